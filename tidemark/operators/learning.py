"""Dataset building, splits, calibration fits and model-run ranking."""

from __future__ import annotations

import json
import math
import random
from collections.abc import Iterable, Iterator, Mapping, Sequence
from decimal import Decimal
from multiprocessing.pool import ThreadPool

import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import scans

UNKNOWN = "__unknown__"


def drop_short_sessions(df: DataFrame, keys: Sequence[str], least: int = 3) -> DataFrame:
    """Rows of sessions with at least ``least`` rows; counts are joined back, so a long session meets no single task."""
    kept = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(*keys)
    return df.join(kept, list(keys), "left_semi")


def drop_blank_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.where(F.coalesce(*[F.col(c).cast("double") for c in columns]).isNotNull())


def time_split(df: DataFrame, user: str = "user_id", order: Sequence[str] = ("bucket",), shares: tuple[float, float] = (0.70, 0.15), holdout: DataFrame | None = None) -> DataFrame:
    """``split``: the first 70 % of each user's rows train, the next 15 % validate, the rest test; held-out users test.

    Cut points are int(n * share) and int(n * (share + share)), of shares as decimal numbers: 70 % of 90 rows are 63, not 62.
    """
    w = Window.partitionBy(user)
    ranked = df.withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w)})
    train, val = (Decimal(str(share)) for share in shares)
    first, second = F.floor(F.col("_n") * F.lit(train)), F.floor(F.col("_n") * F.lit(train + val))
    split = F.when(F.col("_i") < first, "train").when(F.col("_i") < second, "val").otherwise("test")
    if holdout is not None:
        ranked = ranked.join(holdout.select(user, F.lit(True).alias("_h")), user, "left")
        split = F.when(F.col("_h"), "test").otherwise(split)
    return ranked.withColumn("split", split).drop("_i", "_n", "_h")


def holdout_users(df: DataFrame, share: float, seed: int = 42, user: str = "user_id") -> DataFrame:
    """The first max(1, int(n * share)) users by SHA-256 of seed:user."""
    users = df.select(user).distinct().withColumn("_h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(user).cast("string")), 256))
    n = max(1, int(users.count() * share))
    return users.orderBy("_h").limit(n).select(user)


def training_set(features: DataFrame, spans: DataFrame, columns: Sequence[str], session_keys: Sequence[str], least: int = 3, seconds: int = 60, cell: int = 6 * 3600) -> DataFrame:
    """Labelled rows (user_id, bucket, ...) after exclusions, with their split; spans meet rows in cells of ``cell`` seconds."""
    from tidemark.operators.intervals import project_labels

    windows = features.select("user_id", F.col("bucket").alias("start"), F.timestamp_seconds(F.unix_seconds("bucket") + seconds).alias("end"))
    labels = project_labels(windows, spans, cell).select("user_id", F.col("start").alias("bucket"), "label")
    labelled = features.join(labels, ["user_id", "bucket"])
    return time_split(drop_blank_rows(drop_short_sessions(labelled, session_keys, least), columns))


def fingerprint(df: DataFrame) -> DataFrame:
    """One digest of a table's content, whatever the order of its rows: sums of row digests in four parts."""
    names = sorted(df.columns)
    row = F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(4)]
    return df.agg(F.substring(F.sha2(F.concat_ws(":", F.count("*").cast("string"), *parts), 256), 1, 16).alias("fingerprint"))


def dataset_snapshot(df: DataFrame, ts: str = "bucket") -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.min(F.to_date(ts)).cast("string").alias("first_date"), F.max(F.to_date(ts)).cast("string").alias("last_date"), F.countDistinct("user_id").alias("users"), F.countDistinct("label").alias("labels"))


def encode_category(df: DataFrame, column: str, train: Column, least: int = 5, mask: float = 0.05, key: Column | None = None) -> DataFrame:
    """``<column>_code``: index in the alphabetical training vocabulary, unknown for rare or masked values, -1 if there is none.

    A hash of the row's key masks a share of the known training rows.
    """
    counts = df.where(train).groupBy(column).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    known = counts.select(F.col(column).cast("string").alias("_v")).unionByName(df.sparkSession.createDataFrame([(UNKNOWN,)], "_v string"))
    vocabulary = scans.numbered(known, ["_v"], "_code").withColumn("_code", F.col("_code").cast("int"))
    masked = F.lit(False) if key is None else train & (F.pmod(F.xxhash64(key), F.lit(10_000)) < int(mask * 10_000))
    value = F.when(masked, UNKNOWN).otherwise(F.col(column).cast("string"))
    unknown = vocabulary.where(F.col("_v") == UNKNOWN).select(F.col("_code").alias("_u"))
    joined = df.withColumn("_v", value).join(vocabulary, "_v", "left").join(F.broadcast(unknown), how="left")
    return joined.withColumn(f"{column}_code", F.coalesce("_code", "_u", F.lit(-1))).drop("_v", "_code", "_u")


def balanced_weights(df: DataFrame, classes: Sequence[str]) -> DataFrame:
    """``weight`` = n / (k * count of the class); k is the highest class index there is, plus one."""
    index = F.array_position(F.array(*map(F.lit, classes)), F.col("label"))
    counts = df.groupBy("label").agg(F.count("*").alias("_c"))
    totals = counts.agg(F.sum("_c").alias("_n"), F.max(index).alias("_k"))
    weights = counts.join(F.broadcast(totals)).select("label", (F.col("_n") / (F.col("_k") * F.col("_c"))).alias("weight"))
    return df.join(F.broadcast(weights), "label")


def feature_vector(df: DataFrame, columns: Sequence[str], to: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    filled = df.fillna(0, list(columns))
    return VectorAssembler(inputCols=list(columns), outputCol=to).transform(filled)


def train_classifier(df: DataFrame, columns: Sequence[str], classes: Sequence[str], kind: str = "logistic", **params):
    """A fitted pipeline on rows (label, columns), classes weighted evenly."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import StringIndexerModel, VectorAssembler

    indexer = StringIndexerModel.from_labels(list(classes), inputCol="label", outputCol="label_index", handleInvalid="skip")
    vectors = VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="keep")
    common = {"featuresCol": "features", "labelCol": "label_index", "weightCol": "weight"}
    if kind == "logistic":
        model = LogisticRegression(**common, **({"maxIter": 50, "regParam": 0.01} | params))
    else:
        model = RandomForestClassifier(**common, **({"numTrees": 20, "maxDepth": 6, "seed": 7} | params))
    return Pipeline(stages=[indexer, vectors, model]).fit(balanced_weights(df.fillna(0, list(columns)), classes))


def score(model, df: DataFrame, columns: Sequence[str], classes: Sequence[str]) -> DataFrame:
    """``probs``, ``predicted`` and ``confidence`` of each row."""
    from pyspark.ml.functions import vector_to_array

    rows = df.fillna(0, list(columns))
    rows = rows.withColumn("weight", F.lit(1.0)) if "label" in rows.columns else rows.withColumns({"label": F.lit(classes[0]), "weight": F.lit(1.0)})
    scored = model.transform(rows).withColumn("probs", vector_to_array("probability"))
    names = F.array(*map(F.lit, classes))
    return scored.select(*df.columns, "probs", F.element_at(names, F.array_position("probs", F.array_max("probs")).cast("int")).alias("predicted"), F.array_max("probs").alias("confidence"))


def sample_settings(space: Mapping[str, Sequence | tuple[float, float]], n: int, seed: int = 7) -> list[dict]:
    """``n`` settings: one of a list's values, or a number of a (low, high) range on a logarithmic scale, by seed and number of the trial."""
    settings = []
    for trial in range(n):
        rng = random.Random(f"{seed}:{trial}")
        drawn = {}
        for name, values in sorted(space.items()):
            drawn[name] = float(f"{math.exp(rng.uniform(math.log(values[0]), math.log(values[1]))):.6g}") if isinstance(values, tuple) else rng.choice(list(values))
        settings.append(drawn)
    return settings


def search(df: DataFrame, columns: Sequence[str], classes: Sequence[str], settings: Sequence[dict], parallelism: int = 4) -> DataFrame:
    """(trial, params, macro_f1, rank): macro F1 on the validation split of a model for each setting, fitted on the training split.

    ``parallelism`` fits run at a time, as jobs on one kept split. The driver holds one row for each setting; of equal ones the first ranks first.
    """
    from tidemark.operators.metrics import f1_scores

    spark = df.sparkSession
    train, held = df.where("split = 'train'").persist(), df.where("split = 'val'").persist()

    def trial(number: int) -> tuple[int, str, float]:
        model = train_classifier(train, columns, classes, **settings[number])
        return number, json.dumps(settings[number], sort_keys=True), f1_scores(score(model, held, columns, classes), classes).first()["macro_f1"]

    with ThreadPool(max(1, parallelism)) as pool:
        made = pool.map(inheritable_thread_target(spark)(trial), range(len(settings)), chunksize=1)
    train.unpersist(), held.unpersist()
    ranked = sorted(made, key=lambda r: (-r[2], r[0]))
    rows = sorted((*r, k) for k, r in enumerate(ranked, 1))
    return spark.createDataFrame(rows, "trial int, params string, macro_f1 double, rank int")


def eligible_users(df: DataFrame, windows: int = 200, days: int = 3, labels: int = 3) -> DataFrame:
    counts = df.groupBy("user_id").agg(F.count("*").alias("windows"), F.countDistinct(F.to_date("bucket")).alias("days"), F.countDistinct("label").alias("labels"))
    return counts.withColumn("eligible", (F.col("windows") >= windows) & (F.col("days") >= days) & (F.col("labels") >= labels))


def _grid_loss(df: DataFrame, classes: Sequence[str], temperatures: Column, keys: Sequence[str]) -> DataFrame:
    """Mean negative log-likelihood of each temperature."""
    at = F.array_position(F.array(*map(F.lit, classes)), F.col("label")).cast("int")
    logs = df.withColumn("_l", F.transform("probs", lambda p: F.ln(F.greatest(p, F.lit(1e-12))))).withColumn("_at", at).where("_at > 0")
    each = logs.select(*keys, "_l", "_at", F.explode(temperatures).alias("temperature")).withColumn("_x", F.transform("_l", lambda x: x / F.col("temperature")))
    top = F.array_max("_x")
    loss = top + F.ln(F.aggregate("_x", F.lit(0.0), lambda t, x: t + F.exp(x - F.array_max("_x")))) - F.element_at("_x", F.col("_at"))
    return each.groupBy(*keys, "temperature").agg(F.avg(loss).alias("loss"))


def fit_temperature(df: DataFrame, classes: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Temperature with the least loss: 0.1 to 5.0 by 0.1, then around the best by 0.01; 1 wins ties."""
    coarse = F.array(*[F.lit(round(k / 10, 1)) for k in range(1, 51)])
    best = lambda losses: losses.groupBy(*keys).agg(F.min_by("temperature", F.struct("loss", F.abs(F.col("temperature") - 1))).alias("_t"))
    first = best(_grid_loss(df, classes, coarse, keys))
    # one row without keys; with keys a row for each of them, joined as Spark chooses
    joined = df.join(first, list(keys)) if keys else df.join(F.broadcast(first))
    fine = F.filter(F.transform(F.sequence(F.lit(-10), F.lit(10)), lambda k: F.round(F.col("_t") + k / 100, 2)), lambda t: t > 0)
    return best(_grid_loss(joined, classes, fine, keys)).select(*keys, F.col("_t").alias("temperature"))


def calibrators(df: DataFrame, classes: Sequence[str], **limits: int) -> DataFrame:
    """A temperature for each eligible user, and the global one with a null user."""
    users = eligible_users(df, **limits).where("eligible").select("user_id")
    own = fit_temperature(df.join(users, "user_id", "left_semi"), classes, ["user_id"])
    everyone = fit_temperature(df, classes).select(F.lit(None).cast(df.schema["user_id"].dataType).alias("user_id"), "temperature")
    return own.unionByName(everyone)


def pool_adjacent(blocks: Iterable[tuple]) -> list[tuple]:
    """Neighbouring (first, last, n, hits) blocks in order pooled until shares rise; shares are compared in whole numbers."""
    done: list[tuple] = []
    for first, last, n, hits in blocks:
        while done and done[-1][3] * n >= hits * done[-1][2]:
            first, _, m, h = done.pop()
            n, hits = n + m, hits + h
        done.append((first, last, n, hits))
    return done


def isotonic_blocks(df: DataFrame, classes: Sequence[str]) -> DataFrame:
    """(class, first, last, n, hits): the pooled blocks of each class's isotonic fit to the unrounded probabilities.

    Distinct probabilities are sorted over ranges and pooled range by range; what the ranges leave is pooled once more for each class. The
    order of pooling does not change the result. Shares that rise strictly need ever larger denominators, so a class of
    n rows leaves less than 2 n ** (2 / 3) blocks in all, and each range no more than that of its rows.
    """
    schema = "class INT, first DOUBLE, last DOUBLE, n LONG, hits LONG"
    each = df.select("label", F.posexplode("probs").alias("class", "x")).where("x IS NOT NULL AND NOT isnan(x)")
    hit = (F.col("label") == F.get(F.array(*map(F.lit, classes)), F.col("class"))).cast("long")
    points = each.where(F.col("class") < len(classes)).groupBy("class", "x").agg(F.count("*").alias("n"), F.sum(F.coalesce(hit, F.lit(0))).alias("hits"))
    ranged = points.select("class", F.col("x").alias("first"), F.col("x").alias("last"), "n", "hits").repartitionByRange("class", "first").sortWithinPartitions("class", "first")

    def frame(name: int, blocks: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(blocks, columns=["first", "last", "n", "hits"]).assign(**{"class": name})[["class", "first", "last", "n", "hits"]]

    def pool_range(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple[int, list[tuple]] | None = None
        for part in frames:
            for name, rows in part.groupby("class", sort=True):
                if held and held[0] != name:
                    yield frame(*held)
                    held = None
                held = (int(name), pool_adjacent([*(held[1] if held else []), *rows[["first", "last", "n", "hits"]].itertuples(index=False, name=None)]))
        if held:
            yield frame(*held)

    def pool_class(rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.sort_values("first")
        return frame(int(rows["class"].iloc[0]), pool_adjacent(ordered[["first", "last", "n", "hits"]].itertuples(index=False, name=None)))

    return ranged.mapInPandas(pool_range, schema).groupBy("class").applyInPandas(pool_class, schema)


def fit_isotonic(df: DataFrame, classes: Sequence[str]) -> dict[int, tuple[list[float], list[float]]]:
    """(boundaries, values) of each class's isotonic fit, for ``rules.apply_isotonic``: both ends of each block of ``isotonic_blocks``."""
    curves: dict[int, tuple[list[float], list[float]]] = {}
    for r in isotonic_blocks(df, classes).orderBy("class", "first").collect():
        xs, ys = curves.setdefault(r["class"], ([], []))
        for x in dict.fromkeys((r["first"], r["last"])):
            xs.append(x), ys.append(r["hits"] / r["n"])
    return curves


def rank_runs(runs: DataFrame, schema_hash: str, labels: Sequence[str]) -> DataFrame:
    """Runs with the reason why they are left out, or their rank by macro F1, weighted F1 and age."""
    wanted = F.array_sort(F.array(*map(F.lit, labels)))
    reason = F.when(F.col("macro_f1").isNull() | F.col("weighted_f1").isNull(), "invalid").when(F.col("schema_hash") != schema_hash, "schema").when(F.array_sort("label_set") != wanted, "labels")
    judged = runs.withColumn("reason", reason)
    order = Window.partitionBy(F.col("reason").isNull()).orderBy(F.desc("macro_f1"), F.desc("weighted_f1"), F.desc("created_at"), "model_id")  # a registry of runs
    return judged.withColumn("rank", F.when(F.col("reason").isNull(), F.row_number().over(order)))


def due_for_refresh(runs: DataFrame, now: Column, days: int) -> DataFrame:
    newest = runs.agg(F.max("created_at").alias("newest"))
    age = (F.unix_seconds(now) - F.unix_seconds("newest")) / 86_400
    return newest.select(F.unix_seconds("newest").alias("newest"), (F.col("newest").isNull() | (age > days)).alias("due"))
