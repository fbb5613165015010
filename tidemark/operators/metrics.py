"""Evaluation metrics as long tables, all derived from counts of (true, predicted)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIXED = "Mixed/Unknown"


def _labels(df: DataFrame, labels: Sequence[str], name: str = "label") -> DataFrame:
    """One row for each label of a fixed list."""
    return df.sparkSession.createDataFrame([(x,) for x in labels], f"{name} string")


def confusion(df: DataFrame, labels: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Counts for every (label, predicted) of the list; predictions outside of it are left out."""
    counts = df.where(F.col("label").isin(*labels) & F.col("predicted").isin(*labels)).groupBy(*keys, "label", "predicted").agg(F.count("*").alias("n"))
    groups = df.select(*keys).distinct() if keys else None
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("predicted")) for a in labels for b in labels]))
    grid = (groups if groups is not None else df.sparkSession.range(1)).select(*keys, cells.alias("c")).select(*keys, "c.label", "c.predicted")
    return grid.join(counts, [*keys, "label", "predicted"], "left").fillna(0, ["n"])


def per_class(df: DataFrame, labels: Sequence[str], keys: Sequence[str] = (), digits: int = 4) -> DataFrame:
    """precision, recall, f1 and support of each listed label; a zero denominator gives 0."""
    both = F.explode(F.array(F.struct(F.col("label").alias("l"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col("label") == F.col("predicted")).cast("int").alias("h")), F.struct(F.col("predicted").alias("l"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("h"))))
    counts = df.select(*keys, both.alias("x")).groupBy(*keys, F.col("x.l").alias("label")).agg(F.sum("x.t").alias("support"), F.sum("x.p").alias("predicted"), F.sum("x.h").alias("hits"))
    groups = df.select(*keys).distinct() if keys else df.sparkSession.range(1)
    grid = groups.select(*keys, F.explode(F.array(*map(F.lit, labels))).alias("label"))
    joined = grid.join(counts, [*keys, "label"], "left").fillna(0, ["support", "predicted", "hits"])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    f1 = ratio(2 * F.col("hits"), F.col("support") + F.col("predicted"))
    return joined.select(*keys, "label", F.round(ratio(F.col("hits"), F.col("predicted")), digits).alias("precision"), F.round(ratio(F.col("hits"), F.col("support")), digits).alias("recall"), F.round(f1, digits).alias("f1"), F.col("support"))


def f1_scores(df: DataFrame, labels: Sequence[str], keys: Sequence[str] = (), digits: int = 4) -> DataFrame:
    """Macro F1 over all listed labels and F1 weighted by support."""
    each = per_class(df, labels, keys, 15)
    weighted = F.coalesce(F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")), F.lit(0.0))
    return each.groupBy(*keys).agg(F.round(F.avg("f1"), digits).alias("macro_f1"), F.round(weighted, digits).alias("weighted_f1"))


def class_distribution(df: DataFrame, labels: Sequence[str], keys: Sequence[str] = (), column: str = "label") -> DataFrame:
    total = F.sum(F.lit(1))
    counts = df.groupBy(*keys, F.col(column).alias("label")).agg(total.alias("n"))
    groups = df.groupBy(*keys).agg(F.count("*").alias("total"))
    grid = groups.select(*keys, "total", F.explode(F.array(*map(F.lit, labels))).alias("label"))
    joined = grid.join(counts, [*keys, "label"], "left").fillna(0, ["n"])
    return joined.select(*keys, "label", "n", F.round(F.coalesce(F.try_divide("n", "total"), F.lit(0.0)), 4).alias("fraction"))


def reject_rate(df: DataFrame, keys: Sequence[str] = (), column: str = "predicted") -> DataFrame:
    return df.groupBy(*keys).agg(F.round(F.avg((F.col(column) == MIXED).cast("int")), 4).alias("reject_rate"))


def compare(df: DataFrame, methods: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Scores of several prediction columns against one truth, and their macro-F1 gain over the first."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("predicted")) for m in methods]))
    long = df.select("label", each.alias("x")).select("label", "x.*")
    scores = f1_scores(long, [*labels, MIXED], ["method"]).join(reject_rate(long, ["method"]), "method")
    base = scores.where(F.col("method") == methods[0]).select(F.col("macro_f1").alias("_base"))
    return scores.join(F.broadcast(base)).withColumn("gain", F.round(F.col("macro_f1") - F.col("_base"), 4)).drop("_base")


def slices(df: DataFrame, columns: Sequence[str], labels: Sequence[str], top: int = 100) -> DataFrame:
    """Rows, F1 scores and reject rate for the most frequent values of each column."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    long = df.select("label", "predicted", each.alias("x")).select("label", "predicted", "x.*")
    sizes = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    kept = sizes.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top).drop("_r")
    inside = long.join(kept.select("column", "value"), ["column", "value"], "left_semi")
    return kept.join(f1_scores(inside, labels, ["column", "value"]), ["column", "value"]).join(reject_rate(inside, ["column", "value"]), ["column", "value"])


def _binned(df: DataFrame, labels: Sequence[str], bins: int, right_closed: bool, keys: Sequence[str] = ()) -> DataFrame:
    names = F.array(*map(F.lit, labels))
    long = df.select(*keys, "label", F.posexplode("probs").alias("c", "p")).select(*keys, F.get(names, F.col("c")).alias("class"), (F.get(names, F.col("c")) == F.col("label")).cast("int").alias("y"), "p")
    bin_ = F.greatest(F.ceil(F.col("p") * bins) - 1, F.lit(0)) if right_closed else F.least(F.floor(F.col("p") * bins), F.lit(bins - 1))
    return long.withColumn("bin", bin_.cast("int"))


def calibration_curve(df: DataFrame, labels: Sequence[str], bins: int = 10) -> DataFrame:
    """Share of positives and mean probability of each class and right-closed bin; classes without positives are left out."""
    curve = _binned(df, labels, bins, True).groupBy("class", "bin").agg(F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("accuracy"), F.round(F.avg("p"), 6).alias("confidence"))
    present = df.select(F.col("label").alias("class")).distinct()
    return curve.join(present, "class", "left_semi")


def calibration_error(df: DataFrame, labels: Sequence[str], bins: int = 10) -> DataFrame:
    """Expected calibration error of each class, and its support."""
    cells = _binned(df, labels, bins, False).groupBy("class", "bin").agg(F.count("*").alias("n"), F.sum("y").alias("y"), F.sum("p").alias("p"))
    return cells.groupBy("class").agg(F.round(F.try_divide(F.sum(F.abs(F.col("y") - F.col("p"))), F.sum("n")), 6).alias("ece"), F.sum("y").alias("support"))


def _one_hot(labels: Sequence[str]) -> Column:
    return F.transform(F.array(*map(F.lit, labels)), lambda x: (x == F.col("label")).cast("double"))


def brier(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    squares = F.aggregate(F.zip_with("probs", _one_hot(labels), lambda p, y: (p - y) * (p - y)), F.lit(0.0), lambda t, x: t + x)
    return df.agg(F.round(F.avg(squares), 6).alias("brier"))


def log_loss(df: DataFrame, labels: Sequence[str], least: float = 1e-15) -> DataFrame:
    p = F.element_at("probs", F.array_position(F.array(*map(F.lit, labels)), F.col("label")).cast("int"))
    return df.where(F.col("label").isin(*labels)).agg(F.round(F.avg(-F.ln(F.least(F.greatest(p, F.lit(least)), F.lit(1 - least)))), 6).alias("log_loss"))


def top_confusions(df: DataFrame, labels: Sequence[str], k: int = 10) -> DataFrame:
    wrong = df.where(F.col("label").isin(*labels) & F.col("predicted").isin(*labels) & (F.col("label") != F.col("predicted")))
    return wrong.groupBy("label", "predicted").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label", "predicted").limit(k)


def unknown_rates(df: DataFrame, vocabulary: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of values that the training vocabulary (column, value) lacks, for each column."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    counts = df.select(each.alias("x")).select("x.*").groupBy("column", "value").agg(F.count("*").alias("n"))
    joined = counts.join(vocabulary.select("column", "value", F.lit(True).alias("_known")).distinct(), ["column", "value"], "left")
    return joined.groupBy("column").agg(F.round(F.sum(F.when(F.col("_known").isNull(), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("unknown_rate"))


def user_strata(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Rows, share and label counts of each user; users above half of all rows are flagged."""
    counts = df.groupBy("user_id").agg(F.count("*").alias("n"), *[F.count_if(F.col("label") == x).alias(f"n_{x}") for x in labels])
    total = counts.agg(F.sum("n").alias("_t"))
    return counts.join(F.broadcast(total)).withColumns({"share": F.round(F.col("n") / F.col("_t"), 4)}).withColumn("dominant", F.col("n") / F.col("_t") > 0.5).drop("_t")


def reject_by_group(df: DataFrame, keys: Sequence[str] = ("user_id", "date"), times: float = 2.0) -> DataFrame:
    """Reject rate of each group, flagged above ``times`` the overall rate."""
    rejected = (F.col("predicted") == MIXED).cast("int")
    groups = df.groupBy(*keys).agg(F.avg(rejected).alias("rate"))
    whole = df.agg(F.avg(rejected).alias("_all"))
    return groups.join(F.broadcast(whole)).select(*keys, F.round("rate", 4).alias("reject_rate"), (F.col("rate") > times * F.col("_all")).alias("flagged"))


#: Fixed values: (metric, label or empty, comparison, bound).
GATES = (("macro_f1", "", ">=", 0.65), ("weighted_f1", "", ">=", 0.70), ("precision", "BreakIdle", ">=", 0.95), ("recall", "BreakIdle", ">=", 0.90), ("min_precision", "", ">=", 0.50), ("reject_rate", "", ">=", 0.05), ("reject_rate", "", "<=", 0.30), ("seen_macro_f1", "", ">=", 0.70), ("unseen_macro_f1", "", ">=", 0.60))


def metric_table(df: DataFrame, labels: Sequence[str], seen: Column | None = None) -> DataFrame:
    """(metric, label, value) rows of an evaluation; ``seen`` tells users of the training set."""
    each = per_class(df, labels)
    long = each.select("label", F.explode(F.map_from_arrays(F.array(*map(F.lit, ("precision", "recall", "f1"))), F.array("precision", "recall", "f1"))).alias("metric", "value"))
    whole = f1_scores(df, labels).select(F.explode(F.map_from_arrays(F.array(F.lit("macro_f1"), F.lit("weighted_f1")), F.array("macro_f1", "weighted_f1"))).alias("metric", "value"))
    rows = [long.select("metric", "label", "value"), whole.select("metric", F.lit("").alias("label"), "value"), each.agg(F.min("precision").alias("value")).select(F.lit("min_precision").alias("metric"), F.lit("").alias("label"), "value"), reject_rate(df).select(F.lit("reject_rate").alias("metric"), F.lit("").alias("label"), F.col("reject_rate").alias("value"))]
    if seen is not None:
        by = f1_scores(df.withColumn("_seen", seen), labels, ["_seen"])
        rows.append(by.select(F.when(F.col("_seen"), "seen_macro_f1").otherwise("unseen_macro_f1").alias("metric"), F.lit("").alias("label"), F.col("macro_f1").alias("value")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def acceptance(metrics: DataFrame, gates: Sequence[tuple] = GATES) -> DataFrame:
    """Each gate with the metric's value and whether it passes; a missing metric fails."""
    table = metrics.sparkSession.createDataFrame(list(gates), "metric string, label string, comparison string, bound double")
    joined = table.join(metrics, ["metric", "label"], "left")
    passes = F.when(F.col("comparison") == ">=", F.col("value") >= F.col("bound")).otherwise(F.col("value") <= F.col("bound"))
    return joined.select("metric", "label", "comparison", "bound", "value", F.coalesce(passes, F.lit(False)).alias("passed"))


def threshold_sweep(df: DataFrame, labels: Sequence[str], thresholds: Sequence[float] = tuple(round(0.10 + 0.05 * k, 2) for k in range(18))) -> DataFrame:
    """Accuracy on accepted rows, reject rate, coverage and macro F1 for each reject threshold, from one pass over the rows.

    The thresholds are a fixed short list, so each row meets a constant number of them.
    """
    each = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    rows = df.select("label", F.col("predicted").alias("_p"), "confidence", each).withColumn("predicted", F.when(F.col("confidence") < F.col("threshold"), MIXED).otherwise(F.col("_p")))
    accepted = F.col("predicted") != MIXED
    counts = rows.groupBy("threshold").agg(
        F.round(F.coalesce(F.try_divide(F.count_if(accepted & (F.col("label") == F.col("predicted"))), F.count_if(accepted)), F.lit(0.0)), 4).alias("accuracy"),
        F.round(F.count_if(~accepted) / F.count("*"), 4).alias("reject_rate"), F.round(F.count_if(accepted) / F.count("*"), 4).alias("coverage"),
    )
    return counts.join(f1_scores(rows, labels, ["threshold"]).select("threshold", "macro_f1"), "threshold")


def best_threshold(sweep: DataFrame, low: float = 0.05, high: float = 0.30, default: float = 0.55) -> DataFrame:
    """Threshold with the best accuracy whose reject rate is in bounds; the first wins a tie."""
    inside = sweep.where(F.col("reject_rate").between(low, high))
    return inside.agg(F.coalesce(F.min_by("threshold", F.struct(-F.col("accuracy"), F.col("threshold"))), F.lit(default)).alias("threshold"))


#: What a candidate's own metrics have to reach, beside the acceptance gates.
CANDIDATE_FLOORS = (("breakidle_precision", "precision", "BreakIdle", 0.95), ("no_class_below_50_precision", "min_precision", "", 0.50))


def candidate_gates(challenger: DataFrame, gates: Sequence[tuple] = GATES) -> DataFrame:
    """(gate, value, passed) of a candidate by itself: BreakIdle precision, least class precision, and the number of acceptance gates that fail.

    A metric that is missing fails, as in ``acceptance``.
    """
    floors = challenger.sparkSession.createDataFrame(list(CANDIDATE_FLOORS), "gate string, metric string, label string, floor double")
    held = floors.join(challenger, ["metric", "label"], "left").select("gate", "value", F.coalesce(F.col("value") >= F.col("floor"), F.lit(False)).alias("passed"))
    failed = acceptance(challenger, gates).agg(F.count_if(~F.col("passed")).cast("double").alias("value"))
    return held.unionByName(failed.select(F.lit("challenger_acceptance").alias("gate"), "value", (F.col("value") == 0).alias("passed")))


def regression_gates(champion: DataFrame, challenger: DataFrame, tolerance: float = 0.02, gates: Sequence[tuple] = GATES) -> DataFrame:
    """Challenger against champion: macro F1 may drop by the tolerance; and the candidate's own gates."""
    macro = lambda table, name: table.where("metric = 'macro_f1'").select(F.col("value").alias(name))
    drop = F.round(F.col("champion") - F.col("challenger"), 4)
    compared = macro(champion, "champion").join(F.broadcast(macro(challenger, "challenger"))).select(F.lit("macro_f1_no_regression").alias("gate"), drop.alias("value"), (drop <= tolerance).alias("passed"))
    return compared.unionByName(candidate_gates(challenger, gates))


def evaluation_modes(df: DataFrame, labels: Sequence[str], temperature: float, threshold: float, keys: Sequence[str], seconds: int, size: int = 5, seen: Column | None = None) -> DataFrame:
    """macro_f1, weighted_f1 and reject_rate, and macro F1 of seen and unseen users, of each mode.

    ``df`` has (keys, bucket, label, probs). raw rejects by the raw confidence, calibrated takes every calibrated prediction,
    calibrated_reject rejects again, smoothed votes over a key's neighbouring buckets after that, and interval takes the share of smoothed segments that begin
    with a true segment of their label in place of both F1 scores.
    """
    from tidemark.operators import intervals, rules, segments

    def judged(name: str, probs: Column, least: float | None) -> DataFrame:
        best = rules.argmax_label(probs, labels)
        return df.select(*df.columns, (best if least is None else rules.reject(best, F.array_max(probs), F.lit(least))).alias("predicted"), F.lit(name).alias("mode"))

    probs, calibrated = F.col("probs"), rules.apply_temperature(F.col("probs"), F.lit(temperature))
    rejecting = judged("calibrated_reject", calibrated, threshold)
    votes = segments.rolling_majority(rejecting, keys, size, "predicted").drop("predicted").withColumnRenamed("smoothed", "predicted")
    smoothed = [votes.withColumn("mode", F.lit(m)).select(*rejecting.columns) for m in ("smoothed", "interval")]
    rows = judged("raw", probs, threshold).unionByName(judged("calibrated", calibrated, None)).unionByName(rejecting).unionByName(smoothed[0]).unionByName(smoothed[1])
    runs = lambda label: segments.segmentize(smoothed[0].select(*keys, "bucket", F.col(label).alias("label")), keys, seconds)
    hit = intervals.interval_accuracy(runs("predicted"), runs("label"), list(keys)).select(F.lit("interval").alias("mode"), F.round("accuracy", 4).alias("_accuracy"))
    out = f1_scores(rows, labels, ["mode"]).join(reject_rate(rows, ["mode"]), "mode").join(F.broadcast(hit), "mode", "left")
    out = out.withColumns({c: F.coalesce("_accuracy", c) for c in ("macro_f1", "weighted_f1")}).drop("_accuracy")
    if seen is None:
        return out
    by = f1_scores(rows.withColumn("_seen", seen), labels, ["mode", "_seen"]).groupBy("mode").agg(*[F.max(F.when(F.col("_seen") == flag, F.col("macro_f1"))).alias(f"{name}_macro_f1") for name, flag in (("seen", True), ("unseen", False))])
    return out.join(by, "mode", "left")
