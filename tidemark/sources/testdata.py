"""The driver's tables seen as activity data, in Spark and in DuckDB SQL.

An ``events`` row is a foreground event of key ``user_id``: its value is the duration in
seconds, its type stands for an app, and ``props.k`` for input counts. The SQL texts give
the same views to the oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("k",)
BUCKET = 3600
APPS = {"view": "browser", "click": "editor", "purchase": "chat", "signup": "meeting", "error": "terminal"}
LABELS = {"view": "ReadResearch", "click": "Build", "purchase": "Communicate", "signup": "Meet", "error": "Debug"}
#: Fixed value: class order of the probability vectors.
CLASSES = ("BreakIdle", "Build", "Communicate", "Debug", "Meet", "ReadResearch", "Review", "Write")


def chosen(column: Column, values: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for name, value in values.items():
        out = F.when(column == name, value).otherwise(out)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with its zone-free timestamps cast to UTC instants."""
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return frame.select(*[F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.typeName() == "timestamp_ntz" else F.col(f.name) for f in frame.schema.fields])


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, ts, seq, duration_seconds, app_id, app_category, flags, window_title_hash."""
    events = table(spark, sf_dir, "events")
    n = F.get_json_object("props", "$.k").cast("long")
    app = chosen(F.col("event_type"), APPS)
    return events.select(
        F.col("user_id").alias("k"),
        F.col("ts"),
        F.col("event_id").alias("seq"),
        F.col("value").alias("duration_seconds"),
        app.alias("app_id"),
        app.alias("app_category"),
        (app == "browser").alias("is_browser"),
        (app == "editor").alias("is_editor"),
        (app == "terminal").alias("is_terminal"),
        F.substring(F.sha2(F.concat("event_type", F.lit(":"), (n % 3).cast("string")), 256), 1, 12).alias("window_title_hash"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Input-device samples of the same events; every fourth is idle."""
    # the count is parsed once, not for each column
    events = table(spark, sf_dir, "events").withColumn("n", F.get_json_object("props", "$.k").cast("long"))
    n = F.col("n")
    live = n % 4 != 0
    zero = F.lit(0).cast("long")
    value = lambda c: F.when(live, c).otherwise(zero)
    return events.select(
        F.col("user_id").alias("k"),
        F.col("ts"),
        F.col("event_id").alias("seq"),
        F.col("value").alias("duration_seconds"),
        value(n).alias("presses"),
        value(n % 7).alias("clicks"),
        value(3 * n).alias("delta_x"),
        zero.alias("delta_y"),
        zero.alias("scroll_x"),
        value(n % 5).alias("scroll_y"),
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label spans: an event opens four hours of its label for its user."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("ts").alias("start_ts"),
        (F.col("ts") + F.expr("INTERVAL 4 HOURS")).alias("end_ts"),
        chosen(F.col("event_type"), LABELS).alias("label"),
        F.when(F.col("event_id") % 3 == 0, "manual").otherwise("import").alias("provenance"),
        "user_id",
        F.least(F.lit(1.0), F.col("value") / 100).alias("confidence"),
        (F.col("event_id") % 10 == 0).alias("extend_forward"),
        F.col("event_id").alias("seq"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, user (of 7), day, truth and a probability vector over the eight classes."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    powers = F.transform(F.sequence(F.lit(1), F.lit(len(CLASSES))), lambda i: F.exp(F.round(F.element_at("embedding", i).cast("double"), 4) * 12))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    scored = vectors.select("vec_id", "label", powers.alias("e")).select("vec_id", "label", F.transform("e", lambda x: x / total).alias("probs"))
    names = F.array(*map(F.lit, CLASSES))
    return scored.select(
        "vec_id",
        (F.col("vec_id") % 7).alias("user_id"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("vec_id") % 5).cast("int")).alias("date"),
        F.element_at(names, (F.col("label") % 8 + 1).cast("int")).alias("label"),
        "probs",
        F.element_at(names, F.array_position("probs", F.array_max("probs")).cast("int")).alias("predicted"),
        F.array_max("probs").alias("confidence"),
    )


def sql_quotient(numerator: str, denominator: str | int, digits: int, unit: int = 0) -> str:
    """``scalars.quotient`` in SQL."""
    scaled = f"abs({numerator})" + (f" * {10 ** (digits - unit)}" if digits > unit else "")
    by = f"{denominator}" + (f" * {10 ** (unit - digits)}" if digits < unit else "")
    return f"(sign({numerator}) * ((2 * {scaled} + {by}) // (2 * ({by}))) / {10**digits})"


def _case(column: str, values: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in values.items()) + " END"


_N = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
SQL_ACTIVITY = f"""act AS (
  SELECT user_id AS k, ts, event_id AS seq, value AS dur, {_case("event_type", APPS)} AS app,
         substr(sha256(event_type || ':' || ({_N} % 3)), 1, 12) AS title,
         CAST(floor(epoch(ts) / {BUCKET}) AS BIGINT) * {BUCKET} AS b FROM events)"""
SQL_SAMPLES = f"""smp AS (
  SELECT user_id AS k, ts, event_id AS seq, value AS dur, CASE WHEN n % 4 <> 0 THEN n ELSE 0 END AS presses,
         CASE WHEN n % 4 <> 0 THEN n % 7 ELSE 0 END AS clicks, CASE WHEN n % 4 <> 0 THEN 3 * n ELSE 0 END AS dx,
         CASE WHEN n % 4 <> 0 THEN n % 5 ELSE 0 END AS sy, CAST(floor(epoch(ts) / {BUCKET}) AS BIGINT) * {BUCKET} AS b
  FROM (SELECT *, {_N} AS n FROM events))"""
SQL_SPANS = f"""spn AS (
  SELECT ts AS start_ts, ts + INTERVAL 4 HOUR AS end_ts, {_case("event_type", LABELS)} AS label,
         CASE WHEN event_id % 3 = 0 THEN 'manual' ELSE 'import' END AS provenance, user_id,
         least(1.0::DOUBLE, value / 100) AS confidence, event_id % 10 = 0 AS extend_forward, event_id AS seq
  FROM events)"""
_CLASS_LIST = "[" + ", ".join(f"'{c}'" for c in CLASSES) + "]"
SQL_PREDICTIONS = f"""prd0 AS (
  SELECT vec_id, label, list_transform(embedding[1:{len(CLASSES)}], lambda x: exp(round(x::DOUBLE, 4) * 12)) AS e FROM embeddings),
prd1 AS (SELECT vec_id, label, list_transform(e, lambda x: x / list_sum(e)) AS probs FROM prd0),
prd AS (
  SELECT vec_id, vec_id % 7 AS user_id, DATE '2024-01-01' + CAST(vec_id % 5 AS INTEGER) AS date, {_CLASS_LIST}[label % 8 + 1] AS label, probs,
         {_CLASS_LIST}[list_position(probs, list_max(probs))] AS predicted, list_max(probs) AS confidence FROM prd1)"""
