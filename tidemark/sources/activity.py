"""Readers and writers of activity data, labels, predictions and reports.

Paths may be any that Spark can read. Each writer first refuses columns that must not leave
the device.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import scalars
from tidemark.operators import rules
from tidemark.operators.validation import forbidden_columns

_DATA = "app STRING, title STRING, presses DOUBLE, clicks DOUBLE, deltaX DOUBLE, deltaY DOUBLE, scrollX DOUBLE, scrollY DOUBLE"
_BUCKET = f"STRUCT<type: STRING, events: ARRAY<STRUCT<timestamp: STRING, duration: DOUBLE, data: STRUCT<{', '.join(x.replace(' ', ': ', 1) for x in _DATA.split(', ')) }>>>>"
EXPORT = f"buckets MAP<STRING, {_BUCKET}>"
LABELS = "start_ts STRING, end_ts STRING, label STRING, provenance STRING, user_id STRING, confidence DOUBLE, extend_forward BOOLEAN"


def guarded(df: DataFrame) -> DataFrame:
    if found := forbidden_columns(df.schema):
        raise ValueError(f"columns that must not be written: {found}")
    return df


def _events(documents: DataFrame, kind: str) -> DataFrame:
    buckets = documents.select(F.explode("buckets").alias("bucket", "b")).where(F.col("b.type") == kind)
    each = buckets.select(F.explode("b.events").alias("e"))
    return each.select(scalars.parse_instant(F.col("e.timestamp")).alias("ts"), F.coalesce("e.duration", F.lit(0.0)).alias("duration_seconds"), "e.data.*")


def parse_export(documents: DataFrame, salt: str) -> DataFrame:
    """Foreground events of export documents, apps normalised and titles hashed."""
    events = _events(documents, "currentwindow").select("ts", "duration_seconds", F.coalesce("app", F.lit("unknown")).alias("app"), scalars.salted_hash(F.coalesce("title", F.lit("")), salt).alias("window_title_hash"))
    return rules.normalize_app(events).drop("app")


def parse_input_export(documents: DataFrame) -> DataFrame:
    """Input-device samples of export documents; missing counts are 0."""
    count = lambda c, to: F.coalesce(F.col(c), F.lit(0.0)).cast("long").alias(to)
    rows = _events(documents, "os.hid.input")
    return rows.select("ts", "duration_seconds", count("presses", "presses"), count("clicks", "clicks"), count("deltaX", "delta_x"), count("deltaY", "delta_y"), count("scrollX", "scroll_x"), count("scrollY", "scroll_y"))


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Export documents: one JSON object a file, with ``buckets`` or itself the map of buckets."""
    wrapped = spark.read.schema(EXPORT).option("multiLine", True).json(path)
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"MAP<STRING, {_BUCKET}>").alias("buckets"))
    return wrapped.where("buckets IS NOT NULL").unionByName(whole.where("buckets IS NOT NULL AND NOT map_contains_key(buckets, 'buckets')"))


def write_daily(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Parquet by UTC day; days in ``df`` replace those stored."""
    guarded(df).withColumn("date", F.to_date(ts)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def read_features(spark: SparkSession, paths: Sequence[str], first: str, last: str) -> DataFrame:
    """Feature rows of a date range; a date comes from the first path (newest version) that holds it."""
    parts = [spark.read.parquet(p).where(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))).withColumn("_v", F.lit(k)) for k, p in enumerate(paths)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    newest = whole.groupBy("date").agg(F.min("_v").alias("_v"))
    return whole.join(F.broadcast(newest), ["date", "_v"]).drop("_v")


def read_label_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(LABELS).option("header", True).csv(path)
    return rows.withColumns({"start_ts": scalars.parse_instant(F.col("start_ts")), "end_ts": scalars.parse_instant(F.col("end_ts")), "extend_forward": F.coalesce("extend_forward", F.lit(False))}).where("start_ts IS NOT NULL AND end_ts IS NOT NULL")


def write_label_csv(spans: DataFrame, path: str) -> None:
    if spans.isEmpty():
        raise ValueError("no spans to export")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias(c)
    guarded(spans).select(iso("start_ts"), iso("end_ts"), "label", "provenance", "user_id", "confidence", "extend_forward").write.mode("overwrite").option("header", True).csv(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    spans = spark.read.parquet(path)
    return spans.withColumn("confidence", F.when(~F.isnan("confidence"), F.col("confidence")))


def write_predictions(predictions: DataFrame, path: str) -> None:
    """CSV with confidences to four places and probabilities as JSON."""
    guarded(predictions).select("vec_id", "predicted", F.round("confidence", 4).alias("confidence"), F.to_json("probs").alias("probs")).write.mode("overwrite").option("header", True).csv(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("vec_id LONG, predicted STRING, confidence DOUBLE, probs STRING").option("header", True).csv(path)
    return rows.withColumn("probs", F.from_json("probs", "array<double>"))


def write_segments(segments: DataFrame, path: str) -> None:
    guarded(segments).write.mode("overwrite").json(path)


def read_segments(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def report_rows(minutes: DataFrame, label_type: str = "core") -> DataFrame:
    """(date, label_type, label, minutes) with two places, by label within a date."""
    return minutes.groupBy(F.col("date").cast("string").alias("date"), F.lit(label_type).alias("label_type"), "label").agg(F.round(F.sum("minutes"), 2).alias("minutes"))


def write_report(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    guarded(rows).orderBy("date", "label").write.mode("overwrite").format(kind).option("header", True).save(path)


def append_telemetry(snapshot: DataFrame, path: str) -> None:
    guarded(snapshot).write.mode("append").partitionBy("user_id").parquet(path)


def last_telemetry(spark: SparkSession, path: str, n: int) -> DataFrame:
    return spark.read.parquet(path).orderBy(F.desc("ts"), "user_id").limit(n)


def audit_timestamps(df: DataFrame) -> DataFrame:
    """(column, kind, n): how many values of each time column are aware, naive or missing; text by its zone suffix."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields if f.dataType.typeName() in ("timestamp", "timestamp_ntz")}
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name.endswith("_ts")]
    kind = lambda c: F.when(F.col(c).isNull(), "missing").otherwise("aware" if kinds[c] == "timestamp" else "naive")
    spoken = lambda c: F.when(F.col(c).isNull(), "missing").when(F.col(c).rlike(r"(Z|[+-]\d\d:?\d\d)$"), "aware").otherwise("naive")
    cells = [F.struct(F.lit(c).alias("column"), kind(c).alias("kind")) for c in kinds] + [F.struct(F.lit(c).alias("column"), spoken(c).alias("kind")) for c in text]
    return df.select(F.explode(F.array(*cells)).alias("x")).groupBy("x.column", "x.kind").agg(F.count("*").alias("n"))


def localize(df: DataFrame) -> DataFrame:
    """Naive times as UTC instants; doing it twice changes nothing."""
    return df.select(*[F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.typeName() == "timestamp_ntz" else F.col(f.name) for f in df.schema.fields])
