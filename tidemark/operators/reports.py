"""Daily reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import drift, rules, segments


def daily_minutes(segs: DataFrame, keys: Sequence[str], seconds: int, label: str = "label") -> DataFrame:
    """Minutes and segments of each label and day (the day a segment starts)."""
    return segs.groupBy(*keys, F.to_date("start_ts").alias("date"), F.col(label).alias("label")).agg(F.round(F.sum("buckets") * seconds / 60, 2).alias("minutes"), F.count("*").alias("segments"))


def final_report(rows: DataFrame, keys: Sequence[str], seconds: int) -> DataFrame:
    """What a stream has left in its sink, (keys, bucket, label, smoothed), as (section, keys, name, value) rows.

    Minutes of each day and label from the smoothed segments, rates of label changes before and after smoothing, and the telemetry of all
    rows: their number, the first and the last bucket in seconds, reject rate and class shares.
    """
    smooth = rows.select(*keys, "bucket", F.col("smoothed").alias("label"))
    own = [F.col(k).cast("string").alias(k) for k in keys]
    minutes = daily_minutes(segments.segmentize(smooth, keys, seconds), keys, seconds).select(F.lit("minutes").alias("section"), *own, F.concat_ws(" ", F.col("date").cast("string"), "label").alias("name"), F.col("minutes").alias("value"))
    flaps = [segments.flap_rate(df, keys).select(F.lit("flap_rate").alias("section"), *own, F.lit(name).alias("name"), F.round("flap_rate", 4).alias("value")) for name, df in (("raw", rows), ("smoothed", smooth))]
    state = drift.class_shares(smooth, "label", "bucket")
    named = [F.struct(F.lit(c).alias("name"), v.cast("double").alias("value")) for c, v in (("rows", F.col("rows")), ("first_window", F.unix_seconds("first_window")), ("last_window", F.unix_seconds("last_window")), ("reject_rate", F.col("reject_rate")))]
    shares = F.transform(F.map_entries("class_shares"), lambda e: F.struct(F.concat(F.lit("share "), e.key).alias("name"), e.value.alias("value")))
    telemetry = state.select(F.explode(F.concat(F.array(*named), shares)).alias("t")).select(F.lit("telemetry").alias("section"), *[F.lit(None).cast("string").alias(k) for k in keys], "t.name", "t.value")
    return minutes.unionByName(flaps[0]).unionByName(flaps[1]).unionByName(telemetry)


def switch_stats(features: DataFrame, column: str = "app_change_count") -> DataFrame:
    c = F.col(column)
    return features.agg(F.round(F.avg(c), 2).alias("mean"), F.round(F.percentile(c, 0.5), 2).alias("median"), F.max(c).alias("max"), F.sum(c).alias("sum"), F.count(c).alias("buckets"))


def baseline_report(features: DataFrame, keys: Sequence[str], seconds: int, size: int = 3) -> DataFrame:
    """Rule labels, smoothed, as segments; minutes of each day and label."""
    labelled = features.select(*keys, "bucket", rules.baseline_label().alias("label"))
    smooth = segments.rolling_majority(labelled, keys, size).select(*keys, "bucket", F.col("smoothed").alias("label"))
    return daily_minutes(segments.segmentize(smooth, keys, seconds), keys, seconds)
