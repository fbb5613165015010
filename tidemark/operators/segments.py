"""Label sequences: smoothing, segments, hysteresis, transitions and timelines."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rolling_majority(df: DataFrame, keys: Sequence[str], size: int, label: str = "label", order: Sequence[str] = ("bucket",), trailing: bool = False) -> DataFrame:
    """Most frequent label in a centred window; the row's own label wins a tie, else the first to occur.

    With ``trailing`` only the half up to the row votes, as it does for the newest row of a stream.
    """
    half = size // 2
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-half, 0 if trailing else half)
    seen = df.withColumn("_w", F.collect_list(label).over(frame))
    kinds = F.array_distinct("_w")
    counts = F.transform(kinds, lambda k: F.size(F.filter("_w", lambda x: x == k)))
    counted = seen.withColumns({"_k": kinds, "_n": counts})
    own = F.get("_n", (F.array_position("_k", F.col(label)) - 1).cast("int"))
    top = F.get("_k", (F.array_position("_n", F.array_max("_n")) - 1).cast("int"))
    return counted.withColumn("smoothed", F.when(own == F.array_max("_n"), F.col(label)).otherwise(top)).drop("_w", "_k", "_n")


def join_runs(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Neighbouring (start_ts, end_ts, label, buckets) rows of one label joined."""
    order = Window.partitionBy(*keys).orderBy("start_ts")
    cut = rows.withColumn("_new", (F.col("label") != F.lag("label").over(order)).cast("int"))
    runs = cut.withColumn("_run", F.sum(F.coalesce("_new", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "_run").agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.first("label").alias("label"), F.sum("buckets").alias("buckets")).drop("_run")


def bucket_runs(df: DataFrame, keys: Sequence[str], seconds: int, label: str = "label") -> DataFrame:
    """Each bucket as a run of its own."""
    return df.select(*keys, F.col("bucket").alias("start_ts"), F.timestamp_seconds(F.unix_seconds("bucket") + seconds).alias("end_ts"), F.col(label).alias("label"), F.lit(1).cast("long").alias("buckets"))


def segmentize(df: DataFrame, keys: Sequence[str], seconds: int, label: str = "label") -> DataFrame:
    """Runs of one label over observed buckets: start, end of the last bucket, label, buckets."""
    return join_runs(bucket_runs(df, keys, seconds, label), keys)


class Run(NamedTuple):
    start: object
    end: object
    label: str
    buckets: int


def _host(left: Run | None, run: Run, right: Run | None) -> int:
    """The side that takes a short run: -1, 1, or 0 for none. Equal labels attract; else the longer side does, the left one in a tie."""
    if left and left.label == run.label:
        return -1
    if right and right.label == run.label:
        return 1
    if not left or not right:
        return -1 if left else 0
    return -1 if left.buckets >= right.buckets else 1


def _joined(a: Run, b: Run, label: str) -> Run:
    return Run(a.start, b.end, label, a.buckets + b.buckets)


def absorb_short(runs: Sequence[Run], least: int) -> list[Run]:
    """Runs in order, those under ``least`` buckets given to a neighbour; sweeps from the left until one changes nothing."""
    while True:
        todo, done = deque(runs), []
        while todo:
            run = todo.popleft()
            side = _host(done[-1] if done else None, run, todo[0] if todo else None) if run.buckets < least else 0
            if side < 0:
                left = done.pop()
                done.append(_joined(left, run, left.label))
            elif side > 0:
                right = todo.popleft()
                done.append(_joined(run, right, right.label))
            else:
                done.append(run)
        if len(done) == len(runs):
            return done
        runs = done


def merge_short_segments(segments: DataFrame, keys: Sequence[str], seconds: int, least_seconds: int = 180) -> DataFrame:
    """Short segments absorbed by their neighbours.

    A long segment is never absorbed, so nothing passes between two long ones side by side: a key's
    sequence is cut there, and a fold runs over the segments from one such border to the next. A
    worker holds one Arrow batch and one such part.
    """
    least = max(1, least_seconds // seconds)
    schema = segments.select(*keys, "start_ts", "end_ts", "label", "buckets").schema
    order = Window.partitionBy(*keys).orderBy("start_ts")
    border = (F.col("buckets") >= least) & F.coalesce(F.lag("buckets").over(order) >= least, F.lit(False))
    cut = segments.select(*schema.names).withColumn("_border", border.cast("int")).withColumn("_part", F.sum("_border").over(order.rowsBetween(Window.unboundedPreceding, 0)))

    names = ["start_ts", "end_ts", "label", "buckets"]
    parts = [*keys, "_part"]
    # times as whole microseconds, which a fold only hands on
    plain = cut.select(*parts, F.unix_micros("start_ts").alias("start_ts"), F.unix_micros("end_ts").alias("end_ts"), "label", F.col("buckets").cast("long").alias("buckets"))
    # a part's rows lie in one partition, one after another; partitions hold many parts
    dealt = plain.repartition(*parts).sortWithinPartitions(*parts, "start_ts")
    out = T.StructType([*[schema[k] for k in keys], *T.StructType.fromDDL("start_ts LONG, end_ts LONG, label STRING, buckets LONG")])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, runs = None, []
        for batch in batches:
            made: dict[str, list] = {c: [] for c in out.names}

            def close() -> None:
                for run in absorb_short(runs, least):
                    for c, x in zip(out.names, (*current[:-1], *run)):
                        made[c].append(x)

            for *part, start, end, label, buckets in zip(*(batch.column(c).to_pylist() for c in (*parts, *names))):
                if part != current:
                    if runs:
                        close()
                    current, runs = part, []
                runs.append(Run(start, end, label, buckets))
            types = [batch.schema.field(c).type for c in out.names]
            yield pa.RecordBatch.from_arrays([pa.array(made[c], t) for c, t in zip(out.names, types)], names=out.names)
        if runs:
            rows = [(*current[:-1], *run) for run in absorb_short(runs, least)]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows), types)], names=out.names)

    merged = dealt.mapInArrow(fold, out)
    return merged.select(*keys, F.timestamp_micros("start_ts").alias("start_ts"), F.timestamp_micros("end_ts").alias("end_ts"), "label", F.col("buckets").cast(schema["buckets"].dataType).alias("buckets"))


def flap_rate(df: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("bucket")
    marked = df.withColumn("_c", F.col(label) != F.lag(label).over(order))
    return marked.groupBy(*keys).agg(F.when(F.count("*") > 1, F.count_if("_c") / F.count("*")).otherwise(0.0).alias("flap_rate"))


def session_label(df: DataFrame, keys: Sequence[str], share: float = 0.6, label: str = "label") -> DataFrame:
    """Label of at least ``share`` of a session's buckets, else Mixed."""
    per = df.groupBy(*keys, label).agg(F.count("*").alias("n"), F.min("bucket").alias("first"))
    best = per.groupBy(*keys).agg(F.sum("n").alias("total"), F.min_by(F.struct(label, "n"), F.struct(-F.col("n"), F.col("first"))).alias("b"))
    return best.select(*keys, F.when(F.col("b.n") / F.col("total") >= share, F.col(f"b.{label}")).otherwise("Mixed").alias("session_label"))


def weak_spans(df: DataFrame, keys: Sequence[str], seconds: int, tolerance: int = 1) -> DataFrame:
    """Spans of consecutive buckets with one weak label; ``label`` and ``rule`` are null where no rule fits.

    Rule and, where there is such a column, confidence are those of a span's first bucket.
    """
    order = Window.partitionBy(*keys).orderBy("bucket")
    gap = F.unix_seconds("bucket") - (F.unix_seconds(F.lag("bucket").over(order)) + seconds)
    joins = F.coalesce((F.col("label") == F.lag("label").over(order)) & (gap <= tolerance), F.lit(False))
    runs = df.withColumn("_n", (~joins).cast("int")).withColumn("_run", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.where("label IS NOT NULL").groupBy(*keys, "_run").agg(F.min("bucket").alias("start_ts"), F.timestamp_seconds(F.unix_seconds(F.max("bucket")) + seconds).alias("end_ts"), F.first("label").alias("label"), F.concat(F.lit("weak:"), F.min_by("rule", "bucket")).alias("provenance"), *([F.min_by("confidence", "bucket").alias("confidence")] if "confidence" in df.columns else []))
    return spans.drop("_run")


def duration_histogram(segments: DataFrame) -> DataFrame:
    length = F.unix_seconds("end_ts") - F.unix_seconds("start_ts")
    bins = F.when(length <= 60, "<=60").when(length <= 120, "<=120").when(length <= 180, "<=180").when(length <= 300, "<=300").otherwise(">300")
    return segments.groupBy(bins.alias("bin")).agg(F.count("*").alias("n"))


def debounced_transitions(polls: DataFrame, keys: Sequence[str], seconds: int = 120, lock_seconds: int = 60, lock_apps: Sequence[str] = ()) -> DataFrame:
    """Blocks of the dominant app: a new one counts once it has lasted; leaving a lock screen counts at once.

    ``polls`` has (ts, app) rows; a block ends where the app that replaced it was first seen, the
    last one is still open and left out. Polls are first reduced to runs of one app. A run takes
    over if it lasts long enough, or if it follows a lock screen that has taken over; with lock
    screens in a row, that is if one of those since the last other app has lasted.
    """
    order = Window.partitionBy(*keys).orderBy("ts", "app")
    marked = polls.select(*keys, "ts", "app").withColumn("_new", F.coalesce((F.col("app") != F.lag("app").over(order)).cast("int"), F.lit(0)))
    runs = marked.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "_run").agg(F.first("app").alias("app"), F.min("ts").alias("start_ts"), F.max("ts").alias("_last"))
    locked = F.col("app").isin(*lock_apps) if lock_apps else F.lit(False)
    lasted = (F.unix_micros("_last") - F.unix_micros("start_ts")) / 1e6 >= F.when(locked, lock_seconds).otherwise(seconds)
    in_turn = Window.partitionBy(*keys).orderBy("_run")
    before = in_turn.rowsBetween(Window.unboundedPreceding, -1)
    judged = runs.withColumns({"_locked": locked, "_lasted": lasted | (F.col("_run") == 0)})
    latest = lambda c: F.coalesce(F.max(F.when(c, F.col("_run"))).over(before), F.lit(-1))
    takes = judged.withColumn("_takes", F.col("_lasted") | (latest(F.col("_lasted")) > latest(~F.col("_locked")))).where("_takes")
    blocks = takes.withColumn("_same", F.coalesce(F.col("app") == F.lag("app").over(in_turn), F.lit(False))).where("NOT _same")
    return blocks.select(*keys, "app", "start_ts", F.lead("start_ts").over(in_turn).alias("end_ts")).where("end_ts IS NOT NULL")


def day_timeline(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each day of each key as label and gap rows, clipped to the day; overlapped parts go to the earlier label."""
    days = spans.withColumn("date", F.explode(F.sequence(F.to_date("start_ts"), F.to_date("end_ts"))))
    day0, day1 = F.col("date").cast("timestamp"), F.date_add("date", 1).cast("timestamp") - F.expr("INTERVAL 1 MILLISECOND")
    clipped = days.withColumns({"s": F.greatest("start_ts", day0), "e": F.least("end_ts", day1)}).where("e > s")
    order = Window.partitionBy(*keys, "date").orderBy("s", "e", "label", "seq")
    cursor = F.coalesce(F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)), day0)
    placed = clipped.withColumn("cursor", cursor)
    span = F.when(F.greatest("s", "cursor") < F.col("e"), F.struct(F.col("label"), F.greatest("s", "cursor").alias("a"), F.col("e").alias("z"))).otherwise(F.struct(F.col("label"), F.col("s").alias("a"), F.col("s").alias("z")))
    gap = F.when(F.col("s") > F.col("cursor"), F.struct(F.lit(None).cast("string").alias("label"), F.col("cursor").alias("a"), F.col("s").alias("z")))
    rows = placed.select(*keys, "date", F.explode(F.array_compact(F.array(gap, span))).alias("r"))
    last = clipped.groupBy(*keys, "date").agg(F.max("e").alias("e")).where(F.col("e") < day1).select(*keys, "date", F.struct(F.lit(None).cast("string").alias("label"), F.col("e").alias("a"), day1.alias("z")).alias("r"))
    whole = rows.unionByName(last)
    millis = F.unix_millis("r.z") - F.unix_millis("r.a")
    return whole.select(*keys, "date", "r.label", F.col("r.a").alias("start_ts"), F.col("r.z").alias("end_ts"), (millis / 86_399_999).alias("fraction"))


def unlabeled_time(spans: DataFrame, keys: Sequence[str], now: Column, escalate_minutes: int = 480) -> DataFrame:
    minutes = (F.unix_seconds(now) - F.unix_seconds(F.max("end_ts"))) / 60
    return spans.groupBy(*keys).agg(F.greatest(minutes, F.lit(0.0)).alias("minutes")).withColumn("escalate", F.col("minutes") >= escalate_minutes)
