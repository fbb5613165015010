"""The activity pipeline on unbounded input.

Built-in windows and watermarks do the bucketing; what needs memory of a key's past (rolling
features, trailing votes, debounced transitions, open segments) is a fold over the key's rows in event-time order with
a bounded memory in the state store (``ordered.py``).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pyspark.sql.streaming.query import StreamingQuery

from tidemark.operators import intervals, learning, rules
from tidemark.streaming.ordered import at_micros, memories, ordered_fold


def read_stream(spark: SparkSession, path: str, schema: T.StructType, ts: str = "ts", late: str = "10 minutes", per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder as events, with a watermark on their time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def admit(stream: DataFrame, path: str, late_path: str, checkpoint: str, late_seconds: int, ts: str = "ts") -> StreamingQuery:
    """Every micro-batch dealt into what is in time and what lies ``late_seconds`` or more behind the latest row of the batches before.

    That is Spark's own rule for late rows, which drops them without a trace; here they are kept under ``late_path``,
    to be counted and looked at. A stream over ``path`` with the same delay drops nothing: it cannot have seen more than this one.
    The latest time is one row, in two folders that take turns.
    """
    schema = T.StructType.fromDDL("batch LONG, latest TIMESTAMP")

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(schema).parquet(f"{path}-latest/*").where(F.col("batch") < number).agg(F.max("latest").alias("_before"))
        numbered = batch.withColumn("batch", F.lit(number))
        judged = numbered.join(F.broadcast(before)).withColumn("_late", F.coalesce(F.unix_micros(ts) <= F.unix_micros("_before") - late_seconds * 1_000_000, F.lit(False)))
        # a batch that is run again replaces what it wrote
        for late, to in ((False, path), (True, late_path)):
            judged.where(F.col("_late") == late).drop("_late", "_before").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(to)
        latest = batch.agg(F.max(ts).cast("timestamp").alias("latest")).join(before).select(F.lit(number).cast("long").alias("batch"), F.greatest("latest", "_before").alias("latest"))
        latest.write.mode("overwrite").parquet(f"{path}-latest/{number % 2}")

    none = stream.sparkSession.createDataFrame([], schema)
    for k in (0, 1):
        none.write.mode("ignore").parquet(f"{path}-latest/{k}")
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def without_repeats(events: DataFrame, ids: Sequence[str]) -> DataFrame:
    """The first of the rows that repeat ``ids`` before the watermark passes them; later ones are late."""
    return events.dropDuplicatesWithinWatermark(list(ids))


def bucket_stream(events: DataFrame, keys: Sequence[str], seconds: int = 60) -> DataFrame:
    """Tumbling buckets: events, seconds, apps."""
    window = F.window("ts", f"{seconds} seconds")
    return events.groupBy(*keys, window.alias("w")).agg(F.count("*").alias("events"), F.sum("duration_seconds").alias("seconds"), F.approx_count_distinct("app_id").alias("apps")).select(*keys, F.col("w.start").alias("bucket"), "events", "seconds", "apps")


def session_stream(events: DataFrame, keys: Sequence[str], gap_seconds: int = 300) -> DataFrame:
    """Sessions by the gap between event starts."""
    window = F.session_window("ts", f"{gap_seconds} seconds")
    return events.groupBy(*keys, window.alias("w")).agg(F.count("*").alias("events")).select(*keys, F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "events")


def _whole(value: float | None, digits: int) -> int | None:
    return None if value is None else round(value * 10**digits)


def _rounded(numerator: int, denominator: int, digits: int) -> float:
    """Half away from zero, in whole numbers, as ``scalars.quotient``."""
    half = (2 * abs(numerator) + denominator) // (2 * denominator)
    return (half if numerator >= 0 else -half) / 10**digits


def rolling_features(
    rows: DataFrame, keys: Sequence[str], size: int = 15, gap_seconds: int = 300, idle_seconds: float | None = None, rolling: Sequence[str] = ("keys_per_min",), deltas: Sequence[str] = ("keys_per_min",), sizes: Sequence[int] = (5, 15), recent_seconds: int = 900, block_seconds: int = 900
) -> DataFrame:
    """Per bucket: apps of the last 15 minutes less one, rolling means, differences to the row before, session minutes.

    ``rows`` has (ts, app_id) and the columns named. The state of a key is its last ``size`` rows and where its session
    began; a session begins ``gap_seconds`` or more after the row before. Equals ``features.rolling_context`` on the same rows.
    """
    values = list(dict.fromkeys([*rolling, *deltas]))
    memory = ", ".join(["ts ARRAY<LONG>", "app ARRAY<STRING>", *[f"{c} ARRAY<DOUBLE>" for c in values], "began LONG"])
    names = [*[f"{c}_rolling_{n}" for c in rolling for n in sizes], *[f"{c}_delta" for c in deltas]]
    out = "ts TIMESTAMP, switches INT, " + ", ".join(f"{c} DOUBLE" for c in names) + ", session_minutes DOUBLE"

    def fold(held: tuple | None, row: tuple) -> tuple[tuple, list[tuple]]:
        now, app, *given = row
        times, apps, *past, began = [list(x) if hasattr(x, "__len__") else x for x in held] if held else [[], [], *[[] for _ in values], now]
        if times and now - times[-1] >= gap_seconds * 1_000_000:
            began = now
        before = {c: p[-1] if p else None for c, p in zip(values, past)}
        times, apps = [*times, now][-size:], [*apps, app][-size:]
        past = [[*p, None if x is None else float(x)][-size:] for p, x in zip(past, given)]
        held_values, current = dict(zip(values, past)), dict(zip(values, given))
        made: list = [at_micros(now), len({a for t, a in zip(times, apps) if t >= now - recent_seconds * 1_000_000}) - 1]
        for c in rolling:
            for n in sizes:
                known = [_whole(x, 4) for x in held_values[c][-n:] if x is not None and x == x]
                made.append(_rounded(sum(known), len(known), 4) if known else None)
        for c in deltas:
            x, y = current[c], before[c]
            made.append(None if x is None or y is None or y != y else _rounded(_whole(x, 6) - _whole(y, 6), 100, 4))
        made.append(_rounded(now - began, 600_000, 2))
        return (times, apps, *past, began), [tuple(made)]

    return ordered_fold(rows, keys, ["ts", "app_id", *values], memory, out, fold, block_seconds, idle_seconds)


def transitions(polls: DataFrame, keys: Sequence[str], seconds: int = 120, lock_seconds: int = 60, lock_apps: Sequence[str] = (), idle_seconds: float | None = None, block_seconds: int = 900) -> DataFrame:
    """Debounced app blocks of (ts, app) polls, event time driven; the state is the block and its challenger."""
    locked = set(lock_apps)

    def fold(held: tuple | None, row: tuple) -> tuple[tuple, list[tuple]]:
        now, polled = row
        app, began, candidate, since = held or (polled, now, None, None)
        if polled == app:
            return (app, began, None, None), []
        if polled != candidate:
            candidate, since = polled, now
        need = 0 if app in locked else lock_seconds if polled in locked else seconds
        if now - since < need * 1_000_000:
            return (app, began, candidate, since), []
        return (polled, since, None, None), [(app, began / 1e6, since / 1e6)]

    return ordered_fold(polls, keys, ["ts", "app"], "app STRING, began LONG, candidate STRING, since LONG", "app STRING, start_ts DOUBLE, end_ts DOUBLE", fold, block_seconds, idle_seconds)


def trailing_votes(rows: DataFrame, keys: Sequence[str], size: int = 5, idle_seconds: float | None = None, block_seconds: int = 900, carried: Sequence[str] = ()) -> DataFrame:
    """(ts, seq, label, smoothed): the most frequent of a key's last ``size // 2 + 1`` labels, rejected ones among them.

    A row's own label wins a tie, else the first to occur, as in ``segments.rolling_majority`` with ``trailing``.
    Columns that are ``carried`` come out as they went in.
    """
    kind = lambda c: rows.schema[c].dataType.simpleString()

    def fold(held: tuple | None, row: tuple) -> tuple[tuple, list[tuple]]:
        now, seq, label, *rest = row
        labels = [*(held[0] if held else []), label][-(size // 2 + 1) :]
        best = max(labels, key=lambda x: (labels.count(x), x == label, -labels.index(x)))
        return (labels,), [(at_micros(now), seq, label, *rest, best)]

    out = ", ".join(["ts TIMESTAMP", *[f"{c} {kind(c)}" for c in ("seq", "label", *carried)], "smoothed STRING"])
    return ordered_fold(rows, keys, ["ts", "seq", "label", *carried], "labels ARRAY<STRING>", out, fold, block_seconds, idle_seconds)


def predictions(
    rows: DataFrame, model, columns: Sequence[str], classes: Sequence[str], calibrators: DataFrame | None = None, temperature: float = 1.0, thresholds: DataFrame | None = None, threshold: float = 0.55, taxonomy: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Scored, calibrated, judged rows of a stream (or of a table): probs, predicted, confidence, rejected, label, and the taxonomy's mapped columns.

    ``rows`` has user_id and the model's columns. Calibrators (user_id, temperature) and thresholds (user_id, threshold) are static tables, joined
    to the stream; a user without a row has the given default. ``label`` is Mixed/Unknown where the confidence is too low; the mapping
    is that of the row's own probabilities. Votes over these labels are ``trailing_votes``.
    """
    scored = learning.score(model, rows, columns, classes)
    if calibrators is None:
        scored = scored.withColumn("probs", rules.apply_temperature(F.col("probs"), F.lit(temperature)))
    else:
        scored = rules.apply_user_temperature(scored, calibrators, temperature)
    judged = scored.withColumns({"predicted": rules.argmax_label(F.col("probs"), classes), "confidence": F.array_max("probs")})
    judged = judged.withColumn("threshold", F.lit(threshold)) if thresholds is None else rules.with_user_thresholds(judged, thresholds, threshold)
    judged = judged.withColumns({"rejected": F.col("confidence") < F.col("threshold"), "label": rules.reject(F.col("predicted"), F.col("confidence"), F.col("threshold"))})
    return rules.map_taxonomy(judged, taxonomy, classes, rejected="rejected") if taxonomy else judged


def append_batches(stream: DataFrame, path: str, checkpoint: str, each: Callable[[DataFrame], DataFrame] | None = None):
    """Write every micro-batch once, under its number, after ``each`` (scoring, queueing) has been applied."""

    def write(batch: DataFrame, number: int) -> None:
        rows = each(batch) if each else batch
        rows.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def enqueue_batches(stream: DataFrame, path: str, checkpoint: str, threshold: float = 0.55):
    """Low-confidence buckets of every micro-batch, unless a pending request of an earlier batch names them."""
    spark = stream.sparkSession
    schema = T.StructType([*[stream.schema[c] for c in ("user_id", "bucket")], *T.StructType.fromDDL("status STRING, batch INT").fields])

    def write(batch: DataFrame, number: int) -> None:
        # a batch that is run again replaces its own requests
        pending = batch.sparkSession.read.schema(schema).parquet(path).where((F.col("batch") != number) & (F.col("status") == "pending"))
        rows = intervals.enqueue(batch, pending.select("user_id", "bucket").distinct(), threshold)
        rows.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    spark.createDataFrame([], schema).write.mode("append").partitionBy("batch").parquet(path)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_segments(buckets: DataFrame, keys: Sequence[str], seconds: int, block_seconds: int = 900) -> DataFrame:
    """Segments of (bucket, label) rows that a change of label has ended; the open one of each key is its state.

    Segments do not end where micro-batches do. What is kept is one row a key, in the state store: ``read_segments`` adds
    the open ones from there.
    """

    def fold(held: tuple | None, row: tuple) -> tuple[tuple, list[tuple]]:
        start, label = row
        end = start + seconds * 1_000_000
        if held is None:
            return (start, end, label, 1), []
        if held[2] == label:
            return (held[0], end, label, held[3] + 1), []
        return (start, end, label, 1), [(at_micros(held[0]), at_micros(held[1]), held[2], held[3])]

    return ordered_fold(buckets, keys, ["bucket", "label"], "began LONG, until LONG, label STRING, buckets LONG", "start_ts TIMESTAMP, end_ts TIMESTAMP, label STRING, buckets LONG", fold, block_seconds)


def read_segments(done: DataFrame, checkpoint: str, keys: Sequence[str], operator: int = 0) -> DataFrame:
    """Finished segments, and the open ones of the state store after the last micro-batch."""
    open_ = memories(done.sparkSession, checkpoint, operator)
    return done.unionByName(open_.select(*keys, F.timestamp_micros("began").alias("start_ts"), F.timestamp_micros("until").alias("end_ts"), "label", "buckets"))
