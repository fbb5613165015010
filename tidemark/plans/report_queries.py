"""Queries over sources and sinks, learning, reports and streams (S*, L*, R*, ST*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import features, intervals, learning, metrics, reports, rules, segments
from tidemark.plans import feature_queries as fq
from tidemark.plans.feature_queries import DOM, INP, _flat
from tidemark.plans.metric_queries import _P, predictions
from tidemark.plans.segment_queries import _LAB, _SMO, _seg, labelled, segmented, smoothed, WITH_FOLLOWING, with_following
from tidemark.sources import activity as io
from tidemark.sources import scratch
from tidemark.sources import testdata as td
from tidemark.sources.testdata import BUCKET, CLASSES, KEYS, SQL_ACTIVITY, SQL_PREDICTIONS, SQL_SPANS, sql_quotient
from tidemark.streaming import live
from tidemark.streaming.ordered import started

#: Blocks of event time in which the streams wait for the watermark: events of a user are hours apart here.
DAY = 86_400
#: Key of the row that closes a stream.
CLOSING = -1


def _export(spark, d, kind):
    """The events table written as export files, one document for each hour of a user."""
    events = td.table(spark, d, "events")
    n = F.get_json_object("props", "$.k").cast("double")
    data = F.struct(F.when(F.col("event_id") % 7 > 0, F.element_at(F.array(*map(F.lit, ("Firefox", "nvim", "Slack", "zoom", "My Tool"))), (F.col("event_id") % 5 + 1).cast("int"))).alias("app"), F.col("event_type").alias("title"), n.alias("presses"), (n * 2).alias("deltaX"))
    rows = events.select("user_id", F.date_trunc("hour", "ts").alias("hour"), F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), F.col("value").alias("duration"), data.alias("data")).alias("e"))
    buckets = rows.groupBy("user_id", "hour").agg(F.collect_list("e").alias("events"))
    entry = lambda t: F.struct(F.lit(t).alias("type"), F.col("events"))
    path = scratch.folder(spark, "export")
    # a document a file would be many files; lines of whole documents are read the same way
    buckets.select(F.map_from_arrays(F.array(F.lit("window"), F.lit("other")), F.array(entry(kind), entry("afkstatus"))).alias("buckets")).write.json(path)
    return path


def _lines(spark, path):
    """Export documents, one a line."""
    return spark.read.schema(io.EXPORT).json(path)


def s1(spark, d):
    path = _export(spark, d, "currentwindow")
    rows = io.parse_export(_lines(spark, path), "salt:")
    return rows.groupBy("app_id", "app_category", "window_title_hash").agg(F.count("*").alias("n"), F.round(F.sum("duration_seconds"), 2).alias("seconds"))


def s2(spark, d):
    rows = io.parse_input_export(_lines(spark, _export(spark, d, "os.hid.input")))
    return rows.agg(F.count("*").alias("n"), F.sum("presses").alias("presses"), F.sum("clicks").alias("clicks"), F.sum("delta_x").alias("delta_x"))


def s4(spark, d):
    path = scratch.folder(spark, "daily")
    io.write_daily(td.activity(spark, d), path)
    return spark.read.parquet(path).groupBy(F.col("date").cast("string").alias("date")).agg(F.count("*").alias("n"))


def s6(spark, d):
    old, new = scratch.folder(spark, "v1"), scratch.folder(spark, "v2")
    acts = td.activity(spark, d)
    io.write_daily(acts.withColumn("version", F.lit("v1")), old)
    io.write_daily(acts.where("ts >= '2024-01-10'").withColumns({"version": F.lit("v2"), "extra": F.lit(1)}), new)
    return io.read_features(spark, [new, old], "2024-01-05", "2024-01-15").groupBy("version").agg(F.count("*").alias("n"), F.count("extra").alias("extra"))


def s7(spark, d):
    path = scratch.folder(spark, "features")
    rows = features.dominant_apps(td.activity(spark, d), KEYS, BUCKET)
    io.write_daily(rows, path, "bucket")
    io.write_daily(rows.where("bucket >= '2024-01-20'").withColumn("app_id", F.lit("again")), path, "bucket")
    return spark.read.parquet(path).groupBy((F.col("app_id") == "again").alias("again")).agg(F.count("*").alias("n"))


def s8(spark, d):
    path = scratch.folder(spark, "labels")
    io.write_label_csv(td.spans(spark, d).withColumn("user_id", F.col("user_id").cast("string")), path)
    return io.read_label_csv(spark, path).groupBy("label", "user_id").agg(F.count("*").alias("n"), F.sum(F.unix_micros("end_ts") - F.unix_micros("start_ts")).alias("micros"))


def s10(spark, d):
    path = scratch.folder(spark, "spans")
    td.spans(spark, d).withColumn("confidence", F.when(F.col("seq") % 4 == 0, F.lit(float("nan"))).otherwise(F.col("confidence"))).write.parquet(path)
    return io.read_labels(spark, path).groupBy("label").agg(F.count("*").alias("n"), F.count("confidence").alias("known"))


def s11(spark, d):
    path = scratch.folder(spark, "predictions")
    io.write_predictions(predictions(spark, d), path)
    return io.read_predictions(spark, path).select("vec_id", "predicted", "confidence", F.size("probs").alias("classes"))


def s12(spark, d):
    path, segs = scratch.folder(spark, "segments"), segmented(spark, d)
    io.write_segments(segs, path)
    return _flat(io.read_segments(spark, path, segs.schema))


def s13(spark, d):
    path = scratch.folder(spark, "report")
    io.write_report(io.report_rows(reports.daily_minutes(segmented(spark, d), [], BUCKET)), path)
    return spark.read.parquet(path)


def s14(spark, d):
    path = scratch.folder(spark, "telemetry")
    rows = predictions(spark, d).groupBy("user_id", F.col("date").cast("timestamp").alias("ts")).agg(F.count("*").alias("rows"))
    io.append_telemetry(rows.where("user_id < 4"), path)
    io.append_telemetry(rows.where("user_id >= 4"), path)
    return _flat(io.last_telemetry(spark, path, 10)).withColumn("user_id", F.col("user_id").cast("long"))


def s15(spark, d):
    raw = spark.read.parquet(f"{d}/events.parquet").withColumn("text_ts", F.when(F.col("event_id") % 3 == 0, "2024-01-01T00:00:00Z").when(F.col("event_id") % 3 == 1, "2024-01-01T00:00:00"))
    return io.audit_timestamps(raw).unionByName(io.audit_timestamps(io.localize(io.localize(raw))).where("column = 'ts'").withColumn("column", F.lit("ts after")))


def l1(spark, d):
    return _flat(learning.drop_short_sessions(fq._sessions(spark, d), ["k", "session_start"], 2).select("k", "bucket"))


def l2(spark, d):
    rows = with_following(fq._sessions(spark, d)).join(features.input_activity(td.samples(spark, d), KEYS, BUCKET), ["k", "bucket"], "left")
    return _flat(learning.drop_blank_rows(rows, ["keys_per_min", "mouse_distance"]).select("k", "bucket"))


def l3(spark, d):
    return _flat(learning.time_split(labelled(spark, d), "k").select("k", "bucket", "split"))


def l4(spark, d):
    return learning.holdout_users(td.table(spark, d, "events"), 0.1)


def _table(spark, d):
    return fq.table(spark, d).withColumn("user_id", F.col("k"))


def l5(spark, d):
    rows = learning.training_set(_table(spark, d), td.spans(spark, d), ["keys_per_min"], ["user_id", "session_start"], 2, BUCKET)
    return rows.groupBy("split", "label").agg(F.count("*").alias("n"))


def l6(spark, d):
    rows = td.spans(spark, d)
    return learning.fingerprint(rows).withColumn("same", F.lit(True)).join(learning.fingerprint(rows.repartition(7).orderBy(F.desc("seq"))), "fingerprint").select("same", F.length("fingerprint").alias("digits"))


def l7(spark, d):
    return learning.dataset_snapshot(td.spans(spark, d), "start_ts")


def l8(spark, d):
    rows = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_brand")
    coded = learning.encode_category(rows, "p_brand", F.col("p_partkey") % 2 == 0, 40, 0.0)
    return coded.select("p_partkey", F.col("p_brand_code").alias("code"))


def l9(spark, d):
    rows = learning.balanced_weights(predictions(spark, d).select("vec_id", "label"), CLASSES)
    return rows.select("vec_id", F.round("weight", 6).alias("weight"))


_COLUMNS = ["x0", "x1", "x2", "x3"]


def _learn(spark, d):
    preds = td.predictions(spark, d)
    rows = preds.select("vec_id", "user_id", "date", "label", *[F.get("probs", F.lit(k)).alias(c) for k, c in enumerate(_COLUMNS)]).withColumn("bucket", F.col("date").cast("timestamp"))
    return learning.time_split(rows, "user_id", ("bucket", "vec_id"))


def l10(spark, d):
    from pyspark.ml.functions import vector_to_array

    rows = learning.feature_vector(_learn(spark, d).withColumn("x3", F.when(F.col("vec_id") % 2 > 0, F.col("x3"))), _COLUMNS)
    return rows.select("vec_id", F.round(F.aggregate(vector_to_array("features"), F.lit(0.0), lambda t, x: t + x), 6).alias("total"))


def l11(spark, d):
    rows = _learn(spark, d)
    model = learning.train_classifier(rows.where("split = 'train'"), _COLUMNS, CLASSES)
    return metrics.f1_scores(learning.score(model, rows, _COLUMNS, CLASSES), CLASSES, ["split"])


def l12(spark, d):
    rows = _learn(spark, d)
    model = learning.train_classifier(rows.where("split = 'train'"), _COLUMNS, CLASSES, "forest", numTrees=5, maxDepth=4)
    return learning.score(model, rows, _COLUMNS, CLASSES).select("vec_id", "predicted", F.round("confidence", 4).alias("confidence"))


def l13(spark, d):
    settings = learning.sample_settings({"regParam": (0.0001, 1.0), "elasticNetParam": [0.0, 0.5], "maxIter": [10, 30]}, 8)
    return learning.search(_learn(spark, d), _COLUMNS, CLASSES, settings)


def l14(spark, d):
    rows = td.predictions(spark, d).withColumn("bucket", F.col("date").cast("timestamp"))
    return learning.eligible_users(rows, 72, 3, 3)


def l15(spark, d):
    return learning.fit_temperature(td.predictions(spark, d), CLASSES).withColumn("temperature", F.round("temperature", 2))


def l16(spark, d):
    preds = td.predictions(spark, d)
    return metrics.brier(rules.apply_isotonic(preds, learning.fit_isotonic(preds, CLASSES)), CLASSES)


def l17(spark, d):
    rows = td.predictions(spark, d).withColumn("bucket", F.col("date").cast("timestamp"))
    return learning.calibrators(rows, CLASSES, windows=72, days=3, labels=3)


def _runs(spark, d):
    return td.predictions(spark, d).groupBy(F.concat(F.lit("run"), F.col("user_id").cast("string")).alias("model_id")).agg(
        F.round(F.avg((F.col("label") == F.col("predicted")).cast("int")), 4).alias("weighted_f1"), F.round(F.avg("confidence"), 4).alias("macro_f1"), F.max(F.col("date").cast("timestamp")).alias("created_at"), F.first("user_id").alias("u")
    ).select("model_id", "weighted_f1", F.when(F.col("u") != 6, F.col("macro_f1")).alias("macro_f1"), "created_at", F.when(F.col("u") == 5, "old").otherwise("new").alias("schema_hash"), F.when(F.col("u") == 4, F.array(F.lit("Build"))).otherwise(F.array(*map(F.lit, CLASSES))).alias("label_set"))


def l18(spark, d):
    return learning.rank_runs(_runs(spark, d), "new", CLASSES).select("model_id", "reason", "rank")


def l19(spark, d):
    return learning.due_for_refresh(_runs(spark, d), F.timestamp_seconds(F.lit(1706832000)), 14)


def l20(spark, d):
    path = scratch.folder(spark, "replay")
    columns = ["keys_per_min", "clicks_per_min", "scroll_events_per_min", "app_foreground_time_ratio", "session_length_so_far"]
    # every row of the table is stored, with what the model, the split and the evaluation read
    io.write_daily(_table(spark, d).select("user_id", "bucket", "session_start", *columns), path, "bucket")
    stored = io.read_features(spark, [path], "2024-01-01", "2024-01-31").drop("date")
    rows = learning.training_set(stored, td.spans(spark, d), ["keys_per_min"], ["user_id", "session_start"], 2, BUCKET)
    # the features are made once: a fit reads its rows many times
    rows.write.parquet(made := scratch.folder(spark, "labelled"))
    rows = spark.read.parquet(made)
    model = learning.train_classifier(rows.where("split = 'train'"), columns, CLASSES)
    learning.score(model, rows.where("split = 'test'"), columns, CLASSES).select("user_id", "bucket", "label", "probs").write.parquet(kept := scratch.folder(spark, "scored"))
    return metrics.evaluation_modes(spark.read.parquet(kept), CLASSES, 1.0, 0.2, ["user_id"], BUCKET)


def r1(spark, d):
    return reports.daily_minutes(segmented(spark, d), KEYS, BUCKET).withColumn("date", F.col("date").cast("string"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return r1(spark, d)


_NAMES = {"browser": "Reading", "editor": "Making", "terminal": "Making", "chat": "Talking", "meeting": "Talking"}


def r2(spark, d):
    mapped = segmented(spark, d).withColumn("label", td.chosen(F.col("label"), _NAMES))
    return reports.daily_minutes(mapped, [], BUCKET).groupBy("label").agg(F.sum("minutes").alias("minutes"), F.sum("segments").alias("segments"))


def r3(spark, d):
    return reports.switch_stats(features.app_changes(td.activity(spark, d), KEYS, BUCKET))


def r4(spark, d):
    raw = segments.flap_rate(labelled(spark, d), KEYS).withColumnRenamed("flap_rate", "raw")
    smooth = segments.flap_rate(smoothed(spark, d).select("k", "bucket", F.col("smoothed").alias("label")), KEYS).withColumnRenamed("flap_rate", "smooth")
    return raw.join(smooth, "k").select("k", F.round("raw", 6).alias("raw"), F.round("smooth", 6).alias("smooth"))


def r5(spark, d):
    rows = fq.table(spark, d).withColumn("shortcut_rate", F.col("clicks_per_min"))
    return reports.baseline_report(rows, KEYS, BUCKET).withColumn("date", F.col("date").cast("string"))


def _raw_stream(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))
    return events.select(F.col("user_id").alias("k"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("duration_seconds"), td.chosen(F.col("event_type"), td.APPS).alias("app_id"), F.get_json_object("props", "$.k").cast("double").alias("keys_per_min"))


def _event_stream(spark, d):
    return _raw_stream(spark, d).withWatermark("ts", "10 minutes")


def _closed_stream(spark, d):
    """The event stream with a row a year after the last one, so that the watermark passes every window."""
    path = scratch.folder(spark, "closing")
    last = td.table(spark, d, "events").agg((F.max("ts") + F.expr("INTERVAL 365 DAYS")).alias("ts"))
    stream = _raw_stream(spark, d)
    values = {"ts": F.col("ts"), "k": F.lit(CLOSING)}
    last.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in stream.schema.fields]).write.parquet(path)
    # one watermark over both, as that of two sources is the earlier one
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(path)).withWatermark("ts", "10 minutes")


def _hours(spark, d):
    """The first event's app of each hour, as a windowed aggregation of the stream."""
    hours = _closed_stream(spark, d).groupBy("k", F.window("ts", f"{BUCKET} seconds").alias("w")).agg(F.min_by("app_id", "seq").alias("label"))
    # the last moment of a window carries the watermark on
    return hours.select("k", (F.window_time("w") - F.expr(f"INTERVAL {BUCKET * 1_000_000 - 1} MICROSECONDS")).alias("bucket"), "label")


def _run(spark, stream, mode="append", marks=None):
    """The rows of a stream run to the end of its input, read back from its sink."""
    path, marks = scratch.folder(spark, "stream"), marks or scratch.folder(spark, "marks")
    started(stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", marks).trigger(availableNow=True)).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def st1(spark, d):
    rows = _run(spark, _event_stream(spark, d))
    return rows.groupBy("app_id").agg(F.count("*").alias("n"))


def st2(spark, d):
    rows = _run(spark, live.bucket_stream(_closed_stream(spark, d), KEYS, BUCKET))
    return _flat(rows.select("k", "bucket", "events", F.round("seconds", 2).alias("seconds")))


def st3(spark, d):
    rows = _run(spark, live.session_stream(_closed_stream(spark, d), KEYS, 1800))
    return rows.groupBy("k").agg(F.count("*").alias("sessions"), F.sum("events").alias("events"))


def late_events(spark, d):
    """The events in three deliveries by time: one in ten repeated in the next, one in seventeen delivered two later."""
    folder, path, late, marks = (scratch.folder(spark, name) for name in ("deliveries", "in-time", "late", "marks"))
    events = td.table(spark, d, "events").withColumn("_part", F.floor((F.dayofmonth("ts") - 1) / 10))
    schema = events.drop("_part").schema
    for part in range(6):
        held = events.where(((F.col("_part") == part) & (F.col("event_id") % 17 != 0)) | ((F.col("_part") == part - 2) & (F.col("event_id") % 17 == 0)) | ((F.col("_part") == part - 1) & (F.col("event_id") % 10 == 0) & (F.col("event_id") % 17 != 0)))
        held.drop("_part").write.mode("append").parquet(folder)
        # a run takes what has come since the one before, as one micro-batch
        live.admit(spark.readStream.schema(schema).parquet(folder), path, late, marks, 9 * DAY).awaitTermination()
    admitted = spark.readStream.schema(schema).parquet(path).withWatermark("ts", "9 days")
    return _run(spark, live.without_repeats(admitted.drop("batch"), ["event_id"])), spark.read.schema(spark.read.parquet(path).schema).parquet(path), spark.read.schema(spark.read.parquet(path).schema).parquet(late)


def st1_late(spark, d):
    once, admitted, late = late_events(spark, d)
    count = lambda df, name: df.groupBy("event_type").agg(F.count("*").alias(name))
    return count(once, "once").join(count(admitted, "in_time"), "event_type", "left").join(count(late, "late"), "event_type", "left").fillna(0)


def st4(spark, d):
    """Of every event's row; see ``features.rolling_context`` for the batch."""
    rows = _run(spark, live.rolling_features(_closed_stream(spark, d), KEYS, 15, 1800, block_seconds=DAY))
    return rows.where(F.col("k") != CLOSING).select("k", F.unix_micros("ts").alias("us"), "switches", "keys_per_min_rolling_5", "keys_per_min_rolling_15", "keys_per_min_delta", "session_minutes")


def st5(spark, d):
    polls = _closed_stream(spark, d).select("k", "ts", F.col("app_id").alias("app"))
    rows = _run(spark, live.transitions(polls, KEYS, 7200, 3600, ("terminal",), block_seconds=DAY))
    return rows.groupBy("k", "app").agg(F.count("*").alias("blocks"))


def st6(spark, d):
    label, rule = rules.weak_label()
    stream = _closed_stream(spark, d).withColumns({"app_category": F.col("app_id"), "domain_category": F.lit(None).cast("string")}).select("k", "ts", "seq", F.coalesce(label, F.lit("Mixed/Unknown")).alias("label"))
    return _run(spark, live.trailing_votes(stream, KEYS, 5, block_seconds=DAY)).where(F.col("k") != CLOSING).groupBy("k", F.col("label").alias("predicted"), "smoothed").agg(F.count("*").alias("n"))


_MODEL_COLUMNS = ["keys_per_min", "duration_seconds", "hour"]
_TAXONOMY = {"Focus": ("Build", "Debug", "Write", "Review"), "People": ("Communicate", "Meet"), "Input": ("ReadResearch",)}


def _moments(events):
    """Rows that the model of the streams scores."""
    return events.withColumns({"user_id": F.col("k"), "hour": F.hour("ts").cast("double")})


def online_model(spark, d):
    """A classifier of events, fitted on those before the 15th, and static tables of calibrators and thresholds."""
    events = td.table(spark, d, "events")
    past = _moments(events.select(F.col("user_id").alias("k"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("duration_seconds"), F.get_json_object("props", "$.k").cast("double").alias("keys_per_min"), td.chosen(F.col("event_type"), td.LABELS).alias("label"))).where("day(ts) < 15")
    model = learning.train_classifier(past, _MODEL_COLUMNS, CLASSES, maxIter=20)
    users = events.select("user_id").distinct()
    return model, users.where("user_id % 3 = 0").select("user_id", (0.5 + F.col("user_id") % 5 / 4).alias("temperature")), users.where("user_id % 4 = 0").select("user_id", (0.2 + F.col("user_id") % 3 / 100).alias("threshold"))


def predicted(rows, trained):
    model, calibrators, thresholds = trained
    return live.predictions(_moments(rows), model, _MODEL_COLUMNS, CLASSES, calibrators, 1.3, thresholds, 0.21, _TAXONOMY)


def st6_predictions(spark, d):
    """Score, per-user calibration and threshold, trailing vote and taxonomy of every event."""
    scored = predicted(_closed_stream(spark, d), online_model(spark, d))
    votes = live.trailing_votes(scored, KEYS, 5, block_seconds=DAY, carried=("predicted", "confidence", "rejected", "mapped_label"))
    return _run(spark, votes).where(F.col("k") != CLOSING).select("k", "seq", "predicted", F.round("confidence", 4).alias("confidence"), "rejected", "smoothed", "mapped_label")


def st7(spark, d):
    path, marks = scratch.folder(spark, "queue"), scratch.folder(spark, "marks")
    stream = _event_stream(spark, d).select(F.col("k").alias("user_id"), F.date_trunc("hour", "ts").alias("bucket"), F.col("app_id").alias("predicted"), (F.col("keys_per_min") / 100).alias("confidence"))
    live.enqueue_batches(stream, path, marks, 0.3).awaitTermination()
    return spark.read.parquet(path).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 4).alias("confidence"))


def st8(spark, d):
    hours, marks = _hours(spark, d), scratch.folder(spark, "marks")
    done = _run(spark, live.running_segments(hours, KEYS, BUCKET, DAY), marks=marks)
    return live.read_segments(done, marks, KEYS).where(F.col("k") != CLOSING).groupBy("k", "label").agg(F.count("*").alias("n"), F.sum("buckets").alias("buckets"))


def st9(spark, d):
    """Votes over the hours of a stream in its sink; the report of what it has left there."""
    hours = _closed_stream(spark, d).groupBy("k", F.window("ts", f"{BUCKET} seconds").alias("w")).agg(F.min_by("app_id", "seq").alias("label"))
    votes = live.trailing_votes(hours.select("k", F.window_time("w").alias("ts"), F.unix_seconds(F.col("w.start")).alias("seq"), "label"), KEYS, 5, block_seconds=DAY)
    rows = _run(spark, votes).where(F.col("k") != CLOSING).select("k", F.timestamp_seconds("seq").alias("bucket"), "label", "smoothed")
    return reports.final_report(rows, KEYS, BUCKET)


def st10(spark, d):
    from tidemark.operators import votes

    rows = td.activity(spark, d).where("ts >= '2024-01-10' AND ts < '2024-01-11'").select("k", "seq", F.col("app_id").alias("label"), (F.col("duration_seconds") / 500).alias("confidence"))
    return votes.aggregate_interval(rows, ["k"], "confidence_weighted")


def st10_predictions(spark, d):
    """The model's label for a day of each user: majority of the events' labels and their mean confidence."""
    from tidemark.operators import votes

    rows = td.activity(spark, d).where("ts >= '2024-01-10' AND ts < '2024-01-11'").join(td.samples(spark, d).select("seq", F.col("presses").cast("double").alias("keys_per_min")), "seq")
    scored = predicted(rows, online_model(spark, d)).select("k", "seq", F.col("predicted").alias("label"), "confidence")
    return votes.aggregate_interval(scored, ["k"], "majority").select("k", "winner", F.round("confidence", 4).alias("confidence"))


_SPLIT = "CASE WHEN i < floor(n * 0.7) THEN 'train' WHEN i < floor(n * 0.85) THEN 'val' ELSE 'test' END"
_RUNS = f"{SQL_PREDICTIONS}, rn AS (SELECT user_id AS u, 'run' || user_id AS model_id, round(avg((label = predicted)::INTEGER), 4) AS weighted_f1, CASE WHEN user_id <> 6 THEN round(avg(confidence), 4) END AS macro_f1, max(date)::TIMESTAMP AS created_at FROM prd GROUP BY user_id)"
_PREDW = "predicted"

QUERIES = {
    "S1_export": s1, "S2_input_export": s2, "S4_daily_partitions": s4, "S6_versioned_scan": s6, "S7_feature_sink": s7, "S8_S9_label_csv": s8, "S10_label_parquet": s10, "S11_predictions_csv": s11, "S12_segments_json": s12, "S13_report_export": s13, "S14_telemetry": s14, "S15_timestamp_audit": s15,
    "L1_short_sessions": l1, "L2_blank_rows": l2, "L3_time_split": l3, "L4_holdout_users": l4, "L5_training_set": l5, "L6_fingerprint": l6, "L7_dataset_snapshot": l7, "L8_category_codes": l8, "L9_balanced_weights": l9, "L10_feature_vector": l10,
    "L11_train": l11, "L12_score": l12, "L13_search": l13, "L14_eligible_users": l14, "L15_temperature_fit": l15, "L16_isotonic_fit": l16, "L17_calibrators": l17, "L18_rank_runs": l18, "L19_due_runs": l19, "L20_replay": l20,
    "R1_daily_minutes": r1, "R2_mapped_minutes": r2, "R3_switch_stats": r3, "R4_flap_rates": r4, "R5_baseline_report": r5,
    "ST1_ingest": st1, "ST1_late_events": st1_late, "ST6_online_predictions": st6_predictions, "ST10_model_suggestion": st10_predictions, "ST2_bucket_stream": st2, "ST3_session_stream": st3, "ST4_rolling_state": st4, "ST5_transitions": st5, "ST6_online_labels": st6, "ST7_auto_enqueue": st7, "ST8_running_segments": st8, "ST9_final_report": st9, "ST10_suggestion": st10,
}
_APPS5 = "['org.mozilla.firefox', 'io.neovim.nvim', 'com.tinyspeck.slackmacgap', 'us.zoom.xos', 'unknown.my_tool']"
_KIND5 = "['browser', 'editor', 'chat', 'meeting', 'other']"
_KQ = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"
_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
ORACLE_SQL = {
    "S1_export": f"SELECT CASE WHEN event_id % 7 = 0 THEN 'unknown.unknown' ELSE {_APPS5}[event_id % 5 + 1] END AS app_id, CASE WHEN event_id % 7 = 0 THEN 'other' ELSE {_KIND5}[event_id % 5 + 1] END AS app_category, substr(sha256('salt:' || event_type), 1, 12) AS window_title_hash, count(*) AS n, round(sum(value), 2) AS seconds FROM events GROUP BY 1, 2, 3",
    "S2_input_export": f"SELECT count(*) AS n, sum({_K})::BIGINT AS presses, 0::BIGINT AS clicks, sum(2 * {_K})::BIGINT AS delta_x FROM events",
    "S4_daily_partitions": "SELECT CAST(ts::DATE AS VARCHAR) AS date, count(*) AS n FROM events GROUP BY 1",
    "S6_versioned_scan": "SELECT CASE WHEN ts >= TIMESTAMP '2024-01-10' THEN 'v2' ELSE 'v1' END AS version, count(*) AS n, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-10') AS extra FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-16' GROUP BY 1",
    "S7_feature_sink": f"WITH {DOM} SELECT b >= 1705708800 AS again, count(*) AS n FROM dom GROUP BY 1",
    "S8_S9_label_csv": f"WITH {SQL_SPANS} SELECT label, user_id::VARCHAR AS user_id, count(*) AS n, (count(*) * 14400000000)::BIGINT AS micros FROM spn GROUP BY ALL",
    "S10_label_parquet": f"WITH {SQL_SPANS} SELECT label, count(*) AS n, count(*) FILTER (WHERE seq % 4 <> 0) AS known FROM spn GROUP BY label",
    "S11_predictions_csv": f"WITH {_P} SELECT vec_id, predicted, round(confidence, 4) AS confidence, 8 AS classes FROM pr",
    "S12_segments_json": f"WITH {_SMO}, {_seg('smo', 'sg')} SELECT * FROM sg",
    "S13_report_export": f"WITH {_SMO}, {_seg('smo', 'sg')} SELECT CAST(make_timestamp(start_ts * 1000000)::DATE AS VARCHAR) AS date, 'core' AS label_type, label, round(sum(buckets) * {BUCKET / 60}, 2) AS minutes FROM sg GROUP BY 1, 3",
    "S14_telemetry": f"WITH {_P}, t AS (SELECT user_id, epoch(date::TIMESTAMP)::BIGINT AS ts, count(*) AS rows FROM pr GROUP BY 1, 2) SELECT * FROM t ORDER BY ts DESC, user_id LIMIT 10",
    "S15_timestamp_audit": "SELECT 'ts' AS \"column\", 'naive' AS kind, count(*) AS n FROM events UNION ALL SELECT 'text_ts', ['aware', 'naive', 'missing'][event_id % 3 + 1], count(*) FROM events GROUP BY 2 UNION ALL SELECT 'ts after', 'aware', count(*) FROM events",
    "L1_short_sessions": f"WITH {fq.SESS} SELECT k, b AS bucket FROM sess QUALIFY count(*) OVER (PARTITION BY k, s) >= 2",
    "L2_blank_rows": f"WITH {_LAB}, {INP} SELECT f.k, f.b AS bucket FROM ({WITH_FOLLOWING}) f JOIN inp ON inp.k = f.k AND inp.bucket = f.b",
    "L3_time_split": f"WITH {_LAB}, r AS (SELECT k, b, row_number() OVER (PARTITION BY k ORDER BY b) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM lab) SELECT k, b AS bucket, {_SPLIT} AS split FROM r",
    "L4_holdout_users": "WITH u AS (SELECT DISTINCT user_id FROM events) SELECT user_id FROM u ORDER BY sha256('42:' || user_id) LIMIT (SELECT greatest(1, floor(count(*) * 0.1))::BIGINT FROM u)",
    "L5_training_set": f"""WITH {fq.SESS}, {INP}, {SQL_SPANS}, lw AS (SELECT t.k, t.b, t.s, any_value(spn.label) AS label FROM sess t JOIN spn ON spn.user_id = t.k AND epoch_us(start_ts) <= t.b * 1000000 AND (t.b + {BUCKET}) * 1000000 <= epoch_us(end_ts) GROUP BY t.k, t.b, t.s HAVING count(DISTINCT spn.label) = 1),
        ls AS (SELECT * FROM lw QUALIFY count(*) OVER (PARTITION BY k, s) >= 2), lb AS (SELECT ls.* FROM ls JOIN inp ON inp.k = ls.k AND inp.bucket = ls.b),
        r AS (SELECT k, label, row_number() OVER (PARTITION BY k ORDER BY b) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM lb) SELECT {_SPLIT} AS split, label, count(*) AS n FROM r GROUP BY ALL""",
    "L7_dataset_snapshot": f"WITH {SQL_SPANS} SELECT count(*) AS rows, CAST(min(start_ts)::DATE AS VARCHAR) AS first_date, CAST(max(start_ts)::DATE AS VARCHAR) AS last_date, count(DISTINCT user_id) AS users, count(DISTINCT label) AS labels FROM spn",
    "L8_category_codes": "WITH v AS (SELECT p_brand AS v FROM part WHERE p_partkey % 2 = 0 GROUP BY 1 HAVING count(*) >= 40 UNION ALL SELECT '__unknown__'), c AS (SELECT v, (row_number() OVER (ORDER BY v) - 1)::INTEGER AS c FROM v) SELECT p_partkey, coalesce(c, (SELECT c FROM c WHERE v = '__unknown__')) AS code FROM part LEFT JOIN c ON v = p_brand",
    "L9_balanced_weights": f"WITH {_P} SELECT vec_id, round(count(*) OVER () / (max(list_position({td._CLASS_LIST}, label)) OVER () * count(*) OVER (PARTITION BY label)), 6) AS weight FROM pr",
    "L10_feature_vector": f"WITH {SQL_PREDICTIONS} SELECT vec_id, round(probs[1] + probs[2] + probs[3] + CASE WHEN vec_id % 2 > 0 THEN probs[4] ELSE 0 END, 6) AS total FROM prd",
    "L14_eligible_users": f"WITH {SQL_PREDICTIONS} SELECT user_id, count(*) AS windows, count(DISTINCT date) AS days, count(DISTINCT label) AS labels, count(*) >= 72 AND count(DISTINCT date) >= 3 AND count(DISTINCT label) >= 3 AS eligible FROM prd GROUP BY user_id",
    # the greatest, over blocks that begin no later, of the least share over blocks that end no earlier
    "L16_isotonic_fit": f"""WITH {SQL_PREDICTIONS}, u AS (SELECT vec_id, generate_subscripts(probs, 1) AS k, unnest(probs) AS x, ({td._CLASS_LIST}[generate_subscripts(probs, 1)] = label)::INTEGER AS y FROM prd),
        c AS (SELECT k, x, count(*) AS n, sum(y) AS s FROM u GROUP BY k, x), r AS (SELECT *, row_number() OVER w AS i, sum(n) OVER w AS cn, sum(s) OVER w AS cs FROM c WINDOW w AS (PARTITION BY k ORDER BY x)),
        g AS (SELECT a.k, b.i, min((b.cs - a.cs + a.s) / (b.cn - a.cn + a.n)) OVER (PARTITION BY a.k, a.i ORDER BY b.i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM r a JOIN r b ON a.k = b.k AND b.i >= a.i),
        f AS (SELECT k, i, max(m) AS fit FROM g GROUP BY k, i), q AS (SELECT vec_id, y, greatest(fit, 1e-12) AS p FROM u JOIN r USING (k, x) JOIN f USING (k, i)),
        z AS (SELECT vec_id, y, p / sum(p) OVER (PARTITION BY vec_id) AS p FROM q), b AS (SELECT vec_id, sum((p - y) * (p - y)) AS b FROM z GROUP BY vec_id) SELECT round(avg(b), 6) AS brier FROM b""",
    "L18_rank_runs": f"WITH {_RUNS}, q AS (SELECT *, CASE WHEN u = 6 THEN 'invalid' WHEN u = 5 THEN 'schema' WHEN u = 4 THEN 'labels' END AS reason FROM rn) SELECT model_id, reason, CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY reason IS NULL ORDER BY macro_f1 DESC, weighted_f1 DESC, created_at DESC, model_id) END AS rank FROM q",
    "L19_due_runs": f"WITH {_RUNS} SELECT epoch(max(created_at))::BIGINT AS newest, (1706832000 - epoch(max(created_at))) / 86400 > 14 AS due FROM rn",
    "R1_daily_minutes": f"WITH {_SMO}, {_seg('smo', 'sg')} SELECT k, CAST(make_timestamp(start_ts * 1000000)::DATE AS VARCHAR) AS date, label, round(sum(buckets) * {BUCKET / 60}, 2) AS minutes, count(*) AS segments FROM sg GROUP BY 1, 2, 3",
    "R2_mapped_minutes": f"WITH {_SMO}, {_seg('smo', 'sg')} SELECT {td._case('label', _NAMES)} AS label, sum(buckets)::DOUBLE * {BUCKET / 60} AS minutes, count(*) AS segments FROM sg GROUP BY 1",
    "R3_switch_stats": f"WITH {SQL_ACTIVITY}, c AS (SELECT k, b, app <> lag(app) OVER (PARTITION BY k, b ORDER BY ts, seq) AS c FROM act), n AS (SELECT count(*) FILTER (WHERE c) AS n FROM c GROUP BY k, b) SELECT round(avg(n), 2) AS mean, round(quantile_cont(n, 0.5), 2) AS median, max(n) AS max, sum(n)::BIGINT AS sum, count(n) AS buckets FROM n",
    "R4_flap_rates": f"WITH {_SMO}, c AS (SELECT k, own <> lag(own) OVER w AS a, label <> lag(label) OVER w AS z FROM smo WINDOW w AS (PARTITION BY k ORDER BY b)) SELECT k, round(count(*) FILTER (WHERE a) / count(*), 6) AS raw, round(count(*) FILTER (WHERE z) / count(*), 6) AS smooth FROM c GROUP BY k",
    "R5_baseline_report": f"""WITH {DOM}, {INP}, lab AS (SELECT dom.k, dom.b, CASE WHEN active_seconds_any IS NULL OR active_seconds_any < 5 OR idle > 50 THEN 'BreakIdle' WHEN app = 'browser' AND scroll_events_per_min > 3 AND keys_per_min < 10 THEN 'ReadResearch'
        WHEN app IN ('editor', 'terminal') AND keys_per_min > 30 AND clicks_per_min > 1 THEN 'Build' ELSE 'Mixed/Unknown' END AS label FROM dom LEFT JOIN inp ON inp.k = dom.k AND inp.bucket = dom.b LEFT JOIN idle ON idle.k = dom.k AND idle.b = dom.b)
        {_SMO[len(_LAB):].replace("a.i - 2 AND a.i + 2", "a.i - 1 AND a.i + 1")}, {_seg('smo', 'sg')} SELECT k, CAST(make_timestamp(start_ts * 1000000)::DATE AS VARCHAR) AS date, label, round(sum(buckets) * {BUCKET / 60}, 2) AS minutes, count(*) AS segments FROM sg GROUP BY 1, 2, 3""",
    "ST1_ingest": f"WITH {SQL_ACTIVITY} SELECT app AS app_id, count(*) AS n FROM act GROUP BY app",
    "ST2_bucket_stream": f"WITH {SQL_ACTIVITY} SELECT k, b AS bucket, count(*) AS events, round(sum(dur), 2) AS seconds FROM act GROUP BY k, b",
    "ST3_session_stream": f"WITH {SQL_ACTIVITY}, g AS (SELECT k, ts, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY k ORDER BY ts) < 1800 THEN 0 ELSE 1 END AS c FROM act), r AS (SELECT k, ts, sum(c) OVER (PARTITION BY k ORDER BY ts) AS s FROM g), t AS (SELECT k, s, min(ts) AS a, count(*) AS n FROM r GROUP BY k, s) SELECT k, count(*) AS sessions, sum(n)::BIGINT AS events FROM t GROUP BY k",
    "ST6_online_labels": f"""WITH {SQL_ACTIVITY}, p AS (SELECT k, CASE app WHEN 'editor' THEN 'Build' WHEN 'terminal' THEN 'Build' WHEN 'chat' THEN 'Communicate' WHEN 'meeting' THEN 'Meet' ELSE 'Mixed/Unknown' END AS own, row_number() OVER (PARTITION BY k ORDER BY ts, seq) AS i FROM act),
        v AS (SELECT a.k, a.i, a.own, n.own AS label, count(*) AS c, min(n.i) AS f FROM p a JOIN p n ON n.k = a.k AND n.i BETWEEN a.i - 2 AND a.i GROUP BY ALL),
        w AS (SELECT k, own AS predicted, label AS smoothed FROM v QUALIFY row_number() OVER (PARTITION BY k, i ORDER BY c DESC, label = own DESC, f) = 1) SELECT k, predicted, smoothed, count(*) AS n FROM w GROUP BY ALL""",
    "ST7_auto_enqueue": f"WITH {SQL_ACTIVITY}, q AS (SELECT k AS user_id, date_trunc('hour', act.ts) AS h, min({_KQ} / 100) AS c FROM events JOIN act ON seq = event_id WHERE {_KQ} / 100 < 0.3 GROUP BY ALL) SELECT user_id, count(*) AS n, round(sum(c), 4) AS confidence FROM q GROUP BY user_id",
    "ST8_running_segments": f"WITH {SQL_ACTIVITY}, h AS (SELECT k, b, arg_min(app, seq) AS label FROM act GROUP BY k, b), {_seg('h', 'sg')} SELECT k, label, count(*) AS n, sum(buckets)::BIGINT AS buckets FROM sg GROUP BY k, label",
    "ST1_late_events": """WITH e AS (SELECT *, (day(ts) - 1) // 10 AS p FROM events), dl AS (SELECT event_id, event_type, ts, p + CASE WHEN event_id % 17 = 0 THEN 2 ELSE 0 END AS b FROM e
        UNION ALL SELECT event_id, event_type, ts, p + 1 FROM e WHERE event_id % 10 = 0 AND event_id % 17 <> 0),
        m AS (SELECT b, max(max(ts)) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM dl GROUP BY b),
        j AS (SELECT dl.*, coalesce(ts <= latest - INTERVAL 9 DAY, false) AS late FROM dl JOIN m USING (b))
        SELECT event_type, count(DISTINCT event_id) FILTER (WHERE NOT late) AS once, count(*) FILTER (WHERE NOT late) AS in_time, count(*) FILTER (WHERE late) AS late FROM j GROUP BY event_type""",
    "ST4_rolling_state": f"""WITH {SQL_ACTIVITY}, p AS (SELECT act.k, act.ts, app, {_KQ} AS v, row_number() OVER (PARTITION BY act.k ORDER BY act.ts, app) AS i FROM act JOIN events ON seq = event_id),
        s AS (SELECT a.k, a.i, count(DISTINCT n.app) - 1 AS switches FROM p a JOIN p n ON n.k = a.k AND n.i BETWEEN a.i - 14 AND a.i AND n.ts >= a.ts - INTERVAL 15 MINUTE GROUP BY ALL),
        g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY k ORDER BY i) < 1800000000 THEN NULL ELSE epoch_us(ts) END AS o FROM p),
        r AS (SELECT *, max(o) OVER (PARTITION BY k ORDER BY i) AS began FROM g)
        SELECT k, epoch_us(ts) AS us, switches::INTEGER AS switches, {", ".join(sql_quotient(f"(sum(round(v * 10000)::BIGINT) OVER w{n})::BIGINT", f"(count(v) OVER w{n})", 4, 4) + f" AS keys_per_min_rolling_{n}" for n in (5, 15))},
        v - lag(v) OVER (PARTITION BY k ORDER BY i) AS keys_per_min_delta, {sql_quotient("(epoch_us(ts) - began)", 600000, 2, 2)} AS session_minutes FROM r JOIN s USING (k, i)
        WINDOW w5 AS (PARTITION BY k ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), w15 AS (PARTITION BY k ORDER BY i ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)""",
    "ST9_final_report": f"""WITH {SQL_ACTIVITY}, p AS (SELECT k, b, arg_min(app, seq) AS own, row_number() OVER (PARTITION BY k ORDER BY b) AS i FROM act GROUP BY k, b),
        v AS (SELECT a.k, a.b, a.i, a.own, n.own AS label, count(*) AS c, min(n.i) AS f FROM p a JOIN p n ON n.k = a.k AND n.i BETWEEN a.i - 2 AND a.i GROUP BY ALL),
        w AS (SELECT k, b, own, label FROM v QUALIFY row_number() OVER (PARTITION BY k, i ORDER BY c DESC, label = own DESC, f) = 1), {_seg('w', 'sg')},
        c AS (SELECT k, own <> lag(own) OVER q AS a, label <> lag(label) OVER q AS z FROM w WINDOW q AS (PARTITION BY k ORDER BY b)),
        fl AS (SELECT k, count(*) FILTER (WHERE a) / count(*) AS raw, count(*) FILTER (WHERE z) / count(*) AS smooth FROM c GROUP BY k),
        t AS (SELECT count(*) AS n, min(b) AS b0, max(b) AS b1 FROM w)
        SELECT 'minutes' AS section, k::VARCHAR AS k, (make_timestamp(start_ts * 1000000)::DATE)::VARCHAR || ' ' || label AS name, round(sum(buckets) * {BUCKET / 60}, 2) AS value FROM sg GROUP BY 1, 2, 3
        UNION ALL SELECT 'flap_rate', k::VARCHAR, 'raw', round(raw, 4) FROM fl UNION ALL SELECT 'flap_rate', k::VARCHAR, 'smoothed', round(smooth, 4) FROM fl
        UNION ALL SELECT 'telemetry', NULL, unnest(['rows', 'first_window', 'last_window', 'reject_rate']), unnest([n, b0, b1, 0]::DOUBLE[]) FROM t
        UNION ALL SELECT 'telemetry', NULL, 'share ' || label, {sql_quotient("count(*)", "any_value(n)", 4)} FROM w, t GROUP BY label""",
    "ST10_suggestion": f"WITH {SQL_ACTIVITY}, x AS (SELECT k, seq, app, dur / 500 AS c FROM act WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11'), p AS (SELECT k, app, sum(c) AS s, min(seq) AS f, avg(c) AS m FROM x GROUP BY k, app) SELECT k, app AS winner, round(m, 6) AS confidence FROM p QUALIFY row_number() OVER (PARTITION BY k ORDER BY s DESC, f) = 1",
}
