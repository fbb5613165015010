"""Streams over several micro-batches against the same rows at once."""

from datetime import datetime, timedelta

from tidemark.operators import features, learning, segments
from tidemark.streaming import live
from tidemark.streaming.ordered import memories, started

T0 = datetime(2026, 2, 23, 10, 0, 0)
at = lambda minutes: T0 + timedelta(minutes=minutes)


def _in_files(spark, tmp_path, parts, schema):
    """A stream that reads one part after another, each a micro-batch."""
    folder = str(tmp_path / "in")
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


CLOSING = (-1, at(1_000_000))


def _result(spark, stream, tmp_path):
    started(stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True)).awaitTermination()
    return spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))


def test_segments_go_on_over_batches(spark, tmp_path):
    # 01 02 of one label, the label changes in the third batch and a second key is silent meanwhile
    schema = "k int, bucket timestamp, label string"
    parts = [[(1, at(0), "A"), (2, at(0), "B")], [(1, at(1), "A"), (1, at(2), "A")], [(1, at(3), "A"), (1, at(4), "C"), (2, at(4), "B")], [(1, at(5), "C")]]
    stream = _in_files(spark, tmp_path, [*parts, [(*CLOSING, "-")]], schema).withWatermark("bucket", "10 minutes")
    done = _result(spark, live.running_segments(stream, ["k"], 60), tmp_path)
    got = sorted(tuple(r) for r in live.read_segments(done, str(tmp_path / "marks"), ["k"]).where("k > 0").collect())
    whole = segments.segmentize(spark.createDataFrame([r for p in parts for r in p], schema), ["k"], 60)
    assert got == sorted(tuple(r) for r in whole.select("k", "start_ts", "end_ts", "label", "buckets").collect())
    assert [(r[0], r[3], r[4]) for r in got] == [(1, "A", 4), (1, "C", 2), (2, "B", 2)]


def test_open_segments_take_a_row_a_key_after_many_batches(spark, tmp_path):
    schema = "k int, bucket timestamp, label string"
    parts = [[(k, at(20 * n + k), "AB"[n // 7 % 2]) for k in range(3)] for n in range(25)]
    stream = _in_files(spark, tmp_path, parts, schema).withWatermark("bucket", "1 minute")
    done = _result(spark, live.running_segments(stream, ["k"], 1200), tmp_path)
    assert memories(spark, str(tmp_path / "marks")).count() == 3
    whole = segments.segmentize(spark.createDataFrame([r for p in parts for r in p], schema), ["k"], 1200).where("label = 'A' OR buckets = 7")
    finished = sorted(tuple(r) for r in done.collect())
    assert finished == [r for r in sorted(tuple(x) for x in whole.select(*done.columns).collect()) if r in finished] and len(finished) == 9


def test_queue_is_compared_with_what_is_stored(spark, tmp_path):
    schema = "user_id int, bucket timestamp, predicted string, confidence double"
    parts = [[(1, at(0), "A", 0.2), (1, at(1), "A", 0.9)], [(1, at(0), "B", 0.1), (2, at(0), "A", 0.3)], [(2, at(0), "C", 0.2)]]
    path = str(tmp_path / "queue")
    live.enqueue_batches(_in_files(spark, tmp_path, parts, schema), path, str(tmp_path / "marks"), 0.55).awaitTermination()
    assert sorted((r.user_id, r.bucket, r.predicted_label) for r in spark.read.parquet(path).collect()) == [(1, at(0), "A"), (2, at(0), "A")]


def test_trailing_votes_equal_the_batch(spark, tmp_path):
    schema = "k int, ts timestamp, seq int, label string"
    rows = [(k, at(m), m, "ABA-CCB"[(m * (k + 1)) % 7]) for k in range(3) for m in range(20)]
    parts = [[r for r in rows if r[1] < at(7)], [r for r in rows if at(7) <= r[1] < at(8)], [r for r in rows if r[1] >= at(8)]]
    # rows of one key in one batch come in any order, and in the next batch if the delay allows it
    parts[0].append(parts[1].pop())
    parts[2].append(parts[0].pop(0))
    stream = _in_files(spark, tmp_path, [[*reversed(p)] for p in parts] + [[(*CLOSING, 0, "-")]], schema).withWatermark("ts", "30 minutes")
    got = sorted((r.k, r.seq, r.smoothed) for r in _result(spark, live.trailing_votes(stream, ["k"], 5), tmp_path).where("k >= 0").collect())
    whole = segments.rolling_majority(spark.createDataFrame(rows, schema), ["k"], 5, order=("ts",), trailing=True)
    assert got == sorted((r.k, r.seq, r.smoothed) for r in whole.collect())


def _votes(spark, tmp_path, idle):
    schema = "k int, ts timestamp, seq int, label string"
    parts = [[(1, at(0), 0, "A"), (1, at(1), 1, "A")], [(2, at(600), 2, "B")], [(2, at(601), 3, "B"), (None, at(601), 9, "Z")], [(1, at(602), 4, "C")], [(*CLOSING, 5, "-")], [(-1, at(1_000_100), 6, "-")]]
    stream = _in_files(spark, tmp_path, parts, schema).withWatermark("ts", "1 minute")
    return {r.seq: r.smoothed for r in _result(spark, live.trailing_votes(stream, ["k"], 5, idle_seconds=idle), tmp_path).where("k >= 0").collect()}


def test_state_of_silent_keys_is_dropped(spark, tmp_path):
    assert _votes(spark, tmp_path, 3600) == {0: "A", 1: "A", 2: "B", 3: "B", 4: "C"}  # with the old labels, A would win
    # timers have cleared what was silent when a later batch came
    assert [r.k for r in memories(spark, str(tmp_path / "marks")).select("k").collect()] == [-1]


def test_state_is_kept_without_a_limit(spark, tmp_path):
    assert _votes(spark, tmp_path, None) == {0: "A", 1: "A", 2: "B", 3: "B", 4: "A"}
    assert sorted(r.k for r in memories(spark, str(tmp_path / "marks")).select("k").collect()) == [-1, 1, 2]


def test_transitions_of_a_stream_equal_the_batch(spark, tmp_path):
    polls = [(0, "a"), (1, "b"), (2, "a"), (3, "b"), (4, "b"), (5, "b"), (6, "lock"), (7, "lock"), (8, "c")]
    rows = [(0, at(m), a) for m, a in polls]
    stream = _in_files(spark, tmp_path, [rows[:4], rows[4:7], rows[7:], [(*CLOSING, "-")]], "k int, ts timestamp, app string").withWatermark("ts", "10 minutes")
    got = sorted((r.app, r.start_ts, r.end_ts) for r in _result(spark, live.transitions(stream, ["k"], 120, 60, ["lock"]), tmp_path).collect())
    whole = segments.debounced_transitions(spark.createDataFrame(rows, "k int, ts timestamp, app string"), ["k"], 120, 60, ["lock"])
    assert got == sorted((r.app, r.start_ts.timestamp(), r.end_ts.timestamp()) for r in whole.collect())


def test_rolling_features_equal_the_batch(spark, tmp_path):
    schema = "k int, ts timestamp, app_id string, keys_per_min double, clicks_per_min double"
    gaps = [0, 1, 1, 2, 1, 9, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 5, 1, 1, 30, 1]
    rows, now = [], 0
    for n, gap in enumerate(gaps * 2):
        now += gap
        for k in range(2):
            rows.append((k, at(now) + timedelta(seconds=n % 3), "abcd"[(n * n + k) % 4], None if n % 6 == 4 else n * 1.37 % 50, float(n % 9)))
    parts = [sorted(rows[i::7], key=lambda r: -r[1].timestamp()) for i in range(7)]
    stream = _in_files(spark, tmp_path, [*parts, [(*CLOSING, "-", None, None)]], schema).withWatermark("ts", "1 day")
    options = {"rolling": ("keys_per_min", "clicks_per_min"), "deltas": ("keys_per_min", "clicks_per_min")}
    made = live.rolling_features(stream, ["k"], 15, 300, **options)
    got = sorted((tuple(r) for r in _result(spark, made, tmp_path).where("k >= 0").collect()), key=repr)
    whole = features.rolling_context(spark.createDataFrame(rows, schema), ["k"], 15, 300, **options).select(*made.columns)
    assert got == sorted((tuple(r) for r in whole.collect()), key=repr) and len(got) == len(rows)


def test_late_and_repeated_rows(spark, tmp_path):
    schema = "id int, ts timestamp, app string"
    # 2 comes twice in a batch and again later; 9 is too late, 5 is behind but in time
    parts = [[(1, at(0), "a"), (2, at(10), "b"), (2, at(10), "b")], [(3, at(30), "a")], [(2, at(10), "b"), (5, at(5), "c"), (4, at(60), "a")], [(9, at(20), "a"), (6, at(61), "b")], [(10, at(29), "z"), (4, at(60), "a")]]
    folder, path, late, marks = (str(tmp_path / x) for x in ("in", "admitted", "late", "admitting"))
    for part in parts:
        spark.createDataFrame(part, schema).write.mode("append").parquet(folder)
        live.admit(spark.readStream.schema(schema).parquet(folder), path, late, marks, 1800).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(late).collect()) == [9, 10]
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path).drop("batch").withWatermark("ts", "30 minutes")
    got = _result(spark, live.without_repeats(stream, ["id"]), tmp_path)
    assert sorted(tuple(r) for r in got.collect()) == sorted({r for p in parts for r in p if r[0] not in (9, 10)})
    assert len(list((tmp_path / "admitted-latest").iterdir())) == 2


def test_predictions_of_a_stream_equal_the_batch(spark, tmp_path):
    import random

    rng = random.Random(4)
    schema = "user_id int, ts timestamp, seq int, x double, y double, label string"
    classes = ["A", "B", "C"]
    rows = [(n % 4, at(n), n, rng.gauss(n % 3, 0.8), rng.gauss(-(n % 3), 0.8), classes[n % 3]) for n in range(120)]
    whole = spark.createDataFrame(rows, schema)
    model = learning.train_classifier(whole, ["x", "y"], classes)
    calibrators = spark.createDataFrame([(0, 0.5), (1, 3.0)], "user_id int, temperature double")
    thresholds = spark.createDataFrame([(2, 0.9)], "user_id int, threshold double")
    predict = lambda df: live.predictions(df.drop("label"), model, ["x", "y"], classes, calibrators, 1.2, thresholds, 0.5, {"Front": ("A", "B")})
    stream = _in_files(spark, tmp_path, [rows[:50], rows[50:51], rows[51:], [(-1, at(1_000_000), 0, 0.0, 0.0, "A")]], schema).withWatermark("ts", "10 minutes")
    made = live.trailing_votes(predict(stream), ["user_id"], 5, carried=("predicted", "confidence", "rejected", "mapped_label"))
    got = sorted(tuple(r) for r in _result(spark, made, tmp_path).where("user_id >= 0").collect())
    batch = segments.rolling_majority(predict(whole), ["user_id"], 5, order=("ts",), trailing=True).select(*made.columns)
    assert got == sorted(tuple(r) for r in batch.collect())
    assert {r[-3] for r in got} == {True, False} and {r[-2] for r in got} == {"Front", "Other", "Mixed/Unknown"}


def test_windows_close_with_a_later_row(spark, tmp_path):
    rows = [(1, at(0), 1.0, "a"), (1, at(2), 1.0, "a"), (1, at(90), 1.0, "a"), (None, at(100_000), None, None)]
    stream = _in_files(spark, tmp_path, [rows], "k int, ts timestamp, duration_seconds double, app_id string").withWatermark("ts", "10 minutes")
    got = _result(spark, live.session_stream(stream, ["k"], 300), tmp_path).where("k IS NOT NULL").collect()
    assert sorted(r.events for r in got) == [1, 2]


class _Store:
    """A state store and its timers in memory; counts the calls."""

    def __init__(self):
        self.calls, self.values, self.maps, self.timers = 0, {}, {}, set()

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def _state(self, held, **more):
        from types import SimpleNamespace

        def counted(f):
            def call(*given):
                self.calls += 1
                return f(*given)

            return call

        return SimpleNamespace(**{name: counted(f) for name, f in more.items()})

    def getValueState(self, name, schema):
        v = self.values
        return self._state(v, get=lambda: v.get(name), exists=lambda: name in v, update=lambda x: v.__setitem__(name, x), clear=lambda: v.pop(name, None))

    def getMapState(self, name, keys, schema):
        m = self.maps.setdefault(name, {})
        return self._state(m, getValue=lambda k: m.get(k), containsKey=lambda k: k in m, updateValue=m.__setitem__, removeKey=m.pop, keys=lambda: iter(list(m)), iterator=lambda: iter(list(m.items())))

    def expire(self, processor, watermark):
        from types import SimpleNamespace

        made = []
        for at in sorted(t for t in self.timers if t < watermark):
            self.timers.discard(at)
            for frame in processor.handleExpiredTimer((1,), SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark), SimpleNamespace(getExpiryTimeInMs=lambda at=at: at)):
                made += frame["n"].tolist()
        return made


def _processor(spark, store):
    from pyspark.sql import types as types

    from tidemark.streaming.ordered import _OrderedFold

    ddl = types.StructType.fromDDL
    processor = _OrderedFold(["ts", "n", "k"], 1, ddl("ts ARRAY<LONG>, n ARRAY<LONG>, k ARRAY<LONG>"), ddl("k LONG"), ddl("_latest LONG, seen LONG"), ["k", "n"], lambda held, row: (((held[0] if held else 0) + 1,), [(row[1],)]), 86_400, None)
    processor.init(store)
    return processor


def _frame(numbers):
    import pandas as pd

    return pd.DataFrame({"ts": [pd.Timestamp(T0) + pd.Timedelta(hours=n) for n in numbers], "n": list(numbers), "k": 1})


def test_a_key_with_few_rows_takes_few_calls_of_the_store(spark):
    store = _Store()
    processor = _processor(spark, store)
    list(processor.handleInputRows((1,), iter([_frame(range(0, 27 * 24, 12))]), None))
    assert store.expire(processor, 4_000_000_000_000) == list(range(0, 27 * 24, 12))
    assert store.calls <= 8 and not store.timers and not store.maps["waiting"] and not store.values and set(store.maps["memory"]) == {(1,)}


def test_rows_of_a_busy_key_go_by_block_and_come_out_in_order(spark):
    import random

    rng, store, left = random.Random(3), _Store(), list(range(1500))
    processor, got = _processor(spark, store), []
    midnight = int(T0.timestamp() * 1000) // 86_400_000 * 86_400_000
    # rows of days that wait already come between watermarks, and more than fit one value at once
    for day, share in ((2, 0.5), (5, 0.02), (9, 0.1), (40, 0.9), (200, 1)):
        must = [n for n in left if n + 10 < 24 * day]
        part = [n for n in left if n in must or rng.random() < share]
        left = [n for n in left if n not in set(part)]
        rng.shuffle(part)
        list(processor.handleInputRows((1,), iter([_frame(part[:100]), _frame(part[100:])]), None))
        assert len(store.values["few"][0]) <= 256
        got += store.expire(processor, midnight + day * 86_400_000 + 1)
    assert got == list(range(1500)) and not store.maps["waiting"] and not store.timers
