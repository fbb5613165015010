"""Hand-made cases and brute-force comparisons of the operators."""

import hashlib
import hmac
import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import scalars
from tidemark.operators import drift, features, intervals, learning, metrics, rules, segments, validation, votes
from tidemark.sources import activity as io

T0 = datetime(2026, 2, 23, 10, 0, 0)
at = lambda minutes: T0 + timedelta(minutes=minutes)


@pytest.mark.parametrize("secret", [b"k", b"x" * 100])
def test_hmac(spark, secret):
    texts = ["", "abc", "Grüße", "日本"]
    got = spark.createDataFrame([(x,) for x in texts], "t string").select(scalars.keyed_digest(F.col("t"), secret, "ns")).collect()
    assert [r[0] for r in got] == [hmac.new(secret if len(secret) <= 64 else secret, f"ns:{x}".encode(), hashlib.sha256).hexdigest() for x in texts]


def test_hash_bucket(spark):
    values = ["abc123def456", "zz", "", "f" * 20]
    want = []
    for v in values:
        try:
            want.append(int(v, 16) % 256)
        except ValueError:
            want.append(int.from_bytes(hashlib.sha256(v.encode()).digest()[:8], "big") % 256)
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r[0] for r in frame.select(scalars.hash_bucket(F.col("v"))).collect()] == want
    long = spark.createDataFrame([(hashlib.sha256(str(k).encode()).hexdigest()[: 1 + k],) for k in range(64)], "v string")
    for n in (7, 100, 1 << 31):
        assert [(r[0], r[1]) for r in long.select("v", scalars.hash_bucket(F.col("v"), n)).collect()] == [(r.v, int(r.v, 16) % n) for r in long.collect()]


def test_title_sketch(spark):
    row = scalars.title_sketch(spark.createDataFrame([("Fix  Bug 123 | ﬁle-a",), (None,)], "t string"), "t", b"s").collect()
    assert row[0].title_token_count == 4 and row[0].title_separator_count == 2  # fix bug num file
    assert len(row[0].title_token_sketch) == 128 and abs(sum(row[0].title_char3_sketch) - 1) < 1e-3
    assert row[1].title_token_count == 0 and sum(row[1].title_token_sketch) == 0
    titles = spark.createDataFrame([("Fix Bug 123 fix the bug",), ("",), ("Größe – naïve 42 ✓ 漢字漢字",), (None,)], "t string").repartition(3)
    made = scalars.title_sketch(titles, "t", b"s" * 70)
    clean = scalars.normalize_title(F.coalesce(F.col("t"), F.lit("")))
    hashed = titles.withColumns({"a": scalars.keyed_buckets(scalars.title_tokens(clean), b"s" * 70, "title-token"), "b": scalars.keyed_buckets(scalars.char_ngrams(clean), b"s" * 70, "title-char3")})
    want = scalars.with_bucket_frequencies(hashed, {"x": "a", "y": "b"})
    assert sorted(map(str, made.select("t", "title_token_sketch", "title_char3_sketch").toLocalIterator())) == sorted(map(str, want.select("t", F.col("x").alias("title_token_sketch"), F.col("y").alias("title_char3_sketch")).toLocalIterator()))


def _events(spark, rows):
    return spark.createDataFrame([(0, at(m), i, float(d), a) for i, (m, d, a) in enumerate(rows)], "k int, ts timestamp, seq int, duration_seconds double, app_id string")


def test_dominant_app_tie_goes_to_first_seen(spark):
    got = features.dominant_apps(_events(spark, [(0.1, 20, "b"), (0.5, 20, "a"), (1.2, 5, "a")]), ["k"], 60).orderBy("bucket").collect()
    assert [(r.app_id, r.app_foreground_time_ratio) for r in got] == [("b", 0.3333), ("a", 0.0833)]


def test_sessions_compare_only_the_previous_event(spark):
    got = features.sessions(_events(spark, [(0, 3600, "a"), (1, 10, "a"), (10, 10, "a")]), ["k"], 300).orderBy("session_start").collect()
    assert [r.session_start for r in got] == [at(0), at(10)]


def test_lookback_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.random() * 200, rng.randint(1, 50), rng.choice("abcd")) for _ in range(150)]
    got = {r.bucket: r for r in features.lookback(_events(spark, rows), ["k"], 60, 300).collect()}
    buckets = {int(m) for m, _, _ in rows}
    assert set(got) == {at(b) for b in buckets}
    for b in buckets:
        sums = {}
        for m, d, a in rows:
            if b - 5 <= int(m) <= b:
                sums[a] = sums.get(a, 0) + d
        total = sum(sums.values())
        assert got[at(b)].switches == len(sums) - 1
        assert got[at(b)].entropy == pytest.approx(-sum(v / total * math.log2(v / total) for v in sums.values()), abs=1e-4)
        assert got[at(b)].top2 == pytest.approx(sum(sorted(sums.values())[-2:]) / total, abs=1e-4)


def _sequence(spark, labels):
    return spark.createDataFrame([(0, at(i), x) for i, x in enumerate(labels)], "k int, bucket timestamp, label string")


@pytest.mark.parametrize("labels,size,want", [("BBIBB", 3, "BBBBB"), ("XAB", 3, "XAB"), ("XAB", 1, "XAB")])
def test_rolling_majority(spark, labels, size, want):
    got = segments.rolling_majority(_sequence(spark, labels), ["k"], size).orderBy("bucket").collect()
    assert "".join(r.smoothed for r in got) == want


def test_segments_cover_all_buckets(spark):
    got = segments.segmentize(_sequence(spark, "AAABBAAAAA"), ["k"], 60).orderBy("start_ts").collect()
    assert [(r.label, r.buckets) for r in got] == [("A", 3), ("B", 2), ("A", 5)]
    assert got[0].end_ts == got[1].start_ts


@pytest.mark.parametrize("runs,want", [
    ([("A", 5), ("B", 1), ("A", 4)], [("A", 6), ("A", 4)]),
    ([("A", 5), ("B", 1), ("C", 6)], [("A", 5), ("C", 7)]),
    ([("B", 1), ("C", 6)], [("B", 1), ("C", 6)]),
    ([("A", 4), ("B", 2)], [("A", 6)]),
    ([("A", 3), ("B", 1), ("C", 3)], [("A", 4), ("C", 3)]),
])
def test_absorb_short(runs, want):
    at_, rows = 0, []
    for label, n in runs:
        rows.append(segments.Run(at_, at_ + n, label, n))
        at_ += n
    got = segments.absorb_short(rows, 3)
    assert [(r[2], r[3]) for r in got] == want and got[-1][1] == at_


def test_transitions_need_persistence(spark):
    polls = [(0, "a"), (1, "b"), (2, "a"), (3, "b"), (4, "b"), (5, "b"), (6, "lock"), (7, "lock"), (8, "c")]
    frame = spark.createDataFrame([(0, at(m), a) for m, a in polls], "k int, ts timestamp, app string")
    got = segments.debounced_transitions(frame, ["k"], 120, 60, ["lock"]).orderBy("start_ts").collect()
    assert [(r.app, r.start_ts, r.end_ts) for r in got] == [("a", at(0), at(3)), ("b", at(3), at(6)), ("lock", at(6), at(8))]


def _plain_transitions(polls, seconds, lock_seconds, locked):
    """Blocks by stepping through the polls one by one."""
    out, app, began, candidate, since = [], None, None, None, None
    for now, seen in polls:
        if app is None:
            app, began = seen, now
        elif seen == app:
            candidate = None
        else:
            if seen != candidate:
                candidate, since = seen, now
            if now - since >= (0 if app in locked else lock_seconds if seen in locked else seconds):
                out.append((app, began, since))
                app, began, candidate = seen, since, None
    return out


def test_transitions_against_single_steps(spark):
    rng, rows, want = random.Random(3), [], set()
    for k in range(40):
        at_, polls = 0, []
        for _ in range(rng.randrange(1, 60)):
            at_ += rng.choice([20, 40, 60])
            polls.append((at_, rng.choice(["a", "a", "b", "c", "lock", "lock2"])))
        rows += [(k, T0 + timedelta(seconds=t), a) for t, a in polls]
        want |= {(k, a, T0 + timedelta(seconds=s), T0 + timedelta(seconds=e)) for a, s, e in _plain_transitions(polls, 60, 40, {"lock", "lock2"})}
    got = segments.debounced_transitions(spark.createDataFrame(rows, "k int, ts timestamp, app string"), ["k"], 60, 40, ["lock", "lock2"]).collect()
    assert len(got) == len(want) and {(r.k, r.app, r.start_ts, r.end_ts) for r in got} == want


def test_short_segments_between_borders(spark):
    # cut between long neighbours or not, the fold gives the same
    rng, rows, want = random.Random(9), [], []
    for k in range(30):
        at_, runs = 0, []
        for _ in range(rng.randrange(1, 25)):
            n = rng.choice([1, 1, 2, 3, 4, 7])
            runs.append(segments.Run(at(at_), at(at_ + n), rng.choice("ABC"), n))
            at_ += n
        rows += [(k, *r) for r in runs]
        want += [(k, *r) for r in segments.absorb_short(runs, 3)]
    frame = spark.createDataFrame(rows, "k int, start_ts timestamp, end_ts timestamp, label string, buckets long")
    got = [tuple(r) for r in segments.merge_short_segments(frame, ["k"], 60, 180).collect()]
    assert sorted(got) == sorted(want)


SPAN = "start_ts timestamp, end_ts timestamp, label string, provenance string, user_id int, confidence double, extend_forward boolean, seq int"


def _spans(spark, rows):
    return spark.createDataFrame([(at(a), at(z), label, "manual", user, 1.0, ext, i) for i, (a, z, label, user, ext) in enumerate(rows)], SPAN)


def test_projection(spark):
    windows = spark.createDataFrame([(u, at(m), at(m + 1)) for u in (1, 2) for m in (0, 5, 10, 20, 70)], "user_id int, start timestamp, end timestamp")
    spans = _spans(spark, [(0, 8, "A", 1, False), (5, 12, "B", 1, False), (20, 75, "C", None, False), (10.5, 12, "D", 2, False)])
    got = {(r.user_id, r.start): r.label for r in intervals.project_labels(windows, spans).collect()}
    assert got == {(1, at(0)): "A", (1, at(10)): "B", (1, at(20)): "C", (2, at(20)): "C", (1, at(70)): "C", (2, at(70)): "C"}


def test_overlaps_with_wildcards(spark):
    spans = _spans(spark, [(0, 10, "A", 1, False), (5, 8, "B", 2, False), (9, 12, "C", None, False), (12, 14, "D", 1, False)])
    assert {(r.a, r.b) for r in intervals.overlaps(spans).collect()} == {(0, 2)}


def test_overwrite_splits_and_removes(spark):
    stored = _spans(spark, [(0, 100, "A", 1, False), (40, 50, "B", 1, False), (0, 100, "C", 2, False)])
    new = _spans(spark, [(30, 60, "N", 1, False)]).withColumn("seq", F.lit(9))
    got = sorted((r.label, r.start_ts, r.end_ts) for r in intervals.overwrite(stored, new).collect())
    assert got == [("A", at(0), at(30)), ("A", at(60), at(100)), ("C", at(0), at(100)), ("N", at(30), at(60))]


def test_covered_by_an_open_range_years_later(spark):
    year = 366 * 24 * 60
    spans = _spans(spark, [(0, 10, "A", 1, True), (20, 30, "B", 1, True), (0, 10, "C", 2, True), (5, 6, "D", 2, False)])
    later = [(2 * year, 2 * year + 5), (12, 14), (15, 25), (-5, 3), (40, 41)]
    candidates = _spans(spark, [(a, z, "x", u, False) for u in (1, 2, 3) for a, z in later])
    got = {r.seq for r in intervals.covered(candidates, spans).collect()}
    # user 1: A reaches to 20, B is open from 20; user 2: C ends with D's start
    assert got == {0, 1, 4}


def test_overlaps_with_anyones_spans_against_all_pairs(spark):
    rng = random.Random(2)
    rows = [(a := rng.randrange(3000), a + rng.randrange(1, 900), "A", rng.choice([1, 2, 3, None]), False) for _ in range(120)]
    meets = lambda x, y: (x[3] is None or y[3] is None or x[3] == y[3]) and x[0] < y[1] and y[0] < x[1]
    want = {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if meets(rows[i], rows[j])}
    got = intervals.overlaps(_spans(spark, rows)).collect()
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want


def test_mark_done_as_skipped(spark):
    queue = spark.createDataFrame([(1, at(0), "pending"), (1, at(1), "pending")], "user_id int, bucket timestamp, status string")
    assert sorted(r.status for r in intervals.mark_done(queue, queue.limit(1), "skipped").collect()) == ["pending", "skipped"]
    with pytest.raises(ValueError):
        intervals.mark_done(queue, queue, "lost")


def test_append_truncates_and_rejects(spark):
    stored = _spans(spark, [(0, 50, "A", 1, True), (100, 120, "B", 1, False)])
    new = _spans(spark, [(20, 30, "N", 1, False), (110, 130, "M", 1, False)]).withColumn("seq", F.col("seq") + 5)
    kept, rejected = intervals.append_spans(stored, new)
    assert sorted((r.label, r.end_ts) for r in kept.collect()) == [("A", at(20)), ("B", at(120)), ("N", at(30))]
    assert [r.label for r in rejected.collect()] == ["M"]


def test_votes(spark):
    rows = spark.createDataFrame([(0, 0, "B", 0.9), (0, 1, "A", 0.3), (0, 2, "A", 0.4), (0, 3, "B", 0.2)], "iv int, seq int, label string, confidence double")
    assert votes.majority(rows, ["iv"]).first().winner == "B"
    assert votes.aggregate_interval(rows, ["iv"], "confidence_weighted").first()[1:] == ("B", 0.55)


def test_baseline_rules(spark):
    base = {"app_category": "x", "active_seconds_any": 40.0, "max_idle_run_seconds": 10.0, "is_browser": False, "is_editor": False, "is_terminal": False, "scroll_events_per_min": 1.0, "keys_per_min": 20.0, "shortcut_rate": 0.5}
    cases = [({}, "Mixed/Unknown"), ({"app_category": "lockscreen"}, "BreakIdle"), ({"active_seconds_any": None}, "BreakIdle"), ({"max_idle_run_seconds": 51.0}, "BreakIdle"), ({"is_browser": True, "scroll_events_per_min": 5.0, "keys_per_min": 2.0}, "ReadResearch"), ({"is_terminal": True, "keys_per_min": 40.0, "shortcut_rate": 2.0}, "Build"), ({"is_browser": True, "scroll_events_per_min": None}, "Mixed/Unknown")]
    names = list(base)
    schema = ", ".join(f"{n} {'string' if n == 'app_category' else 'boolean' if n.startswith('is_') else 'double'}" for n in names)
    frame = spark.createDataFrame([tuple((base | c)[n] for n in names) for c, _ in cases], schema)
    assert [r[0] for r in frame.select(rules.baseline_label()).collect()] == [w for _, w in cases]


def test_taxonomy_bad_config():
    for buckets in ({"X": ("Nope",)}, {" ": ("A",)}, {"X": ()}):
        with pytest.raises(ValueError):
            rules.check_taxonomy(buckets, ["A"])


def test_metrics_of_rejected_rows(spark):
    rows = spark.createDataFrame([("A", "A"), ("A", "Mixed/Unknown"), ("B", "A")], "label string, predicted string")
    got = {r.label: r for r in metrics.per_class(rows, ["A", "B", "C"]).collect()}
    assert (got["A"].precision, got["A"].recall, got["A"].support, got["C"].f1) == (0.5, 0.5, 2, 0.0)
    assert metrics.confusion(rows, ["A", "B", "C"]).agg(F.sum("n")).first()[0] == 2


def test_drift_statistics_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    a, b = rng.normal(size=400).round(2), rng.normal(0.4, size=300).round(2)
    frame = lambda x: spark.createDataFrame([("f", float(v)) for v in x], "feature string, value double")
    edges = np.unique(np.percentile(a, np.linspace(0, 100, 11)))
    p, q = (np.maximum(np.histogram(x, edges)[0] / np.histogram(x, edges)[0].sum(), 1e-8) for x in (a, b))
    assert drift.psi(frame(a), frame(b)).first().psi == pytest.approx(float(((q - p) * np.log(q / p)).sum()), abs=1e-9)
    grid = np.sort(np.concatenate([a, b]))
    d = float(np.abs(np.searchsorted(np.sort(a), grid, "right") / 400 - np.searchsorted(np.sort(b), grid, "right") / 300).max())
    row = drift.ks(frame(a), frame(b)).first()
    assert row.statistic == pytest.approx(d, abs=1e-12)
    assert row.p_value == pytest.approx(drift.kolmogorov_scalar(d, 400, 300), abs=1e-9)
    assert drift.psi(frame([1.0]), frame(b)).first().psi == 0.0


def test_quantiles_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    values = {"a": rng.normal(size=2000), "b": rng.integers(0, 6, 900).astype(float), "c": np.array([5.0]), "d": np.repeat([1.0, 9.0], [700, 5])}
    rows = [(f, float(v)) for f, own in values.items() for v in own]
    shares = [0, 0.05, 0.1, 0.25, 0.5, 0.95, 1]
    got = {r.feature: r for r in drift.quantiles(spark.createDataFrame(rows, "feature string, value double"), shares).collect()}
    for f, own in values.items():
        assert np.allclose(got[f].quantiles, np.quantile(own, shares)) and got[f].n == len(own)
    assert drift.quantiles(spark.createDataFrame([], "feature string, value double"), shares).count() == 0


def test_temperature_and_isotonic_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(12)
    classes = ("a", "b", "c")
    logits = rng.normal(size=(300, 3)) * 3
    probs = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    label = np.where(rng.random(300) < 0.6, probs.argmax(1), rng.integers(0, 3, 300))
    frame = spark.createDataFrame([(k % 4, classes[y], p.tolist()) for k, (y, p) in enumerate(zip(label, probs))], "user_id int, label string, probs array<double>")

    def loss(rows, t):
        x = np.log(np.maximum(probs[rows], 1e-12)) / t
        return -np.mean(x[np.arange(len(rows)), label[rows]] - np.log(np.exp(x).sum(1)))

    for keys, groups in (((), {None: np.arange(300)}), (("user_id",), {u: np.arange(u, 300, 4) for u in range(4)})):
        got = {(r.user_id if keys else None): r.temperature for r in learning.fit_temperature(frame, classes, keys).collect()}
        for u, rows in groups.items():
            assert loss(rows, got[u]) <= min(loss(rows, t) for t in np.arange(0.1, 5, 0.01)) + 1e-6
    boundaries, values = learning.fit_isotonic(frame, classes)[0]
    # pool adjacent violators over the distinct probabilities
    x = probs[:, 0]
    blocks = []
    for v in np.unique(x):
        own = (label[x == v] == 0).astype(float)
        blocks.append([own.mean(), len(own), v, v])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2], b[3]])
    for mean, _, low, high in blocks:
        assert np.allclose(np.interp([low, high], boundaries, values), mean, atol=1e-6)


def test_time_split_is_a_partition(spark):
    rows = spark.createDataFrame([(u, at(i)) for u, n in ((1, 20), (2, 7)) for i in range(n)], "user_id int, bucket timestamp")
    counts = {(r.user_id, r.split): r["count"] for r in learning.time_split(rows).groupBy("user_id", "split").count().collect()}
    assert counts == {(1, "train"): 14, (1, "val"): 3, (1, "test"): 3, (2, "train"): 4, (2, "val"): 1, (2, "test"): 2}


def test_fingerprint_ignores_order(spark):
    rows = spark.range(100).withColumn("x", F.col("id") % 7)
    one = learning.fingerprint(rows).first()[0]
    assert one == learning.fingerprint(rows.orderBy(F.desc("id")).repartition(5).select("x", "id")).first()[0]
    assert one != learning.fingerprint(rows.withColumn("x", F.col("x") + (F.col("id") == 3).cast("int"))).first()[0]


def test_validation(spark):
    want = T.StructType([T.StructField("a", T.DoubleType()), T.StructField("b", T.StringType()), T.StructField("c", T.StringType())])
    have = spark.createDataFrame([(1, 2, True)], "a int, b int, d boolean")
    assert validation.contract(have, want) == [("missing", "c"), ("extra", "d"), ("type", "b")]
    assert validation.forbidden_columns(spark.createDataFrame([], "x array<struct<raw_keys: int>>, y int").schema) == ["x.raw_keys"]


def test_export_round_trip(spark, tmp_path):
    text = '{"buckets": {"w": {"type": "currentwindow", "events": [{"timestamp": "2026-02-23T10:00:00Z", "duration": 30.0, "data": {"app": "Firefox", "title": "Page 1"}}, {"timestamp": "2026-02-23T12:00:00+01:00", "data": {}}]}, "a": {"type": "afkstatus", "events": []}}}'
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.json").write_text(text)
    (tmp_path / "a" / "y.json").write_text(text[len('{"buckets": ') : -1])
    got = io.parse_export(io.read_export(spark, str(tmp_path / "a")), "salt").orderBy("ts", "app_id").collect()
    assert [(r.app_id, r.ts.hour, r.duration_seconds) for r in got] == [("org.mozilla.firefox", 10, 30.0)] * 2 + [("unknown.unknown", 11, 0.0)] * 2


def test_writers_refuse_raw_columns(spark, tmp_path):
    with pytest.raises(ValueError):
        io.write_segments(spark.range(1).withColumn("raw_title", F.lit("x")), str(tmp_path / "s"))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k int, ts timestamp, seq int, duration_seconds double, app_id string")
    assert features.dominant_apps(none, ["k"], 60).count() == 0
    assert features.lookback(none, ["k"], 60, 300).count() == 0
    assert segments.segmentize(spark.createDataFrame([], "k int, bucket timestamp, label string"), ["k"], 60).count() == 0
    assert intervals.overlaps(spark.createDataFrame([], SPAN)).count() == 0


def test_time_split_cuts_at_decimal_shares(spark):
    # 90 * 0.7 is 62.99... in doubles
    rows = spark.range(90).select(F.lit(1).alias("user_id"), F.timestamp_seconds("id").alias("bucket"))
    assert {r["split"]: r["count"] for r in learning.time_split(rows).groupBy("split").count().collect()} == {"train": 63, "val": 13, "test": 14}


def test_merging_takes_no_group_for_each_part(spark):
    rows, now = [], 0
    for k in (None, 1, 2):
        for n in range(400):
            length = 5 if n % 4 < 2 else 1 + n % 3
            rows.append((k, now, now + 60 * length, "ABC"[n * n % 3], length))
            now += 60 * length
    frame = spark.createDataFrame(rows, "k int, s long, e long, label string, buckets long").select("k", F.timestamp_seconds("s").alias("start_ts"), F.timestamp_seconds("e").alias("end_ts"), "label", "buckets")
    merged = segments.merge_short_segments(frame, ["k"], 60, 180)
    assert "FlatMapGroups" not in merged._jdf.queryExecution().toString()
    got = {(r.k, int(r.start_ts.timestamp()), int(r.end_ts.timestamp()), r.label, r.buckets) for r in merged.collect()}
    whole = {(k, *run) for k in (None, 1, 2) for run in segments.absorb_short([segments.Run(*r[1:]) for r in rows if r[0] == k], 3)}
    assert got == whole and merged.schema == frame.schema


def test_validation_makes_its_table_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.range(50).select(F.lit(1).alias("k"), F.timestamp_seconds(F.col("id") * 60).alias("bucket"), F.timestamp_seconds(F.col("id") * 60 + 60).alias("bucket_end_ts"), F.timestamp_seconds(F.lit(0)).alias("session_start"), F.lit("a").alias("app_id"), F.lit(2.0).alias("keys_per_min"))
    found = validation.validate(rows.mapInArrow(counted, rows.schema), ["k"], ["app_id"], ["keys_per_min"], 60).collect()
    assert [(r["check"], r["subject"]) for r in found] == [("constant", "keys_per_min")] and made.value == 50


def test_lookback_spreads_no_rows_over_empty_buckets(spark):
    # two busy buckets, far apart and over a border of blocks: nothing is made for the 700 hours between
    at = 8 * 54_000 * 4000
    events = spark.createDataFrame([(1, at - 3600, "a", 2.0), (1, at, "b", 6.0), (1, at + 54_000, "b", 1.0), (1, at + 700 * 3600, "c", 1.0)], "k int, s long, app_id string, duration_seconds double").withColumn("ts", F.timestamp_seconds("s"))
    back = features.lookback(events, ["k"], 3600, 54_000)
    # a row stands in one block or two, however many buckets the window has
    assert "sequence(bucket" not in back._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((int(r.bucket.timestamp()) - at, r.switches, r.entropy, r.top2) for r in back.collect())
    assert got == [(-3600, 0, 0.0, 1.0), (0, 1, 0.8113, 1.0), (54_000, 0, 0.0, 1.0), (700 * 3600, 0, 0.0, 1.0)]
