"""Two-level scans, isotonic fits, searches and gates against brute force."""

import random
from datetime import datetime, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import drift, features, intervals, learning, metrics, reports, rules, scans

T0 = datetime(2026, 2, 23)
at = lambda minutes: T0 + timedelta(minutes=minutes)


def _events(seed, n, days=6):
    """Rows of a few keys, one with half of them, a null one, equal times and days without rows."""
    rng = random.Random(seed)
    return [(rng.choice([1, 1, 1, 2, 3, None]), at(rng.choice([0, 1, 4, days]) * 1440 + rng.randrange(0, 400)), k, rng.choice([None, 1.0, 300.0, 5000.0])) for k in range(n)]


def test_previous_row_over_blocks(spark):
    rows = _events(1, 300)
    frame = spark.createDataFrame(rows, "k int, ts timestamp, seq int, v double")
    got = {r.seq: r.before for r in scans.previous(frame, ["k"], ["ts", "seq"], F.col("v"), "before", block_seconds=3600).collect()}
    want = {}
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        want |= {r[2]: before for r, before in zip(mine, [None, *[x[3] for x in mine]])}
    assert got == want


def test_sessions_of_a_hot_user(spark):
    rows = [(k, t, s, v or 0.0) for k, t, s, v in _events(2, 400)]
    frame = spark.createDataFrame(rows, "k int, ts timestamp, seq int, duration_seconds double")
    want = []
    for key in {r[0] for r in rows}:
        end = None
        for _, ts, _, d in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            if end is None or (ts - end).total_seconds() >= 1800:
                want.append((key, ts))
            end = ts + timedelta(seconds=d)
    assert sorted(map(tuple, features.sessions(frame, ["k"], 1800).collect()), key=repr) == sorted(want, key=repr)


def test_asof_join(spark):
    rng = random.Random(3)
    left = [(rng.choice([1, 1, 2, None, 9]), at(rng.randrange(0, 9000)), k) for k in range(200)]
    right = [(rng.choice([1, 1, 2, None]), at(rng.choice([0, 3000, 8000]) + rng.randrange(0, 60)), k, rng.choice(["a", None])) for k in range(120)]
    got = scans.asof(spark.createDataFrame(left, "k int, at timestamp, n int"), spark.createDataFrame(right, "k int, since timestamp, seq int, v string"), ["k"], "at", "since", ["v", "seq"], ["seq"], block_seconds=3600)
    want = []
    for k, t, n in left:
        best = max((r for r in right if r[0] == k and r[1] <= t), key=lambda r: (r[1], r[2]), default=(None, None, None, None))
        want.append((k, t, n, best[3], best[2]))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_labels_at_many_instants(spark):
    rng = random.Random(4)
    spans = [(rng.choice([1, 2, None]), at(s := rng.randrange(0, 3000)), at(s + rng.choice([5, 60, 900])), rng.choice("AB"), rng.random() < 0.8, k) for k in range(60)]
    frame = spark.createDataFrame(spans, "user_id int, start_ts timestamp, end_ts timestamp, label string, extend_forward boolean, seq int")
    instants = [(u, at(m)) for u in (1, 2, None, 7) for m in range(0, 4200, 60)]
    got = {(r.user_id, r.at): r.label for r in intervals.labels_at(spark.createDataFrame(instants, "user_id int, at timestamp"), frame).collect()}
    ends = {}
    for u, start, end, _, forward, k in spans:
        following = min((x[1] for x in spans if x[0] == u and x[1] > start), default=None)
        ends[k] = end if not forward else None if following is None else max(end, following)
    want = {(u, t): max(((s[1], s[5], s[3]) for s in spans if s[0] == u and s[4] and s[1] <= t and (ends[s[5]] is None or t < ends[s[5]])), default=(0, 0, None))[2] for u, t in instants}
    assert got == want


def test_numbers_in_order(spark):
    values = [f"v{k * 7919 % 1000:04d}" for k in range(1000)] + [None]
    got = scans.numbered(spark.createDataFrame([(v,) for v in values], "v string").repartition(7), ["v"], "n").collect()
    assert [r.v for r in sorted(got, key=lambda r: r.n)] == [None, *sorted(values[:-1])] and sorted(r.n for r in got) == list(range(1001))
    assert scans.numbered(spark.createDataFrame([], "v string"), ["v"], "n").count() == 0


def _isotonic(points):
    """Least squares under rising values, by the max-min formula."""
    out = []
    for i in range(len(points)):
        out.append(max(min(sum(p[2] for p in points[j : k + 1]) / sum(p[1] for p in points[j : k + 1]) for k in range(i, len(points))) for j in range(i + 1)))
    return out


def test_isotonic_fit_is_exact(spark):
    rng = random.Random(5)
    classes = ["A", "B"]
    rows = []
    for _ in range(150):
        p = round(rng.random(), rng.choice([1, 9]))
        rows.append(("A" if rng.random() < p * p else rng.choice(["B", "C"]), [p, 1 - p]))
    frame = spark.createDataFrame(rows, "label string, probs array<double>").repartition(5)
    curves = learning.fit_isotonic(frame, classes)
    fitted = {tuple(r.probs): None for r in frame.collect()}
    for k, name in enumerate(classes):
        xs = sorted({p[k] for _, p in rows})
        points = [(x, sum(p[k] == x for _, p in rows), sum(p[k] == x and y == name for y, p in rows)) for x in xs]
        fit = dict(zip(xs, _isotonic(points)))
        for p in fitted:
            fitted[p] = (*(fitted[p] or ()), max(fit[p[k]], 1e-12))
    # boundaries rise, and a point of the data gets its own value, not an interpolated one
    assert all(xs == sorted(set(xs)) and ys == sorted(ys) for xs, ys in curves.values())
    applied = rules.apply_isotonic(frame.select("probs", F.col("probs").alias("given")), curves).collect()
    for r in applied:
        want = fitted[tuple(r.given)]
        assert all(abs(a - b / sum(want)) < 1e-12 for a, b in zip(r.probs, want))
    outside = rules.apply_isotonic(spark.createDataFrame([([-1.0, 2.0],)], "probs array<double>"), curves).first().probs
    ends = [max(curves[0][1][0], 1e-12), max(curves[1][1][-1], 1e-12)]
    assert all(abs(a - b / sum(ends)) < 1e-12 for a, b in zip(outside, ends))


def test_pooling_in_parts_is_pooling_at_once():
    rng = random.Random(6)
    for _ in range(50):
        points = [(x, x, n := rng.randint(1, 4), rng.randint(0, n)) for x in range(60)]
        cut = sorted(rng.sample(range(60), 5))
        parts = [points[a:b] for a, b in zip([0, *cut], [*cut, 60])]
        assert learning.pool_adjacent([b for p in parts for b in learning.pool_adjacent(p)]) == learning.pool_adjacent(points)


def test_sampled_search(spark):
    space = {"regParam": (0.001, 10.0), "elasticNetParam": [0.0, 0.5]}
    settings = learning.sample_settings(space, 50, seed=3)
    assert settings == learning.sample_settings(space, 50, seed=3) != learning.sample_settings(space, 50, seed=4) and settings[:5] == learning.sample_settings(space, 5, seed=3)
    assert all(0.001 <= s["regParam"] <= 10 for s in settings) and {s["elasticNetParam"] for s in settings} == {0.0, 0.5} and sum(s["regParam"] < 0.1 for s in settings) > 15
    rng = random.Random(7)
    rows = [("AB"[k % 2], rng.gauss(k % 2 * 2, 1), "val" if k % 5 == 0 else "train") for k in range(120)]
    frame = spark.createDataFrame(rows, "label string, x double, split string")
    one, other = (learning.search(frame, ["x"], ["A", "B"], [{"regParam": 0.01, "maxIter": 5}, {"regParam": 50.0, "elasticNetParam": 1.0, "maxIter": 5}, {"regParam": 0.01, "maxIter": 5}], n).orderBy("trial").collect() for n in (1, 3))
    assert one == other and [r.rank for r in one] == [1, 3, 2] and one[0].macro_f1 > one[1].macro_f1


def _table(spark, **changes):
    values = {("macro_f1", ""): 0.8, ("weighted_f1", ""): 0.8, ("precision", "BreakIdle"): 0.97, ("recall", "BreakIdle"): 0.95, ("min_precision", ""): 0.6, ("reject_rate", ""): 0.1, ("seen_macro_f1", ""): 0.8, ("unseen_macro_f1", ""): 0.7}
    values |= {tuple(k.split("__")): v for k, v in changes.items()}
    return spark.createDataFrame([(*k, v) for k, v in values.items() if v is not None], "metric string, label string, value double")


def test_each_gate_can_fail(spark):
    champion = _table(spark)

    def failed(**changes):
        return {r.gate for r in metrics.regression_gates(champion, _table(spark, **changes)).collect() if not r.passed}

    assert failed() == set()
    assert failed(macro_f1__=0.7) == {"macro_f1_no_regression"} and failed(macro_f1__=0.78) == set()
    assert failed(precision__BreakIdle=0.9) == {"breakidle_precision", "challenger_acceptance"} == failed(precision__BreakIdle=None)
    assert failed(min_precision__=0.4) == {"no_class_below_50_precision", "challenger_acceptance"}
    for change in ({"reject_rate__": 0.01}, {"reject_rate__": 0.4}, {"weighted_f1__": 0.6}, {"recall__BreakIdle": 0.5}, {"seen_macro_f1__": 0.6}, {"unseen_macro_f1__": None}):
        assert failed(**change) == {"challenger_acceptance"}


def test_modes_by_hand(spark):
    labels = ["A", "B"]
    probs = [0.9, 0.9, 0.45, 0.9, 0.52, 0.1, 0.1, 0.1]
    rows = [(1, at(k), "AAAAABBB"[k], [p, 1 - p]) for k, p in enumerate(probs)] + [(2, at(0), "B", [0.8, 0.2])]
    frame = spark.createDataFrame(rows, "user_id int, bucket timestamp, label string, probs array<double>")
    got = {r["mode"]: r for r in metrics.evaluation_modes(frame, labels, 1.0, 0.56, ["user_id"], 60, 3, F.col("user_id") == 1).collect()}
    # rejected: the third and the fifth; votes of three make the third A, and reject the fourth between them
    assert {m: r.reject_rate for m, r in got.items()} == {"raw": 0.2222, "calibrated": 0.0, "calibrated_reject": 0.2222, "smoothed": 0.2222, "interval": 0.2222}
    assert got["raw"].macro_f1 == got["calibrated_reject"].macro_f1 and got["smoothed"].seen_macro_f1 == 0.875 and got["smoothed"].unseen_macro_f1 == 0.0
    # segments of user 1: A, rejected, B against A, B; of user 2: A against B
    assert got["interval"].macro_f1 == got["interval"].weighted_f1 == 0.5


def test_final_report_of_nothing_and_of_little(spark):
    schema = "k int, bucket timestamp, label string, smoothed string"
    rows = [(1, at(0), "A", "A"), (1, at(60), "B", "A"), (1, at(120), "B", "Mixed/Unknown")]
    got = {(r.section, r.name): r.value for r in reports.final_report(spark.createDataFrame(rows, schema), ["k"], 3600).collect()}
    assert got == {("minutes", "2026-02-23 A"): 120.0, ("minutes", "2026-02-23 Mixed/Unknown"): 60.0, ("flap_rate", "raw"): 0.3333, ("flap_rate", "smoothed"): 0.3333, ("telemetry", "rows"): 3.0, ("telemetry", "first_window"): T0.timestamp() if T0.tzinfo else (T0 - datetime(1970, 1, 1)).total_seconds(), ("telemetry", "last_window"): (at(120) - datetime(1970, 1, 1)).total_seconds(), ("telemetry", "reject_rate"): 0.3333, ("telemetry", "share A"): 0.6667, ("telemetry", "share Mixed/Unknown"): 0.3333}
    assert drift.class_shares(spark.createDataFrame([], schema), "smoothed").first().rows == 0


def test_running_sums_and_quantiles_over_ranges(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    columns = {"a": rng.normal(size=700), "b": rng.integers(0, 4, 300).astype(float), "c": np.array([5.0])}
    frame = spark.createDataFrame([(f, float(v)) for f, vs in columns.items() for v in vs], "feature string, value double").repartition(6)
    shares = [0.0, 0.05, 0.33, 0.5, 1.0]
    got = {r.feature: r for r in drift.quantiles(frame, shares).collect()}
    assert {f: r.n for f, r in got.items()} == {f: len(v) for f, v in columns.items()}
    assert all(np.allclose(got[f].quantiles, np.quantile(v, shares)) for f, v in columns.items())
    sums = drift.running_sums(frame.groupBy("feature", "value").agg(F.count("*").alias("n")), ["n"]).collect()
    assert all(r.before_n == (columns[r.feature] < r.value).sum() for r in sums)


def test_sketches_of_days_merge_to_the_whole(spark):
    import numpy as np

    rng = np.random.default_rng(9)
    days = [(d, "x", float(v)) for d in range(12) for v in rng.exponential(1 + d, 2000)] + [(3, "y", None), (3, "y", 2.0)]
    frame = spark.createDataFrame(days, "date int, feature string, value double")
    sketches = drift.daily_sketches(frame.repartition(5))
    assert sketches.count() == 13
    shares = [0.01, 0.1, 0.5, 0.9, 0.99]
    got = {r.feature: r for r in drift.sketched_quantiles(sketches, shares).collect()}
    values = np.array([v for _, f, v in days if f == "x"])
    assert got["x"].n == 24000 and got["y"].n == 1 and got["y"].quantiles == [2.0] * 5
    assert all(abs((values <= q).mean() - s) < drift.SKETCH_ERROR for q, s in zip(got["x"].quantiles, shares))
    old, new = sketches.where("date < 6"), sketches.where("date >= 6")
    rows = frame.where("value IS NOT NULL").select("date", "feature", "value")
    exact = {r.feature: r.psi for r in drift.psi(rows.where("date < 6").drop("date"), rows.where("date >= 6").drop("date")).collect()}
    near = {r.feature: r.psi for r in drift.sketched_psi(old, new).collect()}
    assert abs(near["x"] - exact["x"]) < 0.02 and near["y"] == exact["y"] == 0.0


def _odd_events(spark):
    """Two users and none, several events in a bucket, gaps inside buckets and between them, missing times, durations and apps."""
    rows = [(u, s, (s * 7 + (u or 0)) % 997, None if s % 11 == 0 else float(s % 1900), None if s % 13 == 0 else "abc"[s % 3]) for u in (1, 2, None) for s in range(0, 90_000, 613)]
    rows += [(1, None, 1000, 5.0, "a"), (2, 7, 1001, 4000.0, "b"), (2, 7, 1002, 1.0, "b")]
    events = spark.createDataFrame(rows, "k long, s long, seq long, duration_seconds double, app_id string").withColumn("ts", F.timestamp_seconds(F.col("s") + F.lit(1_700_000_000))).drop("s")
    events = events.withColumns({"app_category": F.concat(F.lit("of "), "app_id"), "window_title_hash": F.substring(F.sha2(F.col("app_id"), 256), 1, 12)})
    zero = F.lit(0).cast("long")
    samples = events.select("k", "ts", "seq", "duration_seconds", (F.col("seq") % 4).alias("presses"), (F.col("seq") % 3).alias("clicks"), F.col("seq").alias("delta_x"), zero.alias("delta_y"), zero.alias("scroll_x"), zero.alias("scroll_y"))
    return events, samples


def test_feature_table_shuffles_little(spark):
    """Events, samples, blocks of the look-back and keys: one shuffle each."""
    table = features.feature_table(*_odd_events(spark), ["k"], 3600, 1800, (5 * 3600, 15 * 3600))
    assert table._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 4


def test_feature_table_is_its_operators(spark):
    events, samples = _odd_events(spark)
    keys, windows = ["k"], (5 * 3600, 15 * 3600)
    table = features.feature_table(events, samples, keys, 3600, 1800, windows).drop("bucket_end_ts")
    parts = features.dominant_apps(events, keys, 3600, ["app_category", "window_title_hash"]).join(features.app_changes(events, keys, 3600), ["k", "bucket"]).join(features.input_activity(samples, keys, 3600), ["k", "bucket"], "left")
    for w, name in zip(windows, ("5m", "15m")):
        parts = parts.join(features.lookback(events, keys, 3600, w).toDF("k", "bucket", f"app_switch_count_last_{name}", f"app_entropy_{name}", f"top2_app_concentration_{name}"), ["k", "bucket"])
    parts = features.with_sessions(parts, events, keys, 3600, 1800)
    order = Window.partitionBy("k").orderBy("bucket")
    run = parts.withColumn("_run", F.sum(F.coalesce((F.col("app_id") != F.lag("app_id").over(order)).cast("int"), F.lit(0))).over(order))
    in_run = Window.partitionBy("k", "_run").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    units = lambda c, n: F.round(F.col(c) * 10**n).cast("long")
    parts = run.withColumn("app_dwell_time_seconds", F.round(F.sum(units("dominant_seconds", 6)).over(in_run).cast("decimal(38,0)") / 1_000_000, 2).cast("double")).drop("_run")
    for c in ("keys_per_min", "mouse_distance"):
        for n in (5, 15):
            last = order.rowsBetween(1 - n, 0)
            parts = parts.withColumn(f"{c}_rolling_{n}", F.round(F.sum(units(c, 4)).over(last).cast("decimal(30,0)") / F.count(c).over(last) / 10_000, 4).cast("double"))
    names = [c for c in table.columns if c in parts.columns]
    assert len(names) > 25
    want = [tuple(r) for r in parts.select(*names).orderBy("k", "bucket").collect()]
    assert [tuple(r) for r in table.select(*names).orderBy("k", "bucket").collect()] == want
    assert {r[0] for r in want} == {1, 2} and len({r.session_start for r in parts.collect()}) > 2


def test_hash_bucket_of_short_and_long_digits(spark):
    values = ["0", "ff", "123456789abcdef", "123456789abcdef0", "f" * 40, "ABCdef"]
    got = spark.createDataFrame([(v,) for v in values], "v string").select(scalars.hash_bucket(F.col("v"), 251)).collect()
    assert [r[0] for r in got] == [int(v, 16) % 251 for v in values]
