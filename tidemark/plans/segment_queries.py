"""Queries over label sequences, intervals and votes (W12-W21, J*, V0*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import features, intervals, rules, segments, votes
from tidemark.plans.feature_queries import DOM, INP, SESS, _flat, _sessions
from tidemark.sources import testdata as td
from tidemark.sources.testdata import BUCKET, CLASSES, KEYS, SQL_PREDICTIONS, SQL_SPANS

NOW = 1706832000
T = lambda s: F.timestamp_seconds(F.lit(s))


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return features.dominant_apps(td.activity(spark, d), KEYS, BUCKET).select("k", "bucket", F.col("app_id").alias("label"))


def smoothed(spark: SparkSession, d: str, size: int = 5) -> DataFrame:
    return segments.rolling_majority(labelled(spark, d), KEYS, size)


def segmented(spark: SparkSession, d: str) -> DataFrame:
    return segments.segmentize(smoothed(spark, d).select("k", "bucket", F.col("smoothed").alias("label")), KEYS, BUCKET)


def w12(spark, d):
    return _flat(smoothed(spark, d).select("k", "bucket", "smoothed"))


def w13(spark, d):
    return _flat(segmented(spark, d))


def w14(spark, d):
    return _flat(segments.merge_short_segments(segmented(spark, d), KEYS, BUCKET, 3 * BUCKET))


def w15(spark, d):
    return segments.flap_rate(labelled(spark, d), KEYS).withColumn("flap_rate", F.round("flap_rate", 6))


def w16(spark, d):
    rows = _sessions(spark, d).withColumnRenamed("app_id", "label")
    return _flat(segments.session_label(rows, ["k", "session_start"]))


def w17(spark, d):
    """Rules on editors and terminals with confidences of their own."""
    known = [(*r, {"editor": 0.8, "terminal": 0.6}.get(r[1])) for r in rules.DEFAULT_WEAK_RULES]
    label, rule = rules.weak_label(known)
    rows = features.dominant_apps(td.activity(spark, d), KEYS, BUCKET, ["app_category"]).withColumn("domain_category", F.lit(None).cast("string"))
    return _flat(segments.weak_spans(rows.select("k", "bucket", label.alias("label"), rule.alias("rule"), rules.weak_confidence(known, rule).alias("confidence")), KEYS, BUCKET))


def w18(spark, d):
    hours = segmented(spark, d).withColumn("end_ts", F.timestamp_seconds(F.unix_seconds("start_ts") + (F.unix_seconds("end_ts") - F.unix_seconds("start_ts")) / 60))
    return segments.duration_histogram(hours)


def w19(spark, d):
    polls = labelled(spark, d).select("k", F.col("bucket").alias("ts"), F.col("label").alias("app"))
    return _flat(segments.debounced_transitions(polls, KEYS, 2 * BUCKET, BUCKET, ("terminal",)))


def w20(spark, d):
    rows = segments.day_timeline(td.spans(spark, d).withColumnRenamed("user_id", "k"), KEYS)
    return rows.select("k", F.col("date").cast("string").alias("date"), "label", F.unix_micros("start_ts").alias("start_us"), F.unix_micros("end_ts").alias("end_us"), F.round("fraction", 6).alias("fraction"))


def w21(spark, d):
    rows = segments.unlabeled_time(td.spans(spark, d), ["user_id"], T(NOW))
    return rows.withColumn("minutes", F.round("minutes", 3))


def _windows(spark, d):
    buckets = labelled(spark, d)
    return buckets.select(F.col("k").alias("user_id"), F.col("bucket").alias("start"), F.timestamp_seconds(F.unix_seconds("bucket") + BUCKET).alias("end"))


def j1(spark, d):
    return _flat(intervals.project_labels(_windows(spark, d), td.spans(spark, d)))


def with_following(buckets: DataFrame) -> DataFrame:
    """The buckets, and the one after each, which may have no event."""
    after = F.timestamp_seconds(F.unix_seconds("bucket") + BUCKET)
    return buckets.select("k", F.explode(F.array("bucket", after)).alias("bucket")).distinct()


WITH_FOLLOWING = f"SELECT k, b FROM lab UNION SELECT k, b + {BUCKET} FROM lab"


def j2(spark, d):
    joined = with_following(labelled(spark, d)).join(features.input_activity(td.samples(spark, d), KEYS, BUCKET), ["k", "bucket"], "left")
    return _flat(joined.select("k", "bucket", "keys_per_min"))


def j3(spark, d):
    return intervals.overlaps(td.spans(spark, d))


def _imports(spark, d):
    return td.spans(spark, d).where("seq % 2 = 0").withColumns({"label": F.lit("Review"), "seq": F.col("seq") + 1_000_000})


def j4(spark, d):
    return intervals.merge_imports(td.spans(spark, d), _imports(spark, d)).select("seq", "user_id", "label")


def _new(spark, d):
    moved = F.col("seq") % 3 * F.lit(400)
    shift = lambda c: F.timestamp_micros(F.unix_micros(c) + moved)
    return td.spans(spark, d).where("seq % 15 = 0").select(shift("end_ts").alias("start_ts"), F.timestamp_micros(F.unix_micros("end_ts") + moved + 3_600_000_000).alias("end_ts"), F.lit("Write").alias("label"), "provenance", "user_id", "confidence", F.lit(False).alias("extend_forward"), (F.col("seq") + 2_000_000).alias("seq"))


def j5(spark, d):
    return intervals.snap_boundaries(_new(spark, d), td.spans(spark, d)).select("seq", F.unix_micros("start_ts").alias("s"), F.unix_micros("end_ts").alias("e"))


def j6(spark, d):
    return intervals.effective_ends(td.spans(spark, d)).select("seq", F.unix_micros("effective_end").alias("e"))


def j7(spark, d):
    kept, rejected = intervals.append_spans(td.spans(spark, d), _new(spark, d))
    return kept.select("seq", F.unix_micros("end_ts").alias("e"), F.lit(True).alias("kept")).unionByName(rejected.select("seq", F.unix_micros("end_ts").alias("e"), F.lit(False).alias("kept")))


def j8(spark, d):
    return intervals.overwrite(td.spans(spark, d), _new(spark, d)).select("seq", F.unix_micros("start_ts").alias("s"), F.unix_micros("end_ts").alias("e"))


def j9(spark, d):
    spans = td.spans(spark, d)
    changed = intervals.update_labels(spans, spans.where("seq % 7 = 0").withColumn("label", F.lit("Write")))
    return intervals.delete_spans(changed, spans.where("seq % 11 = 0")).select("seq", "label")


def j10(spark, d):
    short = td.spans(spark, d).where("seq % 10 <> 0").withColumn("end_ts", F.timestamp_seconds(F.unix_seconds("start_ts") + 600))
    return intervals.covered(short, td.spans(spark, d).where("seq % 10 = 0")).select("seq")


def j11(spark, d):
    return intervals.current_labels(td.spans(spark, d), T(1705276800))


def j11_buckets(spark, d):
    """The label at every bucket of every user."""
    instants = features.dominant_apps(td.activity(spark, d), KEYS, BUCKET).select(F.col("k").alias("user_id"), F.col("bucket").alias("at"))
    return _flat(intervals.labels_at(instants, td.spans(spark, d)))


def _preds(spark, d):
    return td.predictions(spark, d).withColumn("bucket", F.timestamp_seconds(F.lit(1704067200) + (F.col("vec_id") % 97) * 60))


def j12(spark, d):
    preds = _preds(spark, d)
    pending = preds.where("vec_id % 6 = 0").select("user_id", "bucket").distinct()
    return _flat(intervals.enqueue(preds, pending).drop("predicted_label").withColumn("confidence", F.round("confidence", 6)))


def j12_drift(spark, d):
    """The fifty least confident buckets after an alert, as requests."""
    preds = _preds(spark, d)
    flagged = preds.orderBy("confidence", "vec_id").limit(50)
    queue = intervals.enqueue_drift(flagged, preds.where("vec_id % 6 = 0").select("user_id", "bucket").distinct())
    return _flat(queue.drop("predicted_label").withColumn("confidence", F.round("confidence", 6)))


def _queue(spark, d):
    preds = _preds(spark, d)
    return intervals.enqueue(preds, preds.where("vec_id % 6 = 0").select("user_id", "bucket").distinct())


def j13(spark, d):
    queue = _queue(spark, d)
    marked = intervals.mark_done(queue, queue.where("user_id = 3"))
    return _flat(intervals.serve_queue(marked, 30, 25, 10).select("user_id", "bucket", F.round("confidence", 6).alias("confidence")))


def j14(spark, d):
    gold = segments.segmentize(labelled(spark, d), KEYS, BUCKET)
    return intervals.interval_accuracy(segmented(spark, d), gold, list(KEYS))


def j15(spark, d):
    preds = td.predictions(spark, d)
    return preds.select("vec_id", "predicted").join(preds.select("vec_id", "label"), "vec_id").groupBy("label", "predicted").agg(F.count("*").alias("n"))


def _votes(spark, d):
    return td.predictions(spark, d).select("user_id", F.col("vec_id").alias("seq"), F.col("predicted").alias("label"), "confidence", "probs", F.floor(F.col("vec_id") / 25).alias("interval"))


_IV = ["user_id", "interval"]


def v0a(spark, d):
    return votes.majority(_votes(spark, d), _IV)


def v0b(spark, d):
    return votes.confidence_weighted(_votes(spark, d), _IV)


def v0c(spark, d):
    return votes.highest_probability(_votes(spark, d), _IV, CLASSES)


def v0d(spark, d):
    return votes.aggregate_interval(_votes(spark, d), _IV)


_LAB = f"{DOM}, lab AS (SELECT k, b, app AS label FROM dom)"
_SMO = f"""{_LAB}, num AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY b) AS i FROM lab),
near AS (SELECT a.k, a.i, n.label, count(*) AS c, min(n.i) AS f FROM num a JOIN num n ON n.k = a.k AND n.i BETWEEN a.i - 2 AND a.i + 2 GROUP BY ALL),
top AS (SELECT k, i, label, c, max(c) OVER (PARTITION BY k, i) AS m, f FROM near),
smo AS (SELECT num.k, num.b, num.i, num.label AS own, coalesce(any_value(top.label) FILTER (WHERE top.label = num.label AND c = m), arg_min(top.label, f) FILTER (WHERE c = m)) AS label FROM num JOIN top USING (k, i) GROUP BY ALL)"""


def _seg(source: str, name: str) -> str:
    return f"""{name}_c AS (SELECT k, b, label, CASE WHEN label <> lag(label) OVER (PARTITION BY k ORDER BY b) THEN 1 ELSE 0 END AS c FROM {source}),
{name}_r AS (SELECT *, sum(c) OVER (PARTITION BY k ORDER BY b) AS run FROM {name}_c),
{name} AS (SELECT k, min(b) AS start_ts, max(b) + {BUCKET} AS end_ts, any_value(label) AS label, count(*) AS buckets FROM {name}_r GROUP BY k, run)"""


_NEW = f"""{SQL_SPANS}, nw AS (SELECT end_ts + to_microseconds(seq % 3 * 400) AS start_ts, end_ts + to_microseconds(seq % 3 * 400 + 3600000000) AS end_ts, user_id, seq + 2000000 AS seq FROM spn WHERE seq % 15 = 0)"""
_EFF = f"{SQL_SPANS}, eff AS (SELECT *, CASE WHEN NOT extend_forward THEN end_ts ELSE greatest(end_ts, (SELECT min(x.start_ts) FROM spn x WHERE x.user_id = spn.user_id AND x.start_ts > spn.start_ts)) END AS e0, (SELECT min(x.start_ts) FROM spn x WHERE x.user_id = spn.user_id AND x.start_ts > spn.start_ts) AS nxt FROM spn)"
_PRED = f"{SQL_PREDICTIONS}, prb AS (SELECT *, 1704067200 + (vec_id % 97) * 60 AS bucket FROM prd), que AS (SELECT user_id, bucket, min(confidence) AS confidence FROM prb WHERE confidence < 0.55 AND (user_id, bucket) NOT IN (SELECT (user_id, bucket) FROM prb WHERE vec_id % 6 = 0) GROUP BY ALL)"
_VOTE = f"{SQL_PREDICTIONS}, vot AS (SELECT user_id, vec_id AS seq, predicted AS label, confidence, probs, vec_id // 25 AS \"interval\" FROM prd)"
_WEAK = "CASE app WHEN 'browser' THEN NULL WHEN 'editor' THEN 'Build' WHEN 'terminal' THEN 'Build' WHEN 'chat' THEN 'Communicate' WHEN 'meeting' THEN 'Meet' END"

QUERIES = {
    "W12_rolling_majority": w12, "W13_segments": w13, "W14_merge_short": w14, "W15_flap_rate": w15, "W16_session_label": w16, "W17_weak_spans": w17, "W18_duration_histogram": w18,
    "W19_transitions": w19, "W20_day_timeline": w20, "W21_unlabeled_time": w21,
    "J1_label_projection": j1, "J2_input_join": j2, "J3_overlaps": j3, "J4_merge_imports": j4, "J5_snap_boundaries": j5, "J6_effective_ends": j6, "J7_append_spans": j7, "J8_overwrite": j8,
    "J9_update_delete": j9, "J10_covered": j10, "J11_current_label": j11, "J11_labels_at": j11_buckets, "J12_enqueue": j12, "J12_drift_enqueue": j12_drift, "J13_serve_queue": j13, "J14_interval_accuracy": j14, "J15_align": j15,
    "V0a_majority": v0a, "V0b_confidence_weighted": v0b, "V0c_highest_probability": v0c, "V0d_interval_result": v0d,
}
ORACLE_SQL = {
    "W12_rolling_majority": f"WITH {_SMO} SELECT k, b AS bucket, label AS smoothed FROM smo",
    "W13_segments": f"WITH {_SMO}, {_seg('smo', 'sg')} SELECT * FROM sg",
    "W15_flap_rate": f"WITH {_LAB}, c AS (SELECT k, label <> lag(label) OVER (PARTITION BY k ORDER BY b) AS c FROM lab) SELECT k, CASE WHEN count(*) > 1 THEN round(count(*) FILTER (WHERE c) / count(*), 6) ELSE 0 END AS flap_rate FROM c GROUP BY k",
    "W16_session_label": f"WITH {SESS}, p AS (SELECT k, s, app, count(*) AS n, min(b) AS f FROM sess GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY k, s) AS total FROM p QUALIFY row_number() OVER (PARTITION BY k, s ORDER BY n DESC, f) = 1) SELECT k, s AS session_start, CASE WHEN n / total >= 0.6 THEN app ELSE 'Mixed' END AS session_label FROM r",
    "W17_weak_spans": f"""WITH {DOM}, l AS (SELECT k, b, app, {_WEAK} AS label FROM dom), c AS (SELECT *, CASE WHEN label = lag(label) OVER w AND b - lag(b) OVER w - {BUCKET} <= 1 THEN 0 ELSE 1 END AS c FROM l WINDOW w AS (PARTITION BY k ORDER BY b)),
        r AS (SELECT *, sum(c) OVER (PARTITION BY k ORDER BY b) AS run FROM c) SELECT k, min(b) AS start_ts, max(b) + {BUCKET} AS end_ts, any_value(label) AS label, 'weak:app_category:' || arg_min(app, b) AS provenance, CASE arg_min(app, b) WHEN 'editor' THEN 0.8 WHEN 'terminal' THEN 0.6 END::DOUBLE AS confidence FROM r WHERE label IS NOT NULL GROUP BY k, run""",
    "W18_duration_histogram": f"WITH {_SMO}, {_seg('smo', 'sg')}, l AS (SELECT (end_ts - start_ts) // 60 AS l FROM sg) SELECT CASE WHEN l <= 60 THEN '<=60' WHEN l <= 120 THEN '<=120' WHEN l <= 180 THEN '<=180' WHEN l <= 300 THEN '<=300' ELSE '>300' END AS bin, count(*) AS n FROM l GROUP BY 1",
    "W20_day_timeline": f"""WITH {SQL_SPANS}, dd AS (SELECT user_id AS k, label, seq, start_ts, end_ts, CAST(unnest(generate_series(start_ts::DATE, end_ts::DATE, INTERVAL 1 DAY)) AS DATE) AS date FROM spn),
        cl AS (SELECT *, epoch_us(date::TIMESTAMP) AS d0, epoch_us(date::TIMESTAMP) + 86399999000 AS d1, greatest(epoch_us(start_ts), epoch_us(date::TIMESTAMP)) AS s, least(epoch_us(end_ts), epoch_us(date::TIMESTAMP) + 86399999000) AS e FROM dd),
        cu AS (SELECT *, coalesce(max(e) OVER (PARTITION BY k, date ORDER BY s, e, label, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), d0) AS cur FROM cl WHERE e > s),
        al AS (SELECT k, date, NULL AS label, cur AS a, s AS z FROM cu WHERE s > cur UNION ALL SELECT k, date, label, CASE WHEN greatest(s, cur) < e THEN greatest(s, cur) ELSE s END, CASE WHEN greatest(s, cur) < e THEN e ELSE s END FROM cu
               UNION ALL SELECT k, date, NULL, max(e), any_value(d1) FROM cu GROUP BY k, date HAVING max(e) < any_value(d1))
        SELECT k, CAST(date AS VARCHAR) AS date, label, a AS start_us, z AS end_us, round((z // 1000 - a // 1000) / 86399999, 6) AS fraction FROM al""",
    "W21_unlabeled_time": f"WITH {SQL_SPANS}, m AS (SELECT user_id, greatest(({NOW} - CAST(floor(epoch(max(end_ts))) AS BIGINT)) / 60, 0) AS m FROM spn GROUP BY user_id) SELECT user_id, round(m, 3) AS minutes, m >= 480 AS escalate FROM m",
    "J1_label_projection": f"""WITH {_LAB}, {SQL_SPANS}, j AS (SELECT k, b, spn.label FROM lab JOIN spn ON spn.user_id = k AND epoch_us(start_ts) <= b * 1000000 AND (b + {BUCKET}) * 1000000 <= epoch_us(end_ts))
        SELECT k AS user_id, b AS start, b + {BUCKET} AS "end", any_value(label) AS label FROM j GROUP BY k, b HAVING count(DISTINCT label) = 1""",
    "J2_input_join": f"WITH {_LAB}, {INP} SELECT f.k, f.b AS bucket, keys_per_min FROM ({WITH_FOLLOWING}) f LEFT JOIN inp ON inp.k = f.k AND inp.bucket = f.b",
    "J3_overlaps": f"WITH {SQL_SPANS} SELECT a.seq AS a, b.seq AS b FROM spn a JOIN spn b ON a.user_id = b.user_id AND a.seq < b.seq AND a.start_ts < b.end_ts AND b.start_ts < a.end_ts",
    "J4_merge_imports": f"WITH {SQL_SPANS} SELECT CASE WHEN seq % 2 = 0 THEN seq + 1000000 ELSE seq END AS seq, user_id, CASE WHEN seq % 2 = 0 THEN 'Review' ELSE label END AS label FROM spn",
    "J5_snap_boundaries": f"""WITH {_NEW}, s AS (SELECT nw.*, (SELECT arg_min(x.end_ts, abs(epoch_us(x.end_ts) - epoch_us(nw.start_ts))) FROM spn x WHERE x.user_id = nw.user_id AND abs(epoch_us(x.end_ts) - epoch_us(nw.start_ts)) <= 1000) AS s2,
        (SELECT arg_min(x.start_ts, abs(epoch_us(x.start_ts) - epoch_us(nw.end_ts))) FROM spn x WHERE x.user_id = nw.user_id AND abs(epoch_us(x.start_ts) - epoch_us(nw.end_ts)) <= 1000) AS e2 FROM nw)
        SELECT seq, epoch_us(coalesce(s2, start_ts)) AS s, epoch_us(CASE WHEN e2 > coalesce(s2, start_ts) THEN e2 ELSE end_ts END) AS e FROM s""",
    "J6_effective_ends": f"WITH {_EFF} SELECT seq, CASE WHEN extend_forward AND nxt IS NULL THEN NULL ELSE epoch_us(e0) END AS e FROM eff",
    "J7_append_spans": f"""WITH {_NEW}, al AS (SELECT seq, user_id, start_ts, end_ts, extend_forward AS x, FALSE AS n FROM spn UNION ALL SELECT seq, user_id, start_ts, end_ts, FALSE, TRUE FROM nw),
        c AS (SELECT seq, user_id, start_ts, n, CASE WHEN x AND NOT n THEN coalesce(min(CASE WHEN n THEN start_ts END) OVER (PARTITION BY user_id ORDER BY epoch_us(start_ts) RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), end_ts) ELSE end_ts END AS e FROM al),
        j AS (SELECT seq, n, start_ts, e, max(e) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, min(CASE WHEN NOT n THEN start_ts END) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS l FROM c WINDOW w AS (PARTITION BY user_id ORDER BY start_ts, n, seq))
        SELECT seq, epoch_us(e) AS e, NOT (n AND coalesce(b > start_ts OR l < e, FALSE)) AS kept FROM j""",
    "W19_transitions": f"""WITH {_LAB}, q AS (SELECT k, b, label AS app, CASE WHEN label <> lag(label) OVER (PARTITION BY k ORDER BY b) THEN 1 ELSE 0 END AS c FROM lab),
        r AS (SELECT *, sum(c) OVER (PARTITION BY k ORDER BY b) AS run FROM q), s AS (SELECT k, run AS i, any_value(app) AS app, min(b) AS a, max(b) AS z FROM r GROUP BY k, run),
        t AS (SELECT *, i = 0 OR z - a >= CASE WHEN app = 'terminal' THEN {BUCKET} ELSE {2 * BUCKET} END AS lasted, app = 'terminal' AS locked FROM s),
        u AS (SELECT *, coalesce(max(CASE WHEN lasted THEN i END) OVER w, -1) AS l, coalesce(max(CASE WHEN NOT locked THEN i END) OVER w, -1) AS f FROM t WINDOW w AS (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        v AS (SELECT *, coalesce(app = lag(app) OVER (PARTITION BY k ORDER BY i), FALSE) AS same FROM u WHERE lasted OR l > f),
        x AS (SELECT k, app, a AS start_ts, lead(a) OVER (PARTITION BY k ORDER BY i) AS end_ts FROM v WHERE NOT same) SELECT * FROM x WHERE end_ts IS NOT NULL""",
    "J8_overwrite": f"""WITH {_NEW}, h AS (SELECT s.seq, s.start_ts, s.end_ts, n.start_ts AS a, n.end_ts AS z FROM spn s JOIN nw n ON n.user_id = s.user_id AND s.start_ts < n.end_ts AND n.start_ts < s.end_ts),
        f AS (SELECT *, greatest(start_ts, coalesce(max(z) OVER (PARTITION BY seq ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), start_ts)) AS lo FROM h)
        SELECT seq, epoch_us(lo) AS s, epoch_us(a) AS e FROM f WHERE lo < a UNION ALL SELECT seq, epoch_us(max(z)), epoch_us(any_value(end_ts)) FROM h GROUP BY seq HAVING max(z) < any_value(end_ts)
        UNION ALL SELECT seq, epoch_us(start_ts), epoch_us(end_ts) FROM spn WHERE seq NOT IN (SELECT seq FROM h) UNION ALL SELECT seq, epoch_us(start_ts), epoch_us(end_ts) FROM nw""",
    "J9_update_delete": f"WITH {SQL_SPANS} SELECT seq, CASE WHEN seq % 7 = 0 THEN 'Write' ELSE label END AS label FROM spn WHERE seq % 11 <> 0",
    "J10_covered": f"""WITH {SQL_SPANS}, ext AS (SELECT * FROM spn WHERE seq % 10 = 0), r AS (SELECT user_id, start_ts, (SELECT min(x.start_ts) FROM ext x WHERE x.user_id = ext.user_id AND x.start_ts > ext.start_ts) AS nxt, end_ts FROM ext)
        SELECT seq FROM spn WHERE seq % 10 <> 0 AND EXISTS (SELECT 1 FROM r WHERE r.user_id = spn.user_id AND r.start_ts <= spn.start_ts AND (nxt IS NULL OR make_timestamp((CAST(floor(epoch(spn.start_ts)) AS BIGINT) + 600) * 1000000) <= greatest(r.end_ts, nxt)))""",
    "J11_current_label": f"WITH {_EFF} SELECT user_id, arg_max(label, (start_ts, seq)) AS label FROM eff WHERE extend_forward AND epoch(start_ts) <= 1705276800 AND (nxt IS NULL OR 1705276800 < epoch(e0)) GROUP BY user_id",
    "J11_labels_at": f"WITH {DOM}, {_EFF} SELECT dom.k AS user_id, dom.b AS at, (SELECT arg_max(label, (start_ts, seq)) FROM eff WHERE eff.user_id = dom.k AND extend_forward AND epoch_us(start_ts) <= dom.b * 1000000 AND (nxt IS NULL OR dom.b * 1000000 < epoch_us(e0))) AS label FROM dom",
    "J12_drift_enqueue": f"WITH {_PRED}, low AS (SELECT * FROM prb ORDER BY prb.confidence, vec_id LIMIT 50) SELECT user_id, bucket, round(min(confidence), 6) AS confidence, 'drift' AS reason, 'pending' AS status FROM low WHERE (user_id, bucket) NOT IN (SELECT (user_id, bucket) FROM prb WHERE vec_id % 6 = 0) GROUP BY user_id, bucket",
    "J12_enqueue": f"WITH {_PRED} SELECT user_id, bucket, round(confidence, 6) AS confidence, 'low_confidence' AS reason, 'pending' AS status FROM que",
    "J13_serve_queue": f"WITH {_PRED} SELECT user_id, bucket, round(confidence, 6) AS confidence FROM que WHERE user_id <> 3 ORDER BY que.confidence, user_id, bucket LIMIT 20",
    "J14_interval_accuracy": f"WITH {_SMO}, {_seg('smo', 'sg')}, {_seg('lab', 'gd')} SELECT count(*) AS segments, round(avg(CASE WHEN gd.label = sg.label THEN 1 ELSE 0 END), 6) AS accuracy FROM sg LEFT JOIN gd ON gd.k = sg.k AND gd.start_ts = sg.start_ts",
    "J15_align": f"WITH {SQL_PREDICTIONS} SELECT label, predicted, count(*) AS n FROM prd GROUP BY ALL",
    "V0a_majority": f"""WITH {_VOTE}, p AS (SELECT user_id, "interval", label, count(*) AS n, min(seq) AS f FROM vot GROUP BY ALL) SELECT user_id, "interval", label AS winner FROM p QUALIFY row_number() OVER (PARTITION BY user_id, "interval" ORDER BY n DESC, f) = 1""",
    "V0b_confidence_weighted": f"""WITH {_VOTE}, p AS (SELECT user_id, "interval", label, sum(confidence) AS n, min(seq) AS f FROM vot GROUP BY ALL) SELECT user_id, "interval", label AS winner FROM p QUALIFY row_number() OVER (PARTITION BY user_id, "interval" ORDER BY n DESC, f) = 1""",
    "V0c_highest_probability": f"""WITH {_VOTE}, u AS (SELECT user_id, "interval", unnest(probs) AS p, generate_subscripts(probs, 1) AS c FROM vot), p AS (SELECT user_id, "interval", c, sum(p) AS n FROM u GROUP BY ALL)
        SELECT user_id, "interval", {td._CLASS_LIST}[c] AS winner FROM p QUALIFY row_number() OVER (PARTITION BY user_id, "interval" ORDER BY n DESC, c) = 1""",
    "V0d_interval_result": f"""WITH {_VOTE}, p AS (SELECT user_id, "interval", label, count(*) AS n, min(seq) AS f, avg(confidence) AS c FROM vot GROUP BY ALL) SELECT user_id, "interval", label AS winner, round(c, 6) AS confidence FROM p QUALIFY row_number() OVER (PARTITION BY user_id, "interval" ORDER BY n DESC, f) = 1""",
}
