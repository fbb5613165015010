"""Queries over buckets, sessions, look-back windows and dynamics (A*, W1-W11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import features
from tidemark.sources import testdata as td
from tidemark.sources.testdata import BUCKET, KEYS, SQL_ACTIVITY, SQL_SAMPLES, SQL_SPANS, sql_quotient

GAP = 1800
NEAR, FAR = 5 * BUCKET, 15 * BUCKET


def _flat(df: DataFrame) -> DataFrame:
    """Bucket times as epoch seconds."""
    return df.select(*[F.unix_seconds(f.name).alias(f.name) if f.dataType.typeName() == "timestamp" else F.col(f.name) for f in df.schema.fields])


def a1(spark: SparkSession, d: str) -> DataFrame:
    return _flat(features.bucketed(td.activity(spark, d), BUCKET).groupBy("k", "bucket").agg(F.count("*").alias("events"), F.round(F.sum("duration_seconds"), 2).alias("seconds")))


def a2(spark: SparkSession, d: str) -> DataFrame:
    return _flat(features.dominant_apps(td.activity(spark, d), KEYS, BUCKET).select("k", "bucket", "app_id"))


def a3(spark: SparkSession, d: str) -> DataFrame:
    return _flat(features.dominant_apps(td.activity(spark, d), KEYS, BUCKET, ["app_category", "window_title_hash", "is_browser"]).select("k", "bucket", "app_category", "window_title_hash", "is_browser"))


def a4(spark: SparkSession, d: str) -> DataFrame:
    return _flat(features.dominant_apps(td.activity(spark, d), KEYS, BUCKET).select("k", "bucket", "app_foreground_time_ratio"))


def a5(spark: SparkSession, d: str) -> DataFrame:
    return _flat(features.app_changes(td.activity(spark, d), KEYS, BUCKET))


def a6(spark: SparkSession, d: str) -> DataFrame:
    return _flat(features.input_activity(td.samples(spark, d), KEYS, BUCKET).drop("max_idle_run_seconds"))


def a7(spark: SparkSession, d: str) -> DataFrame:
    return _flat(features.input_activity(td.samples(spark, d), KEYS, BUCKET).select("k", "bucket", "max_idle_run_seconds"))


def a8(spark: SparkSession, d: str) -> DataFrame:
    slices = features.evidence(td.activity(spark, d), td.samples(spark, d), KEYS, BUCKET // 2)
    return _flat(slices.withColumns({"app_ids": F.array_join("app_ids", ","), "title_hashes": F.array_join("title_hashes", ",")}))


def a9(spark: SparkSession, d: str) -> DataFrame:
    acts = td.activity(spark, d)
    buckets = features.dominant_apps(acts, KEYS, BUCKET).select("k", "bucket")
    joined = features.attach_evidence(buckets, features.evidence(acts, td.samples(spark, d), KEYS, BUCKET // 2), KEYS, BUCKET)
    return _flat(joined.select("k", "bucket", F.size("evidence").alias("slices"), F.aggregate("evidence", F.lit(0).cast("long"), lambda a, x: a + x["key_events"]).alias("keys")))


def table(spark: SparkSession, d: str) -> DataFrame:
    return features.feature_table(td.activity(spark, d), td.samples(spark, d), KEYS, BUCKET, GAP, (NEAR, FAR))


def a10(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d)
    return _flat(rows.select("k", "bucket", "bucket_end_ts", "session_id", "app_id", "window_title_bucket", "hour_of_day", "day_of_week", "schema_version", F.array_join("source_ids", ",").alias("sources")))


def a11(spark: SparkSession, d: str) -> DataFrame:
    return features.top_apps(td.activity(spark, d), F.timestamp_seconds(F.lit(1704412800)), F.timestamp_seconds(F.lit(1705276800)))


def a12(spark: SparkSession, d: str) -> DataFrame:
    rows = features.label_summary(table(spark, d), KEYS, td.activity(spark, d))
    return rows.withColumn("top_apps", F.array_join(F.transform("top_apps", lambda a: F.concat_ws(":", a.app_id, a.n.cast("string"))), ","))


def a13(spark: SparkSession, d: str) -> DataFrame:
    return features.label_stats(td.spans(spark, d)).withColumn("date", F.col("date").cast("string"))


def a14(spark: SparkSession, d: str) -> DataFrame:
    buckets = features.dominant_apps(td.activity(spark, d), KEYS, BUCKET)
    return features.readiness(buckets, td.spans(spark, d), F.lit("2023-12-30").cast("date"), F.lit("2024-02-05").cast("date")).withColumn("date", F.col("date").cast("string"))


def w1(spark: SparkSession, d: str) -> DataFrame:
    return features.sessions(td.activity(spark, d), KEYS, GAP).groupBy("k").agg(F.count("*").alias("sessions"), F.unix_seconds(F.max("session_start")).alias("last_start"))


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    acts = td.activity(spark, d)
    return features.with_sessions(features.dominant_apps(acts, KEYS, BUCKET, ["window_title_hash"]), acts, KEYS, BUCKET, GAP)


def w2(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_sessions(spark, d).select("k", "bucket", "session_start"))


def w3(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_sessions(spark, d).select("k", "bucket", features.session_id(F.col("k"), F.col("session_start")).alias("session_id")))


def w4(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_sessions(spark, d).select("k", "bucket", "session_length_so_far", "idle_return_indicator"))


def w5(spark: SparkSession, d: str) -> DataFrame:
    acts = td.activity(spark, d)
    near, far = features.lookback(acts, KEYS, BUCKET, NEAR), features.lookback(acts, KEYS, BUCKET, FAR)
    return _flat(near.select("k", "bucket", F.col("switches").alias("near")).join(far.select("k", "bucket", F.col("switches").alias("far")), ["k", "bucket"]))


def w6(spark: SparkSession, d: str) -> DataFrame:
    return _flat(features.lookback(td.activity(spark, d), KEYS, BUCKET, NEAR).select("k", "bucket", "entropy"))


def w7(spark: SparkSession, d: str) -> DataFrame:
    return _flat(features.lookback(td.activity(spark, d), KEYS, BUCKET, FAR).select("k", "bucket", "top2"))


def w8(spark: SparkSession, d: str) -> DataFrame:
    rows = features.dynamics(features.input_activity(td.samples(spark, d), KEYS, BUCKET), KEYS)
    return _flat(rows.select("k", "bucket", "keys_per_min_rolling_5", "keys_per_min_rolling_15", "mouse_distance_rolling_5", "mouse_distance_rolling_15"))


def w9(spark: SparkSession, d: str) -> DataFrame:
    rows = features.dynamics(features.input_activity(td.samples(spark, d), KEYS, BUCKET), KEYS)
    return _flat(rows.select("k", "bucket", "keys_per_min_delta", "clicks_per_min_delta", "mouse_distance_delta"))


def w10(spark: SparkSession, d: str) -> DataFrame:
    return _flat(features.dwell(features.dominant_apps(td.activity(spark, d), KEYS, BUCKET), KEYS).select("k", "bucket", "app_dwell_time_seconds"))


def w11(spark: SparkSession, d: str) -> DataFrame:
    return _flat(features.title_repeats(_sessions(spark, d), KEYS).select("k", "bucket", "title_repeat_count_session"))


DOM = f"""{SQL_ACTIVITY},
per_app AS (SELECT k, b, app, sum(round(dur * 1000000)::BIGINT)::BIGINT AS us, us / 1e6 AS total, min(ts) AS t0, min(seq) AS s0, arg_min(title, (ts, seq)) AS title FROM act GROUP BY k, b, app),
dom AS (SELECT k, b, app, us, total, title FROM per_app QUALIFY row_number() OVER (PARTITION BY k, b ORDER BY us DESC, t0, s0) = 1)"""
SESS = f"""{DOM},
gaps AS (SELECT k, b, ts, epoch(ts) - lag(epoch(ts) + dur) OVER (PARTITION BY k ORDER BY ts, seq) AS gap FROM act),
starts AS (SELECT DISTINCT k, b AS s FROM gaps WHERE gap IS NULL OR gap >= {GAP}),
sess AS (SELECT dom.*, (SELECT max(s) FROM starts WHERE starts.k = dom.k AND s <= dom.b) AS s FROM dom)"""
SID = "substr(sha256(k || ':' || strftime(make_timestamp(s * 1000000), '%Y-%m-%dT%H:%M:%S') || '+00:00'), 1, 12)"
INP = f"""{SQL_SAMPLES},
live AS (SELECT *, presses > 0 AS kb, clicks > 0 OR dx > 0 OR sy > 0 AS ms FROM smp),
isl AS (SELECT *, sum(CASE WHEN kb OR ms THEN 1 ELSE 0 END) OVER (PARTITION BY k, b ORDER BY ts, seq) AS island FROM live),
idle AS (SELECT k, b, max(i) AS idle FROM (SELECT k, b, island, sum(CASE WHEN kb OR ms THEN 0 ELSE dur END) AS i FROM isl GROUP BY ALL) GROUP BY k, b),
inp AS (
  SELECT k, b AS bucket, round(sum(presses) / {BUCKET / 60}, 2) AS keys_per_min, round(sum(clicks) / {BUCKET / 60}, 2) AS clicks_per_min,
         round(sum(sy) / {BUCKET / 60}, 2) AS scroll_events_per_min, sum(dx)::DOUBLE AS mouse_distance,
         round(coalesce(sum(dur) FILTER (WHERE kb), 0), 2) AS active_seconds_keyboard, round(coalesce(sum(dur) FILTER (WHERE ms), 0), 2) AS active_seconds_mouse,
         round(coalesce(sum(dur) FILTER (WHERE kb OR ms), 0), 2) AS active_seconds_any,
         coalesce({sql_quotient("count(*) FILTER (WHERE kb OR ms) * 1000000", "nullif(sum(round(dur * 1000000)::BIGINT) FILTER (WHERE kb OR ms), 0)::BIGINT", 4)}, 0) AS event_density
  FROM live GROUP BY k, b)"""


def _back(window: int) -> str:
    return f"""{SQL_ACTIVITY}, here AS (SELECT DISTINCT k, b FROM act),
spread AS (SELECT here.k, here.b, app, sum(round(dur * 1000000)::BIGINT)::BIGINT AS d FROM here JOIN act ON act.k = here.k AND act.b BETWEEN here.b - {window} AND here.b GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY k, b ORDER BY d DESC) AS r, sum(d) OVER (PARTITION BY k, b) AS total FROM spread),
back AS (SELECT k, b, count(*) - 1 AS switches, abs(round(-sum(d / total * log2(d / total)), 4)) AS entropy, {sql_quotient("(sum(d) FILTER (WHERE r <= 2))::BIGINT", "nullif(any_value(total), 0)::BIGINT", 4)} AS top2 FROM ranked GROUP BY k, b)"""


QUERIES = {
    "A1_event_buckets": a1, "A2_dominant_app": a2, "A3_dominant_attributes": a3, "A4_foreground_ratio": a4, "A5_app_changes": a5, "A6_input_activity": a6, "A7_longest_idle_run": a7,
    "A8_evidence": a8, "A9_attach_evidence": a9, "A10_feature_rows": a10, "A11_top_apps": a11, "A12_label_summary": a12, "A13_label_stats": a13, "A14_readiness": a14,
    "W1_sessions": w1, "W2_session_lookup": w2, "W3_session_id": w3, "W4_session_length": w4, "W5_app_switches": w5, "W6_app_entropy": w6, "W7_top2_share": w7,
    "W8_rolling_means": w8, "W9_deltas": w9, "W10_dwell": w10, "W11_title_repeats": w11,
}
_HALF = BUCKET // 2
_EV = f"""{SQL_ACTIVITY}, {SQL_SAMPLES},
cut AS (SELECT *, CAST(floor(epoch(ts) / {_HALF}) AS BIGINT) * {_HALF} AS h FROM act),
chg AS (SELECT *, app <> lag(app) OVER (PARTITION BY k, h ORDER BY ts, seq) AS c FROM cut),
sl AS (SELECT k, h, string_agg(DISTINCT app, ',' ORDER BY app) AS app_ids, string_agg(DISTINCT title, ',' ORDER BY title) AS title_hashes,
              CAST(floor(sum(dur) * 1000) AS BIGINT) AS foreground_duration_ms, count(*) FILTER (WHERE c) AS app_switches, bool_or(regexp_matches(lower(app), 'zoom|meet|teams')) AS meeting_signal FROM chg GROUP BY k, h),
si AS (SELECT k, CAST(floor(epoch(ts) / {_HALF}) AS BIGINT) * {_HALF} AS h, sum(presses)::BIGINT AS key_events, sum(clicks + abs(dx))::BIGINT AS pointer_events, sum(abs(sy))::BIGINT AS scroll_events FROM smp GROUP BY ALL),
ev AS (SELECT sl.*, coalesce(key_events, 0) AS key_events, coalesce(pointer_events, 0) AS pointer_events, coalesce(scroll_events, 0) AS scroll_events FROM sl LEFT JOIN si USING (k, h))"""
ORACLE_SQL = {
    "A1_event_buckets": f"WITH {SQL_ACTIVITY} SELECT k, b AS bucket, count(*) AS events, round(sum(dur), 2) AS seconds FROM act GROUP BY k, b",
    "A2_dominant_app": f"WITH {DOM} SELECT k, b AS bucket, app AS app_id FROM dom",
    "A3_dominant_attributes": f"WITH {DOM} SELECT k, b AS bucket, app AS app_category, title AS window_title_hash, app = 'browser' AS is_browser FROM dom",
    "A4_foreground_ratio": f"WITH {DOM} SELECT k, b AS bucket, {sql_quotient(f"least(us, {BUCKET * 1000000})", BUCKET * 1000000, 4)} AS app_foreground_time_ratio FROM dom",
    "A5_app_changes": f"WITH {SQL_ACTIVITY}, c AS (SELECT k, b, app <> lag(app) OVER (PARTITION BY k, b ORDER BY ts, seq) AS c FROM act) SELECT k, b AS bucket, count(*) FILTER (WHERE c) AS app_change_count FROM c GROUP BY k, b",
    "A6_input_activity": f"WITH {INP} SELECT * FROM inp",
    "A7_longest_idle_run": f"WITH {INP} SELECT k, b AS bucket, round(idle, 2) AS max_idle_run_seconds FROM idle",
    "A8_evidence": f"WITH {_EV} SELECT k, h AS bucket, app_ids, title_hashes, foreground_duration_ms, app_switches, meeting_signal, key_events, pointer_events, scroll_events, key_events + pointer_events + scroll_events = 0 AS low_interaction_idle_signal FROM ev",
    "A9_attach_evidence": f"WITH {_EV} SELECT k, (h // {BUCKET}) * {BUCKET} AS bucket, count(*)::INTEGER AS slices, sum(key_events)::BIGINT AS keys FROM ev GROUP BY ALL",
    "A10_feature_rows": f"""WITH {SESS} SELECT k, b AS bucket, b + {BUCKET} AS bucket_end_ts, {SID} AS session_id, app AS app_id, (('0x' || title)::BIGINT % 256)::INTEGER AS window_title_bucket,
        (b // 3600 % 24)::INTEGER AS hour_of_day, ((b // 86400 + 3) % 7)::INTEGER AS day_of_week, 'v1' AS schema_version, 'activity,input' AS sources FROM sess""",
    "A11_top_apps": f"WITH {SQL_ACTIVITY} SELECT app AS app_id, count(*) AS n FROM act WHERE epoch(ts) >= 1704412800 AND epoch(ts) < 1705276800 GROUP BY app ORDER BY n DESC, app LIMIT 5",
    "A12_label_summary": f"""WITH {SESS}, {INP.replace(SQL_ACTIVITY + ',', '')},
        ta AS (SELECT k, app, count(*) AS n, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, app) AS r FROM act GROUP BY k, app), tops AS (SELECT k, string_agg(app || ':' || n, ',' ORDER BY r) AS top_apps FROM ta WHERE r <= 5 GROUP BY k)
        SELECT sess.k, (SELECT top_apps FROM tops WHERE tops.k = sess.k) AS top_apps, {", ".join(sql_quotient(f"sum(round({c} * 100)::BIGINT)::BIGINT", f"count({c})", 2, 2) + f" AS mean_{c}" for c in ("keys_per_min", "clicks_per_min", "scroll_events_per_min"))}, count(*) AS buckets, count(DISTINCT s) AS sessions FROM sess LEFT JOIN inp ON inp.k = sess.k AND inp.bucket = sess.b GROUP BY sess.k""",
    "A13_label_stats": f"WITH {SQL_SPANS} SELECT CAST(start_ts::DATE AS VARCHAR) AS date, label, count(*) AS spans, round(sum(round((epoch(end_ts) - epoch(start_ts)) / 60, 1)), 1) AS minutes FROM spn GROUP BY ALL",
    "A14_readiness": f"""WITH {DOM}, {SQL_SPANS}, days AS (SELECT CAST(unnest(generate_series(DATE '2023-12-30', DATE '2024-02-05', INTERVAL 1 DAY)) AS DATE) AS date),
        r AS (SELECT make_timestamp(b * 1000000)::DATE AS date, count(*) AS n_rows FROM dom GROUP BY 1), m AS (SELECT start_ts::DATE AS date, count(*) AS n_spans, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM spn GROUP BY 1)
        SELECT CAST(date AS VARCHAR) AS date, coalesce(n_rows, 0) AS n_rows, coalesce(n_spans, 0) AS n_spans, coalesce(labels, '') AS labels FROM days LEFT JOIN r USING (date) LEFT JOIN m USING (date)""",
    "W1_sessions": f"WITH {SESS} SELECT k, count(*) AS sessions, CAST(floor(epoch(max(ts))) AS BIGINT) AS last_start FROM gaps WHERE gap IS NULL OR gap >= {GAP} GROUP BY k",
    "W2_session_lookup": f"WITH {SESS} SELECT k, b AS bucket, s AS session_start FROM sess",
    "W3_session_id": f"WITH {SESS} SELECT k, b AS bucket, {SID} AS session_id FROM sess",
    "W4_session_length": f"WITH {SESS} SELECT k, b AS bucket, round((b - s) / 60, 2) AS session_length_so_far, b = s AS idle_return_indicator FROM sess",
    "W5_app_switches": f"WITH {SQL_ACTIVITY}, here AS (SELECT DISTINCT k, b FROM act) SELECT here.k, here.b AS bucket, count(DISTINCT app) FILTER (WHERE act.b >= here.b - {NEAR}) - 1 AS near, count(DISTINCT app) - 1 AS far FROM here JOIN act ON act.k = here.k AND act.b BETWEEN here.b - {FAR} AND here.b GROUP BY here.k, here.b",
    "W6_app_entropy": f"WITH {_back(NEAR)} SELECT k, b AS bucket, entropy FROM back",
    "W7_top2_share": f"WITH {_back(FAR)} SELECT k, b AS bucket, top2 FROM back",
    "W8_rolling_means": f"WITH {INP} SELECT k, bucket, " + ", ".join(f"{sql_quotient(f'(sum(round({c} * 10000)::BIGINT) OVER w{n})::BIGINT', f'(count({c}) OVER w{n})', 4, 4)} AS {c}_rolling_{n}" for c in ("keys_per_min", "mouse_distance") for n in (5, 15)) + " FROM inp WINDOW " + ", ".join(f"w{n} AS (PARTITION BY k ORDER BY bucket ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (5, 15)),
    "W9_deltas": f"WITH {INP} SELECT k, bucket, " + ", ".join(f"round({c} - lag({c}) OVER (PARTITION BY k ORDER BY bucket), 4) AS {c}_delta" for c in ("keys_per_min", "clicks_per_min", "mouse_distance")) + " FROM inp",
    "W10_dwell": f"WITH {DOM}, m AS (SELECT *, app <> lag(app) OVER (PARTITION BY k ORDER BY b) AS c FROM dom), r AS (SELECT *, count(*) FILTER (WHERE c) OVER (PARTITION BY k ORDER BY b) AS run FROM m) SELECT k, b AS bucket, {sql_quotient("(sum(us) OVER (PARTITION BY k, run ORDER BY b))::BIGINT", 1, 2, 6)} AS app_dwell_time_seconds FROM r",
    "W11_title_repeats": f"WITH {SESS} SELECT k, b AS bucket, count(*) OVER (PARTITION BY k, s, title ORDER BY b) AS title_repeat_count_session FROM sess",
}
