"""Queries over evaluation metrics, drift and data checks (M*, D*, V1-V12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import drift, features, metrics, rules, validation
from tidemark.plans import feature_queries as fq
from tidemark.plans.feature_queries import INP, SESS, _flat
from tidemark.sources import scratch
from tidemark.sources import testdata as td
from tidemark.sources.testdata import BUCKET, CLASSES, KEYS, SQL_PREDICTIONS, SQL_SPANS, sql_quotient

LIMIT = 0.3


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Predictions with those under the limit rejected."""
    preds = td.predictions(spark, d)
    return preds.withColumn("predicted", rules.reject(F.col("predicted"), F.col("confidence"), F.lit(LIMIT)))


def m1(spark, d):
    return metrics.confusion(predictions(spark, d), CLASSES)


def m2(spark, d):
    return metrics.per_class(predictions(spark, d), CLASSES)


def m3(spark, d):
    return metrics.f1_scores(predictions(spark, d), CLASSES)


def m4(spark, d):
    return metrics.class_distribution(predictions(spark, d), CLASSES)


def m5(spark, d):
    return metrics.reject_rate(predictions(spark, d))


def m6(spark, d):
    both = td.predictions(spark, d).withColumns({"plain": F.col("predicted"), "rejecting": rules.reject(F.col("predicted"), F.col("confidence"), F.lit(LIMIT))}).drop("predicted")
    return metrics.compare(both, ["plain", "rejecting"], CLASSES)


def m7(spark, d):
    preds = predictions(spark, d)
    return metrics.f1_scores(preds, CLASSES, ["user_id"]).join(preds.groupBy("user_id").agg(F.count("*").alias("n")), "user_id")


def m8(spark, d):
    return metrics.slices(predictions(spark, d).withColumn("parity", F.col("vec_id") % 2), ["user_id", "parity"], CLASSES)


def m9(spark, d):
    return metrics.calibration_curve(predictions(spark, d), CLASSES)


def m10(spark, d):
    return metrics.calibration_error(predictions(spark, d), CLASSES)


def m11(spark, d):
    return metrics.brier(predictions(spark, d), CLASSES)


def m12(spark, d):
    return metrics.log_loss(predictions(spark, d), CLASSES)


def m13(spark, d):
    return metrics.top_confusions(predictions(spark, d), CLASSES, 5)


def m14(spark, d):
    rows = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_brand", "p_type")
    known = rows.where("p_partkey % 97 = 0").select(F.explode(F.array(F.struct(F.lit("p_brand").alias("column"), F.col("p_brand").alias("value")), F.struct(F.lit("p_type").alias("column"), F.col("p_type").alias("value")))).alias("x")).select("x.*").distinct().where("value NOT IN ('Brand#3', 'SMALL')")
    return metrics.unknown_rates(rows, known, ["p_brand", "p_type"])


def m15(spark, d):
    return metrics.user_strata(predictions(spark, d), CLASSES)


def m16(spark, d):
    return metrics.reject_by_group(predictions(spark, d)).withColumn("date", F.col("date").cast("string"))


def m17(spark, d):
    preds = predictions(spark, d)
    return metrics.acceptance(metrics.metric_table(preds, CLASSES, F.col("user_id") < 5))


def m18(spark, d):
    """Users under 5 are seen; a user's rows are in the order of their ids."""
    rows = td.predictions(spark, d).select("user_id", F.timestamp_seconds(F.col("vec_id") * BUCKET).alias("bucket"), "label", "probs")
    return metrics.evaluation_modes(rows, CLASSES, 1.4, LIMIT, ["user_id"], BUCKET, 5, F.col("user_id") < 5)


def m19(spark, d):
    return metrics.threshold_sweep(td.predictions(spark, d), CLASSES)


def m20(spark, d):
    champion, challenger = (metrics.metric_table(preds, CLASSES, F.col("user_id") < 5) for preds in (td.predictions(spark, d), predictions(spark, d)))
    return metrics.regression_gates(champion, challenger)


MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
SPLIT = "1998-05-24"


def _halves(spark, d):
    lines = td.table(spark, d, "lineitem").withColumn("l_quantity", F.when(F.col("l_shipdate") >= SPLIT, F.col("l_quantity") + 3).otherwise(F.col("l_quantity")))
    return lines.where(F.col("l_shipdate") < SPLIT), lines.where(F.col("l_shipdate") >= SPLIT)


def _r(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def d1(spark, d):
    a, b = _halves(spark, d)
    return _r(drift.psi(drift.unpivot(a, MEASURES), drift.unpivot(b, MEASURES)), "psi")


def _ranks(values, found, shares):
    """Whether the share of values below, and up to, each found quantile is as near its own as the sketch promises."""
    met = values.join(F.broadcast(found), "feature").groupBy("feature").agg(*[F.avg((F.col("value") < F.get("quantiles", F.lit(k))).cast("int")).alias(f"below_{k}") for k in range(len(shares))], *[F.avg((F.col("value") <= F.get("quantiles", F.lit(k))).cast("int")).alias(f"to_{k}") for k in range(len(shares))])
    near = [(F.col(f"below_{k}") <= q + drift.SKETCH_ERROR) & (F.col(f"to_{k}") >= q - drift.SKETCH_ERROR) for k, q in enumerate(shares)]
    return met.select("feature", sum((F.when(c, 0).otherwise(1) for c in near), F.lit(0)).alias("misses"))


def d9_sketches(spark, d):
    """A sketch of each ship date and measure, stored, merged, and held against all rows."""
    path, shares = scratch.folder(spark, "sketches"), [0.05, 0.25, 0.5, 0.75, 0.95]
    lines = td.table(spark, d, "lineitem").withColumn("date", F.to_date("l_shipdate"))
    values = drift.unpivot(lines, MEASURES, ["date"])
    drift.daily_sketches(values).write.parquet(path)
    found = drift.sketched_quantiles(spark.read.parquet(path), shares)
    return found.select("feature", "n").join(_ranks(values, found.select("feature", "quantiles"), shares), "feature")


def d1_sketches(spark, d):
    """Which features drift between the two halves, told from sketches alone; the exact PSI beside it.

    Where few distinct values are, an edge that moves by one value moves a whole value's rows, so the figures themselves differ more than their ranks.
    """
    halves = [drift.unpivot(half.withColumn("date", F.to_date("l_shipdate")), MEASURES, ["date"]) for half in _halves(spark, d)]
    paths = [scratch.folder(spark, "sketches") for _ in halves]
    for values, path in zip(halves, paths):
        drift.daily_sketches(values).write.parquet(path)
    exact = drift.psi(*[values.drop("date") for values in halves]).select("feature", F.round("psi", 6).alias("exact"))
    return drift.sketched_psi(*[spark.read.parquet(p) for p in paths]).join(exact, "feature").select("feature", (F.col("psi") > 0.2).alias("drifted"), "exact")


def d2(spark, d):
    a, b = _halves(spark, d)
    return _r(drift.ks(drift.unpivot(a, MEASURES), drift.unpivot(b, MEASURES)), "statistic", "p_value")


def d3(spark, d):
    a, b = _halves(spark, d)
    return drift.feature_drift(a, b, MEASURES).select("feature", "drifted")


def _pair(spark, d):
    preds = predictions(spark, d)
    return preds.where("vec_id % 3 = 0"), preds.where("vec_id % 3 <> 0")


def d4(spark, d):
    return drift.reject_increase(*_pair(spark, d))


def d5(spark, d):
    return drift.entropy_spike(*_pair(spark, d))


def d6(spark, d):
    return drift.class_shift(*_pair(spark, d))


def _with_measures(spark, d):
    lines = td.table(spark, d, "lineitem").select(F.monotonically_increasing_id().alias("_i"), *MEASURES)
    return [p.withColumns({"x": F.get("probs", F.lit(0)) + shift, "y": F.get("probs", F.lit(1))}) for p, shift in zip(_pair(spark, d), (F.lit(0.0), F.lit(0.5)))]


def d7(spark, d):
    return drift.alerts(*_with_measures(spark, d), ["x", "y"])


def d8(spark, d):
    a, b = _with_measures(spark, d)
    return drift.lowest_confidence(b, drift.alerts(a, b, ["x", "y"]), 50).select("vec_id", F.round("confidence", 6).alias("confidence"))


def d9(spark, d):
    state = drift.snapshot(predictions(spark, d).withColumn("x", F.when(F.col("vec_id") % 4 > 0, F.col("confidence"))), ["x"], ts="date")
    shares = F.array_join(F.transform(F.map_entries("class_shares"), lambda e: F.concat_ws(":", e.key, e.value.cast("string"))), ",")
    return state.withColumns({"class_shares": shares, "first_window": F.col("first_window").cast("string"), "last_window": F.col("last_window").cast("string")})


def d10(spark, d):
    return drift.suggestions_per_day(predictions(spark, d), F.lit("2023-12-30").cast("date"), F.lit("2024-01-08").cast("date")).withColumn("date", F.col("date").cast("string"))


def v1(spark, d):
    rows = fq.table(spark, d)
    problems = validation.contract(rows.select("k", "bucket", "app_id"), td.activity(spark, d).select("k", "app_id", "ts").schema)
    found = spark.createDataFrame(problems or [("none", "")], "problem string, subject string")
    return found.join(F.broadcast(rows.agg(F.count_if(F.col("schema_version") != "v1").alias("other_versions"))))


_OPTIONAL = ("keys_per_min", "clicks_per_min", "scroll_events_per_min")
_RANGES = {"keys_per_min": (0.1, 2), "clicks_per_min": (0, 0.2), "scroll_events_per_min": (None, 0.1)}


def _inputs(spark, d):
    return features.input_activity(td.samples(spark, d), KEYS, BUCKET).withColumns({c: F.when(F.col("k") % 5 > 0, F.col(c)) for c in _OPTIONAL})


def v2(spark, d):
    return validation.column_checks(_inputs(spark, d), _OPTIONAL, [], {})


def v3(spark, d):
    return validation.column_checks(_inputs(spark, d), [], _OPTIONAL, {}, 0.1).withColumn("value", F.round("value", 6))


def v4(spark, d):
    return validation.column_checks(_inputs(spark, d), [], [], _RANGES)


def v5(spark, d):
    return validation.bucket_ends(fq.table(spark, d), 60)


def v6(spark, d):
    return validation.monotonic(td.table(spark, d, "events").withColumn("bucket", F.date_trunc("hour", "ts")).withColumn("seq", F.col("event_id") % 1000 * 100_000 + F.col("event_id")), ["user_id"], "seq")


def v7(spark, d):
    return _flat(validation.short_session_gaps(fq._sessions(spark, d), KEYS, BUCKET))


def v8(spark, d):
    rows = td.table(spark, d, "lineitem").withColumns({"one": F.lit(1), "mostly": (F.col("l_orderkey") % 20 > 0).cast("int")})
    return validation.constant_columns(rows, ["one", "mostly", "l_tax"])


def v9(spark, d):
    bad = td.spans(spark, d).withColumns({"label": F.when(F.col("seq") % 9 == 0, "Nap").otherwise(F.col("label")), "end_ts": F.when(F.col("seq") % 4 == 0, F.col("start_ts")).otherwise(F.col("end_ts")), "confidence": F.col("confidence") * 1.5})
    return validation.invalid_spans(bad, CLASSES).select("seq", "reason")


def v10(spark, d):
    return validation.rare_classes(td.spans(spark, d), CLASSES, 0.2)


def v11(spark, d):
    rows = fq.table(spark, d)
    return validation.validate(rows, KEYS, ["app_id"], list(_OPTIONAL), 60).withColumn("value", F.round("value", 4))


def v12(spark, d):
    rows = td.activity(spark, d).withColumns({"raw_title": F.col("app_id"), "inner": F.struct(F.lit(1).alias("raw_keys"), F.lit(2).alias("fine"))})
    names = spark.createDataFrame([(c,) for c in validation.forbidden_columns(rows.schema)], "subject string")
    return names.join(F.broadcast(rows.agg(F.count("*").alias("rows_held"))))


_P = f"{SQL_PREDICTIONS}, pr AS (SELECT * REPLACE (CASE WHEN confidence < {LIMIT} THEN 'Mixed/Unknown' ELSE predicted END AS predicted) FROM prd)"
_CL = "cl AS (SELECT unnest([" + ", ".join(f"'{c}'" for c in CLASSES) + "]) AS label)"


def _pc(source: str, keys: str = "", extra: str = "") -> str:
    """Per-class scores of ``source`` as table pc, unrounded."""
    k = f"{keys}, " if keys else ""
    groups = f"(SELECT DISTINCT {keys} FROM {source}) g CROSS JOIN " if keys else ""
    labels = f"(SELECT label FROM cl{extra})"
    return f"""t_ AS (SELECT {k}label, count(*) AS support, count(*) FILTER (WHERE label = predicted) AS hits FROM {source} GROUP BY ALL), p_ AS (SELECT {k}predicted AS label, count(*) AS pred FROM {source} GROUP BY ALL),
pc AS (SELECT {k}l.label, coalesce(hits, 0) / nullif(pred, 0) AS pr0, coalesce(hits, 0) / nullif(support, 0) AS re0, 2 * coalesce(hits, 0) / nullif(coalesce(support, 0) + coalesce(pred, 0), 0) AS f0, coalesce(support, 0) AS support
  FROM {groups}{labels} l LEFT JOIN t_ USING ({k}label) LEFT JOIN p_ USING ({k}label))"""


_F1 = "round(avg(coalesce(f0, 0)), 4) AS macro_f1, round(coalesce(sum(coalesce(f0, 0) * support) / nullif(sum(support), 0), 0), 4) AS weighted_f1"
_RJ = "round(avg(CASE WHEN predicted = 'Mixed/Unknown' THEN 1 ELSE 0 END), 4) AS reject_rate"
_HALF = f"ln AS (SELECT l_shipdate < TIMESTAMP '{SPLIT}' AS ref, CASE WHEN l_shipdate < TIMESTAMP '{SPLIT}' THEN l_quantity ELSE l_quantity + 3 END AS l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem), uf AS (" + " UNION ALL ".join(f"SELECT ref, '{m}' AS feature, {m} AS v FROM ln" for m in MEASURES) + ")"
_XY = f"{_P}, uf AS (SELECT vec_id % 3 = 0 AS ref, 'x' AS feature, probs[1] + CASE WHEN vec_id % 3 = 0 THEN 0 ELSE 0.5 END AS v FROM pr UNION ALL SELECT vec_id % 3 = 0, 'y', probs[2] FROM pr)"
_PSI = f"""{_HALF}, ed AS (SELECT feature, list_sort(list_distinct(quantile_cont(v, [{", ".join(str(k / 10) for k in range(11))}]))) AS e FROM uf WHERE ref GROUP BY feature),
bn AS (SELECT feature, ref, least(len(list_filter(e, lambda x: x <= v)) - 1, len(e) - 2) AS b FROM uf JOIN ed USING (feature) WHERE v >= e[1] AND v <= e[-1]),
ct AS (SELECT feature, b, count(*) FILTER (WHERE ref) AS r, count(*) FILTER (WHERE NOT ref) AS c FROM bn GROUP BY ALL),
sh AS (SELECT feature, greatest(r / sum(r) OVER (PARTITION BY feature), 1e-8) AS r, greatest(c / sum(c) OVER (PARTITION BY feature), 1e-8) AS c FROM ct), ps AS (SELECT feature, sum((c - r) * ln(c / r)) AS psi FROM sh GROUP BY feature)"""
_KS = f"""{_HALF}, vc AS (SELECT feature, v, count(*) FILTER (WHERE ref) AS r, count(*) FILTER (WHERE NOT ref) AS c FROM uf GROUP BY ALL),
cm AS (SELECT feature, abs(sum(r) OVER w / sum(r) OVER (PARTITION BY feature) - sum(c) OVER w / sum(c) OVER (PARTITION BY feature)) AS g, sum(r) OVER (PARTITION BY feature) AS n, sum(c) OVER (PARTITION BY feature) AS m FROM vc WINDOW w AS (PARTITION BY feature ORDER BY v)),
ks0 AS (SELECT feature, max(g) AS d, any_value(n) AS n, any_value(m) AS m FROM cm GROUP BY feature), ks1 AS (SELECT *, d * d * n * m / (n + m) AS x2 FROM ks0),
ks AS (SELECT feature, d, CASE WHEN x2 < 0.04 THEN 1.0 ELSE least(greatest(list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2 * k * k * x2))), 0.0), 1.0) END AS p FROM ks1)"""
_SHARE = "SELECT predicted AS label, round(count(*) / (SELECT count(*) FROM pr WHERE vec_id % 3 {0} 0), 4) AS s FROM pr WHERE vec_id % 3 {0} 0 GROUP BY 1"
_ENT = "-list_sum(list_transform(probs, lambda p: least(greatest(p, 1e-8), 1) * ln(least(greatest(p, 1e-8), 1))))"
_INPK = f"{INP}, ik AS (SELECT k, CASE WHEN k % 5 > 0 THEN keys_per_min END AS keys_per_min, CASE WHEN k % 5 > 0 THEN clicks_per_min END AS clicks_per_min, CASE WHEN k % 5 > 0 THEN scroll_events_per_min END AS scroll_events_per_min FROM inp)"
_SWEEP = "th AS (SELECT unnest([" + ", ".join(str(round(0.10 + 0.05 * k, 2)) for k in range(18)) + "])::DOUBLE AS threshold), sw AS (SELECT threshold, label, confidence, CASE WHEN confidence < threshold THEN 'Mixed/Unknown' ELSE predicted END AS predicted FROM prd, th)"

_ACCEPTED = f"""WITH {_P}, {_CL}, {_pc('pr')}, s AS (SELECT user_id < 5 AS seen, label, predicted FROM pr), {_pc('s', 'seen').replace('t_', 't2').replace('p_', 'p2').replace('pc AS', 'pc2 AS')},
        mt AS (SELECT 'macro_f1' AS metric, '' AS label, (SELECT round(avg(coalesce(f0, 0)), 4) FROM pc) AS value UNION ALL SELECT 'weighted_f1', '', (SELECT round(sum(coalesce(f0, 0) * support) / sum(support), 4) FROM pc)
          UNION ALL SELECT 'precision', label, round(coalesce(pr0, 0), 4) FROM pc UNION ALL SELECT 'recall', label, round(coalesce(re0, 0), 4) FROM pc UNION ALL SELECT 'min_precision', '', (SELECT min(round(coalesce(pr0, 0), 4)) FROM pc)
          UNION ALL SELECT 'reject_rate', '', (SELECT round(avg((predicted = 'Mixed/Unknown')::INTEGER), 4) FROM pr) UNION ALL SELECT CASE WHEN seen THEN 'seen_macro_f1' ELSE 'unseen_macro_f1' END, '', round(avg(coalesce(f0, 0)), 4) FROM pc2 GROUP BY seen),
        gt(metric, label, comparison, bound) AS (VALUES {", ".join(f"('{a}', '{b}', '{c}', {x}::DOUBLE)" for a, b, c, x in metrics.GATES)})
        SELECT gt.*, value, coalesce(CASE WHEN comparison = '>=' THEN value >= bound ELSE value <= bound END, false) AS passed FROM gt LEFT JOIN mt USING (metric, label)"""

QUERIES = {
    "M1_confusion": m1, "M2_per_class": m2, "M3_f1_scores": m3, "M4_class_distribution": m4, "M5_reject_rate": m5, "M6_compare": m6, "M7_per_user": m7, "M8_slices": m8, "M9_calibration_curve": m9,
    "M10_calibration_error": m10, "M11_brier": m11, "M12_log_loss": m12, "M13_top_confusions": m13, "M14_unknown_rates": m14, "M15_user_strata": m15, "M16_reject_by_group": m16, "M17_acceptance": m17,
    "M18_evaluation_modes": m18, "M19_threshold_sweep": m19, "M20_regression_gates": m20,
    "D1_psi": d1, "D1_sketched_psi": d1_sketches, "D9_daily_sketches": d9_sketches, "D2_ks": d2, "D3_feature_drift": d3, "D4_reject_increase": d4, "D5_entropy_spike": d5, "D6_class_shift": d6, "D7_alerts": d7, "D8_lowest_confidence": d8, "D9_snapshot": d9, "D10_suggestions": d10,
    "V1_contract": v1, "V2_required": v2, "V3_missing": v3, "V4_ranges": v4, "V5_bucket_ends": v5, "V6_monotonic": v6, "V7_session_gaps": v7, "V8_constant_columns": v8, "V9_invalid_spans": v9,
    "V10_rare_classes": v10, "V11_validate": v11, "V12_forbidden_columns": v12,
}
ORACLE_SQL = {
    "M1_confusion": f"WITH {_P}, {_CL} SELECT a.label, b.label AS predicted, (SELECT count(*) FROM pr WHERE pr.label = a.label AND pr.predicted = b.label) AS n FROM cl a CROSS JOIN cl b",
    "M2_per_class": f"WITH {_P}, {_CL}, {_pc('pr')} SELECT label, round(coalesce(pr0, 0), 4) AS precision, round(coalesce(re0, 0), 4) AS recall, round(coalesce(f0, 0), 4) AS f1, support FROM pc",
    "M3_f1_scores": f"WITH {_P}, {_CL}, {_pc('pr')} SELECT {_F1} FROM pc",
    "M4_class_distribution": f"WITH {_P}, {_CL} SELECT label, count(vec_id) AS n, round(count(vec_id) / (SELECT count(*) FROM pr), 4) AS fraction FROM cl LEFT JOIN pr USING (label) GROUP BY label",
    "M5_reject_rate": f"WITH {_P} SELECT {_RJ} FROM pr",
    "M6_compare": f"""WITH {_P}, {_CL}, ml AS (SELECT 'plain' AS method, label, predicted FROM prd UNION ALL SELECT 'rejecting', label, predicted FROM pr), {_pc('ml', 'method', " UNION ALL SELECT 'Mixed/Unknown'")},
        f AS (SELECT method, {_F1} FROM pc GROUP BY method), r AS (SELECT method, {_RJ} FROM ml GROUP BY method) SELECT *, round(macro_f1 - (SELECT macro_f1 FROM f WHERE method = 'plain'), 4) AS gain FROM f JOIN r USING (method)""",
    "M7_per_user": f"WITH {_P}, {_CL}, {_pc('pr', 'user_id')}, f AS (SELECT user_id, {_F1} FROM pc GROUP BY user_id) SELECT f.*, (SELECT count(*) FROM pr WHERE pr.user_id = f.user_id) AS n FROM f",
    "M8_slices": f"""WITH {_P}, {_CL}, sl AS (SELECT 'user_id' AS "column", user_id::VARCHAR AS value, label, predicted FROM pr UNION ALL SELECT 'parity', (vec_id % 2)::VARCHAR, label, predicted FROM pr), {_pc('sl', '"column", value')},
        f AS (SELECT "column", value, {_F1} FROM pc GROUP BY ALL), r AS (SELECT "column", value, count(*) AS n, {_RJ} FROM sl GROUP BY ALL) SELECT * FROM r JOIN f USING ("column", value)""",
    "M9_calibration_curve": f"WITH {_P}, u AS (SELECT label, {td._CLASS_LIST}[generate_subscripts(probs, 1)] AS class, unnest(probs) AS p FROM pr) SELECT class, greatest(ceil(p * 10) - 1, 0)::INTEGER AS bin, count(*) AS n, round(avg((class = label)::INTEGER), 6) AS accuracy, round(avg(p), 6) AS confidence FROM u WHERE class IN (SELECT label FROM pr) GROUP BY 1, 2",
    "M10_calibration_error": f"WITH {_P}, u AS (SELECT label, {td._CLASS_LIST}[generate_subscripts(probs, 1)] AS class, unnest(probs) AS p FROM pr), c AS (SELECT class, least(floor(p * 10), 9) AS b, count(*) AS n, sum((class = label)::INTEGER) AS y, sum(p) AS p FROM u GROUP BY 1, 2) SELECT class, round(sum(abs(y - p)) / sum(n), 6) AS ece, sum(y)::BIGINT AS support FROM c GROUP BY class",
    "M11_brier": f"WITH {_P}, u AS (SELECT vec_id, ({td._CLASS_LIST}[generate_subscripts(probs, 1)] = label)::INTEGER AS y, unnest(probs) AS p FROM pr), s AS (SELECT vec_id, sum((p - y) * (p - y)) AS b FROM u GROUP BY vec_id) SELECT round(avg(b), 6) AS brier FROM s",
    "M12_log_loss": f"WITH {_P} SELECT round(avg(-ln(least(greatest(probs[list_position({td._CLASS_LIST}, label)], 1e-15), 1 - 1e-15))), 6) AS log_loss FROM pr",
    "M13_top_confusions": f"WITH {_P}, {_CL} SELECT label, predicted, count(*) AS n FROM pr WHERE label <> predicted AND predicted IN (SELECT label FROM cl) GROUP BY ALL ORDER BY n DESC, label, predicted LIMIT 5",
    "M14_unknown_rates": "WITH " + ", ".join(f"k_{c} AS (SELECT DISTINCT {c} AS v FROM part WHERE p_partkey % 97 = 0 AND {c} NOT IN ('Brand#3', 'SMALL'))" for c in ("p_brand", "p_type")) + " " + " UNION ALL ".join(f"""SELECT '{c}' AS "column", round(avg(CASE WHEN {c} IN (SELECT v FROM k_{c}) THEN 0 ELSE 1 END), 6) AS unknown_rate FROM part""" for c in ("p_brand", "p_type")),
    "M15_user_strata": f"WITH {_P} SELECT user_id, count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE label = '{c}') AS n_{c}" for c in CLASSES) + ", round(count(*) / (SELECT count(*) FROM pr), 4) AS share, count(*) / (SELECT count(*) FROM pr) > 0.5 AS dominant FROM pr GROUP BY user_id",
    "M16_reject_by_group": f"WITH {_P}, g AS (SELECT user_id, date, avg((predicted = 'Mixed/Unknown')::INTEGER) AS r FROM pr GROUP BY ALL) SELECT user_id, CAST(date AS VARCHAR) AS date, round(r, 4) AS reject_rate, r > 2 * (SELECT avg((predicted = 'Mixed/Unknown')::INTEGER) FROM pr) AS flagged FROM g",
    "M17_acceptance": _ACCEPTED,
    "M18_evaluation_modes": f"""WITH {SQL_PREDICTIONS}, {_CL}, ca AS (SELECT vec_id, user_id, label, predicted, confidence, 1 / list_sum(list_transform(probs, lambda p: exp((ln(greatest(p, 1e-12)) - ln(greatest(confidence, 1e-12))) / 1.4))) AS c FROM prd),
        rj AS (SELECT user_id, vec_id, label, CASE WHEN c < {LIMIT} THEN 'Mixed/Unknown' ELSE predicted END AS own, row_number() OVER (PARTITION BY user_id ORDER BY vec_id) AS i FROM ca),
        vt AS (SELECT a.user_id, a.vec_id, a.label AS truth, a.own, n.own AS vote, count(*) AS c, min(n.i) AS f FROM rj a JOIN rj n ON n.user_id = a.user_id AND n.i BETWEEN a.i - 2 AND a.i + 2 GROUP BY ALL),
        sm AS (SELECT user_id, vec_id, truth AS label, vote AS predicted FROM vt QUALIFY row_number() OVER (PARTITION BY user_id, vec_id ORDER BY c DESC, vote = own DESC, f) = 1),
        md AS (SELECT 'raw' AS mode, user_id < 5 AS seen, label, CASE WHEN confidence < {LIMIT} THEN 'Mixed/Unknown' ELSE predicted END AS predicted FROM ca UNION ALL SELECT 'calibrated', user_id < 5, label, predicted FROM ca
          UNION ALL SELECT 'calibrated_reject', user_id < 5, label, own FROM rj UNION ALL SELECT m, user_id < 5, label, predicted FROM sm, (SELECT unnest(['smoothed', 'interval']) AS m)),
        sp AS (SELECT user_id, vec_id, predicted AS label FROM sm QUALIFY coalesce(lag(predicted) OVER (PARTITION BY user_id ORDER BY vec_id) <> predicted, true)), sg AS (SELECT user_id, vec_id, label FROM sm QUALIFY coalesce(lag(label) OVER (PARTITION BY user_id ORDER BY vec_id) <> label, true)),
        ia AS (SELECT round(avg((sg.label IS NOT NULL AND sg.label = sp.label)::INTEGER), 4) AS v FROM sp LEFT JOIN sg USING (user_id, vec_id)),
        {_pc('md', 'mode')}, {_pc('md', 'mode, seen').replace('t_', 't2').replace('p_', 'p2').replace('pc AS', 'pc2 AS')},
        f AS (SELECT mode, {_F1} FROM pc GROUP BY mode), r AS (SELECT mode, {_RJ} FROM md GROUP BY mode), e AS (SELECT mode, seen, round(avg(coalesce(f0, 0)), 4) AS m FROM pc2 GROUP BY mode, seen)
        SELECT mode, CASE WHEN mode = 'interval' THEN (SELECT v FROM ia) ELSE macro_f1 END AS macro_f1, CASE WHEN mode = 'interval' THEN (SELECT v FROM ia) ELSE weighted_f1 END AS weighted_f1, reject_rate,
        (SELECT m FROM e WHERE e.mode = f.mode AND seen) AS seen_macro_f1, (SELECT m FROM e WHERE e.mode = f.mode AND NOT seen) AS unseen_macro_f1 FROM f JOIN r USING (mode)""",
    "M19_threshold_sweep": f"WITH {SQL_PREDICTIONS}, {_CL}, {_SWEEP}, {_pc('sw', 'threshold')}, f AS (SELECT threshold, round(avg(coalesce(f0, 0)), 4) AS macro_f1 FROM pc GROUP BY threshold), c AS (SELECT threshold, round(coalesce(count(*) FILTER (WHERE predicted <> 'Mixed/Unknown' AND label = predicted) / nullif(count(*) FILTER (WHERE predicted <> 'Mixed/Unknown'), 0), 0), 4) AS accuracy, round(count(*) FILTER (WHERE predicted = 'Mixed/Unknown') / count(*), 4) AS reject_rate, round(count(*) FILTER (WHERE predicted <> 'Mixed/Unknown') / count(*), 4) AS coverage FROM sw GROUP BY threshold) SELECT * FROM c JOIN f USING (threshold)",
    "D1_psi": f"WITH {_PSI} SELECT feature, round(psi, 6) AS psi FROM ps",
    "D1_sketched_psi": f"WITH {_PSI} SELECT feature, psi > 0.2 AS drifted, round(psi, 6) AS exact FROM ps",
    "D9_daily_sketches": " UNION ALL ".join(f"SELECT '{m}' AS feature, count({m}) AS n, 0 AS misses FROM lineitem" for m in MEASURES),
    "D2_ks": f"WITH {_KS} SELECT feature, round(d, 6) AS statistic, round(p, 6) AS p_value FROM ks",
    "D3_feature_drift": f"WITH {_PSI}, {_KS.replace(_HALF + ',', '')} SELECT feature, psi > 0.2 OR p < 0.05 AS drifted FROM ps JOIN ks USING (feature)",
    "D4_reject_increase": f"WITH {_P}, r AS (SELECT avg((predicted = 'Mixed/Unknown')::INTEGER) FILTER (WHERE vec_id % 3 = 0) AS a, avg((predicted = 'Mixed/Unknown')::INTEGER) FILTER (WHERE vec_id % 3 <> 0) AS b FROM pr) SELECT round(a, 4) AS reference, round(b, 4) AS current, b - a >= 0.1 AS flagged FROM r",
    "D5_entropy_spike": f"WITH {_P}, r AS (SELECT avg({_ENT}) FILTER (WHERE vec_id % 3 = 0) AS a, avg({_ENT}) FILTER (WHERE vec_id % 3 <> 0) AS b FROM pr) SELECT round(a, 4) AS reference, round(b, 4) AS current, a > 1e-8 AND b > 2 * a AS flagged FROM r",
    "D6_class_shift": f"WITH {_P}, a AS ({_SHARE.format('=')}), b AS ({_SHARE.format('<>')}) SELECT coalesce(a.label, b.label) AS label, coalesce(a.s, 0) AS reference, coalesce(b.s, 0) AS current, abs(coalesce(b.s, 0) - coalesce(a.s, 0)) > 0.15 AS flagged FROM a FULL JOIN b USING (label)",
    "M20_regression_gates": f"""WITH ac AS ({_ACCEPTED}), {_P}, {_CL}, {_pc('pr')}, {_pc('prd').replace('t_', 't2').replace('p_', 'p2').replace('pc AS', 'pc2 AS')}, c AS (SELECT round(avg(coalesce(f0, 0)), 4) AS v FROM pc2), h AS (SELECT round(avg(coalesce(f0, 0)), 4) AS v FROM pc)
        SELECT 'macro_f1_no_regression' AS gate, round(c.v - h.v, 4) AS value, round(c.v - h.v, 4) <= 0.02 AS passed FROM c, h UNION ALL SELECT 'no_class_below_50_precision', v, v >= 0.5 FROM (SELECT min(round(coalesce(pr0, 0), 4)) AS v FROM pc)
        UNION ALL SELECT 'breakidle_precision', v, v >= 0.95 FROM (SELECT round(coalesce(pr0, 0), 4) AS v FROM pc WHERE label = 'BreakIdle') UNION ALL SELECT 'challenger_acceptance', count(*) FILTER (WHERE NOT passed)::DOUBLE, count(*) FILTER (WHERE NOT passed) = 0 FROM ac""",
    "D7_alerts": f"""WITH {_PSI.replace(_HALF, _XY)}, {_KS.replace(_HALF + ',', '')}, ra AS (SELECT avg((predicted = 'Mixed/Unknown')::INTEGER) FILTER (WHERE vec_id % 3 = 0) AS a, avg((predicted = 'Mixed/Unknown')::INTEGER) FILTER (WHERE vec_id % 3 <> 0) AS b,
        avg({_ENT}) FILTER (WHERE vec_id % 3 = 0) AS ea, avg({_ENT}) FILTER (WHERE vec_id % 3 <> 0) AS eb FROM pr), sa AS ({_SHARE.format('=')}), sb AS ({_SHARE.format('<>')})
        SELECT CASE WHEN psi > 0.2 THEN 'feature_psi' ELSE 'feature_ks' END AS trigger, feature AS subject, round(psi, 4) AS value, CASE WHEN psi > 0.4 THEN 'critical' ELSE 'warning' END AS severity FROM ps JOIN ks USING (feature) WHERE psi > 0.2 OR p < 0.05
        UNION ALL SELECT 'reject_rate', '', round(b, 4), 'critical' FROM ra WHERE b - a >= 0.1 UNION ALL SELECT 'entropy', '', round(eb, 4), 'warning' FROM ra WHERE ea > 1e-8 AND eb > 2 * ea
        UNION ALL SELECT 'class_shift', coalesce(sa.label, sb.label), coalesce(sb.s, 0), 'warning' FROM sa FULL JOIN sb USING (label) WHERE abs(coalesce(sb.s, 0) - coalesce(sa.s, 0)) > 0.15""",
    "D8_lowest_confidence": f"WITH {_P} SELECT vec_id, round(confidence, 6) AS confidence FROM pr WHERE vec_id % 3 <> 0 ORDER BY pr.confidence, vec_id LIMIT 50",
    "D9_snapshot": f"WITH {_P} SELECT count(*) AS rows, round(avg((vec_id % 4 = 0)::INTEGER), 4) AS missing_x, round(avg(confidence), 6) AS confidence_mean, round(quantile_cont(confidence, 0.5), 6) AS confidence_median, round(quantile_cont(confidence, 0.05), 6) AS confidence_p5, round(quantile_cont(confidence, 0.95), 6) AS confidence_p95, round(stddev_pop(confidence), 6) AS confidence_std, round(avg((predicted = 'Mixed/Unknown')::INTEGER), 6) AS reject_rate, round(avg({_ENT}), 6) AS mean_entropy, (SELECT string_agg(label || ':' || s, ',' ORDER BY label) FROM (SELECT predicted AS label, {sql_quotient('count(*)', '(SELECT count(*) FROM pr)', 4)} AS s FROM pr GROUP BY 1)) AS class_shares, CAST(min(date) AS VARCHAR) AS first_window, CAST(max(date) AS VARCHAR) AS last_window FROM pr",
    "D10_suggestions": f"WITH {_P}, days AS (SELECT CAST(unnest(generate_series(DATE '2023-12-30', DATE '2024-01-08', INTERVAL 1 DAY)) AS DATE) AS date), c AS (SELECT date, count(*) AS n FROM pr WHERE predicted <> 'Mixed/Unknown' GROUP BY date) SELECT CAST(date AS VARCHAR) AS date, coalesce(n, 0) AS suggestions, coalesce(n, 0) = 0 AS none FROM days LEFT JOIN c USING (date)",
    "V1_contract": f"WITH {SESS} SELECT p.problem, p.subject, 0::BIGINT AS other_versions FROM (VALUES ('missing', 'ts'), ('extra', 'bucket')) AS p(problem, subject)",
    "V2_required": f"WITH {_INPK} " + " UNION ALL ".join(f"SELECT 'null' AS \"check\", '{c}' AS subject, count(*)::DOUBLE AS value FROM ik WHERE {c} IS NULL" for c in _OPTIONAL),
    "V3_missing": f"WITH {_INPK} " + " UNION ALL ".join(f"SELECT 'missing' AS \"check\", '{c}' AS subject, round(avg(({c} IS NULL)::INTEGER), 6) AS value FROM ik" for c in _OPTIONAL),
    "V4_ranges": f"WITH {_INPK} SELECT * FROM (" + " UNION ALL ".join(f"SELECT 'range' AS \"check\", '{c}' AS subject, count(*)::DOUBLE AS value FROM ik WHERE {c} < {low if low is not None else '-1e300'} OR {c} > {high}" for c, (low, high) in _RANGES.items()) + ") WHERE value > 0",
    "V5_bucket_ends": f"WITH {SESS} SELECT count(*) AS wrong_ends FROM dom",
    "V6_monotonic": "WITH e AS (SELECT user_id, date_trunc('hour', ts) AS b, event_id % 1000 * 100000 + event_id AS s FROM events), c AS (SELECT user_id, b < lag(b) OVER (PARTITION BY user_id ORDER BY s) AS c FROM e) SELECT user_id, count(*) FILTER (WHERE c) AS backward FROM c GROUP BY user_id",
    "V7_session_gaps": f"WITH {SESS}, c AS (SELECT k, b, b - lag(b) OVER w AS gap, s <> lag(s) OVER w AS n FROM sess WINDOW w AS (PARTITION BY k ORDER BY b)) SELECT k, min(b) AS bucket, arg_min(gap, b) AS gap FROM c WHERE n AND gap <= {BUCKET} GROUP BY k",
    "V8_constant_columns": "SELECT 'one' AS \"column\", 'constant' AS finding, 1.0::DOUBLE AS top_share UNION ALL SELECT 'mostly', 'dominant', round(s, 4) FROM (SELECT avg((l_orderkey % 20 > 0)::INTEGER) AS s FROM lineitem) WHERE s > 0.9",
    "V9_invalid_spans": f"WITH {SQL_SPANS} SELECT * FROM (SELECT seq, CASE WHEN seq % 9 = 0 THEN 'label' WHEN seq % 4 = 0 AND NOT extend_forward THEN 'end' WHEN confidence * 1.5 > 1 THEN 'confidence' END AS reason FROM spn) WHERE reason IS NOT NULL",
    "V10_rare_classes": f"WITH {SQL_SPANS}, {_CL} SELECT label, count(seq) AS n, round(count(seq) / (SELECT count(*) FROM spn), 4) AS fraction FROM cl LEFT JOIN spn USING (label) GROUP BY label HAVING round(count(seq) / (SELECT count(*) FROM spn), 4) < 0.2",
    "V12_forbidden_columns": "SELECT s.subject, (SELECT count(*) FROM events) AS rows_held FROM (VALUES ('raw_title'), ('inner.raw_keys')) AS s(subject)",
}
