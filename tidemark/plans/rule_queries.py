"""Queries over scalar functions and rules (S3, S5, H*, X*, P*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars, tables
from tidemark.operators import features, rules
from tidemark.plans.feature_queries import DOM, INP, _EV, _flat
from tidemark.sources import testdata as td
from tidemark.sources.testdata import BUCKET, CLASSES, KEYS, SQL_PREDICTIONS, SQL_SPANS

SECRET = b"a secret of the deployment"
SALT = "salt:"
TAXONOMY = {"Deep work": ("Build", "Debug", "Write", "Review"), "Talk": ("Communicate", "Meet"), "Checks": ("Review", "ReadResearch")}
WEIGHTS = {"Meet": 2.0, "Write": 0.5}


def _sql_text(values: dict[str, str], column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in values.items()) + " END"


def s3(spark: SparkSession, d: str) -> DataFrame:
    text = td.table(spark, d, "events").select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 2 == 0, "Z").otherwise("+02:00")).alias("t"))
    return text.select("event_id", F.unix_seconds(scalars.parse_instant(F.col("t"))).alias("t"))


def s5(spark: SparkSession, d: str) -> DataFrame:
    names = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, " Firefox ").when(F.col("p_partkey") % 3 == 1, "nvim").otherwise(F.col("p_name")).alias("app"))
    return rules.normalize_app(names).drop("app")


def h1(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", scalars.stable_hash(F.coalesce("text", F.lit(""))).alias("h"))


def h2(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", scalars.salted_hash(F.coalesce("text", F.lit("")), SALT).alias("h"))


def h3(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", scalars.keyed_digest(F.col("c_name"), SECRET, "name").alias("h"))


def h4(spark: SparkSession, d: str) -> DataFrame:
    both = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, scalars.stable_hash(F.col("c_name"))).otherwise(F.col("c_name")).alias("v"))
    return both.select("c_custkey", scalars.hash_bucket(F.col("v")).alias("bucket"))


def _titles(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("title"))


def x1(spark: SparkSession, d: str) -> DataFrame:
    made = scalars.title_sketch(_titles(spark, d), "title", SECRET)
    mass = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda t, x: t + x), 3)
    return made.select("conv_id", "turn", mass("title_token_sketch").alias("token_mass"), mass("title_char3_sketch").alias("char_mass"), "title_char_count", "title_token_count", "title_unique_token_ratio", "title_digit_ratio", "title_separator_count")


def x2(spark: SparkSession, d: str) -> DataFrame:
    return _titles(spark, d).select("conv_id", "turn", scalars.normalize_title(F.col("title")).alias("title"))


def x3(spark: SparkSession, d: str) -> DataFrame:
    return _titles(spark, d).select("conv_id", "turn", F.array_join(scalars.title_tokens(F.col("title")), " ").alias("tokens"))


def x4(spark: SparkSession, d: str) -> DataFrame:
    return _titles(spark, d).select("conv_id", "turn", F.size(scalars.char_ngrams(F.col("title"))).alias("n"), F.get(scalars.char_ngrams(F.col("title")), F.lit(1)).alias("second"))


def x5(spark: SparkSession, d: str) -> DataFrame:
    hashed = _titles(spark, d).withColumn("buckets", scalars.keyed_buckets(scalars.title_tokens(F.col("title")), SECRET, "title-token", 16))
    return scalars.with_bucket_frequencies(hashed.select("conv_id", "turn", "buckets"), {"shares": "buckets"}, 16)


def x6(spark: SparkSession, d: str) -> DataFrame:
    return _titles(spark, d).select("conv_id", "turn", *[c.alias(n) for n, c in scalars.title_scalars(F.col("title")).items() if n not in ("title_token_count", "title_unique_token_ratio")])


def x7(spark: SparkSession, d: str) -> DataFrame:
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.when(F.col("page_id") % 5 == 0, "https://mail.GitHub.com/x").otherwise(F.col("url")).alias("url"))
    host = F.regexp_extract(F.coalesce("url", F.lit("")), "^[^:]*://([^/?#]*)", 1)
    return pages.select("page_id", rules.domain_category(host, F.col("page_id") % 7 != 0).alias("category"))


def x8(spark: SparkSession, d: str) -> DataFrame:
    return td.table(spark, d, "events").select("event_id", F.unix_seconds(scalars.align(F.col("ts"), 180)).alias("aligned"))


def x9(spark: SparkSession, d: str) -> DataFrame:
    made = scalars.bucket_range(td.spans(spark, d), "start_ts", "end_ts", BUCKET)
    return made.groupBy("seq").agg(F.count("*").alias("n"), F.unix_seconds(F.min("bucket")).alias("first"), F.unix_seconds(F.max("bucket")).alias("last"))


def x10(spark: SparkSession, d: str) -> DataFrame:
    return td.table(spark, d, "events").select("event_id", *[c.alias(n) for n, c in scalars.calendar(F.col("ts")).items()])


def x11(spark: SparkSession, d: str) -> DataFrame:
    log = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.concat(F.lit("user said window_title = "), F.col("c_name"), F.lit(" and FULL_URL: \"a b\" then ok")).alias("m"))
    return log.select("c_custkey", scalars.redact(F.col("m")).alias("message"))


def x12(spark: SparkSession, d: str) -> DataFrame:
    return td.predictions(spark, d).select("vec_id", F.round(scalars.entropy(F.col("probs")), 5).alias("entropy"))


def p1(spark: SparkSession, d: str) -> DataFrame:
    return rules.in_range(td.activity(spark, d), "ts", F.timestamp_seconds(F.lit(1704412800)), F.timestamp_seconds(F.lit(1705276800))).select("seq", "app_id")


def p2(spark: SparkSession, d: str) -> DataFrame:
    return rules.spans_in_days(td.spans(spark, d), F.lit("2024-01-05").cast("date"), F.lit("2024-01-07").cast("date")).select("seq", "label")


def p3(spark: SparkSession, d: str) -> DataFrame:
    return rules.latest_spans(td.spans(spark, d), F.timestamp_seconds(F.lit(1704412800)), F.timestamp_seconds(F.lit(1705276800)), 50).select("seq", "label", F.unix_seconds("end_ts").alias("end_ts"))


def _rows(spark: SparkSession, d: str) -> DataFrame:
    acts = td.activity(spark, d)
    dom = features.dominant_apps(acts, KEYS, BUCKET, ["app_category", "is_browser", "is_editor", "is_terminal"])
    return dom.join(features.input_activity(td.samples(spark, d), KEYS, BUCKET), ["k", "bucket"], "left")


def p4(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d).withColumns({"shortcut_rate": F.col("clicks_per_min") * 60, "keys_per_min": F.col("keys_per_min") * 10, "scroll_events_per_min": F.col("scroll_events_per_min") * 60})
    return _flat(rows.select("k", "bucket", rules.baseline_label().alias("label")))


def p5(spark: SparkSession, d: str) -> DataFrame:
    label, rule = rules.weak_label()
    rows = _rows(spark, d).withColumn("domain_category", F.when(F.col("is_browser"), "news"))
    return _flat(rows.select("k", "bucket", label.alias("label"), rule.alias("rule")))


def _windows(spark: SparkSession, d: str) -> DataFrame:
    slices = features.evidence(td.activity(spark, d), td.samples(spark, d), KEYS, BUCKET // 2)
    return rules.evidence_windows(slices, KEYS, 3 * BUCKET)


_GROUPS = {"communication": ("chat",), "editors": ("editor", "terminal"), "browsers": ("browser",)}


def p6(spark: SparkSession, d: str) -> DataFrame:
    decided = _windows(spark, d).withColumn("m", rules.mode_decision(**_GROUPS))
    return _flat(decided.select("k", "window", "m.mode", "m.confidence", F.array_join("m.alternatives", ",").alias("alternatives"), F.array_join("m.reasons", ",").alias("reasons")))


def p7(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_windows(spark, d).select("k", "window", *[c.alias(n) for n, c in rules.observed_facts(**_GROUPS).items()]))


def p8(spark: SparkSession, d: str) -> DataFrame:
    asked = td.spans(spark, d).withColumn("mode", F.element_at(F.array(*map(F.lit, tables.MODE_SUBTYPES)), (F.col("seq") % 5 + 1).cast("int")))
    return asked.select("seq", "mode", rules.allowed_subtype(F.col("mode"), F.col("label")).alias("subtype"))


def p9(spark: SparkSession, d: str) -> DataFrame:
    decided = _windows(spark, d).withColumn("m", rules.mode_decision(**_GROUPS)).withColumns(rules.observed_facts(**_GROUPS))
    state = rules.support_state(F.col("m.confidence"))
    return _flat(decided.select("k", "window", state.alias("support_state"), rules.intent_basis(state, F.col("activity_surface")).alias("intent_basis")))


def p10(spark: SparkSession, d: str) -> DataFrame:
    made = rules.migrate_labels(td.spans(spark, d))
    s = "semantic."
    return made.select("seq", "inference_window_ms", F.col(s + "mode.value").alias("mode"), F.col(s + "subtype.value").alias("subtype"), F.round(s + "mode.confidence", 6).alias("confidence"), s + "support_state", s + "intent_basis", s + "mode_source")


def p11(spark: SparkSession, d: str) -> DataFrame:
    preds = td.predictions(spark, d)
    thresholds = preds.select("user_id").distinct().where("user_id < 3").withColumn("threshold", 0.4 + F.col("user_id") / 10)
    with_thresholds = rules.with_user_thresholds(preds, thresholds, 0.55)
    return with_thresholds.select("vec_id", rules.reject(F.col("predicted"), F.col("confidence"), F.col("threshold")).alias("label"))


def p12(spark: SparkSession, d: str) -> DataFrame:
    return td.predictions(spark, d).select("vec_id", rules.argmax_label(F.col("probs"), CLASSES).alias("label"))


def p13(spark: SparkSession, d: str) -> DataFrame:
    preds = td.predictions(spark, d).withColumn("rejected", F.col("confidence") < 0.2)
    mapped = rules.map_taxonomy(preds, TAXONOMY, CLASSES, rejected="rejected", weights=WEIGHTS)
    return mapped.select("vec_id", "mapped_label", *[F.try_element_at("mapped_probs", F.lit(b)).alias(b.lower().replace(" ", "_")) for b in [*TAXONOMY, "Other"]])


def p14(spark: SparkSession, d: str) -> DataFrame:
    rules.check_taxonomy(TAXONOMY, CLASSES, WEIGHTS)
    mapped = rules.map_taxonomy(td.predictions(spark, d), {c: (c,) for c in CLASSES}, CLASSES)
    return mapped.select("vec_id", "mapped_label")


def p15(spark: SparkSession, d: str) -> DataFrame:
    return td.predictions(spark, d).select("vec_id", F.round(F.array_max(rules.apply_temperature(F.col("probs"), F.lit(1.7))), 5).alias("confidence"))


_CURVES = {k: ((0.0, 0.1, 0.4, 1.0), (0.0, 0.05, 0.5, 0.9)) for k in range(8)}


def p16(spark: SparkSession, d: str) -> DataFrame:
    return rules.apply_isotonic(td.predictions(spark, d), _CURVES).select("vec_id", F.round(F.array_max("probs"), 5).alias("confidence"))


def p17(spark: SparkSession, d: str) -> DataFrame:
    preds = td.predictions(spark, d)
    calibrators = preds.select("user_id").distinct().where("user_id % 2 = 0").withColumn("temperature", 0.5 + F.col("user_id") / 4)
    return rules.apply_user_temperature(preds, calibrators, 1.3).select("vec_id", F.round(F.array_max("probs"), 5).alias("confidence"))


_TOKENS = "list_filter(regexp_split_to_array(regexp_replace(lower(title), '[0-9]+', '<num>', 'g'), '[^0-9A-Za-z]+'), lambda t: length(t) > 1)[1:32]"
_GRAM = "regexp_replace(lower(title), '[0-9]+', '0', 'g')[1:256]"
_CONV = "c AS (SELECT conv_id, turn, coalesce(text, '') AS title FROM conversations)"
_ROWS = f"{DOM}, {INP}, rows AS (SELECT dom.k, dom.b AS bucket, app, inp.* EXCLUDE (k, bucket), idle FROM dom LEFT JOIN inp ON inp.k = dom.k AND inp.bucket = dom.b LEFT JOIN idle ON idle.k = dom.k AND idle.b = dom.b)"
_WIN = f"""{_EV}, win AS (SELECT k, (h // {3 * BUCKET}) * {3 * BUCKET} AS w, sum(foreground_duration_ms) AS ms, sum(key_events) AS keys, sum(scroll_events) AS scroll, bool_or(meeting_signal) AS live,
  bool_and(key_events + pointer_events + scroll_events = 0) AS idle, bool_or(contains(app_ids, 'chat')) AS comm, bool_or(contains(app_ids, 'editor') OR contains(app_ids, 'terminal')) AS ed, bool_or(contains(app_ids, 'browser')) AS br FROM ev GROUP BY ALL)"""
_MODE = "CASE WHEN idle AND ms > 0 THEN {0} WHEN live THEN {1} WHEN comm THEN {2} WHEN ed AND keys > 10 THEN {3} WHEN br AND scroll > 0 AND keys < 10 THEN {4} ELSE {5} END"
_CONFIDENCE = _MODE.format(0.9, 0.85, 0.8, 0.85, 0.8, 0.3)
_SURFACE = "CASE WHEN live THEN 'Call' WHEN comm THEN 'Message' WHEN ed AND keys > 0 THEN 'Edit' WHEN br OR scroll > 0 THEN 'Read' WHEN idle THEN 'IdleLike' ELSE 'Read' END"
_TEMPER = "(SELECT max(e) / sum(e) FROM (SELECT exp(ln(greatest(unnest(probs), 1e-12)) / {t}) AS e))"
_CURVE = "CASE WHEN p <= 0 THEN 0.0 WHEN p < 0.1 THEN p * 0.5 WHEN p < 0.4 THEN 0.05 + (p - 0.1) * 1.5 WHEN p < 1 THEN 0.5 + (p - 0.4) * (0.4 / 0.6) ELSE 0.9 END"
_W = [WEIGHTS.get(c, 1.0) for c in CLASSES]
_AT = {c: k for k, c in enumerate(CLASSES)}
_BUCKETS = {**TAXONOMY, "Other": ("BreakIdle",)}
_ALLOWED = " OR ".join(f"(mode = '{m}' AND label IN ({', '.join(repr(x) for x in s)}))" for m, s in tables.MODE_SUBTYPES.items())
_MODES = "[" + ", ".join(f"'{m}'" for m in tables.MODE_SUBTYPES) + "]"
_WEAK = " ".join(f"WHEN {'app' if f == 'app_category' else 'NULL' if f == 'app_id' else 'dom'} = '{v}' THEN {{{i}}}" for i, (f, v, _) in enumerate(rules.DEFAULT_WEAK_RULES))
_DOMAIN_VALUES = ", ".join(f"('{d}', '{kind}')" for kind, ds in tables.DOMAINS.items() for d in ds)

QUERIES = {
    "S3_parse_instants": s3, "S5_normalize_apps": s5, "H1_stable_hash": h1, "H2_salted_hash": h2, "H3_keyed_digest": h3, "H4_hash_bucket": h4,
    "X1_title_sketch": x1, "X2_normalize_title": x2, "X3_title_tokens": x3, "X4_char_ngrams": x4, "X5_bucket_frequencies": x5, "X6_title_scalars": x6, "X7_domain_category": x7,
    "X8_align": x8, "X9_bucket_range": x9, "X10_calendar": x10, "X11_redact": x11, "X12_entropy": x12,
    "P1_time_range": p1, "P2_spans_in_days": p2, "P3_latest_spans": p3, "P4_baseline_rules": p4, "P5_weak_rules": p5, "P6_mode_decision": p6, "P7_observed_facts": p7, "P8_allowed_subtype": p8,
    "P9_semantic_label": p9, "P10_migrate_labels": p10, "P11_reject": p11, "P12_argmax_label": p12, "P13_taxonomy": p13, "P14_identity_taxonomy": p14, "P15_temperature": p15, "P16_isotonic": p16, "P17_user_temperature": p17,
}
ORACLE_SQL = {
    "S3_parse_instants": "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) - CASE WHEN event_id % 2 = 0 THEN 0 ELSE 7200 END AS t FROM events",
    "S5_normalize_apps": """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'org.mozilla.firefox' WHEN 1 THEN 'io.neovim.nvim' ELSE 'unknown.' || translate(lower(trim(p_name)), ' /', '__') END AS app_id,
        p_partkey % 3 = 0 AS is_browser, p_partkey % 3 = 1 AS is_editor, false AS is_terminal, CASE p_partkey % 3 WHEN 0 THEN 'browser' WHEN 1 THEN 'editor' ELSE 'other' END AS app_category FROM part""",
    "H1_stable_hash": "SELECT doc_id, substr(sha256(coalesce(text, '')), 1, 12) AS h FROM documents",
    "H2_salted_hash": f"SELECT conv_id, turn, substr(sha256('{SALT}' || coalesce(text, '')), 1, 12) AS h FROM conversations",
    "H4_hash_bucket": "SELECT c_custkey, (CASE WHEN c_custkey % 2 = 0 THEN ('0x' || substr(sha256(c_name), 1, 12))::HUGEINT ELSE ('0x' || substr(sha256(c_name), 15, 2))::HUGEINT END % 256)::INTEGER AS bucket FROM customer",
    "X2_normalize_title": "SELECT conv_id, turn, trim(regexp_replace(nfc_normalize(coalesce(text, '')), '\\s+', ' ', 'g')) AS title FROM conversations",
    "X3_title_tokens": f"WITH {_CONV} SELECT conv_id, turn, array_to_string({_TOKENS}, ' ') AS tokens FROM c",
    "X4_char_ngrams": f"WITH {_CONV} SELECT conv_id, turn, greatest(length({_GRAM}) - 2, 0)::INTEGER AS n, CASE WHEN length({_GRAM}) > 3 THEN {_GRAM}[2:4] END AS second FROM c",
    "X6_title_scalars": f"WITH {_CONV} SELECT conv_id, turn, length(title)::INTEGER AS title_char_count, CASE WHEN title = '' THEN 0 ELSE round(length(regexp_replace(title, '[^0-9]', '', 'gs')) / length(title), 4) END AS title_digit_ratio, length(regexp_replace(title, '[^|\\-:/•]', '', 'gs'))::INTEGER AS title_separator_count FROM c",
    "X7_domain_category": f"""WITH kinds(domain, kind) AS (VALUES {_DOMAIN_VALUES}), p AS (SELECT page_id, lower(regexp_extract(coalesce(CASE WHEN page_id % 5 = 0 THEN 'https://mail.GitHub.com/x' ELSE url END, ''), '^[^:]*://([^/?#]*)', 1)) AS h FROM pages)
        SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'non_browser' WHEN h = '' THEN 'unknown' ELSE coalesce(a.kind, b.kind, 'other') END AS category FROM p LEFT JOIN kinds a ON a.domain = h
        LEFT JOIN kinds b ON len(string_split(h, '.')) > 2 AND b.domain = string_split(h, '.')[-2] || '.' || string_split(h, '.')[-1]""",
    "X8_align": "SELECT event_id, CAST(floor(epoch(ts) / 180) AS BIGINT) * 180 AS aligned FROM events",
    "X9_bucket_range": f"WITH {SQL_SPANS}, s AS (SELECT seq, CAST(floor(epoch(start_ts) / {BUCKET}) AS BIGINT) * {BUCKET} AS a, CAST(floor((CAST(floor(epoch(end_ts)) AS BIGINT) - 1) / {BUCKET}) AS BIGINT) * {BUCKET} AS z FROM spn) SELECT seq, (z - a) // {BUCKET} + 1 AS n, a AS first, z AS last FROM s",
    "X10_calendar": "SELECT event_id, hour(ts)::INTEGER AS hour_of_day, (isodow(ts) - 1)::INTEGER AS day_of_week FROM events",
    "X11_redact": "SELECT c_custkey, 'user said window_title=[REDACTED] and FULL_URL=[REDACTED] then ok' AS message FROM customer",
    "X12_entropy": f"WITH {SQL_PREDICTIONS} SELECT vec_id, round(-list_sum(list_transform(probs, lambda p: least(greatest(p, 1e-8), 1) * ln(least(greatest(p, 1e-8), 1)))), 5) AS entropy FROM prd",
    "P1_time_range": f"WITH {DOM} SELECT seq, app AS app_id FROM act WHERE epoch(ts) >= 1704412800 AND epoch(ts) < 1705276800",
    "P2_spans_in_days": f"WITH {SQL_SPANS} SELECT seq, label FROM spn WHERE end_ts >= TIMESTAMP '2024-01-05' AND start_ts <= TIMESTAMP '2024-01-07 23:59:59'",
    "P3_latest_spans": f"WITH {SQL_SPANS} SELECT seq, label, CAST(floor(epoch(end_ts)) AS BIGINT) AS end_ts FROM spn WHERE epoch(end_ts) > 1704412800 AND epoch(start_ts) < 1705276800 ORDER BY spn.end_ts DESC, start_ts, seq LIMIT 50",
    "P4_baseline_rules": f"""WITH {_ROWS} SELECT k, bucket, CASE WHEN active_seconds_any IS NULL OR active_seconds_any < 5 OR round(idle, 2) > 50 THEN 'BreakIdle' WHEN app = 'browser' AND scroll_events_per_min * 60 > 3 AND keys_per_min * 10 < 10 THEN 'ReadResearch'
        WHEN app IN ('editor', 'terminal') AND keys_per_min * 10 > 30 AND clicks_per_min * 60 > 1 THEN 'Build' ELSE 'Mixed/Unknown' END AS label FROM rows""",
    "P5_weak_rules": f"WITH {DOM}, r AS (SELECT k, b AS bucket, app, CASE WHEN app = 'browser' THEN 'news' END AS dom FROM dom) SELECT k, bucket, CASE {_WEAK.format(*[repr(l) for _, _, l in rules.DEFAULT_WEAK_RULES])} END AS label, CASE {_WEAK.format(*[repr(f'{f}:{v}') for f, v, _ in rules.DEFAULT_WEAK_RULES])} END AS rule FROM r",
    "P6_mode_decision": f"""WITH {_WIN} SELECT k, w AS "window", {_MODE.format("'Idle'", "'Attend'", "'Coordinate'", "'Produce'", "'Consume'", "'Idle'")} AS mode, ({_CONFIDENCE})::DOUBLE AS confidence,
        {_MODE.format("''", "'Coordinate'", "'Produce'", "'Consume'", "'Produce'", "'Produce,Consume'")} AS alternatives,
        {_MODE.format("'low_interaction_idle_signal'", "'meeting_signal,active_call'", "'communication_app_active'", "'editor_active,high_typing'", "'browser_active,high_scroll,low_typing'", "'no_strong_signal'")} AS reasons FROM win""",
    "P7_observed_facts": f"""WITH {_WIN}, s AS (SELECT *, {_SURFACE} AS surface FROM win) SELECT k, w AS "window", surface AS activity_surface, CASE WHEN surface = 'Edit' THEN 'Modified' WHEN surface = 'Read' THEN 'ReadOnly' ELSE 'None' END AS artifact_touch,
        CASE WHEN live THEN 'LiveHumanSession' ELSE 'None' END AS sync_presence, CASE WHEN live THEN 'SyncVoiceVideo' WHEN comm THEN 'AsyncText' ELSE 'None' END AS collaboration_surface FROM s""",
    "P8_allowed_subtype": f"WITH {SQL_SPANS}, m AS (SELECT seq, label, {_MODES}[seq % 5 + 1] AS mode FROM spn) SELECT seq, mode, CASE WHEN {_ALLOWED} THEN label END AS subtype FROM m",
    "P9_semantic_label": f"""WITH {_WIN}, s AS (SELECT *, {_SURFACE} AS surface, {_CONFIDENCE} AS c FROM win) SELECT k, w AS "window", CASE WHEN c < 0.5 THEN 'MixedUnknown' WHEN c < 0.7 THEN 'WeakEvidence' ELSE 'Supported' END AS support_state,
        CASE WHEN c < 0.7 OR surface = 'Read' THEN 'InferredFromContext' ELSE 'ObservedOnly' END AS intent_basis FROM s""",
    "P10_migrate_labels": f"""WITH {SQL_SPANS} SELECT seq, 14400000::BIGINT AS inference_window_ms, {_sql_text({k: v[0] for k, v in tables.V2_LABELS.items()}, 'label')} AS mode, {_sql_text({k: v[1] for k, v in tables.V2_LABELS.items() if v[1]}, 'label')} AS subtype,
        round(confidence, 6) AS confidence, CASE WHEN confidence < 0.5 THEN 'MixedUnknown' WHEN confidence < 0.7 THEN 'WeakEvidence' ELSE 'Supported' END AS support_state, CASE WHEN provenance = 'manual' THEN 'UserDeclared' ELSE 'Unknown' END AS intent_basis,
        CASE WHEN provenance = 'manual' THEN 'UserOverride' ELSE 'DeterministicRule' END AS mode_source FROM spn""",
    "P11_reject": f"WITH {SQL_PREDICTIONS} SELECT vec_id, CASE WHEN confidence < CASE WHEN user_id < 3 THEN 0.4 + user_id / 10 ELSE 0.55 END THEN 'Mixed/Unknown' ELSE predicted END AS label FROM prd",
    "P12_argmax_label": f"WITH {SQL_PREDICTIONS} SELECT vec_id, predicted AS label FROM prd",
    "P13_taxonomy": f"""WITH {SQL_PREDICTIONS}, w AS (SELECT vec_id, confidence, list_transform(list_zip(probs, {_W}), lambda z: z[1] * z[2]) AS q FROM prd),
        b AS (SELECT vec_id, confidence, {", ".join(f"({' + '.join(f'q[{_AT[c] + 1}]' for c in cs)}) / list_sum(q) AS b{i}" for i, cs in enumerate(_BUCKETS.values()))} FROM w), t AS (SELECT *, b0 + b1 + b2 + b3 AS s, greatest(b0, b1, b2, b3) AS g FROM b)
        SELECT vec_id, CASE WHEN confidence < 0.2 THEN 'Mixed/Unknown' WHEN b0 = g THEN 'Deep work' WHEN b1 = g THEN 'Talk' WHEN b2 = g THEN 'Checks' ELSE 'Other' END AS mapped_label,
        {", ".join(f"CASE WHEN confidence >= 0.2 THEN round(b{i} / s, 6) END AS {n.lower().replace(' ', '_')}" for i, n in enumerate(_BUCKETS))} FROM t""",
    "P14_identity_taxonomy": f"WITH {SQL_PREDICTIONS} SELECT vec_id, predicted AS mapped_label FROM prd",
    "P15_temperature": f"WITH {SQL_PREDICTIONS} SELECT vec_id, round({_TEMPER.format(t=1.7)}, 5) AS confidence FROM prd",
    "P16_isotonic": f"WITH {SQL_PREDICTIONS}, u AS (SELECT vec_id, unnest(probs) AS p FROM prd), c AS (SELECT vec_id, greatest({_CURVE}, 1e-12) AS c FROM u) SELECT vec_id, round(max(c) / sum(c), 5) AS confidence FROM c GROUP BY vec_id",
    "P17_user_temperature": f"WITH {SQL_PREDICTIONS} SELECT vec_id, round({_TEMPER.format(t='CASE WHEN user_id % 2 = 0 THEN 0.5 + user_id / 4 ELSE 1.3 END')}, 5) AS confidence FROM prd",
}
