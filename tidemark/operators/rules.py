"""Rule classification, confidence handling and taxonomies as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import tables

MIXED = "Mixed/Unknown"
#: App groups that evidence rules look for.
COMMUNICATION_APPS = ("com.tinyspeck.slackmacgap", "com.apple.mail", "com.microsoft.teams")
EDITOR_APPS = ("com.microsoft.VSCode", "com.apple.Terminal", "com.jetbrains.intellij")


def _map(values: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def normalize_app(df: DataFrame, name: str = "app") -> DataFrame:
    """app_id, is_browser, is_editor, is_terminal, app_category of a raw app name."""
    ids = _map({n: i for apps in tables.APPS.values() for n, i in apps.items()})
    kinds = _map({n: kind for kind, apps in tables.APPS.items() for n in apps})
    key = F.lower(F.trim(F.coalesce(F.col(name), F.lit("unknown"))))
    kind = F.try_element_at(kinds, key)
    return df.withColumns({
        "app_id": F.coalesce(F.try_element_at(ids, key), F.concat(F.lit("unknown."), F.translate(key, " /", "__"))),
        **{f"is_{k}": F.coalesce(kind == k, F.lit(False)) for k in ("browser", "editor", "terminal")},
        "app_category": F.coalesce(kind, F.lit("other")),
    })


def domain_category(domain: Column, is_browser: Column) -> Column:
    kinds = _map({d: kind for kind, domains in tables.DOMAINS.items() for d in domains})
    name = F.lower(F.trim(domain))
    parent = F.when(F.size(F.split(name, r"\.")) > 2, F.substring_index(name, ".", -2))
    return F.when(~is_browser, "non_browser").when(domain.isNull() | (name == ""), "unknown").otherwise(F.coalesce(F.try_element_at(kinds, name), F.try_element_at(kinds, parent), F.lit("other")))


def in_range(df: DataFrame, column: str, start: Column, end: Column) -> DataFrame:
    """Half-open range of instants."""
    return df.where((F.col(column) >= start) & (F.col(column) < end))


def spans_in_days(spans: DataFrame, first: Column, last: Column) -> DataFrame:
    """Spans that end on or after the first day's start and start by the last second of the last day."""
    return spans.where((F.col("end_ts") >= first.cast("timestamp")) & (F.col("start_ts") <= F.date_add(last, 1).cast("timestamp") - F.expr("INTERVAL 1 SECOND")))


def latest_spans(spans: DataFrame, start: Column, end: Column, limit: int = 500) -> DataFrame:
    return spans.where((F.col("end_ts") > start) & (F.col("start_ts") < end)).orderBy(F.desc("end_ts"), "start_ts", "seq").limit(min(limit, 500))


def baseline_label(idle_active: float = 5, idle_run: float = 50, scroll_high: float = 3, keys_low: float = 10, keys_high: float = 30, shortcuts_high: float = 1) -> Column:
    """Rules in strict order; missing active seconds mean idle, other missing values are 0."""
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    active = F.col("active_seconds_any")
    return (
        F.when(F.coalesce(F.col("app_category") == "lockscreen", F.lit(False)), "BreakIdle")
        .when(active.isNull() | (active < idle_active) | (value("max_idle_run_seconds") > idle_run), "BreakIdle")
        .when(flag("is_browser") & (value("scroll_events_per_min") > scroll_high) & (value("keys_per_min") < keys_low), "ReadResearch")
        .when((flag("is_editor") | flag("is_terminal")) & (value("keys_per_min") > keys_high) & (value("shortcut_rate") > shortcuts_high), "Build")
        .otherwise(MIXED)
    )


DEFAULT_WEAK_RULES = tuple((field, value, label) for field, rules in (("app_id", tables.APP_ID_LABELS), ("app_category", tables.APP_CATEGORY_LABELS), ("domain_category", tables.DOMAIN_LABELS)) for value, label in rules.items())


def weak_label(rules: Sequence[tuple] = DEFAULT_WEAK_RULES) -> tuple[Column, Column]:
    """(label, rule name) of the first rule (field, value, label) that fits; null if none does."""
    label, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for field, value, to, *_ in reversed(rules):
        fits = F.col(field) == value
        label, name = F.when(fits, to).otherwise(label), F.when(fits, f"{field}:{value}").otherwise(name)
    return label, name


def weak_confidence(rules: Sequence[tuple], rule: Column) -> Column:
    """Confidence of the named rule: the fourth part of its (field, value, label, confidence), null where it has none."""
    out = F.lit(None).cast("double")
    for field, value, *rest in reversed(rules):
        if len(rest) > 1 and rest[1] is not None:
            out = F.when(rule == f"{field}:{value}", float(rest[1])).otherwise(out)
    return out


def evidence_windows(slices: DataFrame, keys: Sequence[str], seconds: int = 180) -> DataFrame:
    """Evidence of an inference window: sums, any and all signals, apps."""
    start = F.timestamp_seconds(F.floor(F.unix_seconds("bucket") / seconds) * seconds)
    live = F.coalesce(F.col("meeting_signal"), F.lit(False))
    for c in ("active_call", "active_mic"):
        if c in slices.columns:
            live = live | F.coalesce(F.col(c), F.lit(False))
    category = F.lower("browser_url_category") if "browser_url_category" in slices.columns else F.lit(None).cast("string")
    return slices.withColumn("_live", live).withColumn("_category", category).groupBy(*keys, start.alias("window")).agg(
        F.sum("foreground_duration_ms").alias("duration_ms"), F.sum("key_events").alias("keys"), F.sum("scroll_events").alias("scroll"), F.bool_or("_live").alias("live"), F.bool_and("low_interaction_idle_signal").alias("idle"),
        F.array_distinct(F.flatten(F.collect_list("app_ids"))).alias("apps"), F.collect_set("_category").alias("categories"),
    )


def _signals(communication: Sequence[str], editors: Sequence[str], browsers: Sequence[str]) -> tuple[Column, Column, Column]:
    apps = F.col("apps")
    has = lambda names: F.arrays_overlap(apps, F.array(*map(F.lit, names)))
    browser = F.exists(apps, lambda a: F.regexp_like(F.lower(a), F.lit("|".join(browsers)))) | F.exists("categories", lambda c: F.contains(c, F.lit("browser")))
    return has(communication), has(editors), browser


def mode_decision(communication: Sequence[str] = COMMUNICATION_APPS, editors: Sequence[str] = EDITOR_APPS, browsers: Sequence[str] = ("chrome", "firefox", "safari")) -> Column:
    """struct(mode, confidence, alternatives, reasons) of an evidence window."""
    comm, editor, browser = _signals(communication, editors, browsers)

    def decided(mode: str, confidence: float, alternatives: Sequence[str], *reasons: str) -> Column:
        array = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
        return F.struct(F.lit(mode).alias("mode"), F.lit(confidence).alias("confidence"), array(alternatives).alias("alternatives"), array(reasons).alias("reasons"))

    return (
        F.when(F.col("idle") & (F.col("duration_ms") > 0), decided("Idle", 0.9, [], "low_interaction_idle_signal"))
        .when(F.col("live"), decided("Attend", 0.85, ["Coordinate"], "meeting_signal", "active_call"))
        .when(comm, decided("Coordinate", 0.8, ["Produce"], "communication_app_active"))
        .when(editor & (F.col("keys") > 10), decided("Produce", 0.85, ["Consume"], "editor_active", "high_typing"))
        .when(browser & (F.col("scroll") > 0) & (F.col("keys") < 10), decided("Consume", 0.8, ["Produce"], "browser_active", "high_scroll", "low_typing"))
        .otherwise(decided("Idle", 0.3, ["Produce", "Consume"], "no_strong_signal"))
    )


def observed_facts(communication: Sequence[str] = COMMUNICATION_APPS, editors: Sequence[str] = EDITOR_APPS, browsers: Sequence[str] = ("chrome", "firefox", "safari")) -> dict[str, Column]:
    comm, editor, browser = _signals(communication, editors, browsers)
    named = lambda pattern: F.exists("categories", lambda c: F.regexp_like(c, F.lit(pattern)))
    surface = (
        F.when(F.col("live"), "Call").when(comm, "Message").when(editor & (F.col("keys") > 0), "Edit").when(named("search"), "Search").when(named("video|stream|watch|lecture"), "Watch")
        .when(browser | (F.col("scroll") > 0), "Read").when(F.col("idle"), "IdleLike").otherwise("Read")
    )
    return {
        "activity_surface": surface,
        "artifact_touch": F.when(surface == "Edit", "Modified").when(surface.isin("Read", "Watch", "Search"), "ReadOnly").otherwise("None"),
        "sync_presence": F.when(F.col("live"), "LiveHumanSession").otherwise("None"),
        "collaboration_surface": F.when(F.col("live"), "SyncVoiceVideo").when(comm, "AsyncText").otherwise("None"),
    }


def allowed_subtype(mode: Column, subtype: Column) -> Column:
    policy = F.create_map(*[x for m, subtypes in tables.MODE_SUBTYPES.items() for x in (F.lit(m), F.array(*map(F.lit, subtypes)))])
    return F.when(F.array_contains(F.try_element_at(policy, mode), subtype), subtype)


def support_state(confidence: Column, escalation: float = 0.5) -> Column:
    return F.when(confidence < escalation, "MixedUnknown").when(confidence < 0.7, "WeakEvidence").otherwise("Supported")


def intent_basis(state: Column, surface: Column) -> Column:
    return F.when((state != "Supported") | surface.isin("Read", "Watch", "Search"), "InferredFromContext").otherwise("ObservedOnly")


def migrate_labels(spans: DataFrame) -> DataFrame:
    """Labels v1 as nested labels v2."""
    known = F.create_map(*[x for label, (mode, sub) in tables.V2_LABELS.items() for x in (F.lit(label), F.struct(F.lit(mode).alias("mode"), F.lit(sub).cast("string").alias("subtype")))])
    label = F.coalesce(F.col("label"), F.lit(MIXED))
    to = F.coalesce(F.try_element_at(known, label), F.struct(F.lit("Idle").alias("mode"), F.lit(None).cast("string").alias("subtype")))
    confidence = F.when(label == MIXED, 0.3).otherwise(F.coalesce(F.col("confidence"), F.lit(1.0)))
    declared = F.coalesce(F.regexp_like(F.lower("provenance"), F.lit("manual|user|annotat")), F.lit(False))
    reasons = F.array(F.lit("v1_legacy_migration"))
    axis = lambda value: F.struct(value.alias("value"), confidence.alias("confidence"), reasons.alias("reason_codes"))
    millis = F.coalesce((F.unix_millis("end_ts") - F.unix_millis("start_ts")), F.lit(180_000))
    semantic = F.struct(
        axis(to["mode"]).alias("mode"), F.when(to["subtype"].isNotNull(), axis(to["subtype"])).alias("subtype"),
        F.when((label == MIXED) | (confidence < 0.5), "MixedUnknown").when(confidence < 0.7, "WeakEvidence").otherwise("Supported").alias("support_state"),
        F.when(declared, "UserDeclared").otherwise("Unknown").alias("intent_basis"), F.when(declared, "UserOverride").otherwise("DeterministicRule").alias("mode_source"),
    )
    return spans.select("*", F.lit("labels_v2").alias("taxonomy_version"), F.lit(30_000).alias("evidence_window_ms"), millis.alias("inference_window_ms"), semantic.alias("semantic"))


def reject(label: Column, confidence: Column, threshold: Column) -> Column:
    return F.when(confidence < threshold, MIXED).otherwise(label)


def with_user_thresholds(df: DataFrame, thresholds: DataFrame, default: float) -> DataFrame:
    """``threshold`` of each row's user; a table with a row for each user is joined, not broadcast by hand."""
    return df.join(thresholds.select("user_id", F.col("threshold").alias("_t")), "user_id", "left").withColumn("threshold", F.coalesce("_t", F.lit(default))).drop("_t")


def argmax_label(probs: Column, labels: Sequence[str]) -> Column:
    """Label of the first maximum."""
    return F.element_at(F.array(*map(F.lit, labels)), F.array_position(probs, F.array_max(probs)).cast("int"))


def check_taxonomy(buckets: Mapping[str, Sequence[str]], labels: Sequence[str], weights: Mapping[str, float] | None = None) -> None:
    """Raise for unknown labels, empty or blank buckets, and weights that are not positive."""
    if any(not name.strip() or not members for name, members in buckets.items()):
        raise ValueError("a bucket needs a name and members")
    if unknown := {x for members in buckets.values() for x in members} - set(labels):
        raise ValueError(f"unknown labels: {sorted(unknown)}")
    if bad := {k: w for k, w in (weights or {}).items() if w <= 0 or k not in labels}:
        raise ValueError(f"bad weights: {bad}")


def map_taxonomy(df: DataFrame, buckets: Mapping[str, Sequence[str]], labels: Sequence[str], probs: str = "probs", rejected: str | None = None, weights: Mapping[str, float] | None = None, how: str = "sum", fallback: str = "Other") -> DataFrame:
    """``mapped_label`` and ``mapped_probs`` of the user's buckets."""
    check_taxonomy(buckets, labels, weights)
    buckets = dict(buckets)
    covered = {x for members in buckets.values() for x in members}
    if rest := [x for x in labels if x not in covered]:
        buckets[fallback] = rest
    at = {label: i for i, label in enumerate(labels)}
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda t, x: t + x)
    scale = lambda a: F.transform(a, lambda x: F.when(total(a) > 0, x / total(a)).otherwise(x))
    out = df.withColumn("_p", F.col(probs))
    if weights:
        out = out.withColumn("_w", F.zip_with("_p", F.array(*[F.lit(float(weights.get(x, 1.0))) for x in labels]), lambda p, w: p * w)).withColumn("_p", scale(F.col("_w"))).drop("_w")
    each = [[F.get("_p", F.lit(at[x])) for x in members] for members in buckets.values()]
    joined = [sum(ps[1:], ps[0]) if how == "sum" else F.greatest(*ps) if len(ps) > 1 else ps[0] for ps in each]
    out = out.withColumn("_b", F.array(*joined)).withColumn("_n", scale(F.col("_b")))
    names = F.array(*map(F.lit, buckets))
    label = F.element_at(names, F.array_position("_n", F.array_max("_n")).cast("int"))
    mapped = F.map_from_arrays(names, F.transform("_n", lambda x: F.round(x, 6)))
    if rejected:
        label = F.when(F.col(rejected), MIXED).otherwise(label)
        mapped = F.when(F.col(rejected), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))).otherwise(mapped)
    return out.withColumns({"mapped_label": label, "mapped_probs": mapped}).drop("_p", "_b", "_n")


def apply_temperature(probs: Column, temperature: Column) -> Column:
    """softmax(log(max(p, 1e-12)) / T)."""
    logs = F.transform(probs, lambda p: F.ln(F.greatest(p, F.lit(1e-12))) / temperature)
    top = F.array_max(logs)
    powers = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda t, y: t + y))


def apply_user_temperature(df: DataFrame, calibrators: DataFrame, default: float, probs: str = "probs") -> DataFrame:
    """Calibrate with a user's temperature, or the global one where a user has none."""
    joined = df.join(calibrators.select("user_id", F.col("temperature").alias("_t")), "user_id", "left").withColumn("_t", F.coalesce("_t", F.lit(default)))
    logs = joined.withColumn("_l", F.transform(probs, lambda p: F.ln(F.greatest(p, F.lit(1e-12))) / F.col("_t")))
    powers = logs.withColumn("_e", F.transform("_l", lambda x: F.exp(x - F.array_max("_l"))))
    return powers.withColumn(probs, F.transform("_e", lambda x: x / F.aggregate("_e", F.lit(0.0), lambda t, y: t + y))).drop("_t", "_l", "_e")


def apply_isotonic(df: DataFrame, curves: Mapping[int, tuple[Sequence[float], Sequence[float]]], probs: str = "probs") -> DataFrame:
    """Per class piecewise-linear (boundaries, values), clipped, floored at 1e-12, normalised.

    The curves are one row that is joined to all; a probability finds its place by bisection, whatever the number of boundaries.
    """
    n = max(curves) + 1
    row = [([float(x) for x in curves[k][0]], [float(y) for y in curves[k][1]]) if k in curves else None for k in range(n)]
    table = df.sparkSession.createDataFrame([(row,)], "_curves array<struct<xs: array<double>, ys: array<double>>>")
    most = max(len(xs) for xs, _ in curves.values())
    steps = F.array(*[F.lit(1 << k) for k in range(most.bit_length() - 1, -1, -1)])

    def curve(p: Column, c: Column) -> Column:
        below = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(F.get(c.xs, at + step - 1) < p, F.lit(False)), at + step).otherwise(at))

        def between(at: Column) -> Column:
            x0, x1, y0, y1 = F.get(c.xs, at - 1), F.get(c.xs, at), F.get(c.ys, at - 1), F.get(c.ys, at)
            return F.when(at == 0, F.get(c.ys, F.lit(0))).when(at >= F.size(c.xs), F.element_at(c.ys, -1)).when(x1 == p, y1).otherwise(y0 + (p - x0) * (y1 - y0) / (x1 - x0))

        placed = F.element_at(F.transform(F.array(below), between), 1)
        return F.greatest(F.when(c.isNull(), p).otherwise(placed), F.lit(1e-12))

    out = df.join(F.broadcast(table)).withColumn("_c", F.zip_with(probs, "_curves", curve))
    return out.withColumn(probs, F.transform("_c", lambda x: x / F.aggregate("_c", F.lit(0.0), lambda t, y: t + y))).drop("_c", "_curves")
