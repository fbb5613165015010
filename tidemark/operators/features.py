"""Per-bucket features: aggregates, sessions, look-back windows and dynamics.

``keys`` name the stream (a user, or user and device). Buckets exist where there is a
foreground event. Everything before the look-back is one grouping on (keys, bucket) and
windows on keys over bucket-grain rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import scans

INPUT_COLUMNS = ("keys_per_min", "clicks_per_min", "scroll_events_per_min", "mouse_distance", "active_seconds_keyboard", "active_seconds_mouse", "active_seconds_any", "max_idle_run_seconds", "event_density")


def bucketed(events: DataFrame, seconds: int) -> DataFrame:
    """An event belongs wholly to the bucket it starts in."""
    return events.withColumn("bucket", scalars.align(F.col("ts"), seconds))


def _app_totals(bucketed_events: DataFrame, keys: Sequence[str], attributes: Sequence[str], *more: Column) -> DataFrame:
    """For each bucket and app: seconds in millionths, first event, that event's attributes, and ``more``."""
    place = F.struct("ts", "seq")
    return bucketed_events.groupBy(*keys, "bucket", "app_id").agg(F.sum(scalars.units(F.col("duration_seconds"), 6)).alias("total"), F.min(place).alias("first"), F.min_by(F.struct(F.lit(1).alias("_"), *attributes), place).alias("at_first"), *more)


def _best() -> Column:
    return F.min_by(F.struct("app_id", "total", "at_first"), F.struct(-F.col("total"), F.col("first"))).alias("best")


def _of_best(seconds: int, attributes: Sequence[str]) -> list[Column]:
    whole = F.lit(seconds * 1_000_000)
    return [F.col("best.app_id").alias("app_id"), (F.col("best.total") / 1e6).alias("dominant_seconds"), scalars.quotient(F.least(F.col("best.total"), whole), whole, 4).alias("app_foreground_time_ratio"), *[F.col(f"best.at_first.{c}").alias(c) for c in attributes]]


def dominant_apps(events: DataFrame, keys: Sequence[str], seconds: int, attributes: Sequence[str] = ()) -> DataFrame:
    """The app with most seconds in each bucket (ties: seen first), its first event's attributes, its share."""
    best = _app_totals(bucketed(events, seconds), keys, attributes).groupBy(*keys, "bucket").agg(_best())
    return best.select(*keys, "bucket", *_of_best(seconds, attributes))


def app_changes(events: DataFrame, keys: Sequence[str], seconds: int) -> DataFrame:
    order = Window.partitionBy(*keys, "bucket").orderBy("ts", "seq")
    changed = bucketed(events, seconds).withColumn("changed", F.col("app_id") != F.lag("app_id").over(order))
    return changed.groupBy(*keys, "bucket").agg(F.count_if("changed").alias("app_change_count"))


def input_activity(samples: DataFrame, keys: Sequence[str], seconds: int) -> DataFrame:
    """Rates a minute, distance, active seconds, density and the longest idle run of each bucket."""
    keyboard = F.col("presses") > 0
    mouse = (F.col("clicks") > 0) | (F.col("delta_x") + F.col("delta_y") > 0) | (F.col("scroll_x") + F.col("scroll_y") > 0)
    flagged = bucketed(samples, seconds).withColumns({"kb": keyboard, "mouse": mouse}).withColumn("live", F.col("kb") | F.col("mouse"))
    order = Window.partitionBy(*keys, "bucket").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    islands = flagged.withColumn("island", F.sum(F.col("live").cast("int")).over(order))
    seconds_if = lambda flag: F.sum(F.when(flag, F.col("duration_seconds")).otherwise(0.0))
    runs = islands.groupBy(*keys, "bucket", "island").agg(
        seconds_if(~F.col("live")).alias("idle"), F.sum("presses").alias("presses"), F.sum("clicks").alias("clicks"), F.sum(F.col("scroll_x") + F.col("scroll_y")).alias("scroll"), F.sum(F.col("delta_x") + F.col("delta_y")).alias("distance"),
        seconds_if(F.col("kb")).alias("kb"), seconds_if(F.col("mouse")).alias("mouse"), seconds_if(F.col("live")).alias("live"), F.count_if("live").alias("n_live"), F.sum(F.when(F.col("live"), scalars.units(F.col("duration_seconds"), 6)).otherwise(0)).alias("live_units"),
    )
    minutes = seconds / 60
    live = F.sum("live")
    return runs.groupBy(*keys, "bucket").agg(
        F.round(F.sum("presses") / minutes, 2).alias("keys_per_min"),
        F.round(F.sum("clicks") / minutes, 2).alias("clicks_per_min"),
        F.round(F.sum("scroll") / minutes, 2).alias("scroll_events_per_min"),
        F.sum("distance").cast("double").alias("mouse_distance"),
        F.round(F.sum("kb"), 2).alias("active_seconds_keyboard"),
        F.round(F.sum("mouse"), 2).alias("active_seconds_mouse"),
        F.round(live, 2).alias("active_seconds_any"),
        F.round(F.max("idle"), 2).alias("max_idle_run_seconds"),
        F.coalesce(scalars.quotient(F.sum("n_live") * 1_000_000, F.nullif(F.sum("live_units"), F.lit(0)), 4), F.lit(0.0)).alias("event_density"),
    )


def sessions(events: DataFrame, keys: Sequence[str], gap_seconds: float) -> DataFrame:
    """Session starts: an event that begins ``gap_seconds`` or more after the end of the one before."""
    micros = F.unix_micros("ts") / 1e6
    rows = scans.previous(events.select(*keys, "ts", "seq", "duration_seconds"), keys, ["ts", "seq"], micros + F.col("duration_seconds"), "_before")
    gap = micros - F.col("_before")
    return rows.where(gap.isNull() | (gap >= gap_seconds)).select(*keys, F.col("ts").alias("session_start"))


def with_sessions(buckets: DataFrame, events: DataFrame, keys: Sequence[str], seconds: int, gap_seconds: float) -> DataFrame:
    """``session_start`` (bucket-aligned), length so far in minutes, and the idle-return flag of each bucket."""
    starts = sessions(events, keys, gap_seconds).select(*keys, scalars.align(F.col("session_start"), seconds).alias("session_start")).distinct()
    return scans.asof(buckets, starts, keys, "bucket", "session_start", ["session_start"]).withColumns(_since_start())


def _since_start() -> dict[str, Column]:
    return {
        "session_length_so_far": F.round((F.unix_seconds("bucket") - F.unix_seconds("session_start")) / 60, 2),
        "idle_return_indicator": F.col("bucket") == F.col("session_start"),
    }


def session_id(user: Column, start: Column) -> Column:
    return scalars.stable_hash(F.concat(user.cast("string"), F.lit(":"), F.date_format(start, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")))


def lookback(events: DataFrame, keys: Sequence[str], seconds: int, window_seconds: int) -> DataFrame:
    """Switches, entropy and top-two share of apps in [bucket - window, bucket + seconds).

    A bucket's apps and seconds are one row; a range window gathers those that a bucket looks back on, at most
    ``window / seconds + 1`` rows of observed buckets. Windows are cut into blocks of time, so that a key's history is not one
    task: a row stands in its own block and, where later buckets see it, in the next one.
    """
    known = [F.col(c).isNotNull() for c in (*keys, "bucket")]
    per_app = bucketed(events, seconds).where(reduce(and_, known)).groupBy(*keys, "bucket", "app_id").agg(F.sum(scalars.units(F.col("duration_seconds"), 6)).alias("total"))
    per_bucket = per_app.groupBy(*keys, "bucket").agg(_apps())
    return _look_back(per_bucket, keys, seconds, {window_seconds: ("switches", "entropy", "top2")})


def _apps() -> Column:
    return F.collect_list(F.struct("app_id", F.coalesce("total", F.lit(0)).alias("d"))).alias("_a")


def _look_back(buckets: DataFrame, keys: Sequence[str], seconds: int, windows: Mapping[int, tuple[str, str, str]]) -> DataFrame:
    """``buckets`` with the three columns of each window; ``_a``, a bucket's apps and seconds, goes."""
    if any(window % seconds for window in windows):
        raise ValueError("the window must be a multiple of the bucket")
    others = [c for c in buckets.columns if c not in (*keys, "bucket", "_a")]
    at, length = F.unix_seconds("bucket"), 8 * max(*windows, seconds)
    own = F.floor(at / length)
    # in the next block a row is only looked back on
    spread = buckets.select(*keys, "bucket", "_a", *others, F.explode(F.sequence(own, F.floor((at + max(windows)) / length))).alias("_block"))
    placed = spread.select(*keys, "bucket", "_a", "_block", F.when(F.col("_block") == own, F.struct(F.lit(1).alias("_"), *others)).alias("_own"))
    order = Window.partitionBy(*keys, "_block").orderBy(F.unix_seconds("bucket"))
    seen = placed.withColumns({f"_seen{w}": F.collect_list("_a").over(order.rangeBetween(-w, 0)) for w in windows}).where("_own IS NOT NULL")

    def of_apps(column: str) -> Column:
        apps = F.array_distinct(F.transform(column, lambda x: x["app_id"]))
        of_app = lambda app: F.aggregate(F.filter(column, lambda x: x["app_id"].eqNullSafe(app)), F.lit(0).cast("long"), lambda t, x: t + x["d"])
        return F.sort_array(F.transform(apps, of_app), asc=False)

    flat = seen.withColumns({f"_seen{w}": F.flatten(f"_seen{w}") for w in windows})
    totals = flat.select(*keys, "bucket", "_own", *[of_apps(f"_seen{w}").alias(f"_ds{w}") for w in windows])
    totals = totals.withColumns({f"_total{w}": F.aggregate(f"_ds{w}", F.lit(0).cast("long"), lambda t, x: t + x) for w in windows} | {f"_dlogd{w}": F.aggregate(f"_ds{w}", F.lit(0.0), lambda t, x: t + F.when(x > 0, x * F.log2(x)).otherwise(0.0)) for w in windows})
    found: list[Column] = []
    for w, (switches, entropy_, top2) in windows.items():
        ds, total = f"_ds{w}", F.col(f"_total{w}")
        # -sum p log2 p = log2 total - (sum d log2 d) / total
        entropy = F.when(total > 0, F.round(F.log2(total) - F.col(f"_dlogd{w}") / total, 4)).otherwise(0.0)
        top = scalars.quotient(F.get(ds, F.lit(0)) + F.coalesce(F.get(ds, F.lit(1)), F.lit(0)), F.when(total > 0, total), 4)
        found += [(F.size(ds).cast("long") - 1).alias(switches), F.abs(entropy).alias(entropy_), top.alias(top2)]
    return totals.select(*keys, "bucket", *[F.col(f"_own.{c}").alias(c) for c in others], *found)


def dwell(buckets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Seconds of the dominant app since it became dominant, over observed buckets."""
    order = Window.partitionBy(*keys).orderBy("bucket")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    own = scalars.units(F.col("dominant_seconds"), 6)
    # seconds so far in whole units, less those before the app's run: one order of rows serves both
    so_far = buckets.withColumns({"_new": F.coalesce(F.col("app_id") != F.lag("app_id").over(order), F.lit(False)), "_units": F.coalesce(F.sum(own).over(running), F.lit(0)), "_known": F.count(own).over(running)})
    before = F.struct((F.col("_units") - F.coalesce(own, F.lit(0))).alias("units"), (F.col("_known") - own.isNotNull().cast("long")).alias("known"))
    cut = so_far.withColumn("_cut", F.last(F.when(F.col("_new"), before), ignorenulls=True).over(running))
    since = lambda c: F.col(f"_{c}") - F.coalesce(F.col(f"_cut.{c}"), F.lit(0))
    return cut.withColumn("app_dwell_time_seconds", F.when(since("known") > 0, scalars.quotient(since("units"), F.lit(1), 2, 6))).drop("_new", "_units", "_known", "_cut")


def title_repeats(buckets: DataFrame, keys: Sequence[str]) -> DataFrame:
    run = Window.partitionBy(*keys, "session_start", "window_title_hash").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return buckets.withColumn("title_repeat_count_session", F.count("*").over(run))


def dynamics(buckets: DataFrame, keys: Sequence[str], rolling: Sequence[str] = ("keys_per_min", "mouse_distance"), deltas: Sequence[str] = ("keys_per_min", "clicks_per_min", "mouse_distance"), sizes: Sequence[int] = (5, 15), order: Sequence[str] = ("bucket",)) -> DataFrame:
    """Rolling means over observed buckets, of values to four decimals, and differences to the one before."""
    order = Window.partitionBy(*keys).orderBy(*order)
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    # what the last n rows add is the running total less that of n rows before
    totals = {f"_sum_{c}": F.coalesce(F.sum(scalars.units(F.col(c), 4)).over(running), F.lit(0)) for c in rolling} | {f"_count_{c}": F.count(c).over(running) for c in rolling}
    last = lambda c, n: F.col(c) - F.lag(c, n, 0).over(order)
    steps = {f"_last_{what}_{c}_{n}": last(f"_{what}_{c}", n) for what in ("sum", "count") for c in rolling for n in sizes}
    means = {f"{c}_rolling_{n}": F.when(F.col(f"_last_count_{c}_{n}") > 0, scalars.quotient(F.col(f"_last_sum_{c}_{n}"), F.col(f"_last_count_{c}_{n}"), 4, 4)) for c in rolling for n in sizes}
    return buckets.withColumns(totals).withColumns(steps).withColumns(means | {f"{c}_delta": F.round(F.col(c) - F.lag(c).over(order), 4) for c in deltas}).drop(*totals, *steps)


def rolling_context(rows: DataFrame, keys: Sequence[str], size: int = 15, gap_seconds: int = 300, rolling: Sequence[str] = ("keys_per_min",), deltas: Sequence[str] = ("keys_per_min",), sizes: Sequence[int] = (5, 15), recent_seconds: int = 900) -> DataFrame:
    """Of (ts, app_id, ...) rows: distinct apps less one of the last ``size`` rows in ``recent_seconds``, rolling means, differences, session minutes.

    Sessions begin where the row before starts ``gap_seconds`` or more earlier. The batch form of ``live.rolling_features``.
    """
    order = Window.partitionBy(*keys).orderBy("ts", "app_id")
    past = F.collect_list(F.struct("ts", "app_id")).over(order.rowsBetween(1 - size, 0))
    near = F.filter(past, lambda r: F.unix_micros(r.ts) >= F.unix_micros("ts") - recent_seconds * 1_000_000)
    opens = F.coalesce(F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(order)) >= gap_seconds * 1_000_000, F.lit(True))
    marked = dynamics(rows.withColumn("bucket", F.col("ts")), keys, rolling, deltas, sizes, order=("bucket", "app_id")).withColumns({"switches": F.size(F.array_distinct(F.transform(near, lambda r: r.app_id))) - 1, "_began": F.when(opens, F.unix_micros("ts"))})
    began = F.last("_began", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("session_minutes", scalars.quotient(F.unix_micros("ts") - began, F.lit(600_000), 2, 2)).drop("_began", "bucket")


def evidence(events: DataFrame, samples: DataFrame | None, keys: Sequence[str], seconds: int = 30) -> DataFrame:
    """Short slices: distinct apps and titles, foreground ms, input sums, switches, meeting and idle signals."""
    order = Window.partitionBy(*keys, "bucket").orderBy("ts", "seq")
    marked = bucketed(events, seconds).withColumn("_changed", F.col("app_id") != F.lag("app_id").over(order))
    slices = marked.groupBy(*keys, "bucket").agg(
        F.sort_array(F.collect_set("app_id")).alias("app_ids"), F.sort_array(F.collect_set("window_title_hash")).alias("title_hashes"),
        F.floor(F.sum("duration_seconds") * 1000).alias("foreground_duration_ms"), F.count_if("_changed").alias("app_switches"),
        F.bool_or(F.regexp_like(F.lower("app_id"), F.lit("zoom|meet|teams"))).alias("meeting_signal"),
    )
    if samples is None:
        return slices.withColumns({c: F.lit(0).cast("long") for c in ("key_events", "pointer_events", "scroll_events")} | {"low_interaction_idle_signal": F.lit(True)})
    sums = bucketed(samples, seconds).groupBy(*keys, "bucket").agg(
        F.sum("presses").alias("key_events"), F.sum(F.col("clicks") + F.abs("delta_x") + F.abs("delta_y")).alias("pointer_events"), F.sum(F.abs("scroll_x") + F.abs("scroll_y")).alias("scroll_events"),
    )
    joined = slices.join(sums, [*keys, "bucket"], "left").fillna(0, ["key_events", "pointer_events", "scroll_events"])
    return joined.withColumn("low_interaction_idle_signal", F.col("key_events") + F.col("pointer_events") + F.col("scroll_events") == 0)


def attach_evidence(buckets: DataFrame, slices: DataFrame, keys: Sequence[str], seconds: int) -> DataFrame:
    """Slices that lie wholly inside a bucket, in order, as an array."""
    columns = [c for c in slices.columns if c not in keys and c != "bucket"]
    inside = slices.select(*keys, scalars.align(F.col("bucket"), seconds).alias("_b"), F.struct(F.col("bucket").alias("slice"), *columns).alias("s")).groupBy(*keys, F.col("_b").alias("bucket")).agg(F.sort_array(F.collect_list("s")).alias("evidence"))
    return buckets.join(inside, [*keys, "bucket"], "left")


def feature_table(events: DataFrame, samples: DataFrame, keys: Sequence[str] = ("user_id",), seconds: int = 60, gap_seconds: float = 300, windows: Sequence[int] = (300, 900), version: str = "v1", schema_hash: str = "") -> DataFrame:
    """All features of every bucket.

    Events are dealt out once by bucket, where an ordered pass finds the app changes and the sessions that open inside it; the input counts join
    there, the look-back follows in blocks of time. Then one order of a key's buckets gives its sessions, dwell and dynamics.
    """
    attributes = [c for c in ("app_category", "window_title_hash", "is_browser", "is_editor", "is_terminal") if c in events.columns]
    known = [F.col(c).isNotNull() for c in (*keys, "bucket")]
    inside = Window.partitionBy(*keys, "bucket").orderBy("ts", "seq")
    micros = F.unix_micros("ts") / 1e6
    opens = lambda at, before: F.coalesce(at - before >= gap_seconds, F.lit(True))
    ended = bucketed(events, seconds).where(reduce(and_, known)).withColumn("_end", F.struct((micros + F.col("duration_seconds")).alias("x")))
    marked = ended.withColumns({"_changed": F.col("app_id") != F.lag("app_id").over(inside), "_before": F.lag("_end").over(inside)})
    more = [F.count_if("_changed").alias("changes"), F.bool_or(F.col("_before").isNotNull() & opens(micros, F.col("_before.x"))).alias("opens"), F.max(F.struct("ts", "seq", F.col("_end.x").alias("end"))).alias("last")]
    per_bucket = _app_totals(marked, keys, attributes, *more).groupBy(*keys, "bucket").agg(_best(), _apps(), F.sum("changes").alias("app_change_count"), F.bool_or("opens").alias("_opens"), F.min("first.ts").alias("_first"), F.max("last").alias("_last"))
    rows = per_bucket.select(*keys, "bucket", *_of_best(seconds, attributes), "app_change_count", "_a", "_opens", (F.unix_micros("_first") / 1e6).alias("_first"), F.col("_last.end").alias("_last"))
    rows = rows.join(input_activity(samples, keys, seconds), [*keys, "bucket"], "left")
    rows = _look_back(rows, keys, seconds, {w: (f"app_switch_count_last_{name}", f"app_entropy_{name}", f"top2_app_concentration_{name}") for w, name in zip(windows, ("5m", "15m"))})
    order = Window.partitionBy(*keys).orderBy("bucket")
    began = F.when(F.col("_opens") | opens(F.col("_first"), F.lag("_last").over(order)), F.col("bucket"))
    start = F.last("_began", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_began", began).withColumn("session_start", start).drop("_opens", "_first", "_last", "_began").withColumns(_since_start())
    rows = title_repeats(dynamics(dwell(rows, keys), keys), keys)
    return rows.withColumns({
        "bucket_end_ts": F.timestamp_seconds(F.unix_seconds("bucket") + seconds),
        "session_id": session_id(F.col(keys[0]), F.col("session_start")),
        "window_title_bucket": scalars.hash_bucket(F.col("window_title_hash")),
        "schema_version": F.lit(version),
        "schema_hash": F.lit(schema_hash),
        "source_ids": F.array(F.lit("activity"), F.lit("input")),
        **scalars.calendar(F.col("bucket")),
    })


def top_apps(events: DataFrame, start: Column, end: Column, n: int = 5) -> DataFrame:
    inside = events.where((F.col("ts") >= start) & (F.col("ts") < end))
    return inside.groupBy("app_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "app_id").limit(n)


def label_summary(features: DataFrame, keys: Sequence[str], events: DataFrame, n: int = 5) -> DataFrame:
    """Means of input rates, bucket and session counts, and the ``n`` apps with most events of each key."""
    mean = lambda c: scalars.quotient(F.sum(scalars.units(F.col(c), 2)), F.count(c), 2, 2).alias(f"mean_{c}")
    rates = features.groupBy(*keys).agg(mean("keys_per_min"), mean("clicks_per_min"), mean("scroll_events_per_min"), F.count("*").alias("buckets"), F.countDistinct("session_start").alias("sessions"))
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), "app_id")
    ranked = events.groupBy(*keys, "app_id").agg(F.count("*").alias("n")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    apps = F.transform(F.sort_array(F.collect_list(F.struct("rank", "app_id", "n"))), lambda a: F.struct(a.app_id.alias("app_id"), a.n.alias("n")))
    return rates.join(ranked.groupBy(*keys).agg(apps.alias("top_apps")), list(keys), "left")


def label_stats(spans: DataFrame) -> DataFrame:
    """Per day and label: spans and minutes, each span's minutes rounded first."""
    minutes = F.round((F.unix_micros("end_ts") - F.unix_micros("start_ts")) / 60e6, 1)
    return spans.groupBy(F.to_date("start_ts").alias("date"), "label").agg(F.count("*").alias("spans"), F.round(F.sum(minutes), 1).alias("minutes"))


def readiness(features: DataFrame, spans: DataFrame, start: Column, end: Column) -> DataFrame:
    """For each date from start to end: feature rows and spans, zero where there are none."""
    days = features.sparkSession.range(1).select(F.explode(F.sequence(start, end)).alias("date"))
    rows = features.groupBy(F.to_date("bucket").alias("date")).agg(F.count("*").alias("n_rows"))
    marks = spans.groupBy(F.to_date("start_ts").alias("date")).agg(F.count("*").alias("n_spans"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"))
    return days.join(rows, "date", "left").join(marks, "date", "left").fillna(0, ["n_rows", "n_spans"]).fillna("", ["labels"])
