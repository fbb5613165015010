"""Distribution drift and telemetry.

Features are unpivoted once and everything is grouped by feature. Exact quantiles and the
two-sample statistic come from counts of distinct values and their running sums over ranges
of values, so no window and no aggregate holds all values of a feature in one task. Telemetry that is to be compared
again and again keeps a mergeable sketch of each day instead.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.sources import scratch

EPS = 1e-8
#: Size of a quantile sketch, and what its quantiles keep to in rank.
SKETCH_SIZE, SKETCH_ERROR = 400, 0.015


def unpivot(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(feature, value) rows without nulls and NaN."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features]))
    return df.select(*keep, each.alias("x")).select(*keep, "x.*").where("value IS NOT NULL AND NOT isnan(value)")


def running_sums(values: DataFrame, sums: Sequence[str]) -> DataFrame:
    """(feature, value, sums...) of distinct values, with ``before_`` columns: the sums over all smaller values of the feature.

    The values are dealt out once, by ranges of (feature, value), and written; each range is summed by itself, and the sums of
    the ranges before it, one row for each range and feature, are joined to it.
    """
    path = scratch.folder(values.sparkSession, "ranges")
    values.select("feature", "value", *sums).repartitionByRange("feature", "value").withColumn("_part", F.spark_partition_id()).write.parquet(path)
    ranges = values.sparkSession.read.parquet(path)
    totals = ranges.groupBy("feature", "_part").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    order = Window.partitionBy("feature").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = totals.select("feature", "_part", *[F.coalesce(F.sum(f"_{c}").over(order), F.lit(0)).alias(f"_{c}") for c in sums])
    inner = Window.partitionBy("feature", "_part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    within = ranges.withColumns({f"before_{c}": F.coalesce(F.sum(c).over(inner), F.lit(0)) for c in sums})
    return within.join(F.broadcast(ahead), ["feature", "_part"]).select("feature", "value", *sums, *[(F.col(f"before_{c}") + F.col(f"_{c}")).alias(f"before_{c}") for c in sums])


def _quantiles(ranked: DataFrame, shares: Sequence[float], n: str) -> DataFrame:
    """(feature, quantiles, n) from distinct values with their counts ``n`` and the counts before them."""
    sizes = ranked.groupBy("feature").agg(F.sum(n).alias("size")).where("size > 0")
    places = F.array(*[F.lit(float(q)) * (F.col("size") - 1) for q in shares])
    wanted = sizes.select("feature", "size", places.alias("places")).withColumn("ranks", F.array_distinct(F.flatten(F.transform("places", lambda p: F.array(F.floor(p), F.ceil(p))))))
    met = ranked.join(F.broadcast(wanted), "feature").select("feature", "size", "places", "value", F.explode(F.filter("ranks", lambda r: (r >= F.col(f"before_{n}")) & (r < F.col(f"before_{n}") + F.col(n)))).alias("rank"))
    found = met.groupBy("feature").agg(F.first("size").alias("n"), F.first("places").alias("places"), F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))
    low, high = lambda p: F.element_at("at", F.floor(p)), lambda p: F.element_at("at", F.ceil(p))
    between = lambda p: F.when(F.floor(p) == F.ceil(p), low(p)).otherwise((F.ceil(p) - p) * low(p) + (p - F.floor(p)) * high(p))
    return found.select("feature", F.transform("places", between).alias("quantiles"), "n")


def quantiles(values: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(feature, quantiles, n): exact quantiles of (feature, value), interpolated between neighbours."""
    return _quantiles(running_sums(values.groupBy("feature", "value").agg(F.count("*").alias("n")), ["n"]), shares, "n")


def _counted(reference: DataFrame, current: DataFrame) -> DataFrame:
    """(feature, value, r, c): how often each distinct value occurs in either table."""
    both = reference.withColumn("_r", F.lit(1)).unionByName(current.withColumn("_r", F.lit(0)))
    return both.groupBy("feature", "value").agg(F.sum("_r").alias("r"), F.sum(1 - F.col("_r")).alias("c"))


def _binned(values: DataFrame, edges: DataFrame) -> DataFrame:
    """(feature, bin, r, c): sums of the values between the edges of their feature."""
    placed = values.join(F.broadcast(edges), "feature")
    inside = placed.where((F.col("value") >= F.get("edges", F.lit(0))) & (F.col("value") <= F.element_at("edges", -1)))
    bin_ = F.least(F.size(F.filter("edges", lambda e: e <= F.col("value"))) - 1, F.greatest(F.size("edges") - 2, F.lit(0)))
    return inside.groupBy("feature", bin_.alias("bin")).agg(F.sum("r").alias("r"), F.sum("c").alias("c"))


def _psi(binned: DataFrame, edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """PSI from (feature, bin, r, c), edges with ``n_ref`` and ``n_cur`` rows of each feature."""
    totals = binned.groupBy("feature").agg(F.sum("r").alias("tr"), F.sum("c").alias("tc"))
    # every bin counts, those that neither sample fills too (they add nothing)
    share = lambda n, t: F.greatest(F.coalesce(F.try_divide(n, t), F.lit(0.0)), F.lit(EPS))
    term = (share("c", "tc") - share("r", "tr")) * F.ln(share("c", "tc") / share("r", "tr"))
    sums = binned.join(totals, "feature").groupBy("feature").agg(F.sum(term).alias("psi"))
    known = edges.join(sizes, "feature", "left").join(sums, "feature", "left")
    enough = (F.size("edges") >= 2) & (F.col("n_ref") >= 2) & (F.coalesce("n_cur", F.lit(0)) >= 2)
    return known.select("feature", F.when(enough, F.coalesce("psi", F.lit(0.0))).otherwise(0.0).alias("psi"))


def psi(reference: DataFrame, current: DataFrame, bins: int = 10, ranked: DataFrame | None = None) -> DataFrame:
    """Population stability index of each feature of (feature, value) tables.

    Edges are distinct quantiles of the reference; values beyond them are left out, the last
    bin is closed. Fewer than two values or edges give 0. Everything comes from one count of distinct values.
    """
    ranked = running_sums(_counted(reference, current), ["r", "c"]) if ranked is None else ranked
    edges = _quantiles(ranked, [k / bins for k in range(bins + 1)], "r").select("feature", F.array_distinct("quantiles").alias("edges"), F.col("n").alias("n_ref"))
    return _psi(_binned(ranked, edges), edges, ranked.groupBy("feature").agg(F.sum("c").alias("n_cur")))


def daily_sketches(values: DataFrame, day: str = "date", k: int = SKETCH_SIZE) -> DataFrame:
    """(day, feature, n, sketch): a KLL quantile sketch of each day's values, some kilobytes whatever their number.

    With the default size a quantile's rank is wrong by less than ``SKETCH_ERROR`` of all rows, merged over any number of days (the
    library's bound for 99 of 100 quantiles is 0.7 %).
    """
    return values.groupBy(day, "feature").agg(F.count("value").alias("n"), F.kll_sketch_agg_double("value", k).alias("sketch"))


def merged(sketches: DataFrame) -> DataFrame:
    """(feature, n, sketch) over all days of a table of sketches; the rows behind them are not read again."""
    return sketches.groupBy("feature").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketched_quantiles(sketches: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(feature, quantiles, n) of the days' sketches, within ``SKETCH_ERROR`` in rank; ``quantiles`` is the exact way."""
    return merged(sketches).select("feature", F.array(*[F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))) for q in shares]).alias("quantiles"), "n")


def sketched_psi(reference: DataFrame, current: DataFrame, bins: int = 10, grid: int = 1000) -> DataFrame:
    """PSI of two tables of sketches: edges from the reference's quantiles, bins from ``grid`` quantiles of either.

    A bin's share is off by two rank errors and 1 / ``grid`` at most.
    """
    edges = sketched_quantiles(reference, [k / bins for k in range(bins + 1)]).select("feature", F.array_distinct("quantiles").alias("edges"), F.col("n").alias("n_ref"))
    ranks = F.array(*[F.lit((k + 0.5) / grid) for k in range(grid)])
    points = lambda t, r, c: merged(t).select("feature", F.explode(F.kll_sketch_get_quantile_double("sketch", ranks)).alias("value"), F.lit(r).alias("r"), F.lit(c).alias("c"))
    counts = _binned(points(reference, 1, 0).unionByName(points(current, 0, 1)), edges)
    return _psi(counts, edges, current.groupBy("feature").agg(F.sum("n").alias("n_cur")))


def ks(reference: DataFrame, current: DataFrame, ranked: DataFrame | None = None) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic and asymptotic p-value of each feature."""
    ranked = running_sums(_counted(reference, current), ["r", "c"]) if ranked is None else ranked
    sizes = ranked.groupBy("feature").agg(F.sum("r").alias("nr"), F.sum("c").alias("nc"))
    run = ranked.join(F.broadcast(sizes), "feature")
    gap = F.abs(F.try_divide(F.col("before_r") + F.col("r"), F.col("nr")) - F.try_divide(F.col("before_c") + F.col("c"), F.col("nc")))
    found = run.groupBy("feature").agg(F.max(gap).alias("d"), F.first("nr").alias("nr"), F.first("nc").alias("nc"))
    enough = (F.col("nr") >= 2) & (F.col("nc") >= 2)
    return found.select("feature", F.when(enough, F.col("d")).otherwise(0.0).alias("statistic"), F.when(enough, kolmogorov(F.col("d"), F.col("nr"), F.col("nc"))).otherwise(1.0).alias("p_value"))


def kolmogorov(d: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """Asymptotic survival probability 2 sum (-1)^(k-1) exp(-2 k^2 x^2) with x = d sqrt(nm / (n + m))."""
    x2 = d * d * n * m / (n + m)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda t, k: t + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2 * k * k * x2))
    return F.when(x2 < 0.04, 1.0).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))


def kolmogorov_scalar(d: float, n: int, m: int) -> float:
    """The same in plain Python, for tests."""
    x2 = d * d * n * m / (n + m)
    return 1.0 if x2 < 0.04 else min(1.0, max(0.0, sum((2 if k % 2 else -2) * math.exp(-2 * k * k * x2) for k in range(1, 101))))


def feature_drift(reference: DataFrame, current: DataFrame, features: Sequence[str], psi_limit: float = 0.2, alpha: float = 0.05) -> DataFrame:
    """PSI, KS statistic and p-value of each feature, and whether either tells drift."""
    a, b = unpivot(reference, features), unpivot(current, features)
    ranked = running_sums(_counted(a, b), ["r", "c"])
    return psi(a, b, ranked=ranked).join(ks(a, b, ranked), "feature").withColumn("drifted", (F.col("psi") > psi_limit) | (F.col("p_value") < alpha))


def reject_increase(reference: DataFrame, current: DataFrame, column: str = "predicted", rejected: str = "Mixed/Unknown", limit: float = 0.10) -> DataFrame:
    rate = lambda df, name: df.agg(F.avg((F.col(column) == rejected).cast("int")).alias(name))
    both = rate(reference, "a").join(F.broadcast(rate(current, "b")))
    return both.select(F.round("a", 4).alias("reference"), F.round("b", 4).alias("current"), (F.col("b") - F.col("a") >= limit).alias("flagged"))


def entropy_spike(reference: DataFrame, current: DataFrame, probs: str = "probs", times: float = 2.0) -> DataFrame:
    mean = lambda df, name: df.agg(F.avg(scalars.entropy(F.col(probs))).alias(name))
    both = mean(reference, "a").join(F.broadcast(mean(current, "b")))
    return both.select(F.round("a", 4).alias("reference"), F.round("b", 4).alias("current"), ((F.col("a") > 1e-8) & (F.col("b") > times * F.col("a"))).alias("flagged"))


def class_shift(reference: DataFrame, current: DataFrame, column: str = "predicted", limit: float = 0.15) -> DataFrame:
    """Shares of each class before and after, rounded first; flagged beyond the limit."""
    def shares(df: DataFrame, name: str) -> DataFrame:
        counts = df.groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n"))
        return counts.join(F.broadcast(df.agg(F.count("*").alias("t")))).select("label", F.round(F.col("n") / F.col("t"), 4).alias(name))

    both = shares(reference, "reference").join(shares(current, "current"), "label", "full").fillna(0.0, ["reference", "current"])
    return both.withColumn("flagged", F.abs(F.col("current") - F.col("reference")) > limit)


def alerts(reference: DataFrame, current: DataFrame, features: Sequence[str], psi_limit: float = 0.2, alpha: float = 0.05) -> DataFrame:
    """(trigger, subject, value, severity) of every check that tells drift."""
    drift = feature_drift(reference, current, features, psi_limit, alpha).where("drifted")
    rows = drift.select(F.when(F.col("psi") > psi_limit, "feature_psi").otherwise("feature_ks").alias("trigger"), F.col("feature").alias("subject"), F.round("psi", 4).alias("value"), F.when(F.col("psi") > 2 * psi_limit, "critical").otherwise("warning").alias("severity"))
    reject = reject_increase(reference, current).where("flagged").select(F.lit("reject_rate").alias("trigger"), F.lit("").alias("subject"), F.col("current").alias("value"), F.lit("critical").alias("severity"))
    spike = entropy_spike(reference, current).where("flagged").select(F.lit("entropy").alias("trigger"), F.lit("").alias("subject"), F.col("current").alias("value"), F.lit("warning").alias("severity"))
    shift = class_shift(reference, current).where("flagged").select(F.lit("class_shift").alias("trigger"), F.col("label").alias("subject"), F.col("current").alias("value"), F.lit("warning").alias("severity"))
    return rows.unionByName(reject).unionByName(spike).unionByName(shift)


def lowest_confidence(predictions: DataFrame, alert_rows: DataFrame, n: int = 50) -> DataFrame:
    """The least confident rows, if there is any alert."""
    any_alert = alert_rows.agg((F.count("*") > 0).alias("_any"))
    return predictions.orderBy("confidence", "vec_id").limit(n).join(F.broadcast(any_alert)).where("_any").drop("_any")


def class_shares(df: DataFrame, label: str = "predicted", ts: str | None = None) -> DataFrame:
    """One row: rows, first and last window where ``ts`` is given, reject rate, and the share of each label as a map."""
    span = [F.min("first").alias("first_window"), F.max("last").alias("last_window")] if ts else []
    per = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"), *([F.min(ts).alias("first"), F.max(ts).alias("last")] if ts else []))
    counted = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), *span, F.coalesce(F.sum(F.when(F.col("label") == "Mixed/Unknown", F.col("n"))), F.lit(0)).alias("_r"), F.sort_array(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("label", "n")))).alias("_c"))
    # one row for each label
    shares = F.map_from_entries(F.transform("_c", lambda c: F.struct(c.label, scalars.quotient(c.n, F.col("rows"), 4))))
    return counted.select("rows", *(["first_window", "last_window"] if ts else []), F.when(F.col("rows") > 0, scalars.quotient(F.col("_r"), F.col("rows"), 4)).otherwise(0.0).alias("reject_rate"), shares.alias("class_shares"))


def snapshot(df: DataFrame, features: Sequence[str], probs: str = "probs", ts: str | None = None) -> DataFrame:
    """One row: rows, missing rates, confidence statistics, reject rate, mean entropy, class shares; first and last window where ``ts`` is given."""
    spread = quantiles(unpivot(df, ["confidence"]), [0.5, 0.05, 0.95]).select(F.col("quantiles").alias("_q"))
    missing = [F.round(F.avg(F.col(f).isNull().cast("int")), 4).alias(f"missing_{f}") for f in features]
    r = lambda c, name: F.round(c, 6).alias(name)
    whole = df.agg(F.count("*").alias("rows"), *missing, r(F.avg("confidence"), "confidence_mean"), r(F.stddev_pop("confidence"), "confidence_std"), r(F.avg((F.col("predicted") == "Mixed/Unknown").cast("int")), "reject_rate"), r(F.avg(scalars.entropy(F.col(probs))), "mean_entropy"))
    shares = class_shares(df, "predicted", ts).drop("rows", "reject_rate")
    # all sides have at most one row
    return whole.join(spread, how="left").join(shares, how="left").select(*whole.columns, *[r(F.get("_q", F.lit(k)), f"confidence_{name}") for k, name in enumerate(("median", "p5", "p95"))], *shares.columns)


def suggestions_per_day(predictions: DataFrame, start: Column, end: Column) -> DataFrame:
    """Accepted predictions of each day, days without any included."""
    days = predictions.sparkSession.range(1).select(F.explode(F.sequence(start, end)).alias("date"))
    counts = predictions.where("predicted <> 'Mixed/Unknown'").groupBy("date").agg(F.count("*").alias("suggestions"))
    return days.join(counts, "date", "left").fillna(0, ["suggestions"]).withColumn("none", F.col("suggestions") == 0)
