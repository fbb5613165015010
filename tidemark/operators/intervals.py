"""Interval joins and label-span maintenance.

Range predicates become equi-joins on time cells: spans are spread over the cells that they
touch, so a join shuffles on (user, cell) and never degenerates to a nested loop. A null user
on a span stands for every user and is handled in a branch of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import scans

CELL = 3600


def _cells(df: DataFrame, start: str, end: str, cell: int) -> DataFrame:
    first = F.floor(F.unix_seconds(start) / cell)
    last = F.greatest(first, F.ceil(F.unix_micros(end) / 1e6 / cell) - 1)
    return df.withColumn("_cell", F.explode(F.sequence(first, last)))


def project_labels(windows: DataFrame, spans: DataFrame, cell: int = CELL) -> DataFrame:
    """Windows (user_id, start, end, ...) that spans of exactly one label wholly cover, with that label."""
    names = windows.columns
    placed = windows.withColumn("_cell", F.floor(F.unix_seconds("start") / cell))
    spread = _cells(spans.select("user_id", "start_ts", "end_ts", "label"), "start_ts", "end_ts", cell).withColumnRenamed("user_id", "_user")
    covers = (F.col("start_ts") <= F.col("start")) & (F.col("end") <= F.col("end_ts"))
    own = placed.join(spread.where("_user IS NOT NULL"), (placed["user_id"] == F.col("_user")) & (placed["_cell"] == spread["_cell"]) & covers).select(*[placed[c] for c in names], "label")
    anyone = placed.join(spread.where("_user IS NULL"), (placed["_cell"] == spread["_cell"]) & covers).select(*[placed[c] for c in names], "label")
    return own.unionByName(anyone).groupBy(*names).agg(F.min("label").alias("label"), F.max("label").alias("_other")).where(F.col("label") == F.col("_other")).drop("_other")


def overlaps(spans: DataFrame, cell: int = 6 * CELL) -> DataFrame:
    """(a, b): sequence numbers of overlapping spans of one user, each pair once; a null user is anyone's."""
    spread = _cells(spans.select("user_id", "start_ts", "end_ts", "seq"), "start_ts", "end_ts", cell)

    def pairs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
        a, b = (side.select(*[F.col(c).alias(f"{name}_{c}") for c in spread.columns]) for side, name in ((left, "a"), (right, "b")))
        same = [F.col(f"a_{k}") == F.col(f"b_{k}") for k in keys]
        meets = (F.col("a_start_ts") < F.col("b_end_ts")) & (F.col("b_start_ts") < F.col("a_end_ts"))
        joined = a.join(b, [*same, meets])
        return joined.select(F.least("a_seq", "b_seq").alias("a"), F.greatest("a_seq", "b_seq").alias("b")).where("a < b")

    owned, anyone = spread.where("user_id IS NOT NULL"), spread.where("user_id IS NULL")
    found = pairs(owned, owned, ["user_id", "_cell"])
    if _has_wildcards(spans):
        found = found.unionByName(pairs(anyone, owned, ["_cell"])).unionByName(pairs(anyone, anyone, ["_cell"]))
    return found.distinct()


def _has_wildcards(spans: DataFrame) -> bool:
    return spans.schema["user_id"].nullable and not spans.where("user_id IS NULL").limit(1).isEmpty()


def overlapping_spans(spans: DataFrame) -> DataFrame:
    """Spans that begin before an earlier one of their user has ended; needs concrete users, one window."""
    order = Window.partitionBy("user_id").orderBy("start_ts", "end_ts", "seq")
    reach = F.max("end_ts").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("_reach", reach).where(F.col("_reach") > F.col("start_ts")).drop("_reach")


def merge_imports(stored: DataFrame, imported: DataFrame) -> DataFrame:
    """One row for each (start, end, user); an imported one wins."""
    both = stored.withColumn("_p", F.lit(0)).unionByName(imported.withColumn("_p", F.lit(1)))
    names = stored.columns
    return both.groupBy("start_ts", "end_ts", "user_id").agg(F.max_by(F.struct(*names), F.struct("_p", "seq")).alias("r")).select("r.*")


def snap_boundaries(new: DataFrame, stored: DataFrame, tolerance_micros: int = 1000) -> DataFrame:
    """New spans whose edges lie within the tolerance of a stored span's edge, moved onto it."""
    def near(frame: DataFrame, edge: str, at: str, to: str) -> DataFrame:
        cell = lambda c: F.floor(F.unix_micros(c) / tolerance_micros)
        edges = stored.select(F.col("user_id").alias("_u"), F.col(edge).alias("_e")).distinct().withColumn("_c", F.explode(F.array(*[cell("_e") + k for k in (-1, 0, 1)])))
        close = F.abs(F.unix_micros("_e") - F.unix_micros(at)) <= tolerance_micros
        hit = frame.withColumn("_at", cell(at)).join(edges, (F.col("user_id") == F.col("_u")) & (F.col("_at") == F.col("_c")) & close, "left")
        return hit.groupBy("seq").agg(F.min_by("_e", F.abs(F.unix_micros("_e") - F.unix_micros(at))).alias(to))

    starts, ends = near(new, "end_ts", "start_ts", "_s"), near(new, "start_ts", "end_ts", "_z")
    joined = new.join(starts, "seq").join(ends, "seq")
    point = F.col("extend_forward") & (F.col("start_ts") == F.col("end_ts"))
    start = F.coalesce("_s", "start_ts")
    end = F.when(point, start).when(F.col("_z") > start, F.col("_z")).otherwise(F.col("end_ts"))
    return joined.withColumns({"start_ts": start, "end_ts": end}).select(*new.columns)


def effective_ends(spans: DataFrame) -> DataFrame:
    """``effective_end`` of extend-forward spans: the next start of their user, not before their end; null is open."""
    order = Window.partitionBy("user_id").orderBy(F.unix_micros("start_ts")).rangeBetween(1, Window.unboundedFollowing)
    following = F.min("start_ts").over(order)
    extended = F.when(following.isNotNull(), F.greatest("end_ts", following))
    return spans.withColumn("effective_end", F.when(F.col("extend_forward"), extended).otherwise(F.col("end_ts")))


def append_spans(stored: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): an extend-forward span ends where the next one of its user starts; new spans that overlap are rejected."""
    both = stored.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))
    order = Window.partitionBy("user_id").orderBy(F.unix_micros("start_ts")).rangeBetween(1, Window.unboundedFollowing)
    following = F.min(F.when(F.col("_new"), F.col("start_ts"))).over(order)
    cut = both.withColumn("end_ts", F.when(F.col("extend_forward") & ~F.col("_new") & following.isNotNull(), following).otherwise(F.col("end_ts")))
    order = Window.partitionBy("user_id").orderBy("start_ts", "_new", "seq")
    before = F.max("end_ts").over(order.rowsBetween(Window.unboundedPreceding, -1))
    later = F.min(F.when(~F.col("_new"), F.col("start_ts"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    clash = F.col("_new") & F.coalesce((before > F.col("start_ts")) | (later < F.col("end_ts")), F.lit(False))
    judged = cut.withColumn("_clash", clash)
    return judged.where("NOT _clash").drop("_new", "_clash"), judged.where("_clash").drop("_new", "_clash")


def overwrite(stored: DataFrame, new: DataFrame, cell: int = 6 * CELL) -> DataFrame:
    """Stored spans minus the new ones of their user (truncated, split or gone), and the new ones."""
    spread = _cells(stored.select("user_id", "start_ts", "end_ts", "seq"), "start_ts", "end_ts", cell)
    other = _cells(new.select(F.col("user_id").alias("_u"), F.col("start_ts").alias("_s"), F.col("end_ts").alias("_e")), "_s", "_e", cell).withColumnRenamed("_cell", "_cell2")
    hits = spread.join(other, (F.col("user_id") == F.col("_u")) & (F.col("_cell") == F.col("_cell2")) & (F.col("start_ts") < F.col("_e")) & (F.col("_s") < F.col("end_ts"))).select("seq", "start_ts", "end_ts", "_s", "_e").distinct()
    # the holes of a span in order; what lies between the reach of earlier holes and the next one stays
    order = Window.partitionBy("seq", "start_ts", "end_ts").orderBy("_s", "_e")
    reach = F.greatest(F.col("start_ts"), F.coalesce(F.max("_e").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("start_ts")))
    gaps = hits.withColumn("_from", reach).select("seq", F.col("_from").alias("a"), F.col("_s").alias("z")).where("a < z")
    tails = hits.groupBy("seq", "start_ts", "end_ts").agg(F.max("_e").alias("a")).where("a < end_ts").select("seq", "a", F.col("end_ts").alias("z"))
    pieces = stored.join(gaps.unionByName(tails), "seq").withColumns({"start_ts": F.col("a"), "end_ts": F.col("z")}).select(*stored.columns)
    return stored.join(hits.select("seq").distinct(), "seq", "left_anti").select(*stored.columns).unionByName(pieces).unionByName(new.select(*stored.columns))


def update_labels(spans: DataFrame, changes: DataFrame) -> DataFrame:
    """New labels by (start, end, user)."""
    keys = ["start_ts", "end_ts", "user_id"]
    return spans.join(changes.select(*keys, F.col("label").alias("_l")), keys, "left").withColumn("label", F.coalesce("_l", "label")).drop("_l").select(*spans.columns)


def delete_spans(spans: DataFrame, gone: DataFrame) -> DataFrame:
    return spans.join(gone, ["start_ts", "end_ts", "user_id"], "left_anti").select(*spans.columns)


def covered(candidates: DataFrame, spans: DataFrame, cell: int = 6 * CELL) -> DataFrame:
    """Candidates that lie inside an extend-forward span's effective range.

    Closed ranges are spread over time cells. An open range has no end and no cells: only the
    spans with a user's latest start can be open, so they join on the user as one row, the start.
    """
    reach = effective_ends(spans).where("extend_forward").select(F.col("user_id").alias("_u"), F.col("start_ts").alias("_s"), F.col("effective_end").alias("_e"))
    closed = _cells(reach.where("_e IS NOT NULL"), "_s", "_e", cell)
    placed = candidates.withColumn("_at", F.floor(F.unix_seconds("start_ts") / cell))
    inside = (F.col("user_id") == F.col("_u")) & (F.col("_at") == F.col("_cell")) & (F.col("_s") <= F.col("start_ts")) & (F.col("end_ts") <= F.col("_e"))
    opened = reach.where("_e IS NULL").groupBy(F.col("_u").alias("_ou")).agg(F.min("_s").alias("_os"))
    held = placed.join(opened, F.col("user_id") == F.col("_ou"), "left").withColumn("_open", F.coalesce(F.col("_os") <= F.col("start_ts"), F.lit(False)))
    return held.where("_open").select(*candidates.columns).unionByName(held.where("NOT _open").join(closed, inside, "left_semi").select(*candidates.columns))


def current_labels(spans: DataFrame, at: Column) -> DataFrame:
    """The label of each user at an instant: extend-forward spans that reach it, the latest start wins."""
    live = effective_ends(spans).where(F.col("extend_forward") & (F.col("start_ts") <= at) & (F.col("effective_end").isNull() | (at < F.col("effective_end"))))
    return live.groupBy("user_id").agg(F.max_by("label", F.struct("start_ts", "seq")).alias("label"))


def labels_at(instants: DataFrame, spans: DataFrame, at: str = "at", cell: int = 6 * CELL) -> DataFrame:
    """(user_id, at, ...) rows with their user's ``label`` at that time: ``current_labels`` for many instants of many users.

    An as-of join finds the latest extend-forward span that has begun; where that one has ended, an earlier one may still
    last, and those instants alone meet the spans over time cells.
    """
    live = effective_ends(spans).where("extend_forward").select("user_id", "start_ts", "seq", F.col("label").alias("_label"), "effective_end")
    found = scans.asof(instants, live, ["user_id"], at, "start_ts", ["_label", "effective_end"], ["seq"])
    current = F.col("effective_end").isNull() | (F.col(at) < F.col("effective_end"))
    judged = found.withColumns({"_ended": ~current, "label": F.when(current, F.col("_label"))}).drop("_label", "effective_end")
    ended = judged.where("_ended").select("user_id", F.col(at).alias("_at")).distinct().withColumn("_cell", F.floor(F.unix_seconds("_at") / cell))
    # only the last span of a user is open, and it never has ended
    lasting = _cells(live.where("effective_end IS NOT NULL"), "start_ts", "effective_end", cell).withColumnRenamed("user_id", "_user")
    met = ended.join(lasting, F.col("user_id").eqNullSafe(F.col("_user")) & (ended["_cell"] == lasting["_cell"]) & (F.col("start_ts") <= F.col("_at")) & (F.col("_at") < F.col("effective_end")))
    earlier = met.groupBy("_user", "_at").agg(F.max_by("_label", F.struct("start_ts", "seq")).alias("_earlier"))
    joined = judged.join(earlier, F.col("user_id").eqNullSafe(F.col("_user")) & (F.col(at) == F.col("_at")), "left")
    return joined.withColumn("label", F.coalesce("label", "_earlier")).drop("_ended", "_user", "_at", "_earlier")


def enqueue(predictions: DataFrame, pending: DataFrame, threshold: float = 0.55) -> DataFrame:
    """Low-confidence buckets that no pending request names, once each."""
    low = predictions.where(F.col("confidence") < threshold)
    fresh = low.join(pending, ["user_id", "bucket"], "left_anti")
    return fresh.groupBy("user_id", "bucket").agg(F.min("confidence").alias("confidence"), F.min_by("predicted", "confidence").alias("predicted_label")).withColumns({"reason": F.lit("low_confidence"), "status": F.lit("pending")})


def enqueue_drift(flagged: DataFrame, pending: DataFrame) -> DataFrame:
    """Buckets that a drift alert has flagged and no pending request names, once each, whatever their confidence; the least one is kept."""
    fresh = flagged.join(pending, ["user_id", "bucket"], "left_anti")
    return fresh.groupBy("user_id", "bucket").agg(F.min("confidence").alias("confidence"), F.min_by("predicted", "confidence").alias("predicted_label")).withColumns({"reason": F.lit("drift"), "status": F.lit("pending")})


def serve_queue(queue: DataFrame, cap: int, limit: int, served: int = 0) -> DataFrame:
    """Pending requests by rising confidence (missing is 0), within the day's cap and the limit."""
    order = [F.coalesce("confidence", F.lit(0.0)), "user_id", "bucket"]
    return queue.where("status = 'pending'").orderBy(*order).limit(max(0, min(cap - served, limit)))


def mark_done(queue: DataFrame, done: DataFrame, status: str = "labeled") -> DataFrame:
    """Requests of ``done`` get the status labeled or skipped."""
    if status not in ("labeled", "skipped"):
        raise ValueError(f"unknown status {status}")
    keys = ["user_id", "bucket"]
    return queue.join(done.select(*keys).distinct().withColumn("_d", F.lit(status)), keys, "left").withColumn("status", F.coalesce("_d", "status")).drop("_d").select(*queue.columns)


def interval_accuracy(predicted: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """Share of predicted segments for which a gold one starts at the same time with the same label."""
    hit = predicted.select(*keys, "start_ts", "label").join(gold.select(*keys, "start_ts", F.col("label").alias("_g")), [*keys, "start_ts"], "left")
    return hit.agg(F.count("*").alias("segments"), F.round(F.avg(F.coalesce(F.col("label") == F.col("_g"), F.lit(False)).cast("int")), 6).alias("accuracy"))
