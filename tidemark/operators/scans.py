"""Ordered scans in two levels: within blocks of the order, and over one row for each block.

A window over a key's whole history is one task however long the history is. Here a key is cut into blocks of time, or all
rows into ranges of values: each is scanned by itself, what it hands on to the next is one row, and those few
rows are scanned and joined back. Keys may be null; null keys belong together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources import scratch

#: Seconds of a key's history that one task scans.
BLOCK_SECONDS = 86_400
_PLACE_BITS = 33


def _block(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(ts) / (seconds * 1_000_000))


def _joined(rows: DataFrame, edges: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``value`` of ``edges`` (keys, _block, value) at the rows of its block."""
    names = {k: f"_edge_{n}" for n, k in enumerate([*keys, "_block"])}
    renamed = edges.select(*[F.col(k).alias(n) for k, n in names.items()], value)
    same = [rows[k].eqNullSafe(renamed[n]) for k, n in names.items()]
    return rows.join(renamed, same, "left").drop(*names.values())


def previous(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, to: str, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """``value`` of the row before, by ``order``, whose first column is a time; null at a key's first row."""
    blocked = rows.withColumns({"_block": _block(F.col(order[0]), block_seconds), "_value": F.struct(value.alias("x"))})
    edges = blocked.groupBy(*keys, "_block").agg(F.max_by("_value", F.struct(*order)).alias("_last"))
    carried = edges.withColumn("_before", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_block")))
    inside = blocked.withColumn("_inside", F.lag("_value").over(Window.partitionBy(*keys, "_block").orderBy(*order)))
    return _joined(inside, carried, keys, "_before").withColumn(to, F.coalesce("_inside", "_before")["x"]).drop("_block", "_value", "_inside", "_before")


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, since: str, values: Sequence[str], ties: Sequence[str] = (), block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """``left`` with ``values`` of the latest row of ``right`` whose ``since`` is not after ``at``; of equal ones the last by ``ties``.

    Both sides are one union, scanned in order within blocks of time; a block hands on the last row of ``right`` in it or before it.
    Each side is shuffled once, whatever the number of instants.
    """
    whole = F.struct(*[F.col(c).alias(f"c{n}") for n, c in enumerate(left.columns)])
    kind = left.select(whole.alias("x")).schema["x"].dataType
    found = right.select(*keys, F.col(since).alias("_t"), F.struct(*[F.col(c).alias(f"t{n}") for n, c in enumerate(ties)], F.struct(*values).alias("v")).alias("_right"), F.lit(None).cast(kind).alias("_left"))
    asked = left.select(*keys, F.col(at).alias("_t"), F.lit(None).cast(found.schema["_right"].dataType).alias("_right"), whole.alias("_left"))
    tie = [F.col(f"_right.t{n}") for n in range(len(ties))]
    both = found.unionByName(asked).withColumns({"_block": _block(F.col("_t"), block_seconds), "_asked": F.col("_left").isNotNull()})
    # rows of right before rows of left at one time, so that what begins at an instant counts
    order = Window.partitionBy(*keys, "_block").orderBy("_t", "_asked", *tie).rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("_inside", F.last("_right", ignorenulls=True).over(order)).where("_asked")
    edges = both.where("NOT _asked").groupBy(*keys, "_block").agg(F.max_by("_right", F.struct("_t", *tie)).alias("_last"))
    blocks = both.select(*keys, "_block").distinct()
    handed = _joined(blocks, edges, keys, "_last")
    before = F.last("_last", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    carried = handed.withColumn("_before", before)
    latest = _joined(inside, carried, keys, "_before").withColumn("_found", F.coalesce("_inside", "_before"))
    return latest.select(*[F.col(f"_left.c{n}").alias(c) for n, c in enumerate(left.columns)], *[F.col(f"_found.v.{c}").alias(c) for c in values])


def numbered(rows: DataFrame, order: Sequence[str], to: str) -> DataFrame:
    """``to``: the place of each row in ``order``, from 0, over all rows.

    Ranges of values are sorted by themselves and written; the size of each, a row for each range, tells where the next begins.
    """
    spark = rows.sparkSession
    path = scratch.folder(spark, "numbered")
    rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    placed = spark.read.parquet(path).withColumn("_part", F.shiftrightunsigned("_at", _PLACE_BITS))
    begins, n = [], 0
    for r in sorted(placed.groupBy("_part").agg(F.count("*").alias("n")).collect()):
        begins.append((r["_part"], n))
        n += r["n"]
    begin = F.broadcast(spark.createDataFrame(begins, "_part long, _begin long"))
    return placed.join(begin, "_part").withColumn(to, F.col("_begin") + F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))).drop("_part", "_begin", "_at")
