"""A reproducible shuffle into shards by a Feistel permutation of row numbers.

Rows are numbered in the order of their key, whatever files they come from: a range partitioning,
a sort inside its partitions and a written table give a place in each partition, and the sizes
of the partitions (one row for each, brought to the driver) where each begins. Row number r of n goes to
position p(r), a permutation of 0..n-1, and so to shard ``p % shards`` and slot ``p // shards``: sizes
differ by one row at most, slots have no gaps.

The permutation is a Feistel network over a x b >= n numbers, a = ceil(sqrt(n)) and b = ceil(n / a): a
number is a pair, and each round adds a keyed function of one half to the other, modulo that
one's size. Numbers of n or more walk on along their cycle until they are under n. Fewer than
sqrt(n) + 1 numbers can be in the way; they are walked first, as rows, so the steps that
each row needs at most are known and no walk is cut short. All is integer arithmetic on less than 63
bits, so that anyone can compute a row's place (``place_of``) or the row at a place (``row_at``)
from n, the number of shards and the seed alone.

Rows that tie in the key are interchangeable if they are alike in every column of it. The query's key is (doc_id,
size, CRC, a 64-bit digest of the text), so repeated rows are numbered one after another, and a hot key is cut over
several range partitions. Nulls come first; a null text counts as empty. Other columns stay but
``row_number``, ``position``, ``shard`` and ``slot``, which are replaced. Texts may be of any length.
Empty tables give empty ones. An executor that is lost costs its tasks: numbers are read from the written
table and never drawn twice.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import stored

ROUNDS = 8
#: Modulus of the round function; halves are less, up to 2**62 rows.
PRIME = (1 << 31) - 1
#: Place inside a partition, below, and partition, above, in ``monotonically_increasing_id``.
_PLACE_BITS = 33
SHARDS, SEED = 16, 20240101


def _keys(seed: int) -> list[tuple[int, int]]:
    """Factor and summand of each round."""
    digests = [hashlib.sha256(f"{seed}:{k}".encode()).digest() for k in range(ROUNDS)]
    return [(1 + int.from_bytes(d[:8], "big") % (PRIME - 1), int.from_bytes(d[8:16], "big") % PRIME) for d in digests]


def _halves(n: int) -> tuple[int, int]:
    a = math.isqrt(max(n, 1) - 1) + 1
    return a, -(-max(n, 1) // a)


def permuted(row: int, n: int, seed: int = SEED) -> int:
    """The position of a row number."""
    a, b = _halves(n)
    while True:
        x, y = divmod(row, b)
        for k, (m, c) in enumerate(_keys(seed)):
            t = (y * m + c) % PRIME
            x, y = y, (x + t * t % PRIME * t % PRIME) % (b if k % 2 else a)
        row = x * b + y
        if row < n:
            return row


def restored(position: int, n: int, seed: int = SEED) -> int:
    """The row number at a position: the rounds backward."""
    a, b = _halves(n)
    while True:
        x, y = divmod(position, b)
        for k, (m, c) in reversed(list(enumerate(_keys(seed)))):
            t = (x * m + c) % PRIME
            x, y = (y - t * t % PRIME * t % PRIME) % (b if k % 2 else a), x
        position = x * b + y
        if position < n:
            return position


def place_of(row: int, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[int, int]:
    """(shard, slot) of a row number, without any table."""
    position = permuted(row, n, seed)
    return position % shards, position // shards


def row_at(shard: int, slot: int, n: int, shards: int = SHARDS, seed: int = SEED) -> int:
    return restored(slot * shards + shard, n, seed)


def _network(row: Column, n: int, seed: int) -> Column:
    """One pass of a number through the rounds."""
    a, b = _halves(n)
    whole = lambda x: F.lit(x).cast("long")
    rounds = F.array(*[F.struct(whole(m).alias("m"), whole(c).alias("c"), whole(b if k % 2 else a).alias("size")) for k, (m, c) in enumerate(_keys(seed))])

    def step(s: Column, key: Column) -> Column:
        t = (s.y * key.m + key.c) % PRIME
        return F.struct(s.y.alias("x"), ((s.x + t * t % PRIME * t % PRIME) % key["size"]).alias("y"))

    halves = F.struct(F.floor(row / b).cast("long").alias("x"), (row % b).alias("y")) if n < 1 << 52 else F.struct(((row - row % b) / b).cast("long").alias("x"), (row % b).alias("y"))
    return F.aggregate(rounds, halves, step, lambda s: s.x * b + s.y)


def _walks(spark: SparkSession, n: int, seed: int) -> int:
    """Steps that a number under n needs at most: one, and the longest way of a number that is not."""
    a, b = _halves(n)
    steps, outside = 1, spark.range(n, a * b)
    while True:
        images = stored(outside.select(_network(F.col("id"), n, seed).alias("id")))
        # every way that leads back loses its last number in each step; what stays are cycles that no row enters
        if images.where(F.col("id") < n).isEmpty():
            return steps
        steps, outside = steps + 1, images.where(F.col("id") >= n)


def position(row: Column, n: int, seed: int, steps: int) -> Column:
    """The position of a row number as an expression; ``steps`` from ``_walks``."""
    if n == 0:
        return F.lit(None).cast("long")
    walk = lambda x, k: F.when((k == 1) | (x >= n), _network(x, n, seed)).otherwise(x)
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), row, walk)


def numbered(frame: DataFrame, key: Sequence[str]) -> tuple[DataFrame, int]:
    """``frame`` with ``row_number`` from 0 in the order of ``key``, and the number of its rows."""
    spark = frame.sparkSession
    # rows alike in the key are dealt by where they come from, so that no range has to hold them all
    salted = frame.drop("row_number").withColumn("_salt", F.monotonically_increasing_id())
    ranged = salted.repartitionByRange(*key, "_salt").sortWithinPartitions(*key).drop("_salt")
    placed = stored(ranged.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", _PLACE_BITS)
    sizes = sorted((r.part, r.n) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    begins, n = [], 0
    for k, size in sizes:
        begins.append((k, n))
        n += size
    # one row for each range partition
    begin = F.broadcast(spark.createDataFrame(begins, "_part long, _begin long"))
    row = F.col("_begin") + F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return placed.withColumn("_part", part).join(begin, "_part").withColumn("row_number", row).drop("_part", "_begin", "_at"), n


def shuffled(frame: DataFrame, key: Sequence[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``frame`` with ``row_number`` (int64), ``position``, ``shard`` and ``slot`` of each row."""
    rows, n = numbered(frame.drop("position", "shard", "slot"), key)
    placed = rows.withColumn("position", position(F.col("row_number"), n, seed, _walks(frame.sparkSession, n, seed)))
    return placed.withColumns({"shard": (F.col("position") % shards).cast("int"), "slot": F.floor(F.col("position") / shards) if n < 1 << 52 else ((F.col("position") - F.col("position") % shards) / shards).cast("long")})


def write_shards(placed: DataFrame, path: str) -> None:
    """A folder for each shard, its rows in the order of their slots."""
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, by the law ``rows``: counts at most one apart."""
    text = F.coalesce("text", F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("digest"))
    placed = shuffled(docs, ["doc_id", "size", "text_crc32", "digest"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _crc_table() -> list[int]:
    """The CRC of each byte, by its polynomial."""
    table = list(range(256))
    for _ in range(8):
        table = [(c >> 1) ^ (0xEDB88320 if c & 1 else 0) for c in table]
    return table


def _rounds_sql() -> str:
    """The rounds as one common table expression after another; a and b are columns of ``size``."""
    out = "r0 AS (SELECT row, walk, v // b AS x, v % b AS y, n, a, b FROM todo)"
    for k, (m, c) in enumerate(_keys(SEED)):
        half = "b" if k % 2 else "a"
        out += f", t{k} AS (SELECT *, (y * {m} + {c}) % {PRIME} AS t FROM r{k}), r{k + 1} AS (SELECT row, walk, y AS x, (x + t * t % {PRIME} * t % {PRIME}) % {half} AS y, n, a, b FROM t{k})"
    return out


#: Document ids are unique in the tables, so that they alone order the rows here.
OP12_SQL = f"""
WITH RECURSIVE b AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
c AS (SELECT *, list_transform(string_split(rtrim(regexp_replace(hex(encode(text)), '(..)', '\\1,', 'g'), ','), ','), lambda x: ('0x' || x)::BIGINT) AS bytes FROM b WHERE text <> ''),
d AS MATERIALIZED (SELECT doc_id, strlen(text) + 1 AS size, xor(list_reduce(bytes, lambda s, x: xor(s >> 8, ({_crc_table()}::BIGINT[])[(xor(s, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS crc FROM c
      UNION ALL SELECT doc_id, 1, 0 FROM b WHERE text = ''),
q AS (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS a FROM d),
dims AS (SELECT n, a, ((n + a - 1) // a)::BIGINT AS b FROM q),
numbered AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST) - 1 AS row FROM d),
walked AS (
  SELECT row, 0 AS walk, row AS v, n, a, b FROM numbered, dims
  UNION ALL
  (WITH todo AS (SELECT row, walk, v, n, a, b FROM walked WHERE walk = 0 OR v >= n), {_rounds_sql()}
   SELECT row, walk + 1, x * b + y, n, a, b FROM r{ROUNDS})),
done AS (SELECT row, v AS position FROM walked WHERE walk > 0 AND v < n)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'rows' AS law, (position % {SHARDS})::INTEGER AS shard, (position // {SHARDS})::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM numbered JOIN done USING (row)
"""
