"""Hard negatives of anchors, found through bounds along spanning trees of the anchors.

Vectors become integers (floor(256 x)), scores their inner products. An anchor's positives are the rows
of its label with the highest scores; the negatives of a positive are the best rows of other
labels in a window of scores below it. A minimum spanning tree joins the anchors of a block that share a label.
From a score s at an anchor, a candidate c has a score at the child within s +- d |c|, d being the
length of the edge; where the window (or the best scores so far) does not overlap that interval, the
candidate is not scored at the child, and the interval, widened, goes on to the
grandchildren. What overlaps is scored exactly, so the bounds decide about work and never about results. An edge longer than
``REACH`` times the child's norm can exclude nothing and is cut: what stands below is a root, and all roots of a block
are scored in one matrix product.

Anchors lie in blocks of at most ``BLOCK_ROWS`` rows and ``BLOCK_BYTES``, ordered by label and by the signs of
some projections, so that near anchors share a block; trees are built block by block in tasks. A
pass takes ``PASS_BLOCKS`` blocks, at most 16 MB, to all tasks and reads the candidates twice: for the positives, whose scores set the windows,
then for the negatives. More anchors take more passes. Each task keeps the best few of an anchor over
all its candidates, and Spark merges those of the tasks, so that no group of candidates is ever gathered.

Rows take part that have an id, a label and a vector of finite components; a component of 2**18 or more takes its row
out as well, as sums of 2**10 products might not fit 64 bits. Vectors of another length than the anchor's have no score with
it. Ties go to the smaller id. Rows that repeat an id, a label and a score count once for an anchor, and rows with
the anchor's own id are no positives and no negatives of it; an anchor id with several vectors or labels is an anchor for each of
them. No positives or no negatives: no rows. Other columns are not carried; empty tables give empty ones. A lost executor costs
its tasks: anchors and their trees are read from a written table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import mapped, stored

BLOCK_ROWS, BLOCK_BYTES = 1024, 256 << 10
#: Blocks of anchors that the driver and each worker hold at once.
PASS_BLOCKS = 64
#: Edges longer than so many norms of the child exclude nothing.
REACH = 0.5
_LARGEST = 1 << 18
_PLANES = 16
#: Candidates that are scored at once.
_AT_ONCE = 4096

ANCHORS = "dim INT, n INT, ids BINARY, labels BINARY, vectors BINARY, parents BINARY, edges BINARY"
_FOUND = "anchor_row LONG, anchor_id LONG, slot INT, score LONG, id LONG"


def quantised(ids: pa.Array, labels: pa.Array, vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, integer vectors as doubles) of the rows that take part, one triple for each length of vectors."""
    lists = vectors.cast(pa.large_list(pa.float64()))
    whole = np.array(ids.is_valid()) & np.array(labels.is_valid()) & np.array(lists.is_valid())
    lengths = np.array(pa.compute.list_value_length(lists).fill_null(-1))
    numbers, names = np.array(ids.cast(pa.int64()).fill_null(0)), np.array(labels.cast(pa.int64()).fill_null(0))
    for dim in np.unique(lengths[whole]).tolist():
        at = np.flatnonzero(whole & (lengths == dim))
        # null components become NaN
        flat = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        values = np.floor(flat.astype(np.float64).reshape(len(at), dim) * 256)
        fits = (np.abs(values) < _LARGEST).all(axis=1)  # false for NaN
        if fits.any():
            yield numbers[at[fits]], names[at[fits]], values[fits]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Candidates of one length in pieces of ``_AT_ONCE`` rows, the last ones smaller."""
    held: dict[int, list] = {}
    for batch in batches:
        for ids, labels, values in quantised(*batch.columns):
            rows = held.setdefault(values.shape[1], [])
            rows.append((ids, labels, values))
            if sum(len(x[0]) for x in rows) >= _AT_ONCE:
                yield tuple(np.concatenate(x) for x in zip(*held.pop(values.shape[1])))
    for rows in held.values():
        yield tuple(np.concatenate(x) for x in zip(*rows))


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge length) of a minimum spanning tree, parents before children, the first one the root (-1)."""
    n = len(vectors)
    order, parent, near = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.full(n, np.inf)
    left = np.ones(n, bool)
    at = 0
    for k in range(n):
        order[k], left[at] = at, False
        distance = np.sqrt(np.square(vectors - vectors[at]).sum(axis=1))
        closer = left & (distance < near)
        near[closer], parent[closer] = distance[closer], at
        at = int(np.argmin(np.where(left, near, np.inf)))
    near[0] = 0
    return order, parent[order], near[order]


def _block(ids: list, labels: list, vectors: list, reach: float = REACH) -> dict:
    """A block in the order of its trees: parents are places in the block, -1 for roots."""
    ids, labels, vectors = np.array(ids), np.array(labels), np.array(vectors)
    norms = np.sqrt(np.square(vectors).sum(axis=1))
    order, parents, edges = [], [], []
    for label in np.unique(labels).tolist():
        mine = np.flatnonzero(labels == label)
        place, parent, edge = spanning_tree(vectors[mine])
        where = np.zeros(len(mine), np.int64)
        where[place] = len(order) + np.arange(len(mine))
        cut = (parent < 0) | (edge > reach * norms[mine[place]])
        parents.extend(np.where(cut, -1, where[parent]).tolist())
        edges.extend(np.where(cut, 0.0, edge).tolist())
        order.extend(mine[place].tolist())
    pack = lambda x, kind: np.ascontiguousarray(x, kind).tobytes()
    return {"dim": vectors.shape[1], "n": len(ids), "ids": pack(ids[order], np.int64), "labels": pack(labels[order], np.int64), "vectors": pack(vectors[order], np.int32), "parents": pack(parents, np.int32), "edges": pack(edges, np.float64)}


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Integer vectors with the signs of their projections on random directions, as one number."""
    for batch in batches:
        for ids, labels, values in quantised(*batch.columns):
            planes = np.random.default_rng(values.shape[1]).normal(size=(values.shape[1], _PLANES))
            signs = (values @ planes > 0) @ (1 << np.arange(_PLANES))[::-1]
            flat = pa.array(values.astype(np.int32).ravel())
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * values.shape[1]), flat)
            yield pa.record_batch([pa.array(ids), pa.array(labels), pa.array(np.full(len(ids), values.shape[1], np.int32)), pa.array(signs.astype(np.int32)), vectors], ["id", "label", "dim", "signs", "vector"])


def _blocks(block_rows: int, reach: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def flush(ids: list, labels: list, vectors: list) -> pa.RecordBatch:
        made = _block(ids, labels, vectors, reach)
        ids.clear(), labels.clear(), vectors.clear()
        return pa.RecordBatch.from_pylist([made], pa.schema([(k, pa.int32() if k in ("dim", "n") else pa.binary()) for k in made]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vectors = [], [], []
        for batch in batches:
            for id_, label, vector in zip(batch.column("id").to_pylist(), batch.column("label").to_pylist(), batch.column("vector")):
                vector = np.array(vector.values, np.float64)
                if ids and (len(ids) == block_rows or len(vector) != len(vectors[0]) or (len(ids) + 1) * len(vector) * 4 > BLOCK_BYTES):
                    yield flush(ids, labels, vectors)
                ids.append(id_), labels.append(label), vectors.append(vector)
        if ids:
            yield flush(ids, labels, vectors)

    return run


def anchor_blocks(anchors: DataFrame, block_rows: int = BLOCK_ROWS, reach: float = REACH) -> DataFrame:
    """Anchors (id, label, vector) in blocks with their spanning trees, numbered by (part, block)."""
    signed = mapped(anchors, _signed, "id LONG, label LONG, dim INT, signs INT, vector ARRAY<INT>").distinct()
    ranged = signed.repartitionByRange("dim", "label", "signs", "id").sortWithinPartitions("dim", "label", "signs", "id")
    return stored(mapped(ranged.select("id", "label", "vector"), _blocks(block_rows, reach), ANCHORS).withColumn("block", F.monotonically_increasing_id()))


class Anchors(NamedTuple):
    """The anchors of a block, as they are held by a worker."""

    first: int
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    parents: np.ndarray
    edges: np.ndarray


def _read(rows: list) -> list[Anchors]:
    out, first = [], 0
    for r in rows:
        get = lambda c, kind: np.frombuffer(bytes(r[c]), kind)  # noqa: B023,E731
        out.append(Anchors(first, get("ids", np.int64), get("labels", np.int64), get("vectors", np.int32).reshape(r["n"], r["dim"]), get("parents", np.int32), get("edges", np.float64)))
        first += r["n"]
    return out


def _products(a: np.ndarray, b: np.ndarray, norm_a: float, norm_b: float) -> np.ndarray:
    """Exact inner products of integer vectors: no sum can exceed the product of the norms."""
    if norm_a * norm_b < 1 << 24:
        kind = np.float32
    elif norm_a * norm_b < 1 << 53:
        kind = np.float64
    else:
        kind = np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


def _scored(block: Anchors, values: np.ndarray, wanted: Callable[[int], tuple[int, int]], of_label: Callable[[int], np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor, candidates, scores) for each anchor of a block: all candidates whose score lies in its wanted range, and maybe others.

    ``wanted`` gives an anchor's range of scores, asked again for each piece, ``of_label`` the candidates for a label's anchors.
    """
    anchors = block.vectors.astype(np.float64)
    norms, own = np.sqrt(np.square(values).sum(axis=1)), np.sqrt(np.square(anchors).sum(axis=1))
    top, most = float(norms.max(initial=0)) + 1, float(own.max(initial=0)) + 1
    has_child = np.zeros(len(anchors), bool)
    has_child[block.parents[block.parents >= 0]] = True
    begins = np.flatnonzero(np.append(True, block.labels[1:] != block.labels[:-1]))
    for begin, end in zip(begins.tolist(), [*begins[1:].tolist(), len(anchors)]):
        rows = of_label(int(block.labels[begin]))
        if not len(rows):
            continue
        part, reach = values[rows], norms[rows]
        roots = begin + np.flatnonzero(block.parents[begin:end] < 0)
        exact = _products(anchors[roots], part, most, top)
        place = {int(a): k for k, a in enumerate(roots)}
        low, high = {}, {}
        for a in range(begin, end):
            if a in place:
                scores, seen = exact[place[a]], None
                if has_child[a]:
                    low[a] = high[a] = scores.astype(np.float64)
            else:
                parent = int(block.parents[a])
                # a little more than the bound, for the rounding of the norms
                slack = block.edges[a] * reach * (1 + 1e-9) + 1
                under, over = low[parent] - slack, high[parent] + slack
                least, greatest = wanted(a)
                seen = np.flatnonzero((over >= least) & (under <= greatest))
                scores = _products(anchors[a : a + 1], part[seen], most, top)[0]
                if has_child[a]:
                    under[seen] = over[seen] = scores
                    low[a], high[a] = under, over
            yield a, rows if seen is None else rows[seen], scores


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k by score, highest first, then id; equal pairs once."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        held = scores >= least
        scores, ids = scores[held], ids[held]
    order = np.lexsort((ids, -scores))
    scores, ids = scores[order], ids[order]
    if len(scores) > 1:
        new = np.append(True, (scores[1:] != scores[:-1]) | (ids[1:] != ids[:-1]))
        scores, ids = scores[new], ids[new]
    return scores[:k], ids[:k]


_NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _emitted(found: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]], blocks: list[Anchors]) -> Iterator[pa.RecordBatch]:
    names = np.concatenate([b.ids for b in blocks]) if blocks else np.zeros(0, np.int64)
    keys = list(found)
    for row in range(0, len(keys), 10_000):
        part = keys[row : row + 10_000]
        sizes = [len(found[k][0]) for k in part]
        anchor = np.repeat(np.array([k[0] for k in part], np.int64), sizes)
        slot = np.repeat(np.array([k[1] for k in part], np.int32), sizes)
        scores, ids = (np.concatenate([found[k][i] for k in part]) for i in (0, 1))
        yield pa.record_batch([pa.array(anchor), pa.array(names[anchor]), pa.array(slot), pa.array(scores), pa.array(ids)], ["anchor_row", "anchor_id", "slot", "score", "id"])


def _positives(shared, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _read(shared.value)
        found: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for ids, labels, values in _pieces(batches):
            order = np.argsort(labels, kind="stable")
            sorted_labels = labels[order]
            alike = lambda label: order[np.searchsorted(sorted_labels, label) : np.searchsorted(sorted_labels, label, "right")]  # noqa: B023,E731
            for block in blocks:
                if block.vectors.shape[1] != values.shape[1]:
                    continue

                def wanted(a: int) -> tuple[float, float]:
                    scores = found.get((block.first + a, 0), _NONE)[0]  # noqa: B023
                    return (scores[-1] if len(scores) == k else -np.inf), np.inf

                for a, rows, scores in _scored(block, values, wanted, alike):
                    held = found.get((block.first + a, 0), _NONE)
                    good = (ids[rows] != block.ids[a]) & (scores >= wanted(a)[0])
                    if good.any():
                        found[block.first + a, 0] = _best(np.append(held[0], scores[good]), np.append(held[1], ids[rows[good]]), k)
        yield from _emitted(found, blocks)

    return run


def _negatives(shared, windows, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``windows``: for each anchor row, the (lowest, highest) score of each of its positives' windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, ranges = _read(shared.value), windows.value
        found: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

        def wanted_in(row: int) -> tuple[float, float]:
            """From the least score that still could enter a window to the greatest."""
            least, greatest = np.inf, -np.inf
            for slot, (low, high) in enumerate(ranges.get(row, ())):
                scores = found.get((row, slot), _NONE)[0]
                least, greatest = min(least, max(low, scores[-1]) if len(scores) == k else low), max(greatest, high)
            return least, greatest

        for ids, labels, values in _pieces(batches):
            other = lambda label: np.flatnonzero(labels != label)  # noqa: B023,E731
            for block in blocks:
                if block.vectors.shape[1] != values.shape[1]:
                    continue
                for a, rows, scores in _scored(block, values, lambda a: wanted_in(block.first + a), other):  # noqa: B023
                    row = block.first + a
                    least, greatest = wanted_in(row)
                    near = np.flatnonzero((scores >= least) & (scores <= greatest))
                    near = near[ids[rows[near]] != block.ids[a]]
                    if not len(near):
                        continue
                    order = np.lexsort((ids[rows[near]], -scores[near]))
                    value, name = scores[near][order], ids[rows[near]][order]
                    for slot, (low, high) in enumerate(ranges.get(row, ())):
                        begin, end = np.searchsorted(-value, -high), np.searchsorted(-value, -low, "right")
                        if begin < end:
                            held = found.get((row, slot), _NONE)
                            found[row, slot] = _best(np.append(held[0], value[begin:end]), np.append(held[1], name[begin:end]), k)
        yield from _emitted(found, blocks)

    return run


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The first k (score, id) of each (anchor_row, slot) over all tasks, with ``rank`` from 1."""
    order = Window.partitionBy("anchor_row", "anchor_id", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k).dropDuplicates(["anchor_row", "anchor_id", "slot", "rank"])


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95), block_rows: int = BLOCK_ROWS, pass_blocks: int = PASS_BLOCKS, reach: float = REACH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` and ``anchors`` have (id, label, vector). Negatives score between ``window`` hundredths of the positive.
    """
    spark = rows.sparkSession
    context = spark.sparkContext
    blocks = anchor_blocks(anchors, block_rows, reach)
    # blocks by where they lie, and passes of so many in a row: one count for each part of the table
    part = F.shiftrightunsigned("block", 33)
    before, parts = 0, []
    for k, n in sorted((r.part, r.n) for r in blocks.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):
        parts.append((k, before))
        before += n
    passes = -(-before // pass_blocks)
    number = F.col("before") + F.col("block").bitwiseAND(F.lit((1 << 33) - 1))
    dealt = blocks.withColumn("part", part).join(F.broadcast(spark.createDataFrame(parts, "part long, before long")), "part").withColumn("pass", F.floor(number / pass_blocks))
    out = []
    low, high = window
    for p in range(passes):
        held = [{c: r[c] for c in ("dim", "n", "ids", "labels", "vectors", "parents", "edges")} for r in dealt.where(F.col("pass") == p).orderBy("block").collect()]
        shared = context.broadcast(held)
        first = stored(_merged(mapped(rows, _positives(shared, positives), _FOUND), positives))
        ranges: dict[int, list[tuple[int, int]]] = {}
        for r in first.orderBy("anchor_row", "rank").collect():  # a few for each anchor of the pass
            # low * s <= 100 * x <= high * s, in whole numbers
            ranges.setdefault(r.anchor_row, []).append((-(-low * r.score // 100), high * r.score // 100))
        second = _merged(mapped(rows, _negatives(shared, context.broadcast(ranges), negatives), _FOUND), negatives)
        chosen = first.select("anchor_row", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        made = second.join(chosen, ["anchor_row", "slot"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out.append(stored(made) if passes > 1 else made)
    if not out:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose id is divisible by 50; labels of ids divisible by 7 are moved on by one of ten."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = vectors.select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector"))
    return mine(rows, rows.where(F.col("id") % 50 == 0))


OP11_SQL = """
WITH r AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS alike, list_inner_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON a.id % 50 = 0 AND a.id <> b.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 3
"""
