"""N-gram Jaccard join by MinHash banding.

A text is the set of its five-word shingles (one shingle of all words if there are fewer);
texts with equal sets are one class. Each class has ``bands * rows`` minimum hashes; band
and row counts are the cheapest whose chance to miss a pair at the threshold is at most
``1 - recall``. Band hashes are shuffled: classes that share one are candidates of each other.

Candidates are verified on full sets, in units. Ties of each class to the least class of each
bucket give components, which hold every candidate pair; a component is a unit, so that classes
which share many buckets are compared once. A component beyond a block, where chains of loosely
alike texts may join what no bucket does, is verified bucket by bucket instead wherever that brings
fewer rows together: buckets with the same classes count once, and a pair that shares several
is counted in the least of them. Within a unit intersections are counted for whole blocks at
once, and only link counts and one tie for each class leave a task. A unit beyond a block is dealt
out as pairs of blocks, so no group meets in one task and no pair becomes a row.

Rows: exact copies collapse by a grouping before anything is compared; hot bucket and class
keys meet only in joins that Spark splits and in groupings that pre-aggregate. Steps are
checkpointed, so an executor's loss costs the tasks of one step.

A null or empty text, or one without words, equals only texts with the same bytes and links
to none. Ids may repeat or be null: every row finds its class through the digest of its set,
and texts without an id are compared as all others. A pair exactly at the threshold is linked.
Very long texts are one chunk each, never cut. Columns other than id and text play no part;
``deduplicate`` keeps them. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import textbytes as tb
from tidemark.llm.graph import components
from tidemark.llm.shared import checkpointed, mapped

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.9999
#: Classes, and shingles, of a block of candidates.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1_000_000


def banding(threshold: float = THRESHOLD, recall: float = RECALL, most_hashes: int = 200) -> tuple[int, int]:
    """(bands, rows) that reach the recall at the threshold with the most rows within ``most_hashes``."""
    best = (1, 1)
    for rows in range(1, 33):
        bands = 1
        while 1 - (1 - threshold**rows) ** bands < recall:
            bands += 1
        if bands * rows <= most_hashes:
            best = (bands, rows)
    return best


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, shingles per text): the distinct shingles of each text, sorted."""
    hashes, _, _, counts = tb.words(data, offsets)
    sizes = np.maximum(counts - SHINGLE + 1, np.minimum(counts, 1))
    first = np.cumsum(counts) - counts
    edge = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(counts)), sizes)
    start = first[text] + np.arange(int(sizes.sum())) - edge[text]
    width = np.minimum(counts, SHINGLE)[text]
    shingle = np.full(len(start), 0x1B873593, np.uint64)
    for k in range(SHINGLE):
        word = hashes[np.minimum(start + k, max(0, len(hashes) - 1))] if len(hashes) else start.astype(np.uint64)
        shingle = np.where(k < width, tb.mix(shingle * np.uint64(0x9E3779B97F4A7C15) + word), shingle)
    order = np.lexsort((shingle, text))
    shingle, text = shingle[order], text[order]
    fresh = np.ones(len(shingle), bool)
    fresh[1:] = (shingle[1:] != shingle[:-1]) | (text[1:] != text[:-1])
    return shingle[fresh], np.bincount(text[fresh], minlength=len(counts))


def set_digests(data: np.ndarray, offsets: np.ndarray, shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each text's set; of its bytes if the set is empty."""
    sums = np.zeros(len(shingles) + 1, np.uint64)
    np.cumsum(tb.mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)), out=sums[1:])
    edges = np.concatenate([[0], np.cumsum(counts)])
    digest = tb.mix((sums[edges[1:]] - sums[edges[:-1]]) * np.uint64(0xD6E8FEB86659FD93) + counts.astype(np.uint64))
    empty = np.flatnonzero(counts == 0)
    if len(empty):
        digest[empty] = tb.mix(tb.span_hashes(data, offsets[empty], offsets[empty + 1]) ^ np.uint64(0x0123456789ABCDEF))
    return digest.view(np.int64)


def min_hashes(shingles: np.ndarray, counts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes, one row for each text that has shingles."""
    starts = (np.cumsum(counts) - counts)[counts > 0]
    random = np.random.default_rng(20_011)
    factors = random.integers(1, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros((len(starts), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(starts), band + 1, np.uint64)
        for row in range(rows):
            least = np.minimum.reduceat(shingles * factors[band * rows + row], starts) if len(starts) else starts.astype(np.uint64)
            key = tb.mix(key * np.uint64(0x9E3779B97F4A7C15) + least)
        out[:, band] = key
    return out.view(np.int64)


def _text_key(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def signatures(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int) -> DataFrame:
    """id, text_key (digest of the text), node (digest of the set), n (its size), bands (null without words)."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("text_key", T.LongType()), T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("bands", T.BinaryType())])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in tb.chunks(batch.column(2)):
                shingles, counts = shingle_sets(data, offsets)
                hashed = min_hashes(shingles, counts, bands, rows)
                packed: list[bytes | None] = [None] * len(counts)
                for k, line in zip(np.flatnonzero(counts).tolist(), hashed):
                    packed[k] = line.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0)[row:end], batch.column(1)[row:end], pa.array(set_digests(data, offsets, shingles, counts)), pa.array(counts, pa.int64()), pa.array(packed, pa.binary())], schema.names)

    return mapped(docs.select(id_col, _text_key(text_col).alias("text_key"), text_col), sign, schema)


def _place(id_: Column, text_key: Column) -> Column:
    """Where a class's text is fetched from: its least id, or its text where no copy has an id."""
    return F.coalesce(F.when(id_.isNotNull(), F.xxhash64(id_)), text_key)


def _band_rows(classes: DataFrame, bands: int) -> DataFrame:
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(batch.column(0).to_numpy(), bands))], ["key", "node"])

    return mapped(classes.where("bands IS NOT NULL").select("node", "bands"), unpack, "key long, node long")


def candidate_ties(classes: DataFrame, bands: int) -> DataFrame:
    """(a, b): each class and the least class of each bucket that holds others."""
    keyed = _band_rows(classes, bands)
    least = keyed.groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("most")).where("b <> most").select("key", "b")
    return keyed.join(least, "key").where("node <> b").select(F.col("node").alias("a"), "b").distinct()


def _intersections(columns: np.ndarray, owners: np.ndarray, m: int) -> np.ndarray:
    """m x m counts of shared shingles, from (shingle, owner) pairs."""
    order = np.lexsort((owners, columns))
    columns, owners = columns[order], owners[order]
    first = np.flatnonzero(np.concatenate([[True], columns[1:] != columns[:-1]]))
    size = np.diff(np.append(first, len(columns)))
    shared = np.zeros(m * m, np.float32)
    for f in np.unique(size[size > 1]).tolist():
        if f > 12:
            break
        rows = owners[first[size == f][:, None] + np.arange(f)]
        a, b = np.triu_indices(f, 1)
        shared += np.bincount((rows[:, a] * m + rows[:, b]).ravel(), minlength=m * m).astype(np.float32)
    shared = shared.reshape(m, m)
    shared += shared.T
    wide = np.flatnonzero(size > 12)
    for at in range(0, len(wide), 1024):
        part = wide[at : at + 1024]
        dense = np.zeros((m, len(part)), np.float32)
        times = size[part]
        place = np.repeat(first[part] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        dense[owners[place], np.repeat(np.arange(len(part)), times)] = 1
        shared += dense @ dense.T
    return shared


def _counted_before(units: list[np.ndarray], unit: int, m: int) -> np.ndarray:
    """m x m flags of pairs that share a unit before this one; ``units`` has those of each class."""
    seen = np.zeros((m, m), bool)
    sizes = [len(u) for u in units]
    if sum(sizes):
        all_units, owners = np.concatenate(units), np.repeat(np.arange(m), sizes)
        earlier = all_units < unit
        order = np.argsort(all_units[earlier], kind="stable")
        found, owners = all_units[earlier][order], owners[earlier][order]
        edges = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1], [True]])) if len(found) else np.zeros(1, np.int64)
        for k in np.flatnonzero(np.diff(edges) > 1):
            both = owners[edges[k] : edges[k + 1]]
            seen[np.ix_(both, both)] = True
    return seen


def _verify(nodes: np.ndarray, blocks: np.ndarray, sets: list[np.ndarray], units: list[np.ndarray], unit: int, across: bool, share: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, links, least linked node) of the classes of one tile: all pairs of one block, or only those ``across`` two, one of which may be empty."""
    _, keep = np.unique(nodes, return_index=True)
    nodes, blocks, sets, units = nodes[keep], blocks[keep], [sets[k] for k in keep], [units[k] for k in keep]
    m = len(nodes)
    sizes = np.array([len(s) for s in sets], np.int64)
    owners = np.repeat(np.arange(m), sizes)
    shared = _intersections(np.concatenate(sets), owners, m)
    p, q = share.numerator, share.denominator
    linked = (p + q) * shared.astype(np.int64) >= p * (sizes[:, None] + sizes[None, :])
    if across:
        linked &= blocks[:, None] != blocks[None, :]
    linked &= ~_counted_before(units, unit, m)
    np.fill_diagonal(linked, False)
    label = np.arange(m)
    while True:
        least = np.minimum(label, np.where(linked, label[None, :], m).min(axis=1, initial=m))
        least = least[least]
        if (least == label).all():
            break
        label = least
    return nodes, linked.sum(axis=1), nodes[label]


def _tile_results(share: Fraction):
    """Rows arrive sorted by tile and node: (tile, unit, across, block, node, units, shingles); repeated rows bring a node again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, unit, across, nodes, blocks, units, sets = None, 0, False, [], [], [], []

        def result() -> Iterator[pa.RecordBatch]:
            if len(nodes) > 1:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _verify(np.array(nodes), np.array(blocks), sets, units, unit, across, share)], ["node", "links", "tie"])

        for batch in batches:
            tiles, unit_, across_, block, node, shared, shingles = (c.to_pylist() for c in batch.columns)
            for k in range(len(tiles)):
                if tiles[k] != tile:
                    yield from result()
                    tile, unit, across, nodes, blocks, units, sets = tiles[k], unit_[k], across_[k], [], [], [], []
                elif nodes[-1] == node[k]:
                    continue
                nodes.append(node[k])
                blocks.append(block[k])
                units.append(np.array(shared[k], np.int64))
                sets.append(np.frombuffer(shingles[k], np.uint64))
        yield from result()

    return run


def _blocks(m: Column, s: Column) -> Column:
    return F.greatest(F.ceil(m / BLOCK_ROWS), F.ceil(s / BLOCK_SHINGLES)).cast("long")


def units_of(classes: DataFrame, members: DataFrame, bands: int) -> DataFrame:
    """(node, units, blocks, shared): the units that each class is verified in, their numbers of blocks, and those that pairs may share.

    ``members`` has (node, n, component). One unit is the component; a larger component goes by its
    buckets if their rows, each as often as its bucket has blocks, are fewer.
    """
    sizes = members.groupBy("component").agg(F.count("*").alias("m"), F.sum("n").alias("s")).where("m > 1").withColumn("blocks", _blocks(F.col("m"), F.col("s")))
    large = checkpointed(sizes.where("blocks > 1"))
    none = F.array().cast("array<bigint>")
    if large.isEmpty():
        return members.join(sizes, "component").select("node", F.array("component").alias("units"), F.array("blocks").alias("blocks"), none.alias("shared"))
    inside = members.join(large.select("component"), "component").select("node", "n", "component")
    keyed = checkpointed(_band_rows(classes.join(inside.select("node"), "node", "left_semi"), bands).join(inside, "node"))
    # a bucket's classes are told by their number and the sum of their digests
    members_sum = F.sum(F.xxhash64("node").cast("decimal(20,0)"))
    buckets = keyed.groupBy("key").agg(F.first("component").alias("component"), F.count("*").alias("m"), F.sum("n").alias("s"), members_sum.alias("d")).where("m > 1")
    once = checkpointed(buckets.groupBy("component", "m", "d").agg(F.min("key").alias("key"), F.first("s").alias("s")).withColumn("blocks", _blocks(F.col("m"), F.col("s"))))
    cost = once.groupBy("component").agg(F.sum(F.col("m") * F.col("blocks")).alias("cost"))
    cheaper = checkpointed(large.join(cost, "component").where(F.col("cost") < F.col("m") * F.col("blocks")).select("component"))
    whole = members.join(sizes, "component").join(cheaper, "component", "left_anti").select("node", F.array("component").alias("units"), F.array("blocks").alias("blocks"), none.alias("shared"))
    held = keyed.join(once.join(cheaper, "component", "left_semi").select("key", "blocks"), "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("key", "blocks"))).alias("u"))
    return whole.unionByName(held.select("node", F.col("u.key").alias("units"), F.col("u.blocks").alias("blocks"), F.col("u.key").alias("shared")))


def verified(docs: DataFrame, classes: DataFrame, members: DataFrame, id_col: str, text_col: str, threshold: float, bands: int) -> DataFrame:
    """(node, links, tie) from every tile of every unit of ``members`` (id, text_key, node, n, component)."""
    placed = members.join(units_of(classes, members, bands), "node").select(_place(F.col("id"), F.col("text_key")).alias("place"), "node", "units", "blocks", "shared")
    texts = docs.select(_place(F.col(id_col), _text_key(text_col)).alias("place"), F.col(text_col).alias("text")).join(placed, "place").select("text", "node", "units", "blocks", "shared")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in tb.chunks(batch.column(0)):
                shingles, counts = shingle_sets(data, offsets)
                digest = set_digests(data, offsets, shingles, counts)
                edges = np.concatenate([[0], np.cumsum(counts)])
                node = batch.column(1)[row:end].to_numpy()
                own = np.flatnonzero(digest == node)  # an id may stand for other texts too
                mark = tb.mix(node.view(np.uint64))
                out: list[tuple] = []
                for k in own.tolist():
                    raw, shared = shingles[edges[k] : edges[k + 1]].tobytes(), batch.column(4)[row + k].as_py()
                    for unit, blocks in zip(batch.column(2)[row + k].as_py(), batch.column(3)[row + k].as_py()):
                        b = int(mark[k] % np.uint64(blocks))
                        for other in range(blocks):
                            low, high = min(b, other), max(b, other)
                            out.append((unit, low * blocks + high, low != high, b, int(node[k]), shared, raw))
                            if len(out) >= 256:
                                yield _tile_batch(out)
                                out = []
                if out:
                    yield _tile_batch(out)

    tiles = mapped(texts, spread, "unit long, tile long, across boolean, block long, node long, shared array<long>, shingles binary")
    # a random mix of unit and tile names the task; rows of a tile then come together
    dealt = tiles.withColumn("tile", F.xxhash64("unit", "tile")).repartition(_partitions(docs.sparkSession), "tile").sortWithinPartitions("tile", "node")
    return mapped(dealt.select("tile", "unit", "across", "block", "node", "shared", "shingles"), _tile_results(Fraction(threshold).limit_denominator(1000)), "node long, links long, tie long")


def _partitions(spark: SparkSession) -> int:
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def _tile_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["unit", "tile", "across", "block", "node", "shared", "shingles"])


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row for each row of ``docs``: id, text_key, node, group, class_id, group_id, n_links.

    ``text_key`` is a digest of the row's text, ``group`` the least node of its group, ``node`` is the digest of the row's shingle set, ``class_id`` the least id with that
    set, ``n_links`` the number of other sets at the threshold or above, ``group_id`` the
    least class id of all texts connected by links.
    """
    bands, rows = banding(threshold, recall)
    signed = checkpointed(signatures(docs, id_col, text_col, bands, rows))
    classes = checkpointed(signed.groupBy("node").agg(F.min("id").alias("id"), F.min("text_key").alias("text_key"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    ties = checkpointed(candidate_ties(classes, bands))
    groups = components(ties)
    members = checkpointed(classes.select("id", "text_key", "node", "n").join(groups, "node"))
    found = checkpointed(verified(docs, classes, members, id_col, text_col, threshold, bands))
    links = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    linked = components(found.where("links > 0 AND node <> tie").select(F.col("node").alias("a"), F.col("tie").alias("b")))
    named = classes.select("node", F.col("id").alias("class_id")).join(linked, "node", "left").join(links, "node", "left")
    named = checkpointed(named.select("node", "class_id", F.coalesce("component", "node").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    least = named.groupBy("component").agg(F.min("class_id").alias("group_id"))
    whole = named.join(least, "component").select("node", F.col("component").alias("group"), "class_id", "group_id", "n_links")
    return signed.select(F.col("id").alias(id_col), "text_key", "node").join(whole, "node").select(id_col, "text_key", "node", "group", "class_id", "group_id", "n_links")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row of ``docs`` for each group: that with the least id (null first), then the least digest of text."""
    joined = jaccard_join(docs, id_col, text_col, threshold, recall)
    kept = joined.groupBy("group").agg(F.min(F.struct(F.col(id_col).alias("i"), F.col("text_key").alias("k"))).alias("kept")).select("kept.i", "kept.k").distinct()
    rows = docs.withColumn("_td_key", _text_key(text_col))
    same = rows[id_col].eqNullSafe(kept["i"]) & (rows["_td_key"] == kept["k"])
    return rows.join(kept, same, "left_semi").dropDuplicates([id_col, "_td_key"]).select(*docs.columns)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id (least id of all texts connected by links), n_links, copy_of (least id with the same set)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_join(docs).select("doc_id", F.col("group_id").alias("class_id"), "n_links", F.col("class_id").alias("copy_of"))


def brute_force(docs: list[tuple], threshold: float = THRESHOLD) -> dict:
    """{id: (class, group, links)} for distinct ids, by comparing all pairs; for tests."""
    import re

    def shingles(text):
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return frozenset(tuple(own[k : k + SHINGLE]) for k in range(max(1, len(own) - SHINGLE + 1))) if own else frozenset([("", text or "")])

    sets = {i: shingles(t) for i, t in docs}
    classes: dict = {}
    for i in sorted(sets):
        classes.setdefault(sets[i], i)
    kinds = list(classes)
    parent = {s: s for s in kinds}

    def root(s):
        while parent[s] is not s:
            s = parent[s]
        return s

    count = dict.fromkeys(kinds, 0)
    for a in range(len(kinds)):
        for b in range(a):
            both = len(kinds[a] & kinds[b])
            if both and both / (len(kinds[a]) + len(kinds[b]) - both) >= threshold - 1e-12:
                count[kinds[a]] += 1
                count[kinds[b]] += 1
                parent[root(kinds[a])] = root(kinds[b])
    least: dict = {}
    for s in kinds:
        least[id(root(s))] = min(least.get(id(root(s)), classes[s]), classes[s])
    return {i: (classes[s], least[id(root(s))], count[s]) for i, s in sets.items()}
