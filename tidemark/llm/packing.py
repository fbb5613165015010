"""Best-fit packing with certified bin counts, partition by partition.

Pieces of one length are exchangeable, so whatever is decided about a partition is decided on
its length histogram (at most 2,048 counts), however many pieces it holds:

1. Each partition is packed by best-fit decreasing. Dual-feasible functions of its lengths prove
   a lower bound; a count that meets it is certified.
2. If the counts of all partitions together meet the bound of all lengths, nothing can be saved
   and all bins close. Otherwise a partition that is certified by its mere number of tokens closes
   its full bins, and its fullest others as long as they leave no more than 1/32 of a bin. A
   certificate by longer pieces closes nothing, as shorter pieces of other partitions may fill
   those bins; nor does a partition with a gap between count and bound.
3. What does not close is exchanged: ``FAN`` partitions at a time pool the rest of their
   histograms, and best-fit decreasing runs again on the pool, under a bound of its own. After
   log(partitions) rounds one pool is left, and closes.
4. If the result misses the bound of all lengths, certified partitions may hold what others lack:
   the rounds run again with all pieces exchanged, and the smaller number of bins is taken.

A round groups histogram rows, never pieces, and no group holds more than one row for each
length and partition that it pools. A piece finds its place by its rank among the pieces of its length: the
ranks that each round places are carried back to the partitions as intervals, and one join
on (partition, length) ends it. Only ids, lengths and checksums are written, never tokens or
texts. A source or id that holds many rows changes nothing.

A null text is empty and makes one token, the separator. Repeated rows and null ids are packed
each; of pieces of equal length any may come first. Other columns are carried along, ones named
like the results replaced. A very long text is encoded as one chunk and cut. Empty tables give none.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import checkpointed, mapped, stored
from tidemark.llm.tokens import encode_column

LENGTH = 2048
#: Partitions, or pools, that exchange pieces in one round.
FAN = 16


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def lower_bound(lengths: np.ndarray, capacity: int = LENGTH) -> int:
    """The largest number of bins that dual-feasible functions prove necessary."""
    return histogram_bound(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity)


def histogram_bound(count: np.ndarray, capacity: int = LENGTH) -> int:
    """``lower_bound`` of ``count[x]`` pieces of each length x."""
    if not count.any():
        return 0
    size = np.arange(capacity + 1)
    many, total = np.cumsum(count), np.cumsum(count * size)
    best = -(-int(total[-1]) // capacity)
    # lengths over capacity - k count as whole bins, those under k as nothing
    k = np.arange(1, capacity // 2 + 1)
    weight = (many[-1] - many[capacity - k]) * capacity + total[capacity - k] - total[k - 1]
    best = max(best, int(-(-weight // capacity).max()))
    # lengths rounded: x with (m + 1) x integral stays, others round down to a multiple of 1 / m
    for m in range(1, 33):
        scaled = (m + 1) * size
        value = np.where(scaled % capacity == 0, size * m, (scaled // capacity) * capacity)
        best = max(best, int(-(-int((count * value).sum()) // (m * capacity))))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = LENGTH) -> tuple[np.ndarray, list[int]]:
    """(bin of each item, room left in each bin)."""
    bins = np.zeros(len(lengths), np.int64)
    room: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order].tolist()
    chosen = []
    for size in sizes:
        fits = open_rooms >> size
        if fits:
            left = (fits & -fits).bit_length() - 1 + size
            b = by_room[left].pop()
            if not by_room[left]:
                open_rooms &= ~(1 << left)
            left -= size
            room[b] = left
        else:
            b, left = len(room), capacity - size
            room.append(left)
        if left:
            by_room[left].append(b)
            open_rooms |= 1 << left
        chosen.append(b)
    bins[order] = chosen
    return bins, room


def cut(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Pieces of at most ``length`` ids: id, piece, start, length, ids_crc32."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, ids, counts in encode_column(tokenizer_path, batch.column(1)):
                out: list[tuple[int, int, int, int, int]] = []
                at = 0
                for k, n in enumerate(counts.tolist()):
                    raw = np.append(ids[at : at + n], 0).astype("<u4")
                    at += n
                    total, start, piece = n + 1, 0, 0
                    while start < total:
                        size = length if start or total % length == 0 else total if total < length else total % length
                        out.append((row + k, piece, start, size, zlib.crc32(raw[start : start + size].tobytes())))
                        start, piece = start + size, piece + 1
                rows, piece, start, size, crc = (np.array(x, np.int64) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size), pa.array(crc)], schema.names)

    return mapped(docs.select(id_col, text_col), pieces, schema)


Segment = tuple[int, int, int, int, int, int]


def plan(count: np.ndarray, capacity: int = LENGTH) -> tuple[list[Segment], int, list[tuple[int, int, int]]]:
    """(segments, bins, bins with room) of best-fit decreasing over ``count[x]`` pieces of each length x.

    A segment (length, first rank, pieces, first bin, pieces a bin, offset) lays pieces of
    consecutive ranks into consecutive bins, so many in each. Bins with room come as
    (first bin, end bin, room); all others are full.
    """
    segments: list[Segment] = []
    by_room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # (first bin, bins) of each room
    open_rooms, n_bins = 0, 0

    def put(room: int, group: tuple[int, int]) -> None:
        nonlocal open_rooms
        if room and group[1]:
            by_room[room].append(group)
            open_rooms |= 1 << room

    for size in range(capacity, 0, -1):
        left, rank = int(count[size]), 0
        while left:
            fits = open_rooms >> size
            if fits:
                room = (fits & -fits).bit_length() - 1 + size
                first, bins = by_room[room].pop()
                if not by_room[room]:
                    open_rooms &= ~(1 << room)
            else:
                room, first, bins = capacity, n_bins, -(-left // (capacity // size))
                n_bins += bins
            each = room // size
            whole = min(bins, left // each)
            rest = min(left - whole * each, each) if whole < bins else 0
            used = whole + (rest > 0)
            segments.append((size, rank, whole * each + rest, first, each, capacity - room))
            put(room - each * size, (first, whole))
            if rest:
                put(room - rest * size, (first + whole, 1))
            put(room, (first + used, bins - used))
            rank += whole * each + rest
            left -= whole * each + rest
    return segments, n_bins, [(first, first + bins, room) for room, groups in enumerate(by_room) for first, bins in groups]


def _stay_open(count: np.ndarray, bins: int, bound: int, with_room: list[tuple[int, int, int]], capacity: int) -> list[tuple[int, int]]:
    """Ranges of bins that do not close: all, or those with room but for the fullest of a group that is certified by its tokens."""
    tokens = int((count * np.arange(capacity + 1)).sum())
    if not bins == bound == -(-tokens // capacity):
        return [(0, bins)] if bins else []
    spare, left = capacity // 32, []
    for first, end, room in sorted(with_room, key=lambda x: x[2]):
        closes = min(end - first, spare // room)
        spare -= closes * room
        if closes < end - first:
            spare = 0
            left.append((first + closes, end))
    return sorted(left)


def _closed(segments: list[Segment], open_bins: list[tuple[int, int]], capacity: int) -> tuple[list[Segment], np.ndarray]:
    """(segments in closed bins, ranked anew from 0 within each length; how many pieces of each length they hold)."""
    closed: list[Segment] = []
    held = np.zeros(capacity + 1, np.int64)
    edges = [first for first, _ in open_bins]
    for size, _, pieces, first, each, offset in segments:
        end, at = first - (-pieces // each), first
        k = max(0, bisect.bisect_right(edges, first) - 1)
        while at < end:
            while k < len(open_bins) and open_bins[k][1] <= at:
                k += 1
            low, high = open_bins[k] if k < len(open_bins) else (end, end)
            if low > at:
                stop = min(low, end)
                n = min(pieces - (at - first) * each, (stop - at) * each)
                closed.append((size, int(held[size]), n, at, each, offset))
                held[size] += n
                at = stop
            else:
                at = min(high, end)
    return closed, held


def pack_group(count: np.ndarray, capacity: int = LENGTH, closes: str = "certified") -> tuple[list[Segment], np.ndarray, int, int, int]:
    """(closed segments, pieces of each length they hold, bins, bound, closed bins) of one histogram; all bins close, none, or those of a certified group."""
    segments, bins, with_room = plan(count, capacity)
    bound = histogram_bound(count, capacity)
    open_bins = _stay_open(count, bins, bound, with_room, capacity) if closes == "certified" else [] if closes == "all" else [(0, bins)]
    return *_closed(segments, open_bins, capacity), bins, bound, bins - sum(end - first for first, end in open_bins)


def _ranked(pieces: DataFrame, names: list[str], length: int) -> DataFrame:
    """``pieces`` with their partition and their rank among its pieces of one length."""
    at = names.index("length")
    schema = T.StructType([*[pieces.schema[c] for c in names], T.StructField("_td_part", T.LongType()), T.StructField("_td_rank", T.LongType())])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(length + 1, np.int64)
        for batch in batches:
            lengths = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(lengths, kind="stable")
            counts = np.bincount(lengths, minlength=length + 1)
            ranks = np.zeros(len(lengths), np.int64)
            ranks[order] = np.arange(len(lengths)) + (seen - (np.cumsum(counts) - counts))[lengths[order]]
            seen += counts
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(lengths), part, np.int64)), pa.array(ranks)], schema.names)

    return mapped(pieces.select(*names), rank, schema)


def _round(level: DataFrame, number: int, closes: str, length: int) -> DataFrame:
    """Rows of one round over (group, length, n): closed segments, closed counts of each length, and each group's certificate."""
    schema = "kind string, level int, group long, length long, rank long, n long, bin long, each long, offset long"

    def fit(table: pa.Table) -> pa.Table:
        count = np.zeros(length + 1, np.int64)
        np.add.at(count, table["length"].to_numpy(), table["n"].to_numpy())
        group = table["group"][0].as_py()
        segments, held, bins, bound, closed = pack_group(count, length, closes)
        rows = [("segment", size, rank, n, first, each, offset) for size, rank, n, first, each, offset in segments]
        rows += [("held", int(size), int(held[size]), int(count[size] - held[size]), 0, 0, 0) for size in np.flatnonzero(count)]
        rows.append(("certificate", 0, bound, bins, closed, 0, 0))
        kind, *numbers = zip(*rows)
        names = ("length", "rank", "n", "bin", "each", "offset")
        return pa.table({"kind": pa.array(kind, pa.string()), "level": pa.array([number] * len(rows), pa.int32()), "group": pa.array([group] * len(rows), pa.int64()), **{c: pa.array(x, pa.int64()) for c, x in zip(names, numbers)}})

    return stored(level.groupBy("group").applyInArrow(fit, schema))


def _rounds(counts: DataFrame, groups: int, bound: int, closes: str, length: int, fan: int) -> tuple[DataFrame, DataFrame, int]:
    """(rows of all rounds, intervals of ranks that each places, bins) for (part, length, n)."""
    # pieces of a partition that reach a group: their first rank in the group, how many, how many of the partition were placed before
    held = counts.select("part", "length", F.col("part").alias("group"), F.lit(0).cast("long").alias("at"), "n", F.lit(0).cast("long").alias("before"))
    level = counts.select(F.col("part").alias("group"), "length", "n")
    whole, spots, closed, number = None, None, 0, 0
    while True:
        last = groups <= 1
        made = _round(level, number, "all" if last else closes, length)
        sums = made.where("kind = 'certificate'").agg(F.sum("n").alias("bins"), F.sum("bin").alias("closed")).first()
        if not last and closed + (sums.bins or 0) == bound:
            last, made = True, _round(level, number, "all", length)  # nothing can be saved anywhere
        closed += (sums.bins if last else sums.closed) or 0
        here = held.join(made.where("kind = 'held'").select("group", "length", F.col("rank").alias("placed")), ["group", "length"])
        fits = F.least(F.greatest(F.col("placed") - F.col("at"), F.lit(0)), F.col("n"))
        spots_here = here.select("part", "length", F.lit(number).alias("level"), "group", "at", fits.alias("n"), "before").where("n > 0")
        whole, spots = (made, spots_here) if whole is None else (whole.unionByName(made), spots.unionByName(spots_here))
        if last:
            return whole, spots, closed
        passed = made.where("kind = 'held' AND n > 0")
        order = Window.partitionBy("parent", "length").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
        moved = stored(passed.withColumn("parent", F.floor(F.col("group") / fan).cast("long")).select("group", "parent", "length", "n", F.coalesce(F.sum("n").over(order), F.lit(0)).cast("long").alias("start")))
        level = moved.groupBy(F.col("parent").alias("group"), "length").agg(F.sum("n").alias("n"))
        rest = here.withColumn("fits", fits).where("n > fits").select("part", "length", "group", (F.greatest("at", "placed") - F.col("placed")).alias("over"), (F.col("n") - F.col("fits")).alias("n"), (F.col("before") + F.col("fits")).alias("before"))
        held = stored(rest.join(moved.select("group", "length", "parent", "start"), ["group", "length"]).select("part", "length", F.col("parent").alias("group"), (F.col("start") + F.col("over")).alias("at"), "n", "before"))
        groups, number = -(-groups // fan), number + 1


def pack_certified(pieces: DataFrame, length: int = LENGTH, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """(``pieces`` with sequence_id and offset; certificates): rows of a sequence fill it from 0 without gaps.

    ``pieces`` needs a column ``length``, from 1 to the argument's value. A certificate is a row
    (level, group, bins, closed, bound) of a partition or pool, ``closed`` being the bins that it
    keeps; level -1 has those of the result and the bound of all lengths.
    """
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    ranked = stored(_ranked(pieces, names, length))
    counts = stored(ranked.groupBy(F.col("_td_part").alias("part"), "length").agg(F.count("*").alias("n")))
    count = np.zeros(length + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        count[row["length"]] = row["n"]
    bound, groups = histogram_bound(count, length), (counts.agg(F.max("part")).first()[0] or 0) + 1
    whole, spots, bins = _rounds(counts, groups, bound, "certified", length, fan)
    if bins > bound and groups > 1:
        again = _rounds(counts, groups, bound, "none", length, fan)
        whole, spots, bins = min((whole, spots, bins), again, key=lambda x: x[2])
    segments = whole.where("kind = 'segment'").select("level", "group", "length", F.col("rank").alias("s_rank"), F.col("n").alias("s_n"), "bin", "each", F.col("offset").alias("s_offset"))
    # the part of a segment that a partition's interval covers, by ranks of the partition
    start, stop = F.greatest("at", "s_rank"), F.least(F.col("at") + F.col("n"), F.col("s_rank") + F.col("s_n"))
    covered = spots.join(segments, ["level", "group", "length"]).where(start < stop)
    sequence = F.shiftleft(F.col("level").cast("long"), 57) + F.shiftleft(F.col("group"), 36) + F.col("bin")
    placed = covered.select("part", "length", F.struct((F.col("before") + start - F.col("at")).alias("rank"), (stop - start).alias("n"), (start - F.col("s_rank")).alias("skip"), sequence.alias("bin"), "each", F.col("s_offset").alias("offset")).alias("spot"))
    spots_of = placed.groupBy(F.col("part").alias("_td_part"), "length").agg(F.collect_list("spot").alias("_td_spots"))
    rank = F.col("_td_rank")
    spot = F.get(F.filter("_td_spots", lambda x: (x["rank"] <= rank) & (rank < x["rank"] + x["n"])), F.lit(0))
    found = ranked.join(spots_of, ["_td_part", "length"]).select(*names, "_td_rank", spot.alias("_td_spot"))
    nth = F.col("_td_rank") - F.col("_td_spot.rank") + F.col("_td_spot.skip")
    packed = found.select(*names, (F.col("_td_spot.bin") + F.floor(nth / F.col("_td_spot.each"))).cast("long").alias("sequence_id"), (F.col("_td_spot.offset") + nth % F.col("_td_spot.each") * F.col("length")).cast("long").alias("offset"))
    certificates = whole.where("kind = 'certificate'").select("level", "group", F.col("n").alias("bins"), F.col("bin").alias("closed"), F.col("rank").alias("bound"))
    total = counts.sparkSession.range(1).select(F.lit(-1).alias("level"), F.lit(None).cast("long").alias("group"), F.lit(bins).cast("long").alias("bins"), F.lit(bins).cast("long").alias("closed"), F.lit(bound).cast("long").alias("bound"))
    return packed, certificates.unionByName(total)


def pack(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """``pieces`` with sequence_id and offset, as ``pack_certified`` gives them."""
    return pack_certified(pieces, length)[0]


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packed = pack(checkpointed(cut(docs, default_tokenizer())))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
