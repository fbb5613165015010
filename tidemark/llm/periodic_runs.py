"""Runs of words: maximal stretches that repeat with a period, by internal pattern matching.

A chunk of whole texts is one sequence of words, named by text so that nothing matches across
texts. Prefix doubling gives its suffix array and, on the way, a name for every block of
2**k words; blocks of one name are a range of the suffix array. A run of period q is found at the
level whose blocks are so short that the first part of the run, all but its last q words, holds
one that begins at a multiple of its length: that block occurs again q words later. So every such
block asks a wavelet matrix over the suffix array for the occurrences of its name in the
neighbouring window that holds the level's periods, by counts below the window's edges and range
successors from there. The distance of each occurrence is a candidate period. Inside a stretch that already has a
short period, the occurrences of a block form an arithmetic progression whose difference is that
period, so they give nothing new and the window begins behind the stretch.

Candidates of one distance in blocks side by side are one; what is left is extended to both sides
by the block names, longest first. A stretch that is found with several periods keeps the least.

Nothing is shuffled: a row answers for itself, so hot sources, copies and lost executors need no care.
Null and empty texts have no words and no runs, repeated rows and ids are taken row by row, a
null id changes nothing, runs that tie in length are ordered by their start. Very long texts
are chunks of their own, never cut; one of two million words that repeat throughout takes 1.2 GB and 23 s
of its task, others a fraction. Other columns are not carried, whatever their names; an empty
table gives an empty one. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import textbytes as tb
from tidemark.llm.decontamination import WaveletMatrix
from tidemark.llm.shared import mapped

#: A run has at least so many words, and at least two periods.
LEAST_WORDS = 12
#: Occurrences that are looked up at once.
_AT_ONCE = 1 << 18

#: (ids, words of each text) to the word that stands at each place, as a place in the chunk; None for the texts as they are.
Rearrange = Callable[[list, np.ndarray], np.ndarray]


def _window(level: int) -> tuple[int, int]:
    """Distances that blocks of 2**level words look at.

    The part of a run before its last q words has q words at least, and 12 - q. Any 2 * 2**level - 1
    words hold an aligned block, so periods up to 5 and from 7 on may use four words, 6 needs two.
    """
    return (6, 6) if level == 1 else (1, 14) if level == 2 else ((2 << level) - 1, (4 << level) - 2)


def _counted_below(matrix: WaveletMatrix, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
    """How many entries of each range are less than its value."""
    found = np.zeros(len(low), np.int64)
    for k, b in enumerate(range(matrix.bits - 1, -1, -1)):
        one = (value >> b) & 1 == 1
        low_ones, high_ones = matrix.ones[k][low], matrix.ones[k][high]
        found += np.where(one, (high - low) - (high_ones - low_ones), 0)
        low = np.where(one, matrix.zeros[k] + low_ones, low - low_ones)
        high = np.where(one, matrix.zeros[k] + high_ones, high - high_ones)
    return found


def _successors(matrix: WaveletMatrix, low: np.ndarray, high: np.ndarray, below: np.ndarray) -> np.ndarray:
    """The entry of each range that has ``below`` less ones in it: the successor of any value with that count."""
    value = np.zeros(len(low), np.int64)
    for k, b in enumerate(range(matrix.bits - 1, -1, -1)):
        low_ones, high_ones = matrix.ones[k][low], matrix.ones[k][high]
        zeros = (high - low) - (high_ones - low_ones)
        one = below >= zeros
        value |= one.astype(np.int64) << b
        below = np.where(one, below - zeros, below)
        low = np.where(one, matrix.zeros[k] + low_ones, low - low_ones)
        high = np.where(one, matrix.zeros[k] + high_ones, high - high_ones)
    return value


class Blocks:
    """Names of all blocks of 2**k words, and the suffix array that they are ranges of.

    ``names[k][i]`` is where the suffixes that begin with the block at i begin in the suffix array,
    ``repeated[k]`` the places whose block occurs elsewhere and ``sizes[k]`` how often it occurs.
    """

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        n = len(words)
        ends = np.repeat(np.cumsum(counts), counts)
        texts = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
        _, names = np.unique(words, return_inverse=True)
        rank, places = np.zeros(n, np.int64), np.arange(n, dtype=np.int64)
        key = texts * (int(names.max(initial=0)) + 1) + names
        self.names, self.repeated, self.sizes = [], [], []
        longest, k = int(counts.max(initial=0)), 0
        while True:
            order = np.argsort(key, kind="stable")
            key, places = key[order], places[order]
            old, at = rank[places], np.arange(len(places))
            begins = np.ones(len(places), bool)
            begins[1:] = key[1:] != key[:-1]
            groups = np.ones(len(places), bool)
            groups[1:] = old[1:] != old[:-1]
            first = np.maximum.accumulate(np.where(begins, at, 0)) if len(at) else at
            # names begin where their group does: ranks stay places in the suffix array as groups split
            rank[places] = old + first - (np.maximum.accumulate(np.where(groups, at, 0)) if len(at) else at)
            size = np.diff(np.append(np.flatnonzero(begins), len(at)))
            size = np.repeat(size, size)
            again = size > 1
            places, size = places[again], size[again]
            self.names.append(rank.astype(np.int32))
            self.repeated.append(places)
            self.sizes.append(size)
            k += 1
            if k > 2 and 2 * _window(k)[0] > longest:
                break
            step = 1 << (k - 1)
            after = places + step
            inside = after < ends[places]
            second = np.where(inside, rank[np.where(inside, after, 0)] + 1, 0)
            key = rank[places] * (n + 2) + second
        self.order = np.argsort(rank, kind="stable")

    def matrix(self) -> tuple[WaveletMatrix, np.ndarray]:
        """A wavelet matrix over the suffixes whose first two words occur again, and their number before each rank."""
        n = len(self.order)
        held = np.zeros(n, bool)
        held[self.repeated[1]] = True
        held = held[self.order]
        before = np.zeros(n + 1, np.int64)
        np.cumsum(held, out=before[1:])
        return WaveletMatrix(self.order[held], n + 1), before


def _chains(period: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Stretches of one period that meet, joined: (period, start, end)."""
    order = np.lexsort((start, period))
    period, start, end = period[order], start[order], end[order]
    heads = np.ones(len(start), bool)
    heads[1:] = (period[1:] != period[:-1]) | (start[1:] != end[:-1])
    return np.stack([period[heads], start[heads], end[np.append(heads[1:], True)]])


def _extended(blocks: Blocks, level: int, left: np.ndarray, right: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches [left, right) that equal what stands ``period`` words later, made as long as they can be."""
    n = len(blocks.order)
    for top in (True, False):
        for k in [level] if top else range(level - 1, -1, -1):
            names, step = blocks.names[k], 1 << k
            todo = np.arange(len(left))
            while len(todo):
                at = left[todo] - step
                same = at >= 0
                same[same] = names[at[same]] == names[at[same] + period[todo][same]]
                todo = todo[same]
                left[todo] -= step
                if not top:
                    break
            todo = np.arange(len(right))
            while len(todo):
                at = right[todo]
                same = at + period[todo] < n
                same[same] = names[at[same]] == names[at[same] + period[todo][same]]
                todo = todo[same]
                right[todo] += step
                if not top:
                    break
    return left, right


def _least_periods(found: np.ndarray) -> np.ndarray:
    """(start, end, period) rows by start and period, one for each stretch."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    found = found[new]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def find_runs(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(start, end, period) of all runs of a sequence of texts with ``counts`` words each, by start and period."""
    found, n = np.zeros((0, 3), np.int64), len(words)
    if int(counts.max(initial=0)) < LEAST_WORDS:
        return found
    blocks = Blocks(words, counts)
    matrix, before = blocks.matrix()
    for level in range(1, len(blocks.names)):
        size = 1 << level
        places, sizes = blocks.repeated[level], blocks.sizes[level]
        aligned = places % size == 0
        places, sizes = places[aligned], sizes[aligned]
        if not len(places):
            continue
        nearest, farthest = _window(level)
        begin = places + nearest
        if level > 3 and len(found):
            # a block in a stretch with a short period: its occurrences there are a progression
            short = found[(found[:, 2] * 2 <= size) & (found[:, 1] - found[:, 0] >= size)]
            one, end = -(-short[:, 0] // size), short[:, 1] // size
            held = np.maximum(end - one, 0)
            behind = np.zeros(n // size + 1, np.int64)
            at = np.repeat(one, held) + np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held)
            behind[at] = np.repeat(short[:, 1] - size + 1, held)
            begin = np.maximum(begin, behind[places // size])
        low = blocks.names[level][places].astype(np.int64)
        low, high = before[low], before[low + sizes]
        first = _counted_below(matrix, low, high, np.minimum(begin, n))
        many = np.maximum(_counted_below(matrix, low, high, np.minimum(places + farthest + 1, n)) - first, 0)
        seen = np.flatnonzero(many)
        total, pieces, row = np.cumsum(many[seen]), [], 0
        while row < len(seen):
            until = max(row + 1, int(np.searchsorted(total, (total[row - 1] if row else 0) + _AT_ONCE, "right")))
            part = seen[row:until]
            each = np.repeat(part, many[part])
            nth = first[each] + np.arange(len(each)) - np.repeat(np.cumsum(many[part]) - many[part], many[part])
            start = places[each]
            pieces.append(_chains(_successors(matrix, low[each], high[each], nth) - start, start, start + size))
            row = until
        if not pieces:
            continue
        period, left, right = _chains(*np.concatenate(pieces, axis=1))
        left, right = _extended(blocks, level, left, right, period)
        made = np.stack([left, right + period, period], axis=1)
        made = made[made[:, 1] - made[:, 0] >= np.maximum(LEAST_WORDS, 2 * made[:, 2])]
        found = _least_periods(np.concatenate([found, made]))
    return found


def _collapsed(text: bytes, order: np.ndarray | None, kept: np.ndarray | None) -> bytes:
    """The words of a text in the given order, those that are kept, joined by single spaces."""
    words = text.split()
    if order is not None:
        words = [words[i] for i in order.tolist()]
    if kept is not None:
        words = [words[i] for i in np.flatnonzero(kept).tolist()]
    return b" ".join(words)


def _annotate(rearrange: Rearrange | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for row, end, data, offsets in tb.chunks(batch.column(1)):
                starts, ends, counts = tb.spans(data, offsets, tb.NOT_SPACE)
                words = tb.span_hashes(data, starts, ends)
                order = rearrange(ids[row:end].to_pylist(), counts) if rearrange else None
                if order is not None:
                    words = words[order]
                found = find_runs(words, counts)
                edges = np.zeros(len(counts) + 1, np.int64)
                np.cumsum(counts, out=edges[1:])
                at = np.searchsorted(found[:, 0], edges)
                base = np.repeat(edges[:-1], np.diff(at))
                cover = np.zeros(len(words) + 1, np.int64)
                np.add.at(cover, found[:, 0] + found[:, 2], 1)
                np.add.at(cover, found[:, 1], -1)
                kept = np.cumsum(cover[:-1]) == 0
                texts = []
                for k in range(end - row):
                    a, z = edges[k], edges[k + 1]
                    own = None if order is None else order[a:z] - a
                    texts.append(_collapsed(data[offsets[k] : offsets[k + 1]].tobytes(), own, kept[a:z] if at[k] < at[k + 1] else None))
                each = pa.StructArray.from_arrays([pa.array(x) for x in (found[:, 0] - base, found[:, 1] - found[:, 0], found[:, 2])], ["start", "length", "period"])
                runs = pa.ListArray.from_arrays(pa.array(at, pa.int32()), each)
                yield pa.record_batch([ids[row:end], pa.array(counts, pa.int64()), runs, pa.array(texts, pa.binary()).cast(pa.string())], ["id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rearrange: Rearrange | None = None) -> DataFrame:
    """(id, n_words, runs, collapsed) of each row: its runs (start, length, period) and its text with each run cut to one period."""
    schema = T.StructType([docs.schema[id_col], *T.StructType.fromDDL("n_words LONG, runs ARRAY<STRUCT<start: LONG, length: LONG, period: LONG>>, collapsed STRING").fields])
    return mapped(docs.select(id_col, F.col(text_col).cast("string").alias("_text")), _annotate(rearrange), schema)


def repeated_tails(ids: list, counts: np.ndarray) -> np.ndarray:
    """For one id in ten, by its CRC: from some word on, the words that follow there again and again."""
    order, base = np.arange(int(counts.sum())), 0
    for doc, n in zip(ids, counts.tolist()):
        h = 1 if doc is None else zlib.crc32(str(doc).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            order[base + a : base + n] = base + a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
        base += n
    return order


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, one in ten with a repeated tail; digests of the runs and of the collapsed texts."""
    found = periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), rearrange=repeated_tails)
    # greatest length, then least start: no two runs of a text have both alike
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("before"), r.period.alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string"))), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    best = found.withColumn("best", longest)
    return best.select(
        "doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.before")).alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
