"""Benchmark decontamination by an FM-index over each training shard.

A shard is the part of one task's input that fits in a chunk. Its words are ranked in the
benchmark's vocabulary; stretches in which no window can lie (a word, or a pair of
neighbouring words, that no window holds) are left out of the index, which cannot lose an
occurrence. The rest is indexed: suffix array, Burrows-Wheeler transform in a wavelet
matrix, suffix positions sampled at every eighth place. All windows are searched backward
at once through the wavelet ranks, their occurrences located by walking to the next
sampled position, and the spans merged.

There is no shuffle: documents are scanned once and each row answers for itself, so hot
sources, copies and lost executors need no care. The benchmark is broadcast in blocks of
about ``block_bytes``; a larger one costs one pass over the documents for each block, with a
written table between blocks, so that a task holds one block. The driver makes each block's windows
as arrays, about 50 bytes for each word of the block.

Null or empty texts have no words. Repeated rows and repeated ids are judged row by row; items
that tie in a window are all listed. An item without id marks words but is not listed; items that
repeat an id count once. A very long text is a shard of its own, never cut. Other columns stay.
Empty tables give empty ones; an empty benchmark marks nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import textbytes as tb
from tidemark.llm.shared import mapped, stored

SAMPLE_EVERY = 8
#: Bytes of benchmark texts whose windows the driver and each worker hold at once, about.
BLOCK_BYTES = 4 << 20


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit level after another."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.bits = max(1, int(n_symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        level = symbols.astype(np.int64)
        for b in range(self.bits - 1, -1, -1):
            bit = (level >> b) & 1
            ones = np.zeros(len(level) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(level) - int(ones[-1]))
            level = np.concatenate([level[bit == 0], level[bit == 1]])

    def rank(self, symbols: np.ndarray, position: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its position."""
        low = np.zeros(len(symbols), np.int64)
        high = position.astype(np.int64)
        for k, b in enumerate(range(self.bits - 1, -1, -1)):
            one = (symbols >> b) & 1
            low_ones, high_ones = self.ones[k][low], self.ones[k][high]
            low = np.where(one == 1, self.zeros[k] + low_ones, low - low_ones)
            high = np.where(one == 1, self.zeros[k] + high_ones, high - high_ones)
        return high - low

    def access(self, position: np.ndarray) -> np.ndarray:
        symbols = np.zeros(len(position), np.int64)
        position = position.astype(np.int64)
        for k, b in enumerate(range(self.bits - 1, -1, -1)):
            ones = self.ones[k][position]
            bit = self.ones[k][position + 1] - ones
            symbols |= bit.astype(np.int64) << b
            position = np.where(bit == 1, self.zeros[k] + ones, position - ones)
        return symbols


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    rank = np.zeros(n, np.int64)
    rank[order[1:]] = np.cumsum(symbols[order[1:]] != symbols[order[:-1]])
    step = 1
    while n and rank[order[-1]] < n - 1:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        step *= 2
    return order


class FMIndex:
    """Counts and places of patterns in a sequence of symbols 1..n; 0 separates stretches."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        # one more zero closes the sequence; it sorts first as it is the shortest suffix of zeros
        sequence = np.append(symbols, 0).astype(np.int64)
        order = suffix_array(sequence)
        self.n = len(sequence)
        self.matrix = WaveletMatrix(sequence[order - 1], n_symbols)
        self.before = np.zeros(n_symbols + 1, np.int64)
        np.cumsum(np.bincount(sequence, minlength=n_symbols), out=self.before[1:])
        self.sampled = (order % SAMPLE_EVERY) == 0
        self.slot = np.cumsum(self.sampled) - 1
        self.samples = order[self.sampled]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of right-aligned patterns, by backward search."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        width = patterns.shape[1]
        for k in range(width):
            live = np.flatnonzero((lengths > k) & (low < high))
            if not len(live):
                break
            symbol = patterns[live, width - 1 - k].astype(np.int64)
            low[live] = self.before[symbol] + self.matrix.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.matrix.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of suffixes: step back in the sequence until a sampled one is met."""
        places = np.zeros(len(rows), np.int64)
        rows, at, steps = rows.copy(), np.arange(len(rows)), 0
        while len(rows):
            hit = self.sampled[rows]
            places[at[hit]] = self.samples[self.slot[rows[hit]]] + steps
            rows, at = rows[~hit], at[~hit]
            symbol = self.matrix.access(rows)
            rows = self.before[symbol] + self.matrix.rank(symbol, rows)
            steps += 1
        return places


class Windows:
    """The windows of one block of items, in ranks of the block's vocabulary."""

    def __init__(self, ids: list[str | None], texts: pa.Array, n: int):
        data, offsets = tb.utf8(texts)
        hashes, _, _, counts = tb.words(data, offsets)
        self.vocabulary = np.unique(hashes)
        ranks = (np.searchsorted(self.vocabulary, hashes) + 1).astype(np.int32)
        known = sorted({x for x in ids if x is not None})
        codes = {x: k for k, x in enumerate(known)}
        code = np.array([codes.get(x, -1) for x in ids], np.int64)
        # each item's windows, right-aligned in rows of n words
        sizes = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
        item = np.repeat(np.arange(len(ids)), sizes)
        start = np.repeat(np.cumsum(counts) - counts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(item))
        width = np.minimum(counts, n)[item]
        rows = np.zeros((len(item), n), np.int32)
        for k in range(n):
            live = np.flatnonzero(k < width)
            rows[live, n - width[live] + k] = ranks[start[live] + k]
        _, first, window = np.unique(rows.view(f"V{4 * n}").ravel(), return_index=True, return_inverse=True)
        self.items = np.array(known, dtype=object)
        self.lengths, self.patterns = width[first].astype(np.int64), rows[first]
        named = code[item] >= 0
        owned = np.unique(window[named] * (len(known) + 1) + code[item][named])
        self.owners = owned % (len(known) + 1)
        self.owner_edges = np.searchsorted(owned // (len(known) + 1), np.arange(len(first) + 1))
        self.shortest = int(self.lengths.min()) if len(first) else 0
        self.size = len(self.vocabulary) + 1
        left, right = self.patterns[:, :-1].astype(np.int64), self.patterns[:, 1:]
        self.pairs = np.unique((left * self.size + right)[left > 0])
        self.filter = np.zeros(1 << 18, bool)
        self.filter[(self.vocabulary >> np.uint64(46)).astype(np.int64)] = True

    def occurrences(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, first word) of every occurrence in a shard's words."""
        none = np.zeros(0, np.int64)
        if not self.shortest or not len(hashes):
            return none, none
        ranks = np.zeros(len(hashes), np.int64)
        maybe = np.flatnonzero(self.filter[(hashes >> np.uint64(46)).astype(np.int64)])
        slot = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), self.size - 2)
        same = self.vocabulary[slot] == hashes[maybe]
        ranks[maybe[same]] = slot[same] + 1
        follows = np.zeros(len(hashes), bool)
        both = np.flatnonzero((ranks[:-1] > 0) & (ranks[1:] > 0))
        if len(self.pairs) and len(both):
            codes = ranks[both] * self.size + ranks[both + 1]
            slot = np.minimum(np.searchsorted(self.pairs, codes), len(self.pairs) - 1)
            follows[both + 1] = self.pairs[slot] == codes
        first = np.cumsum(counts)[:-1]
        follows[first[first < len(follows)]] = False
        heads = np.flatnonzero((ranks > 0) & ~follows)
        if not len(heads):
            return none, none
        known = ranks > 0
        run = np.cumsum(known & ~follows) - 1  # of known words; a run is cut wherever a word does not follow
        size = np.bincount(run[known], minlength=len(heads))
        keep = np.flatnonzero(known & (size[np.maximum(run, 0)] >= self.shortest))
        if not len(keep):
            return none, none
        begins = np.concatenate([[True], run[keep[1:]] != run[keep[:-1]]])
        place = np.arange(len(keep)) + np.cumsum(begins)
        sequence = np.zeros(int(place[-1]) + 1, np.int64)
        sequence[place] = ranks[keep]
        word_at = np.zeros(len(sequence), np.int64)
        word_at[place] = keep
        index = FMIndex(sequence, self.size)
        low, high = index.search(self.patterns, self.lengths)
        times = high - low
        window = np.repeat(np.arange(len(times)), times)
        rows = np.repeat(low - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(int(times.sum()))
        return window, word_at[index.locate(rows)]


def _judge(windows: Windows, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[list[str]]]:
    """Flags of the hit words, and the items of each text as sorted strings."""
    window, first = windows.occurrences(hashes, counts)
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + windows.lengths[window], -1)
    hit = np.cumsum(edge[:-1]) > 0
    items: list[list[str]] = [[] for _ in counts]
    if len(window):
        # a window counts once in a text, however often it occurs there and however many items own it
        once = np.unique(np.searchsorted(np.cumsum(counts), first, "right") * len(windows.lengths) + window)
        text, window = once // len(windows.lengths), once % len(windows.lengths)
        times = np.diff(windows.owner_edges)[window]
        start = windows.owner_edges[window]
        owner = windows.owners[np.repeat(start - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(int(times.sum()))]
        pairs = np.unique(np.repeat(text, times) * (len(windows.items) + 1) + owner)
        for pair in pairs.tolist():
            items[pair // (len(windows.items) + 1)].append(windows.items[pair % (len(windows.items) + 1)])
    return hit, items


def _n_blocks(benchmark: DataFrame, text_col: str, block_bytes: int) -> int:
    return int((benchmark.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // block_bytes) + 1


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, n: int) -> Iterator[tuple[list, pa.Array]]:
    """``n`` blocks of items, dealt by a hash, each fetched by itself."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        table = part.toArrow()
        yield table["item"].to_pylist(), table["text"].combine_chunks()


def _merged_items(found: list[list[str]], before: pa.Array) -> list[list[str]]:
    """Sorted items of each text, with those that blocks before have found."""
    return [sorted({*own, *(earlier or ())}) for own, earlier in zip(found, before.to_pylist())]


def _add_runs(hit: np.ndarray, counts: np.ndarray, runs: pa.Array) -> np.ndarray:
    """``hit`` with the words in each text's ``runs`` (first word, word after the last, ...) flagged too."""
    edges = runs.flatten().to_numpy(zero_copy_only=False).reshape(-1, 2).astype(np.int64)
    times = np.array([len(x) // 2 for x in runs], np.int64)
    base = np.repeat(np.cumsum(counts) - counts, times)
    mark = np.zeros(len(hit) + 1, np.int64)
    np.add.at(mark, base + edges[:, 0], 1)
    np.add.at(mark, base + edges[:, 1], -1)
    return hit | (np.cumsum(mark[:-1]) > 0)


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: id, n_words, n_hit, items (sorted strings), spans.

    ``spans`` are the merged removal spans: byte offsets [start, end) in the UTF-8 text,
    from the first to the last hit word of a run. Each block of the benchmark is a pass over
    the rows that adds to the runs of hit words found so far, so rows stay apart whatever
    their ids are.
    """
    answer = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))]
    runs_field = T.StructField("runs", T.ArrayType(T.LongType()))
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    id_field = T.StructField(id_col, docs.schema[id_col].dataType)

    def run(frame: DataFrame, shared, first: bool, last: bool) -> DataFrame:
        schema = T.StructType([id_field, *answer] if last else [id_field, T.StructField("text", T.StringType()), answer[2], runs_field])

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row, end, data, offsets in tb.chunks(batch.column(1)):
                    hashes, starts, ends, counts = tb.words(data, offsets)
                    hit, items = _judge(shared.value, hashes, counts)
                    if not first:
                        items = _merged_items(items, batch.column(2)[row:end])
                        hit = _add_runs(hit, counts, batch.column(3)[row:end])
                    spans: list[list[dict]] = [[] for _ in counts]
                    runs: list[list[int]] = [[] for _ in counts]
                    if hit.any():
                        text = np.repeat(np.arange(len(counts)), counts)
                        word = np.cumsum(counts) - counts
                        begins, stops = hit.copy(), hit.copy()
                        begins[1:] &= ~hit[:-1] | (text[1:] != text[:-1])
                        stops[:-1] &= ~hit[1:] | (text[1:] != text[:-1])
                        for a, b in zip(np.flatnonzero(begins).tolist(), np.flatnonzero(stops).tolist()):
                            k = int(text[a])
                            spans[k].append({"start": int(starts[a] - offsets[k]), "end": int(ends[b] - offsets[k])})
                            runs[k] += [a - int(word[k]), b + 1 - int(word[k])]
                    ids, found = batch.column(0)[row:end], pa.array(items, pa.list_(pa.string()))
                    if last:
                        columns = [ids, pa.array(counts, pa.int64()), pa.array(tb.segment_sums(hit.astype(np.int64), counts), pa.int64()), found, pa.array(spans, span_type)]
                    else:
                        columns = [ids, batch.column(1)[row:end], found, pa.array(runs, pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(columns, schema.names)

        return mapped(frame, judge, schema)

    frame = docs.select(id_col, F.col(text_col).alias("text"))
    blocks = _n_blocks(benchmark, item_text_col, block_bytes)
    for k, (ids, texts) in enumerate(_blocks(benchmark, item_col, item_text_col, blocks)):
        shared = docs.sparkSession.sparkContext.broadcast(Windows(ids, texts, n))
        frame = run(frame, shared, k == 0, k == blocks - 1)
        if k < blocks - 1:
            frame = stored(frame)
            shared.unpersist()
    return frame


def _runs(hit: np.ndarray, counts: np.ndarray) -> list[list[int]]:
    """Of each text the runs of its hit words: first word, word after the last, ..."""
    runs: list[list[int]] = [[] for _ in counts]
    text = np.repeat(np.arange(len(counts)), counts)
    word = np.cumsum(counts) - counts
    begins, stops = hit.copy(), hit.copy()
    begins[1:] &= ~hit[:-1] | (text[1:] != text[:-1])
    stops[:-1] &= ~hit[1:] | (text[1:] != text[:-1])
    for a, b in zip(np.flatnonzero(begins).tolist(), np.flatnonzero(stops).tolist()):
        runs[int(text[a])] += [a - int(word[text[a]]), b + 1 - int(word[text[a]])]
    return runs


def _without(data: np.ndarray, offsets: np.ndarray, hit: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(texts with a hit word, their bytes without the runs of hit words)."""
    touched = np.flatnonzero(tb.segment_sums(hit.astype(np.int64), counts))
    text = np.repeat(np.arange(len(counts)), counts)
    same = text[1:] == text[:-1]
    gone = np.zeros(len(data) + 1, np.int64)
    np.add.at(gone, starts[hit], 1)
    np.add.at(gone, ends[hit], -1)
    gone = np.cumsum(gone[:-1]) > 0
    between = np.flatnonzero(hit[:-1] & hit[1:] & same)
    fill = np.zeros(len(data) + 1, np.int64)
    np.add.at(fill, ends[between], 1)
    np.add.at(fill, starts[between + 1], -1)
    gone |= np.cumsum(fill[:-1]) > 0
    return touched, [data[offsets[k] : offsets[k + 1]][~gone[offsets[k] : offsets[k + 1]]] for k in touched]


def _replaced(texts: pa.Array, changed: dict[int, str]) -> pa.Array:
    if not changed:
        return texts
    rows = texts.to_pylist()
    for row, text in changed.items():
        rows[row] = text
    return pa.array(rows, texts.type)


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with the removal spans cut out of its texts; other columns and rows stay.

    Cutting brings words together that were apart, so a text is searched again until
    nothing is found. With several blocks, a round marks the words that any block hits in
    the uncut text, cuts their merged runs, and rows with a hit go through another round:
    the result is that of one block. Texts without a hit are returned byte for byte.
    """
    names = docs.columns
    at = names.index(text_col)
    runs_field = T.StructField("_td_runs", T.ArrayType(T.LongType()))
    hit_field = T.StructField("_td_hit", T.BooleanType())

    def at_once(frame: DataFrame, shared) -> DataFrame:
        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                changed: dict[int, str] = {}
                for row, end, data, offsets in tb.chunks(batch.column(at)):
                    owners = np.arange(row, end)
                    while len(owners):
                        hashes, starts, ends, counts = tb.words(data, offsets)
                        hit, _ = _judge(shared.value, hashes, counts)
                        touched, pieces = _without(data, offsets, hit, starts, ends, counts)
                        if not len(touched):
                            break
                        owners = owners[touched]
                        for owner, piece in zip(owners.tolist(), pieces):
                            changed[owner] = piece.tobytes().decode()
                        data = np.concatenate(pieces)
                        offsets = np.concatenate([[0], np.cumsum([len(x) for x in pieces])]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([_replaced(c, changed) if k == at else c for k, c in enumerate(batch.columns)], names)

        return mapped(frame, clean, frame.schema)

    def marked(frame: DataFrame, shared, first: bool, last: bool) -> DataFrame:
        """With the runs of hit words so far; the last block cuts them and says which rows it changed."""
        schema = T.StructType([*docs.schema.fields, hit_field if last else runs_field])

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                changed: dict[int, str] = {}
                runs: list[list[int]] = []
                for row, end, data, offsets in tb.chunks(batch.column(at)):
                    hashes, starts, ends, counts = tb.words(data, offsets)
                    hit, _ = _judge(shared.value, hashes, counts)
                    if not first:
                        hit = _add_runs(hit, counts, batch.column(len(names))[row:end])
                    if not last:
                        runs += _runs(hit, counts)
                        continue
                    touched, pieces = _without(data, offsets, hit, starts, ends, counts)
                    for k, piece in zip(touched.tolist(), pieces):
                        changed[row + k] = piece.tobytes().decode()
                columns = [_replaced(c, changed) if k == at else c for k, c in enumerate(batch.columns[: len(names)])]
                added = pa.array([k in changed for k in range(batch.num_rows)], pa.bool_()) if last else pa.array(runs, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*columns, added], schema.names)

        return mapped(frame, mark, schema)

    context = docs.sparkSession.sparkContext
    blocks = _n_blocks(benchmark, item_text_col, block_bytes)
    if blocks == 1:
        for ids, texts in _blocks(benchmark, item_col, item_text_col, 1):
            return at_once(docs, context.broadcast(Windows(ids, texts, n)))
    done, open_ = [], docs
    while True:
        for k, (ids, texts) in enumerate(_blocks(benchmark, item_col, item_text_col, blocks)):
            shared = context.broadcast(Windows(ids, texts, n))
            open_ = stored(marked(open_, shared, k == 0, k == blocks - 1))
            shared.unpersist()
        done.append(open_.where("NOT _td_hit").select(*names))
        open_ = open_.where("_td_hit").select(*names)
        if open_.isEmpty():
            break
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    return whole


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contamination(docs, benchmark)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def brute_force(docs: list[tuple], items: list[tuple], n: int = 10) -> list[tuple]:
    """The contract of op1 in plain Python, for tests."""
    import re

    def split(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))

    windows = {}
    for item, text in items:
        own = split(text)
        for k in range(max(1, len(own) - n + 1) if own else 0):
            windows.setdefault(tuple(own[k : k + n]), set()).add(item)
    out = []
    for doc, text in docs:
        own, hit, found = split(text), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(own) - size + 1):
                if (w := tuple(own[k : k + size])) in windows:
                    hit |= set(range(k, k + size))
                    found |= windows[w]
        ids = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(own), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out
