"""Removal of byte strings that occur twice, by longest-previous-factor arrays.

A window is a string of ``length`` bytes. Only windows that can have an equal are put in
suffix order, so candidates are narrowed first, without losing any:

1. The least hash of the 24-byte strings in a window is its anchor; equal windows have
   equal anchors. Neighbouring windows with one anchor form a run, and one row for each run
   (anchor, digest of the run's bytes, place) is grouped: a run that occurs in two places is
   repeated as a whole, an anchor with a single run has no repeats. Runs end at ``PIECE`` windows
   or a little later, where the anchor stands again, so that the pieces of a periodic run are
   equal and collapse to one; a text is read in slabs of ``SLAB`` bytes, at whose borders runs end too.
2. Anchors with several different runs meet in a task, one copy of each run. The suffixes that
   start in the runs are put in suffix order (prefix doubling), with the common prefixes of
   neighbours. For each suffix the previous and the next smaller position in that order are
   its nearest earlier texts; the longer of the two common prefixes is its longest previous
   factor. Where that reaches ``length``, the window is a later copy of the one it points to.
3. An anchor with more bytes of runs than ``PART_BYTES`` is dealt out in parts; the windows
   that no part finds earlier meet in a grouping on a digest of their bytes, which also
   settles which of them is the first of all.

The order of places is (digest of the text, place), everywhere the same, so the result does
not depend on these sizes or on how rows are dealt out. Texts are compared by digest, so
exact copies cost one text. With ``keep_first`` the first occurrence stays whole, even where
later copies of other strings overlap it, as does the row with the least id of equal texts;
otherwise every occurrence goes. Null texts are empty; texts under ``length`` bytes keep all.
Repeated rows, and ids that stand for several texts, are judged row by row; columns other than
the id and the text are not read. A very long text takes the memory of one slab at a time and
some copies of its bytes, whatever it repeats.
Removing bytes may cut a character, so kept bytes are binary.
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
from tidemark.llm.shared import checkpointed, mapped, stored

LENGTH = 400
GRAM = 24
#: Bytes of runs that are compared at once, if not of one anchor; bytes beyond which an anchor is dealt out.
CHUNK_BYTES, PART_BYTES = 1 << 19, 2 << 20
#: Windows after which a run is cut; bytes of one text that are hashed at once; bytes of slices handed on at once.
PIECE, SLAB, SLICE_BYTES = 1 << 16, 2 << 20, 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


def _rolling(data: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all strings of ``width`` bytes, by doubling; equal strings hash equally."""
    table = tb.mix(np.arange(256, dtype=np.uint64) + np.uint64(0x51ED270B))
    hashes, have = table[data], 1
    total, done, power = None, 0, _BASE
    rest = width
    while rest:
        if rest & 1:
            if total is None:
                total = hashes
            else:
                keep = len(data) - (done + have) + 1
                shift = np.uint64(pow(_BASE, have, 1 << 64))
                total = total[:keep] * shift + hashes[done : done + keep]
            done += have
        rest >>= 1
        if rest:
            keep = len(hashes) - have
            if keep <= 0:
                return np.zeros(0, np.uint64)
            hashes = hashes[:keep] * np.uint64(power) + hashes[have:]
            power = power * power % (1 << 64)
            have *= 2
    return tb.mix(total)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    have, level = 1, values
    while have * 2 <= width:
        level = np.minimum(level[:-have], level[have:])
        have *= 2
    return np.minimum(level[: len(values) - width + 1], level[width - have :]) if width > have else level


def _pieces(start: np.ndarray, stop: np.ndarray, key: np.ndarray, own: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, index of the run): runs over ``piece`` windows cut where their anchor stands.

    ``key`` holds the places of all anchors in order, those of run i from ``own[i]`` on.
    """
    long = np.flatnonzero(stop - start > piece)
    if not len(long):
        return start, stop, np.arange(len(start))
    starts, run, done = [], [], 0
    for k in long:
        starts.append(start[done : k + 1])
        run.append(np.arange(done, k + 1))
        done = k + 1
        at, cuts = int(start[k]), []
        while stop[k] - at > piece:
            next_ = np.searchsorted(key, own[k] + at + piece)
            at = int(key[next_] - own[k]) if next_ < len(key) else int(stop[k])
            if at >= stop[k]:  # the next anchor is that of the last window, or another run's
                break
            cuts.append(at)
        starts.append(np.array(cuts, np.int64))
        run.append(np.full(len(cuts), k))
    starts, run = np.concatenate([*starts, start[done:]]), np.concatenate([*run, np.arange(done, len(start))])
    ends = stop[run]
    same = run[1:] == run[:-1]
    ends[:-1][same] = starts[1:][same]
    return starts, ends, run


def anchor_runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, piece: int = PIECE) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor: text, place, windows, anchor, digest, tied (an anchor met twice)."""
    width = length - GRAM + 1
    grams = _rolling(data, GRAM) if len(data) >= length else np.zeros(0, np.uint64)
    if not len(grams):
        return {k: np.zeros(0, np.int64) for k in ("text", "place", "windows", "anchor", "digest", "tied")}
    least = _sliding_min(grams, width)
    n = len(least)
    # windows that cross into another text are no windows
    inside = np.zeros(len(data) + 1, np.int8)
    has = np.diff(offsets) >= length
    inside[offsets[:-1][has]] += 1
    inside[offsets[1:][has] - length + 1] -= 1
    valid = np.cumsum(inside[:n]) > 0
    change = np.ones(n, bool)
    change[1:] = (least[1:] != least[:-1]) | ~valid[:-1]
    change[offsets[:-1][offsets[:-1] < n]] = True
    start = np.flatnonzero(change & valid)
    stop_mark = np.ones(n, bool)
    stop_mark[:-1] = change[1:] | ~valid[1:]
    stop = np.flatnonzero(stop_mark & valid) + 1
    anchor = least[start]
    # places of the anchors: an anchor met twice within a run may repeat a window inside the run
    kinds = np.unique(anchor)
    table = np.zeros(1 << 20, bool)
    table[(kinds >> np.uint64(44)).astype(np.int64)] = True
    at = np.flatnonzero(table[(grams >> np.uint64(44)).astype(np.int64)])
    slot = np.minimum(np.searchsorted(kinds, grams[at]), len(kinds) - 1)
    same = kinds[slot] == grams[at]
    key = np.sort(slot[same] * (len(data) + 1) + at[same])
    own = np.searchsorted(kinds, anchor) * (len(data) + 1)
    start, stop, run = _pieces(start, stop, key, own, piece)
    anchor, own = anchor[run], own[run]
    digest = tb.span_hashes(data, start, stop + length - 1)
    met = np.searchsorted(key, own + stop + width - 1) - np.searchsorted(key, own + start)
    text = np.searchsorted(offsets, start, "right") - 1
    return {"text": text, "place": start - offsets[text], "windows": stop - start, "anchor": anchor.view(np.int64), "digest": digest.view(np.int64), "tied": met > 1}


def _runs(texts: DataFrame, length: int, piece: int, slab: int) -> DataFrame:
    """anchor, run, text, at (place << 32 | windows), tied for each run of (digest, text)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in tb.chunks(batch.column(1), min(slab, 1 << 20)):
                # a chunk beyond a slab is one text; its slabs share the bytes of the windows that cross a border
                for begin in range(0, max(len(data), 1), slab):
                    part = data[begin : begin + slab + length - 1] if len(data) > slab else data
                    r = anchor_runs(part, offsets if len(data) <= slab else np.array([0, len(part)]), length, piece)
                    text = batch.column(0)[row:end].to_numpy()[r["text"]]
                    yield pa.RecordBatch.from_arrays([pa.array(r["anchor"]), pa.array(r["digest"]), pa.array(text), pa.array(r["place"] + begin << 32 | r["windows"]), pa.array(r["tied"].astype(bool))], ["anchor", "run", "text", "at", "tied"])

    return mapped(texts, find, "anchor long, run long, text long, at long, tied boolean")


def _dense(keys: np.ndarray) -> np.ndarray:
    """Ranks of keys in their order, equal for equal keys."""
    order = np.argsort(keys)
    found = keys[order]
    out = np.empty(len(keys), np.int32)
    out[order] = np.cumsum(np.concatenate([[False], found[1:] != found[:-1]]), dtype=np.int32)
    return out


def _levels(data: np.ndarray, length: int) -> list[np.ndarray]:
    """Ranks of the strings of 1, 2, 4, ... bytes at each place, by prefix doubling, while they fit in ``length``."""
    levels, have = [data.astype(np.int32)], 1
    while have * 2 <= length:
        last = levels[-1]
        n = len(last)
        following = np.minimum(np.arange(n, dtype=np.int64) + have, n - 1)
        levels.append(_dense(last.astype(np.int64) * (max(n, 256) + 1) + last[following]))
        have *= 2
    return levels


def suffix_order(levels: list[np.ndarray], starts: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Indices of ``starts`` by group, then by their first ``length`` bytes, then by place."""
    n = len(levels[0]) + 1
    total, at = group.astype(np.int64), 0
    for k in range(len(levels) - 1, -1, -1):
        if length - at >= 1 << k:
            total = _dense(total * n + levels[k][starts + at]).astype(np.int64)
            at += 1 << k
    return np.argsort(total, kind="stable")


def common_prefixes(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Bytes, up to ``length``, that the strings at ``a`` and ``b`` share."""
    n = len(levels[0])
    shared = np.zeros(len(a), np.int32)
    for k in range(len(levels) - 1, -1, -1):
        for _ in range(1 + (k == len(levels) - 1)):  # the longest string may fit twice
            fits = shared + (1 << k) <= length
            same = levels[k][np.minimum(a + shared, n - 1)] == levels[k][np.minimum(b + shared, n - 1)]
            shared[fits & same] += 1 << k
    return shared


def _smaller(places: np.ndarray, prefixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix in order, the last one before it with a smaller place (-1: none), and what they share.

    ``prefixes[k]`` is what suffixes k - 1 and k share. Each suffix steps from one candidate to that
    one's own until the place is smaller; what lies between is known to be larger.
    """
    found, shared = np.arange(-1, len(places) - 1), prefixes.copy()
    open_ = np.flatnonzero(found >= 0)
    while len(open_ := open_[(found[open_] >= 0) & (places[found[open_]] > places[open_])]):
        over = found[open_]
        shared[open_] = np.minimum(shared[open_], shared[over])
        found[open_] = found[over]
    shared[found < 0] = 0
    return found, shared


def longest_previous_factors(levels: list[np.ndarray], starts: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, up to ``length``, that each string shares with an earlier one of its group; index of that one, or -1)."""
    order = suffix_order(levels, starts, group, length)
    prefixes = np.zeros(len(order), np.int32)
    prefixes[1:] = common_prefixes(levels, starts[order[:-1]], starts[order[1:]], length)
    prefixes[1:][group[order[1:]] != group[order[:-1]]] = 0
    previous, with_previous = _smaller(order, prefixes)
    # the next smaller place is the previous one of the reversed order
    turned = np.concatenate([[0], prefixes[:0:-1]]).astype(np.int32)
    following, with_following = _smaller(order[::-1], turned)
    following, with_following = len(order) - 1 - following[::-1], with_following[::-1]
    ahead = with_following > with_previous
    factor, source = np.zeros(len(order), np.int32), np.full(len(order), -1, np.int64)
    factor[order] = np.where(ahead, with_following, with_previous)
    best = np.where(ahead, np.minimum(following, len(order) - 1), previous)
    source[order] = np.where(np.where(ahead, with_following, with_previous) > 0, order[best], -1)
    return factor, source


def _factors(segments: list[tuple], length: int) -> tuple[np.ndarray, ...]:
    """Per window of the segments (group, text, place, bytes): segment, shift, later copy, earlier one of a copy; and the bytes."""
    group, _, _, raw = zip(*segments)
    data = np.frombuffer(b"".join(raw), np.uint8)
    sizes = np.array([len(x) for x in raw], np.int64)
    base = np.cumsum(sizes) - sizes
    windows = sizes - length + 1
    segment = np.repeat(np.arange(len(raw)), windows)
    shift = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    _, groups = np.unique(np.array(group), return_inverse=True)
    # segments come by (group, text, place), so that an earlier window has a smaller index
    factor, source = longest_previous_factors(_levels(data, length), base[segment] + shift, groups[segment], length)
    later = factor >= length
    copied = np.zeros(len(later), bool)
    copied[source[later]] = True
    return segment, shift, later, copied, data, base


def _compare(length: int):
    """Rows sorted by group: (group, parts, text, place, whole, bytes) -> spans and, for dealt-out anchors, open suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        held, last = 0, None

        def result() -> Iterator[pa.RecordBatch]:
            if not waiting:
                return
            segment, shift, later, copied, data, base = _factors([(w[0], w[2], w[3], w[5]) for w in waiting], length)
            parts, text, place, whole = (np.array([w[k] for w in waiting]) for k in (1, 2, 3, 4))
            repeated = later | copied | whole[segment]
            at = place[segment] + shift
            dealt = parts[segment] > 1
            pick = np.flatnonzero(repeated & (later | ~dealt))
            # neighbouring windows with the same answer form one span
            cut = np.ones(len(pick), bool)
            cut[1:] = (pick[1:] != pick[:-1] + 1) | (segment[pick[1:]] != segment[pick[:-1]]) | (later[pick[1:]] != later[pick[:-1]])
            begin = np.flatnonzero(cut)
            count = np.diff(np.append(begin, len(pick)))
            p = pick[begin]
            yield _batch(text[segment[p]], at[p] << 32 | count, ~later[p], np.ones(len(p), bool), np.zeros(len(p), np.int64), np.zeros(len(p), bool))
            opened = np.flatnonzero(dealt & ~later)
            if len(opened):
                start = base[segment[opened]] + shift[opened]
                digest = tb.span_hashes(data, start, start + length).view(np.int64)
                for cut_at in range(0, len(opened), 50_000):
                    d = opened[cut_at : cut_at + 50_000]
                    yield _batch(text[segment[d]], at[d] << 32 | 1, np.ones(len(d), bool), repeated[d], digest[cut_at : cut_at + 50_000], np.ones(len(d), bool))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != last and held >= CHUNK_BYTES:
                    yield from result()
                    waiting, held = [], 0
                last = row[0]
                waiting.append(row)
                held += len(row[5])
        yield from result()

    return run


def _batch(text, at, first, again, window, opened) -> pa.RecordBatch:
    columns = zip((text, at, first, again, window, opened), (pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.bool_()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], ["text", "at", "first", "again", "window", "opened"])


def repeated_windows(texts: DataFrame, length: int = LENGTH, firsts: bool = True) -> DataFrame:
    """(text, at, first): windows with an equal elsewhere, ``at`` being place << 32 | count of windows.

    ``texts`` has (digest, text). ``first`` marks windows whose earliest occurrence this is; without
    ``firsts`` it does not for windows that a run repeats in itself, which spares comparing those.
    """
    runs = stored(_runs(texts, length, PIECE, SLAB))
    slice_bytes = SLICE_BYTES
    place = F.struct("text", "at")
    several = F.min(place) != F.max(place)
    kinds = stored(runs.groupBy("anchor", "run").agg(F.min(place).alias("least"), several.alias("several"), F.max("tied").alias("tied")))
    several = F.col("several")
    size = F.col("least.at").bitwiseAND(0xFFFFFFFF) + length - 1
    anchors = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.max(F.col("tied") if firsts else F.col("tied") & ~several).alias("tied"), F.sum(size).alias("bytes"))
    mixed = anchors.where("kinds > 1 OR tied").select("anchor", F.ceil(F.col("bytes") / PART_BYTES).cast("long").alias("parts"))
    # of a run that occurs twice all but the first occurrence are copies; the first one is too if its windows lie earlier in another run
    twice = kinds.where(several).select("anchor", "run", "least").join(mixed.select("anchor", F.lit(True).alias("mixed")), "anchor", "left")
    is_least = place == F.col("least")
    whole = runs.join(twice, ["anchor", "run"]).where(~(is_least & F.col("mixed").isNotNull())).select("text", "at", is_least.alias("first"))
    wanted = kinds.join(mixed, "anchor").select("anchor", "parts", F.col("least.text").alias("digest"), F.col("least.at").alias("at"), several.alias("whole"))
    # one text may hold many runs; they travel with it in one row for each text
    by_text = wanted.groupBy("digest").agg(F.collect_list(F.struct("anchor", "parts", "at", "whole")).alias("runs"))
    single = texts.join(by_text, "digest").select("digest", "text", "runs")

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, texts_, lists = batch.column(0).to_pylist(), batch.column(1), batch.column(2)
            data, offsets = tb.utf8(texts_)
            out: list[tuple] = []
            held = 0
            for k in range(len(digests)):
                raw = data[offsets[k] : offsets[k + 1]].tobytes()
                for r in lists[k].as_py():
                    at, windows = r["at"] >> 32, r["at"] & 0xFFFFFFFF
                    part = hash((digests[k], at)) % r["parts"]
                    out.append((r["anchor"], part, r["parts"], digests[k], at, r["whole"], raw[at : at + windows + length - 1]))
                    held += windows + length - 1
                    if len(out) >= 4096 or held >= slice_bytes:
                        yield _slice_batch(out)
                        out, held = [], 0
            if out:
                yield _slice_batch(out)

    cut = mapped(single, slices, "anchor long, part long, parts long, text long, place long, whole boolean, bytes binary")
    # copies of a text bring the same slice again
    grouped = cut.withColumn("group", F.xxhash64("anchor", "part")).repartition(2 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "group").sortWithinPartitions("group", "text", "place")
    compared = checkpointed(mapped(grouped.select("group", "parts", "text", "place", "whole", "bytes"), _compare_once(length), "text long, at long, first boolean, again boolean, window long, opened boolean"))
    spans = compared.where("NOT opened").select("text", "at", "first")
    opened = compared.where("opened").select("text", "at", "again", "window")
    met = opened.groupBy("window").agg(F.min(place).alias("least"), (F.max("again") | (F.min(place) != F.max(place))).alias("again")).where("again").select("window", "least")
    again = opened.join(met, "window").select("text", "at", (place == F.col("least")).alias("first"))
    return whole.unionByName(spans).unionByName(again)


def _compare_once(length: int):
    """``_compare`` on rows of which each (group, text, place) counts once; rows come sorted by these."""
    compare = _compare(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def distinct() -> Iterator[pa.RecordBatch]:
            last = None
            for batch in batches:
                keys = [tuple(x) for x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist())]
                keep = [k for k, key in enumerate(keys) if key != (keys[k - 1] if k else last)]
                last = keys[-1] if keys else last
                yield batch.take(pa.array(keep, pa.int64()))

        yield from compare(distinct())

    return run


def _slice_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    types = [pa.int64()] * 5 + [pa.bool_(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["anchor", "part", "parts", "text", "place", "whole", "bytes"])


def _spans(gone: np.ndarray, stay: np.ndarray, length: int) -> np.ndarray:
    """Edges (start, end, start, ...) of what the windows ``gone`` cover and ``stay`` do not; windows are place << 32 | count."""
    ends = lambda at: (at >> 32) + (at & 0xFFFFFFFF) + length - 1
    place = np.concatenate([gone >> 32, ends(gone), stay >> 32, ends(stay)])
    sign = np.repeat([1, -1], len(gone)), np.repeat([1, -1], len(stay))
    order = np.argsort(place, kind="stable")
    place = place[order]
    removing = np.cumsum(np.concatenate([sign[0], np.zeros(2 * len(stay), np.int64)])[order])
    staying = np.cumsum(np.concatenate([np.zeros(2 * len(gone), np.int64), sign[1]])[order])
    last = np.append(place[1:] != place[:-1], True)[: len(place)]
    place, removed = place[last], (removing[last] > 0) & (staying[last] == 0)
    return place[removed != np.concatenate([[False], removed])[: len(removed)]]


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_first: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, spans (removed [start, end) byte runs) and kept (the other bytes) of each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    found = repeated_windows(rows.select("digest", "text"), length, keep_first)
    stays = F.col("first") & F.lit(keep_first)
    marks = found.groupBy(F.col("text").alias("digest")).agg(F.collect_set(F.when(~stays, F.col("at"))).alias("marks"), F.collect_set(F.when(stays, F.col("at"))).alias("firsts"))
    copies = rows.groupBy("digest").agg(F.count("*").alias("copies"), F.min("id").alias("least_id"))
    marked = rows.join(copies.where("copies > 1").join(marks, "digest", "full"), "digest", "left")
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("n_bytes", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.BinaryType())])
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    all_gone = F.coalesce(F.col("copies") > 1, F.lit(False))
    if keep_first:
        all_gone = all_gone & F.coalesce(F.col("id") != F.col("least_id"), F.lit(False))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.utf8(batch.column(1))
            gone, marks_, firsts = batch.column(2).to_pylist(), batch.column(3), batch.column(4)
            spans, kept = [], []
            for k in range(batch.num_rows):
                own = data[offsets[k] : offsets[k + 1]]
                n = len(own)
                if gone[k] and n >= length:
                    spans.append([{"start": 0, "end": n}])
                    kept.append(b"")
                    continue
                at = marks_[k].values.to_numpy() if marks_[k].is_valid else np.zeros(0, np.int64)
                if not len(at):
                    spans.append([])
                    kept.append(own.tobytes())
                    continue
                edges = _spans(at, firsts[k].values.to_numpy(), length).tolist()
                spans.append([{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2])])
                kept.append(b"".join(own[a:b].tobytes() for a, b in zip([0, *edges[1::2]], [*edges[::2], n])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(spans, span_type), pa.array(kept, pa.binary())], schema.names)

    return mapped(marked.select("id", "text", all_gone.alias("gone"), "marks", "firsts"), cut, schema)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cut = remove_repeats(docs, keep_first=False)
    return cut.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(docs: list[tuple], length: int = LENGTH) -> list[tuple]:
    """The contract of op10 by a table of all windows, for tests."""
    seen: dict[bytes, int] = {}
    texts = [(i, (t or "").encode()) for i, t in docs]
    for _, raw in texts:
        for k in range(len(raw) - length + 1):
            seen[raw[k : k + length]] = seen.get(raw[k : k + length], 0) + 1
    out = []
    for i, raw in texts:
        covered = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if seen[raw[k : k + length]] > 1:
                covered[k : k + length] = b"\x01" * length
        kept = bytes(b for b, c in zip(raw, covered) if not c)
        spans = sum(1 for k in range(len(raw)) if covered[k] and (k == 0 or not covered[k - 1]))
        out.append((i, len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out
