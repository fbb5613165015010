"""Toxicity by two class-conditional Kneser-Ney models.

Each class has an interpolated bigram model. Its lower order is made of continuation counts:
the number of different words that a word follows in the class. Discounts for n-grams seen
once, twice, and more often come from the counts of counts of the class. Bigrams back off to
the continuation distribution of the class, and that to one distribution that both classes
share: the continuation counts of the words over every document of the corpus. A rare
expression thus has the shared probability under both classes and says nothing. The two
length-normalised log-likelihoods are compared through a logistic curve.

Three things are chosen by the loss on texts that the models have not seen (two folds of the
labelled rows that are not held out): whether the bigrams take part or the continuation order
alone, a count added to every shared one, and a margin within which a word's difference counts
as none. The margin is needed because topics and languages are not equally frequent in the
classes, and over hundreds of common words that would outweigh the few telling ones.

The class models are fitted on a bounded sample of labelled rows (``labelled.MAX_ROWS`` and
``MAX_BYTES``), so what is broadcast is bounded by that sample; the curve's offset is set to
the class shares of all labelled rows that are not held out. The shared counts are exact up to
collisions of 32-bit hashes (``shared_counts``): tasks pass on the distinct pairs (word of the
sample, word before it) of their texts, a shuffle by the word before makes them distinct in the
corpus, and counts are added up by word. Scoring is a scan.

Null and empty texts have no evidence and score the calibrated base; without rows of both
classes every text scores 0. Rows are scored one by one, whatever their ids: repeated rows
score alike, ties have no meaning. A very long text is one chunk of its own, never cut. Other
columns stay as they are; one named like the score is replaced. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import textbytes as tb
from tidemark.llm.labelled import MAX_BYTES, MAX_ROWS, held_out, labelled_sample
from tidemark.llm.shared import mapped

#: Pairs that a task makes distinct before it passes them on; no pair is dropped.
MERGED_PAIRS = 1 << 19
#: Buckets of contexts at most, and words whose counts travel in one row.
MOST_BUCKETS, WORD_RANGE = 1 << 14, 1 << 12
#: Tried on texts the models have not seen: order, count added to every shared one, margin.
SETTINGS = tuple((order, added, margin) for order in (1, 2) for added in (1.0, 30.0) for margin in (0.0, 1.0, 2.0, 3.0))
_START = np.uint64(0x5BF03635)


def _previous(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The word before each word; at the start of a text a mark of its own."""
    before = np.empty_like(hashes)
    before[1:] = hashes[:-1]
    before[(np.cumsum(counts) - counts)[counts > 0]] = _START
    return before


def _pairs(before: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return tb.mix(before * np.uint64(0xC2B2AE3D27D4EB4F) + hashes)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the wanted keys in sorted keys, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    slot = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return slot, keys[slot] == wanted


def _of(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The values of the wanted keys, 0 for others."""
    if not len(keys):
        return np.zeros(len(wanted))
    slot, known = _find(keys, wanted)
    return np.where(known, values[slot], 0)


def discounts(counts: np.ndarray) -> np.ndarray:
    """What is taken off an n-gram seen 0, 1, 2, or 3 and more times, by the counts of counts."""
    n1, n2, n3, n4 = (int((counts == k).sum()) for k in (1, 2, 3, 4))
    if not min(n1, n2, n3, n4):
        return np.array([0.0, 0.75, 0.75, 0.75])
    y = n1 / (n1 + 2 * n2)
    return np.clip([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], 0.0, [0.0, 1.0, 2.0, 3.0])


@dataclass
class SharedCounts:
    """In how many contexts of the corpus each word of a vocabulary stands.

    Words beyond the vocabulary count 0: no class has seen them, so whatever is shared
    cancels between the classes.
    """

    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    contexts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def probability(self, hashes: np.ndarray, added: float) -> np.ndarray:
        return (_of(self.words, self.contexts, hashes) + added) / (float(self.contexts.sum()) + added * (len(self.words) + 1))


def shared_counts(docs: DataFrame, vocabulary: np.ndarray, text_col: str = "text") -> SharedCounts:
    """Continuation counts over all documents of ``vocabulary``, the words of a bounded sample.

    A pair is (word, 32-bit hash of the word before it). Tasks pass on sorted pairs in one row for
    each bucket of hashes, so a frequent word's pairs spread over all buckets; a task makes those of
    a bucket distinct and adds up its counts, in one row for each range of words.
    """
    words = np.unique(vocabulary)
    if not len(words):
        return SharedCounts()
    buckets = min(max(4 * docs.rdd.getNumPartitions(), 64), MOST_BUCKETS)
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def dealt(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        pairs = np.unique(np.concatenate(held))
        context = pairs & np.uint64(0xFFFFFFFF)
        bucket = (context % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")  # sorted within each bucket
        pairs, context = pairs[order], context[order].astype("<u4")
        slot = (pairs >> np.uint64(32)).astype(np.int64)
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows = [k for k in range(buckets) if edges[k] < edges[k + 1]]
        # words as steps, which are small and compress
        blobs = [np.diff(slot[edges[k] : edges[k + 1]], prepend=0).astype("<u4").tobytes() + context[edges[k] : edges[k + 1]].tobytes() for k in rows]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "pairs"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, _, data, offsets in tb.chunks(batch.column(0)):
                hashes, _, _, counts = tb.words(data, offsets)
                slot, known = _find(shared.value, hashes)
                context = _previous(hashes, counts) >> np.uint64(32)
                held.append(np.unique(slot[known].astype(np.uint64) << np.uint64(32) | context[known]))
                size += len(held[-1])
                if size > MERGED_PAIRS:
                    yield from dealt(held)
                    held, size = [], 0
        if held:
            yield from dealt(held)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, at, held, size = np.zeros(len(shared.value), np.int64), None, [], 0

        def add() -> None:
            if held:
                found[:] += np.bincount((np.unique(np.concatenate(held)) >> np.uint64(32)).astype(np.int64), minlength=len(found))

        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if bucket != at:
                    add()
                    at, held, size = bucket, [], 0
                numbers = np.frombuffer(blob.as_buffer(), "<u4")
                half = len(numbers) // 2
                held.append(np.cumsum(numbers[:half], dtype=np.uint64) << np.uint64(32) | numbers[half:].astype(np.uint64))
                size += half
                if size > 4 * MERGED_PAIRS:
                    held = [np.unique(np.concatenate(held))]
                    size = len(held[0]) // 2  # merged again when it has grown by half
        add()
        starts = [k for k in range(0, len(found), WORD_RANGE) if found[k : k + WORD_RANGE].any()]
        yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int32()), pa.array([found[k : k + WORD_RANGE].astype("<i8").tobytes() for k in starts], pa.binary())], ["start", "counts"])

    def add_up(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), "<i8") for x in table["counts"])
        return pa.table({"slot": pa.array(table["start"][0].as_py() + np.arange(len(total)), pa.int64()), "n": pa.array(total)})

    sent = mapped(docs.select(text_col), pairs, "bucket int, pairs binary").repartition("bucket").sortWithinPartitions("bucket")
    found = mapped(sent, count, "start int, counts binary").groupBy("start").applyInArrow(add_up, "slot long, n long").toArrow()
    shared.unpersist()
    contexts = np.zeros(len(words), np.int64)
    contexts[found["slot"].to_numpy()] = found["n"].to_numpy()
    return SharedCounts(words, contexts)


@dataclass
class KneserNey:
    """An interpolated bigram model of one class over the shared distribution."""

    words: np.ndarray
    kept: np.ndarray
    freed: float
    total: float
    pairs: np.ndarray
    pair_kept: np.ndarray
    contexts: np.ndarray
    context_total: np.ndarray
    context_freed: np.ndarray

    @classmethod
    def fit(cls, hashes: np.ndarray, counts: np.ndarray) -> KneserNey:
        before = _previous(hashes, counts)
        pairs, first, times = np.unique(_pairs(before, hashes), return_index=True, return_counts=True)
        off = discounts(times)[np.minimum(times, 3)]
        contexts, slot = np.unique(before[first], return_inverse=True)
        words, continuations = np.unique(hashes[first], return_counts=True)
        word_off = discounts(continuations)[np.minimum(continuations, 3)]
        return cls(words, continuations - word_off, float(word_off.sum()), float(continuations.sum()), pairs, times - off, contexts, np.bincount(slot, times, len(contexts)), np.bincount(slot, off, len(contexts)))

    def without_pairs(self) -> KneserNey:
        none = np.zeros(0)
        return KneserNey(self.words, self.kept, self.freed, self.total, none.astype(np.uint64), none, none.astype(np.uint64), none, none)

    def continuation(self, hashes: np.ndarray, shared: np.ndarray) -> np.ndarray:
        return (_of(self.words, self.kept, hashes) + self.freed * shared) / max(1.0, self.total)

    def probability(self, before: np.ndarray, pairs: np.ndarray, lower: np.ndarray) -> np.ndarray:
        slot, there = _find(self.contexts, before)
        if not there.any():
            return lower
        total = np.where(there, self.context_total[slot], 1.0)
        return np.where(there, (_of(self.pairs, self.pair_kept, pairs) + self.context_freed[slot] * lower) / total, lower)


@dataclass
class ClassModels:
    """Models of the ordinary (0) and the toxic (1) class."""

    shared: SharedCounts = field(default_factory=SharedCounts)
    classes: tuple[KneserNey, ...] = ()
    setting: tuple[int, float, float] = (1, 30.0, 2.0)
    slope: float = 0.0
    offset: float = -30.0

    @classmethod
    def fit(cls, hashes: np.ndarray, counts: np.ndarray, labels: np.ndarray, shared: SharedCounts) -> ClassModels:
        of_word = np.repeat(labels, counts)
        return cls(shared, tuple(KneserNey.fit(hashes[of_word == c], counts[labels == c]) for c in (0, 1)))

    def _ratios(self, hashes: np.ndarray, counts: np.ndarray, models: list[tuple[int, float]]) -> Iterator[np.ndarray]:
        """Toxic minus ordinary log-probability of each word, for each (order, added)."""
        before = _previous(hashes, counts)
        pairs = _pairs(before, hashes) if any(order == 2 for order, _ in models) else None
        for order, added in models:
            logs = []
            base = self.shared.probability(hashes, added)
            for model in self.classes:
                p = model.continuation(hashes, base)
                logs.append(np.log(np.maximum(model.probability(before, pairs, p) if order == 2 else p, 1e-30)))
            yield logs[1] - logs[0]

    def evidence(self, hashes: np.ndarray, counts: np.ndarray, settings: tuple[tuple[int, float, float], ...] = ()) -> np.ndarray:
        """Evidence a word for each text, 0 without words: one row for each setting, or the model's own alone."""
        wanted = settings or (self.setting,)
        if len(counts) > 200:
            # in blocks of texts, so that the many arrays of a word each stay small
            cuts = np.arange(0, len(counts), 200)
            edges = np.append(np.concatenate([[0], np.cumsum(counts)])[cuts], len(hashes))
            return np.concatenate([self.evidence(hashes[edges[k] : edges[k + 1]], counts[cut : cut + 200], wanted) for k, cut in enumerate(cuts)], axis=1)
        if not self.classes:
            return np.zeros((len(wanted), len(counts)))
        models, rows = list(dict.fromkeys(x[:2] for x in wanted)), {}
        for model, ratio in zip(models, self._ratios(hashes, counts, models)):
            for setting in (x for x in wanted if x[:2] == model):
                beyond = np.sign(ratio) * np.maximum(np.abs(ratio) - setting[2], 0)
                rows[setting] = tb.segment_sums(beyond, counts) / np.maximum(counts, 1)
        return np.array([rows[x] for x in wanted])

    def score(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if not self.slope:
            return np.full(len(counts), 1 / (1 + np.exp(-self.offset)))
        return 1 / (1 + np.exp(-np.clip(self.slope * self.evidence(hashes, counts)[0] + self.offset, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float, float]:
    """Slope, offset and mean loss of a one-variable logistic fit, by damped Newton steps."""
    scale = x.std() or 1.0
    a = np.stack([(x - x.mean()) / scale, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hessian = (a * (p * (1 - p))[:, None]).T @ a + 0.05 * np.eye(2)
        w += np.clip(np.linalg.solve(hessian, a.T @ (y - p) - 0.05 * w), -2, 2)
    p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
    loss = -float(np.mean(np.log(np.where(y == 1, p, 1 - p))))
    return float(w[0] / scale), float(w[1] - w[0] * x.mean() / scale), loss


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> ClassModels:
    texts, marks, shift = labelled_sample(docs, labels, label_col, max_rows, max_bytes)
    y = np.array(marks, np.int64)
    if len(set(marks)) < 2:
        return ClassModels()
    parts = [tb.words(data, offsets) for _, _, data, offsets in tb.chunks(texts)]
    hashes, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[3] for p in parts])
    shared = shared_counts(docs, hashes)
    edges = np.concatenate([[0], np.cumsum(counts)])

    def take(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([hashes[edges[r] : edges[r + 1]] for r in rows] or [hashes[:0]]), counts[rows]

    folds = [np.concatenate([np.flatnonzero(y == c)[f::2] for c in (0, 1)]) for f in (0, 1)]
    tested = np.concatenate(folds)
    setting, curve = None, None
    if min((y == 0).sum(), (y == 1).sum()) >= 2:
        evidence = np.concatenate([ClassModels.fit(*take(folds[1 - f]), y[folds[1 - f]], shared).evidence(*take(folds[f]), SETTINGS) for f in (0, 1)], axis=1)
        fits = [_logistic(row, y[tested]) for row in evidence]
        best = min(range(len(fits)), key=lambda k: fits[k][2])
        setting, curve = SETTINGS[best], fits[best]
    model = ClassModels.fit(hashes, counts, y, shared)
    model.setting = setting or model.setting
    model.slope, model.offset, _ = curve or _logistic(model.evidence(hashes, counts)[0], y)
    model.offset += shift
    if model.setting[0] == 1:  # the bigrams were not worth their cost; the continuation counts come from them
        model.classes = tuple(m.without_pairs() for m in model.classes)
    return model


def score(docs: DataFrame, model: ClassModels, text_col: str = "text", to: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 added; a column of that name is replaced."""
    docs = docs.drop(to)
    at = docs.columns.index(text_col)
    names = [*docs.columns, to]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for row, end, data, offsets in tb.chunks(batch.column(at)):
                hashes, _, _, counts = tb.words(data, offsets)
                scores[row:end] = shared.value.score(hashes, counts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names)

    return mapped(docs, judge, T.StructType([*docs.schema.fields, T.StructField(to, T.DoubleType())]))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
