"""Quality by logistic regression on hashed word n-grams, trained with FTRL-proximal.

Tokens are runs of letters and digits and runs of other non-space characters, lower-cased;
unigrams and bigrams fall into ``2**BITS`` cells. A text is the set of its cells, scaled to
length one, so a score is one sparse dot product and does not grow with length.

The weights are fitted on a bounded sample of labelled rows (``labelled.MAX_ROWS`` and
``MAX_BYTES``), the bias then set to the class shares of all labelled rows that are not held
out; they are one array of fixed size, which is broadcast. Scoring is a scan.

Null and empty texts score the bias alone. Without rows of both classes every text scores
that base. Rows are scored one by one, whatever their ids: repeated rows score alike, ties have no
meaning. A very long text is one chunk of its own, never cut. Other columns stay as they are; one
named like the score is replaced. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import textbytes as tb
from tidemark.llm.labelled import MAX_ROWS, held_out, labelled_sample
from tidemark.llm.shared import mapped

BITS = 19
#: Bytes of labelled texts at most; a text becomes one small array of cells, so more fit than in a language model.
MAX_BYTES = 12 << 20
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.01, 0.01
#: Passes over the sample: at least MIN_STEPS updates, from 3 to 30 passes.
MIN_STEPS = 20_000
_SYMBOL = tb.word_table((0x21, 0x2F), (0x3A, 0x60), (0x7B, 0x7E))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cells, cells per text): the distinct unigram and bigram cells of each text."""
    n = len(offsets) - 1
    data = tb.LOWER[data]
    found = [tb.spans(data, offsets, table) for table in (tb.ALNUM, _SYMBOL)]
    starts, ends = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    order = np.argsort(starts, kind="stable")
    hashes = tb.span_hashes(data, starts[order], ends[order])
    counts = found[0][2] + found[1][2]
    text = np.repeat(np.arange(n, dtype=np.int64), counts)
    same = text[1:] == text[:-1]
    pairs = tb.mix(hashes[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[1:])[same]
    shift = np.uint64(64 - BITS)
    cells = np.concatenate([hashes >> shift, pairs >> shift]).astype(np.int64)
    keys = np.unique(np.concatenate([text, text[1:][same]]) << BITS | cells)
    return keys & ((1 << BITS) - 1), np.bincount(keys >> BITS, minlength=n)


def train(texts: pa.Array, labels: list[int]) -> tuple[np.ndarray, float]:
    """(weights, bias) after a few passes in a fixed shuffled order."""
    weights, bias = np.zeros(1 << BITS, np.float64), 0.0
    if len(set(labels)) < 2:
        return weights, 30.0 if labels and labels[0] else -30.0
    rows: list[np.ndarray] = []
    for _, _, data, offsets in tb.chunks(texts):
        cells, counts = features(data, offsets)
        rows += np.split(cells.astype(np.int32), np.cumsum(counts)[:-1])
    z, g2 = np.zeros(1 << BITS), np.zeros(1 << BITS)
    z_bias = g2_bias = 0.0
    y = np.array(labels, np.float64)
    random = np.random.default_rng(7)
    for _ in range(min(30, max(3, MIN_STEPS // len(rows)))):
        for r in random.permutation(len(rows)):
            cells = rows[r]
            x = 1 / np.sqrt(max(1, len(cells)))
            zi, gi = z[cells], g2[cells]
            w = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(gi)) / ALPHA + L2))
            bias = -z_bias / ((BETA + np.sqrt(g2_bias)) / ALPHA)
            p = 1 / (1 + np.exp(-np.clip(w.sum() * x + bias, -30, 30)))
            g = (p - y[r]) * x
            z[cells] += g - (np.sqrt(gi + g * g) - np.sqrt(gi)) / ALPHA * w
            g2[cells] += g * g
            g = p - y[r]
            z_bias += g - (np.sqrt(g2_bias + g * g) - np.sqrt(g2_bias)) / ALPHA * bias
            g2_bias += g * g
    live = np.abs(z) > L1
    weights[live] = -(z[live] - np.sign(z[live]) * L1) / ((BETA + np.sqrt(g2[live])) / ALPHA + L2)
    return weights, float(-z_bias / ((BETA + np.sqrt(g2_bias)) / ALPHA))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> tuple[np.ndarray, float]:
    texts, marks, shift = labelled_sample(docs, labels, label_col, max_rows, max_bytes)
    weights, bias = train(texts, marks)
    return weights.astype(np.float32), bias + shift


def score(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", to: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 added; a column of that name is replaced."""
    docs = docs.drop(to)
    at = docs.columns.index(text_col)
    names = [*docs.columns, to]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for row, end, data, offsets in tb.chunks(batch.column(at)):
                cells, counts = features(data, offsets)
                total = tb.segment_sums(weights[cells].astype(np.float64), counts) / np.sqrt(np.maximum(counts, 1))
                scores[row:end] = 1 / (1 + np.exp(-np.clip(total + bias, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names)

    return mapped(docs, judge, T.StructType([*docs.schema.fields, T.StructField(to, T.DoubleType())]))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
