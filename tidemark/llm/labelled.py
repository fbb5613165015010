"""A bounded sample of labelled documents, and the hold-out rule shared by the classifiers."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import stored

#: Rows of each class, and bytes of text in all, that a classifier is fitted on at most.
MAX_ROWS = 2000
MAX_BYTES = 8 << 20
#: Longer texts are drawn after all others of their class, the shortest first.
LONG_BYTES = 128 << 10


def held_out(id_col: str = "doc_id") -> Column:
    """Labels of these documents are never learnt: CRC-32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def _leading(sizes: list[int], most: int) -> int:
    """How many of the first sizes stay within ``most`` bytes together; the first one always counts."""
    taken = total = 0
    for size in sizes:
        total += size
        if taken and total > most:
            break
        taken += 1
    return taken


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, id_col: str = "doc_id", text_col: str = "text", long_bytes: int = LONG_BYTES) -> tuple[pa.Array, list[int], float]:
    """(texts, labels, shift) of at most ``max_rows`` documents a class and ``max_bytes`` of whole texts.

    Documents are taken in the order of a hash of their id, those over ``long_bytes`` after
    all others, so that a long text takes no place from the rows behind it. Each class has half
    of the bytes and what the other leaves; its first document is taken whatever its length, so
    no labelled class is missing. Only ids and lengths are ordered; the texts of the chosen rows
    are joined afterwards. ``shift`` is what a fit on the sample adds to its log odds to
    have the class shares of all labelled rows that are not held out.

    Null ids and null labels are left out; an id with several labels counts as the
    largest, one with several texts as the smallest text.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("label")).where("label IN (0, 1)")
    sizes = docs.groupBy(id_col).agg(F.coalesce(F.max(F.octet_length(text_col)), F.lit(0)).cast("long").alias("size"))
    known = stored(sizes.join(known, id_col).withColumn("hash", F.xxhash64(id_col)))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = [F.greatest("size", F.lit(long_bytes)), F.col("hash"), F.col(id_col)]
    drawn = [known.where(F.col("label") == c).orderBy(*order).limit(max_rows).collect() for c in (0, 1)]
    wanted = [sum(r["size"] for r in rows) for rows in drawn]
    taken = [rows[: _leading([r["size"] for r in rows], max(max_bytes // 2, max_bytes - wanted[1 - c]))] for c, rows in enumerate(drawn)]
    chosen = sorted((r["hash"], r[id_col], r["label"]) for rows in taken for r in rows)
    schema = T.StructType([T.StructField(id_col, known.schema[id_col].dataType), T.StructField("label", T.IntegerType()), T.StructField("place", T.IntegerType())])
    places = docs.sparkSession.createDataFrame([(own, label, k) for k, (_, own, label) in enumerate(chosen)], schema)
    texts = docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(places), id_col).groupBy("place", "label").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))
    table = texts.toArrow().sort_by("place")
    shift = math.log(counts[1] / len(taken[1])) - math.log(counts[0] / len(taken[0])) if len(counts) == 2 else 0.0
    return table["text"].combine_chunks(), table["label"].to_pylist(), shift
