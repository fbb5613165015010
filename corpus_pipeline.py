"""From raw documents to packed training sequences.

Each stage reads the Parquet table that its predecessor wrote to the shared checkpoint
folder, so a stage lost to a failure starts again from a table.

All stages but the last keep the columns of ``documents``, whatever their names; columns that
the stages do not know are carried along. Null and empty texts are scored, stay one text each for
the near-duplicate stage, and make one token each. Rows that repeat an id and a text become one;
of a group of near duplicates the least id stays (a null one first), ties by the digest of the
text. Very long texts pass whole through every stage. Empty tables give an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, near_duplicates, packing, surrogates, toxicity
from tidemark.llm.shared import checkpointed, ensure_checkpoint_dir

#: No stage of the five has an equivalent in SQL.
ORACLE_SQL = None


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name in docs.columns:
        name += "_"
    return name


def _same_columns(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, n_chars counted again where there is one."""
    return changed.select(*[F.char_length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score(docs, toxicity.fit(docs, labels), to=(to := _free(docs, "_toxicity")))
    return scored.where(F.col(to) < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.deduplicate(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _same_columns(decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = docs.withColumnRenamed("n_entities", aside := _free(docs, "_n_entities"))
    return _same_columns(surrogates.pseudonymise(own, surrogates.session_key(spark)).drop("n_entities").withColumnRenamed(aside, "n_entities"), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(checkpointed(packing.cut(docs, packing.default_tokenizer())))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("personal_data", replace_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; the last one's rows."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(path := f"{folder}/{k}-{name}")
            docs = spark.read.parquet(path)
    return docs
