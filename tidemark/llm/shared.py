"""Shared folders for intermediate tables, and Arrow batches of bounded size."""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Bytes of rows that pass to a Python worker at once, about; a longer row is a batch of its own.
BATCH_BYTES = 2 << 20
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use spark.checkpoint.dir; where it is unset, a folder of our own in local mode only, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidemark-"))


def checkpointed(frame: DataFrame) -> DataFrame:
    """``frame`` written to the shared folder; what follows reads it and does not compute it again."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint()


def stored(frame: DataFrame) -> DataFrame:
    """``frame`` as a Parquet table in the shared folder: smaller than a checkpoint, and read by column."""
    spark = frame.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.parquet(path)


def mapped(frame: DataFrame, each: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` over batches of about ``BATCH_BYTES``: by rows alone, a batch of long texts could fill a worker."""
    conf = frame.sparkSession.conf
    if int(conf.get(_BATCHES).rstrip("b")) > BATCH_BYTES:
        conf.set(_BATCHES, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from each(batches)
        # a worker lives on for other tasks; what its buffers took goes back
        pa.default_memory_pool().release_unused()

    return frame.mapInArrow(run, schema)
