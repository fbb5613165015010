"""Folds over the rows of a key in the order of their event time, with state in Spark's state store.

A row waits in the state store until the watermark has passed its block of event time; an event-time timer then folds
all blocks of the key that the watermark has passed, in order, into the key's memory and emits
what the fold makes. So results do not depend on how rows are dealt over micro-batches or in
which order they come, and equal those of a batch over the rows that were in time.

Every call of the store is a round trip between the worker and the JVM, and every group a batch of its own, so keys are dealt into ``SHARDS``
groups. The waiting rows of a group are one value while they
are ``FEW`` or fewer, with one timer, whatever the number of their blocks. More go into a map state by block, with a timer each. A worker holds one
Arrow batch while rows come in, and ``FEW`` rows, one block of one group and the memories of ``FEW`` keys while it folds; all other rows and memories stay in the store.

A key that is silent for ``idle_seconds`` of event time forgets: its next row starts anew, and a timer clears its
memory. With None it remembers for good, as the batch does. Rows with a null in their key belong to nobody and are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

#: The store that keyed state needs; a setting of the query, read when it starts.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

#: Rows of a group that wait in one value, and memories that a fold holds.
FEW = 256
#: Groups of keys, and so the most tasks that fold at a time. Fixed for the life of a checkpoint.
SHARDS = 1024

#: (memory or None, row) to (memory, rows made): called for each row of a key in turn; a row is a tuple of the columns asked for.
Fold = Callable[[tuple | None, tuple], tuple[tuple, list[tuple]]]


class _OrderedFold(StatefulProcessor):
    """Groups of keys; ``columns`` are the time, the rest of the order and then the ``n_keys`` key columns."""

    def __init__(self, columns: Sequence[str], n_keys: int, rows: T.StructType, key: T.StructType, memory: T.StructType, out: Sequence[str], fold: Fold, block_seconds: int, idle_seconds: float | None):
        self.columns, self.n_keys, self.rows, self.key, self.memory_schema, self.out, self.fold = list(columns), n_keys, rows, key, memory, list(out), fold
        self.block_ms, self.idle_ms = block_seconds * 1000, None if idle_seconds is None else int(idle_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # rows of any block, the timer that has been set for the earliest, and how many blocks wait in the map
        few = T.StructType([*self.rows.fields, T.StructField("_due", T.LongType()), T.StructField("_blocks", T.LongType())])
        self.few = handle.getValueState("few", few)
        self.waiting = handle.getMapState("waiting", T.StructType([T.StructField("block", T.LongType())]), self.rows)
        self.memory = handle.getMapState("memory", self.key, self.memory_schema)

    def _end(self, micros: int) -> int:
        """The end of a row's block in milliseconds."""
        return (micros // (self.block_ms * 1000) + 1) * self.block_ms

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.few.get()
        *few, due, blocks = [list(x) for x in held[:-2]] + list(held[-2:]) if held else [*([] for _ in self.columns), None, 0]
        for frame in rows:
            times = frame[self.columns[0]].astype("datetime64[us]").astype("int64").tolist()
            new = [times, *([None if x is None or x != x else x for x in frame[c].tolist()] for c in self.columns[1:])]
            few = [old + more for old, more in zip(few, new)]
            if len(few[0]) > FEW:
                blocks += self._spill(few, due)
                few, due = [[] for _ in self.columns], None
        if few[0]:
            end = self._end(min(few[0]))
            if due is None or end < due:
                self.handle.registerTimer(due := end)
        self.few.update((*few, due, blocks))
        return iter(())

    def _spill(self, few: list[list], due: int | None) -> int:
        """Rows put by block into the map; the number of blocks that are new there."""
        dealt: dict[int, list[tuple]] = {}
        for row in zip(*few):
            dealt.setdefault(self._end(row[0]), []).append(row)
        made = 0
        for end, part in dealt.items():
            at = (end // self.block_ms - 1,)
            new, old = [list(c) for c in zip(*part)], self.waiting.getValue(at) if self.waiting.containsKey(at) else None
            if old is None:
                made += 1
                if end != due:
                    self.handle.registerTimer(end)
            self.waiting.updateValue(at, tuple(new if old is None else [[*x, *y] for x, y in zip(old, new)]))
        return made

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, passed = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        waiting = self.few.get()
        dealt: dict[int, list[tuple]] = {}
        for row in zip(*waiting[:-2]) if waiting else ():
            dealt.setdefault(self._end(row[0]), []).append(row)
        blocks = waiting[-1] if waiting else 0
        spilled = {(k[0] + 1) * self.block_ms for k in self.waiting.keys()} if blocks else set()
        due = sorted(end for end in dealt.keys() | spilled if end <= max(passed, now))
        if not due:
            # an idle timer, or that of a block folded with another's
            if self.idle_ms is not None and now % self.block_ms:
                silent = [tuple(k) for k, memory in self.memory.iterator() if memory[0] // 1000 + self.idle_ms < now]
                for k in silent:
                    self.memory.removeKey(k)
            return
        held: dict[tuple, tuple | None] = {}
        made: list[tuple] = []
        for end in due:
            part = dealt.pop(end, [])
            if end in spilled:
                at = (end // self.block_ms - 1,)
                part = [*part, *zip(*self.waiting.getValue(at))]
                self.waiting.removeKey(at)
                blocks -= 1
            # each key's rows in order, one key after another
            width = len(self.columns) - self.n_keys
            for whole in sorted(part, key=lambda r: tuple((x is not None, x) for x in (*r[width:], *r[:width]))):
                row, k = whole[:width], whole[width:]
                if k not in held:
                    if len(held) >= FEW:
                        self._keep(held)
                        held = {}
                    held[k] = self.memory.getValue(k) if self.memory.containsKey(k) else None
                memory = held[k]
                latest, own = (memory[0], tuple(memory[1:])) if memory is not None else (None, None)
                if latest is not None and self.idle_ms is not None and row[0] - latest >= self.idle_ms * 1000:
                    own = None
                own, rows = self.fold(own, row)
                held[k] = (row[0], *own)
                made += [(*k, *r) for r in rows]
            if len(made) > FEW:
                yield pd.DataFrame(made, columns=self.out)
                made = []
        self._keep(held)
        left = [row for part in dealt.values() for row in part]
        if left or blocks:
            end = min(dealt, default=None)
            if end is not None and end != waiting[-2]:
                self.handle.registerTimer(end)
            self.few.update((*([list(c) for c in zip(*left)] if left else [[] for _ in self.columns]), end, blocks))
        else:
            self.few.clear()
        if made:
            yield pd.DataFrame(made, columns=self.out)

    def _keep(self, held: dict[tuple, tuple]) -> None:
        """Memories written back; with a limit, a timer for the time when each has been silent."""
        for k, memory in held.items():
            self.memory.updateValue(k, memory)
        if self.idle_ms is not None:
            # never a block's end: that timer might have been there
            ends = {latest // 1000 + self.idle_ms + 1 for latest, *_ in held.values()}
            for at in {at + (at % self.block_ms == 0) for at in ends}:
                self.handle.registerTimer(at)


def ordered_fold(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], memory: str, out: str, fold: Fold, block_seconds: int = 900, idle_seconds: float | None = None) -> DataFrame:
    """The rows that ``fold`` makes of each key: the keys and ``out``.

    ``columns`` begins with the event time, which folds get in microseconds and which carries the watermark; ties go by the other
    columns. ``memory`` and ``out`` are DDL; times that are made are timestamps in microseconds made by ``at_micros``.
    """
    fields = T.StructType.fromDDL(out).fields
    made = T.StructType([*[rows.schema[k] for k in keys], *fields])
    columns = [*columns, *keys]
    kinds = {c: T.LongType() if c == columns[0] else rows.schema[c].dataType for c in columns}
    waiting = T.StructType([T.StructField(c, T.ArrayType(kinds[c])) for c in columns])
    held = T.StructType([T.StructField("_latest", T.LongType()), *T.StructType.fromDDL(memory).fields])
    processor = _OrderedFold(columns, len(keys), waiting, T.StructType([rows.schema[k] for k in keys]), held, made.names, fold, block_seconds, idle_seconds)
    # a null in a batch of whole numbers would turn the other keys of the batch into floats
    known = rows.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    sharded = known.select(F.pmod(F.xxhash64(*keys), F.lit(SHARDS)).cast("int").alias("_shard"), *columns)
    return sharded.groupBy("_shard").transformWithStateInPandas(processor, made, "append", "EventTime")


def at_micros(micros: int) -> pd.Timestamp:
    return pd.Timestamp(micros, unit="us")


def started(writer) -> StreamingQuery:
    """Start a query with the state store it needs; the session's own setting stays as it was."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    name, store = STORE
    before = spark.conf.get(name, None)
    spark.conf.set(name, store)
    try:
        return writer.start()
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def memories(spark: SparkSession, checkpoint: str, operator: int = 0) -> DataFrame:
    """(keys, memory) of all keys after the last micro-batch, read from the state store."""
    name, store = STORE
    before = spark.conf.get(name, None)
    spark.conf.set(name, store)
    try:
        held = spark.read.format("statestore").option("path", checkpoint).option("operatorId", operator).option("stateVarName", "memory").load()
        return held.select("user_map_key.*", "user_map_value.*")
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)
