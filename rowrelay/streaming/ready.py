"""Readiness as a stream: every row or prompt group once per task, when it becomes complete.

State is kept per address block, not per row: one key holds the latest put of the cells of up
to ``width`` consecutive indices. A micro-batch touches each block's state once, and the
work on it is array arithmetic. A step of any size spreads over its blocks.

A micro-batch is one poll: readiness is judged after all its events. A clear drops every
cell whose latest put is not newer, whenever it arrives, and lets rows that lost a cell become
ready again. A block that holds nothing any more keeps its last clear only, and that for a
limited time where one is set.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rowrelay.functions import addressing as A
from rowrelay.functions.bits import position_in
from rowrelay.layout import Layout
from rowrelay.schema import INDEX, STEP
from rowrelay.streaming.events import spread_clears

# Python workers get this module's code with the query, so the package need not be
# installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

READY_SCHEMA = T.StructType(
    [
        T.StructField("task_name", T.StringType()),
        T.StructField(STEP, T.LongType()),
        T.StructField(INDEX, T.LongType()),
        T.StructField("group_id", T.LongType()),
        T.StructField("ready_seq", T.LongType()),
    ]
)

# Python hands back the number of the task; its name is looked up in the JVM.
_FRESH = T.StructType([T.StructField("task", T.IntegerType()), *READY_SCHEMA.fields[1:]])

_STATE = T.StructType(
    [
        T.StructField("latest", T.BinaryType()),
        T.StructField("announced", T.BinaryType()),
        T.StructField("cleared", T.LongType()),
    ]
)

_CLEARED = T.StructType([T.StructField("cleared", T.LongType())])

DEFAULT_WIDTH = 4096

# Cells of a task that are brought together by block before the shuffle (some 32 bytes each).
TOGETHER = 1 << 19
_PACKED = pa.schema([(STEP, pa.int64()), ("_block", pa.int64()), ("cells", pa.binary())])


class BlockReadiness(StatefulProcessor):
    """Cells produced and rows announced in one block of one step."""

    def __init__(self, tasks: list[list[int]], n_fields: int, width: int, samples: int, forget_ms: int | None = None):
        self.tasks = tasks
        self.n_fields = n_fields
        self.width = width
        self.samples = samples
        self.forget_ms = forget_ms
        # Clears of empty blocks are a variable of their own: only these expire, never what is produced.
        self.emptied = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("block", _STATE)
        if self.forget_ms is not None:
            self.emptied = handle.getValueState("emptied", _CLEARED, self.forget_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        step, block = int(key[0]), int(key[1])
        # Latest put of every cell; bounded by the block, not the input.
        latest, announced, cleared = self._load()
        known = latest.copy()
        before = cleared
        for chunk in rows:
            bit = chunk["bit"].to_numpy()
            seq = chunk["put_seq"].to_numpy(dtype=np.int64)
            is_clear = bit < 0
            if is_clear.any():
                cleared = max(cleared, int(seq[is_clear].max()))
            np.maximum.at(latest, bit[~is_clear], seq[~is_clear])
        latest[latest <= cleared] = -1
        produced = (latest >= 0).reshape(self.width, self.n_fields)
        if cleared > before:
            # What a task has been told stays told only where all its cells are newer than the clear.
            for i, fields in enumerate(self.tasks):
                announced[:, i] &= self._complete(produced, fields)
        # The put that completed a row is the newest of those that this micro-batch brought.
        brought = np.where(latest > known, latest, -1).reshape(self.width, self.n_fields)
        last_put = brought.max(axis=1)
        if self.samples > 1:
            last_put = np.repeat(last_put.reshape(-1, self.samples).max(axis=1), self.samples)
        fresh = []
        for i, fields in enumerate(self.tasks):
            complete = self._complete(produced, fields)
            new = np.flatnonzero(complete & ~announced[:, i])
            announced[new, i] = True
            if len(new):
                index = new + block * self.width
                fresh.append(
                    pd.DataFrame(
                        {
                            "task": np.int32(i),
                            STEP: step,
                            INDEX: index,
                            "group_id": index // self.samples,
                            "ready_seq": last_put[new],
                        }
                    )
                )
        self._store(latest, announced, cleared)
        yield from fresh

    def _complete(self, produced: np.ndarray, fields: list[int]) -> np.ndarray:
        complete = produced[:, fields].all(axis=1)
        if self.samples > 1:
            complete = np.repeat(complete.reshape(-1, self.samples).all(axis=1), self.samples)
        return complete

    def _store(self, latest: np.ndarray, announced: np.ndarray, cleared: int) -> None:
        if (latest >= 0).any():
            self.state.update((zlib.compress(latest.tobytes(), 1), np.packbits(announced).tobytes(), cleared))
            if self.emptied is not None:
                self.emptied.clear()
        elif cleared < 0:
            self.state.clear()
        elif self.emptied is None:
            self.state.update((b"", b"", cleared))
        else:
            self.state.clear()
            self.emptied.update((cleared,))

    def _load(self) -> tuple[np.ndarray, np.ndarray, int]:
        latest = np.full(self.width * self.n_fields, -1, dtype=np.int64)
        announced = np.zeros((self.width, len(self.tasks)), dtype=bool)
        if not self.state.exists():
            gone = self.emptied is not None and self.emptied.exists()
            return latest, announced, int(self.emptied.get()[0]) if gone else -1
        packed, told, cleared = self.state.get()
        if packed:
            latest = np.frombuffer(zlib.decompress(packed), dtype=np.int64).copy()
            bits = np.unpackbits(np.frombuffer(told, dtype=np.uint8), count=announced.size)
            announced = bits.astype(bool).reshape(announced.shape)
        return latest, announced, int(cleared)

    def close(self) -> None:
        pass


class PackedReadiness(BlockReadiness):
    """The same on rows that hold many cells each, as ``_latest_per_cell`` makes them."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        cells = (np.frombuffer(b"".join(chunk["cells"]), np.int64).reshape(-1, 2) for chunk in rows)
        return super().handleInputRows(key, (pd.DataFrame(c, columns=["bit", "put_seq"]) for c in cells), timerValues)


def _latest_per_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for a block instead of one for a cell, as far as a task sees its cells together.

    A row holds pairs (bit, put_seq) of 64-bit numbers. Of the puts of a cell only the last one counts.
    """
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= TOGETHER:
            yield _pack(held)
            held, n = [], 0
    if n:
        yield _pack(held)


def _pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(held)
    if any(c.null_count for c in rows.columns):
        raise ValueError("events without an address or a sequence cannot be placed")
    step, block, bit, seq = (rows[c].to_numpy() for c in (STEP, "_block", "bit", "put_seq"))
    order = np.lexsort((seq, bit, block, step))
    step, block, bit, seq = step[order], block[order], bit[order], seq[order]
    new_block = np.append(True, (np.diff(step) != 0) | (np.diff(block) != 0))
    last = np.append(new_block[1:] | (np.diff(bit) != 0), True)
    cells, first = np.stack((bit[last], seq[last]), axis=1), np.flatnonzero(new_block)
    cuts = np.append(np.cumsum(last)[first] - last[first], len(cells)).tolist()
    packed = [cells[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
    return pa.RecordBatch.from_arrays([pa.array(step[first]), pa.array(block[first]), pa.array(packed, pa.binary())], schema=_PACKED)


def ready_stream(
    production: DataFrame,
    layout: Layout,
    tasks: dict[str, list[str]],
    grouped: bool = False,
    clears: DataFrame | None = None,
    width: int = DEFAULT_WIDTH,
    forget_ms: int | None = None,
) -> DataFrame:
    """(task_name, global_step, global_index, group_id, ready_seq), each row once per task.

    With ``grouped`` the rows of a prompt group appear together, once all are complete.
    ``clears`` is a stream of (global_step, put_seq).

    With ``forget_ms`` the clear of a block without cells is forgotten that long after the block's last
    event (processing time), so that the state follows the live steps. A put older than the clear
    must arrive before; later it would count again. A checkpoint stays with the choice it began with, and such a
    stream wants a trigger by processing time: expiry needs micro-batches without input.
    """
    tasks = {t: list(dict.fromkeys(f)) for t, f in tasks.items() if f}
    names = sorted({f for fields in tasks.values() for f in fields})
    samples = layout.samples if grouped else 1
    # A step is a block of its own where it is smaller: nothing is kept for addresses that it has not.
    width = -(-min(width, layout.rows_per_step) // samples) * samples
    if not names:
        raise ValueError("no task asks for any field")
    index = F.col(INDEX)
    offset = F.pmod(index, F.lit(width).cast("bigint"))
    events = production.filter(F.col("field").isin(names)).select(
        STEP,
        A.floor_div(index, width).alias("_block"),
        (offset * len(names) + position_in(F.col("field"), names)).cast("bigint").alias("bit"),
        "put_seq",
    )
    if clears is not None:
        marks = spread_clears(clears, layout, width).select(STEP, "_block", F.lit(-1).cast("bigint").alias("bit"), "put_seq")
        events = events.unionByName(marks)
    events = events.mapInArrow(_latest_per_cell, f"{STEP} bigint, _block bigint, cells binary")
    wanted = [[names.index(f) for f in fields] for fields in tasks.values()]
    fresh = events.groupBy(STEP, "_block").transformWithStateInPandas(
        statefulProcessor=PackedReadiness(wanted, len(names), width, samples, forget_ms),
        outputStructType=_FRESH,
        outputMode="Append",
        timeMode="None" if forget_ms is None else "ProcessingTime",
    )
    labels = F.array(*[F.lit(t) for t in tasks])
    return fresh.select(F.element_at(labels, F.col("task") + 1).alias("task_name"), *READY_SCHEMA.names[1:])


def write_ready(ready: DataFrame, folder: str, checkpoint: str, **trigger):
    """Append ready rows to a table by task; steps share files, as a micro-batch may touch many."""
    return (
        ready.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .partitionBy("task_name")
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start(folder)
    )
