"""Telling a consumer that its batch cannot be filled in time."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rowrelay.schema import STEP

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WAIT_SCHEMA = T.StructType(
    [
        T.StructField("task_name", T.StringType()),
        T.StructField(STEP, T.LongType()),
        T.StructField("required", T.LongType()),
        T.StructField("available", T.LongType()),
        T.StructField("timed_out", T.BooleanType()),
    ]
)

_STATE = T.StructType([T.StructField("available", T.LongType()), T.StructField("settled", T.BooleanType())])


class WaitForBatch(StatefulProcessor):
    """One answer per task and step: enough rows came, or the time was up."""

    def __init__(self, required: int, timeout_ms: int):
        self.required = required
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("wait", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = not self.state.exists()
        available, settled = (0, False) if first else self.state.get()
        available = int(available) + sum(int(chunk["rows"].sum()) for chunk in rows)
        if first and available < self.required:
            # The first row or the request itself starts the clock.
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)
        answer = not settled and available >= self.required
        self.state.update((available, bool(settled) or answer))
        if answer:
            yield self._answer(key, available, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        available, settled = self.state.get()
        if not settled:
            self.state.update((available, True))
            yield self._answer(key, int(available), True)

    def _answer(self, key, available: int, timed_out: bool) -> pd.DataFrame:
        return pd.DataFrame(
            {"task_name": [key[0]], STEP: [int(key[1])], "required": [self.required], "available": [available], "timed_out": [timed_out]}
        )

    def close(self) -> None:
        pass


def _count_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial counts before the shuffle, so a busy step sends numbers instead of rows."""
    for batch in batches:
        yield batch.groupby(["task_name", STEP], as_index=False).size().rename(columns={"size": "rows"})


def _no_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.drop_duplicates().assign(rows=0)


def wait_stream(ready: DataFrame, required: int, timeout_seconds: float, requests: DataFrame | None = None) -> DataFrame:
    """(task_name, global_step, required, available, timed_out), once per task and step.

    ``requests`` is a stream of (task_name, global_step) of consumers that wait: a step that never
    gets a row is answered, too, with 0 available. Time is processing time, so the query has to run
    with a processing-time trigger.
    """
    schema = "task_name string, global_step bigint, rows bigint"
    counts = ready.select("task_name", STEP).mapInPandas(_count_rows, schema)
    if requests is not None:
        counts = counts.union(requests.select("task_name", STEP).mapInPandas(_no_rows, schema))
    return counts.groupBy("task_name", STEP).transformWithStateInPandas(
        statefulProcessor=WaitForBatch(required, int(timeout_seconds * 1000)),
        outputStructType=WAIT_SCHEMA,
        outputMode="Append",
        timeMode="ProcessingTime",
    )
