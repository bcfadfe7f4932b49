"""Exact-size batches from a stream of ready rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rowrelay.functions.blocks import rank_by_block
from rowrelay.operators.read import live_rows
from rowrelay.schema import INDEX, STEP

HANDED = T.StructType(
    [
        T.StructField("task_name", T.StringType()),
        T.StructField(STEP, T.LongType()),
        T.StructField(INDEX, T.LongType()),
        T.StructField("ready_seq", T.LongType()),
        T.StructField("batch_no", T.LongType()),
        T.StructField("batch_index", T.LongType()),
        T.StructField("epoch", T.LongType()),
        T.StructField("waiting", T.BooleanType()),
    ]
)

_PAIR = ["task_name", STEP]


class BatchCutter:
    """Cuts batches of exactly ``k`` rows per task and step, lowest indices first.

    Every micro-batch writes its ready rows aside once: a state is read and kept by one job, however often
    the rows are used. Then it writes one folder: the rows handed out and the rows left over. The
    next one reads the left-overs back from there, so the work follows the new rows and at
    most ``k - 1`` old ones per task and step. A repeated micro-batch reads the same
    left-overs and overwrites its own folder: no row is handed out twice.

    Without ``whole`` nothing waits: the rows of a task and step that fill no batch come as a smaller last one.
    """

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        k: int,
        samples: int = 1,
        clears: Callable[[], DataFrame] | None = None,
        whole: bool = True,
    ):
        if k < 1 or k % samples:
            raise ValueError(f"batch size {k} is not a positive multiple of {samples}")
        self.spark, self.folder, self.k, self.clears, self.whole = spark, folder.rstrip("/"), k, clears, whole

    def _part(self, epoch: int) -> str:
        return f"{self.folder}/epoch={epoch}"

    def _read(self, epoch: int) -> DataFrame:
        stored = T.StructType([f for f in HANDED if f.name != "epoch"])
        return self.spark.read.schema(stored).parquet(self._part(epoch))

    def _kept(self, ready: DataFrame) -> DataFrame:
        """The ready rows of a micro-batch as a table, which the next one replaces."""
        ready.write.mode("overwrite").parquet(f"{self.folder}/_ready")
        return self.spark.read.schema(ready.schema).parquet(f"{self.folder}/_ready")

    def cut(self, ready: DataFrame, epoch: int) -> DataFrame:
        """Write the micro-batch's folder; returns the rows handed out in it."""
        rows = self._kept(ready.select(*_PAIR, INDEX, "ready_seq"))
        if epoch > 0:
            rows = rows.unionByName(self._read(epoch - 1).filter("waiting").select(*rows.columns))
        if self.clears is not None:
            rows = live_rows(rows, self.clears(), "ready_seq")
        ranked = rank_by_block(rows, _PAIR, INDEX, "_pos", size="_size")
        k = F.lit(self.k).cast("bigint")
        number = F.call_function("div", F.col("_pos"), k)
        waits = number >= F.call_function("div", F.col("_size"), k) if self.whole else F.lit(False)
        placed = ranked.select(
            *_PAIR,
            INDEX,
            "ready_seq",
            F.when(~waits, number).alias("batch_no"),
            F.when(~waits, F.pmod(F.col("_pos"), k)).alias("batch_index"),
            waits.alias("waiting"),
        )
        placed.write.mode("overwrite").partitionBy("waiting").parquet(self._part(epoch))
        return self._read(epoch).filter("NOT waiting").drop("waiting")

    def batches(self) -> DataFrame:
        """All rows handed out so far; a batch is (task_name, global_step, epoch, batch_no)."""
        stored = self.spark.read.schema(HANDED).parquet(self.folder)
        return stored.filter("NOT waiting").drop("waiting")


def batch_stream(
    ready: DataFrame,
    cutter: BatchCutter,
    checkpoint: str,
    then: Callable[[DataFrame, int], None] | None = None,
    **trigger,
):
    """Run the cutter on a stream of ready rows; ``then(rows, epoch)`` sees what was handed out."""

    def each(rows: DataFrame, epoch: int) -> None:
        handed = cutter.cut(rows, epoch)
        if then is not None:
            then(handed, epoch)

    return (
        ready.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
