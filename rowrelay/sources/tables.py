"""The Parquet tables an exchange keeps in a shared folder."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from rowrelay.functions.addressing import floor_div
from rowrelay.layout import Layout
from rowrelay.schema import BITMAPS, CLAIMS, CLEARS, FIELDS, INDEX, PRODUCTION, STEP
from rowrelay.session import Files

_SEGMENT_HEAD = T.StructType(
    [
        T.StructField(STEP, T.LongType()),
        T.StructField(INDEX, T.LongType()),
        T.StructField("put_seq", T.LongType()),
        T.StructField("write_pos", T.LongType()),
        T.StructField("fields_written", T.ArrayType(T.StringType())),
    ]
)

_SCHEMAS = {
    "segments": _SEGMENT_HEAD,
    "production": PRODUCTION,
    "claims": CLAIMS,
    "bitmaps": BITMAPS,
    "clears": CLEARS,
    "fields": FIELDS,
}

# Folders are cut by runs of steps: a folder per step would leave a bulk put with a file
# per step, while inside a run the row-group statistics of the sorted files tell steps apart.
# Small steps share a folder until it has this many addresses: every folder costs each put a file and each read a listing.
BAND = "step_band"
STEPS_PER_BAND = 64
ROWS_PER_BAND = 1 << 18

_PARTITIONS = {"segments": [BAND], "production": [BAND], "bitmaps": [BAND], "claims": ["task_name", BAND]}


# Characters that Spark escapes in folder names (fixed values).
_ESCAPED = set("\"#%'*/:=?\\\x7f{[]^")


_REPLACING = "_replacing"
_STEPS_PER_FOLDER = "_steps_per_folder"


class Tables:
    """Append-only tables below ``path``, for any number of writers and readers.

    The first writer fixes how many steps a folder holds, by its ``layout`` where it names one.
    """

    def __init__(self, spark: SparkSession, path: str, layout: Layout | None = None):
        self.spark = spark
        self.path = path.rstrip("/")
        self._wanted = STEPS_PER_BAND if layout is None else max(STEPS_PER_BAND, ROWS_PER_BAND // layout.rows_per_step)
        self._steps_per_band: int | None = None
        self._types: dict[str, T.DataType] = {}
        self._last_seq = 0
        self._counting = threading.Lock()

    def location(self, name: str) -> str:
        return f"{self.path}/{name}"

    def steps_per_band(self, writes: bool = False) -> int:
        """Steps of a folder, as recorded by the first writer; tables that an earlier version has begun have no record."""
        if self._steps_per_band is None:
            files, record = self._files(), f"{self.path}/{_STEPS_PER_FOLDER}"
            if not files.exists(record):
                begun = any(files.exists(self.location(name)) for name in _PARTITIONS)
                steps = STEPS_PER_BAND if begun else self._wanted
                if not writes:
                    return steps
                files.take(record, str(steps))
            self._steps_per_band = int(files.text(record))
        return self._steps_per_band

    def neighbours(self, step: int) -> tuple[int, int]:
        """First and last step of the folder that holds ``step``."""
        steps = self.steps_per_band()
        first = step // steps * steps
        return first, first + steps - 1

    def schema(self, name: str, types: dict[str, T.DataType] | None = None) -> T.StructType:
        fields = list(_SCHEMAS[name].fields)
        if name == "segments":
            types = self.field_types() if types is None else types
            fields += [T.StructField(n, t) for n, t in types.items()]
        return T.StructType(fields)

    def read(
        self,
        name: str,
        steps: list[int] | None = None,
        types: dict[str, T.DataType] | None = None,
        span: tuple[int, int] | None = None,
        steps_of: DataFrame | None = None,
    ) -> DataFrame:
        """A table, or the rows of some steps; a table nobody has written yet is empty.

        Steps prune folders and row groups, so name them whenever they are few. ``span`` does the
        same for a range of steps, and ``steps_of`` (a table with steps) by a join on the folders.

        ``types`` names the columns to read of the segments, all known ones by default.
        """
        schema = self.schema(name, types)
        try:
            rows = self.spark.read.schema(_with_band(name, schema)).parquet(self.location(name))
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = self.spark.createDataFrame([], _with_band(name, schema))
        if steps is not None:
            if name in _PARTITIONS:
                rows = rows.filter(F.col(BAND).isin(sorted({s // self.steps_per_band() for s in steps})))
            rows = rows.filter(F.col(STEP).isin(steps))
        if span is not None:
            rows = rows.filter(F.col(STEP).between(*span))
            if name in _PARTITIONS:
                rows = rows.filter(F.col(BAND).between(*[s // self.steps_per_band() for s in span]))
        if steps_of is not None:
            rows = rows.join(steps_of.select(floor_div(F.col(STEP), self.steps_per_band()).alias(BAND)).distinct(), BAND, "left_semi")
        return rows.select(*schema.names)

    def read_stream(self, name: str) -> DataFrame:
        """A table as a stream of the rows appended to it."""
        schema = self.schema(name)
        # A file stream needs its folder to exist.
        self.append(name, self.spark.createDataFrame([], schema))
        return self.spark.readStream.schema(_with_band(name, schema)).parquet(self.location(name)).select(*schema.names)

    def append(self, name: str, rows: DataFrame, one_folder: bool = False) -> None:
        """Add rows; ``one_folder`` tells that they all belong to one step.

        Jobs of several sessions may append to a table at once: each keeps its pending files in a folder of its own.
        """
        attempt = uuid.uuid4().int % (1 << 31)
        own = {
            "mapreduce.job.application.attempt.id": attempt,
            "mapreduce.fileoutputcommitter.cleanup.skipped": True,
            "mapreduce.fileoutputcommitter.marksuccessfuljobs": False,
        }
        try:
            self._write(name, rows, one_folder).options(**own).mode("append").parquet(self.location(name))
        finally:
            self._files().delete(f"{self.location(name)}/_temporary/{attempt}")

    def claim(self, task: str, scope: str, pick: Callable[[int], DataFrame]) -> int | None:
        """Append the claims that ``pick`` chooses; returns their sequence number, or None where it chooses none.

        Any number of consumers of one task may claim at once. ``pick`` gets a sequence number and chooses rows by the
        claims as they are when it is called. What it chose is written aside, as an offer for the next turn of the
        task (in ``scope``, which all of them name alike). One of them gets the turn's name; the others drop their offers
        and pick again. Offers that have their turn belong to the table: whoever comes next moves what the owner has
        not moved yet, so a lost consumer holds nobody up.
        """
        turns, files = f"{self.path}/_turns/{_folder_name(task)}/{_folder_name(scope)}", self._files()
        while True:
            turn, last = self._settle(turns)
            seq, name = max(self.next_seq(), last + 1), f"{turn + 1}-{uuid.uuid4().hex}"
            offer = f"{turns}/offers/{name}"
            self._write("claims", pick(seq), one_folder=True).parquet(offer)
            if not files.below(offer):
                files.delete(offer)
                return None
            if files.take(f"{turns}/taken/{turn + 1}", f"{seq} {name}"):
                self._settle(turns)
                return seq
            files.delete(offer)

    def _settle(self, turns: str) -> tuple[int, int]:
        """Move offers that have their turn into the claims; returns the last turn and its sequence number."""
        files = self._files()
        numbers = {int(n) for n in (c.rsplit("/", 1)[1] for c in files.children(f"{turns}/taken")) if n.isdigit()}
        for offer in files.children(f"{turns}/offers"):
            name = offer.rsplit("/", 1)[1]
            turn = int(name.split("-")[0])
            if turn in numbers and files.text(f"{turns}/taken/{turn}").split()[1] == name:
                for file in files.below(offer):
                    files.move(f"{offer}/{file}", f"{self.location('claims')}/{file}")
                files.delete(offer)
        last = max(numbers, default=0)
        return last, int(files.text(f"{turns}/taken/{last}").split()[0]) if last else 0

    def replace(self, name: str, step: int, rows: DataFrame, task: str | None = None) -> None:
        """Overwrite the folder of a step (of a task's claims) with ``rows``, which may be none.

        ``rows`` may read the table itself: they are written aside first. A crash loses nothing: once the rows
        are whole a record names the folder they replace, and whoever opens the tables next does what is left.
        """
        folder = self.location(name)
        by = _PARTITIONS.get(name, [])
        if "task_name" in by:
            folder, rows = f"{folder}/task_name={_folder_name(task)}", rows.drop("task_name")
        if by:
            folder = f"{folder}/{BAND}={step // self.steps_per_band(writes=True)}"
        aside = f"{self.path}/{_REPLACING}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{aside}/rows")
        self._files().record(f"{aside}/folder", folder)
        self._take_over(aside)

    def _take_over(self, aside: str) -> None:
        """Put the rows that were written aside into the folder they replace; may be repeated."""
        files = self._files()
        placed = self.spark.read.parquet(f"{aside}/rows")
        if INDEX in placed.columns:
            placed = placed.sortWithinPartitions(STEP, INDEX)
        placed.write.mode("overwrite").parquet(files.text(f"{aside}/folder"))
        files.delete(f"{aside}/folder")
        files.delete(aside)

    def recover(self) -> int:
        """Finish replacements that were cut off; those whose rows were not whole are dropped. Nobody may replace meanwhile."""
        files, finished = self._files(), 0
        for aside in files.children(f"{self.path}/{_REPLACING}"):
            if files.exists(f"{aside}/folder"):
                self._take_over(aside)
                finished += 1
            else:
                files.delete(aside)
        return finished

    def _files(self) -> Files:
        return Files(self.spark)

    def tasks(self, step: int) -> list[str]:
        """Tasks with claims in the folder of a step (a few names)."""
        return sorted(r[0] for r in self.read("claims", span=self.neighbours(step)).select("task_name").distinct().collect())

    def _write(self, name: str, rows: DataFrame, one_folder: bool = False):
        """Few files per folder: rows of several folders are brought together by folder, and a
        folder too big for one task is split again at run time. Rows of one folder stay where
        they are. Files are sorted by address."""
        by = _PARTITIONS.get(name)
        if not by:
            return rows.write
        placed = rows.withColumn(BAND, floor_div(F.col(STEP), self.steps_per_band(writes=True)))
        if not one_folder:
            placed = placed.hint("rebalance", *by)
        return placed.sortWithinPartitions(*by, STEP, INDEX).write.partitionBy(*by)

    def field_types(self, needed: list[str] | None = None) -> dict[str, T.DataType]:
        """Spark type of every field, as fixed by the first put (one row per column name).

        A type never changes, so the table is read again only for fields not seen before.
        """
        if needed is None or any(f not in self._types for f in needed):
            first = self.read("fields").groupBy("field").agg(F.min_by("type_ddl", "put_seq").alias("ddl"))
            self._types = {r["field"]: T.DataType.fromDDL(r["ddl"]) for r in first.orderBy("field").collect()}
        return dict(self._types)

    def next_seq(self) -> int:
        """Sequence number of a new operation: the time in microseconds, always increasing.

        Writers on several machines are ordered by their clocks.
        """
        with self._counting:
            self._last_seq = max(self._last_seq + 1, time.time_ns() // 1000)
            return self._last_seq

    def append_record(self, name: str, *values) -> None:
        """Append one row given by its values."""
        columns = [F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(_SCHEMAS[name], values, strict=True)]
        self.append(name, self.spark.range(1).coalesce(1).select(*columns))

    def add_fields(self, types: dict[str, T.DataType], put_seq: int, positions: dict[str, int]) -> None:
        """Register fields that a put brings for the first time."""
        rows = [
            F.struct(
                F.lit(n).alias("field"), F.lit(t.simpleString()).alias("type_ddl"),
                F.lit(put_seq).cast("bigint").alias("put_seq"), F.lit(positions[n]).alias("field_pos"),
            )
            for n, t in types.items()
        ]
        self.append("fields", self.spark.range(1).coalesce(1).select(F.inline(F.array(*rows))))


def _folder_name(value: str) -> str:
    """A partition value as Spark writes it into a folder's name."""
    return "".join(f"%{ord(c):02X}" if c in _ESCAPED or ord(c) < 32 else c for c in value)


def _with_band(name: str, schema: T.StructType) -> T.StructType:
    if name not in _PARTITIONS:
        return schema
    return T.StructType(schema.fields + [T.StructField(BAND, T.LongType())])
