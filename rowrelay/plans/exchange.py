"""The exchange: put fields onto rows, fetch ready batches per task, read them, clear steps."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowrelay.layout import Layout
from rowrelay.operators import bitmaps as BM, fetch as FE, ingest as IN, read as RD, status as ST
from rowrelay.schema import INDEX, KEY, STEP
from rowrelay.sources.tables import Tables

_POSITION = ("batch_id", "batch_index", STEP, INDEX)


def _some(step: int | None) -> list[int] | None:
    return None if step is None else [step]


class Exchange:
    """Operators composed over persisted tables.

    Every call is a Spark job on the tables of the step concerned; the driver keeps nothing
    but column types, so a new session on the same folder continues where another left.
    """

    def __init__(self, spark: SparkSession, path: str, layout: Layout):
        self.spark = spark
        self.layout = layout
        self.tables = Tables(spark, path, layout)

    # --- tables of one step, cleared rows left out ---------------------------------

    def production(self, global_step: int | None = None) -> DataFrame:
        return self._live("production", "put_seq", _some(global_step))

    def batch_production(self, metadata: DataFrame) -> DataFrame:
        """The log around a batch: folders that hold none of its steps are left out."""
        near = self.tables.read("production", steps_of=metadata)
        return RD.live_rows(near, self.tables.read("clears"), "put_seq")

    def claims(self, task_name: str | None = None, global_step: int | None = None) -> DataFrame:
        live = self._live("claims", "claim_seq", _some(global_step))
        return live if task_name is None else live.filter(F.col("task_name") == task_name)

    def status_index(self, global_step: int | None = None) -> DataFrame:
        """Bitmaps of what was produced and claimed, cleared steps left out."""
        return self._live("bitmaps", "seq", _some(global_step))

    def segments(
        self, steps: list[int] | None = None, fields: list[str] | None = None, span: tuple[int, int] | None = None
    ) -> DataFrame:
        """Written cells, of some steps, a range of steps or all; with ``fields`` only those columns."""
        return self._live("segments", "put_seq", steps, self._types(fields), span)

    def batch_segments(self, metadata: DataFrame, fields: list[str]) -> DataFrame:
        """Written cells around a batch, whatever the number of its steps.

        The batch's lowest and highest step and index (one row) prune folders and row groups of
        the scan; the join on the folder leaves out those between that hold none of its steps.
        """
        span = metadata.agg(*[f(c).alias(f"{n}_{c}") for c in KEY for n, f in (("low", F.min), ("high", F.max))]).first()
        if span[f"low_{STEP}"] is None:
            return self._live("segments", "put_seq", [], self._types(fields))
        if span[f"low_{STEP}"] == span[f"high_{STEP}"]:
            rows = self._live("segments", "put_seq", [span[f"low_{STEP}"]], self._types(fields))
        else:
            near = self.tables.read("segments", types=self._types(fields), span=(span[f"low_{STEP}"], span[f"high_{STEP}"]), steps_of=metadata)
            rows = RD.live_rows(near, self.tables.read("clears"), "put_seq")
        return rows.filter(F.col(INDEX).between(span[f"low_{INDEX}"], span[f"high_{INDEX}"]))

    def _types(self, fields: list[str] | None) -> dict:
        known = self.tables.field_types(fields)
        return known if fields is None else {f: known[f] for f in fields if f in known}

    def _live(
        self, name: str, seq: str, steps: list[int] | None, types: dict | None = None, span: tuple[int, int] | None = None
    ) -> DataFrame:
        log, clears = self.tables.read(name, steps, types, span), self.tables.read("clears", steps, span=span)
        if steps is None or len(steps) != 1:
            return RD.live_rows(log, clears, seq)
        # One step: its last clear is a single number, no join is needed.
        last = clears.agg(F.coalesce(F.max("clear_seq"), F.lit(-1)).alias("c"))
        return log.filter(F.col(seq) > last.scalar())

    def _steps(self, *steps: int) -> DataFrame:
        return self.spark.createDataFrame([(s,) for s in steps], f"{STEP} bigint")

    # --- put -----------------------------------------------------------------------

    def put(
        self,
        data: DataFrame,
        metadata: DataFrame | None = None,
        global_step: int | None = None,
        order_by: list[str] | None = None,
        whole: bool = True,
    ) -> int:
        """Write columns onto rows; returns the put's sequence number.

        Without ``metadata`` the rows fill a whole step in the order of ``batch_index`` (or
        of the unique columns ``order_by``); a column ``global_step`` fills many steps at
        once, and without ``whole`` they may bring fewer rows than a step has. With metadata, the row
        at each position goes to the address the batch holds there.
        """
        fields = [c for c in data.columns if c not in _POSITION]
        if metadata is None:
            if global_step is None and STEP not in data.columns:
                raise ValueError("global_step is needed when no metadata is given")
            if "batch_index" not in data.columns:
                if not order_by:
                    raise ValueError("unnumbered rows need order_by")
                data = IN.number_rows(data, order_by)
            if global_step is not None:
                data = data.withColumn(STEP, F.lit(global_step).cast("bigint"))
            rows = IN.insert_positions(data, self.layout, whole=whole)
        else:
            if metadata.isEmpty():
                raise ValueError("a batch without rows takes no data")
            rows = IN.transfer_rows(metadata, data)
        return self._write(rows, fields, global_step)

    def put_rows(self, rows: DataFrame) -> int:
        """Write columns onto rows that carry their own ``global_step`` and ``global_index``."""
        return self._write(rows, [c for c in rows.columns if c not in _POSITION])

    def _write(self, rows: DataFrame, fields: list[str], global_step: int | None = None) -> int:
        known = self.tables.field_types(fields)
        clash = IN.conflicting_types(known, rows.schema, fields)
        if clash:
            raise TypeError(f"fields put with another type before: {clash}")
        seq = self.tables.next_seq()
        cells = IN.segment(rows, fields, seq, "batch_index" if "batch_index" in rows.columns else None)
        types = {f: rows.schema[f].dataType for f in fields}
        new = {f: t for f, t in types.items() if f not in known}
        if new:
            self.tables.add_fields(new, seq, {f: i for i, f in enumerate(fields)})
        one = global_step is not None
        self.tables.append("segments", cells, one_folder=one)
        # Read back what was written: the log describes the stored values, and it is
        # appended last, so a row becomes ready only when its data is there.
        stored = self.tables.read("segments", _some(global_step), types).filter(F.col("put_seq") == seq)
        self.tables.append("production", IN.production_rows(stored, fields), one_folder=one)
        log = self.tables.read("production", _some(global_step)).filter(F.col("put_seq") == seq)
        self.tables.append("bitmaps", BM.production_bitmaps(log), one_folder=one)
        return seq

    # --- get -----------------------------------------------------------------------

    def get_meta(
        self,
        data_fields: list[str],
        batch_size: int,
        global_step: int,
        mode: str = "fetch",
        get_n_samples: bool = False,
        task_name: str | None = None,
        wait_seconds: float = 0,
        check_interval: float = 1,
    ) -> DataFrame:
        """The next batch of a task: (batch_index, global_step, global_index, fields).

        ``fetch`` hands out exactly ``batch_size`` ready rows and waits up to
        ``wait_seconds`` for them, ``force_fetch`` takes unconsumed rows whatever their
        readiness, ``insert`` lists all rows of the step. Rows handed out are claimed.
        """
        if mode == "insert":
            if batch_size != self.layout.rows_per_step:
                raise ValueError(f"a step to insert has {self.layout.rows_per_step} rows, not {batch_size}")
            space = RD.step_space(self.spark, self.layout, global_step)
            return FE.insert_meta(space, self.layout, data_fields)
        if mode not in ("fetch", "force_fetch"):
            raise ValueError(f"unknown mode {mode}")
        if not task_name:
            raise ValueError("a fetch needs a task name")
        deadline = time.monotonic() + wait_seconds
        while True:
            # Rows are only counted until there are enough; the claims get a sequence of a later moment, so
            # that a clear during the wait is older than they are.
            available = self._available(data_fields, global_step, mode, get_n_samples, task_name)
            if available >= batch_size:
                batch = self._claim(data_fields, batch_size, global_step, mode, get_n_samples, task_name)
                if not batch.isEmpty():
                    break
            if time.monotonic() >= deadline:
                # A writer that was lost between its log and its bitmaps is seen here.
                if available < batch_size <= self._available_in_log(data_fields, global_step, mode, get_n_samples, task_name):
                    self.rebuild_status_index(global_step)
                    continue
                raise TimeoutError(f"task {task_name} asked for {batch_size} rows of step {global_step}, {available} could be taken")
            time.sleep(check_interval)
        return FE.batch_meta(batch, self.production(global_step), data_fields, real_status=mode == "force_fetch")

    def _claim(self, fields, k, step, mode, grouped, task) -> DataFrame:
        samples = self.layout.samples if grouped else 1

        def pick(seq: int) -> DataFrame:
            taken = self.claims(task, step)
            if mode == "fetch":
                rows = FE.fetch_rows(self.production(step), taken, fields, k, task, samples)
            else:
                rows = FE.force_fetch_rows(self._steps(step), taken, self.layout, k, task, grouped)
            return FE.claim(rows, task, seq)

        seq = self.tables.claim(task, str(step), pick)
        # Evaluating the selection again would pick other rows: the batch is what was written.
        written = self.claims(task, step).filter(F.col("claim_seq") == F.lit(seq))
        if seq is not None:
            self.tables.append("bitmaps", BM.claim_bitmaps(written), one_folder=True)
        return written.select("batch_index", *KEY)

    def _available(self, fields, step, mode, grouped, task) -> int:
        """Rows that a fetch could take, from the bitmaps alone: polls read no log."""
        index = self.status_index(step)
        if mode != "fetch":
            taken = BM.check_consumption(index, self._steps(step), self.layout, [task]).first()
            return self.layout.rows_per_step - taken["consumed"]
        if grouped:
            return BM.ready_group_rows(index, fields, task, self.layout.samples).count()
        counted = BM.ready_count(index, fields, task).first()
        return counted["available"] if counted else 0

    def _available_in_log(self, fields, step, mode, grouped, task) -> int:
        taken = self.claims(task, step)
        if mode != "fetch":
            return self.layout.rows_per_step - taken.count()
        samples = self.layout.samples if grouped else 1
        return FE.scan_ready_units(self.production(step), taken, fields, task, samples).count() * samples

    def rebuild_status_index(self, global_step: int) -> None:
        """Write the bitmaps around a step again from the logs. Covers the run of steps that share a folder with this one."""
        span = self.tables.neighbours(global_step)
        made = BM.production_bitmaps(self._live("production", "put_seq", None, span=span))
        made = made.unionByName(BM.claim_bitmaps(self._live("claims", "claim_seq", None, span=span)))
        self.tables.replace("bitmaps", global_step, made)

    def get_data(self, metadata: DataFrame, fields: list[str] | None = None, ordered: bool = False) -> DataFrame:
        """Values of the batch's rows; without ``fields`` those of the batch's first row."""
        if fields is None:
            first = metadata.filter("batch_index = 0").select(F.map_keys("fields").alias("names")).first()
            fields = first["names"] if first else []
        return RD.get_data(metadata, self.batch_segments(metadata, fields), fields, ordered)

    # --- clear and maintenance -------------------------------------------------------

    def get_clear_meta(self, global_step: int) -> DataFrame:
        return RD.clear_meta(RD.step_space(self.spark, self.layout, global_step), self.layout)

    def clear(self, global_step: int) -> int:
        """Drop a step's cells, production and claims."""
        seq = self.tables.next_seq()
        self.tables.append_record("clears", global_step, seq)
        return seq

    def clear_all(self, steps: DataFrame) -> int:
        """Drop the cells, production and claims of every step in ``steps`` at once."""
        seq = self.tables.next_seq()
        marks = steps.select(F.col(STEP).cast("bigint").alias(STEP)).distinct()
        self.tables.append("clears", marks.withColumn("clear_seq", F.lit(seq).cast("bigint")))
        return seq

    def clear_rows(self, rows: DataFrame) -> int:
        """Unset every field of the given rows; their status stays."""
        seq = self.tables.next_seq()
        self.tables.append("segments", IN.clear_row_segment(rows, self.tables.field_types(), seq))
        return seq

    def compact(self, global_step: int) -> None:
        """Rewrite the segments around a step without overwritten and cleared cells.

        Reads then no longer pay for earlier puts. Covers the run of steps that share a
        folder with this one; nobody may put into them meanwhile.
        """
        old = self.segments(span=self.tables.neighbours(global_step))
        self.tables.replace("segments", global_step, RD.compact(old, list(self.tables.field_types())))

    def purge(self, global_step: int) -> None:
        """Free what clears have dropped around a step: segments, production rows and claims.

        Covers the same run of steps as ``compact``, under the same condition. The clears
        themselves stay, one for each step, for records that land late.
        """
        span = self.tables.neighbours(global_step)
        self.tables.replace("segments", global_step, self.segments(span=span))
        self.tables.replace("production", global_step, self._live("production", "put_seq", None, span=span))
        for task in self.tables.tasks(global_step):
            live = self._live("claims", "claim_seq", None, span=span).filter(F.col("task_name") == task)
            self.tables.replace("claims", global_step, live, task)
        self.tables.replace("bitmaps", global_step, self._live("bitmaps", "seq", None, span=span))
        last = self.tables.read("clears").groupBy(STEP).agg(F.max("clear_seq").alias("clear_seq"))
        self.tables.replace("clears", global_step, last)

    def recover(self) -> int:
        """Finish what a crash has cut off in ``compact`` or ``purge``; returns the number of folders."""
        return self.tables.recover()

    def stored_rows(self) -> dict[str, int]:
        """Rows that each table holds, dead or alive."""
        return {name: self.tables.read(name).count() for name in ("segments", "production", "claims", "clears")}

    # --- status --------------------------------------------------------------------

    def production_status(self, global_step: int, fields: list[str] | None = None) -> DataFrame:
        names = fields or [r["field"] for r in self.field_registry().orderBy("column_number").collect()]
        return ST.production_status(self.production(global_step), self._steps(global_step), self.layout, names)

    def consumption_status(self, global_step: int, tasks: list[str]) -> DataFrame:
        return ST.consumption_status(self.claims(None, global_step), self._steps(global_step), self.layout, tasks)

    def field_registry(self) -> DataFrame:
        """Fields in first-seen order, those of cleared steps included."""
        first = self.tables.read("fields").groupBy("field").agg(F.min(F.struct("put_seq", "field_pos")).alias("s"))
        return ST.field_registry(first.select("field", "s.put_seq", "s.field_pos"))

    def check_consumption(self, task_name: str, global_step: int) -> bool:
        claims = self.claims(task_name, global_step)
        return ST.check_consumption(claims, self._steps(global_step), self.layout, [task_name]).first()["all_consumed"]

    def check_production(self, data_fields: list[str], global_step: int) -> bool:
        log = self.production(global_step)
        return ST.check_production(log, self._steps(global_step), self.layout, data_fields).first()["all_produced"]
