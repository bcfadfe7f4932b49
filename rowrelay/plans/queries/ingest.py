"""Put, repeat, read back and clear."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from rowrelay.operators import fetch as FE, ingest as IN, read as RD
from rowrelay.plans.exchange import Exchange
from rowrelay.plans.queries.fetch import hand_out
from rowrelay.plans.queries.registry import DOC_CTE, EVT_CTE, place, query
from rowrelay.schema import INDEX, KEY, STEP
from rowrelay.session import shared_dir
from rowrelay.sources import bindings as B


@query(
    "a1_put_insert",
    f"""
WITH s AS (SELECT doc_id, doc_id // 40 AS step FROM documents),
r AS (SELECT doc_id, step, row_number() OVER (PARTITION BY step ORDER BY doc_id) - 1 AS bi,
             count(*) OVER (PARTITION BY step) AS c FROM s)
SELECT doc_id, CAST(step AS BIGINT) AS global_step, CAST(bi AS BIGINT) AS batch_index,
       CAST((step % 8) * 40 + bi AS BIGINT) AS global_index, c = 40 AS is_full FROM r""",
)
def a1_put_insert(spark, sf_dir):
    docs = B.doc_rows(spark, sf_dir).select(STEP, "doc_id")
    rows = IN.insert_rows(docs, B.DOC, "doc_id", strict=False)
    return rows.select("doc_id", STEP, "batch_index", INDEX, "is_full")


_LATEST = ", ".join(f"arg_max(value, event_id) FILTER (WHERE event_type = '{f}') AS {f}" for f in B.EVENT_FIELDS)


@query("a2_put_update", f"WITH {EVT_CTE} SELECT global_step, global_index, {_LATEST} FROM evt GROUP BY ALL")
def a2_put_update(spark, sf_dir):
    return RD.resolve_cells(B.event_segments(spark, sf_dir), B.EVENT_FIELDS)


@query(
    "a2_put_log",
    f"""WITH {DOC_CTE}
SELECT global_step, global_index, f.field, f.dtype, f.shape, f.put_seq FROM doc,
LATERAL (VALUES ('text', NULL, NULL, CAST(1 AS BIGINT)), ('lang', NULL, NULL, 1), ('source', NULL, NULL, 1),
                ('n_chars', 'bigint', '[]', 1), ('quality', 'int', '[]', 2), ('toxic', 'int', '[]', 2))
        AS f(field, dtype, shape, put_seq)
WHERE f.put_seq = 1 OR quality IS NOT NULL""",
)
def a2_put_log(spark, sf_dir):
    log = B.doc_production(spark, sf_dir)
    shape = F.concat(F.lit("["), F.array_join(F.col("shape").cast("array<string>"), "x"), F.lit("]"))
    return log.select(*KEY, "field", "dtype", shape.alias("shape"), "put_seq")


@query(
    "a3_repeat_interleave",
    """SELECT doc_id, lang, CAST(doc_id * 4 + r AS BIGINT) AS batch_index
FROM documents, range(4) AS t(r)""",
)
def a3_repeat_interleave(spark, sf_dir):
    prompts = B.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return IN.repeat_interleave(prompts, 4, "doc_id").select("doc_id", "lang", "batch_index")


@query(
    "a4_get_data",
    f"""WITH {DOC_CTE},
q AS (SELECT *, row_number() OVER (PARTITION BY global_step ORDER BY global_index) - 1 AS bi,
             count(*) OVER (PARTITION BY global_step) AS c FROM doc WHERE quality IS NOT NULL AND NOT taken)
SELECT CAST(bi AS BIGINT) AS batch_index, global_step, global_index, n_chars, quality, text
FROM q WHERE c >= 8 AND bi < 8""",
)
def a4_get_data(spark, sf_dir):
    rows = FE.fetch_rows(B.doc_production(spark, sf_dir), B.doc_claims(spark, sf_dir), ["text", "quality"], 8, "train")
    return RD.get_data(hand_out(spark, rows, "train"), B.doc_segments(spark, sf_dir), ["text", "quality", "n_chars"])


@query(
    "a4_resolve_documents",
    f"""WITH {DOC_CTE} SELECT global_step, global_index, lang, n_chars, source, quality, toxic FROM doc""",
)
def a4_resolve_documents(spark, sf_dir):
    return RD.resolve_cells(B.doc_segments(spark, sf_dir), ["lang", "n_chars", "source", "quality", "toxic"])


@query(
    "a5_clear_step",
    f"""WITH evt AS (SELECT event_id, event_type, {place('user_id', 2, 128)} FROM events),
c AS (SELECT global_step, max(event_id) AS at FROM evt WHERE event_type = 'error' GROUP BY 1)
SELECT e.global_step, e.global_index, e.event_type AS field, e.event_id AS put_seq
FROM evt e LEFT JOIN c ON c.global_step = e.global_step WHERE c.at IS NULL OR e.event_id > c.at""",
)
def a5_clear_step(spark, sf_dir):
    log = B.event_production(spark, sf_dir, B.EVT_SMALL)
    clears = B.event_clears(spark, sf_dir, B.EVT_SMALL)
    return RD.live_rows(log, clears, "put_seq").select(*KEY, "field", "put_seq")


_UNLESS_CLEARED = ", ".join(
    f"CASE WHEN max(event_id) FILTER (WHERE event_type = '{f}') > coalesce(max(event_id) FILTER (WHERE event_type = 'error'), -1) "
    f"THEN arg_max(value, event_id) FILTER (WHERE event_type = '{f}') END AS {f}"
    for f in ("click", "purchase", "signup", "view")
)


@query("a6_clear_rows", f"WITH {EVT_CTE} SELECT global_step, global_index, {_UNLESS_CLEARED} FROM evt GROUP BY ALL")
def a6_clear_rows(spark, sf_dir):
    fields = ["click", "purchase", "signup", "view"]
    puts = B.event_segments(spark, sf_dir)
    errors = B.event_cells(B.table(spark, sf_dir, "events").filter("event_type = 'error'"))
    types = {f: puts.schema[f].dataType for f in fields}
    cleared = IN.clear_row_segment(errors.select(*KEY, "put_seq"), types, F.col("put_seq"))
    return RD.resolve_cells(RD.union_segments([puts, cleared]), fields)


@query(
    "a7_clear_meta",
    """WITH s AS (SELECT DISTINCT doc_id // 40 AS step FROM documents)
SELECT CAST(i AS BIGINT) AS batch_index, CAST(step AS BIGINT) AS global_step,
       CAST((step % 8) * 40 + i AS BIGINT) AS global_index, CAST(0 AS INTEGER) AS n_fields FROM s, range(40) AS t(i)""",
)
def a7_clear_meta(spark, sf_dir):
    space = RD.row_space(B.steps_of(B.doc_rows(spark, sf_dir)), B.DOC)
    return RD.clear_meta(space, B.DOC).select("batch_index", *KEY, F.size("fields").alias("n_fields"))


@query(
    "a_compact",
    f"""WITH {EVT_CTE}
SELECT global_step, global_index, event_id AS put_seq, CASE WHEN event_type = 'click' THEN value END AS click,
       CASE WHEN event_type = 'view' THEN value END AS "view", event_type AS written
FROM evt QUALIFY row_number() OVER (PARTITION BY global_step, global_index, event_type ORDER BY event_id DESC) = 1""",
)
def a_compact(spark, sf_dir):
    """Only the last write of a cell is left, under its own sequence."""
    cells = RD.compact(B.event_segments(spark, sf_dir), ["click", "view"])
    return cells.select(*KEY, "put_seq", "click", "view", F.array_join("fields_written", ",").alias("written"))


_CELLS = f"""{EVT_CTE},
cell AS (SELECT global_step, global_index, max(value) FILTER (WHERE event_type = 'click') AS click,
                max(value) FILTER (WHERE event_type = 'view') AS "view" FROM evt GROUP BY 1, 2)"""


def _event_columns(spark, sf_dir, name):
    cells = B.event_segments(spark, sf_dir).groupBy(*KEY).agg(F.max(name).alias(name))
    return cells.filter(F.col(name).isNotNull())


@query(
    "a5_clear_compact",
    f"""WITH {_CELLS}, left_over AS (
SELECT global_step, global_index, CASE WHEN global_step NOT IN (0, 2) THEN click END AS click, "view" FROM cell)
SELECT * FROM left_over WHERE click IS NOT NULL OR "view" IS NOT NULL""",
)
def a5_clear_compact(spark, sf_dir):
    """Clicks, clears of two steps, compaction, views, and a clear that lands late with an old sequence."""
    exchange = Exchange(spark, shared_dir(spark, "exchange"), B.EVT)
    early = exchange.tables.next_seq()
    exchange.put_rows(_event_columns(spark, sf_dir, "click"))
    exchange.clear(0)
    exchange.clear(2)
    exchange.compact(0)
    exchange.put_rows(_event_columns(spark, sf_dir, "view"))
    exchange.tables.append_record("clears", 1, early)
    return RD.resolve_cells(exchange.segments(), ["click", "view"])


@query(
    "a5_purge",
    f"""WITH {_CELLS}, kept AS (SELECT count(*) AS n FROM cell WHERE click IS NOT NULL AND global_step <> 0)
SELECT t.name, CASE t.name WHEN 'clears' THEN 1 ELSE n END AS stored
FROM kept, (VALUES ('segments'), ('production'), ('claims'), ('clears')) AS t(name)""",
)
def a5_purge(spark, sf_dir):
    """Rows that the tables store after a step with data and claims was cleared and purged."""
    exchange = Exchange(spark, shared_dir(spark, "exchange"), B.EVT)
    clicks = _event_columns(spark, sf_dir, "click")
    exchange.put_rows(clicks)
    exchange.tables.append("claims", FE.claim(clicks, "train: first", exchange.tables.next_seq()))
    exchange.clear(0)
    exchange.clear(0)
    exchange.purge(0)
    counts = [
        exchange.tables.read(name).agg(F.count(F.lit(1)).alias("stored")).select(F.lit(name).alias("name"), "stored")
        for name in ("segments", "production", "claims", "clears")
    ]
    return reduce(DataFrame.union, counts)


@query(
    "a1_put_unnumbered",
    f"""WITH {DOC_CTE}
SELECT global_step, CAST((global_step % 8) * 40 + row_number() OVER (PARTITION BY global_step ORDER BY n_chars, doc_id) - 1 AS BIGINT)
       AS global_index, doc_id FROM doc""",
)
def a1_put_unnumbered(spark, sf_dir):
    """Rows without positions fill many steps at once, each in the order of its rows' keys; the last step may have fewer."""
    exchange = Exchange(spark, shared_dir(spark, "exchange"), B.DOC)
    docs = B.doc_rows(spark, sf_dir).select(STEP, "n_chars", "doc_id")
    exchange.put(docs, order_by=["n_chars", "doc_id"], whole=False)
    return RD.resolve_cells(exchange.segments(), ["doc_id"])
