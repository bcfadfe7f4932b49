"""Readiness, sampling and fetch."""

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Window, functions as F

from rowrelay.functions.fieldmaps import render_fields
from rowrelay.operators import fetch as FE, read as RD
from rowrelay.plans.queries.registry import DOC_CTE, ORD_CTE, place, query
from rowrelay.schema import KEY, STEP
from rowrelay.session import shared_dir
from rowrelay.sources import bindings as B
from rowrelay.sources.tables import Tables

_READY = f"""{DOC_CTE},
ready AS (SELECT * FROM doc WHERE quality IS NOT NULL AND NOT taken),
numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY global_step ORDER BY global_index) - 1 AS BIGINT) AS bi,
                    count(*) OVER (PARTITION BY global_step) AS c FROM ready)"""

_LINE_READY = f"""{ORD_CTE},
has AS (SELECT l_orderkey FROM lines WHERE l_linenumber IN (1, 2) GROUP BY 1 HAVING count(*) = 2),
ready AS (SELECT o.* FROM ord o JOIN has h ON h.l_orderkey = o.o_orderkey WHERE NOT o.shipped),
pairs AS (SELECT global_step, global_index // 2 AS g FROM ready GROUP BY 1, 2 HAVING count(*) = 2),
pair_rows AS (SELECT p.global_step, p.g, CAST(p.g * 2 + t.i AS BIGINT) AS global_index, t.i,
                     dense_rank() OVER (PARTITION BY p.global_step ORDER BY p.g) - 1 AS gr
              FROM pairs p, range(2) AS t(i)),
pair_numbered AS (SELECT *, CAST(gr * 2 + i AS BIGINT) AS bi,
                         count(*) OVER (PARTITION BY global_step) AS c FROM pair_rows)"""


def _docs(spark, sf_dir):
    return B.doc_production(spark, sf_dir), B.doc_claims(spark, sf_dir)


def _lines(spark, sf_dir):
    return B.line_production(spark, sf_dir), B.order_claims(spark, sf_dir)


def hand_out(spark, rows, task):
    """Record a selection as claims and go on with what was recorded.

    Whatever follows reads the batch, instead of scanning the log for it again.
    """
    tables = Tables(spark, shared_dir(spark, "exchange"))
    tables.append("claims", FE.claim(rows, task, 0))
    return tables.read("claims").select("batch_index", *KEY)


@query("d1_scan_ready", f"WITH {_READY} SELECT global_step, global_index FROM ready")
def d1_scan_ready(spark, sf_dir):
    return FE.scan_ready(*_docs(spark, sf_dir), ["text", "quality"], "train")


@query("d1_scan_ready_lines", f"WITH {_LINE_READY} SELECT global_step, global_index FROM ready")
def d1_scan_ready_lines(spark, sf_dir):
    return FE.scan_ready(*_lines(spark, sf_dir), ["l1", "l2"], "ship")


@query(
    "d1_scan_ready_tasks",
    f"""WITH {ORD_CTE},
has AS (SELECT l_orderkey, bool_or(l_linenumber = 1) AS a, bool_or(l_linenumber = 2) AS b, bool_or(l_linenumber = 3) AS c
        FROM lines GROUP BY 1)
SELECT 'ship' AS task_name, o.global_step, o.global_index FROM ord o JOIN has h ON h.l_orderkey = o.o_orderkey
WHERE a AND b AND NOT o.shipped
UNION ALL
SELECT 'price', o.global_step, o.global_index FROM ord o JOIN has h ON h.l_orderkey = o.o_orderkey WHERE b AND c""",
)
def d1_scan_ready_tasks(spark, sf_dir):
    tasks = {"ship": ["l1", "l2"], "price": ["l2", "l3"], "audit": ["l1"]}
    return FE.scan_ready_tasks(*_lines(spark, sf_dir), tasks)


@query("d2_scan_ready_groups", f"WITH {_LINE_READY} SELECT global_step, global_index FROM pair_rows")
def d2_scan_ready_groups(spark, sf_dir):
    return FE.scan_ready_groups(*_lines(spark, sf_dir), ["l1", "l2"], "ship", B.ORD.samples)


@query(
    "d2_scan_ready_conversations",
    f"""WITH t AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1 HAVING count(*) = 8)
SELECT {place('(conv_id * 8 + r.i)', 40)} FROM t, range(8) AS r(i)""",
)
def d2_scan_ready_conversations(spark, sf_dir):
    log = B.conversation_production(spark, sf_dir)
    return FE.scan_ready_groups(log, B.no_claims(spark), ["text"], "reply", B.CONV.samples)


@query(
    "d3_sequential_sample",
    f"WITH {_READY} SELECT global_step, global_index, bi AS batch_index FROM numbered WHERE bi < 8",
)
def d3_sequential_sample(spark, sf_dir):
    ready = FE.scan_ready(*_docs(spark, sf_dir), ["text", "quality"], "train")
    return FE.sequential_sample(ready, 8).select(*KEY, "batch_index")


@query(
    "d4_sequential_sample_groups",
    f"WITH {_LINE_READY} SELECT global_step, global_index, bi AS batch_index FROM pair_numbered WHERE bi < 20",
)
def d4_sequential_sample_groups(spark, sf_dir):
    ready = FE.scan_ready(*_lines(spark, sf_dir), ["l1", "l2"], "ship")
    return FE.sequential_sample_groups(ready, 20, B.ORD.samples)


@query(
    "d5_fetch",
    f"WITH {_READY} SELECT global_step, global_index, bi AS batch_index FROM numbered WHERE c >= 8 AND bi < 8",
)
def d5_fetch(spark, sf_dir):
    rows = FE.fetch_rows(*_docs(spark, sf_dir), ["text", "quality"], 8, "train")
    return rows.select(*KEY, "batch_index")


@query(
    "d5_fetch_lines",
    f"""WITH {_LINE_READY}, q AS (SELECT *, CAST(row_number() OVER (PARTITION BY global_step ORDER BY global_index) - 1 AS BIGINT) AS bi,
count(*) OVER (PARTITION BY global_step) AS c FROM ready)
SELECT global_step, global_index, bi AS batch_index FROM q WHERE c >= 50 AND bi < 50""",
)
def d5_fetch_lines(spark, sf_dir):
    rows = FE.fetch_rows(*_lines(spark, sf_dir), ["l1", "l2"], 50, "ship")
    return rows.select(*KEY, "batch_index")


@query(
    "d5_fetch_groups",
    f"WITH {_LINE_READY} SELECT global_step, global_index, bi AS batch_index FROM pair_numbered WHERE c >= 8 AND bi < 8",
)
def d5_fetch_groups(spark, sf_dir):
    rows = FE.fetch_rows(*_lines(spark, sf_dir), ["l1", "l2"], 8, "ship", B.ORD.samples)
    return rows.select(*KEY, "batch_index")


_FORCED = f"""{DOC_CTE},
numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY global_step ORDER BY global_index) - 1 AS BIGINT) AS bi,
                    count(*) OVER (PARTITION BY global_step) AS c FROM doc WHERE NOT taken)"""


@query(
    "d6_force_fetch",
    f"""WITH {_FORCED} SELECT global_step, global_index, bi AS batch_index,
CASE WHEN quality IS NULL THEN 'quality:-:-:0' ELSE 'quality:int:[]:1' END || ',text:-:-:1' AS fields
FROM numbered WHERE c >= 16 AND bi < 16""",
)
def d6_force_fetch(spark, sf_dir):
    production, claims = _docs(spark, sf_dir)
    steps = B.steps_of(B.doc_rows(spark, sf_dir))
    rows = hand_out(spark, FE.force_fetch_rows(steps, claims, B.DOC, 16, "train"), "train")
    meta = FE.batch_meta(rows, production, ["text", "quality"], real_status=True)
    return meta.select(*KEY, "batch_index", render_fields(F.col("fields")).alias("fields"))


@query(
    "d6_force_fetch_groups",
    f"""WITH {DOC_CTE},
g AS (SELECT global_step, global_index // 2 AS g, CAST(row_number() OVER (PARTITION BY global_step ORDER BY global_index // 2) - 1 AS BIGINT) AS r,
             count(*) OVER (PARTITION BY global_step) AS c
      FROM doc GROUP BY global_step, global_index // 2 HAVING count(*) FILTER (WHERE NOT taken) = 2)
SELECT global_step, CAST(g * 2 + i AS BIGINT) AS global_index, CAST(r * 2 + i AS BIGINT) AS batch_index
FROM g, range(2) AS t(i) WHERE c >= 4 AND r < 4""",
)
def d6_force_fetch_groups(spark, sf_dir):
    layout = B.DOC_PAIRS
    steps = B.steps_of(B.doc_rows(spark, sf_dir, layout))
    claims = B.doc_claims(spark, sf_dir, layout)
    rows = FE.force_fetch_rows(steps, claims, layout, 8, "train", grouped=True)
    return rows.select(*KEY, "batch_index")


@query(
    "d7_insert_meta",
    """WITH s AS (SELECT DISTINCT o_orderkey // 500 AS step FROM orders)
SELECT CAST(i AS BIGINT) AS batch_index, CAST(step AS BIGINT) AS global_step,
CAST((step % 8) * 500 + i AS BIGINT) AS global_index, 'l1:-:-:0,l2:-:-:0' AS fields FROM s, range(500) AS t(i)""",
)
def d7_insert_meta(spark, sf_dir):
    space = RD.row_space(B.steps_of(B.order_rows(spark, sf_dir)), B.ORD)
    meta = FE.insert_meta(space, B.ORD, ["l1", "l2"])
    return meta.withColumn("fields", render_fields(F.col("fields")))


@query(
    "d8_claim",
    f"""WITH {_READY} SELECT 'train' AS task_name, global_step, global_index, CAST(bi // 4 + 2 AS BIGINT) AS claim_seq,
CAST(bi % 4 AS BIGINT) AS batch_index FROM numbered WHERE (bi < 4 AND c >= 4) OR (bi < 8 AND c >= 8)""",
)
def d8_claim(spark, sf_dir):
    """Two batches in a row: the second is picked after the first has been recorded."""
    production, claims = _docs(spark, sf_dir)
    tables = Tables(spark, shared_dir(spark, "exchange"), B.DOC)
    for claim_seq in (2, 3):
        rows = FE.fetch_rows(production, claims, ["text", "quality"], 4, "train")
        tables.append("claims", FE.claim(rows, "train", claim_seq))
        taken = tables.read("claims")
        claims = B.doc_claims(spark, sf_dir).unionByName(taken)
    return taken.select("task_name", *KEY, "claim_seq", "batch_index")


@query(
    "d8_claim_consumers",
    f"""WITH {_LINE_READY}, q AS (SELECT *, CAST(row_number() OVER (PARTITION BY global_step ORDER BY global_index) - 1 AS BIGINT) AS bi,
count(*) OVER (PARTITION BY global_step) AS c FROM ready)
SELECT global_step, global_index, CAST(bi // 60 AS INTEGER) AS turn, bi % 60 AS batch_index FROM q WHERE bi < c // 60 * 60""",
)
def d8_claim_consumers(spark, sf_dir):
    """Two consumers of one task at the same time, each with its own session, until nothing is left for a batch."""
    path = shared_dir(spark, "exchange")

    def consume(session):
        tables = Tables(session, path, B.ORD)
        production, before = _lines(session, sf_dir)

        def pick(seq):
            taken = before.unionByName(tables.read("claims"))
            return FE.claim(FE.fetch_rows(production, taken, ["l1", "l2"], 60, "ship"), "ship", seq)

        while tables.claim("ship", "all", pick) is not None:
            pass

    with ThreadPoolExecutor(2) as pool:
        list(pool.map(consume, [spark.newSession(), spark.newSession()]))
    taken = Tables(spark, path).read("claims")
    batches = taken.select(STEP, "claim_seq").distinct()
    turns = batches.withColumn("turn", F.row_number().over(Window.partitionBy(STEP).orderBy("claim_seq")) - 1)
    return taken.join(turns, [STEP, "claim_seq"]).select(*KEY, "turn", "batch_index")


@query(
    "d9_batch_meta",
    f"""WITH {_READY} SELECT global_step, global_index, bi AS batch_index,
'n_chars:bigint:[]:1,quality:int:[]:1,text:-:-:1' AS fields FROM numbered WHERE c >= 8 AND bi < 8""",
)
def d9_batch_meta(spark, sf_dir):
    production, claims = _docs(spark, sf_dir)
    names = ["text", "n_chars", "quality"]
    rows = hand_out(spark, FE.fetch_rows(production, claims, names, 8, "train"), "train")
    meta = FE.batch_meta(rows, production, names)
    return meta.select(*KEY, "batch_index", render_fields(F.col("fields")).alias("fields"))


@query(
    "d10_batch_gate",
    f"""WITH {_READY} SELECT d.global_step, count(r.doc_id) AS available, CAST(8 AS BIGINT) AS required,
count(r.doc_id) >= 8 AS is_sufficient FROM doc d LEFT JOIN ready r ON r.doc_id = d.doc_id GROUP BY 1""",
)
def d10_batch_gate(spark, sf_dir):
    ready = FE.scan_ready(*_docs(spark, sf_dir), ["text", "quality"], "train")
    return FE.batch_gate(ready, B.steps_of(B.doc_rows(spark, sf_dir)), 8)
