"""Status from bitmaps that the writers keep, next to the SQL of the same status on the tables."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowrelay.operators import bitmaps as BM
from rowrelay.plans.queries.fetch import _LINE_READY, _READY, _docs, _lines
from rowrelay.plans.queries.registry import ORD_CTE, query
from rowrelay.schema import INDEX
from rowrelay.session import shared_dir
from rowrelay.sources import bindings as B
from rowrelay.sources.tables import Tables

PUTS = 4  # parts in which the logs are put


def index_of(spark: SparkSession, production: DataFrame, claims: DataFrame) -> DataFrame:
    """The bitmaps that writers leave who put the log in parts: read without the log."""
    tables = Tables(spark, shared_dir(spark, "status"))
    part = F.pmod(F.col(INDEX), F.lit(PUTS)).cast("bigint")
    tables.append("bitmaps", BM.production_bitmaps(production.withColumn("put_seq", part)))
    tables.append("bitmaps", BM.claim_bitmaps(claims.withColumn("claim_seq", part)))
    return tables.read("bitmaps")


@query(
    "c2_bitmap_produced",
    f"""WITH {ORD_CTE} SELECT global_step, 'l' || l_linenumber AS field, count(DISTINCT global_index) AS produced
FROM lines GROUP BY 1, 2""",
)
def c2_bitmap_produced(spark, sf_dir):
    return BM.produced_count(index_of(spark, *_lines(spark, sf_dir)), B.LINE_FIELDS)


@query(
    "c6_bitmap_consumption",
    f"""WITH {ORD_CTE}, t AS (
SELECT 'ship' AS task_name, global_step, count(*) FILTER (WHERE shipped) AS consumed FROM ord GROUP BY 2
UNION ALL SELECT 'report', global_step, 0 FROM ord GROUP BY 2)
SELECT task_name, global_step, CAST(consumed AS BIGINT) AS consumed, consumed = 500 AS all_consumed FROM t""",
)
def c6_bitmap_consumption(spark, sf_dir):
    index = index_of(spark, *_lines(spark, sf_dir))
    return BM.check_consumption(index, B.steps_of(B.order_rows(spark, sf_dir)), B.ORD, ["ship", "report"])


@query("d1_bitmap_ready", f"WITH {_READY} SELECT global_step, global_index FROM ready")
def d1_bitmap_ready(spark, sf_dir):
    return BM.ready_rows(index_of(spark, *_docs(spark, sf_dir)), ["text", "quality"], "train")


@query("d2_bitmap_ready_groups", f"WITH {_LINE_READY} SELECT global_step, global_index FROM pair_rows")
def d2_bitmap_ready_groups(spark, sf_dir):
    return BM.ready_group_rows(index_of(spark, *_lines(spark, sf_dir)), ["l1", "l2"], "ship", B.ORD.samples)


@query("d10_bitmap_available", f"WITH {_LINE_READY} SELECT global_step, count(*) AS available FROM ready GROUP BY 1")
def d10_bitmap_available(spark, sf_dir):
    return BM.ready_count(index_of(spark, *_lines(spark, sf_dir)), ["l1", "l2"], "ship")
