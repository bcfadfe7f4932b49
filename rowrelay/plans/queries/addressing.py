"""Addresses, prompt groups and shards."""

from pyspark.sql import functions as F

from rowrelay.layout import Layout
from rowrelay.operators import ingest as IN, layout as LA
from rowrelay.plans.queries.registry import META_CTE, ORD_CTE, query
from rowrelay.schema import KEY, STEP
from rowrelay.sources import bindings as B


@query(
    "b1_step_range",
    """SELECT DISTINCT CAST(o_orderkey // 500 AS BIGINT) AS global_step, CAST((o_orderkey // 500) % 8 AS BIGINT) AS slot,
CAST(((o_orderkey // 500) % 8) * 500 AS BIGINT) AS start_index,
CAST(((o_orderkey // 500) % 8) * 500 + 500 AS BIGINT) AS end_index FROM orders""",
)
def b1_step_range(spark, sf_dir):
    return LA.step_ranges(B.steps_of(B.order_rows(spark, sf_dir)), B.ORD)


@query(
    "b1_slot_conflicts",
    """SELECT CAST((o_orderkey // 500) % 8 AS BIGINT) AS slot, count(DISTINCT o_orderkey // 500) AS live_steps
FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderkey // 500) > 1""",
)
def b1_slot_conflicts(spark, sf_dir):
    return LA.slot_conflicts(B.steps_of(B.order_rows(spark, sf_dir)), B.ORD)


@query(
    "b2_prompt_group",
    f"""WITH {ORD_CTE} SELECT global_step, global_index, CAST(global_index // 2 AS BIGINT) AS group_id,
CAST(global_index % 2 AS BIGINT) AS group_offset FROM ord""",
)
def b2_prompt_group(spark, sf_dir):
    return LA.prompt_groups(B.order_rows(spark, sf_dir).select(*KEY), B.ORD.samples)


@query(
    "b3_shard_map",
    f"""WITH {ORD_CTE} SELECT global_step, global_index, CAST(global_index % 3 AS BIGINT) AS shard_id,
CAST(global_index // 3 AS BIGINT) AS local_index FROM ord""",
)
def b3_shard_map(spark, sf_dir):
    return LA.shard_map(B.order_rows(spark, sf_dir).select(*KEY), B.ORD.shards)


@query(
    "b4_shard_groups",
    f"""WITH {META_CTE} SELECT batch_id, batch_index, global_index, CAST(global_index % 3 AS BIGINT) AS shard_id,
CAST(global_index // 3 AS BIGINT) AS local_index,
CAST(row_number() OVER (PARTITION BY batch_id, global_index % 3 ORDER BY batch_index) - 1 AS BIGINT) AS shard_pos
FROM meta""",
)
def b4_shard_groups(spark, sf_dir):
    return LA.shard_groups(B.doc_meta(spark, sf_dir), B.DOC.shards)


@query(
    "b4_shard_summary",
    f"""WITH {META_CTE} SELECT batch_id, CAST(global_index % 3 AS BIGINT) AS shard_id, count(*) AS size,
CAST(min(global_index // 3) AS BIGINT) AS first_local, CAST(max(global_index // 3) AS BIGINT) AS last_local,
'n_chars,quality,text' AS field_names FROM meta GROUP BY 1, 2""",
)
def b4_shard_summary(spark, sf_dir):
    out = LA.shard_summary(B.doc_meta(spark, sf_dir), B.DOC.shards)
    return out.withColumn("field_names", F.array_join("field_names", ","))


@query(
    "b5_transfer_rows",
    f"""WITH {META_CTE} SELECT batch_id, batch_index, global_step, global_index,
CAST(global_index % 3 AS BIGINT) AS shard_id, CAST(global_index // 3 AS BIGINT) AS local_index, n_chars FROM meta""",
)
def b5_transfer_rows(spark, sf_dir):
    data = B.doc_rows(spark, sf_dir).select(
        F.col(STEP).alias("batch_id"), (F.col("doc_id") - F.col(STEP) * 40).alias("batch_index"), "n_chars"
    )
    return IN.transfer_rows(B.doc_meta(spark, sf_dir), data, B.DOC.shards)


@query(
    "b5_dense_position",
    """SELECT o_orderkey, o_custkey,
CAST(row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS BIGINT) AS batch_index FROM orders""",
)
def b5_dense_position(spark, sf_dir):
    rows = B.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return IN.number_rows(rows, ["o_custkey", "o_orderkey"])


@query(
    "b6_capacity_check",
    f"""WITH {ORD_CTE} SELECT CAST(global_index % 3 AS BIGINT) AS shard_id, count(*) AS rows,
CAST(max(global_index // 3) AS BIGINT) AS last_local,
count(*) FILTER (WHERE global_index // 3 >= 667) AS outside, CAST(667 AS BIGINT) AS capacity FROM ord GROUP BY 1""",
)
def b6_capacity_check(spark, sf_dir):
    # Addresses of an eight-slot ring checked against shards sized for four slots.
    smaller = Layout(prompts=B.ORD.prompts, samples=B.ORD.samples, slots=4, shards=B.ORD.shards)
    return LA.capacity_check(B.order_rows(spark, sf_dir).select(*KEY), smaller)
