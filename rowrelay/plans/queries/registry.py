"""Registered queries and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


# --- SQL fragments shared by the oracles --------------------------------------------


def place(identifier: str, rows: int, slots: int = 8) -> str:
    """Step and ring index of a dense identifier."""
    return (
        f"CAST({identifier} // {rows} AS BIGINT) AS global_step, "
        f"CAST((({identifier} // {rows}) % {slots}) * {rows} + {identifier} % {rows} AS BIGINT) AS global_index"
    )


# Documents with their label, 40 rows per step, and whether task `train` has taken them.
DOC_CTE = f"""
doc AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic,
               {place('d.doc_id', 40)}, d.lang <> 'en' AS taken
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""

# Orders, 500 rows per step; `nl` distinct lines among 1 and 2.
ORD_CTE = f"""
ord AS (SELECT o.o_orderkey, {place('o.o_orderkey', 500)}, o.o_orderstatus = 'F' AS shipped FROM orders o),
lines AS (SELECT DISTINCT l_orderkey, l_linenumber, {place('l_orderkey', 500)} FROM lineitem)"""

EVT_CTE = f"""
evt AS (SELECT event_id, event_type, value, props, user_id, {place('user_id', 50)} FROM events)"""

# Batches of the documents: one per step.
META_CTE = DOC_CTE + """,
meta AS (SELECT global_step AS batch_id, CAST(doc_id % 40 AS BIGINT) AS batch_index, global_step, global_index,
                n_chars, quality IS NOT NULL AS labelled,
                'n_chars:bigint:[]:1' || CASE WHEN quality IS NOT NULL THEN ',quality:int:[]:1' ELSE ',quality:-:-:0' END
                || ',text:-:-:1' AS fields_text
         FROM doc)"""
