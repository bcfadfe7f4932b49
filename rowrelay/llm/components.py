"""Connected components of a link table, by hooking, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from rowrelay.llm.common import drop, written


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable from every node of ``links`` (a, b).

    A round hooks every node to its smallest neighbour, follows these pointers to their roots (each
    step doubles the distance), and contracts the links to those between different roots. At
    least half of the nodes go in a round, all of a star in the first. Tables are written to the shared
    folder after each step and deleted when the next has them; the driver only learns, from the job that writes, whether something is left. A
    node with very many links is a single minimum, combined before the shuffle. Joins are by shuffle: nothing is
    built on the driver, however many rounds there are.
    """
    edges = written(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct(), "links")
    alone = links.select(F.col("a").alias("node"), F.col("a").alias("label")).filter(links["a"] == links["b"]).distinct()
    labels = None
    while True:
        hooks = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "hooks")
        while True:
            onward = hooks.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
            moved = (F.col("beyond") != F.col("label")).alias("moved")
            jumped = hooks.join(onward.hint("merge"), "label").select("node", F.col("beyond").alias("label"), moved)
            seen = Observation()
            before, hooks = hooks, written(jumped.observe(seen, F.max("moved").alias("moved")).select("node", "label"), "hooks")
            drop(before)
            if not seen.get["moved"]:
                break
        if labels is None:
            labels = hooks
        else:
            roots = hooks.select(F.col("node").alias("label"), F.col("label").alias("root"))
            before, labels = labels, written(labels.join(roots.hint("merge"), "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels")
            drop(before)
        left = hooks.select(F.col("node").alias("a"), F.col("label").alias("root_a"))
        right = hooks.select(F.col("node").alias("b"), F.col("label").alias("root_b"))
        crossing = edges.join(left.hint("merge"), "a").join(right.hint("merge"), "b").filter("root_a <> root_b")
        crossing = crossing.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct()
        seen = Observation()
        before, edges = edges, written(crossing.observe(seen, F.count(F.lit(1)).alias("n")), "links")
        drop(before, *([] if labels is hooks else [hooks]))
        if not seen.get["n"]:
            drop(edges)
            return labels.union(alone.join(labels.select("node").hint("merge"), "node", "left_anti"))
