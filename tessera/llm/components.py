"""Connected components of pairs, as a table of node and component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Workspace


def roots(ws: Workspace, pairs: DataFrame) -> DataFrame:
    """node, comp (the smallest node that pairs(a, b) connect it with), for nodes that occur in pairs.

    Every round hooks each component to its smallest neighbour, follows the hooks to their ends and
    contracts the pairs, which at least halves the components that still have any. Each table is
    written to the shared folder and the one before is dropped. A pair with a null node connects nothing and is left out.
    """
    edges = ws.keep(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    comp = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("near")))
        hook = ws.keep(both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("comp")), "hooks")
        while True:  # pointer jumping
            up = hook.select(F.col("node").alias("comp"), F.col("comp").alias("_up"))
            jumped = ws.keep(hook.join(up, "comp", "left").select("node", F.coalesce("_up", "comp").alias("comp"), (F.coalesce("_up", "comp") != F.col("comp")).alias("moved")), "hooks")
            ws.drop(hook)
            hook = jumped
            if hook.where("moved").isEmpty():
                break
        hook_path, hook = hook, hook.select("node", "comp")
        step = hook.select(F.col("node").alias("comp"), F.col("comp").alias("_up"))
        grown = hook if comp is None else comp.join(step, "comp", "left").select("node", F.coalesce("_up", "comp").alias("comp")).unionByName(hook.join(comp.select("node"), "node", "left_anti"))
        grown = ws.keep(grown, "components")
        to_a, to_b = hook.select(F.col("node").alias("a"), F.col("comp").alias("_a")), hook.select(F.col("node").alias("b"), F.col("comp").alias("_b"))
        left = edges.join(to_a, "a").join(to_b, "b").where("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct()
        left = ws.keep(left, "edges")
        ws.drop(edges, hook_path, *([comp] if comp is not None else []))
        edges, comp = left, grown
    return comp if comp is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
