"""Connected components of an edge table, by contraction: every round is a few shuffles of an ever smaller edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import stash, unstash


def components(edges: DataFrame) -> DataFrame:
    """The smallest node reachable from each node of `edges` (columns u, v, both long).

    Returns (node, component), one row for each node that has an edge. Rows with a null end and loops link nothing. Each round
    points every node at its smallest neighbour, jumps pointers, and contracts; the edges that are left then are those between
    different groups. Nothing is collected but the number of edges left.
    """
    left = stash(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    labels = None
    while True:
        both = left.select("u", "v").union(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("p"))
        for _ in range(2):  # p of p
            up = parent.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            parent = parent.join(up, "p").select("u", F.col("pp").alias("p"))
        parent = stash(parent)
        if labels is None:
            now = parent.select(F.col("u").alias("node"), F.col("p").alias("component"))
        else:
            now = labels.join(parent.withColumnRenamed("u", "component"), "component", "left").select("node", F.coalesce("p", "component").alias("component"))
        now = stash(now)
        to_u, to_v = parent.withColumnRenamed("p", "pu"), parent.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        rest = left.join(to_u, "u").join(to_v, "v").where("pu <> pv")
        rest = stash(rest.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct())
        for old in (left, labels, parent):
            unstash(old)
        left, labels = rest, now
        if left.isEmpty():
            unstash(left)
            return labels
