"""Connected components by alternating stars, without collecting links or labels to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recframe.llm.common import materialise


#: A node's links are dealt over so many keys, so that a hub's don't meet in one task.
DEALT = 64


def _least(links: DataFrame) -> DataFrame:
    """u, v, m: every link in both directions beside the least of u and its neighbours.

    Links go by their node and a hash of the other end. The minimum is combined on the map side, then over a node's keys, and comes back
    once for each key that the node has (at most DEALT).
    """
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).withColumn("deal", F.pmod(F.xxhash64("v"), F.lit(DEALT)))
    parts = both.groupBy("u", "deal").agg(F.min("v").alias("m"))
    least = parts.groupBy("u").agg(F.min("m").alias("m"), F.collect_list("deal").alias("deals"))
    back = least.select(F.col("u").alias("w"), F.least("u", "m").alias("m"), F.explode("deals").alias("d"))
    return both.join(back, (both.u == back.w) & (both.deal == back.d)).select("u", "v", "m")


def components(links: DataFrame) -> DataFrame:
    """node, label: for every node of links (u, v; any orderable type) the least node of its component.

    Self-links keep their node. Rounds: each node's larger neighbours go to its least neighbour (large star), then its smaller
    ones do (small star), until every node hangs on its component's least one: every round brings some link nearer to it, so
    this ends; O(log n) rounds in practice. Null ends are no links; no links give no rows.
    """
    links = materialise(links.where(F.col("u").isNotNull() & F.col("v").isNotNull()).select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).distinct())
    nodes = links
    links = links.where("u != v")
    while True:
        large = _least(links).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))  # in large every u > v
        small = large.join(down.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u != v").distinct()
        links = materialise(small)
        # done when all links lead to nodes that have no smaller neighbour, one link for each node
        state = links.groupBy("u").agg(F.count("*").alias("n"))
        again = state.where("n > 1").limit(1).count() or links.select(F.col("v").alias("u")).join(state, "u", "left_semi").limit(1).count()
        if not again:
            break
    roots = nodes.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return roots.join(links.select(F.col("u").alias("node"), F.col("v").alias("label")), "node", "left").select("node", F.coalesce("label", "node").alias("label"))
