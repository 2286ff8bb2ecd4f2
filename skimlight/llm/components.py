"""Connected components of a link table, by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import materialise


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for all nodes of ``links`` (a, b longs): the smallest node reachable.

    Each round gives every node and its parent the smallest grandparent among its
    neighbours, then jumps to the grandparent: about log2(longest path) rounds, each a
    fixed number of shuffles on node ids. All reductions are minima that tasks combine
    before they send, and the lookups on a parent, where one large component makes a
    hot key, are plain joins whose skewed partitions AQE splits. Repeated links and links
    of a node with itself change nothing, and a node with no other link has no row; ends are not null; no links give no rows.
    """
    edges = materialise(
        links.where("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b").distinct(),
        "edges",
    )
    state = materialise(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("p")), "components")
    total = F.sum(F.col("p").cast("decimal(38,0)")).alias("s")
    before, now = object(), state.agg(total).first().s
    while now != before:
        up = state.select(F.col("node").alias("p"), F.col("p").alias("gp"))
        seen = materialise(state.join(up, "p").select("node", "p", "gp"), "grandparents")
        low = edges.join(seen.select(F.col("node").alias("b"), "gp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("gp").alias("m"))
        moves = seen.join(low, "node").select(
            F.explode(F.array(
                F.struct("node", F.least("p", "gp", "m").alias("p")),
                F.struct(F.col("p").alias("node"), F.col("m").alias("p")),
            )).alias("x")
        ).select("x.*")
        state = materialise(moves.groupBy("node").agg(F.min("p").alias("p")), "components")
        before, now = now, state.agg(total).first().s
    return state.select("node", F.col("p").alias("component"))
