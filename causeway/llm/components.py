"""Connected components of an undirected graph whose nodes have few neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import discard, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """``(node, root)`` for every node of ``edges``; root is the least node that can be reached.

    Each round takes the least parent among a node's neighbours, offers it to the node and
    to the node's present parent, then halves the paths to the roots, so that the number of
    rounds grows with the logarithm of the longest path.  All tables stay distributed and
    are cut by a written table each round.  Minima are combined before the shuffle; joins
    meet written tables keyed by node, so that adaptive execution can split a root that
    many nodes point to.  The tables of a round go when the next one is written.  Nulls and self-loops add no edge; no edges give no rows.
    """
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    both = materialize(
        e.select(F.col(a).alias("u"), F.col(b).alias("v")).union(e.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct(), "edges"
    )
    parent = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("p")).withColumnRenamed("u", "node"), "parents")
    before = None
    for _ in range(max_rounds):
        now = parent.agg(F.count("*"), F.sum(F.xxhash64("node", "p").cast("decimal(38,0)"))).first()
        if now == before:
            discard(both)
            return parent.select("node", F.col("p").alias("root"))
        before = now
        offered = both.join(parent.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("p").alias("m")).withColumnRenamed("u", "node")
        offered = offered.join(parent, "node")
        hooked = materialize(
            offered.select("node", F.least("m", "p").alias("p"))
            .union(offered.select(F.col("p"), F.col("m")))
            .union(parent.select("node", "p"))
            .groupBy("node")
            .agg(F.min("p").alias("p")),
            "hooked",
        )
        grand = hooked.select(F.col("node").alias("p"), F.col("p").alias("pp"))
        old, parent = parent, materialize(hooked.join(grand, "p").select("node", F.col("pp").alias("p")), "parents")
        discard(old, hooked)
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
