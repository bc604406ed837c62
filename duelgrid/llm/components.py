"""Connected components of links that no single task could hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelgrid.llm.arrow import checkpointed


def _hung_low(links: DataFrame) -> DataFrame:
    """Every node hangs its larger neighbours on its smallest neighbour (or on itself)."""
    both = links.unionByName(links.select(F.col("low").alias("high"), F.col("high").alias("low")))
    ends = both.select(F.col("high").alias("hub"), F.col("low").alias("other"))
    least = ends.groupBy("hub").agg(F.least(F.min("other"), F.col("hub")).alias("least"))
    moved = ends.where("other > hub").join(least, "hub")
    return moved.select(F.col("other").alias("high"), F.col("least").alias("low")).distinct()


def _hung_flat(links: DataFrame) -> DataFrame:
    """Every node hangs its smaller neighbours and itself on the smallest of them."""
    least = links.groupBy("high").agg(F.min("low").alias("least"))
    moved = links.join(least, "high").where("low > least").select(F.col("low").alias("high"), F.col("least").alias("low"))
    return moved.unionByName(least.select("high", F.col("least").alias("low"))).distinct()


def roots(links: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, root) for every node of `links` (two long columns, a and b); the root is the smallest node reachable.

    Two steps alternate until nothing moves, a number of rounds that grows with the logarithm of the longest path.
    Each is a minimum per node and a join with it, so a node with very many links is pre-aggregated and Spark can
    split it. Every round is written to the shared folder; `rows` bounds the number of links, if known. Links of a node to itself and repeated links are allowed,
    links with a null end are left out; no links give an empty table.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    clean = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    links = checkpointed(clean.select(high.alias("high"), low.alias("low")).distinct(), "links", rows)
    mark = None
    while True:
        state = links.agg(F.count("*"), F.bit_xor(F.xxhash64("high", "low"))).first()
        if state == mark or state[0] == 0:
            break
        mark = state
        links = checkpointed(_hung_flat(_hung_low(links)), "links", 2 * state[0])
    return links.select(F.col("high").alias("node"), F.col("low").alias("root")).unionByName(
        links.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct()
    )
