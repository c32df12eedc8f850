"""Connected components of a graph held in a table, by alternating large and small stars.

Every round rewires edges towards smaller neighbours until each component is a star around its smallest vertex.  All
rounds are joins and aggregates on vertices; nothing but two counts a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from docengine.llm.store import SHUFFLED, Store


def _written(store: Store, edges: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """The edges as a table, with their number and the sum of their hashes, which are observed while they are written."""
    seen = Observation()
    edges = store.put(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), name)
    return edges, (seen.get["n"], seen.get["sum"])


def components(edges: DataFrame) -> DataFrame:
    """``vertex, component`` for every vertex of an edge (``a``, ``b``, both long); the component is its smallest
    vertex.  Loops and repeated edges change nothing."""
    store = Store(edges.sparkSession, "components", **SHUFFLED)
    high, low = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    edges, after = _written(store, edges.where("a <> b").select(high, low).distinct(), "0")
    before, turn = None, 0
    while after[0] and after != before:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("w").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("w"))
        small = large.join(least, "u").where("v > w").select(F.col("v").alias("u"), F.col("w").alias("v"))
        turn, before = turn + 1, after
        edges, after = _written(store, small.union(least.select("u", F.col("w").alias("v"))).distinct(), str(turn))
        store.drop(str(turn - 1))
    stars = edges.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    return stars.union(edges.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct())
