"""Connected components over an edge table by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import Stored


def connected_components(edges: DataFrame, store: Stored, max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component is the smallest node that links reach.

    Self links and repeated links are allowed; an empty table gives an empty table. A round points all larger
    neighbours of a node at its smallest neighbour (large star), then all smaller ones (small star), until the
    links are stars; rounds grow with the logarithm of the longest chain. Minima are pre-aggregated before the
    shuffle, so no node's neighbours are gathered in one row, and stored: the join back then knows their size. Below
    Spark's broadcast threshold the links stay where they are, a hub's too; beyond it both sides are plain shuffles,
    whose skewed partitions adaptive execution may split. Each round is a table in the shared folder; the last but
    one is dropped."""
    links, path = store.put(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _sum(links)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = links.union(links.select("b", "a"))
        least, least_path = store.put(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("least")))
        large = both.where("b > a").join(least, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(down.withColumnRenamed("a", "node"), F.col("a") == F.col("node")).where("b > least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        new, new_path = store.put(small.union(down.select("a", F.col("least").alias("b"))).where("a <> b").distinct())
        after = _sum(new)
        same = after == before and new.subtract(links).isEmpty()  # sums may agree by chance, rows don't
        store.drop(path)
        store.drop(least_path)
        links, path, before = new, new_path, after
        if same:
            break
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select("b", "b").distinct())


def _sum(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31))).alias("h")).first()
    return row["n"], row["h"] or 0
