"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import text as tx


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Point the larger (large) or the smaller neighbours of every node at its least neighbour."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    if large:
        return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    out = both.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a > b").distinct()


def components(links: DataFrame, *, most_rounds: int = 40) -> DataFrame:
    """node and root (the least node of its component) for every node of links(a, b). Every round is written to the shared folder.
    A table without links gives no rows."""
    kind = dict(links.dtypes)["a"]
    edges = tx.stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(most_rounds):
        now = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
        if now == before or not now[0]:
            break
        before, old = now, edges
        edges = tx.stored(_stars(_stars(old, True), False), "links")
        tx.discard(old)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct()).select(F.col("node").cast(kind), F.col("root").cast(kind))
