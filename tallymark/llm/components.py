"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.session import materialize

# The edges of one node meet its least neighbour in so many tasks.
SALTS = 16


def _beside_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges ``a, b`` with the one row ``a, m`` of ``a``.

    A hub's edges are spread over ``SALTS`` keys by their other end, and every row of
    ``least`` is copied to all of them, so no task reads all edges of a node.
    """
    salt = F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")
    copies = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return edges.withColumn("salt", salt).join(copies, ["a", "salt"]).drop("salt")


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest node around it."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return _beside_least(both, least).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = _beside_least(down, least).where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b``; root is the least node.

    Alternating large and small stars turn every component into a star around its
    least node in a few rounds (logarithmic in its size in practice). Only sums of a
    round reach the driver; each round is stored in the shared folder, which cuts the
    lineage. The edges of a node with very many neighbours are spread by salt; no
    neighbour list is gathered.
    """
    edges = edges.where(F.col("a") != F.col("b")).select("a", "b")
    mark = None
    for _ in range(rounds):
        edges = materialize(_small_star(_large_star(edges)).where(F.col("a") != F.col("b")).distinct(), "components")
        seen = edges.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        if (seen.n, seen.h) == mark:
            break
        mark = seen.n, seen.h
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
