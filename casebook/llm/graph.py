"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm.store import forget, written


def _minimum(edges: DataFrame) -> DataFrame:
    """Smallest neighbour of each ``a``; partial aggregation takes the weight of hot nodes."""
    return edges.groupBy("a").agg(F.min("b").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = _minimum(both).withColumn("m", F.least("m", "a"))
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges run from the larger ``a`` to the smaller ``b``."""
    low = _minimum(edges)
    moved = edges.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select("a", F.col("m").alias("b"))).distinct()


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """``(a, root)`` for every node that has an edge and is not the smallest of its component.

    ``edges`` has columns ``a`` and ``b`` of one orderable type; direction, loops and repeats do not matter. Every
    step is joins and minima over a written edge table; hot nodes are never gathered. The rounds end when the edges
    form stars around the smallest nodes.
    """
    plain = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = written(plain, name)
    mark = _mark(now)
    while True:
        after = written(_small_star(_large_star(now)), name)
        last, mark = mark, _mark(after)
        forget(now)
        now = after
        if mark == last:
            return now.select("a", F.col("b").alias("root"))
