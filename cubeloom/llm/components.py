"""Connected components of a graph of any size, by alternating large-star and small-star steps.

Both steps are a minimum over neighbours (which combines before the shuffle) and a join back, so a node with very
many neighbours is no single task's work: the join's hot key is split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.llm.common import materialize


def _round(edges: DataFrame) -> DataFrame:
    """``edges``: a > b, distinct. Large-star, then small-star."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(low, "a")
    return (
        small.select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b"))
        .unionByName(low.select("a", F.col("m").alias("b")))
        .distinct()
    )


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) but the roots; root: the least node that links reach."""
    e = (
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    e = materialize(e, "links")
    now, before = _state(e), None
    while now != before and now[0]:
        e = materialize(_round(e), "stars")
        now, before = _state(e), now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
