"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import stored


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """Hang each node's larger (or smaller) neighbours under the least node of its neighbourhood.

    Minima are partial sums, and the join back to the links can be split, so a node with very many links is no
    bottleneck.
    """
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else edges
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
    joined = both.join(least, "a")
    if larger:
        moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).union(
            joined.select("a", F.col("least").alias("b"))
        )
    pair = moved.where(F.col("a") != F.col("b"))
    return pair.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of the links ``(a, b)``; the root is the component's least node.

    Large and small stars alternate until nothing changes, which takes a number of rounds in the order of the
    logarithm of the component size. Each round is written to the shared folder.
    """
    pairs = edges.where(F.col("a") != F.col("b"))
    now = stored(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(rounds):
        now = stored(_stars(_stars(now, larger=True), larger=False))
        digest = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if digest == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        seen = digest
    raise RuntimeError("the components did not settle")
