"""Connected components of a table of links, by rounds of contraction; links never come to the driver."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.llm.common import at_rest


def components(links: DataFrame) -> DataFrame:
    """(v, root) for every vertex of links(a, b): equal roots mean one component; root is one of its vertices.

    In each round every vertex points to the neighbour of least hash, if less than its own; the hash changes by
    round, so chains and stars alike lose a fixed share of their vertices, and the rounds grow with the logarithm of
    the largest component. A hub's links are reduced where they are read (min), before they are shuffled.
    """
    left = at_rest(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                   .distinct(), "links")
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        seed = F.lit(len(rounds))

        def rank(v: str, seed: Column = seed) -> Column:
            return F.struct(F.xxhash64(F.col(v), seed).alias("h"), F.col(v).alias("v"))

        both = left.select(F.col("a").alias("v"), rank("b").alias("to")).unionAll(
            left.select(F.col("b").alias("v"), rank("a").alias("to")))
        points = both.groupBy("v").agg(F.min("to").alias("to")).select("v", F.least("to", rank("v"))["v"].alias("p"))
        points = at_rest(points, "points")
        rounds.append(points)
        left = at_rest(
            left.join(points.select(F.col("v").alias("a"), F.col("p").alias("pa")), "a")
            .join(points.select(F.col("v").alias("b"), F.col("p").alias("pb")), "b")
            .filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
            .distinct(), "links")
    if not rounds:
        return left.select(F.col("a").alias("v"), F.col("b").alias("root"))
    roots = rounds.pop().withColumnRenamed("p", "root")
    while rounds:
        after = roots.select(F.col("v").alias("p"), "root")
        roots = rounds.pop().join(after, "p", "left").select("v", F.coalesce("root", "p").alias("root"))
    return at_rest(roots, "roots")
