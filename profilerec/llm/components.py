"""Connected components of a distributed edge list by alternating star contractions.

Each round points the larger neighbours of a node at its smallest neighbour (large star), then a
node and its smaller neighbours at the smallest of them (small star). Rounds are tables in the
shared folder, so that lost executors cost one round at most. Minima combine inside tasks before
the shuffle; the join that follows reads a written table of minima, which leaves a hot node's
edges to skew splitting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilerec.session import StepTables


def _fingerprint(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) of every node that has an edge; ``component`` is its smallest reachable node.

    Null ends and loops are ignored; repeated edges count once. No edges: no rows. The result reads
    a table in the shared folder.
    """
    spark = edges.sparkSession
    steps = StepTables(spark, "components")
    pairs = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a is not null and b is not null and a <> b")
    now = steps.write(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while (mark := _fingerprint(now)) != seen:
        seen = mark
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = steps.write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        star = steps.write(large.distinct(), "star")
        least = steps.write(star.groupBy("u").agg(F.min("v").alias("m")), "small")
        small = star.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = steps.write(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    steps.drop("least", "star", "small")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
