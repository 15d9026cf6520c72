"""Connected components of an edge table, by Spark joins and group-bys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finops_spark.llm.common import store


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node of its component.

    Alternates two steps until nothing changes: every node links its larger neighbours to
    its smallest one, then its smaller neighbours. Each step keeps the components, never adds
    edges beyond one for each given end, and the number of rounds grows with the logarithm of
    the longest path. Each round is written to the shared folder. The group of a node that
    many share is only a minimum, so no neighbour list is ever gathered."""
    now = store(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written out, so that the join may split the rows of a node with very many neighbours
        least = store(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")), "least")
        # larger neighbours of u go to the smallest node around u
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("m").alias("a"), "b")
        now = store(large.where("a != b").distinct(), "edges")
        # smaller neighbours of u, and u itself, go to the smallest node below u
        down = store(now.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("u"), "m"), "least")
        small = now.join(down, F.col("b") == F.col("u")).select(F.col("m").alias("a"), F.col("a").alias("b")).where("a != b")
        now = store(small.unionByName(down.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct(), "edges")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if state == before:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()
        before = state
