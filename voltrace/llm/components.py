"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``; root is the smallest node that it reaches.

    Each round links all larger neighbours of a node to its smallest neighbour, then all smaller ones, which halves the
    depth of the trees; rounds end when the edges don't change. No neighbourhood is collected: a round is two minimum
    aggregations and two joins whose skewed keys Spark may split, and its edges are written to shared storage. Null
    nodes, loops and repeated edges are ignored; without edges the result is empty.
    """
    x, y = F.least(a, b), F.greatest(a, b)
    stars = materialize(edges.where(x < y).select(y.alias("n"), x.alias("m")).distinct(), "edges")
    state = None
    while True:
        both = stars.unionByName(stars.select(F.col("m").alias("n"), F.col("n").alias("m")))
        least = both.groupBy("n").agg(F.min("m").alias("least")).withColumn("least", F.least("n", "least"))
        large = both.join(least, "n").where("m > n").select(F.col("m").alias("n"), F.col("least").alias("m"))
        large = materialize(large.distinct(), "large-star")
        least = large.groupBy("n").agg(F.min("m").alias("least"))
        small = large.join(least, "n").select(
            F.explode(F.array(F.struct("n", F.col("least").alias("m")), F.struct(F.col("m").alias("n"), F.col("least").alias("m")))).alias("e")
        )
        stars = materialize(small.select("e.*").where("m < n").distinct(), "small-star")
        now = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("n", "m"))).first()
        if now == state:
            break
        state = now
    return stars.select(F.col("n").alias("node"), F.col("m").alias("root")).unionByName(
        stars.select(F.col("m").alias("node"), F.col("m").alias("root")).distinct()
    )
