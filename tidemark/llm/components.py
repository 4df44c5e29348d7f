"""Connected components by alternating large-star and small-star steps.

Edges stay distributed; every round is written to the shared folder, so a lost
executor costs a round at most, and no list of members is ever formed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import packed as P


def _least(edges: DataFrame) -> DataFrame:
    """u, v and the least of u and its neighbours, for edges (u, v) in the directions given."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return edges.join(least, "u")


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _stars(edges: DataFrame) -> bool:
    """Whether every u has one v and no v is a u: the edges are (node, root) then."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    odd = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1")
    return odd.agg(F.count("*")).first()[0] == 0


def roots(edges: DataFrame, scratch: P.Scratch) -> DataFrame:
    """(node, root) for edges (u, v), stored: the root is the least node that can be reached.  Nodes without an edge aren't listed."""
    edges = edges.select("u", "v").where("u <> v")
    e = scratch.stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _stars(e):
        # large star: every greater neighbour v of u goes to the least, so that edges point down
        large = _least(_both(e)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: u and its neighbours go to the least of them
        small = _least(large).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
        last, e = e, scratch.stored(small.select("x.u", "x.v").where("u <> v").distinct(), "edges")
        scratch.drop(last)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
