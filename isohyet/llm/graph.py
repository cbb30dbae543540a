"""Connected components of an edge table, without gathering edges anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.llm.common import cut, freed

ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, root): each node that has an edge, and the smallest node it reaches.

    Large-star and small-star steps in turn (Kiveris et al. 2014). Each step hangs neighbours on the smallest one,
    so the table stays at most as large as the edges, in a number of rounds that grows with the logarithm of the
    longest path, until each node hangs on one that hangs on none. Each round is written to the shared folder. Loops,
    repeats and nulls are left out.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = cut(e, "edges")
    for _ in range(ROUNDS):
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("top")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("top")))
        with freed(edges.sparkSession):
            settled = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("top").alias("top")).where("up + top > 1 and up > 0").isEmpty()
        if settled:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p")).select("p.u", "p.v")
        e = cut(small.where("u <> v").distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
