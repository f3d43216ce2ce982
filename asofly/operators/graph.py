"""Connected components on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofly.session import drop_path, scratch_path


def _star(pairs: DataFrame) -> DataFrame:
    """One round: every neighbour of a vertex is linked to the least vertex around it.

    ``pairs`` are (u, v) with u > v. Large star links the larger neighbours of each
    vertex to its least one, small star does so for the smaller neighbours; both
    keep components, and alternating them ends in stars.
    """
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionByName(low.select("u", F.col("m").alias("v")))
    return small.distinct()


def connected_components(edges: DataFrame, left: str, right: str, max_rounds: int = 64) -> DataFrame:
    """(vertex, component) of every vertex that an edge touches; a component is named by its least vertex.

    Alternating large and small stars, each round a written table, until a round
    changes nothing. Loops and repeated edges are allowed, nulls are dropped; a
    vertex with loops only is its own component.
    """
    spark = edges.sparkSession
    folder = scratch_path(spark, "components")
    clean = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a is not null and b is not null")
    loops = clean.where("a = b").select(F.col("a").alias("vertex")).distinct()
    pairs = clean.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    schema = pairs.schema

    def saved(df: DataFrame, n: int) -> tuple[DataFrame, tuple]:
        df.write.parquet(f"{folder}/{n}")
        back = spark.read.schema(schema).parquet(f"{folder}/{n}")
        row = back.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return back, (row.n, row.h)

    pairs, state = saved(pairs, 0)
    for n in range(1, max_rounds + 1):
        if not state[0]:
            break
        after, now = saved(_star(pairs), n)
        drop_path(spark, f"{folder}/{n - 1}")
        pairs, changed = after, now != state
        state = now
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select(F.col("v").alias("vertex")).distinct().select("vertex", F.col("vertex").alias("component"))
    found = pairs.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(roots)
    alone = loops.join(found, "vertex", "left_anti").select("vertex", F.col("vertex").alias("component"))
    return found.unionByName(alone)
