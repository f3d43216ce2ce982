"""Components that stay themselves while edges come and go.

A stored table says for each vertex which component it is in. New edges are
contracted through it: between components that they don't touch nothing is computed.
A component that grows or merges keeps the oldest name among its parts; one that
falls apart hands its name to the part with its oldest vertex, and the others get new ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofly.operators.graph import connected_components
from asofly.session import materialize


def first_components(edges: DataFrame, left: str, right: str, batch: int = 0) -> DataFrame:
    """(vertex, component, since, born): components of a first batch; ``since`` is a vertex's batch, ``born`` its component's."""
    found = connected_components(edges, left, right)
    return found.select("vertex", "component", F.lit(batch).cast("long").alias("since"), F.lit(batch).cast("long").alias("born"))


def add_edges(stored: DataFrame, edges: DataFrame, left: str, right: str, batch: int) -> tuple[DataFrame, DataFrame]:
    """The table after a batch of new edges, and (component, into): names that have gone by merging.

    Both ends of an edge are replaced by their component's name, new vertices by themselves;
    components of these contracted edges are the merges. Only renamed rows change.
    """
    ends = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a is not null and b is not null")
    touched = ends.select(F.col("a").alias("vertex")).unionByName(ends.select(F.col("b").alias("vertex"))).distinct()
    known = touched.join(stored, "vertex", "left").select("vertex", F.coalesce("component", "vertex").alias("own"), F.col("component").isNull().alias("new"), "born")
    known = materialize(known, "delta-ends")
    named = lambda c: known.select(F.col("vertex").alias(c), F.col("own").alias(f"own_{c}"))
    # a loop on every end keeps those that no other one touches; stored and new names may be equal words, so they are told apart
    kind = known.select(F.struct("new", "own").alias("node"), "born").distinct()
    tagged = known.select("vertex", F.struct("new", "own").alias("node"))
    pairs = ends.join(tagged.withColumnRenamed("vertex", "a").withColumnRenamed("node", "x"), "a").join(tagged.withColumnRenamed("vertex", "b").withColumnRenamed("node", "y"), "b").select("x", "y")
    merged = connected_components(pairs.distinct(), "x", "y")
    oldest = F.min(F.struct(F.coalesce("born", F.lit(batch).cast("long")).alias("born"), F.col("node.new").alias("new"), F.col("node.own").alias("own")))
    group = merged.join(kind, merged["vertex"] == kind["node"]).groupBy("component").agg(oldest.alias("o"))
    target = materialize(merged.join(group, "component").select(F.col("vertex").alias("node"), F.col("o.own").alias("into"), F.col("o.born").alias("into_born")), "delta-merges")
    moved = target.where("not node.new and node.own <> into").select(F.col("node.own").alias("component"), "into", "into_born")
    fresh = tagged.where("node.new").join(target, "node").select("vertex", F.col("into").alias("component"), F.lit(batch).cast("long").alias("since"), F.col("into_born").alias("born"))
    kept = stored.join(moved, "component", "left").select("vertex", F.coalesce("into", "component").alias("component"), "since", F.coalesce("into_born", "born").alias("born"))
    return kept.unionByName(fresh), moved.select("component", "into")


def remove_edges(stored: DataFrame, left_edges: DataFrame, removed: DataFrame, left: str, right: str, batch: int) -> tuple[DataFrame, DataFrame]:
    """The table after edges went, and (component, into): the parts of components that fell apart.

    ``left_edges`` are all edges that are still there. Only components with a removed edge are
    computed again; vertices without any edge left are components of their own.
    """
    gone = removed.select(F.explode(F.array(left, right)).alias("vertex")).distinct().join(stored, "vertex").select("component").distinct()
    old = materialize(stored.join(gone, "component", "left_semi"), "delta-old")
    edges = left_edges.select(F.col(left).alias("a"), F.col(right).alias("b")).join(old.select(F.col("vertex").alias("a")), "a", "left_semi")
    loops = old.select(F.col("vertex").alias("a"), F.col("vertex").alias("b"))
    parts = connected_components(edges.unionByName(loops), "a", "b").select("vertex", F.col("component").alias("part"))
    placed = materialize(old.join(parts, "vertex"), "delta-parts")
    first = placed.groupBy("component").agg(F.min(F.struct("since", "vertex"))["vertex"].alias("vertex")).join(placed.select("vertex", "part"), "vertex").select("component", F.col("part").alias("heir"))
    named = placed.join(first, "component").withColumn("name", F.when(F.col("part") == F.col("heir"), F.col("component")).otherwise(F.concat(F.col("part").cast("string"), F.lit(f"~{batch}")).cast(stored.schema["component"].dataType)))
    changed = named.select("vertex", F.col("name").alias("component"), "since", F.when(F.col("name") == F.col("component"), F.col("born")).otherwise(F.lit(batch).cast("long")).alias("born"))
    report = named.where("name <> component").select("component", F.col("name").alias("into")).distinct()
    return stored.join(gone, "component", "left_anti").select(*changed.columns).unionByName(changed), report
