"""Structure of JSON bodies by path, on VARIANT (S7, P1, P2): what a fixed schema would read as null is seen here.

A body is parsed once and taken apart level by level: an object's members and an array's
elements (all of one path, ``[]``) are rows of the next level, until nothing is nested any
more. Each path of each body is counted once with its kind, so the table of paths is as long as the
structures are different, not as the bodies are many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofly.session import materialize

#: Beyond so many levels a body is taken for damaged.
MOST_LEVELS = 64


def body_paths(bodies: DataFrame, key: str, body: str) -> DataFrame:
    """(key, path, kind): the distinct paths of each body, ``$`` being the whole. Kinds are object, array, null, string, number, boolean; a body that isn't JSON has the kind invalid."""
    parsed = bodies.select(F.col(key).alias("key"), F.try_parse_json(body).alias("v"), F.col(body).isNull().alias("_none"))
    parsed = materialize(parsed.select("key", "_none", F.lit("$").alias("path"), "v", F.col("v").isNull().alias("_bad")), "variant-0")
    found = parsed.where("_bad and not _none").select("key", "path", F.lit("invalid").alias("kind"))
    level = parsed.where("not _bad").select("key", "path", "v")
    for n in range(1, MOST_LEVELS + 1):
        shape = F.schema_of_variant("v")
        kind = (
            F.when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array").when(shape == "VOID", "null")
            .when(shape == "STRING", "string").when(shape == "BOOLEAN", "boolean").otherwise("number")
        )
        typed = level.withColumn("kind", kind)
        found = found.unionByName(typed.select("key", "path", "kind").distinct())
        nested = typed.where(F.col("kind").isin("object", "array"))
        step = nested.lateralJoin(bodies.sparkSession.tvf.variant_explode(F.col("v").outer()).select(F.col("key").alias("_member"), F.col("value").alias("_value")))
        below = step.select("key", F.when(F.col("_member").isNotNull(), F.concat("path", F.lit("."), "_member")).otherwise(F.concat("path", F.lit("[]"))).alias("path"), F.col("_value").alias("v"))
        level = materialize(below, f"variant-{n}")
        if level.isEmpty():
            return found
    raise ValueError(f"bodies are nested deeper than {MOST_LEVELS} levels")


def path_table(paths: DataFrame, bodies: DataFrame, key: str, date: str) -> DataFrame:
    """(path, kind, n, first, last): bodies that have each path in each kind, and the dates between which it was seen, in one aggregate."""
    dated = paths.join(bodies.select(F.col(key).alias("key"), F.col(date).alias("_d")), "key")
    return dated.groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("_d").alias("first"), F.max("_d").alias("last"))


def drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change, kinds_before, kinds_after): paths that came, went, or changed their kinds between two path tables."""
    kinds = lambda df, name: df.groupBy("path").agg(F.sort_array(F.collect_set("kind")).alias(name))
    j = kinds(old, "kinds_before").join(kinds(new, "kinds_after"), "path", "full")
    change = F.when(F.col("kinds_before").isNull(), "added").when(F.col("kinds_after").isNull(), "removed").when(F.col("kinds_before") != F.col("kinds_after"), "kind_changed")
    return j.select("path", change.alias("change"), "kinds_before", "kinds_after").where("change is not null")


def signature(paths: DataFrame) -> DataFrame:
    """(key, signature): first 16 hex digits of a digest of a body's sorted top-level keys, as ``schema_hash`` gives them."""
    top = paths.where(F.col("path").rlike(r"^\$\.[^.\[]+$")).groupBy("key").agg(F.sort_array(F.collect_set(F.substring("path", 3, 10_000))).alias("k"))
    return top.select("key", F.substring(F.sha2(F.to_json("k"), 256), 1, 16).alias("signature"))
