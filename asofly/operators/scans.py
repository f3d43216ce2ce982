"""Ordered scans and rank selection that no single key can hold up.

A window sorts and walks a key's rows in one task. Where a key holds more than
``HOT_ROWS`` rows, its rows are laid out over range partitions of (key, order) instead:
each partition is scanned on its own, what its last key has gathered is carried into the
next partitions of that key, and the carry is put before every row there. A carry is
an associative sum (latest value, sum, least, greatest), so the result is the window's.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from asofly.operators.ranges import bases, ranged

#: Rows of one key that a task sorts and walks; keys with more are split.
HOT_ROWS = 5_000_000


@dataclass(frozen=True)
class Scan:
    """A running value of ``column``: the latest that isn't null, or the sum, least or greatest.

    Of the rows up to each row, or with ``exclusive`` only those before it; ``backward`` runs from the last row to the first.
    """

    column: str
    how: str = "last"
    exclusive: bool = False
    backward: bool = False

    def over(self, key: list[str], order: list[str]) -> Column:
        w = Window.partitionBy(*key).orderBy(*[F.desc_nulls_last(c) if self.backward else F.asc_nulls_first(c) for c in order])
        frame = w.rowsBetween(Window.unboundedPreceding, -1 if self.exclusive else 0)
        if self.how == "last":
            return F.last(self.column, ignorenulls=True).over(frame)
        return getattr(F, self.how)(self.column).over(frame)

    def whole(self, place: str) -> Column:
        """The value over all rows of a group, ``place`` being their order."""
        if self.how == "last":
            known = F.when(F.col(self.column).isNotNull(), F.col(place))
            return (F.min_by if self.backward else F.max_by)(self.column, known)
        return getattr(F, self.how)(self.column)

    def join(self, before: Column, here: Column) -> Column:
        if self.how == "last":
            return F.coalesce(here, before)
        if self.how == "sum":
            return F.coalesce(before + here, before, here)
        return F.least(before, here) if self.how == "min" else F.greatest(before, here)

    def add(self, before, here):
        """``join`` of two values on the driver."""
        if before is None or here is None:
            return here if before is None else before
        return {"last": lambda: here, "sum": lambda: before + here, "min": lambda: min(before, here), "max": lambda: max(before, here)}[self.how]()

    def carries(self, parts: list[tuple[int, object, object, object, object]]) -> dict[int, object]:
        """What reaches each partition from those before it; a part is (number, first key, last key, value of the first key there, of the last)."""
        out, carry, end = {}, None, None
        for n, (p, first, last, of_first, of_last) in enumerate(reversed(parts) if self.backward else parts):
            enter, leave, gathered = (last, first, of_first) if self.backward else (first, last, of_last)
            out[p] = carry if n and end == enter else None
            carry = self.add(out[p], gathered) if first == last else gathered
            end = leave
        return out


def windowed_scan(rows: DataFrame, key: list[str], order: list[str], scans: dict[str, Scan]) -> DataFrame:
    """The scans by a window: a key's rows in one task."""
    return rows.withColumns({name: s.over(key, order) for name, s in scans.items()})


def segmented_scan(rows: DataFrame, key: list[str], order: list[str], scans: dict[str, Scan]) -> DataFrame:
    """The scans over range partitions of (key, order): a key of any size is split wherever its order differs.

    What is brought to the driver is the first and last key of each partition and what the
    two have gathered there: two rows a partition.
    """
    local = ranged(rows, [*key, *order], "scan")
    ident = F.struct(*[F.col(c) for c in key])
    ends = local.groupBy("_p").agg(F.min_by(ident, "_i").alias("_first"), F.max_by(ident, "_i").alias("_last"))
    is_first, is_last = (F.col("_key").eqNullSafe(F.col(c)) for c in ("_first", "_last"))
    sums = (
        local.withColumn("_key", ident).join(F.broadcast(ends), "_p").where(is_first | is_last)
        .groupBy("_p", is_first.alias("_is_first"), is_last.alias("_is_last"))
        .agg(F.any_value("_key").alias("_key"), *[s.whole("_i").alias(f"_c{i}") for i, s in enumerate(scans.values())])
    )
    found: dict[int, dict[str, object]] = {}
    for r in sums.collect():
        found.setdefault(r["_p"], {}).update({end: r for end in ("_first", "_last") if r[f"_is{end}"]})
    parts = sorted(found)
    carried = [
        s.carries([(p, found[p]["_first"]["_key"], found[p]["_last"]["_key"], found[p]["_first"][f"_c{i}"], found[p]["_last"][f"_c{i}"]) for p in parts]) for i, s in enumerate(scans.values())
    ]
    schema = StructType([StructField("_p", LongType()), *[StructField(f"_c{i}", sums.schema[f"_c{i}"].dataType) for i in range(len(scans))]])
    edges = F.broadcast(rows.sparkSession.createDataFrame([(p, *[c[p] for c in carried]) for p in parts], schema).join(ends, "_p"))
    scanned = local.withColumns({name: s.over(["_p", *key], ["_i"]) for name, s in scans.items()}).withColumn("_key", ident).join(edges, "_p")
    done = {name: F.when(is_last if s.backward else is_first, s.join(F.col(f"_c{i}"), F.col(name))).otherwise(F.col(name)) for i, (name, s) in enumerate(scans.items())}
    return scanned.withColumns(done).drop("_p", "_i", "_key", "_first", "_last", *[f"_c{i}" for i in range(len(scans))])


def _may_be_hot(rows: DataFrame, hot_rows: int) -> bool:
    """Whether a key may have so many rows at all, by the planner's estimate of the table's bytes; only saves a count."""
    return int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > hot_rows


def split_hot(rows: DataFrame, key: list[str], hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """The rows of keys of at most ``hot_rows`` rows, and those of larger keys (None if there are none).

    There are at most rows / hot_rows larger keys, so they are broadcast.
    """
    if not _may_be_hot(rows, hot_rows):
        return rows, None
    hot = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows).drop("_n").collect()
    if not hot:
        return rows, None
    named = rows.sparkSession.createDataFrame(hot, StructType([rows.schema[c] for c in key])).select(*[F.col(c).alias(f"_h{i}") for i, c in enumerate(key)])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_h{i}")) for i, c in enumerate(key)])
    return rows.join(F.broadcast(named), same, "left_anti"), rows.join(F.broadcast(named), same, "left_semi")


def running(rows: DataFrame, key: list[str], order: list[str], scans: dict[str, Scan], hot_rows: int = HOT_ROWS) -> DataFrame:
    """The scans: by a window for keys that fit a task, over range partitions for larger ones. Rows with equal (key, order) stand in any order."""
    cold, hot = split_hot(rows, key, hot_rows)
    done = windowed_scan(cold, key, order, scans)
    return done if hot is None else done.unionByName(segmented_scan(hot, key, order, scans))


def rank_selected(rows: DataFrame, by: list[str], value: str, inclusive: dict[str, float], index: dict[str, float] | None = None) -> DataFrame:
    """Quantiles of the non-null values of each group by their ranks: all rows are numbered once over range partitions of (group, value).

    A group's first number and size give the numbers wanted for each share, and one join on
    the number fetches them: no group is gathered anywhere. ``inclusive`` shares interpolate
    between the values around (n - 1) * share, ``index`` ones take the value at int(share * n),
    the last at most.
    """
    index = index or {}
    local = ranged(rows.where(F.col(value).isNotNull()).select(*by, value), [*by, value], "ranks")
    before = bases(local.groupBy("_p").agg(F.count(F.lit(1)).alias("n")))
    numbered = local.select(*by, F.col(value).cast("double").alias("_v"), (F.col("_i") + before[F.col("_p")]).cast("long").alias("_at"))
    groups = numbered.groupBy(*by).agg(F.min("_at").alias("_base"), F.count(F.lit(1)).alias("_n"))

    def want(name: str, place: Column, part: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), place.cast("long").alias("place"), part.cast("double").alias("part"))

    wanted = [want(name, F.least(F.floor(F.lit(share) * F.col("_n")), F.col("_n") - 1), F.lit(1.0)) for name, share in index.items()]
    for name, share in inclusive.items():
        place = (F.col("_n") - 1) * F.lit(share)
        low = F.floor(place)
        wanted += [want(name, low, 1 - (place - low)), want(name, F.least(low + 1, F.col("_n") - 1), place - low)]
    asked = groups.select(*by, "_base", F.explode(F.array(*wanted)).alias("w")).select(*by, "w.name", "w.part", (F.col("_base") + F.col("w.place")).alias("_at"))
    found = asked.join(numbered.select("_at", "_v"), "_at")
    return found.groupBy(*by).agg(*[F.sum(F.when(F.col("name") == name, F.col("part") * F.col("_v"))).alias(name) for name in (*inclusive, *index)])
