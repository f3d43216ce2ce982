"""As-of lookups, month spines, latest revisions and other ordered analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofly.operators.ranges import bases, ranged
from asofly.operators.scans import HOT_ROWS, Scan, running


def as_of_point(rows: DataFrame, key: str, order: list[str], date: str, as_of: Column) -> DataFrame:
    """For each key the row with the greatest ``order`` among those dated on or before ``as_of``.

    One hash aggregate on the key (partial results first), no window and no sort.
    """
    rest = [c for c in rows.columns if c != key]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return rows.where(F.col(date) <= as_of).groupBy(key).agg(best.alias("_row")).select(key, "_row.*")


def validity(rows: DataFrame, key: str, date: str, order: list[str]) -> DataFrame:
    """Each version with the date of the next, from which on it no longer holds (null for the last)."""
    w = Window.partitionBy(key).orderBy(date, *order)
    return rows.withColumn("valid_to", F.lead(date).over(w))


def month_spine(rows: DataFrame, start: str, end: Column, name: str = "as_of") -> DataFrame:
    """A row for each first-of-month from the month of ``start`` to ``end``."""
    return rows.withColumn(name, F.explode(F.sequence(F.trunc(start, "MM").cast("date"), end.cast("date"), F.expr("interval 1 month"))))


def as_of_month_panel(versions: DataFrame, key: str, date: str, order: list[str], end: Column, name: str = "as_of") -> DataFrame:
    """J2 + W6: for every key and month since the month of its first version, the version that held on the month's first day.

    Each version is exploded into the months of its own validity, so there is one
    shuffle on the key and no join. The spine begins on the first day of the first
    version's month, when usually nothing is known yet: those rows carry nulls.
    """
    spans = validity(versions, key, date, order).withColumn("_first", F.min(date).over(Window.partitionBy(key)))
    # first month that begins on or after the version, and the last that begins before its successor
    begin = F.when(F.trunc(date, "MM") == F.col(date), F.col(date)).otherwise(F.add_months(F.trunc(date, "MM"), 1)).cast("date")
    until = F.least(F.coalesce(F.date_sub(F.col("valid_to"), 1), end), end).cast("date")
    held = spans.where(begin <= until).withColumn(name, F.explode(F.sequence(begin, until, F.expr("interval 1 month"))))
    months = held.drop("valid_to", "_first")
    first = spans.groupBy(key).agg(F.min("_first").alias("_first")).withColumn(name, F.trunc("_first", "MM").cast("date")).where((F.col(name) < F.col("_first")) & (F.col(name) <= end))
    return months.unionByName(first.select(key, name), allowMissingColumns=True)


def as_of_join(left: DataFrame, right: DataFrame, key: str, at: str, date: str, order: list[str], fields: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each left row with the fields of the right row that held at its time; nulls where none did.

    Both sides are merged on (key, time) and the last right row is carried forward:
    one shuffle on the key, linear in both sides, no row pairs; a key of any size is split.
    """
    l_cols = left.columns
    both = left.select(F.struct(*l_cols).alias("_l"), F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(_struct_type(right, fields)).alias("_r"), *[F.lit(None).cast(right.schema[c].dataType).alias(f"_o{i}") for i, c in enumerate(order)])
    other = right.select(
        F.lit(None).cast(both.schema["_l"].dataType).alias("_l"), F.col(key).alias("_k"), F.col(date).alias("_t"), F.lit(0).alias("_side"), F.struct(*fields).alias("_r"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]
    )
    merged = running(both.unionByName(other), ["_k"], ["_t", "_side", *[f"_o{i}" for i in range(len(order))]], {"_last": Scan("_r")}, hot_rows)
    return merged.where("_side = 1").select("_l.*", *[F.col("_last")[f].alias(f) for f in fields])


def _struct_type(df: DataFrame, fields: list[str]):
    from pyspark.sql.types import StructType

    return StructType([df.schema[f] for f in fields])


def latest_by(rows: DataFrame, key: str, stamp: str, position: str) -> DataFrame:
    """The row with the greatest stamp of each key; of ties the first in the input. Null stamps are the lowest."""
    rest = [c for c in rows.columns if c != key]
    best = F.max_by(F.struct(*rest), F.struct(F.coalesce(F.col(stamp).cast("string"), F.lit("")), -F.col(position)))
    return rows.groupBy(key).agg(best.alias("_row")).select(key, "_row.*").select(*rows.columns)


def forward_fill(rows: DataFrame, key: str, order: list[str], field: str, name: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The latest non-null value of a field up to each row; a key of any size is split (``scans.running``)."""
    return running(rows, [key], order, {name: Scan(field)}, hot_rows)


def running_sum(rows: DataFrame, key: str, order: list[str], value: str, name: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Sum of the values up to each row; a key of any size is split."""
    return running(rows, [key], order, {name: Scan(value, "sum")}, hot_rows)


def first_crossing(rows: DataFrame, key: str, date: str, score: str, threshold: Column) -> DataFrame:
    """First date on which the score reaches the threshold. NaN never does: it would compare as the greatest."""
    reached = (F.col(score) >= threshold) & ~F.isnan(F.col(score).cast("double"))
    return rows.groupBy(key).agg(F.min(F.when(reached, F.col(date))).alias("flag_date"))


def contiguity(rows: DataFrame, key: str, number: str, date: str, first: int = 0, hot_rows: int = HOT_ROWS) -> DataFrame:
    """For each key, whether versions are numbered from ``first`` without gaps and dates never go back (null dates skipped)."""
    seen = running(rows.select(key, number, date), [key], [number, date], {"_most": Scan(date, "max", exclusive=True)}, hot_rows)
    back = seen.withColumn("_back", F.coalesce(F.col(date) < F.col("_most"), F.lit(False)))
    n, distinct = F.count(F.lit(1)), F.count_distinct(number)
    whole = (F.min(number) == first) & (F.max(number) == first + n - 1) & (distinct == n)
    return back.groupBy(key).agg(whole.alias("contiguous"), (~F.bool_or("_back")).alias("monotone"), n.alias("n_versions"))


def top_k_by_tier(rows: DataFrame, key: str, tier: str, newest: list[str], k: int) -> DataFrame:
    """The ``k`` rows of each key by tier, then newest first."""
    w = Window.partitionBy(key).orderBy(F.col(tier), *[F.col(c).desc() for c in newest])
    return rows.withColumn("_rn", F.row_number().over(w)).where(f"_rn <= {k}").drop("_rn")


def dense_ids(rows: DataFrame, order: list[str], name: str = "event_id") -> DataFrame:
    """Numbers 0, 1, 2, ... in a total order, without bringing all rows into one task."""
    local = ranged(rows, order, "dense-ids")
    offsets = bases(local.groupBy("_p").agg(F.count(F.lit(1)).alias("n")))
    return local.withColumn(name, (F.col("_i") + offsets[F.col("_p")]).cast("long")).drop("_p", "_i")


def global_running_sum(rows: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Sum of a value over all rows before each row in a total order, by prefix sums over range partitions."""
    local = ranged(rows, order, "running-sum")
    offsets = bases(local.groupBy("_p").agg(F.sum(value).alias("n")))
    before = F.coalesce(F.sum(value).over(Window.partitionBy("_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return local.withColumn(name, before + offsets[F.col("_p")]).drop("_p", "_i")


def round_robin(rows: DataFrame, cell: list[str], order: Column) -> DataFrame:
    """The turn of each row when strata are served in rotation; sort by (turn, cell)."""
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(*cell).orderBy(order)))


def stratified_sample(rows: DataFrame, stratum: list[str], need: DataFrame, key: str, reserved: DataFrame, order: Column) -> DataFrame:
    """Reserved rows and, for each stratum, as many further ones in hash order as it still needs (column ``need``)."""
    marked = rows.join(reserved.select(key).distinct().withColumn("reserved", F.lit(True)), key, "left").withColumn("reserved", F.coalesce("reserved", F.lit(False)))
    w = Window.partitionBy(*stratum).orderBy(F.col("reserved").desc(), order)
    ranked = marked.join(need, stratum, "left").withColumn("_rn", F.row_number().over(w))
    return ranked.where((F.col("_rn") <= F.coalesce("need", F.lit(0))) | F.col("reserved")).drop("_rn", "need")
