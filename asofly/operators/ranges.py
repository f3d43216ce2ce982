"""Rows of a total order in range partitions, and prefix sums over the partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofly.session import materialize


def ranged(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """Rows in range partitions of a total order, with their place in it as (_p, _i); written, so that the ranges stay."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    part = F.shiftright("_m", 33)
    return materialize(placed.withColumn("_p", part).withColumn("_i", F.col("_m") - F.shiftleft(part, 33)).drop("_m"), label)


def bases(sums: DataFrame) -> Column:
    """Prefix sums of a number for each range partition (_p, n): what lies before it. One row for a partition on the driver."""
    base, before = 0, {}
    for r in sorted(sums.collect(), key=lambda r: r._p):
        before[r._p] = base
        base += r.n or 0
    return F.create_map(*[F.lit(x) for kv in (before or {0: 0}).items() for x in kv])
