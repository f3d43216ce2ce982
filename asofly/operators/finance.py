"""Cost, conviction and money panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofly.functions.scoring import highest_phase, site_factor, trial_cost
from asofly.operators.stats import grouped_summary, leave_one_out_ratio
from asofly.operators.temporal import as_of_join, as_of_month_panel


def monthly_cost(versions: DataFrame, members: DataFrame, program: str, trial: str, end: Column) -> DataFrame:
    """Each program's cost index on the first of each month, from the trial versions known by then.

    ``versions``: trial, version, posted_date, phases, enrollment, start_date (fetched ones only).
    Sums are partial on the map side; the panel is one shuffle on the trial, one on (program, month).
    """
    panel = as_of_month_panel(versions, trial, "posted_date", ["version"], end)
    cost = trial_cost(highest_phase(F.col("phases")), F.col("enrollment"), F.col("start_date"), F.col("as_of"))
    joined = panel.withColumn("_cost", cost).join(members.select(program, trial).distinct(), trial)
    return joined.groupBy(program, "as_of").agg(F.sum("_cost").alias("cost_index"))


def cost_snapshot(current: DataFrame, program: str, as_of: Column) -> DataFrame:
    """Present cost with the site factor, which history doesn't know: phases, enrollment, start_date, sites of current records."""
    cost = trial_cost(highest_phase(F.col("phases")), F.col("enrollment"), F.col("start_date"), as_of)
    return current.groupBy(program).agg(F.sum(cost * site_factor(F.col("sites"))).alias("cost_index"), F.sum("sites").alias("site_count"))


def conviction(spend: DataFrame, groups: list[str], program: str, month: str, value: str) -> DataFrame:
    """Positive spend over the median of same-month peers; null with fewer than two of them."""
    return leave_one_out_ratio(spend.where(F.col(value) > 0), [month, *groups], program, value)


def money_panel(events: DataFrame) -> DataFrame:
    """(subject, date) rows of financial events: cost of the date, spend so far, the date's own conviction.

    Spend is carried on; a conviction ratio is that of its exact date, never filled.
    """
    cost = F.sum(F.when(F.col("event_type") == "trial_cost_index", F.col("value")))
    ratio = F.max(F.when(F.col("event_type") == "conviction_ratio", F.col("value")))
    daily = events.groupBy("subject_id", "event_date").agg(cost.alias("cost_index"), ratio.alias("conviction_ratio"))
    w = Window.partitionBy("subject_id").orderBy("event_date").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("estimated_cumulative_spend", F.sum("cost_index").over(w))


def spend_at_event(labels: DataFrame, panel: DataFrame, key: str, date: str) -> DataFrame:
    """Each dated label with the spend known on that date; labels without a date are dropped, no match gives nulls."""
    return as_of_join(labels.where(F.col(date).isNotNull()), panel, key, date, "event_date", [], ["estimated_cumulative_spend"])


def spend_by_reason(rows: DataFrame, reason: str, value: str) -> DataFrame:
    """Spend at death by kill reason."""
    return grouped_summary(rows, reason, value)


def exact_month(panel: DataFrame, values: DataFrame, key: str, month: str, field: str) -> DataFrame:
    """R2: a month's own value, by equality and never filled."""
    return panel.join(values.select(key, month, field), [key, month], "left")
