"""Typed change events between adjacent record versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVENT = "struct<event_type:string,field:string,direction:string,from_value:string,to_value:string,detail:string>"


def version_pairs(versions: DataFrame, key: str, version: str, date: str, body: str) -> DataFrame:
    """Adjacent *fetched* versions of a record; pairs whose later version has no date are dropped.

    One window on the key: versions without a body are left out before, so a gap is carried over.
    """
    w = Window.partitionBy(key).orderBy(version)
    pairs = versions.where(F.col(body).isNotNull()).select(key, F.col(version).alias("to_version"), F.col(date).alias("event_date"), F.col(body).alias("curr"), F.lag(version).over(w).alias("from_version"), F.lag(body).over(w).alias("prev"))
    return pairs.where(F.col("from_version").isNotNull() & F.col("event_date").isNotNull())


def event(kind: str, field: str, old: Column, new: Column, direction: Column | None = None, detail: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(kind).alias("event_type"), F.lit(field).alias("field"), (none if direction is None else direction).alias("direction"), old.cast("string").alias("from_value"), new.cast("string").alias("to_value"), (none if detail is None else detail).alias("detail")
    )


def scalar_change(kind: str, field: str, old: Column, new: Column) -> Column:
    """an event if both sides are known and differ."""
    return F.when(old.isNotNull() & new.isNotNull() & (old != new), event(kind, field, old, new))


def array_change(kind: str, field: str, old: Column, new: Column) -> Column:
    """an event if the sorted lists differ; no list counts as the empty one, so a first value does fire."""
    flat = lambda c: F.sort_array(F.coalesce(c, F.array().cast("array<string>")))
    return F.when(flat(old) != flat(new), event(kind, field, F.to_json(flat(old)), F.to_json(flat(new))))


def dated_change(field: str, old: Column, new: Column) -> Column:
    """F29 over structs(date, type): estimate made actual is a finalisation, the reverse a reopening, else earlier or later."""
    known = old["date"].isNotNull() & new["date"].isNotNull()
    made_actual = (old["type"] == "ESTIMATED") & (new["type"] == "ACTUAL")
    reopened = (old["type"] == "ACTUAL") & (new["type"] == "ESTIMATED")
    direction = F.when(new["date"] > old["date"], "later").otherwise("earlier")
    return (
        F.when(known & made_actual, event(f"{field}_finalized", field, old["date"], new["date"]))
        .when(known & reopened, event("trial_reopened", field, old["date"], new["date"]))
        .when(known & (old["date"] != new["date"]), event(f"{field}_changed", field, old["date"], new["date"], direction))
    )


def count_change(field: str, old: Column, new: Column) -> Column:
    """F29 over structs(count, type), as for dates: increased or decreased."""
    known = old["count"].isNotNull() & new["count"].isNotNull()
    made_actual = (old["type"] == "ESTIMATED") & (new["type"] == "ACTUAL")
    reopened = (old["type"] == "ACTUAL") & (new["type"] == "ESTIMATED")
    direction = F.when(new["count"] > old["count"], "increased").otherwise("decreased")
    return (
        F.when(known & made_actual, event(f"{field}_finalized", field, old["count"], new["count"]))
        .when(known & reopened, event("trial_reopened", field, old["count"], new["count"]))
        .when(known & (old["count"] != new["count"]), event(f"{field}_changed", field, old["count"], new["count"], direction))
    )


def member_changes(field: str, old: Column, new: Column) -> Column:
    """An event for each member added to or removed from a list."""
    none = F.array().cast("array<string>")
    a, b = F.coalesce(old, none), F.coalesce(new, none)
    null = F.lit(None).cast("string")
    added = F.transform(F.sort_array(F.array_except(b, a)), lambda x: event(f"{field}_added", field, null, x))
    removed = F.transform(F.sort_array(F.array_except(a, b)), lambda x: event(f"{field}_removed", field, x, null))
    return F.concat(added, removed)


def outcome_changes(old: Column, new: Column) -> Column:
    """X2 over arrays of structs(measure, timeFrame): added, removed, and other time frames; the last of equal measures counts."""
    last = lambda xs: F.map_from_entries(F.transform(F.array_distinct(F.transform(xs, lambda x: x["measure"])), lambda m: F.struct(m.alias("k"), F.element_at(F.filter(xs, lambda x: x["measure"] == m), -1)["timeFrame"].alias("v"))))
    a, b = last(old), last(new)
    moved = F.filter(F.array_intersect(F.map_keys(a), F.map_keys(b)), lambda m: ~a[m].eqNullSafe(b[m]))
    return F.concat(member_changes("primary_outcome", F.map_keys(a), F.map_keys(b)), F.transform(moved, lambda m: event("primary_outcome_timeframe_changed", "primary_outcome", a[m], b[m], None, m)))


def diff_studies(pairs: DataFrame, key: str) -> DataFrame:
    """events of all pairs of study bodies, a row each; identical bodies give none."""
    p, c = F.col("prev.protocolSection"), F.col("curr.protocolSection")
    status, sponsor = "statusModule", "sponsorCollaboratorsModule"
    one = [
        scalar_change("status_changed", "overall_status", p[status]["overallStatus"], c[status]["overallStatus"]),
        array_change("phase_changed", "phases", p["designModule"]["phases"], c["designModule"]["phases"]),
        scalar_change("sponsor_changed", "lead_sponsor", p[sponsor]["leadSponsor"]["name"], c[sponsor]["leadSponsor"]["name"]),
        count_change("enrollment", p["designModule"]["enrollmentInfo"], c["designModule"]["enrollmentInfo"]),
        dated_change("primary_completion_date", p[status]["primaryCompletionDateStruct"], c[status]["primaryCompletionDateStruct"]),
        dated_change("completion_date", p[status]["completionDateStruct"], c[status]["completionDateStruct"]),
    ]
    arms = lambda s: F.transform(s["armsInterventionsModule"]["armGroups"], lambda a: a["label"])
    outcomes = lambda s: F.coalesce(s["outcomesModule"]["primaryOutcomes"], F.array().cast("array<struct<measure:string,timeFrame:string>>"))
    events = F.concat(F.array_compact(F.array(*one)), member_changes("arm", arms(p), arms(c)), outcome_changes(outcomes(p), outcomes(c)))
    return pairs.select(key, "from_version", "to_version", "event_date", F.explode(events).alias("e")).select(key, "from_version", "to_version", "event_date", "e.*")


def noise_floor(pairs: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """A2: for each event type the pairs in which it fires, its events and its share of all pairs; type null: pairs without any.

    One pass over pairs and events together: each pair gives a row for each of its types and
    one for itself. Without pairs there are no rows.
    """
    pair = [key, "from_version", "to_version"]
    both = pairs.select(*pair, F.lit(None).cast("string").alias("event_type"), F.lit(0).cast("long").alias("n")).unionByName(events.select(*pair, "event_type", F.lit(1).cast("long").alias("n")))
    fired = both.groupBy(*pair, "event_type").agg(F.sum("n").alias("n"))
    # as many types as there are, at most
    per = fired.groupBy(*pair).agg(F.collect_list(F.when(F.col("n") > 0, F.struct(F.lit(False).alias("whole"), "event_type", "n"))).alias("types"))
    # a pair's own row: its n says whether it has no event
    own = F.struct(F.lit(True).alias("whole"), F.lit(None).cast("string").alias("event_type"), (F.size("types") == 0).cast("long").alias("n"))
    counts = per.select(F.explode(F.concat("types", F.array(own))).alias("t")).groupBy("t.whole", "t.event_type").agg(F.count(F.lit(1)).alias("k"), F.sum("t.n").alias("n"))
    total = F.max(F.when(F.col("whole"), F.col("k"))).over(Window.partitionBy())  # over a row for each type
    with_, events_ = F.when(F.col("whole"), F.col("n")).otherwise(F.col("k")), F.when(F.col("whole"), F.lit(0)).otherwise(F.col("n"))
    return counts.select("event_type", with_.alias("pairs_with"), events_.cast("long").alias("events"), F.try_divide(with_, total).alias("share"))


def direction_mix(pairs: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """Pairs of each event type and direction, with the share of all pairs."""
    total = pairs.agg(F.count(F.lit(1)).alias("pairs"))
    counts = events.groupBy("event_type", "direction").agg(F.count_distinct(F.struct(key, "from_version", "to_version")).alias("n"))
    return counts.crossJoin(F.broadcast(total)).select("event_type", "direction", "n", F.try_divide("n", "pairs").alias("share"))


def boundary_violations(events: DataFrame, versions: DataFrame, key: str, version: str, date: str) -> DataFrame:
    """Q5: events whose date isn't the posted date of their later version."""
    posted = versions.select(F.col(key).alias("_k"), F.col(version).alias("_v"), F.col(date).alias("_d"))
    joined = events.join(posted, (F.col(key) == F.col("_k")) & (F.col("to_version") == F.col("_v")), "left")
    return joined.where(~F.col("event_date").eqNullSafe(F.col("_d"))).select(*events.columns)
