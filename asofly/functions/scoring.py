"""Silence scores, bands, archetypes, coverage, cost and scope."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from asofly.functions import vocab as V
from asofly.functions.dates import elapsed_months
from asofly.functions.text import contains_any, first_matching, is_vague


def staleness(status: Column, reason: Column, last_update: Column, as_of: Column) -> Column:
    """1 - e^(-days/365); 0.5 without a date; three tenths of it for a stop with a stated reason."""
    days = F.greatest(F.datediff(as_of, last_update), F.lit(0))
    raw = 1 - F.exp(-days / F.lit(V.STALENESS_TAU_DAYS))
    explained = F.coalesce(status.isin(*V.TERMINAL_STOP), F.lit(False)) & ~is_vague(reason)
    return F.when(last_update.isNull(), F.lit(V.MISSING_DATE_STALENESS)).when(explained, raw * V.EXPLAINED_STOP_DISCOUNT).otherwise(raw)


def verification_lapse(status: Column, verified: Column, as_of: Column) -> Column:
    """days since verification over a year, within [0, 1], for records that claim to be active."""
    share = F.datediff(as_of, verified) / F.lit(float(V.LAPSE_CAP_DAYS))
    active = F.coalesce(status.isin(*V.ACTIVE_LIKE), F.lit(False)) & verified.isNotNull()
    return F.when(active, F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))


def status_ambiguity(status: Column, reason: Column, has_results: Column, completion: Column, as_of: Column) -> Column:
    """1 unknown, 0.8 stopped without a reason, 0.4 with a vague one or long completed without results."""
    stopped = status.isin(*V.TERMINAL_STOP)
    overdue = (status == "COMPLETED") & ~F.coalesce(has_results, F.lit(False)) & (F.datediff(as_of, completion) > V.COMPLETED_STALE_DAYS)
    none = reason.isNull() | (reason == "")
    return F.when(status == "UNKNOWN", F.lit(1.0)).when(stopped & none, F.lit(0.8)).when(stopped & is_vague(reason), F.lit(0.4)).when(overdue, F.lit(0.4)).otherwise(F.lit(0.0))


def enrollment_signal(status: Column, enrollment_type: Column) -> Column:
    """a stopped (1) or completed (1/3) record whose enrolment was never made actual."""
    estimated = enrollment_type == "ESTIMATED"
    return F.when(status.isin(*V.TERMINAL_STOP) & estimated, F.lit(1.0)).when((status == "COMPLETED") & estimated, F.lit(1 / 3)).otherwise(F.lit(0.0))


def silence_score(stale: Column, lapse: Column, ambiguity: Column, enrollment: Column) -> Column:
    """each weighted part rounded half-even to a tenth, in this order; their sum rounded, 100 at most."""
    parts = [F.bround(c * w, 1) for c, w in ((stale, V.STALENESS_WEIGHT), (lapse, V.LAPSE_WEIGHT), (ambiguity, V.AMBIGUITY_WEIGHT), (enrollment, V.ENROLLMENT_WEIGHT))]
    return F.bround(F.least(F.lit(100.0), reduce(lambda a, b: a + b, parts)), 0).cast("int")


def band(score: Column) -> Column:
    """five bands of twenty points, the last one closed; null without a score."""
    return F.least(F.floor(score / V.BAND_WIDTH), F.lit(V.BANDS - 1)).cast("int")


def program_score(trials: Column, as_of: Column) -> Column:
    """F11 over an array of trial structs (status, why_stopped, last_update, verified, completion, has_results, enrollment_type).

    Staleness and lapse are those of the trial updated last (the first of ties; no date
    is the lowest), ambiguity and enrolment the greatest over all. Null without trials.
    """
    order = F.transform(trials, lambda t, i: F.struct(F.coalesce(t["last_update"], F.lit("0001-01-01").cast("date")).alias("d"), (-i).alias("i"), t.alias("t")))
    latest = F.array_max(F.transform(order, lambda o: F.struct(o["d"].alias("d"), o["i"].alias("i"))))
    last = F.get(trials, -latest["i"])
    ambiguity = F.array_max(F.transform(trials, lambda t: status_ambiguity(t["status"], t["why_stopped"], t["has_results"], t["completion"], as_of)))
    enrolled = F.array_max(F.transform(trials, lambda t: enrollment_signal(t["status"], t["enrollment_type"])))
    score = silence_score(
        staleness(last["status"], last["why_stopped"], last["last_update"], as_of), verification_lapse(last["status"], last["verified"], as_of), ambiguity, enrolled
    )
    return F.when(F.size(trials) > 0, score)


def archetypes(trials: Column, as_of: Column) -> Column:
    """Sorted tags of a program's trials (status, why_stopped, has_results, amended array<date>)."""
    stopped = lambda t: F.coalesce(t["status"].isin(*V.TERMINAL_STOP), F.lit(False))
    recent = lambda t: F.size(F.array_distinct(F.filter(t["amended"], lambda d: F.datediff(as_of, d) <= V.AMENDED_WINDOW_DAYS))) >= 2
    tests = {
        "unknown_status": lambda t: t["status"] == "UNKNOWN",
        "registry_terminated_vague_reason": lambda t: stopped(t) & is_vague(t["why_stopped"]),
        "registry_terminated_stated_reason": lambda t: stopped(t) & ~is_vague(t["why_stopped"]),
        "completed_no_results": lambda t: (t["status"] == "COMPLETED") & ~F.coalesce(t["has_results"], F.lit(False)),
        "actively_amended": recent,
    }
    tags = F.array_compact(F.array(*[F.when(F.exists(trials, test), F.lit(tag)) for tag, test in tests.items()]))
    return F.when(F.size(tags) > 0, F.sort_array(tags)).otherwise(F.array(F.lit("other")))


def primary_archetype(tags: Column) -> Column:
    """the first tag in the fixed order."""
    return first_matching([(F.array_contains(tags, a), F.lit(a)) for a in V.ARCHETYPES], F.lit("other"))


def trial_coverage(indexed: Column, errored: Column, signal_versions: Column, fetched_signal: Column) -> Column:
    """none if never indexed, partial after a failed refresh or with a signal version not fetched, else full."""
    return F.when(~indexed, "none").when(errored | (fetched_signal < signal_versions), "partial").otherwise("full")


def program_coverage(coverages: Column) -> Column:
    """full if all are, none if none is anything, else partial."""
    return F.when((F.size(coverages) == 0) | F.forall(coverages, lambda c: c == "none"), "none").when(F.forall(coverages, lambda c: c == "full"), "full").otherwise("partial")


def highest_phase(phases: Column) -> Column:
    """the most advanced of the listed phases."""
    return F.array_max(F.filter(F.coalesce(phases, F.array().cast("array<string>")), lambda p: p.isin(*V.PHASE_WEIGHTS)))


def trial_cost(phase: Column, enrollment: Column, start: Column, as_of: Column) -> Column:
    """F16: phase weight times enrolment times months since the start; zero where any is missing."""
    weight = first_matching([(phase == p, F.lit(w)) for p, w in V.PHASE_WEIGHTS.items()], F.lit(0.0))
    return weight * F.coalesce(enrollment, F.lit(0)) * elapsed_months(start, as_of)


def site_factor(sites: Column) -> Column:
    """F16: square root of the number of sites; one where it isn't known."""
    return F.when(sites > 0, F.pow(sites.cast("double"), F.lit(V.SITE_EXPONENT))).otherwise(F.lit(1.0))


def amendment_cadence(n: Column, first: Column, as_of: Column) -> Column:
    """amendments a year since the first one; zero without any before the date."""
    days = F.datediff(as_of, first)
    return F.when((n > 0) & (days > 0), n / (days / F.lit(365.25))).otherwise(F.lit(0.0))


def condition_category(mesh_id: Column) -> Column:
    """F8: heme, solid, generic_basket; null for an identifier that isn't listed."""
    solid = [i for ids in V.SYSTEM_IDS.values() for i in ids] + list(V.SITELESS_SOLID_IDS)
    return F.when(mesh_id.isin(*V.HEME_IDS), "heme").when(mesh_id.isin(*solid), "solid").when(mesh_id.isin(*V.BASKET_IDS), "generic_basket")


def condition_system(mesh_id: Column) -> Column:
    """F8: body system of a listed solid condition, else null."""
    return first_matching([(mesh_id.isin(*ids), F.lit(s)) for s, ids in V.SYSTEM_IDS.items()])


def trial_scope(mesh_ids: Column) -> Column:
    """F8: a trial's scope from its condition identifiers: unlisted ones leave it unresolved, both kinds are mixed."""
    kinds = F.array_distinct(F.transform(mesh_ids, condition_category))
    heme, solid = F.array_contains(kinds, "heme"), F.array_contains(kinds, "solid")
    unknown = F.exists(mesh_ids, lambda m: condition_category(m).isNull())
    return F.when(F.coalesce(F.size(mesh_ids), F.lit(0)) <= 0, "no_data").when(heme & solid, "mixed").when(solid, "solid").when(unknown, "unresolved").when(heme, "heme").otherwise("generic_basket")


def asset_scope(trial_scopes: Column) -> Column:
    """F8: heme_only where every trial is heme, else needs_review."""
    return F.when((F.size(trial_scopes) > 0) & F.forall(trial_scopes, lambda s: s == "heme"), "heme_only").otherwise("needs_review")


def text_system(condition: Column) -> Column:
    """System of a condition text by its first keyword group."""
    low = F.lower(condition)
    return first_matching([(contains_any(low, words), F.lit(s)) for s, words in V.SYSTEM_KEYWORDS.items()])


def any_sponsor(sponsors: Column, industry: str = "INDUSTRY") -> tuple[Column, Column, Column]:
    """(any is not industry, all are industry, none is industry) over an array of sponsor structs; empty is false for the last two."""
    is_industry = lambda s: F.upper(F.coalesce(s["class"], F.lit(""))) == industry
    some = F.size(sponsors) > 0
    return F.exists(sponsors, lambda s: ~is_industry(s)), some & F.forall(sponsors, is_industry), some & F.forall(sponsors, lambda s: ~is_industry(s))
