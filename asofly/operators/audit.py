"""Audit checks as DataFrames of one row each: provenance, universe, history, labels, features, model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofly.operators.differ import boundary_violations
from asofly.operators.entities import containment
from asofly.operators.labels import gate3_labels, latest_labels, self_consistency
from asofly.operators.programs import saturation, spike, stratum_progress
from asofly.operators.temporal import as_of_join, as_of_point, contiguity
from asofly.sources.snapshots import integrity

#: Least shares and counts at which a check is content.
MESH_COVERAGE, SPIKE_SHARE, UNBLINDED_SHARE, CONSISTENCY, LABELS_TO_JUDGE = 0.9, 0.15, 0.2, 0.8, 20


def verdict(one: DataFrame, stage: str, name: str, level: Column, expected: str | Column, actual: Column, detail: str | Column = "") -> DataFrame:
    """A check's row from an aggregate of one row."""
    text = lambda c: c.cast("string") if isinstance(c, Column) else F.lit(c)
    return one.select(F.lit(stage).alias("stage"), F.lit(name).alias("name"), level.alias("level"), text(expected).alias("expected"), text(actual).alias("actual"), text(detail).alias("detail"))


def none_bad(rows: DataFrame, stage: str, name: str, bad: Column, worse: str = "FAIL") -> DataFrame:
    """PASS if no row is bad, else ``worse``; the count of bad ones against all."""
    n = rows.agg(F.count_if(F.coalesce(bad, F.lit(False))).alias("bad"), F.count(F.lit(1)).alias("n"))
    return verdict(n, stage, name, F.when(F.col("bad") == 0, "PASS").otherwise(worse), "0", F.col("bad"), F.concat(F.lit("of "), F.col("n").cast("string")))


def union(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def provenance(envelopes: DataFrame, stored: DataFrame) -> DataFrame:
    """Q2: files and manifest agree both ways, and bodies with their digests; the as-of lookup gives each date its own snapshot."""
    problems = integrity(envelopes, stored)
    names = {"orphan_file": "every file is in the manifest", "missing_file": "every entry of the manifest has its file", "hash_mismatch": "every body has the digest it is listed with"}
    return union([*(none_bad(problems, "provenance", text, F.col("problem") == kind) for kind, text in names.items()), as_of_probe(stored)])


def as_of_probe(stored: DataFrame) -> DataFrame:
    """Q2: each snapshot date, and the day before the next one, must be answered by that date's snapshot.

    All dates of all records are probed at once: the probes are an as-of join's left side.
    """
    dates = stored.select(F.struct("source", "id").alias("key"), F.col("snapshot_date").alias("day")).distinct()
    per = dates.groupBy("key").agg(F.sort_array(F.collect_set("day")).alias("days")).where(F.size("days") > 1)
    at = F.explode(F.transform("days", lambda d, i: F.struct(d.alias("want"), F.date_sub(F.get("days", i + 1), 1).alias("eve"))))
    wanted = per.select("key", at.alias("p"))
    probes = wanted.select("key", F.col("p.want").alias("want"), F.col("p.want").alias("probe")).unionByName(wanted.where("p.eve >= p.want").select("key", "p.want", F.col("p.eve").alias("probe")))
    got = as_of_join(probes, dates.withColumn("found", F.col("day")), "key", "probe", "day", [], ["found"])
    return none_bad(got, "provenance", "a date is answered by the snapshot known then", ~F.col("found").eqNullSafe(F.col("want")))


def universe(candidates: DataFrame, known: DataFrame, seeds: DataFrame, trials: DataFrame, scored: DataFrame) -> DataFrame:
    """Q3: recall and independence of the known names, candidates without trials, shared trials, backlog, coverage, dead zone.

    candidates: candidate_id, proposed_name, synonyms, nct_ids, strategies, review_status; known: asset, name; seeds: name;
    trials: mesh_ids; scored: silence_score.
    """
    names = candidates.select(F.explode(F.concat(F.array("proposed_name"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("name")).where("name is not null")
    low = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    pairs = containment(known, "name", names, "name").select("a").distinct()
    hit = known.withColumn("a", low("name")).join(pairs.withColumn("_hit", F.lit(True)), "a", "left").groupBy("asset").agg(F.bool_or(F.coalesce("_hit", F.lit(False))).alias("found"))
    fresh = known.select(low("name").alias("n")).distinct().join(seeds.select(low("name").alias("n")).distinct(), "n", "left_anti").agg(F.count(F.lit(1)).alias("new"))
    claims = candidates.select("candidate_id", F.explode("nct_ids").alias("nct_id"), (~F.forall("strategies", lambda s: s == "sponsor_expansion")).alias("verified")).groupBy("nct_id")
    shared = claims.agg(F.count_distinct("candidate_id").alias("k"), F.bool_and("verified").alias("genuine")).where("k > 1")
    mesh = trials.agg(F.try_divide(F.count_if(F.size("mesh_ids") > 0), F.count(F.lit(1))).alias("rate"))
    worst = spike(scored, "silence_score")
    return union(
        [
            none_bad(hit, "universe", "known assets are found", ~F.col("found"), "WARN"),
            verdict(fresh, "universe", "known names are not only the seeds", F.when(F.col("new") > 0, "PASS").otherwise("WARN"), "names beyond the seeds", F.col("new")),
            none_bad(candidates, "universe", "candidates have trials", F.coalesce(F.size("nct_ids"), F.lit(0)) <= 0, "WARN"),
            none_bad(shared, "universe", "shared trials are claimed by verified candidates", ~F.col("genuine"), "WARN"),
            none_bad(candidates, "universe", "candidates are reviewed", F.col("review_status") == "unreviewed"),
            verdict(mesh, "universe", "trials have condition identifiers", F.when(F.col("rate") >= MESH_COVERAGE, "PASS").otherwise("WARN"), str(MESH_COVERAGE), F.round("rate", 4)),
            verdict(worst, "universe", "no score is a dead zone", F.when(F.col("share").isNull(), "INFO").when(F.col("share") > SPIKE_SHARE, "WARN").otherwise("PASS"), str(SPIKE_SHARE), F.round("share", 4), F.col("value")),
        ]
    )


#: Discovery strategies in the order in which they run, the last one's share that is still content, and the agreement that exclusions need.
STRATEGIES, LAST_SHARE, AGREEMENT = ("pattern_match", "seed_expansion", "sponsor_expansion"), 0.15, 0.95


def scope_agreement(sample: DataFrame, records: DataFrame) -> DataFrame:
    """Q3: of the held-out programs with a scope decision (gate 2 or 3): sampled, compared, agreements, rate.

    sample: program_id, predicted_in_scope, predicted_scope_reason. A "no" agrees only if its reason does too.
    """
    decided = latest_labels(records).where(F.col("gate_reached").isin(2, 3)).select("program_id", "in_scope", "scope_reason", F.lit(True).alias("_seen"))
    j = sample.join(decided, "program_id", "left").withColumn("_seen", F.coalesce("_seen", F.lit(False)))
    same = F.col("in_scope").eqNullSafe(F.col("predicted_in_scope"))
    reason = (F.col("predicted_in_scope") != "no") | F.col("predicted_in_scope").isNull() | F.col("scope_reason").eqNullSafe(F.col("predicted_scope_reason"))
    n = j.agg(F.count(F.lit(1)).alias("sampled"), F.count_if("_seen").alias("compared"), F.count_if(F.col("_seen") & same & reason).alias("agreements"))
    return n.withColumn("rate", F.try_divide("agreements", "compared"))


def discovery(candidates: DataFrame, programs: DataFrame, sample: DataFrame, records: DataFrame) -> DataFrame:
    """Q3: how much the last strategy still adds, assets that span both tumour kinds, and whether automatic exclusions agree with reviewers.

    candidates: candidate_id, strategies; programs: proposed_name, spans_heme_and_solid; sample and records as in ``scope_agreement``.
    """
    found = candidates.select("candidate_id", F.explode_outer("strategies").alias("strategy"))
    curve = saturation(found, "candidate_id", "strategy", list(STRATEGIES))
    line = F.concat(F.coalesce("strategy", F.lit("no recognised strategy")), F.lit(": "), F.col("n").cast("string"), F.lit(", "), F.col("cumulative").cast("string"))
    last = curve.agg(F.max(F.when(F.col("strategy") == STRATEGIES[-1], F.col("share"))).alias("share"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("step", line.alias("t")))), lambda x: x["t"]), " | ").alias("lines"))
    spans = programs.agg(F.count_if("spans_heme_and_solid").alias("k"), F.count(F.lit(1)).alias("n"))
    agreed = scope_agreement(sample, records)
    level = F.when(F.col("rate").isNull(), "INFO").when(F.col("rate") >= AGREEMENT, "PASS").otherwise("FAIL")
    return union(
        [
            verdict(last, "universe", "the last strategy adds little", F.when(F.col("share") > LAST_SHARE, "WARN").otherwise("INFO"), f"at most {LAST_SHARE}", F.round("share", 4), F.col("lines")),
            verdict(spans, "universe", "assets span haematological and solid tumours", F.lit("INFO"), "any", F.col("k"), F.concat(F.lit("of "), F.col("n").cast("string"))),
            verdict(agreed, "universe", "automatic exclusions agree with blind reviews", level, str(AGREEMENT), F.round("rate", 4), F.concat("agreements", F.lit(" of "), "compared", F.lit(" compared, "), "sampled", F.lit(" held out"))),
        ]
    )


def history(index: DataFrame, queue: DataFrame) -> DataFrame:
    """Q5: versions without gaps and dates that don't go back; no work pending and no errors.

    index: nct_id, version, posted_date; queue: nct_id, status.
    """
    runs = contiguity(index, "nct_id", "version", "posted_date")
    return union(
        [
            none_bad(runs, "history", "versions are numbered without gaps", ~F.col("contiguous")),
            none_bad(runs, "history", "dates never go back", ~F.col("monotone"), "WARN"),
            none_bad(queue, "backfill", "nothing is pending", F.col("status") == "pending", "WARN"),
            none_bad(queue, "backfill", "nothing failed", F.col("status") == "error", "WARN"),
        ]
    )


def changes(events: DataFrame, versions: DataFrame, unchanged: DataFrame, key: str = "nct_id", version: str = "version", date: str = "posted_date") -> DataFrame:
    """Q5: events carry the date of their later version, and a body against itself (``unchanged``: its events) gives none."""
    wrong = boundary_violations(events, versions, key, version, date).agg(F.count(F.lit(1)).alias("bad")).crossJoin(events.agg(F.count(F.lit(1)).alias("n")))
    control = unchanged.agg(F.count(F.lit(1)).alias("bad"))
    level = F.when(F.col("bad") == 0, "PASS").otherwise("FAIL")
    return union(
        [
            verdict(wrong, "differ", "events are dated by their later version", level, "0", F.col("bad"), F.concat(F.lit("of "), F.col("n").cast("string"))),
            verdict(control, "differ", "a body against itself changes nothing", level, "0", F.col("bad")),
        ]
    )


def gold_set(records: DataFrame, programs: DataFrame, fields: tuple[str, ...] = ("status",)) -> DataFrame:
    """Labels are human, dead ones whole, evidence was full, strata are covered, labels blind and consistent.

    Revisions and counts by gate are information, not tests.
    """
    labels = records.where("action = 'label'")
    dead = labels.where("status = 'dead_confirmed'")
    blank = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
    deep = labels.where("gate_reached = 3 and not coalesce(is_repeat_probe, false)")
    done = gate3_labels(records)
    strata = stratum_progress(programs, done).agg(F.count_if((F.col("labelled") == 0) & (F.col("population") > 0)).alias("empty"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("labelled"), F.lit(0)).alias("labelled"))
    blind = deep.agg(F.try_divide(F.count_if(~F.coalesce("blind", F.lit(False))), F.count(F.lit(1))).alias("share"))
    revised = deep.agg(F.try_divide(F.count_if(F.coalesce("status_revised", F.lit(False))), F.count(F.lit(1))).alias("share"))
    gates = labels.groupBy("gate_reached").agg(F.count(F.lit(1)).alias("n")).agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.col("gate_reached").cast("string"), F.lit("="), F.col("n").cast("string")))), ", ").alias("text"))
    same = self_consistency(records, list(fields))
    share = F.col("share")
    return union(
        [
            none_bad(records, "gold_set", "no record is automatic", F.col("labeller") == "auto"),
            none_bad(dead, "gold_set", "dead programs have a reason", blank("kill_reason")),
            none_bad(dead, "gold_set", "dead programs have an evidence date", blank("label_evidence_date")),
            none_bad(dead, "gold_set", "dead programs have a confirmation date or say that there is none", blank("public_confirmation_date") & ~F.coalesce("never_publicly_confirmed", F.lit(False))),
            none_bad(records.where("action in ('label', 'skip')"), "gold_set", "evidence was full when served", ~F.col("history_coverage_at_serve_time").eqNullSafe("full")),
            verdict(strata, "gold_set", "strata have labels", F.when(F.col("labelled") < LABELS_TO_JUDGE, "INFO").when(F.col("empty") > 0, "WARN").otherwise("PASS"), "0", F.col("empty"), F.concat(F.lit("of "), F.col("n").cast("string"))),
            verdict(blind, "gold_set", "labels are blind", F.when(share > UNBLINDED_SHARE, "WARN").otherwise("INFO"), f"at most {UNBLINDED_SHARE} unblinded", F.round("share", 4)),
            verdict(revised, "gold_set", "status revised after a search", F.lit("INFO"), "", F.round("share", 4)),
            verdict(gates, "gold_set", "labels by gate", F.lit("INFO"), "", F.col("text")),
            verdict(same, "gold_set", "repeats agree with the first label", F.when(F.col("n") == 0, "INFO").when(F.col("rate") < CONSISTENCY, "WARN").otherwise("PASS"), str(CONSISTENCY), F.round("rate", 4), F.concat(F.lit("of "), F.col("n").cast("string"))),
        ]
    )


def features(panel: DataFrame, register: dict[str, str], values: list[str], as_of: str = "as_of", known: str = "knowability_date") -> DataFrame:
    """Q7: every feature is in the register of knowability dates, none was known only later, and how many are missing."""
    missing = sorted(set(values) - set(register))
    one = panel.sparkSession.range(1)
    listed = verdict(one, "features", "features are registered", F.lit("FAIL" if missing else "PASS"), str(len(values)), F.lit(str(len(values) - len(missing))), ", ".join(missing))
    n = panel.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(f"_{c}") for c in values])
    rates = [verdict(n, "features", f"{c} is missing", F.lit("INFO"), "", F.round(F.try_divide(F.col(f"_{c}"), F.col("n")), 4)) for c in values]
    return union([listed, none_bad(panel, "features", "nothing is used before it was known", F.col(known) > F.col(as_of)), *rates])


def leakage_probe(versions: DataFrame, key: str = "nct_id", version: str = "version", date: str = "posted_date") -> DataFrame:
    """Each record, looked up on the date of its own first version, gives no later one. All records are probed."""
    first = versions.groupBy(key).agg(F.min(date).alias("_at"))
    got = as_of_point(versions.join(first, key), key, [date, version], date, F.col("_at"))
    top = versions.join(first, key).where(F.col(date) == F.col("_at")).groupBy(key).agg(F.max(version).alias("_want"))
    return none_bad(got.join(top, key), "features", "a record on its first date is its first version", F.col(version) != F.col("_want"))


def model_gate(results: DataFrame, body: str = "body") -> DataFrame:
    """Q8: the stored result of the back-test (a JSON body in one row): events it was fitted on, and whether the gate passed.

    No row: not run yet. A body that isn't a result fails.
    """
    schema = "gate_passed boolean, gate_reason string, min_precision double, training_event_counts map<string,long>"
    r = results.select(F.from_json(body, schema).alias("r")).agg(F.count(F.lit(1)).alias("n"), F.first("r").alias("r"))
    counts = F.array_join(F.transform(F.array(*[F.lit(k) for k in ("dead", "approved", "superseded")]), lambda k: F.concat(k, F.lit("="), F.coalesce(F.try_element_at("r.training_event_counts", k), F.lit(0)).cast("string"))), ", ")
    passed = F.col("r.gate_passed")
    level = F.when(F.col("n") == 0, "INFO").when(passed, "PASS").otherwise("FAIL")
    said = F.when(F.col("n") == 0, "not run").when(passed.isNull(), "no result to be read").when(passed, "passed").otherwise("not passed")
    return union(
        [
            verdict(r, "model", "training events", F.lit("INFO"), "", F.when(F.col("n") > 0, counts)),
            verdict(r, "model", "the model flags earlier than the heuristic at enough precision", level, F.concat(F.lit("precision of at least "), F.coalesce("r.min_precision", F.lit(0.5)).cast("string")), said, F.coalesce("r.gate_reason", F.lit(""))),
        ]
    )
