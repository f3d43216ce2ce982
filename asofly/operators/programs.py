"""Trial records, programs, panels and their smaller selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofly.functions import vocab as V
from asofly.functions.dates import DAYS_PER_YEAR, parse_partial_date
from asofly.functions.scoring import any_sponsor, asset_scope, band, program_score, trial_scope
from asofly.functions.text import evidence_source, mentions, stated_reason
from asofly.operators.labels import latest_labels
from asofly.operators.stats import cluster_bootstrap
from asofly.operators.temporal import as_of_month_panel, dense_ids


def summarize(studies: DataFrame, key: str = "nct_id", study: str = "study") -> DataFrame:
    """Flat trial record of a parsed study."""
    p = F.col(f"{study}.protocolSection")
    s, d = p["statusModule"], p["designModule"]
    return studies.select(
        key, s["overallStatus"].alias("status"), s["whyStopped"].alias("why_stopped"), parse_partial_date(s["startDateStruct"]["date"]).alias("start_date"),
        parse_partial_date(s["completionDateStruct"]["date"]).alias("completion"), parse_partial_date(s["primaryCompletionDateStruct"]["date"]).alias("primary_completion_date"),
        s["primaryCompletionDateStruct"]["type"].alias("primary_completion_type"), parse_partial_date(s["lastUpdatePostDateStruct"]["date"]).alias("last_update"), parse_partial_date(s["statusVerifiedDate"]).alias("verified"),
        d["phases"].alias("phases"), d["enrollmentInfo"]["count"].alias("enrollment"), d["enrollmentInfo"]["type"].alias("enrollment_type"),
        p["sponsorCollaboratorsModule"]["leadSponsor"]["name"].alias("lead_sponsor"), p["conditionsModule"]["conditions"].alias("conditions"), F.col(f"{study}.hasResults").alias("has_results"),
        F.size(p["contactsLocationsModule"]["locations"]).alias("sites"), F.array_distinct(F.transform(p["contactsLocationsModule"]["locations"], lambda x: x["country"])).alias("countries"),
        F.transform(F.col(f"{study}.derivedSection.conditionBrowseModule.meshes"), lambda m: m["id"]).alias("mesh_ids"),
    )


def best_snapshot(index: DataFrame, bodies: DataFrame, current: DataFrame, key: str = "nct_id") -> DataFrame:
    """The body of the highest indexed version if it was fetched, else the current-state body, else null."""
    top = index.groupBy(key).agg(F.max("version").alias("version"))
    j = top.join(bodies.select(key, "version", F.col("body").alias("_b")), [key, "version"], "left").join(current.select(key, F.col("body").alias("_c")), key, "full")
    return j.select(key, F.coalesce("_b", "_c").alias("body"), F.when(F.col("_b").isNotNull(), "versioned").when(F.col("_c").isNotNull(), "current_state").alias("origin"))


def in_date_scope(start: Column, floor: str = V.SCOPE_FLOOR) -> Column:
    """No start date, or one on or after the floor."""
    return start.isNull() | (start >= F.lit(floor).cast("date"))


def interventions(studies: DataFrame, key: str = "nct_id", study: str = "study") -> DataFrame:
    """P5: a row for each drug or biological intervention."""
    rows = studies.select(key, F.explode(F.col(f"{study}.protocolSection.armsInterventionsModule.interventions")).alias("i"))
    return rows.where(F.col("i.type").isin(*V.INTERVENTION_TYPES)).select(key, F.col("i.name").alias("intervention_name"), F.col("i.otherNames").alias("other_names"), F.col("i.type").alias("intervention_type"))


def by_text_evidence(rows: DataFrame, snippets: str) -> tuple[DataFrame, DataFrame]:
    """P10: rows with any non-blank snippet, and those without."""
    has = F.coalesce(F.exists(snippets, lambda s: F.trim(s) != ""), F.lit(False))
    return rows.where(has), rows.where(~has)


def decided_later(rows: DataFrame) -> DataFrame:
    """Answers of layers 2 and 3 that decide; a layer-1 row among them would be an error upstream."""
    return rows.where("layer in (2, 3) and is_adc in ('yes', 'no') and not coalesce(manual_overflow, false)")


def last_stated_reason(trials: Column) -> Column:
    """Text of the stop reason of the terminal trial updated last."""
    stopped = F.filter(trials, lambda t: t["status"].isin(*V.TERMINAL_STOP) & t["why_stopped"].isNotNull())
    return F.array_max(F.transform(stopped, lambda t: F.struct(t["last_update"].alias("d"), t["why_stopped"].alias("r"))))["r"]


def assert_registered(df: DataFrame, registry: set[str]) -> DataFrame:
    """Every column of a panel must be in the register of knowability dates."""
    if unknown := set(df.columns) - registry:
        raise ValueError(f"columns without a knowability date: {sorted(unknown)}")
    return df


def lead_sponsor(sponsors: Column) -> Column:
    """The sponsor seen last (a date before none); UNKNOWN without any."""
    best = F.array_max(F.transform(sponsors, lambda s, i: F.struct(F.coalesce(s["last_seen"].cast("string"), F.lit("")).alias("d"), (-i).alias("i"), s["sponsor"].alias("s"))))
    return F.coalesce(best["s"], F.lit("UNKNOWN"))


def with_sponsor(rows: DataFrame, programs: DataFrame) -> DataFrame:
    """Labels with their program's lead sponsor, UNKNOWN where there is none."""
    return rows.join(programs.select("program_id", lead_sponsor(F.col("sponsors_over_time")).alias("sponsor")), "program_id", "left").na.fill("UNKNOWN", ["sponsor"])


def timeline(events: DataFrame, key: str) -> DataFrame:
    """A program's dated events in order, undated ones first."""
    return events.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.coalesce(F.col("date").cast("string"), F.lit("")).alias("date"), "kind", "detail"))).alias("timeline"))


def interval_widths(rows: DataFrame, order: list[str], cluster: str, value: str, sizes: list[int]) -> list[tuple[int, float | None]]:
    """Width of the bootstrap interval over growing prefixes of the labels; a row for each size on the driver.

    Rows are numbered once, each counts for the prefixes that reach it, and all prefixes
    are drawn in one job.
    """
    placed = dense_ids(rows, order, "_at").withColumn("_size", F.explode(F.filter(F.array(*[F.lit(n) for n in sizes]), lambda n: n > F.col("_at"))))
    ci = cluster_bootstrap(placed, cluster, F.col(value).cast("double"), F.lit(1.0), resamples=500, by=["_size"])
    width = {r._size: None if r.low is None else r.high - r.low for r in ci.collect()}
    return [(n, width.get(n)) for n in sizes]


def stratum_progress(programs: DataFrame, labelled: DataFrame) -> DataFrame:
    """Programs and labelled ones in each stratum of band and archetype, those without a band left out."""
    done = labelled.select("program_id").distinct().withColumn("_l", F.lit(1))
    return programs.where("band is not null").join(done, "program_id", "left").groupBy("band", "primary_archetype").agg(F.count(F.lit(1)).alias("population"), F.count("_l").alias("labelled"))


def scope_counts(trials: DataFrame, program: str) -> DataFrame:
    """Trials by scope, with how many have identifiers, and assets by their roll-up."""
    t = trials.withColumn("scope", trial_scope(F.col("mesh_ids")))
    per_trial = t.groupBy(F.lit("trial").alias("level"), "scope").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("mesh_ids") > 0).alias("with_mesh"))
    assets = t.groupBy(program).agg(asset_scope(F.collect_list("scope")).alias("scope"), F.max(F.size("mesh_ids")).alias("_m"))
    return per_trial.unionByName(assets.groupBy(F.lit("asset").alias("level"), "scope").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_m") > 0).alias("with_mesh")))


def triage_summary(results: DataFrame) -> DataFrame:
    """Outcomes by rule."""
    return results.groupBy("is_adc", "in_scope", "committable", F.regexp_extract("rule", "^[a-z_]+", 0).alias("rule")).agg(F.count(F.lit(1)).alias("n"))


def spike(rows: DataFrame, value: str) -> DataFrame:
    """The most frequent value and its share: a dead zone of a score shows as one."""
    n = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.max_by(value, F.struct("n", F.col(value))).alias("value"), F.try_divide(F.max("n"), F.sum("n")).alias("share"))


def distinct_tuples(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct tuples, those with a null included."""
    return rows.agg(F.count_distinct(F.struct(*columns)).alias("n"))


def ranked_cells(cells: DataFrame, least: int, show: int) -> DataFrame:
    """Cells with enough programs, most dead first; a top-k report."""
    return cells.where(F.col("n_live") + F.col("n_dead") >= least).orderBy(F.desc("n_dead"), F.asc("n_live")).limit(show)


def open_ids(programs: DataFrame, records: DataFrame, exclude: DataFrame, key: str = "program_id") -> DataFrame:
    """Programs neither labelled nor excluded, by key: the pool that queues are drawn from."""
    return programs.join(latest_labels(records).select(key), key, "left_anti").join(exclude.select(key), key, "left_anti").orderBy(key)


def without_type(programs: DataFrame, versions: DataFrame, bad: str, key: str = "nct_id", field: str = "study_type") -> DataFrame:
    """Rows none of whose indexed versions is of the type ``bad`` (expanded access): one anti join, null keys stay."""
    return programs.join(versions.where(F.col(field) == bad).select(key), key, "left_anti")


def outstanding(universe: DataFrame, *done: DataFrame, key: str = "nct_id") -> DataFrame:
    """Keys of the universe that none of the other tables (indexed, failed, tracked) has."""
    left = universe.select(key).distinct()
    for d in done:
        left = left.join(d.select(key), key, "left_anti")
    return left


def signal_stats(versions: DataFrame, key: str, modules: str, signals: list[str]) -> DataFrame:
    """A1: versions, records, versions with a signal module, and their share (0.0 of none), in one pass."""
    signal = F.count_if(F.arrays_overlap(modules, F.array(*[F.lit(x) for x in signals])))
    return versions.agg(F.count(F.lit(1)).alias("versions"), F.count_distinct(key).alias("records"), signal.alias("signal"), F.coalesce(F.try_divide(signal, F.count(F.lit(1))), F.lit(0.0)).alias("ratio"))


def child_stats(parents: DataFrame, children: DataFrame, key: str, child: str) -> DataFrame:
    """Children of each parent: sum, mean, median, most, parents without any, and distinct children overall."""
    counts = children.groupBy(key).agg(F.count(child).alias("n"))
    n = parents.select(key).distinct().join(counts, key, "left").na.fill(0, ["n"])
    per = n.agg(F.sum("n").alias("total"), F.avg("n").alias("mean"), F.median("n").alias("median"), F.max("n").alias("most"), F.count_if(F.col("n") == 0).alias("without"))
    return per.crossJoin(children.agg(F.count_distinct(child).alias("distinct_children")))


def saturation(found: DataFrame, key: str, strategy: str, order: list[str]) -> DataFrame:
    """For each strategy in order the members that it is the first to find, their share, and how many are found so far.

    Strategies outside ``order`` credit nobody; members that only such have found are the row of step 0.
    """
    steps = F.array(*[F.lit(x) for x in order])
    first = found.groupBy(key).agg(F.coalesce(F.min(F.nullif(F.array_position(steps, F.col(strategy)), F.lit(0).cast("long"))), F.lit(0).cast("long")).alias("step"))
    counts = first.groupBy("step").agg(F.count(F.lit(1)).alias("n"))
    known = found.sparkSession.createDataFrame([(i + 1, x) for i, x in enumerate(order)], "step long, strategy string")
    # one row for each strategy: a handful
    rows = known.join(counts, "step", "left").select("step", "strategy", F.coalesce("n", F.lit(0)).alias("n")).unionByName(counts.where("step = 0").select("step", F.lit(None).cast("string").alias("strategy"), "n"))
    upto = F.sum(F.when(F.col("step") > 0, F.col("n"))).over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(F.when(F.col("step") > 0, F.col("n"))).over(Window.partitionBy())
    return rows.select("step", "strategy", "n", F.when(F.col("step") > 0, F.coalesce(F.try_divide("n", total), F.lit(0.0))).alias("share"), F.coalesce(upto, F.lit(0)).alias("cumulative"))


def unknown_values(rows: DataFrame, values: str, known: list[str]) -> DataFrame:
    """Values of an array column outside a vocabulary."""
    return rows.select(F.explode(values).alias("value")).distinct().where(~F.col("value").isin(*known))


def union_strategies(parts: dict[str, DataFrame]) -> DataFrame:
    """Mentions of all discovery strategies, each marked with its own."""
    first, *rest = [df.withColumn("strategy", F.lit(name)) for name, df in parts.items()]
    for df in rest:
        first = first.unionByName(df, allowMissingColumns=True)
    return first


def recovery(known: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """Known names, and how many of them were not found."""
    n = lambda c: F.lower(F.trim(c))
    missing = known.join(found.select(n(name).alias("_n")).distinct(), n(name) == F.col("_n"), "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    return known.agg(F.count(F.lit(1)).alias("known")).crossJoin(missing)


def needs_scope_backfill(records: DataFrame) -> DataFrame:
    """Latest labels that say no molecule but carry no scope, with the values that a corrective record gets."""
    old = latest_labels(records).where("is_adc = 'no' and (in_scope is null or scope_reason is null)")
    return old.withColumns({"in_scope": F.lit("no"), "scope_reason": F.lit("not_an_adc")})


def panels_after(panel: DataFrame, outcome: DataFrame, cutoff: Column, end: Column) -> DataFrame:
    """M5: panel rows from the cut to the earlier of event and end."""
    return panel.where(F.col("as_of") >= cutoff).join(outcome, "program_id").where(F.col("as_of") <= F.least("event_month", end))


def status_base_rate(trials: DataFrame, by: str, status: str = "UNKNOWN") -> DataFrame:
    """Share of a status in each group."""
    return trials.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == status).alias("k")).withColumn("rate", F.try_divide("k", "n"))


def feature_panel(versions: DataFrame, members: DataFrame, end: Column, program: str = "program_id", trial: str = "nct_id") -> DataFrame:
    """(program, month) with score, band and amendment cadence as known on the month's first day.

    versions: trial, version, posted_date, changed_modules, and the fields of ``program_score``'s trial struct.
    A month before the first version has no score; cadence counts site changes so far over the years since
    the earliest history, of a day at least.
    """
    site = F.array_contains("changed_modules", "Contacts/Locations").cast("int")
    seen = Window.partitionBy(trial).orderBy("posted_date", "version").rowsBetween(Window.unboundedPreceding, 0)
    v = versions.withColumn("_amend", F.sum(F.coalesce(site, F.lit(0))).over(seen)).withColumn("_since", F.min("posted_date").over(Window.partitionBy(trial)))
    p = as_of_month_panel(v, trial, "posted_date", ["version"], end).join(members.select(program, trial).distinct(), trial)
    state = F.struct("status", "why_stopped", F.col("posted_date").alias("last_update"), "verified", "completion", "has_results", "enrollment_type", F.array().cast("array<date>").alias("amended"))
    rows = p.groupBy(program, "as_of").agg(F.collect_list(F.when(F.col("version").isNotNull(), state)).alias("_t"), F.sum("_amend").alias("_n"), F.min("_since").alias("_first"))
    score = program_score(F.col("_t"), F.col("as_of"))
    years = F.greatest(F.datediff("as_of", "_first") / F.lit(DAYS_PER_YEAR), F.lit(1 / DAYS_PER_YEAR))
    return rows.select(program, "as_of", score.alias("silence_score_asof"), band(score).alias("band_asof"), F.coalesce(F.col("_n") / years, F.lit(0.0)).alias("contacts_locations_amendment_cadence_asof"))


def evidence_bundle(trials: DataFrame, program: str, names: str, k: int = 3, snippets: int = 5) -> DataFrame:
    """Of the first ``k`` trials at most ``snippets`` texts that name the candidate, in order."""
    w = Window.partitionBy(program).orderBy("nct_id")
    rows = trials.withColumn("_rn", F.row_number().over(w)).where(f"_rn <= {k}").select(program, names, "_rn", F.posexplode("snippets").alias("_p", "text"))
    own = rows.where(mentions("text", F.col(names))).withColumn("_k", F.row_number().over(Window.partitionBy(program).orderBy("_rn", "_p"))).where(f"_k <= {snippets}")
    return own.groupBy(program).agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", "text"))), lambda x: x["text"]).alias("evidence"))


def extension_cohort(candidates: DataFrame, existing: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Candidates not known yet with the reasons that keep them out; an empty list is in."""
    _, industry, _ = any_sponsor(F.col("sponsors_over_time"))
    reasons = F.array_compact(F.array(F.when(~industry, F.lit("not_all_industry")), F.when(~in_date_scope(F.col("first_start"), V.EXTENSION_FLOOR), F.lit("too_early")), F.when(F.col("ambiguous"), F.lit("ambiguous"))))
    return candidates.join(existing.select(key), key, "left_anti").withColumn("excluded_for", reasons)


def evidenced_trials(candidates: DataFrame, labelled: DataFrame) -> DataFrame:
    """Trials of labelled or evidenced candidates."""
    return candidates.select(F.explode("nct_ids").alias("nct_id")).union(labelled.select(F.explode("nct_ids").alias("nct_id"))).distinct()


def only_country(countries: Column, country: str) -> Column:
    """All sites are in one country, and there are any."""
    return (F.size(countries) > 0) & F.forall(countries, lambda c: c == country)


def auto_scope(asset: Column) -> Column:
    """Scope that may be filled in beforehand: out for heme-only assets, else none."""
    return F.when(asset == "heme_only", F.struct(F.lit("no").alias("in_scope"), F.lit("heme_only").alias("scope_reason")))


def feasibility(decisions: DataFrame, need: int) -> DataFrame:
    """Decisions of each stratum of answer and evidence source, and whether they are enough for a sample."""
    s = decisions.withColumn("source", evidence_source(F.col("from_recall"), F.col("quote")))
    return s.groupBy("is_adc", "source").agg(F.count(F.lit(1)).alias("n")).withColumn("enough", F.col("n") >= need)


def commit_candidates(results: DataFrame, records: DataFrame, holdout: DataFrame) -> DataFrame:
    """Committable results of programs without a label and outside the holdout; the rest are the residue."""
    free = results.join(latest_labels(records).select("program_id"), "program_id", "left_anti")
    return free.where("committable").join(holdout.select("program_id"), "program_id", "left_anti")


def discovery_flags(candidates: DataFrame) -> DataFrame:
    """Counts of single-strategy, ambiguous and code-only candidates."""
    return candidates.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("strategies") == 1).alias("single_strategy"), F.count_if("ambiguous").alias("ambiguous"), F.count_if("dev_code_only").alias("dev_code_only"))


def accuracy_against_ceiling(accuracy: Column, ceiling: Column) -> Column:
    """Accuracy as a share of self-consistency; null where either is."""
    return F.try_divide(accuracy, ceiling)


def reasons_of(programs: DataFrame) -> DataFrame:
    """Class of each program's latest stated reason."""
    return programs.select("program_id", stated_reason(last_stated_reason(F.col("trials"))).alias("stated"))
