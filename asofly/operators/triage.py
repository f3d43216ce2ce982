"""Deterministic triage, serving, queues, matrices and audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofly.functions import vocab as V
from asofly.functions.scoring import any_sponsor, asset_scope
from asofly.functions.text import contains_any, is_denylisted, suffixes_in


def _first(names: Column, test) -> Column:
    return F.get(F.filter(names, test), F.lit(0))


def molecule_rule(names: Column, proposed: Column, known: Column) -> Column:
    """struct(is_adc, rule) by known list, suffix, denylist, other conjugates, class labels, in this order.

    ``known`` is an array of lower-case names (a small curated list).
    """
    hit = _first(names, lambda n: F.array_contains(known, F.lower(F.trim(n))))
    suffix = F.get(F.flatten(F.transform(names, suffixes_in)), F.lit(0))
    other = _first(names, lambda n: F.lower(F.trim(n)).isin(*V.NON_ANTIBODY_CODES) | contains_any(F.lower(n), V.NON_ANTIBODY_PHRASES))
    made = lambda yes, rule: F.struct(F.lit(yes).alias("is_adc"), (rule if isinstance(rule, Column) else F.lit(rule)).alias("rule"))
    none = F.struct(F.lit(None).cast("string").alias("is_adc"), F.lit(None).cast("string").alias("rule"))
    return (
        F.when(hit.isNotNull(), made("yes", F.concat(F.lit("known_list:"), hit)))
        .when(suffix.isNotNull(), made("yes", F.concat(F.lit("inn_suffix:"), suffix)))
        .when(F.exists(names, lambda n: is_denylisted(n)), made("no", "denylist"))
        .when(other.isNotNull(), made("no", "non_antibody_conjugate"))
        .when(F.exists(names, lambda n: n.rlike(V.CLASS_LABEL)), made("yes", "generic_class_label"))
        .when(F.trim(proposed).rlike(V.NON_CLASS_LABEL), made("no", "generic_class_label"))
        .otherwise(none)
    )


def triage(programs: DataFrame, known: Column) -> DataFrame:
    """is_adc, in_scope, scope_reason, rule, committable of each program; all null where nothing resolves.

    programs: program_id, proposed_name, synonyms, sponsors_over_time, scopes array<string>, start_dates array<date>.
    """
    names = F.filter(F.concat(F.array(F.coalesce("proposed_name", F.lit(""))), F.coalesce("synonyms", F.array().cast("array<string>"))), lambda n: n.isNotNull())
    p = programs.withColumn("_m", molecule_rule(names, F.coalesce("proposed_name", F.lit("")), known))
    _, industry, outside = any_sponsor(F.col("sponsors_over_time"))
    heme = asset_scope(F.col("scopes")) == "heme_only"
    solid = (F.size("scopes") > 0) & F.forall("scopes", lambda s: s == "solid")
    recent = F.coalesce(F.array_min("start_dates") >= F.lit(V.SCOPE_FLOOR).cast("date"), F.lit(False))
    reject = F.when(outside, "non_industry").when(heme, "heme_only")
    positive = industry & solid & recent
    adc = F.col("_m.is_adc")
    in_scope = F.when(adc == "no", None).when(reject.isNotNull(), "no").when(positive | (adc == "yes"), "yes")
    tail = F.when(adc == "no", None).when(reject.isNotNull(), F.concat(F.lit("scope:"), reject)).when(positive, F.lit("positive_in_scope")).when(adc == "yes", F.lit("elimination"))
    return p.select(
        "program_id", adc.alias("is_adc"), in_scope.alias("in_scope"), F.when((in_scope == "no"), reject).alias("scope_reason"), F.nullif(F.concat_ws("+", F.col("_m.rule"), tail), F.lit("")).alias("rule"),
        ((F.coalesce(adc, F.lit("")) == "no") | F.coalesce(in_scope == "no", F.lit(False))).alias("committable"),
    )


def serve_plan(rows: DataFrame) -> DataFrame:
    """skip and start_gate of each row of triage results with the flags reopened, holdout, heme_auto_ok, model_gate_ok and a staged answer."""
    c = F.col
    staged = c("model_gate_ok") & c("staged_is_adc").isNotNull() & ~F.coalesce("staged_overflow", F.lit(False))
    plan = lambda gate, skip=False: F.struct(F.lit(gate).alias("start_gate"), F.lit(skip).alias("skip"))
    resolved = c("is_adc").isNotNull() | c("in_scope").isNotNull()
    cases = (
        F.when(c("reopened") | c("holdout"), plan(1))
        .when(staged & ((c("staged_is_adc") == "no") | (c("staged_in_scope") == "no")), plan(1, True))
        .when(staged & (c("staged_is_adc") == "yes") & (c("staged_in_scope") == "yes"), plan(3))
        .when(staged & (c("staged_is_adc") == "yes"), plan(2))
        .when(~resolved, plan(1))
        .when(c("committable") & (c("scope_reason") == "heme_only") & ~c("heme_auto_ok"), F.when(c("is_adc") == "yes", plan(2)).otherwise(plan(1)))
        .when(c("committable"), plan(1, True))
        .when((c("is_adc") == "yes") & F.contains("rule", F.lit("positive_in_scope")), plan(3))
        .when(c("is_adc") == "yes", plan(2))
        .otherwise(plan(1))
    )
    return rows.withColumn("_p", cases).select(*rows.columns, "_p.*")


def live_or_dead(programs: DataFrame, labels: DataFrame, dead=("dead_confirmed", "dormant_suspected"), live=("active", "approved", "superseded"), band: int = 4) -> DataFrame:
    """programs that gold holds in scope, as dead by gold, live by gold, dead by the silence proxy or assumed live.

    The proxy needs full history coverage and a band; without gold a program is left out.
    """
    g = labels.where("is_adc = 'yes' and in_scope = 'yes'").select("program_id", "status", "kill_reason")
    j = programs.join(g, "program_id")
    proxy = (F.col("history_coverage") == "full") & (F.col("band") >= band)
    basis = F.when(F.col("status").isin(*dead, *live), "gold").when(proxy, "silence_proxy").otherwise("assumed_live")
    is_dead = F.when(F.col("status").isin(*dead), True).when(F.col("status").isin(*live), False).otherwise(F.coalesce(proxy, F.lit(False)))
    return j.withColumn("basis", basis).withColumn("is_dead", is_dead)


def matrix(rows: DataFrame, axes: list[str], least: int = 5) -> DataFrame:
    """Live and dead counts of each cell and its quadrant; rows without an axis value are left out."""
    cells = rows.where(" and ".join(f"{a} is not null" for a in axes)).groupBy(*axes).agg(F.count_if(~F.col("is_dead")).alias("n_live"), F.count_if("is_dead").alias("n_dead"))
    return cells.withColumn("quadrant", quadrant(F.col("n_live"), F.col("n_dead"), least))


def quadrant(n_live: Column, n_dead: Column, least: int = 5) -> Column:
    """the reading of a cell by its counts."""
    total = n_live + n_dead
    return F.when(total == 0, "untested_white_space").when(total < least, "insufficient_evidence").when((n_live >= least) & (n_dead == 0), "red_ocean").when((n_dead >= least) & (n_live < least), "graveyard").otherwise("contested_and_hard")


def fold_historical(cells: DataFrame, historical: DataFrame, axes: list[str]) -> DataFrame:
    """Counts of an extension cohort beside the cells, which keep theirs."""
    h = historical.groupBy(*axes).agg(F.count(F.lit(1)).alias("n_dead_historical"))
    return cells.join(h, axes, "full").na.fill(0, ["n_live", "n_dead", "n_dead_historical"])


def reason_mix(dead: DataFrame, axes: list[str], reason: str) -> DataFrame:
    """Each cell's reasons by frequency, as one string."""
    n = dead.where(F.col(reason).isNotNull()).groupBy(*axes, reason).agg(F.count(F.lit(1)).alias("n"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(reason).alias("r")))), lambda x: F.concat(x["r"], F.lit(" ("), (-x["m"]).cast("string"), F.lit(")")))
    return n.groupBy(*axes).agg(F.array_join(parts, ", ").alias("mix"))


def dead_historical(programs: DataFrame, today: Column, approved: list[str]) -> DataFrame:
    """programs whose last trial began over ten years ago, of no approved name and without a successor.

    programs: program_id, names, last_start, has_successor (J8).
    """
    old = F.datediff(today, F.col("last_start")) > 3650
    known = F.exists("names", lambda n: F.lower(F.trim(n)).isin(*approved))
    return programs.withColumn("dead_historical", F.coalesce(old & ~known & ~F.col("has_successor"), F.lit(False)))


def priority_queue(trials: DataFrame, today: Column) -> DataFrame:
    """O1: tier 0 with gold or evidence, 1 indexed by longest silence, 2 the rest; order by tier, key, id.

    trials: nct_id, is_gold, has_evidence, last_posted.
    """
    tier = F.when(F.col("is_gold") | F.col("has_evidence"), 0).when(F.col("last_posted").isNotNull(), 1).otherwise(2)
    return trials.withColumn("priority_tier", tier).withColumn("priority_key", F.when(tier == 1, -F.datediff(today, "last_posted")).otherwise(0).cast("double")).orderBy("priority_tier", "priority_key", "nct_id")


def cap_with_overflow(rows: DataFrame, order: list[str], cap: int) -> DataFrame:
    """O3: the first ``cap`` rows in order, and all others marked as overflow: none is dropped."""
    head = rows.orderBy(*order).limit(cap).select(F.struct(*order).alias("_o"))
    last = head.agg(F.max("_o").alias("_last"))
    return rows.crossJoin(F.broadcast(last)).withColumn("overflow", F.coalesce(F.struct(*order) > F.col("_last"), F.lit(True))).drop("_last")


def batches(rows: DataFrame, group: str, order: list[str], size: int = 20) -> DataFrame:
    """Batch number of each row within its group."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1) / size))


def disposition(rows: DataFrame) -> DataFrame:
    """O2: rows ordered by disposition (likely_reject, ambiguous, confirmed) and id."""
    rank = F.when(F.col("likely_reject"), 0).when(F.col("confirmed"), 2).otherwise(1)
    return rows.withColumn("bucket", F.element_at(F.array(*[F.lit(x) for x in ("likely_reject", "ambiguous", "confirmed")]), rank + 1)).orderBy(rank, "program_id")


def spend_cap(rows: DataFrame, order: list[str], cost: str, cap: float) -> DataFrame:
    """Rows in order while the cost so far stays within the cap."""
    from asofly.operators.temporal import global_running_sum

    return global_running_sum(rows, order, cost, "_before").where(F.col("_before") + F.col(cost) <= cap).drop("_before")


# ------------------------------------------------------------------ audit

CHECK = "stage string, name string, level string, expected string, actual string, detail string"


def check(df: DataFrame, stage: str, name: str, bad: Column, warn_only: bool = False) -> DataFrame:
    """Q: one row: PASS if no row of ``df`` is bad, else FAIL (or WARN), with the count."""
    n = df.agg(F.count_if(F.coalesce(bad, F.lit(False))).alias("n"), F.count(F.lit(1)).alias("all"))
    return n.select(
        F.lit(stage).alias("stage"), F.lit(name).alias("name"), F.when(F.col("n") == 0, "PASS").otherwise("WARN" if warn_only else "FAIL").alias("level"),
        F.lit("0").alias("expected"), F.col("n").cast("string").alias("actual"), F.concat(F.lit("of "), F.col("all").cast("string")).alias("detail"),
    )


def run_stages(stages: list[tuple[str, bool, list[DataFrame]]]) -> tuple[DataFrame | None, int]:
    """Q1: stages in order; a gating stage with a FAIL stops the rest. Exit code 1 with any FAIL."""
    rows, failed, spark = [], False, None
    for _, gating, checks in stages:
        if not checks:
            continue
        spark = checks[0].sparkSession
        found = reduce(DataFrame.unionByName, checks).collect()  # a row for each check, in one job
        rows += found
        bad = any(r.level == "FAIL" for r in found)
        failed = failed or bad
        if bad and gating:
            break
    return (spark.createDataFrame(rows, CHECK) if spark else None), int(failed)


def error_classes(rows: DataFrame, message: str, classes: dict[str, str]) -> DataFrame:
    """Errors by the first matching expression, with the share of each."""
    m = F.col(message)
    chain = reduce(lambda c, x: c.when(m.rlike(x[1]), x[0]), classes.items(), F).otherwise("other")
    n = rows.where(m.isNotNull()).groupBy(chain.alias("error_class")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.try_divide("n", F.sum("n").over(Window.partitionBy())))
