"""Append-only labels: validation, latest revision, subsets, agreement, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofly.functions import vocab as V
from asofly.functions.text import stated_reason
from asofly.operators.temporal import latest_by


def _known(c: Column, values) -> Column:
    return F.coalesce(c.isin(*values), F.lit(False))


def label_errors(layers: list[str]) -> Column:
    """Messages of all rules that a label record breaks; an empty array is a valid record.

    The gates follow one another: a record is only held to the rules of the gate that it
    reached, and automatic records to their own, shorter list.
    """
    c = F.col
    gate, is_adc, in_scope, reason = c("gate_reached"), c("is_adc"), c("in_scope"), c("scope_reason")
    label = c("action") == "label"
    auto = F.coalesce(c("decided_by"), F.lit("human")) == "auto"
    human = label & ~auto
    g3 = human & (gate == 3)
    dead = g3 & (c("status") == "dead_confirmed")
    present = lambda x: x.isNotNull() & (x.cast("string") != "")
    rules = {
        "unknown action": ~_known(c("action"), ("label", "skip")),
        "gate_reached must be 1, 2 or 3": label & ~_known(gate, (1, 2, 3)),
        "decided_by must be human or auto": label & ~_known(F.coalesce(c("decided_by"), F.lit("human")), ("human", "auto")),
        "auto needs a known triage_layer": label & auto & ~_known(c("triage_layer"), layers),
        "auto is only for gates 1 and 2": label & auto & (gate == 3),
        "auto at gate 1 needs is_adc=no": label & auto & (gate == 1) & ~_known(is_adc, ("no",)),
        "auto at gate 2 needs in_scope=no": label & auto & (gate == 2) & ~_known(in_scope, ("no",)),
        "auto at gate 2 needs a gate-2 scope_reason": label & auto & (gate == 2) & ~_known(reason, V.GATE2_SCOPE_OUT_REASONS),
        "auto at gate 2 with an unknown is_adc": label & auto & (gate == 2) & is_adc.isNotNull() & ~_known(is_adc, V.IS_ADC_VALUES),
        "unknown is_adc": human & ~_known(is_adc, V.IS_ADC_VALUES),
        "is_adc=yes goes on to gate 2": human & (gate == 1) & (is_adc == "yes"),
        "is_adc=no carries in_scope=no and not_an_adc, or neither": human & (gate == 1) & (is_adc == "no") & (in_scope.isNotNull() | reason.isNotNull()) & ~(in_scope.eqNullSafe("no") & reason.eqNullSafe("not_an_adc")),
        "gates 2 and 3 need is_adc=yes": human & (gate >= 2) & ~_known(is_adc, ("yes",)),
        "unknown in_scope": human & (gate >= 2) & ~_known(in_scope, V.IN_SCOPE_VALUES),
        "in_scope=yes goes on to gate 3": human & (gate == 2) & (in_scope == "yes"),
        "in_scope=no needs a gate-2 scope_reason": human & (gate == 2) & (in_scope == "no") & ~_known(reason, V.GATE2_SCOPE_OUT_REASONS),
        "gate 3 needs in_scope=yes": g3 & ~_known(in_scope, ("yes",)),
        "history coverage was not full when served": g3 & ~_known(c("history_coverage_at_serve_time"), ("full",)),
        "third-party date and source go together": g3 & (present(c("third_party_first_noted_date")) != present(c("third_party_source"))),
        "unknown status": g3 & ~_known(c("status"), V.PROGRAM_STATUSES),
        "confidence is required": g3 & ~_known(c("confidence"), V.CONFIDENCE_LEVELS),
        "dead_confirmed needs a kill_reason": dead & ~_known(c("kill_reason"), V.KILL_REASONS),
        "dead_confirmed needs a confirmation date or never_publicly_confirmed": dead & ~present(c("public_confirmation_date")) & ~F.coalesce(c("never_publicly_confirmed"), F.lit(False)),
        "dead_confirmed needs label_evidence_date": dead & ~present(c("label_evidence_date")),
        "a confirmation date needs its evidence type": dead & present(c("public_confirmation_date")) & ~_known(c("confirmation_evidence_type"), V.CONFIRMATION_EVIDENCE_TYPES),
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(text)) for text, broken in rules.items()]))


def latest_labels(records: DataFrame, position: str = "position") -> DataFrame:
    """The latest ``label`` record of each program that isn't a repeat probe; of equal stamps the first."""
    kept = records.where((F.col("action") == "label") & ~F.coalesce("is_repeat_probe", F.lit(False)))
    return latest_by(kept, "program_id", "timestamp", position)


def gate3_labels(records: DataFrame) -> DataFrame:
    """Latest labels that reached gate 3."""
    return latest_labels(records).where("gate_reached = 3")


def dead_with_reason(records: DataFrame) -> DataFrame:
    """Latest gate-3 labels that are confirmed dead."""
    return gate3_labels(records).where("status = 'dead_confirmed'")


def not_reviewed(pool: DataFrame, records: DataFrame, key: str = "program_id") -> DataFrame:
    """Programs without a label of any gate."""
    return pool.join(latest_labels(records).select(key), key, "left_anti")


def in_scope(programs: DataFrame, gold: DataFrame, staged: DataFrame, key: str = "program_id") -> DataFrame:
    """The gold record decides where there is one, else the staged one unless it was an overflow."""
    g = latest_labels(gold).select(key, F.col("in_scope").alias("_g"), F.lit(True).alias("_has"))
    s = latest_by(staged, key, "timestamp", "position").where("not coalesce(manual_overflow, false)").select(key, F.col("in_scope").alias("_s"))
    joined = programs.join(g, key, "left").join(s, key, "left")
    return joined.where(F.when(F.col("_has"), F.col("_g") == "yes").otherwise(F.col("_s") == "yes")).select(*programs.columns)


def stated_vs_true(programs: DataFrame, records: DataFrame) -> DataFrame:
    """The class of the latest stated stop reason against the labelled one, of dead programs that state any.

    ``programs``: program_id, trials array<struct<status,why_stopped,last_update_post_date>>.
    """
    stopped = F.filter("trials", lambda t: t["status"].isin(*V.TERMINAL_STOP) & t["why_stopped"].isNotNull())
    last = F.array_max(F.transform(stopped, lambda t: F.struct(F.coalesce(t["last_update_post_date"], F.lit("")).alias("d"), t["why_stopped"].alias("r"))))
    stated = programs.select("program_id", stated_reason(last["r"]).alias("stated"))
    dead = dead_with_reason(records).select("program_id", F.col("kill_reason").alias("labelled"))
    return dead.join(stated, "program_id").where("stated is not null")


def confusion(rows: DataFrame, left: str, right: str) -> DataFrame:
    """Counts of pairs of values."""
    return rows.groupBy(left, right).agg(F.count(F.lit(1)).alias("n"))


def agreement(rows: DataFrame, left: str, right: str) -> DataFrame:
    """Answered pairs, agreeing ones and the rate; abstentions (null) are left out."""
    both = rows.where(F.col(left).isNotNull() & F.col(right).isNotNull())
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(left) == F.col(right)).alias("agree")).withColumn("rate", F.try_divide("agree", "n"))


def self_consistency(records: DataFrame, fields: list[str]) -> DataFrame:
    """How often repeat probes agree with the program's own label, in all of the fields."""
    labels = records.where("action = 'label'")
    repeats = labels.where("coalesce(is_repeat_probe, false)").select("program_id", *[F.col(f).alias(f"_{f}") for f in fields])
    pairs = repeats.join(latest_labels(records).select("program_id", *fields), "program_id")
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"_{f}"))
    return pairs.agg(F.count(F.lit(1)).alias("n"), F.count_if(same).alias("agree")).withColumn("rate", F.try_divide("agree", "n"))


def align_answers(asked: DataFrame, answered: DataFrame, group: str) -> DataFrame:
    """Answers matched to questions by position, or by name where a group's counts differ.

    asked: group, position, name; answered: group, position, name, answer.
    """
    sizes = asked.groupBy(group).agg(F.count(F.lit(1)).alias("_na")).join(answered.groupBy(group).agg(F.count(F.lit(1)).alias("_nb")), group, "left")
    q = asked.join(sizes, group).withColumn("_by_position", F.col("_na") == F.coalesce("_nb", F.lit(0)))
    a = answered.select(F.col(group).alias("_g"), F.col("position").alias("_p"), F.lower(F.trim("name")).alias("_n"), F.col("answer"))
    by_position = q.where("_by_position").join(a, (F.col(group) == F.col("_g")) & (F.col("position") == F.col("_p")), "left")
    first = a.groupBy("_g", "_n").agg(F.min_by("answer", "_p").alias("answer")).withColumn("_p", F.lit(None).cast("int"))
    by_name = q.where("not _by_position").join(first, (F.col(group) == F.col("_g")) & (F.lower(F.trim("name")) == F.col("_n")), "left")
    cols = [*asked.columns, "answer"]
    return by_position.select(*cols).unionByName(by_name.select(*cols))


def gate_counts(records: DataFrame) -> DataFrame:
    """Label events by gate, median seconds (zero and null left out) and blind ones."""
    seconds = F.when(F.col("seconds") > 0, F.col("seconds"))
    return records.where("action = 'label'").groupBy("gate_reached").agg(F.count(F.lit(1)).alias("n"), F.median(seconds).alias("median_seconds"), F.count_if(F.coalesce("blind", F.lit(False))).alias("blind"))


def rejection_patterns(records: DataFrame) -> DataFrame:
    """All gate-1 rejections by answer, layer and reason, not only the latest ones."""
    return records.where("action = 'label' and gate_reached = 1").groupBy("is_adc", "triage_layer", "scope_reason").agg(F.count(F.lit(1)).alias("n"))


def split_by_key(rows: DataFrame, key: str, share: float = 0.3, seed: int = 0) -> DataFrame:
    """A fixed evaluation split: the hash of a key alone decides, so it is stable as rows are added."""
    u = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(1_000_000)) / 1e6
    return rows.withColumn("split", F.when(u < share, "eval").otherwise("train"))


def decision_table(a: str = "answers") -> Column:
    """struct(status, kill_reason, abstain, rule_path) from decomposed answers; an undeterminable needed answer abstains.

    Answers are strings: statement, trial_since, successor in (yes, no, not_determinable); stop_category.
    """
    f = lambda n: F.col(a)[n]
    unknown = "not_determinable"
    made = lambda status, path, abstain=False, kill=None: F.struct(
        F.lit(status).cast("string").alias("status"), (F.lit(None).cast("string") if kill is None else kill).alias("kill_reason"), F.lit(abstain).alias("abstain"), (path if isinstance(path, Column) else F.lit(path)).alias("rule_path")
    )
    kill = F.when(f("stop_category").isin(*V.KILL_REASONS), f("stop_category")).otherwise("unknown_silent")
    return (
        F.when((f("statement") == unknown) | (f("trial_since") == unknown), made(None, "abstain:core_evidence_not_determinable", True))
        .when((f("statement") == "yes") & (f("stop_category") == unknown), made(None, "abstain:stop_reason_not_determinable", True))
        .when(f("statement") == "yes", made("dead_confirmed", F.concat(F.lit("dead_confirmed:"), f("stop_category")), kill=kill))
        .when((f("successor") == unknown) & (f("trial_since") == "no"), made(None, "abstain:successor_not_determinable", True))
        .when((f("trial_since") == "no") & (f("successor") == "yes"), made("superseded", "superseded"))
        .when((f("trial_since") == "no") & (f("successor") == "no"), made("dormant_suspected", "dormant_suspected"))
        .when(f("trial_since") == "yes", made("active", "active"))
        .otherwise(made(None, "abstain:unresolved", True))
    )
