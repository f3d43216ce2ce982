"""Work queues, staged runs and the reports over their answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofly.functions.scoring import any_sponsor
from asofly.functions.text import apply_grounding, evidence_source, unescape_html, verify_quote, wilson
from asofly.operators.entities import unique_match
from asofly.operators.labels import agreement, confusion, gate3_labels, latest_labels
from asofly.operators.scans import rank_selected
from asofly.operators.temporal import dense_ids, latest_by

#: Rows of the first two stages of a run; the third has the rest. Every tenth serve is a repeat.
STAGE_ROWS, REPEAT_EVERY = (50, 150), 10


def stable_pool(programs: DataFrame, records: DataFrame, staged: DataFrame, exclude: DataFrame, key: str = "program_id") -> DataFrame:
    """Open programs that no check may overturn: first those without an opinion (or an overflow), then those staged as yes.

    ``turn`` orders the queue; staged "no" and "unsure" are left out.
    """
    latest = latest_by(staged, key, "timestamp", "position").select(key, F.when(~F.coalesce("manual_overflow", F.lit(False)), F.col("is_adc")).alias("_said"))
    free = programs.join(latest_labels(records).select(key), key, "left_anti").join(exclude.select(key), key, "left_anti").join(latest, key, "left")
    pool = F.when(F.col("_said").isNull(), 0).when(F.col("_said") == "yes", 1)
    return dense_ids(free.withColumn("pool", pool).where("pool is not null").drop("_said"), ["pool", key], "turn")


def stratum_gaps(programs: DataFrame, records: DataFrame, least: int = 1, key: str = "program_id") -> DataFrame:
    """Unlabelled programs of strata with fewer than ``least`` full labels, by key."""
    done = gate3_labels(records).select(key, F.lit(1).alias("_done"))
    j = programs.where("band is not null").join(done, key, "left")
    thin = j.groupBy("band", "primary_archetype").agg(F.count("_done").alias("_n")).where(F.col("_n") < least).drop("_n")
    return j.where("_done is null").join(thin, ["band", "primary_archetype"]).select(*programs.columns)


def automatic_rejections(records: DataFrame, gate: int = 2) -> DataFrame:
    """Programs whose latest label an automatic rule gave at the gate: a queue to review them by hand."""
    return latest_labels(records).where((F.col("decided_by") == "auto") & (F.col("gate_reached") == gate)).select("program_id")


def queue_in_front(order: DataFrame, front: DataFrame, key: str = "program_id") -> DataFrame:
    """An ordered queue (key, turn) with some keys moved to its front, each once; reopened ones come back this way."""
    marked = order.join(front.select(key).distinct().withColumn("_front", F.lit(0)), key, "full").select(key, F.coalesce("_front", F.lit(1)).alias("_rank"), F.coalesce("turn", F.lit(0)).alias("_turn"))
    return dense_ids(marked, ["_rank", "_turn", key], "turn").select(key, "turn")


def run_stage(rows: DataFrame, order: list[str], stage: int, done: tuple[int, ...] = ()) -> DataFrame:
    """The rows of a stage of a run (the first 50, the next 150, the rest); a stage waits for the one before it."""
    if stage not in (1, 2, 3):
        raise ValueError(f"no stage {stage}")
    if stage > 1 and stage - 1 not in done:
        raise RuntimeError(f"stage {stage - 1} has not been run")
    cuts = (0, STAGE_ROWS[0], sum(STAGE_ROWS))
    placed = dense_ids(rows, order, "_at").where(F.col("_at") >= cuts[stage - 1])
    return (placed.where(F.col("_at") < cuts[stage]) if stage < 3 else placed).drop("_at")


def serve_order(queue: DataFrame, labelled: DataFrame, key: str = "program_id") -> DataFrame:
    """(serve, key, is_repeat): the queue in turn, with every tenth serve a repeat of a labelled program.

    Repeats go round the labelled programs in hash order, so one never follows itself
    where there are two. Without any labelled program there are none.
    """
    pool = dense_ids(labelled.select(key).distinct().withColumn("_h", F.xxhash64(key)), ["_h", key], "_k").drop("_h")
    n = pool.count()
    if not n:
        return queue.select(F.col("turn").alias("serve"), key, F.lit(False).alias("is_repeat"))
    own = queue.select((F.col("turn") + F.floor(F.col("turn") / (REPEAT_EVERY - 1))).alias("serve"), key, F.lit(False).alias("is_repeat"))
    slots = queue.where(F.col("turn") % (REPEAT_EVERY - 1) == REPEAT_EVERY - 2).select((F.col("turn") + F.floor(F.col("turn") / (REPEAT_EVERY - 1)) + 1).alias("serve"))
    again = slots.withColumn("_k", F.floor(F.col("serve") / REPEAT_EVERY) % n).join(pool, "_k").select("serve", key, F.lit(True).alias("is_repeat"))
    return own.unionByName(again)


def selection(programs: DataFrame, records: DataFrame, staged: DataFrame, ids: list[str] | None = None, gold_only: bool = False, fresh: bool = False, limit: int | None = None) -> DataFrame:
    """Programs of a run: explicit ids, or those with a gold label, without those staged before unless ``fresh``; a limit is the caller's."""
    chosen = programs.where(F.col("program_id").isin(*ids)) if ids is not None else programs
    if gold_only:
        chosen = chosen.join(gate3_labels(records).select("program_id"), "program_id", "left_semi")
    if not fresh:
        chosen = chosen.join(staged.select("program_id").distinct(), "program_id", "left_anti")
    return chosen.orderBy("program_id").limit(limit) if limit is not None else chosen


def annotate_pilot(rows: DataFrame) -> DataFrame:
    """Answers with their grounding: whether recall was forced, the evidence source, and whether they go on to layer 3."""
    g = rows.withColumn("_g", apply_grounding(F.col("verdict"), F.coalesce("from_recall", F.lit(False)), F.col("quote")))
    g = g.withColumn("from_recall", F.col("_g.from_recall")).withColumn("grounding_forced_recall", F.coalesce("_g.forced", F.lit(False))).drop("_g")
    return g.withColumn("evidence_source", evidence_source(F.col("from_recall"), F.col("quote"))).withColumn("would_route_l3", F.coalesce("routed_to_layer3", F.lit(False)) | F.col("from_recall") | F.coalesce(F.col("verdict") == "unsure", F.lit(False)))


def pilot_block(annotated: DataFrame) -> DataFrame:
    """One row of counts over annotated answers."""
    v, e = F.col("verdict"), F.col("evidence_source")
    n = F.count(F.lit(1))
    return annotated.agg(
        n.alias("n"), *[F.count_if(v == x).alias(x) for x in ("yes", "no", "unsure")], *[F.count_if(e == x).alias(x) for x in ("text", "recall", "no_usable_evidence")],
        F.count_if("would_route_l3").alias("n_l3"), F.coalesce(F.try_divide(F.count_if("would_route_l3"), n), F.lit(0.0)).alias("l3_rate"),
        F.count_if("grounding_forced_recall").alias("n_forced"), F.count_if((v == "unsure") & (e == "no_usable_evidence")).alias("n_empty_unsure"),
    )


def collected_answers(asked: DataFrame, samples: DataFrame, sources: DataFrame, key: str = "program_id") -> DataFrame:
    """One answer for each program asked: the most frequent sampled vote, "unsure" if there is none or a tie, and whether its quote holds.

    asked: key; samples: key, sample, vote, quote (null votes are samples that couldn't be
    read and don't vote); sources: key, text. A quote that its source lacks is dropped.
    """
    votes = samples.where("vote is not null").groupBy(key, "vote").agg(F.count(F.lit(1)).alias("n"), F.min_by("quote", "sample").alias("quote"))
    best = votes.groupBy(key).agg(F.max("n").alias("top"), F.sum("n").alias("votes"), F.collect_list(F.struct("vote", "n", "quote")).alias("all"))
    lead = F.filter("all", lambda x: x["n"] == F.col("top"))
    won = best.select(key, "votes", F.when(F.size(lead) == 1, lead[0]).alias("w"))
    j = asked.select(key).distinct().join(won, key, "left").join(sources.select(key, "text"), key, "left")
    ok = verify_quote(F.col("w.quote"), F.col("text"))
    return j.select(key, F.coalesce("w.vote", F.lit("unsure")).alias("answer"), F.coalesce("votes", F.lit(0)).alias("votes"), F.when(ok, F.col("w.quote")).alias("quote"), F.coalesce(ok, F.lit(False)).alias("verified"))


def abstains(objections: Column) -> Column:
    """Whether a critic's objections (array of structs strength, citations) withdraw the answer: a strong one with evidence does."""
    return F.coalesce(F.exists(objections, lambda o: (o["strength"] == "strong") & (F.size(o["citations"]) > 0)), F.lit(False))


def sponsor_index(programs: DataFrame, key: str = "candidate_id", large: int = 300) -> DataFrame:
    """For each sponsor its class (the first known one), programs, trials, trials by phase, and whether it ran a large phase 3.

    programs: key, sponsors_over_time array<struct<sponsor,class>>, trials array<struct<nct_id,sponsor,phases,enrollment>>.
    A trial counts for its own sponsor only. Names are compared with character references undone.
    """
    some = lambda c: c.isNotNull() & (c != "")
    named = programs.select(key, F.posexplode("sponsors_over_time").alias("at", "s")).where(some(F.col("s.sponsor")))
    seen = named.select(unescape_html(F.col("s.sponsor")).alias("sponsor"), F.col(key).alias("program"), F.col("s.class").alias("class"), F.struct(key, "at").alias("order"))
    ran = programs.select(key, F.explode("trials").alias("t")).where(some(F.col("t.sponsor"))).select(unescape_html(F.col("t.sponsor")).alias("sponsor"), F.col(key).alias("program"), "t.nct_id", "t.phases", "t.enrollment")
    both = seen.unionByName(ran, allowMissingColumns=True)
    base = both.groupBy("sponsor").agg(
        F.min_by("class", F.when(F.col("class").isNotNull(), F.col("order"))).alias("class"), F.count_distinct("program").alias("programs"), F.count_distinct("nct_id").alias("trials"),
        F.bool_or(F.coalesce(F.array_contains("phases", "PHASE3") & (F.col("enrollment") > large), F.lit(False))).alias("has_large_phase3"),
    )
    phases = ran.select("sponsor", F.explode("phases").alias("phase")).groupBy("sponsor", "phase").agg(F.count(F.lit(1)).alias("n"))
    counts = phases.groupBy("sponsor").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("phase", "n")))).alias("phase_counts"))
    return base.join(counts, "sponsor", "left")


def class_candidates(index: DataFrame) -> DataFrame:
    """Sponsors that look like industry by a large phase 3 but aren't classed as such."""
    _, industry, _ = any_sponsor(F.array(F.struct("sponsor", "class")))
    return index.where(F.col("has_large_phase3") & ~industry)


def with_residual(resolved: DataFrame, residual: DataFrame, key: str = "program_id") -> DataFrame:
    """A program's own target, else that of the residual map with its source; a target found here is never replaced."""
    r = residual.select(key, F.col("target").alias("_t"), F.col("source").alias("_s"))
    j = resolved.join(r, key, "left")
    use = F.col("target").isNull() & F.col("_t").isNotNull()
    return j.withColumn("source", F.when(use, F.col("_s")).otherwise(F.col("source"))).withColumn("target", F.coalesce("target", "_t")).drop("_t", "_s")


def external_funnel(unresolved: DataFrame, names: DataFrame, steps: list[tuple[str, DataFrame]], key: str = "program_id") -> tuple[DataFrame, DataFrame]:
    """Targets of unresolved programs by several dimension tables in turn, and the funnel: asked and resolved at each step.

    names: key, name; a step is (source, table(name, target)). A later step sees only what
    the earlier ones left open; names with several targets stay open.
    """
    left, found, funnel = unresolved.select(key), None, None
    for source, dimension in steps:
        hit = unique_match(names.join(left, key, "left_semi"), key, "name", dimension, "name", "target").where("target is not null").withColumn("source", F.lit(source))
        n = left.agg(F.count(F.lit(1)).alias("asked")).crossJoin(hit.agg(F.count(F.lit(1)).alias("resolved"))).select(F.lit(source).alias("step"), "asked", "resolved")
        found = hit if found is None else found.unionByName(hit)
        funnel = n if funnel is None else funnel.unionByName(n)
        left = left.join(hit.select(key), key, "left_anti")
    return found, funnel


def attribute_coverage(programs: DataFrame, columns: list[str], none: str = "undisclosed") -> DataFrame:
    """For each attribute the programs that have a value, in one aggregate."""
    known = {c: F.count_if(F.col(c).isNotNull() & (F.col(c).cast("string") != none)) for c in columns}
    one = programs.agg(F.count(F.lit(1)).alias("n"), *[k.alias(c) for c, k in known.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).alias("known")) for c in columns]))
    return one.select("n", rows.alias("r")).select("r.attribute", "r.known", "n", F.try_divide("r.known", "n").alias("share"))


def usage(records: DataFrame, answers: str = "answers", review: str = "review") -> DataFrame:
    """Calls, tokens and cost of each record: over its answers (map of structs(usage)) and the review of them."""
    logs = F.concat(F.coalesce(F.map_values(answers), F.array().cast(_value_array(records, answers))), F.array(F.col(review)))
    total = lambda f, zero: F.aggregate(F.transform(logs, lambda x: F.coalesce(x["usage"][f], F.lit(zero))), F.lit(zero), lambda a, b: a + b)
    return records.select("*", *[total(f, 0).cast("long").alias(f) for f in ("calls", "input_tokens", "output_tokens")], total("cost_usd", 0.0).alias("cost_usd"))


def _value_array(df: DataFrame, column: str) -> str:
    return f"array<{df.schema[column].dataType.valueType.simpleString()}>"


def request_cost(input_tokens: Column, output_tokens: Column, rates: tuple[float, float], batch_discount: float = 1.0, searches: Column | None = None, per_thousand: float = 0.0) -> Column:
    """Price of a request from rates for a million tokens; the discount is for tokens, never for searches."""
    tokens = (input_tokens * rates[0] + output_tokens * rates[1]) / 1e6 * batch_discount
    return tokens if searches is None else tokens + searches * per_thousand / 1000


def dry_run(evidences: DataFrame, header_chars: int, rates: tuple[float, float], batch_discount: float = 0.5, batch: int = 20, samples: tuple[int, int] = (3, 5), answer_tokens: int = 60, cap: int = 400, search_tokens: tuple[int, int] = (1400, 150), key: str = "program_id") -> DataFrame:
    """What a run over the residue would ask and cost, without asking: one row.

    evidences: key, prompt (a candidate's part of a prompt, null where no text names it).
    Candidates with a text are asked ``batch`` to a prompt behind a header, ``samples`` times
    typically and at worst; those without go to the search layer, of which at most ``cap`` are served
    and the others counted as overflow. Tokens are a quarter of the characters, one at least.
    """
    named = evidences.where("prompt is not null")
    groups = dense_ids(named.select(key, F.length("prompt").alias("_n")), [key], "_at").groupBy(F.floor(F.col("_at") / batch).alias("_g")).agg(F.sum("_n").alias("chars"), F.count(F.lit(1)).alias("k"))
    tokens = F.greatest(F.lit(1), F.floor((F.col("chars") + F.col("k") - 1 + header_chars) / 4)).cast("long")
    asked = groups.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"), F.coalesce(F.sum("k"), F.lit(0)).alias("with_text"))
    size = evidences.agg(F.count(F.lit(1)).alias("residue"), F.count_if(F.col("prompt").isNull()).alias("no_text"))
    one = asked.crossJoin(size)
    cost = lambda k: request_cost(F.col("tokens") * k, F.col("with_text") * answer_tokens * k, rates, batch_discount)
    each = request_cost(F.lit(search_tokens[0]), F.lit(search_tokens[1]), rates, batch_discount)
    return one.select(
        "residue", "with_text", "groups", "tokens", cost(samples[0]).alias("typical_cost"), cost(samples[1]).alias("worst_cost"), "no_text", F.greatest(F.col("no_text") - cap, F.lit(0)).alias("overflow"),
        (each * F.least(F.col("no_text"), F.lit(cap))).alias("least_search_cost"), (each * F.least(F.col("no_text") + F.col("with_text"), F.lit(cap))).alias("most_search_cost"),
    )


def resume_sets(pool: DataFrame, staged: DataFrame, pilot: DataFrame, key: str = "program_id", name: str = "proposed_name") -> DataFrame:
    """What is left of an interrupted run: (key, name, step) of the pool: ``done``, ``search`` or ``ask``.

    The latest staged record of a program decides: with a layer 3 record it is done; with one of
    layer 2 it is done unless that was sent on to the search layer. Programs of the pilot (name,
    routed) have been asked already, and those that it sent on are searched.
    """
    last = latest_by(staged, key, "timestamp", "position").select(key, "layer", F.coalesce("route_to_layer3", F.lit(False)).alias("_sent"))
    seen = pilot.groupBy(name).agg(F.bool_or(F.coalesce("routed", F.lit(False))).alias("_routed"), F.lit(True).alias("_piloted"))
    j = pool.select(key, name).join(last, key, "left").join(seen, name, "left")
    step = (
        F.when(F.col("layer") == 3, "done").when(F.col("layer") == 2, F.when(F.col("_sent"), "search").otherwise("done"))
        .when(F.coalesce("_piloted", F.lit(False)), F.when(F.col("_routed"), "search").otherwise("done")).otherwise("ask")
    )
    return j.select(key, name, step.alias("step"))


def lead_distribution(rows: DataFrame, by: str, lead: str) -> DataFrame:
    """N, mean, median, range and index quartiles of lead times: the value at ``int(q n)``; with fewer than four, the ends.

    Medians and quartiles come by ranks over range partitions, so no group is gathered in a task.
    """
    known = rows.where(F.col(lead).isNotNull())
    a = known.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(lead).alias("mean"), F.min(lead).alias("min"), F.max(lead).alias("max"))
    ranks = rank_selected(known, [by], lead, {"median": 0.5}, {"_q1": 0.25, "_q3": 0.75}).withColumnRenamed(by, "_by")
    at = lambda c, end: F.when(F.col("n") >= 4, F.col(c).cast(rows.schema[lead].dataType)).otherwise(F.col(end))
    return a.join(ranks, F.col(by).eqNullSafe(F.col("_by"))).select(by, "n", "mean", "median", "min", "max", at("_q1", "min").alias("q1"), at("_q3", "max").alias("q3"))


def evaluation(gold: DataFrame, silver: DataFrame, field: str, key: str = "program_id") -> dict[str, DataFrame]:
    """Answers against gold: disagreements, confusion, and coverage and accuracy with their score interval."""
    j = gold.select(key, F.col(field).alias("gold")).join(silver.select(key, F.col(field).alias("silver")), key, "left")
    acc = agreement(j, "gold", "silver")
    n = j.agg(F.count(F.lit(1)).alias("population"))
    summary = acc.crossJoin(n).withColumn("ci", wilson(F.col("agree"), F.col("n"))).select("population", "n", F.try_divide("n", "population").alias("coverage"), "agree", F.col("rate").alias("accuracy"), F.col("ci.low").alias("low"), F.col("ci.high").alias("high"))
    return {"summary": summary, "confusion": confusion(j.where("silver is not null"), "gold", "silver"), "disagreements": j.where("silver is not null and gold <> silver")}


def validation_sample(results: DataFrame, per_stratum: int, stratum: list[str], key: str = "program_id", seed: int = 0) -> DataFrame:
    """The same few committable results of each stratum on every run, by a hash of the key; a sampling operator."""
    w = Window.partitionBy(*stratum).orderBy(F.xxhash64(key, F.lit(seed)), key)
    return results.where("committable").withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= per_stratum).drop("_rn")


def promotable(staged: DataFrame, records: DataFrame, field: str = "is_adc", least: float = 0.95) -> DataFrame:
    """Whether staged decisions agree with the labels of the same programs well enough to be promoted: n, agree, rate, promote."""
    s = latest_by(staged, "program_id", "timestamp", "position").select("program_id", F.col(field).alias("_s"))
    j = latest_labels(records).select("program_id", F.col(field).alias("_g")).join(s, "program_id")
    return agreement(j, "_g", "_s").withColumn("promote", F.coalesce(F.col("rate") >= least, F.lit(False)))
