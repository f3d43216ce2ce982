"""Records, panels, selections, queues, audits and the back-test on small cases with known results."""

import ast
import datetime as dt
import json
import os
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from asofly.functions import scoring
from asofly.functions import text as X
from asofly.operators import audit, differ, entities, finance, labels, programs, queues, stats, survival, temporal, triage
from asofly.session import scratch_path
from asofly.sources import snapshots
from asofly.streaming import ingest
from tests.test_operators import body

D = dt.date
RECORD = (
    "program_id string, position long, timestamp string, action string, gate_reached int, is_repeat_probe boolean, status string, kill_reason string, is_adc string, in_scope string, scope_reason string, "
    "decided_by string, triage_layer string, labeller string, seconds double, blind boolean, public_confirmation_date string, label_evidence_date string, never_publicly_confirmed boolean, history_coverage_at_serve_time string, status_revised boolean"
)


def record(program, at, **more):
    base = dict(action="label", gate_reached=3, is_repeat_probe=False, status="active", kill_reason=None, is_adc="yes", in_scope="yes", scope_reason=None, decided_by="human", triage_layer=None, labeller="me", seconds=100.0, blind=True,
                public_confirmation_date=None, label_evidence_date=None, never_publicly_confirmed=None, history_coverage_at_serve_time="full", status_revised=False)
    return (program, at, f"2024-01-{at:02d}", *{**base, **more}.values())


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), RECORD)


def values(df, *order):
    return sorted((tuple(r) for r in df.select(*(order or df.columns)).collect()), key=str)


def test_label_subsets(spark):
    r = frame(
        spark, record("a", 1, status="dead_confirmed", kill_reason="futility_efficacy"), record("a", 2, is_repeat_probe=True), record("b", 3, gate_reached=1, is_adc="no", in_scope=None, seconds=0.0, blind=False, triage_layer="layer1", scope_reason="x"),
        record("c", 4, gate_reached=2, in_scope="no", decided_by="auto", seconds=50.0), record("c", 5, gate_reached=2, in_scope="no", decided_by="auto", seconds=70.0), record("d", 6, action="skip"),
    )
    assert values(labels.dead_with_reason(r), "program_id") == [("a",)]
    pool = spark.createDataFrame([("a",), ("d",), ("e",)], "program_id string")
    assert values(labels.not_reviewed(pool, r)) == [("d",), ("e",)]
    assert values(labels.gate_counts(r)) == [(1, 1, None, 0), (2, 2, 60.0, 2), (3, 2, 100.0, 2)]
    assert values(labels.rejection_patterns(r)) == [("no", "layer1", "x", 1)]
    assert values(queues.automatic_rejections(r)) == [("c",)]
    s = labels.split_by_key(spark.range(2000).withColumnRenamed("id", "asset"), "asset")
    part = s.where("asset < 500").withColumnRenamed("split", "then").join(labels.split_by_key(spark.range(500).withColumnRenamed("id", "asset"), "asset"), "asset")
    assert part.where("then <> split").count() == 0 and 500 < s.where("split = 'eval'").count() < 700
    scoped = frame(spark, record("a", 1, gate_reached=1, is_adc="no", in_scope=None), record("b", 2, gate_reached=1, is_adc="no", in_scope="no", scope_reason="not_an_adc"))
    assert values(programs.needs_scope_backfill(scoped), "program_id", "in_scope", "scope_reason") == [("a", "no", "not_an_adc")]


def test_stated_against_true(spark):
    p = spark.createDataFrame([("p1", [("TERMINATED", "futility at interim analysis", "2020"), ("TERMINATED", "lack of funding for it", "2019")]), ("p2", [("WITHDRAWN", "portfolio reprioritised", None)]), ("p3", [("COMPLETED", "lack of funding for it", "2020")])], "program_id string, trials array<struct<status:string,why_stopped:string,last_update_post_date:string>>")
    r = frame(spark, *[record(k, i, status="dead_confirmed", kill_reason=w) for i, (k, w) in enumerate((("p1", "toxicity_safety"), ("p2", "strategic_portfolio"), ("p3", "accrual_failure")), 1)])
    got = labels.stated_vs_true(p, r)
    assert values(got) == [("p1", "toxicity_safety", "futility_efficacy"), ("p2", "strategic_portfolio", "strategic_portfolio")]
    assert values(labels.agreement(got, "stated", "labelled")) == [(2, 1, 0.5)]
    t = spark.createDataFrame([("p1", [("TERMINATED", "slow recruitment rate", D(2020, 1, 1)), ("TERMINATED", "patent litigation", D(2021, 1, 1))]), ("p2", [])], "program_id string, trials array<struct<status:string,why_stopped:string,last_update:date>>")
    assert values(programs.reasons_of(t)) == [("p1", "ip_legal"), ("p2", None)]


def test_decisions(spark):
    keys = ("statement", "trial_since", "successor", "stop_category")
    cases = {
        ("not_determinable", "no", "no", None): (None, None, True), ("yes", "no", "no", "not_determinable"): (None, None, True), ("yes", "no", "no", "toxicity_safety"): ("dead_confirmed", "toxicity_safety", False),
        ("yes", "no", "no", "odd"): ("dead_confirmed", "unknown_silent", False), ("no", "no", "not_determinable", None): (None, None, True), ("no", "no", "yes", None): ("superseded", None, False),
        ("no", "no", "no", None): ("dormant_suspected", None, False), ("no", "yes", "no", None): ("active", None, False), ("no", "odd", "no", None): (None, None, True),
    }
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "id int, answers struct<" + ",".join(f"{k}:string" for k in keys) + ">")
    got = df.orderBy("id").select(labels.decision_table().alias("d")).collect()
    assert [(r.d.status, r.d.kill_reason, r.d.abstain) for r in got] == list(cases.values())
    objections = spark.createDataFrame([(1, [("strong", ["x"])]), (2, [("strong", [])]), (3, [("weak", ["x"])]), (4, None)], "id int, o array<struct<strength:string,citations:array<string>>>")
    assert [r.x for r in objections.orderBy("id").select(queues.abstains(F.col("o")).alias("x")).collect()] == [True, False, False, False]


def test_matrix_and_history(spark):
    p = spark.createDataFrame([("a", "full", 4, "T", "s"), ("b", "full", 1, "T", "s"), ("c", "partial", 4, "T", "s"), ("d", "full", 4, "T", None), ("e", "full", 4, "T", "s")], "program_id string, history_coverage string, band int, target string, system string")
    g = spark.createDataFrame([("a", "yes", "yes", "unknown", None), ("b", "yes", "yes", "superseded", None), ("c", "yes", "yes", "dead_confirmed", "k"), ("d", "yes", "no", "active", None), ("e", "yes", "yes", "unknown", None)], "program_id string, is_adc string, in_scope string, status string, kill_reason string")
    rows = triage.live_or_dead(p, g)
    assert values(rows, "program_id", "basis", "is_dead") == [("a", "silence_proxy", True), ("b", "gold", False), ("c", "gold", True), ("e", "silence_proxy", True)]
    cells = triage.matrix(rows, ["target", "system"], least=3)
    assert values(cells) == [("T", "s", 1, 3, "graveyard")]
    folded = triage.fold_historical(cells.drop("quadrant"), spark.createDataFrame([("T", "s"), ("T", "s"), ("U", "s")], "target string, system string"), ["target", "system"])
    assert values(folded) == [("T", "s", 1, 3, 2), ("U", "s", 0, 0, 1)]
    h = spark.createDataFrame([(1, ["X"], D(2000, 1, 1), False), (2, ["Known "], D(2000, 1, 1), False), (3, ["X"], D(2000, 1, 1), True), (4, ["X"], D(2020, 1, 1), False), (5, ["X"], None, False)], "id int, names array<string>, last_start date, has_successor boolean")
    assert [r.dead_historical for r in triage.dead_historical(h, F.lit(D(2024, 1, 1)), ["known"]).orderBy("id").collect()] == [True, False, False, False, False]
    c = spark.createDataFrame([("a", 1, 4), ("b", 0, 9), ("c", 1, 1)], "target string, n_live long, n_dead long")
    assert [r.target for r in programs.ranked_cells(c, 5, 2).collect()] == ["b", "a"]


def test_serving_order(spark):
    q = spark.createDataFrame([(True, True, "b"), (False, True, "c"), (False, False, "d"), (True, False, "a")], "likely_reject boolean, confirmed boolean, program_id string")
    assert [(r.program_id, r.bucket) for r in triage.disposition(q.withColumn("confirmed", F.col("confirmed") & ~F.col("likely_reject"))).collect()] == [("a", "likely_reject"), ("b", "likely_reject"), ("d", "ambiguous"), ("c", "confirmed")]
    b = triage.batches(spark.range(45).withColumn("g", F.lit(1)), "g", ["id"], 20)
    assert [r["count"] for r in b.groupBy("batch").count().orderBy("batch").collect()] == [20, 20, 5]


def test_queues(spark):
    p = spark.createDataFrame([(x, i % 2, "t") for i, x in enumerate("abcdefg")] + [("h", None, "t")], "program_id string, band int, primary_archetype string")
    r = frame(spark, record("a", 1), record("b", 2, gate_reached=1, is_adc="no", in_scope=None))
    staged = spark.createDataFrame([("c", "2024", 1, "yes", False), ("d", "2024", 2, "no", False), ("e", "2024", 3, "unsure", False), ("f", "2024", 4, "yes", True), ("c", "2023", 0, "no", False)], "program_id string, timestamp string, position long, is_adc string, manual_overflow boolean")
    none = p.limit(0)
    got = queues.stable_pool(p, r, staged, spark.createDataFrame([("g",)], "program_id string"))
    assert [x.program_id for x in got.orderBy("turn").collect()] == ["f", "h", "c"]
    assert values(queues.stratum_gaps(p, r), "program_id") == [("b",), ("d",), ("f",)]
    front = queues.queue_in_front(got.select("program_id", "turn"), spark.createDataFrame([("c",), ("z",)], "program_id string"))
    assert [x.program_id for x in front.orderBy("turn").collect()] == ["z", "c", "f", "h"] or [x.program_id for x in front.orderBy("turn").collect()] == ["c", "z", "f", "h"]
    assert values(queues.selection(p, r, staged), "program_id") == [("a",), ("b",), ("g",), ("h",)]
    assert values(queues.selection(p, r, staged, gold_only=True, fresh=True), "program_id") == [("a",)]
    assert values(queues.selection(p, r, staged, ids=["a", "c"]), "program_id") == [("a",)] and values(queues.selection(p, r, none, limit=2), "program_id") == [("a",), ("b",)]
    rows = spark.range(260).withColumnRenamed("id", "n")
    sizes = [queues.run_stage(rows, ["n"], k, done).count() for k, done in ((1, ()), (2, (1,)), (3, (1, 2)))]
    assert sizes == [50, 150, 60] and queues.run_stage(rows, ["n"], 2, (1,)).agg(F.min("n")).first()[0] == 50
    with pytest.raises(RuntimeError):
        queues.run_stage(rows, ["n"], 3, (1,))
    order = spark.range(25).select(F.concat(F.lit("p"), "id").alias("program_id"), F.col("id").alias("turn"))
    served = queues.serve_order(order, spark.createDataFrame([("x",), ("y",)], "program_id string")).orderBy("serve").collect()
    assert [s.serve for s in served] == list(range(27)) and [s.serve for s in served if s.is_repeat] == [9, 19] and {s.program_id for s in served if s.is_repeat} == {"x", "y"}
    assert queues.serve_order(order, none).where("is_repeat").count() == 0
    assert values(programs.open_ids(p, r, none)) == [(x, i % 2, "t") for i, x in enumerate("abcdefg") if x not in "ab"] + [("h", None, "t")]


def test_answers_and_reports(spark):
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "program_id string")
    samples = spark.createDataFrame([("a", 0, "yes", "it is  an ADC"), ("a", 1, "yes", "other"), ("a", 2, None, None), ("b", 0, "yes", "q"), ("b", 1, "no", "q")], "program_id string, sample int, vote string, quote string")
    sources = spark.createDataFrame([("a", "text: it is an ADC indeed")], "program_id string, text string")
    assert values(queues.collected_answers(asked, samples, sources)) == [("a", "yes", 2, "it is  an ADC", True), ("b", "unsure", 2, None, False), ("c", "unsure", 0, None, False)]
    pilot = spark.createDataFrame([("yes", False, "a payload of MMAE", False), ("yes", False, "nothing said", False), ("unsure", False, None, False), ("no", True, None, True)], "verdict string, from_recall boolean, quote string, routed_to_layer3 boolean")
    b = queues.pilot_block(queues.annotate_pilot(pilot)).first()
    assert (b.n, b.yes, b.no, b.unsure, b.text, b.recall, b.no_usable_evidence, b.n_l3, b.n_forced, b.n_empty_unsure) == (4, 2, 1, 1, 1, 2, 1, 3, 1, 1) and b.l3_rate == 0.75
    gold = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", "y")], "program_id string, status string")
    silver = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", None)], "program_id string, status string")
    e = queues.evaluation(gold, silver, "status")
    s = e["summary"].first()
    assert (s.population, s.n, s.coverage, s.agree, s.accuracy) == (4, 2, 0.5, 1, 0.5) and s.low < 0.5 < s.high
    assert values(e["confusion"]) == [("x", "x", 1), ("x", "y", 1)] and values(e["disagreements"]) == [("b", "x", "y")]
    u = spark.createDataFrame([(1, {"q2": ((2, 10, 5, 0.5),), "q3": (None,)}, ((1, 1, 1, 0.25),)), (2, None, None)], "id int, answers map<string,struct<usage:struct<calls:int,input_tokens:int,output_tokens:int,cost_usd:double>>>, review struct<usage:struct<calls:int,input_tokens:int,output_tokens:int,cost_usd:double>>")
    assert values(queues.usage(u), "id", "calls", "input_tokens", "output_tokens", "cost_usd") == [(1, 3, 11, 6, 0.75), (2, 0, 0, 0, 0.0)]
    price = spark.range(1).select(queues.request_cost(F.lit(2_000_000), F.lit(1_000_000), (3.0, 15.0), 0.5, F.lit(500), 10.0).alias("c")).first().c
    assert price == pytest.approx((6 + 15) * 0.5 + 5)
    lead = spark.createDataFrame([("a", float(x)) for x in (5, 1, 9, 7, 3)] + [("b", 2.0), ("b", 4.0), ("b", None)], "g string, lead double")
    assert values(queues.lead_distribution(lead, "g", "lead")) == [("a", 5, 5.0, 5.0, 1.0, 9.0, 3.0, 7.0), ("b", 2, 3.0, 3.0, 2.0, 4.0, 2.0, 4.0)]
    v = queues.validation_sample(spark.range(100).select(F.col("id").cast("string").alias("program_id"), (F.col("id") % 3).alias("s"), (F.col("id") > 10).alias("committable")), 4, ["s"])
    assert v.count() == 12 and values(v) == values(queues.validation_sample(v, 4, ["s"]))
    staged = spark.createDataFrame([("a", "1", 0, "yes"), ("b", "1", 1, "no")], "program_id string, timestamp string, position long, is_adc string")
    assert values(queues.promotable(staged, frame(spark, record("a", 1), record("b", 2)))) == [(2, 1, 0.5, False)]
    assert values(queues.attribute_coverage(spark.createDataFrame([("t", "undisclosed"), (None, "x")], "target string, payload string"), ["target", "payload"])) == [("payload", 1, 2, 0.5), ("target", 1, 2, 0.5)]


def test_sponsors_and_targets(spark):
    p = spark.createDataFrame(
        [("a", [("Bio &amp; Co", None), ("Uni", "OTHER")], [("n1", "Bio & Co", ["PHASE3"], 400), ("n2", None, ["PHASE1"], 5)]), ("b", [("Bio & Co", "NETWORK"), ("", "X")], [("n1", "Bio & Co", ["PHASE2", "PHASE3"], 10)])],
        "candidate_id string, sponsors_over_time array<struct<sponsor:string,class:string>>, trials array<struct<nct_id:string,sponsor:string,phases:array<string>,enrollment:int>>",
    )
    index = queues.sponsor_index(p)
    got = {r.sponsor: (r["class"], r.programs, r.trials, r.has_large_phase3, r.phase_counts) for r in index.collect()}
    assert got == {"Bio & Co": ("NETWORK", 2, 1, True, {"PHASE2": 1, "PHASE3": 2}), "Uni": ("OTHER", 1, 0, False, None)}
    assert values(queues.class_candidates(index), "sponsor") == [("Bio & Co",)]
    resolved = spark.createDataFrame([("a", "ERBB2", "stem"), ("b", None, "unresolved"), ("c", None, "unresolved")], "program_id string, target string, source string")
    residual = spark.createDataFrame([("a", "X", "ext"), ("b", "CD22", "ext")], "program_id string, target string, source string")
    assert values(queues.with_residual(resolved, residual)) == [("a", "ERBB2", "stem"), ("b", "CD22", "ext"), ("c", None, "unresolved")]
    names = spark.createDataFrame([("b", "Drug B"), ("c", "drug  c"), ("d", "drug d")], "program_id string, name string")
    steps = [("first", spark.createDataFrame([("drug b", "T1"), ("drug d", "T1"), ("Drug D", "T2")], "name string, target string")), ("second", spark.createDataFrame([("DRUG C", "T3"), ("drug b", "T9")], "name string, target string"))]
    found, funnel = queues.external_funnel(names, names, steps)
    assert values(found, "program_id", "target", "source") == [("b", "T1", "first"), ("c", "T3", "second")] and values(funnel) == [("first", 3, 1), ("second", 2, 1)]


def test_entities(spark):
    m = spark.createDataFrame(
        [("c", "Enhertu 5.4 mg/kg", "n1", "keyword", "A", "INDUSTRY", D(2019, 1, 1), "literal", "adc"), ("c", "trastuzumab deruxtecan", "n2", "seed", "B", None, D(2018, 1, 1), "suffix", "deruxtecan"), ("c", "trastuzumab deruxtecan", "n1", "seed", "A", "OTHER", D(2020, 1, 1), "suffix", "deruxtecan")],
        "cluster string, intervention_name string, nct_id string, strategy string, lead_sponsor string, lead_sponsor_class string, study_start_date date, match_strength string, match_term string",
    )
    r = entities.roll_up(m, "cluster").first()
    assert (r.proposed_name, r.trial_count, r.nct_ids, r.strategies, r.ambiguous, r.dev_code_only) == ("trastuzumab deruxtecan", 2, ["n1", "n2"], ["keyword", "seed"], False, False)
    assert [(s.sponsor, s["class"], s.first_seen) for s in r.sponsors_over_time] == [("A", "INDUSTRY", D(2019, 1, 1)), ("B", None, D(2018, 1, 1))] and (r.discovery_strategy, r.matched_term) == ("keyword", "adc")
    n = spark.createDataFrame([(1, ["ABC-123", "Xvedotin 3 mg", "long name xvedotin"]), (2, ["ABC-123", "Some name 10 mg/m2"])], "id int, n array<string>")
    assert [x.b for x in n.orderBy("id").select(entities.best_name(F.col("n")).alias("b")).collect()] == ["Xvedotin", "Some name"]
    assert spark.range(1).select(entities.evidence_of(F.lit("x vedotin adc")).alias("e")).first().e.term == "vedotin"
    assert values(entities.claims(spark.createDataFrame([("g2", 1), ("g1", 1), ("g1", 2)], "g string, m int"), "g", "m")) == [(1, ["g1", "g2"], 2), (2, ["g1"], 1)]


def test_containment_of_long_names(spark):
    """A name of ten thousand words is expanded into the lengths that occur, not into all its runs."""
    long = " ".join(f"w{i}" for i in range(10_000))
    a = spark.createDataFrame([(long,), ("w5 w6",), ("w5 w7",)], "n string")
    b = spark.createDataFrame([("w77 w78 w79",), ("W5",)], "n string")
    assert values(entities.containment(a, "n", b, "n")) == sorted([("w5 w6", "w5"), ("w5 w7", "w5"), (long, "w5"), (long, "w77 w78 w79")], key=str)


def test_costs(spark):
    v = spark.createDataFrame([("NCT1", 1, D(2020, 2, 1), ["PHASE1"], 50, D(2020, 1, 1)), ("NCT1", 2, D(2020, 8, 1), ["PHASE1", "PHASE2"], 100, D(2020, 1, 1))], "nct_id string, version int, posted_date date, phases array<string>, enrollment int, start_date date")
    m = spark.createDataFrame([("p", "NCT1"), ("p", "NCT1")], "program_id string, nct_id string")
    got = {r.as_of: r.cost_index for r in finance.monthly_cost(v, m, "program_id", "nct_id", F.lit(D(2020, 9, 1))).collect()}
    assert got[D(2020, 9, 1)] == pytest.approx(11.2 * 100 * (D(2020, 9, 1) - D(2020, 1, 1)).days / 30.44) and got[D(2020, 5, 1)] == pytest.approx(4.5 * 50 * 121 / 30.44)
    c = spark.createDataFrame([("p", ["PHASE2"], 100, D(2020, 1, 1), 16), ("q", ["PHASE2"], 100, D(2020, 1, 1), None), ("r", ["PHASE2"], 100, D(2021, 1, 1), 4)], "program_id string, phases array<string>, enrollment int, start_date date, sites int")
    snap = {r.program_id: (r.cost_index, r.site_count) for r in finance.cost_snapshot(c, "program_id", F.lit(D(2020, 9, 1))).collect()}
    base = 11.2 * 100 * 244 / 30.44
    assert snap["p"] == (pytest.approx(4 * base), 16) and snap["q"] == (pytest.approx(base), None) and snap["r"][0] == 0
    spend = spark.createDataFrame([("a", D(2021, 1, 1), "PHASE2", 300.0), ("b", D(2021, 1, 1), "PHASE2", 100.0), ("c", D(2021, 1, 1), "PHASE2", 100.0), ("d", D(2021, 1, 1), "PHASE1", 50.0), ("e", D(2021, 1, 1), "PHASE2", 0.0)], "program_id string, month date, phase string, spend double")
    got = {r.program_id: (r.peers, r.peer_median, r.ratio) for r in finance.conviction(spend, ["phase"], "program_id", "month", "spend").collect()}
    assert got["a"] == (2, 100.0, 3.0) and got["d"] == (0, None, None) and "e" not in got
    panel = spark.createDataFrame([("p", 1), ("p", 2)], "program_id string, month int")
    assert values(finance.exact_month(panel, spark.createDataFrame([("p", 2, 2.5)], "program_id string, month int, r double"), "program_id", "month", "r")) == [("p", 1, None), ("p", 2, 2.5)]
    s = spark.createDataFrame([("futility", 100.0), ("futility", 300.0), ("portfolio", 10.0), ("portfolio", None)], "r string, v double")
    got = {r.r: (r.n, r.n_with_data, r.median, r.q1, r.q3) for r in finance.spend_by_reason(s, "r", "v").collect()}
    assert got == {"futility": (2, 2, 200.0, 150.0, 250.0), "portfolio": (2, 1, 10.0, None, None)}


def test_hot_group_of_ratios(spark):
    """A group with most rows, ties and rows without a value or group, against all pairs."""
    rnd = random.Random(7)
    rows = [(i, "hot" if i < 80 else rnd.choice(["x", "y", None]), rnd.choice([0.0, 1.0, 2.0, 3.5, 8.0, None, -1.0])) for i in range(110)]
    got = {r.id: (r.peers, r.peer_median) for r in stats.leave_one_out_ratio(spark.createDataFrame(rows, "id int, g string, v double"), ["g"], "id", "v").collect()}
    for i, g, _ in rows:
        peers = [v for k, h, v in rows if h == g and g is not None and k != i and v is not None and v > 0]
        assert got[i] == (len(peers), statistics.median(peers) if len(peers) >= 2 else None)


def test_scopes_and_scores(spark):
    ids = spark.createDataFrame([(1, ["D001943"]), (2, ["D006402"]), (3, ["D001943", "D006402"]), (4, []), (5, ["zzz"]), (6, ["D009369"]), (7, None), (8, ["D006402", "zzz"])], "id int, mesh_ids array<string>")
    got = [r.s for r in ids.orderBy("id").select(scoring.trial_scope(F.col("mesh_ids")).alias("s")).collect()]
    assert got == ["solid", "heme", "mixed", "no_data", "unresolved", "generic_basket", "no_data", "unresolved"]
    t = ids.withColumn("program", F.when(F.col("id") == 2, "h").otherwise("o"))
    assert ("asset", "heme_only", 1, 1) in values(programs.scope_counts(t, "program"), "level", "scope", "n", "with_mesh")
    one = spark.range(1).select(
        scoring.asset_scope(F.array()).alias("a"), scoring.highest_phase(F.array(F.lit("PHASE1"), F.lit("NA"), F.lit("PHASE3"))).alias("p"), scoring.site_factor(F.lit(9)).alias("f"), scoring.site_factor(F.lit(None).cast("int")).alias("g"),
        scoring.amendment_cadence(F.lit(4), F.lit(D(2020, 1, 1)), F.lit(D(2022, 1, 1))).alias("c"), scoring.text_system(F.lit("Advanced Breast Cancer")).alias("s"), scoring.text_system(F.lit("x")).alias("n"),
        programs.only_country(F.array(F.lit("China"), F.lit("China")), "China").alias("o"), programs.only_country(F.array().cast("array<string>"), "China").alias("q"), programs.auto_scope(F.lit("heme_only")).alias("h"), programs.auto_scope(F.lit("x")).alias("i"),
        programs.accuracy_against_ceiling(F.lit(0.6), F.lit(0.8)).alias("r"), X.estimate_tokens(F.lit("a" * 41)).alias("t"), X.estimate_tokens(F.lit("")).alias("u"), F.length(X.custom_id(F.lit("x" * 500))).alias("l"),
    ).first()
    assert (one.a, one.p, one.f, one.g, one.s, one.n) == ("needs_review", "PHASE3", 3.0, 1.0, "breast", None) and one.c == pytest.approx(4 / (731 / 365.25))
    assert (one.o, one.q, one.h.scope_reason, one.i, one.t, one.u, one.l) == (True, False, "heme_only", None, 10, 1, 34) and one.r == pytest.approx(0.75)
    s = spark.createDataFrame([(1, [("A", "INDUSTRY")]), (2, [("A", "INDUSTRY"), ("B", "OTHER")]), (3, []), (4, [("B", None)])], "id int, s array<struct<sponsor:string,class:string>>")
    flags = scoring.any_sponsor(F.col("s"))
    assert [tuple(r) for r in s.orderBy("id").select(*flags).collect()] == [(False, True, False), (True, False, False), (False, False, False), (True, False, True)]
    day = F.lit(D(2021, 1, 1))
    parts = spark.range(1).select(
        scoring.staleness(F.lit("RECRUITING"), F.lit(None).cast("string"), F.lit(D(2020, 1, 2)), day).alias("a"), scoring.staleness(F.lit("TERMINATED"), F.lit("lack of efficacy was shown"), F.lit(D(2020, 1, 2)), day).alias("b"),
        scoring.staleness(F.lit("X"), F.lit(None).cast("string"), F.lit(None).cast("date"), day).alias("c"), scoring.verification_lapse(F.lit("RECRUITING"), F.lit(D(2020, 7, 2)), day).alias("d"), scoring.verification_lapse(F.lit("COMPLETED"), F.lit(D(2010, 7, 2)), day).alias("e"),
    ).first()
    assert parts.a == pytest.approx(1 - np.exp(-1)) and parts.b == pytest.approx(0.3 * (1 - np.exp(-1))) and parts.c == 0.5 and parts.d == pytest.approx(183 / 365) and parts.e == 0


def test_text_answers(spark):
    one = spark.range(1).select(
        X.grounds_yes(F.lit("linked to MMAE")).alias("a"), X.grounds_yes(F.lit(" ")).alias("b"), X.grounds_no(F.lit("given orally")).alias("c"), X.grounds_no(F.lit("a bispecific antibody conjugate")).alias("d"),
        X.extract_json(F.lit('text {"a": 1} more'), "a int").alias("e"), X.extract_json(F.lit("[{\"a\": 2}]"), "array<struct<a:int>>", True).alias("f"), X.extract_json(F.lit("none"), "a int").alias("g"),
        X.name_matches(F.lit("Acme Inc. of Basel"), ["acme", "cme", "inc.", "bas"]).alias("h"), X.confidence_label(F.lit(True), F.array(F.lit("y"), F.lit("y"), F.lit("n"))).alias("i"), X.confidence_label(F.lit(True), F.array(F.lit("y"), F.lit("n"))).alias("j"),
        X.confidence_label(F.lit(False), F.array(F.lit("y"))).alias("k"), X.evidence_source(F.lit(False), F.lit("q")).alias("l"), X.is_vague(F.lit("sponsor decision")).alias("m"), X.is_vague(F.lit("no benefit was found at the interim analysis")).alias("n"),
        X.mentions(F.lit("The ABC-1234 arm"), F.array(F.lit("ABC-1234/foo"))).alias("o"), X.is_untrusted_key(F.lit("adc")).alias("p"), X.names_many_compounds(F.lit("xvedotin + ABC-123")).alias("q"), X.stem_target(F.array(F.lit("x"), F.lit("Sacituzumab y"))).alias("r"),
        X.targets_in(F.lit("binds HER2 and CD22")).alias("s"),
    ).first()
    assert (one.a, one.b, one.c, one.d, one.e.a, one.f[0].a, one.g) == (True, False, True, False, 1, 2, None)
    assert (one.h, one.i, one.j, one.k, one.l, one.m, one.n, one.o, one.p, one.q, one.r, one.s) == (["acme", "inc."], "escalated-and-resolved", "escalated-and-split", "unanimous", "text", True, False, True, True, True, "TACSTD2", ["ERBB2", "CD22"])


def test_studies_and_selections(spark):
    text = json.loads(body())
    text = text.get("study", text)
    text["protocolSection"]["armsInterventionsModule"]["interventions"] = [{"name": "A", "type": "DRUG", "otherNames": ["B"]}, {"name": "C", "type": "PROCEDURE"}]
    s = spark.createDataFrame([("n1", json.dumps(text)), ("n2", json.dumps({"study": text}))], "nct_id string, raw string").withColumn("study", snapshots.parse_study(F.col("raw")))
    assert values(programs.interventions(s), "nct_id", "intervention_name") == [("n1", "A"), ("n2", "A")]
    rows = spark.createDataFrame([(1, ["x"]), (2, [" "]), (3, []), (4, None)], "id int, s array<string>")
    has, lacks = programs.by_text_evidence(rows, "s")
    assert values(has, "id") == [(1,)] and values(lacks, "id") == [(2,), (3,), (4,)]
    d = spark.createDataFrame([(1, 2, "yes", None), (2, 1, "yes", None), (3, 3, "unsure", None), (4, 3, "no", True)], "id int, layer int, is_adc string, manual_overflow boolean")
    assert values(programs.decided_later(d), "id") == [(1,)]
    sp = spark.createDataFrame([("a", [("S", "2020")])], "program_id string, sponsors_over_time array<struct<sponsor:string,last_seen:string>>")
    assert values(programs.with_sponsor(spark.createDataFrame([("a",), ("b",)], "program_id string"), sp)) == [("a", "S"), ("b", "UNKNOWN")]
    t = programs.timeline(spark.createDataFrame([("p", D(2020, 1, 1), "x", "1"), ("p", None, "y", "2")], "program_id string, date date, kind string, detail string"), "program_id").first().timeline
    assert [x.kind for x in t] == ["y", "x"]
    st = spark.createDataFrame([("a", 1, "t"), ("b", 1, "t"), ("c", None, "t")], "program_id string, band int, primary_archetype string")
    assert values(programs.stratum_progress(st, spark.createDataFrame([("a",), ("a",)], "program_id string"))) == [(1, "t", 2, 1)]
    tr = spark.createDataFrame([("no", None, True, "denylist:x"), ("no", None, True, "denylist:y"), (None, None, False, None)], "is_adc string, in_scope string, committable boolean, rule string")
    assert ("no", None, True, "denylist", 2) in values(programs.triage_summary(tr))
    assert values(programs.unknown_values(spark.createDataFrame([(["a", "b"],), (["c"],)], "v array<string>"), "v", ["a"])) == [("b",), ("c",)]
    u = programs.union_strategies({"k": spark.createDataFrame([(1,)], "id int"), "s": spark.createDataFrame([(2, "x")], "id int, more string")})
    assert values(u, "id", "more", "strategy") == [(1, None, "k"), (2, "x", "s")]
    assert values(programs.recovery(spark.createDataFrame([("A ",), ("b",)], "n string"), spark.createDataFrame([("a",)], "n string"), "n")) == [(2, 1)]
    panel = spark.createDataFrame([("p", D(2021, m, 1)) for m in range(1, 9)], "program_id string, as_of date")
    out = spark.createDataFrame([("p", "dead", D(2021, 6, 15))], "program_id string, outcome string, event_month date")
    assert programs.panels_after(panel, out, F.lit(D(2021, 3, 1)), F.lit(D(2022, 1, 1))).count() == 4
    assert values(programs.status_base_rate(spark.createDataFrame([("g", "UNKNOWN"), ("g", "x"), ("h", "x")], "g string, status string"), "g")) == [("g", 2, 1, 0.5), ("h", 1, 0, 0.0)]
    b = spark.createDataFrame([("p", ["ABCD"], f"n{k}", ["about abcd", "else", "ABCD again"]) for k in range(5)], "program_id string, names array<string>, nct_id string, snippets array<string>")
    assert programs.evidence_bundle(b, "program_id", "names").first().evidence == ["about abcd", "ABCD again"] * 2 + ["about abcd"]
    c = spark.createDataFrame([("a", [("S", "INDUSTRY")], D(2005, 1, 1), False, ["n1"], ["k"], False), ("b", [("S", "OTHER")], D(1990, 1, 1), True, ["n1", "n2"], ["k", "s"], True), ("c", [], None, False, [], ["k"], True)], "candidate_id string, sponsors_over_time array<struct<sponsor:string,class:string>>, first_start date, ambiguous boolean, nct_ids array<string>, strategies array<string>, dev_code_only boolean")
    assert values(programs.extension_cohort(c, spark.createDataFrame([("c",)], "candidate_id string")), "candidate_id", "excluded_for") == [("a", []), ("b", ["not_all_industry", "too_early", "ambiguous"])]
    assert values(programs.evidenced_trials(c, c.limit(0))) == [("n1",), ("n2",)] and values(programs.discovery_flags(c)) == [(3, 2, 1, 2)]
    f = spark.createDataFrame([("yes", False, "MMAE"), ("yes", False, "x"), ("no", True, None)], "is_adc string, from_recall boolean, quote string")
    assert values(programs.feasibility(f, 2)) == [("no", "recall", 1, False), ("yes", "text", 2, True)]
    results = spark.createDataFrame([("a", True), ("b", True), ("c", True), ("d", False)], "program_id string, committable boolean")
    assert values(programs.commit_candidates(results, frame(spark, record("a", 1)), spark.createDataFrame([("b",)], "program_id string")), "program_id") == [("c",)]


def test_interval_widths(spark):
    rows = spark.createDataFrame([(i, f"s{i % 7}", float(i % 5)) for i in range(40)], "i int, sponsor string, days double")
    got = programs.interval_widths(rows, ["i"], "sponsor", "days", [10, 20, 40])
    for n, width in got:
        one = stats.cluster_bootstrap(rows.where(f"i < {n}"), "sponsor", F.col("days"), F.lit(1.0), resamples=500).first()
        assert width == pytest.approx(one.high - one.low, abs=1.0) and width > 0


def test_sources(spark, tmp_path):
    log = f"{tmp_path}/log"
    staged = spark.createDataFrame([("a", "auto"), ("b", "auto")], "program_id string, labeller string")
    snapshots.append_log(staged, log, reviewed=spark.createDataFrame([("a",)], "program_id string"), only_auto=True)
    snapshots.append_log(staged.where("program_id = 'a'"), log)
    assert values(snapshots.read_log(spark, log, "program_id string, labeller string")) == [("a", "auto"), ("b", "auto")]
    with pytest.raises(Exception, match="only automatic"):
        snapshots.append_log(staged.withColumn("labeller", F.lit("me")), log, only_auto=True)
    facts = spark.createDataFrame([("t", 1), ("u", 2)], "event_type string, n int")
    for _ in range(2):
        snapshots.append_facts(facts, f"{tmp_path}/facts")
    assert spark.read.parquet(f"{tmp_path}/facts").where("event_type = 't'").count() == 2
    assert [snapshots.replace_table(facts.where(f"n <= {n}"), f"{tmp_path}/table").count() for n in (2, 1)] == [2, 1]
    stored = spark.createDataFrame([("s", "b"), ("s", "a"), ("s", "a"), ("x", "c")], "source string, id string")
    assert [r.id for r in snapshots.all_ids(stored, "s").collect()] == ["a", "b"]
    (tmp_path / "names.txt").write_text("# comment\n\nAbc | DEF\nghi\n")
    assert values(snapshots.read_name_list(spark, f"{tmp_path}/names.txt"), "name") == [("abc",), ("def",), ("ghi",)]
    table = snapshots.markdown_table(facts.orderBy("n"), "T")
    assert table == "## T\n\n| event_type | n |\n|---|---|\n| t | 1 |\n| u | 2 |\n"
    (tmp_path / "t.md").write_text(table)
    assert values(snapshots.read_markdown_table(spark, f"{tmp_path}/t.md", ["event_type", "n"])) == [("t", "1"), ("u", "2")]
    with pytest.raises(ValueError):
        snapshots.markdown_table(spark.range(3000), "long")
    snapshots.write_csv(spark.createDataFrame([(1, ["a", "b"])], "id int, l array<string>"), f"{tmp_path}/csv")
    assert values(spark.read.option("header", "true").csv(f"{tmp_path}/csv")) == [("1", "a; b")]
    e = spark.createDataFrame([("n2", 1, 2, "x", "f", "a", "b"), ("n1", 1, 2, "x", "f", "a", "b")], "nct_id string, from_version int, to_version int, event_type string, field string, to_value string, from_value string")
    assert values(snapshots.event_table(e), "event_id", "nct_id") == [(0, "n1"), (1, "n2")]
    counts = ingest.daily_counts(spark.createDataFrame([("s", dt.datetime(2024, 1, 1, 5)), ("s", dt.datetime(2024, 1, 1, 6)), ("s", dt.datetime(2024, 1, 2, 6))], "source string, fetched_at timestamp"))
    assert sorted(r.n for r in counts.collect()) == [1, 2]


def test_survival_tables(spark):
    p = spark.createDataFrame([("d", []), ("u", []), ("s", [("ACTUAL", "2022-03-01"), ("ACTUAL", "2021-05-01"), ("ESTIMATED", "2020-01-01")]), ("a", [])], "program_id string, trials array<struct<primary_completion_type:string,primary_completion_date:string>>")
    lab = spark.createDataFrame([("d", "dead_confirmed", "2021-02-03"), ("u", "dead_confirmed", None), ("s", "superseded", None), ("a", "active", None)], "program_id string, status string, public_confirmation_date string")
    end = F.lit(D(2023, 1, 1))
    assert values(survival.outcomes(p, lab, end)) == [("a", "censored", D(2023, 1, 1)), ("d", "dead", D(2021, 2, 3)), ("s", "superseded", D(2021, 5, 1)), ("u", "censored", D(2023, 1, 1))]
    preds = spark.createDataFrame([(0.05,), (float("nan"),), (0.02,), (float("nan"),), (None,), (0.0500000001,)], "p double")
    assert sorted(r.threshold for r in survival.thresholds(preds, "p").collect()) == [0.02, 0.05]
    pts = "threshold double, n_flagged long, n_correct long, precision double, recall double, median_lead_days double"
    good = spark.createDataFrame([(0.1, 4, 2, 0.5, 1.0, -30.0), (0.2, 2, 2, 1.0, 0.9, -30.0), (0.3, 9, 1, 0.1, 1.0, -90.0)], pts)
    late = spark.createDataFrame([(0.1, 4, 4, 1.0, 1.0, -10.0)], pts)
    none = spark.createDataFrame([(0.1, 4, 0, 0.0, 0.0, None)], pts)
    assert survival.best_point(good).first().threshold == 0.2
    assert [survival.gate(a, b)[0] for a, b in ((good, late), (late, good), (none, late), (good, none), (none, none))] == [True, False, False, True, False]
    curve = stats.kaplan_meier(spark.createDataFrame([("g", 1, True), ("g", 2, True), ("g", 3, False), ("h", 1, False)], "g string, t int, e boolean"), "g", "t", F.col("e"))
    assert values(stats.median_survival(curve, "g", "t")) == [("g", 2), ("h", None)]
    r = stats.ols_residuals(spark.createDataFrame([(1.0, 3.0), (2.0, 5.0), (3.0, 7.5)], "x double, y double"), "y", "x")
    assert sum(x.residual for x in r.collect()) == pytest.approx(0, abs=1e-9)


@pytest.mark.parametrize("few", [10**6, 0])
def test_flags_with_many_thresholds(spark, monkeypatch, few):
    monkeypatch.setattr(survival, "FEW_CUTS", few)
    rnd = random.Random(1)
    rows = [(f"p{i % 5}", D(2020, 1, 1) + dt.timedelta(days=i), rnd.choice([None, float("nan"), rnd.random() * 3])) for i in range(100)]
    cuts = sorted({round(rnd.random() * 3, 2) for _ in range(30)} | {-0.5, 0.0})
    got = {(r.program_id, r.threshold): r.flag_date for r in survival.flags(spark.createDataFrame(rows, "program_id string, as_of date, s double"), "s", spark.createDataFrame([(c,) for c in cuts], "threshold double")).collect()}
    want = {}
    for p, d, s in rows:
        for c in cuts:
            if s is not None and s == s and s >= c:
                want[p, c] = min(want.get((p, c), d), d)
    assert got == want


def test_mixture_hazard_and_components_against_numpy(spark):
    rnd = np.random.RandomState(4)
    x = np.concatenate([rnd.normal(0, 1, 150), rnd.normal(8, 2, 100)])
    g = stats.gaussian_mixture(spark.createDataFrame([(float(v),) for v in x], "x double"), "x")
    w, m, v = np.array([0.5, 0.5]), np.quantile(x, [0.25, 0.75]), np.full(2, x.var() / 2)
    for _ in range(g["rounds"]):
        dens = w * np.exp(-((x[:, None] - m) ** 2) / (2 * v)) / np.sqrt(2 * np.pi * v)
        r = dens / dens.sum(1, keepdims=True)
        w, m = r.mean(0), (r * x[:, None]).sum(0) / r.sum(0)
        v = (r * (x[:, None] - m) ** 2).sum(0) / r.sum(0)
    assert np.allclose(sorted(g["components"]), sorted(zip(w, m, v, strict=True)), rtol=1e-4) and g["ashman_d"] > 3
    e = rnd.normal(size=(200, 3))
    e[:, 2] += e[:, 0]
    p = stats.correlation_pca(spark.createDataFrame(e.tolist(), "a double, b double, c double"), ["a", "b", "c"])
    want = np.linalg.eigvalsh(np.corrcoef(e.T))[::-1]
    assert np.allclose(p["eigenvalues"], want) and p["condition"] == pytest.approx(want[0] / want[-1])
    z = rnd.normal(size=400)
    y = (rnd.random(400) < 1 / (1 + np.exp(-(z - 0.5)))).astype(int)
    h = survival.fit_hazard(spark.createDataFrame([(int(a), f"s{i % 20}", float(b)) for i, (a, b) in enumerate(zip(y, z, strict=True))], "event int, sponsor string, z double"), "event", covariates=("z",))
    d, beta = np.column_stack([np.ones(400), z]), np.zeros(2)
    for _ in range(30):
        mu = 1 / (1 + np.exp(-d @ beta))
        beta += np.linalg.solve(d.T @ (d * (mu * (1 - mu))[:, None]), d.T @ (y - mu))
    bread = np.linalg.inv(d.T @ (d * (mu * (1 - mu))[:, None]))
    s = np.array([(d * (y - mu)[:, None])[np.arange(400) % 20 == k].sum(0) for k in range(20)])
    assert np.allclose(h.coefficients, beta, atol=1e-6) and np.allclose(h.errors, np.sqrt(np.diag(bread @ (s.T @ s) @ bread * 20 / 19)), rtol=1e-4)


def test_bootstrap_is_wide_for_few_clusters(spark):
    rows = spark.createDataFrame([("a", 1.0)] * 30 + [("b", 0.0)] * 30, "c string, v double")
    ci = stats.cluster_bootstrap(rows, "c", F.col("v"), F.lit(1.0)).first()
    assert (ci.estimate, ci.clusters, ci.low, ci.high) == (0.5, 2, 0.0, 1.0)


def test_back_test_from_end_to_end(spark):
    """Outcomes, training table, hazard, flags, curves and gate over one small portfolio whose silent programs die."""
    rnd = random.Random(9)
    panel, outs = [], []
    for k in range(40):
        dies = k % 2 == 0
        death = D(2022, 1 + k % 12, 1)
        outs.append((f"p{k:02d}", "dead_confirmed" if dies else "active", str(death) if dies else None))
        for m in range(48):
            day = D(2019 + m // 12, 1 + m % 12, 1)
            near = max(0, 12 - (death.year - day.year) * 12 - (death.month - day.month)) if dies else 0
            panel.append((f"p{k:02d}", f"s{k % 7}", day, float(20 + 6 * near + rnd.randint(-3, 3)), float(rnd.randint(1, 50)), 1.0 + rnd.random()))
    panel = spark.createDataFrame(panel, "program_id string, sponsor string, as_of date, silence_score_asof double, cost_index double, conviction_ratio double").cache()
    progs = panel.select("program_id").distinct().withColumn("trials", F.array().cast("array<struct<primary_completion_type:string,primary_completion_date:string>>"))
    end = F.lit(D(2022, 12, 1))
    out = survival.outcomes(progs, spark.createDataFrame(outs, "program_id string, status string, public_confirmation_date string"), end)
    table = survival.training_table(panel, out, end)
    hazard = survival.fit_hazard(table, "event_dead")
    assert hazard.events == 20 and hazard.coefficients[1] > 0
    scored = programs.panels_after(table.select("program_id", "as_of", *hazard.covariates), out, F.lit(D(2021, 1, 1)), end).withColumn("p", hazard.column())
    cuts = survival.thresholds(scored, "p")
    model = survival.curve(survival.flags(scored, "p", cuts), out, cuts)
    rule_cuts = spark.createDataFrame([(20.0,), (90.0,)], "threshold double")
    rule = survival.curve(survival.flags(scored, "silence_score_asof", rule_cuts), out, rule_cuts)
    best = survival.best_point(model).first()
    assert best.precision >= 0.5 and best.median_lead_days < 0
    passed, why = survival.gate(model, rule)
    assert isinstance(passed, bool) and "median lead" in why
    # nothing behind the cut is used: events after it are censored
    early = survival.training_table(panel, out, F.lit(D(2022, 3, 1)))
    assert early.agg(F.sum("event_dead")).first()[0] == sum(1 for _, s, d in outs if d and d <= "2022-03-01")


def levels(df):
    return {r.name: r.level for r in df.collect()}


def test_audit_provenance(spark):
    rows = [("s", "a", D(2024, 1, 1), "x"), ("s", "a", D(2024, 1, 5), "y"), ("s", "b", D(2024, 1, 1), "z")]
    disk = spark.createDataFrame(rows, "source string, id string, snapshot_date date, body string").withColumn("sha256", F.sha2("body", 256))
    assert set(levels(audit.provenance(disk, disk.drop("body"))).values()) == {"PASS"}
    bad = disk.withColumn("sha256", F.when(F.col("id") == "b", "0").otherwise(F.col("sha256")))
    got = levels(audit.provenance(bad, disk.where("body <> 'y'").unionByName(disk.limit(1).withColumn("id", F.lit("q")))))
    assert sorted(got.values()) == ["FAIL", "FAIL", "FAIL", "PASS"]
    probe = audit.as_of_probe(disk).first()
    assert (probe.level, probe.detail) == ("PASS", "of 3")


def test_audit_universe(spark):
    c = spark.createDataFrame([("c1", "Enapotamab vedotin (HuMax)", ["x"], ["n1", "n2"], ["keyword"], "reviewed"), ("c2", "dev-1", None, ["n1"], ["sponsor_expansion"], "unreviewed"), ("c3", "none", [], [], ["keyword"], "reviewed")], "candidate_id string, proposed_name string, synonyms array<string>, nct_ids array<string>, strategies array<string>, review_status string")
    known = spark.createDataFrame([("k1", "enapotamab vedotin"), ("k1", "other"), ("k2", "missing one")], "asset string, name string")
    trials = spark.createDataFrame([(["a"],), ([],)], "mesh_ids array<string>")
    scored = spark.createDataFrame([(1,), (1,), (2,), (None,)], "silence_score int")
    got = levels(audit.universe(c, known, spark.createDataFrame([("Other",)], "name string"), trials, scored))
    assert got == {
        "known assets are found": "WARN", "known names are not only the seeds": "PASS", "candidates have trials": "WARN", "shared trials are claimed by verified candidates": "WARN", "candidates are reviewed": "FAIL",
        "trials have condition identifiers": "WARN", "no score is a dead zone": "WARN",
    }
    circular = levels(audit.universe(c, known, known.select("name"), trials, scored.limit(0)))
    assert circular["known names are not only the seeds"] == "WARN" and circular["no score is a dead zone"] == "INFO"


def test_audit_history_and_changes(spark):
    v = spark.createDataFrame([("n", 0, D(2020, 1, 1), body()), ("n", 1, D(2020, 2, 1), body(status="TERMINATED")), ("m", 0, D(2020, 1, 1), body()), ("m", 2, D(2019, 1, 1), body())], "nct_id string, version int, posted_date date, raw string").withColumn("body", snapshots.parse_study(F.col("raw")))
    q = spark.createDataFrame([("n", "done"), ("m", "error")], "nct_id string, status string")
    assert list(levels(audit.history(v, q)).values()) == ["FAIL", "WARN", "PASS", "WARN"]
    events = differ.diff_studies(differ.version_pairs(v, "nct_id", "version", "posted_date", "body"), "nct_id")
    same = differ.diff_studies(differ.version_pairs(v, "nct_id", "version", "posted_date", "body").withColumn("prev", F.col("curr")), "nct_id")
    assert events.count() and set(levels(audit.changes(events, v, same)).values()) == {"PASS"}
    assert set(levels(audit.changes(events.withColumn("event_date", F.lit(D(1999, 1, 1))), v, events)).values()) == {"FAIL"}
    assert differ.boundary_violations(events, v, "nct_id", "version", "posted_date").count() == 0


def test_audit_gold_set(spark):
    p = spark.createDataFrame([("a", 1, "t"), ("b", 2, "t")], "program_id string, band int, primary_archetype string")
    fine = frame(spark, record("a", 1, status="dead_confirmed", kill_reason="k", label_evidence_date="2020", public_confirmation_date="2020"), record("a", 2, is_repeat_probe=True, status="dead_confirmed", kill_reason="k", label_evidence_date="2020", never_publicly_confirmed=True))
    assert set(levels(audit.gold_set(fine, p)).values()) == {"PASS", "INFO"}
    poor = frame(spark, record("a", 1, status="dead_confirmed", labeller="auto", blind=False, history_coverage_at_serve_time="partial"), record("a", 2, is_repeat_probe=True), record("b", 3, gate_reached=1, status_revised=True))
    got = {r.name: (r.level, r.actual) for r in audit.gold_set(poor, p).collect()}
    assert [got[k][0] for k in ("no record is automatic", "dead programs have a reason", "dead programs have an evidence date", "dead programs have a confirmation date or say that there is none", "evidence was full when served")] == ["FAIL"] * 5
    assert got["labels are blind"] == ("WARN", "1.0") and got["repeats agree with the first label"] == ("WARN", "0.0") and got["labels by gate"] == ("INFO", "1=1, 3=2") and got["strata have labels"][0] == "INFO"
    many = frame(spark, *[record(f"x{i}", 1 + i) for i in range(25)])
    wide = spark.createDataFrame([(f"x{i}", 1, "t") for i in range(25)] + [("z", 3, "t")], "program_id string, band int, primary_archetype string")
    assert levels(audit.gold_set(many, wide))["strata have labels"] == "WARN"


def test_audit_features_and_model(spark):
    panel = spark.createDataFrame([("p", D(2020, 1, 1), D(2020, 1, 1), 1.0), ("p", D(2020, 2, 1), D(2020, 3, 1), float("nan"))], "program_id string, as_of date, knowability_date date, cost_index double")
    got = {r.name: (r.level, r.actual) for r in audit.features(panel, {"cost_index": "posted date"}, ["cost_index"]).collect()}
    assert got == {"features are registered": ("PASS", "1"), "nothing is used before it was known": ("FAIL", "1"), "cost_index is missing": ("INFO", "0.5")}
    assert levels(audit.features(panel, {}, ["cost_index"]))["features are registered"] == "FAIL"
    v = spark.createDataFrame([("n", 1, D(2020, 1, 1)), ("n", 2, D(2021, 1, 1))], "nct_id string, version int, posted_date date")
    assert audit.leakage_probe(v).first().level == "PASS"
    result = lambda *rows: {r.name: (r.level, r.actual) for r in audit.model_gate(spark.createDataFrame([(x,) for x in rows], "body string")).collect()}
    gate = "the model flags earlier than the heuristic at enough precision"
    assert result()[gate] == ("INFO", "not run") and result("no json")[gate][0] == "FAIL"
    good = result('{"gate_passed": true, "training_event_counts": {"dead": 47, "approved": 12}}')
    assert good[gate] == ("PASS", "passed") and good["training events"][1] == "dead=47, approved=12, superseded=0"
    assert result('{"gate_passed": false}')[gate][0] == "FAIL"


def test_audit_stages_stop_at_a_gate(spark):
    ok, bad = spark.range(3), spark.range(2)
    good, fails = audit.none_bad(ok, "a", "fine", F.lit(False)), audit.none_bad(bad, "b", "broken", F.lit(True))
    rows, code = triage.run_stages([("a", True, [good]), ("b", True, [fails]), ("c", False, [good])])
    assert code == 1 and values(rows, "stage", "level") == [("a", "PASS"), ("b", "FAIL")]
    assert triage.run_stages([("a", True, [good])])[1] == 0


def test_source_boundaries():
    """Q4: the history panels don't read current state, and nothing but the training-data operators imports those."""
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "asofly")
    for folder, _, files in os.walk(root):
        for name in files:
            if not name.endswith(".py") or os.path.basename(folder) == "llm":
                continue
            with open(os.path.join(folder, name), encoding="utf-8") as f:
                tree = ast.parse(f.read())
            modules = [n.module or "" for n in ast.walk(tree) if isinstance(n, ast.ImportFrom)] + [a.name for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names]
            assert not any(m.startswith("asofly.llm") for m in modules), name
            for f in ast.walk(tree):
                if isinstance(f, ast.FunctionDef) and f.name in ("monthly_cost", "feature_panel", "training_table", "as_of_month_panel", "money_panel"):
                    used = {n.id for n in ast.walk(f) if isinstance(n, ast.Name)} | {n.attr for n in ast.walk(f) if isinstance(n, ast.Attribute)}
                    assert not used & {"cost_snapshot", "site_factor", "best_snapshot"}, f.name


def test_scratch_is_shared_or_local(spark):
    assert scratch_path(spark, "x").startswith("file:") and temporal.dense_ids(spark.range(3), ["id"], "n").count() == 3
