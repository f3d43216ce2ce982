"""Operators of the evidence engine on small cases with known results."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from asofly.functions import dates, scoring
from asofly.functions import text as X
from asofly.operators import differ, entities, finance, graph, labels, stats, survival, temporal, triage
from asofly.sources import snapshots

D = dt.date


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_partial_dates(spark):
    rows = [("2020-02-30", None), ("2020", D(2020, 1, 1)), ("2020-03", D(2020, 3, 1)), ("2020-03-04", D(2020, 3, 4)), ("x", None), (None, None), ("20-1", None)]
    got = spark.createDataFrame(rows, "t string, d date").select(dates.parse_partial_date("t").alias("p"), "d").collect()
    assert all(r.p == r.d for r in got)


VERSIONS = [("NCT001", 1, D(2020, 2, 1), 50), ("NCT001", 2, D(2020, 8, 1), 100), ("NCT001", 3, D(2020, 8, 1), 110)]


def test_as_of(spark):
    v = spark.createDataFrame(VERSIONS[:2], "nct string, version int, posted date, n int")
    for day, want in (("2020-01-01", None), ("2020-05-01", 50), ("2020-09-01", 100), ("2026-01-01", 100)):
        got = temporal.as_of_point(v, "nct", ["posted", "version"], "posted", F.lit(day).cast("date")).collect()
        assert (got[0].n if got else None) == want


def test_month_panel_equals_loop(spark):
    rnd = random.Random(3)
    rows = sorted({(k, v, D(2019, 1, 1) + dt.timedelta(days=rnd.randint(0, 500)), v * 10) for k in "abc" for v in range(6)})
    end = D(2020, 9, 15)
    v = spark.createDataFrame(rows, "nct string, version int, posted date, n int")
    got = {(r.nct, r.as_of): r.n for r in temporal.as_of_month_panel(v, "nct", "posted", ["version"], F.lit(end)).collect()}
    want = {}
    for k in "abc":
        own = [r for r in rows if r[0] == k]
        m = min(r[2] for r in own).replace(day=1)
        while m <= end:
            held = [r for r in own if r[2] <= m]
            want[k, m] = max(held, key=lambda r: (r[2], r[1]))[3] if held else None
            m = (m + dt.timedelta(days=32)).replace(day=1)
    assert got == want
    # leakage: cutting the input leaves all earlier rows as they are
    cut = temporal.as_of_month_panel(v.where("posted <= '2019-12-31'"), "nct", "posted", ["version"], F.lit(D(2019, 12, 31)))
    assert all(got[r.nct, r.as_of] == r.n for r in cut.collect())


def test_as_of_join_does_not_leak(spark):
    panel = spark.createDataFrame([("p", D(2021, 1, 1), 10.0), ("p", D(2021, 12, 1), 999.0)], "program_id string, event_date date, estimated_cumulative_spend double")
    lab = spark.createDataFrame([("p", D(2021, 6, 1)), ("p", D(2020, 1, 1)), ("p", None), ("q", D(2021, 6, 1))], "program_id string, label_date date")
    got = {(r.program_id, r.label_date): r.estimated_cumulative_spend for r in finance.spend_at_event(lab, panel, "program_id", "label_date").collect()}
    assert got == {("p", D(2021, 6, 1)): 10.0, ("p", D(2020, 1, 1)): None, ("q", D(2021, 6, 1)): None}


def test_money_panel(spark):
    rows = [("p", D(2021, 1, 1), "trial_cost_index", 10.0), ("p", D(2021, 2, 1), "trial_cost_index", 15.0), ("p", D(2021, 3, 1), "trial_cost_index", 5.0), ("p", D(2021, 2, 1), "conviction_ratio", 2.5)]
    got = finance.money_panel(spark.createDataFrame(rows, "subject_id string, event_date date, event_type string, value double")).orderBy("event_date").collect()
    assert [(r.estimated_cumulative_spend, r.conviction_ratio) for r in got] == [(10.0, None), (25.0, 2.5), (30.0, None)]


def test_latest_and_crossing(spark):
    rows = [("a", "2020-01", 1, "x"), ("a", "2020-02", 2, "y"), ("a", "2020-02", 3, "z"), ("b", None, 4, "w")]
    got = {r.k: r.v for r in temporal.latest_by(spark.createDataFrame(rows, "k string, t string, pos int, v string"), "k", "t", "pos").collect()}
    assert got == {"a": "y", "b": "w"}
    nan = spark.createDataFrame([("a", 1, float("nan")), ("a", 2, 0.4), ("b", 1, float("nan"))], "k string, d int, s double")
    assert {r.k: r.flag_date for r in temporal.first_crossing(nan, "k", "d", "s", F.lit(0.3)).collect()} == {"a": 2, "b": None}


def test_global_order(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("x"), F.lit(2).alias("v"))
    assert all(r.i == r.x for r in temporal.dense_ids(df, ["x"], "i").collect())
    assert all(r.s == 2 * r.x for r in temporal.global_running_sum(df, ["x"], "v", "s").collect())
    assert temporal.dense_ids(df.limit(0), ["x"], "i").count() == 0


def test_leave_one_out_equals_loop(spark):
    from statistics import median

    rnd = random.Random(1)
    rows = [(rnd.choice("ab"), i, float(rnd.choice([0, 1, 2, 5, 5, 7, 9]))) for i in range(40)] + [("c", 99, 3.0), ("d", 100, 1.0), ("d", 101, 4.0), ("d", 102, 9.0)]
    got = stats.leave_one_out_ratio(spark.createDataFrame(rows, "g string, id int, x double"), ["g"], "id", "x").collect()
    for r in got:
        peers = [x for g, i, x in rows if g == r.g and i != r.id and x > 0]
        assert r.peers == len(peers)
        assert r.peer_median == (median(peers) if len(peers) >= 2 else None)


def body(status="RECRUITING", phases=("PHASE1",), count=100, kind="ESTIMATED", date="2020-01", dtype="ESTIMATED", arms=("A",)):
    import json

    return json.dumps({"study": {"protocolSection": {
        "statusModule": {"overallStatus": status, "primaryCompletionDateStruct": {"date": date, "type": dtype}}, "designModule": {"phases": list(phases), "enrollmentInfo": {"count": count, "type": kind}},
        "armsInterventionsModule": {"armGroups": [{"label": a} for a in arms]},
    }}})


@pytest.mark.parametrize(
    "change,want",
    [
        ({}, []), ({"status": "TERMINATED"}, ["status_changed"]), ({"kind": "ACTUAL", "count": 90}, ["enrollment_finalized"]), ({"dtype": "ACTUAL", "date": "2020-02"}, ["primary_completion_date_finalized"]),
        ({"count": 120}, ["enrollment_changed"]), ({"phases": ["PHASE1", "PHASE2"]}, ["phase_changed"]), ({"arms": ["A", "B"]}, ["arm_added"]), ({"arms": []}, ["arm_removed"]), ({"date": "2021-01"}, ["primary_completion_date_changed"]),
    ],
)
def test_differ(spark, change, want):
    rows = [("n", 1, D(2020, 1, 1), body()), ("n", 2, D(2020, 2, 1), None), ("n", 3, D(2020, 3, 1), body(**change))]
    v = spark.createDataFrame(rows, "nct_id string, version int, posted date, raw string").withColumn("study", snapshots.parse_study(F.col("raw")))
    pairs = differ.version_pairs(v, "nct_id", "version", "posted", "study")
    events = differ.diff_studies(pairs, "nct_id").collect()
    assert [e.event_type for e in events] == want
    assert all((e.from_version, e.to_version, e.event_date) == (1, 3, D(2020, 3, 1)) for e in events)


def test_reopened(spark):
    rows = [("n", 1, D(2020, 1, 1), body(dtype="ACTUAL", kind="ACTUAL")), ("n", 2, D(2020, 2, 1), body())]
    v = spark.createDataFrame(rows, "nct_id string, version int, posted date, raw string").withColumn("study", snapshots.parse_study(F.col("raw")))
    events = differ.diff_studies(differ.version_pairs(v, "nct_id", "version", "posted", "study"), "nct_id").collect()
    assert [(e.event_type, e.direction) for e in events] == [("trial_reopened", None)] * 2


def test_text_rules(spark):
    reasons = [(None, None), ("", None), ("N/A", None), ("lack of efficacy at interim", "futility_efficacy"), ("dose-limiting toxicity seen", "toxicity_safety"), ("strategic portfolio review", "strategic_portfolio"), ("slow recruitment of patients", "accrual_failure"), ("sponsor became insolvent", "funding_insolvency"), ("no reason was ever given", "unknown_silent")]
    assert all(r.got == r.want for r in spark.createDataFrame(reasons, "r string, want string").select(X.stated_reason("r").alias("got"), "want").collect())
    r = one(
        spark, code=X.looks_like_dev_code(F.lit("SKB410 for injection")), plain=X.looks_like_dev_code(F.lit("trastuzumab")), deny=X.is_denylisted(F.lit("Trastuzumab (Herceptin)")), suffix=X.match_pattern(F.lit("X Vedotin conjugate")), lit=X.match_pattern(F.lit("an ADC")),
        none=X.match_pattern(F.lit("adcx")), cut=X.truncate_at_word(F.lit("alpha beta gamma"), 13), html=X.unescape_html(F.lit("A &amp;amp; B &lt;")), tokens=X.name_tokens(F.array(F.lit("Abcd / XL1 ; io"))), payload=X.payload_class(F.array(F.lit("a"), F.lit("b emtansine"))),
        yes=X.grounds_yes(F.lit("a DXd payload")), no=X.grounds_no(F.lit("Oral tablet")), mab=X.grounds_no(F.lit("a monoclonal antibody")), adc=X.grounds_no(F.lit("monoclonal antibody with linker")), maj=X.strict_majority(F.array(*map(F.lit, "aab"))), tie=X.strict_majority(F.array(*map(F.lit, "aabb"))),
        quote=X.verify_quote(F.lit("b  c"), F.lit("a b\nc d")), blank=X.verify_quote(F.lit(" "), F.lit("x")), js=X.extract_json(F.lit('so: {"a": 1} ok'), "a int"),
    )
    assert r.code and not r.plain and r.deny and r.suffix.term == "vedotin" and r.lit.strength == "literal" and r.none is None
    assert r.cut == "alpha beta" and r.html == "A &amp; B <" and r.tokens == ["abcd / xl1 ; io", "abcd", "xl1"] and r.payload == "maytansinoid"
    assert r.yes and r.no and r.mab and not r.adc and r.maj == "a" and r.tie is None and r.quote and not r.blank and r.js.a == 1


TRIAL = "array<struct<status:string,why_stopped:string,last_update:date,verified:date,completion:date,has_results:boolean,enrollment_type:string,amended:array<date>>>"


def test_silence(spark):
    def trial(status, update=None, why=None, enrollment="ACTUAL"):
        return (status, why, update, None, None, True, enrollment, [])

    rows = [(0, []), (1, [trial("COMPLETED", D(2018, 1, 1))]), (2, [trial("COMPLETED", D(2024, 1, 1))]), (3, [trial("TERMINATED", D(2018, 1, 1), "stopped for a clearly stated safety reason")]), (4, [trial("TERMINATED", D(2018, 1, 1))]), (5, [trial("UNKNOWN", D(2024, 6, 1))])]
    df = spark.createDataFrame(rows, f"id int, trials {TRIAL}").select("id", scoring.program_score(F.col("trials"), F.lit(D(2024, 6, 1))).alias("s"), scoring.primary_archetype(scoring.archetypes(F.col("trials"), F.lit(D(2024, 6, 1)))).alias("a"))
    s = {r.id: (r.s, r.a) for r in df.collect()}
    assert s[0] == (None, "other") and s[1][0] > s[2][0] and s[3][0] < s[4][0] and s[5] == (27, "unknown_status")
    assert s[3][1] == "registry_terminated_stated_reason" and s[4][1] == "registry_terminated_vague_reason"
    r = one(spark, a=scoring.band(F.lit(100)), b=scoring.band(F.lit(20)), c=scoring.program_coverage(F.array(F.lit("full"), F.lit("partial"))), d=scoring.program_coverage(F.array().cast("array<string>")), cost=scoring.trial_cost(F.lit("PHASE2"), F.lit(100), F.lit(D(2020, 1, 1)), F.lit(D(2020, 9, 1))), early=scoring.trial_cost(F.lit("PHASE2"), F.lit(100), F.lit(D(2020, 1, 1)), F.lit(D(2019, 1, 1))))
    assert (r.a, r.b, r.c, r.d, r.early) == (4, 1, "partial", "none", 0.0) and r.cost == pytest.approx(11.2 * 100 * 244 / 30.44)


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (7, 7), (200, 200), (100, 101)]
    got = {r.vertex: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100, 200: 200}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_clustering(spark):
    m = [(1, "trastuzumab deruxtecan", ["Enhertu", "DS-8201"]), (2, "Enhertu", []), (3, "ADC", []), (4, "adc", []), (5, "ladiratuzumab vedotin", []), (6, "ladiratuzumab vedotin + sacituzumab govitecan", []), (7, "sacituzumab govitecan", [])]
    got = {r.id: r.cluster_id for r in entities.cluster_names(spark.createDataFrame(m, "id int, name string, others array<string>"), "id", "name", "others").collect()}
    assert got[1] == got[2] and len(got) == 7 and got[5] != got[7]


LABEL = "action string, gate_reached int, is_repeat_probe boolean, program_id string, timestamp string, position int, status string, kill_reason string"


def test_labels_and_weights(spark):
    rows = [("label", 3, False, "p1", "2021-01", 1, "active", None), ("label", 3, False, "p1", "2021-02", 2, "dead_confirmed", "toxicity_safety"), ("label", 3, True, "p1", "2021-03", 3, "active", None)]
    assert labels.gate3_labels(spark.createDataFrame(rows, LABEL)).first().status == "dead_confirmed"
    pop = spark.createDataFrame([(0, "o")] * 4 + [(3, "s")] * 2 + [(None, "s")], "band int, kind string")
    w = stats.ipw_weights(pop, spark.createDataFrame([(0, "o")] * 2 + [(3, "s")], "band int, kind string"), ["band", "kind"])
    assert {r.weight for r in stats.require_coverage(w, ["band"]).collect()} == {2.0}
    with pytest.raises(stats.InsufficientCoverage) as e:
        stats.require_coverage(stats.ipw_weights(pop, pop.where("band = 0"), ["band", "kind"]), ["band", "kind"])
    assert e.value.missing == [(3, "s", 2)]


def test_label_rules(spark):
    base = {"action": "label", "gate_reached": 3, "decided_by": None, "triage_layer": None, "is_adc": "yes", "in_scope": "yes", "scope_reason": None, "history_coverage_at_serve_time": "full", "third_party_first_noted_date": None, "third_party_source": None, "status": "active", "confidence": "high", "kill_reason": None, "public_confirmation_date": None, "never_publicly_confirmed": None, "label_evidence_date": None, "confirmation_evidence_type": None}
    schema = ", ".join(f"{k} {'int' if k == 'gate_reached' else 'boolean' if k == 'never_publicly_confirmed' else 'string'}" for k in base)
    cases = [({}, 0), ({"action": "skip", "gate_reached": None}, 0), ({"action": "x"}, 1), ({"gate_reached": 1}, 1), ({"gate_reached": 1, "is_adc": "no", "in_scope": None}, 0), ({"status": "dead_confirmed"}, 3), ({"status": "dead_confirmed", "kill_reason": "ip_legal", "never_publicly_confirmed": True, "label_evidence_date": "2020"}, 0), ({"decided_by": "auto", "triage_layer": "l1"}, 1), ({"history_coverage_at_serve_time": "none"}, 1)]
    df = spark.createDataFrame([tuple((base | c).values()) for c, _ in cases], schema).select(labels.label_errors(["l1"]).alias("e"))
    assert [len(r.e) for r in df.collect()] == [n for _, n in cases]


def test_hazard_and_curve(spark):
    rnd = random.Random(2)
    rows = [(f"s{i % 20}", x := rnd.random(), int(rnd.random() < 1 / (1 + 2.718 ** (2 - 3 * x)))) for i in range(3000)]
    h = survival.fit_hazard(spark.createDataFrame(rows, "sponsor string, x double, event int"), "event", covariates=("x",))
    assert h.coefficients[1] == pytest.approx(3, abs=0.5) and h.clusters == 20 and all(e > 0 for e in h.errors)
    few = survival.fit_hazard(spark.createDataFrame([("a", 0.1, 1), ("b", 0.2, 0), ("c", None, 0)], "sponsor string, x double, event int"), "event", covariates=("x",))
    assert few.covariates == () and few.n == 3
    flagged = spark.createDataFrame([("p1", 0.5, D(2021, 1, 1)), ("p2", 0.5, D(2021, 1, 1))], "program_id string, threshold double, flag_date date")
    out = spark.createDataFrame([("p1", "dead", D(2021, 3, 1)), ("p2", "censored", D(2022, 1, 1)), ("p3", "dead", D(2021, 5, 1))], "program_id string, outcome string, event_month date")
    c = survival.curve(flagged, out, spark.createDataFrame([(0.5,), (0.9,)], "threshold double")).orderBy("threshold").collect()
    assert (c[0].n_flagged, c[0].n_correct, c[0].precision, c[0].recall, c[0].median_lead_days) == (2, 1, 0.5, 0.5, -59.0) and c[1].precision is None
    panel = spark.createDataFrame([("p", D(2021, m, 1), 1, 1.0, None) for m in (1, 2, 3)], "program_id string, as_of date, silence_score_asof int, cost_index double, conviction_ratio double")
    dead = spark.createDataFrame([("p", "dead", D(2025, 1, 1))], "program_id string, outcome string, event_month date")
    assert survival.training_table(panel, dead, F.lit(D(2021, 3, 1))).agg(F.sum("event_dead")).first()[0] == 0
    assert survival.training_table(panel, dead, F.lit(D(2021, 3, 1)), compat=True).agg(F.sum("event_dead")).first()[0] == 1


def test_statistics(spark):
    df = spark.createDataFrame([(1.0, True), (2.0, True), (3.0, False), (4.0, False), (4.0, False)], "x double, a boolean")
    u = stats.mann_whitney(df, "x", F.col("a")).first()
    assert (u.n1, u.n2, u.u) == (2, 3, 0.0) and 0 < u.p <= 1
    same = spark.createDataFrame([(f"s{i % 2}", float(i % 2)) for i in range(100)], "s string, x double")
    wide = stats.cluster_bootstrap(same, "s", F.col("x"), F.lit(1.0), resamples=200).first()
    assert wide.estimate == 0.5 and (wide.low, wide.high) == (0.0, 1.0)
    km = stats.kaplan_meier(spark.createDataFrame([("g", 1, True), ("g", 2, False), ("g", 3, True)], "g string, t int, e boolean"), "g", "t", F.col("e")).orderBy("t").collect()
    assert [round(r.survival, 4) for r in km] == [0.6667, 0.6667, 0.0]


def test_serve_and_cap(spark):
    df = spark.range(10).select(F.col("id").alias("k"))
    capped = triage.cap_with_overflow(df, ["k"], 3)
    assert capped.count() == 10 and capped.where("not overflow").count() == 3
    r = one(spark, a=triage.quadrant(F.lit(0), F.lit(0)), b=triage.quadrant(F.lit(1), F.lit(2)), c=triage.quadrant(F.lit(9), F.lit(0)), d=triage.quadrant(F.lit(1), F.lit(9)), e=triage.quadrant(F.lit(6), F.lit(6)))
    assert tuple(r) == ("untested_white_space", "insufficient_evidence", "red_ocean", "graveyard", "contested_and_hard")
    assert triage.spend_cap(df.withColumn("cost", F.lit(1.0)), ["k"], "cost", 4.0).count() == 4


def test_snapshots(spark, tmp_path):
    import json

    for day, text in (("2024-01-01", "{}"), ("2024-02-01", '{"a":1}'), ("notadate", "{}")):
        (tmp_path / "raw/src" / day).mkdir(parents=True)
        (tmp_path / "raw/src" / day / "n1%3Av1.json").write_text(json.dumps({"url": "u", "fetched_at": f"{day if day[0] == '2' else '2024-01-01'}T00:00:00Z", "sha256": "bad", "body": text}))
    env = snapshots.read_envelopes(spark, f"file://{tmp_path}/raw")
    man = snapshots.manifest(env)
    assert man.count() == 2 and snapshots.version_paths(man).first().version == 1
    assert snapshots.as_of(man, F.lit("2024-01-15").cast("date")).first().snapshot_date == D(2024, 1, 1)
    assert {r.problem for r in snapshots.integrity(env, man).collect()} == {"hash_mismatch"}
    stored = env.withColumn("sha256", F.sha2("body", 256)).cache()
    new = env.withColumn("body", F.lit("{}"))
    assert snapshots.append_snapshots(new.where("snapshot_date = '2024-01-01'"), stored).count() == 0
    with pytest.raises(snapshots.SnapshotConflict):
        snapshots.append_snapshots(new, stored)
    assert snapshots.read_log(spark, f"file://{tmp_path}/none.jsonl", "a int").count() == 0
    (tmp_path / "log.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert snapshots.read_log(spark, f"file://{tmp_path}/log.jsonl", "a int").count() == 2


def test_replay_source(spark, tmp_path):
    from asofly.sources.registry_replay import ReplaySource

    (tmp_path / "q1").mkdir()
    (tmp_path / "q1/first.json").write_text('{"studies": [{"i": 1}, {"i": 2}], "nextPageToken": "t2"}')
    (tmp_path / "q1/t2.json").write_text('{"studies": [{"i": 3}]}')
    spark.dataSource.register(ReplaySource)
    read = spark.read.format("registry_replay").option("queries", "q1")
    assert read.load(f"file://{tmp_path}").count() == 3
    assert read.option("max_records", "2").load(f"file://{tmp_path}").count() == 2


def test_streaming(spark, tmp_path):
    from asofly.streaming.ingest import ingest

    (tmp_path / "in").mkdir()
    line = '{"source":"s","id":"1","snapshot_date":"2024-01-01","fetched_at":"2024-01-01T00:00:00Z","url":"u","body":"b"}\n'
    (tmp_path / "in/a.json").write_text(line * 2)
    for _ in range(2):
        ingest(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1
