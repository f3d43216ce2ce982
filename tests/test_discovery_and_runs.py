"""Discovery checks, dry runs, resumed runs, serve plans and what used to be written in queries only."""

import duckdb
import pytest
from pyspark.sql import functions as F

from asofly.operators import audit, programs, queues, triage
from asofly.plans import registry
from asofly.sources import snapshots


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_pools(spark):
    p = spark.createDataFrame([("a",), ("b",), (None,)], "nct_id string")
    v = spark.createDataFrame([("a", "EXPANDED_ACCESS"), ("a", "OTHER"), ("b", "OTHER"), ("b", None)], "nct_id string, study_type string")
    assert sorted(rows(programs.without_type(p, v, "EXPANDED_ACCESS")), key=str) == [("b",), (None,)]
    assert rows(programs.outstanding(spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "nct_id string"), p.where("nct_id = 'a'"), p.where("nct_id = 'b'"))) == [("c",)]


def test_counts(spark):
    v = spark.createDataFrame([("a", ["x"]), ("a", ["y", "z"]), ("b", None), ("b", [])], "id string, m array<string>")
    assert rows(programs.signal_stats(v, "id", "m", ["y", "x"])) == [(4, 2, 2, 0.5)] and rows(programs.signal_stats(v.limit(0), "id", "m", ["y"])) == [(0, 0, 0, 0.0)]
    parents = spark.createDataFrame([("a",), ("b",), ("c",)], "p string")
    children = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", None)], "p string, c int")
    assert rows(programs.child_stats(parents, children, "p", "c")) == [(3, 1.0, 1.0, 2, 1, 2)]


def test_saturation(spark):
    f = spark.createDataFrame([("a", "two"), ("a", "one"), ("b", "two"), ("c", "three"), ("d", "else"), ("d", "two"), ("e", "else"), ("f", None)], "id string, s string")
    assert rows(programs.saturation(f, "id", "s", ["one", "two", "three", "four"]), "step") == [(0, None, 2, None, 0), (1, "one", 1, 0.25, 1), (2, "two", 2, 0.5, 3), (3, "three", 1, 0.25, 4), (4, "four", 0, 0.0, 4)]


RECORD = "program_id string, position int, timestamp string, action string, gate_reached int, is_repeat_probe boolean, in_scope string, scope_reason string"


def test_discovery_checks(spark):
    c = spark.createDataFrame([("1", ["pattern_match"]), ("2", ["sponsor_expansion", "pattern_match"]), ("3", ["sponsor_expansion"]), ("4", None)], "candidate_id string, strategies array<string>")
    p = spark.createDataFrame([("x", True), ("y", False)], "proposed_name string, spans_heme_and_solid boolean")
    sample = spark.createDataFrame([("a", "no", "heme_only"), ("b", "no", "heme_only"), ("c", "yes", None), ("d", "yes", None)], "program_id string, predicted_in_scope string, predicted_scope_reason string")
    rec = lambda xs: spark.createDataFrame([(k, i, str(i), "label", g, False, s, r) for i, (k, g, s, r) in enumerate(xs)], RECORD)
    mixed = rec([("a", 2, "no", "heme_only"), ("b", 3, "no", "not_an_adc"), ("c", 1, "yes", None)])
    assert rows(audit.scope_agreement(sample, mixed)) == [(4, 2, 1, 0.5)]
    got = {r.name: (r.level, r.actual) for r in audit.discovery(c, p, sample, mixed).collect()}
    assert [v[0] for v in got.values()] == ["WARN", "INFO", "FAIL"] and got["the last strategy adds little"][1] == "0.3333" and got["assets span haematological and solid tumours"][1] == "1"
    good = rec([("a", 2, "no", "heme_only"), ("c", 3, "yes", None)])
    assert [r.level for r in audit.discovery(c.where("candidate_id < '3'"), p, sample, good).collect()] == ["INFO", "INFO", "PASS"]
    assert [r.level for r in audit.discovery(c, p, sample, good.limit(0)).collect()][2] == "INFO"


def test_dry_run(spark):
    e = spark.createDataFrame([(f"p{k:02d}", "x" * 40 if k < 45 else None) for k in range(60)], "program_id string, prompt string")
    r = queues.dry_run(e, 100, (1.0, 5.0), cap=10).first()
    groups = [(20 * 40 + 19 + 100) // 4] * 2 + [(5 * 40 + 4 + 100) // 4]
    assert (r.residue, r.with_text, r.groups, r.tokens, r.no_text, r.overflow) == (60, 45, 3, sum(groups), 15, 5)
    price = lambda k: 0.5 * (sum(groups) * k * 1.0 + 45 * 60 * k * 5.0) / 1e6
    each = 0.5 * (1400 + 150 * 5.0) / 1e6
    assert (r.typical_cost, r.worst_cost) == (pytest.approx(price(3)), pytest.approx(price(5))) and (r.least_search_cost, r.most_search_cost) == (pytest.approx(10 * each), pytest.approx(10 * each))
    none = queues.dry_run(e.limit(0), 100, (1.0, 5.0)).first()
    assert (none.residue, none.groups, none.tokens, none.typical_cost) == (0, 0, 0, 0.0)


def test_resume(spark):
    pool = spark.createDataFrame([(k, f"n{k}") for k in "abcdefg"], "program_id string, proposed_name string")
    staged = spark.createDataFrame([("a", "1", 0, 2, False), ("b", "1", 1, 2, True), ("c", "1", 2, 2, True), ("c", "2", 3, 3, None), ("d", "2", 4, 3, None), ("d", "3", 5, 2, True)], "program_id string, timestamp string, position int, layer int, route_to_layer3 boolean")
    pilot = spark.createDataFrame([("ne", False), ("nf", False), ("nf", True), ("nb", False)], "proposed_name string, routed boolean")
    assert {r.program_id: r.step for r in queues.resume_sets(pool, staged, pilot).collect()} == {"a": "done", "b": "search", "c": "done", "d": "search", "e": "done", "f": "search", "g": "ask"}


PLAN = "program_id string, reopened boolean, holdout boolean, heme_auto_ok boolean, model_gate_ok boolean, staged_is_adc string, staged_in_scope string, staged_overflow boolean, is_adc string, in_scope string, scope_reason string, rule string, committable boolean"


@pytest.mark.parametrize(
    "row,gate,skip",
    [
        ((True, False, True, True, "no", None, None, "no", "no", "not_an_adc", "denylist", True), 1, False),
        ((False, True, True, True, "yes", "yes", None, "yes", None, None, "suffix", False), 1, False),
        ((False, False, True, True, "no", None, None, None, None, None, "", False), 1, True),
        ((False, False, True, True, "yes", "yes", None, None, None, None, "", False), 3, False),
        ((False, False, True, True, "yes", None, None, None, None, None, "", False), 2, False),
        ((False, False, True, False, "yes", "yes", None, None, None, None, "", False), 1, False),
        ((False, False, True, True, "yes", "yes", True, None, None, None, "", False), 1, False),
        ((False, False, False, False, None, None, None, "yes", "no", "heme_only", "suffix", True), 2, False),
        ((False, False, False, False, None, None, None, None, "no", "heme_only", "mesh", True), 1, False),
        ((False, False, True, False, None, None, None, "yes", "no", "heme_only", "suffix", True), 1, True),
        ((False, False, True, False, None, None, None, "yes", None, None, "suffix+positive_in_scope", False), 3, False),
        ((False, False, True, False, None, None, None, "yes", None, None, "suffix", False), 2, False),
        ((False, False, True, False, None, None, None, None, "yes", None, "mesh", False), 1, False),
    ],
)
def test_serve_plan(spark, row, gate, skip):
    """where a reviewer begins with a program, and whether it is passed over."""
    got = triage.serve_plan(spark.createDataFrame([("p", *row)], PLAN)).first()
    assert (got.start_gate, got.skip) == (gate, skip)


def test_last_stated_reason(spark):
    """Of the trials that stopped with a reason, the one updated last; trials that go on, or say nothing, don't count."""
    trial = "array<struct<status:string,why_stopped:string,last_update:string>>"
    df = spark.createDataFrame([("a", [("TERMINATED", "old", "2020"), ("WITHDRAWN", "new", "2021"), ("COMPLETED", "no", "2022"), ("TERMINATED", None, "2023")]), ("b", [("RECRUITING", "x", "2020")]), ("c", [("TERMINATED", "undated", None)])], f"program_id string, trials {trial}")
    assert {r.program_id: r.s for r in df.select("program_id", programs.last_stated_reason(F.col("trials")).alias("s")).collect()} == {"a": "new", "b": None, "c": "undated"}


def test_schema_hash(spark):
    """The signature depends on the set of keys only."""
    df = spark.createDataFrame([('{"b": 1, "a": {"c": 2}}',), ('{"a": [], "b": null}',), ('{"a": 1}',)], "t string").select(snapshots.schema_hash(F.col("t")).alias("h"))
    a, b, c = (r.h for r in df.collect())
    assert a == b != c and len(a) == 16 and set(a) <= set("0123456789abcdef")


@pytest.mark.parametrize("name", ["entity_components", "growing_components"])
def test_components_of_all_lines(spark, name):
    """Suppliers and parts of every line at the middle scale, against union-find."""
    folder = "/root/testdata/sf0.01"
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for s, p in duckdb.sql(f"SELECT DISTINCT l_suppkey, l_partkey FROM '{folder}/lineitem.parquet'").fetchall():
        a, b = find(("s", s)), find(("p", p))
        root[max(a, b)] = min(a, b)
    got: dict = {}
    for r in registry.queries()[name](spark, folder).select("vertex", "component").collect():
        v = r["vertex"]
        node = (v[0], int(v[1:])) if isinstance(v, str) else ("p", v - 1_000_000) if v >= 1_000_000 else ("s", v)
        got.setdefault(r["component"], set()).add(node)
    want: dict = {}
    for x in list(root):
        want.setdefault(find(x), set()).add(x)
    assert {frozenset(g) for g in got.values()} == {frozenset(g) for g in want.values()}
