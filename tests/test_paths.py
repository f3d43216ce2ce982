"""Paths of JSON bodies against a recursive walk."""

import json
import random

from pyspark.sql import functions as F

from asofly.sources import paths, snapshots


def walk(x, path="$"):
    kind = "null" if x is None else "boolean" if isinstance(x, bool) else "number" if isinstance(x, int | float) else "string" if isinstance(x, str) else "array" if isinstance(x, list) else "object"
    out = {(path, kind)}
    for k, v in x.items() if isinstance(x, dict) else ():
        out |= walk(v, f"{path}.{k}")
    for v in x if isinstance(x, list) else ():
        out |= walk(v, f"{path}[]")
    return out


def value(rng, depth=0):
    kind = rng.choice(["n", "s", "b", "0", "f", "o", "o", "a"] if depth < 4 else ["n", "s", "b"])
    if kind == "o":
        return {rng.choice("abcdefg"): value(rng, depth + 1) for _ in range(rng.randrange(4))}
    if kind == "a":
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {"n": rng.randrange(10**12), "s": "text", "b": True, "0": None, "f": 1.5}[kind]


def test_paths(spark):
    rng = random.Random(4)
    bodies = {k: value(rng) for k in range(120)}
    rows = [(k, json.dumps(v), f"2020-01-{k % 28 + 1:02d}") for k, v in bodies.items()] + [(500, "no json", "2020-01-01"), (501, None, "2020-01-01"), (502, "", "2020-01-01")]
    df = spark.createDataFrame(rows, "id long, body string, day string")
    found = paths.body_paths(df, "id", "body").collect()
    got: dict = {}
    for r in found:
        got.setdefault(r["key"], []).append((r["path"], r["kind"]))
    want = {k: walk(v) for k, v in bodies.items()} | {500: {("$", "invalid")}, 502: {("$", "invalid")}}
    assert {k: set(v) for k, v in got.items()} == want and all(len(v) == len(set(v)) for v in got.values())
    table = {(r["path"], r["kind"]): (r["n"], r["first"], r["last"]) for r in paths.path_table(paths.body_paths(df, "id", "body"), df, "id", "day").collect()}
    for p, k in {x for v in want.values() for x in v}:
        days = [d for i, _, d in rows if (p, k) in want.get(i, ())]
        assert table[p, k] == (len(days), min(days), max(days))


def test_drift_and_signature(spark):
    """A member that a fixed schema would read as null shows as a change of kind; a renamed one as gone and new."""
    old = spark.createDataFrame([(1, '{"a": {"n": 1}, "b": [1, 2]}'), (2, '{"b": [], "a": {"n": 2}}')], "id long, body string")
    new = spark.createDataFrame([(3, '{"a": {"n": "1"}, "c": [1]}'), (4, '{"a": {"n": 5}, "c": [2]}')], "id long, body string")
    p, q = (paths.body_paths(df, "id", "body") for df in (old, new))
    got = {r["path"]: (r["change"], r["kinds_before"], r["kinds_after"]) for r in paths.drift(p, q).collect()}
    assert got == {
        "$.a.n": ("kind_changed", ["number"], ["number", "string"]), "$.b": ("removed", ["array"], None), "$.b[]": ("removed", ["number"], None), "$.c": ("added", None, ["array"]), "$.c[]": ("added", None, ["number"]),
    }
    hashes = {r["id"]: r["h"] for r in old.unionByName(new).select("id", snapshots.schema_hash(F.col("body")).alias("h")).collect()}
    assert {r["key"]: r["signature"] for r in paths.signature(p.unionByName(q)).collect()} == hashes
