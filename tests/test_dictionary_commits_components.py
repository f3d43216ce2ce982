"""The dictionary automaton, the snapshot store and growing components against brute force."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from asofly.operators import components, dictionary
from asofly.session import scratch_path
from asofly.sources.commits import SnapshotStore
from asofly.sources.snapshots import SnapshotConflict


def brute_mentions(texts, names):
    spoken = {" ".join(dictionary.words_of(n)) for n in names if n} - {""}
    out = []
    for k, t in texts:
        words = dictionary.words_of(t or "")
        for name in spoken:
            parts = name.split(" ")
            at = [i for i in range(len(words) - len(parts) + 1) if words[i : i + len(parts)] == parts]
            if at:
                out.append((k, name, len(at), at[0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("share_bytes", [60, 1 << 20])
def test_mentions(spark, share_bytes):
    """Overlapping, nested and repeated names, several shares, nulls, repeats, case and punctuation."""
    rng = random.Random(2)
    words = ["a", "b", "ab", "Été", "x9", "HER2"]
    names = [" ".join(rng.choices(words, k=rng.randrange(1, 5))) for _ in range(60)] + ["a-b", "A  B", None, "", "--", "a a a"]
    texts = [(k, "".join(w + rng.choice([" ", ", ", "-", "\n"]) for w in rng.choices(words + ["zz"], k=rng.randrange(0, 60)))) for k in range(40)] + [(40, None), (41, ""), (3, "a b a b"), (None, "x9 her2"), (42, "a " * 5000)]
    t = spark.createDataFrame(texts, "id long, body string").repartition(3)
    n = spark.createDataFrame([(x,) for x in names], "label string")
    got = sorted((tuple(r) for r in dictionary.text_mentions(t, "body", "id", n, "label", share_bytes).collect()), key=str)
    assert got == brute_mentions(texts, names)
    assert dictionary.text_mentions(t, "body", "id", n.limit(0), "label").count() == 0 and dictionary.text_mentions(t.limit(0), "body", "id", n, "label").count() == 0


def test_mentions_of_many_names(spark):
    """A hundred thousand names, in time linear in the texts."""
    names = spark.range(100_000).select(F.concat(F.lit("name "), F.col("id").cast("string"), F.when(F.col("id") % 2 == 0, " plus").otherwise("")).alias("n"))
    text = lambda k: " and ".join(f"name {i} plus" for i in range(k, k + 2000))
    docs = spark.createDataFrame([(k, text(1000 * k)) for k in range(20)], "id long, body string")
    began = time.time()
    got = dictionary.text_mentions(docs, "body", "id", names, "n").groupBy("id").agg(F.sum("n").alias("n")).collect()
    assert {r["n"] for r in got} == {2000} and time.time() - began < 120


def snapshot(spark, rows):
    day, now = datetime.date(2024, 1, 1), datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([("s", k, day, now, "u", body) for k, body in rows], "source string, id string, snapshot_date date, fetched_at timestamp, url string, body string")


def test_store(spark):
    store = SnapshotStore(spark, scratch_path(spark, "store"))
    assert store.read().count() == 0 and store.log() == []
    assert store.append(snapshot(spark, [("a", "1"), ("b", "2")])) == 1
    assert store.append(snapshot(spark, [("a", "1")])) == 1  # the same bytes: no commit
    assert store.append(snapshot(spark, [("a", "1"), ("c", "3")])) == 2
    with pytest.raises(SnapshotConflict):
        store.append(snapshot(spark, [("d", "4"), ("a", "other")]))
    assert sorted((r.id, r.body) for r in store.read().collect()) == [("a", "1"), ("b", "2"), ("c", "3")]
    assert sorted(r.id for r in store.read(1).collect()) == ["a", "b"] and [c.n_rows for c in store.log()] == [2, 1]


def test_two_writers(spark):
    """Of two writers of one key one wins and the other gets a conflict; writers of other keys, or of the same bytes, both go through."""
    store = SnapshotStore(spark, scratch_path(spark, "store"))
    step = iter([lambda: store.append(snapshot(spark, [("a", "mine")]))])
    with pytest.raises(SnapshotConflict):
        store.append(snapshot(spark, [("a", "yours"), ("b", "2")]), before_commit=lambda: next(step)())
    assert [(r.id, r.body) for r in store.read().collect()] == [("a", "mine")]
    step = iter([lambda: store.append(snapshot(spark, [("c", "3"), ("e", "5")])), lambda: store.append(snapshot(spark, [("f", "6")])), lambda: None])
    assert store.append(snapshot(spark, [("d", "4"), ("c", "3")]), before_commit=lambda: next(step)()) == 4
    rows = sorted((r.id, r.body) for r in store.read().collect())
    assert rows == [("a", "mine"), ("c", "3"), ("d", "4"), ("e", "5"), ("f", "6")] and [c.number for c in store.log()] == [1, 2, 3, 4]


def test_failed_writer_leaves_nothing(spark):
    store = SnapshotStore(spark, scratch_path(spark, "store"))
    store.append(snapshot(spark, [("a", "1")]))

    def fail():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        store.append(snapshot(spark, [("b", "2")]), before_commit=fail)
    assert [r.id for r in store.read().collect()] == ["a"]
    folder = store._fs.listStatus(store._path(f"{store.root}/data"))
    assert len(list(folder)) == 1


def test_corrections_only_add(spark):
    store = SnapshotStore(spark, scratch_path(spark, "store"))
    store.append(snapshot(spark, [("a", "1"), ("b", "2")]))
    fix = lambda rows: store.correct(spark.createDataFrame([("s", k, datetime.date(2024, 1, 1), f, v) for k, f, v in rows], "source string, id string, snapshot_date date, field string, value string"))
    assert fix([("a", "scope", "no")]) == 2 and fix([("a", "scope", "yes"), ("a", "why", "x")]) == 3
    got = {r.id: (r.body, r.corrections) for r in store.corrected().collect()}
    assert got == {"a": ("1", {"scope": "yes", "why": "x"}), "b": ("2", None)} and store.read().count() == 2


def partition_of(rows):
    groups: dict = {}
    for v, c in rows:
        groups.setdefault(c, set()).add(v)
    return {frozenset(g) for g in groups.values()}


def brute_partition(edges):
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return partition_of([(v, find(v)) for v in list(root)])


@pytest.mark.parametrize("seed", [1, 2])
def test_growing_components(spark, seed):
    """After every batch the table is that of a full run, and a component keeps the oldest of its parts' names."""
    rng = random.Random(seed)
    frame = lambda e: spark.createDataFrame(e, "a string, b string")
    vertex = lambda: f"v{rng.randrange(60):02d}"
    edges = [(vertex(), vertex()) for _ in range(12)]
    stored = components.first_components(frame(edges), "a", "b")
    for batch in (1, 2, 3):
        before = [tuple(r) for r in stored.collect()]
        stored = spark.createDataFrame(before, "vertex string, component string, since long, born long")
        new = [(vertex(), vertex()) for _ in range(6)]
        edges += new
        stored, merges = components.add_edges(stored, frame(new), "a", "b", batch)
        rows = [tuple(r) for r in stored.collect()]
        assert len(rows) == len({r[0] for r in rows}) and partition_of([r[:2] for r in rows]) == brute_partition(edges)
        now, born = {r[0]: r[1] for r in rows}, {r[1]: r[3] for r in before}
        for group in partition_of([r[:2] for r in rows]):
            old = {c for v, c, *_ in before if v in group}
            if old:
                assert {now[v] for v in group} == {min(old, key=lambda c: (born[c], c))}
        assert {(m["component"], m["into"]) for m in merges.collect()} == {(c, now[v]) for v, c, *_ in before if now[v] != c}
    rows = [tuple(r) for r in stored.collect()]
    stored = spark.createDataFrame(rows, "vertex string, component string, since long, born long")
    gone = rng.sample(edges, 8)
    left = [e for e in edges if e not in gone]
    after, splits = components.remove_edges(stored, frame(left), frame(gone), "a", "b", 9)
    got = [tuple(r) for r in after.collect()]
    assert partition_of([r[:2] for r in got]) == brute_partition(left + [(v, v) for v, *_ in rows])
    kept = {c for _, c, *_ in rows}
    assert kept <= {c for _, c, *_ in got} and {s["component"] for s in splits.collect()} <= kept
