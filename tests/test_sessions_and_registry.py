"""Review sessions in batch and stream, request pacing, and the incremental registry sources."""

import json
import random

import pytest

from asofly.operators import dictionary
from asofly.sources.pacing import Answer, Pace, RequestFailed, fetch
from asofly.sources.registry_stream import RegistryHistory, RegistryPages
from asofly.streaming import sessions
from asofly.streaming.sessions import EVENT, Session


def say(events, cap=None, session="s"):
    state, out = Session(), []
    for i, (kind, queue, ids, cost) in enumerate(events):
        if (row := state.hear(session, i, kind, queue, ids, cost, cap)) is not None:
            out.append(row[3:])
    return state, out


def test_queues():
    """A session begins in main; switching serves the other queue; unknown queues are refused."""
    load = [("load", "main", ["m1", "m2"], None), ("load", "validation", ["v1"], None)]
    _, out = say([*load, ("serve", None, None, None), ("switch", "validation", None, None), ("serve", None, None, None), ("serve", None, None, None), ("switch", "main", None, None), ("serve", None, None, None)])
    assert out == [("m1", "main", False), ("v1", "validation", False), (None, "validation", False), ("m2", "main", False)]
    with pytest.raises(ValueError):
        say([("switch", "other", None, None)])


def test_skip_and_expire():
    """A skipped card goes to the end of the active queue, a named one, or, when it expires, to where it came from."""
    state, out = say([("load", "main", ["a", "b"], None), ("serve", None, None, None), ("skip", None, ["a"], None), ("serve", None, None, None), ("switch", "auto_review", None, None), ("expire", None, ["b"], None), ("skip", "validation", ["x"], None)])
    assert [p for p, *_ in out] == ["a", "b"] and state.queues["main"] == ["a", "b"] and state.queues["validation"] == ["x"] and state.queues["auto_review"] == []


@pytest.mark.parametrize("queue,labels,repeats", [("main", ["x", "y"], [9, 19, 29]), ("validation", ["x", "y"], []), ("main", [], [])])
def test_repeats(queue, labels, repeats):
    """Every tenth serve of the main queue repeats a labelled program, and never the same one twice in a row."""
    _, out = say([("load", queue, [f"p{i}" for i in range(40)], None), ("switch", queue, None, None), ("label", None, labels, None)] + [("serve", None, None, None)] * 35)
    assert [i for i, (_, _, r) in enumerate(out) if r] == repeats
    again = [p for p, _, r in out if r]
    assert all(a != b for a, b in zip(again, again[1:], strict=False)) and set(again) <= set(labels)


def test_spend_cap():
    _, out = say([("load", "main", ["a", "b", "c"], None), ("serve", None, None, None), ("spend", None, None, 0.6), ("serve", None, None, None), ("spend", None, None, 0.4), ("serve", None, None, None)], cap=1.0)
    assert [p for p, *_ in out] == ["a", "b", None]


def log(n_sessions=6, n=120, seed=3):
    rng = random.Random(seed)
    rows = []
    for s in range(n_sessions):
        for seq in range(n):
            kind = rng.choice(["load", "serve", "serve", "serve", "label", "skip", "expire", "switch", "spend"])
            queue = rng.choice([*sessions.QUEUES, None]) if kind in ("load", "switch", "skip") else None
            ids = [f"p{rng.randrange(50)}" for _ in range(rng.randrange(1, 4))] if kind in ("load", "label", "skip", "expire") else None
            rows.append((f"s{s}", seq, kind, queue, ids, 0.01 if kind == "spend" else None))
    return rows


def test_batch_and_stream_agree(spark, tmp_path):
    """Replaying a log gives the serves that a stream of it gives, and those of the plain fold."""
    rows = log()
    events = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), EVENT)
    want = []
    for s in sorted({r[0] for r in rows}):
        state = Session()
        want += [x for r in rows if r[0] == s and (x := state.hear(*r, 0.08)) is not None]
    got = sorted(tuple(r) for r in sessions.replay(events, 0.08).select(*[c.split()[0] for c in sessions.SERVED.split(", ")]).collect())
    assert got == sorted(want)
    for part in range(3):
        chunk = [r for r in rows if r[1] * 3 // 120 == part]
        spark.createDataFrame(chunk, EVENT).coalesce(1).write.mode("append").json(f"{tmp_path}/log/{part}")
        source = spark.readStream.schema(EVENT).option("recursiveFileLookup", "true").json(f"{tmp_path}/log")
        q = sessions.serve_stream(source, 0.08).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    streamed = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("session", "seq", "serve", "program_id", "queue", "is_repeat").collect())
    assert streamed == sorted(want)
    left = {(r.session, r.program_id) for r in sessions.open_cards(events, sessions.replay(events)).collect()}
    served = [tuple(r) for r in sessions.replay(events).collect()]
    brute = set()
    for s, seq, _, p, *_ in served:
        if p and not any(r[0] == s and r[1] > seq and r[2] in ("label", "skip", "expire") and p in r[4] for r in rows):
            brute.add((s, p))
    assert left == brute


def paced(answers, pace):
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    it = iter(answers)
    return (*fetch(lambda: next(it), pace, lambda: now[0], sleep)[:2], slept)


def test_pace():
    body, pace, slept = paced([Answer(429), Answer(429), Answer(200, "ok")], Pace(interval=0.0))
    assert (body, slept, pace.interval) == ("ok", [2.0, 4.0], 2.0)  # the raised interval has passed by the back-off
    body, pace, slept = paced([Answer(429, retry_after="0.5"), Answer(200, "ok")], Pace(interval=0.0))
    assert slept == [0.5, 1.5] and pace.interval == 2.0
    assert paced([Answer(429, retry_after="3"), Answer(200, "ok")], Pace(interval=5.0))[1:] == (Pace(interval=5.0), [3.0, 2.0])
    assert paced([Answer(503), Answer(0), Answer(200, "ok")], Pace(interval=0.0))[1:] == (Pace(interval=0.0), [2.0, 4.0])
    assert paced([Answer(500, retry_after="soon"), Answer(200, "x")], Pace(interval=0.0))[2] == [2.0]
    with pytest.raises(RequestFailed):
        paced([Answer(404), Answer(200)], Pace(interval=0.0))
    asked = []
    with pytest.raises(RequestFailed):
        fetch(lambda: asked.append(1) or Answer(0), Pace(interval=0.0, most_retries=3), lambda: 0.0, lambda s: None)
    assert len(asked) == 4
    assert Pace().wait(0.3) == pytest.approx(0.75) and Pace().wait(9) == 0


def test_pages_stream(spark, tmp_path):
    """A stream goes on at the committed page after a restart; a refused page is asked again."""
    for q, n in (("q1", 3), ("q2", 1)):
        (tmp_path / "in" / q).mkdir(parents=True)
        for k in range(n):
            name = "first" if not k else f"t{k}"
            page = {"studies": [{"id": f"{q}-{k}-{i}"} for i in range(2)]} | ({"nextPageToken": f"t{k + 1}"} if k + 1 < n else {})
            (tmp_path / "in" / q / f"{name}.json").write_text(json.dumps(page))
    (tmp_path / "in" / "q1" / "t1.1.json").write_text(json.dumps({"status": 429, "retry_after": "0"}))
    spark.dataSource.register(RegistryPages)

    def run():
        source = spark.readStream.format("registry_pages").option("path", f"file://{tmp_path}/in").option("queries", "q1,q2").option("interval", "0").option("floor", "0.1").load()
        q = source.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="0 seconds").start()
        return q

    def rows():
        return sorted(json.loads(r.body)["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect())

    want = sorted([f"q1-{k}-{i}" for k in range(3) for i in range(2)] + ["q2-0-0", "q2-0-1"])
    q = run()
    q.processAllAvailable()
    q.stop()
    for _ in range(10):
        if rows() == want:
            break
        q = run()
        q.processAllAvailable()
        q.stop()
    assert rows() == want
    (tmp_path / "in" / "q2" / "late.json").write_text("{}")
    q = run()
    q.processAllAvailable()
    q.stop()
    assert rows() == want


def test_history_stream(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"n{k}" / "history").mkdir(parents=True)
        (tmp_path / f"n{k}" / "history.json").write_text(json.dumps({"changes": [{"version": v, "date": f"2020-0{v + 1}-01"} for v in range(k % 3 + 1)]}))
        for v in range(k % 3 + 1):
            (tmp_path / f"n{k}" / "history" / f"{v}.json").write_text(json.dumps({"study": {"v": v}}))
    spark.dataSource.register(RegistryHistory)
    source = spark.readStream.format("registry_history").option("path", f"file://{tmp_path}").option("ids", ",".join(f"n{k}" for k in range(5))).option("records_per_batch", "2").option("interval", "0").load()
    q = source.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="0 seconds").start()
    for _ in range(4):
        q.processAllAvailable()
    q.stop()
    got = sorted((r.id, r.version, json.loads(r.body)["study"]["v"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(f"n{k}", v, v) for k in range(5) for v in range(k % 3 + 1)]


def test_confirmed_hits(spark):
    hits = spark.createDataFrame([("h1", "c1", "We sold Alpha Beta, and alpha-beta again"), ("h1", "c2", "We sold Alpha Beta, and alpha-beta again"), ("h2", "c2", "gamma"), ("h3", "c1", None)], "hit_id string, candidate_id string, text string")
    names = spark.createDataFrame([("c1", "alpha beta"), ("c1", "ab-1"), ("c2", "Gamma")], "candidate_id string, name string")
    assert sorted(tuple(r) for r in dictionary.confirmed_hits(hits, names).collect()) == [("h1", "c1", 2), ("h2", "c2", 1)]
