"""Segmented scans, rank selection and the sweep line against windows and brute force, with keys that hold nearly all rows."""

import datetime
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from asofly.operators import ranges, scans, stats, survival
from asofly.operators.scans import Scan

SCANS = {"last": Scan("v"), "total": Scan("v", "sum"), "before": Scan("v", "sum", exclusive=True), "top": Scan("v", "max"), "low": Scan("v", "min", exclusive=True), "held": Scan("v", "last", exclusive=True), "after": Scan("v", "sum", backward=True), "next": Scan("v", "last", exclusive=True, backward=True)}


def skewed(n=600, seed=1):
    """Nine tenths of the rows in one key, a null key, values that are null, unique order within a key."""
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.9 else rng.choice(["a", "b", "z", None]), i, rng.choice([None, rng.randrange(-50, 50)])) for i in range(n)]


@pytest.mark.parametrize("hot_rows", [10, 100, 10**9])
def test_scan(spark, hot_rows):
    df = spark.createDataFrame(skewed(), "k string, t int, v long").repartition(5)
    want = sorted(map(str, scans.windowed_scan(df, ["k"], ["t"], SCANS).select("k", "t", "v", *SCANS).collect()))
    assert sorted(map(str, scans.running(df, ["k"], ["t"], SCANS, hot_rows).select("k", "t", "v", *SCANS).collect())) == want
    whole = sorted(map(str, scans.segmented_scan(df, ["k"], ["t"], SCANS).select("k", "t", "v", *SCANS).collect()))
    assert whole == want
    assert scans.running(df.limit(0), ["k"], ["t"], SCANS, hot_rows).count() == 0


def test_scan_splits_the_hot_key(spark):
    """The rows of one key lie in several ranges, none with more than half of them."""
    df = spark.createDataFrame([("hot", i, i) for i in range(4000)], "k string, t int, v long")
    sizes = [r["n"] for r in ranges.ranged(df, ["k", "t"], "test").groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) > 2 and max(sizes) < 2000
    got = scans.segmented_scan(df, ["k"], ["t"], {"s": Scan("v", "sum")}).orderBy("t").collect()
    assert [r.s for r in got] == np.cumsum(range(4000)).tolist()


def test_scan_of_structs_and_two_keys(spark):
    rows = [(k % 2, "x" if k % 3 else None, k, k if k % 5 else None) for k in range(300)]
    df = spark.createDataFrame(rows, "a int, b string, t int, v int").withColumn("r", F.when(F.col("v").isNotNull(), F.struct("v", "b")))
    got = {r.t: r.last for r in scans.segmented_scan(df, ["a", "b"], ["t"], {"last": Scan("r")}).collect()}
    want = {r.t: r.last for r in scans.windowed_scan(df, ["a", "b"], ["t"], {"last": Scan("r")}).collect()}
    assert got == want


def test_rank_selection(spark):
    rows = [(k, v) for k, _, v in skewed(500, 2)] + [("one", 7), ("none", None), ("two", 1), ("two", 2)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(4)
    shares = {"q1": 0.25, "mid": 0.5, "q3": 0.75, "low": 0.0, "high": 1.0}
    got = {r.k: r for r in scans.rank_selected(df, ["k"], "v", shares, {f"i_{n}": q for n, q in shares.items()}).collect()}
    groups: dict = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    assert set(got) == set(groups)
    for k, vs in groups.items():
        vs.sort()
        for name, q in shares.items():
            assert abs(got[k][name] - np.quantile(vs, q)) < 1e-9
            assert got[k][f"i_{name}"] == vs[min(int(q * len(vs)), len(vs) - 1)]


def test_summary_of_hot_groups(spark):
    """A group above the bound goes by ranks, the others by an aggregate: the same rows either way."""
    df = spark.createDataFrame([(k or "null", v) for k, _, v in skewed(400, 3)], "k string, v long").repartition(3)
    want = sorted(map(str, stats.grouped_summary(df, "k", "v").collect()))
    assert sorted(map(str, stats.grouped_summary(df, "k", "v", hot_rows=20).collect())) == want


@pytest.mark.parametrize("hot_rows", [3, 10**9])
def test_kaplan_meier_of_hot_groups(spark, hot_rows):
    rng = random.Random(6)
    rows = [("hot" if rng.random() < 0.8 else "b", rng.randrange(60), rng.random() < 0.6) for _ in range(500)]
    got = {(r.g, r.t): r for r in stats.kaplan_meier(spark.createDataFrame(rows, "g string, t int, e boolean"), "g", "t", F.col("e"), hot_rows).collect()}
    for g in ("hot", "b"):
        s = 1.0
        for t in sorted({t for h, t, _ in rows if h == g}):
            risk = sum(h == g and u >= t for h, u, _ in rows)
            events = sum(h == g and u == t and e for h, u, e in rows)
            s *= 1 - events / risk
            assert (got[g, t].at_risk, got[g, t].events) == (risk, events) and abs(got[g, t].survival - s) < 1e-9


def brute_curve(rows, outcomes, cuts):
    best = {}
    for t in cuts:
        flagged, leads, correct = 0, [], 0
        for p, (outcome, month) in outcomes.items():
            dates = [d for q, d, s in rows if q == p and s is not None and s == s and s >= t]
            if dates:
                flagged += 1
                if outcome == "dead":
                    correct += 1
                    if month:
                        leads.append((min(dates) - month).days)
        dead = sum(o == "dead" for o, _ in outcomes.values())
        best[t] = (flagged, correct, correct / flagged if flagged else None, correct / dead if dead else None, float(statistics.median(leads)) if leads else None)
    return best


@pytest.mark.parametrize("seed", range(3))
def test_sweep(spark, seed):
    rng = random.Random(seed)
    day = datetime.date(2020, 1, 1)
    rows = [(p, day + datetime.timedelta(31 * m), rng.choice([None, float("nan"), round(rng.random(), 2), round(rng.random(), 1)])) for p in range(40) for m in range(rng.randrange(0, 12))]
    outcomes = {p: (rng.choice(["dead", "dead", "censored", "approved"]), rng.choice([None, day + datetime.timedelta(rng.randrange(900))])) for p in range(45)}
    cuts = sorted({s for *_, s in rows if s is not None and s == s} | {-1.0, 0.333, 5.0})
    p = spark.createDataFrame(rows, "program_id int, as_of date, s double")
    out = spark.createDataFrame([(k, *v) for k, v in outcomes.items()], "program_id int, outcome string, event_month date")
    points = spark.createDataFrame([(c,) for c in cuts], "threshold double")
    got = {r.threshold: tuple(r)[1:] for r in survival.sweep(p, "s", out, points).collect()}
    assert got == brute_curve(rows, outcomes, cuts)
    old = {r.threshold: tuple(r)[1:] for r in survival.curve(survival.flags(p, "s", points), out, points).collect()}
    assert got == old
    assert survival.sweep(p.limit(0), "s", out, points).where("n_flagged <> 0").count() == 0 and survival.sweep(p, "s", out, points.limit(0)).count() == 0
    plan = survival.sweep(p, "s", out, points)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin BuildRight, Inner, (" not in plan


def test_most_precise(spark):
    points = spark.createDataFrame([(0.1, 9, 3, 0.9, 0.5, -10.0), (0.2, 9, 3, 0.9, 0.4, -40.0), (0.3, 9, 3, 0.9, 0.6, -40.0), (0.4, 9, 3, 0.9, 0.9, None), (0.5, 0, 0, None, 0.9, None), (0.6, 3, 1, 0.4, 1.0, -99.0)], "threshold double, n_flagged long, n_correct long, precision double, recall double, median_lead_days double")
    assert survival.most_precise(points).first().threshold == 0.3
    assert survival.most_precise(points.where("precision is null")).count() == 0


def test_all_hazards(spark):
    """A joint fit equals three single ones; each cause has its own rows, and events are counted over the whole table."""
    rng = np.random.default_rng(4)
    n = 3000
    x = rng.normal(size=n)
    rows = []
    for i in range(n):
        known = None if i % 11 == 0 else float(x[i])
        dead = int(rng.random() < 1 / (1 + np.exp(2.5 - x[i])))
        approved = int(not dead and i < 12 and i % 11 == 0 or i in (1, 2, 3, 5, 6, 7, 8, 9, 10, 12, 13))
        rows.append((f"s{i % 37}", known, dead, approved, int(i in (4, 5, 6))))
    df = spark.createDataFrame(rows, "sponsor string, x double, event_dead int, event_approved int, event_superseded int")
    events = ("event_dead", "event_approved", "event_superseded")
    joint = survival.fit_all(df, events, covariates=("x",))
    for e in events:
        one = survival.fit_hazard(df, e, covariates=("x",))
        assert one.covariates == joint[e].covariates and one.n == joint[e].n and one.events == joint[e].events and one.clusters == joint[e].clusters
        assert np.allclose(one.coefficients, joint[e].coefficients, atol=1e-8) and np.allclose(one.errors, joint[e].errors, atol=1e-8)
    assert joint["event_dead"].covariates == ("x",) and joint["event_dead"].n == sum(r[1] is not None for r in rows)
    assert joint["event_superseded"].covariates == () and joint["event_superseded"].n == n
    # the superseded intercept is the log odds of its share
    assert abs(joint["event_superseded"].coefficients[0] - np.log(3 / (n - 3))) < 1e-6
    # twelve events, of which few on complete rows: still with covariates
    assert sum(r[3] for r in rows) >= 10 > 0 and joint["event_approved"].covariates == ("x",)
    none = survival.fit_all(df.withColumn("event_dead", F.lit(0)), ("event_dead",), covariates=("x",))["event_dead"]
    assert none.coefficients == [-40.0] and none.events == 0


def test_splitting_tree():
    """Each resample draws as many clusters as there are; the draws are multinomial, and a block's don't depend on who asks."""
    k, resamples = 1000, 300
    blocks = [stats.leaf_draws(7, 3, k, b, resamples) for b in range(-(-k // stats.LEAF))]
    times = np.concatenate(blocks)
    assert times.shape == (k, resamples) and (times.sum(axis=0) == k).all()
    assert (stats.leaf_draws(7, 3, k, 5, resamples) == blocks[5]).all()
    # counts of one cluster are nearly Poisson(1); two clusters are hardly related, and resamples differ
    assert abs(times.var() - 1) < 0.03 and abs((times == 0).mean() - np.exp(-1)) < 0.01
    assert abs(np.corrcoef(times[0], times[900])[0, 1]) < 0.2 and len({tuple(c) for c in times.T}) == resamples
    assert (stats.leaf_draws(7, 3, 10_000_000, 77_777, 20).sum(axis=0) > 20).all()


def test_bootstrap_interval(spark):
    """The interval of a weighted mean agrees with drawing clusters one by one."""
    rng = np.random.default_rng(9)
    means = rng.normal(size=150)
    rows = [("g" if c < 100 else "h", f"c{c}", float(means[c] + 0.1 * rng.normal()), float(rng.integers(1, 4))) for c in range(150) for _ in range(rng.integers(1, 6))]
    df = spark.createDataFrame(rows, "g string, c string, v double, w double")
    got = {r.g: r for r in stats.cluster_bootstrap(df, "c", F.col("v"), F.col("w"), resamples=4000, by=["g"]).collect()}
    for g in ("g", "h"):
        sums: dict = {}
        for h, c, v, w in rows:
            if h == g:
                a = sums.setdefault(c, [0.0, 0.0])
                a[0] += w
                a[1] += w * v
        w, wx = np.array(list(sums.values())).T
        at = rng.integers(0, len(w), (4000, len(w)))
        means_ = np.sort(wx[at].sum(axis=1) / w[at].sum(axis=1))
        low, high = means_[100], means_[3900]
        assert got[g].clusters == len(w) and abs(got[g].estimate - wx.sum() / w.sum()) < 1e-12
        assert abs(got[g].low - low) < 0.15 * (high - low) and abs(got[g].high - high) < 0.15 * (high - low)
