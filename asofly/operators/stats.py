"""Distributions, weights, intervals and tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofly.operators.scans import HOT_ROWS, Scan, rank_selected, running, split_hot
from asofly.operators.temporal import dense_ids, global_running_sum


def share_of(rows: DataFrame, by: list[str], domain: DataFrame | None = None) -> DataFrame:
    """A3-A5: count and share of each value, null being one; values of ``domain`` that don't occur keep a zero row."""
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    if domain is not None:
        test = [F.col(f"d.{c}").eqNullSafe(F.col(f"c.{c}")) for c in by]
        cond = test[0]
        for t in test[1:]:
            cond = cond & t
        counts = domain.alias("d").join(counts.alias("c"), cond, "full").select(*[F.coalesce(f"d.{c}", f"c.{c}").alias(c) for c in by], F.coalesce("c.n", F.lit(0)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(*by, "n", F.try_divide("n", "total").alias("share"))


def top_n_other(rows: DataFrame, by: str, top: int, other: str) -> DataFrame:
    """The ``top`` most frequent values and one row for all others, with how many values those are."""
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    head = counts.orderBy(F.desc("n"), F.asc(by)).limit(top)
    rest = counts.join(F.broadcast(head.select(F.col(by).alias("_top"))), F.col(by).eqNullSafe(F.col("_top")), "left_anti")
    tail = rest.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).where("k > 0")
    return head.select(F.col(by).cast("string").alias("value"), "n").unionByName(tail.select(F.concat(F.lit(f"{other} ("), "k", F.lit(")")).alias("value"), "n"))


def ipw_weights(population: DataFrame, labelled: DataFrame, stratum: list[str]) -> DataFrame:
    """Population, labelled and weight of each stratum; strata with a null are left out."""
    known = " and ".join(f"{c} is not null" for c in stratum)
    pop = population.where(known).groupBy(*stratum).agg(F.count(F.lit(1)).alias("population"))
    lab = labelled.where(known).groupBy(*stratum).agg(F.count(F.lit(1)).alias("labelled"))
    return pop.join(lab, stratum, "left").select(*stratum, "population", F.coalesce("labelled", F.lit(0)).alias("labelled"), F.try_divide("population", "labelled").alias("weight"))


class InsufficientCoverage(Exception):
    """A population estimate was asked for while strata have no labels; ``missing`` lists them."""

    def __init__(self, missing: list):
        self.missing = missing
        super().__init__(f"{len(missing)} strata have no labels: {missing}")


def require_coverage(weights: DataFrame, stratum: list[str]) -> DataFrame:
    """Refuse an estimate that would leave out a populated stratum (a row for each stratum on the driver)."""
    missing = [tuple(r) for r in weights.where("labelled = 0").select(*stratum, "population").orderBy(*stratum).collect()]
    if missing:
        raise InsufficientCoverage(missing)
    return weights


def weighted_distribution(labelled: DataFrame, weights: DataFrame, stratum: list[str], value: str) -> DataFrame:
    """A10: weighted share and raw count of each value."""
    joined = labelled.join(weights, stratum).groupBy(value).agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n"))
    total = joined.agg(F.sum("w").alias("total"))
    return joined.crossJoin(F.broadcast(total)).select(value, "n", F.try_divide("w", "total").alias("weighted_share"))


def index_percentile(sorted_values: Column, share: float) -> Column:
    """The value at index ``int(share * n)`` (the last at most) of a sorted array; no interpolation."""
    n = F.size(sorted_values)
    at = F.least(F.floor(F.lit(share) * n), n - 1)
    return F.when(n > 0, F.get(sorted_values, at.cast("int")))


#: Clusters below which the splitting tree deals draws to clusters at once.
LEAF = 64


def _draws(seed: int, group: int, low: int, high: int, drawn, size: int):
    """Draws of one resample and of all others (a vector) that go to the lower ``size`` of the clusters [low, high): binomial, seeded by the node."""
    import numpy as np

    return np.random.Generator(np.random.Philox(key=[seed % 2**64, group * 2_654_435_761 % 2**64], counter=[low, high, 0, 0])).binomial(drawn, size / (high - low))


def leaf_draws(seed: int, group: int, k: int, block: int, resamples: int):
    """How often each cluster of a block of ``LEAF`` is drawn in each resample: (clusters of the block, resamples).

    The ``k`` draws of a resample start at the root of a tree over the numbers 0 to k - 1.
    At a node a binomial draw sends some of them to its lower half, the others to the
    upper. Every draw is seeded by the node, so each block is found by walking down to it,
    wherever it lies, and all of them together are one multinomial draw.
    """
    import numpy as np

    low, high = 0, -(-k // LEAF)  # blocks
    drawn = np.full(resamples, k, np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        lower = _draws(seed, group, low * LEAF, min(high * LEAF, k), drawn, middle * LEAF - low * LEAF)
        if block < middle:
            high, drawn = middle, lower
        else:
            low, drawn = middle, drawn - lower
    size = min(k, (block + 1) * LEAF) - block * LEAF
    rng = np.random.Generator(np.random.Philox(key=[seed % 2**64, group * 2_654_435_761 % 2**64], counter=[block * LEAF, 0, 1, 0]))
    return rng.multinomial(drawn, np.full(size, 1 / size)).T


def _resampled(seed: int, resamples: int):
    """(base, r, w, wx): weighted sums of each resample over the clusters that a task has."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        at, times = None, None
        for batch in batches:
            for base, k, n, w, wx in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if at != (base, (n - base) // LEAF):
                    at = (base, (n - base) // LEAF)
                    times = leaf_draws(seed, base, k, at[1], resamples)
                sums.setdefault(base, np.zeros((2, resamples)))
                sums[base] += times[(n - base) % LEAF] * np.array([[w or 0.0], [wx or 0.0]])
            if len(sums) > 512:  # many small groups: hand on what is summed
                yield from out(sums)
        yield from out(sums)

    def out(sums):
        import numpy as np
        import pyarrow as pa

        for base, (w, wx) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(resamples, base)), pa.array(np.arange(resamples)), pa.array(w), pa.array(wx)], names=["base", "r", "w", "wx"])
        sums.clear()

    return run


def cluster_bootstrap(rows: DataFrame, cluster: str, value: Column, weight: Column, resamples: int = 1000, seed: int = 0, by: list[str] | None = None) -> DataFrame:
    """Estimate and 95 % interval of a weighted mean, of each group of ``by``; whole clusters are drawn, not rows.

    Rows are first summed for each cluster, and clusters numbered over range partitions.
    Each resample draws as many clusters as there are: a splitting tree tells each cluster,
    where it lies, how often each resample has drawn it (``leaf_draws``). No draw is a
    row; a task hands on one sum for each resample and group it has clusters of.
    """
    by = by or []
    per = rows.groupBy(*by, cluster).agg(F.sum(weight).cast("double").alias("w"), F.sum(weight * value).cast("double").alias("wx"))
    numbered = dense_ids(per, [*by, cluster], "n")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    groups = numbered.groupBy(*by).agg(F.min("n").alias("base"), F.count(F.lit(1)).alias("k"), F.try_divide(F.sum("wx"), F.sum("w")).alias("estimate"))
    named = groups.select(*[F.col(c).alias(f"_{c}") for c in by], "base", "k")
    placed = numbered.join(named, reduce(lambda a, b: a & b, same)) if by else numbered.crossJoin(F.broadcast(named))
    # the rows of a block next to each other, so that its draws are made once
    ordered = placed.select("base", "k", "n", "w", "wx").where("n is not null").sortWithinPartitions("n")
    sums = ordered.mapInArrow(_resampled(seed, resamples), "base long, r long, w double, wx double").groupBy("base", "r").agg(F.try_divide(F.sum("wx"), F.sum("w")).alias("m"))
    ends = sums.groupBy("base").agg(F.sort_array(F.collect_list("m")).alias("s")).select("base", index_percentile(F.col("s"), 0.025).alias("low"), index_percentile(F.col("s"), 0.975).alias("high"))
    return groups.join(ends, "base", "left").select(*by, "estimate", F.col("k").alias("clusters"), "low", "high")


def grouped_summary(rows: DataFrame, by: str, value: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Counts, median, mean, range and inclusive quartiles of each group; quartiles are null below two values.

    An exact percentile holds a group's values in one task; groups of more than ``hot_rows``
    rows get theirs by ranks over range partitions instead.
    """
    n = F.count(value)
    moments = [F.count(F.lit(1)).alias("n"), n.alias("n_with_data"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max")]
    cold, hot = split_hot(rows, [by], hot_rows)
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    done = cold.groupBy(by).agg(*moments, q[1].alias("median"), q[0].alias("q1"), q[2].alias("q3"))
    if hot is not None:
        ranks = rank_selected(hot, [by], value, {"median": 0.5, "q1": 0.25, "q3": 0.75}).withColumnRenamed(by, "_by")
        done = done.unionByName(hot.groupBy(by).agg(*moments).join(ranks, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by"))
    two = F.col("n_with_data") >= 2
    return done.select(by, "n", "n_with_data", "median", "mean", "min", "max", F.when(two, F.col("q1")).alias("q1"), F.when(two, F.col("q3")).alias("q3"))


def leave_one_out_ratio(rows: DataFrame, group: list[str], key: str, value: str, least: int = 2) -> DataFrame:
    """Each row's value over the median of the other members' positive values; null below ``least`` of them.

    All rows are ordered once over range partitions, so a group of any size is split, and a
    positive row's rank is its place less that of its group's first (no pairs, no window
    over a group). The median of the others is read from the ranked values around the
    middle, stepping over the row's own rank. Rows of a null group have no peers.
    """
    positive = F.coalesce(F.col(value) > 0, F.lit(False))
    placed = dense_ids(rows.withColumn("_pos", positive), [*group, "_pos", value, key], "_at")
    base = placed.where("_pos").groupBy(*group).agg(F.min("_at").alias("_base"), F.count(F.lit(1)).alias("_n"))
    ranked = placed.join(base, group, "left").withColumn("_n", F.coalesce("_n", F.lit(0))).withColumn("_r", F.when(F.col("_pos"), F.col("_at") - F.col("_base") + 1))
    mids = ranked.where("_r is not null and _r between _n div 2 - 2 and _n div 2 + 3").groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("_r", value))).alias("_mid"))
    peers = F.col("_n") - F.when(F.col("_r").isNotNull(), 1).otherwise(0)
    joined = ranked.join(mids, group, "left").withColumn("peers", peers)

    def at(position: Column) -> Column:
        shifted = F.when(F.col("_r").isNotNull() & (position >= F.col("_r")), position + 1).otherwise(position)
        return F.try_element_at("_mid", shifted.cast("long"))

    low, high = F.floor((F.col("peers") + 1) / 2), F.floor((F.col("peers") + 2) / 2)
    median = F.when(F.col("peers") >= least, (at(low) + at(high)) / 2)
    return joined.select(*rows.columns, F.col("peers").cast("long").alias("peers"), median.alias("peer_median"), F.try_divide(F.col(value), median).alias("ratio"))


def majority_vote(rows: DataFrame, by: list[str], vote: str, position: str) -> DataFrame:
    """The most frequent vote of each group, of ties the one seen first, with its count and whether all agree."""
    votes = rows.groupBy(*by, vote).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("first"))
    best = F.max_by(F.struct(F.col(vote), F.col("n")), F.struct(F.col("n"), -F.col("first")))
    return votes.groupBy(*by).agg(best.alias("b"), F.sum("n").alias("votes"), F.count(F.lit(1)).alias("options")).select(*by, F.col("b")[vote].alias("winner"), F.col("b")["n"].alias("n"), "votes", (F.col("options") == 1).alias("unanimous"))


def strict_majority(rows: DataFrame, by: list[str], vote: str) -> DataFrame:
    """The vote with at least two and more than all others together, else null."""
    votes = rows.groupBy(*by, vote).agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy(*by).agg(F.max_by(vote, "n").alias("v"), F.max("n").alias("top"), F.sum("n").alias("votes"))
    return best.select(*by, F.when((F.col("top") >= 2) & (2 * F.col("top") > F.col("votes")), F.col("v")).alias("winner"))


def kaplan_meier(rows: DataFrame, by: str, duration: str, event: Column, hot_rows: int = HOT_ROWS) -> DataFrame:
    """M9: at-risk counts, events and the product-limit survival at each time of each group; zero once all at risk fail.

    Rows are first summed by time, so a group is as long as its distinct times; longer ones than ``hot_rows`` are split.
    """
    times = rows.groupBy(by, duration).agg(F.sum(event.cast("int")).alias("events"), F.count(F.lit(1)).alias("leaving"))
    risk = running(times, [by], [duration], {"at_risk": Scan("leaving", "sum", backward=True)}, hot_rows)
    all_fail = F.col("events") == F.col("at_risk")
    steps = risk.withColumns({"_all": all_fail.cast("int"), "_log": F.when(all_fail, 0.0).otherwise(F.log1p(-F.col("events") / F.col("at_risk")))})
    curve = running(steps, [by], [duration], {"_dead": Scan("_all", "max"), "_logs": Scan("_log", "sum")}, hot_rows)
    return curve.select(by, duration, "events", "at_risk", F.when(F.col("_dead") == 1, 0.0).otherwise(F.exp("_logs")).alias("survival"))


def median_survival(curve: DataFrame, by: str, duration: str) -> DataFrame:
    """M9: first time at which survival is at most a half, null if it stays above."""
    return curve.groupBy(by).agg(F.min(F.when(F.col("survival") <= 0.5, F.col(duration))).alias("median_survival"))


def anova_icc(rows: DataFrame, cluster: str, value: str) -> DataFrame:
    """One-way F and intraclass correlation from grouped moments; the correlation is clipped at zero."""
    g = rows.where(F.col(value).isNotNull()).groupBy(cluster).agg(F.count(value).cast("double").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    t = g.agg(F.count(F.lit(1)).cast("double").alias("k"), F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n")).alias("n2"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("gm"), F.sum(F.col("n") * F.col("v")).alias("within"))
    between = g.crossJoin(F.broadcast(t)).agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("gm"), 2)).alias("between"))
    x = t.crossJoin(between)
    msb, msw = F.try_divide("between", F.col("k") - 1), F.try_divide("within", F.col("total") - F.col("k"))
    n0 = F.try_divide(F.col("total") - F.col("n2") / F.col("total"), F.col("k") - 1)
    x = x.select(F.col("k").cast("long").alias("clusters"), F.col("total").cast("long").alias("n"), msb.alias("b"), msw.alias("w"), n0.alias("n0"))
    return x.select("clusters", "n", F.try_divide("b", "w").alias("f"), F.greatest(F.lit(0.0), F.try_divide(F.col("b") - F.col("w"), F.col("b") + (F.col("n0") - 1) * F.col("w"))).alias("icc"))


def mann_whitney(rows: DataFrame, value: str, first: Column) -> DataFrame:
    """U of the first sample, effect size, tie-corrected z and two-sided p of the normal approximation.

    Ranks need each distinct value's count and how many lie below: a running sum over distinct values in order.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.sum(first.cast("long")).alias("a"), F.count(F.lit(1)).alias("t"))
    ranked = global_running_sum(counts, [value], "t", "below").withColumn("rank", F.col("below") + (F.col("t") + 1) / 2)
    s = ranked.agg(F.sum("a").cast("double").alias("n1"), F.sum(F.col("t") - F.col("a")).cast("double").alias("n2"), F.sum(F.col("a") * F.col("rank")).alias("r1"), F.sum(F.pow(F.col("t").cast("double"), 3) - F.col("t")).alias("ties"))
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    n, mid = F.col("n1") + F.col("n2"), F.col("n1") * F.col("n2") / 2
    sigma = F.sqrt(F.col("n1") * F.col("n2") / 12 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1))))
    z = F.try_divide(u - mid - F.signum(u - mid) * 0.5, sigma)
    p = 2 * (1 - _normal_cdf(F.abs(z)))
    return s.select(F.col("n1").cast("long").alias("n1"), F.col("n2").cast("long").alias("n2"), u.alias("u"), F.try_divide(u, F.col("n1") * F.col("n2")).alias("effect"), z.alias("z"), F.least(F.lit(1.0), p).alias("p"))


def _normal_cdf(x: Column) -> Column:
    """Abramowitz and Stegun 26.2.17 for x >= 0; off by less than 7.5e-8."""
    t = 1 / (1 + 0.2316419 * x)
    poly = F.lit(0.0)
    for c in (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530):
        poly = (poly + c) * t
    return 1 - F.exp(-x * x / 2) / F.lit(2.5066282746310002) * poly


def gaussian_mixture(rows: DataFrame, value: str, k: int = 2, rounds: int = 200, tol: float = 1e-8) -> dict:
    """M7: 1-D mixture by EM over distinct values; log-likelihood, BIC and, for two components, Ashman's D.

    It ends after ``rounds``, or when the log-likelihood moves by less than ``tol``. Each round is one aggregate that returns k triples of sums; starts are quantiles.
    """
    import math

    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("x")).agg(F.count(F.lit(1)).cast("double").alias("c")).persist()
    n, mean, var = counts.agg(F.sum("c"), F.sum(F.col("c") * F.col("x")) / F.sum("c"), F.sum(F.col("c") * F.col("x") * F.col("x")) / F.sum("c") - F.pow(F.sum(F.col("c") * F.col("x")) / F.sum("c"), 2)).first()
    if not n:
        counts.unpersist()
        return {"n": 0}
    floor = max(var * 1e-6, 1e-12)
    means = rows.select(F.percentile(value, F.array(*[F.lit((i + 0.5) / k) for i in range(k)])).alias("q")).first().q
    comps = [(1 / k, m, max(var / k, floor)) for m in means]
    last, done = -math.inf, 0
    for done in range(1, rounds + 1):  # noqa: B007
        dens = [F.lit(w / math.sqrt(2 * math.pi * v)) * F.exp(-F.pow(F.col("x") - m, 2) / (2 * v)) for w, m, v in comps]
        total = dens[0]
        for d in dens[1:]:
            total = total + d
        total = F.greatest(total, F.lit(1e-300))
        aggs = [F.sum(F.col("c") * F.log(total)).alias("ll")]
        for i, d in enumerate(dens):
            r = F.col("c") * d / total
            aggs += [F.sum(r).alias(f"r{i}"), F.sum(r * F.col("x")).alias(f"s{i}"), F.sum(r * F.col("x") * F.col("x")).alias(f"q{i}")]
        row = counts.agg(*aggs).first()
        comps = [(max(row[f"r{i}"] / n, 1e-12), row[f"s{i}"] / max(row[f"r{i}"], 1e-300), max(row[f"q{i}"] / max(row[f"r{i}"], 1e-300) - (row[f"s{i}"] / max(row[f"r{i}"], 1e-300)) ** 2, floor)) for i in range(k)]
        if abs(row.ll - last) < tol:
            break
        last = row.ll
    counts.unpersist()
    out = {"n": int(n), "k": k, "log_likelihood": row.ll, "bic": (3 * k - 1) * math.log(n) - 2 * row.ll, "components": comps, "rounds": done}
    if k == 2:
        (_, m1, v1), (_, m2, v2) = comps
        out["ashman_d"] = math.sqrt(2) * abs(m1 - m2) / math.sqrt(v1 + v2)
    return out


def correlation_pca(rows: DataFrame, columns: list[str]) -> dict:
    """M8: correlation matrix, its eigenvalues and condition number, of complete rows.

    One pass for the means, one for the products of centred values: a task adds up a
    matrix of its rows, and the matrices are added by place, so what reaches the driver is
    one matrix. A constant column correlates with nothing.
    """
    import numpy as np

    d = len(columns)
    clean = rows.select(*[F.col(c).cast("double").alias(c) for c in columns]).na.drop()
    first = clean.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], F.count(F.lit(1)).alias("n")).first()
    means = np.array([first[f"m{i}"] or 0.0 for i in range(d)])

    def products(batches):
        import pyarrow as pa

        total = np.zeros((d, d))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) - means
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d)), pa.array(total.reshape(-1))], ["at", "s"])

    sums = clean.mapInArrow(products, "at long, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()
    cov = np.zeros(d * d)
    for r in sums:
        cov[r["at"]] = r.s
    cov = cov.reshape(d, d)
    scale = np.sqrt(np.diag(cov))
    flat = np.outer(scale, scale)
    m = np.divide(cov, flat, out=np.zeros((d, d)), where=flat > 0)
    np.fill_diagonal(m, 1.0)
    values, vectors = np.linalg.eigh(m)
    return {"n": first.n, "correlation": m, "eigenvalues": values[::-1], "vectors": vectors[:, ::-1], "condition": float(values[-1] / max(values[0], 1e-300))}


def ols_residuals(rows: DataFrame, y: str, x: str, name: str = "residual") -> DataFrame:
    """M8: residual of y on x."""
    fit = rows.agg(F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"))
    return rows.crossJoin(F.broadcast(fit)).withColumn(name, F.col(y) - F.col("_a") - F.col("_b") * F.col(x)).drop("_a", "_b")
