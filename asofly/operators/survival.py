"""Person-period tables, hazards, flags and back-tests."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofly.operators.ranges import ranged
from asofly.operators.scans import Scan, running

COVARIATES = ("silence_score_asof", "log_cost_index", "log_conviction_ratio")
MIN_EVENTS = 10
#: Thresholds up to which they are broadcast: 8 bytes each.
FEW_CUTS = 1_000_001


def outcomes(programs: DataFrame, labels: DataFrame, panel_end: Column) -> DataFrame:
    """M1: outcome and month of each labelled program: dead at its confirmation date (censored without one),
    approved or superseded at the first actual primary completion, else censored at the end."""
    done = F.array_min(F.transform(F.filter("trials", lambda t: t["primary_completion_type"] == "ACTUAL"), lambda t: t["primary_completion_date"]))
    j = programs.join(labels.select("program_id", "status", F.col("public_confirmation_date").cast("date").alias("_dead")), "program_id").withColumn("_done", done.cast("date"))
    dead = (F.col("status") == "dead_confirmed") & F.col("_dead").isNotNull()
    ended = F.col("status").isin("approved", "superseded") & F.col("_done").isNotNull()
    return j.select("program_id", F.when(dead, "dead").when(ended, F.col("status")).otherwise("censored").alias("outcome"), F.when(dead, F.col("_dead")).when(ended, F.col("_done")).otherwise(panel_end).alias("event_month"))


def training_table(panel: DataFrame, outcome: DataFrame, panel_end: Column, compat: bool = False) -> DataFrame:
    """Panel rows up to the event, log1p covariates, and an event on the last row.

    An event after ``panel_end`` is censored there. ``compat`` marks it all the same, which
    leaks a label from behind the cut; it is for comparing with results made that way.
    """
    j = panel.join(outcome, "program_id").where((F.col("as_of") <= F.col("event_month")) & (F.col("as_of") <= panel_end))
    last = F.row_number().over(Window.partitionBy("program_id").orderBy(F.col("as_of").desc())) == 1
    seen = F.lit(True) if compat else F.col("event_month") <= panel_end
    marks = {f"event_{k}": (last & seen & (F.col("outcome") == k)).cast("int") for k in ("dead", "approved", "superseded")}
    return j.withColumns(
        {
            **marks,
            "silence_score_asof": F.coalesce(F.col("silence_score_asof").cast("double"), F.lit(0.0)),
            "log_cost_index": F.log1p(F.coalesce("cost_index", F.lit(0.0))),
            "log_conviction_ratio": F.log1p("conviction_ratio"),
        }
    )


@dataclass
class Hazard:
    """Coefficients (intercept first), their cluster-robust standard errors, and what they were fitted on."""

    covariates: tuple[str, ...]
    coefficients: list[float]
    errors: list[float]
    n: int
    events: int
    clusters: int

    def column(self) -> Column:
        """M4: predicted hazard; null where a covariate is."""
        eta = F.lit(self.coefficients[0])
        for name, b in zip(self.covariates, self.coefficients[1:], strict=True):
            eta = eta + F.lit(b) * F.col(name)
        return 1 / (1 + F.exp(-eta))


def _never(n: int) -> Hazard:
    """A hazard of nothing: no row, or no event."""
    return Hazard((), [-40.0], [float("nan")], n, 0, 0)


class _Cause:
    """One cause's rows, covariates and present coefficients within the joint fit."""

    def __init__(self, at: int, event: str, names: tuple[str, ...], covariates: tuple[str, ...]):
        self.at, self.event, self.names = at, event, names
        # its own complete-case rule: rows count where all covariates in use are known
        self.used = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in covariates if names], F.lit(True))
        self.x = [F.lit(1.0), *[F.col(c).cast("double") for c in names]]
        self.beta = [0.0] * len(self.x)
        self.done = False

    def _sum(self, c: Column) -> Column:
        return F.coalesce(F.sum(F.when(self.used, c)), F.lit(0.0))

    def size(self) -> list[Column]:
        return [F.count_if(self.used).alias(f"n{self.at}"), F.coalesce(F.sum(F.when(self.used, F.col(self.event))), F.lit(0)).alias(f"e{self.at}")]

    def mu(self) -> Column:
        return 1 / (1 + F.exp(-sum((F.lit(float(v)) * c for v, c in zip(self.beta, self.x, strict=True)), F.lit(0.0))))

    def score(self) -> list[Column]:
        rest = F.col(self.event) - self.mu()
        return [self._sum(rest * c).alias(f"g{self.at}_{i}") for i, c in enumerate(self.x)]

    def information(self) -> list[Column]:
        mu, p = self.mu(), len(self.x)
        return [self._sum(mu * (1 - mu) * self.x[i] * self.x[j]).alias(f"h{self.at}_{i}_{j}") for i in range(p) for j in range(i, p)]

    def products(self) -> list[Column]:
        """Sums of products of per-cluster scores; clusters without a row in use have zero scores and aren't counted."""
        p = len(self.x)
        return [F.sum(F.col(f"g{self.at}_{i}") * F.col(f"g{self.at}_{j}")).alias(f"h{self.at}_{i}_{j}") for i in range(p) for j in range(i, p)] + [F.count_if(F.col(f"n{self.at}") > 0).alias(f"k{self.at}")]

    def matrix(self, row):
        import numpy as np

        p = len(self.x)
        h = np.zeros((p, p))
        for i in range(p):
            for j in range(i, p):
                h[i, j] = h[j, i] = row[f"h{self.at}_{i}_{j}"]
        return h


def fit_all(table: DataFrame, events: tuple[str, ...], cluster: str = "sponsor", covariates: tuple[str, ...] = COVARIATES, rounds: int = 50, tol: float = 1e-10) -> dict[str, Hazard]:
    """M3: the logits of all causes by joint Newton steps: one pass a step, whatever the number of causes.

    A step's aggregate returns gradient and information of every cause that hasn't converged;
    one more pass gives all sandwiches of per-cluster scores, with the factor k / (k - 1).
    A cause with fewer than ten events in the whole table gets an intercept only and
    all rows; others use the rows on which all covariates are known.
    """
    import numpy as np

    table = table.select(cluster, *events, *covariates).persist()
    try:
        whole = table.agg(*[F.coalesce(F.sum(e), F.lit(0)).alias(f"e{i}") for i, e in enumerate(events)]).first()
        causes = [_Cause(i, e, covariates if whole[f"e{i}"] >= MIN_EVENTS else (), covariates) for i, e in enumerate(events)]
        sizes = table.agg(*[c for k in causes for c in k.size()]).first()
        fitted = [k for k in causes if sizes[f"e{k.at}"]]
        for _ in range(rounds):
            todo = [k for k in fitted if not k.done]
            if not todo:
                break
            row = table.agg(*[c for k in todo for c in (*k.score(), *k.information())]).first()
            for k in todo:
                step = np.linalg.solve(k.matrix(row) + 1e-12 * np.eye(len(k.x)), np.array([row[f"g{k.at}_{i}"] for i in range(len(k.x))]))
                k.beta = (np.array(k.beta) + np.clip(step, -5, 5)).tolist()
                k.done = bool(np.abs(step).max() < tol)
        out = {k.event: _never(sizes[f"n{k.at}"]) for k in causes}
        if fitted:
            bread = table.agg(*[c for k in fitted for c in k.information()]).first()
            per = table.groupBy(cluster).agg(*[c for k in fitted for c in (*k.score(), k.size()[0])])
            meat = per.agg(*[c for k in fitted for c in k.products()]).first()
            for k in fitted:
                inverse, clusters = np.linalg.inv(k.matrix(bread) + 1e-12 * np.eye(len(k.x))), meat[f"k{k.at}"]
                cov = inverse @ k.matrix(meat) @ inverse * (clusters / (clusters - 1) if clusters > 1 else 1.0)
                out[k.event] = Hazard(k.names, k.beta, np.sqrt(np.diag(cov)).tolist(), sizes[f"n{k.at}"], int(sizes[f"e{k.at}"]), clusters)
        return out
    finally:
        table.unpersist()


def fit_hazard(table: DataFrame, event: str, cluster: str = "sponsor", covariates: tuple[str, ...] = COVARIATES, rounds: int = 50, tol: float = 1e-10) -> Hazard:
    """M3: the logit of one cause."""
    return fit_all(table, (event,), cluster, covariates, rounds, tol)[event]


def thresholds(predictions: DataFrame, score: str) -> DataFrame:
    """Distinct predictions rounded to six places; NaN and null are none."""
    return predictions.where(F.col(score).isNotNull() & ~F.isnan(score)).select(F.round(score, 6).alias("threshold")).distinct()


def flags(predictions: DataFrame, score: str, cuts: DataFrame) -> DataFrame:
    """First date at which each program's score reaches each threshold.

    A program's first crossing of a threshold lies on a strict running maximum of its
    scores, so only those records meet the thresholds. Thresholds are broadcast while
    their number is counted to be at most ``FEW_CUTS``, as those of a hazard rounded to six
    places always are; more of them are met through their buckets of a thousandth.
    """
    clean = predictions.where(F.col(score).isNotNull() & ~F.isnan(score))
    before = F.max(score).over(Window.partitionBy("program_id").orderBy("as_of").rowsBetween(Window.unboundedPreceding, -1))
    records = clean.withColumn("_before", before).where(F.col("_before").isNull() | (F.col(score) > F.col("_before")))
    met = (F.col("threshold") <= F.col(score)) & (F.col("_before").isNull() | (F.col("threshold") > F.col("_before")))
    if cuts.count() <= FEW_CUTS:
        hit = records.join(F.broadcast(cuts), met)
    else:
        bucket = lambda c: F.floor(c * 1000).cast("long")
        low = cuts.agg(F.min(bucket(F.col("threshold")))).first()[0]
        spans = records.withColumn("_b", F.explode(F.sequence(F.greatest(F.coalesce(bucket(F.col("_before")), F.lit(low)), F.lit(low)), F.greatest(bucket(F.col(score)), F.lit(low)))))
        hit = spans.join(cuts.withColumn("_b", bucket(F.col("threshold"))), "_b").where(met)
    return hit.groupBy("program_id", "threshold").agg(F.min("as_of").alias("flag_date"))


def curve(flagged: DataFrame, outcome: DataFrame, cuts: DataFrame) -> DataFrame:
    """For each threshold: flagged, correct, precision (null without flags), recall over all dead, median lead time.

    Lead time is flag minus event in days: more negative is earlier, so better. A flag is
    correct if the program dies and was flagged by then or later all the same.
    """
    dead = outcome.agg(F.count_if(F.col("outcome") == "dead").alias("n_dead"))
    j = flagged.join(outcome, "program_id")
    is_dead = F.col("outcome") == "dead"
    per = j.groupBy("threshold").agg(F.count(F.lit(1)).alias("n_flagged"), F.count_if(is_dead).alias("n_correct"), F.median(F.when(is_dead, F.datediff("flag_date", "event_month"))).alias("median_lead_days"))
    full = cuts.join(per, "threshold", "left").crossJoin(F.broadcast(dead)).na.fill(0, ["n_flagged", "n_correct"])
    return full.select("threshold", "n_flagged", "n_correct", F.try_divide("n_correct", "n_flagged").alias("precision"), F.try_divide("n_correct", "n_dead").alias("recall"), "median_lead_days")


class RunningMedian:
    """Median of a multiset over known sorted values whose counts move by small steps; the place of the median moves with them."""

    def __init__(self, values: list[int], counts: list[int]):
        self.values, self.counts, self.total = values, counts, sum(counts)
        self.at = self.below = 0

    def add(self, at: int, n: int) -> None:
        self.counts[at] += n
        self.total += n
        if at < self.at:
            self.below += n

    def median(self) -> float | None:
        if not self.total:
            return None
        low, high = (self.total - 1) // 2, self.total // 2
        while self.below > low:
            self.at -= 1
            self.below -= self.counts[self.at]
        while self.below + self.counts[self.at] <= low:
            self.below += self.counts[self.at]
            self.at += 1
        upper = self.at
        if high >= self.below + self.counts[upper]:
            upper += 1
            while not self.counts[upper]:
                upper += 1
        return (self.values[self.at] + self.values[upper]) / 2


def _swept(rows, start):
    """One range of the sweep: its events and thresholds from the highest down, on top of what is active above it."""
    import pandas as pd

    # a group that one side lacks comes without columns
    rows, start = rows.reindex(columns=["_i", "kind", "x", "dead", "lead", "n"]), start.reindex(columns=["dead", "lead", "n"])
    leads = sorted({int(x) for frame in (rows, start) for x in frame["lead"].dropna()})
    place = {x: i for i, x in enumerate(leads)}
    active = RunningMedian(leads, [0] * len(leads))
    flagged = correct = 0
    out = []

    def move(dead: bool, lead: float, n: int) -> None:
        nonlocal flagged, correct
        flagged += n
        if dead:
            correct += n
            if not pd.isna(lead):
                active.add(place[int(lead)], n)

    for dead, lead, n in zip(start["dead"].tolist(), start["lead"].tolist(), start["n"].tolist(), strict=True):
        move(dead, lead, n)
    ordered = rows.sort_values("_i")
    for cut, x, dead, lead, n in zip(*(ordered[c].tolist() for c in ("kind", "x", "dead", "lead", "n")), strict=True):
        if cut:
            out.append((x, flagged, correct, active.median()))
        else:
            move(dead, lead, n)
    return pd.DataFrame(out, columns=["threshold", "n_flagged", "n_correct", "median_lead_days"]).astype({"threshold": float, "n_flagged": "int64", "n_correct": "int64", "median_lead_days": float})


def sweep(predictions: DataFrame, score: str, outcome: DataFrame, cuts: DataFrame) -> DataFrame:
    """The rows of ``curve`` for any number of thresholds, in time linear in records and thresholds.

    A program is flagged at a threshold by the one strict running maximum of its scores
    that first reaches it: the record's interval (maximum before, score]. A line swept from
    the highest threshold down meets the interval's upper end (+1) and its lower end (-1).
    Events and thresholds are laid out over range partitions; what is active above a
    partition is the sum of the events before it by lead time, so each partition starts
    with its own histogram and runs alone. No (program, threshold) rows are formed.
    """
    clean = predictions.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))).select("program_id", "as_of", F.col(score).cast("double").alias("_s"))
    ran = running(clean, ["program_id"], ["as_of"], {"_before": Scan("_s", "max", exclusive=True)})
    records = ran.where(F.col("_before").isNull() | (F.col("_s") > F.col("_before"))).join(outcome, "program_id")
    dead = F.coalesce(F.col("outcome") == "dead", F.lit(False))
    ends = F.explode(F.array(F.struct(F.col("_s").alias("x"), F.lit(1).alias("n")), F.struct(F.col("_before").alias("x"), F.lit(-1).alias("n")))).alias("e")
    each = records.select(dead.alias("dead"), F.when(dead, F.datediff("as_of", "event_month")).alias("lead"), ends).select("dead", "lead", "e.x", "e.n").where("x is not null")
    events = each.groupBy("x", "dead", "lead").agg(F.sum("n").alias("n")).where("n <> 0").withColumn("kind", F.lit(0))
    points = cuts.select(F.col("threshold").cast("double").alias("x"), F.lit(False).alias("dead"), F.lit(None).cast("int").alias("lead"), F.lit(0).cast("long").alias("n"), F.lit(1).alias("kind"))
    line = ranged(events.unionByName(points).withColumn("y", -F.col("x")), ["y", "kind"], "sweep")
    w = Window.partitionBy("dead", "lead").orderBy("_p")
    last = line.agg(F.max("_p")).first()[0] or 0
    moved = line.where("kind = 0").groupBy("_p", "dead", "lead").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(w)).withColumn("next", F.coalesce(F.lead("_p").over(w), F.lit(last)))
    start = moved.where((F.col("upto") != 0) & (F.col("next") > F.col("_p"))).select(F.explode(F.sequence(F.col("_p") + 1, F.col("next"))).alias("_p"), "dead", "lead", F.col("upto").alias("n"))
    swept = line.groupBy("_p").cogroup(start.groupBy("_p")).applyInPandas(_swept, "threshold double, n_flagged long, n_correct long, median_lead_days double")
    n_dead = outcome.agg(F.count_if(F.col("outcome") == "dead").alias("n_dead"))
    rates = swept.crossJoin(F.broadcast(n_dead))
    return rates.select("threshold", "n_flagged", "n_correct", F.try_divide("n_correct", "n_flagged").alias("precision"), F.try_divide("n_correct", "n_dead").alias("recall"), F.when(~F.isnan("median_lead_days"), F.col("median_lead_days")).alias("median_lead_days"))


def most_precise(points: DataFrame) -> DataFrame:
    """The point of the highest precision; of ties the one of the earliest median lead (none counts as 0), then of the highest recall, then the lowest threshold."""
    usable = points.where("precision is not null")
    return usable.orderBy(F.desc("precision"), F.coalesce("median_lead_days", F.lit(0.0)), F.desc(F.coalesce("recall", F.lit(0.0))), "threshold").limit(1)


def best_point(points: DataFrame, least_precision: float = 0.5) -> DataFrame:
    """The point with the earliest median lead among those of enough precision and a correct flag."""
    usable = points.where((F.col("precision") >= least_precision) & (F.col("n_correct") > 0))
    return usable.orderBy("median_lead_days", F.desc("precision"), F.desc("recall"), "threshold").limit(1)


def gate(model: DataFrame, heuristic: DataFrame, least_precision: float = 0.5) -> tuple[bool, str]:
    """Whether the model flags earlier than the heuristic at enough precision (a row of each on the driver)."""
    m, h = best_point(model, least_precision).first(), best_point(heuristic, least_precision).first()
    if m is None and h is None:
        return False, "neither reaches the precision"
    if m is None:
        return False, "the model never reaches the precision"
    if h is None:
        return True, "the heuristic never reaches the precision"
    return m.median_lead_days < h.median_lead_days, f"median lead {m.median_lead_days} against {h.median_lead_days} days"
