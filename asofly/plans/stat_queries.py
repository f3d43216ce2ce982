"""Queries of the statistics, label, matrix and audit operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofly.functions import vocab as V
from asofly.functions.text import stated_reason, wilson
from asofly.operators import labels as L
from asofly.operators import programs, stats, survival, triage
from asofly.plans.registry import query
from asofly.plans.tables import lineitem, orders, table

STRATA_SQL = "p AS (SELECT doc_id, lang, CASE WHEN n_chars < 1000 THEN 0 WHEN n_chars < 3000 THEN 1 ELSE 2 END AS size_band FROM documents)"


def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return d.select("doc_id", "lang", F.when(F.col("n_chars") < 1000, 0).when(F.col("n_chars") < 3000, 1).otherwise(2).alias("size_band"))


WEIGHTS_SQL = f"""{STRATA_SQL},
w AS (SELECT lang, size_band, count(*) AS population, count(l.doc_id) AS labelled, CASE WHEN count(l.doc_id) > 0 THEN count(*) / count(l.doc_id) END AS weight FROM p LEFT JOIN labels l USING (doc_id) GROUP BY lang, size_band)"""


@query(f"WITH {WEIGHTS_SQL} SELECT lang, size_band, population, labelled, round(weight, 6) AS weight FROM w")
def ipw_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of strata of language and size."""
    p = strata(spark, sf_dir)
    w = stats.ipw_weights(p, p.join(table(spark, sf_dir, "labels"), "doc_id"), ["lang", "size_band"])
    return w.withColumn("weight", F.round("weight", 6))


@query(f"""WITH {WEIGHTS_SQL}, j AS (SELECT quality, weight FROM p JOIN labels USING (doc_id) JOIN w USING (lang, size_band))
SELECT quality, count(*) AS n, round(sum(weight) / (SELECT sum(weight) FROM j), 6) AS weighted_share FROM j GROUP BY quality""")
def weighted_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: population shares of a label from a weighted sample."""
    p = strata(spark, sf_dir)
    lab = p.join(table(spark, sf_dir, "labels"), "doc_id")
    w = stats.ipw_weights(p, lab, ["lang", "size_band"])
    return stats.weighted_distribution(lab, w.select("lang", "size_band", "weight"), ["lang", "size_band"], "quality").withColumn("weighted_share", F.round("weighted_share", 6))


@query(f"""WITH {STRATA_SQL}, l AS (SELECT * FROM labels JOIN p USING (doc_id) WHERE lang <> 'es')
SELECT p.lang, p.size_band, count(*) AS population FROM p LEFT JOIN l USING (doc_id) GROUP BY p.lang, p.size_band HAVING count(l.doc_id) = 0""")
def stratum_refusal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strata for which an estimate must be refused, here with one language unlabelled."""
    p = strata(spark, sf_dir)
    w = stats.ipw_weights(p, p.where("lang <> 'es'").join(table(spark, sf_dir, "labels"), "doc_id"), ["lang", "size_band"])
    return w.where("labelled = 0").select("lang", "size_band", "population")


@query()
def cluster_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of a share with sources as clusters. The draws hash by Spark's XXH64, so no other engine repeats them."""
    j = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return stats.cluster_bootstrap(j, "source", F.col("toxic").cast("double"), F.lit(1.0))


@query("""
SELECT l_returnflag, count(*) AS n, count(l_extendedprice) AS n_with_data, round(median(l_extendedprice), 4) AS median, round(avg(l_extendedprice), 4) AS mean, min(l_extendedprice) AS min, max(l_extendedprice) AS max,
  round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3 FROM lineitem GROUP BY l_returnflag""")
def grouped_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary of prices by flag."""
    s = stats.grouped_summary(lineitem(spark, sf_dir), "l_returnflag", "l_extendedprice")
    return s.withColumns({c: F.round(c, 4) for c in ("median", "mean", "q1", "q3")})


@query("""
WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, o_custkey) AS k FROM n)
SELECT CASE WHEN k <= 10 THEN CAST(o_custkey AS VARCHAR) ELSE 'other (' || (SELECT count(*) FROM r WHERE k > 10) || ')' END AS value, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY ALL""")
def topn_other_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten customers with most orders and all others as one."""
    return stats.top_n_other(orders(spark, sf_dir), "o_custkey", 10, "other")


@query("""WITH v AS (SELECT CASE WHEN event_type <> 'view' THEN event_type END AS kind FROM events)
SELECT kind, count(*) AS n, round(count(*) / (SELECT count(*) FROM v), 6) AS share FROM v GROUP BY kind""")
def value_counts_null_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4, A5: counts of values, null being one."""
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_type") != "view", F.col("event_type")).alias("kind"))
    return stats.share_of(e, ["kind"]).withColumn("share", F.round("share", 6))


@query("""
WITH n AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)
SELECT CAST(sum(n) AS BIGINT) AS total, round(avg(n), 4) AS mean, median(n) AS median, max(n) AS most, count(*) FILTER (WHERE n = 0) AS without, (SELECT count(DISTINCT l_partkey) FROM lineitem) AS distinct_children FROM n""")
def child_count_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children for each parent: sum, mean, median, most, none, and distinct ones overall."""
    o = orders(spark, sf_dir).select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    per = programs.child_stats(table(spark, sf_dir, "customer"), o, "c_custkey", "o_orderkey").drop("distinct_children")
    parts = programs.child_stats(orders(spark, sf_dir).select(F.col("o_orderkey").alias("l_orderkey")), lineitem(spark, sf_dir), "l_orderkey", "l_partkey").select("distinct_children")
    return per.withColumn("mean", F.round("mean", 4)).crossJoin(parts)


@query("""WITH v AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL)
SELECT user_id, max_by(event_type, struct_pack(a := n, b := -first)) AS winner, max(n) AS n, CAST(sum(n) AS BIGINT) AS votes, count(*) = 1 AS unanimous FROM v GROUP BY user_id""")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's most frequent event type, of ties the one seen first."""
    return stats.majority_vote(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


@query("""WITH v AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_orderkey, CASE WHEN max(n) >= 2 AND 2 * max(n) > sum(n) THEN max_by(l_returnflag, n) END AS winner FROM v GROUP BY l_orderkey""")
def strict_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's flag if it has at least two lines and more than all others together."""
    return stats.strict_majority(lineitem(spark, sf_dir), ["l_orderkey"], "l_returnflag")


@query("""
WITH t AS (SELECT o_orderpriority, CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) // 30 AS INTEGER) AS months, l_linestatus = 'F' AS event FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate),
u AS (SELECT o_orderpriority, months, CAST(sum(CAST(event AS INT)) AS BIGINT) AS events, count(*) AS leaving FROM t GROUP BY ALL),
r AS (SELECT *, CAST(sum(leaving) OVER (PARTITION BY o_orderpriority ORDER BY months DESC) AS BIGINT) AS at_risk FROM u)
SELECT o_orderpriority, months, events, at_risk, round(coalesce(exp(sum(CASE WHEN events < at_risk THEN ln(1 - events / at_risk) END) OVER w) * CASE WHEN bool_or(events = at_risk) OVER w THEN 0 ELSE 1 END, CASE WHEN bool_or(events = at_risk) OVER w THEN 0.0 ELSE 1.0 END), 6) AS survival
FROM r WINDOW w AS (PARTITION BY o_orderpriority ORDER BY months)""")
def km_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: product-limit survival of the time from order to shipment."""
    j = lineitem(spark, sf_dir).join(orders(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey")).where("l_shipdate >= o_orderdate")
    t = j.select("o_orderpriority", F.floor(F.datediff("l_shipdate", "o_orderdate") / 30).cast("int").alias("months"), (F.col("l_linestatus") == "F").alias("event"))
    return stats.kaplan_meier(t, "o_orderpriority", "months", F.col("event")).withColumn("survival", F.round("survival", 6))


@query("""
WITH g AS (SELECT l_suppkey, count(*) AS n, avg(l_quantity) AS m, var_pop(l_quantity) AS v FROM lineitem GROUP BY l_suppkey),
t AS (SELECT count(*) AS k, sum(n) AS big, sum(n * n) AS n2, sum(n * m) / sum(n) AS gm, sum(n * v) AS within FROM g),
b AS (SELECT any_value(k) AS k, any_value(big) AS big, any_value(n2) AS n2, any_value(within) AS within, sum(n * (m - gm) ** 2) AS between_ FROM g, t),
x AS (SELECT k, big, between_ / (k - 1) AS msb, within / (big - k) AS msw, (big - n2 / big) / (k - 1) AS n0 FROM b)
SELECT k AS clusters, CAST(big AS BIGINT) AS n, round(msb / msw, 4) AS f, round(greatest(0.0, (msb - msw) / (msb + (n0 - 1) * msw)), 6) AS icc FROM x""")
def icc_anova(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F and intraclass correlation of quantities within suppliers."""
    return stats.anova_icc(lineitem(spark, sf_dir), "l_suppkey", "l_quantity").withColumns({"f": F.round("f", 4), "icc": F.round("icc", 6)})


@query("""
WITH v AS (SELECT o_orderstatus = 'F' AS first, o_totalprice AS x FROM orders WHERE o_orderstatus IN ('F', 'O')),
r AS (SELECT first, avg(rn) OVER (PARTITION BY x) AS rank FROM (SELECT *, row_number() OVER (ORDER BY x) AS rn FROM v))
SELECT count(*) FILTER (WHERE first) AS n1, count(*) FILTER (WHERE NOT first) AS n2, round(sum(rank) FILTER (WHERE first) - count(*) FILTER (WHERE first) * (count(*) FILTER (WHERE first) + 1) / 2, 1) AS u,
  round((sum(rank) FILTER (WHERE first) - count(*) FILTER (WHERE first) * (count(*) FILTER (WHERE first) + 1) / 2) / (count(*) FILTER (WHERE first) * count(*) FILTER (WHERE NOT first)), 6) AS effect FROM r""")
def mann_whitney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank test of order values of two statuses."""
    o = orders(spark, sf_dir).where("o_orderstatus in ('F', 'O')")
    return stats.mann_whitney(o, "o_totalprice", F.col("o_orderstatus") == "F").select("n1", "n2", F.round("u", 1).alias("u"), F.round("effect", 6).alias("effect"))


@query("""SELECT round(corr(l_quantity, l_extendedprice), 6) AS r, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, count(*) AS n FROM lineitem""")
def corr_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: correlation and least squares of price on quantity."""
    return lineitem(spark, sf_dir).agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"), F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 2).alias("intercept"), F.count(F.lit(1)).alias("n"))


@query()
def pca_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: eigenvalues of the correlation matrix of all embedding coordinates (iterative linear algebra)."""
    e = table(spark, sf_dir, "embeddings")
    width = e.agg(F.max(F.size("embedding"))).first()[0] or 0
    e = e.select(*[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(width)])
    p = stats.correlation_pca(e, e.columns)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(p["eigenvalues"])], "component int, eigenvalue double")


@query()
def gmm_em(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: a two-part mixture of order values (iterative)."""
    g = stats.gaussian_mixture(orders(spark, sf_dir), "o_totalprice")
    return spark.createDataFrame([(i, *map(float, c), float(g["log_likelihood"])) for i, c in enumerate(g["components"])], "component int, weight double, mean double, variance double, log_likelihood double")


@query()
def hazard_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: a logit with cluster-robust errors of toxicity on length (iterative)."""
    j = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("toxic").alias("event"), F.col("source").alias("sponsor"), F.log1p("n_chars").alias("log_chars"))
    h = survival.fit_hazard(j, "event", covariates=("log_chars",))
    names = ("intercept", *h.covariates)
    return spark.createDataFrame([(n, float(b), float(e)) for n, b, e in zip(names, h.coefficients, h.errors, strict=True)], "term string, coefficient double, robust_se double")


@query()
def all_hazards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: logits of three labels on length in one joint fit, sources as clusters (iterative)."""
    j = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    j = j.select(F.col("toxic").alias("event_toxic"), (1 - F.col("quality")).alias("event_poor"), (F.col("toxic") * F.col("quality")).alias("event_both"), F.col("source").alias("sponsor"), F.log1p("n_chars").alias("log_chars"))
    fits = survival.fit_all(j, ("event_toxic", "event_poor", "event_both"), covariates=("log_chars",))
    rows = [(e, n, float(b), float(s), h.events) for e, h in fits.items() for n, b, s in zip(("intercept", *h.covariates), h.coefficients, h.errors, strict=True)]
    return spark.createDataFrame(rows, "event string, term string, coefficient double, robust_se double, events int")


_REASONS_SQL = "CASE " + " ".join("WHEN " + " OR ".join("contains(lower(r), '" + p.replace("'", "''") + "')" for p in ps) + f" THEN '{k}'" for k, ps in V.STATED_REASONS.items()) + " ELSE 'unknown_silent' END"
_REASON_SQL = f"""r AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'short' ELSE text || CASE doc_id % 5 WHEN 0 THEN ' business decision after an interim analysis' WHEN 1 THEN ' slow recruitment' WHEN 2 THEN ' Dose-Limiting toxicity' WHEN 3 THEN ' funding' ELSE '' END END AS r FROM documents),
s AS (SELECT doc_id, CASE WHEN length(trim(r)) >= 15 THEN {_REASONS_SQL} END AS stated FROM r)"""


_WHOLE_SQL = _REASON_SQL


def stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.expr("case doc_id % 5 when 0 then ' business decision after an interim analysis' when 1 then ' slow recruitment' when 2 then ' Dose-Limiting toxicity' when 3 then ' funding' else '' end")
    r = F.when(F.col("doc_id") % 7 == 0, "short").otherwise(F.concat("text", tail))
    return table(spark, sf_dir, "documents").select("doc_id", stated_reason(r).alias("stated"))


@query(f"WITH {_REASON_SQL} SELECT stated, count(*) AS n FROM s GROUP BY stated")
def reason_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """classes of stop reasons written anywhere in the documents."""
    return stated(spark, sf_dir).groupBy("stated").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_WHOLE_SQL} SELECT stated, count(*) AS n FROM s GROUP BY stated")
def reason_classifier_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """classes of stop reasons written anywhere in the documents."""
    return stated(spark, sf_dir).groupBy("stated").agg(F.count(F.lit(1)).alias("n"))


_TRUE_SQL = "t AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxicity_safety' WHEN quality = 0 THEN 'futility_efficacy' ELSE 'accrual_failure' END AS truth FROM labels)"


def stated_and_true(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxicity_safety").when(F.col("quality") == 0, "futility_efficacy").otherwise("accrual_failure").alias("truth"))
    return stated(spark, sf_dir).join(t, "doc_id").where("stated is not null")


@query(f"WITH {_REASON_SQL}, {_TRUE_SQL} SELECT stated, truth, count(*) AS n FROM s JOIN t USING (doc_id) WHERE stated IS NOT NULL GROUP BY ALL")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated against labelled reasons."""
    return L.confusion(stated_and_true(spark, sf_dir), "stated", "truth")


@query(f"WITH {_REASON_SQL}, {_TRUE_SQL} SELECT count(*) AS n, count(*) FILTER (WHERE stated = truth) AS agree, round(count(*) FILTER (WHERE stated = truth) / count(*), 6) AS rate FROM s JOIN t USING (doc_id) WHERE stated IS NOT NULL")
def stated_vs_true(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often stated and labelled reasons agree."""
    return L.agreement(stated_and_true(spark, sf_dir), "stated", "truth").withColumn("rate", F.round("rate", 6))


@query(f"WITH {_WHOLE_SQL}, {_TRUE_SQL} SELECT stated, truth, count(*) AS n FROM s JOIN t USING (doc_id) WHERE stated IS NOT NULL GROUP BY ALL")
def confusion_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``confusion``; the name under which it was first registered for whole texts."""
    return L.confusion(stated_and_true(spark, sf_dir), "stated", "truth")


@query(f"WITH {_WHOLE_SQL}, {_TRUE_SQL} SELECT count(*) AS n, count(*) FILTER (WHERE stated = truth) AS agree, round(count(*) FILTER (WHERE stated = truth) / count(*), 6) AS rate FROM s JOIN t USING (doc_id) WHERE stated IS NOT NULL")
def stated_vs_true_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``stated_vs_true``; the name under which it was first registered for whole texts."""
    return L.agreement(stated_and_true(spark, sf_dir), "stated", "truth").withColumn("rate", F.round("rate", 6))


@query("""WITH k AS (SELECT lang, sum(toxic) AS k, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang)
SELECT lang, CAST(k AS BIGINT) AS k, n, round(greatest(0.0, (k / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)), 6) AS low,
  round(least(1.0, (k / n + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)), 6) AS high FROM k""")
def wilson_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score interval of a share by language."""
    j = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("lang").agg(F.sum("toxic").alias("k"), F.count(F.lit(1)).alias("n"))
    w = j.withColumn("w", wilson(F.col("k"), F.col("n")))
    return w.select("lang", "k", "n", F.round("w.low", 6).alias("low"), F.round("w.high", 6).alias("high"))


@query("""WITH x AS (SELECT lower(regexp_replace(trim(text), '\\s+', ' ', 'g')) AS t, doc_id, quality FROM documents JOIN labels USING (doc_id)),
f AS (SELECT t, min(doc_id) AS first FROM x GROUP BY t), p AS (SELECT a.quality AS q1, b.quality AS q2 FROM x b JOIN f USING (t) JOIN x a ON a.doc_id = f.first WHERE b.doc_id <> f.first)
SELECT count(*) AS n, count(*) FILTER (WHERE q1 = q2) AS agree, round(count(*) FILTER (WHERE q1 = q2) / nullif(count(*), 0), 6) AS rate FROM p""")
def self_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of a document as repeat probes: do their labels agree with the first one's?"""
    x = table(spark, sf_dir, "documents").select("doc_id", F.lower(F.regexp_replace(F.trim("text"), r"\s+", " ")).alias("program_id")).join(table(spark, sf_dir, "labels"), "doc_id")
    first = x.groupBy("program_id").agg(F.min("doc_id").alias("_f"))
    r = x.join(first, "program_id").select("program_id", F.lit("label").alias("action"), (F.col("doc_id") != F.col("_f")).alias("is_repeat_probe"), F.lit("t").alias("timestamp"), F.col("doc_id").alias("position"), "quality")
    return L.self_consistency(r, ["quality"]).withColumn("rate", F.round("rate", 6))


@query("""WITH s AS (SELECT p_brand, s_nationkey % 5 AS region, p_size > 25 AS is_dead FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey),
c AS (SELECT p_brand, region, count(*) FILTER (WHERE NOT is_dead) AS n_live, count(*) FILTER (WHERE is_dead) AS n_dead FROM s GROUP BY ALL)
SELECT p_brand, region, n_live, n_dead, CASE WHEN n_live + n_dead = 0 THEN 'untested_white_space' WHEN n_live + n_dead < 5 THEN 'insufficient_evidence' WHEN n_live >= 5 AND n_dead = 0 THEN 'red_ocean' WHEN n_dead >= 5 AND n_live < 5 THEN 'graveyard' ELSE 'contested_and_hard' END AS quadrant FROM c""")
def matrix_quadrants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live and dead parts of each cell of brand and region, and its reading."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") % 5).alias("region"))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    j = lineitem(spark, sf_dir).join(p, F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return triage.matrix(j.withColumn("is_dead", F.col("p_size") > 25), ["p_brand", "region"])


@query("""SELECT c_mktsegment, string_agg(o_orderpriority || ' (' || n || ')', ', ' ORDER BY n DESC, o_orderpriority) AS mix FROM (SELECT c_mktsegment, o_orderpriority, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' GROUP BY ALL) GROUP BY c_mktsegment""")
def reason_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities of finished orders in each segment, by frequency."""
    j = orders(spark, sf_dir).where("o_orderstatus = 'F'").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return triage.reason_mix(j, ["c_mktsegment"], "o_orderpriority")


@query("""
WITH c AS (SELECT 'provenance' AS stage, 'texts are present' AS name, count(*) FILTER (WHERE text IS NULL) AS bad, count(*) AS n FROM documents
 UNION ALL SELECT 'history', 'order totals are positive', count(*) FILTER (WHERE o_totalprice <= 0), count(*) FROM orders
 UNION ALL SELECT 'gold_set', 'labels are binary', count(*) FILTER (WHERE quality NOT IN (0, 1)), count(*) FROM labels
 UNION ALL SELECT 'features', 'shipped after ordered', count(*) FILTER (WHERE CAST(l_shipdate AS DATE) < CAST(o_orderdate AS DATE)), count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT stage, name, CASE WHEN bad = 0 THEN 'PASS' WHEN stage = 'features' THEN 'WARN' ELSE 'FAIL' END AS level, '0' AS expected, CAST(bad AS VARCHAR) AS actual, 'of ' || n AS detail FROM c""")
def audit_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1: four named conditions with their counts, run stage by stage."""
    j = lineitem(spark, sf_dir).join(orders(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey"))
    stages = [
        ("provenance", True, [triage.check(table(spark, sf_dir, "documents"), "provenance", "texts are present", F.col("text").isNull())]),
        ("history", True, [triage.check(orders(spark, sf_dir), "history", "order totals are positive", F.col("o_totalprice") <= 0)]),
        ("gold_set", False, [triage.check(table(spark, sf_dir, "labels"), "gold_set", "labels are binary", ~F.col("quality").isin(0, 1))]),
        ("features", False, [triage.check(j, "features", "shipped after ordered", F.col("l_shipdate") < F.col("o_orderdate"), warn_only=True)]),
    ]
    return triage.run_stages(stages)[0]


@query("""SELECT CASE WHEN regexp_matches(t, 'password|token|secret') THEN 'credential' WHEN regexp_matches(t, '%%%|&&&') THEN 'symbols' WHEN contains(t, '|') THEN 'table' ELSE 'other' END AS error_class, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM (SELECT lower(text) AS t FROM documents) GROUP BY ALL""")
def error_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts by the first expression that matches."""
    d = table(spark, sf_dir, "documents").select(F.lower("text").alias("t"))
    return triage.error_classes(d, "t", {"credential": "password|token|secret", "symbols": "%%%|&&&", "table": r"\|"}).withColumn("share", F.round("share", 6))
