"""Queries of the as-of, panel, differ and finance operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from asofly.functions import vocab as V
from asofly.functions.scoring import archetypes, band, primary_archetype, program_coverage, silence_score, trial_coverage, trial_cost
from asofly.operators import differ, programs, stats, survival, temporal, triage
from asofly.operators.scans import Scan, rank_selected, segmented_scan
from asofly.plans.registry import query
from asofly.plans.tables import AS_OF, as_of, lineitem, orders, table
from asofly.session import materialize


@query(f"""
SELECT o_custkey, o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) AS rn
  FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '{AS_OF}') WHERE rn = 1""")
def asof_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's latest order on a date."""
    o = orders(spark, sf_dir).select("o_custkey", "o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"), "o_orderdate")
    return temporal.as_of_point(o, "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderdate", as_of())


PANEL_SQL = f"""
o AS (SELECT o_custkey, o_orderkey, o_totalprice, CAST(o_orderdate AS DATE) AS d FROM orders),
spine AS (SELECT o_custkey, CAST(unnest(generate_series(date_trunc('month', min(d)), TIMESTAMP '{AS_OF}', INTERVAL 1 MONTH)) AS DATE) AS as_of FROM o GROUP BY o_custkey),
panel AS (
  SELECT s.o_custkey, s.as_of, max(d) AS d, max_by(o_orderkey, struct_pack(a := d, b := o_orderkey)) AS o_orderkey
  FROM spine s LEFT JOIN o ON o.o_custkey = s.o_custkey AND o.d <= s.as_of GROUP BY s.o_custkey, s.as_of)"""


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = orders(spark, sf_dir).select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return temporal.as_of_month_panel(o, "o_custkey", "o_orderdate", ["o_orderkey"], as_of())


def stale(days):
    return F.bround(45 * (1 - F.exp(-days / F.lit(365.0))), 1)


@query(f"""
WITH {PANEL_SQL}
SELECT o_custkey, as_of, o_orderkey, CASE WHEN d IS NOT NULL THEN round_even(45 * (1 - exp(-date_diff('day', d, as_of) / 365.0)), 1) END AS staleness FROM panel""")
def asof_month_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order known on the first of each month and how stale it was."""
    return panel(spark, sf_dir).select("o_custkey", "as_of", "o_orderkey", stale(F.datediff("as_of", "o_orderdate")).alias("staleness"))


@query(f"""
WITH {PANEL_SQL}
SELECT o_custkey, min(as_of) FILTER (WHERE round_even(45 * (1 - exp(-date_diff('day', d, as_of) / 365.0)), 1) >= 20) AS flag_date FROM panel GROUP BY o_custkey""")
def first_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First month in which a customer's record is stale by twenty points."""
    p = asof_month_panel(spark, sf_dir)
    return temporal.first_crossing(p, "o_custkey", "as_of", "staleness", F.lit(20))


@query("""
SELECT event_id, user_id, event_type, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_purchase FROM events""")
def asof_nonnull_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest known purchase value at each event."""
    e = table(spark, sf_dir, "events").withColumn("bought", F.when(F.col("event_type") == "purchase", F.col("value")))
    return temporal.forward_fill(e, "user_id", ["ts", "event_id"], "bought", "last_purchase").select("event_id", "user_id", "event_type", "last_purchase")


@query("""
WITH p AS (SELECT user_id, ts, event_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS spend FROM events WHERE event_type = 'purchase'),
l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error')
SELECT l.event_id, l.user_id, round(max_by(p.spend, struct_pack(a := p.ts, b := p.event_id)), 2) AS spend
FROM l LEFT JOIN p ON p.user_id = l.user_id AND p.ts <= l.ts GROUP BY l.event_id, l.user_id""")
def spend_at_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spend known when an error came; later purchases don't leak into it."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    spent = temporal.running_sum(e.where("event_type = 'purchase'"), "user_id", ["ts", "event_id"], "value", "spend")
    joined = temporal.as_of_join(e.where("event_type = 'error'").select("event_id", "user_id", "ts"), spent.select("user_id", "ts", "event_id", "spend"), "user_id", "ts", "ts", ["event_id"], ["spend"])
    return joined.select("event_id", "user_id", F.round("spend", 2).alias("spend"))


VERSIONS_SQL = """
v AS (SELECT o_custkey, o_orderkey AS to_version, CAST(o_orderdate AS DATE) AS event_date, o_orderstatus AS s, o_orderpriority AS p, o_totalprice AS t,
  lag(o_orderkey) OVER w AS from_version, lag(o_orderstatus) OVER w AS s0, lag(o_orderpriority) OVER w AS p0, lag(o_totalprice) OVER w AS t0
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
pairs AS (SELECT * FROM v WHERE from_version IS NOT NULL),
ev AS (
  SELECT o_custkey, from_version, to_version, event_date, CASE WHEN s0 = 'O' AND s = 'F' THEN 'status_finalized' WHEN s0 = 'F' AND s = 'O' THEN 'reopened' ELSE 'status_changed' END AS event_type, CAST(NULL AS VARCHAR) AS direction, s0 AS from_value, s AS to_value FROM pairs WHERE s <> s0
  UNION ALL SELECT o_custkey, from_version, to_version, event_date, 'priority_changed', NULL, p0, p FROM pairs WHERE p <> p0
  UNION ALL SELECT o_custkey, from_version, to_version, event_date, 'size_changed', CASE WHEN t > t0 THEN 'increased' ELSE 'decreased' END, CAST(CAST(round(t0) AS BIGINT) AS VARCHAR), CAST(CAST(round(t) AS BIGINT) AS VARCHAR) FROM pairs WHERE abs(t - t0) > 100000)"""


def order_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.struct(F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"), F.col("o_totalprice").alias("t"))
    return differ.version_pairs(orders(spark, sf_dir).withColumn("body", body), "o_custkey", "o_orderkey", "o_orderdate", "body")


def order_events(pairs: DataFrame) -> DataFrame:
    a, b = F.col("prev"), F.col("curr")
    kind = [("status_finalized", (a["s"] == "O") & (b["s"] == "F")), ("reopened", (a["s"] == "F") & (b["s"] == "O"))]
    status = F.when(a["s"] == b["s"], None)
    for name, test in kind:
        status = status.when(test, differ.event(name, "status", a["s"], b["s"]))
    status = status.otherwise(differ.event("status_changed", "status", a["s"], b["s"]))
    size = F.when(F.abs(b["t"] - a["t"]) > 100000, differ.event("size_changed", "size", F.round(a["t"]).cast("long"), F.round(b["t"]).cast("long"), F.when(b["t"] > a["t"], "increased").otherwise("decreased")))
    events = F.array_compact(F.array(status, differ.scalar_change("priority_changed", "priority", a["p"], b["p"]), size))
    return pairs.select("o_custkey", "from_version", "to_version", "event_date", F.explode(events).alias("e")).select("o_custkey", "from_version", "to_version", "event_date", "e.event_type", "e.direction", "e.from_value", "e.to_value")


@query(f"WITH {VERSIONS_SQL} SELECT * FROM ev")
def version_pairs_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed changes between a customer's adjacent orders."""
    return order_events(order_pairs(spark, sf_dir))


@query(f"""WITH {VERSIONS_SQL}, n AS (SELECT count(*) AS pairs FROM pairs)
SELECT event_type, count(DISTINCT (o_custkey, from_version, to_version)) AS pairs_with, count(*) AS events, round(count(DISTINCT (o_custkey, from_version, to_version)) / any_value(pairs), 6) AS share FROM ev, n GROUP BY event_type
UNION ALL SELECT NULL, count(*), 0, round(count(*) / any_value(n.pairs), 6) FROM pairs, n WHERE (o_custkey, from_version, to_version) NOT IN (SELECT (o_custkey, from_version, to_version) FROM ev)""")
def noise_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: pairs that fire each event type, and those that fire none."""
    pairs = materialize(order_pairs(spark, sf_dir), "version-pairs")  # read twice
    return differ.noise_floor(pairs, order_events(pairs), "o_custkey").withColumn("share", F.round("share", 6))


@query(f"""WITH {VERSIONS_SQL}, n AS (SELECT count(*) AS pairs FROM pairs)
SELECT event_type, direction, count(DISTINCT (o_custkey, from_version, to_version)) AS n, round(count(DISTINCT (o_custkey, from_version, to_version)) / any_value(pairs), 6) AS share FROM ev, n GROUP BY event_type, direction""")
def event_direction_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types by direction."""
    pairs = materialize(order_pairs(spark, sf_dir), "version-pairs")
    return differ.direction_mix(pairs, order_events(pairs), "o_custkey").withColumn("share", F.round("share", 6))


@query("""
WITH m AS (SELECT l_orderkey, list_sort(list_distinct(list(l_partkey))) AS parts FROM lineitem GROUP BY l_orderkey),
v AS (SELECT o_custkey, o_orderkey AS to_version, lag(o_orderkey) OVER w AS from_version, coalesce(parts, []) AS b, lag(coalesce(parts, [])) OVER w AS a
  FROM orders LEFT JOIN m ON l_orderkey = o_orderkey WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT o_custkey, from_version, to_version, len(list_filter(b, lambda x: NOT list_contains(a, x))) AS n_added, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS n_removed, len(list_filter(a, lambda x: list_contains(b, x))) AS n_kept
FROM v WHERE from_version IS NOT NULL""")
def set_diff_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts added, removed and kept between adjacent orders."""
    parts = lineitem(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))
    o = orders(spark, sf_dir).join(parts, F.col("l_orderkey") == F.col("o_orderkey"), "left").withColumn("parts", F.coalesce("parts", F.array().cast("array<bigint>")))
    p = differ.version_pairs(o, "o_custkey", "o_orderkey", "o_orderdate", "parts")
    size = lambda c: F.size(c).cast("long")
    return p.select("o_custkey", "from_version", "to_version", size(F.array_except("curr", "prev")).alias("n_added"), size(F.array_except("prev", "curr")).alias("n_removed"), size(F.array_intersect("prev", "curr")).alias("n_kept"))


@query("""
WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, list(DISTINCT event_type) AS kinds FROM events GROUP BY user_id, CAST(ts AS DATE))
SELECT count(*) AS versions, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE list_has_any(kinds, ['error', 'purchase'])) AS signal,
  round(coalesce(count(*) FILTER (WHERE list_has_any(kinds, ['error', 'purchase'])) / nullif(count(*), 0), 0.0), 6) AS ratio FROM d""")
def signal_version_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: versions, records and the share of versions with a signal module."""
    d = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.collect_set("event_type").alias("kinds"))
    return programs.signal_stats(d, "user_id", "kinds", ["error", "purchase"]).withColumnRenamed("records", "users").withColumn("ratio", F.round("ratio", 6))


@query("""
SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) AS rn FROM events) WHERE rn = 1""")
def latest_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user and type; of ties the first."""
    e = table(spark, sf_dir, "events").withColumn("k", F.struct("user_id", "event_type"))
    return temporal.latest_by(e.select("k", "ts", "event_id", "value"), "k", "ts", "event_id").select("k.user_id", "k.event_type", "event_id", "value")


@query("""
WITH m AS (SELECT l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, CAST(round(sum(CAST(l_extendedprice AS DECIMAL(18,2))), 2) AS DOUBLE) AS revenue FROM lineitem GROUP BY ALL)
SELECT l_suppkey, month, revenue, round(sum(revenue) OVER (PARTITION BY l_suppkey ORDER BY month), 2) AS cumulative FROM m""")
def running_and_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly and cumulative revenue of each supplier."""
    m = lineitem(spark, sf_dir).groupBy("l_suppkey", F.trunc("l_shipdate", "MM").alias("month")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("revenue"))
    return temporal.running_sum(m, "l_suppkey", ["month"], "revenue", "cumulative").withColumn("cumulative", F.round("cumulative", 2))


@query("""
WITH m AS (SELECT s_nationkey, l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS spend FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
p AS (SELECT a.s_nationkey, a.l_suppkey, a.month, a.spend, count(b.spend) AS peers, median(b.spend) AS med FROM m a LEFT JOIN m b ON a.s_nationkey = b.s_nationkey AND a.month = b.month AND a.l_suppkey <> b.l_suppkey AND b.spend > 0 GROUP BY ALL)
SELECT s_nationkey, l_suppkey, month, peers, CASE WHEN peers >= 2 THEN round(spend / med, 4) END AS ratio FROM p""")
def conviction_loo_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's monthly spend over the median of its nation's other suppliers."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    m = lineitem(spark, sf_dir).join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_nationkey", "l_suppkey", F.trunc("l_shipdate", "MM").alias("month")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("spend"))
    r = stats.leave_one_out_ratio(m, ["month", "s_nationkey"], "l_suppkey", "spend")
    return r.select("s_nationkey", "l_suppkey", "month", "peers", F.round("ratio", 4).alias("ratio"))


@query(f"""
WITH {PANEL_SQL}, q AS (SELECT l_orderkey, sum(l_quantity) AS qty FROM lineitem GROUP BY l_orderkey)
SELECT p.o_custkey, p.as_of, round(CASE left(o_orderpriority, 1) WHEN '1' THEN 22.1 WHEN '2' THEN 11.2 ELSE 4.5 END * coalesce(qty, 0) * CASE WHEN p.as_of <= p.d THEN 0 ELSE date_diff('day', p.d, p.as_of) / 30.44 END, 3) AS cost_index
FROM panel p JOIN orders o ON o.o_orderkey = p.o_orderkey LEFT JOIN q ON l_orderkey = p.o_orderkey""")
def cost_index_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight times size times elapsed months of the order known in each month."""
    o = orders(spark, sf_dir).withColumn("phase", F.when(F.col("o_orderpriority").startswith("1"), "PHASE3").when(F.col("o_orderpriority").startswith("2"), "PHASE2").otherwise("PHASE1"))
    q = lineitem(spark, sf_dir).groupBy("l_orderkey").agg(F.sum("l_quantity").alias("qty"))
    versions = o.join(q, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_custkey", "o_orderkey", "o_orderdate", "phase", "qty")
    p = temporal.as_of_month_panel(versions, "o_custkey", "o_orderdate", ["o_orderkey"], as_of()).where("o_orderkey is not null")
    return p.select("o_custkey", "as_of", F.round(trial_cost(F.col("phase"), F.col("qty"), F.col("o_orderdate"), F.col("as_of")), 3).alias("cost_index"))


SILENCE_SQL = f"""
l AS (SELECT o_custkey, max(CAST(o_orderdate AS DATE)) AS d, max_by(o_orderstatus, struct_pack(a := CAST(o_orderdate AS DATE), b := o_orderkey)) AS s FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '{AS_OF}' GROUP BY o_custkey),
c AS (SELECT c_custkey, d, round_even(45 * (1 - exp(-date_diff('day', d, DATE '{AS_OF}') / 365.0)), 1) AS stale,
  round_even(8 * CASE WHEN s = 'O' THEN least(date_diff('day', d, DATE '{AS_OF}') / 365.0, 1.0) ELSE 0 END, 1) AS lapse,
  round_even(27 * CASE s WHEN 'P' THEN 1.0 WHEN 'F' THEN 0.4 ELSE 0 END, 1) AS amb, round_even(20 * CASE s WHEN 'P' THEN 1.0 ELSE 0 END, 1) AS enr
  FROM customer LEFT JOIN l ON o_custkey = c_custkey),
scored AS (SELECT c_custkey, CASE WHEN d IS NOT NULL THEN CAST(round_even(least(100.0, stale + lapse + amb + enr), 0) AS INTEGER) END AS score FROM c)"""


@query(f"WITH {SILENCE_SQL} SELECT c_custkey, score, CAST(least(floor(score / 20), 4) AS INTEGER) AS band FROM scored")
def silence_score_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silence of each customer on a date; null without any order by then."""
    last = temporal.as_of_point(orders(spark, sf_dir).select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderdate", as_of())
    c = table(spark, sf_dir, "customer").select("c_custkey").join(last, F.col("o_custkey") == F.col("c_custkey"), "left")
    days, s = F.datediff(as_of(), "o_orderdate"), F.col("o_orderstatus")
    lapse = F.when(s == "O", F.least(days / F.lit(365.0), F.lit(1.0))).otherwise(0.0)
    score = silence_score(1 - F.exp(-days / F.lit(V.STALENESS_TAU_DAYS)), lapse, F.when(s == "P", 1.0).when(s == "F", 0.4).otherwise(0.0), F.when(s == "P", 1.0).otherwise(0.0))
    scored = c.withColumn("score", F.when(F.col("o_orderdate").isNotNull(), score))
    return scored.select("c_custkey", "score", band(F.col("score")).alias("band"))


@query(f"""WITH {SILENCE_SQL}, b AS (SELECT CAST(least(floor(score / 20), 4) AS INTEGER) AS band FROM scored), k AS (SELECT band, count(*) AS n FROM b GROUP BY band),
d AS (SELECT unnest([0, 1, 2, 3, 4]) AS band), f AS (SELECT coalesce(d.band, k.band) AS band, coalesce(n, 0) AS n FROM d FULL JOIN k ON d.band = k.band)
SELECT band, n, round(n / sum(n) OVER (), 6) AS share FROM f""")
def band_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: customers in each band; all five bands have a row, those without a score one if there are any."""
    domain = spark.createDataFrame([(i,) for i in range(V.BANDS)], "band int")
    return stats.share_of(silence_score_band(spark, sf_dir).select("band"), ["band"], domain).withColumn("share", F.round("share", 6))


@query(f"""
SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'unknown_status' WHEN bool_or(o_orderstatus = 'F' AND o_orderpriority >= '4') THEN 'registry_terminated_vague_reason'
  WHEN count(DISTINCT CAST(o_orderdate AS DATE)) FILTER (WHERE date_diff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF}') BETWEEN 0 AND 400) >= 2 THEN 'actively_amended' ELSE 'other' END AS archetype
FROM orders GROUP BY o_custkey""")
def archetypes_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's first archetype; amended is two order dates within 400 days."""
    o = orders(spark, sf_dir).groupBy("o_custkey").agg(
        F.bool_or(F.col("o_orderstatus") == "P").alias("u"), F.bool_or((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") >= "4")).alias("v"),
        F.collect_set(F.when(F.datediff(as_of(), "o_orderdate") >= 0, F.col("o_orderdate"))).alias("amended"),
    )
    trial = F.struct(F.when(F.col("u"), "UNKNOWN").when(F.col("v"), "TERMINATED").otherwise("RECRUITING").alias("status"), F.lit(None).cast("string").alias("why_stopped"), F.lit(True).alias("has_results"), F.col("amended"))
    return o.select("o_custkey", primary_archetype(archetypes(F.array(trial), as_of())).alias("archetype"))


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus FROM orders), l AS (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'R') AS need, count(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'F') AS got FROM lineitem GROUP BY l_orderkey),
t AS (SELECT c_custkey, CASE WHEN l_orderkey IS NULL THEN 'none' WHEN o_orderstatus = 'P' OR got < need THEN 'partial' ELSE 'full' END AS cov, o_orderkey FROM customer LEFT JOIN o ON o_custkey = c_custkey LEFT JOIN l ON l_orderkey = o_orderkey)
SELECT c_custkey, CASE WHEN count(o_orderkey) = 0 OR bool_and(cov = 'none') THEN 'none' WHEN bool_and(cov = 'full') THEN 'full' ELSE 'partial' END AS coverage FROM t GROUP BY c_custkey""")
def history_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whether each customer's orders are backed by all their lines of interest."""
    flag = F.col("l_returnflag") == "R"
    lines = lineitem(spark, sf_dir).groupBy("l_orderkey").agg(F.count_if(flag).alias("need"), F.count_if(flag & (F.col("l_linestatus") == "F")).alias("got"))
    o = orders(spark, sf_dir).join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    cov = trial_coverage(F.col("l_orderkey").isNotNull(), F.coalesce(F.col("o_orderstatus") == "P", F.lit(False)), F.coalesce("need", F.lit(0)), F.coalesce("got", F.lit(0)))
    per = o.groupBy("o_custkey").agg(F.collect_list(cov).alias("covs"))
    c = table(spark, sf_dir, "customer").select("c_custkey").join(per, F.col("o_custkey") == F.col("c_custkey"), "left")
    return c.select("c_custkey", program_coverage(F.coalesce("covs", F.array().cast("array<string>"))).alias("coverage"))


@query("""
WITH l AS (SELECT *, CAST(l_shipdate AS DATE) < max(CAST(l_shipdate AS DATE)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_shipdate AS DATE) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS back FROM lineitem)
SELECT l_orderkey, min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND count(DISTINCT l_linenumber) = count(*) AS contiguous, NOT bool_or(coalesce(back, false)) AS monotone, count(*) AS n_versions FROM l GROUP BY l_orderkey""")
def contiguity_monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers without gaps and ship dates that never go back, order by order."""
    return temporal.contiguity(lineitem(spark, sf_dir), "l_orderkey", "l_linenumber", "l_shipdate", first=1)


@query("""
SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END, ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 15""")
def tiered_topk_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifteen events of each user by tier, newest first."""
    e = table(spark, sf_dir, "events").withColumn("tier", F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", 1).otherwise(2))
    return temporal.top_k_by_tier(e, "user_id", "tier", ["ts", "event_id"], 15).select("event_id", "user_id", "event_type")


@query("SELECT event_id, row_number() OVER (ORDER BY user_id, ts, event_id) - 1 AS position FROM events")
def dense_event_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gapless numbers in a total order."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return temporal.dense_ids(e, ["user_id", "ts", "event_id"], "position").select("event_id", "position")


@query("SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS turn FROM customer")
def roundrobin_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turn in which each customer is served when segments take turns."""
    return temporal.round_robin(table(spark, sf_dir, "customer"), ["c_mktsegment"], F.col("c_custkey")).select("c_custkey", "c_mktsegment", F.col("turn").cast("long").alias("turn"))


@query("""
WITH r AS (SELECT c_custkey, c_mktsegment, c_custkey % 50 = 0 AS reserved FROM customer),
k AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY reserved DESC, c_custkey) AS rn FROM r)
SELECT c_custkey, c_mktsegment, reserved FROM k WHERE rn <= 20 OR reserved""")
def stratified_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reserved customers, and further ones up to twenty a segment."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    need = c.select("c_mktsegment").distinct().withColumn("need", F.lit(20))
    return temporal.stratified_sample(c, ["c_mktsegment"], need, "c_custkey", c.where("c_custkey % 50 = 0"), F.col("c_custkey")).select("c_custkey", "c_mktsegment", "reserved")


_STEPS = ("signup", "view", "click", "purchase", "error")


@query("""
WITH o AS (SELECT user_id, min(list_position(['signup', 'view', 'click', 'purchase', 'error'], event_type)) AS k FROM events GROUP BY user_id), n AS (SELECT k, count(*) AS n FROM o GROUP BY k)
SELECT k AS step, n, CAST(sum(n) OVER (ORDER BY k) AS BIGINT) AS cumulative FROM n""")
def saturation_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users credited to the first strategy that finds them, and how many are found so far."""
    return programs.saturation(table(spark, sf_dir, "events"), "user_id", "event_type", list(_STEPS)).where("n > 0").select("step", "n", "cumulative")


SWEEP_SQL = f"""WITH {PANEL_SQL},
p AS (SELECT o_custkey, as_of, round_even(45 * (1 - exp(-date_diff('day', d, as_of) / 365.0)), 1) AS score FROM panel WHERE d IS NOT NULL),
cut AS (SELECT DISTINCT round(score, 6) AS threshold FROM p),
f AS (SELECT o_custkey, threshold, min(as_of) AS flag_date FROM p JOIN cut ON score >= threshold GROUP BY o_custkey, threshold),
g AS (SELECT c_custkey, c_acctbal < 0 AS dead, DATE '1999-01-01' AS event_month FROM customer)
SELECT threshold, count(flag_date) AS n_flagged, count(*) FILTER (WHERE dead AND flag_date IS NOT NULL) AS n_correct, round(count(*) FILTER (WHERE dead AND flag_date IS NOT NULL) / nullif(count(flag_date), 0), 6) AS precision,
  round(count(*) FILTER (WHERE dead AND flag_date IS NOT NULL) / (SELECT count(*) FROM g WHERE dead), 6) AS recall, median(date_diff('day', event_month, flag_date)) FILTER (WHERE dead) AS median_lead_days
FROM cut LEFT JOIN f USING (threshold) LEFT JOIN g ON c_custkey = o_custkey GROUP BY threshold"""


@query(SWEEP_SQL)
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and lead time of every observed staleness as a threshold, against an outcome."""
    p = materialize(asof_month_panel(spark, sf_dir).where("staleness is not null").select(F.col("o_custkey").alias("program_id"), "as_of", "staleness"), "sweep-panel")
    cuts = survival.thresholds(p, "staleness")
    out = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("program_id"), F.when(F.col("c_acctbal") < 0, "dead").otherwise("censored").alias("outcome"), F.lit("1999-01-01").cast("date").alias("event_month"))
    c = survival.sweep(p, "staleness", out, cuts)
    return c.withColumns({"precision": F.round("precision", 6), "recall": F.round("recall", 6)})


@query(f"""WITH s AS ({SWEEP_SQL}),
r AS (SELECT 'most_precise' AS rule, *, row_number() OVER (ORDER BY precision DESC, coalesce(median_lead_days, 0), coalesce(recall, 0) DESC, threshold) AS k FROM s WHERE precision IS NOT NULL
 UNION ALL SELECT 'earliest', *, row_number() OVER (ORDER BY median_lead_days, precision DESC, recall DESC, threshold) FROM s WHERE precision >= 0.05 AND n_correct > 0)
SELECT rule, threshold, n_flagged, n_correct, precision, recall, median_lead_days FROM r WHERE k = 1""")
def operating_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the sweep over staleness, the point of the highest precision, and the earliest of enough precision."""
    points = threshold_sweep(spark, sf_dir)
    return survival.most_precise(points).withColumn("rule", F.lit("most_precise")).unionByName(survival.best_point(points, 0.05).withColumn("rule", F.lit("earliest")))


@query("""SELECT event_id, event_type, CAST(sum(CASE WHEN event_type = 'purchase' THEN event_id % 97 ELSE 1 END) OVER w AS BIGINT) AS upto, max(value) OVER w AS top,
  last_value(CASE WHEN event_id % 3 = 0 THEN user_id END IGNORE NULLS) OVER w AS last_user, CAST(count(*) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS left_over
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def split_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running values over the events of each type: a few keys with all the rows, split over range partitions."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value", F.when(F.col("event_type") == "purchase", F.col("event_id") % 97).otherwise(1).alias("w"), F.when(F.col("event_id") % 3 == 0, F.col("user_id")).alias("u"), F.lit(1).alias("one"))
    wanted = {"upto": Scan("w", "sum"), "top": Scan("value", "max"), "last_user": Scan("u"), "left_over": Scan("one", "sum", backward=True)}
    return segmented_scan(e, ["event_type"], ["ts", "event_id"], wanted).select("event_id", "event_type", *wanted)


@query("""SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90,
  list_sort(list(l_extendedprice))[CAST(least(floor(0.25 * count(*)), count(*) - 1) AS BIGINT) + 1] AS q1, list_sort(list(l_extendedprice))[CAST(least(floor(0.75 * count(*)), count(*) - 1) AS BIGINT) + 1] AS q3 FROM lineitem GROUP BY l_returnflag""")
def rank_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpolated and index quantiles of the prices of each flag, by ranks over range partitions."""
    q = rank_selected(lineitem(spark, sf_dir), ["l_returnflag"], "l_extendedprice", {"p10": 0.1, "median": 0.5, "p90": 0.9}, {"q1": 0.25, "q3": 0.75})
    return q.withColumns({c: F.round(c, 4) for c in ("p10", "median", "p90")})


@query(SWEEP_SQL)
def threshold_sweep_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``threshold_sweep``; the name under which it was first registered for observed thresholds."""
    return threshold_sweep(spark, sf_dir)


@query(f"""
WITH c AS (SELECT c_custkey, count(o_orderkey) > 10 AS is_gold, bool_or(coalesce(o_orderstatus, '') = 'P') AS has_evidence, max(CAST(o_orderdate AS DATE)) AS last FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)
SELECT c_custkey, CASE WHEN is_gold OR has_evidence THEN 0 WHEN last IS NOT NULL THEN 1 ELSE 2 END AS priority_tier, CAST(CASE WHEN NOT (is_gold OR has_evidence) AND last IS NOT NULL THEN -date_diff('day', last, DATE '{AS_OF}') ELSE 0 END AS DOUBLE) AS priority_key FROM c""")
def priority_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1: tiers of work, the longest silent first."""
    o = orders(spark, sf_dir).groupBy("o_custkey").agg((F.count(F.lit(1)) > 10).alias("is_gold"), F.bool_or(F.col("o_orderstatus") == "P").alias("has_evidence"), F.max("o_orderdate").alias("last_posted"))
    c = table(spark, sf_dir, "customer").select("c_custkey").join(o, F.col("o_custkey") == F.col("c_custkey"), "left").na.fill(False, ["is_gold", "has_evidence"])
    return triage.priority_queue(c.withColumnRenamed("c_custkey", "nct_id"), as_of()).select(F.col("nct_id").alias("c_custkey"), "priority_tier", "priority_key")
