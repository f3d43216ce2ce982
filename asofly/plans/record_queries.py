"""Queries of label, record, cost, queue and audit operators: the tables are read as records, programs and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofly.functions import scoring
from asofly.functions import vocab as V
from asofly.functions.text import resolve_target
from asofly.operators import audit, differ, finance, queues, stats, survival
from asofly.operators import labels as L
from asofly.operators import programs as P
from asofly.plans.registry import query
from asofly.plans.stat_queries import _TRUE_SQL, _WHOLE_SQL
from asofly.plans.tables import AS_OF, as_of, lineitem, orders, table
from asofly.plans.temporal_queries import PANEL_SQL, asof_month_panel
from asofly.session import materialize
from asofly.sources import paths
from asofly.sources import snapshots as S
from asofly.streaming import sessions


def _in(c: str, words) -> str:
    return f"coalesce({c} IN ({', '.join(repr(w) for w in words)}), false)"


# Orders as label records: each field cycles through its values and through null.
_FIELDS = {
    "action": "CASE o_orderkey % 11 WHEN 0 THEN 'skip' WHEN 1 THEN 'odd' ELSE 'label' END",
    "gate_reached": "CAST(o_orderkey % 4 AS INT)",
    "is_adc": "CASE o_custkey % 5 WHEN 0 THEN 'no' WHEN 1 THEN 'odd' WHEN 2 THEN NULL ELSE 'yes' END",
    "in_scope": "CASE o_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'no' WHEN 2 THEN 'odd' WHEN 3 THEN 'no' ELSE 'yes' END",
    "scope_reason": "CASE o_orderkey % 6 WHEN 0 THEN 'heme_only' WHEN 1 THEN 'not_an_adc' WHEN 2 THEN 'odd' ELSE NULL END",
    "decided_by": "CASE o_orderkey % 9 WHEN 0 THEN 'auto' WHEN 1 THEN 'odd' WHEN 2 THEN NULL ELSE 'human' END",
    "triage_layer": "CASE o_orderkey % 5 WHEN 0 THEN 'layer1' ELSE NULL END",
    "history_coverage_at_serve_time": "CASE o_custkey % 4 WHEN 0 THEN 'partial' ELSE 'full' END",
    "third_party_first_noted_date": "CASE WHEN o_orderkey % 8 < 2 THEN '2020-01-01' END",
    "third_party_source": "CASE WHEN o_orderkey % 8 < 3 THEN 'x' ELSE '' END",
    "status": "CASE o_orderkey % 3 WHEN 0 THEN 'dead_confirmed' WHEN 1 THEN 'active' ELSE 'odd' END",
    "confidence": "CASE o_orderkey % 13 WHEN 0 THEN NULL ELSE 'high' END",
    "kill_reason": "CASE o_custkey % 6 WHEN 0 THEN NULL ELSE 'futility_efficacy' END",
    "public_confirmation_date": "CASE o_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE '2020-02-02' END",
    "never_publicly_confirmed": "CASE o_orderkey % 10 WHEN 3 THEN true WHEN 6 THEN false END",
    "label_evidence_date": "CASE o_orderkey % 12 WHEN 3 THEN '' ELSE '2020-03-03' END",
    "confirmation_evidence_type": "CASE o_orderkey % 14 WHEN 3 THEN 'odd' ELSE 'regulatory' END",
}
_LABEL, _AUTO = "(action = 'label')", "(coalesce(decided_by, 'human') = 'auto')"
_HUMAN = f"({_LABEL} AND NOT {_AUTO})"
_G3 = f"({_HUMAN} AND gate_reached = 3)"
_DEAD = f"({_G3} AND status = 'dead_confirmed')"
_HAS = lambda c: f"(coalesce({c}, '') <> '')"
_BROKEN = [
    f"NOT {_in('action', ('label', 'skip'))}", f"{_LABEL} AND gate_reached NOT IN (1, 2, 3)", f"{_LABEL} AND coalesce(decided_by, 'human') NOT IN ('human', 'auto')", f"{_LABEL} AND {_AUTO} AND NOT {_in('triage_layer', ('layer1',))}",
    f"{_LABEL} AND {_AUTO} AND gate_reached = 3", f"{_LABEL} AND {_AUTO} AND gate_reached = 1 AND NOT {_in('is_adc', ('no',))}", f"{_LABEL} AND {_AUTO} AND gate_reached = 2 AND NOT {_in('in_scope', ('no',))}",
    f"{_LABEL} AND {_AUTO} AND gate_reached = 2 AND NOT {_in('scope_reason', V.GATE2_SCOPE_OUT_REASONS)}", f"{_LABEL} AND {_AUTO} AND gate_reached = 2 AND is_adc IS NOT NULL AND NOT {_in('is_adc', V.IS_ADC_VALUES)}",
    f"{_HUMAN} AND NOT {_in('is_adc', V.IS_ADC_VALUES)}", f"{_HUMAN} AND gate_reached = 1 AND is_adc = 'yes'",
    f"{_HUMAN} AND gate_reached = 1 AND is_adc = 'no' AND (in_scope IS NOT NULL OR scope_reason IS NOT NULL) AND NOT (in_scope IS NOT DISTINCT FROM 'no' AND scope_reason IS NOT DISTINCT FROM 'not_an_adc')",
    f"{_HUMAN} AND gate_reached >= 2 AND NOT {_in('is_adc', ('yes',))}", f"{_HUMAN} AND gate_reached >= 2 AND NOT {_in('in_scope', V.IN_SCOPE_VALUES)}", f"{_HUMAN} AND gate_reached = 2 AND in_scope = 'yes'",
    f"{_HUMAN} AND gate_reached = 2 AND in_scope = 'no' AND NOT {_in('scope_reason', V.GATE2_SCOPE_OUT_REASONS)}", f"{_G3} AND NOT {_in('in_scope', ('yes',))}", f"{_G3} AND history_coverage_at_serve_time <> 'full'",
    f"{_G3} AND {_HAS('third_party_first_noted_date')} <> {_HAS('third_party_source')}", f"{_G3} AND NOT {_in('status', V.PROGRAM_STATUSES)}", f"{_G3} AND NOT {_in('confidence', V.CONFIDENCE_LEVELS)}",
    f"{_DEAD} AND NOT {_in('kill_reason', V.KILL_REASONS)}", f"{_DEAD} AND NOT {_HAS('public_confirmation_date')} AND NOT coalesce(never_publicly_confirmed, false)", f"{_DEAD} AND NOT {_HAS('label_evidence_date')}",
    f"{_DEAD} AND {_HAS('public_confirmation_date')} AND NOT {_in('confirmation_evidence_type', V.CONFIRMATION_EVIDENCE_TYPES)}",
]
_RECORDS_SQL = "r AS (SELECT o_orderkey, o_custkey, o_orderdate, " + ", ".join(f"{sql} AS {c}" for c, sql in _FIELDS.items()) + " FROM orders)"


def records(spark: SparkSession, sf_dir: str, urgent: bool = False) -> DataFrame:
    """Orders as label records of programs (customers); ``urgent``: those of the highest priority."""
    o = orders(spark, sf_dir)
    return (o.where("o_orderpriority = '1-URGENT'") if urgent else o).select(
        "o_orderkey", F.col("o_custkey").alias("program_id"), F.col("o_orderkey").alias("position"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("timestamp"), F.lit(False).alias("is_repeat_probe"), *[F.expr(sql).alias(c) for c, sql in _FIELDS.items()]
    )


@query(f"WITH {_RECORDS_SQL} SELECT o_orderkey, {' + '.join(f'CASE WHEN {b} THEN 1 ELSE 0 END' for b in _BROKEN)} AS n_errors FROM r")
def label_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the validator's rules each record breaks."""
    return records(spark, sf_dir).select("o_orderkey", F.size(L.label_errors(["layer1"])).alias("n_errors"))


# The log of urgent orders only: most programs have no record in it.
_URGENT_SQL = _RECORDS_SQL.replace("FROM orders", "FROM orders WHERE o_orderpriority = '1-URGENT'") + ", l AS (SELECT * FROM r WHERE action = 'label')"
_LATEST_SQL = f"{_RECORDS_SQL}, l AS (SELECT * FROM r WHERE action = 'label' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey) = 1)"


@query(f"WITH {_URGENT_SQL} SELECT c_custkey AS program_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM l)")
def not_reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without a label in the log of urgent orders."""
    return L.not_reviewed(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("program_id")), records(spark, sf_dir, urgent=True))


@query(f"WITH {_LATEST_SQL} SELECT o_custkey AS program_id, status, kill_reason FROM l WHERE gate_reached = 3 AND status = 'dead_confirmed'")
def dead_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest labels of gate 3 that are confirmed dead, with their reason."""
    return L.dead_with_reason(records(spark, sf_dir)).select("program_id", "status", "kill_reason")


@query(f"WITH {_RECORDS_SQL} SELECT is_adc, triage_layer, scope_reason, count(*) AS n FROM r WHERE action = 'label' AND gate_reached = 1 GROUP BY ALL")
def rejection_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All gate-1 records by answer, layer and reason."""
    return L.rejection_patterns(records(spark, sf_dir))


@query(f"WITH {_LATEST_SQL} SELECT o_custkey AS program_id FROM l WHERE decided_by = 'auto' AND gate_reached = 2")
def automatic_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs whose latest label a rule gave at gate 2."""
    return queues.automatic_rejections(records(spark, sf_dir))


@query(f"""WITH {_URGENT_SQL}, s AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'unsure' END AS said FROM customer),
p AS (SELECT c_custkey AS program_id, CASE WHEN said IS NULL THEN 0 ELSE 1 END AS pool FROM s WHERE c_custkey NOT IN (SELECT o_custkey FROM l) AND c_custkey % 17 <> 0 AND (said IS NULL OR said = 'yes'))
SELECT program_id, pool, row_number() OVER (ORDER BY pool, program_id) - 1 AS turn FROM p""")
def stable_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue of open programs that no check may overturn."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("program_id"))
    staged = c.where("program_id % 6 < 3").withColumns({"is_adc": F.expr("case program_id % 6 when 0 then 'yes' when 1 then 'no' else 'unsure' end"), "timestamp": F.lit("2024"), "position": F.col("program_id"), "manual_overflow": F.lit(False)})
    return queues.stable_pool(c, records(spark, sf_dir, urgent=True), staged, c.where("program_id % 17 = 0"))


@query("""WITH q AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS turn FROM customer)
SELECT turn + turn // 9 AS serve, false AS is_repeat FROM q UNION ALL SELECT turn + turn // 9 + 1, true FROM q WHERE turn % 9 = 8""")
def serve_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The serves of a queue, every tenth a repeat."""
    from asofly.operators.temporal import dense_ids

    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("program_id"))
    return queues.serve_order(dense_ids(c, ["program_id"], "turn"), c.where("program_id <= 100")).select("serve", "is_repeat")


@query("""WITH q AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS place FROM orders) SELECT o_orderkey FROM q WHERE place >= 50 AND place < 200""")
def staged_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second stage of a run, 150 rows behind the first 50."""
    return queues.run_stage(orders(spark, sf_dir), ["o_orderdate", "o_orderkey"], 2, (1,)).select("o_orderkey")


@query("""WITH m AS (SELECT l_orderkey, list_sort(list_distinct(list(CAST(l_partkey AS VARCHAR)))) AS parts FROM lineitem GROUP BY l_orderkey),
v AS (SELECT o_custkey, o_orderkey AS to_version, lag(o_orderkey) OVER w AS from_version, coalesce(parts, []) AS b, lag(coalesce(parts, [])) OVER w AS a
  FROM orders LEFT JOIN m ON l_orderkey = o_orderkey WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT o_custkey, to_version, 'part_added' AS event_type, unnest(list_filter(b, lambda x: NOT list_contains(a, x))) AS value FROM v WHERE from_version IS NOT NULL
UNION ALL SELECT o_custkey, to_version, 'part_removed', unnest(list_filter(a, lambda x: NOT list_contains(b, x))) FROM v WHERE from_version IS NOT NULL""")
def member_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event for each part added to or removed from a customer's next order."""
    parts = lineitem(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey").cast("string")).alias("parts"))
    o = orders(spark, sf_dir).join(parts, F.col("l_orderkey") == F.col("o_orderkey"), "left").withColumn("parts", F.coalesce("parts", F.array().cast("array<string>")))
    pairs = differ.version_pairs(o, "o_custkey", "o_orderkey", "o_orderdate", "parts")
    e = pairs.select("o_custkey", "to_version", F.explode(differ.member_changes("part", F.col("prev"), F.col("curr"))).alias("e"))
    return e.select("o_custkey", "to_version", "e.event_type", F.coalesce("e.to_value", "e.from_value").alias("value"))


_STATUS_SQL = "CASE o_orderstatus WHEN 'O' THEN 'RECRUITING' WHEN 'F' THEN 'TERMINATED' ELSE 'UNKNOWN' END"
_WHY_SQL = "CASE o_orderkey % 3 WHEN 0 THEN 'lack of efficacy in the interim analysis' WHEN 1 THEN 'sponsor decision' END"


@query(f"""WITH t AS (SELECT o_orderkey, {_STATUS_SQL} AS s, {_WHY_SQL} AS why, CAST(o_orderdate AS DATE) AS d FROM orders),
v AS (SELECT *, why IS NULL OR length(trim(why)) < 15 OR why = 'sponsor decision' AS vague, greatest(date_diff('day', d, DATE '{AS_OF}'), 0) AS days FROM t)
SELECT o_orderkey, round((1 - exp(-days / 365.0)) * CASE WHEN s = 'TERMINATED' AND NOT vague THEN 0.3 ELSE 1 END, 6) AS stale, round(CASE WHEN s = 'RECRUITING' THEN greatest(0.0, least(1.0, date_diff('day', d, DATE '{AS_OF}') / 365.0)) ELSE 0 END, 6) AS lapse,
  CAST(CASE WHEN s = 'UNKNOWN' THEN 1.0 WHEN s = 'TERMINATED' AND why IS NULL THEN 0.8 WHEN s = 'TERMINATED' AND vague THEN 0.4 ELSE 0.0 END AS DOUBLE) AS ambiguity FROM v""")
def silence_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staleness, verification lapse and ambiguity of each order read as a trial."""
    o = orders(spark, sf_dir).select("o_orderkey", F.expr(_STATUS_SQL).alias("s"), F.expr(_WHY_SQL).alias("why"), "o_orderdate")
    s, why, d = F.col("s"), F.col("why"), F.col("o_orderdate")
    ambiguity = scoring.status_ambiguity(s, why, F.lit(True), F.lit(None).cast("date"), as_of())
    return o.select("o_orderkey", F.round(scoring.staleness(s, why, d, as_of()), 6).alias("stale"), F.round(scoring.verification_lapse(s, d, as_of()), 6).alias("lapse"), ambiguity.alias("ambiguity"))


@query("""WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice - a - b * l_quantity), 2) AS mean_residual FROM lineitem, f GROUP BY l_returnflag""")
def ols_residual_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: mean residual of price on quantity by flag."""
    return stats.ols_residuals(lineitem(spark, sf_dir), "l_extendedprice", "l_quantity").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("residual"), 2).alias("mean_residual"))


_PHASE_SQL = "CASE left(o_orderpriority, 1) WHEN '1' THEN 22.1 WHEN '2' THEN 11.2 ELSE 4.5 END"


@query(f"""WITH {PANEL_SQL}
SELECT c_nationkey AS program_id, p.as_of, round(sum(CASE WHEN p.o_orderkey IS NOT NULL THEN {_PHASE_SQL} * (o.o_orderkey % 100) * CASE WHEN p.as_of <= p.d THEN 0 ELSE date_diff('day', p.d, p.as_of) / 30.44 END ELSE 0 END), 2) AS cost_index
FROM panel p JOIN customer ON c_custkey = p.o_custkey LEFT JOIN orders o ON o.o_orderkey = p.o_orderkey GROUP BY ALL""")
def program_month_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly cost of nations as programs, their customers as trials and orders as trial versions."""
    phases = F.array(F.when(F.col("o_orderpriority").startswith("1"), "PHASE3").when(F.col("o_orderpriority").startswith("2"), "PHASE2").otherwise("PHASE1"))
    versions = orders(spark, sf_dir).select("o_custkey", F.col("o_orderkey").alias("version"), F.col("o_orderdate").alias("posted_date"), phases.alias("phases"), (F.col("o_orderkey") % 100).alias("enrollment"), F.col("o_orderdate").alias("start_date"))
    members = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("program_id"), F.col("c_custkey").alias("o_custkey"))
    m = finance.monthly_cost(versions, members, "program_id", "o_custkey", as_of())
    return m.withColumn("cost_index", F.round("cost_index", 2))


@query(f"""SELECT o_custkey AS program_id, round(sum({_PHASE_SQL} * (o_orderkey % 100) * CASE WHEN CAST(o_orderdate AS DATE) >= DATE '{AS_OF}' THEN 0 ELSE date_diff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF}') / 30.44 END * CASE WHEN o_orderkey % 5 > 0 THEN sqrt(o_orderkey % 5) ELSE 1 END), 2) AS cost_index,
  CAST(sum(o_orderkey % 5) AS BIGINT) AS site_count FROM orders GROUP BY o_custkey""")
def present_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Present cost of customers' orders with the site factor."""
    phases = F.array(F.when(F.col("o_orderpriority").startswith("1"), "PHASE3").when(F.col("o_orderpriority").startswith("2"), "PHASE2").otherwise("PHASE1"))
    current = orders(spark, sf_dir).select(F.col("o_custkey").alias("program_id"), phases.alias("phases"), (F.col("o_orderkey") % 100).alias("enrollment"), F.col("o_orderdate").alias("start_date"), (F.col("o_orderkey") % 5).alias("sites"))
    return finance.cost_snapshot(current, "program_id", as_of()).withColumn("cost_index", F.round("cost_index", 2))


@query("""WITH m AS (SELECT s_nationkey, l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, CAST(sum(CAST(l_extendedprice - 2000 AS DECIMAL(18,2))) AS DOUBLE) AS spend FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL HAVING sum(CAST(l_extendedprice - 2000 AS DECIMAL(18,2))) > 0),
p AS (SELECT a.s_nationkey, a.l_suppkey, a.month, a.spend, count(b.spend) AS peers, median(b.spend) AS med FROM m a LEFT JOIN m b ON a.s_nationkey = b.s_nationkey AND a.month = b.month AND a.l_suppkey <> b.l_suppkey GROUP BY ALL)
SELECT l_suppkey, month, peers, CASE WHEN peers >= 2 THEN round(spend / med, 4) END AS ratio FROM p""")
def conviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive monthly spend over the median of a nation's other suppliers."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    spend = F.sum((F.col("l_extendedprice") - 2000).cast("decimal(18,2)")).cast("double").alias("spend")
    m = lineitem(spark, sf_dir).join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_nationkey", "l_suppkey", F.trunc("l_shipdate", "MM").alias("month")).agg(spend)
    return finance.conviction(m, ["s_nationkey"], "l_suppkey", "month", "spend").select("l_suppkey", "month", "peers", F.round("ratio", 4).alias("ratio"))


@query(f"WITH {_WHOLE_SQL}, {_TRUE_SQL} SELECT doc_id AS program_id, truth AS labelled, stated FROM s JOIN t USING (doc_id) WHERE stated IS NOT NULL")
def stated_reason_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each labelled document's stated reason, from its whole text, beside the labelled one."""
    tail = F.expr("case doc_id % 5 when 0 then ' business decision after an interim analysis' when 1 then ' slow recruitment' when 2 then ' Dose-Limiting toxicity' when 3 then ' funding' else '' end")
    why = F.when(F.col("doc_id") % 7 == 0, "short").otherwise(F.concat("text", tail))
    p = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("program_id"), F.array(F.struct(F.lit("TERMINATED").alias("status"), why.alias("why_stopped"), F.lit("2020").alias("last_update_post_date"))).alias("trials"))
    reason = F.when(F.col("toxic") == 1, "toxicity_safety").when(F.col("quality") == 0, "futility_efficacy").otherwise("accrual_failure")
    r = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("program_id"), F.col("doc_id").alias("position"), F.lit("t").alias("timestamp"), F.lit("label").alias("action"), F.lit(3).alias("gate_reached"), F.lit(False).alias("is_repeat_probe"), F.lit("dead_confirmed").alias("status"), reason.alias("kill_reason"))
    return L.stated_vs_true(p, r)


_BODY = "'{\"protocolSection\":{\"statusModule\":{\"overallStatus\":\"' || o_orderstatus || '\",\"startDateStruct\":{\"date\":\"' || CAST(YEAR(CAST(o_orderdate AS DATE)) AS STRING) || '-03\"}},\"designModule\":{\"phases\":[\"' || o_orderpriority || '\"],\"enrollmentInfo\":{\"count\":' || CAST(o_orderkey % 1000 AS STRING) || ',\"type\":\"ACTUAL\"}}}}'"


@query(f"""WITH b AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'no json' WHEN 1 THEN '{{"study":' || {_BODY.replace("STRING", "VARCHAR")} || '}}' ELSE {_BODY.replace("STRING", "VARCHAR")} END AS body FROM orders),
s AS (SELECT o_orderkey, CASE WHEN json_valid(body) THEN coalesce(json_extract(body, '$.study'), CAST(body AS JSON)) END AS j FROM b)
SELECT o_orderkey, json_extract_string(j, '$.protocolSection.statusModule.overallStatus') AS status, CAST(json_extract_string(j, '$.protocolSection.statusModule.startDateStruct.date') || '-01' AS DATE) AS start_date,
  CAST(json_extract_string(j, '$.protocolSection.designModule.enrollmentInfo.count') AS INTEGER) AS enrollment, json_extract_string(j, '$.protocolSection.designModule.phases[0]') AS phase FROM s""")
def study_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat records of study bodies, bare or wrapped; what is no JSON has nulls only."""
    body = F.expr(f"case o_orderkey % 5 when 0 then 'no json' when 1 then '{{\"study\":' || {_BODY} || '}}' else {_BODY} end")
    s = orders(spark, sf_dir).select("o_orderkey", S.parse_study(body).alias("study"))
    return P.summarize(s, "o_orderkey").select("o_orderkey", "status", "start_date", "enrollment", F.get("phases", F.lit(0)).alias("phase"))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, sha256(text) AS sha256 FROM documents WHERE doc_id % 3 <> 0")
def snapshot_appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshots that an append adds: those not stored yet, each once."""
    d = table(spark, sf_dir, "documents").select(F.lit("docs").alias("source"), F.col("doc_id").cast("string").alias("id"), F.lit("2024-01-01").cast("date").alias("snapshot_date"), F.col("text").alias("body"), "doc_id")
    stored = d.where("doc_id % 3 = 0").withColumn("sha256", F.sha2("body", 256))
    return S.append_snapshots(d.unionByName(d), stored).select("id", "sha256")


@query("SELECT doc_id, " + "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + f" THEN '{s}'" for s, words in V.SYSTEM_KEYWORDS.items()) + " END AS system FROM (SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN ' Breast' WHEN 1 THEN ' uveal' ELSE '' END AS text FROM documents)")
def text_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Body system of each whole text by its first keyword group."""
    t = F.concat("text", F.expr("case doc_id % 4 when 0 then ' Breast' when 1 then ' uveal' else '' end"))
    return table(spark, sf_dir, "documents").select("doc_id", scoring.text_system(t).alias("system"))


@query("""WITH p AS (SELECT doc_id, CASE WHEN n_chars < 1000 THEN 0 WHEN n_chars < 3000 THEN 1 END AS band, lang FROM documents)
SELECT band, lang AS primary_archetype, count(*) AS population, count(l.doc_id) AS labelled FROM p LEFT JOIN labels l USING (doc_id) WHERE band IS NOT NULL GROUP BY ALL""")
def stratum_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents of each stratum; those without a band are left out."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("program_id"), F.when(F.col("n_chars") < 1000, 0).when(F.col("n_chars") < 3000, 1).alias("band"), F.col("lang").alias("primary_archetype"))
    return P.stratum_progress(d, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("program_id")))


@query("""WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), n AS (SELECT user_id, day, lead(day) OVER (PARTITION BY user_id ORDER BY day) AS next, count(*) OVER (PARTITION BY user_id) AS k FROM d)
SELECT 'provenance' AS stage, 'PASS' AS level, '0' AS actual, 'of ' || CAST(count(*) + count(next) AS VARCHAR) AS detail FROM n WHERE k > 1""")
def audit_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2: every date, and every day before the next one, is answered by the snapshot known then; all users are probed."""
    e = table(spark, sf_dir, "events").select(F.lit("events").alias("source"), F.col("user_id").cast("string").alias("id"), F.to_date("ts").alias("snapshot_date"))
    return audit.as_of_probe(e).select("stage", "level", "actual", "detail")


@query(f"""WITH {_RECORDS_SQL}, d AS (SELECT * FROM r WHERE action = 'label' AND status = 'dead_confirmed')
SELECT 'dead programs have a reason' AS name, CASE WHEN count(*) FILTER (WHERE kill_reason IS NULL) > 0 THEN 'FAIL' ELSE 'PASS' END AS level, CAST(count(*) FILTER (WHERE kill_reason IS NULL) AS VARCHAR) AS actual, 'of ' || count(*) AS detail FROM d
UNION ALL SELECT 'dead programs have an evidence date', CASE WHEN count(*) FILTER (WHERE label_evidence_date = '') > 0 THEN 'FAIL' ELSE 'PASS' END, CAST(count(*) FILTER (WHERE label_evidence_date = '') AS VARCHAR), 'of ' || count(*) FROM d
UNION ALL SELECT 'evidence was full when served', 'FAIL', CAST(count(*) FILTER (WHERE history_coverage_at_serve_time <> 'full') AS VARCHAR), 'of ' || count(*) FROM r WHERE action IN ('label', 'skip')
UNION ALL SELECT 'labels by gate', 'INFO', string_agg(gate_reached || '=' || n, ', ' ORDER BY gate_reached), '' FROM (SELECT gate_reached, count(*) AS n FROM r WHERE action = 'label' GROUP BY gate_reached)""")
def audit_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invariants of the label log."""
    r = records(spark, sf_dir).withColumns({"labeller": F.lit("me"), "blind": F.lit(True), "status_revised": F.lit(False)})
    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("program_id"), F.lit(1).alias("band"), F.col("c_mktsegment").alias("primary_archetype"))
    names = ("dead programs have a reason", "dead programs have an evidence date", "evidence was full when served", "labels by gate")
    return audit.gold_set(r, p).where(F.col("name").isin(*names)).select("name", "level", "actual", "detail")


@query(f"""WITH {PANEL_SQL}, k AS (SELECT *, CASE WHEN d IS NOT NULL THEN d ELSE as_of END AS known FROM panel)
SELECT 'nothing is used before it was known' AS name, CASE WHEN count(*) FILTER (WHERE known > as_of) = 0 THEN 'PASS' ELSE 'FAIL' END AS level, CAST(count(*) FILTER (WHERE known > as_of) AS VARCHAR) AS actual FROM k
UNION ALL SELECT 'features are registered', 'PASS', '1' UNION ALL SELECT 'staleness is missing', 'INFO', CAST(round(count(*) FILTER (WHERE d IS NULL) / count(*), 4) AS VARCHAR) FROM k
UNION ALL SELECT 'a record on its first date is its first version', 'PASS', '0'""")
def audit_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The month panel uses nothing before it was known, and first dates give first versions."""
    o = orders(spark, sf_dir).select("o_orderkey", "o_custkey", "o_orderdate")
    p = asof_month_panel(spark, sf_dir).join(o.select("o_orderkey", "o_orderdate"), "o_orderkey", "left").withColumn("knowability_date", F.coalesce("o_orderdate", "as_of"))
    checks = audit.features(p, {"staleness": "order date"}, ["staleness"]).unionByName(audit.leakage_probe(o, "o_custkey", "o_orderkey", "o_orderdate"))
    return checks.select("name", "level", "actual")


@query("""WITH t AS (SELECT s_name, l_orderkey, p_brand, l_quantity, s_acctbal FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey),
x AS (SELECT p_brand AS sponsor, count(DISTINCT s_name) AS programs, count(DISTINCT l_orderkey) AS trials, bool_or(l_quantity > 45) AS has_large_phase3, count(*) AS n FROM t GROUP BY p_brand)
SELECT sponsor, programs, trials, has_large_phase3, n AS phase3 FROM x""")
def sponsor_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as sponsors: suppliers as programs, orders as trials, large lines as large phase 3."""
    j = lineitem(spark, sf_dir).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    trial = F.struct(F.col("l_orderkey").cast("string").alias("nct_id"), F.col("p_brand").alias("sponsor"), F.array(F.lit("PHASE3")).alias("phases"), F.col("l_quantity").alias("enrollment"))
    none = F.array().cast("array<struct<sponsor:string,class:string>>")
    p = j.select(F.col("s_name").alias("candidate_id"), none.alias("sponsors_over_time"), F.array(trial).alias("trials"))
    return queues.sponsor_index(p, large=45).select("sponsor", "programs", "trials", "has_large_phase3", F.col("phase_counts")["PHASE3"].alias("phase3"))


@query("""WITH d AS (SELECT o_orderpriority, list_sort(list(CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS INTEGER))) AS s FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY o_orderpriority)
SELECT o_orderpriority, len(s) AS n, list_median(s) AS median, s[1] AS min, s[-1] AS max, s[CAST(floor(0.25 * len(s)) AS INT) + 1] AS q1, s[CAST(floor(0.75 * len(s)) AS INT) + 1] AS q3 FROM d""".replace("list_median(s)", "list_aggregate(s, 'median')"))
def lead_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days from order to shipment with index quartiles."""
    j = lineitem(spark, sf_dir).join(orders(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderpriority", F.datediff("l_shipdate", "o_orderdate").alias("lead"))
    return queues.lead_distribution(j, "o_orderpriority", "lead").drop("mean")


def _alias_sql(target: str) -> str:
    return " OR ".join(f"regexp_matches(snippet, '(?i){a}')" for a in V.TARGET_ALIASES[target])


_TARGETS = ("ERBB2", "CD22", "DLL3", "MET", "AXL")


@query(f"""WITH n AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Trastuzumab xyz' WHEN 1 THEN 'anti-CD22 conjugate' ELSE 'abc-1' END AS name, text || CASE doc_id % 4 WHEN 0 THEN ' targets DLL3' WHEN 1 THEN ' HER2 and CD22' WHEN 2 THEN ' c-Met' ELSE '' END AS snippet FROM documents),
h AS (SELECT doc_id, name, list_filter([{", ".join(f"CASE WHEN {_alias_sql(t)} THEN '{t}' END" for t in _TARGETS)}], lambda x: x IS NOT NULL) AS hits FROM n),
r AS (SELECT doc_id, CASE WHEN contains(lower(name), 'trastuzumab') THEN 'ERBB2' WHEN len(hits) = 1 THEN hits[1] WHEN regexp_matches(name, '(?i)\\bcd22\\b') THEN 'CD22' END AS target, CASE WHEN contains(lower(name), 'trastuzumab') THEN 'stem' WHEN len(hits) = 1 THEN 'trial_text' WHEN regexp_matches(name, '(?i)\\bcd22\\b') THEN 'name' ELSE 'unresolved' END AS source FROM h)
SELECT doc_id, CASE WHEN target IS NULL AND doc_id % 5 = 0 THEN 'ROR1' ELSE target END AS target, CASE WHEN target IS NULL AND doc_id % 5 = 0 THEN 'external' ELSE source END AS source FROM r""")
def target_with_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets found in whole texts by their aliases, and the residual map for what is left; the SQL searches the texts too."""
    d = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("program_id"), F.expr("case doc_id % 6 when 0 then 'Trastuzumab xyz' when 1 then 'anti-CD22 conjugate' else 'abc-1' end").alias("name"),
        F.concat("text", F.expr("case doc_id % 4 when 0 then ' targets DLL3' when 1 then ' HER2 and CD22' when 2 then ' c-Met' else '' end")).alias("snippet"),
    )
    own = d.select("program_id", resolve_target(F.array("name"), F.array("snippet")).alias("r")).select("program_id", "r.target", "r.source")
    residual = d.where("program_id % 5 = 0").select("program_id", F.lit("ROR1").alias("target"), F.lit("external").alias("source"))
    return queues.with_residual(own, residual).withColumnRenamed("program_id", "doc_id")


@query("""WITH g AS (SELECT doc_id, quality FROM labels), s AS (SELECT doc_id, CASE WHEN n_chars > 500 THEN 1 WHEN n_chars > 100 THEN 0 END AS said FROM documents), j AS (SELECT g.doc_id, quality, said FROM g LEFT JOIN s USING (doc_id))
SELECT count(*) AS population, count(said) AS n, round(count(said) / count(*), 6) AS coverage, count(*) FILTER (WHERE said = quality) AS agree, round(count(*) FILTER (WHERE said = quality) / count(said), 6) AS accuracy FROM j""")
def evaluation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers by length against labels: coverage and accuracy, abstentions left out."""
    gold = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("program_id"), F.col("quality").alias("x"))
    silver = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("program_id"), F.when(F.col("n_chars") > 500, 1).when(F.col("n_chars") > 100, 0).alias("x"))
    s = queues.evaluation(gold, silver, "x")["summary"]
    return s.select("population", "n", F.round("coverage", 6).alias("coverage"), "agree", F.round("accuracy", 6).alias("accuracy"))


@query(f"""WITH c AS (SELECT c_custkey AS program_id, CASE c_custkey % 4 WHEN 0 THEN 'dead_confirmed' WHEN 1 THEN 'superseded' ELSE 'active' END AS status, CASE WHEN c_custkey % 8 = 0 THEN DATE '1999-05-05' END AS dead FROM customer),
f AS (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS done FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey)
SELECT program_id, CASE WHEN status = 'dead_confirmed' AND dead IS NOT NULL THEN 'dead' WHEN status = 'superseded' AND done IS NOT NULL THEN 'superseded' ELSE 'censored' END AS outcome,
  CASE WHEN status = 'dead_confirmed' AND dead IS NOT NULL THEN dead WHEN status = 'superseded' AND done IS NOT NULL THEN done ELSE DATE '{AS_OF}' END AS event_month FROM c LEFT JOIN f ON o_custkey = program_id""")
def program_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: outcome and date of customers as programs, finished orders being completed trials."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("program_id"))
    t = F.struct(F.when(F.col("o_orderstatus") == "F", "ACTUAL").otherwise("ESTIMATED").alias("primary_completion_type"), F.col("o_orderdate").cast("string").alias("primary_completion_date"))
    per = orders(spark, sf_dir).groupBy(F.col("o_custkey").alias("program_id")).agg(F.collect_list(t).alias("trials"))
    lab = c.select("program_id", F.expr("case program_id % 4 when 0 then 'dead_confirmed' when 1 then 'superseded' else 'active' end").alias("status"), F.expr("case when program_id % 8 = 0 then '1999-05-05' end").alias("public_confirmation_date"))
    return survival.outcomes(c.join(per, "program_id", "left"), lab, as_of())


@query(f"""WITH {PANEL_SQL}, e AS (SELECT c_custkey, c_acctbal < 0 AS dead FROM customer), t AS (SELECT o_custkey, as_of, date_diff('day', d, as_of) AS days, dead, row_number() OVER (PARTITION BY o_custkey ORDER BY as_of DESC) AS rn FROM panel JOIN e ON c_custkey = o_custkey WHERE as_of <= DATE '1999-01-01')
SELECT o_custkey AS program_id, as_of, round(ln(1 + coalesce(days, 0)), 6) AS log_cost_index, CASE WHEN rn = 1 AND dead THEN 1 ELSE 0 END AS event_dead FROM t""")
def person_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows up to the event, logged covariates, an event on each dead program's last row."""
    o = orders(spark, sf_dir).select("o_orderkey", "o_orderdate")
    p = asof_month_panel(spark, sf_dir).join(o, "o_orderkey", "left").select(F.col("o_custkey").alias("program_id"), "as_of", F.col("staleness").alias("silence_score_asof"), F.datediff("as_of", "o_orderdate").cast("double").alias("cost_index"), F.lit(1.0).alias("conviction_ratio"))
    out = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("program_id"), F.when(F.col("c_acctbal") < 0, "dead").otherwise("censored").alias("outcome"), F.lit("1999-01-01").cast("date").alias("event_month"))
    t = survival.training_table(p, out, as_of())
    return t.select("program_id", "as_of", F.round("log_cost_index", 6).alias("log_cost_index"), "event_dead")


@query()
def back_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit up to a cut, score the months behind it, and set the model's curve beside the plain score's.

    Iterative, so without SQL; the parts have theirs, and the whole a test.
    """
    o = orders(spark, sf_dir).select("o_orderkey", "o_orderdate")
    p = asof_month_panel(spark, sf_dir).join(o, "o_orderkey", "left").select(
        F.col("o_custkey").alias("program_id"), "as_of", F.col("staleness").alias("silence_score_asof"), F.datediff("as_of", "o_orderdate").cast("double").alias("cost_index"), (F.col("o_custkey") % 7 + 1).cast("double").alias("conviction_ratio"), (F.col("o_custkey") % 50).alias("sponsor")
    )
    c = table(spark, sf_dir, "customer")
    out = c.select(F.col("c_custkey").alias("program_id"), F.when(F.col("c_acctbal") < 0, "dead").otherwise("censored").alias("outcome"), F.when(F.col("c_acctbal") < 0, F.add_months(F.lit("1998-01-01").cast("date"), (F.col("c_custkey") % 24).cast("int"))).otherwise(as_of()).alias("event_month"))
    cut = F.lit("1999-01-01").cast("date")
    hazard = survival.fit_hazard(survival.training_table(p, out, cut), "event_dead")
    scored = P.panels_after(survival.training_table(p, out, as_of()).select("program_id", "as_of", *survival.COVARIATES), out, cut, as_of()).withColumn("p", hazard.column())
    scored = materialize(scored, "back-test-scores")
    curves = []
    for name, score in (("model", "p"), ("score", "silence_score_asof")):
        cuts = survival.thresholds(scored, score)
        curves.append(survival.sweep(scored, score, out, cuts).withColumn("by", F.lit(name)))
    return curves[0].unionByName(curves[1])


@query()
def review_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """users' events as events of review sessions, and what each session is served (a fold; tested against the plain one)."""
    kinds = F.create_map(*[F.lit(x) for x in ("view", "load", "click", "serve", "purchase", "label", "error", "skip", "signup", "switch")])
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session"), F.struct("ts", "event_id").alias("at"), F.element_at(kinds, F.col("event_type")).alias("kind"), "event_id")
    numbered = e.withColumn("seq", F.col("event_id").cast("long"))
    queue = F.when(F.col("kind") == "switch", F.when(F.col("event_id") % 5 == 0, "validation").otherwise("main"))
    events = numbered.select("session", "seq", "kind", queue.alias("queue"), F.array(F.concat(F.lit("p"), (F.col("event_id") % 1000).cast("string"))).alias("ids"), F.lit(None).cast("double").alias("cost"))
    return sessions.replay(events)


_SHAPES = "CASE o_orderkey % 4 WHEN 0 THEN '{\"a\": ' || o_orderkey || '}' WHEN 1 THEN '{\"a\": \"' || o_orderstatus || '\", \"b\": [1, {\"c\": null}]}' WHEN 2 THEN '{\"b\": [], \"a\": {\"d\": true}}' ELSE 'none' END"


@query("""WITH k AS (SELECT o_orderkey % 4 AS k, count(*) AS n, CAST(min(CAST(o_orderdate AS DATE)) AS DATE) AS first, CAST(max(CAST(o_orderdate AS DATE)) AS DATE) AS last FROM orders GROUP BY ALL),
p(k, path, kind) AS (VALUES (0, '$', 'object'), (0, '$.a', 'number'), (1, '$', 'object'), (1, '$.a', 'string'), (1, '$.b', 'array'), (1, '$.b[]', 'number'), (1, '$.b[]', 'object'), (1, '$.b[].c', 'null'), (2, '$', 'object'), (2, '$.b', 'array'), (2, '$.a', 'object'), (2, '$.a.d', 'boolean'), (3, '$', 'invalid'))
SELECT path, kind, CAST(sum(n) AS BIGINT) AS n, min(first) AS first, max(last) AS last FROM p JOIN k USING (k) GROUP BY path, kind""")
def variant_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths and kinds of bodies of four shapes, one of them no JSON, with the dates between which they were seen."""
    b = orders(spark, sf_dir).select("o_orderkey", F.expr(_SHAPES).alias("body"), F.col("o_orderdate").cast("date").alias("day"))
    return paths.path_table(paths.body_paths(b, "o_orderkey", "body"), b, "o_orderkey", "day")
