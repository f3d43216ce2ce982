"""Queries of the entity, text, set and source operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from asofly.functions import text as X
from asofly.functions import vocab as V
from asofly.operators import components, dictionary
from asofly.operators import entities as E
from asofly.operators import labels as L
from asofly.operators import programs as P
from asofly.operators import triage as T
from asofly.operators.graph import connected_components
from asofly.plans.registry import query
from asofly.plans.tables import lineitem, orders, table
from asofly.session import materialize, scratch_path
from asofly.sources import snapshots as S
from asofly.sources.commits import SnapshotStore


def _list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


@query("""SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM customer d WHERE d.c_nationkey = c.c_nationkey AND d.c_mktsegment = c.c_mktsegment AND d.c_custkey <> c.c_custkey AND d.c_acctbal > c.c_acctbal)""")
def semi_successor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a greater one in their group; the group's greatest decides, without pairs."""
    c = table(spark, sf_dir, "customer")
    return E.later_successor(c, "c_custkey", ["c_nationkey", "c_mktsegment"], "c_acctbal").where("has_successor").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def anti_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an order of a kind."""
    versions = orders(spark, sf_dir).select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    return P.without_type(table(spark, sf_dir, "customer").select("c_custkey"), versions, "P", "c_custkey", "o_orderstatus")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def outstanding_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that neither of two logs of orders has."""
    done = [orders(spark, sf_dir).where(w).select(F.col("o_custkey").alias("c_custkey")) for w in ("o_orderstatus = 'P'", "o_totalprice > 300000")]
    return P.outstanding(table(spark, sf_dir, "customer"), *done, key="c_custkey")


_WORDS_SQL = "list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


@query(f"""WITH b AS (SELECT {_WORDS_SQL.format("text")} AS w FROM benchmark),
names AS (SELECT DISTINCT w[i] || ' ' || w[i + 1] AS name FROM (SELECT w, unnest(range(1, len(w))) AS i FROM b) UNION SELECT DISTINCT w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM (SELECT w, unnest(range(1, len(w) - 1)) AS i FROM b)),
d AS (SELECT doc_id, {_WORDS_SQL.format("coalesce(text, '')")} AS w FROM documents),
runs AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] AS name FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d) UNION ALL SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d))
SELECT doc_id, name, count(*) AS n, min(i) - 1 AS first_word FROM runs JOIN names USING (name) GROUP BY doc_id, name""")
def text_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every phrase of two or three words of the benchmark, wherever whole documents hold it."""
    words = F.split(dictionary.spoken("text"), " ")
    run = lambda k: F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.array_join(F.slice("w", i, k), " "))).alias("name")
    b = table(spark, sf_dir, "benchmark").select(words.alias("w"))
    names = b.where(F.size("w") >= 2).select(run(2)).unionByName(b.where(F.size("w") >= 3).select(run(3)))
    return dictionary.text_mentions(table(spark, sf_dir, "documents"), "text", "doc_id", names, "name")


@query("""SELECT o_orderstatus AS source, year(CAST(o_orderdate AS DATE)) AS year, count(*) AS n, count(DISTINCT sha256(CAST(o_orderkey AS VARCHAR) || '|' || o_orderstatus)) AS bodies FROM orders GROUP BY ALL""")
def committed_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as snapshots in three commits, the second repeating the first's, and what a reader of the store sees."""
    body = F.concat(F.col("o_orderkey").cast("string"), F.lit("|"), F.col("o_orderstatus"))
    rows = orders(spark, sf_dir).select(F.col("o_orderstatus").alias("source"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderdate").cast("date").alias("snapshot_date"), F.col("o_orderdate").cast("timestamp").alias("fetched_at"), F.lit("u").alias("url"), body.alias("body"))
    store = SnapshotStore(spark, scratch_path(spark, "snapshot-store", keep=True))
    for upto in ("1994-12-31", "1996-12-31", "9999-12-31"):
        store.append(rows.where(F.col("snapshot_date") <= upto))
    return store.read().groupBy("source", F.year("snapshot_date").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sha256").alias("bodies"))


@query()
def growing_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers joined by parts, the lines of returned goods first, then the others in two batches (iterative; tested against union-find)."""
    e = lineitem(spark, sf_dir).select(F.concat(F.lit("s"), "l_suppkey").alias("a"), F.concat(F.lit("p"), "l_partkey").alias("b"), "l_returnflag")
    stored = materialize(components.first_components(e.where("l_returnflag = 'R'"), "a", "b"), "components-0")
    for batch, flag in enumerate(("A", "N"), 1):
        stored = materialize(components.add_edges(stored, e.where(F.col("l_returnflag") == flag), "a", "b", batch)[0], f"components-{batch}")
    return stored


@query("""SELECT l_partkey, count(DISTINCT l_suppkey) AS groups FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1 AND bool_and(s_acctbal > -500)""")
def combo_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that several suppliers deliver, all of them in good standing."""
    j = lineitem(spark, sf_dir).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_partkey", "l_suppkey", (F.col("s_acctbal") > -500).alias("ok_supplier"))
    return E.shared_members(j, "l_suppkey", "l_partkey", "ok_supplier")


_SHARED_SQL = """WITH m AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), a AS (SELECT l_partkey, list_sort(list(l_suppkey)) AS all_ FROM m GROUP BY l_partkey)
SELECT l_suppkey, l_partkey, array_to_string(list_filter(all_, lambda x: x <> l_suppkey), ',') AS shared_with FROM m JOIN a USING (l_partkey)"""


@query(_SHARED_SQL)
def shared_with(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each supplier and part, the other suppliers of the part, over every line."""
    return shared_with_all(spark, sf_dir)


@query(_SHARED_SQL)
def shared_with_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``shared_with``; the name under which it was first registered for every line."""
    return E.shared_with(lineitem(spark, sf_dir), "l_suppkey", "l_partkey").withColumn("shared_with", F.array_join("shared_with", ","))


@query("SELECT p_partkey, lower(trim(regexp_replace('  ' || p_name || '  ' || p_type, '\\s+', ' ', 'g'))) AS name FROM part")
def name_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """normalised names."""
    return table(spark, sf_dir, "part").select("p_partkey", X.normalise(F.concat(F.lit("  "), "p_name", F.lit("  "), "p_type")).alias("name"))


_NAMES = "CASE p_partkey % 8 WHEN 0 THEN p_name || ' Vedotin' WHEN 1 THEN 'anti ' || p_name || ' ADC' WHEN 2 THEN 'XMT-' || (1000 + p_partkey) WHEN 3 THEN 'SKB' || (100 + p_partkey) || ' for injection' WHEN 4 THEN 'Trastuzumab (Herceptin)' WHEN 5 THEN p_name || ' soravtansine' WHEN 6 THEN 'placebo' ELSE p_name END"


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names dressed as free-text compound names."""
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(_NAMES.replace("||", "||")).alias("name"))


_SUFFIX_SQL = " ".join(f"WHEN contains(lower(name), '{t}') THEN '{t}'" for t in V.SUFFIX_CHEMOTYPES)
_LITERAL_SQL = " ".join(f"WHEN regexp_matches(lower(name), '\\b{t}\\b') THEN '{t}'" for t in V.LITERAL_TERMS)


@query(f"""WITH n AS (SELECT p_partkey, {_NAMES} AS name FROM part), t AS (SELECT p_partkey, CASE {_SUFFIX_SQL} END AS suffix, CASE {_LITERAL_SQL} END AS literal FROM n)
SELECT p_partkey, CASE WHEN suffix IS NOT NULL THEN 'suffix' WHEN literal IS NOT NULL THEN 'literal' END AS strength, coalesce(suffix, literal) AS term FROM t""")
def pattern_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """suffix before literal, in list order."""
    return part_names(spark, sf_dir).select("p_partkey", X.match_pattern("name").alias("m")).select("p_partkey", "m.strength", "m.term")


@query(f"""WITH n AS (SELECT p_partkey, {_NAMES} AS name FROM part)
SELECT p_partkey, regexp_matches(trim(name), '^[A-Za-z]{{2,8}}[-\\s]?\\d{{2,6}}[A-Za-z]{{0,3}}$') OR regexp_matches(regexp_replace(trim(name), '(?i)\\s+for\\s+(injection|infusion|intravenous\\s+use)\\s*$', ''), '^[A-Za-z]{{2,8}}[-\\s]?\\d{{2,6}}[A-Za-z]{{0,3}}$') AS dev_code,
  lower(trim(name)) IN ({_list(V.DENYLIST)}) OR trim(regexp_replace(lower(trim(name)), '\\s*\\([^)]*\\)\\s*$', '')) IN ({_list(V.DENYLIST)}) AS denylisted FROM n""")
def dev_code_denylist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """development codes and listed partner drugs."""
    return part_names(spark, sf_dir).select("p_partkey", X.looks_like_dev_code("name").alias("dev_code"), X.is_denylisted("name").alias("denylisted"))


@query(f"""WITH n AS (SELECT p_partkey, {_NAMES} AS name FROM part), t AS (SELECT p_partkey, CASE {_SUFFIX_SQL} END AS suffix FROM n)
SELECT p_partkey, CASE suffix {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.SUFFIX_CHEMOTYPES.items())} ELSE 'undisclosed' END AS chemotype FROM t""")
def payload_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """payload class by suffix."""
    return part_names(spark, sf_dir).select("p_partkey", X.payload_class(F.array("name")).alias("chemotype"))


@query()
def entity_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: components of suppliers and parts linked by any line; too slow as recursive SQL, so tested against union-find."""
    return entity_components_all(spark, sf_dir)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON left(b.n_name, 1) = left(a.n_name, 1)),
v AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e), r AS (SELECT x, x AS root FROM v UNION SELECT v.y, r.root FROM r JOIN v ON v.x = r.x)
SELECT x AS vertex, min(root) AS component FROM r GROUP BY x""")
def nation_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: components of nations by their first letter, linked along a chain; small enough for recursive SQL."""
    from pyspark.sql import Window

    n = table(spark, sf_dir, "nation").withColumn("letter", F.substring("n_name", 1, 1))
    e = n.withColumn("before", F.coalesce(F.lag("n_nationkey").over(Window.partitionBy("letter").orderBy("n_nationkey")), F.col("n_nationkey")))
    return connected_components(e, "n_nationkey", "before")


@query()
def entity_components_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: as ``entity_components``; the name under which it was first registered for every line."""
    e = lineitem(spark, sf_dir).select("l_suppkey", (F.col("l_partkey") + 1000000).alias("part"))
    return connected_components(e, "l_suppkey", "part")


def _named(c: str) -> str:
    """SQL list of the targets whose aliases a text has. Its expressions know no look-ahead: the one alias with it is a match that isn't one of "receptor 2"."""

    def one(alias: str) -> str:
        plain, ahead, tail = alias.partition("(?!")
        hit = f"regexp_matches({c}, '(?i){plain}')"
        return f"({hit} AND NOT regexp_matches({c}, '(?i){plain}{tail[:-1]}'))" if ahead else hit

    return "list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(map(one, aliases))} THEN '{t}' END" for t, aliases in V.TARGET_ALIASES.items()) + "], lambda x: x IS NOT NULL)"


_STEMS = " ".join(f"WHEN contains(lower(name), '{s}') THEN '{t}'" for s, t in V.STEM_TARGETS.items())
_TARGET_SQL = f"""WITH n AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Trastuzumab xyz' WHEN 1 THEN 'anti-CD22 conjugate' ELSE 'abc-1' END AS name, text || CASE doc_id % 4 WHEN 0 THEN ' targets DLL3' WHEN 1 THEN ' HER2 and CD22' ELSE '' END AS snippet FROM documents),
h AS (SELECT doc_id, CASE {_STEMS} END AS stem, {_named('snippet')} AS t, {_named('name')} AS m FROM n)
SELECT doc_id, coalesce(stem, CASE WHEN len(t) = 1 THEN t[1] END, CASE WHEN len(m) = 1 THEN m[1] END) AS target,
  CASE WHEN stem IS NOT NULL THEN 'stem' WHEN len(t) = 1 THEN 'trial_text' WHEN len(m) = 1 THEN 'name' ELSE 'unresolved' END AS source FROM h"""


@query(_TARGET_SQL)
def target_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """targets by tiers of evidence in whole texts; an ambiguous text resolves nothing. The SQL looks for the same stems and aliases."""
    return targets(spark, sf_dir, F.col("text"))


@query(_TARGET_SQL)
def target_resolution_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """as ``target_resolution``; the name under which it was first registered for whole texts."""
    return targets(spark, sf_dir, F.col("text"))


def targets(spark: SparkSession, sf_dir: str, text: Column) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.expr("case doc_id % 6 when 0 then 'Trastuzumab xyz' when 1 then 'anti-CD22 conjugate' else 'abc-1' end").alias("name"),
        F.concat(text, F.expr("case doc_id % 4 when 0 then ' targets DLL3' when 1 then ' HER2 and CD22' else '' end")).alias("snippet"),
    )
    return d.select("doc_id", X.resolve_target(F.array("name"), F.array("snippet")).alias("r")).select("doc_id", "r.target", "r.source")


@query("""WITH q AS (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN regexp_replace(substr(text, 11, 50), ' ', '  ', 'g') WHEN 1 THEN 'not in there ' || doc_id ELSE '  ' END AS quote FROM documents)
SELECT doc_id, trim(regexp_replace(quote, '[\\s\\x0b]+', ' ', 'g')) <> '' AND contains(trim(regexp_replace(text, '[\\s\\x0b]+', ' ', 'g')), trim(regexp_replace(quote, '[\\s\\x0b]+', ' ', 'g'))) AS verified FROM q""")
def quote_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quotes found again in their source, white space aside."""
    quote = F.when(F.col("doc_id") % 3 == 0, F.regexp_replace(F.substring("text", 11, 50), " ", "  ")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("not in there "), F.col("doc_id").cast("string"))).otherwise("  ")
    return table(spark, sf_dir, "documents").select("doc_id", X.verify_quote(quote, "text").alias("verified"))


@query("""WITH t AS (SELECT doc_id, text, substr(text, 1, 100) AS cut FROM documents),
s AS (SELECT doc_id, text, cut, CASE WHEN regexp_matches(substr(text, 101, 1), '^[\\p{L}\\p{N}]') AND regexp_matches(cut, '[\\p{L}\\p{N}]$') AND regexp_matches(cut, '\\S\\s+\\S+$') THEN regexp_replace(cut, '\\s+\\S+$', '') ELSE cut END AS c FROM t)
SELECT doc_id, CASE WHEN length(text) <= 100 THEN text ELSE regexp_replace(c, '\\s+$', '') END AS snippet FROM s""")
def snippet_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """at most a hundred characters, whole words."""
    return table(spark, sf_dir, "documents").select("doc_id", X.truncate_at_word("text", 100).alias("snippet"))


@query("""SELECT page_id, replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&#39;', ''''), '&amp;', '&') AS html, upper(split_part(split_part(url, '://', 2), '/', 1)) AS host FROM pages""")
def html_unescape_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character references undone, and the host as an upper-case class key."""
    host = F.upper(F.element_at(F.split(F.element_at(F.split("url", "://"), 2), "/"), 1))
    return table(spark, sf_dir, "pages").select("page_id", X.unescape_html("html").alias("html"), host.alias("host"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, NOT list_contains(json_keys(props), 'k') AS guard_failed FROM events""")
def json_paths_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested values by schema, and records that lack a required key."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.from_json("props", "k int")["k"].alias("k"), (F.size(S.missing_keys(F.col("props"), ["k"])) > 0).alias("guard_failed"))


@query("""SELECT doc_id, sha256(text) AS digest, CASE WHEN doc_id % 97 = 0 THEN 'orphan_file' WHEN doc_id % 89 = 0 THEN 'hash_mismatch' END AS problem FROM documents""")
def sha_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of bodies against a manifest with gaps and errors in it."""
    d = table(spark, sf_dir, "documents").select(F.lit("docs").alias("source"), F.col("doc_id").cast("string").alias("id"), F.lit("2024-01-01").cast("date").alias("snapshot_date"), F.col("text").alias("body"), F.sha2("text", 256).alias("digest"), "doc_id")
    stored = d.withColumn("sha256", F.when(F.col("doc_id") % 89 == 0, F.lit("0")).otherwise(F.col("digest")))
    bad = S.integrity(stored, stored.where("doc_id % 97 <> 0"))
    return d.join(bad, ["source", "id", "snapshot_date"], "left").select("doc_id", "digest", "problem")


@query("""SELECT conv_id, turn, CASE WHEN turn < 0 THEN 'negative turn' WHEN role NOT IN ('user', 'assistant', 'system') THEN 'unknown role' WHEN turn % 2 = 0 AND role = 'assistant' THEN 'assistant out of turn' WHEN length(trim(text)) = 0 THEN 'empty' END AS error FROM conversations""")
def gate_validator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that a record breaks."""
    rules = [(F.col("turn") < 0, F.lit("negative turn")), (~F.col("role").isin("user", "assistant", "system"), F.lit("unknown role")), ((F.col("turn") % 2 == 0) & (F.col("role") == "assistant"), F.lit("assistant out of turn")), (F.length(F.trim("text")) == 0, F.lit("empty"))]
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.first_matching(rules).alias("error"))


@query("""WITH q AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn AS answer, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'assistant'),
n AS (SELECT conv_id, count(*) FILTER (WHERE role = 'user') = count(*) FILTER (WHERE role = 'assistant') AS same FROM conversations GROUP BY conv_id)
SELECT q.conv_id, q.turn, CASE WHEN same THEN answer END AS answer FROM q JOIN n USING (conv_id) LEFT JOIN a ON a.conv_id = q.conv_id AND a.k = q.k""")
def position_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to questions by position where a conversation has as many of both; their names never match."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations")
    asked = c.where("role = 'user'").select("conv_id", F.row_number().over(w).alias("position"), F.concat(F.lit("q"), "turn").alias("name"), "turn")
    answered = c.where("role = 'assistant'").select("conv_id", F.row_number().over(w).alias("position"), F.concat(F.lit("a"), "turn").alias("name"), F.col("turn").alias("answer"))
    return L.align_answers(asked, answered, "conv_id").select("conv_id", "turn", "answer")


@query(f"""WITH n AS (SELECT p_partkey, {_NAMES} AS name, p_size FROM part),
m AS (SELECT *, CASE WHEN contains(lower(name), 'vedotin') THEN 'inn_suffix:vedotin' WHEN contains(lower(name), 'soravtansine') THEN 'inn_suffix:soravtansine' WHEN p_partkey % 8 IN (4, 6) THEN 'denylist' WHEN p_partkey % 8 = 1 THEN 'generic_class_label' END AS mol FROM n),
s AS (SELECT *, CASE WHEN mol = 'denylist' THEN 'no' WHEN mol IS NOT NULL THEN 'yes' END AS is_adc, CASE WHEN p_size > 40 THEN 'non_industry' WHEN p_size > 30 THEN 'heme_only' END AS rej, p_size <= 20 AS pos FROM m)
SELECT CAST(p_partkey AS VARCHAR) AS program_id, is_adc, CASE WHEN is_adc = 'no' THEN NULL WHEN rej IS NOT NULL THEN 'no' WHEN pos OR is_adc = 'yes' THEN 'yes' END AS in_scope,
  CASE WHEN coalesce(is_adc, '') <> 'no' THEN rej END AS scope_reason,
  nullif(concat_ws('+', mol, CASE WHEN is_adc = 'no' THEN NULL WHEN rej IS NOT NULL THEN 'scope:' || rej WHEN pos THEN 'positive_in_scope' WHEN is_adc = 'yes' THEN 'elimination' END), '') AS rule,
  coalesce(is_adc, '') = 'no' OR rej IS NOT NULL AS committable FROM s""")
def triage_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ordered rules over names, sponsors and scopes."""
    n = part_names(spark, sf_dir).join(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    sponsor = F.array(F.struct(F.lit("s").alias("sponsor"), F.when(F.col("p_size") > 40, "OTHER").otherwise("INDUSTRY").alias("class")))
    scope = F.array(F.when(F.col("p_size") > 40, "unresolved").when(F.col("p_size") > 30, "heme").when(F.col("p_size") > 20, "mixed").otherwise("solid"))
    p = n.select(F.col("p_partkey").cast("string").alias("program_id"), F.col("name").alias("proposed_name"), F.array().cast("array<string>").alias("synonyms"), sponsor.alias("sponsors_over_time"), scope.alias("scopes"), F.array(F.lit("2015-01-01").cast("date")).alias("start_dates"))
    return T.triage(p, F.array(F.lit("nothing known")))


@query(f"""WITH n AS (SELECT p_partkey, {_NAMES} AS name FROM part), k AS (SELECT DISTINCT lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))) AS a FROM n), t AS (SELECT DISTINCT lower(p_name) AS b FROM part)
SELECT a, b FROM k, t WHERE regexp_matches(a, '(^|[^\\p{{L}}\\p{{N}}])' || b || '($|[^\\p{{L}}\\p{{N}}])') OR regexp_matches(b, '(^|[^\\p{{L}}\\p{{N}}])' || regexp_escape(a) || '($|[^\\p{{L}}\\p{{N}}])')""")
def name_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that hold one another as whole words."""
    return E.containment(part_names(spark, sf_dir), "name", table(spark, sf_dir, "part"), "p_name")


@query("""WITH o AS (SELECT c_custkey AS k, c_mktsegment AS n FROM customer WHERE c_custkey % 10 <> 0), w AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 15 = 0 THEN 'MOVED' ELSE c_mktsegment END AS n FROM customer WHERE c_custkey % 7 <> 0)
SELECT coalesce(o.k, w.k) AS c_custkey, CASE WHEN o.k IS NULL THEN 'added' WHEN w.k IS NULL THEN 'removed' WHEN o.n <> w.n THEN 'renamed' ELSE 'kept' END AS change, o.n AS old_name, w.n AS new_name FROM o FULL JOIN w ON o.k = w.k""")
def table_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows added, removed, renamed and kept between two states of a table."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    new = S.update_where(c.where("c_custkey % 7 <> 0"), F.col("c_custkey") % 15 == 0, {"c_mktsegment": F.lit("MOVED")})
    return E.compare_tables(c.where("c_custkey % 10 <> 0"), new, "c_custkey", "c_mktsegment")


@query("""SELECT s_suppkey, CASE WHEN count(DISTINCT n_name) = 1 THEN min(n_name) END AS n_name FROM (SELECT s_suppkey, s_nationkey AS k FROM supplier UNION SELECT s_suppkey, (s_nationkey + s_suppkey % 2) % 25 FROM supplier) JOIN nation ON n_nationkey = k GROUP BY s_suppkey""")
def unique_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value by any of several names; two different hits leave it unresolved."""
    s = table(spark, sf_dir, "supplier")
    names = s.select("s_suppkey", F.concat(F.lit(" N "), "s_nationkey").alias("name")).union(s.select("s_suppkey", F.concat(F.lit("n  "), ((F.col("s_nationkey") + F.col("s_suppkey") % 2) % 25))))
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("n "), "n_nationkey").alias("code"), "n_name")
    return E.unique_match(names, "s_suppkey", "name", nation, "code", "n_name")
