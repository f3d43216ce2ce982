"""The thin contract queries over the operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from asofly.llm import html_text, quality, secrets
from asofly.llm.bpe_trie import bpe_round_trip
from asofly.llm.divergence import MIN_DOCS, TOP_TERMS, divergence
from asofly.llm.exact_dedup import exact_dedup
from asofly.llm.packing import pack_documents
from asofly.llm.ranked_search import ranked_search
from asofly.llm.simhash import near_duplicates
from asofly.llm.token_counts import token_counts
from asofly.llm.token_files import token_files
from asofly.llm.toxicity import toxicity
from asofly.llm.vocab import PIECE_BPE, WORD_BPE, tokenizer_path
from asofly.llm.warc import warc_round_trip


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), tokenizer_path(WORD_BPE))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), tokenizer_path(PIECE_BPE))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(documents(spark, sf_dir), tokenizer_path(WORD_BPE))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(pages(spark, sf_dir))


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(documents(spark, sf_dir), tokenizer_path(WORD_BPE))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(pages(spark, sf_dir), layout=html_text.EXACT)


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(documents(spark, sf_dir))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(documents(spark, sf_dir))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = [
        op1_best_fit_packing, op2_token_counts, op3_exact_dedup, op4_simhash, op5_token_files, op6_quality_rules, op7_warc, op8_bpe_round_trip, op9_html_extraction, op10_secret_scans,
        op11_source_divergence, op12_ranked_search, op13_toxicity,
    ]
    return {f.__name__: f for f in made}


OP3_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY body) AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY body) AS kept,
       sha256(body) AS text_sha256
FROM t
"""

_STOP = ", ".join(f"'{w}'" for w in sorted({*quality.STOP_WORDS, *(w.capitalize() for w in quality.STOP_WORDS)}))


def _broken(r: quality.Rule) -> list[str]:
    low = [f"100 * {r.numerator} < {r.low} * {r.denominator}"] if r.low is not None else []
    return low + ([f"100 * {r.numerator} > {r.high} * {r.denominator}"] if r.high is not None else [])


OP6_SQL = f"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS body,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM documents
), g AS (
  SELECT doc_id, i, ws[i : i + 4] AS five FROM w, unnest(range(1, len(ws) - 3)) AS u(i)
), r AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS times FROM g), range(0, 5) AS o(k)
  WHERE times > 1 GROUP BY doc_id
), m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(len(list_filter(ws, lambda x: x IN ({_STOP}))) AS BIGINT) AS n_stop_words,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
         AND NOT ({" OR ".join(b for r in quality.RULES for b in _broken(r))}) AS kept
FROM m
"""


def _rule_sql(rank: int, r: secrets.Rule) -> str:
    pattern = r.pattern.replace("'", "''")
    return f"""
  SELECT doc_id, '{r.kind}' AS kind, {rank} AS rk, {r.least} AS least, string_split_regex(body, '{pattern}') AS gaps,
         regexp_extract_all(body, '{pattern}', 0) AS ms, regexp_extract_all(body, '{pattern}', {r.group}) AS gs
  FROM b WHERE regexp_matches(body, '{pattern}')"""


OP10_SQL = f"""
WITH b AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
m AS ({" UNION ALL ".join(_rule_sql(i, r) for i, r in enumerate(secrets.RULES))}
), u AS (
  SELECT doc_id, kind, rk, least, length(gs[i]) AS counted, length(ms[i]) AS size,
         list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s
  FROM m, unnest(range(1, len(ms) + 1)) AS t(i)
), v AS (
  SELECT doc_id, kind, rk, CAST(s AS BIGINT) AS s, kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + size AS BIGINT) AS span FROM u WHERE counted >= least
), g AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
         count(*) FILTER (WHERE kind = 'hex') AS n_hex,
         string_agg(span, ',' ORDER BY s, rk) FILTER (WHERE rk < 3) AS base, string_agg(span, ',' ORDER BY s, rk) AS spans
  FROM v GROUP BY doc_id
)
SELECT b.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM b LEFT JOIN g ON b.doc_id = g.doc_id
"""


OP7_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
w AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM w
"""


_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _share(n: str, total: str) -> str:
    return f"CASE WHEN v > 0 THEN 1 + CAST(1000000000 AS HUGEINT) * ({n} + 5) // ({total} + 5 * v) ELSE 0 END"


OP11_SQL = f"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_ASCII_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), c AS (
  SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS term FROM d) GROUP BY ALL
), kept AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM d) GROUP BY ALL HAVING count(*) >= {MIN_DOCS}
), v AS (
  SELECT lang, count(term) AS v FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY lang
), k AS (
  SELECT c.*, sum(n) OVER (PARTITION BY lang, term) AS lang_n FROM c JOIN kept USING (lang, term)
), s AS (
  SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN k USING (lang, source) GROUP BY ALL
), g AS (
  SELECT s.*, v, sum(total) OVER (PARTITION BY lang) AS lang_total FROM s JOIN v USING (lang)
), dense AS (
  SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n, {_share("coalesce(n, 0)", "total")} AS p FROM g JOIN kept USING (lang) LEFT JOIN k USING (lang, source, term)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), over_used AS (
  SELECT k.lang, k.source, k.term AS item, {_share("k.n", "total")} - ({_share("lang_n", "lang_total")}) AS value FROM k JOIN g USING (lang, source)
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', item, value FROM over_used WHERE value > 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS place FROM r
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(place AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR place <= {TOP_TERMS}
"""

OP12_SQL = f"""
WITH t AS (
  SELECT doc_id, regexp_extract_all({_ASCII_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), s AS (
  SELECT count(*) FILTER (WHERE len(terms) > 0) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM t
), b AS (
  SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, unnest(regexp_extract_all({_ASCII_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL
), f AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM t) WHERE term IN (SELECT term FROM b) GROUP BY ALL
), w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM f, s GROUP BY term, n_docs
), p AS (
  SELECT doc_id, term, w * (1000000000 * tf // (1000 * tf + 8 * (25 + 75 * n * n_docs // n_terms))) AS points FROM f JOIN w USING (term), s
), r AS (
  SELECT item_id, doc_id, CAST(sum(repeats * points) AS BIGINT) AS score FROM b JOIN p USING (term) GROUP BY ALL HAVING sum(repeats * points) > 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM r
)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM o WHERE place <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_dedup": OP3_SQL, "op6_quality_rules": OP6_SQL, "op7_warc": OP7_SQL, "op10_secret_scans": OP10_SQL, "op11_source_divergence": OP11_SQL, "op12_ranked_search": OP12_SQL,
    }
