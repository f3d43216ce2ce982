"""Secret scans with a trigram inverted index, in DataFrame operations only.

Each rule's regular expression is compiled into a Boolean query over trigrams that
every match must contain (compared in lower case). The index holds a posting
(trigram, document) for each trigram of the queries that a document has. Postings
are intersected and united per rule to candidates, and only candidates are matched
against the expression. A rule whose expression has no mandatory trigram scans all.
"""

from __future__ import annotations

import re._parser as sre
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofly.llm.common import fresh, probe
from asofly.session import materialize, scratch_scope

# ---------------------------------------------------------------- rules


@dataclass(frozen=True)
class Rule:
    """A kind of secret: expression (Java and RE2 syntax), the group whose length counts, its least length."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def either_case(word: str) -> str:
    """A pattern for an ASCII word in either case, the same in every engine."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


# The three base kinds.
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = "(" + "|".join(either_case(k) for k in KEYWORDS) + ")[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
BASE_RULES = (
    Rule("assign", ASSIGN, 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]+", 0, 24),
)

#: Further well-known credential formats.
MORE_RULES = (
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", "gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", "eyJ[A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}"),
    Rule("url_login", "[a-z]{2,10}://[A-Za-z0-9._-]+:[A-Za-z0-9._-]{6,}@"),
)
RULES = BASE_RULES + MORE_RULES

# ------------------------------------------- trigram queries of expressions

#: A query in disjunctive form: a match contains all trigrams of one of the sets. None: no condition.
Query = frozenset[frozenset[str]] | None

#: Alternative strings kept for an expression part, and longest such string, before it is reduced to trigrams.
MAX_STRINGS, MAX_LENGTH = 64, 16

#: Trigrams noted in one word of a document's mask.
WORD_BITS = 62


@dataclass(frozen=True)
class _Part:
    """What is known of a part's matches: all of them (lower case), if few enough, and a query."""

    strings: frozenset[str] | None
    query: Query


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _of_strings(strings: frozenset[str] | None) -> Query:
    """Every match holds one of the strings: an alternative without trigrams leaves no condition."""
    if strings is None or any(len(s) < 3 for s in strings):
        return None
    return _reduced(frozenset(_trigrams(s) for s in strings))


def _reduced(query: frozenset[frozenset[str]]) -> Query:
    """Leave out alternatives that another, weaker one covers."""
    return frozenset(a for a in query if not any(b < a for b in query))


def _both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    if len(a) * len(b) > MAX_STRINGS:
        return a if len(a) <= len(b) else b
    return _reduced(frozenset(x | y for x, y in product(a, b)))


def _either(a: Query, b: Query) -> Query:
    return None if a is None or b is None else _reduced(a | b)


def _join(parts: Iterable[_Part]) -> _Part:
    """Parts in a row: strings are multiplied out while they stay few, and give trigrams where that ends."""
    query: Query = None
    run: frozenset[str] | None = frozenset([""])
    exact = True
    for p in parts:
        query = _both(query, p.query)
        longer = None if run is None or p.strings is None else frozenset(a + b for a, b in product(run, p.strings))
        if longer is not None and len(longer) <= MAX_STRINGS and all(len(s) <= MAX_LENGTH for s in longer):
            run = longer
            continue
        exact = False
        query = _both(query, _of_strings(run))
        run = p.strings if p.strings is not None else frozenset([""])
    query = _both(query, _of_strings(run))
    return _Part(run if exact else None, query)


def _walk(tree) -> _Part:
    return _join(_node(op, arg) for op, arg in tree)


def _node(op, arg) -> _Part:
    name = str(op)
    if name == "LITERAL":
        return _Part(frozenset([chr(arg).lower()]), None)
    if name == "IN":
        chars: set[str] = set()
        for kind, value in arg:
            if str(kind) == "LITERAL":
                chars.add(chr(value).lower())
            elif str(kind) == "RANGE" and value[1] - value[0] < 4:
                chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return _Part(None, None)
        return _Part(frozenset(chars) if len(chars) <= 4 else None, None)
    if name == "SUBPATTERN":
        return _walk(arg[-1])
    if name == "BRANCH":
        parts = [_walk(branch) for branch in arg[1]]
        strings = None if any(p.strings is None for p in parts) else frozenset().union(*(p.strings for p in parts))
        return _Part(strings if strings is not None and len(strings) <= MAX_STRINGS else None, reduce(_either, (_either(p.query, p.query) for p in parts)))
    if name in ("MAX_REPEAT", "MIN_REPEAT"):
        low, high, inner = arg
        part = _walk(inner)
        if low == 0:
            return _Part(part.strings | {""} if high == 1 and part.strings is not None else None, None)
        if low == high and low <= 3:
            return _join([part] * low)
        return _Part(None, part.query)
    if name == "AT":
        return _Part(frozenset([""]), None)
    return _Part(None, None)


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query of an expression: alternatives of sets of lower-case trigrams, or None."""
    part = _walk(sre.parse(pattern))
    return _both(part.query, _of_strings(part.strings))


# ------------------------------------------------------------------ index


def postings(docs: DataFrame, trigrams: list[str], text: Column, key: str) -> DataFrame:
    """The inverted index: (trigram number, key) for each of the trigrams that a document has."""
    low = F.lower(text)
    present = F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)]))
    return docs.select(F.col(key).alias("key"), low.alias("_low")).select("key", F.explode(present).alias("trigram"))


def candidates(index: DataFrame, trigrams: list[str], queries: dict[str, Query]) -> DataFrame:
    """(key, kinds): documents that fulfil some rule's query, with the rules' kinds.

    The postings of a document are united into the set of its trigrams (a bit each, in
    as many words as there are trigrams for), which intersects the posting lists of every
    alternative in one pass.
    """
    number = {t: i for i, t in enumerate(trigrams)}
    words = range(-(-len(trigrams) // WORD_BITS))
    masks = index.groupBy("key").agg(*[F.bit_or(F.when(F.expr(f"trigram div {WORD_BITS} = {w}"), F.expr(f"shiftleft(1L, trigram % {WORD_BITS})")).otherwise(F.lit(0).cast("long"))).alias(f"mask{w}") for w in words])

    def holds(alternative: frozenset[str]) -> Column:
        need = [sum(1 << number[t] % WORD_BITS for t in alternative if number[t] // WORD_BITS == w) for w in words]
        return reduce(lambda a, b: a & b, (F.col(f"mask{w}").bitwiseAND(F.lit(m).cast("long")) == m for w, m in enumerate(need) if m))

    def fulfils(query: Query) -> Column:
        return reduce(lambda a, b: a | b, (holds(x) for x in sorted(query, key=sorted)))

    kinds = F.array_compact(F.array(*[F.when(fulfils(q), F.lit(kind)) for kind, q in queries.items()]))
    return masks.select("key", kinds.alias("kinds")).where(F.size("kinds") > 0)


# ------------------------------------------------------------ verification

#: Elements of an array that are scanned at once; see ``running``.
SCAN_BLOCK = 256


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once."""
    return F.transform(F.array(value), then)[0]


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """What ``op`` makes of the elements of an integer array up to each one.

    Appending to an array copies it, so a scan is made in blocks: within each block,
    over the blocks' last values, and both put together. Empty stays empty.
    """

    def scan(xs: Column) -> Column:
        none = F.array().cast("array<int>")
        return F.aggregate(xs, none, lambda out, x: F.array_append(out, F.when(F.size(out) > 0, op(F.element_at(out, -1), x)).otherwise(x)))

    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(values) - 1) / SCAN_BLOCK).cast("int"))), lambda b: scan(F.slice(values, b * SCAN_BLOCK + 1, SCAN_BLOCK)))

    def put(blocks: Column) -> Column:
        lasts = scan(F.transform(blocks, lambda b: F.element_at(b, -1)))
        return let(lasts, lambda lasts: F.flatten(F.transform(blocks, lambda b, i: F.when(i == 0, b).otherwise(F.transform(b, lambda x: op(F.get(lasts, i - 1), x))))))

    return F.when(F.size(values) > 0, let(blocks, put)).otherwise(F.array().cast("array<int>"))


def _found(text: Column, rule: Rule) -> Column:
    """Spans (kind, start, end) of a rule's matches, leftmost first and non-overlapping, the too short ones dropped.

    The text between matches and the matches themselves alternate; running sums of
    their lengths (code points) are the places.
    """
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    sizes = F.arrays_zip(
        F.transform(F.slice(F.split(text, rule.pattern), F.lit(1), F.size(whole)), F.length).alias("gap"), F.transform(whole, F.length).alias("match"), F.transform(counted, F.length).alias("counted")
    )

    def spans(rows: Column) -> Column:
        ends = running(F.transform(rows, lambda r: r["gap"] + r["match"]), lambda a, b: a + b)
        at = lambda ends: F.transform(rows, lambda r, i: F.when(r["counted"] >= rule.least, F.struct(F.lit(rule.kind).alias("kind"), (F.get(ends, i) - r["match"]).alias("start"), F.get(ends, i).alias("end"))))
        return F.array_compact(let(ends, at))

    return let(sizes, spans)


def _tight(rule: Rule) -> Rule:
    """The same matches from a stricter expression: a run of one class is maximal, so its least length can stand in it."""
    if not rule.group and rule.least > 1 and rule.pattern.startswith("[") and rule.pattern.endswith("]+") and rule.pattern.count("[") == 1:
        return Rule(rule.kind, f"{rule.pattern[:-1]}{{{rule.least},}}", 0, rule.least)
    return rule


def identity(text: str, key: str) -> Column:
    """What a row is known by in the index: its key and its text's XXH64, so that null and repeated keys are told apart."""
    return F.struct(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("hash"))


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, spans): the spans of all rules, for the documents that have any; sorted by start, then the rules' order.

    ``key`` of the result is the row's ``identity``. The result is a written table.
    """
    docs = docs.select(identity(text, key).alias("key"), F.col(text).alias("body"))
    body = F.col("body")
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    trigrams = sorted({t for q in queries.values() for a in q for t in a})
    order = {r.kind: i for i, r in enumerate(rules)}
    parts = []
    with scratch_scope(docs.sparkSession):
        if queries:
            index = materialize(postings(docs, trigrams, body, "key"), "postings")
            wanted = materialize(candidates(index, trigrams, queries), "candidates")
            # Only rows that pass a filter, sized by a count, carry their text into the join.
            near, _ = probe(docs, F.col("key"), wanted, "key")
            matched = near.join(wanted, "key")
            verified = F.concat(*[F.when(F.array_contains("kinds", r.kind), _found(F.col("body"), r)).otherwise(_none()) for r in rules if r.kind in queries])
            parts.append(matched.select("key", verified.alias("spans")))
        for rule in (_tight(r) for r in rules if r.kind not in queries):
            full = docs.where(body.rlike(rule.pattern)).select("key", _found(body, rule).alias("spans"))
            parts.append(full)
        spans = reduce(lambda a, b: a.unionByName(b), parts).where(F.size("spans") > 0)
        ranked = F.transform(F.flatten(F.collect_set("spans")), lambda s: F.struct(s["start"].alias("start"), _rank(order, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
        return materialize(spans.groupBy("key").agg(F.sort_array(F.array_distinct(ranked)).alias("spans")), "spans", keep=True)


def _none() -> Column:
    return F.array().cast("array<struct<kind:string,start:int,end:int>>")


def _rank(order: dict[str, int], kind: Column) -> Column:
    return reduce(lambda c, item: c.when(kind == item[0], F.lit(item[1])), order.items(), F).otherwise(F.lit(len(order)))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame, text: str = "text", key: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """key, n_assign, n_access, n_hex, base_sha256, spans for every row.

    Spans are ``kind:start:end`` (code points, end exclusive), by start and then the
    rules' order, comma-joined; base_sha256 is the digest of the base kinds' spans.
    Null texts count as empty, and texts are searched whole, however long. Every row is
    answered for its own text, also where its key is null or repeats. Other columns are
    not read; an empty table gives no rows.
    """
    found = scan(docs, text, key, rules)
    rows = docs.select(identity(text, key).alias("key"))
    maybe, sure = probe(rows, F.col("key"), found, "key")
    none = F.array().cast(found.schema["spans"].dataType)
    joined = maybe.join(found, "key", "left").select("key", F.coalesce("spans", none).alias("spans")).unionByName(sure.select("key", none.alias("spans")))
    base = [r.kind for r in BASE_RULES]

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return joined.select(
        F.col("key")["key"].cast("long").alias(key), *[count(k) for k in base], F.sha2(_joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans")
    )


def redacted(text: Column, spans: Column) -> Column:
    """The text with the spans, sorted by start, replaced by ``[kind]``; a span that begins within an earlier one is a part of it."""

    def cut(chars: Column, ends: Column) -> Column:
        piece = lambda a, n: F.array_join(F.slice(chars, a + 1, n), "")
        before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1))
        parts = F.transform(spans, lambda s, i: F.when(s["start"] >= before(i), F.concat(piece(before(i), s["start"] - before(i)), F.lit("["), s["kind"], F.lit("]"))).otherwise(F.lit("")))
        return F.concat(F.array_join(parts, ""), piece(F.element_at(ends, -1), F.size(chars)))

    furthest = running(F.transform(spans, lambda s: s["end"]), F.greatest)
    return let(F.split(text, ""), lambda chars: let(furthest, lambda ends: cut(chars, ends)))


def redact(docs: DataFrame, text: str = "text", key: str = "doc_id", n_chars: str = "n_chars", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents with every secret span replaced by ``[kind]``; overlapping spans are replaced as one.

    All columns and rows stay, and each row is searched itself, also where keys repeat
    or are null; null and empty texts stay as they are, and long texts are searched
    whole. ``n_chars``, where there is one, is the new length. Only rows that pass a filter
    of those with secrets are joined. An empty table gives no rows.
    """
    columns = docs.columns
    own, name, spans = fresh(docs, "_own", "_key", "_spans")
    found = scan(docs, text, key, rules)
    maybe, sure = probe(docs.withColumn(own, identity(text, key)), F.col(own), found, "key")
    joined = maybe.join(found.select(F.col("key").alias(name), F.col("spans").alias(spans)), F.col(own) == F.col(name), "left")
    clean = joined.withColumn(text, F.when(F.col(spans).isNull(), F.col(text)).otherwise(redacted(F.col(text), F.col(spans))))
    if n_chars in docs.columns:
        clean = clean.withColumn(n_chars, F.when(F.col(spans).isNull(), F.col(n_chars)).otherwise(F.length(text).cast(docs.schema[n_chars].dataType)))
    return sure.select(*columns).unionByName(clean.select(*columns))
