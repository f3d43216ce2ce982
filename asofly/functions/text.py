"""Text functions over names, reasons, quotes and answers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from asofly.functions import vocab as V


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def contains_any(text: Column, phrases) -> Column:
    """Whether any of the phrases is in the text."""
    return any_of([F.contains(text, F.lit(p)) for p in phrases])


def first_matching(cases: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """Ordered rules in one ``when`` chain: the first that holds decides."""
    (test, value), *rest = cases
    chain = reduce(lambda c, x: c.when(x[0], x[1]), rest, F.when(test, value))
    return chain if otherwise is None else chain.otherwise(otherwise)


def normalise(name: Column | str) -> Column:
    """trimmed, lower case, white space collapsed."""
    return F.lower(F.trim(F.regexp_replace(col(name), r"\s+", " ")))


def match_pattern(name: Column | str) -> Column:
    """struct(strength, term) of the first suffix in the name, else of the first literal as a whole word, else null."""
    low = F.lower(col(name))
    made = lambda kind, term: F.struct(F.lit(kind).alias("strength"), F.lit(term).alias("term"))
    suffix = [(F.contains(low, F.lit(t)), made("suffix", t)) for t in V.SUFFIX_CHEMOTYPES]
    return first_matching(suffix + [(low.rlike(rf"\b{re.escape(t)}\b"), made("literal", t)) for t in V.LITERAL_TERMS])


def looks_like_dev_code(name: Column | str) -> Column:
    """a development code, also after a formulation ("... for injection") is taken off."""
    n = F.trim(col(name))
    return n.rlike(V.DEV_CODE) | F.regexp_replace(n, V.FORMULATION, "").rlike(V.DEV_CODE)


def is_denylisted(name: Column | str, denylist=V.DENYLIST) -> Column:
    """an exact listed name, also after one trailing parenthesis is taken off."""
    n = F.lower(F.trim(col(name)))
    return n.isin(*denylist) | F.trim(F.regexp_replace(n, r"\s*\([^)]*\)\s*$", "")).isin(*denylist)


def suffixes_in(name: Column | str) -> Column:
    """the payload suffixes that a name holds."""
    low = F.lower(col(name))
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in V.SUFFIX_CHEMOTYPES]))


def parts_of(name: Column | str) -> Column:
    """Parts of a name that lists several compounds (``a + b``, ``a/b``, ``a and b``)."""
    return F.filter(F.split(normalise(name), r"\s*(?:\+|/|,|;|\band\b|\bwith\b|\bplus\b)\s*"), lambda x: x != "")


def looks_specific(name: Column) -> Column:
    """names one compound: a suffix or a development code."""
    low = F.lower(name)
    return contains_any(low, V.SUFFIX_CHEMOTYPES) | looks_like_dev_code(name)


def names_many_compounds(name: Column | str) -> Column:
    """two or more of a name's parts are specific, so it can't stand for one entity."""
    return F.size(F.filter(parts_of(name), looks_specific)) >= 2


def is_untrusted_key(name: Column | str) -> Column:
    """a normalised name that must not join entities: too short, generic, denylisted, or several compounds."""
    n = normalise(name)
    return (F.length(n) < 4) | n.isin(*V.LITERAL_TERMS) | is_denylisted(n) | names_many_compounds(n)


def payload_class(names: Column) -> Column:
    """payload class of the first of several names with a suffix; ``undisclosed`` without one."""
    table = F.create_map(*[F.lit(x) for kv in V.SUFFIX_CHEMOTYPES.items() for x in kv])
    hit = F.get(F.filter(F.transform(names, lambda n: F.get(suffixes_in(n), F.lit(0))), lambda t: t.isNotNull()), F.lit(0))
    return F.coalesce(F.try_element_at(table, hit), F.lit("undisclosed"))


def stem_target(names: Column) -> Column:
    """target named by an antibody stem in the first name that has one."""
    one = lambda n: first_matching([(F.contains(F.lower(n), F.lit(s)), F.lit(t)) for s, t in V.STEM_TARGETS.items()])
    return F.get(F.filter(F.transform(names, one), lambda t: t.isNotNull()), F.lit(0))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body has it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sure_part(alias: str) -> str:
    """The longest piece that every match of an alias has once hyphens are taken out of it."""
    return max(re.split(r"\(\?[:!][^)]*\)\??|\\.[*?]?|\[[^]]*\][*?]?|.\?", alias.replace("-?", "")), key=len)


def folded(text: Column) -> Column:
    """A text without hyphens and in the case in which ``(?iu)`` compares; three letters have a lower case of their own or none."""
    return F.replace(F.lower(reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), (("\u017f", "s"), ("\u0131", "i"), ("\u0130", "i")), text)), F.lit("-"), F.lit(""))


def digit_keys(parts: Iterable[str]) -> dict[str, str]:
    """For each part with a digit behind a letter its first such digit and up to four letters before it; the shorter of two keys of which one ends in the other."""
    own = {p: m[0] for p in parts if (m := re.search(r"[a-z]{1,4}[0-9]", p))}
    return {p: min((k for k in own.values() if mine.endswith(k)), key=len) for p, mine in own.items()}


def targets_in(text: Column) -> Column:
    """all targets that an alias of theirs names in a text.

    One pass finds the digits behind letters that any alias has; an expression is only tried on a text with its key and its sure part.
    """
    keys = digit_keys(sure_part(a) for aliases in V.TARGET_ALIASES.values() for a in aliases)
    behind = f"[a-z][0-9](?<=({'|'.join(sorted(set(keys.values())))}))"

    def named(t: Column, low: Column, seen: Column, aliases) -> Column:
        by_part = {p: any_of([t.rlike(f"(?iu){a}") for a in aliases if sure_part(a) == p]) for p in map(sure_part, aliases)}
        return any_of([(F.array_contains(seen, keys[p]) if p in keys else F.lit(True)) & F.contains(low, F.lit(p)) & hit for p, hit in by_part.items()])

    search = lambda t, low, seen: F.array_compact(F.array(*[F.when(named(t, low, seen, aliases), F.lit(x)) for x, aliases in V.TARGET_ALIASES.items()]))
    return bound(text, lambda t: bound(folded(t), lambda low: bound(F.array_distinct(F.regexp_extract_all(low, F.lit(behind), F.lit(1))), lambda seen: search(t, low, seen))))


def only(values: Column) -> Column:
    """The one distinct value of an array; null if there are none or several: ambiguous is unresolved."""
    return bound(F.array_distinct(values), lambda distinct: F.when(F.size(distinct) == 1, F.get(distinct, F.lit(0))))


def strict_majority(values: Column) -> Column:
    """The value with at least two votes and more than all others together."""
    counts = F.transform(F.array_distinct(values), lambda v: F.struct(F.size(F.filter(values, lambda x: x == v)).alias("n"), v.alias("v")))
    top = F.array_max(counts)
    return F.when((top["n"] >= 2) & (2 * top["n"] > F.size(values)), top["v"])


def resolve_target(names: Column, snippets: Column) -> Column:
    """struct(target, source) by stem, then a text's only target, then a name's, then the snippets' strict majority.

    Texts are searched once, and only for names without a stem.
    """
    none = F.array().cast("array<string>")
    made = lambda c, s: F.struct(c.alias("target"), F.lit(s).alias("source"))
    either = lambda c, s, rest: bound(c, lambda x: F.when(x.isNotNull(), made(x, s)).otherwise(rest))
    in_name = only(F.flatten(F.transform(names, targets_in)))

    def by_texts(found: Column) -> Column:
        vote = either(strict_majority(F.flatten(F.transform(found, F.array_distinct))), "trial_text_majority", made(F.lit(None).cast("string"), "unresolved"))
        return either(only(F.flatten(found)), "trial_text", either(in_name, "name", vote))

    return either(stem_target(names), "stem", bound(F.transform(F.coalesce(snippets, none), targets_in), by_texts))


def is_vague(reason: Column | str) -> Column:
    """No reason, one under 15 characters, or a stock phrase in a text under 80."""
    r = col(reason)
    return r.isNull() | (F.length(F.trim(r)) < V.VAGUE_MIN) | (contains_any(F.lower(r), V.VAGUE_PHRASES) & (F.length(r) < V.VAGUE_MAX))


def stated_reason(reason: Column | str) -> Column:
    """class of a stated stop reason by its first keyword group; null if it is too short to say anything."""
    r = col(reason)
    low = F.lower(r)
    groups = [(contains_any(low, words), F.lit(name)) for name, words in V.STATED_REASONS.items()]
    return F.when(F.length(F.trim(r)) >= V.VAGUE_MIN, first_matching(groups, F.lit("unknown_silent")))


def unescape_html(text: Column | str) -> Column:
    """The six basic character references; ``&amp;`` last, so nothing is unescaped twice."""
    pairs = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&amp;", "&"))
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, col(text))


def truncate_at_word(text: Column | str, n: int) -> Column:
    """at most ``n`` characters, not ending inside a word, no trailing white space (blank, tab, line and form feed, carriage return).

    The end is ``\\z``: ``$`` also matches before a line end, so that a cut right behind a line lost its last word.
    """
    t = col(text)
    cut = F.substring(t, 1, n)
    space, word = r"[ \t\n\f\r]", r"[^ \t\n\f\r]"
    inside = F.substring(t, n + 1, 1).rlike(r"^[\p{L}\p{N}]") & cut.rlike(r"[\p{L}\p{N}]\z")
    shorter = F.when(cut.rlike(rf"{word}{space}+{word}+\z"), F.regexp_replace(cut, rf"{space}+{word}+\z", "")).otherwise(cut)
    return F.when((F.length(t) <= n) | F.lit(n <= 0), t).otherwise(F.regexp_replace(F.when(inside, shorter).otherwise(cut), rf"{space}+\z", ""))


def name_tokens(names: Column) -> Column:
    """names and their parts of four characters or with a digit, each once (case ignored)."""
    pieces = F.flatten(F.transform(names, lambda n: F.concat(F.array(F.trim(n)), F.transform(F.split(n, "[/,;]"), lambda p: F.trim(p)))))
    good = F.filter(pieces, lambda p: (p != "") & ((F.length(p) >= 4) | p.rlike(r"\d")))
    return F.array_distinct(F.transform(good, F.lower))


def mentions(snippet: Column | str, names: Column) -> Column:
    """whether a snippet names the candidate by one of its tokens."""
    low = F.lower(col(snippet))
    return F.coalesce(F.exists(name_tokens(names), lambda t: F.contains(low, t)), F.lit(False))


def _blank(q: Column) -> Column:
    return q.isNull() | (F.trim(q) == "")


def grounds_yes(quote: Column | str) -> Column:
    """the quote states a conjugate modality, a payload or a linker."""
    q = col(quote)
    return ~_blank(q) & contains_any(F.lower(q), (*V.LITERAL_TERMS, *V.SUFFIX_CHEMOTYPES, *V.PAYLOAD_WORDS))


def grounds_no(quote: Column | str) -> Column:
    """the quote states an oral route, denies the modality, or states another one."""
    q = col(quote)
    conjugate, negated = q.rlike(V.CONJUGATE_WORDS), q.rlike(r"(?i)\bnot\b")
    cases = [
        (_blank(q), F.lit(False)),
        (q.rlike(V.NO_ROUTE) | q.rlike(r"(?i)\bnot an?\s+(adc|antibody[- ]drug)\b"), F.lit(True)),
        (q.rlike(V.NO_MODALITY), ~conjugate | negated),
        (q.rlike(r"(?i)\bantibod(?:y|ies)\b") & ~conjugate, F.lit(True)),
    ]
    return first_matching(cases, F.lit(False))


def apply_grounding(answer: Column, from_recall: Column, quote: Column) -> Column:
    """struct(from_recall, forced): a yes or no without a probative quote counts as recalled."""
    ok = F.when(answer == "yes", grounds_yes(quote)).otherwise(grounds_no(quote))
    forced = ~from_recall & answer.isin("yes", "no") & ~ok
    return F.struct((from_recall | forced).alias("from_recall"), forced.alias("forced"))


def evidence_source(from_recall: Column, quote: Column) -> Column:
    """recall, text, or no usable evidence."""
    return F.when(from_recall, "recall").when(~_blank(quote), "text").otherwise("no_usable_evidence")


def confidence_label(disagreement: Column, votes: Column) -> Column:
    """unanimous, or escalated and resolved by a single most frequent vote, or split."""
    counts = F.reverse(F.sort_array(F.transform(F.array_distinct(votes), lambda v: F.size(F.filter(votes, lambda x: x == v)))))
    resolved = (F.size(counts) == 1) | (F.get(counts, F.lit(0)) > F.coalesce(F.get(counts, F.lit(1)), F.lit(0)))
    return F.when(~disagreement, "unanimous").when((F.size(votes) > 0) & resolved, "escalated-and-resolved").otherwise("escalated-and-split")


def verify_quote(quote: Column | str, source: Column | str) -> Column:
    """the quote, white space collapsed, is in the source, white space collapsed; a blank quote is never verified."""
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    q = flat(col(quote))
    return F.coalesce((q != "") & F.contains(flat(col(source)), q), F.lit(False))


def extract_json(text: Column | str, schema: str, array: bool = False) -> Column:
    """the outermost object or array in a text around it, by schema; null if there is none."""
    pattern = r"(?s)\[.*\]" if array else r"(?s)\{.*\}"
    found = F.regexp_extract(col(text), pattern, 0)
    return F.when(found != "", F.from_json(found, schema))


def name_matches(name: Column | str, patterns: list[str]) -> Column:
    """the patterns in a name: whole words where they begin and end in a letter or digit, else anywhere."""
    low = F.lower(col(name))

    def test(p: str) -> Column:
        word = p[:1].isalnum() and p[-1:].isalnum()
        return low.rlike(rf"\b{re.escape(p.lower())}\b") if word else F.contains(low, F.lit(p.lower()))

    return F.array_compact(F.array(*[F.when(test(p), F.lit(p)) for p in patterns]))


def estimate_tokens(text: Column | str) -> Column:
    """a quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(col(text)) / 4))


def custom_id(key: Column | str, prefix: str = "p") -> Column:
    """a stable identifier of bounded length."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(col(key), 256), 1, 32))


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """struct(low, high) of the score interval of a share, clamped to [0, 1]; null without observations."""
    p, m = F.try_divide(k, n), n.cast("double")
    centre, base = p + z * z / (2 * m), 1 + z * z / m
    half = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))
    return F.when(n > 0, F.struct(F.greatest(F.lit(0.0), (centre - half) / base).alias("low"), F.least(F.lit(1.0), (centre + half) / base).alias("high")))
