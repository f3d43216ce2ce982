"""Quality rules: a table of thresholds compiled into one projection, without user functions.

The measures of a text come from array functions over its words and lines; each
rule of the table is a bound on a ratio of two measures.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the base rule: white space that separates words, symbols, window of repeated words.
SPACES = "\\x20\\x09-\\x0D"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
MIN_WORDS = 10
REPEATED_PERCENT = 20

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that it for on with as are be this by at from or an "
    "le la les de des du et un une en que qui est dans pour pas sur au "
    "der die das und ist nicht ein eine den von zu mit sich auf dem "
    "el los las y que del se por con una para es no"
).split()


@dataclass(frozen=True)
class Rule:
    """100 * numerator must lie within [low, high] percent of the denominator; None leaves a side open."""

    name: str
    numerator: str
    denominator: str
    low: int | None = None
    high: int | None = None


#: Thresholds in percent. The word-length bounds are the published ones for web text, widened for compounds.
RULES = (
    Rule("word_length", "word_chars", "n_words", low=200, high=1200),
    Rule("symbols", "n_symbols", "n_words", high=10),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=50),
    Rule("stop_words", "n_stop_words", "n_words", low=1),
)


def _window_hash(*words: Column) -> Column:
    return F.xxhash64(*words)


def _covered(words: Column, windows: Column) -> Column:
    """Words that lie in a window found twice or more.

    Windows are sorted by hash, then their words, then place: equal windows are
    neighbours even where other windows have their hash. A window starting at
    ``p`` newly covers ``min(WINDOW, p - previous start)`` words.
    """
    # element by element: slice() would copy the whole array for each window
    window = lambda i: F.array(*[F.get(words, i + k) for k in range(WINDOW)])
    order = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), window(i).alias("w"), i.alias("i"))))

    def same(a: Column, b: Column) -> Column:
        return (a["h"] == b["h"]) & (a["w"] == b["w"])

    def twice(order: Column) -> Column:
        last = F.size(order) - 1
        hit = F.transform(
            order,
            lambda w, k: F.when(
                ((k > 0) & same(w, F.get(order, k - 1))) | ((k < last) & same(w, F.get(order, k + 1))),
                w["i"],
            ),
        )
        return F.sort_array(F.array_compact(hit))

    def cover(starts: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("at"))
        return F.aggregate(starts, start, lambda s, p: F.struct((s["n"] + F.least(F.lit(WINDOW), p - s["at"])).alias("n"), p.alias("at")), lambda s: s["n"])

    # let: name a value once, so that it is computed once
    def let(value: Column, then) -> Column:
        return F.transform(F.array(value), then)[0]

    return let(order, lambda o: cover(twice(o)))


def measures(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and the measures of each text: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_stop_words, n_repeat_words."""
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(
        F.col(key).alias(key),
        body.alias("_text"),
        F.filter(F.split(body, f"[{SPACES}]+"), lambda w: w != "").alias("_words"),
        F.filter(F.split(body, "\n"), lambda x: x.rlike(f"[^{SPACES}]")).alias("_lines"),
    )
    stop = sorted({*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)})
    starts = F.sequence(F.lit(0), F.size("_words") - WINDOW)
    windows = F.when(
        F.size("_words") >= WINDOW,
        F.transform(starts, lambda i: _window_hash(*[F.get(F.col("_words"), i + k) for k in range(WINDOW)])),
    )
    counted = base.select(
        key,
        "_words",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_words", lambda w: w.isin(stop))).cast("long").alias("n_stop_words"),
        windows.alias("_windows"),
    )
    distinct = F.size(F.array_distinct("_windows")) == F.size("_windows")
    repeated = F.when(F.col("_windows").isNull() | distinct, F.lit(0).cast("long")).otherwise(_covered(F.col("_words"), F.col("_windows")))
    # A filter on a measure must not be pushed below this projection: the optimiser would put the word arrays'
    # expressions into it, and evaluate them for each element. It stops at expressions that aren't deterministic.
    kept_apart = F.when(F.monotonically_increasing_id() >= 0, repeated)
    return counted.withColumn("n_repeat_words", kept_apart).drop("_words", "_windows")


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """One boolean column: true where a rule of the table is broken. Bounds are compared as integers."""
    broken: Column = F.lit(False)
    for r in rules:
        share, whole = 100 * F.col(r.numerator), F.col(r.denominator)
        if r.low is not None:
            broken = broken | (share < r.low * whole)
        if r.high is not None:
            broken = broken | (share > r.high * whole)
    return broken


def quality_rules(docs: DataFrame, text: str = "text", key: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept for every row.

    Null and empty texts have no words and fail the base rule; texts are measured whole,
    however long. Repeated rows give repeated results, null keys stay null, and other
    columns are not read; an empty table gives no rows.
    """
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    return measures(docs, text, key).select(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~compile_rules(rules)).alias("kept")
    )


def keep_good(docs: DataFrame, text: str = "text", key: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that the rules keep, with all their columns, in one projection and no shuffle.

    Null and empty texts go; each row is judged by its own whole text, whatever its key,
    so repeated rows and null keys stay or go alike. An empty table gives no rows.
    """
    row = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col(text).alias("_body"))
    names = docs.columns
    return _with_verdict(row, rules).where("kept").select(*[F.col("_row")[n].alias(n) for n in names])


def _with_verdict(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    return quality_rules(rows, "_body", "_row", rules)
