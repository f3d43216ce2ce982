"""Source divergence audit: how far the word use of each source lies from the others of its language.

The distance of two groups is the sum over all kept terms of the differences of their
smoothed shares. It is never summed term by term over pairs. With the shares p(t) of a
group and p0 for a term that it lacks, inclusion and exclusion over the supports give

    sum over A's support of |pA(t) - pB0|        (one-sided: priced from A's histogram of counts)
  + sum over B's support of |pA0 - pB(t)|        (the same, from B's histogram)
  + (V - |A| - |B|) * |pA0 - pB0|                (a constant for terms in neither)
  + sum over the overlap of the four differences' alternating sum (sparse join of postings)

A histogram has a row for each distinct share of a group, so it grows with the root of
the group's terms; running sums over it answer all the other groups of the language
at once. Only terms that both groups hold are met pairwise.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofly.llm.terms import LETTERS, rows_of, strings, terms_of, utf8
from asofly.session import materialize

# Fixed values of the audit: documents that a kept term is in, smoothing of a count, scale of a share.
MIN_DOCS, SMOOTHING, SCALE = 30, 5, 1_000_000_000
TOP_TERMS = 50
#: Distinct (group, term) entries that a task adds up before it hands them on; only saves shuffled rows.
HELD = 300_000

_COUNTS = "lang string, source string, term string, n long, docs long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    seen: set[tuple[str, str]] = set()

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in counts.items():
            if n:
                k = len(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(lang, k), pa.repeat(source, k), strings(list(n)), pa.array(n.values(), pa.int64()), pa.array(map(docs.__getitem__, n), pa.int64())],
                    names=["lang", "source", "term", "n", "docs"],
                )
        counts.clear()

    held = 0
    for lang, source, text in rows_of(batches):
        group = (lang, source)
        seen.add(group)
        n, docs = counts.setdefault(group, (Counter(), Counter()))
        before = len(n)
        words = terms_of(text, LETTERS)
        n.update(words)
        docs.update(set(words))
        held += len(n) - before
        if held > HELD:
            yield from flush()
            held = 0
    yield from flush()
    if seen:
        langs, sources = zip(*sorted(seen), strict=True)
        none = pa.array([0] * len(langs), pa.int64())
        # a space stands in no term: a group's own row is dealt like a term's
        yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array(sources), pa.array([f" {s}" for s in sources]), none, none], names=["lang", "source", "term", "n", "docs"])


def postings(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n, lang_n, first): occurrences of each kept term in each group that has it, and a row of null term for each group.

    ``lang_n`` is the term's count in the whole language; ``first`` marks one row of each (lang, term).
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"))], utf8(text).alias("text"))
    placed = rows.mapInArrow(_count, _COUNTS).repartition("lang", "term")
    summed = placed.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    w = Window.partitionBy("lang", "term")
    group_row = F.col("term").startswith(" ")
    return (
        summed.withColumn("lang_docs", F.sum("docs").over(w))
        .withColumn("lang_n", F.sum("n").over(w))
        .withColumn("first", (F.row_number().over(w.orderBy("source")) == 1) & ~group_row)
        .where(group_row | (F.col("lang_docs") >= min_docs))
        .select("lang", "source", F.when(~group_row, F.col("term")).alias("term"), "n", "lang_n", "first")
    )


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTHING) / (total + SMOOTHING * kept)), exact; 0 where nothing is kept."""
    whole = (total + SMOOTHING * kept).cast("decimal(38,0)")
    top = F.lit(SCALE).cast("decimal(18,0)") * (n + SMOOTHING).cast("decimal(19,0)")
    return F.when(kept > 0, 1 + F.call_function("div", top, F.nullif(whole, F.lit(0).cast("decimal(38,0)")))).otherwise(F.lit(0).cast("long"))


def _groups(kept: DataFrame) -> DataFrame:
    """A row for each group: total, support, and its language's kept terms and total; share of an absent term."""
    by_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("term").alias("support"), F.sum(F.col("first").cast("long")).alias("firsts"))
    w = Window.partitionBy("lang")
    return by_group.select(
        "lang", "source", "total", "support", F.sum("firsts").over(w).alias("kept"), F.sum("total").over(w).alias("lang_total")
    ).withColumn("p0", share(F.lit(0).cast("long"), F.col("total"), F.col("kept")))


def _one_sided(prices: DataFrame, pairs: DataFrame) -> DataFrame:
    """(lang, source, other, value): sum over the source's support of |p - the other's p0|, for all others by one pass of running sums."""
    bars = prices.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("c")).select("lang", "source", "p", "c", (F.col("c") * F.col("p")).alias("s"), F.lit(None).cast("string").alias("other"))
    asked = pairs.select("lang", "source", F.col("other_p0").alias("p"), F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("s"), "other")
    w = Window.partitionBy("lang", "source")
    upto = w.orderBy("p").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    x, c, s = F.col("p"), F.sum("c").over(upto), F.sum("s").over(upto)
    summed = bars.unionByName(asked).select(
        "lang", "source", "other", (x * c - s + (F.sum("s").over(w) - s) - x * (F.sum("c").over(w) - c)).alias("value")
    )
    return summed.where("other is not null")


def _overlaps(prices: DataFrame) -> DataFrame:
    """(lang, source, other, value), source before other: over the terms that both hold, what the one-sided sums got wrong."""
    a = prices.select("lang", "term", "source", "p", "p0")
    b = prices.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("r"), F.col("p0").alias("r0"))
    p, p0, r, r0 = (F.col(c) for c in ("p", "p0", "r", "r0"))
    wrong = F.abs(p - r) - F.abs(p - r0) - F.abs(p0 - r) + F.abs(p0 - r0)
    return a.join(b, ["lang", "term"]).where(F.col("source") < F.col("other")).groupBy("lang", "source", "other").agg(F.sum(wrong).alias("value"))


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): each source's distance from the others of its language, and the terms it overuses.

    Part ``pair`` has every other source with the distance, part ``term`` the terms whose
    share lies most above the language's, ``top_terms`` at most. Equal values rank by
    the item's bytes. Null texts, languages and sources count as ''; a group without terms
    has zero counts; a language without kept terms has distances of 0 and no terms. Repeated
    rows count as often as they stand, texts are read whole, other columns aren't read,
    and an empty table gives no rows. The result has a row for each ordered pair of a
    language's sources, as asked for; no pair of rows or of terms is formed.
    """
    kept = materialize(postings(docs, text, lang, source, min_docs), "divergence-postings")
    groups = materialize(_groups(kept), "divergence-groups")
    held = kept.where("term is not null").join(groups, ["lang", "source"])
    prices = materialize(
        held.select("lang", "source", "term", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), "p0", share(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q")),
        "divergence-prices",
    )
    own = groups.select("lang", "source", "support", "kept", "p0")
    others = groups.select("lang", F.col("source").alias("other"), F.col("support").alias("other_support"), F.col("p0").alias("other_p0"))
    pairs = own.join(others, "lang").where(F.col("source") != F.col("other"))
    neither = pairs.where(F.col("source") < F.col("other")).select(
        "lang", "source", "other", ((F.col("kept") - F.col("support") - F.col("other_support")) * F.abs(F.col("p0") - F.col("other_p0"))).alias("value")
    )
    one = _one_sided(prices, pairs).select("lang", F.least("source", "other").alias("source"), F.greatest("source", "other").alias("other"), "value")
    summed = neither.unionByName(one).unionByName(_overlaps(prices)).groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("source"), F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("source").alias("item"))))
    distances = summed.select("lang", both.alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    over = prices.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return distances.withColumn("rank", ranked).unionByName(over.withColumn("rank", ranked).where(F.col("rank") <= top_terms))
