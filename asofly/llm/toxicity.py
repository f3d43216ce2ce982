"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes.

Features of a text are the beginnings of its words, of ``STEM_BYTES`` bytes, and whole
words, each at the levels of ``LEVELS`` that its count reaches ("three words that begin
so"), so that how often something is said survives the cosine's normalisation. Only
features are kept that go with the label beyond chance (a chi-square bound); a text's
profile is the short list of those it has, weighted by their inverse document frequency
in the whole corpus.

Examples are a sample of the labelled rows (``MOST_EXAMPLES``, a documented bound: labels
grow with the corpus, the classifier doesn't). Equal profiles are one entry with its
examples and toxic examples counted, so ties are never broken by order: a text's
neighbours are the nearest entries until ``NEIGHBOURS`` examples are in, with all that
are as near as the last. Votes are calibrated by the votes that the examples
themselves get when each is left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofly.llm.terms import WORDS, rows_of, terms_of, utf8
from asofly.session import materialize

#: Labelled rows that the classifier learns from, at most (expected: rows are chosen by hash), and features it keeps.
MOST_EXAMPLES, MOST_FEATURES = 30_000, 4096
#: Least chi-square of a feature with the label, and least toxic examples that have it.
CHI_SQUARE, LEAST_TOXIC = 30.0, 3
STEM_BYTES = range(3, 10)
LEVELS = (1, 2, 3, 4, 6, 8, 12, 16)
NEIGHBOURS = 25
#: Entries of a block of the index; similarities that differ by less than EPSILON are equal.
BLOCK, EPSILON = 64, 1e-9
#: Candidate features added up in a task before they are handed on, and profiles whose score a worker remembers.
HELD, REMEMBERED = 400_000, 50_000
FOLDS = 5


def held_out(key: Column) -> Column:
    """Whether the row's label must not be learnt: crc32 of the key as text, modulo five, is zero."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def _stems(word: bytes) -> list[bytes]:
    """The word's beginnings (marked by a following dash, which no word holds) and the word itself."""
    return [word, *(word[:n] + b"-" for n in STEM_BYTES if n <= len(word))]


def features(text: bytes) -> list[tuple[bytes, int]]:
    """All (stem, level) features of a text."""
    counts: Counter = Counter()
    for word, n in Counter(terms_of(text, WORDS)).items():
        for stem in _stems(word):
            counts[stem] += n
    return [(stem, level) for stem, n in counts.items() for level in LEVELS if level <= n]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(stem, level, n, toxic) added up within a task."""
    seen: Counter = Counter()
    bad: Counter = Counter()

    def flush() -> pa.RecordBatch:
        stems, levels = zip(*seen, strict=True)
        out = pa.RecordBatch.from_arrays(
            [pa.array(stems, pa.binary()), pa.array(levels, pa.int32()), pa.array(seen.values(), pa.int64()), pa.array([bad[f] for f in seen], pa.int64())], names=["stem", "level", "n", "toxic"]
        )
        seen.clear()
        bad.clear()
        return out

    for text, toxic in rows_of(batches):
        found = features(text)
        seen.update(found)
        if toxic:
            bad.update(found)
        if len(seen) > HELD:
            yield flush()
    if seen:
        yield flush()


def _distinct_features(rows: list) -> list[tuple[bytes, int]]:
    """Of features in equally many examples and toxic examples, one of those that continue one another: the longest stem, the lowest level."""
    kept = []
    for _, same in groupby(sorted(rows, key=lambda r: (r["n"], r["toxic"])), key=lambda r: (r["n"], r["toxic"])):
        group: list[tuple[bytes, int]] = []
        for stem, level in sorted(((bytes(r["stem"]), r["level"]) for r in same), key=lambda x: (-len(x[0].rstrip(b"-")), x[1], x[0])):
            if not any(longer.startswith(stem.rstrip(b"-")) for longer, _ in group):
                group.append((stem, level))
        kept += group
    return sorted(kept)


@dataclass
class Profiles:
    """Maps a text to the sorted numbers of the chosen features that it has."""

    chosen: list[tuple[bytes, int]]
    levels: dict[bytes, list[tuple[int, int]]] = field(default_factory=dict)
    heads: set[bytes] = field(default_factory=set)

    def __post_init__(self) -> None:
        for number, (stem, level) in enumerate(self.chosen):
            self.levels.setdefault(stem, []).append((level, number))
        self.heads = {stem.rstrip(b"-")[:3] for stem in self.levels}

    def of(self, text: bytes) -> list[int]:
        counts: Counter = Counter()
        heads, levels = self.heads, self.levels
        for word, n in Counter(w for w in terms_of(text, WORDS) if w[:3] in heads).items():
            for stem in _stems(word):
                if stem in levels:
                    counts[stem] += n
        return sorted(number for stem, n in counts.items() for level, number in levels[stem] if level <= n)

    def rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.num_columns - 1)
            made = pa.array([self.of(t.as_py()) for t in text], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=[*batch.schema.names[:-1], "profile"])


class ExampleIndex:
    """Inverted index of example profiles in blocks, each with its greatest weight of every feature."""

    def __init__(self, profiles: list[tuple[int, ...]], n: np.ndarray, toxic: np.ndarray, weight: np.ndarray):
        order = sorted(range(len(profiles)), key=lambda i: profiles[i])  # like profiles share blocks, so that few blocks have high bounds
        self.profiles = [profiles[i] for i in order]
        self.order, self.n, self.toxic, self.weight = order, n[order].astype(float), toxic[order].astype(float), weight
        self.place = {p: i for i, p in enumerate(self.profiles)}
        self.n_blocks = -(-len(order) // BLOCK)
        ids: dict[int, list[int]] = {}
        shares: dict[int, list[float]] = {}
        for i, profile in enumerate(self.profiles):
            for f, w in zip(profile, self.unit(profile), strict=True):
                ids.setdefault(f, []).append(i)
                shares.setdefault(f, []).append(w)
        self.postings = {f: (np.asarray(at), np.asarray(shares[f])) for f, at in ids.items()}
        self.blocks = {}
        for f, (at, w) in self.postings.items():
            block, first = np.unique(at // BLOCK, return_index=True)
            self.blocks[f] = (block, np.maximum.reduceat(w, first))
        self.prior = float(self.toxic.sum() / self.n.sum()) if len(order) else 0.0

    def unit(self, profile: tuple[int, ...]) -> np.ndarray:
        w = self.weight[list(profile)]
        size = float(np.sqrt((w * w).sum()))
        return w / size if size else w

    def nearest(self, profile: tuple[int, ...], without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Entries and similarities of the neighbours, nearest first; of the entry ``without`` one example is left out."""
        have = self.n
        if without is not None:
            have = have.copy()
            have[without] -= 1
        query = [(f, w) for f, w in zip(profile, self.unit(profile), strict=True) if f in self.postings and w > 0]
        if not query:  # nothing in common with any: the examples that have nothing either
            at = self.place.get(())
            return (np.asarray([at]), np.ones(1)) if at is not None and have[at] > 0 else (np.zeros(0, int), np.zeros(0))
        bound = np.zeros(self.n_blocks)
        for f, w in query:
            block, most = self.blocks[f]
            bound[block] += w * most
        ranked = np.argsort(-bound, kind="stable")
        ranked = ranked[bound[ranked] > 0]
        similar = np.zeros(len(self.n))
        least, done, step = -1.0, 0, 4
        while done < len(ranked) and bound[ranked[done]] >= least - EPSILON:
            now = np.zeros(self.n_blocks, bool)
            now[ranked[done : done + step]] = True
            for f, w in query:
                at, share = self.postings[f]
                hit = now[at // BLOCK]
                similar[at[hit]] += w * share[hit]
            done, step = done + step, 2 * step
            found = np.flatnonzero((similar > 0) & (have > 0))
            found = found[np.argsort(-similar[found], kind="stable")]
            within = np.cumsum(have[found])
            if len(found) and within[-1] >= NEIGHBOURS:
                least = float(similar[found[np.searchsorted(within, NEIGHBOURS)]])
        found = np.flatnonzero((similar > 0) & (similar >= least - EPSILON) & (have > 0))
        found = found[np.argsort(-np.round(similar[found], 9), kind="stable")]
        return found, similar[found]

    def vote(self, profile: tuple[int, ...], without: int | None = None, label: int = 0) -> tuple[float, np.ndarray]:
        """Share of toxic votes, the prior as one vote more, and the neighbours. An example weighs the less the farther it is."""
        at, similar = self.nearest(profile, without)
        close = 1 / (0.1 + np.sqrt(np.maximum(0.0, 2 - 2 * np.minimum(similar, 1))))
        n, toxic = self.n[at].copy(), self.toxic[at].copy()
        if without is not None:
            n[at == without] -= 1
            toxic[at == without] -= label
        return float((close @ toxic + self.prior) / (close @ n + 1)), at


@dataclass
class Calibration:
    """Piecewise linear map through the centres of the pools of an isotonic fit."""

    votes: np.ndarray
    shares: np.ndarray

    @classmethod
    def fit(cls, rows: list[tuple[float, float, float]]) -> Calibration:
        """``rows``: (vote, examples, toxic examples)."""
        pools: list[list[float]] = []
        for vote, n, toxic in sorted(rows):
            pools.append([vote * n, n, toxic])
            while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
        return cls(np.asarray([v / n for v, n, _ in pools]), np.asarray([(t + 0.1) / (n + 0.2) if len(pools) > 1 else t / n for _, n, t in pools]))

    def of(self, vote: float) -> float:
        return float(np.interp(vote, self.votes, self.shares)) if len(self.votes) else 0.0


def _left_out(index: ExampleIndex):
    """(vote, n, toxic): the votes that examples get from the others, by numbers of entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in batch.column(0).to_pylist():
                toxic, n = int(index.toxic[i]), int(index.n[i])
                rows += [(round(index.vote(index.profiles[i], i, label)[0], 3), k, k * label) for label, k in ((1, toxic), (0, n - toxic)) if k]
            vote, n, toxic = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(vote, pa.float64()), pa.array(n, pa.int64()), pa.array(toxic, pa.int64())], names=["vote", "n", "toxic"])

    return run


def _scores(index: ExampleIndex, calibration: Calibration, evidence: np.ndarray, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, ...], tuple[float, list[int]]] = {}

        def answer(profile: tuple[int, ...]) -> tuple[float, list[int]]:
            if (found := known.get(profile)) is None:
                vote, at = index.vote(profile)
                found = calibration.of(vote), [int(evidence[i]) for i in at[:most]]
                if len(known) < REMEMBERED:
                    known[profile] = found
            return found

        for batch in batches:
            rows = [answer(tuple(p)) for p in batch.column("profile").to_pylist()]
            score = pa.array([s for s, _ in rows], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], score, pa.array([e for _, e in rows], pa.list_(pa.int64()))], names=[*batch.schema.names[:-1], "score", "evidence"])

    return run


def _sample(labels: DataFrame, label_key: str, label: str, most: int) -> DataFrame:
    """(_id, _toxic) of at most about ``most`` keys whose labels may be learnt, chosen by a hash of the key; a key labelled both ways counts as its majority."""
    usable = labels.where(F.col(label).isNotNull() & ~held_out(F.col(label_key)))
    known = usable.groupBy(F.col(label_key).cast("long").alias("_id")).agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("_toxic"))
    n = known.count()
    return known.where(F.pmod(F.xxhash64("_id", F.lit(13)), F.lit(1_000_000_000)) < 1_000_000_000 * most // max(n, 1)) if n > most else known


def toxicity(
    docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label_key: str = "doc_id", label: str = "toxic", most_examples: int = MOST_EXAMPLES, evidence: int = 5
) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) of every row of ``docs``; evidence are keys of the nearest examples, one of each of the nearest profiles.

    A score depends on the text alone: neither labels, nor the key, nor other columns are
    read for it. Null and empty texts have an empty profile, as have texts without any
    feature that goes with the label; they get the share of toxic examples among such. Repeated
    rows are scored alike. Null keys count as held out. Without usable labels all scores are 0;
    with one class they are that class. Texts are read whole; an empty table gives no rows.
    """
    spark = docs.sparkSession
    chosen = materialize(_sample(labels, label_key, label, most_examples), "toxicity-sample")
    body = docs.select(F.col(key).cast("long").alias("_id"), utf8(text).alias("_text"))
    # at most about ``most_examples`` rows of two numbers
    learnt = body.join(F.broadcast(chosen), "_id")
    candidates = learnt.select("_text", "_toxic").mapInArrow(_candidates, "stem binary, level int, n long, toxic long").groupBy("stem", "level").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    total, bad = (int(x or 0) for x in chosen.agg(F.count(F.lit(1)), F.sum("_toxic")).first())
    expected = F.col("n") * (bad / total if total else 0.0)
    gain = F.pow(F.col("toxic") - expected, F.lit(2)) / (expected * (1 - bad / total)) if 0 < bad < total else F.lit(0.0)
    picked = candidates.withColumn("gain", gain).where((F.col("toxic") >= LEAST_TOXIC) & (F.col("toxic") > expected) & (F.col("gain") >= CHI_SQUARE))
    profiles = Profiles(_distinct_features(picked.orderBy(F.desc("gain"), "stem", "level").limit(MOST_FEATURES).collect()) if 0 < bad < total else [])
    made = body.select(F.col("_id").alias("doc_id"), "_text").mapInArrow(profiles.rows, "doc_id long, profile array<int>")
    made = materialize(made, "toxicity-profiles")
    # inverse document frequencies are the whole corpus's
    n_docs = made.count()
    frequency = np.zeros(len(profiles.chosen))
    for r in made.select(F.explode("profile").alias("f")).groupBy("f").count().collect():
        frequency[r["f"]] = r["count"]
    weight = np.log((n_docs + 1) / (frequency + 1))
    examples = made.join(F.broadcast(chosen), made["doc_id"] == chosen["_id"])
    entries = examples.groupBy("profile").agg(F.count(F.lit(1)).alias("n"), F.sum("_toxic").alias("toxic"), F.min("doc_id").alias("first")).orderBy("profile").collect()
    index = ExampleIndex([tuple(r["profile"]) for r in entries], np.asarray([r["n"] for r in entries], float), np.asarray([r["toxic"] for r in entries], float), weight)
    first = np.asarray([entries[i]["first"] for i in index.order], np.int64)
    places = spark.range(len(entries)).select(F.col("id").alias("place"))
    votes = places.mapInArrow(_left_out(index), "vote double, n long, toxic long").groupBy("vote").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).collect() if entries else []
    calibration = Calibration.fit([(r["vote"], r["n"], r["toxic"]) for r in votes])
    scored = made.mapInArrow(_scores(index, calibration, first, evidence), "doc_id long, score double, evidence array<long>")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
