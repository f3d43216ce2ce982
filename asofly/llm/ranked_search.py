"""Ranked lexical search by block-max pruning over a forward index of document blocks.

A block is a short range of neighbouring documents with its terms, each document's
(term, tf) entries, and for each term the points (tf, length) that no other document of
the block beats in both. The score of a term grows with tf and falls with the length, so
its greatest score in the block is at one of these points, whatever the corpus
statistics turn out to be: the index is written in one pass and stays valid as they grow.

A search reads the points only, bounds every (query, block), and scores the best few
blocks of each query first, which gives a threshold that the answer can't fall below. Then
the tasks score their blocks in the order of the bounds, until these drop below the
threshold, which a task's own finds raise further. Bounds are sums of maxima and weights aren't negative, so nothing above a threshold is skipped:
the result is exact.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from asofly.llm.terms import WORDS, rows_of, terms_of, utf8
from asofly.session import materialize

# Fixed values of the score: length normalisation in percent, term frequency saturation, scales.
LENGTH_PERCENT, SATURATION, TF_SCALE, TF_STEP, WEIGHT_SCALE = 75, 8, 1_000_000_000, 1000, 1000
TOP = 10
#: A block ends at so many documents or bytes of text, whichever comes first; a longer document is a block of its own.
BLOCK_DOCS, BLOCK_BYTES = 128, 1 << 19
#: Queries answered together: their terms are what a task is sent, so this many bytes of query text bound it.
QUERY_BYTES, QUERY_ROWS = 4 << 20, 2000
#: Blocks of the greatest bounds that are scored first for each query.
FIRST_BLOCKS = 4

#: A block's row: its number, documents with a term, their terms, and three packed columns of which a pass reads what it needs.
INDEX = "block long, n_docs long, n_terms long, dictionary binary, points binary, forward binary"


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of 64-bit or smaller integers as one compressed value."""
    head = np.asarray([len(arrays), *[len(a) for a in arrays], *[a.itemsize for a in arrays]], "<i8").tobytes()
    return zstandard.compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), 1)


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    sizes, widths = np.frombuffer(raw, "<i8", 2 * n, 8).reshape(2, n).tolist()
    out, at = [], 8 * (2 * n + 1)
    for size, width in zip(sizes, widths, strict=True):
        out.append(np.frombuffer(raw, f"<i{width}", size, at))
        at += size * width
    return out


def _points(term: np.ndarray, tf: np.ndarray, length: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each term its unbeaten (tf, length): entries sorted by length, kept where tf exceeds all before."""
    order = np.lexsort((-tf, length, term))
    term, tf, length = term[order], tf[order], length[order]
    lifted = term.astype(np.int64) * (int(tf.max(initial=0)) + 1) + tf
    before = np.concatenate([[-1], np.maximum.accumulate(lifted)[:-1]]) if len(lifted) else lifted
    keep = lifted > np.maximum(before, term.astype(np.int64) * (int(tf.max(initial=0)) + 1))
    return np.searchsorted(term[keep], np.arange(n_terms + 1)), tf[keep], length[keep]


def _block(number: int, docs: list[tuple[int | None, Counter, int]]) -> pa.RecordBatch:
    vocabulary: dict[bytes, int] = {}
    place = vocabulary.setdefault
    ids = [place(t, len(vocabulary)) for _, counts, _ in docs for t in counts]
    sizes = [len(counts) for _, counts, _ in docs]
    term = np.asarray(ids, np.int32)
    tf = np.fromiter((v for _, counts, _ in docs for v in counts.values()), np.int32, len(ids))
    lengths = np.asarray([n for *_, n in docs], np.int64)
    begin, point_tf, point_length = _points(term, tf, np.repeat(lengths, sizes), len(vocabulary))
    # no term holds a line end
    dictionary = _pack(np.bincount(term, minlength=len(vocabulary)).astype(np.int32), np.frombuffer(b"\n".join(vocabulary), np.int8))
    null = np.asarray([d is None for d, *_ in docs], np.int8)
    forward = _pack(np.asarray([d or 0 for d, *_ in docs], np.int64), null, lengths, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), term, tf)
    columns = [pa.array([x]) for x in (number, int((lengths > 0).sum()), int(lengths.sum()))]
    columns += [pa.array([x], pa.binary()) for x in (dictionary, _pack(begin.astype(np.int32), point_tf, point_length), forward)]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in INDEX.split(", ")])


def _blocks(block_docs: int, block_bytes: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # as monotonically_increasing_id: a task's blocks are numbered from its partition's own base
        number = TaskContext.get().partitionId() << 33
        held: list[tuple[int | None, Counter, int]] = []
        size = 0
        for doc_id, text in rows_of(batches):
            if held and (len(held) >= block_docs or size + len(text) > block_bytes):
                yield _block(number, held)
                held, size, number = [], 0, number + 1
            words = terms_of(text, WORDS)
            held.append((doc_id, Counter(words), len(words)))
            size += len(text)
        if held:
            yield _block(number, held)

    return make


def build_index(docs: DataFrame, text: str = "text", key: str = "doc_id", block_docs: int = BLOCK_DOCS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The forward index of all documents, a row for each block, in the order in which the table is read."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), utf8(text).alias("text")).mapInArrow(_blocks(block_docs, block_bytes), INDEX)


@dataclass
class Queries:
    """Queries answered together: each query's distinct terms by their place in ``terms``, with weight times repeats."""

    terms: list[bytes]
    of_query: list[tuple[np.ndarray, np.ndarray]]
    n_docs: int = 0
    n_terms: int = 0

    def weigh(self, n_docs: int, n_terms: int, df: np.ndarray) -> None:
        self.n_docs, self.n_terms = n_docs, n_terms
        w = np.asarray([math.floor(WEIGHT_SCALE * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        self.of_query = [(at, w[at] * repeats) for at, repeats in self.of_query]
        self.flat_terms = np.concatenate([at for at, _ in self.of_query])
        self.flat_weights = np.concatenate([weight for _, weight in self.of_query])
        self.edges = np.cumsum([0, *[len(at) for at, _ in self.of_query]])


def parse(texts: Iterable[bytes]) -> Queries:
    place: dict[bytes, int] = {}
    of_query = []
    for text in texts:
        counts = Counter(terms_of(text, WORDS))
        of_query.append((np.asarray([place.setdefault(t, len(place)) for t in counts], np.int64), np.asarray(list(counts.values()), np.int64)))
    return Queries(list(place), of_query)


def impact(tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What one unit of weight adds for a term: (TF_SCALE * tf) div (TF_STEP * tf + SATURATION * m)."""
    distinct, at = np.unique(length, return_inverse=True)
    # Python's integers: length times documents may pass 64 bits before it is divided
    m = np.asarray([100 - LENGTH_PERCENT + LENGTH_PERCENT * int(n) * n_docs // n_terms for n in distinct], np.int64)[at]
    tf = tf.astype(np.int64)
    return TF_SCALE * tf // (TF_STEP * tf + SATURATION * m)


def _dictionary(blob: bytes, wanted: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each term of a block its place among the wanted ones, or -1, and the documents that hold it."""
    df, text = _unpack(blob)
    terms = pa.array(text.tobytes().split(b"\n") if len(text) else [], pa.binary())
    return pc.fill_null(pc.index_in(terms, value_set=wanted), -1).to_numpy(zero_copy_only=False), df


def _document_counts(terms: list[bytes]):
    """Documents of each wanted term, added up within a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(terms, pa.binary())
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for blob in batch.column("dictionary"):
                at, df = _dictionary(blob.as_py(), wanted)
                total[at[at >= 0]] += df[at >= 0]
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], names=["at", "df"])

    return count


def _block_bounds(q: Queries, at: np.ndarray, begin: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For each query the sum of weights times the block's greatest impact of each term; ``at`` is each block term's place among the wanted ones."""
    here = np.flatnonzero(at >= 0)
    if not len(here):
        return np.zeros(len(q.of_query), np.int64)
    begin = begin.astype(np.int64)
    sizes = begin[here + 1] - begin[here]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    points = np.repeat(begin[here] - starts, sizes) + np.arange(sizes.sum())
    best = np.zeros(len(q.terms), np.int64)
    best[at[here]] = np.maximum.reduceat(impact(tf[points], length[points], q.n_docs, q.n_terms), starts)
    upto = np.concatenate([[0], np.cumsum(best[q.flat_terms] * q.flat_weights)])
    return upto[q.edges[1:]] - upto[q.edges[:-1]]


def _bounds(q: Queries):
    """(query, block, bound) wherever the bound is above zero."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(q.terms, pa.binary())
        for batch in batches:
            for number, dictionary, points in zip(*(batch.column(c) for c in ("block", "dictionary", "points")), strict=True):
                sums = _block_bounds(q, _dictionary(dictionary.as_py(), wanted)[0], *_unpack(points.as_py()))
                hit = np.flatnonzero(sums > 0)
                yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(np.full(len(hit), number.as_py())), pa.array(sums[hit])], names=["query", "block", "bound"])

    return bound


#: Blocks that a task sorts by their bounds at once.
SORTED_BLOCKS = 64


def _scores(q: Queries, floor: np.ndarray, top: int, only: dict[int, list[int]] | None = None):
    """Best documents of the blocks that a task has: the greatest bounds first, and no block for a query whose threshold its bound misses.

    A query's threshold is ``floor`` or the last of its own best documents here, whichever
    is more. ``only`` names the queries of each block where not all are wanted.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(q.terms, pa.binary())
        best: dict[int, list[tuple[int, tuple[bool, int], int]]] = {}  # heaps of (score, descending key, row number)
        least = floor.copy()
        made = 0
        for batch in (b.slice(i, SORTED_BLOCKS) for b in batches for i in range(0, b.num_rows, SORTED_BLOCKS)):
            numbers = batch.column("block").to_pylist()
            ats = [_dictionary(x.as_py(), wanted)[0] for x in batch.column("dictionary")]
            sums = [_block_bounds(q, at, *_unpack(x.as_py())) for at, x in zip(ats, batch.column("points"), strict=True)]
            for row in sorted(range(batch.num_rows), key=lambda r: -int(sums[r].max(initial=0))):
                asked = np.flatnonzero(sums[row] >= least)
                if only is not None:
                    asked = np.intersect1d(asked, only.get(numbers[row], []))
                if not len(asked):
                    continue
                ids, null, length, begin, term, tf = _unpack(batch.column("forward")[row].as_py())
                term = ats[row][term]
                kept = np.flatnonzero(term >= 0)
                edge = np.searchsorted(kept, begin)
                term = term[kept]
                worth = impact(tf[kept], np.repeat(length, np.diff(edge)), q.n_docs, q.n_terms)
                for query in asked.tolist():
                    weight = np.zeros(len(q.terms), np.int64)
                    places, w = q.of_query[query]
                    weight[places] = w
                    upto = np.concatenate([[0], np.cumsum(weight[term] * worth)])
                    total = upto[edge[1:]] - upto[edge[:-1]]
                    heap = best.setdefault(query, [])
                    for d in np.flatnonzero(total >= least[query]).tolist():
                        made += 1
                        entry = (int(total[d]), (not null[d], -int(ids[d])), made)  # of equal scores the smaller key, null last
                        if len(heap) < top:
                            heapq.heappush(heap, entry)
                        elif entry > heap[0]:
                            heapq.heapreplace(heap, entry)
                    if len(heap) == top:
                        least[query] = max(least[query], heap[0][0])
        rows = [(query, s, -k if known else None) for query, heap in best.items() for s, (known, k), _ in heap]
        if rows:
            query, s, ids = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(ids, pa.int64()), pa.array(s, pa.int64())], names=["query", "doc_id", "score"])

    return score


def _best(found: DataFrame, top: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def _document_frequencies(index: DataFrame, terms: list[bytes]) -> np.ndarray:
    df = np.zeros(len(terms), np.int64)
    for r in index.select("dictionary").mapInArrow(_document_counts(terms), "at long, df long").groupBy("at").agg(F.sum("df").alias("df")).collect():
        df[r["at"]] = r["df"]
    return df


def _answer(index: DataFrame, q: Queries, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(query, rank, doc_id, score) of the queries answered together.

    First each query's ``FIRST_BLOCKS`` blocks of the greatest bounds are scored: the last
    of the best documents there is a threshold that the answer can't fall below. Then each task
    scores, of the blocks it has, those whose bound reaches the threshold, greatest first, while
    its own finds raise it. A bound that equals a threshold is scored too: the block may hold an
    equal score of a smaller key. Index rows aren't shuffled; what is are a task's
    ``top`` documents of a query, and what the driver holds is ``FIRST_BLOCKS`` numbers and a threshold for each query.
    """
    q.weigh(n_docs, n_terms, _document_frequencies(index, q.terms))
    bounds = index.select("block", "dictionary", "points").mapInArrow(_bounds(q), "query long, block long, bound long")
    w = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
    only: dict[int, list[int]] = {}
    for r in bounds.withColumn("place", F.row_number().over(w)).where(F.col("place") <= FIRST_BLOCKS).collect():
        only.setdefault(r["block"], []).append(r["query"])
    floor = np.ones(len(q.of_query), np.int64)
    if only:
        first = index.sparkSession.createDataFrame([(b,) for b in only], "block long")
        some = index.select("block", "dictionary", "points", "forward").join(F.broadcast(first), "block", "left_semi").mapInArrow(_scores(q, floor, top, only), "query long, doc_id long, score long")
        for r in _best(some, top).where(F.col("rank") == top).collect():
            floor[r["query"]] = r["score"]
    return _best(index.select("block", "dictionary", "points", "forward").mapInArrow(_scores(q, floor, top), "query long, doc_id long, score long"), top)


_RESULT = [StructField("rank", IntegerType()), StructField("doc_id", LongType()), StructField("score", LongType())]


def _together(rows: Iterable, most: int, most_bytes: int) -> Iterator[list[tuple[object, bytes]]]:
    """The queries in runs bounded by number and bytes."""
    held: list[tuple[object, bytes]] = []
    size = 0
    for k, t in rows:
        if held and (len(held) >= most or size + len(t) > most_bytes):
            yield held
            held, size = [], 0
        held.append((k, bytes(t)))
        size += len(t)
    if held:
        yield held


def ranked_search(docs: DataFrame, queries: DataFrame, text: str = "text", key: str = "doc_id", query_text: str = "text", query_key: str = "item_id", top: int = TOP) -> DataFrame:
    """(query_key, rank, doc_id, score): the ``top`` best documents of each query, exactly.

    Every document is indexed, whole; queries are answered in blocks bounded by their bytes
    and number, each against all documents. Null and empty texts have no terms and are never
    found; a query without known terms has no rows. Repeated documents are found each for
    itself, and repeated queries are answered each for itself. Equal scores rank by ascending
    key, null keys last. Other columns aren't read; empty tables give no rows.
    """
    index = materialize(build_index(docs, text, key), "search-index")
    n_docs, n_terms = (x or 0 for x in index.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    shape = StructType([StructField("query", LongType()), StructField(query_key, queries.schema[query_key].dataType)])
    out = docs.sparkSession.createDataFrame([], StructType([shape[query_key], *_RESULT]))
    for held in _together(queries.select(F.col(query_key).alias("k"), utf8(query_text).alias("t")).toLocalIterator(), QUERY_ROWS, QUERY_BYTES):
        q = parse([t for _, t in held])
        if n_terms and q.terms:
            keys = docs.sparkSession.createDataFrame([(i, k) for i, (k, _) in enumerate(held)], shape)
            out = out.unionByName(_answer(index, q, n_docs, n_terms, top).join(F.broadcast(keys), "query").select(query_key, F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return out
