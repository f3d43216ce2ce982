"""Near-duplicates by SimHash fingerprints and a self-join of their binary trie.

Fingerprints are leaves of a binary trie. Two nodes of a depth are walked together
with the number of bits in which their paths differ; a pair of nodes over the error
budget is dropped with all below it.

The walk is dealt to tasks by sub-tries that share a block of bits: two paths that
differ in at most ``b`` bits agree on one of any ``b + 1`` blocks, so each path goes
to one group a block, and a group is walked by one task. A group of too many paths
is dealt again by blocks of the bits that are still open, in rounds of written
tables, until every group is small; nothing about single groups reaches the driver.
A task returns a spanning forest of the links found, never the links themselves, so a
dense group costs no more rows than it has members. Components are then found over
all forests.

Two kinds of links use the walk. ``near_duplicates`` links 64-bit fingerprints at a
few differing bits, exactly. ``similar_documents`` links texts whose sets of five-word
shingles have a Jaccard similarity of 0.8 or more: fingerprints of 320 bits are cut
into 13 paths of 24 bits, and a pair that one of the 13 tries brings together
within its budget is a candidate if all bits are within the budget of the whole.
Groups of candidates are then checked by their shingles, and only pairs that are
similar are links. A group is a pool of one task up to a number of shingles; a larger
one is cut into chunks and each pair of chunks is a pool, so nothing is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofly.llm.common import fresh, probe
from asofly.llm.words import slices
from asofly.operators.graph import connected_components
from asofly.session import materialize, scratch_scope

#: Bits of a fingerprint, error budget, words in a shingle, seed of XXH64.
BITS, BUDGET, SHINGLE, SEED = 64, 2, 3, 42
#: Similar texts: words in a shingle, 64-bit words of a fingerprint, bits in which two candidates may differ.
#: A five-word Jaccard similarity of 0.8 makes each bit differ with probability 0.151: 48 of 320, with a deviation of 6.
#: One of 13 paths is then within its budget with probability 0.98 (0.998 at a similarity of 0.85).
WIDE_SHINGLE, WIDE_WORDS, WIDE_BUDGET = 5, 5, 68
#: Least similarity of two linked texts, as a fraction.
SIMILAR = (4, 5)
#: Shingles of the texts that one task compares as a pool; a text counts as ``POOL_TEXT`` more.
POOL_SHINGLES, POOL_TEXT = 1_000_000, 64
#: Bits of a path cut from a wide fingerprint, and the budget of its trie.
PATH_BITS, PATH_BUDGET = 24, 2
#: Paths that one task walks as a group, rows that a task walks at once.
GROUP_ROWS, TASK_ROWS = 50_000, 100_000
#: Node pairs walked at once, pairs of leaves below which a pair of nodes is compared directly, and pairs compared at once.
BLOCK, DIRECT, PAIRS = 100_000, 64, 200_000

UPPER_TO_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: str | None, size: int):
    """Blocks of XXH64 values of a text's word shingles, repeats included, and their number; no words, no blocks."""
    import numpy as np
    import xxhash

    words = text.encode("utf-8").translate(UPPER_TO_LOWER).split() if text else []
    if not words:
        return [], 0
    body = b" ".join(words)
    n = max(1, len(words) - size + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[min(size, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return (
        np.fromiter((digest(body[a:b], SEED) for a, b in zip(starts[k : k + 65536], stops[k : k + 65536], strict=True)), np.uint64) for k in range(0, n, 65536)
    ), n


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """SimHash of a text's word shingles: bit ``b`` is set if it is in more than half of their hashes."""
    import numpy as np

    blocks, n = shingle_hashes(text, size)
    ones = np.zeros(BITS, np.int64)
    for hashes in blocks:
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def wide_fingerprint(blocks: list, n: int, words: int = WIDE_WORDS):
    """SimHash of ``words`` 64-bit words: the hashes of ``n`` shingles, in blocks, and values mixed from each for the further words."""
    import numpy as np

    ones = np.zeros(words * 64, np.int64)
    for hashes in blocks:
        table = np.stack([hashes, *(_mixed(hashes, k) for k in range(1, words))], axis=1)
        for at in range(0, len(table), 8192):
            ones += np.unpackbits(table[at : at + 8192].view(np.uint8).reshape(-1, 8 * words), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)


def shingle_set(blocks: list):
    """The distinct hashes of a text's shingles, sorted."""
    import numpy as np

    return np.unique(np.concatenate(blocks)) if blocks else np.zeros(0, np.uint64)


def _wide_row(text: str | None, size: int) -> list:
    """Wide fingerprint, 128-bit digest and number of a text's distinct shingles."""
    import numpy as np
    import xxhash

    blocks, n = shingle_hashes(text, size)
    blocks = list(blocks)
    shingles = shingle_set(blocks)
    digest = np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), np.uint64)
    return [*wide_fingerprint(blocks, n), *digest, len(shingles)]


def _mixed(hashes, k: int):
    """Values as good as independent of the hashes: a Weyl step and two rounds of multiply and shift."""
    import numpy as np

    x = hashes + np.uint64((0x9E3779B97F4A7C15 * k) & (2**64 - 1))
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", tagged: bool = False, size: int = SHINGLE) -> DataFrame:
    """(key, print): the fingerprint of every row as a signed 64-bit integer; null texts have fingerprint zero.

    ``tagged`` adds the text's XXH64 as ``tag``, which tells rows of one key apart.
    """
    return _prints(docs, text, key, tagged, ["print"], lambda t: fingerprint(t, size))


def _prints(docs: DataFrame, text: str, key: str, tagged: bool, names: list[str], make: Callable) -> DataFrame:
    tag = [F.xxhash64(F.col(text)).alias("tag")] if tagged else []
    source = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), *tag)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in slices(batches):
            prints = np.array([make(t) for t in batch.column(1).to_pylist()], np.uint64).reshape(-1, len(names)).view(np.int64)
            columns = [pa.array(np.ascontiguousarray(prints[:, k])) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *batch.columns[2:]], ["key", *names, *(["tag"] if tagged else [])])

    return source.mapInArrow(run, ", ".join(f"{c} long" for c in ["key", *names, *(["tag"] if tagged else [])]))


class Forest:
    """Union-find over local numbers, fed with arrays of links."""

    def __init__(self, n: int):
        import numpy as np

        self.np = np
        self.root = np.arange(n)

    def add(self, a, b) -> None:
        """Join the ends of every link: each root takes the least root it meets, until all agree."""
        np, root = self.np, self.root
        while True:
            ra, rb = root[a], root[b]
            unequal = ra != rb
            if not unequal.any():
                return
            a, b, ra, rb = a[unequal], b[unequal], ra[unequal], rb[unequal]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while not np.array_equal(root, up := root[root]):
                root[:] = up


def walk(left, right, same: bool, budget: int = BUDGET, bits: int = BITS, ranges=None, near: Callable | None = None):
    """Blocks (i, j) of index pairs with ``left[i]`` and ``right[j]`` at most ``budget`` bits apart.

    The values' upper ``bits`` are the paths; both arrays are sorted, and so are tries: a
    node of a depth is a range of equal upper bits. ``same``: both are one array, and only
    i < j is returned. ``ranges`` (begins, ends) are the roots of several tries that lie in
    one array one after another. ``near(i, j)`` is a further test of pairs.
    """
    import numpy as np

    if not len(left) or not len(right):
        return
    begin, end = ranges if ranges is not None else (np.array([0]), np.array([len(left)]))
    right_end = end if same else np.array([len(right)])
    stack = [(begin, end, begin, right_end, np.zeros(len(begin), np.int64), 0)]
    while stack:
        l0, l1, r0, r1, differ, depth = stack.pop()
        sizes = (l1 - l0) * (r1 - r0)
        small = (sizes <= DIRECT) if depth < bits else np.ones(len(sizes), bool)
        if small.any():
            for i, j in _pairs(l0[small], l1[small], r0[small], r1[small]):
                good = np.bitwise_count(left[i] ^ right[j]) <= budget
                if same:
                    good &= i < j
                if near is not None and good.any():
                    i, j = i[good], j[good]
                    good = near(i, j)
                if good.any():
                    yield i[good], j[good]
        large = ~small
        if not large.any():
            continue
        l0, l1, r0, r1, differ = l0[large], l1[large], r0[large], r1[large], differ[large]
        lm, rm = _middle(left, l0, l1, depth), _middle(right, r0, r1, depth)
        children = []
        for a0, a1, lb in ((l0, lm, 0), (lm, l1, 1)):
            for b0, b1, rb in ((r0, rm, 0), (rm, r1, 1)):
                d = differ + (lb != rb)
                good = (a0 < a1) & (b0 < b1) & (d <= budget)
                if same:
                    good &= a0 < b1  # the mirrored half of the square
                children.append([x[good] for x in (a0, a1, b0, b1, d)])
        parts = [np.concatenate(c) for c in zip(*children, strict=True)]
        for at in range(0, len(parts[0]), BLOCK):
            stack.append((*[x[at : at + BLOCK] for x in parts], depth + 1))


def _pairs(a0, a1, b0, b1):
    """All index pairs of each pair of ranges, at most about ``PAIRS`` at a time; wide ranges are cut into stripes."""
    import numpy as np

    count = (a1 - a0) * (b1 - b0)
    for k in np.flatnonzero(count > PAIRS):
        width = int(b1[k] - b0[k])
        step = max(1, PAIRS // width)
        for a in range(int(a0[k]), int(a1[k]), step):
            for b in range(int(b0[k]), int(b1[k]), PAIRS):
                i, j = np.arange(a, min(a + step, a1[k])), np.arange(b, min(b + PAIRS, b1[k]))
                yield np.repeat(i, len(j)), np.tile(j, len(i))
    fits = count <= PAIRS
    a0, b0, b1, count = a0[fits], b0[fits], b1[fits], count[fits]
    at, total = 0, np.cumsum(count)
    while at < len(count):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        n = count[at:to]
        which = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        width = (b1 - b0)[at:to][which]
        yield a0[at:to][which] + place // width, b0[at:to][which] + place % width
        at = to


def _middle(values, low, high, depth: int):
    """First index of each range whose bit at ``depth`` is set, by bisection: within a node the bit splits the range in two."""
    import numpy as np

    bit = np.uint64(1 << (BITS - 1 - depth))
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        mid = (low + high) // 2
        one = (values[np.minimum(mid, len(values) - 1)] & bit) != 0
        high = np.where(open_ & one, mid, high)
        low = np.where(open_ & ~one, mid + 1, low)
    return low


def blocks(fixed: int, bits: int, budget: int) -> list[int]:
    """Masks of the upper ``bits``: ``fixed`` and one of ``budget + 1`` blocks of the bits that are still open."""
    free = [b for b in range(64 - bits, 64) if not fixed >> b & 1]
    cuts = [len(free) * k // (budget + 1) for k in range(budget + 2)]
    return [fixed | sum(1 << b for b in free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def trie_links(prints: DataFrame, budget: int = BUDGET, leaves: int = GROUP_ROWS, words: tuple[str, ...] = ("print",), bits: int = BITS, whole: int | None = None) -> DataFrame:
    """(a, b): a spanning forest of the links between rows (words, rep) with distinct fingerprints, as pairs of reps.

    Fingerprints are cut into paths of ``bits`` bits, and pairs found that are within
    ``budget`` on one of the paths and, with ``whole``, within that on all bits. A group
    of more than ``leaves`` paths is dealt again. Where no bits are open to deal it by
    (its paths are all within the budget, and only ``whole`` can part them), it is cut
    into chunks and each pair of chunks is a group.
    """
    group = ["tag", "fixed", "part", "chunk"]
    extra = list(words) if whole is not None else []
    names = [*group, "path", "rep", *extra]
    schema = ", ".join(f"{c} long" for c in names)

    def batch_of(columns) -> pa.RecordBatch:
        import numpy as np

        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns], names)

    def dealt(tag, fixed: int, chunk, path, rest):
        import numpy as np

        for mask in blocks(fixed, bits, budget):
            m = np.uint64(mask)
            yield batch_of([tag, np.full(len(path), m), path & m, chunk, path, *rest])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            columns = [c.to_numpy().view(np.uint64) for c in batch.columns]
            table, rep = np.stack(columns[:-1], axis=1), columns[-1]
            for tag, path in enumerate(_paths(table, bits)):
                yield from dealt(np.full(len(path), tag, np.int64), 0, np.zeros(len(path), np.int64), path, [rep, *columns[: len(extra)]])

    def deal_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            c = {n: batch.column(k).to_numpy().view(np.uint64) for k, n in enumerate(names)}
            for fixed in np.unique(c["fixed"]):
                of = c["fixed"] == fixed
                yield from dealt(c["tag"][of], int(fixed), c["chunk"][of], c["path"][of], [c[n][of] for n in ("rep", *extra)])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def links(table) -> pa.RecordBatch:
            keys, path, rep, wide = table[:4], table[4], table[5].view(np.int64), table[6:]
            new = np.concatenate([[True], np.any(keys[:, 1:] != keys[:, :-1], axis=0)])
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(path))
            some = end - begin > 1
            forest = Forest(len(path))

            def near(i, j):
                good = forest.root[i] != forest.root[j]
                at = np.flatnonzero(good)
                good[at] = sum(np.bitwise_count(w[i[at]] ^ w[j[at]]).astype(np.int64) for w in wide) <= whole
                return good

            if some.any():
                for i, j in walk(path, path, True, budget, bits, (begin[some], end[some]), near if extra else None):
                    forest.add(i, j)
            member = np.flatnonzero(forest.root != np.arange(len(path)))
            return pa.RecordBatch.from_arrays([pa.array(rep[member]), pa.array(rep[forest.root[member]])], ["a", "b"])

        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([c.to_numpy().view(np.uint64) for c in batch.columns]))
            size += batch.num_rows
            if size >= TASK_ROWS:
                table = np.concatenate(held, axis=1)
                # the last group may go on in the next batch
                cut = int(np.flatnonzero(np.append(True, np.any(table[:4, 1:] != table[:4, :-1], axis=0)))[-1])
                if cut:
                    yield links(table[:, :cut])
                held, size = [table[:, cut:]], table.shape[1] - cut
        if size:
            yield links(np.concatenate(held, axis=1))

    def walked(rows: DataFrame) -> DataFrame:
        return rows.repartition(*group).sortWithinPartitions(*group, F.col("path").bitwiseXOR(F.lit(-(2**63)))).mapInArrow(join, "a long, b long")

    rows = prints.select(*words, "rep").mapInArrow(deal, schema)
    found: list[DataFrame] = []
    with scratch_scope(prints.sparkSession):
        while True:
            sizes = materialize(rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > leaves), "hot-groups")
            if sizes.isEmpty():
                found.append(materialize(walked(rows), "trie-links", keep=True))
                break
            found.append(materialize(walked(rows.join(sizes, group, "left_anti")), "trie-links", keep=True))
            hot = rows.join(sizes, group)
            tight = F.lit(bits) - F.bit_count("fixed") <= budget
            # no bit is open any more: chunks of the group, each pair of them a group of its own
            n = F.ceil(F.col("n") / leaves)
            own, other = F.pmod(F.xxhash64("rep"), n), F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
            chunks = hot.where(tight).withColumn("own", own).withColumn("other", other).withColumn("chunk", F.least("own", "other") * n + F.greatest("own", "other") + 1)
            found.append(materialize(walked(chunks.select(*names)), "trie-links", keep=True))
            rows = materialize(hot.where(~tight).select(*names).mapInArrow(deal_again, schema), "trie-rows")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _paths(table, bits: int):
    """The paths of fingerprints (a row of 64-bit words each): pieces of ``bits`` bits, as the upper bits of a word."""
    import numpy as np

    if bits == BITS:
        yield from np.ascontiguousarray(table.T)
        return
    flat = np.unpackbits(np.ascontiguousarray(table).view(np.uint8), axis=1)
    for at in range(0, flat.shape[1] - bits + 1, bits):
        piece = np.zeros((len(table), BITS), np.uint8)
        piece[:, :bits] = flat[:, at : at + bits]
        yield np.packbits(piece, axis=1).view(">u8").astype(np.uint64).reshape(-1)


def _components(made: DataFrame, words: tuple[str, ...], links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of ``made`` with component_id and linked: classes of equal fingerprints, named by their least key, and links between them."""
    classes = materialize(made.where("key is not null").groupBy(*words).agg(F.min("key").alias("rep")), "fingerprint-classes")
    component = connected_components(links(classes), "a", "b").select(F.col("vertex").alias("rep"), "component")
    named = classes.join(component, "rep", "left").select(*words, F.coalesce("component", "rep").alias("component_id"), F.col("component").isNotNull().alias("linked"))
    return made.join(named, list(words), "left").withColumn("linked", F.coalesce("linked", F.lit(False)))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", budget: int = BUDGET, leaves: int = GROUP_ROWS, tagged: bool = False, size: int = SHINGLE) -> DataFrame:
    """key, fingerprint (16 lower-case hex digits), component_id, linked for every row.

    Fingerprints link at ``budget`` or fewer differing bits; a component is named by its
    smallest key; ``linked`` says whether another fingerprint is in it. Null texts and texts
    without a word have fingerprint zero and link like any other. Repeated rows share their
    answer. Rows with a null key get a fingerprint, and the component of their
    fingerprint's other keys, or null. Texts are hashed whole, in blocks of shingles.
    Other columns are not read; an empty table gives no rows. ``tagged`` adds the text's
    XXH64 as ``tag``; ``size`` is the words in a shingle.
    """
    made = materialize(fingerprints(docs, text, key, tagged, size), "fingerprints")
    found = _components(made, ("print",), lambda classes: trie_links(classes, budget, leaves))
    return found.select(F.col("key").alias(key), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id", "linked", *(["tag"] if tagged else []))


def similar_links(sets: list, share: tuple[int, int] = SIMILAR):
    """A spanning forest (members, roots) of the links between sets (sorted distinct values each) of at least that Jaccard similarity.

    One set after another is compared with all at once, by the postings of its values.
    Sets linked with the first one needn't be: what else they link with is compared itself.
    """
    import numpy as np

    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    forest = Forest(n)
    num, den = share
    if n < 8:
        for i in range(n):
            for j in range(i):
                s = int(sizes[i] + sizes[j])
                # the smaller set bounds what both share
                if int(min(sizes[i], sizes[j])) * (num + den) < num * s or forest.root[i] == forest.root[j]:
                    continue
                if len(np.intersect1d(sets[i], sets[j], assume_unique=True)) * (num + den) >= num * s:
                    forest.add(np.array([j]), np.array([i]))
    else:
        values, value = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(n), sizes)
        posting = owner[np.argsort(value, kind="stable")]
        held = np.bincount(value, minlength=len(values))
        first = np.cumsum(held) - held
        begin = np.cumsum(sizes) - sizes
        # the text whose shingles most others have comes first: it links with the most
        weight = np.bincount(owner, held[value].astype(float), n) / np.maximum(sizes, 1)
        order = np.argsort(-weight, kind="stable")
        for p in order:
            if p != order[0] and forest.root[p] == forest.root[order[0]]:
                continue
            own = value[begin[p] : begin[p] + sizes[p]]
            count = held[own]
            at = np.repeat(first[own] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            other, shared = np.unique(posting[at], return_counts=True)
            good = other[shared * (num + den) >= num * (sizes[p] + sizes[other])]
            forest.add(np.full(len(good), p), good)
    member = np.flatnonzero(forest.root != np.arange(n))
    return member, forest.root[member]


def checked_links(docs: DataFrame, candidates: DataFrame, text: str, key: str, size: int, share: tuple[int, int], pool: int) -> DataFrame:
    """(a, b): a spanning forest of the links within groups of candidates (rep, tag, size, pool), as pairs of reps; a written table.

    The texts are read again, those that pass a filter of the candidates. ``pool`` is the
    number of shingles compared by a task at once; larger groups are cut into chunks.
    """
    weight = F.sum(F.col("size") + POOL_TEXT)
    totals = candidates.groupBy("pool").agg(F.ceil(weight / pool).alias("n"), F.count(F.lit(1)).alias("texts")).where("texts > 1").select("pool", "n")
    own, other = F.pmod(F.xxhash64("rep", "tag"), F.col("n")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    chunks = candidates.join(totals, "pool").withColumn("own", own).withColumn("other", other)
    dealt = chunks.select(F.col("rep"), F.col("tag"), "pool", (F.least("own", "other") * F.col("n") + F.greatest("own", "other")).alias("chunk"))
    texts = docs.select(F.col(key).cast("long").alias("rep"), F.xxhash64(F.col(text)).alias("tag"), F.col(text).alias("text")).where("rep is not null")
    maybe, _ = probe(texts, F.struct("rep", "tag"), candidates.select(F.struct("rep", "tag").alias("own")), "own")
    rows = maybe.groupBy("rep", "tag").agg(F.first("text").alias("text")).join(dealt, ["rep", "tag"]).select("pool", "chunk", "rep", "text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def links(reps, sets) -> pa.RecordBatch:
            member, root = similar_links(sets, share) if len(sets) > 1 else ([], [])
            reps = np.array(reps, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(reps[member]), pa.array(reps[root])], ["a", "b"]) if len(member) else empty

        empty = pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64())], ["a", "b"])
        last, reps, sets = None, [], []
        for batch in slices(batches, 256):
            for group, rep, words in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if group != last:
                    if len(sets) > 1 and (found := links(reps, sets)).num_rows:
                        yield found
                    last, reps, sets = group, [], []
                reps.append(rep)
                sets.append(shingle_set(list(shingle_hashes(words.as_py(), size)[0])))
        yield links(reps, sets)

    pools = rows.repartition("pool", "chunk").sortWithinPartitions("pool", "chunk")
    return materialize(pools.mapInArrow(check, "a long, b long"), "checked-links", keep=True)


def similar_documents(
    docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = WIDE_SHINGLE, whole: int = WIDE_BUDGET, leaves: int = GROUP_ROWS, share: tuple[int, int] = SIMILAR, pool: int = POOL_SHINGLES
) -> DataFrame:
    """key, tag (the text's XXH64), component_id, linked for every row: groups of texts linked by their shingles.

    Texts are candidates if their 320-bit fingerprints over ``size`` words differ in at
    most ``whole`` bits and one of 13 paths in at most two; candidates and what they
    are candidates with in turn are a group. Texts of a group link if the Jaccard
    similarity of their sets of shingles is ``share`` or more; texts of equal sets are
    one. Nulls, empty and repeated rows, null keys, long texts and other columns are as
    in ``near_duplicates``; texts without a word have the same, empty set.
    """
    names, digest = tuple(f"w{k}" for k in range(WIDE_WORDS)), ["s0", "s1"]
    made = materialize(_prints(docs, text, key, True, [*names, *digest, "size"], lambda t: _wide_row(t, size)), "fingerprints")
    least = F.min(F.struct("key", "tag", *names, "size")).alias("least")
    classes = materialize(made.where("key is not null").groupBy(*digest).agg(least).select(*digest, F.col("least.key").alias("rep"), "least.tag", *(f"least.{c}" for c in names), "least.size"), "set-classes")
    prints = materialize(classes.groupBy(*names).agg(F.min("rep").alias("rep"), F.count(F.lit(1)).alias("n")), "fingerprint-classes")
    near = connected_components(trie_links(prints, PATH_BUDGET, leaves, names, PATH_BITS, whole), "a", "b").select(F.col("vertex").alias("rep"), "component")
    pooled = prints.join(near, "rep", "left").where("n > 1 or component is not null").select(*names, F.coalesce("component", "rep").alias("pool"))
    candidates = materialize(classes.join(pooled, list(names)).select("rep", "tag", "size", "pool"), "similar-candidates")
    component = connected_components(checked_links(docs, candidates, text, key, size, share, pool), "a", "b").select(F.col("vertex").alias("rep"), "component")
    named = classes.join(component, "rep", "left").select(*digest, F.coalesce("component", "rep").alias("component_id"), F.col("component").isNotNull().alias("linked"))
    found = made.join(named, digest, "left")
    return found.select(F.col("key").alias(key), "tag", "component_id", F.coalesce("linked", F.lit(False)).alias("linked"))


def _one_of_each(docs: DataFrame, found: DataFrame, text: str, key: str) -> DataFrame:
    """The documents without those whose component another key names."""
    own_key, own_tag, lost_key, lost_tag = fresh(docs, "_key", "_tag", "_lost_key", "_lost_tag")
    lost = materialize(found.where(F.col("component_id").isNotNull() & ~F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias(lost_key), F.col("tag").alias(lost_tag)), "near-copies")
    marked = docs.withColumns({own_key: F.col(key).cast("long"), own_tag: F.xxhash64(F.col(text))})
    # Only rows that pass a filter of the lost ones carry their texts into the join.
    maybe, sure = probe(marked, F.struct(own_key, own_tag), lost.select(F.struct(F.col(lost_key).alias(own_key), F.col(lost_tag).alias(own_tag)).alias("lost")), "lost")
    same = F.col(own_key).eqNullSafe(F.col(lost_key)) & (F.col(own_tag) == F.col(lost_tag))
    return sure.unionByName(maybe.join(lost, same, "left_anti")).drop(own_key, own_tag)


def drop_near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", budget: int = BUDGET, size: int = SHINGLE) -> DataFrame:
    """The documents whose key names their component of ``near_duplicates``, with all their columns: one of each group.

    Rows are told apart by key and text, so a key that repeats with other texts doesn't
    share the fate of its namesakes. Rows with a null key go where a row with a key is
    in their group, and stay otherwise. Rows that repeat the winning key stay with it:
    exact deduplication is the stage that drops those. Null and empty texts are one
    group. An empty table gives no rows.
    """
    return _one_of_each(docs, near_duplicates(docs, text, key, budget, tagged=True, size=size), text, key)


def drop_similar(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = WIDE_SHINGLE, whole: int = WIDE_BUDGET, share: tuple[int, int] = SIMILAR) -> DataFrame:
    """As ``drop_near_copies``, with the groups of ``similar_documents``: five-word shingles, a similarity of 0.8 or more."""
    return _one_of_each(docs, similar_documents(docs, text, key, size, whole, share=share), text, key)
