"""Near-duplicates with other shingle sizes and budgets, and similar documents, against brute force."""

import random

import numpy as np
import pytest
import xxhash

from asofly.llm.simhash import blocks, drop_near_copies, drop_similar, fingerprint, near_duplicates, similar_documents, similar_links
from asofly.session import scratch_path
from tests.llm.test_text import WORDS, lower

BASE = [f"w{i}" for i in range(300)]
TEXTS = {1: BASE, 2: [*BASE[:150], "other", *BASE[151:]], 3: [f"z{i}" for i in range(300)]}


def test_shingle_size_and_budget(spark):
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in TEXTS.items()], "doc_id long, text string")
    want = {k: fingerprint(" ".join(w), 5) for k, w in TEXTS.items()}
    budget = (want[1] ^ want[2]).bit_count()
    got = {r.doc_id: r for r in near_duplicates(docs, budget=budget, size=5).collect()}
    assert {k: int(r.fingerprint, 16) for k, r in got.items()} == want
    assert got[2].component_id == 1 and got[3].component_id == 3
    assert sorted(r.doc_id for r in drop_near_copies(docs, budget=budget, size=5).collect()) == [1, 3]


def shingles(text):
    words = WORDS.findall(lower(text))
    return [" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []


def brute_wide(text):
    """320 bits, a list of 0 and 1 in the order of their places: a shingle's XXH64 and four values mixed from it."""
    grams = shingles(text)
    ones = [0] * 320
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for k in range(5):
            x = h
            if k:
                x = (h + 0x9E3779B97F4A7C15 * k) % 2**64
                for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
                    x = (x ^ x >> 30) * factor % 2**64
                x ^= x >> 31
            for b in range(64):
                ones[64 * k + b] += x >> b & 1
    return [int(2 * n > len(grams)) for n in ones]


def components(keys, linked):
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def brute_similar(texts):
    """key -> least key reachable by links: candidates differ in at most 68 of all bits and at most two in one of the 13 paths
    of 24 bits; within a group of candidates, the sets of shingles of a link share 0.8 or more."""
    keys = sorted(texts)
    # a path is cut from the bytes as they lie in memory, the upper bit of each byte first
    prints = {k: np.array(brute_wide(texts[k])).reshape(40, 8)[:, ::-1].reshape(-1) for k in keys}
    sets = {k: set(shingles(texts[k])) for k in keys}

    def candidates(a, b):
        d = prints[a] != prints[b]
        return d.sum() <= 68 and (d[:312].reshape(13, 24).sum(axis=1) <= 2).any()

    group = components(keys, candidates)
    return components(keys, lambda a, b: group[a] == group[b] and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])))


def family(rnd, first, n, words=200, edits=12):
    """Texts made from one by replacing single words."""
    base = [f"v{rnd.randrange(5000)}" for _ in range(words)]
    out = {}
    for k in range(n):
        t = list(base)
        for _ in range(rnd.randint(0, edits)):
            t[rnd.randrange(words)] = f"e{rnd.randrange(10**6)}"
        out[first + k] = " ".join(t)
    return out


@pytest.mark.parametrize(("leaves", "pool"), [(4, 900), (100_000, 1_000_000)])
def test_similar_documents(spark, leaves, pool):
    """Small limits split the groups round by round, down to pairs of chunks, and change nothing."""
    rnd = random.Random(3)
    texts = family(rnd, 0, 25, edits=3) | family(rnd, 100, 10, edits=40) | {200 + k: " ".join(f"u{rnd.randrange(9999)}" for _ in range(50)) for k in range(15)}
    texts |= {300: "", 301: None, 302: "one two", 303: "ONE two", 304: "word " * 30_000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in similar_documents(docs, leaves=leaves, pool=pool).collect()}
    assert got == brute_similar(texts)
    assert len({got[k] for k in range(25)}) == 1 and all(got[k] == k for k in range(200, 215))


def test_similarity_of_links(spark):
    """Nearly all pairs of 0.8 or more are linked, and none below."""
    rnd = random.Random(8)
    texts = {}
    for k in range(120):
        texts |= family(rnd, 1000 * k, 2, edits=5)
    groups = {r.doc_id: r.component_id for r in similar_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    high = missed = low = 0
    for k in range(120):
        a, b = set(shingles(texts[1000 * k])), set(shingles(texts[1000 * k + 1]))
        near, linked = 5 * len(a & b) >= 4 * len(a | b), groups[1000 * k] == groups[1000 * k + 1]
        high += near
        missed += near and not linked
        low += linked and not near
    assert high >= 40 and missed <= 2 and low == 0


@pytest.mark.parametrize("n", [5, 40, 120])
def test_similar_links(n):
    """The forest joins what links join, for few and many sets; a share on the bound is a link."""
    rnd = random.Random(n)
    base = [rnd.sample(range(300), 40) for _ in range(3)]
    sets = [sorted({*rnd.sample(b, rnd.randint(30, 40)), *(rnd.randrange(300) for _ in range(rnd.randint(0, 6)))}) for b in base for _ in range(n // 3 + 1)][:n] + [[], [7]]
    sets += [list(range(1000, 1008)), list(range(1000, 1010)), list(range(2000, 2007)), list(range(2000, 2009))]
    member, root = similar_links([np.array(s, np.uint64) for s in sets])
    got = components(list(range(len(sets))), lambda a, b: (b, a) in set(zip(member.tolist(), root.tolist(), strict=True)))
    assert got == components(list(range(len(sets))), lambda a, b: 5 * len({*sets[a]} & {*sets[b]}) >= 4 * max(1, len({*sets[a]} | {*sets[b]})))


def test_drop_similar(spark):
    rnd = random.Random(5)
    texts = family(rnd, 10, 5, edits=3)
    rows = [*texts.items(), (1, "a lone text with a few words in it"), (1, texts[10]), (None, texts[11]), (None, "another text that nobody else has here")]
    got = drop_similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([rows[5], rows[6], rows[8]], key=str)
    assert drop_similar(got.limit(0)).count() == 0


def test_blocks():
    """Any two paths within the budget agree on one of the masks."""
    rnd = random.Random(1)
    for fixed, bits, budget in ((0, 64, 2), (0, 24, 2), (0xFF << 56, 24, 2), (0, 10, 3)):
        masks = blocks(fixed, bits, budget)
        assert len(masks) == budget + 1
        for _ in range(200):
            d = 0
            for _ in range(budget):
                d |= 1 << rnd.randrange(64 - bits, 64)
            assert any(not d & ~fixed & m for m in masks)


def test_nothing_is_left_in_the_shared_folder(spark):
    """Tables that only the walk reads are gone behind it."""
    import os

    folder = os.path.dirname(scratch_path(spark, "x")).removeprefix("file:")
    near_duplicates(spark.createDataFrame([(1, "a b c"), (2, "a b c d")], "doc_id long, text string")).count()
    assert not [n for n in os.listdir(folder) if n.startswith(("hot-groups", "trie-rows"))]
