"""Encoders, counts, files and packing against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from asofly.llm import packing, token_counts, words
from asofly.llm.bpe_trie import BpeTrie, bpe_round_trip, trie_cache
from asofly.llm.packing import best_fit, pack_documents
from asofly.llm.token_counts import PieceCounter
from asofly.llm.token_files import token_files
from asofly.llm.vocab import PIECE_BPE, WORD_BPE, tokenizer_path

ODD = [
    "", " ", "\n", "a<|endoftext|>B c", "ΣΑΣ ς  x\x1cy", "é é", "　x y z²½ ª", "it's 's''s <|ENDOFTEXT|>", "İ İ", "K Å", "<|startoftext|><|endoftext|>", "x\x85y\x00z", "中文字 abc日本",
    "👩‍👩‍👧 x", "​zz﻿", " ' s", "don't_stop__x12", "ſ ŉ", "x́ a\ńb", "a  b\n\n c d \n", "A" * 3000, "IT'S WE'LL", "▁ ▁▁ x▁y", "  lead", "trail  ", "a\tb\r\nc",
    "<s> </s> <unk>", "word " * 5000,
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path(WORD_BPE))
    return lambda text: tok.encode(text or "", add_special_tokens=False).ids, lambda ids: tok.decode(ids, skip_special_tokens=False)


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECE_BPE))
    return lambda text: len(model.encode(text or ""))


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(1000 + i, t) for i, t in enumerate([*ODD, None, "same", "same"])], "doc_id long, text string")
    # extra columns with names that the operators use inside
    return real.unionByName(odd).withColumn("key", F.lit("x")).withColumn("part", F.lit(1)).withColumn("bin", F.lit(2)).cache()


def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.mark.parametrize("make", [words.library_cache, trie_cache])
def test_words_equal_library(make, library):
    cache = make(tokenizer_path(WORD_BPE), 50)
    for text, packed in zip(ODD, cache.pack(ODD), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == library[0](text), text


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_any_text_equals_library(library, found):
    cache = trie_cache_once()
    for text, packed in zip(found, cache.pack(found), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == library[0](text)


_CACHE = []


def trie_cache_once():
    if not _CACHE:
        _CACHE.append(trie_cache(tokenizer_path(WORD_BPE)))
    return _CACHE[0]


def test_caches_are_bounded_in_bytes():
    """Long pieces aren't kept, and many short ones push out old generations."""
    g = words.Generations(10**9, 100_000)
    for k in range(5000):
        g.put(f"piece{k}", b"12345678")
        g.put("x" * 5000 + str(k), b"1")
    assert max(len(g.young), len(g.old)) <= 600 and not any(len(x) > 100 for x in [*g.young, *g.old])
    assert g.get("piece4999") == b"12345678"


def test_every_vocabulary_word_is_itself():
    trie = BpeTrie(tokenizer_path(WORD_BPE))
    whole = {t.removesuffix("</w>"): i for t, i in trie.ids.items() if t.endswith("</w>") and t != "</w>"}
    assert all(ids == [whole[w]] for w, ids in trie.encode_letters(list(whole)))


def test_round_trip(docs, library):
    body = texts(docs)
    rows = bpe_round_trip(docs, tokenizer_path(WORD_BPE)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        ids = library[0](body[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library[1](ids).encode()).hexdigest()


def test_counts(docs, pieces):
    body = texts(docs)
    rows = token_counts.token_counts(docs, tokenizer_path(PIECE_BPE), limit=100).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.n_tokens == pieces(body[r.doc_id]), body[r.doc_id]
        assert r.n_bytes == len((body[r.doc_id] or "").encode())
        assert r.over_limit == (r.n_tokens > 100)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n▁ab.é中<"), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=5))
def test_any_count_equals_library(pieces, found):
    if not _COUNTER:
        _COUNTER.append(PieceCounter(tokenizer_path(PIECE_BPE), {"the": 1}, limit=20))
    assert _COUNTER[0].count(found) == [pieces(t) for t in found]


_COUNTER: list = []


def test_sketch_tree(docs, monkeypatch):
    monkeypatch.setattr(token_counts, "FAN_IN", 2)
    top = token_counts.frequent_segments(docs.repartition(9))
    assert "the" in top and len(top) <= token_counts.TABLE_ENTRIES


def test_files(docs, library):
    body = texts(docs)
    start = 0
    for r in token_files(docs, tokenizer_path(WORD_BPE)).orderBy("doc_id").collect():
        ids = [*library[0](body[r.doc_id]), 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert start > 0


def test_files_order_and_parts(spark, library, monkeypatch):
    """Many rows of one key spread over parts, null keys come first, the smallest long is a key like any other, and only listed files count."""
    import os

    from asofly.llm import token_files as T

    monkeypatch.setattr(T, "LEAST_BYTES", 64)
    rows = [(7, f"same key {k}") for k in range(60)] + [(None, "b c"), (None, "a"), (-(2**63), "least"), (3, "x y"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path, folder = tokenizer_path(WORD_BPE), T.scratch_path(spark, "files-test")
    parts = T.part_bases(T.write_token_files(docs, folder, path))
    with open(f"{folder.removeprefix('file:')}/part-000000-lost.ids", "wb") as f:
        f.write(b"attempt that failed")
    assert len(parts) >= 3 and len(os.listdir(folder.removeprefix("file:"))) >= 2 * len(parts) + 1
    got = sorted(T.read_token_files(spark, folder, parts, T.id_type(path)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, -(2**63), 3, *[7] * 60, 9]
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    sums = lambda rs: sorted(rs, key=str)
    assert sums((r.doc_id, r.ids_crc32) for r in got) == sums((k, zlib.crc32(np.array([*library[0](t), 1], "<u4").tobytes())) for k, t in rows)
    assert T.parts_for(0, 8) == 1 and T.parts_for(10 * T.MOST_BYTES, 4) == 10


def check_packing(rows, body, library, capacity):
    seen: dict = {}
    for r in rows:
        ids = [*library[0](body[r.doc_id]), 1]
        assert r.start == capacity * r.piece and r.length == min(capacity, len(ids) - r.start) > 0
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        seen.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seen.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert sum(r.length for r in rows) == sum(len(library[0](t)) + 1 for t in body.values())
    return len(seen)


def test_packing(docs, library, monkeypatch):
    body = texts(docs)
    total = sum(len(library[0](t)) + 1 for t in body.values())
    rows = pack_documents(docs.repartition(7), tokenizer_path(WORD_BPE), capacity=512).collect()
    n = check_packing(rows, body, library, 512)
    assert n <= 1.02 * -(-total // 512) + 1
    monkeypatch.setattr(packing, "FAN_IN", 2)
    monkeypatch.setattr(packing, "BLOCK_PIECES", 20)
    again = pack_documents(docs.repartition(7), tokenizer_path(WORD_BPE), capacity=512).collect()
    assert check_packing(again, body, library, 512) <= n + 1


def test_rounds_lose_nothing(spark):
    """The rounds leave as many bins as best-fit over all bins with every one handed on, whatever the tree; offsets stay gapless."""
    rnd = random.Random(2)
    for fan, parts, size in ((2, 40, 3), (16, 40, 3), (3, 30, 20), (2, 17, 1)):
        fills = []
        for part in range(parts):
            packer = packing.BestFit(100)
            packer.place([rnd.randint(1, 70) for _ in range(rnd.randint(0, size))])
            fills += [(part, (part << 36) + b, f) for b, f in packer.open()]
        packing.FAN_IN, before = fan, packing.FAN_IN
        try:
            moves = packing.merge_rounds(spark.createDataFrame(fills, "part long, bin long, fill long").repartition(3), parts, 100)
            moved = {r.bin: (r.into, r["at"]) for r in (moves.collect() if moves else [])}
        finally:
            packing.FAN_IN = before
        of: dict = {}
        for _, b, f in fills:
            into, at = moved.get(b, (b, 0))
            of.setdefault(into, []).append((at, f))
        for placed in of.values():
            at = 0
            for offset, f in sorted(placed):
                assert offset == at
                at += f
            assert at <= 100
        # no bin is left that another one could take
        left = sorted(sum(f for _, f in placed) for placed in of.values())
        assert len(left) < 2 or left[0] + left[1] > 100


@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit(sizes):
    bins, offsets = best_fit(sizes, 50)
    fill: dict = {}
    for i, b in enumerate(bins):
        fill.setdefault(b, []).append((offsets[i], sizes[i]))
    for parts in fill.values():
        assert sum(s for _, s in parts) <= 50
        assert [o for o, _ in sorted(parts)] == [sum(s for _, s in sorted(parts)[:k]) for k in range(len(parts))]
    # any-fit: at most one bin is half empty
    assert sum(sum(s for _, s in p) * 2 <= 50 for p in fill.values()) <= 1


def test_empty_and_null(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    nulls = spark.createDataFrame([(None, None), (None, "a b"), (1, None), (1, None)], "doc_id long, text string")
    path, model = tokenizer_path(WORD_BPE), tokenizer_path(PIECE_BPE)
    for f in (lambda d: bpe_round_trip(d, path), lambda d: token_counts.token_counts(d, model), lambda d: token_files(d, path), lambda d: pack_documents(d, path)):
        assert f(none).count() == 0
        rows = f(nulls).collect()
        assert sorted(str(r.doc_id) for r in rows) == ["1", "1", "None", "None"]
