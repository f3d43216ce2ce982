"""BPE encoding of distinct words by a depth-first walk over their trie.

The encoding of a text ends, at every prefix, with one token: the longest token
that ends there and is *compatible* with the last token of the prefix before it.
(Two tokens are compatible when BPE leaves their joined text as exactly these
two.) A node of the trie of words therefore needs one number, its last token, and
words that share a prefix share the walk to it. Words are visited in sorted
order, which is the depth-first order of their trie; the states of the current
path are a stack.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofly.llm.words import SPECIAL, WordCache, slices


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: printable Latin-1 stays, the rest follow from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (chr(0x100 + k) for k in range(256))
    return [chr(b) if b in plain else next(rest) for b in range(256)]


class BpeTrie:
    """Encoder and decoder for a byte-level BPE vocabulary file with a word-end suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = dict(model["vocab"])
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*self.ids.values(), *self.special.values()]) + 1
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # rank: symbols first, then merged tokens in the order in which BPE makes them
        made = {a + b for a, b in merges}
        self.rank = [0] * size
        n = 0
        for token, i in self.ids.items():
            if token not in made:
                self.rank[i] = n
                n += 1
        self.left, self.right = list(range(size)), list(range(size))
        self.joined: dict[tuple[int, int], int] = {}
        for k, (a, b) in enumerate(merges):
            i = self.ids[a + b]
            if i == self.ids[a] or i == self.ids[b] or (self.ids[a], self.ids[b]) in self.joined:
                raise ValueError("the vocabulary makes a token in more than one way")
            self.rank[i] = n + k
            self.left[i], self.right[i] = self.ids[a], self.ids[b]
            self.joined[self.ids[a], self.ids[b]] = i
        self.longest = max(len(t.removesuffix(self.suffix)) for t in self.ids)
        self.text: list[str] = [""] * size
        for token, i in [*self.ids.items(), *self.special.items()]:
            self.text[i] = token
        self.chars = [len(t.removesuffix(self.suffix)) for t in self.text]
        self.bytes: list[bytes] = [t.encode("utf-8") for t in self.text]
        self.table = str.maketrans({chr(b): x for b, x in enumerate(byte_letters())})
        self.known: dict[int, bool] = {}

    def compatible(self, first: int, second: int) -> bool:
        """Whether BPE of the two tokens' joined text is exactly these two tokens.

        Undo the later of the merges that made the neighbours of the boundary,
        again and again; a merge across the boundary that would have come before
        the one just undone shows that BPE would have joined them there.
        """
        key = first << 20 | second
        if (seen := self.known.get(key)) is not None:
            return seen
        rank, left, right, joined = self.rank, self.left, self.right, self.joined
        a, b, limit, good = first, second, 1 << 60, True
        while True:
            over = joined.get((a, b))
            if over is not None and rank[over] < limit:
                good = False
                break
            # Undo the later merge of the two neighbours; a symbol has none, so then the other's.
            # Of equal ranks the left token's merge came first, hence the + 1 on the right one's.
            undo_left = rank[a] > rank[b]
            if undo_left and right[a] == a or not undo_left and left[b] == b:
                undo_left = not undo_left
            if undo_left:
                if right[a] == a:
                    break
                limit, a = rank[a], right[a]
            else:
                if left[b] == b:
                    break
                limit, b = rank[b] + 1, left[b]
        if len(self.known) > 400_000:
            self.known.clear()
        self.known[key] = good
        return good

    def encode_letters(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """(word, ids) of distinct words in byte letters, in sorted order: the walk over their trie."""
        ids, longest, suffix, chars = self.ids, self.longest, self.suffix, self.chars
        compatible, get = self.compatible, self.ids.get
        path, last = "", [-1]  # last[i]: last token of the first i letters of path
        for word in sorted(words):
            top = min(len(word) - 1, len(last) - 1)
            keep = 0
            while keep < top and word[keep] == path[keep]:
                keep += 1
            del last[keep + 1 :]
            end = len(word)
            for i in range(keep + 1, end):
                for k in range(max(0, i - longest), i):
                    token = get(word[k:i])
                    if token is not None and (k == 0 or compatible(last[k], token)):
                        last.append(token)
                        break
                else:
                    raise ValueError(f"no token for {word[i - 1]!r}")
            path = word
            for k in range(max(0, end - longest), end):
                token = get(word[k:] + suffix)
                if token is not None and (k == 0 or compatible(last[k], token)):
                    break
            else:
                raise ValueError(f"no token for {word[-1]!r} at a word's end")
            out = [token]
            while k:
                out.append(last[k])
                k -= chars[last[k]]
            out.reverse()
            yield word, out

    def pack_words(self, words: list[str]) -> list[bytes]:
        """Packed ids of distinct words."""
        import numpy as np

        table = self.table
        # printable ASCII stands for itself, all other bytes have letters of their own
        letters = [w if w.isascii() and w.isprintable() else w.encode("utf-8").decode("latin-1").translate(table) for w in words]
        found = {w: np.array(ids, "<u4").tobytes() for w, ids in self.encode_letters(list(set(letters)))}
        return [found[x] for x in letters]

    def decode(self, ids: Iterable[int]) -> bytes:
        """Text of ids, special tokens kept: without a decoder in its file the library joins tokens by spaces."""
        return b" ".join(map(self.bytes.__getitem__, ids))


@lru_cache(maxsize=1)
def trie_cache(path: str, limit: int = 300_000) -> WordCache:
    """Piece and word caches filled by the trie walk; the library only normalises and splits unusual pieces. A worker keeps them from task to task."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import numpy as np
    from tokenizers import Tokenizer

    trie, tok = BpeTrie(path), Tokenizer.from_file(path)

    def whole(pieces: list[str]) -> list[bytes]:
        out = []
        for piece in pieces:
            packed, at = b"", 0
            for m in [*SPECIAL.finditer(piece), None]:
                plain = piece[at : m.start()] if m else piece[at:]
                letters = [w for w, _ in tok.pre_tokenizer.pre_tokenize_str(tok.normalizer.normalize_str(plain))] if plain else []
                ids = dict(trie.encode_letters(list(set(letters))))
                packed += b"".join(np.array(ids[w], "<u4").tobytes() for w in letters)
                if m:
                    packed += np.array([trie.special[m[0]]], "<u4").tobytes()
                    at = m.end()
            out.append(packed)
        return out

    cache = WordCache(trie.pack_words, whole, limit)
    cache.trie = trie
    return cache


def bpe_round_trip(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode every text and decode it again: key, n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts have no tokens and decode to the empty text. Repeated rows
    give repeated results, null keys stay null, and other columns are not read. A text
    is encoded whole, however long; an empty table gives no rows.
    """
    fields = "key long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    source = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        import numpy as np

        cache = trie_cache(path)
        decode = cache.trie.decode
        for batch in slices(batches):
            packed = cache.pack(batch.column(1).to_pylist())
            ids = [np.frombuffer(x, "<u4") for x in packed]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in packed]),
                    pa.array([hashlib.sha256(decode(x.tolist())).hexdigest() for x in ids]),
                ],
                ["key", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return source.mapInArrow(run, fields).withColumnRenamed("key", key)
