"""Word-level encoding of the lower-casing, word-end BPE tokenizer.

The tokenizer's normaliser and splitter never join text across white space, and
inside it they cut letters, single digits and runs of other characters apart, so
the ids of a text are the ids of its words in a row. A worker therefore encodes
each distinct word once and joins packed bytes.

Texts whose characters all lie in a plain range (below) are split by one regular
expression; any other text is cut at white space, plain pieces of it are split alike, and
the others go to the tokenizers library whole.
"""

from __future__ import annotations

import gc
import re
import struct
from collections.abc import Callable, Iterable
from functools import lru_cache

# Characters that neither NFC nor lower-casing treats specially and whose class is the same in all Unicode
# versions: ASCII without the separators 1C-1F, Latin letters, common punctuation and currency signs.
_LETTERS = "a-zA-ZÀ-ÖØ-öø-įı-ſ"
_OTHERS = "¡-©«-±´¶-¸»¿×÷‐-‧‰-⁞₠-₿"
UNUSUAL = re.compile(f"[^\\x00-\\x1b\\x20-\\x7f{_LETTERS}{_OTHERS}]")
WORD = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]"
    "|[^\\s0-9a-zß-öø-ſ]+"
)
#: The same for texts without an apostrophe.
PLAIN_WORD = re.compile("[a-zß-öø-ſ]+|[0-9]|[^\\s0-9a-zß-öø-ſ]+")
#: What may stand inside a special token; texts that hold such a string take the library's way.
SPECIAL = re.compile(r"<\|(?:startoftext|endoftext)\|>")
WHITE = re.compile(r"[\t-\r\x20\x85\xa0  -     　]+")


def split_words(text: str) -> list[str] | None:
    """Words of a text or a piece of one; None if only the library can split it."""
    if text.isascii():
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
            return None
    elif UNUSUAL.search(text):
        return None
    if "<|" in text and SPECIAL.search(text):
        return None
    low = text.lower()
    return (WORD if "'" in low else PLAIN_WORD).findall(low)


def units(text: str) -> list[str]:
    """What a text is encoded by: its words, and with a space before them the pieces that only the library can split."""
    if (words := split_words(text)) is not None:
        return words
    out: list[str] = []
    for piece in split_white(text):
        words = split_words(piece)
        if words is None:
            out.append(f" {piece}")
        else:
            out += words
    return out


def split_white(text: str) -> list[str]:
    """Pieces of ``text`` between what the tokenizer holds for white space."""
    # str.split also cuts at 1C-1F, which the tokenizer keeps
    if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        return [x for x in WHITE.split(text) if x]
    return text.split()


#: Bytes that an entry of a map takes beside its text and value, about; entries of more bytes than that are not kept.
ENTRY_BYTES, LONG_ENTRY = 180, 2048


class Generations:
    """Map in two generations, bounded in entries and bytes: a full young one becomes the old one, whose entries move back when used."""

    def __init__(self, limit: int, most_bytes: int = 40 << 20):
        self.limit, self.most_bytes = limit, most_bytes
        self.size = 0
        self.young: dict = {}
        self.old: dict = {}

    def get(self, key: str):
        """Value of a key that the young generation lacks or has."""
        if (known := self.young.get(key)) is None and (known := self.old.get(key)) is not None:
            self.put(key, known)
        return known

    def put(self, key: str, value) -> None:
        n = ENTRY_BYTES + len(key) * (1 if key.isascii() else 2) + (len(value) if isinstance(value, bytes) else 0)
        if n > LONG_ENTRY:
            return  # long pieces hardly come again
        if len(self.young) >= self.limit or self.size > self.most_bytes:
            self.old, self.young, self.size = self.young, {}, 0
        self.young[key] = value
        self.size += n


class WordCache:
    """Texts to packed ids (little-endian unsigned 32-bit) by way of a bounded cache of words.

    ``encode`` gets distinct words and returns their packed ids; ``encode_whole``
    does so for pieces that must not be split here.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], encode_whole: Callable[[list[str]], list[bytes]], limit: int = 300_000):
        self.encode, self.encode_whole = encode, encode_whole
        self.known = Generations(limit)

    def pack(self, texts: Iterable[str | None], block_words: int = 200_000) -> list[bytes]:
        """Packed ids of each text; null counts as empty."""
        # Blocks are many small live objects and no cycles: the collector would walk them again and again.
        gc.disable()
        try:
            return self._pack(texts, block_words)
        finally:
            gc.enable()

    def _pack(self, texts: Iterable[str | None], block_words: int) -> list[bytes]:
        out: list[bytes] = []
        block: list[tuple[list[str], list[bytes | None]]] = []
        size = 0
        for text in texts:
            words = units(text) if text else []
            block.append((words, list(map(self.known.young.get, words))))
            size += len(words)
            if size > block_words:
                out += self._fill(block)
                block, size = [], 0
        return out + self._fill(block)

    def _fill(self, block: list[tuple[list[str], list[bytes | None]]]) -> list[bytes]:
        gaps = [[i for i, ids in enumerate(parts) if ids is None] for _, parts in block]
        missing = {words[i] for (words, _), at in zip(block, gaps, strict=True) for i in at}
        fresh = self._learn(missing) if missing else {}
        out = []
        for (words, parts), at in zip(block, gaps, strict=True):
            for i in at:
                parts[i] = fresh[words[i]]
            out.append(b"".join(parts))
        return out

    def _learn(self, missing: set[str]) -> dict[str, bytes]:
        old = self.known.old.get
        found = {w: old(w) for w in missing}
        new = [w for w, ids in found.items() if ids is None]
        words, whole = [w for w in new if w[0] != " "], [w for w in new if w[0] == " "]
        found.update(zip(words, self.encode(words) if words else [], strict=True))
        found.update(zip(whole, self.encode_whole([w[1:] for w in whole]) if whole else [], strict=True))
        for w, ids in found.items():
            self.known.put(w, ids)
        return found


def slices(batches: Iterable, rows: int = 2048):
    """The batches in slices of a few rows, so that a worker holds few texts as Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: Words that go to the library in one text.
TEXT_WORDS = 200


@lru_cache(maxsize=1)
def _load(path: str):
    """The library's tokenizer, unused truncation and padding; one a worker. One thread: the executor's cores are Spark's."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def library_whole(path: str) -> Callable[[list[str]], list[bytes]]:
    """Encode each text on its own."""
    import numpy as np

    tok = _load(path)

    def encode(texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in tok.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    return encode


def library_words(path: str) -> Callable[[list[str]], list[bytes]]:
    """Encode distinct words: printable ASCII ones by the library's model alone, others many to a text.

    The steps before the model leave a lower-cased word of printable ASCII as it is (bytes
    33 to 126 stand for themselves). In a text the last token of a word carries the word
    end, which cuts the ids apart.
    """
    in_texts, tokenize, pack = _words_in_texts(path), _load(path).model.tokenize, struct.pack

    def encode(words: list[str]) -> list[bytes]:
        plain = [w.isascii() and w.isprintable() for w in words]
        others = iter(in_texts([w for w, is_plain in zip(words, plain, strict=True) if not is_plain]))
        out: list[bytes] = []
        for w, is_plain in zip(words, plain, strict=True):
            if is_plain:
                tokens = tokenize(w)
                out.append(pack(f"<{len(tokens)}I", *[t.id for t in tokens]))
            else:
                out.append(next(others))
        return out

    return encode


def _words_in_texts(path: str) -> Callable[[list[str]], list[bytes]]:
    import numpy as np

    tok = _load(path)
    ends = np.zeros(tok.get_vocab_size(), bool)
    for token, i in tok.get_vocab().items():
        ends[i] = token.endswith("</w>")

    def encode(words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(words), 64 * TEXT_WORDS):
            part = words[at : at + 64 * TEXT_WORDS]
            texts = [" ".join(part[k : k + TEXT_WORDS]) for k in range(0, len(part), TEXT_WORDS)]
            ids = np.concatenate([np.asarray(e.ids, "<u4") for e in tok.encode_batch_fast(texts, add_special_tokens=False)])
            cut = (4 * (np.flatnonzero(ends[ids]) + 1)).tolist()
            if len(cut) != len(part):
                raise ValueError("the tokenizer doesn't end each word with a word-end token")
            packed = ids.tobytes()
            out += [packed[a:b] for a, b in zip([0, *cut], cut, strict=False)]
        return out

    return encode


@lru_cache(maxsize=1)
def library_cache(path: str, limit: int = 300_000) -> WordCache:
    """A cache filled by the library. A worker process keeps it from task to task."""
    return WordCache(library_words(path), library_whole(path), limit)
