"""Token counts by a map-side two-tier lookup.

Tier one is a broadcast table with the lengths (in tokens) of the most frequent
pre-tokens of a bounded sample of rows, tier two each worker's bounded cache, filled by
the library. The table only saves work: no count depends on which pre-tokens are in it.
No pre-token of the texts is shuffled; the sample's counters are merged as a tree of
packed sketches of fixed size.

A pre-token is a maximal run of spaces with what follows up to the next space or
line end. No piece of the vocabulary has anything before a space sign or beside a
line end (checked when the model is loaded), so merges never cross the cuts.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofly.llm.words import Generations, slices

SPACE = "▁"
SEGMENT = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*")

#: Entries of the broadcast table and of each sketch on the way to it; the longest pre-token kept in it.
TABLE_ENTRIES, TABLE_CHARS = 8192, 24
#: Rows of the sample that the table is made from, and entries of a task's sketch.
SAMPLE_ROWS, SKETCH_ENTRIES = 4000, 2048
#: Sketches merged by one task.
FAN_IN = 32


def split_segments(text: str) -> list[str]:
    """Pre-tokens of a text that isn't empty; each begins with the space sign (left out on the fast way) or a line end."""
    if "  " in text or " \n" in text or SPACE in text or text[0] in " \n" or text[-1] == " ":
        return SEGMENT.findall(SPACE + text.replace(" ", SPACE))
    return text.replace("\n", " \n").split(" ")


def to_pieces(segment: str) -> list[str]:
    """Model-ready parts of a pre-token as ``split_segments`` writes it: the fast way leaves out the space sign."""
    if segment[0] == "\n":
        return ["\n", segment[1:]] if len(segment) > 1 else ["\n"]
    return [segment] if segment[0] == SPACE else [SPACE + segment]


class PieceCounter:
    """Lengths in tokens of whole texts by one sentencepiece BPE model."""

    def __init__(self, path: str, table: dict[str, int] | None = None, limit: int = 300_000):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces:
            raise ValueError("pre-tokens can't be cut for this normaliser")
        if any((p.type == 1 and (re.search(f"[^{SPACE}]{SPACE}", p.piece) or "\n" in p.piece)) or p.type == 4 for p in proto.pieces):
            raise ValueError("pieces of this vocabulary cross the cuts of pre-tokens")
        spec.add_dummy_prefix = False
        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.table = table or {}
        self.cache = Generations(limit)

    def lengths(self, segments: list[str]) -> dict[str, int]:
        """Tokens of each of some distinct pre-tokens, by the library."""
        parts = [to_pieces(s) for s in segments]
        counts = iter([len(x) for x in self.model.encode([p for ps in parts for p in ps], num_threads=1)] if parts else [])
        return {s: sum(next(counts) for _ in ps) for s, ps in zip(segments, parts, strict=True)}

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; null counts as empty. The model adds a space before a text that isn't empty."""
        import gc

        gc.disable()
        try:
            out: list[int] = []
            for at in range(0, len(texts), 256):
                out += self._count(texts[at : at + 256])
            return out
        finally:
            gc.enable()

    def _count(self, texts: list[str | None]) -> list[int]:
        first, second = self.table.get, self.cache.young.get
        sums, rest = [], []
        for text in texts:
            found = list(map(first, segments := split_segments(text))) if text else []
            if None in found:
                left = [s for s, n in zip(segments, found, strict=True) if n is None]
                found = [n for n in found if n is not None]
                again = list(map(second, left))
                left = [s for s, n in zip(left, again, strict=True) if n is None]
                found += [n for n in again if n is not None]
            else:
                left = []
            sums.append(sum(found))
            rest.append(left)
        missing = set().union(*rest)
        fresh = {s: n for s in missing if (n := self.cache.old.get(s)) is not None}
        fresh |= self.lengths([s for s in missing if s not in fresh])
        for s, n in fresh.items():
            self.cache.put(s, n)
        return [n + sum(map(fresh.__getitem__, left)) for n, left in zip(sums, rest, strict=True)]


def _pack(counts: Counter, entries: int = TABLE_ENTRIES) -> str:
    return json.dumps(counts.most_common(entries), ensure_ascii=False, separators=(",", ":"))


@lru_cache(maxsize=1)
def worker_counter(path: str) -> PieceCounter:
    """The counter of a worker process, which keeps its cache from task to task."""
    return PieceCounter(path)


def frequent_segments(docs: DataFrame, text: str = "text") -> list[str]:
    """The most frequent pre-tokens of a sample of about ``SAMPLE_ROWS`` rows, by merging sketches.

    Each task counts its rows of the sample, whole texts; rounds of ``FAN_IN`` to one
    merge the tasks' sketches, until so few are left that their size on the driver has
    a fixed bound.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                if text:
                    counts.update(split_segments(text))
                    if len(counts) > 400_000:
                        counts = Counter(dict(counts.most_common(100_000)))
        short = Counter({s: n for s, n in counts.items() if len(s) <= TABLE_CHARS})
        if not short:
            return
        yield pa.RecordBatch.from_pydict({"slot": pa.array([TaskContext.get().partitionId()], pa.int64()), "sketch": [_pack(short, SKETCH_ENTRIES)]})

    def merge(group):
        import pandas as pd

        counts: Counter = Counter()
        for x in group["sketch"]:
            for s, n in json.loads(x):
                counts[s] += n
        return pd.DataFrame({"slot": [int(group["slot"].iloc[0])], "sketch": [_pack(counts)]})

    n = docs.count()
    source = docs.select(text) if n <= SAMPLE_ROWS else docs.select(text).sample(SAMPLE_ROWS / n, seed=1)
    tasks = source.rdd.getNumPartitions()
    level = source.mapInArrow(sketch, "slot long, sketch string")
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        level = level.withColumn("slot", F.expr(f"slot div {FAN_IN}")).groupBy("slot").applyInPandas(merge, "slot long, sketch string")
    counts: Counter = Counter()
    for row in level.select("sketch").collect():  # at most FAN_IN rows of at most TABLE_ENTRIES entries
        for s, n in json.loads(row.sketch):
            counts[s] += n
    return [s for s, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:TABLE_ENTRIES]]


def token_counts(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", limit: int = 4096) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit of every text, without begin, end or added special tokens.

    Null and empty texts have no bytes and no tokens. Repeated rows give repeated
    results, null keys stay null, and other columns are not read. A text is counted
    whole, however long; an empty table gives no rows.
    """
    table = PieceCounter(path).lengths(frequent_segments(docs, text))
    shared = docs.sparkSession.sparkContext.broadcast(table)
    source = docs.select(
        F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_counter(path)
        counter.table = shared.value
        for batch in slices(batches):
            n = counter.count(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["key", "n_bytes", "n_tokens", "over_limit"]
            )

    return source.mapInArrow(run, "key long, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("key", key)
