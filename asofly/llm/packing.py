"""Best-fit packing of token sequences by hierarchical residual rounds.

Every partition encodes its documents, cuts those over the capacity into pieces
and packs the pieces best-fit, longest first within a block; open bins are carried
from block to block. Bins that are nearly full are finished. Underfull bins become
the items of the next round: groups of partitions are merged as a tree, and each
group packs its bins best-fit again, whole bins into the space left in others, until
one group is left.

Pieces are written once, where they were packed. Only (bin, fill) travels through the
rounds, and a small table of the bins that moved tells pieces their last place.

A group hands on its emptiest bins, one more than there are bins at most half full in
all. That loses nothing: best-fit leaves at most one bin at most half full in a group,
two fuller ones never fit together, so no more bins than that can take another one, and
whatever fits into a bin fits into all emptier ones.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofly.llm.common import probe
from asofly.llm.words import library_cache, slices
from asofly.session import materialize, scratch_path, scratch_scope

#: A bin with at least this share of its capacity used is finished.
NEARLY_FULL = 0.995
#: Pieces that are sorted and packed at once; groups that a task of a round merges.
BLOCK_PIECES, FAN_IN = 200_000, 16

PIECES = "key long, piece int, start long, length long, ids_crc32 long, bin long, offset long"


class BestFit:
    """Bins of one capacity that take blocks of items, each longest first into the bin with the least space that holds it.

    The free spaces are small integers: bit ``r`` of a mask says that some bin has ``r`` left.
    """

    def __init__(self, capacity: int):
        self.capacity, self.count, self.mask = capacity, 0, 0
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, lengths: list[int]) -> tuple[list[int], list[int]]:
        """(bin, offset) of each item of a block."""
        bins, offsets = [0] * len(lengths), [0] * len(lengths)
        free, mask, capacity = self.free, self.mask, self.capacity
        for i in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
            size = lengths[i]
            fits = mask >> size
            if fits:
                space = size + (fits & -fits).bit_length() - 1
                at = free[space].pop()
                if not free[space]:
                    mask &= ~(1 << space)
            else:
                space, at = capacity, self.count
                self.count += 1
            bins[i], offsets[i] = at, capacity - space
            if left := space - size:
                free[left].append(at)
                mask |= 1 << left
        self.mask = mask
        return bins, offsets

    def open(self) -> list[tuple[int, int]]:
        """(bin, fill) of the bins that aren't nearly full, the emptiest first."""
        least = int(self.capacity - NEARLY_FULL * self.capacity)
        return [(at, self.capacity - space) for space in range(self.capacity, least, -1) for at in self.free[space]]


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of each item of one block."""
    return BestFit(capacity).place(lengths)


def merge_rounds(bins: DataFrame, tasks: int, capacity: int) -> DataFrame | None:
    """(bin, into, at): the bins that a round put into another, with their last place; None if there are none.

    ``bins`` (part, bin, fill) are the underfull bins of each first task, a written table.
    """
    hand_on = bins.where(F.col("fill") * 2 <= capacity).count() + 1
    if hand_on == 1:
        return None
    schema = "part long, bin long, fill long, into long, at long"

    def merge(group):
        import pandas as pd

        group = group.sort_values("bin")
        names, fills = group["bin"].tolist(), group["fill"].tolist()
        packer = BestFit(capacity)
        placed, offsets = packer.place(fills)
        first = {b: n for n, b, o in zip(names, placed, offsets, strict=True) if o == 0}
        moved = [(n, f, first[b], o) for n, f, b, o in zip(names, fills, placed, offsets, strict=True) if o]
        stay = [(first[b], f, None, None) for b, f in packer.open()[:hand_on]]
        out = pd.DataFrame(moved + stay, columns=["bin", "fill", "into", "at"]).astype({"into": "Int64", "at": "Int64"})
        out.insert(0, "part", int(group["part"].iloc[0]))
        return out

    rounds, level = [], bins
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        level = level.withColumn("part", F.expr(f"part div {FAN_IN}")).groupBy("part").applyInPandas(merge, schema)
        rounds.append(materialize(level, "packing-round"))
        level = rounds[-1].where("into is null").select("part", "bin", "fill")
    total = None
    for level in reversed(rounds):
        moves = level.where("into is not null").select("bin", "into", "at")
        if total is not None:
            # a bin that took others may itself have moved in a later round
            later = total.select(F.col("bin").alias("into"), F.col("into").alias("last"), F.col("at").alias("more"))
            moved_on = moves.join(later, "into", "left").select("bin", F.coalesce("last", "into").alias("into"), (F.col("at") + F.coalesce("more", F.lit(0))).alias("at"))
            moves = moved_on.unionByName(total)
        total = moves
    return total


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Sequences of at most ``capacity`` tokens: a row for each piece of each document.

    A document is its text's ids and then ``end_id``; null and empty texts are the
    one id ``end_id``. Only documents over the capacity are cut. Columns: key, piece
    (from 0), start (ids of the document before it), length, ids_crc32 (of its ids
    as little-endian unsigned 32-bit integers), sequence_id, offset (place in the
    sequence, gapless from 0). Repeated rows are packed each for itself, null keys
    stay null, and other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    tasks = max(1, source.rdd.getNumPartitions())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        cache, last, wide = library_cache(path), np.array([end_id], "<u4").tobytes(), 4 * capacity
        packer, rows = BestFit(capacity), []

        def table(keys, columns, underfull: bool) -> pa.RecordBatch:
            n = len(keys)
            kinds = (("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("bin", pa.int64()), ("offset", pa.int64()), ("part", pa.int64()))
            arrays = [pa.array(c, kind) for c, (_, kind) in zip([*columns, [part] * n], kinds, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *arrays, pa.array([underfull] * n, pa.bool_())], ["key", *(c for c, _ in kinds), "underfull"])

        def flush() -> pa.RecordBatch:
            keys, pieces, starts, lengths, sums = zip(*rows, strict=True)
            rows.clear()
            bins, offsets = packer.place(list(lengths))
            return table(keys, [pieces, starts, lengths, sums, [(part << 36) + b for b in bins], offsets], False)

        for batch in slices(batches):
            for doc, ids in zip(batch.column(0).to_pylist(), cache.pack(batch.column(1).to_pylist()), strict=True):
                ids += last
                for k in range(0, len(ids), wide):
                    piece = ids[k : k + wide]
                    rows.append((doc, k // wide, k // 4, len(piece) // 4, zlib.crc32(piece)))
            if len(rows) >= BLOCK_PIECES:
                yield flush()
        if rows:
            yield flush()
        if underfull := packer.open():
            bins, fills = zip(*underfull, strict=True)
            none = [None] * len(bins)
            yield table(none, [none, none, fills, none, [(part << 36) + b for b in bins], none], True)

    folder = scratch_path(spark, "packing")
    schema = f"{PIECES}, part long, underfull boolean"
    source.mapInArrow(run, schema).write.partitionBy("underfull").parquet(folder)
    written = spark.read.schema(schema).parquet(folder)
    pieces = written.where("not underfull").select("key", "piece", "start", "length", "ids_crc32", "bin", "offset")
    with scratch_scope(spark):
        moves = merge_rounds(written.where("underfull").select("part", "bin", F.col("length").alias("fill")), tasks, capacity)
        moves = None if moves is None else materialize(moves, "packing-moves", keep=True)
    if moves is not None:
        # Only pieces whose bin passes a filter of the moved ones are joined.
        maybe, pieces = probe(pieces, F.col("bin"), moves, "bin")
        told = maybe.join(moves, "bin", "left").select("key", "piece", "start", "length", "ids_crc32", F.coalesce("into", "bin").alias("bin"), (F.col("offset") + F.coalesce("at", F.lit(0))).alias("offset"))
        pieces = pieces.unionByName(told)
    return pieces.withColumnRenamed("key", key).withColumnRenamed("bin", "sequence_id")
