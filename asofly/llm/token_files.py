"""Token ids as flat unsigned integer files with 64-bit document offsets.

A data set is a folder of parts in ascending key order. A part has

* ``NAME.ids``: the ids of its documents one after another, little-endian unsigned
  16- or 32-bit (the smaller that holds the vocabulary), and nothing else;
* ``NAME.off``: for each document two little-endian signed 64-bit integers, its
  key and the index in ``NAME.ids`` of the first id behind it.

Texts are encoded where they lie; only packed ids travel to their place in the order.
Both files of a part carry the name of the task attempt that wrote them, and the
table of parts, which Spark commits once, says which attempt counts: a repeated task
can't leave one file of each. Prefix sums over the parts' totals (one row a part) give
each part's base, the number of ids in all parts before it. Files are memory-mapped
where the folder is local to the reader, and read whole from any other store.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofly.llm.words import library_cache, slices
from asofly.session import materialize, scratch_path

PARTS = pa.schema([("part", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_null", pa.int64())])
#: Bytes of ids in a part: the most, and the least that is split off to give all cores work.
MOST_BYTES, LEAST_BYTES = 256 << 20, 8 << 20


@dataclass(frozen=True)
class Part:
    """A part's files, the number of ids before it, its documents, and how many of its first ones have a null key."""

    name: str
    base: int
    n_docs: int
    n_null: int


def _open_fs(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def id_type(path: str) -> str:
    """numpy type of the ids of a vocabulary file."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


#: Keys sampled for each part to find the parts' bounds.
SAMPLED_KEYS = 50


def parts_for(n_bytes: int, tasks: int) -> int:
    """Parts for so many bytes of ids: enough for all tasks where there are bytes enough, and none too large."""
    return max(1, -(-n_bytes // MOST_BYTES), min(tasks, -(-n_bytes // LEAST_BYTES)))


def _place(row) -> tuple[int, int, int]:
    """Order of a (key, hash of the text): null keys first, rows of one key by hash."""
    return (row[0] is not None, row[0] or 0, row[1])


def part_bounds(rows: DataFrame, n: int, count: int) -> list[tuple[int, int, int]]:
    """The first places of the parts behind the first, from a sample of (key, hash): some keys for each part, on the driver."""
    share = min(1.0, SAMPLED_KEYS * n / max(count, 1))
    places = sorted(map(_place, rows.sample(share, seed=1).collect() if share < 1 else rows.collect()))
    return sorted({places[len(places) * k // n] for k in range(1, n)}) if places else []


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int = 1, text: str = "text", key: str = "doc_id", partitions: int | None = None) -> DataFrame:
    """Encode ``docs`` and write the parts in ascending key order; (part, name, n_docs, n_ids, n_null) for each.

    The parts' bounds come from a sample of keys, so each text is encoded once, where it
    lies, and only its packed ids are shuffled. Null texts are empty; null keys sort first,
    and their number is kept beside the part. Rows with equal keys are ordered by a hash
    of their text and their ids, so a repeated task writes the same again, and many rows of
    one key spread over parts. An empty table has no parts.
    """
    spark = docs.sparkSession
    width = id_type(path)
    source = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"), F.col(text).alias("text"))
    size = source.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    # a token is about four bytes of text, and two of ids
    n = partitions or parts_for((size.bytes or 0) // 2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = part_bounds(source.select("key", "hash"), n, size.n)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_right

        import numpy as np

        cache, last = library_cache(path), np.array([end_id], "<u4").tobytes()
        for batch in slices(batches):
            places = map(_place, zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            part = pa.array([bisect_right(bounds, place) for place in places], pa.int32())
            ids = pa.array([np.frombuffer(x + last, "<u4").astype(width).tobytes() for x in cache.pack(batch.column(2).to_pylist())], pa.binary())
            yield pa.RecordBatch.from_arrays([part, batch.column(0), batch.column(1), ids], ["part", "key", "hash", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid
        from contextlib import ExitStack
        from itertools import groupby

        import numpy as np

        def rows():
            for batch in slices(batches):
                yield from zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)

        store, root = _open_fs(folder)
        store.create_dir(root, recursive=True)
        item = np.dtype(width).itemsize
        for part, group in groupby(rows(), lambda row: row[0]):
            name = f"part-{part:06d}-{uuid.uuid4().hex}"
            n_docs = n_ids = n_null = 0
            with ExitStack() as stack:
                ids, off = (stack.enter_context(store.open_output_stream(f"{root}/{name}.{kind}", buffer_size=1 << 20)) for kind in ("ids", "off"))
                for _, k, packed in group:
                    n_docs, n_ids, n_null = n_docs + 1, n_ids + len(packed) // item, n_null + (k is None)
                    ids.write(packed)
                    off.write(np.array([k or 0, n_ids], "<i8").tobytes())
            yield pa.RecordBatch.from_pylist([{"part": part, "name": name, "n_docs": n_docs, "n_ids": n_ids, "n_null": n_null}], PARTS)

    packed = source.mapInArrow(encode, "part int, key long, hash long, ids binary").repartitionById(n, "part")
    ordered = packed.sortWithinPartitions("part", F.col("key").asc_nulls_first(), "hash", "ids").select("part", "key", "ids")
    return materialize(ordered.mapInArrow(write, "part int, name string, n_docs long, n_ids long, n_null long"), "token-parts", keep=True)


def part_bases(parts: DataFrame) -> list[Part]:
    """The parts in order, each with its base, by a prefix sum: a row for each file on the driver, never one for a document."""
    out, base = [], 0
    for row in sorted(parts.collect(), key=lambda r: r.part):
        out.append(Part(row.name, base, row.n_docs, row.n_null))
        base += row.n_ids
    return out


def read_token_files(spark: SparkSession, folder: str, parts: list[Part], width: str, key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens and ids_crc32 of every document, from the files.

    ``start`` is the number of ids before the document in the whole data set,
    ``ids_crc32`` the checksum of its ids as little-endian unsigned 32-bit integers.
    """
    todo = spark.createDataFrame([(p.name, p.base, p.n_docs, p.n_null) for p in parts], "name string, base long, n_docs long, n_null long")
    todo = todo.repartition(max(1, min(len(parts), 4096)), "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyarrow import fs

        store, root = _open_fs(folder)
        local = isinstance(store, fs.LocalFileSystem)

        def load(name: str, kind: str) -> np.ndarray:
            if local:
                return np.memmap(name, kind, "r")
            with store.open_input_file(name) as f:
                return np.frombuffer(f.read(), kind)

        for batch in batches:
            for part in batch.to_pylist():
                ids = load(f"{root}/{part['name']}.ids", width)
                table = load(f"{root}/{part['name']}.off", "<i8").reshape(-1, 2)
                if len(table) != part["n_docs"]:
                    raise OSError(f"{part['name']} holds {len(table)} documents instead of {part['n_docs']}")
                for a in range(0, len(table), 8192):
                    end = np.asarray(table[a : a + 8192, 1])
                    start = np.concatenate([[table[a - 1, 1] if a else 0], end[:-1]])
                    sums = [zlib.crc32(np.ascontiguousarray(ids[x:y], "<u4")) for x, y in zip(start.tolist(), end.tolist(), strict=True)]
                    null = np.arange(a, a + len(end)) < part["n_null"]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.asarray(table[a : a + 8192, 0]), pa.int64(), mask=null), pa.array(part["base"] + start), pa.array(end - start), pa.array(sums, pa.int64())], ["key", "start", "n_tokens", "ids_crc32"]
                    )

    return todo.mapInArrow(run, "key long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("key", key)


def token_files(docs: DataFrame, path: str, end_id: int = 1, text: str = "text", key: str = "doc_id", folder: str | None = None) -> DataFrame:
    """Write the token files of ``docs`` and read every document back from them: key, start, n_tokens, ids_crc32.

    Null and empty texts are the one id ``end_id``; a long text is one document however
    long. Repeated rows and rows with equal keys are documents of their own; null keys
    come first and stay null. Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token-files")
    parts = write_token_files(docs, folder, path, end_id, text, key)
    return read_token_files(spark, folder, part_bases(parts), id_type(path), key)
