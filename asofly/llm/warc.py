"""WARC archives as a PySpark Python data source, and deduplicated writing of pages to them.

Format ``warc`` reads a folder of ``*.warc`` and ``*.warc.gz`` files (a gzip member
for each record) and writes the latter. Planning deals files, and byte ranges of
large indexed ones, to tasks. Predicates on the record type and on header columns
are pushed down: a task inflates the head of a record, parses its headers, and goes
on to the payload only if they pass and the option ``payload`` isn't ``false``. With
the index that the writer leaves beside a file, the rest of an unwanted record is
neither read nor inflated.

Each commit leaves a manifest of its own that names its files. Readers take the files
of all manifests, so appending adds records and files of failed attempts don't count;
mode ``overwrite`` removes what earlier commits named.
"""

from __future__ import annotations

import gzip
import io
import json
import posixpath
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from asofly.llm.common import probe
from asofly.session import materialize, scratch_path, scratch_scope

#: Column, its WARC header, and how the header's text is read.
HEADERS = {
    "warc_type": ("WARC-Type", str),
    "record_id": ("WARC-Record-ID", str),
    "target_uri": ("WARC-Target-URI", str),
    "payload_digest": ("WARC-Payload-Digest", str),
    "refers_to": ("WARC-Refers-To", str),
    "page_id": ("X-Page-Id", int),
    "payload_length": ("X-Payload-Length", int),
}
SCHEMA = "warc_type string, record_id string, target_uri string, payload_digest string, refers_to string, page_id long, payload_length long, payload binary"
ARROW = pa.schema([*((c, pa.int64() if kind is int else pa.string()) for c, (_, kind) in HEADERS.items()), ("payload", pa.binary())])
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
MANIFEST = "_files-"
#: Bytes of files dealt to a task; first bytes inflated to find the headers; bytes of rows in a batch.
TASK_BYTES, HEAD_BYTES, BATCH_BYTES = 32 << 20, 2048, 8 << 20


# ---------------------------------------------------------------- records


def _clean(value) -> str:
    """A header value on one line, not ASCII kept as UTF-8."""
    return str(value).replace("\r", " ").replace("\n", " ")


def record(kind: str, headers: dict, block: bytes) -> bytes:
    """One record; headers without a value are left out."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {_clean(v)}" for k, v in headers.items() if v is not None), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8") + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    """Header lines by lower-case name; lines that are none are passed over."""
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, found, value = line.partition(":")
        if found:
            out[name.strip().lower()] = value.strip()
    return out


#: A number that a 64-bit column holds: ASCII digits with a sign at most.
NUMBER = re.compile(r"[+-]?[0-9]{1,30}")


def whole_number(text: str) -> int | None:
    """The number that a header's value is; None for anything else, and for numbers beyond 64 bits."""
    if not NUMBER.fullmatch(text):
        return None
    n = int(text)
    return n if -(1 << 63) <= n < 1 << 63 else None


def columns_of(headers: dict[str, str]) -> dict:
    """Column values of a record's headers; numbers that are none are null."""
    row: dict = {}
    for column, (name, kind) in HEADERS.items():
        value = headers.get(name.lower())
        if value is not None and kind is int:
            value = whole_number(value)
        row[column] = value
    return row


# ---------------------------------------------------------------- filters


def _test(f: Filter):
    """A predicate on column values for a filter on one header column, or None if it can't be pushed down."""
    target, negated = (f.child, True) if type(f).__name__ == "Not" else (f, False)
    attribute = getattr(target, "attribute", None)
    if not attribute or len(attribute) != 1 or attribute[0] not in HEADERS:
        return None
    name, value = attribute[0], getattr(target, "value", None)
    checks = {
        EqualTo: lambda x: x is not None and x == value,
        EqualNullSafe: lambda x: x == value,
        In: lambda x: x is not None and x in value,
        IsNull: lambda x: x is None,
        IsNotNull: lambda x: x is not None,
        GreaterThan: lambda x: x is not None and x > value,
        GreaterThanOrEqual: lambda x: x is not None and x >= value,
        LessThan: lambda x: x is not None and x < value,
        LessThanOrEqual: lambda x: x is not None and x <= value,
        StringStartsWith: lambda x: x is not None and x.startswith(value),
        StringEndsWith: lambda x: x is not None and x.endswith(value),
        StringContains: lambda x: x is not None and value in x,
    }
    check = checks.get(type(target))
    if check is None:
        return None
    if not negated:
        return lambda row: check(row[name])
    if type(target) in (IsNull, IsNotNull, EqualNullSafe):
        return lambda row: not check(row[name])
    return lambda row: row[name] is not None and not check(row[name])


# ---------------------------------------------------------------- reading


@dataclass
class Task(InputPartition):
    """Files of a task; ``part`` of ``parts`` byte ranges of one indexed file."""

    files: list[str]
    part: int = 0
    parts: int = 1

    def __post_init__(self):
        super().__init__(None)


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _manifests(store, root: str) -> dict[str, list[str]]:
    """Names of the files that each commit made, by the commit's manifest."""
    from pyarrow import fs

    found = {}
    for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if info.base_name.startswith(MANIFEST):
            with store.open_input_file(info.path) as f:
                found[info.path] = json.loads(f.read())
    return found


def _length(headers: dict[str, str]) -> int | None:
    """A record's content length; None if there is none or it isn't a number."""
    n = whole_number(headers.get("content-length", ""))
    return n if n is not None and n >= 0 else None


def _past(f, n: int) -> bool:
    """Go past so many bytes; whether they are all there."""
    if not n:
        return True
    f.seek(n - 1, 1)
    return bool(f.read(1))


class WarcReader(DataSourceReader):
    def __init__(self, folder: str, payload: bool):
        self.folder, self.payload = folder, payload
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if _test(f) is None:
                yield f
            else:
                self.filters.append(f)

    def partitions(self) -> list[Task]:
        from pyarrow import fs

        store, root = _store(self.folder)
        listed = [i for i in store.get_file_info(fs.FileSelector(root, recursive=True)) if i.type == fs.FileType.File]
        sizes = {posixpath.relpath(i.path, root): i.size for i in listed}
        manifests = _manifests(store, root)
        if manifests:
            named = {n for names in manifests.values() for n in names}
            sizes = {n: s for n, s in sizes.items() if n in named or n.removesuffix(".idx") in named}
        tasks: list[Task] = []
        group: list[str] = []
        size = 0
        for name in sorted(n for n in sizes if n.endswith((".warc", ".warc.gz"))):
            if sizes[name] > TASK_BYTES and f"{name}.idx" in sizes:
                parts = -(-sizes[name] // TASK_BYTES)
                tasks += [Task([name], k, parts) for k in range(parts)]
                continue
            if group and size + sizes[name] > TASK_BYTES:
                tasks.append(Task(group))
                group, size = [], 0
            group.append(name)
            size += sizes[name]
        return [*tasks, Task(group)] if group or not tasks else tasks

    def read(self, partition: Task) -> Iterator[pa.RecordBatch]:
        tests = [_test(f) for f in self.filters]
        rows: list[dict] = []
        size = 0
        store, root = _store(self.folder)
        for name in partition.files:
            for row, payload in self._records(store, f"{root}/{name}", partition, tests):
                row["payload"] = payload
                rows.append(row)
                size += 500 + len(payload or b"")
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)

    def _records(self, store, path: str, task: Task, tests):
        from pyarrow import fs

        index = store.get_file_info([f"{path}.idx"])[0]
        with store.open_input_file(path) as f:
            if path.endswith(".gz") and index.type == fs.FileType.File:
                with store.open_input_file(f"{path}.idx") as g:
                    ends = [x for (x,) in struct.iter_unpack("<q", g.read())]
                total, size = ends[-1] if ends else 0, f.size()
                low, high = total * task.part // task.parts, total * (task.part + 1) // task.parts
                for begin, end in zip([0, *ends], ends, strict=False):
                    if low <= begin < high and end <= size:
                        f.seek(begin)
                        first = f.read(min(HEAD_BYTES, end - begin))
                        try:
                            yield from self._member(first, lambda f=f, n=end - begin - len(first): f.read(n), tests)
                        except zlib.error:
                            continue
            elif path.endswith(".gz"):
                yield from self._plain(gzip.GzipFile(fileobj=io.BufferedReader(f)), tests)
            else:
                yield from self._plain(io.BufferedReader(f), tests)

    def _wanted(self, head: bytes, tests):
        headers = parse_head(head)
        row = columns_of(headers)
        return headers, row, all(t(row) for t in tests)

    def _body(self, headers: dict[str, str], block: bytes) -> bytes:
        """The payload of a record's block: what follows the HTTP headers, if it has any."""
        if block.startswith(b"HTTP/"):
            return block.partition(b"\r\n\r\n")[2]
        return block

    def _member(self, first: bytes, more: Callable[[], bytes], tests):
        """One gzip member: the head is inflated from its first bytes; the rest is read for a longer head or a wanted payload."""
        inflate = zlib.decompressobj(31)
        head, rest = inflate.decompress(first, HEAD_BYTES), None
        while (cut := head.find(b"\r\n\r\n")) < 0 and not inflate.eof:
            data = inflate.unconsumed_tail
            if not data:
                if rest is not None:
                    break
                data = rest = more()
            head += inflate.decompress(data, HEAD_BYTES)
        if cut < 0:
            return
        headers, row, wanted = self._wanted(head[:cut], tests)
        if not wanted:
            return
        payload = None
        if self.payload and row["warc_type"] != "revisit" and (length := _length(headers)) is not None:
            block = head[cut + 4 :] + inflate.decompress(inflate.unconsumed_tail + (more() if rest is None else b""))
            payload = self._body(headers, block[:length])
        yield row, payload

    def _plain(self, f, tests):
        """Records of a stream without an index, up to where it breaks off: unwanted blocks are read past.

        A record without a proper length has a null payload; the next one is looked for
        line by line. A record that the end of the stream cuts off is none, nor is what lies behind damaged bytes.
        """
        try:
            yield from self._stream(f, tests)
        except (EOFError, zlib.error, gzip.BadGzipFile):
            return

    def _stream(self, f, tests):
        while True:
            line = f.readline()
            if not line:
                return
            if not line.startswith(b"WARC/"):
                continue
            head = [line]
            while (line := f.readline()) not in (b"\r\n", b"\n", b""):
                head.append(line)
            if not line:
                return
            headers, row, wanted = self._wanted(b"".join(head), tests)
            length = _length(headers)
            if length is None:
                if wanted:
                    yield row, None
                continue
            keep = wanted and self.payload and row["warc_type"] != "revisit"
            block = f.read(length) if keep else None
            if len(block) < length if keep else not _past(f, length):
                return
            if wanted:
                yield row, self._body(headers, block) if keep else None


# ---------------------------------------------------------------- writing


@dataclass
class Written(WriterCommitMessage):
    name: str


class WarcWriter(DataSourceArrowWriter):
    """Writes response and revisit records; a file counts once the commit names it in a manifest."""

    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite = folder, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        rows = (row for batch in iterator for row in batch.to_pylist())
        if (first := next(rows, None)) is None:
            return Written("")  # a task without rows makes no file
        store, root = _store(self.folder)
        store.create_dir(root, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        ends: list[int] = []
        at = 0
        with store.open_output_stream(f"{root}/{name}", compression=None) as out:
            for row in chain([first], rows):
                kind = row["warc_type"]
                block = b"" if kind == "revisit" else HTTP_HEAD + (row["payload"] or b"")
                headers = {h: row[c] for c, (h, _) in HEADERS.items() if c != "warc_type"}
                packed = zlib.compressobj(1, zlib.DEFLATED, 31)
                data = packed.compress(record(kind, headers, block)) + packed.flush()
                out.write(data)
                at += len(data)
                ends.append(at)
        with store.open_output_stream(f"{root}/{name}.idx") as out:
            out.write(struct.pack(f"<{len(ends)}q", *ends))
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _store(self.folder)
        store.create_dir(root, recursive=True)
        before = _manifests(store, root) if self.overwrite else {}
        with store.open_output_stream(f"{root}/{MANIFEST}{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([m.name for m in messages if m and m.name]).encode())
        for manifest, names in before.items():
            store.delete_file(manifest)
            for name in names:
                _delete(store, f"{root}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _store(self.folder)
        for m in messages:
            if m and m.name:
                _delete(store, f"{root}/{m.name}")


def _delete(store, path: str) -> None:
    """Remove an archive file and its index."""
    for name in (path, f"{path}.idx"):
        store.delete_file(name)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true") != "false")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make format ``warc`` known to the session and let it get predicates."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


# ---------------------------------------------------------------- pages

#: Payloads of fewer bytes are always written in full.
LEAST_SHARED = 100


def plan_records(pages: DataFrame, html: str = "html", key: str = "page_id", url: str = "url") -> DataFrame:
    """Rows for the writer: of equal payloads of ``LEAST_SHARED`` bytes or more, the smallest key is the response, others revisit it.

    Who revisits is found without payloads. Rows that pass a filter of the revisits' keys
    are told apart by a join; all others keep their payload where it is.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    slim = pages.select(
        F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("target_uri"), F.sha2(body, 256).alias("sha256"), F.octet_length(body).cast("long").alias("payload_length")
    )
    known = materialize(slim, "page-digests")
    groups = known.where(F.col("payload_length") >= LEAST_SHARED).groupBy("sha256").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").drop("n")
    shared, _ = probe(known, F.col("sha256"), groups := materialize(groups, "page-groups"), "sha256")
    revisits = materialize(shared.join(groups, "sha256").where(~F.col("page_id").eqNullSafe(F.col("first"))), "page-revisits")
    lost = revisits.select(F.col("page_id").alias("lost_id"), F.col("sha256").alias("lost_sha")).distinct()
    maybe, sure = probe(pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("target_uri"), body.alias("body")), F.col("page_id"), revisits, "page_id")
    digested = [d.withColumns({"sha256": F.sha2("body", 256), "payload_length": F.octet_length("body").cast("long")}) for d in (maybe, sure)]
    full = digested[1].unionByName(digested[0].join(lost, F.col("page_id").eqNullSafe(F.col("lost_id")) & (F.col("sha256") == F.col("lost_sha")), "left_anti"))

    def records(rows: DataFrame, kind: str, refers: Column, payload: Column) -> DataFrame:
        return rows.select(
            F.lit(kind).alias("warc_type"),
            F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.expr("uuid()")), F.lit(">")).alias("record_id"),
            "target_uri",
            F.concat(F.lit("sha256:"), "sha256").alias("payload_digest"),
            refers.alias("refers_to"),
            "page_id",
            "payload_length",
            payload.alias("payload"),
        )

    first = F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">"))
    return records(full, "response", F.lit(None).cast("string"), F.col("body").cast("binary")).unionByName(records(revisits, "revisit", first, F.lit(None).cast("binary")))


def archive_pages(pages: DataFrame, folder: str, html: str = "html", key: str = "page_id", url: str = "url", mode: str = "append") -> None:
    """Write one record for each row of ``pages``."""
    spark = pages.sparkSession
    register(spark)
    with scratch_scope(spark):
        plan_records(pages, html, key, url).write.format("warc").mode(mode).save(folder)


def read_archives(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(folder)


def warc_round_trip(pages: DataFrame, html: str = "html", key: str = "page_id", url: str = "url", folder: str | None = None) -> DataFrame:
    """Archive ``pages``, read the archives back: key, payload_bytes, payload_digest, record_type, refers_to.

    Responses are measured by their payload as read, and a digest unlike that in the
    record's header is an error; revisits have no payload, and their headers say how
    long it was and what its digest was. Null html is empty. Null keys stay null and
    never name a response; rows that repeat the first key of a group are responses too.
    A payload is one record however long it is. Other columns are not read; an empty
    table gives no rows.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    archive_pages(pages, folder, html, key, url)
    stored = F.substring_index("payload_digest", ":", -1)
    read = F.sha2("payload", 256)
    full = read_archives(spark, folder).where("warc_type = 'response'").select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.when(read == stored, read).otherwise(F.raise_error(F.lit("a payload differs from its digest"))).alias("payload_digest"), "warc_type", F.lit(None).cast("long").alias("refers_to")
    )
    seen = read_archives(spark, folder, payload=False).where("warc_type = 'revisit'").select(
        "page_id", F.col("payload_length").alias("payload_bytes"), stored.alias("payload_digest"), "warc_type", F.regexp_extract("refers_to", ":(-?[0-9]+)>$", 1).cast("long").alias("refers_to")
    )
    return full.unionByName(seen).select(F.col("page_id").alias(key), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), "refers_to")
