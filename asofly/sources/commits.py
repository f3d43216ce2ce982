"""Write-once snapshots with an optimistic commit log.

A store is a folder of Parquet parts under ``data`` and of numbered commits under ``log``.
A writer lays its part down first, where no reader looks, and then tries to create the
next commit's file. Whoever comes second reads what the first has added,
checks its own rows against just that, and tries the number behind it. Readers see the
parts of a run of whole commits and nothing else, so a writer that fails leaves
nothing visible. The store's file system must refuse to rename onto a file that is there, as HDFS does.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofly.sources.snapshots import append_snapshots

ROWS = "source string, id string, snapshot_date date, fetched_at timestamp, url string, body string, sha256 string"
CORRECTIONS = "source string, id string, snapshot_date date, field string, value string, corrected_at timestamp"


@dataclass(frozen=True)
class Commit:
    number: int
    kind: str
    part: str
    n_rows: int


class SnapshotStore:
    """A folder of snapshots with its log."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _name(self, number: int):
        return self._path(f"{self.root}/log/{number:020d}.json")

    def log(self, since: int = 0) -> list[Commit]:
        """Commits behind number ``since``, in order; a row for each commit on the driver."""
        folder = self._path(f"{self.root}/log")
        if not self._fs.exists(folder):
            return []
        names = sorted(str(s.getPath().toString()) for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json"))
        names = [n for n in names if int(n[-25:-5]) > since]
        rows = self.spark.read.schema("number long, kind string, part string, n_rows long").json(names).collect() if names else []
        return sorted((Commit(**r.asDict()) for r in rows), key=lambda c: c.number)

    def _parts(self, commits: list[Commit], kind: str, schema: str) -> DataFrame:
        paths = [f"{self.root}/data/{c.part}" for c in commits if c.kind == kind and c.n_rows]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, at: int | None = None) -> DataFrame:
        """All snapshots, or those that the store had at commit ``at``."""
        return self._parts([c for c in self.log() if at is None or c.number <= at], "append", ROWS)

    def corrections(self) -> DataFrame:
        return self._parts(self.log(), "correct", CORRECTIONS)

    def _try(self, commit: Commit) -> bool:
        """Put the commit's file in its place unless one is there: written aside, then renamed without overwriting, so that it is whole or not there."""
        aside = self._path(f"{self.root}/log/.{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        try:
            out.write(bytearray(json.dumps(commit.__dict__).encode()))
        finally:
            out.close()
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        files = hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(aside, self._name(commit.number), self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0))
        except Py4JJavaError as e:
            self._fs.delete(aside, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def _lay_down(self, rows: DataFrame) -> tuple[str, int]:
        part = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/data/{part}")
        return part, self.spark.read.schema(rows.schema).parquet(f"{self.root}/data/{part}").count()

    def _drop(self, part: str) -> None:
        self._fs.delete(self._path(f"{self.root}/data/{part}"), True)

    def append(self, new: DataFrame, before_commit=None) -> int:
        """Add snapshots; the number of the commit, or of the last one if nothing was new.

        Rows that are stored with the same bytes are no change; other bytes for a stored key
        raise ``SnapshotConflict``, whichever writer stored them, and nothing of this call is kept.
        ``before_commit`` is called once the part is laid down: a test steps in there.
        """
        head = max([c.number for c in self.log()], default=0)
        part, n = self._lay_down(append_snapshots(new, self.read(head)).select(*_columns(ROWS)))
        try:
            while n:
                if before_commit:
                    before_commit()
                if self._try(Commit(head + 1, "append", part, n)):
                    return head + 1
                since = self.log(head)
                mine = self.spark.read.schema(ROWS).parquet(f"{self.root}/data/{part}")
                left = append_snapshots(mine, self._parts(since, "append", ROWS)).select(*_columns(ROWS))
                head = since[-1].number
                again, m = self._lay_down(left)
                self._drop(part)
                part, n = again, m
        except BaseException:
            self._drop(part)
            raise
        self._drop(part)
        return head

    def correct(self, fixes: DataFrame) -> int:
        """Add corrective values (source, id, snapshot_date, field, value); snapshots stay as they are, a later fix wins."""
        part, n = self._lay_down(fixes.withColumn("corrected_at", F.current_timestamp()).select(*_columns(CORRECTIONS)))
        head = max([c.number for c in self.log()], default=0)
        while n and not self._try(Commit(head + 1, "correct", part, n)):
            head = self.log(head)[-1].number
        return head + 1 if n else head

    def corrected(self) -> DataFrame:
        """The snapshots, each with a map of its corrected fields (null for none)."""
        keys = ["source", "id", "snapshot_date"]
        last = self.corrections().groupBy(*keys, "field").agg(F.max_by("value", "corrected_at").alias("value"))
        fixed = last.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "value")))).alias("corrections"))
        return self.read().join(fixed, keys, "left")


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]
