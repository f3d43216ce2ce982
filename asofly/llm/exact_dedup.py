"""Exact deduplication by a log-structured merge index of text digests, in DataFrame operations only.

* **Memtable and flush.** The rows come in batches of at most about ``MEMTABLE_ROWS``,
  and ``FLUSHES`` of them at least. A batch is the memtable: its digests are grouped,
  with the winning key and the number of rows, and flushed as a run, a table bucketed
  (sharded) and sorted by digest. Beside it lies a bitmap filter of its digests, sized
  by their count.
* **Lookup.** Before a memtable joins the index, its digests are probed against the
  filters of the runs there; those that pass are looked up in the run, shard by shard.
  What is found, or repeats within the memtable, is a hit.
* **Compaction** merges the runs of a full level, sorted shard with sorted shard, without
  a shuffle or a sort, and keeps for each digest the winning key and the rows.
* **Byte verification.** The rows of the hits (picked by a filter of their keys) are
  grouped by digest, partial results first, and the least and greatest text of each
  group compared: equal digests with unequal texts are told apart by the texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from asofly.llm.common import apply_filter, ascii_lower, build_filter, filter_bits, fresh, probe
from asofly.session import drop_path, materialize, scratch_path, scratch_scope

#: Rows of a memtable, the least number of flushes of one call, and runs of a level that are compacted into the next.
MEMTABLE_ROWS, FLUSHES, LEVEL_RUNS = 500_000_000, 3, 2
#: Folders that the rows' digests are written to; a memtable takes some that follow each other.
FOLDERS = 4096

#: A bucket of a run is one sorted file; with this its order counts when two runs are merged.
ORDERED_SCAN = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def text_digest(text: Column) -> Column:
    """SHA-256 of the text's UTF-8 bytes."""
    return F.unhex(F.sha2(text, 256))


@dataclass
class Run:
    """A sorted, sharded table (digest, winner, n_rows); its filter is made when first probed."""

    name: str
    path: str
    bits: int = 0


class DigestIndex:
    """The index over one or more batches of documents. ``keep`` says which key of equal texts wins: min or max."""

    def __init__(self, spark: SparkSession, keep: str = "max", level_runs: int = LEVEL_RUNS):
        self.spark, self.level_runs = spark, level_runs
        self.best = {"min": F.min, "max": F.max}[keep]
        self.better = {"min": F.least, "max": F.greatest}[keep]
        self.folder = scratch_path(spark, "digest-index")
        self.shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.levels: list[list[Run]] = [[]]
        self.merged_away: list[Run] = []
        self.found: list[DataFrame] = []

    def _write(self, rows: DataFrame) -> Run:
        run = Run(name := f"digest_run_{uuid.uuid4().hex}", f"{self.folder}/{name}")
        rows.select("digest", "winner", "n_rows").write.bucketBy(self.shards, "digest").sortBy("digest").option("path", run.path).saveAsTable(name)
        return run

    def filter_of(self, run: Run) -> DataFrame:
        path = f"{run.path}-filter"
        if not run.bits:
            run.bits = filter_bits(self.spark.table(run.name).count())
            build_filter(self.spark.table(run.name), "digest", run.bits).write.parquet(path)
        return self.spark.read.schema("_bucket long, _bitmap binary").parquet(path)

    def runs(self) -> list[Run]:
        return [r for level in self.levels for r in level]

    def flush(self, batch: DataFrame) -> None:
        """Write a batch (digest, winner) as a run, to be looked up in the runs before it; full levels are compacted."""
        grouped = batch.groupBy("digest").agg(self.best(F.col("winner").cast("long")).alias("winner"), F.count(F.lit(1)).alias("n_rows"))
        run = self._write(grouped)
        fresh_rows = self.spark.table(run.name)
        self.found.append(fresh_rows.where("n_rows > 1").select("digest"))
        for old in self.runs():
            near = self.filter_of(old)
            maybe = apply_filter(fresh_rows.select("digest"), F.col("digest"), near, old.bits)
            self.found.append(maybe.join(self.spark.table(old.name).hint("merge"), "digest", "left_semi"))
        self.levels[0].append(run)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.level_runs:
            self._compact(level)
            level += 1

    def merged(self, runs: list[Run]) -> DataFrame:
        """The rows of sorted runs, merged shard by shard: a row for each digest."""

        def two(a: DataFrame, b: DataFrame) -> DataFrame:
            a, b = a.hint("merge").alias("a"), b.hint("merge").alias("b")
            n = F.coalesce(F.col("a.n_rows"), F.lit(0)) + F.coalesce(F.col("b.n_rows"), F.lit(0))
            return a.join(b, "digest", "full_outer").select("digest", self.better("a.winner", "b.winner").alias("winner"), n.alias("n_rows"))

        return reduce(two, [self.spark.table(r.name) for r in runs])

    def _compact(self, level: int) -> None:
        old = self.levels[level]
        before = self.spark.conf.get(ORDERED_SCAN)
        self.spark.conf.set(ORDERED_SCAN, "true")
        try:
            run = self._write(self.merged(old))
        finally:
            self.spark.conf.set(ORDERED_SCAN, before)
        self.levels[level] = []
        while len(self.levels) <= level + 1:
            self.levels.append([])
        self.levels[level + 1].append(run)
        # their files go when the index is closed: lookups that were noted read them still
        self.merged_away += old

    def compact(self) -> DataFrame:
        """Merge all levels into one run; a row for each digest."""
        runs = self.runs()
        if len(runs) > 1:
            self.levels = [runs]
            self._compact(0)
        return self.spark.table(self.runs()[0].name)

    def groups(self) -> DataFrame:
        """(digest, winner, n_rows) of the hits: digests that several rows share."""
        hits = materialize(reduce(DataFrame.unionByName, self.found).distinct(), "hits")
        bits = filter_bits(hits.count())
        near = build_filter(hits, "digest", bits)
        rows = [apply_filter(self.spark.table(r.name), F.col("digest"), near, bits) for r in self.runs()]
        return reduce(DataFrame.unionByName, rows).join(hits, "digest", "left_semi").groupBy("digest").agg(self.best("winner").alias("winner"), F.sum("n_rows").alias("n_rows"))

    def close(self) -> None:
        """Delete the runs."""
        for r in [*self.runs(), *self.merged_away]:
            self.spark.sql(f"DROP TABLE IF EXISTS {r.name}")
        drop_path(self.spark, self.folder)
        self.levels, self.merged_away, self.found = [[]], [], []


def memtables(sizes: list[tuple[int, int]], most: int = MEMTABLE_ROWS, least: int = FLUSHES) -> list[tuple[int, int]]:
    """Ranges (first, last) of the folders of given rows, in order: each of at most ``most`` rows or one folder, and about ``least`` of them or more."""
    most = min(most, -(-sum(n for _, n in sizes) // least))
    out: list[tuple[int, int]] = []
    held = 0
    for folder, n in sizes:
        if out and held + n <= most:
            out[-1] = (out[-1][0], folder)
            held += n
        else:
            out.append((folder, folder))
            held = n
    return out or [(0, 0)]


def _answers(docs: DataFrame, text: str, key: str, keep: str, digest: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """(key, text_sha256, winner, n_rows) of the rows that share their text with another row, and (key, text_sha256) of all others."""
    spark = docs.sparkSession
    plain = docs.select(F.col(key).cast("long").alias("key"), ascii_lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    with scratch_scope(spark):
        # The rows' own digests are kept beside the runs: the answer needs them again, and they are far smaller than the texts.
        path = scratch_path(spark, "digest-rows", keep=True)
        own = [] if digest is text_digest else [digest(F.col("text")).alias("digest")]
        # A task writes to one folder, so that many folders aren't more files.
        batch = F.pmod(F.spark_partition_id(), F.lit(FOLDERS)).alias("batch")
        plain.select("key", F.sha2("text", 256).alias("text_sha256"), *own, batch).write.partitionBy("batch").parquet(path)
        schema = "key long, text_sha256 string, " + ("digest binary, " if own else "") + "batch int"
        rows = spark.read.schema(schema).parquet(path).withColumn("digest", F.col("digest") if own else F.unhex("text_sha256"))
        sizes = [(r["batch"], r["n"]) for r in rows.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).orderBy("batch").collect()]
        index = DigestIndex(spark, keep)
        try:
            for first, last in memtables(sizes):
                index.flush(rows.where(F.col("batch").between(first, last)).select("digest", F.col("key").alias("winner")))
            groups = materialize(index.groups(), "hit-groups", keep=True)
        finally:
            index.close()
        maybe, single = probe(rows.select("key", "text_sha256", "digest"), F.col("digest"), groups, "digest")
        shared = materialize(maybe.join(groups, "digest", "left"), "hit-rows", keep=True)
        # a row that the filter let through in vain has no group
        single = single.unionByName(shared.where("n_rows is null").select("key", "text_sha256", "digest"))
        shared = shared.where("n_rows is not null")
        texts, _ = probe(plain, F.col("key"), shared.select("key"), "key")
        probed = texts.withColumn("digest", digest(F.col("text")))
        sides = probed.groupBy("digest").agg(F.min("text").alias("least"), F.max("text").alias("most")).where(F.col("least") != F.col("most")).select("digest")
        clashes = materialize(sides, "digest-clashes")
        if not clashes.isEmpty():
            # Groups of clashing digests are formed again from the texts themselves; no digest decides there.
            doubtful = probed.join(clashes, "digest", "left_semi").select("key", F.sha2("text", 256).alias("text_sha256"), "digest", "text")
            exact = doubtful.groupBy("text").agg(index.best("key").alias("winner"), F.count(F.lit(1)).alias("n_rows"))
            told = doubtful.join(exact, "text").select("key", "text_sha256", "digest", "winner", "n_rows")
            kept = shared.join(clashes, "digest", "left_anti").select("key", "text_sha256", "digest", "winner", "n_rows")
            shared = materialize(kept.unionByName(told), "told-apart", keep=True)
            single = materialize(single.join(clashes, "digest", "left_anti"), "single-rows", keep=True)
    return shared.select("key", "text_sha256", "winner", "n_rows"), single.select("key", "text_sha256")


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: str = "max", digest: Callable[[Column], Column] = text_digest) -> DataFrame:
    """Groups of texts that are equal after lower-casing A-Z.

    A row for every row of ``docs``: key, keep_id (the winning key of its group),
    group_size (rows), kept, text_sha256 (of the normalised text). Null counts as
    the empty text, and texts are compared whole, however long. Rows that repeat a key
    and its text share one answer. Null keys lose to any other key; a group of null keys
    alone keeps null. Other columns are not read; an empty table gives no rows.
    """
    shared, single = _answers(docs, text, key, keep, digest)
    rows = shared.unionByName(single.select("key", "text_sha256", F.col("key").alias("winner"), F.lit(1).cast("long").alias("n_rows")))
    return rows.select(F.col("key").alias(key), F.col("winner").alias("keep_id"), F.col("n_rows").alias("group_size"), F.col("key").eqNullSafe(F.col("winner")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: str = "max") -> DataFrame:
    """The documents that stay, with all their columns: one row of each group of equal texts.

    Rows are told apart by key and text: a key that repeats with other texts, or is
    null, doesn't share the fate of its namesakes. Of rows that repeat the winning key
    and its text any one stays. Null and empty texts are one group. An empty table gives
    no rows. Only rows whose key passes a filter of the groups' keys are joined.
    """
    own_key, own_sha, verdict_key, verdict_sha = fresh(docs, "_key", "_sha", "_verdict_key", "_verdict_sha")
    shared, _ = _answers(docs, text, key, keep, text_digest)
    answers = shared.groupBy(F.col("key").alias(verdict_key), F.col("text_sha256").alias(verdict_sha)).agg(F.bool_or(F.col("key").eqNullSafe(F.col("winner"))).alias("kept"), F.count(F.lit(1)).alias("n"))
    verdicts = materialize(answers.where("not kept or n > 1"), "dedup-verdicts")
    dropped, repeated = (verdicts.where(c).select(verdict_key, verdict_sha) for c in ("not kept", "kept"))
    marked = docs.withColumn(own_key, F.col(key).cast("long"))
    maybe, sure = probe(marked, F.col(own_key), verdicts, verdict_key)
    maybe = maybe.withColumn(own_sha, F.sha2(ascii_lower(F.coalesce(F.col(text), F.lit(""))), 256))
    same = F.col(own_key).eqNullSafe(F.col(verdict_key)) & (F.col(own_sha) == F.col(verdict_sha))
    stay = maybe.join(dropped, same, "left_anti")
    if not repeated.isEmpty():
        once = stay.join(repeated, same, "left_semi").dropDuplicates([own_key, own_sha])
        stay = stay.join(repeated, same, "left_anti").unionByName(once)
    return sure.drop(own_key).unionByName(stay.drop(own_key, own_sha))
