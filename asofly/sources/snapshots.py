"""Snapshot envelopes, manifests, history lists, logs, fixtures and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from asofly.functions.dates import parse_full_date
from asofly.operators.temporal import as_of_point, dense_ids

ENVELOPE = "url string, fetched_at timestamp, sha256 string, body string"
MANIFEST = "source string, id string, snapshot_date date, fetched_at timestamp, url string, sha256 string, path string"

#: Paths read from a study body; the schema prunes all others while parsing.
STUDY = (
    "struct<protocolSection:struct<"
    "identificationModule:struct<nctId:string,briefTitle:string>,"
    "descriptionModule:struct<briefSummary:string>,"
    "statusModule:struct<overallStatus:string,whyStopped:string,statusVerifiedDate:string,startDateStruct:struct<date:string>,"
    "primaryCompletionDateStruct:struct<date:string,type:string>,completionDateStruct:struct<date:string,type:string>,lastUpdatePostDateStruct:struct<date:string>>,"
    "designModule:struct<phases:array<string>,enrollmentInfo:struct<count:int,type:string>>,"
    "sponsorCollaboratorsModule:struct<leadSponsor:struct<name:string,class:string>>,"
    "conditionsModule:struct<conditions:array<string>>,"
    "armsInterventionsModule:struct<armGroups:array<struct<label:string>>,interventions:array<struct<name:string,otherNames:array<string>,type:string,description:string>>>,"
    "outcomesModule:struct<primaryOutcomes:array<struct<measure:string,timeFrame:string>>>,"
    "contactsLocationsModule:struct<locations:array<struct<city:string,country:string>>>>,"
    "derivedSection:struct<conditionBrowseModule:struct<meshes:array<struct<id:string,term:string>>,ancestors:array<struct<id:string,term:string>>>>,"
    "hasResults:boolean>"
)


class SnapshotConflict(Exception):
    """Other bytes for a (source, id, day) that is already stored."""


def body_digest(body: Column) -> Column:
    return F.sha2(body, 256)


def append_snapshots(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of ``new`` (source, id, snapshot_date, ...) to append: those not stored yet, one for each key.

    The same bytes on the same day are no change; different ones raise ``SnapshotConflict``.
    """
    keys = ["source", "id", "snapshot_date"]
    stamped = new.withColumn("sha256", body_digest(F.col("body")))
    within = stamped.groupBy(*keys).agg(F.count_distinct("sha256").alias("n")).where("n > 1").select(*keys)
    across = stamped.join(stored.select(*keys, F.col("sha256").alias("_old")), keys).where("_old <> sha256").select(*keys)
    clash = within.unionByName(across).limit(5).collect()
    if clash:
        raise SnapshotConflict(str([tuple(r) for r in clash]))
    return stamped.join(stored.select(*keys), keys, "left_anti").dropDuplicates(keys)


def read_envelopes(spark: SparkSession, root: str) -> DataFrame:
    """All ``root/source/YYYY-MM-DD/id.json`` (ids percent-encoded, as paths are once more); folders that aren't dates are skipped."""
    raw = spark.read.schema(ENVELOPE).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(root)
    part = lambda k: F.regexp_extract(F.col("path"), r"([^/]+)/([^/]+)/([^/]+)\.json$", k)
    rows = raw.withColumn("path", F.col("_metadata.file_path")).withColumns({"source": part(1), "snapshot_date": parse_full_date(part(2)), "id": F.url_decode(F.url_decode(part(3)))})
    return rows.where("snapshot_date is not null")


def manifest(envelopes: DataFrame) -> DataFrame:
    """The manifest, one row for each (source, id, day): the last fetched."""
    cols = [c.split()[0] for c in MANIFEST.split(", ")]
    keys = ["source", "id", "snapshot_date"]
    rest = [c for c in cols if c not in keys]
    return envelopes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("fetched_at", "path")).alias("_r")).select(*keys, "_r.*").select(*cols)


def integrity(envelopes: DataFrame, stored: DataFrame) -> DataFrame:
    """(source, id, snapshot_date, problem): files the manifest lacks, entries without a file, bodies unlike their digest."""
    keys = ["source", "id", "snapshot_date"]
    disk = envelopes.select(*keys, (body_digest(F.col("body")) == F.col("sha256")).alias("_ok"), F.lit(True).alias("_disk"))
    j = disk.join(stored.select(*keys, F.lit(True).alias("_man")), keys, "full")
    problem = F.when(F.col("_man").isNull(), "orphan_file").when(F.col("_disk").isNull(), "missing_file").when(~F.col("_ok"), "hash_mismatch")
    return j.select(*keys, problem.alias("problem")).where("problem is not null")


def all_ids(stored: DataFrame, source: str) -> DataFrame:
    """S3: sorted distinct ids of a source."""
    return stored.where(F.col("source") == source).select("id").distinct().orderBy("id")


def as_of(stored: DataFrame, at: Column) -> DataFrame:
    """For each (source, id) the snapshot of the latest day on or before ``at``, of ties the last fetched."""
    keyed = stored.withColumn("_k", F.struct("source", "id"))
    return as_of_point(keyed.drop("source", "id"), "_k", ["snapshot_date", "fetched_at"], "snapshot_date", at).select("_k.*", "snapshot_date", "fetched_at", *[c for c in stored.columns if c not in ("source", "id", "snapshot_date", "fetched_at")])


def version_paths(stored: DataFrame) -> DataFrame:
    """(nct_id, version, path) of ids written ``nct:vN``."""
    v = stored.where(F.col("id").contains(":v"))
    return v.select(F.split("id", ":v")[0].alias("nct_id"), F.try_to_number(F.split("id", ":v")[1], F.lit("999999")).cast("int").alias("version"), "path")


def parse_study(body: Column) -> Column:
    """A study, bare or wrapped in ``{"study": ...}``; null where it isn't JSON."""
    wrapped = F.from_json(body, f"struct<study:{STUDY}>")["study"]
    return F.coalesce(wrapped, F.from_json(body, STUDY))


def missing_keys(text: Column, required: list[str]) -> Column:
    """Required keys that a JSON object lacks; additions are allowed. All are missing where it is no object."""
    return F.array_except(F.array(*[F.lit(k) for k in required]), F.coalesce(F.json_object_keys(text), F.array().cast("array<string>")))


def schema_hash(text: Column) -> Column:
    """First 16 hex digits of a digest of the sorted keys."""
    return F.substring(F.sha2(F.to_json(F.sort_array(F.json_object_keys(text))), 256), 1, 16)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines log; blank lines are skipped, a missing file is an empty log."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def append_log(records: DataFrame, path: str, reviewed: DataFrame | None = None, key: str = "program_id", only_auto: bool = False) -> None:
    """Append records; staged ones of reviewed programs and, with ``only_auto``, human ones are refused."""
    if reviewed is not None:
        records = records.join(reviewed.select(key).distinct(), key, "left_anti")
    if only_auto:
        records = records.where(F.when(F.col("labeller") == "auto", True).otherwise(F.raise_error(F.lit("only automatic records belong in this log")).cast("boolean")))
    records.write.mode("append").json(path)


def append_facts(facts: DataFrame, path: str) -> None:
    """Append typed facts, partitioned by type so that a scan of one type reads only its files."""
    facts.write.mode("append").partitionBy("event_type").parquet(path)


def replace_table(df: DataFrame, path: str) -> DataFrame:
    """Full refresh of a derived table."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def event_table(events: DataFrame, key: str = "nct_id") -> DataFrame:
    """Events with dense ids in the order of record, versions, type and field."""
    return dense_ids(events, [key, "from_version", "to_version", "event_type", "field", "to_value", "from_value"])


def read_name_list(spark: SparkSession, path: str) -> DataFrame:
    """(line, name): names of lines ``a | b | c``, lower case; ``#`` begins a comment line."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)"))
    return lines.select(F.xxhash64("value").alias("line"), F.explode(F.split("value", r"\|")).alias("name")).select("line", F.lower(F.trim("name")).alias("name")).where("name <> ''")


def read_markdown_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of a pipe table with as many cells as there are columns; header and rule lines are left out."""
    cells = F.transform(F.split(F.regexp_replace("value", r"^\s*\||\|\s*$", ""), r"\|"), lambda c: F.trim(c))
    rows = spark.read.text(path).where(F.col("value").rlike(r"^\s*\|") & ~F.col("value").rlike(r"^[\s|:-]+$")).select(cells.alias("c")).where((F.size("c") == len(columns)) & (F.get("c", F.lit(0)) != columns[0]))
    return rows.select(*[F.get("c", F.lit(i)).alias(n) for i, n in enumerate(columns)])


#: Rows of the longest report table.
REPORT_ROWS = 2000


def markdown_table(df: DataFrame, title: str) -> str:
    """A small result as a Markdown table; one of more than ``REPORT_ROWS`` rows is refused, not cut: it should be written as a table."""
    head = df.columns
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"more than {REPORT_ROWS} rows: write them as a table")
    lines = [f"## {title}", "", "| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]) + "\n"


def write_csv(df: DataFrame, path: str) -> None:
    """Arrays joined by ``; ``, then CSV."""
    flat = [F.concat_ws("; ", c).alias(c) if t.startswith("array<string>") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", "true").csv(path)


def update_where(df: DataFrame, test: Column, values: dict[str, Column]) -> DataFrame:
    """New values in the rows that match."""
    return df.withColumns({c: F.when(test, v).otherwise(F.col(c)) for c, v in values.items()})
