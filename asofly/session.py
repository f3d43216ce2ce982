"""Session construction and shared-folder helpers.

Nothing here touches a machine-local folder on a cluster: intermediate tables go
to the folder the session names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "asofly", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the library is tested with."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the session; a temporary one only where none is set and driver and executors are one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="asofly-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


#: Folders made in the innermost scope, each with whether it outlives the scope.
_MADE: ContextVar[list[tuple[str, bool]] | None] = ContextVar("made", default=None)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete the scratch folders made inside when it ends; those made with ``keep`` pass to the scope around it."""
    made: list[tuple[str, bool]] = []
    token = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(token)
        for path, keep in made:
            if not keep:
                drop_path(spark, path)
            elif (outer := _MADE.get()) is not None:
                outer.append((path, False))


def scratch_path(spark: SparkSession, label: str, keep: bool = False) -> str:
    """A fresh folder name under the shared folder, as a URI with a scheme."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_root(spark)}/asofly/{label}-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    name = str(fs.makeQualified(path).toString())
    if (made := _MADE.get()) is not None:
        made.append((name, keep))
    return name


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that no live DataFrame reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back; ``keep`` it beyond the scope."""
    spark = df.sparkSession
    path = scratch_path(spark, label, keep)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
