"""Shared-folder workspace for the multi-pass operators.

Every operator that needs more than one pass cuts its lineage by writing a
table under the folder that the cluster names in ``spark.checkpoint.dir`` and
reading it back.  A lost executor then costs a re-read, never a recomputation
of earlier passes, and no executor needs another one's local disk.
"""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a local one only where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        if not re.fullmatch(r"local(\[[^\[\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="braidwork-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Smaller Arrow batches: texts are long, and several batches are held at once on either side."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that begin inside have their shuffle files removed as they end, not when the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Workspace:
    """Tables of one operator run, each written once and read back."""

    def __init__(self, spark: SparkSession, label: str):
        bounded_batches(spark)
        self.spark = spark
        self.root = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        self._live: list[str] = []

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str, *, hashes: bool = False) -> DataFrame:
        """Write ``df`` as Parquet and return a frame that reads the files; columns of ``hashes`` are not worth a dictionary."""
        path = self.path(name)
        with freed_shuffles(self.spark):
            df.write.option("compression", "zstd").option("parquet.enable.dictionary", str(not hashes).lower()).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._workspace_path = path
        self._live.append(path)
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that no later step reads."""
        self._delete([x._workspace_path for x in frames])

    def keep_only(self, *frames: DataFrame) -> None:
        """Delete all tables of this workspace but these."""
        held = {x._workspace_path for x in frames}
        self._delete([x for x in self._live if x not in held])

    def _delete(self, paths: list[str]) -> None:
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for x in paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(x)
            path.getFileSystem(conf).delete(path, True)
            self._live.remove(x)


def without(rows: DataFrame, gone: DataFrame, key: str, most: int = 1 << 20) -> DataFrame:
    """``rows`` whose ``key`` is not in ``gone``: a broadcast of up to ``most`` keys, else a join that shuffles."""
    small = gone.limit(most + 1).count() <= most
    return rows.join(F.broadcast(gone) if small else gone.hint("merge"), key, "left_anti")
