"""A cache that merges rows by key and hands each consumer only what is new to it.

The table is a folder of versions, each a Parquet dataset that is complete once
Spark's committer has left its ``_SUCCESS`` file.  A merge writes the next
version; frames that still read an older one are not disturbed, and a failed
write leaves the newest complete version in force.  The ledger records, for
each pair of cached nodes, the latest change that the second one has taken from
the first.
"""

from __future__ import annotations

import time
import uuid
from datetime import datetime, timedelta, timezone
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ConcurrentWriteError
from .cache import Cache

CHANGED = "cdc_datetime_updated"


def _fs(spark: SparkSession, path: str) -> tuple[Any, Any]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def delete_path(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


#: What a run has read of each source for each destination, until its entry is written.
_seen: dict[tuple[str, str, str], datetime | None] = {}
_ATTEMPTS, _PAUSE = 20, 0.5


class Ledger:
    """``(source, destination, cdc_datetime_updated)`` rows, partitioned by the pair of nodes."""

    COLUMNS = f"source string, destination string, {CHANGED} timestamp_ntz"

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def create(self, spark: SparkSession) -> None:
        if not path_exists(spark, self.path):
            spark.createDataFrame([], self.COLUMNS).write.mode("append").partitionBy("source", "destination").parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        if not path_exists(spark, self.path):
            return spark.createDataFrame([], self.COLUMNS)
        return spark.read.schema(self.COLUMNS).parquet(self.path)

    def append(self, spark: SparkSession, sources: list[str], destination: str, at: datetime) -> None:
        if sources:
            rows = spark.createDataFrame([(s, destination, at) for s in sources], self.COLUMNS).coalesce(1)
            rows.write.mode("append").partitionBy("source", "destination").parquet(self.path)

    def last(self, spark: SparkSession, source: str, destination: str) -> datetime | None:
        """The latest entry of a pair; only its partition is read."""
        pair = (F.col("source") == source) & (F.col("destination") == destination)
        return self.read(spark).where(pair).agg(F.max(CHANGED)).first()[0]

    def compact(self, spark: SparkSession) -> None:
        """Keep the latest entry of each pair, in one file a pair.

        The latest entries are written before the older files go, and only the
        maximum of a pair counts, so a crash at any point loses nothing.
        """
        fs, root = _fs(spark, self.path)
        held, files = [], fs.listFiles(root, True)
        while files.hasNext():
            path = files.next().getPath()
            if not path.getName().startswith(("_", ".")):
                held.append(path)
        latest = self.read(spark).groupBy("source", "destination").agg(F.max(CHANGED).alias(CHANGED))
        latest.repartition("source", "destination").write.mode("append").partitionBy("source", "destination").parquet(self.path)
        for path in held:
            fs.delete(path, False)


def merge_rows(current: DataFrame | None, new: DataFrame, keys: list[str]) -> DataFrame:
    """``current`` with the rows of ``new`` in place of those with the same keys, and the rest added.

    Null keys match nothing.  A key that ``new`` repeats is an error when the
    result is worked out; checking it costs no job of its own.
    """
    over = Window.partitionBy(*keys)
    whole = F.lit(True)
    for k in keys:
        whole &= F.col(k).isNotNull()
    message = F.concat(F.lit("rows to merge repeat the key "), F.to_json(F.struct(*keys)))
    mark = "__rows_of_key"
    sound = F.when(whole & (F.col(mark) > 1), F.raise_error(message).cast("boolean")).otherwise(True)
    new = new.withColumn(mark, F.count("*").over(over)).where(sound).drop(mark)
    if current is None:
        return new
    rest = current.join(new.select(*keys), keys, "left_anti").select(*current.columns)
    return rest.unionByName(new, allowMissingColumns=True)


class MergeCache(Cache):
    """Versioned Parquet table with keyed merges and change tracking.

    ``merge_keys`` name the columns that tell rows apart; ``ledger`` is shared by
    the caches of a pipeline.
    """

    def __init__(self, path: str, merge_keys: list[str], ledger: Ledger | str):
        if not isinstance(merge_keys, list):
            raise TypeError("merge_keys must be a list of column names")
        if not merge_keys:
            raise ValueError("merge_keys must name a column")
        self.path, self.merge_keys = path.rstrip("/"), merge_keys
        self.ledger = Ledger(ledger) if isinstance(ledger, str) else ledger

    def versions(self, spark: SparkSession) -> list[int]:
        """The complete versions, oldest first."""
        fs, where = _fs(spark, self.path)
        if not fs.exists(where):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        there = [n for n in names if n.startswith("v-") and fs.exists(_fs(spark, f"{self.path}/{n}/_SUCCESS")[1])]
        return sorted(int(n[2:]) for n in there)

    def _at(self, version: int) -> str:
        return f"{self.path}/v-{version:08d}"

    def table(self, spark: SparkSession) -> DataFrame:
        """The newest version, with the change times."""
        return spark.read.parquet(self._at(self.versions(spark)[-1]))

    def exists(self, spark: SparkSession) -> bool:
        return bool(self.versions(spark))

    def create_cdc_table(self, spark: SparkSession) -> None:
        self.ledger.create(spark)

    def read(self, spark: SparkSession, from_node: Any = None, to_node: Any = None, is_static: bool = False) -> DataFrame:
        version = self.versions(spark)[-1]
        frame = spark.read.parquet(self._at(version))
        if is_static or from_node is None or to_node is None or CHANGED not in frame.columns:
            return frame
        last = self.ledger.last(spark, from_node.key, to_node.key)
        _seen[self.ledger.path, from_node.key, to_node.key] = self._changed(spark, version)
        return frame if last is None else frame.where(F.col(CHANGED) > F.lit(last).cast("timestamp_ntz"))

    def _changed(self, spark: SparkSession, version: int) -> datetime | None:
        """The latest change time of a version, from the note written with it."""
        fs, note = _fs(spark, f"{self._at(version)}/_changed")
        if not fs.exists(note):
            return spark.read.parquet(self._at(version)).agg(F.max(CHANGED)).first()[0]
        stream = fs.open(note)
        try:
            return datetime.fromisoformat(stream.readUTF())
        finally:
            stream.close()

    def write(self, spark: SparkSession, frame: Any, upstream_nodes: list | None = None, to_node: Any = None, datetime_started_transformation: datetime | None = None) -> None:
        """Merge ``frame`` into the next version.

        Rows are written to a private folder that becomes the next version only
        if no other writer has claimed its number; else they are merged again,
        into what that writer has left.  Change times rise from version to
        version, so a consumer's ledger entry, the latest time of the version it
        has read, covers exactly the rows it has seen.
        """
        from .frames import FrameKind, convert

        frame = convert(frame, FrameKind.PYSPARK, spark)
        for _ in range(_ATTEMPTS):
            if self._commit(spark, frame):
                break
            time.sleep(_PAUSE)
        else:
            raise ConcurrentWriteError(f"{self.path}: another writer has claimed the next version and not finished it; delete its _claim file if it is gone")
        for n in upstream_nodes or [] if to_node is not None else []:
            started = datetime_started_transformation or datetime.now(timezone.utc).replace(tzinfo=None)
            at = _seen.pop((self.ledger.path, n.key, to_node.key), started)
            self.ledger.append(spark, [n.key], to_node.key, at or datetime(1970, 1, 1))  # nothing was there to take

    def _commit(self, spark: SparkSession, frame: DataFrame) -> bool:
        held = self.versions(spark)
        version = (held[-1] if held else 0) + 1
        fs, claim = _fs(spark, f"{self.path}/_claim-{version:08d}")
        if fs.exists(claim):
            return False
        current, before = None, None
        if held:
            current, before = spark.read.parquet(self._at(held[-1])), self._changed(spark, held[-1])
        if CHANGED not in frame.columns:
            now = datetime.now(timezone.utc).replace(tzinfo=None)
            frame = frame.withColumn(CHANGED, F.lit(max(now, before + timedelta(microseconds=1)) if before else now).cast("timestamp_ntz"))
        else:
            frame = frame.withColumn(CHANGED, F.col(CHANGED).cast("timestamp_ntz"))
        private = f"{self.path}/_private-{uuid.uuid4().hex}"
        latest = Observation()
        merge_rows(current, frame, self.merge_keys).observe(latest, F.max(CHANGED).cast("string").alias("at")).write.parquet(private)
        at = latest.get["at"]
        if at is not None:
            note = fs.create(_fs(spark, f"{private}/_changed")[1])
            note.writeUTF(at)
            note.close()
        if not fs.createNewFile(claim):
            delete_path(spark, private)
            return False
        if self.versions(spark) != held:  # a claim that was cleared away since
            delete_path(spark, private)
            fs.delete(claim, False)
            return False
        if not fs.rename(_fs(spark, private)[1], _fs(spark, self._at(version))[1]):
            raise OSError(f"{private} could not be renamed")
        return True

    def vacuum(self, spark: SparkSession, keep: int = 2) -> None:
        """Delete all but the newest ``keep`` versions (with 0 all of them); frames that still read them will fail."""
        if keep < 0:
            raise ValueError("keep must not be negative")
        held = self.versions(spark)
        for v in held[: max(len(held) - keep, 0)]:
            delete_path(spark, self._at(v))
            delete_path(spark, f"{self.path}/_claim-{v:08d}")

    def drop(self, spark: SparkSession) -> None:
        delete_path(spark, self.path)


class ParquetCache(Cache):
    """A plain cache: one Parquet dataset, written once."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def exists(self, spark: SparkSession) -> bool:
        return path_exists(spark, f"{self.path}/_SUCCESS")

    def read(self, spark: SparkSession, from_node: Any = None, to_node: Any = None, is_static: bool = False) -> DataFrame:
        return spark.read.parquet(self.path)

    def write(self, spark: SparkSession, frame: Any, upstream_nodes: list | None = None, to_node: Any = None, datetime_started_transformation: datetime | None = None) -> None:
        from .frames import FrameKind, convert

        convert(frame, FrameKind.PYSPARK, spark).write.mode("overwrite").parquet(self.path)


class TableCache(ParquetCache):
    """A plain cache in a table of the session's catalog."""

    def exists(self, spark: SparkSession) -> bool:
        return spark.catalog.tableExists(self.path)

    def read(self, spark: SparkSession, from_node: Any = None, to_node: Any = None, is_static: bool = False) -> DataFrame:
        return spark.table(self.path)

    def write(self, spark: SparkSession, frame: Any, upstream_nodes: list | None = None, to_node: Any = None, datetime_started_transformation: datetime | None = None) -> None:
        from .frames import FrameKind, convert

        convert(frame, FrameKind.PYSPARK, spark).write.mode("overwrite").saveAsTable(self.path)
