"""Structured Streaming: file arrival, change feeds, generations, reconciliation."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import store as K
from ..operators.tableset import TableSet


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors share; a local one only in local mode, where the session names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and (known := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        root = known.get()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="wherry-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def arrivals(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 64) -> DataFrame:
    """New files of a folder as they come, in bounded batches."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def appended(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Rows to Parquet, exactly once: the sink's log and the checkpoint name what was written."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def sync_mode(completed: bool, checkpoint: str | None, expired: bool = False) -> str:
    """``incremental`` only after a completed full run with a checkpoint that is still known."""
    return "incremental" if completed and checkpoint and not expired else "full"


class VersionedTable:
    """A Parquet table of whole versions: a version is read only once all of it is written."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        p, fs = self._fs()
        if not fs.exists(p):
            return []
        done = []
        for s in fs.listStatus(p):
            name = s.getPath().getName()
            if name.startswith("v") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
                done.append(int(name[1:]))
        return sorted(done)

    def read(self) -> DataFrame:
        known = self.versions()
        if not known:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{known[-1]}")

    def write(self, rows: DataFrame, version: int) -> None:
        """Write a version; a repeated batch writes the same version again."""
        rows.write.mode("overwrite").parquet(f"{self.path}/v{version}")
        # the version before stays for readers that have begun, and for a batch that comes again
        p, fs = self._fs()
        for old in self.versions()[:-2]:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(p, f"v{old}"), True)


def upserting(table: VersionedTable, key: str, order: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: the last row of each key replaces what the table has, if it is newer.

    Batches may come again after a failure: a version is named by its batch, so it is replaced.
    """

    def apply(batch: DataFrame, number: int) -> None:
        if table.versions()[-1:] and table.versions()[-1] > number:
            return  # a batch that came again after later ones
        old = table.read() if not table.versions() or table.versions()[-1] < number else _before(table, number)
        table.write(K.latest(old.unionByName(batch.select(old.columns)), key, order), number)

    return apply


def _before(table: VersionedTable, number: int) -> DataFrame:
    known = [v for v in table.versions() if v < number]
    return table.spark.read.schema(table.schema).parquet(f"{table.path}/v{known[-1]}") if known else table.spark.createDataFrame([], table.schema)


def merging(tables: TableSet, name: str, key: str, order: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function like ``upserting``, for a table in buckets of its key: only the buckets of a batch's keys are rewritten.

    A batch that comes again changes nothing; the last two versions stay.
    """

    def apply(batch: DataFrame, number: int) -> None:
        base = tables.manifest()
        keys = batch.select(key).distinct()
        rows = batch
        if name in base["tables"]:
            old = tables.read(name, tables.asked(keys, key), base)
            rows = old.join(keys.withColumnRenamed(key, "__key"), F.col(key).eqNullSafe(F.col("__key")), "left_semi").unionByName(batch.select(old.columns))
        tables.cascade({name: K.latest(rows, key, order)}, keys, key, number)
        tables.vacuum()

    return apply
