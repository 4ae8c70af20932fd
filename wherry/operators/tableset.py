"""Several tables in one folder, in buckets of their keys, whose versions are committed together."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 32


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class TableSet:
    """Tables of Parquet files under ``root``; a manifest names the files of each table's buckets.

    A version is a manifest. It is written whole and gets its name by a rename, after all files
    it names are there, so readers see all tables of a version or none, and what they read stays
    until ``vacuum``. A version also names the batch it came from: a batch that comes again is
    not applied again. One writer at a time, as a streaming query is; readers need no lock.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    # ------------------------------------------------------------------ files

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(), self._path(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self._names("_manifest") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        """The latest version's manifest, or that of an earlier one."""
        known = self.versions()
        if not known:
            return {"version": 0, "batch": None, "tables": {}}
        stream = self._fs().open(self._path(f"_manifest/{version or known[-1]:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    # ------------------------------------------------------------------ writing

    def laid(self, name: str, rows: DataFrame, version: int, order: Iterable[str] = ()) -> dict:
        """Write rows for a version to come where they are: nothing moves, so no disk is used but for the files.

        Rows with a ``bucket`` column lie in buckets, each task's in the order of the ``order``
        columns; without one they are files of one bucket, in the order in which they come.
        """
        folder = f"{name}/v{version}"
        dealt = "bucket" in rows.columns
        kept = (rows.sortWithinPartitions("bucket", *order) if dealt else rows).write.mode("overwrite").option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0")
        kept.partitionBy("bucket").parquet(f"{self.root}/{folder}") if dealt else kept.parquet(f"{self.root}/{folder}/bucket=0")
        files = {n.removeprefix("bucket="): [f"{folder}/{n}"] for n in self._names(folder) if n.startswith("bucket=")}
        return {"schema": rows.drop("bucket").schema.jsonValue(), "files": files}

    def staged(self, name: str, rows: DataFrame, version: int, spread: Iterable[str] = ()) -> dict:
        """Write rows with a ``bucket`` column for a version to come; what the manifest needs to know of them.

        Rows are dealt by bucket and the ``spread`` columns, in whose order they also lie in the
        files, so that a bucket with a hot key is several files and a filter on the first of them
        skips row groups. Files that an attempt left before are replaced.
        """
        order = ["bucket", *spread]
        folder = f"{name}/v{version}"
        rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{folder}")
        files = {n.removeprefix("bucket="): [f"{folder}/{n}"] for n in self._names(folder) if n.startswith("bucket=")}
        return {"schema": rows.drop("bucket").schema.jsonValue(), "files": files}

    def commit(self, base: dict, tables: dict, batch: int | None = None) -> int:
        """Make the version after ``base``: its tables with those of ``tables`` in their place."""
        version = base["version"] + 1
        if self.versions()[-1:] != ([base["version"]] if base["version"] else []):
            raise RuntimeError(f"another writer has made a version after {base['version']}")
        made = {"version": version, "batch": base["batch"] if batch is None else batch, "buckets": self.buckets, "tables": base["tables"] | tables}
        fs, draft, done = self._fs(), self._path(f"_manifest/.{version:012d}.draft"), self._path(f"_manifest/{version:012d}.json")
        out = fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps(made).encode()))
        finally:
            out.close()
        if fs.exists(done) or not fs.rename(draft, done):
            raise RuntimeError(f"version {version} could not be committed")
        return version

    def added(self, base: dict, name: str, staged: dict) -> dict:
        """A table's entry with staged files beside those of ``base``."""
        old = base["tables"].get(name, {"files": {}})["files"]
        return staged | {"files": {b: old.get(b, []) + staged["files"].get(b, []) for b in sorted({*old, *staged["files"]})}}

    def replaced(self, base: dict, name: str, key: str, rows: DataFrame, keys: DataFrame, version: int) -> dict:
        """A table's entry in which all rows of ``keys`` are gone and ``rows`` have come: only their buckets are rewritten."""
        changed = keys.select(F.col(key).alias("__key")).distinct()
        asked = self.asked(keys, key)
        new = rows.withColumn("bucket", bucket_of(F.col(key), self.buckets))
        if name in base["tables"]:
            old = self.read(name, asked, base).join(changed.select("__key"), F.col(key).eqNullSafe(F.col("__key")), "left_anti")
            new = old.withColumn("bucket", bucket_of(F.col(key), self.buckets)).unionByName(new)
        made = self.laid(name, new, version, [key])
        old_files = base["tables"].get(name, {"files": {}})["files"]
        return made | {"files": {b: f for b, f in old_files.items() if int(b) not in asked} | made["files"]}

    def asked(self, keys: DataFrame, key: str) -> list[int]:
        """The buckets of some keys: at most as many as there are buckets."""
        return [r[0] for r in keys.select(bucket_of(F.col(key), self.buckets).alias("b")).distinct().collect()]

    def cascade(self, changes: dict[str, DataFrame], keys: DataFrame, key: str, batch: int) -> int:
        """Replace the rows of ``keys`` in several tables by one version: their new rows come, those without new rows are deleted.

        A batch that was applied already changes nothing. Returns the version.
        """
        base = self.manifest()
        if base["batch"] is not None and base["batch"] >= batch:
            return base["version"]
        version = base["version"] + 1
        return self.commit(base, {n: self.replaced(base, n, key, rows, keys, version) for n, rows in changes.items()}, batch)

    def vacuum(self, keep: int = 2) -> None:
        """Delete manifests but the last ``keep``, and files that none of those names."""
        fs = self._fs()
        for v in self.versions()[:-keep]:
            fs.delete(self._path(f"_manifest/{v:012d}.json"), False)
        kept = [self.manifest(v) for v in self.versions()]
        used = {f for m in kept for t in m["tables"].values() for fs_ in t["files"].values() for f in fs_}
        for name in {t for m in kept for t in m["tables"]}:
            for folder in self._names(name):
                for b in self._names(f"{name}/{folder}"):
                    if b.startswith("bucket=") and f"{name}/{folder}/{b}" not in used:
                        fs.delete(self._path(f"{name}/{folder}/{b}"), True)

    # ------------------------------------------------------------------ reading

    def read(self, name: str, buckets: Iterable[int] | None = None, manifest: dict | None = None) -> DataFrame:
        """A table, or only the files of some of its buckets."""
        m = manifest or self.manifest()
        if name not in m["tables"]:
            raise KeyError(f"no table {name}")
        entry = m["tables"][name]
        files = [f"{self.root}/{f}" for b, fs in sorted(entry["files"].items()) for f in fs if buckets is None or int(b) in set(buckets)]
        schema = StructType.fromJson(entry["schema"])
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)
