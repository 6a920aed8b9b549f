"""Stored tables whose changes are whole versions.

A table is a folder with ``data`` (a folder per commit, in it one per cell), ``manifests``
(a small table per version that names the commit and the row count of every cell) and
``versions`` (a file per version that names its manifest). A cell is a hash bucket of a
tenant's rows. A change reads only the cells it touches, writes them to a new commit, writes
the manifest that has these cells in place of the old ones, and then creates the version's
file, which fails if it is there: that one creation switches the table. A job that dies
before leaves the old version as it was, and of two changes at once one fails.

Whatever only drops cells, as the purge of a tenant, edits the manifest alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from loomery.session import PACKED, materialize, shuffles_end

MAX_ROWS_PER_FILE = 2_000_000
MANIFEST = "tenant_id string, cell string, commit string, rows bigint"


class VersionedTable:
    """Rows of ``schema`` (with tenant_id) under ``path``, dealt to cells by tenant and ``bucket_by``."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, bucket_by: str, buckets: int = 8):
        self.spark, self.path, self.schema, self.bucket_by, self.buckets = spark, path, schema, bucket_by, buckets

    # ---- versions --------------------------------------------------------

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _current(self) -> tuple[int, str | None, int]:
        """(version, folder of its manifest, tag); version 0 is the empty table."""
        fs, folder = self._fs(f"{self.path}/versions")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        numbers = [int(n) for n in names if n.isdigit()]
        if not numbers:
            return 0, None, -1
        name, tag = self.spark.read.text(f"{self.path}/versions/{max(numbers):012d}").first()[0].split()
        return max(numbers), f"{self.path}/manifests/{name}", int(tag)

    @property
    def tag(self) -> int:
        """The tag of the last change that had one (a stream's batch id); -1 before."""
        return self._current()[2]

    def manifest(self) -> DataFrame:
        return self._manifest_at(self._current()[1])

    def _manifest_at(self, folder: str | None) -> DataFrame:
        if folder is None:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(folder)

    def _switch(self, was: int, cells: DataFrame, tag: int) -> None:
        name = uuid.uuid4().hex
        cells.select("tenant_id", "cell", "commit", "rows").write.parquet(f"{self.path}/manifests/{name}")
        fs, at = self._fs(f"{self.path}/versions/{was + 1:012d}")
        out = fs.create(at, False)  # fails if another change came first
        out.write(bytearray(f"{name} {tag}".encode()))
        out.close()

    # ---- rows ------------------------------------------------------------

    def _cell(self) -> Column:
        bucket = F.pmod(F.xxhash64(self.bucket_by), F.lit(self.buckets))
        return F.concat_ws("-", F.substring(F.sha2("tenant_id", 256), 1, 32), bucket.cast("string"))

    def _read(self, cells: DataFrame) -> DataFrame:
        folders = [f"{self.path}/data/c={r['commit']}/cell={r['cell']}" for r in cells.select("commit", "cell").distinct().collect()]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def rows(self, tenant: str | None = None) -> DataFrame:
        """All rows of the current version, or one tenant's, of which only the cells are read."""
        cells = self.manifest()
        return self._read(cells if tenant is None else cells.where(F.col("tenant_id") == tenant))

    def rows_near(self, keys: DataFrame) -> DataFrame:
        """Rows of the cells that ``keys`` (tenant_id and the bucket column) fall in."""
        hit = keys.select(self._cell().alias("cell")).distinct()
        return self._read(self.manifest().join(hit, "cell", "left_semi"))

    def _write(self, rows: DataFrame) -> DataFrame:
        """A commit of ``rows``; its manifest entries."""
        commit = uuid.uuid4().hex
        new = rows.select(*self.schema.names).withColumn("cell", self._cell())
        # rebalanced: a cell is few files, a large one is split over tasks
        packed = new.hint("rebalance", "cell").write.option("maxRecordsPerFile", MAX_ROWS_PER_FILE).option("compression", PACKED)
        with shuffles_end(self.spark):
            packed.partitionBy("cell").parquet(f"{self.path}/data/c={commit}")
        whole = StructType([*self.schema.fields, StructField("cell", StringType())])
        written = self.spark.read.schema(whole).parquet(f"{self.path}/data/c={commit}").groupBy("tenant_id", "cell").agg(F.count("*").alias("rows"))
        return written.withColumn("commit", F.lit(commit))

    def add(self, rows: DataFrame) -> None:
        """More rows as a commit of their own; what lies there is not rewritten.

        A cell then has a folder for each commit; :meth:`change` with its rows as they are joins them.
        """
        version, folder, last = self._current()
        self._switch(version, materialize(self._manifest_at(folder).unionByName(self._write(rows)), "cells"), last)

    def change(self, touched: DataFrame, make: Callable[[DataFrame], DataFrame], tag: int | None = None) -> DataFrame:
        """Put ``make(rows of the touched cells)`` in their place.

        ``touched`` has tenant_id and the bucket column; ``make`` must keep to these cells.
        Returns rows_before and rows_after by touched tenant, as the manifests count them.
        """
        version, folder, last = self._current()
        cells = self._manifest_at(folder)
        hit = materialize(touched.select(self._cell().alias("cell"), "tenant_id").distinct(), "touched-cells")
        written = self._write(make(self._read(cells.join(hit, "cell", "left_semi"))))
        after = materialize(cells.join(hit, "cell", "left_anti").unionByName(written), "cells")
        self._switch(version, after, last if tag is None else tag)
        both = cells.select("tenant_id", F.col("rows").alias("b"), F.lit(0).alias("a")).unionAll(after.select("tenant_id", F.lit(0), "rows"))
        counts = both.join(hit.select("tenant_id").distinct(), "tenant_id", "left_semi").groupBy("tenant_id")
        return counts.agg(F.sum("b").alias("rows_before"), F.sum("a").alias("rows_after"))

    def append(self, rows: DataFrame, tag: int | None = None) -> None:
        self.change(rows, lambda old: old.unionByName(rows.select(*self.schema.names)), tag)

    def upsert(self, changes: DataFrame, key: list[str], version: str) -> None:
        """The latest version of each key; the same changes again leave the same rows.
        ``key`` has the bucket column."""
        from loomery.sources.stores import upsert

        self.change(changes, lambda old: upsert(old, changes.select(*self.schema.names), ["tenant_id", *key], version))

    def delete(self, gone: DataFrame, key: str) -> DataFrame:
        """Rows of ``gone`` (tenant_id, ``key``, which is the bucket column) leave; counts by tenant."""
        ids = gone.select("tenant_id", key).distinct()
        out = self.change(ids, lambda old: old.join(ids, ["tenant_id", key], "left_anti"))
        return out.withColumn("deleted", F.col("rows_before") - F.col("rows_after"))

    def replace(self, owners: DataFrame, rows: DataFrame, tag: int | None = None) -> bool:
        """All rows of ``owners`` (tenant_id and the bucket column) are now those in ``rows``, maybe none.

        With ``tag`` a change that was already made is not made again; returns whether it was made.
        """
        if tag is not None and self.tag >= tag:
            return False
        ids = owners.select("tenant_id", self.bucket_by).distinct()
        self.change(ids, lambda old: old.join(ids, ["tenant_id", self.bucket_by], "left_anti").unionByName(rows.select(*self.schema.names)), tag)
        return True

    def purge(self, gone: Column) -> None:
        """Drop the tenants for which ``gone`` (over tenant_id) holds: an edit of the manifest."""
        version, folder, last = self._current()
        self._switch(version, self._manifest_at(folder).where(~F.coalesce(gone, F.lit(False))), last)

    def vacuum(self) -> int:
        """Remove folders that the current version doesn't name; returns how many.

        Only the folders' names pass through the driver, as in any listing, and each goes
        in one call. Not to be run beside a change.
        """
        live = {(r["commit"], r["cell"]) for r in self.manifest().select("commit", "cell").distinct().collect()}
        kept = {c for c, _ in live}
        fs, folder = self._fs(f"{self.path}/data")
        removed = 0
        for commit in fs.listStatus(folder) if fs.exists(folder) else []:
            name = commit.getPath().getName().removeprefix("c=")
            if name not in kept:
                removed += fs.delete(commit.getPath(), True)
                continue
            for cell in fs.listStatus(commit.getPath()):
                own = cell.getPath().getName()
                if own.startswith("cell=") and (name, own.removeprefix("cell=")) not in live:
                    removed += fs.delete(cell.getPath(), True)
        return removed
