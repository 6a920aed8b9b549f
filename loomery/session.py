"""Session, table and scratch-folder helpers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Small sides are collected or broadcast only up to this many rows; beyond it
# operators take their shuffle route.
BROADCAST_MAX_ROWS = 100_000
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
PACKED = "zstd"  # of stored tables, which stay to the end


def build_session(app: str = "loomery", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever they run; once per context.

    Workers then import it once and keep loaded models between tasks.
    """
    context = spark.sparkContext
    if getattr(context, "_loomery_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp")) / "loomery.zip"  # Spark copies it to the workers
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(path))
    context._loomery_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give CPU-heavy work one partition per core when the scan has fewer.

    A single-row-group file scans as one task. A large input already has many
    splits and is returned unchanged, so no shuffle of the texts is added.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want, *keys)


_fallback_root: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a local one only where unset."""
    global _fallback_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _fallback_root is None:
        _fallback_root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _fallback_root


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def fits(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> bool:
    """True when ``df`` has at most ``max_rows`` rows; reads no more than that."""
    return df.limit(max_rows + 1).count() <= max_rows


@contextmanager
def shuffles_end(spark: SparkSession):
    """What is stored inside leaves no shuffle files; they would lie there until the driver collects its garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Compute once into a table in the shared folder (or at ``path`` there) and read that:
    cuts the lineage and survives lost executors."""
    path = path or scratch_dir(df.sparkSession, name)
    with shuffles_end(df.sparkSession):
        df.write.option("compression", PACKED).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table of the shared folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


_kept: dict[tuple, object] = {}


def stored_once(spark: SparkSession, make, *key):
    """What ``make`` stores (an index, vectors, a graph), once per application and key.

    Searches of one application share it; a table is taken as it is when first asked for.
    """
    key = (spark.sparkContext.applicationId, make.__module__, *key)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]
