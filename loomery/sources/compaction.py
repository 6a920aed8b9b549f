"""Small Parquet files packed into files of about a target size.

Sizes come from a listing, no content is read for the plan. Files between half and twice
the target stay where they are. Smaller ones of a folder are laid end to end and cut at
multiples of the target: a group then holds between half and one and a half times of it,
and a short last group joins the one before. Larger files are cut into equal pieces.
Groups, not files, are the tasks' unit, and no group holds more than twice the target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomery.session import materialize

TARGET_BYTES = 256 << 20


def file_sizes(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, length) of all Parquet files under ``paths``; the contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(list(paths)).select("path", "length")


def plan(files: DataFrame, target: int = TARGET_BYTES) -> DataFrame:
    """(path, length, folder, group, pieces): ``group`` is null for files that stay."""
    sized = files.withColumn("folder", F.regexp_replace("path", r"/[^/]*$", ""))
    small = sized.where(F.col("length") < target / 2)
    before = Window.partitionBy("folder").orderBy("length", "path").rowsBetween(Window.unboundedPreceding, -1)
    cut = small.withColumn("_no", F.floor(F.coalesce(F.sum("length").over(before), F.lit(0)) / target))
    held = Window.partitionBy("folder", "_no")
    last = Window.partitionBy("folder")
    cut = cut.withColumn("_held", F.sum("length").over(held)).withColumn("_last", F.max("_no").over(last))
    short = (F.col("_no") == F.col("_last")) & (F.col("_held") < target / 2) & (F.col("_no") > 0)
    cut = cut.withColumn("_no", F.when(short, F.col("_no") - 1).otherwise(F.col("_no")))
    # a folder's only small file has nothing to be packed with
    alone = F.count("*").over(held) == 1
    packed = cut.select("path", "length", "folder", F.when(~alone, F.concat_ws("-", F.lit("s"), F.xxhash64("folder").cast("string"), F.col("_no").cast("string"))).alias("group"), F.lit(1).alias("pieces"))
    pieces = F.ceil(F.col("length") / target).cast("int")
    large = sized.where(F.col("length") > 2 * target).select("path", "length", "folder", F.concat_ws("-", F.lit("l"), F.xxhash64("path").cast("string")).alias("group"), pieces.alias("pieces"))
    fine = sized.where(F.col("length").between(target / 2, 2 * target)).select("path", "length", "folder", F.lit(None).cast("string").alias("group"), F.lit(1).alias("pieces"))
    return packed.unionByName(large).unionByName(fine)


def compact(spark: SparkSession, paths: list[str], out: str, target: int = TARGET_BYTES) -> tuple[list[str], DataFrame]:
    """Rewrite what the plan groups; (paths that are now the table, the plan).

    New files go to ``out``; nothing is overwritten or removed, so a reader of the old
    files goes on and a job that dies leaves them as they were. Rows of a file stay in
    their order. The paths pass through the driver, as in any listing.
    """
    planned = materialize(plan(file_sizes(spark, *paths), target), "file-plan")
    kept = [r["path"] for r in planned.where("group is null").select("path").collect()]
    moved = [r["path"] for r in planned.where("group is not null").select("path").collect()]
    if not moved:
        return kept, planned
    groups = planned.where("group is not null").select(F.col("path").alias("_path"), "group", "pieces")
    rows = spark.read.parquet(*moved)
    names = rows.columns
    # one listing names a file "file:/x", another "file:///x"
    at = F.regexp_replace("_metadata.file_path", r"^file:/+", "/")
    rows = rows.select("*", at.alias("_path"), F.col("_metadata.row_index").alias("_row"))
    groups = groups.withColumn("_path", F.regexp_replace("_path", r"^file:/+", "/"))
    # numbers go with the rows, not names, which take more room than many a row
    place = F.xxhash64("group", F.pmod("_row", "pieces"))
    placed = rows.join(groups, "_path").select(*names, place.alias("_group"), F.xxhash64("_path").alias("_file"), "_row")
    # a group's rows meet in one task, at most twice the target
    sized = placed.repartition(max(1, len(moved)), "_group").sortWithinPartitions("_group", "_file", "_row")
    sized.select(*names, "_group").write.partitionBy("_group").parquet(out)
    fresh = [r["path"] for r in file_sizes(spark, out).select("path").collect()]
    return kept + fresh, planned
