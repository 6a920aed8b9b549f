"""How the given tables play the parts of the catalogue, in Spark and in SQL.

Documents are tenant-scoped by ``source``; the catalogue columns the tables do
not carry (file type, size, quotas, times) are derived from their own values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.session import spread, table

# Stand-in file types by document id: six supported ones and two that are not.
FILE_TYPES = ["pdf", "docx", "doc", "txt", "html", "md", "exe", "csv"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tenant_id, doc_id, text."""
    df = table(spark, sf_dir, "documents").select(F.col("source").alias("tenant_id"), "doc_id", "text")
    return spread(df, "doc_id")


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(t) for t in FILE_TYPES])
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("source").alias("tenant_id"),
        F.get(kinds, (F.col("doc_id") % len(FILE_TYPES)).cast("int")).alias("file_type"),
        (F.col("n_chars") * 20000).alias("file_size"),
    )


UPLOADS_SQL = (
    "select doc_id, source as tenant_id, ["
    + ", ".join(f"'{t}'" for t in FILE_TYPES)
    + f"][(doc_id % {len(FILE_TYPES)})::int + 1] as file_type, n_chars * 20000 as file_size from documents"
)


def _source_no():
    return F.regexp_extract("tenant_id", r"(\d+)$", 1).cast("int")


def tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per source: quotas derived from its number, usage from its documents."""
    n = F.col("n")
    usage = (
        table(spark, sf_dir, "documents")
        .groupBy(F.col("source").alias("tenant_id"))
        .agg(F.count("*").alias("current_documents"), F.sum("n_chars").alias("current_bytes"))
    )
    return usage.withColumn("n", _source_no()).select(
        "tenant_id",
        F.concat(F.lit("tenant-"), n.cast("string")).alias("slug"),
        F.concat(F.lit("Tenant "), n.cast("string")).alias("name"),
        (n % 5 != 0).alias("is_active"),
        (n % 7 == 6).alias("is_deleted"),
        F.when(n % 6 == 3, 0).otherwise(40 + n * 2).cast("bigint").alias("max_documents"),
        F.when(n % 9 == 4, 0).otherwise(n + 1).cast("bigint").alias("max_storage_mb"),
        (100 + n * 10).cast("bigint").alias("max_queries_per_day"),
        "current_documents",
        "current_bytes",
    )


TENANTS_SQL = """
select tenant_id, 'tenant-' || n as slug, 'Tenant ' || n as name, n % 5 <> 0 as is_active, n % 7 = 6 as is_deleted,
  (case when n % 6 = 3 then 0 else 40 + n * 2 end)::bigint as max_documents,
  (case when n % 9 = 4 then 0 else n + 1 end)::bigint as max_storage_mb,
  (100 + n * 10)::bigint as max_queries_per_day, current_documents, current_bytes
from (select source as tenant_id, regexp_extract(source, '([0-9]+)$', 1)::int as n, count(*)::bigint as current_documents,
        sum(n_chars)::bigint as current_bytes from documents group by source)
"""


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document rows of the catalogue: status, times and soft-delete flags."""
    from loomery.constants import STATUSES

    states = F.array(*[F.lit(s) for s in STATUSES])
    doc = F.col("doc_id")
    return uploads(spark, sf_dir).select(
        "*",
        F.get(states, (doc * 7 % 6).cast("int")).alias("status"),
        (doc % 11 == 4).alias("is_deleted"),
        F.timestamp_seconds(F.lit(1704067200) + doc * 7919 % 2592000).alias("created_at"),
    )


CATALOGUE_SQL = f"""
select u.*, ['pending','processing','indexing','completed','failed','deleted'][(doc_id * 7 % 6)::int + 1] as status,
  doc_id % 11 = 4 as is_deleted, make_timestamp((1704067200 + doc_id * 7919 % 2592000)::bigint * 1000000) as created_at
from ({UPLOADS_SQL}) u
"""


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query batch: every benchmark item."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
