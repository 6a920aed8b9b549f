"""Catalogue, tenants, quotas, audits and tiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery import constants as k
from loomery.operators.topk import top_k


def page(df: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    """One page plus total and has_more on every row; the sort keeps only the page's head."""
    total = df.agg(F.count("*").alias("total")).scalar()
    rows = df.orderBy(*order).offset(offset).limit(size)
    return rows.withColumn("total", total).withColumn("has_more", F.lit(offset + size) < F.col("total"))


def page_per_group(df: DataFrame, by: str, order: list[Column], offset: int, size: int) -> DataFrame:
    """The same page of every group at once."""
    total = df.groupBy(by).agg(F.count("*").alias("total"))
    rows = top_k(df, by, order, offset + size, "place").where(F.col("place") > offset)
    return rows.join(total, by).withColumn("has_more", F.lit(offset + size) < F.col("total"))


def document_detail(documents: DataFrame, chunks: DataFrame, first: int = 10) -> DataFrame:
    """Documents with their first chunks by index, contents as short previews."""
    short = chunks.withColumn("preview", F.substring("content", 1, k.PREVIEW_CHARS)).drop("content")
    head = top_k(short, "document_id", [F.asc("chunk_index")], first, "place")
    return documents.join(head.drop("place"), "document_id", "left")


def status_progress(status: Column) -> Column:
    return F.when(status == "completed", 1.0).when(status == "processing", 0.5).when(status == "indexing", 0.8).otherwise(0.0)


def document_progress(documents: DataFrame, progress_log: DataFrame) -> DataFrame:
    """Progress by status; the latest logged task progress overrides it."""
    last = progress_log.groupBy("document_id").agg(F.max_by("progress", F.struct("ts", "progress")).alias("logged"))
    out = documents.join(last, "document_id", "left")
    return out.withColumn("progress", F.coalesce("logged", status_progress(F.col("status")))).drop("logged")


def check_quota(kind: Column, documents: Column, storage_mb: Column, queries: Column, max_documents: Column, max_storage: Column, max_queries: Column) -> Column:
    """Current below the limit of its kind; an unknown kind has limit 0."""
    current = F.when(kind == "documents", documents).when(kind == "storage", storage_mb).when(kind == "queries", queries).otherwise(0)
    limit = F.when(kind == "documents", max_documents).when(kind == "storage", max_storage).when(kind == "queries", max_queries).otherwise(0)
    return current < limit


def usage_percent(current: Column, limit: Column) -> Column:
    return F.when(limit > 0, 100.0 * current / limit).otherwise(0.0)


def tenant_usage(tenants: DataFrame) -> DataFrame:
    return tenants.withColumns(
        {
            "documents_pct": usage_percent(F.col("current_documents"), F.col("max_documents")),
            "storage_pct": usage_percent(F.col("current_storage_mb"), F.col("max_storage_mb")),
            "queries_pct": usage_percent(F.col("queries_today"), F.col("max_queries_per_day")),
        }
    )


def query_counters(log: DataFrame, tenant: str = "tenant_id", ts: str = "ts") -> DataFrame:
    """Per tenant and day: queries and the last of them. The day's count starts at midnight."""
    return log.groupBy(F.col(tenant).alias("tenant_id"), F.to_date(ts).alias("day")).agg(F.count("*").alias("queries"), F.max(ts).alias("last_query_at"))


def access_statistics(log: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    return log.groupBy(key).agg(F.count("*").alias("access_count"), F.max(ts).alias("last_accessed_at"))


def system_totals(parts: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """One (metric, value) row per named aggregate; those over one table take one scan of it."""
    tables: dict[int, tuple[DataFrame, list[Column]]] = {}
    for name, (df, agg) in parts.items():
        tables.setdefault(id(df), (df, []))[1].append(F.struct(F.lit(name).alias("metric"), agg.cast("double").alias("value")))
    rows = [df.agg(F.array(*aggs).alias("_r")).select(F.inline("_r")) for df, aggs in tables.values()]
    return reduce(DataFrame.unionAll, rows)


def isolation_audit(stores: dict[str, DataFrame], documents: DataFrame) -> DataFrame:
    """Per store and tenant: rows, rows owned by another tenant, rows without a document.

    Store rows are counted per document first, so a document or tenant with
    very many rows joins as one row.
    """
    counted = [
        df.groupBy("tenant_id", "document_id").agg(F.count("*").alias("n")).select(F.lit(s).alias("store"), "*") for s, df in stores.items()
    ]
    owner = documents.select("document_id", F.col("tenant_id").alias("owner"))
    j = reduce(DataFrame.unionByName, counted).join(owner, "document_id", "left")
    out = j.groupBy("store", "tenant_id").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("owner") != F.col("tenant_id"), F.col("n")).otherwise(0)).alias("foreign_rows"),
        F.sum(F.when(F.col("owner").isNull(), F.col("n")).otherwise(0)).alias("orphan_rows"),
    )
    return out.withColumn("isolated", (F.col("foreign_rows") == 0) & (F.col("orphan_rows") == 0))


def store_names(slug: Column, prefix: str = "loom") -> dict[str, Column]:
    return {
        "vector_store": F.concat(F.lit(f"{prefix}_"), slug, F.lit("_chunks")),
        "keyword_store": F.concat(F.lit(f"{prefix}_"), slug, F.lit("_docs")),
        "graph_label": F.concat(F.lit("Tenant_"), slug),
    }


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def reject_existing(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """New rows whose key is free."""
    return new.join(existing.select(key), key, "left_anti")


def partial_update(df: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Only set (non-null) fields of ``updates`` change."""
    fields = [c for c in updates.columns if c != key]
    u = updates.select(key, *[F.col(c).alias(f"_u_{c}") for c in fields])
    out = df.join(u, key, "left")
    return out.withColumns({c: F.coalesce(f"_u_{c}", c) for c in fields}).drop(*[f"_u_{c}" for c in fields])


def storage_tier(age_days: Column, per_day: Column) -> Column:
    """Hot when young or busy, warm when not yet old and still asked, else cold."""
    return (
        F.when((age_days <= k.HOT_DAYS) | (per_day >= k.PROMOTE_PER_DAY), "hot")
        .when((age_days <= k.WARM_DAYS) & (per_day > k.DEMOTE_PER_DAY), "warm")
        .otherwise("cold")
    )


def merge_fragments(chunks: DataFrame, min_tokens: int = k.CHUNK_MIN_TOKENS, max_tokens: int = k.CHUNK_MAX_TOKENS) -> DataFrame:
    """Adjacent tiny chunks of a document joined, with the fold of the chunker.

    A document's chunks are gathered into its row (a document is bounded by the
    upload limit).
    """
    from loomery.operators.chunking import chunk_sections
    from loomery.sources.sections import section

    item = F.struct("chunk_index", section(F.col("content"), F.col("page_number"), F.col("chunk_type"), None, F.col("heading_text")).alias("s"))
    docs = chunks.groupBy("tenant_id", "document_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["s"]).alias("sections"))
    return chunk_sections(docs, document_id="document_id", min_tokens=min_tokens, max_tokens=max_tokens, min_overlap=10**9)
