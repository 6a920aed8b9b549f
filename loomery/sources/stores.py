"""Vector, keyword and graph tables: writes, upserts, deletes, statistics.

Changes of stored tables are versions (see :mod:`loomery.sources.versions`), so a job
never overwrites what it reads and a failed job leaves the old version whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery import constants as k
from loomery.session import discard, materialize, scratch_dir
from loomery.sources.versions import VersionedTable

MAX_ROWS_PER_FILE = 2_000_000
STORES = ("vectors", "keywords", "chunks", "mentions")


def write_store(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).option("maxRecordsPerFile", MAX_ROWS_PER_FILE).partitionBy("tenant_id").parquet(path)


def vector_rows(chunks: DataFrame) -> DataFrame:
    """The ten columns of the vector table."""
    return chunks.select(
        F.col("chunk_id").alias("id"), "tenant_id", "document_id", "chunk_id", F.coalesce("page_number", F.lit(0)).alias("page_number"), "chunk_index",
        "chunk_type", F.coalesce("heading_text", F.lit("")).alias("heading_text"),
        "content", "embedding",
    )


def keyword_rows(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", "tenant_id", "document_id", "page_number", "chunk_index", "chunk_type", "heading_text", "content")


def chunk_rows(chunks: DataFrame) -> DataFrame:
    """Metadata rows: one per chunk, marked as embedded."""
    cols = ["chunk_id", "tenant_id", "document_id", "chunk_index", "page_number", "chunk_type", "heading_text", "content_hash", "token_count"]
    return chunks.select(*cols, F.lit("completed").alias("embedding_status"))


def upsert(current: DataFrame, changes: DataFrame, key: list[str], version: str) -> DataFrame:
    """One row per key, the latest version. Combined map-side, so a key with very
    many versions is no hot spot."""
    both = current.unionByName(changes)
    rest = [c for c in both.columns if c not in key]
    order = F.struct(version, *[c for c in rest if c != version])
    return both.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_l")).select(*key, "_l.*").select(*both.columns)


def split_bad_rows(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with ``errors``): bad rows are set aside, not raised."""
    marked = df.withColumn("errors", F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks.items()])))
    return marked.where(F.size("errors") == 0).drop("errors"), marked.where(F.size("errors") > 0)


def delete_where(df: DataFrame, ids: DataFrame | None = None, document_ids: DataFrame | None = None, tenant: str | None = None,
                 id_column: str = "chunk_id") -> DataFrame:
    """What is left after a delete; the given conditions hold together, none deletes nothing."""
    marks = []
    if ids is not None:
        df = df.join(ids.select(id_column).distinct().withColumn("_m1", F.lit(True)), id_column, "left")
        marks.append("_m1")
    if document_ids is not None:
        df = df.join(document_ids.select("document_id").distinct().withColumn("_m2", F.lit(True)), "document_id", "left")
        marks.append("_m2")
    hit = [F.coalesce(m, F.lit(False)) for m in marks] + ([F.col("tenant_id") == tenant] if tenant is not None else [])
    if not hit:
        return df
    return df.where(~reduce(lambda a, b: a & b, hit)).drop(*marks)


def delete_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per tenant: rows before, after and deleted."""
    both = before.select("tenant_id", F.lit(1).alias("b"), F.lit(0).alias("a")).unionAll(after.select("tenant_id", F.lit(0), F.lit(1)))
    out = both.groupBy("tenant_id").agg(F.sum("b").alias("rows_before"), F.sum("a").alias("rows_after"))
    return out.withColumn("deleted", F.col("rows_before") - F.col("rows_after"))


def soft_delete(documents: DataFrame, gone: DataFrame, at: Column) -> DataFrame:
    """Flag the documents in ``gone`` (document_id); the rest is unchanged."""
    mark = gone.select("document_id").distinct().withColumn("_gone", F.lit(True))
    hit = F.coalesce("_gone", F.lit(False)) & ~F.col("is_deleted")
    out = documents.join(mark, "document_id", "left").withColumn("_hit", hit)
    return out.withColumns(
        {
            "is_deleted": F.col("is_deleted") | F.col("_hit"),
            "status": F.when(F.col("_hit"), "deleted").otherwise(F.col("status")),
            "deleted_at": F.when(F.col("_hit"), at).otherwise(F.col("deleted_at")),
        }
    ).drop("_gone", "_hit")


def cascade_delete(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks flagged when their document is deleted."""
    gone = documents.where("is_deleted").select("document_id").withColumn("_gone", F.lit(True))
    return chunks.join(gone, "document_id", "left").withColumn("is_deleted", F.coalesce("_gone", F.lit(False))).drop("_gone")


def purge_tenants(stores: dict[str, DataFrame], prefixes: list[str], column: str = "tenant_id") -> dict[str, DataFrame]:
    """Every store without the tenants whose name starts with one of the prefixes."""
    hit = reduce(lambda a, b: a | b, [F.startswith(F.col(column), F.lit(p)) for p in prefixes], F.lit(False))
    return {name: df.where(~hit) for name, df in stores.items()}


def purge_tables(tables: dict[str, VersionedTable], prefixes: list[str]) -> None:
    """Stored tables without the tenants whose name starts with one of the prefixes."""
    hit = reduce(lambda a, b: a | b, [F.startswith(F.col("tenant_id"), F.lit(p)) for p in prefixes], F.lit(False))
    for table in tables.values():
        table.purge(hit)


def store_statistics(vectors: DataFrame, keywords: DataFrame, entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """(store, metric, value) over all stores."""

    def one(df, store, metric, agg):
        return df.agg(agg.cast("bigint").alias("value")).select(F.lit(store).alias("store"), F.lit(metric).alias("metric"), "value")

    rows = [
        one(vectors, "vectors", "rows", F.count("*")),
        one(keywords, "keywords", "documents", F.count("*")),
        one(keywords, "keywords", "bytes", F.coalesce(F.sum(F.octet_length("content")), F.lit(0))),
        one(entities, "graph", "entities", F.count("*")),
        one(mentions.select("chunk_id").distinct(), "graph", "chunks", F.count("*")),
        one(mentions, "graph", "relationships", F.count("*")),
    ]
    return reduce(DataFrame.unionAll, rows)


def source_lookup(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunk with the name of its document in the same tenant, else 'Unknown'."""
    names = documents.select("tenant_id", "document_id", F.col("name").alias("document_name"))
    out = chunks.join(names, ["tenant_id", "document_id"], "left")
    return out.withColumn("document_name", F.coalesce("document_name", F.lit("Unknown")))


def ingest(documents: DataFrame, root: str, encoder, separator: str = "\n", **limits) -> dict[str, str]:
    """Documents (tenant_id, document_id, text) -> chunks -> all stores; the folders written.

    The chunks are stored first and the other stores are made from that table,
    so texts are split, cleaned and hashed once.
    """
    from loomery.operators.chunking import chunk_text
    from loomery.operators.embedding import encode
    from loomery.operators.graph import chunk_nodes, extract_mentions

    spark = documents.sparkSession
    paths = {s: f"{root}/{s}" for s in ("staged", *STORES, "nodes")}
    staged = chunk_text(documents, separator=separator, document_id="document_id", clean=True, **limits)
    write_store(staged, paths["staged"], "overwrite")
    chunks = spark.read.schema(staged.schema).parquet(paths["staged"])
    write_store(vector_rows(chunks.withColumn("embedding", encode(encoder)("content"))), paths["vectors"], "overwrite")
    write_store(keyword_rows(chunks), paths["keywords"], "overwrite")
    write_store(chunk_rows(chunks), paths["chunks"], "overwrite")
    write_store(chunk_nodes(chunks.select("tenant_id", "chunk_id", "document_id", "chunk_index", "page_number", "content")), paths["nodes"], "overwrite")
    write_store(extract_mentions(chunks), paths["mentions"], "overwrite")
    return paths


def _mention_rows(chunks: DataFrame) -> DataFrame:
    from loomery.functions.text import entity_set

    return chunks.select("tenant_id", "document_id", "chunk_id", F.explode(entity_set(F.col("content"))).alias("entity_id"))


def store_rows(chunks: DataFrame, encoder) -> dict[str, DataFrame]:
    """The rows of every store for chunks of documents; all have tenant_id and document_id."""
    from loomery.operators.embedding import encode

    return {
        "vectors": vector_rows(chunks.withColumn("embedding", encode(encoder)("content"))),
        "keywords": keyword_rows(chunks),
        "chunks": chunk_rows(chunks),
        "mentions": _mention_rows(chunks),
    }


def open_stores(documents: DataFrame, root: str, encoder, buckets: int = 4) -> dict[str, VersionedTable]:
    """The stores under ``root`` as versioned tables, dealt by document.

    ``documents`` (tenant_id, document_id, text) gives the types only.
    """
    from loomery.operators.chunking import chunk_text

    spark = documents.sparkSession
    nothing = chunk_text(spark.createDataFrame([], documents.schema), document_id="document_id")
    return {
        name: VersionedTable(spark, f"{root}/{name}", rows.schema, "document_id", buckets) for name, rows in store_rows(nothing, encoder).items()
    }


def ingest_batch(tables: dict[str, VersionedTable], documents: DataFrame, encoder, batch_id: int, separator: str = "\n", clean: bool = True, **limits) -> None:
    """Documents into all stores, each taking the place of what the stores had of it.

    A batch that is run again, also after it failed between two stores, changes only the
    stores it hadn't reached: every store keeps the id of its last batch.
    """
    from loomery.operators.chunking import chunk_text

    if all(t.tag >= batch_id for t in tables.values()):
        return
    owners = materialize(documents.select("tenant_id", "document_id").distinct(), "owners")
    path = scratch_dir(documents.sparkSession, "chunks")
    chunks = materialize(chunk_text(documents, separator=separator, document_id="document_id", clean=clean, **limits), "chunks", path)
    for name, rows in store_rows(chunks, encoder).items():
        tables[name].replace(owners, rows, batch_id)
    discard(documents.sparkSession, path)  # every store has them now
