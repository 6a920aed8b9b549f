"""Structured Streaming forms of ingest, status, rates, sessions and cache hits.

Sinks write one folder per micro-batch, named by its id and overwritten when a
batch is retried; together with the checkpoint every batch counts once. Reading
takes, per key, the row of the latest batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from loomery import constants as k
from loomery.operators import metrics

TIMEOUT_SECONDS = 3600


def read_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Files of a folder (or one file) as a stream, with the schema they have now."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    # as a pattern that only matches itself, the path may be one file or a folder
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def batch_folder_sink(out: str, transform: Callable[[DataFrame], DataFrame] | None = None):
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = transform(batch) if transform else batch
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return write


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", transform=None) -> None:
    """Process what is there now and stop; the next run goes on from the checkpoint."""
    run_batches(stream, batch_folder_sink(out, transform), checkpoint, mode)


def run_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    q = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )
    if not q.awaitTermination(TIMEOUT_SECONDS):
        q.stop()
        raise TimeoutError("stream did not finish")


def latest_rows(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """Per key the row of the latest batch that wrote it."""
    df = spark.read.parquet(out)
    rest = [c for c in df.columns if c not in (*keys, "batch")]
    last = F.max_by(F.struct(*rest), "batch").alias("_l")
    return df.groupBy(*keys).agg(last).select(*keys, "_l.*")


def latest_groups(spark: SparkSession, out: str, key: str) -> DataFrame:
    """All rows of the latest batch that brought each key (many rows per key, or none)."""
    df = spark.read.parquet(out)
    last = spark.read.parquet(f"{out}-seen").groupBy(key).agg(F.max("batch").alias("batch"))
    return df.join(last, [key, "batch"], "left_semi").drop("batch")


def ingest_stream(documents: DataFrame, out: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame], version: str | None = None) -> None:
    """New documents (document_id, ...) -> ``prepare`` -> one folder per batch.

    A document that comes again replaces its rows, also by none (see
    :func:`latest_groups`): the ids of a batch are kept in ``<out>-seen``. Of
    several rows of a document in one batch the one with the greatest ``version``
    counts (without it, the greatest row).
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rest = [c for c in batch.columns if c != "document_id"]
        order = F.struct(*([version] if version else []), *[c for c in rest if c != version])
        once = batch.groupBy("document_id").agg(F.max_by(F.struct(*rest), order).alias("_l")).select("document_id", "_l.*").select(*batch.columns)
        once.select("document_id").write.mode("overwrite").parquet(f"{out}-seen/batch={batch_id}")
        prepare(once).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    run_batches(documents, write, checkpoint)


def ingest_stores(documents: DataFrame, root: str, checkpoint: str, encoder, version: str | None = None, **chunking) -> dict:
    """New documents (tenant_id, document_id, text[, version]) into all stores; the tables.

    Each micro-batch replaces its documents in every store. Of several rows of a document
    in one batch the one with the greatest ``version`` counts. A retried batch changes
    nothing in the stores that have it.
    """
    from loomery.sources import stores

    plain = documents.select("tenant_id", "document_id", "text")
    tables = stores.open_stores(plain, root, encoder)

    def write(batch: DataFrame, batch_id: int) -> None:
        order = F.struct(*([version] if version else []), "text")
        once = batch.groupBy("tenant_id", "document_id").agg(F.max_by("text", order).alias("text"))
        stores.ingest_batch(tables, once, encoder, batch_id, **chunking)

    run_batches(documents, write, checkpoint)
    return tables


def timed(stream: DataFrame, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def request_rates(stream: DataFrame, labels: list[str]) -> DataFrame:
    """Update mode: windows as they change, dropped from state behind the watermark."""
    return metrics.request_rate(timed(stream), labels)


def document_status(stream: DataFrame) -> DataFrame:
    """Update mode: latest status per document. An update that comes late never
    takes a document back, as the order is by event time."""
    return metrics.status_latest(stream)


def session_activity(stream: DataFrame, key: str, gap: str = f"{k.SESSION_TTL} seconds") -> DataFrame:
    """Append mode emits a session once the watermark has passed its end."""
    out = timed(stream).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("events"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def run_cache_flags(stream: DataFrame, out: str, checkpoint: str, key: str, ident: str, ttl: int = k.QUERY_TTL, delay: int = 600) -> None:
    """Hit or miss per event, one folder per batch under ``out``.

    The state, each key's stored answer, is a small table under ``<out>-state``, a folder
    per batch, so a batch is a batch job: a busy key's events are spread as any others
    (see :func:`metrics.cache_flags`) and a retried batch starts from the same state. An
    answer leaves the state when it expired more than ``delay`` seconds before the newest
    event.
    """
    spark = stream.sparkSession
    state = f"{out}-state"
    held = stream.select(F.col(key), F.col("ts").cast("timestamp").alias("stored"))
    spark.createDataFrame([], held.schema).write.mode("ignore").parquet(f"{state}/batch=-1")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = spark.read.schema(StructType([*held.schema.fields, StructField("batch", LongType())])).parquet(state).where(F.col("batch") < batch_id)
        last = known.agg(F.max("batch")).first()[0]
        before = known.where(F.col("batch") == (-1 if last is None else last)).select(key, "stored")
        metrics.cache_flags(batch, key, ident, ttl, stored=before).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        flags = spark.read.parquet(f"{out}/batch={batch_id}")
        # misses of late events are older than the stored answer, so the greatest time stands
        both = before.unionByName(flags.where("not is_hit").select(key, F.col("ts").alias("stored"))).groupBy(key).agg(F.max("stored").alias("stored"))
        newest = F.greatest(*[F.lit(x) for x in (flags.agg(F.max("ts")).first()[0], before.agg(F.max("stored")).first()[0])])
        live = F.unix_seconds("stored") + ttl + delay >= F.unix_seconds(newest.cast("timestamp"))
        both.where(F.coalesce(live, F.lit(True)) & F.col(key).isNotNull()).write.mode("overwrite").parquet(f"{state}/batch={batch_id}")

    run_batches(stream, write, checkpoint)
