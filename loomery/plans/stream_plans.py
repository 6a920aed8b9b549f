"""Streams over the whole tables, each drained once and compared with its batch form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery import constants as k
from loomery.operators.chunking import chunk_text
from loomery.operators.embedding import HashedTermEncoder
from loomery.plans import bindings as b
from loomery.plans import chunk_plans as cp
from loomery.plans import metric_plans as mp
from loomery.plans.graph_plans import sql_entities
from loomery.plans.registry import query
from loomery.session import scratch_dir
from loomery.sources import stores
from loomery.streaming import jobs


def _stream(spark, sf_dir, name):
    return jobs.read_stream(spark, f"{sf_dir}/{name}.parquet")


def _drain(spark, stream, name, mode, keys):
    root = scratch_dir(spark, name)
    jobs.run_available(stream, f"{root}/out", f"{root}/checkpoint", mode)
    return jobs.latest_rows(spark, f"{root}/out", keys)


@query("streaming_ingest", f"{cp.CHUNK_OUT} from ({cp.CHUNKS_SQL})")
def streaming_ingest(spark, sf_dir):
    root = scratch_dir(spark, "stream-ingest")
    docs = _stream(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("tenant_id"), "text")

    def prepare(batch):
        return chunk_text(batch, separator="\n", document_id="document_id")

    jobs.ingest_stream(docs, f"{root}/out", f"{root}/checkpoint", prepare)
    return cp._out(jobs.latest_groups(spark, f"{root}/out", "document_id").withColumnRenamed("document_id", "doc_id"))


@query(
    "streaming_ingest_stores",
    f"""with c as materialized ({cp.CHUNK_OUT} from ({cp.CHUNKS_SQL})),
    n as (select tenant_id, count(*)::bigint as n from c group by tenant_id)
    select 'vectors' as store, * from n union all select 'keywords', * from n union all select 'chunks', * from n
    union all select 'mentions', tenant_id, count(*) from (select tenant_id, unnest({sql_entities('content')}) from c) group by tenant_id""",
)
def streaming_ingest_stores(spark, sf_dir):
    """The documents as a stream into all stores; the first batch is replayed after it."""
    root = scratch_dir(spark, "stream-stores")
    docs = _stream(spark, sf_dir, "documents").select(F.col("source").alias("tenant_id"), F.col("doc_id").alias("document_id"), "text")
    encoder = HashedTermEncoder(64)
    tables = jobs.ingest_stores(docs, root, f"{root}/checkpoint", encoder, clean=False)
    again = b.documents(spark, sf_dir).withColumnRenamed("doc_id", "document_id")
    stores.ingest_batch(tables, again, encoder, 0, clean=False)
    rows = [t.rows().groupBy("tenant_id").agg(F.count("*").alias("n")).withColumn("store", F.lit(name)) for name, t in tables.items()]
    return reduce(DataFrame.unionByName, rows)


@query("streaming_request_rate", mp.RATE_SQL)
def streaming_request_rate(spark, sf_dir):
    out = _drain(spark, jobs.request_rates(_stream(spark, sf_dir, "events"), ["event_type"]), "stream-rate", "update", ["start", "event_type"])
    return out.select(mp.text_ts("start"), "event_type", "count", F.round("rate", 6).alias("rate"))


@query("streaming_status", mp.STATUS_SQL)
def streaming_status(spark, sf_dir):
    log = mp.status_log(_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return mp.status_out(_drain(spark, jobs.document_status(log), "stream-status", "update", ["document_id"]))


@query("streaming_sessions", mp.sessions_sql())
def streaming_sessions(spark, sf_dir):
    """Complete mode, so that sessions still open at the end are compared too."""
    out = _drain(spark, jobs.session_activity(_stream(spark, sf_dir, "events"), "user_id"), "stream-sessions", "complete", ["user_id", "session_start"])
    return out.select("user_id", mp.text_ts("session_start"), mp.text_ts("session_end"), "events")


@query("streaming_cache", mp.CACHE_SQL)
def streaming_cache(spark, sf_dir):
    root = scratch_dir(spark, "stream-cache")
    jobs.run_cache_flags(_stream(spark, sf_dir, "events"), f"{root}/out", f"{root}/checkpoint", "event_type", "event_id", k.VECTOR_TTL)
    return spark.read.parquet(f"{root}/out").select("event_type", "event_id", "is_hit")
