"""Chunking, hashing and embedding over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.functions import text as tx
from loomery.operators import chunking as ch
from loomery.operators import chunk_table, sparse
from loomery.operators import embedding as em
from loomery.operators.progress import Stage, run_stages
from loomery.plans import bindings as b
from loomery.plans.registry import query
from loomery.plans.text_plans import SECTIONS_SQL, sql_clean, sql_estimate, sql_tokens
from loomery.session import scratch_dir, spread, table
from loomery.sources import sections as sx
from loomery.sources.reuse import ReuseStore

DIM = 256


def sql_places(rows: str, keys: str, text: str, dim: int = DIM) -> str:
    """(keys, place, tf): hashed term counts of ``text``."""
    return f"""select {keys}, place, count(*)::double as tf from (select {keys}, ('0x' || substr(md5(w), 1, 8))::bigint % {dim} as place
      from (select {keys}, unnest({sql_tokens(text)}) as w from {rows})) group by {keys}, place"""


def sql_fold(sections: str, edges: str | None = None, least: int = 100, most: int = 1000, overlap: int = 10) -> str:
    """Chunk fold as a recursive query. ``sections``: (tenant_id, doc_id, i from 1, content)."""
    edge = "false" if edges is None else "coalesce(e.edge, false)"
    join = "" if edges is None else f"left join ({edges}) e on e.doc_id = x.doc_id and e.i = x.i"
    return f"""
with recursive s as materialized (
  select x.*, {edge} as edge, lag(t, 1, 0) over w as c1, lag(t, 1, 0) over w + lag(t, 2, 0) over w as c2,
    lag(t, 1, 0) over w + lag(t, 2, 0) over w + lag(t, 3, 0) over w as c3
  from (select *, {sql_estimate('content')} as t from ({sections})) x {join}
  window w as (partition by x.doc_id order by x.i)),
f as (
  select doc_id, i, 1::bigint as start, 1::bigint as n, t as tok, null::bigint as f_first, null::bigint as f_last from s where i = 1
  union all
  select doc_id, i, case when cut then i - m else start end, case when cut then m + 1 else n + 1 end,
    case when cut then (case m when 3 then c3 when 2 then c2 when 1 then c1 else 0 end) else tok end + t,
    case when cut then start end, case when cut then i - 1 end
  from (select g.*, case when (case p when 3 then c3 when 2 then c2 when 1 then c1 else 0 end) >= {overlap} then p else 0 end as m
        from (select s.doc_id, s.i, s.t, s.c1, s.c2, s.c3, f.start, f.n, f.tok,
                s.edge or (f.tok + s.t > {most} and f.tok >= {least}) as cut,
                (s.c1 <= 250)::bigint + (f.n >= 2 and s.c2 <= 250)::bigint + (f.n >= 3 and s.c3 <= 250)::bigint as p
              from f join s on s.doc_id = f.doc_id and s.i = f.i + 1) g)),
runs as (
  select doc_id, f_first as a, f_last as z from f where f_first is not null
  union all select doc_id, start, i from (select *, row_number() over (partition by doc_id order by i desc) as r from f) where r = 1)
select tenant_id, doc_id, (row_number() over (partition by doc_id order by z) - 1)::bigint as chunk_index, content
from (select any_value(s.tenant_id) as tenant_id, r.doc_id, r.z, trim(string_agg(s.content, E'\\n\\n' order by s.i), E' \\n\\t') as content
      from runs r join s on s.doc_id = r.doc_id and s.i between r.a and r.z group by r.doc_id, r.a, r.z)
"""


NUMBERED = f"select tenant_id, doc_id, section_index + 1 as i, content from ({SECTIONS_SQL})"
CHUNKS_SQL = sql_fold(NUMBERED)
EDGES_SQL = f"""
select a.doc_id, a.i, round(coalesce(d.dot, 0) / nullif(sqrt(a.sq) * sqrt(p.sq), 0), 6) < 0.5 or d.dot is null as edge
from (select n.doc_id, n.i, coalesce(q.sq, 0) as sq from ({NUMBERED}) n left join (select doc_id, i, sum(tf * tf) as sq from (
      {sql_places(f"({NUMBERED})", "doc_id, i", "content")}) group by doc_id, i) q on q.doc_id = n.doc_id and q.i = n.i) a
left join (select doc_id, i, sum(tf * tf) as sq from ({sql_places(f"({NUMBERED})", "doc_id, i", "content")}) group by doc_id, i) p
  on p.doc_id = a.doc_id and p.i = a.i - 1
left join (select x.doc_id, x.i, sum(x.tf * y.tf) as dot from ({sql_places(f"({NUMBERED})", "doc_id, i", "content")}) x
  join ({sql_places(f"({NUMBERED})", "doc_id, i", "content")}) y on y.doc_id = x.doc_id and y.i = x.i - 1 and y.place = x.place group by x.doc_id, x.i) d
  on d.doc_id = a.doc_id and d.i = a.i
where a.i > 1
"""


def chunks(spark, sf_dir):
    """All documents, one section a line, cut by size with overlap."""
    return ch.chunk_text(b.documents(spark, sf_dir), separator="\n")


CHUNK_OUT = "select tenant_id, doc_id, doc_id || '_' || chunk_index as chunk_id, chunk_index, content, sha256(content) as content_hash, " + (
    f"{sql_estimate('content')}::bigint as token_count"
)


def _out(df):
    return df.select(
        "tenant_id", "doc_id", "chunk_id", F.col("chunk_index").cast("bigint"), "content", "content_hash", F.col("token_count").cast("bigint")
    )


@query("chunk_fold", f"{CHUNK_OUT} from ({CHUNKS_SQL})")
def chunk_fold(spark, sf_dir):
    return _out(chunks(spark, sf_dir))


@query("chunk_table_function", f"{CHUNK_OUT} from ({CHUNKS_SQL})")
def chunk_table_function(spark, sf_dir):
    """The fold called from SQL, as a table function with a lateral join."""
    chunk_table.register(spark)
    return _out(
        spark.sql(
            r"""select d.tenant_id, d.doc_id, concat_ws('_', d.doc_id, c.chunk_index) as chunk_id, c.*
            from {docs} d, lateral chunk_text(d.text, separator => '\n') c""",
            docs=b.documents(spark, sf_dir),
        )
    )


@query("chunk_fold_semantic", f"{CHUNK_OUT} from ({sql_fold(NUMBERED, EDGES_SQL)})")
def chunk_fold_semantic(spark, sf_dir):
    return _out(ch.chunk_text(b.documents(spark, sf_dir), separator="\n", encoder=em.HashedTermEncoder(DIM)))


@query("chunk_boundaries", EDGES_SQL)
def chunk_boundaries(spark, sf_dir):
    docs = b.documents(spark, sf_dir).select("doc_id", F.transform(sx.text_sections(F.col("text"), "\n"), lambda s: s["content"]).alias("parts"))
    edges = ch.detect_boundaries(em.adjacent_similarity(em.HashedTermEncoder(DIM))("parts"))
    return docs.select("doc_id", F.posexplode(edges).alias("i", "edge")).where("i > 0").select("doc_id", (F.col("i") + 1).cast("bigint").alias("i"), "edge")


@query("html_chunks")
def html_chunks(spark, sf_dir):
    """Pages: parsed, cleaned, chunked under their headings."""
    pages = spread(table(spark, sf_dir, "pages"), "page_id").select("page_id", sx.parse_html("html").alias("h"))
    cleaned = pages.select("page_id", ch.clean_sections(F.col("h.sections")).alias("sections"))
    return ch.chunk_sections(cleaned, document_id="page_id")


@query(
    "chunk_clean",
    f"select doc_id, chunk_index, content from (select doc_id, chunk_index, {sql_clean('content')} as content from ({CHUNKS_SQL}))",
)
def chunk_clean(spark, sf_dir):
    return chunks(spark, sf_dir).select("doc_id", F.col("chunk_index").cast("bigint"), tx.clean_content(F.col("content"), F.col("chunk_type")).alias("content"))


@query(
    "chunk_hash_dedup",
    f"""select tenant_id, content_hash, min(chunk_id) as chunk_id from ({CHUNK_OUT} from ({CHUNKS_SQL})) group by tenant_id, content_hash""",
)
def chunk_hash_dedup(spark, sf_dir):
    return ch.dedup_chunks(chunks(spark, sf_dir)).select("tenant_id", "content_hash", "chunk_id")


@query(
    "preprocess_rollup",
    f"""select doc_id, 1::bigint as total_pages, count(*)::bigint as total_chunks, sum(token_count)::bigint as total_tokens
      from ({CHUNK_OUT} from ({CHUNKS_SQL})) group by doc_id""",
)
def preprocess_rollup(spark, sf_dir):
    return ch.preprocess_rollup(chunks(spark, sf_dir))


@query(
    "encode_documents",
    f"""with p as ({sql_places('documents', 'doc_id', 'text')})
    select p.doc_id, place::bigint as place, (tf / n)::float::double as weight from p
      join (select doc_id, sqrt(sum(tf * tf)) as n from p group by doc_id) q on p.doc_id = q.doc_id""",
)
def encode_documents(spark, sf_dir):
    vec = b.documents(spark, sf_dir).select("doc_id", em.encode(em.HashedTermEncoder(DIM))("text").alias("v"))
    return vec.select("doc_id", F.posexplode("v").alias("place", "w")).where("w <> 0").select(
        "doc_id", F.col("place").cast("bigint"), F.col("w").cast("double").alias("weight")
    )


STORE_SQL = "select distinct source as tenant_id, sha256(text) as content_hash from documents where lang = 'en'"


def _store(spark, sf_dir):
    """Hashes already encoded: every English text."""
    en = table(spark, sf_dir, "documents").where("lang = 'en'")
    return en.select(F.col("source").alias("tenant_id"), tx.content_hash(F.col("text")).alias("content_hash")).distinct()


@query(
    "embed_misses",
    f"""select distinct tenant_id, content_hash from (select source as tenant_id, sha256(text) as content_hash from documents) d
      where not exists (select 1 from ({STORE_SQL}) s where s.tenant_id = d.tenant_id and s.content_hash = d.content_hash)""",
)
def embed_misses(spark, sf_dir):
    return em.embedding_misses(b.documents(spark, sf_dir), _store(spark, sf_dir), "text").select("tenant_id", "content_hash")


@query(
    "embed_pending",
    f"""select d.source as tenant_id, d.doc_id, lang <> 'en' as was_pending, len({sql_tokens("text")}) > 0 as has_vector
      from documents d""",
)
def embed_pending(spark, sf_dir):
    """English texts come with their vectors; texts whose vector is missing are encoded once per distinct text and filled."""
    enc = em.HashedTermEncoder(DIM)
    docs = table(spark, sf_dir, "documents").select(
        F.col("source").alias("tenant_id"), "doc_id", "text", tx.content_hash(F.col("text")).alias("content_hash"), "lang"
    )
    docs = spread(docs, "doc_id")
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    known = docs.where(english).withColumn("embedding", em.encode(enc)("text"))
    pending = docs.where(~english).withColumn("embedding", F.lit(None).cast("array<float>"))
    empty_store = pending.select("tenant_id", "content_hash").where("false")
    new = em.encode_missing(pending, empty_store, enc, "text")
    # only rows without a vector meet the new ones
    out = known.drop("text").unionByName(em.attach_embeddings(pending.drop("text"), new))
    has = F.exists("embedding", lambda x: x != 0)
    return out.select("tenant_id", "doc_id", (F.col("lang") != "en").alias("was_pending"), has.alias("has_vector"))


@query(
    "embed_by_content",
    f"""with p as ({sql_places('documents', 'doc_id', 'text')})
    select d.source as tenant_id, p.doc_id, place::bigint as place, (tf / n)::float::double as weight, not exists (
        select 1 from ({STORE_SQL}) s where s.tenant_id = d.source and s.content_hash = sha256(d.text)) as was_pending
      from p join (select doc_id, sqrt(sum(tf * tf)) as n from p group by doc_id) q on p.doc_id = q.doc_id join documents d on d.doc_id = p.doc_id""",
)
def embed_by_content(spark, sf_dir):
    """Vectors of English texts are stored; then all texts ask, misses are encoded once and stored, all are filled by value."""
    enc = em.encode(em.HashedTermEncoder(DIM))
    store = ReuseStore(spark, scratch_dir(spark, "vectors-by-content"), enc.returnType, buckets=2)
    docs = table(spark, sf_dir, "documents").select(
        F.col("source").alias("tenant_id"), "doc_id", "text", "lang", tx.content_hash(F.col("text")).alias("key")
    )

    def make(missing):
        return spread(missing, "key").withColumn("value", enc("text"))

    store.fill(docs.where("lang = 'en'"), make, 0)
    filled, _ = store.fill(docs, make, 1)
    return filled.select("tenant_id", "doc_id", (F.col("stored_at") == 1).alias("was_pending"), F.posexplode("value").alias("place", "w")).where("w <> 0").select(
        "tenant_id", "doc_id", "was_pending", F.col("place").cast("bigint"), F.col("w").cast("double").alias("weight")
    )


CLEANED_SQL = f"select * from (select tenant_id, doc_id, section_index, {sql_clean('content')} as content from ({SECTIONS_SQL})) where content <> ''"
CLEAN_CHUNKS_SQL = sql_fold(f"select tenant_id, doc_id, row_number() over (partition by doc_id order by section_index) as i, content from ({CLEANED_SQL})")


@query(
    "stage_counts",
    f"""with s as materialized ({SECTIONS_SQL}), x as materialized ({CLEANED_SQL}), c as materialized ({CLEAN_CHUNKS_SQL}),
    n as (select (select count(*) from documents) as docs, (select count(*) from s) as s, (select count(*) from x) as x, (select count(*) from c) as c,
      (select sum({sql_estimate('content')}) from c) as tokens, (select count(*) from c where len({sql_tokens('content')}) > 0) as vectors,
      (select sum(len(list_distinct({sql_tokens('content')}))) from c) as terms)
    select unnest([1, 1, 2, 2, 3, 3, 4, 4, 5, 5])::bigint as stage_no, unnest(['parse', 'parse', 'clean', 'clean', 'chunk', 'chunk', 'embed', 'embed', 'index', 'index']) as stage,
      unnest(['rows', 'sections', 'rows', 'sections', 'rows', 'tokens', 'rows', 'vectors', 'rows', 'terms']) as metric,
      unnest([docs, s, docs, x, c, tokens, c, vectors, c, terms])::bigint as value from n""",
)
def stage_counts(spark, sf_dir):
    """What every stage of the preparation put out, observed while it was stored."""
    one, size = F.count("*"), F.sum(F.size("sections"))
    stages = [
        Stage("parse", lambda d: d.select("tenant_id", "doc_id", sx.text_sections(F.col("text"), "\n").alias("sections")), {"rows": one, "sections": size}),
        Stage("clean", lambda d: d.withColumn("sections", ch.clean_sections(F.col("sections"))), {"rows": one, "sections": size}),
        Stage("chunk", ch.chunk_sections, {"rows": one, "tokens": F.sum("token_count")}),
        Stage("embed", lambda d: d.withColumn("embedding", em.encode(em.HashedTermEncoder(DIM))("content")), {"rows": one, "vectors": F.count_if(F.exists("embedding", lambda x: x != 0))}),
        Stage("index", lambda d: sparse.keyword_index(d, heading=None), {"rows": one, "terms": F.sum(F.size("counts"))}),
    ]
    return run_stages(b.documents(spark, sf_dir), stages)[1].withColumn("stage_no", F.col("stage_no").cast("bigint"))
