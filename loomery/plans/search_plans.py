"""Search over ingested chunks, within tenants, in every mode, with filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.operators.embedding import HashedTermEncoder
from loomery.operators.search import Request, open_search
from loomery.plans import bindings as b
from loomery.plans import graph_plans as g
from loomery.plans import rank_plans as rank
from loomery.plans import retrieval_plans as r
from loomery.plans.chunk_plans import CHUNK_OUT, CLEAN_CHUNKS_SQL, DIM, sql_places
from loomery.plans.query_plans import SQL_GRAPH
from loomery.plans.registry import query
from loomery.plans.text_plans import sql_tokens
from loomery.session import scratch_dir, stored_once, table
from loomery.sources import stores


def opened(spark, sf_dir):
    """Documents through the whole preparation into the stores, indexed; once per application."""

    def make():
        root = scratch_dir(spark, "search")
        docs = b.documents(spark, sf_dir).withColumnRenamed("doc_id", "document_id")
        encoder = HashedTermEncoder(DIM)
        tables = stores.open_stores(docs, f"{root}/stores", encoder, buckets=2)
        stores.ingest_batch(tables, docs, encoder, 0)
        return open_search({name: t.rows() for name, t in tables.items()}, f"{root}/index", encoder)

    return stored_once(spark, make, "chunk-search", sf_dir)


# ---- twins ---------------------------------------------------------------

CHUNKS = f"(select tenant_id, chunk_id, doc_id, chunk_index, content from ({CHUNK_OUT} from ({CLEAN_CHUNKS_SQL})))"
FILTER = "c.doc_id in (select doc_id from labels where quality = 1) and c.chunk_index <= 2"


def _weights(rows, key, text):
    return f"""select p.{key}, place, (tf / n)::float::double as w from ({sql_places(rows, key, text)}) p
      join (select {key}, sqrt(sum(tf * tf)) as n from ({sql_places(rows, key, text)}) group by {key}) using ({key})"""


def _dense_sql(keep: str) -> str:
    return f"""select query_id, chunk_id, dense_score, rank from (select *, row_number() over (partition by query_id order by dense_score desc, chunk_id) as rank from (
      select qn.query_id, c.chunk_id, round(coalesce(dot, 0) / (coalesce(qn.n, 1) * coalesce(cn.n, 1)), 6) as dense_score
      from (select q.query_id, q.tenant_id, n from ({r.QUERIES_SQL}) q left join (select query_id, sqrt(sum(w * w)) as n from qw group by all) x using (query_id)) qn
      join ch c on c.tenant_id = qn.tenant_id left join (select chunk_id, sqrt(sum(w * w)) as n from cw group by all) cn using (chunk_id)
      left join (select query_id, chunk_id, sum(qw.w * cw.w) as dot from qw join cw using (place) group by all) x on x.query_id = qn.query_id and x.chunk_id = c.chunk_id where {keep})) where rank <= 50"""


def _sparse_sql(keep: str) -> str:
    return f"""select query_id, chunk_id, sparse_score, rank from (select *, row_number() over (partition by query_id order by sparse_score desc, chunk_id) as rank from (
      select query_id, chunk_id, round(sum(boost * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) as sparse_score
      from post p join (select query_id, tenant_id, term, count(*)::double as boost from (select query_id, tenant_id, unnest({sql_tokens('query')}) as term from ({r.QUERIES_SQL})) group by all) q using (tenant_id, term)
      join (select tenant_id, term, count(*) as df from post group by all) d using (tenant_id, term)
      join (select tenant_id, count(*) as n, avg(dl) as avgdl from (select distinct tenant_id, chunk_id, dl from post) group by all) st using (tenant_id)
      join ch c using (tenant_id, chunk_id) where {keep} group by all)) where rank <= 50"""


GRAPH_SQL = """select query_id, chunk_id, graph_score, rank from (select *, row_number() over (partition by query_id order by graph_score desc, chunk_id) as rank from (
  select query_id, chunk_id, round(case when max(seed) = 1 then 1.0::double else 0.5 end + 0.1::double * sum(1 - seed), 6) as graph_score
  from (select query_id, tenant_id, entity_id, 1 as seed from seeds union all select query_id, tenant_id, entity_id, 0 from shared) join m using (tenant_id, entity_id) group by query_id, chunk_id)) where rank <= 50"""

BASE = f"""ch as materialized (select * from {CHUNKS}),
  cw as materialized ({_weights("ch", "chunk_id", "content")}), qw as materialized ({_weights(f"({r.QUERIES_SQL})", "query_id", "query")}),
  post as materialized (select tenant_id, chunk_id, dl, term, count(*) as tf from (select tenant_id, chunk_id, len(w) as dl, unnest(w) as term from (select tenant_id, chunk_id, {sql_tokens('content')} as w from ch)) group by all),
  m as materialized (select tenant_id, chunk_id, unnest({g.sql_entities('content')}) as entity_id from ch),
  seeds as materialized (select distinct query_id, tenant_id, e as entity_id from (select query_id, tenant_id, unnest({SQL_GRAPH}) as e from ({r.QUERIES_SQL})) s
    where exists (select 1 from m where m.tenant_id = s.tenant_id and m.entity_id = s.e)),
  shared as materialized (select distinct s.query_id, s.tenant_id, z.entity_id from seeds s join m y using (tenant_id, entity_id) join m z on z.tenant_id = y.tenant_id and z.chunk_id = y.chunk_id
    where not exists (select 1 from seeds t where t.query_id = s.query_id and t.entity_id = z.entity_id))"""


def _routes(keep: str) -> dict[str, str]:
    return {"dense": _dense_sql(keep), "sparse": _sparse_sql(keep), "graph": GRAPH_SQL}


def _mode_sql(mode: str, keep: str) -> str:
    if mode == "hybrid":
        body = f"select query_id, chunk_id, {rank._nz_sql(*rank.SCORES)}, fusion_score, prev_rank from ({rank.fused_sql(_routes(keep))})"
    else:
        body = f"select query_id, chunk_id, {mode}_score, rank as prev_rank from ({_routes(keep)[mode]})"
    return f"with {BASE} {body}"


ACCESS = "select doc_id || '_0' as chunk_id, count(*) as access_count from events join documents on doc_id = user_id group by all"
SEARCH_CAND = f"""select f.*, q.query, c.content, c.chunk_index, 1 as page_number, a.access_count from ({rank.fused_sql(_routes('true'))}) f join ({r.QUERIES_SQL}) q on q.query_id = f.query_id
  join ch c on c.chunk_id = f.chunk_id left join ({ACCESS}) a on a.chunk_id = f.chunk_id"""


# ---- queries -------------------------------------------------------------

def _request(spark, sf_dir, mode: str, filtered: bool) -> Request:
    if not filtered:
        return Request(mode)
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("document_id"))
    return Request(mode, document_ids=good, terms={"chunk_type": ["text", "table"]}, expr="chunk_index <= 2")


def _mode(spark, sf_dir, mode: str, filtered: bool = False):
    found = opened(spark, sf_dir).candidates(r.queries(spark, sf_dir), _request(spark, sf_dir, mode, filtered))
    if mode == "hybrid":
        return found.select("query_id", "chunk_id", *rank._nz(*rank.SCORES), "fusion_score", F.col("prev_rank").cast("bigint"))
    return found.select("query_id", "chunk_id", f"{mode}_score", F.col("prev_rank").cast("bigint"))


@query("chunk_search_dense", _mode_sql("dense", "true"))
def chunk_search_dense(spark, sf_dir):
    return _mode(spark, sf_dir, "dense")


@query("chunk_search_sparse", _mode_sql("sparse", FILTER))
def chunk_search_sparse(spark, sf_dir):
    """Keyword mode under a document, a column and an expression filter."""
    return _mode(spark, sf_dir, "sparse", filtered=True)


@query("chunk_search_graph", _mode_sql("graph", "true"))
def chunk_search_graph(spark, sf_dir):
    return _mode(spark, sf_dir, "graph")


@query("chunk_search_fused", _mode_sql("hybrid", FILTER))
def chunk_search_fused(spark, sf_dir):
    """All routes, the filters on dense and keyword hits."""
    return _mode(spark, sf_dir, "hybrid", filtered=True)


@query(
    "chunk_search",
    f"with {BASE} select query_id, chunk_id, excerpt, score, final_rank, confidence from ({rank.SHAPED_SQL.replace(rank.CAND_SQL, SEARCH_CAND)})",
)
def chunk_search(spark, sf_dir):
    """The whole way: ingested chunks, three routes, fused, ranked on ids, texts fetched, scored, shaped."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    counts = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.count("*").alias("access_count"))
    access = counts.join(docs, "doc_id").select(F.concat(F.col("doc_id").cast("string"), F.lit("_0")).alias("chunk_id"), "access_count")
    out = opened(spark, sf_dir).search(r.queries(spark, sf_dir), access=access)
    return out.select("query_id", "chunk_id", "excerpt", "score", F.col("final_rank").cast("bigint"), "confidence")
