"""Dense, keyword and graph retrieval over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomery.operators import dense, sparse
from loomery.operators.embedding import HashedTermEncoder, encode
from loomery.operators.topk import top_k
from loomery.plans import bindings as b
from loomery.plans.chunk_plans import DIM, sql_places
from loomery.plans.registry import query
from loomery.plans.text_plans import sql_tokens
from loomery.session import materialize, scratch_dir, spread, stored_once, table


# ---- vectors -------------------------------------------------------------

PROTOTYPE_SQL = """select label as query_id, list(m order by d) as qv from (select label, d, round(avg(x), 6) as m from (
  select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as d from embeddings) group by label, d) group by label"""


def vectors(spark, sf_dir):
    return spread(table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "chunk_id"), "chunk_id")


def prototypes(spark, sf_dir):
    """One query vector per label: the mean of its vectors."""
    dims = vectors(spark, sf_dir).select("label", F.posexplode("embedding").alias("d", "x"))
    mean = dims.groupBy("label", "d").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("m"))
    row = F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"])  # one entry per dimension
    return mean.groupBy("label").agg(row.alias("embedding")).withColumn("query_id", F.col("label"))


def _dense_sql(on: str, keep: str = "true") -> str:
    return f"""select query_id::bigint as query_id, chunk_id::bigint as chunk_id, dense_score, rank from (
      select query_id, vec_id as chunk_id, s as dense_score, row_number() over (partition by query_id order by s desc, vec_id) as rank
      from (select q.query_id, e.vec_id, round(list_cosine_similarity(qv, embedding::double[]), 6) as s from ({PROTOTYPE_SQL}) q join embeddings e on {on}) where {keep})
      where rank <= 50"""


def _dense_out(df):
    return df.select(F.col("query_id").cast("bigint"), F.col("chunk_id").cast("bigint"), "dense_score", F.col("rank").cast("bigint"))


@query("dense_topk", _dense_sql("true"))
def dense_topk(spark, sf_dir):
    return _dense_out(dense.dense_topk(prototypes(spark, sf_dir), vectors(spark, sf_dir)))


@query("dense_topk_filtered", _dense_sql("e.label = q.query_id"))
def dense_topk_filtered(spark, sf_dir):
    """Each query only meets vectors of its own label (the tenant's part)."""
    return _dense_out(dense.dense_topk(prototypes(spark, sf_dir), vectors(spark, sf_dir), tenant="label"))


def stored_lists(spark, sf_dir):
    """(vectors stored by list, centroids), made once and searched many times."""

    def make():
        corpus = vectors(spark, sf_dir).select("chunk_id", "embedding")
        centroids = dense.train_centroids(corpus, lists=16)
        path = scratch_dir(spark, "ivf")
        # ranges end inside a large list too, so a list is few files and no task has it whole
        listed = dense.assign_lists(corpus, centroids)
        listed.repartitionByRange("list_id", "chunk_id").write.partitionBy("list_id").parquet(path)
        return spark.read.parquet(path), centroids

    return stored_once(spark, make, "ivf", sf_dir)


@query("dense_ivf")
def dense_ivf(spark, sf_dir):
    """Vectors written by list, then searched in the four nearest lists."""
    listed, centroids = stored_lists(spark, sf_dir)
    return _dense_out(dense.ivf_topk(prototypes(spark, sf_dir), listed, centroids))


@query("dense_ivf_recall", "select distinct label::bigint as query_id, true as enough from embeddings")
def dense_ivf_recall(spark, sf_dir):
    """Whether the approximate search, with probes tuned to a recall of 0.9, has it for every query."""
    listed, centroids = stored_lists(spark, sf_dir)
    asked = prototypes(spark, sf_dir)
    probes = dense.tune_probes(asked, listed, centroids)
    found = dense.ivf_topk(asked, listed, centroids, probes=probes)
    got = dense.recall(dense.dense_topk(asked, vectors(spark, sf_dir)), found)
    return got.select(F.col("query_id").cast("bigint").alias("query_id"), (F.col("recall") >= 0.9).alias("enough"))


@query("dense_ivf_all_lists", _dense_sql("true"))
def dense_ivf_all_lists(spark, sf_dir):
    """All lists probed, the batch joined to them by list: the exact result."""
    listed, centroids = stored_lists(spark, sf_dir)
    return _dense_out(dense.ivf_grid_topk(prototypes(spark, sf_dir), listed, centroids, probes=len(centroids)))


@query(
    "vector_similarity",
    """select a.vec_id, round(list_inner_product(a.embedding::double[], b.embedding::double[]), 6) as similarity,
      round(list_inner_product(a.embedding::double[], b.embedding::double[]), 6) < 0.5 as is_boundary
      from (select *, lag(vec_id) over (partition by label order by vec_id) as before from embeddings) a join embeddings b on b.vec_id = a.before""",
)
def vector_similarity(spark, sf_dir):
    """Neighbours within a label, as sections within a document."""
    from loomery.operators.embedding import dot

    w = Window.partitionBy("label").orderBy("vec_id")
    v = table(spark, sf_dir, "embeddings").withColumn("before", F.lag("embedding").over(w)).where("before is not null")
    s = F.round(dot(F.col("embedding"), F.col("before")), 6)
    return v.select("vec_id", s.alias("similarity"), (s < 0.5).alias("is_boundary"))


# ---- keywords ------------------------------------------------------------

def corpus(spark, sf_dir):
    """Documents as chunks: the first line is the heading, the rest the content."""
    text = F.col("text")
    end = F.locate("\n", text)
    return b.documents(spark, sf_dir).select(
        "tenant_id",
        F.col("doc_id").alias("chunk_id"),
        F.substring_index(text, "\n", 1).alias("heading"),
        F.when(end > 0, F.substring(text, end + 1, F.length(text))).when(text.isNotNull(), "").alias("content"),
    )


CORPUS_SQL = r"""select source as tenant_id, doc_id as chunk_id, string_split(text, chr(10))[1] as heading,
  regexp_replace(text, '\A[^\n]*\n?', '') as content from documents"""


def built_index(spark, sf_dir, tenant=None):
    """The index is made once, stored, and read by statistics and search."""

    def make():
        return sparse.write_inverted_index(sparse.keyword_words(corpus(spark, sf_dir), tenant=tenant), scratch_dir(spark, "keyword-index"))

    return stored_once(spark, make, "keyword-index", sf_dir, tenant)


QUERIES_SQL = "select item_id as query_id, text as query, 'src' || (item_id % 20) as tenant_id from benchmark"


def queries(spark, sf_dir):
    return b.queries(spark, sf_dir).withColumn("tenant_id", F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")))


def sql_postings(tenant: str) -> str:
    return f"""select tenant_id, chunk_id, field, dl, term, count(*) as tf from (select {tenant} as tenant_id, chunk_id, field, len(w) as dl, unnest(w) as term from (
      select tenant_id, chunk_id, 'content' as field, {sql_tokens('content')} as w from ({CORPUS_SQL})
      union all select tenant_id, chunk_id, 'heading', {sql_tokens('heading')} from ({CORPUS_SQL}))) group by all"""


def bm25_sql(tenant: str = "'all'", terms: str | None = None, where: str = "true", boost: float = 3.0, k: int = 50) -> str:
    if terms is None:
        terms = f"""select query_id, tenant_id, term, count(*)::double as boost from (select query_id, {tenant} as tenant_id, unnest({sql_tokens('query')}) as term
          from ({QUERIES_SQL})) group by all"""
    return f"""
with p as materialized ({sql_postings(tenant)}),
st as (select tenant_id, field, count(*) as n, avg(dl) as avgdl from (select distinct tenant_id, field, chunk_id, dl from p) group by all),
d as (select tenant_id, field, term, count(*) as df from p group by all),
q as ({terms}),
s as (select query_id, chunk_id, p.field, sum(boost * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as s
  from p join q using (tenant_id, term) join d using (tenant_id, field, term) join st on st.tenant_id = p.tenant_id and st.field = p.field
  where {where} group by query_id, chunk_id, p.field),
m as (select query_id, chunk_id, round(max(case when field = 'heading' then {boost} * s else s end), 6) as sparse_score from s group by all)
select query_id, chunk_id, sparse_score, rank from (select *, row_number() over (partition by query_id order by sparse_score desc, chunk_id) as rank from m) where rank <= {k}
"""


def _sparse_out(df):
    return df.select("query_id", "chunk_id", "sparse_score", F.col("rank").cast("bigint"))


@query("keyword_stats", f"""select tenant_id, field, term, count(*)::bigint as df, sum(tf)::bigint as ttf from ({sql_postings('tenant_id')}) group by all""")
def keyword_stats(spark, sf_dir):
    """Read from the stored index."""
    return built_index(spark, sf_dir, "tenant_id").terms.select("tenant_id", "field", "term", "df", "ttf")


@query(
    "keyword_field_stats",
    f"""select tenant_id, field, count(*)::bigint as n, round(avg(dl), 6) as avgdl from (select distinct tenant_id, field, chunk_id, dl from ({sql_postings('tenant_id')})) group by all""",
)
def keyword_field_stats(spark, sf_dir):
    return built_index(spark, sf_dir, "tenant_id").fields.withColumn("avgdl", F.round("avgdl", 6))


@query("bm25_topk", bm25_sql())
def bm25_topk(spark, sf_dir):
    index = built_index(spark, sf_dir)
    return _sparse_out(sparse.bm25_topk(sparse.query_terms(queries(spark, sf_dir)), index))


@query("bm25_min_score", f"select * from ({bm25_sql()}) where sparse_score >= 20")
def bm25_min_score(spark, sf_dir):
    """Hits below a score are left out."""
    return _sparse_out(sparse.bm25_topk(sparse.query_terms(queries(spark, sf_dir)), built_index(spark, sf_dir), min_score=20.0))


@query("bm25_heading_boost", bm25_sql(boost=10.0))
def bm25_heading_boost(spark, sf_dir):
    index = built_index(spark, sf_dir)
    return _sparse_out(sparse.bm25_topk(sparse.query_terms(queries(spark, sf_dir)), index, heading_boost=10.0))


@query("bm25_tenant_filtered", bm25_sql("tenant_id", where="p.chunk_id % 3 <> 1"))
def bm25_tenant_filtered(spark, sf_dir):
    """Statistics per tenant; the document filter restricts hits, not statistics."""
    index = built_index(spark, sf_dir, "tenant_id")
    terms = sparse.query_terms(queries(spark, sf_dir), tenant="tenant_id")
    return _sparse_out(sparse.bm25_topk(terms, index, where=F.col("chunk_id") % 3 != 1))


USER_TERMS_SQL = f"select distinct 'all' as tenant_id, unnest({sql_tokens('text')}) as term from benchmark"
VOCAB_SQL = f"select term, count(*) as df from (select distinct doc_id, unnest({sql_tokens('text')}) as term from documents) group by term"


def _bytes(x: str) -> str:
    """The SQL distance counts bytes; give every accented letter one byte (terms hold no capitals)."""
    return f"translate({x}, 'äçèéêíñóöüß', 'ABCDEFGHIJK')"


FUZZY_SQL = f"""
select tenant_id, term, expansion, distance, place, 1 - distance / least(length(term), length(expansion)) as weight from (
  select *, row_number() over (partition by term order by distance, df desc, expansion) as place from (
    select q.tenant_id, q.term, v.term as expansion, v.df, levenshtein({_bytes('q.term')}, {_bytes('v.term')}) as distance,
      case when length(q.term) <= 2 then 0 when length(q.term) <= 5 then 1 else 2 end as edits
    from ({USER_TERMS_SQL}) q join ({VOCAB_SQL}) v
      on abs(length(q.term) - length(v.term)) <= case when length(q.term) <= 2 then 0 when length(q.term) <= 5 then 1 else 2 end)
  where distance <= edits)
"""


def vocabulary(spark, sf_dir):
    """Terms of whole documents with their document frequency; counted once, as it is joined three times."""

    def make():
        return materialize(sparse.document_frequencies(b.documents(spark, sf_dir).select(F.lit("all").alias("tenant_id"), "text"), "text"), "vocabulary")

    return stored_once(spark, make, "vocabulary", sf_dir)


def _expansions(spark, sf_dir):
    terms = sparse.query_terms(queries(spark, sf_dir))
    return sparse.fuzzy_expand(terms, vocabulary(spark, sf_dir))


@query("fuzzy_terms", f"select tenant_id, term, expansion, distance::bigint as distance, place::bigint as place, round(weight, 6) as weight from ({FUZZY_SQL})")
def fuzzy_terms(spark, sf_dir):
    return _expansions(spark, sf_dir).select(
        "tenant_id", "term", "expansion", F.col("distance").cast("bigint"), F.col("place").cast("bigint"), F.round("weight", 6).alias("weight")
    )


@query(
    "bm25_fuzzy",
    bm25_sql(
        terms=f"""select query_id, tenant_id, expansion as term, max(boost * weight) as boost from (select query_id, 'all' as tenant_id, term, count(*)::double as boost
          from (select query_id, unnest({sql_tokens('query')}) as term from ({QUERIES_SQL})) group by all) t join ({FUZZY_SQL}) f using (tenant_id, term) group by all"""
    ),
)
def bm25_fuzzy(spark, sf_dir):
    index = built_index(spark, sf_dir)
    terms = materialize(sparse.fuzzy_terms(sparse.query_terms(queries(spark, sf_dir)), _expansions(spark, sf_dir)), "fuzzy-terms")
    return _sparse_out(sparse.bm25_topk(terms, index))


# ---- dense over texts ----------------------------------------------------

def text_vectors(spark, sf_dir):
    """Encoded once, stored, and searched many times."""

    def make():
        enc = encode(HashedTermEncoder(DIM))
        return materialize(b.documents(spark, sf_dir).select("tenant_id", F.col("doc_id").alias("chunk_id"), enc("text").alias("embedding")), "text-vectors")

    return stored_once(spark, make, "text-vectors", sf_dir)


def query_vectors(spark, sf_dir):
    return queries(spark, sf_dir).select("query_id", encode(HashedTermEncoder(DIM))("query").alias("embedding"))


def _weights_sql(rows, key, text):
    return f"""select p.{key}, place, (tf / n)::float::double as w from ({sql_places(rows, key, text)}) p
      join (select {key}, sqrt(sum(tf * tf)) as n from ({sql_places(rows, key, text)}) group by {key}) using ({key})"""


DENSE_TEXT_SQL = f"""
with c as materialized ({_weights_sql('documents', 'doc_id', 'text')}), q as materialized ({_weights_sql('benchmark', 'item_id', 'text')}),
cn as (select doc_id, sqrt(sum(w * w)) as n from c group by all), qn as (select item_id, sqrt(sum(w * w)) as n from q group by all),
s as (select qn.item_id as query_id, d.doc_id as chunk_id, round(coalesce(dot, 0) / (qn.n * coalesce(cn.n, 1)), 6) as dense_score
  from qn cross join documents d left join cn on cn.doc_id = d.doc_id
  left join (select item_id, doc_id, sum(q.w * c.w) as dot from q join c using (place) group by all) x on x.item_id = qn.item_id and x.doc_id = d.doc_id)
select query_id, chunk_id, dense_score, rank from (select *, row_number() over (partition by query_id order by dense_score desc, chunk_id) as rank from s) where rank <= 50
"""


@query("dense_text_topk", DENSE_TEXT_SQL)
def dense_text_topk(spark, sf_dir):
    return _dense_out(dense.dense_topk(query_vectors(spark, sf_dir), text_vectors(spark, sf_dir)))
