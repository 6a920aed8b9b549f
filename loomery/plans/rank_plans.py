"""Fusion, ranking, confidence, conflicts and answers over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loomery import constants as k
from loomery.functions.queries import reported_class
from loomery.operators import answers, conflicts, dense, fusion, metrics, ranking, sparse
from loomery.plans import bindings as b
from loomery.plans import graph_plans as g
from loomery.plans import retrieval_plans as r
from loomery.plans.query_plans import features_sql, weights_sql
from loomery.plans.registry import query
from loomery.plans.text_plans import sql_tokens
from loomery.session import materialize, scratch_dir, table
from loomery.sources.reuse import ReuseStore

ASKED = "select item_id as query_id, text as query from benchmark"
RAW_WEIGHTS_SQL = weights_sql(features_sql(ASKED)).replace("round(", "(").replace(", 6)", ")")


def fused_sql(routes: dict[str, str]) -> str:
    ctes = ", ".join(f"h_{n} as materialized ({sql})" for n, sql in routes.items())
    union = " union all ".join(f"select query_id, chunk_id, '{n}' as route, rank, {n}_score as score from h_{n}" for n in routes)
    scores = ", ".join(f"max(case when route = '{n}' then score end)::double as {n}_score" for n in ("dense", "sparse", "graph"))
    share = " + ".join(f"coalesce(max({n}) / (60 + max(case when route = '{n}' then rank end)), 0)" for n in ("dense", "sparse", "graph"))
    return f"""with {ctes}, w as materialized ({RAW_WEIGHTS_SQL}), u as ({union}),
    f as (select u.query_id, chunk_id, {scores}, round({share}, 9) as fusion_score from u join w on w.query_id = u.query_id group by u.query_id, chunk_id)
    select *, row_number() over (partition by query_id order by fusion_score desc, chunk_id) as prev_rank from f"""


ALL_ROUTES_SQL = {"dense": r.DENSE_TEXT_SQL, "sparse": r.bm25_sql(), "graph": g.GRAPH_SQL}
TWO_ROUTES_SQL = {n: ALL_ROUTES_SQL[n] for n in ("dense", "sparse")}


def routes(spark, sf_dir) -> dict:
    queries = r.queries(spark, sf_dir)
    found = {
        "dense": lambda: dense.dense_topk(r.query_vectors(spark, sf_dir), r.text_vectors(spark, sf_dir)),
        "sparse": lambda: sparse.bm25_topk(sparse.query_terms(queries), r.built_index(spark, sf_dir)),
        "graph": lambda: g.graph_hits(spark, sf_dir),
    }
    # a route's hits are at most k rows per query: stored, so fusion reads plain small tables
    return {name: (lambda name=name, run=run: materialize(run(), f"{name}-hits")) for name, run in found.items()}


def _nz(*cols):
    return [F.coalesce(c, F.lit(0.0)).alias(c) for c in cols]


def _nz_sql(*cols):
    return ", ".join(f"coalesce({c}, 0.0::double) as {c}" for c in cols)


SCORES = ("dense_score", "sparse_score", "graph_score")


@query("rrf_fuse", f"select query_id, chunk_id, {_nz_sql(*SCORES)}, fusion_score, prev_rank from ({fused_sql(ALL_ROUTES_SQL)})")
def rrf_fuse(spark, sf_dir):
    out = fusion.retrieve("hybrid", r.queries(spark, sf_dir), routes(spark, sf_dir))
    return out.select("query_id", "chunk_id", *_nz(*SCORES), "fusion_score", F.col("prev_rank").cast("bigint"))


@query("mode_sparse", f"select query_id, chunk_id, sparse_score, 0.0::double as fusion_score, rank as prev_rank from ({r.bm25_sql()})")
def mode_sparse(spark, sf_dir):
    out = fusion.retrieve("sparse", r.queries(spark, sf_dir), routes(spark, sf_dir))
    return out.select("query_id", "chunk_id", "sparse_score", *_nz("fusion_score"), F.col("prev_rank").cast("bigint"))


# ---- candidates ----------------------------------------------------------
# Documents as chunks: the position, page and access count of a chunk follow
# its id and the event log.

ACCESS_SQL = "select user_id as chunk_id, count(*) as access_count from events group by user_id"
CAND_SQL = f"""select f.*, q.text as query, d.text as content, d.source as tenant_id, (d.doc_id % 60)::bigint as chunk_index,
  case when d.doc_id % 4 <> 0 then 1 end as page_number, a.access_count
from ({fused_sql(TWO_ROUTES_SQL)}) f join benchmark q on q.item_id = f.query_id join documents d on d.doc_id = f.chunk_id left join ({ACCESS_SQL}) a on a.chunk_id = f.chunk_id"""


def candidates(spark, sf_dir, names=("dense", "sparse"), features=False):
    queries = r.queries(spark, sf_dir)
    found = fusion.retrieve("hybrid", queries, {n: f for n, f in routes(spark, sf_dir).items() if n in names})
    # at most k rows per query: stored, so its true size decides the join with the
    # texts (shipped to their scan when small) and nothing upstream runs twice
    found = materialize(found, "candidates")
    docs = b.documents(spark, sf_dir).select(
        F.col("doc_id").alias("chunk_id"), "tenant_id", F.col("text").alias("content"),
        (F.col("doc_id") % 60).alias("chunk_index"), F.when(F.col("doc_id") % 4 != 0, 1).alias("page_number"),
    )
    if features:
        docs = ranking.content_features(docs.join(found.select("chunk_id").distinct(), "chunk_id", "left_semi"))
    # counted per id before the join, so a busy id is one row
    access = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("chunk_id")).agg(F.count("*").alias("access_count"))
    return found.join(queries.select("query_id", "query"), "query_id").join(docs, "chunk_id").join(access, "chunk_id", "left")


def _dot(alias):
    return f"select {alias}, term, count(*)::double as tf from (select {alias}, unnest({{tokens}}) as term from {{rows}}) group by all"


COARSE_SQL = f"""
with c as materialized ({CAND_SQL}),
ct as materialized ({_dot('chunk_id').format(tokens=sql_tokens('content'), rows='(select distinct chunk_id, content from c)')}),
qt as materialized ({_dot('query_id').format(tokens=sql_tokens('query'), rows='(select distinct query_id, query from c)')}),
cn as (select chunk_id, sqrt(sum(tf * tf)) as n from ct group by all), qn as (select query_id, sqrt(sum(tf * tf)) as n from qt group by all),
dots as (select c.query_id, c.chunk_id, sum(ct.tf * qt.tf) as dot from c join qt on qt.query_id = c.query_id join ct on ct.chunk_id = c.chunk_id and ct.term = qt.term group by all),
e as (select query_id, chunk_id, {g.sql_entities('query')} as qe, {g.sql_entities('content')} as ce from c),
s as (select c.*, coalesce(dot / (cn.n * qn.n), 0) as tfidf, case when len(qe) = 0 then 0 else len(list_intersect(qe, ce)) / len(qe) end as entity,
  case when chunk_index < 10 then 0.9::double when chunk_index < 50 then 0.7 else 0.5 end as recency,
  case when access_count > 100 then 0.9::double when access_count > 10 then 0.7 else 0.5 end as authority
  from c join e using (query_id, chunk_id) left join dots using (query_id, chunk_id) left join cn using (chunk_id) left join qn using (query_id)),
t as (select *, round(0.4::double * tfidf + 0.3::double * entity + 0.15::double * recency + 0.15::double * authority, 6) as coarse_score from s)
select *, row_number() over (partition by query_id order by coarse_score desc, prev_rank) as coarse_rank from t"""


@query(
    "coarse_features",
    f"select query_id, chunk_id, round(tfidf, 6) as tfidf, round(entity, 6) as entity, recency, authority, coarse_score from ({COARSE_SQL})",
)
def coarse_features(spark, sf_dir):
    out = ranking.coarse_score(candidates(spark, sf_dir, features=True))
    return out.select("query_id", "chunk_id", F.round("tfidf", 6).alias("tfidf"), F.round("entity", 6).alias("entity"), "recency", "authority", "coarse_score")


@query("coarse_rank", f"select query_id, chunk_id, coarse_score, coarse_rank from ({COARSE_SQL}) where coarse_rank <= 20")
def coarse_rank(spark, sf_dir):
    return ranking.coarse_rank(candidates(spark, sf_dir, features=True)).select("query_id", "chunk_id", "coarse_score", F.col("coarse_rank").cast("bigint"))


CASCADE_SQL = f"""select * exclude (prev_rank), coarse_rank as final_rank, 0.5::double as rerank_score from ({COARSE_SQL}) where coarse_rank <= 5"""


def cascade(spark, sf_dir, top=k.FINAL_TOP_K, names=("dense", "sparse")):
    """50 per route -> fused -> coarse 20 -> fine."""
    coarse = ranking.coarse_rank(candidates(spark, sf_dir, names, features=True))
    return ranking.fine_rank(coarse, top, order="coarse_rank")


@query("rerank_fallback", f"select query_id, chunk_id, rerank_score, final_rank from ({CASCADE_SQL})")
def rerank_fallback(spark, sf_dir):
    return cascade(spark, sf_dir).select("query_id", "chunk_id", "rerank_score", F.col("final_rank").cast("bigint"))


def overlap_model():
    """Stand-in pair model: share of query words found in the text."""

    def score(pairs):
        out = []
        for q, c in pairs:
            words = set(q.lower().split())
            out.append(round(len(words & set(c.lower().split())) / len(words), 6) if words else 0.0)
        return out

    return score


@query("rerank_model")
def rerank_model(spark, sf_dir):
    out = ranking.fine_rank(candidates(spark, sf_dir), factory=overlap_model)
    return out.select("query_id", "chunk_id", "rerank_score", "final_rank")


CONFIDENCE = """round(0.4::double * least(greatest(coalesce({rerank}, fusion_score, 0), 0), 1)
  + 0.2::double * (case when dense_score is null or sparse_score is null then 0.5::double when dense_score > 0.5 and sparse_score > 5 then 0.8
      when dense_score > 0.3 or sparse_score > 3 then 0.6 else 0.4 end)
  + 0.2::double * (case when length(content) > 200 then 0.7::double when length(content) > 50 then 0.5 else 0.3 end)
  + 0.2::double * (case when page_number is not null then 0.8::double else 0.6 end), 6)"""
SCORED_SQL = f"select *, {CONFIDENCE.format(rerank='null::double')} as confidence from ({CAND_SQL})"
RANKED_SQL = f"select *, {CONFIDENCE.format(rerank='rerank_score')} as confidence from ({CASCADE_SQL})"


def scored(spark, sf_dir):
    return ranking.score_confidence(candidates(spark, sf_dir).withColumn("rerank_score", F.lit(None).cast("double")))


@query("confidence", f"select query_id, chunk_id, confidence from ({SCORED_SQL})")
def confidence(spark, sf_dir):
    return scored(spark, sf_dir).select("query_id", "chunk_id", "confidence")


@query("low_confidence_filter", f"select query_id, chunk_id, confidence from ({SCORED_SQL}) where confidence >= 0.45")
def low_confidence_filter(spark, sf_dir):
    return ranking.filter_low_confidence(scored(spark, sf_dir), 0.45).select("query_id", "chunk_id", "confidence")


@query(
    "aggregate_confidence",
    f"""select query_id, round(case when high >= 3 then least(m + 0.1::double, 1) else m end, 6) as aggregate_confidence from (
      select query_id, sum(confidence / prev_rank) / sum(1 / prev_rank) as m, count(*) filter (confidence >= 0.7) as high from ({SCORED_SQL}) group by query_id)""",
)
def aggregate_confidence(spark, sf_dir):
    return ranking.aggregate_confidence(scored(spark, sf_dir), "prev_rank")


_NUMS = r"list_filter(list_transform(regexp_extract_all({0}.content, '\d+\.?\d*'), lambda x: x::double), lambda x: x > 10)"
_DATE = r"regexp_extract({0}.content, '\d{{4}}[-/]\d{{1,2}}[-/]\d{{1,2}}')"
_NEG = "regexp_matches(lower({0}.content), '不|没有|否|不是|no|not|never')"
_KEYS = r"list_distinct(regexp_extract_all(lower({0}.content), '[\p{{L}}\p{{N}}_]{{3,}}'))"
PAIRS_SQL = f"""
with t as materialized (select query_id, chunk_id, prev_rank as place, content from ({CAND_SQL}) where prev_rank <= 5),
p as (select a.query_id, a.chunk_id as s, b.chunk_id as c, {_NUMS.format('a')} as n1, {_NUMS.format('b')} as n2, {_DATE.format('a')} as d1, {_DATE.format('b')} as d2,
  {_NEG.format('a')} as g1, {_NEG.format('b')} as g2, len(list_intersect({_KEYS.format('a')}, {_KEYS.format('b')})) as shared
  from t a join t b on a.query_id = b.query_id and a.place < b.place),
f as (select *, list_filter(n1, lambda x: len(list_filter(n2, lambda y: abs(x - y) > 0.5 * greatest(x, y))) > 0)[1] as x from p)
select query_id, s::varchar as supporting, c::varchar as contradicting, type, case type when 'numeric' then 0.6::double when 'temporal' then 0.5 else 0.4 end as confidence,
  case type when 'numeric' then '{conflicts.RESOLUTIONS["numeric"]}' when 'temporal' then '{conflicts.RESOLUTIONS["temporal"]}' else '{conflicts.RESOLUTIONS["factual"]}' end as resolution,
  case when type = 'numeric' then round(x, 3) else 0 end as claimed
from (select *, case when x is not null then 'numeric' when d1 <> '' and d2 <> '' and d1 <> d2 then 'temporal' when g1 <> g2 and shared > 3 then 'factual' end as type from f)
where type is not null
"""


@query("conflict_pairs", PAIRS_SQL)
def conflict_pairs(spark, sf_dir):
    out = conflicts.detect_conflicts(candidates(spark, sf_dir), "prev_rank")
    number = F.regexp_extract("claim", r": (\d+\.\d+) vs", 1).try_cast("double")
    return out.select(
        "query_id", "supporting", "contradicting", "type", "confidence", "resolution",
        F.when(F.col("type") == "numeric", F.round(number, 3)).otherwise(0.0).alias("claimed"),
    )


# ---- answers -------------------------------------------------------------

SHAPED_SQL = f"""select *, substring(content, 1, 300) as excerpt, coalesce(nullif(fusion_score, 0), nullif(rerank_score, 0), 0.0) as score from ({RANKED_SQL})"""


def shaped(spark, sf_dir, names=("dense", "sparse")):
    return answers.shape_results(ranking.score_confidence(cascade(spark, sf_dir, names=names)))


@query(
    "citations",
    f"""select query_id, chunk_id, excerpt, score, final_rank, confidence, coalesce('lang-' || l.name, 'Unknown') as document_name
      from ({SHAPED_SQL}) s left join (select doc_id, quality::varchar as name from labels) l on l.doc_id = s.chunk_id""",
)
def citations(spark, sf_dir):
    names = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id"), F.concat(F.lit("lang-"), F.col("quality").cast("string")).alias("name"))
    out = answers.cite(shaped(spark, sf_dir), names, "chunk_id")
    return out.select("query_id", "chunk_id", "excerpt", "score", F.col("final_rank").cast("bigint"), "confidence", "document_name")


AGGREGATE_SQL = f"""select query_id, round(case when high >= 3 then least(m + 0.1::double, 1) else m end, 6) as aggregate_confidence from (
      select query_id, sum(confidence / prev_rank) / sum(1 / prev_rank) as m, count(*) filter (confidence >= 0.7) as high from ({SCORED_SQL}) group by query_id)"""


@query(
    "confidence_by_day",
    f"""select strftime(ts::date::timestamp, '%Y-%m-%d %H:%M:%S.%f') as start, query_type, count(*)::bigint as count, round(avg(aggregate_confidence), 6) as mean
      from events e join ({AGGREGATE_SQL}) a on a.query_id = e.user_id join (select query_id, reported_type as query_type from ({features_sql(ASKED)})) q on q.query_id = e.user_id group by ts::date, query_type""",
)
def confidence_by_day(spark, sf_dir):
    """Mean confidence of the answers given on a day, by class of the query; an event is a user's query being asked again."""
    conf = materialize(ranking.aggregate_confidence(scored(spark, sf_dir), "prev_rank"), "confidences")
    kinds = fusion.analyze(r.queries(spark, sf_dir)).select("query_id", reported_class(F.col("length")).alias("query_type"))
    asked = b.events(spark, sf_dir).select(F.col("user_id").alias("query_id"), "ts")
    out = metrics.by_route(asked.join(conf, "query_id").join(kinds, "query_id"), "query_type", "aggregate_confidence", "1 day")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start"), "query_type", "count", F.round("mean", 6).alias("mean"))


EVIDENCE = 0.45
CONTEXT_SQL = f"""select query_id, string_agg(content, '{answers.SEPARATOR}' order by final_rank) as context, count(*)::bigint as n_sources,
  round(avg(score), 9) as confidence from ({SHAPED_SQL}) where confidence <> 0 and confidence >= 0.6 group by query_id"""


@query("qa_context", CONTEXT_SQL)
def qa_context(spark, sf_dir):
    c = answers.qa_context(shaped(spark, sf_dir))
    return c.select("query_id", "context", F.size("sources").cast("bigint").alias("n_sources"), F.round("confidence", 9).alias("confidence"))


@query(
    "qa_answer",
    f"""with p as (select item_id as query_id, coalesce(confidence, 0) as confidence, '{answers.PROMPT_HEAD}' || coalesce(context, '') || '{answers.PROMPT_QUESTION}' || text || '{answers.PROMPT_TAIL}' as prompt
      from benchmark left join ({CONTEXT_SQL}) c on c.query_id = item_id)
    select query_id, confidence, sha256(prompt) as prompt_hash, '{answers.MOCK_ANSWER}' || length(prompt) || ' characters' as answer, '{answers.MOCK_MODEL}' as model_used from p""",
)
def qa_answer(spark, sf_dir):
    prompts = answers.qa_prompts(b.queries(spark, sf_dir), answers.qa_context(shaped(spark, sf_dir)))
    out = answers.generate(prompts)
    return out.select("query_id", F.round("confidence", 9).alias("confidence"), F.sha2("prompt", 256).alias("prompt_hash"), "answer", "model_used")


@query(
    "query_metrics",
    f"""select w.query_id, reported_type as query_type, round(dense, 6) as dense, round(sparse, 6) as sparse, round(graph, 6) as graph,
      coalesce(t.n, 0)::bigint as total_candidates, coalesce(f.n, 0)::bigint as final_candidates
      from ({RAW_WEIGHTS_SQL}) w join ({features_sql(ASKED)}) q on q.query_id = w.query_id
      left join (select query_id, count(*) as n from ({CAND_SQL}) group by query_id) t on t.query_id = w.query_id
      left join (select query_id, count(*) as n from ({CAND_SQL}) where prev_rank <= 5 group by query_id) f on f.query_id = w.query_id""",
)
def query_metrics(spark, sf_dir):
    queries = r.queries(spark, sf_dir)
    found = fusion.retrieve("hybrid", queries, {n: f for n, f in routes(spark, sf_dir).items() if n != "graph"})
    found = materialize(found, "candidates")
    m = answers.query_metrics(queries, found, found.where("prev_rank <= 5"))
    return m.select("query_id", "query_type", *[F.round(c, 6).alias(c) for c in fusion.ROUTES], "total_candidates", "final_candidates")


HYBRID_SQL = SHAPED_SQL.replace(fused_sql(TWO_ROUTES_SQL), fused_sql(ALL_ROUTES_SQL))


@query("hybrid_search", f"select query_id, chunk_id, excerpt, score, final_rank, confidence from ({HYBRID_SQL})")
def hybrid_search(spark, sf_dir):
    """All three routes, fused, ranked, scored and shaped, for every query."""
    out = shaped(spark, sf_dir, ("dense", "sparse", "graph"))
    return out.select("query_id", "chunk_id", "excerpt", "score", F.col("final_rank").cast("bigint"), "confidence")


REUSE_SQL = """select min(conv_id * 1000 + turn) as query_id, text as query, 'role-' || role as tenant_id, count(*)::bigint as asked
  from conversations group by text, role"""


@query("query_reuse", REUSE_SQL)
def query_reuse(spark, sf_dir):
    """Every turn asked once per distinct text and role; how often it was asked."""
    batch = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.concat(F.lit("role-"), F.col("role")).alias("tenant_id"),
        F.col("text").alias("query"), F.lit("hybrid").alias("mode"), F.timestamp_seconds(F.lit(0)).alias("ts"),
    )
    keyed, once = answers.distinct_queries(batch)
    asked = keyed.groupBy("key").agg(F.count("*").alias("asked"))
    return once.join(asked, "key").select("query_id", "query", "tenant_id", "asked")


@query(
    "answer_reuse",
    f"""with a as (select text, role, min(turn) as first from conversations group by text, role)
    select c.conv_id * 1000 + c.turn as query_id, case when first = 1 then 299 else 300 end::bigint as stored_at,
      '{answers.MOCK_ANSWER}' || length('{answers.PROMPT_HEAD}' || '{answers.PROMPT_QUESTION}' || c.text || '{answers.PROMPT_TAIL}') || ' characters' as answer
    from conversations c join a on a.text = c.text and a.role = c.role""",
)
def answer_reuse(spark, sf_dir):
    """Three batches against stored answers of an age of at most 300 seconds: first turns at 0 (too old
    at 300), second turns at 299 (taken again), and everything at 300."""
    asked = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "turn", F.concat(F.lit("role-"), F.col("role")).alias("tenant_id"), F.col("text").alias("query")
    )
    asked = asked.withColumn("key", answers.reuse_key(F.col("tenant_id"), F.col("query"), F.lit("hybrid")))
    store = ReuseStore(spark, scratch_dir(spark, "answers"), StringType(), k.QUERY_TTL)

    def make(missing):
        prompts = missing.withColumn("prompt", answers.build_prompt(F.lit(""), F.col("query")))
        return answers.generate(prompts).withColumnRenamed("answer", "value")

    store.fill(asked.where("turn = 0"), make, 0)
    store.fill(asked.where("turn <= 1"), make, k.QUERY_TTL - 1)
    out, _ = store.fill(asked, make, k.QUERY_TTL)
    return out.select("query_id", "stored_at", F.col("value").alias("answer"))
