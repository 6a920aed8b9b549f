"""Entity graph over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.operators import graph
from loomery.plans import bindings as b
from loomery.plans import retrieval_plans as r
from loomery.plans.query_plans import SQL_GRAPH
from loomery.plans.registry import query
from loomery.plans.text_plans import sql_ascii_words
from loomery.session import materialize, stored_once, table


def sql_entities(x: str) -> str:
    return rf"""list_distinct(list_concat(list_concat(regexp_extract_all({sql_ascii_words(x)}, '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b'),
      regexp_extract_all({sql_ascii_words(x)}, '\b\d{{3,}}\b')), regexp_extract_all({x}, '[一-鿿]{{2,4}}')))"""


MENTIONS_SQL = f"select source as tenant_id, doc_id as chunk_id, unnest({sql_entities('text')}) as entity_id from documents"
SEEDS_SQL = f"""select distinct query_id, e as entity_id from (select item_id as query_id, unnest({SQL_GRAPH.replace('query', 'text')}) as e from benchmark)
  where e in (select entity_id from m)"""
GRAPH_CTE = f"""m as materialized ({MENTIONS_SQL}), seeds as materialized ({SEEDS_SQL}),
links as materialized (select distinct a.entity_id as seed, c.entity_id from (select distinct entity_id from seeds) a join m b using (entity_id) join m c using (chunk_id)),
shared as materialized (select distinct s.query_id, l.entity_id from seeds s join links l on l.seed = s.entity_id
  where not exists (select 1 from seeds t where t.query_id = s.query_id and t.entity_id = l.entity_id))"""
GRAPH_SQL = f"""with {GRAPH_CTE},
h as (select query_id, chunk_id, max(seed) as seed, sum(1 - seed) as links from (select query_id, entity_id, 1 as seed from seeds
  union all select query_id, entity_id, 0 from shared) join m using (entity_id) group by query_id, chunk_id),
g as (select query_id, chunk_id, round(case when seed = 1 then 1.0::double else 0.5 end + 0.1::double * links, 6) as graph_score from h)
select query_id, chunk_id, graph_score, rank from (select *, row_number() over (partition by query_id order by graph_score desc, chunk_id) as rank from g) where rank <= 50"""


def mentions(spark, sf_dir):
    docs = b.documents(spark, sf_dir).select("tenant_id", F.col("doc_id").alias("chunk_id"), "text")
    return graph.extract_mentions(docs, "text")


def stored_graph(spark, sf_dir):
    """Mentions stored once; the searches walk the table."""

    def make():
        docs = b.documents(spark, sf_dir).select("tenant_id", F.col("doc_id").alias("chunk_id"), "text")
        return materialize(graph.sized_mentions(docs, "text"), "mentions")

    m = stored_once(spark, make, "mentions", sf_dir)
    return m, graph.extract_entities(m.withColumn("tenant_id", F.lit("all")))


@query("entity_mentions", MENTIONS_SQL)
def entity_mentions(spark, sf_dir):
    return mentions(spark, sf_dir)


@query(
    "entities",
    f"""select tenant_id, entity_id, count(*)::bigint as mention_count, case when regexp_matches(entity_id, '^\\d+$') then 'number' else 'name' end as entity_type
      from ({MENTIONS_SQL}) group by all""",
)
def entities(spark, sf_dir):
    return graph.extract_entities(mentions(spark, sf_dir)).drop("name")


@query("entity_cooccurrence", f"""with m as materialized ({MENTIONS_SQL}), seeds as ({SEEDS_SQL})
select a.entity_id as src, c.entity_id as dst, count(*)::bigint as chunks from (select distinct entity_id from seeds) a join m b using (entity_id)
  join m c using (chunk_id) where c.entity_id <> a.entity_id group by all""")
def entity_cooccurrence(spark, sf_dir):
    m, e = stored_graph(spark, sf_dir)
    return graph.cooccurrence(graph.query_seeds(r.queries(spark, sf_dir), e), m)


@query("graph_one_hop", f"""with {GRAPH_CTE} select query_id, chunk_id, 1.0::double as graph_score, rank from (
  select *, row_number() over (partition by query_id order by chunk_id) as rank from (select distinct query_id, chunk_id from seeds join m using (entity_id))) where rank <= 50""")
def graph_one_hop(spark, sf_dir):
    m, e = stored_graph(spark, sf_dir)
    out = graph.one_hop(graph.query_seeds(r.queries(spark, sf_dir), e), m)
    return out.withColumn("rank", F.col("rank").cast("bigint"))


def graph_hits(spark, sf_dir):
    m, e = stored_graph(spark, sf_dir)
    # stored: its true size decides how the walks join it
    seeds = materialize(graph.query_seeds(r.queries(spark, sf_dir), e), "seeds")
    return graph.multi_hop(seeds, graph.neighbours(seeds, m), m)


@query("graph_two_hop", GRAPH_SQL)
def graph_two_hop(spark, sf_dir):
    return graph_hits(spark, sf_dir).withColumn("rank", F.col("rank").cast("bigint"))


EDGES_SQL = """select 'r' || n_regionkey as src, 'n' || n_nationkey as dst, 'RELATED_TO' as relation from nation
  union all select 'n' || c_nationkey, 'c' || c_custkey, 'MENTIONS' from customer
  union all select 'c' || o_custkey, 'o' || o_orderkey, 'PLACED' from orders
  union all select 'n' || s_nationkey, 's' || s_suppkey, 'SAME_AS' from supplier"""
NODES_SQL = """select 'r' || r_regionkey as entity_id, r_name as name, 'region' as entity_type from region
  union all select 'n' || n_nationkey, n_name, 'nation' from nation union all select 'c' || c_custkey, c_name, 'customer' from customer
  union all select 's' || s_suppkey, s_name, 'supplier' from supplier union all select 'o' || o_orderkey, o_orderpriority, 'order' from orders"""


def _id(prefix, col):
    return F.concat(F.lit(prefix), F.col(col).cast("string"))


def edges(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    parts = [
        ("nation", "r", "n_regionkey", "n", "n_nationkey", "RELATED_TO"),
        ("customer", "n", "c_nationkey", "c", "c_custkey", "MENTIONS"),
        ("orders", "c", "o_custkey", "o", "o_orderkey", "PLACED"),
        ("supplier", "n", "s_nationkey", "s", "s_suppkey", "SAME_AS"),
    ]
    out = None
    for name, p, src, q, dst, rel in parts:
        e = t(name).select(_id(p, src).alias("src"), _id(q, dst).alias("dst"), F.lit(rel).alias("relation"))
        out = e if out is None else out.unionByName(e)
    return out


def nodes(spark, sf_dir):
    parts = [
        ("region", "r", "r_regionkey", "r_name"), ("nation", "n", "n_nationkey", "n_name"), ("customer", "c", "c_custkey", "c_name"),
        ("supplier", "s", "s_suppkey", "s_name"), ("orders", "o", "o_orderkey", "o_orderpriority"),
    ]
    out = None
    for name, p, key, label in parts:
        kind = "order" if name == "orders" else name
        n = table(spark, sf_dir, name).select(_id(p, key).alias("entity_id"), F.col(label).alias("name"), F.lit(kind).alias("entity_type"))
        out = n if out is None else out.unionByName(n)
    return out


@query(
    "graph_expand_hops",
    f"""with recursive e as materialized ({EDGES_SQL}), f as (select 'r' || r_regionkey as query_id, 'r' || r_regionkey as entity_id, 0 as hop from region
      union select f.query_id, e.dst, hop + 1 from f join e on e.src = f.entity_id where hop < 3)
    select query_id, entity_id, min(hop)::bigint as hop from f group by all""",
)
def graph_expand_hops(spark, sf_dir):
    seeds = table(spark, sf_dir, "region").select(_id("r", "r_regionkey").alias("query_id"), _id("r", "r_regionkey").alias("entity_id"))
    out = graph.expand_hops(seeds, edges(spark, sf_dir).select("src", "dst"), 3)
    return out.withColumn("hop", F.col("hop").cast("bigint"))


@query(
    "related_entities",
    f"""select src, dst as entity_id, name, entity_type, relation from ({EDGES_SQL}) e join ({NODES_SQL}) n on n.entity_id = e.dst
      where relation in ('MENTIONS', 'RELATED_TO', 'SAME_AS') and src in (select 'n' || n_nationkey from nation)""",
)
def related_entities(spark, sf_dir):
    starts = table(spark, sf_dir, "nation").select(_id("n", "n_nationkey").alias("entity_id"))
    return graph.related_entities(starts, edges(spark, sf_dir), nodes(spark, sf_dir))


@query(
    "merge_entities",
    """select tenant_id, entity_id, arg_max(clerk, version) as clerk, max(version)::bigint as version from (
      select o_orderpriority as tenant_id, o_custkey::varchar as entity_id, o_orderstatus || o_totalprice as clerk, o_orderkey as version from orders) group by all""",
)
def merge_entities(spark, sf_dir):
    """Every order is a version of its customer's entity."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("tenant_id"), F.col("o_custkey").cast("string").alias("entity_id"),
        F.concat(F.col("o_orderstatus"), F.col("o_totalprice").cast("string")).alias("clerk"), F.col("o_orderkey").alias("version"),
    )
    return graph.merge_entities(o)


@query("chunk_nodes", "select doc_id as chunk_id, source as tenant_id, substring(text, 1, 500) as content_preview from documents")
def chunk_nodes(spark, sf_dir):
    d = b.documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "tenant_id", F.col("text").alias("content"))
    return graph.chunk_nodes(d)


@query(
    "link_mentions",
    f"""with m as ({MENTIONS_SQL}) select tenant_id, chunk_id, entity_id from m where chunk_id in (select doc_id from labels where quality = 1)
      and exists (select 1 from (select tenant_id, entity_id from m group by all having count(*) > 1) e where e.tenant_id = m.tenant_id and e.entity_id = m.entity_id)""",
)
def link_mentions(spark, sf_dir):
    """Edges from chunks of good quality to entities named more than once."""
    m = mentions(spark, sf_dir)
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("chunk_id"))
    chunks = b.documents(spark, sf_dir).select("tenant_id", F.col("doc_id").alias("chunk_id")).join(good, "chunk_id", "left_semi")
    return graph.link_mentions(m, chunks, graph.extract_entities(m).where("mention_count > 1"))
