"""Query understanding over every benchmark item and every user turn."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.functions import queries as qf
from loomery.plans import bindings as b
from loomery.plans.registry import query
from loomery.plans.text_plans import sql_ascii_words
from loomery.session import table

# One row per query: benchmark items whole, and user turns (which also bring
# long and non-English ones).
ASKED_SQL = """select 'b' || item_id as query_id, text as query from benchmark
  union all select 'c' || conv_id || '_' || turn, text from conversations where role = 'user'
  union all select 's' || item_id, '"' || regexp_extract(text, '^\\w+ \\w+') || '" show ' || item_id || '00 who?' from benchmark"""


def asked(spark, sf_dir):
    bench, conv = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "conversations")
    item = F.col("item_id").cast("string")
    full = bench.select(F.concat(F.lit("b"), item).alias("query_id"), F.col("text").alias("query"))
    short = bench.select(
        F.concat(F.lit("s"), item).alias("query_id"),
        F.concat(F.lit('"'), F.regexp_extract("text", r"^\w+ \w+", 0), F.lit('" show '), item, F.lit("00 who?")).alias("query"),
    )
    turns = conv.where("role = 'user'").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("query_id"), F.col("text").alias("query")
    )
    return full.unionByName(turns).unionByName(short)


_CAPS = rf"regexp_extract_all({sql_ascii_words('query')}, '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b')"
_QUOTED = r"""regexp_extract_all(query, '"([^"]+)"', 1)"""
_NUMBER = rf"regexp_extract_all({sql_ascii_words('query')}, '\b\d{{3,}}\b')"
_CJK = "regexp_extract_all(query, '[一-鿿]{2,4}')"
SQL_DETECT = f"list_concat(list_concat({_CAPS}, {_QUOTED}), list_concat({_NUMBER}, list_filter({_CJK}, lambda w: w not in {tuple(qf.CJK_QUESTION_WORDS)})))"
SQL_GRAPH = f"list_concat(list_concat({_QUOTED}, {_CAPS}), list_filter({_CJK}, lambda w: w not in {tuple(qf.CJK_COMMON_NOUNS)}))"
SQL_WORDS = r"list_filter(regexp_split_to_array(query, '\s+'), lambda x: x <> '')"


def _sql_type():
    arms = " ".join(
        f"when {' or '.join(f'contains(lower(query), {m!r})' for m in marks)} then '{kind}'" for kind, marks in qf.QUESTION_WORDS.items()
    )
    return f"case {arms} else 'general' end"


FEATURES_SQL = f"""
select *, case when length <= 5 and entity_count >= 1 then 'entity' when length > 10 and entity_count = 0 then 'semantic' else 'mixed' end as query_type,
  case when length <= 5 then 'entity' when length > 15 then 'semantic' else 'mixed' end as reported_type
from (select query_id, query, len({SQL_WORDS})::bigint as length, array_to_string({SQL_DETECT}, '|') as entities, len({SQL_DETECT})::bigint as entity_count,
  {_sql_type()} as question_type,
  coalesce(round(len(list_filter({SQL_WORDS}, lambda x: lower(x) not in {tuple(qf.STOPWORDS)})) / nullif(len({SQL_WORDS}), 0), 6), 0.0) as keyword_ratio
  from ({{asked}}))
"""


def features_sql(asked: str) -> str:
    return FEATURES_SQL.replace("{asked}", asked)


def weights_sql(features: str) -> str:
    return f"""select query_id, round(dense / (dense + sparse + graph), 6) as dense, round(sparse / (dense + sparse + graph), 6) as sparse,
      round(graph / (dense + sparse + graph), 6) as graph from (select query_id,
      case query_type when 'entity' then 0.3::double when 'semantic' then 0.6 else 0.4 end + (length > 15)::int * 0.3::double - (entity_count > 2)::int * 0.2::double as dense,
      case query_type when 'entity' then 0.5::double when 'semantic' then 0.2 else 0.3 end - (length > 15)::int * 0.3::double + (entity_count > 2)::int * 0.2::double as sparse,
      case query_type when 'entity' then 0.2::double when 'semantic' then 0.2 else 0.3 end + (entity_count > 2)::int * 0.2::double as graph
      from ({features}))"""


@query("query_features", f"select * exclude (query) from ({features_sql(ASKED_SQL)})")
def query_features(spark, sf_dir):
    return qf.analyze(asked(spark, sf_dir)).select(
        "query_id", F.col("length").cast("bigint"), F.array_join("entities", "|").alias("entities"), F.col("entity_count").cast("bigint"),
        "question_type", F.round("keyword_ratio", 6).alias("keyword_ratio"), "query_type", qf.reported_class(F.col("length")).alias("reported_type"),
    )


@query("graph_query_entities", f"select query_id, array_to_string({SQL_GRAPH}, '|') as entities from ({ASKED_SQL})")
def graph_query_entities(spark, sf_dir):
    return asked(spark, sf_dir).select("query_id", F.array_join(qf.graph_entities(F.col("query")), "|").alias("entities"))


@query("fusion_weights", weights_sql(features_sql(ASKED_SQL)))
def fusion_weights(spark, sf_dir):
    w = qf.analyze(asked(spark, sf_dir)).select("query_id", "weights.*")
    return w.select("query_id", *[F.round(c, 6).alias(c) for c in ("dense", "sparse", "graph")])
