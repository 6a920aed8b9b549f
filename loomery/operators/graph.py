"""Entity graph: mentions of entities in chunks, and search along them.

Two hops go chunk -> entity -> chunk through the mentions table, so entity
pairs are never listed. Each hop is an equi-join followed by an aggregation that
is combined map-side, the second one cut by a bound on what a chunk can score;
skewed entities are split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery import constants as k_
from loomery.functions.queries import graph_entities
from loomery.functions.text import entity_set
from loomery.operators.topk import top_k
from loomery.session import materialize


def extract_mentions(chunks: DataFrame, text: str = "content", tenant: str = "tenant_id") -> DataFrame:
    """(tenant_id, chunk_id, entity_id): each entity once per chunk, in the row."""
    return chunks.select(F.col(tenant).alias("tenant_id"), "chunk_id", F.explode(entity_set(F.col(text))).alias("entity_id"))


def sized_mentions(chunks: DataFrame, text: str = "content", tenant: str = "tenant_id") -> DataFrame:
    """Mentions with ``size``, the number of entities of the chunk, which bounds its score."""
    found = chunks.select(F.col(tenant).alias("tenant_id"), "chunk_id", entity_set(F.col(text)).alias("_e"))
    return found.select("tenant_id", "chunk_id", F.explode("_e").alias("entity_id"), F.size("_e").alias("size"))


def entity_type(name):
    return F.when(F.rlike(name, F.lit(r"^\d+$")), "number").when(F.rlike(name, F.lit(r"^[一-鿿]+$")), "cjk").otherwise("name")


def extract_entities(mentions: DataFrame) -> DataFrame:
    """(tenant_id, entity_id, name, entity_type, mention_count)."""
    e = mentions.groupBy("tenant_id", "entity_id").agg(F.count("*").alias("mention_count"))
    return e.select("tenant_id", "entity_id", F.col("entity_id").alias("name"), entity_type(F.col("entity_id")).alias("entity_type"), "mention_count")


def query_seeds(queries: DataFrame, entities: DataFrame, tenant: bool = False) -> DataFrame:
    """(query_id[, tenant_id], entity_id) of the entities a query names."""
    keys = ["query_id"] + (["tenant_id"] if tenant else [])
    named = queries.select(*keys, F.explode(F.array_distinct(graph_entities(F.col("query")))).alias("name"))
    on = ["name"] + (["tenant_id"] if tenant else [])
    return named.join(entities, on).select(*keys, "entity_id").distinct()


def one_hop(seeds: DataFrame, mentions: DataFrame, k: int = k_.RETRIEVER_TOP_K, tenant: bool = False) -> DataFrame:
    """Chunks that mention a seed, score 1."""
    keys = ["entity_id"] + (["tenant_id"] if tenant else [])
    hits = seeds.join(mentions, keys).select("query_id", "chunk_id").distinct().withColumn("graph_score", F.lit(1.0))
    return top_k(hits, "query_id", [F.desc("graph_score"), F.asc("chunk_id")], k)


def neighbours(seeds: DataFrame, mentions: DataFrame, tenant: bool = False) -> DataFrame:
    """(query_id, entity_id): entities that share a chunk with a seed, seeds left out.

    Chunks and neighbours are found once per distinct seed, not per query.
    """
    scope = ["tenant_id"] if tenant else []
    asked = seeds.select(*scope, F.col("entity_id").alias("seed")).distinct()
    where = asked.join(mentions.withColumnRenamed("entity_id", "seed"), ["seed"] + scope).select(*scope, "seed", "chunk_id")
    linked = where.join(mentions, ["chunk_id"] + scope).where("entity_id <> seed").select(*scope, "seed", "entity_id").distinct()
    found = seeds.withColumnRenamed("entity_id", "seed").join(linked, ["seed"] + scope).select("query_id", *scope, "entity_id").distinct()
    return found.join(seeds, ["query_id", "entity_id"], "left_anti")


def cooccurrence(anchors: DataFrame, mentions: DataFrame) -> DataFrame:
    """(src, dst, chunks): in how many chunks each anchor meets each other entity.

    Counted from the anchors outward, never over all pairs of a chunk.
    """
    src = anchors.select(F.col("entity_id").alias("src")).distinct()
    at = src.join(mentions.withColumnRenamed("entity_id", "src"), "src").select("src", "chunk_id")
    met = at.join(mentions.select("chunk_id", F.col("entity_id").alias("dst")), "chunk_id").where("src <> dst")
    return met.groupBy("src", "dst").agg(F.count("*").alias("chunks"))


def _second_hop(links):
    return F.round(0.5 + 0.1 * links, 6)


def multi_hop(seeds: DataFrame, shared: DataFrame, mentions: DataFrame, k: int = k_.RETRIEVER_TOP_K, tenant: bool = False) -> DataFrame:
    """(query_id, chunk_id, graph_score, rank): 1 for a chunk naming a seed, else 0.5
    for one naming a linked entity, plus 0.1 per distinct linked entity in it.

    The second hop is cut by a bound. All entities of a seed's chunk are linked, so its
    score follows from the number of its entities alone. A chunk of the second hop scores
    0.5 + 0.1 * (number of its entities) at most; only those that may reach the query's
    k-th score are joined. For queries with fewer than k chunks of seeds, that score comes
    from the chunks with most entities, k for each linked entity, counted exactly.
    """
    scope = ["tenant_id"] if tenant else []
    if "size" not in mentions.columns:
        counted = mentions.groupBy("chunk_id", *scope).agg(F.count("*").cast("int").alias("size"))
        mentions = mentions.join(counted, ["chunk_id"] + scope)
    mentions = mentions.select("chunk_id", "entity_id", "size", *scope)
    shared = materialize(shared.select("query_id", "entity_id", *scope), "linked")
    order = [F.desc("graph_score"), F.asc("chunk_id")]

    met = seeds.join(mentions, ["entity_id"] + scope).groupBy("query_id", "chunk_id").agg(F.max("size").alias("size"), F.count("*").alias("own"))
    scored = met.select("query_id", "chunk_id", F.round(1.0 + 0.1 * (F.col("size") - F.col("own")), 6).alias("graph_score"))
    # k per query are enough, and how many there are
    all_first = materialize(scored, "seed-chunks")
    first = top_k(all_first, "query_id", order, k)
    full = materialize(first.where(F.col("rank") == k).select("query_id", F.col("graph_score").alias("least")), "kth-scores")

    open_ = shared.join(full, "query_id", "left_anti")
    heads = top_k(mentions.join(open_.select("entity_id", *scope).distinct(), ["entity_id"] + scope, "left_semi"), ["entity_id"] + scope, [F.desc("size"), F.asc("chunk_id")], k)
    tried = open_.join(heads, ["entity_id"] + scope).select("query_id", "chunk_id", *scope).distinct().join(all_first, ["query_id", "chunk_id"], "left_anti")
    linked = tried.join(mentions, ["chunk_id"] + scope).join(open_, ["query_id", "entity_id"] + scope).groupBy("query_id", "chunk_id").agg(F.count("*").alias("links"))
    better = first.select("query_id", "chunk_id", "graph_score").unionByName(linked.select("query_id", "chunk_id", _second_hop(F.col("links")).alias("graph_score")))
    least = top_k(better, "query_id", order, k).where(F.col("rank") == k).select("query_id", F.col("graph_score").alias("least"))

    wanted = materialize(shared.join(least, "query_id", "left").select("query_id", "entity_id", *scope, F.coalesce("least", F.lit(0.0)).alias("least")), "wanted")
    per_entity = wanted.groupBy("entity_id", *scope).agg(F.min("least").alias("fewest"))
    possible = mentions.join(per_entity, ["entity_id"] + scope).where(_second_hop(F.col("size")) >= F.col("fewest")).drop("fewest")
    hits = (
        wanted.join(possible, ["entity_id"] + scope)
        .where(_second_hop(F.col("size")) >= F.col("least"))
        .groupBy("query_id", "chunk_id")
        .agg(F.count("*").alias("links"))  # a mention occurs once per chunk and entity
        .join(all_first, ["query_id", "chunk_id"], "left_anti")
    )
    second = hits.select("query_id", "chunk_id", _second_hop(F.col("links")).alias("graph_score"))
    return top_k(first.select("query_id", "chunk_id", "graph_score").unionByName(second), "query_id", order, k)


def graph_topk(queries: DataFrame, mentions: DataFrame, entities: DataFrame, k: int = k_.RETRIEVER_TOP_K, tenant: bool = False) -> DataFrame:
    seeds = query_seeds(queries, entities, tenant)
    return multi_hop(seeds, neighbours(seeds, mentions, tenant), mentions, k, tenant)


def expand_hops(seeds: DataFrame, edges: DataFrame, max_hops: int = 2) -> DataFrame:
    """(query_id, entity_id, hop): entities within ``max_hops`` edges, nearest hop.

    One frontier join per hop; what a query already reached is not walked again.
    Each frontier is stored, so a hop's plan doesn't hold those before it.
    """
    reached = materialize(seeds.select("query_id", "entity_id").distinct().withColumn("hop", F.lit(0)), "hop-0")
    frontier = reached
    for hop in range(1, max_hops + 1):
        step = frontier.join(edges, frontier["entity_id"] == edges["src"]).select("query_id", F.col("dst").alias("entity_id")).distinct()
        frontier = materialize(step.join(reached, ["query_id", "entity_id"], "left_anti").withColumn("hop", F.lit(hop)), f"hop-{hop}")
        reached = reached.unionByName(frontier)
    return reached


def related_entities(starts: DataFrame, edges: DataFrame, entities: DataFrame, relations=("MENTIONS", "RELATED_TO", "SAME_AS")) -> DataFrame:
    """(src, entity_id, name, entity_type, relation): targets of the given out-edges."""
    out = edges.where(F.col("relation").isin(list(relations))).join(starts.select(F.col("entity_id").alias("src")), "src", "left_semi")
    named = entities.select(F.col("entity_id").alias("dst"), "name", "entity_type")
    return out.join(named, "dst").select("src", F.col("dst").alias("entity_id"), "name", "entity_type", "relation")


def merge_entities(entities: DataFrame, version: str = "version") -> DataFrame:
    """One row per entity: the properties of the latest version win."""
    rest = [c for c in entities.columns if c not in ("tenant_id", "entity_id")]
    last = F.max_by(F.struct(*rest), F.struct(version, *[c for c in rest if c != version])).alias("_l")
    return entities.groupBy("tenant_id", "entity_id").agg(last).select("tenant_id", "entity_id", "_l.*")


def chunk_nodes(chunks: DataFrame) -> DataFrame:
    return chunks.select("*", F.substring("content", 1, k_.GRAPH_PREVIEW_CHARS).alias("content_preview")).drop("content")


def link_mentions(mentions: DataFrame, chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with both ends present, each once."""
    keys = ["tenant_id", "chunk_id", "entity_id"]
    have = mentions.join(chunks.select("tenant_id", "chunk_id"), ["tenant_id", "chunk_id"], "left_semi")
    have = have.join(entities.select("tenant_id", "entity_id"), ["tenant_id", "entity_id"], "left_semi")
    return have.select(*keys).distinct()
