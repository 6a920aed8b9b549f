"""Search over ingested chunks: every route within the query's tenant, fused, ranked, shown.

The stores are those that :func:`loomery.sources.stores.ingest_batch` fills. The keyword
index and the entity counts are made of them once (:func:`open_search`) and searched many
times. Ranking works on ids, scores and the features of a chunk's text; texts are read
for the few chunks that are shown.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery import constants as k_
from loomery.operators import answers, dense, fusion, graph, ranking, sparse
from loomery.operators.embedding import encode
from loomery.operators.filters import apply_filters
from loomery.session import materialize, scratch_dir


@dataclass
class Request:
    """What all queries of a batch ask for. ``document_ids`` is a list or a DataFrame with
    document_id, ``terms`` and ``expr`` filter on the chunk's columns (see
    :func:`loomery.operators.filters.apply_filters`). As in the contract of the routes,
    filters act on dense and keyword hits, not on hits along the graph."""

    mode: str = "hybrid"
    document_ids: object = None
    terms: dict | None = None
    expr: str | None = None
    min_score: float = 0.0
    k: int = k_.RETRIEVER_TOP_K

    @property
    def filtered(self) -> bool:
        return self.document_ids is not None or bool(self.terms) or bool(self.expr)


@dataclass
class ChunkSearch:
    chunks: DataFrame  # tenant_id, document_id, chunk_id, chunk_index, page_number, chunk_type, heading_text, content
    vectors: DataFrame  # the same with embedding
    index: sparse.InvertedIndex
    mentions: DataFrame  # tenant_id, chunk_id, entity_id, size
    entities: DataFrame
    encoder: Callable

    def allowed(self, request: Request) -> DataFrame | None:
        """(tenant_id, chunk_id) that pass the filters; None for all."""
        if not request.filtered:
            return None
        return apply_filters(self.chunks, None, request.document_ids, request.terms, request.expr).select("tenant_id", "chunk_id")

    def routes(self, queries: DataFrame, request: Request) -> dict[str, Callable[[], DataFrame]]:
        """Hits of each route, run when called and stored: at most k rows per query."""

        def run_dense():
            asked = queries.select("query_id", "tenant_id", encode(self.encoder)("query").alias("embedding"))
            corpus = apply_filters(self.vectors, None, request.document_ids, request.terms, request.expr)
            return dense.dense_topk(asked, corpus, request.k, tenant="tenant_id")

        def run_sparse():
            terms = sparse.query_terms(queries, tenant="tenant_id")
            return sparse.bm25_topk(terms, self.index, request.k, allowed=self.allowed(request), min_score=request.min_score)

        def run_graph():
            seeds = materialize(graph.query_seeds(queries, self.entities, tenant=True), "seeds")
            return graph.multi_hop(seeds, graph.neighbours(seeds, self.mentions, tenant=True), self.mentions, request.k, tenant=True)

        runs = {"dense": run_dense, "sparse": run_sparse, "graph": run_graph}
        return {name: (lambda name=name, run=run: materialize(run(), f"{name}-hits")) for name, run in runs.items()}

    def candidates(self, queries: DataFrame, request: Request = Request(), tolerate: bool = False) -> DataFrame:
        """(query_id, chunk_id, scores, prev_rank) of the request's mode.

        ``queries``: query_id, tenant_id, query. A query only meets chunks of its own tenant.
        """
        return fusion.retrieve(request.mode, queries, self.routes(queries, request), request.k, tolerate)

    def search(self, queries: DataFrame, request: Request = Request(), access: DataFrame | None = None, top: int = k_.FINAL_TOP_K, factory=None, tolerate: bool = False) -> DataFrame:
        """The ``top`` chunks of each query, scored and shaped.

        ``access``: chunk_id, access_count. Queries without hits have no row.
        """
        found = materialize(self.candidates(queries, request, tolerate).join(queries.select("query_id", "tenant_id", "query"), "query_id"), "candidates")
        key = ["tenant_id", "chunk_id"]
        hit = found.select(*key).distinct()
        features = ranking.content_features(self.chunks.join(hit, key, "left_semi").select(*key, "chunk_index", "content")).drop("content")
        rows = found.join(features, key)
        if access is None:
            rows = rows.withColumn("access_count", F.lit(None).cast("bigint"))
        else:
            rows = rows.join(access, "chunk_id", "left")
        coarse = materialize(ranking.coarse_rank(rows).drop("chunk_index"), "coarse")  # ids and scores, some 20 a query
        texts = self.chunks.join(coarse.select(*key).distinct(), key, "left_semi")
        fine = ranking.fine_rank(coarse.join(texts, key), top, factory, order="coarse_rank")
        return answers.shape_results(ranking.score_confidence(fine))


def open_search(tables: dict[str, DataFrame], root: str, encoder) -> ChunkSearch:
    """Make the indexes over the stores' rows (see ``stores.STORES``) under ``root``."""
    chunks = tables["keywords"]
    spark = chunks.sparkSession
    words = sparse.keyword_words(chunks, heading="heading_text")
    index = sparse.write_inverted_index(words, root or scratch_dir(spark, "chunk-index"))
    m = tables["mentions"].select("tenant_id", "chunk_id", "entity_id")
    size = m.groupBy("tenant_id", "chunk_id").agg(F.count("*").cast("int").alias("size"))
    mentions = materialize(m.join(size, ["tenant_id", "chunk_id"]), "sized-mentions")
    entities = materialize(graph.extract_entities(mentions), "entities")
    return ChunkSearch(chunks, tables["vectors"], index, mentions, entities, encoder)
