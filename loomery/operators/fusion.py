"""Weighted reciprocal rank fusion and mode dispatch."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery import constants as k_
from loomery.functions.queries import analyze

ROUTES = ("dense", "sparse", "graph")


def query_weights(queries: DataFrame) -> DataFrame:
    """(query_id, dense, sparse, graph) by query class."""
    return analyze(queries).select("query_id", "weights.*")


def rrf_fuse(hits: dict[str, DataFrame], weights: DataFrame, k: int = k_.RRF_K) -> DataFrame:
    """Fuse ranked lists into (query_id, chunk_id, three scores, fusion_score, prev_rank).

    ``hits`` maps a route to (query_id, chunk_id, <route>_score, rank); a
    missing route is an empty list. If a chunk repeats in a list its last place
    counts. ``prev_rank`` is the order by score, ties by chunk id.
    """
    from pyspark.sql import Window

    parts = []
    for route in ROUTES:
        if route in hits:
            parts.append(
                hits[route].select(
                    "query_id", "chunk_id", F.lit(route).alias("route"), F.col("rank").cast("int"), F.col(f"{route}_score").cast("double").alias("score")
                )
            )
    ranked = reduce(DataFrame.unionByName, parts)
    # one pass: per route the last place and the score there, side by side
    per_route = [F.max(F.when(F.col("route") == r, F.struct("rank", "score"))).alias(r) for r in ROUTES]
    wide = ranked.groupBy("query_id", "chunk_id").agg(*per_route)
    w = weights.select("query_id", *[F.col(r).alias(f"w_{r}") for r in ROUTES])
    share = [F.coalesce(F.col(f"w_{r}") / (k + F.col(f"{r}.rank")), F.lit(0.0)) for r in ROUTES]
    fused = wide.join(w, "query_id").select(
        "query_id", "chunk_id", *[F.col(f"{r}.score").alias(f"{r}_score") for r in ROUTES], F.round(sum(share), 9).alias("fusion_score")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("fusion_score"), F.asc("chunk_id"))
    return fused.withColumn("prev_rank", F.row_number().over(order))


def retrieve(mode: str, queries: DataFrame, routes: dict, k: int = k_.RETRIEVER_TOP_K, tolerate: bool = False) -> DataFrame:
    """Candidates of one mode: ``hybrid`` fuses all routes, the others run one.

    ``routes`` maps a route to a function without arguments that gives its hits,
    k per query at most; hybrid keeps all of them. A route that fails raises,
    unless ``tolerate`` lets it count as empty (and says so in a warning).
    """
    if mode not in ("hybrid", *ROUTES):
        raise ValueError(f"unknown mode {mode}")
    if mode != "hybrid":
        hits = routes[mode]()
        scores = [F.col(f"{r}_score") if r == mode else F.lit(None).cast("double").alias(f"{r}_score") for r in ROUTES]
        return hits.where(F.col("rank") <= k).select(
            "query_id", "chunk_id", *scores, F.lit(None).cast("double").alias("fusion_score"), F.col("rank").alias("prev_rank")
        )
    hits = {}
    for route, run in routes.items():
        try:
            hits[route] = run()
        except Exception as e:
            if not tolerate:
                raise
            warnings.warn(f"route {route} failed and counts as empty: {e}", stacklevel=2)
    if not hits:
        raise RuntimeError("every route failed")
    return rrf_fuse(hits, query_weights(queries))
