"""Coarse rank, fine rerank and confidence over candidates.

``candidates``: query_id, chunk_id, query, content, chunk_index, page_number,
score columns and prev_rank, the place in the list that came in.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery import constants as k_
from loomery.functions.text import entity_set, let, term_counts, tokens
from loomery.operators.topk import top_k


def _norm(counts: Column) -> Column:
    return F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x["tf"].cast("double") * x["tf"]))


def lexical_cosine(query_counts: Column, content_counts: Column, content_norm: Column) -> Column:
    """Cosine of term counts; 0 when either side has no words."""

    def shared(asked):
        # only the words both sides have are paired term by term
        both = F.filter(content_counts, lambda c: F.array_contains(asked, c["term"]))
        return F.aggregate(
            both,
            F.lit(0.0),
            lambda s, x: s + x["tf"] * F.get(F.filter(query_counts, lambda q: q["term"] == x["term"]), F.lit(0))["tf"],
        )

    dot = let(F.transform(query_counts, lambda q: q["term"]), shared)
    return F.coalesce(F.try_divide(dot, _norm(query_counts) * content_norm), F.lit(0.0))


def entity_overlap(query_entities: Column, content_entities: Column) -> Column:
    hits = F.size(F.array_intersect(query_entities, content_entities))
    return F.coalesce(F.try_divide(hits, F.size(query_entities)), F.lit(0.0))


def recency(chunk_index: Column) -> Column:
    i = F.coalesce(chunk_index, F.lit(0))
    return F.when(i < 10, 0.9).when(i < 50, 0.7).otherwise(0.5)


def authority(access_count: Column) -> Column:
    return F.when(access_count > 100, 0.9).when(access_count > 10, 0.7).otherwise(0.5)


_CONTENT = ("_cc", "_cn", "_ce")


def content_features(chunks: DataFrame, content: str = "content") -> DataFrame:
    """Term counts, their norm and entities of a text. Call it before the join
    with the candidates: once per chunk, however many queries found it."""
    out = chunks.withColumns({"_cc": term_counts(tokens(F.col(content))), "_ce": entity_set(F.col(content))})
    return out.withColumn("_cn", _norm(F.col("_cc")))


def coarse_score(df: DataFrame) -> DataFrame:
    """Add tfidf, entity, recency, authority and coarse_score."""
    if any(c not in df.columns for c in _CONTENT):
        df = content_features(df)
    out = df.withColumns({"_qc": term_counts(tokens(F.col("query"))), "_qe": entity_set(F.col("query"))})
    out = out.withColumns(
        {
            "tfidf": lexical_cosine(F.col("_qc"), F.col("_cc"), F.col("_cn")),
            "entity": entity_overlap(F.col("_qe"), F.col("_ce")),
            "recency": recency(F.col("chunk_index")),
            "authority": authority(F.col("access_count")),
        }
    ).drop("_qc", "_qe", *_CONTENT)
    total = 0.4 * F.col("tfidf") + 0.3 * F.col("entity") + 0.15 * F.col("recency") + 0.15 * F.col("authority")
    return out.withColumn("coarse_score", F.round(total, 6))


def coarse_rank(candidates: DataFrame, k: int = k_.COARSE_TOP_K) -> DataFrame:
    return top_k(coarse_score(candidates), "query_id", [F.desc("coarse_score"), F.asc("prev_rank")], k, "coarse_rank")


def reranker(factory, chars: int = k_.RERANK_CHARS):
    """Iterator pandas UDF (query, content) -> score, the best of windows of ``chars``. ``factory`` is a picklable
    callable giving ``score(list of pairs) -> list of float``, once per worker."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        score = factory()
        for q, c in batches:
            # a long text is scored window by window and takes its best
            windows = [[t[i : i + chars] for i in range(0, max(len(t), 1), chars)] for t in (x or "" for x in c)]
            found = iter(score([(a, w) for a, own in zip(q, windows) for w in own]))
            yield pd.Series([max(next(found) for _ in own) for own in windows], dtype="float64")

    return run


def fine_rank(candidates: DataFrame, k: int = k_.FINAL_TOP_K, factory=None, order: str = "prev_rank") -> DataFrame:
    """Pair score of the whole text; 0.5 for all without a model."""
    score = F.lit(0.5) if factory is None else reranker(factory)(F.col("query"), F.col("content"))
    return top_k(candidates.withColumn("rerank_score", score), "query_id", [F.desc("rerank_score"), F.asc(order)], k, "final_rank")


def confidence(rerank: Column, fusion: Column, dense: Column, sparse: Column, content: Column, page: Column) -> Column:
    base = F.least(F.greatest(F.coalesce(rerank, fusion, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    agreement = (
        F.when(dense.isNull() | sparse.isNull(), 0.5)
        .when((dense > 0.5) & (sparse > 5), 0.8)
        .when((dense > 0.3) | (sparse > 3), 0.6)
        .otherwise(0.4)
    )
    n = F.length(F.coalesce(content, F.lit("")))
    quality = F.when(n > 200, 0.7).when(n > 50, 0.5).otherwise(0.3)
    trace = F.when(page.isNotNull(), 0.8).otherwise(0.6)
    return 0.4 * base + 0.2 * agreement + 0.2 * quality + 0.2 * trace


def score_confidence(df: DataFrame) -> DataFrame:
    c = {n: F.col(n) for n in ("rerank_score", "fusion_score", "dense_score", "sparse_score", "content", "page_number")}
    return df.withColumn("confidence", F.round(confidence(*c.values()), 6))


def filter_low_confidence(df: DataFrame, threshold: float = k_.CONFIDENCE_THRESHOLD) -> DataFrame:
    return df.where(F.coalesce("confidence", F.lit(0.0)) >= threshold)


def filter_evidence(df: DataFrame, threshold: float = k_.CONFIDENCE_THRESHOLD) -> DataFrame:
    """Answer evidence: confidence present, not zero, and at the threshold."""
    return df.where((F.col("confidence") != 0) & (F.col("confidence") >= threshold))


def aggregate_confidence(df: DataFrame, order: str = "final_rank") -> DataFrame:
    """Per query: mean weighted by 1/place, +0.1 (at most 1) with three at 0.7 or more."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(order))
    c = F.coalesce("confidence", F.lit(0.0))
    agg = df.withColumn("_w", 1 / place).groupBy("query_id").agg(
        F.sum(c * F.col("_w")).alias("s"), F.sum("_w").alias("w"), F.count_if(c >= 0.7).alias("high")
    )
    mean = F.col("s") / F.col("w")
    return agg.select("query_id", F.round(F.when(F.col("high") >= 3, F.least(mean + 0.1, F.lit(1.0))).otherwise(mean), 6).alias("aggregate_confidence"))
