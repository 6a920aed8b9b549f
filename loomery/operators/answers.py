"""Search results, answer contexts, prompts and generation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery import constants as k_
from loomery.functions.queries import analyze, reported_class
from loomery.functions.text import content_hash
from loomery.operators.ranking import filter_evidence

SEPARATOR = "\n\n---\n\n"

# Prompt template and placeholder answer.
PROMPT_HEAD = '基于以下参考文档回答问题。如果参考文档中没有相关信息，请说明"根据提供的文档，无法回答此问题"。\n\n参考文档：\n'
PROMPT_QUESTION = "\n\n问题："
PROMPT_TAIL = "\n\n请提供准确、简洁的回答，并引用来源页码。"
MOCK_ANSWER = (
    "[MOCK RESPONSE] This is a placeholder response from the mock LLM provider. "
    "To get real responses, configure a real LLM provider (ollama, vllm, or openai) "
    "in your environment variables.\n\n"
    "Original prompt length: "
)
MOCK_MODEL = "mock-model"


def cite(hits: DataFrame, documents: DataFrame, document_id: str = "document_id") -> DataFrame:
    """Add ``document_name`` by left join, 'Unknown' where missing."""
    names = documents.select(document_id, F.col("name").alias("document_name"))
    return hits.join(names, document_id, "left").withColumn("document_name", F.coalesce("document_name", F.lit("Unknown")))


def shown_score(fusion: Column, rerank: Column) -> Column:
    """Fusion score, else rerank score, else 0; zero falls through."""
    return F.coalesce(F.nullif(fusion, F.lit(0.0)), F.nullif(rerank, F.lit(0.0)), F.lit(0.0))


def shape_results(ranked: DataFrame) -> DataFrame:
    return ranked.withColumns(
        {
            "excerpt": F.substring("content", 1, k_.EXCERPT_CHARS),
            "score": shown_score(F.col("fusion_score"), F.col("rerank_score")),
        }
    )


def qa_context(results: DataFrame, top: int = k_.FINAL_TOP_K, order: str = "final_rank") -> DataFrame:
    """Per query: context of the first ``top`` evidence rows, their sources, mean score.

    A query with no evidence left has no row here; see :func:`qa_prompts`.
    """
    from loomery.operators.topk import top_k

    kept = top_k(filter_evidence(results), "query_id", [F.asc(order)], top, "place")
    item = F.struct("place", "content", "chunk_id", "score")
    rows = kept.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("_i"))  # at most ``top`` entries
    n = F.size("_i")
    return rows.select(
        "query_id",
        F.array_join(F.transform("_i", lambda x: x["content"]), SEPARATOR).alias("context"),
        F.transform("_i", lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["score"].alias("relevance_score"))).alias("sources"),
        (F.aggregate("_i", F.lit(0.0), lambda s, x: s + x["score"]) / n).alias("confidence"),
    )


def build_prompt(context: Column, question: Column) -> Column:
    return F.concat(F.lit(PROMPT_HEAD), context, F.lit(PROMPT_QUESTION), question, F.lit(PROMPT_TAIL))


def qa_prompts(queries: DataFrame, contexts: DataFrame) -> DataFrame:
    """Every question with its prompt; without evidence the context is empty, confidence 0."""
    out = queries.join(contexts, "query_id", "left")
    out = out.withColumns({"context": F.coalesce("context", F.lit("")), "confidence": F.coalesce("confidence", F.lit(0.0))})
    return out.withColumn("prompt", build_prompt(F.col("context"), F.col("query")))


def generator(factory, tolerate: bool = False):
    """Iterator pandas UDF prompt -> answer and error; ``factory`` runs once per worker.

    A prompt the model fails on fails the job, or, where that is tolerated, has no
    answer and the error's text.
    """

    @F.pandas_udf("answer string, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ask = factory()

        def one(p):
            try:
                return ask(p), None
            except Exception as e:
                if not tolerate:
                    raise
                return None, f"{type(e).__name__}: {e}"

        for prompts in batches:
            yield pd.DataFrame([one(p) for p in prompts], columns=["answer", "error"], dtype=object)

    return run


def generate(df: DataFrame, factory=None, model: str = MOCK_MODEL, tolerate: bool = False) -> DataFrame:
    """Add answer and model_used; without a model the placeholder answer.

    A model's error is raised. With ``tolerate`` such a row gets the placeholder, and a
    column ``error`` says why (null elsewhere).
    """
    mock = F.concat(F.lit(MOCK_ANSWER), F.length("prompt").cast("string"), F.lit(" characters"))
    if factory is None:
        return df.withColumns({"answer": mock, "model_used": F.lit(MOCK_MODEL)})
    got = df.withColumn("_a", generator(factory, tolerate).asNondeterministic()(F.col("prompt")))
    missing = F.col("_a.answer").isNull()
    out = {"answer": F.coalesce("_a.answer", mock), "model_used": F.when(missing, MOCK_MODEL).otherwise(model)}
    return got.withColumns(out | ({"error": F.col("_a.error")} if tolerate else {})).drop("_a")


def query_metrics(queries: DataFrame, candidates: DataFrame, results: DataFrame) -> DataFrame:
    """Per query: candidate counts, reported class and the weights used."""
    total = candidates.groupBy("query_id").agg(F.count("*").alias("total_candidates"))
    final = results.groupBy("query_id").agg(F.count("*").alias("final_candidates"))
    q = analyze(queries).select("query_id", reported_class(F.col("length")).alias("query_type"), "weights.*")
    out = q.join(total, "query_id", "left").join(final, "query_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("total_candidates", "final_candidates")})


def reuse_key(tenant: Column, query: Column, mode: Column) -> Column:
    return content_hash(F.concat_ws("\u0001", tenant, mode, query))


def distinct_queries(batch: DataFrame, stored: DataFrame | None = None, ttl: int = k_.QUERY_TTL) -> tuple[DataFrame, DataFrame]:
    """(keyed batch, queries to compute): each key once, without those stored within ``ttl``.

    ``batch``: query_id, tenant_id, query, mode, ts; ``stored``: key, stored_at.
    Join the results of the second back to the first on ``key``.
    """
    keyed = batch.withColumn("key", reuse_key(F.col("tenant_id"), F.col("query"), F.col("mode")))
    first = keyed.groupBy("key").agg(F.min_by(F.struct("query_id", "tenant_id", "query", "mode", "ts"), "query_id").alias("f")).select("key", "f.*")
    if stored is not None:
        age = F.unix_timestamp("ts") - F.unix_timestamp("stored_at")
        last = stored.groupBy("key").agg(F.max("stored_at").alias("stored_at"))
        fresh = first.join(last, "key").where((age >= 0) & (age < ttl)).select("key")
        first = first.join(fresh, "key", "left_anti")
    return keyed, first
