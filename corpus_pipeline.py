"""From raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``docs``, whatever they are, so stages can be written as
Parquet and read again in between.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm import decontamination, language_id, minhash_dedup, packing, substring_dedup
from loomery.llm.common import free_name, small_batches, store
from loomery.session import ship_package

TOKENIZER = "word_bpe_49k.json"
CERTAIN = 0.5  # a language with less of the odds than this is no decision


def _prepare(spark: SparkSession) -> None:
    ship_package(spark)
    small_batches(spark)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; without letters, or
    with no language ahead of all others together, they go."""
    _prepare(spark)
    model = language_id.train(docs)
    out = free_name(docs, "_language")
    found = language_id.identify(docs, model, out=out)
    return found.where((F.col(f"{out}.lang") != language_id.UNKNOWN) & (F.col(f"{out}.score") >= CERTAIN)).drop(out)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: word 5-shingles, similarity of 0.8 or more."""
    _prepare(spark)
    groups = minhash_dedup.near_duplicates(docs, shingle=5, percent=80)
    return docs.join(groups.where("not kept").select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under 13-word windows that an earlier document has are cut; documents
    of which nothing is left go."""
    _prepare(spark)
    out = free_name(docs, "_cut")
    cut = substring_dedup.cut(docs, window=13, out=out)
    changed = F.col(f"{out}.n_removed") > 0
    columns = {"text": F.when(changed, F.col(f"{out}.kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(changed, F.length(f"{out}.kept").cast("long")).otherwise(F.col("n_chars"))
    return cut.where(~changed | (F.col(f"{out}.n_removed") < F.col(f"{out}.n_words"))).withColumns(columns).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item, exact or edited, go."""
    _prepare(spark)
    return decontamination.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens at most; one row per piece of a document."""
    _prepare(spark)
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

ORACLE_SQL = None  # output codes, alignment and packing are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
