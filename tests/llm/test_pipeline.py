"""The pipeline's stages on planted documents, and as a whole."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = np.random.default_rng(1)
    say = lambda n: " ".join(f"{'the of and to in'.split()[rng.integers(0, 5)]} wor{rng.integers(0, 3000)}d" for _ in range(n))
    clean = [(i, say(40 + i), "en", "s", 1, "extra") for i in range(30)]
    passage, item = say(30), say(20)
    near = clean[3][1].split()
    near[10] = "changed"
    rows = clean + [
        (100, None, "en", "s", 0, None),
        (101, "123 456", None, None, None, None),
        (102, " ".join(near), "en", "s", 1, "near"),
        (103, clean[5][1], "en", "s", 1, "copy"),
        (104, f"{say(20)} {passage} {say(20)}", "en", "s", 1, "first"),
        (105, f"{say(20)} {passage} {say(20)}", "en", "s", 1, "second"),
        (106, f"{say(20)} {item} {say(20)}", "en", "s", 1, "leak"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, cut string")
    folder = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs.write.parquet(f"{folder}/documents.parquet")
    return docs, folder, passage


def test_stages_decide_as_planted(spark, planted):
    docs, folder, passage = planted
    columns, gone = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in docs.collect()}
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == columns
        gone.append(before - {r["doc_id"] for r in docs.collect()})
    assert gone == [{100, 101}, {102, 103}, set(), {106}]
    texts = {r["doc_id"]: r for r in docs.collect()}
    assert passage in texts[104]["text"] and passage not in texts[105]["text"]
    assert texts[105]["n_chars"] == len(texts[105]["text"]) and texts[104]["n_chars"] == 1
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r["doc_id"] for r in packed.collect()} == set(texts)
    assert corpus_pipeline.run(spark, folder).agg(F.sum("length")).first() == packed.agg(F.sum("length")).first()


def test_stages_take_empty_tables(spark, planted):
    docs, folder, _ = planted
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, none, folder).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, none, folder).count() == 0


def test_leaks_without_an_id_go(spark, planted):
    docs, folder, _ = planted
    bare = docs.withColumn("doc_id", F.when(F.col("doc_id") != 106, F.col("doc_id")))
    left = corpus_pipeline.drop_contaminated(spark, bare, folder)
    assert left.columns == docs.columns and left.where("cut = 'leak'").count() == 0 and left.count() == docs.count() - 1


def test_columns_named_like_the_stages_own_stay(spark, planted):
    docs, folder, _ = planted
    clash = docs.withColumns({n: F.lit(n) for n in ("_language", "_cut", "_id", "_version", "_starts", "language", "leaks", "hits")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, clash, folder)
        assert left.columns == clash.columns
        assert left.where("_language <> '_language' or _cut <> '_cut' or _id <> '_id' or leaks <> 'leaks'").count() == 0
