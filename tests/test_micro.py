"""Hand-computed cases of the single operators."""

import pytest
from pyspark.sql import functions as F

from loomery.functions import queries as qf
from loomery.functions import text as tx
from loomery.operators import answers, chunking, conflicts, fusion, governance, metrics, ranking, sparse
from loomery.sources import sections as sx


def one(spark, expr, value=None, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def text(spark, fn, value):
    return one(spark, fn(F.col("x")), value)


@pytest.mark.parametrize(
    "fn,value,want",
    [
        (tx.clean_text, "Page 3\nHello  ,world.Next", "Hello, world. Next"),
        (tx.clean_text, "Hello\n 2 / 3 ", "Hello"),
        (tx.clean_text, "copyright 2020 x\nbody\n第 4 页", "body"),
        (tx.space_punctuation, "see http://x", "see http: //x"),
        (tx.space_punctuation, "!!a", "! !a"),
        (tx.strip_charset, "Café 中文", "Caf 中文"),
        (tx.clean_table, "| a |  | b |\nnope", "| a | b |"),
        (tx.clean_formula, " a  =\n b ", "a = b"),
        (tx.normalize_whitespace, "a \t b  \nc \n", "a b\nc\n"),
        (tx.estimate_tokens, "Hello world 中文", 7),
        (tx.estimate_tokens, "aaaa bbbb", 4),
        (tx.estimate_tokens, "ab c1 d", 3),
        (tx.count_tokens, "Hello world 中文", 4),
        (tx.tokens, "The cafés, a b2 x", ["the", "cafés", "b2"]),
        (qf.question_type, "show me", "how"),
        (qf.question_type, "whole list", "who"),
        (qf.question_type, "哪个 时间", "who"),
        (qf.question_type, "list them", "general"),
        (qf.detect_entities, "Tell me about John Smith", ["Tell", "John Smith"]),
        (qf.detect_entities, 'Find "enterprise RAG systems"', ["Find", "enterprise RAG systems"]),
        (qf.detect_entities, "Project ID 12345", ["Project", "12345"]),
        (qf.detect_entities, "John Smith2 and Ann Lee, Bo", ["John", "Ann Lee", "Bo"]),
        (tx.strip, " \t\n a b \u00a0\n", "a b"),
        (tx.strip, " \n ", ""),
        (tx.space_punctuation, "a \n , b . c", "a, b. c"),
        (qf.detect_entities, "什么 北京大学", ["北京大学"]),
        (qf.graph_entities, 'ask "x y" of Bob 公司 银河', ["x y", "Bob", "银河"]),
        (qf.query_length, "  a  b c ", 3),
    ],
)
def test_text_functions(spark, fn, value, want):
    assert text(spark, fn, value) == want


def test_term_counts(spark):
    got = spark.createDataFrame([(["b", "a", "b"],), ([],)], "x array<string>").select(tx.term_counts(F.col("x")).alias("r")).collect()
    assert [(t["term"], t["tf"]) for t in got[0]["r"]] == [("a", 1), ("b", 2)]
    assert got[1]["r"] == []


@pytest.mark.parametrize(
    "kind,length,ents,want",
    [
        ("entity", 2, 1, (0.3, 0.5, 0.2)),
        ("entity", 4, 3, (0.083333, 0.583333, 0.333333)),
        ("semantic", 20, 0, (0.9, -0.1, 0.2)),
        ("mixed", 20, 0, (0.7, 0.0, 0.3)),
        ("mixed", 20, 3, (0.416667, 0.166667, 0.416667)),
    ],
)
def test_weights(spark, kind, length, ents, want):
    w = one(spark, qf.fusion_weights(F.lit(kind), F.lit(length), F.lit(ents)))
    assert (w["dense"], w["sparse"], w["graph"]) == pytest.approx(want, abs=1e-6)


def test_query_class(spark):
    q = "What are the benefits of using hybrid retrieval in enterprise RAG systems?"
    row = qf.analyze(spark.createDataFrame([(1, q), (2, "")], "query_id int, query string")).orderBy("query_id").collect()
    assert row[0]["query_type"] == "mixed" and row[0]["length"] == 12
    assert row[1]["keyword_ratio"] == 0.0


def test_fuse(spark):
    def hits(name, ids):
        return spark.createDataFrame([(1, c, 0.5, i + 1) for i, c in enumerate(ids)], f"query_id int, chunk_id int, {name}_score double, rank int")

    lists = {"dense": hits("dense", [1, 2]), "sparse": hits("sparse", [1, 3]), "graph": hits("graph", [2, 4])}
    w = spark.createDataFrame([(1, 0.4, 0.3, 0.3)], "query_id int, dense double, sparse double, graph double")
    got = [(r["chunk_id"], round(r["fusion_score"], 6)) for r in fusion.rrf_fuse(lists, w).orderBy("prev_rank").collect()]
    assert got == [(1, 0.011475), (2, 0.01137), (3, 0.004839), (4, 0.004839)]


def test_hybrid_survives_a_failed_route(spark):
    q = spark.createDataFrame([(1, "find Bob")], "query_id int, query string")
    hits = spark.createDataFrame([(1, 7, 2.0, 1)], "query_id int, chunk_id int, sparse_score double, rank int")

    def broken():
        raise ValueError("store is away")

    with pytest.warns(UserWarning, match="dense"):
        got = fusion.retrieve("hybrid", q, {"dense": broken, "sparse": lambda: hits}, tolerate=True).collect()
    assert [r["chunk_id"] for r in got] == [7]
    with pytest.raises(ValueError):
        fusion.retrieve("dense", q, {"dense": broken})


def sections_df(spark, rows):
    parts = [sx.section(F.lit(c), p, k, lvl, h) for c, p, k, lvl, h in rows]
    return spark.range(1).select(F.lit(1).alias("doc_id"), F.array(*parts).alias("sections"))


def fold(spark, rows, **limits):
    out = chunking.chunk_sections(sections_df(spark, rows), **limits).orderBy("chunk_index").collect()
    return [(r["chunk_type"], r["content"], r["page_number"], r["heading_text"]) for r in out]


def test_fold_overlap(spark):
    rows = [("aaaa bbbb", 1, "text", None, None), ("cccc dddd", 1, "text", None, None), ("eeee ffff", 1, "text", None, None), ("gggg hhhh", 1, "text", None, None)]
    df = chunking.chunk_sections(sections_df(spark, rows), min_tokens=5, max_tokens=10, min_overlap=1, max_overlap=4).orderBy("chunk_index").collect()
    assert [r["content"] for r in df] == ["aaaa bbbb\n\ncccc dddd", "cccc dddd\n\neeee ffff", "eeee ffff\n\ngggg hhhh"]
    assert [r["token_count"] for r in df] == [9, 9, 9]
    assert df[0]["chunk_id"] == "1_0" and len(df[0]["content_hash"]) == 64


def test_fold_kinds(spark):
    rows = [("intro", 1, "text", None, None), ("| a |", 2, "table", None, "T"), ("after", 3, "text", None, None), ("Head", 4, "heading", 1, "Head"), ("body", 5, "paragraph", None, None)]
    assert fold(spark, rows) == [
        ("text", "intro", 1, None), ("table", "| a |", 2, "T"), ("text", "after", 1, None), ("text", "Head\n\nbody", 4, "Head"),
    ]


def test_fold_never_splits_a_section(spark):
    assert len(fold(spark, [("word " * 4000, 1, "text", None, None)])) == 1


def test_small_text_is_one_chunk(spark):
    df = spark.createDataFrame([(1, "Small")], "doc_id int, text string")
    assert [r["content"] for r in chunking.chunk_text(df).collect()] == ["Small"]


def test_empty_text_has_no_chunk(spark):
    df = spark.createDataFrame([(1, " \n\n "), (2, "")], "doc_id int, text string")
    assert chunking.chunk_text(df).count() == 0


def test_text_headings(spark):
    df = spark.createDataFrame([("Intro:\n\nALL CAPS\n\nplain text",)], "t string").select(F.explode(sx.text_sections(F.col("t"))).alias("s")).select("s.*")
    assert [(r["content"], r["heading_level"], r["section_type"]) for r in df.collect()] == [("Intro:", 2, "text"), ("ALL CAPS", 1, "text"), ("plain text", None, "text")]


@pytest.mark.parametrize("y,want", [(100.0, (True, False)), (500.0, (False, False)), (900.0, (False, True)), (None, (False, False))])
def test_header_footer(spark, y, want):
    h, f = tx.header_footer_flags(F.lit("plain text"), F.lit(y).cast("double"), F.lit(1000.0))
    r = spark.range(1).select(h.alias("h"), f.alias("f")).first()
    assert (r["h"], r["f"]) == want


def test_lexical_cosine(spark):
    df = spark.createDataFrame([("spark joins spark", "spark window joins", 0, None)], "query string, content string, chunk_index int, access_count int")
    assert ranking.coarse_score(df).first()["tfidf"] == pytest.approx(0.774597, abs=1e-6)


def test_confidence(spark):
    df = spark.createDataFrame(
        [(0.8, None, 0.6, 6.0, "x" * 250, 3), (0.0, None, None, None, "x" * 10, None)],
        "rerank_score double, fusion_score double, dense_score double, sparse_score double, content string, page_number int",
    )
    assert [r["confidence"] for r in ranking.score_confidence(df).collect()] == [0.78, 0.28]


def test_aggregate_confidence(spark):
    df = spark.createDataFrame([(1, 0.9, 1), (1, 0.8, 2), (1, 0.7, 3)], "query_id int, confidence double, final_rank int")
    assert ranking.aggregate_confidence(df).first()["aggregate_confidence"] == pytest.approx(0.936364, abs=1e-6)


@pytest.mark.parametrize(
    "a,b,want",
    [
        ("price 100", "price 40", ("numeric", 0.6, "数值差异: 100.0 vs 40.0")),
        ("sum 12 and 10000000", "sum 12", ("numeric", 0.6, "数值差异: 10000000.0 vs 12.0")),
        ("at 2024-01-15", "at 2023-02-07", ("numeric", 0.6, "数值差异: 15.0 vs 2023.0")),
        ("at 2024-01-05", "at 2023-02-07", ("temporal", 0.5, "时间差异: 2024-01-05 vs 2023-02-07")),
        ("at 2024/1/5", "at 2023/2/7", ("temporal", 0.5, None)),
        ("I know that spark joins big tables", "spark joins that use big tables", ("factual", 0.4, None)),
        ("price 100", "price 90", None),
        ("same words", "same words", None),
    ],
)
def test_conflicts(spark, a, b, want):
    df = spark.createDataFrame([(1, 10, a, 1), (1, 11, b, 2)], "query_id int, chunk_id int, content string, final_rank int")
    got = conflicts.detect_conflicts(df).collect()
    if want is None:
        assert got == []
        return
    assert (got[0]["type"], got[0]["confidence"], got[0]["supporting"], got[0]["contradicting"]) == (want[0], want[1], "10", "11")
    if want[2]:
        assert got[0]["claim"] == want[2]


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "aa bb"), (2, "aa aa cc"), (3, "dd")], "chunk_id int, content string")
    q = spark.createDataFrame([(1, "aa")], "query_id int, query string")
    got = sparse.bm25_topk(sparse.query_terms(q), sparse.keyword_index(docs, heading=None, tenant=None)).collect()
    assert {r["chunk_id"]: r["sparse_score"] for r in got} == pytest.approx({1: 0.213638, 2: 0.257536}, abs=1e-6)


def test_bucket_quantile(spark):
    counts = F.array(*[F.lit(x).cast("bigint") for x in (2, 6, 10, 10)])
    assert one(spark, metrics.bucket_quantile(counts, [50, 100, 200], 0.5)) == pytest.approx(87.5)
    assert one(spark, metrics.bucket_quantile(counts, [50, 100, 200], 0.95)) == pytest.approx(187.5)


def test_zero_score_falls_through(spark):
    assert one(spark, answers.shown_score(F.lit(0.0), F.lit(0.5))) == 0.5


def test_usage_without_limit(spark):
    assert one(spark, governance.usage_percent(F.lit(5), F.lit(0))) == 0.0


def test_upload_reasons(spark):
    up = spark.createDataFrame([("t", "exe", 104857601), ("t", "PDF", 1)], "tenant_id string, file_type string, file_size long")
    ten = spark.createDataFrame([("t", 5, 5)], "tenant_id string, current_documents int, max_documents int")
    got = [r["reject_reasons"] for r in sx.validate_uploads(up, ten).orderBy("file_type").collect()]
    assert got == [["quota"], ["file type", "file size", "quota"]]


def test_answer_falls_back_to_placeholder(spark):
    def model():
        def ask(p):
            if "bad" in p:
                raise ValueError("no")
            return "ok"

        return ask

    df = spark.createDataFrame([("good",), ("bad",)], "prompt string")
    got = {r["prompt"]: (r["answer"][:4], r["model_used"]) for r in answers.generate(df, model, "m", tolerate=True).collect()}
    assert got == {"good": ("ok", "m"), "bad": ("[MOC", "mock-model")}


HTML = """<html><head><title> T &amp; x </title><script>var a="<p>no</p>";</script></head><body>
<h2>Two</h2><h1>One</h1><p>first<p>second <b>bold</b></p><table><tr><th>a</th><td> b </td></tr><tr></tr></table>
<ul><li>x<ul><li>y</li></ul></li><li> </li></ul><p> </p></body></html>"""


def test_html_outline():
    got = sx.html_outline(HTML)
    assert got["title"] == "T & x"
    assert [(s["section_type"], s["heading_level"], s["content"]) for s in got["sections"]] == [
        ("heading", 1, "One"), ("heading", 2, "Two"), ("paragraph", None, "first"), ("paragraph", None, "second bold"),
        ("table", None, "| a | b |"), ("list", None, "- xy\n- y"), ("list", None, "- y"),
    ]


def test_long_runs_are_processed_whole(spark):
    words, blanks = "Word " * 60_000, "\u00a0" * 400_000
    df = spark.createDataFrame([(words, "x" + blanks + "y" + blanks)], "a string, b string")
    got = df.select(
        F.length(F.element_at(tx.entity_set(F.col("a")), 1)).alias("run"), F.length(tx.strip(F.col("b"))).alias("kept"), F.length(tx.space_punctuation(F.col("b"))).alias("same")
    ).first()
    assert got["run"] == 60_000 * 5 - 1
    assert got["kept"] == 400_002
    assert got["same"] == 800_002
