"""Search over ingested chunks: tenants, filters, modes, odd input."""

import pytest
from pyspark.sql import functions as F

from loomery.operators.embedding import HashedTermEncoder
from loomery.operators.search import Request, open_search
from loomery.session import scratch_dir
from loomery.sources import stores

DOCS = [
    ("a", 1, "Berlin has many lakes and parks."),
    ("a", 2, "Parks in Berlin: lakes of Berlin and more lakes."),
    ("a", 3, "Nothing of that kind here, only Paris."),
    ("b", 4, "Berlin has many lakes and parks."),
    ("b", 5, None),
    ("c", 6, ""),
]
QUERIES = [(1, "a", "lakes in Berlin"), (2, "b", "lakes in Berlin"), (3, "c", "lakes in Berlin"), (4, "a", ""), (5, "nobody", "lakes")]


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame(DOCS, "tenant_id string, document_id int, text string")
    encoder, root = HashedTermEncoder(64), scratch_dir(spark, "search-test")
    tables = stores.open_stores(docs, f"{root}/stores", encoder, buckets=1)
    stores.ingest_batch(tables, docs, encoder, 0)
    return open_search({n: t.rows() for n, t in tables.items()}, f"{root}/index", encoder)


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(QUERIES, "query_id int, tenant_id string, query string")


def _hits(df):
    out = {}
    for r in df.orderBy("query_id", "prev_rank").collect():
        out.setdefault(r["query_id"], []).append(r["chunk_id"])
    return out


def test_every_mode_stays_in_the_tenant(found, queries):
    for mode in ("dense", "sparse", "graph", "hybrid"):
        got = _hits(found.candidates(queries, Request(mode)))
        assert set(got[2]) == {"4_0"} and set(got[1]) <= {"1_0", "2_0", "3_0"} and 3 not in got and 5 not in got
    assert _hits(found.candidates(queries, Request("sparse")))[1] == ["2_0", "1_0"]


def test_filters_act_on_dense_and_keyword_hits(spark, found, queries):
    only = [1, 3]
    assert _hits(found.candidates(queries, Request("sparse", document_ids=only))) == {1: ["1_0"]}
    ids = spark.createDataFrame([(i,) for i in only], "document_id int")
    assert set(_hits(found.candidates(queries, Request("dense", document_ids=ids)))[1]) == {"1_0", "3_0"}
    assert found.candidates(queries, Request("sparse", terms={"chunk_type": "table"})).count() == 0
    assert _hits(found.candidates(queries, Request("sparse", expr="content like 'Parks%'")))[1] == ["2_0"]
    assert set(_hits(found.candidates(queries, Request("hybrid", document_ids=only)))[1]) == {"1_0", "2_0", "3_0"}  # 2_0 along the graph


def test_least_score_and_length(found, queries):
    assert found.candidates(queries, Request("sparse", min_score=99.0)).count() == 0
    assert _hits(found.candidates(queries, Request("sparse", k=1))) == {1: ["2_0"], 2: ["4_0"]}


def test_results_are_shaped(found, queries):
    rows = found.search(queries).collect()
    assert {r["query_id"] for r in rows} <= {1, 2, 4} and all(r["excerpt"] == r["content"][:300] for r in rows)
    assert len({(r["query_id"], r["chunk_id"]) for r in rows}) == len(rows)
    assert [r["chunk_id"] for r in rows if r["query_id"] == 2] == ["4_0"]


def test_failed_route_and_unknown_mode(found, queries, monkeypatch):
    with pytest.raises(ValueError):
        found.candidates(queries, Request("other"))
    from loomery.operators import graph

    def broken(*a, **k):
        raise RuntimeError("no graph")

    monkeypatch.setattr(graph, "multi_hop", broken)
    with pytest.raises(RuntimeError):
        found.candidates(queries, Request("hybrid"))
    with pytest.warns(UserWarning):
        assert set(_hits(found.candidates(queries, Request("hybrid"), tolerate=True))[2]) == {"4_0"}


def test_no_queries(spark, found, queries):
    none = queries.where(F.lit(False))
    assert found.candidates(none, Request("hybrid")).count() == 0 and found.search(none).count() == 0


def test_an_encoder_remembers_so_many_words(monkeypatch):
    import inspect

    from loomery.operators import embedding

    texts = [" ".join(f"w{i}" for i in range(at, at + 30)) for at in range(0, 300, 10)]
    want = HashedTermEncoder(16)()(texts)
    monkeypatch.setattr(embedding, "MAX_PLACES", 7)
    fn = HashedTermEncoder(16)()
    assert (fn(texts) == want).all()
    place = inspect.getclosurevars(fn).nonlocals["place"]
    assert 0 < len(inspect.getclosurevars(place).nonlocals["places"]) <= 7


def test_a_batch_that_every_store_has_is_not_chunked_again(spark, monkeypatch):
    from loomery.operators import chunking

    docs = spark.createDataFrame(DOCS, "tenant_id string, document_id int, text string")
    encoder = HashedTermEncoder(8)
    tables = stores.open_stores(docs, f"{scratch_dir(spark, 'again')}/stores", encoder, buckets=1)
    stores.ingest_batch(tables, docs, encoder, 3)
    rows = tables["chunks"].rows().count()
    monkeypatch.setattr(chunking, "chunk_text", lambda *a, **k: pytest.fail("chunked again"))
    stores.ingest_batch(tables, docs, encoder, 3)
    stores.ingest_batch(tables, docs, encoder, 1)
    assert rows and tables["chunks"].rows().count() == rows
