"""Exactness against brute force, and results that must not depend on layout."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomery.operators import dense, graph, metrics, sparse
from loomery.operators.chunking import chunk_text, dedup_chunks
from loomery.session import scratch_dir
from loomery.sources import stores as st
from loomery.streaming import jobs

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_grid_equals_shipped(spark, monkeypatch):
    v = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding")
    q = v.select(F.col("chunk_id").alias("query_id"), "embedding")
    shipped = rows(dense.dense_topk(q, v, 5))
    monkeypatch.setattr(dense, "MAX_SHIPPED_QUERIES", 60)
    monkeypatch.setattr(dense, "GRID_CORPUS_ROWS", 100)
    assert rows(dense.dense_topk(q, v, 5)) == shipped


def test_dense_ties_end_on_the_least_ids(spark):
    v = spark.range(1000).select(F.col("id").alias("chunk_id"), F.array(F.lit(1.0), F.lit(0.0)).alias("embedding")).repartition(7)
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<double>")
    got = dense.dense_topk(q, v, 20).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == list(range(20))


def test_ivf_recall(spark, monkeypatch):
    v = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding")
    q = v.select(F.col("chunk_id").alias("query_id"), "embedding")
    c = dense.train_centroids(v, 8)
    exact = {(r["query_id"], r["chunk_id"]) for r in dense.dense_topk(q, v, 10).collect()}
    listed = dense.assign_lists(v, c)
    found = {(r["query_id"], r["chunk_id"]) for r in dense.ivf_topk(q, listed, c, 10, probes=4).collect()}
    # the vectors are nearly isotropic: half the lists hold well over half of the neighbours
    assert len(exact & found) / len(exact) > 0.7
    everything = {(r["query_id"], r["chunk_id"]) for r in dense.ivf_topk(q, listed, c, 10, probes=8).collect()}
    assert everything == exact
    # a batch joined by list gives the same as a shipped one, also where lists and batches are cut
    monkeypatch.setattr(dense, "MAX_SHIPPED_QUERIES", 7)
    monkeypatch.setattr(dense, "GRID_CORPUS_ROWS", 9)
    joined = dense.ivf_topk(q, listed, c, 10, probes=4)
    assert {(r["query_id"], r["chunk_id"]) for r in joined.collect()} == found
    assert dense.recall(spark.createDataFrame(sorted(exact), "query_id long, chunk_id long"), joined).agg(F.avg("recall")).first()[0] == pytest.approx(len(exact & found) / len(exact))


def test_probes_are_tuned_to_a_recall(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding")
    q = v.where("chunk_id % 9 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    c = dense.train_centroids(v, 8)
    listed = dense.assign_lists(v, c)
    probes = dense.tune_probes(q, listed, c, 10, target=0.8)
    exact = dense.dense_topk(q, v, 10)
    least = lambda n: dense.recall(exact, dense.ivf_topk(q, listed, c, 10, probes=n)).agg(F.min("recall")).first()[0]
    assert 1 < probes <= 8 and least(probes) >= 0.8 > least(probes - 1)


def test_inverted_index_prunes_and_keeps_all_hits(spark, tmp_path):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    texts = [(i, " ".join(rnd.choices(words, [1 / (j + 1) for j in range(40)], k=rnd.randint(1, 60)))) for i in range(900)]
    docs = spark.createDataFrame(texts, "chunk_id long, content string")
    asked = spark.createDataFrame([(1, "w0"), (2, "w0 w39"), (3, "w1 w2 w3 w30"), (4, "none")], "query_id long, query string")
    index = sparse.write_inverted_index(sparse.keyword_index(docs, heading=None, tenant=None), str(tmp_path / "index"), buckets=8, block=4)
    got = {}
    for r in sparse.bm25_topk(sparse.query_terms(asked), index, k=20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["chunk_id"], r["sparse_score"]))
    split = {i: t.split() for i, t in texts}
    mean = sum(map(len, split.values())) / len(split)
    for q, query in [(1, ["w0"]), (2, ["w0", "w39"]), (3, ["w1", "w2", "w3", "w30"])]:
        score = dict.fromkeys(split, 0.0)
        for w in query:
            df = sum(w in t for t in split.values())
            for i, t in split.items():
                tf = t.count(w)
                if tf:
                    score[i] += math.log(1 + (len(split) - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))
        best = sorted((-round(s, 6), i) for i, s in score.items() if s > 0)[:20]
        assert sorted(got[q]) == [(n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert 4 not in got
    # a stored block is small, also of the most frequent term, and other buckets are not read
    assert index.postings.agg(F.max(F.size("list"))).first()[0] <= 30
    one = sparse.bm25_topk(sparse.query_terms(asked.where("query_id = 1")), index, k=5)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:80]


def test_an_index_moves_postings_once_and_searches_in_bounded_tasks(spark, tmp_path, monkeypatch):
    rnd = random.Random(9)
    texts = [(i, "t" + str(i % 2), " ".join(rnd.choices(["a1", "b2", "c3", f"r{i}"], [9, 3, 1, 1], k=12))) for i in range(600)]
    docs = spark.createDataFrame(texts, "chunk_id long, tenant_id string, content string")
    aggregated, by = [], type(docs).groupBy
    monkeypatch.setattr(type(docs), "groupBy", lambda df, *c: aggregated.append(df.columns) or by(df, *c))
    index = sparse.write_inverted_index(sparse.keyword_index(docs, heading=None), str(tmp_path / "index"), buckets=4, block=8)
    # postings are cut where they lie, no aggregate gathers them
    assert aggregated and not [c for c in aggregated if "chunk_id" in c and "tf" in c]
    lists = index.postings.select("tenant_id", "term", "top", "df", "ttf", F.explode("list").alias("p")).select("tenant_id", "term", "p.*")
    want = sorted((t, w, i, text.split().count(w), 12) for i, t, text in texts for w in set(text.split()))
    assert sorted(map(tuple, lists.collect())) == want
    assert index.postings.agg(F.max(F.size("list"))).first()[0] <= 8
    sums = {(r["tenant_id"], r["term"]): (r["df"], r["ttf"]) for r in index.terms.collect()}
    assert sums[("t0", "a1")] == (sum(w[:2] == ("t0", "a1") for w in want), sum(w[3] for w in want if w[:2] == ("t0", "a1")))
    monkeypatch.setattr(sparse, "PAIRS_PER_TASK", 20)
    asked = sparse.query_terms(spark.createDataFrame([(1, "a1 c3", "t0"), (2, "b2", "t1")], "query_id long, query string, tenant_id string"), tenant="tenant_id")
    plan = sparse.bm25_topk(asked, index)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(chunk_id" in plan and ", 60), REPARTITION_BY_NUM" in plan  # 600 documents, 2 queries


def test_an_index_of_words_gathers_in_tasks_and_spreads_frequent_terms(spark, tmp_path, monkeypatch):
    rnd = random.Random(17)
    texts = [(i, "t" + str(i % 3), " ".join(rnd.choices(["a1", "b2", f"r{i % 50}"], [9, 2, 1], k=i % 7)), rnd.choice([None, "", "a1 a1 zz"])) for i in range(400)]
    docs = spark.createDataFrame(texts, "chunk_id long, tenant_id string, content string, heading string")

    def tables(index):
        lists = index.postings.select("tenant_id", "field", "term", F.explode("list").alias("p")).select("tenant_id", "field", "term", "p.*")
        return [sorted(map(tuple, df.collect())) for df in (lists, index.fields, index.terms.select("tenant_id", "field", "term", "df", "ttf", "best"))]

    want = tables(sparse.write_inverted_index(sparse.keyword_index(docs), str(tmp_path / "counts"), buckets=2, block=8))
    for name, value in (("HELD_WORDS", 300), ("WORDS_PER_TASK", 100)):
        monkeypatch.setattr(sparse, name, value)
    index = sparse.write_inverted_index(sparse.keyword_words(docs.coalesce(1)), str(tmp_path / "words"), buckets=2, block=8)
    assert tables(index) == want
    # a frequent term's blocks lie in several files of its bucket
    files = index.postings.where("term = 'a1' and field = 'content' and tenant_id = 't0'").select(F.input_file_name()).distinct().count()
    assert files > 1
    assert index.postings.agg(F.max(F.size("list"))).first()[0] <= 8


@pytest.mark.parametrize("text", ["", "a", "ab c_d e9 x", "tab\tnew\nline\x0bv\x1cfs-end", "Straße ab é ab\u0301c 中文", "___ 1 22"])
def test_words_of_ascii_are_those_of_the_pattern(text):
    from loomery.operators import embedding

    assert embedding.words_of(text) == embedding._WORD.findall(text)


def test_second_hop_is_cut_and_whole(spark):
    rnd = random.Random(11)
    names = [f"E{i}" for i in range(60)]
    chunks = {c: set(rnd.choices(names, [1 / (j + 1) for j in range(60)], k=rnd.randint(1, 9))) for c in range(400)}
    m = spark.createDataFrame([(c, e) for c, es in chunks.items() for e in es], "chunk_id long, entity_id string")
    asked = {1: {"E0"}, 2: {"E59"}, 3: {"E40", "E50"}, 4: {"E5", "E6", "E7"}}
    seeds = spark.createDataFrame([(q, e) for q, es in asked.items() for e in es], "query_id long, entity_id string")
    for k in (3, 20, 500):
        got = {}
        for r in graph.multi_hop(seeds, graph.neighbours(seeds, m), m, k).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["chunk_id"], r["graph_score"]))
        for q, es in asked.items():
            linked = set().union(*[x for x in chunks.values() if x & es]) - es
            scored = {c: round((1.0 if x & es else 0.5) + 0.1 * len(x & linked), 6) for c, x in chunks.items() if x & (es | linked)}
            best = sorted((-s, c) for c, s in scored.items())[:k]
            assert sorted(got.get(q, [])) == [(n, c, -s) for n, (s, c) in enumerate(best, 1)]


def edit(a, b):
    d = np.arange(len(b) + 1)
    for i, x in enumerate(a, 1):
        prev, d[0] = d.copy(), i
        for j, y in enumerate(b, 1):
            d[j] = min(prev[j] + 1, d[j - 1] + 1, prev[j - 1] + (x != y))
    return int(d[-1])


def test_fuzzy_finds_all(spark):
    rnd = random.Random(3)
    words = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 9))) for _ in range(500)} | {"äöü", "äöüa", "a" * 60, "a" * 59 + "b"})
    asked = words[::5] + ["äöb", "a" * 58 + "cb"]
    v = spark.createDataFrame([("t", w, 1) for w in words], "tenant_id string, term string, df int")
    q = spark.createDataFrame([("t", w) for w in asked], "tenant_id string, term string")
    got = {(r["term"], r["expansion"], r["distance"]) for r in sparse.fuzzy_expand(q, v, 10**6).collect()}
    want = set()
    for a in asked:
        e = 0 if len(a) <= 2 else 1 if len(a) <= 5 else 2
        want |= {(a, w, edit(a, w)) for w in words if abs(len(a) - len(w)) <= e and edit(a, w) <= e}
    assert got == want


@pytest.mark.parametrize("ttl,block", [(300, 300), (300, 3600), (50, 86400)])
def test_cache_flags(spark, ttl, block):
    rnd = random.Random(ttl + block)
    base = 1_704_067_200
    events = [("hot" if rnd.random() < 0.6 else rnd.choice("abc"), i, base + rnd.randint(0, 40_000)) for i in range(3000)]
    df = spark.createDataFrame(events, "key string, id int, s long").select("key", "id", F.timestamp_seconds("s").alias("ts"))
    stored, want = {}, {}
    for key, i, t in sorted(events, key=lambda e: (e[2], e[1])):
        want[i] = key in stored and t - stored[key] < ttl
        if not want[i]:
            stored[key] = t
    got = {r["id"]: r["is_hit"] for r in metrics.cache_flags(df, "key", "id", ttl, block_seconds=block).collect()}
    assert got == want


def test_sessions_match_session_window(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    want = ev.groupBy(F.session_window("ts", "3600 seconds").alias("w"), "user_id").agg(F.count("*").alias("events"))
    assert rows(metrics.sessions(ev, "user_id")) == rows(want.select("user_id", "w.start", "w.end", "events"))


def test_chunks_do_not_depend_on_partitions(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    cols = ["chunk_id", "content_hash", "token_count"]
    a = rows(chunk_text(d.repartition(1), separator="\n").select(*cols))
    assert a == rows(chunk_text(d.repartition(13), separator="\n").select(*cols))


def test_dedup_keeps_one_of_a_large_group(spark):
    c = spark.range(5000).select(F.lit("t").alias("tenant_id"), F.format_string("%05d", "id").alias("chunk_id"),
                                 F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("content_hash"))
    out = dedup_chunks(c)
    assert out.count() == 5000 - len(range(0, 5000, 3)) + 1
    assert out.where("content_hash = 'same'").first()["chunk_id"] == "00000"


def test_graph_scores(spark):
    m = spark.createDataFrame(
        [("c1", "A"), ("c1", "X"), ("c1", "Y"), ("c2", "X"), ("c3", "Z")], "chunk_id string, entity_id string"
    )
    seeds = spark.createDataFrame([(1, "A")], "query_id int, entity_id string")
    got = {r["chunk_id"]: r["graph_score"] for r in graph.multi_hop(seeds, graph.neighbours(seeds, m), m).collect()}
    assert got == {"c1": 1.2, "c2": 0.6}


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "id int, v int, x string")
    new = spark.createDataFrame([(2, 2, "c"), (3, 1, "d")], "id int, v int, x string")
    once = st.upsert(old, new, ["id"], "v")
    assert rows(once) == [(1, 1, "a"), (2, 2, "c"), (3, 1, "d")]
    assert rows(st.upsert(once, new, ["id"], "v")) == rows(once)


def test_delete_without_condition_is_a_no_op(spark):
    df = spark.createDataFrame([("t", 1), ("u", 2)], "tenant_id string, document_id int")
    assert rows(st.delete_where(df)) == rows(df)
    gone = spark.createDataFrame([(1,), (2,)], "document_id int")
    assert rows(st.delete_where(df, document_ids=gone, tenant="t").select("tenant_id", "document_id")) == [("u", 2)]


def test_ingest_stream_resumes(spark):
    root = scratch_dir(spark, "resume")
    d = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("document_id"), F.col("source").alias("tenant_id"), "text")
    cut = d.selectExpr("max(document_id) / 2 as m").first()["m"]

    def prepare(b):
        return chunk_text(b, separator="\n", document_id="document_id")

    for part in (d.where(F.col("document_id") <= cut), d.where(F.col("document_id") > cut)):
        part.write.mode("append").parquet(f"{root}/in")
        jobs.ingest_stream(jobs.read_stream(spark, f"{root}/in"), f"{root}/out", f"{root}/cp", prepare)
    got = rows(jobs.latest_groups(spark, f"{root}/out", "document_id").select("chunk_id", "content_hash"))
    assert got == rows(prepare(d).select("chunk_id", "content_hash"))


def test_status_stream_ignores_late_updates(spark):
    root = scratch_dir(spark, "late")
    first = [(1, 20, 2, "completed", ""), (2, 5, 3, "pending", "")]
    late = [(1, 10, 1, "processing", ""), (2, 9, 4, "failed", "boom")]
    for part in (first, late):
        df = spark.createDataFrame(part, "document_id int, s long, event_id int, status string, error string")
        df.select("document_id", F.timestamp_seconds("s").alias("ts"), "event_id", "status", "error").coalesce(1).write.mode("append").parquet(f"{root}/in")
        jobs.run_available(jobs.document_status(jobs.read_stream(spark, f"{root}/in")), f"{root}/out", f"{root}/cp", "update")
    got = {r["document_id"]: (r["status"], r["error"]) for r in jobs.latest_rows(spark, f"{root}/out", ["document_id"]).collect()}
    assert got == {1: ("completed", ""), 2: ("failed", "boom")}


def test_a_search_in_blocks_of_queries_and_documents_is_whole(spark, tmp_path, monkeypatch):
    rnd = random.Random(13)
    texts = [(f"c{i}", " ".join(rnd.choices(["a1", "b2", "c3", "d4", f"r{i % 7}"], [9, 5, 3, 2, 1], k=9)), rnd.choice(["a1", "x y", "r3 d4"])) for i in range(200)]
    docs = spark.createDataFrame(texts, "chunk_id string, content string, heading string")
    index = sparse.write_inverted_index(sparse.keyword_index(docs, tenant=None), str(tmp_path / "index"), buckets=4, block=8)
    asked = sparse.query_terms(spark.createDataFrame([(q, f"r{q % 7} a1 d4") for q in range(12)], "query_id int, query string"))
    whole = sorted(map(tuple, sparse.bm25_topk(asked, index, k=5).collect()))
    assert len(whole) == 60
    for name, value in (("MAX_SHIPPED_WEIGHTS", 10), ("MAX_SHIPPED_TERMS", 1), ("CELLS", 7), ("STEP", 3)):
        monkeypatch.setattr(sparse, name, value)
    plan = sparse.bm25_topk(asked, index, k=5)
    assert sorted(map(tuple, plan.collect())) == whole
    # queries meet documents inside a task: behind the shuffle by document nothing is joined
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in text and "Join" not in text.split("MapInArrow")[0]


def test_forms_are_made_row_by_row(spark):
    got = sparse.with_forms(spark.createDataFrame([("abca",), ("x",)], "w string"), "w", 2).groupBy("w").agg(F.collect_set("form").alias("f")).collect()
    want = {"abca": {"abca", "bca", "aca", "aba", "abc", "ca", "ba", "bc", "aa", "ac", "ab"}, "x": {"x", ""}}
    for r in got:
        hashes = spark.createDataFrame([(t,) for t in want[r["w"]]], "t string").select(F.xxhash64("t").alias("h")).collect()
        assert set(r["f"]) == {h["h"] for h in hashes}


@pytest.mark.parametrize("value", ["Straße abc ab", "日本語 ÿĀ ab\x85\x7f\tx", "plain words 12 a1", "", "é", "中\r\n文 \U0001f600 ok"])
def test_cheaper_patterns_say_the_same(spark, value):
    from loomery.functions import text as tx

    plain = F.regexp_replace("x", r"[^\x20-\x7E\n\r一-鿿]+", "")
    narrow = F.length(F.regexp_replace("x", r"[^\x00-\xff]+", ""))
    count = F.length("x") + F.regexp_count("x", F.lit(r"(?U)\b[a-zA-Z]+\b")) - F.floor((narrow * 3 + 3) / 4)
    got = spark.createDataFrame([(value,)], "x string").select(tx.strip_charset(F.col("x")) == plain, tx.estimate_tokens(F.col("x")) == count).first()
    assert tuple(got) == (True, True)


def test_an_index_and_its_search_leave_no_shuffles_and_no_steps_on_disk(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(f"c{i}", f"t{i % 3}", f"a1 b{i % 9} r{i}") for i in range(300)], "chunk_id string, tenant_id string, content string")
    cleaned, folders = [], []
    conf, scratch, writer = spark.conf, sparse.scratch_dir, type(docs.write)
    old = writer.parquet
    monkeypatch.setattr(sparse, "PASS_WORDS", 100)
    monkeypatch.setattr(sparse, "scratch_dir", lambda s, name: folders.append(str(tmp_path / name)) or folders[-1])
    monkeypatch.setattr(writer, "parquet", lambda w, path, *a, **k: cleaned.append((path, conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false"))) or old(w, path, *a, **k))
    index = sparse.write_inverted_index(sparse.keyword_words(docs, heading=None), str(tmp_path / "index"), buckets=8, block=8)
    assert scratch is not sparse.scratch_dir and len(folders) == 2
    assert not [f for f in folders if (tmp_path / f).exists()]
    # postings move in several passes, and what each of them shuffled goes with it
    assert len([p for p, _ in cleaned if p.endswith("/postings")]) == sparse.PASSES
    assert {c for _, c in cleaned} == {"true"}
    assert index.postings.select(F.explode("list")).count() == 900
    monkeypatch.setattr(sparse, "MAX_SHIPPED_WEIGHTS", 12)
    asked = sparse.query_terms(spark.createDataFrame([(q, f"a1 b{q} r{q}", "t0") for q in range(12)], "query_id int, query string, tenant_id string"), tenant="tenant_id")
    cleaned.clear()
    sparse.bm25_topk(asked, index, k=3)
    assert len([p for p, _ in cleaned if "block-hits" in p]) >= 1 and {c for _, c in cleaned} == {"true"}


def test_ingest_leaves_only_the_stores(spark, tmp_path, monkeypatch):
    from loomery.operators.embedding import HashedTermEncoder
    from loomery.sources import stores

    docs = spark.createDataFrame([(f"t{i % 2}", i, f"Some words of text {i}.\nAnd more.") for i in range(8)], "tenant_id string, document_id long, text string")
    monkeypatch.setattr(stores, "scratch_dir", lambda s, name: str(tmp_path / name))
    tables = stores.open_stores(docs, str(tmp_path / "stores"), HashedTermEncoder(8), buckets=1)
    stores.ingest_batch(tables, docs, HashedTermEncoder(8), 0)
    assert {name: t.rows().count() for name, t in tables.items()} == {"vectors": 8, "keywords": 8, "chunks": 8, "mentions": tables["mentions"].rows().count()}
    assert not (tmp_path / "chunks").exists()
