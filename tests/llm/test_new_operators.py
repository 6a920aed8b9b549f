"""Whitening, token counts and importance resampling against brute force and odd input."""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import pytest

import public_tokenizers
from loomery.llm import importance_resampling, queries, token_counts, whitening  # noqa: F401
from loomery.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"
PIECES = public_tokenizers.path("piece_bpe_32k.model")


# --- whitening --------------------------------------------------------------


@pytest.mark.parametrize("kind", ["full", "graded", "two clusters", "diagonal", "low rank", "identity", "zero"])
@pytest.mark.parametrize("dims", [1, 2, 3, 17, 64])
def test_eigenvectors_of_hard_spectra(kind, dims):
    rng = np.random.default_rng(dims)
    q = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
    values = {
        "full": rng.random(dims) * 5,
        "graded": 10.0 ** -(np.arange(dims) / 4),
        "two clusters": np.repeat([5.0, 1.0], [dims // 2, dims - dims // 2]),
        "diagonal": rng.random(dims),
        "low rank": np.where(np.arange(dims) < max(1, dims // 3), 2.0 + np.arange(dims), 0.0),
        "identity": np.ones(dims),
        "zero": np.zeros(dims),
    }[kind]
    v = np.diag(values) if kind == "diagonal" else (q * values) @ q.T
    v = (v + v.T) / 2
    e, u = whitening.eigenvectors(v, 16)
    scale = max(values.max(), 1e-300)
    assert np.allclose(e, np.sort(values)[::-1][:16], atol=1e-13 * scale, rtol=0)
    assert np.allclose(u.T @ u, np.eye(u.shape[1]), atol=1e-13)
    assert np.abs(v @ u - u * e).max() <= 1e-13 * scale


def test_polar_factor_is_the_matrix_sign():
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.standard_normal((30, 30)))[0]
    values = np.concatenate([np.geomspace(1e-9, 3, 15), -np.geomspace(1e-12, 7, 15)])
    u = whitening.polar((q * values) @ q.T)
    assert np.allclose(u, (q * np.sign(values)) @ q.T, atol=1e-4)
    assert np.allclose(u @ u, np.eye(30), atol=1e-12)


def whitened_by_brute_force(vectors, components):
    kept = [v for v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in kept], np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), [int(t) for t in fit.sum(0)]
    centred = fit - fit.mean(0)
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    deviation = [sum((n * int(a) - b) ** 2 for a, b in zip(row, s)) for row in x]
    return n, deviation, np.abs((x - fit.mean(0)) @ u / np.sqrt(e)), e / np.trace(v)


def test_whitening_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = (rng.standard_normal((300, 20)) @ rng.standard_normal((20, 20))).tolist()
    vectors = base + base[:100] + [base[7]] * 200 + [None, [], [1.0] * 3, [float("nan")] * 20, [float("inf")] + [0.0] * 19, [None] + [0.0] * 19, [1e30] * 20]
    rows = [(i, v, "c", "d") for i, v in enumerate(vectors)] + [(None, base[0], None, None), (0, base[0], None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string, whitened string")
    got = whitening.whiten(df, components=5).collect()
    n, deviation, whitened, explained = whitened_by_brute_force([r[1] for r in rows[:600]], 5)
    assert n == 300 and len(got) == (600 + 2) * 5 and {r["n"] for r in got} == {n}
    assert max(r["identity_error"] for r in got) < 1e-9
    once = {(r["vec_id"], r["component"]): r for r in got}
    for i in range(600):
        for c in range(5):
            r = once[(i, c + 1)]
            assert r["deviation"] == deviation[i]
            assert abs(abs(r["whitened"]) - whitened[i][c]) < 1e-9 and abs(r["explained"] - explained[c]) < 1e-12


def test_whitening_without_variance_and_without_rows(spark):
    schema = "vec_id long, embedding array<float>"
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema), components=16).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in flat] == [(1, 1, 0, None, 0.0, 0.0), (2, 1, 0, None, 0.0, 0.0)] * 2
    line = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], schema), components=16).collect()
    assert sorted((r["vec_id"], r["component"], r["whitened"] is None) for r in line) == [(1, 1, False), (1, 2, True), (2, 1, False), (2, 2, True)]
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [float("nan")])], schema)).collect() == []


def test_deviation_beyond_a_long_is_null():
    x = np.array([[1 << 41, 0], [5, 0]])
    centre = whitening.Centre(1 << 30, [0, 0])
    assert centre.deviation(x).to_pylist() == [None, 25 << 60] if 25 << 60 < 1 << 63 else [None, None]
    assert whitening.Centre(3, [10, 2]).deviation(np.array([[4, 1]])).to_pylist() == [5]


def test_whitening_query(spark):
    got = QUERIES["op11_whitening_qdwh"](spark, SF).collect()
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    n, deviation, whitened, explained = whitened_by_brute_force([r["embedding"] for r in rows], 16)
    place = {r["vec_id"]: i for i, r in enumerate(rows)}
    assert len(got) == 16 * len(rows)
    for r in got:
        i, c = place[r["vec_id"]], r["component"] - 1
        assert (r["n"], r["deviation"]) == (n, deviation[i])
        assert abs(abs(r["whitened"]) - whitened[i][c]) < 1e-6 and abs(r["explained"] / explained[c] - 1) < 1e-9 and r["identity_error"] < 1e-9


# --- token counts -----------------------------------------------------------


def plain_counts(texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    return [len(library.encode(t)) if t else 0 for t in texts]


def odd_texts():
    import random

    rng = random.Random(7)
    texts = [None, "", " ", "a  b", " \t\n", "x" * 5000, " " * 3000, "ab" * 3000, "\x00a\x00", "日本 𝄞é", "<s> </s> <unk> <0x0A>", "=" * 777 + "-" * 500, "▁x ▁", "é́ ﬁ Ａ"]
    for alphabet in ["abc de", "   a", "0123456789abcdef", "日本語テスト ", "=-_*#", "aAeEiItThHsS ", "éüßñ ", "ha", "thaner "] * 40:
        texts.append("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 900))))
    return texts


@pytest.mark.parametrize("part", [1 << 20, 300])
def test_token_counts_equal_the_library(part):
    texts = odd_texts()
    assert token_counts.count_tokens(token_counts.vocabulary(PIECES), texts, part).tolist() == plain_counts(texts)


def test_heap_and_arrays_agree(monkeypatch):
    texts = odd_texts()[:120]
    want = plain_counts(texts)
    for long in (2, 10_000):
        monkeypatch.setattr(token_counts, "LONG", long)
        assert token_counts.count_tokens(token_counts.vocabulary(PIECES), texts).tolist() == want


def test_token_count_query_and_odd_rows(spark):
    got = {r["doc_id"]: r for r in QUERIES["op12_token_counts_rank_synchronous"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    for r, n in zip(rows, plain_counts([r["text"] for r in rows])):
        assert (got[r["doc_id"]]["n_bytes"], got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["over_limit"]) == (len((r["text"] or "").encode()), n, n > 4096)
    texts = [*odd_texts()[:20], "word " * 100_000]
    df = spark.createDataFrame([(None if i == 3 else i // 2, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string, over_limit int")
    out = token_counts.with_token_counts(df, PIECES, 4096)
    assert out.columns == ["doc_id", "text", "n_tokens", "over_limit", "tokens"]
    want = sorted((t or "", n) for t, n in zip(texts, plain_counts(texts)))
    assert sorted((r["text"] or "", r["tokens"]["n_tokens"]) for r in out.collect()) == want
    assert token_counts.with_token_counts(df.limit(0), PIECES, 4096).collect() == []


# --- importance resampling --------------------------------------------------


def lowered_words(text):
    small = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", small)


def features(text, runs):
    w = lowered_words(text)
    return [" ".join(w[i : i + n]) for n in range(1, runs + 1) for i in range(len(w) - n + 1)]


def drawn_by_brute_force(docs, target, runs, buckets, seed, least, percent):
    def counts(texts):
        out = [0] * buckets
        for t in texts:
            for f in features(t, runs):
                out[zlib.crc32(f.encode()) % buckets] += 1
        return out

    s, t = counts(x for _, x in docs), counts(target)
    big_s, big_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((b + 1) * (big_s + buckets) / ((a + 1) * (big_t + buckets)))) for a, b in zip(s, t)]
    out = {}
    for doc_id, text in docs:
        own = features(text, runs)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in own)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out[doc_id] = [len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    able = sorted((i for i, x in docs if len(lowered_words(x)) >= least), key=lambda i: (-out[i][2], i is None, i))
    for rank, i in enumerate(able[: percent * len(able) // 100], 1):
        out[i][3] = rank
    return out


def test_composed_crcs():
    rng = np.random.default_rng(2)
    parts = [(rng.bytes(int(a)), rng.bytes(int(b))) for a, b in rng.integers(0, 300, (200, 2))]
    left, right = (np.array([zlib.crc32(p[i]) for p in parts], np.uint32) for i in (0, 1))
    got = importance_resampling.compose(left, right, np.array([len(p[1]) for p in parts]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in parts]


@pytest.mark.parametrize("runs", [1, 2, 3])
def test_resampling_against_brute_force(spark, runs):
    rng = np.random.default_rng(runs)
    docs = [(i, " ".join(rng.choice(["Äpfel", "a", "B", "c1", "x-y", "zz", "é"], rng.integers(0, 60)))) for i in range(200)]
    docs += [(200, None), (201, ""), (202, "?!"), (203, "one" + " two,Three" * 40), (None, "a b " * 30)]
    target = ["zz c1 zz", "a é", None, "other words"]
    df = spark.createDataFrame([(i, t, "r", 1) for i, t in docs], "doc_id long, text string, rank string, score int")
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance_resampling.resample(df, goal, runs=runs, buckets=50, seed=9, least_words=10, percent=30).collect()
    want = drawn_by_brute_force(docs, target, runs, 50, 9, 10, 30)
    assert {r["doc_id"]: [r["n_features"], r["weight"], r["score"], r["rank"]] for r in got} == want


def test_texts_in_parts_have_the_same_features():
    text = ("Some words, über " * 30 + "x" * 200 + " end").encode()
    for runs in (1, 3):
        whole = sorted(b for w in importance_resampling.scan([text, None, b"a b c"], runs, 997) for b in w[0].tolist())
        parts = sorted(b for w in importance_resampling.scan([text, None, b"a b c"], runs, 997, limit=40) for b in w[0].tolist())
        assert whole == parts == sorted(zlib.crc32(f.encode()) % 997 for t in (text.decode(), "a b c") for f in features(t, runs))


def test_ranks_of_ties_and_repeated_rows(spark):
    rows = [(i % 50, "same words " * 20) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = importance_resampling.resample(df, df.select("text"), percent=50).collect()
    ranked = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, 201))
    assert [(r["score"], r["doc_id"]) for r in ranked] == sorted(((r["score"], r["doc_id"]) for r in got), key=lambda x: (-x[0], x[1]))[:200]


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string")
    assert importance_resampling.resample(none, one).collect() == []
    assert [(r["n_features"], r["rank"]) for r in importance_resampling.resample(one, none, percent=100).collect()] == [(30, 1)]


def test_first_weights_are_fitted_on_all_training_words(spark, monkeypatch):
    from loomery.llm import lm_scoring

    rng = np.random.default_rng(4)
    parts = ["an", "der", "ti", "on", "sche", "re", "ig", "lo", "ma"]
    texts = [(i, " ".join("".join(rng.choice(parts, rng.integers(1, 5))) for _ in range(60))) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)

    def fitted(drawn):
        for name in ("TRAIN_WORDS", "START_WORDS"):  # drawn words, whatever their number, don't decide
            monkeypatch.setattr(lm_scoring, name, drawn, raising=False)
        monkeypatch.setattr(lm_scoring, "SETTLED", 1e-7, raising=False)
        model, vocabulary, totals = lm_scoring.train(docs)
        return lm_scoring.score(docs, model, vocabulary, totals).groupBy().sum("score").first()[0]

    assert abs(fitted(20) / fitted(10**9) - 1) < 1e-3


def test_a_shard_scores_many_queries_by_few_products(monkeypatch):
    from loomery.llm import topk_search

    rng = np.random.default_rng(8)
    n, ids = 500, rng.permutation(500) * 3
    size = np.array([400, 250, 90, 20, 7, 1, 3, 60])
    texts = np.concatenate([np.sort(rng.choice(n, s, replace=False)) for s in size])
    impacts = rng.exponential(1.0, len(texts)).round(1)  # ties
    first = np.cumsum(size) - size
    whole = np.zeros((len(size), n))
    for t, (f, s) in enumerate(zip(first, size)):
        whole[t, texts[f : f + s]] = impacts[f : f + s]
    asked = [np.sort(rng.choice(len(size), rng.integers(0, 6), replace=False)) for _ in range(40)] + [np.arange(8)]
    query, term = np.repeat(np.arange(41), [len(a) for a in asked]), np.concatenate(asked)
    times = rng.integers(1, 4, len(term)).astype(float)
    want = []
    for q in range(41):
        scores = np.round(times[query == q] @ whole[term[query == q]], 6)
        want += sorted((q, -s, int(i)) for s, i in zip(scores, ids) if s > 0)[:5]
    products = []
    score = topk_search.Shard._score
    monkeypatch.setattr(topk_search.Shard, "_score", lambda shard, *a: products.append(a[0].shape) or score(shard, *a))
    for cells, step, least in ((1 << 20, 1 << 20, 2), (1 << 20, 1 << 20, 32), (3000, 1 << 20, 8), (1 << 20, 50, 10**9)):
        for name, value in (("CELLS", cells), ("STEP", step), ("SPARSE", least)):
            monkeypatch.setattr(topk_search, name, value)
        products.clear()
        got = topk_search.Shard(size, texts, impacts, ids, 64).best(query, term, times, 5)
        assert [(int(q), round(-s, 6), int(i)) for q, i, s in zip(*got)] == [(q, round(s, 6), i) for q, s, i in want]
        assert len(products) < 41 or step == 50
