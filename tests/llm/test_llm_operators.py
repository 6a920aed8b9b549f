"""The training-data operators against brute force, round trips and held-out accuracy,
and with odd input: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import itertools
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from loomery.llm import (
    decontamination,
    language_id,
    lm_scoring,
    minhash_dedup,
    packing,
    quality,
    substring_dedup,
    topk_search,
    toxicity,
    warc_fixity,
)
from loomery.llm.common import chain_hash, fold, word_hashes
from loomery.llm import queries  # noqa: F401
from loomery.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, cut string, hits string, label int, score string, starts int"


def table(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def odd(spark):
    """Odd texts, with extra columns named like the operators' own."""
    phrase = " ".join(f"w{i}" for i in range(20))
    texts = [None, "", " \t\n", "12 %% --", "one", phrase, phrase, phrase + " more", "Ünïcode ß " * 5, "x" * 50_000, "ha " * 9_000, "a b c. d e f!"]
    rows = [(i, t, "en" if i % 2 else None, None, None, "c", "h", 1, "s", 3) for i, t in enumerate(texts)]
    rows += [(5, phrase, "en", "s", 1, None, None, None, None, None), (None, phrase, "en", "s", 1, None, None, None, None, None)]
    return table(spark, rows, COLUMNS)


def empty(spark):
    return table(spark, [], COLUMNS)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_word_hashes_tell_words_apart():
    texts = ["a b\tb  aa".encode(), None, b"", b"\x0b", "é x \x1c".encode()]
    hashes, counts = word_hashes(texts)
    assert counts.tolist() == [4, 0, 0, 0, 2]
    words = [w for t in texts if t for w in t.split()]
    assert len(words) == len(hashes)
    for (x, a), (y, b) in itertools.combinations(zip(words, hashes), 2):
        assert (x == y) == (a == b)


# --- language identification ----------------------------------------------------


def test_codebook_separates_all_pairs():
    for n in (2, 3, 4, 7, 8, 20):
        code = language_id.codebook(n)
        assert min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= 1
        assert all(0 < c < n for c in code.sum(0)) or n == 1


def test_language_held_out(spark, documents):
    docs = documents.where("lang is not null")
    model = language_id.train(docs.where(fold("doc_id", 4) != 2))
    got = language_id.identify(docs.where(fold("doc_id", 4) == 2), model).select((F.col("lang") == F.col("language.lang")).cast("int").alias("ok"))
    assert got.agg(F.avg("ok")).first()[0] > 0.95


def test_language_odd_input(spark, documents):
    model = language_id.train(documents)
    got = {r["doc_id"]: r for r in language_id.identify(odd(spark), model).collect()}
    for i in (0, 1, 2, 3):
        assert (got[i]["language"]["lang"], got[i]["language"]["score"]) == ("und", 0.0)
    assert got[4]["language"]["lang"] in model.languages and 0 <= got[4]["language"]["score"] <= 1
    assert got[5]["cut"] is None or got[5]["cut"] == "c"
    assert language_id.identify(empty(spark), model).count() == 0
    none = language_id.train(empty(spark))
    assert {r["language"]["lang"] for r in language_id.identify(odd(spark), none).collect()} == {"und"}
    one = language_id.train(table(spark, [(1, "abc", "xx")], "doc_id long, text string, lang string"))
    assert language_id.identify(table(spark, [(1, "zzz")]), one).first()["language"]["lang"] == "xx"


# --- top-k search -----------------------------------------------------------------


def brute_bm25(docs, queries, k):
    bags = {i: decontamination.plain(t.encode()).split() if t else [] for i, t in docs}
    n, mean = len(bags), sum(map(len, bags.values())) / max(len(bags), 1)
    out = {}
    for q, text in queries:
        scores = {}
        for w in decontamination.plain(text.encode()).split():
            df = sum(w in b for b in bags.values())
            for i, b in bags.items():
                tf = b.count(w)
                if tf:
                    scores[i] = scores.get(i, 0) + np.log1p((n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(b) / mean))
        out[q] = sorted(((round(s, 6), i) for i, s in scores.items()), key=lambda x: (-x[0], x[1]))[:k]
    return out


@pytest.mark.parametrize("shard_bytes,block", [(1 << 24, 64), (600, 4)])
def test_search_is_exact(spark, monkeypatch, shard_bytes, block):
    rng = np.random.default_rng(1)
    docs = [(i, " ".join(f"t{min(int(x), 60)}" for x in rng.zipf(1.3, rng.integers(0, 40)))) for i in range(150)] + [(900, None), (901, "")]
    asked = [(q, " ".join(f"t{min(int(x), 70)}" for x in rng.zipf(1.2, 6))) for q in range(12)] + [(50, ""), (51, "unheard")]
    monkeypatch.setattr(topk_search, "BLOCK_TEXTS", block)
    monkeypatch.setattr(topk_search, "SHARD_BYTES", shard_bytes)
    for k in (1, 5):
        got = topk_search.search(topk_search.build_index(table(spark, docs)), table(spark, asked, "query_id long, query string"), k).collect()
        want = brute_bm25(docs, asked, k)
        for q, _ in asked:
            mine = sorted((r["rank"], r["score"], r["doc_id"]) for r in got if r["query_id"] == q)
            assert [x[2] for x in mine] == [i for _, i in want[q]]
            assert np.allclose([x[1] for x in mine], [s for s, _ in want[q]], atol=2e-6)


def test_search_blocks_are_skipped_without_loss():
    rng = np.random.default_rng(2)
    n, ids = 2_000, np.arange(2_000)
    terms, exact = [], np.zeros(n)
    for _ in range(6):
        texts = np.sort(rng.choice(n, 300, replace=False))
        impacts = rng.exponential(1.0, 300)
        most = np.zeros(-(-n // topk_search.BLOCK_TEXTS))
        np.maximum.at(most, texts // topk_search.BLOCK_TEXTS, impacts)
        terms.append((texts, impacts, most))
        exact[texts] += impacts
    want = sorted(((float(s), int(i)) for i, s in enumerate(np.round(exact, 6)) if s > 0), key=lambda x: (-x[0], x[1]))[:7]
    assert topk_search.best_texts(terms, ids, 7) == want


def test_search_odd_input(spark):
    index = topk_search.build_index(odd(spark))
    got = topk_search.search(index, table(spark, [(1, "w3"), (2, None)], "query_id long, query string"), 10).collect()
    assert {r["doc_id"] for r in got} == {5, 6, 7} and len(got) == 4
    assert topk_search.search(topk_search.build_index(empty(spark)), table(spark, [(1, "a")], "query_id long, query string")).count() == 0


# --- decontamination ---------------------------------------------------------------


def slow_align(item, text):
    h = np.zeros((len(item) + 1, len(text) + 1), int)
    for i in range(1, len(item) + 1):
        for j in range(1, len(text) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if item[i - 1] == text[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


def test_a_search_ends_each_block_of_queries_before_the_next(spark, monkeypatch):
    rnd = np.random.default_rng(3)
    docs = [(i, " ".join(f"w{j}" for j in rnd.integers(0, 30, 12))) for i in range(120)]
    index = topk_search.build_index(table(spark, docs))
    asked = table(spark, docs[::3], "query_id long, query string")
    want = sorted(map(tuple, topk_search.search(index, asked, 5).collect()))
    monkeypatch.setattr(topk_search, "QUERY_BYTES", 700)  # several blocks
    found = topk_search.search(index, asked, 5)
    assert sorted(map(tuple, found.collect())) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "InArrow" not in plan  # no block's search is left to a common plan


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(3)
    for _ in range(60):
        item, text = rng.integers(0, 6, rng.integers(1, 15)), rng.integers(0, 6, rng.integers(1, 30))
        score, a, b = decontamination.align(item, text)
        assert score == slow_align(item, text)
        if score:
            assert slow_align(item, text[a:b]) == score


def test_edited_copies_are_found(spark):
    rng = np.random.default_rng(4)
    items = [(i, " ".join(f"i{i}x{j}" if j % 3 else "the" for j in range(30))) for i in range(6)]
    noise = lambda n: " ".join(f"n{rng.integers(0, 500)}" if rng.random() > 0.3 else "the" for _ in range(n))
    words = items[0][1].split()
    edited = [w for j, w in enumerate(words) if j % 9 != 4]
    edited[10] = "swapped"
    docs = [(0, noise(80)), (1, f"{noise(30)} {' '.join(edited)} {noise(9)}"), (2, f"{noise(5)} {items[3][1].upper()}!"), (3, items[5][1][:40]), (4, None)]
    docs += [(10 + i, f"{noise(20)} {items[4][1]}") for i in range(30)]  # an item that leaked everywhere
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.leaks(table(spark, docs), table(spark, items, "item_id long, text string")).collect()}
    assert set(got) == {(1, 0), (2, 3)} | {(10 + i, 4) for i in range(30)}
    assert got[(2, 3)]["similarity"] == 1.0 and (got[(2, 3)]["start_word"], got[(2, 3)]["end_word"]) == (5, 35)
    many = decontamination.leaks(table(spark, docs), table(spark, items, "item_id long, text string"))
    assert many.count() == len(got)


def test_every_alignment_above_the_threshold_is_found(spark):
    """Copies with every 4th and 5th word replaced, others added or dropped, against all pairs."""
    rng = np.random.default_rng(5)
    items = [(i, " ".join(f"i{i}x{j}" if rng.random() > 0.3 else "the" for j in range(n))) for i, n in enumerate((3, 4, 5, 6, 9, 12, 20, 20, 30, 59))]
    docs = []
    for _, text in items:
        words = text.split()
        copies = [[w if j % step != step - 1 else f"e{j}" for j, w in enumerate(words)] for step in (3, 4, 5)]
        copies += [[x for j, w in enumerate(words) for x in ([w] if j % step else [f"a{j}", w])] for step in (1, 2, 3)]
        copies += [[w for j, w in enumerate(words) if j % step] for step in (3, 4, 5)]
        copies += [["the" if rng.random() < 0.2 else w for w in words] for _ in range(3)]
        docs += [" ".join(["the", "n1", *c, "n2", "the"]) for c in copies]
    docs = list(enumerate([*docs, *docs[:20], items[7][1]]))  # whole copies elsewhere don't hide edited ones
    want = {}
    for i, text in items:
        for d, other in docs:
            names = {w: n for n, w in enumerate(sorted({*text.split(), *other.split()}))}
            share = slow_align([names[w] for w in text.split()], [names[w] for w in other.split()]) / (2 * len(text.split()))
            if share >= decontamination.LEAST:
                want[d, i] = share
    assert sum(0.6 <= s < 0.75 for s in want.values()) > 20
    got = decontamination.leaks(table(spark, docs), table(spark, items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): r["similarity"] for r in got if r["similarity"] >= decontamination.LEAST} == want


def slow_passage(item, text, shortest=13):
    """The greatest 5 * score - 6 * words of alignments of ``shortest`` consecutive item words or more."""
    most = -(10**9)
    for first in range(len(item) - shortest + 1):
        row = [0] * (len(text) + 1)
        for i in range(first, len(item)):
            new = []
            for j in range(len(text) + 1):
                new.append(max(row[j] - 1, row[j - 1] + (2 if item[i] == text[j - 1] else -1) if j else row[j] - 1, new[-1] - 1 if j else -(10**9)))
            row = new
            if i + 1 - first >= shortest:
                most = max(most, 5 * max(row) - 6 * (i + 1 - first))
    return most


def test_passages_of_long_items_are_found(spark):
    rng = np.random.default_rng(6)
    items = [(i, " ".join(f"i{i}x{j}" if rng.random() > 0.3 else "the" for j in range(n))) for i, n in enumerate((59, 120, 13, 1, 2))]
    docs = [f"n1 {' '.join(text.split()[:35])} n2" for _, text in items]
    for _ in range(30):
        words = items[rng.integers(0, 3)][1].split()
        first, n, rate = rng.integers(0, max(len(words) - 12, 1)), rng.integers(9, 28), rng.random() * 0.4
        docs.append(" ".join(["the", *[x for w in words[first : first + n] for x in ([w], [], ["e"], [w, "the"])[0 if rng.random() > rate else rng.integers(1, 4)]], "n3"]))
    docs = list(enumerate(docs))
    want = {}
    for i, text in items:
        for d, other in docs:
            names = {w: n for n, w in enumerate(sorted({*text.split(), *other.split()}))}
            a, b = [names[w] for w in text.split()], [names[w] for w in other.split()]
            share, over = slow_align(a, b) / (2 * len(a)), slow_passage(a, b)
            if share >= decontamination.LEAST or over >= 0:
                want[d, i] = over if over >= 0 else None
    rows = decontamination.leaks(table(spark, docs), table(spark, items, "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]): None if r["passage"] is None else round((r["passage"] - 0.6) * 10 * r["passage_words"]) for r in rows}
    assert got == want
    assert {(0, 0), (1, 1), (2, 2), (3, 3), (4, 4)} <= set(got) and len(got) < len(docs) + 5
    one = {r["doc_id"]: r for r in rows if r["item_id"] == 1}[1]
    assert (one["passage"], one["passage_words"], one["start_word"], one["end_word"]) == (1.0, 35, 1, 36) and 0.28 < one["similarity"] < 0.31


def all_rare(rare):
    return [np.ones(len(r), bool) for r in rare]


def block_in(items, docs, least=0.6):
    """A block of items whose seeds are rare in the texts, and the texts' word hashes."""
    words = decontamination.item_words([t.encode() for t in items])
    hashes, counts = word_hashes([t.encode() for t in docs])
    there = np.concatenate([chain_hash(hashes, 1), chain_hash(hashes, 2)])
    cost = [np.array([(there == g).sum() for g in grams]) for grams in decontamination.item_grams(words, least)]
    rare = [decontamination.rare_grams(c, len(w), least) for c, w in zip(cost, words)]
    return decontamination.block_of(list(range(len(items))), words, rare, least), hashes, counts


def test_rare_seeds_find_what_all_seeds_find(monkeypatch):
    """Edited stretches of items in few and in many words, also with the items taken in halves."""
    rng = np.random.default_rng(8)
    left_out = leaks = 0
    sizes = [1, 2, 3, 4, 5, 6, 8, 12, 13, 14, 17, 20, 21, 22, 25, 26, 45, 100]
    for _ in range(80):
        vocabulary = int(rng.choice([6, 12, 40, 200]))
        share = 1 / np.arange(1, vocabulary + 1)
        draw = lambda n: rng.choice(vocabulary, n, p=share / share.sum()).tolist()  # noqa: B023, E731
        items = [draw(int(n)) for n in rng.choice(sizes, 4)]
        docs = []
        for _ in range(6):
            item = items[rng.integers(0, 4)]
            first, rate = rng.integers(0, max(1, len(item) - 8)), rng.random() * 0.5
            kept = [([w], draw(1), [], [w, *draw(1)])[0 if rng.random() > rate else rng.integers(1, 4)] for w in item[first : first + rng.integers(4, 50)]]
            docs.append(draw(rng.integers(0, 30)) + sum(kept, []) + draw(rng.integers(0, 60)))
        items, docs = ([" ".join(f"w{w}" for w in x) for x in y] for y in (items, docs))
        block, hashes, counts = block_in(items, docs)
        every = decontamination.block_of(block.ids, block.words, all_rare(block.rare), 0.6)
        want = decontamination._aligned(every, hashes, counts, 0.6)
        assert decontamination._aligned(block, hashes, counts, 0.6) == want
        with monkeypatch.context() as m:
            m.setattr(decontamination, "MOST_PAIRS", 3)
            assert decontamination._aligned(block, hashes, counts, 0.6) == want
        left_out, leaks = left_out + sum((~r).sum() for r in block.rare), leaks + len(want)
    assert left_out > 300 and leaks > 500


def test_a_bigram_that_all_items_share_is_no_seed():
    """What a text is paired with doesn't grow with the items that hold its most frequent bigram."""
    text = " ".join(f"n{j} of the" for j in range(300)) + " " + " ".join(f"i7x{j}" if j != 9 else "of the" for j in range(20))
    found = {}
    for n in (20, 80, 320):
        items = [" ".join(f"i{i}x{j}" if j != 9 else "of the" for j in range(20)) for i in range(n)]
        block, hashes, counts = block_in(items, [text])
        found[n] = len(decontamination._hits(block, hashes, counts).item)
        assert [x[:3] for x in decontamination._aligned(block, hashes, counts, 0.6)] == [(0, 7, 1.0)]
    assert found[20] == found[80] == found[320] < 60


def test_occurrences_are_counted_in_one_pass(spark):
    docs = table(spark, [(1, "of the cat"), (2, "the cat of the cat"), (3, None), (4, "")])
    hashes, _ = word_hashes([b"of the cat dog"])
    grams = np.unique(np.concatenate([chain_hash(hashes, 1), chain_hash(hashes, 2)]))
    got = dict(zip(grams.tolist(), decontamination.occurrences(docs.where("text is not null"), grams).tolist()))
    assert [got[h] for h in chain_hash(hashes, 1).tolist()] == [2, 3, 3, 0]
    assert [got[h] for h in chain_hash(hashes, 2).tolist()] == [2, 3, 0]


def test_item_blocks_lose_nothing(spark, monkeypatch):
    items = [(i, " ".join(f"i{i}x{j}" for j in range(12))) for i in range(20)]
    docs = [(i, t) for i, t in items]
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 50)
    got = decontamination.leaks(table(spark, docs), table(spark, items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(i, i) for i in range(20)}


def test_decontamination_odd_input(spark):
    items = table(spark, [(1, None), (2, ""), (3, "two words"), (4, "w1 w2 w3 w4 w5")], "item_id long, text string")
    got = decontamination.clean(odd(spark), items)
    assert got.columns == odd(spark).columns
    assert {r["doc_id"] for r in odd(spark).collect()} - {r["doc_id"] for r in got.collect()} == {5, 6, 7}
    assert decontamination.clean(empty(spark), items).count() == 0
    assert decontamination.leaks(odd(spark), items.limit(0)).count() == 0


def test_contaminated_rows_without_an_id_go(spark):
    items = table(spark, [(4, "w1 w2 w3 w4 w5"), (5, None)], "item_id long, text string")
    docs = odd(spark)
    stays = lambda r: r["text"] is None or "w1 w2 w3" not in r["text"]
    got = decontamination.clean_rows(docs, items)
    assert got.columns == docs.columns and sorted(map(str, got.collect())) == sorted(str(r) for r in docs.collect() if stays(r))
    assert decontamination.clean_rows(empty(spark), items).count() == 0
    assert decontamination.clean_rows(docs, items.limit(0)).count() == docs.count()


# --- substring dedup -----------------------------------------------------------------


def slow_cut(rows, window):
    first: dict = {}
    out = []
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        words = t.encode().split() if t else []
        gone = [False] * len(words)
        for a in range(len(words) - window + 1):
            if first.setdefault(tuple(words[a : a + window]), i) < i:
                gone[a : a + window] = [True] * window
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("window,shard_words,letters", [(13, 60_000, 40), (7, 60_000, 3), (6, 40, 4)])
def test_cut_matches_brute_force(spark, monkeypatch, window, shard_words, letters):
    rng = np.random.default_rng(window)
    stock = [" ".join(f"{'w' * rng.integers(1, 8)}{rng.integers(0, letters)}" for _ in range(60)) for _ in range(6)]
    rows = []
    for i in range(80):
        parts = []
        for _ in range(rng.integers(0, 5)):
            words = stock[rng.integers(0, 6)].split()
            a = rng.integers(0, 50)
            parts += words[a : a + rng.integers(1, 40)] + [f"own{i}"] * rng.integers(0, 3)
        rows.append((int(i), "  ".join(parts)))
    rows += [(100, rows[3][1]), (101, None), (102, ""), (103, "\n".join([stock[0]] * 3))]
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", shard_words)
    monkeypatch.setattr(substring_dedup, "HOT_SEED", 20_000 if shard_words > 40 else 12)
    got = substring_dedup.cut(table(spark, rows), window).select("doc_id", "cut.n_words", "cut.n_removed", "cut.kept_sha256").collect()
    assert sorted(tuple(r) for r in got) == slow_cut(rows, window)


def test_cut_of_rows_that_share_an_id(spark):
    rng = np.random.default_rng(8)
    passage = " ".join(f"word{i}" for i in range(40))
    own = [" ".join(f"own{rng.integers(0, 10**9)}" for _ in range(300)) for _ in range(3)]
    rows = [(5, "short"), (5, "a b c " + passage), (5, own[0]), (2, own[1]), (9, passage + " end"), (9, own[2] + " " + passage), (9, passage + " end")]
    df = table(spark, rows).select("*", F.lit(1).alias("_id"), F.lit(2).alias("_version"), F.lit(3).alias("_starts"), F.lit(4).alias("cut"))
    cut = substring_dedup.cut(df, 13, out="gone")
    assert cut.columns == [*df.columns, "gone"]
    got = sorted((r["doc_id"], r["text"], r["gone"]["n_words"], r["gone"]["n_removed"], r["_id"] + r["_version"] + r["_starts"] + r["cut"]) for r in cut.collect())
    assert got == sorted((i, t, len(t.split()), 40 if i == 9 else 0, 10) for i, t in rows)


@pytest.mark.parametrize("hot", [20_000, 30])
def test_passages_grow_in_proportion_to_the_copies(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT_SEED", hot)
    rng = np.random.default_rng(9)
    passage = " ".join(f"shared{rng.integers(0, 10**6)}" for _ in range(200))
    kept, stored = substring_dedup.store, {}
    monkeypatch.setattr(substring_dedup, "store", lambda df, name: stored.setdefault(name, kept(df, name)))
    per_document = []
    for n in (25, 100, 400):
        stored.clear()
        rows = [(i, " ".join([*(f"o{rng.integers(0, 10**9)}" for _ in range(30)), passage, *(f"o{rng.integers(0, 10**9)}" for _ in range(30))])) for i in range(n)]
        got = substring_dedup.cut(table(spark, rows), 13).select("doc_id", "cut.n_removed").collect()
        assert sorted(tuple(r) for r in got) == [(i, 200 if i else 0) for i in range(n)]
        per_document.append(stored["passages"].count() / n)
    assert max(per_document) <= (60 if hot > 400 else 220)
    if hot > 400:
        assert max(per_document) <= 1.1 * min(per_document)


def test_stored_tables_leave_no_shuffle_files(tmp_path):
    script = f"""
import sys
from pathlib import Path
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
from loomery.llm.common import store
spark = SparkSession.builder.master("local[2]").config("spark.local.dir", {str(tmp_path)!r}).config("spark.ui.enabled", "false").getOrCreate()
stored = store(spark.range(100000).selectExpr("id % 1000 as k").groupBy("k").count(), "counts")
print(stored.count(), "files:", len(list(Path({str(tmp_path)!r}).rglob("shuffle_0_*"))))
"""
    out = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=120).stdout
    assert out.split() == ["1000", "files:", "0"]


def test_shuffles_end_before_texts_move(spark, monkeypatch):
    kept, stored = substring_dedup.store, {}
    monkeypatch.setattr(substring_dedup, "store", lambda df, name: stored.setdefault(name, kept(df, name)))
    phrase = " ".join(f"word{i}" for i in range(30))
    got = substring_dedup.cut(table(spark, [(1, phrase), (2, "before " + phrase)]), 13).select("doc_id", "cut.n_removed").collect()
    assert sorted(map(tuple, got)) == [(1, 0), (2, 30)]
    assert stored["hits"].count() == 2 and [r["doc_id"] for r in stored["starts"].collect()] == [2]


def test_marks_alone_are_no_letters():
    assert len(language_id.ngram_slots("́́ 12")) == 0 and len(language_id.ngram_slots("é")) > 0


def test_cut_odd_input(spark):
    got = substring_dedup.cut(odd(spark).drop("cut"), 13)
    rows = {(r["doc_id"], r["text"]): r["cut"] for r in got.collect()}
    assert got.count() == odd(spark).count()
    assert rows[(0, None)]["n_words"] == 0 and rows[(1, "")]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert rows[(6, " ".join(f"w{i}" for i in range(20)))]["n_removed"] == 20
    assert [c["n_removed"] for (i, _), c in rows.items() if i in (5, None, 10)] == [0, 0, 0]
    assert substring_dedup.cut(empty(spark).drop("cut")).count() == 0


# --- near duplicates --------------------------------------------------------------------


def slow_components(rows, shingle, percent):
    sets = {}
    for i, t in rows:
        w = t.encode().lower().split() if t else []
        sets[i] = frozenset(tuple(w[a : a + shingle]) for a in range(max(len(w) - shingle + 1, 1))) if w else frozenset()
    label = {i: i for i in sets}
    changed = True
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {i: (len(sets[i]), label[i], label[i] == i) for i in sets}


@pytest.mark.parametrize("shingle,block,size", [(2, 1000, 1 << 20), (5, 1000, 1 << 20), (2, 3, 2000)])
def test_near_duplicates_match_brute_force(spark, monkeypatch, shingle, block, size):
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    monkeypatch.setattr(minhash_dedup, "CELL_BYTES", size)
    rng = np.random.default_rng(shingle)
    rows = []
    for g in range(25):
        base = [f"v{rng.integers(0, 400)}" for _ in range(rng.integers(1, 120))]
        for _ in range(rng.integers(1, 7)):
            words = list(base)
            for _ in range(rng.integers(0, max(len(words) // 10, 1) + 1)):
                words[rng.integers(0, len(words))] = f"e{rng.integers(0, 400)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows), rows[0][1]), (len(rows) + 1, None), (len(rows) + 2, ""), (len(rows) + 3, "Solo"), (len(rows) + 4, "solo")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(table(spark, rows), shingle).collect()}
    assert got == slow_components(rows, shingle, 80)


def test_pruning_keeps_what_may_reach_the_threshold():
    least = minhash_dedup.fewest_matches(0.8, minhash_dedup.MISS)
    assert list(least) == sorted(least)
    rng = np.random.default_rng(5)
    matches = np.cumsum(rng.random((20_000, minhash_dedup.BANDS * minhash_dedup.ROWS)) < 0.8, 1)
    alive = np.ones(20_000, bool)
    for i, m in enumerate(least):
        alive &= matches[:, (i + 1) * minhash_dedup.BATCH - 1] >= m
    assert alive.mean() > 0.999


@pytest.mark.parametrize("edits,block,size", [(4, 4096, 1 << 24), (3, 16, 8000)])
def test_links_grow_in_proportion_to_a_group(spark, monkeypatch, edits, block, size):
    """Copies around the threshold of each other: tasks emit forests, not pairs."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    monkeypatch.setattr(minhash_dedup, "CELL_BYTES", size)
    kept, counts = minhash_dedup.store, {}

    def counted(df, name):
        out = kept(df, name)
        counts[name] = counts.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(minhash_dedup, "store", counted)
    for n in (50, 200):
        rng = np.random.default_rng(n)
        rows = []
        for i in range(n):
            words = [f"f{k}" for k in range(60)]
            for at in rng.choice(60, edits, replace=False):
                words[at] = f"own{i}x{at}"
            rows.append((i, " ".join(words)))
        counts.clear()
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(table(spark, rows), 2).collect()}
        assert got == slow_components(rows, 2, 80)
        assert counts["survivors"] <= minhash_dedup.HUBS * n and counts["meeting"] <= minhash_dedup.BANDS * n
        assert counts["forests"] <= 2 * n


def test_rows_that_share_an_id_share_a_fate(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(7, "a b c d e f"), (7, text + " z"), (3, text), (9, "a b c d e f"), (1, "other words here")]
    want = None
    for order in (rows, rows[::-1]):
        got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(table(spark, order), 2).collect())
        assert want is None or got == want
        want = got
    assert {(i, c) for i, _, c, _ in got} == {(1, 1), (3, 3), (7, 3), (9, 3)}


def test_templates_below_the_threshold_stay_apart(spark):
    """Many texts alike at about 0.7: all share buckets, few or none are linked."""
    rng = np.random.default_rng(12)
    frame = [f"f{i}" for i in range(60)]
    rows = []
    for i in range(60):
        words = list(frame)
        for at in rng.choice(60, 6, replace=False):
            words[at] = f"own{i}x{at}"
        rows.append((i, " ".join(words)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(table(spark, rows), 2).collect()}
    assert got == slow_components(rows, 2, 80)


def test_chain_of_links_is_one_component(spark):
    links = table(spark, [(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["label"] for r in minhash_dedup.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_near_duplicates_move_entries_once_and_no_band_keys(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i // 3) * 7 + j}" for j in range(20)) + " x" * (i % 3)) for i in range(60)]
    stored, plain = {}, minhash_dedup.store

    def spy(df, name):
        stored[name] = df.columns, df._jdf.queryExecution().optimizedPlan().toString()
        return plain(df, name)

    monkeypatch.setattr(minhash_dedup, "store", spy)
    assert minhash_dedup.near_duplicates(table(spark, rows), 2).where("not kept").count()
    assert "Join" not in stored["buckets"][1]  # members and their smallest one in one pass
    assert "bands" not in stored["signatures"][0] + stored["classes"][0]


def test_near_duplicates_odd_input(spark):
    got = minhash_dedup.near_duplicates(odd(spark)).collect()
    assert len(got) == odd(spark).count()
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[i]["kept"] and by_id[i]["n_shingles"] == 0 for i in (0, 1, 2))
    assert by_id[6]["component_id"] == 5 and by_id[None]["kept"]
    assert minhash_dedup.near_duplicates(empty(spark)).count() == 0


# --- packing -------------------------------------------------------------------------------


def test_words_alone_give_the_ids_of_the_text():
    from tokenizers import Tokenizer

    words = packing.WordTokens(TOKENIZER)
    plain = Tokenizer.from_file(TOKENIZER)
    texts = ["", "a", "It's DON'T we'll 'tis", "x<|endoftext|>y <|startoftext|>", "A <|endoftext|> b", "É<|ENDOFTEXT|>x <|EndOfText|>", "Don't<|endoftext|>STOP, é<|endoftext|>́!", "é ÉÀ ñandú ǅ ſ K İ ß ẞ Σς", "a.b,c!? ... 12½ ²³ 文字 🙂", "é ̈x \x1c y\x85z q", "un:deux %%% **a** a's"]
    rng = np.random.default_rng(6)
    letters = list("abzAÉéñß.,!%'0 \t\n文́")
    texts += ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(500)]
    for t in texts:
        assert np.frombuffer(words.encode(t.encode()), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids + [1]


def test_words_of_many_texts_are_looked_up_once():
    from tokenizers import Tokenizer

    words = packing.WordTokens(TOKENIZER, 50)
    plain = Tokenizer.from_file(TOKENIZER)
    rng = np.random.default_rng(7)
    letters = list("abzAÉéñß.,!%'|0 \t\n文́\x0b\x1c")
    texts = [None, "", " ", "It's DON'T, we'll. 'tis,'s x,'s a.b,c!? ab,\u0301"] + ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(500)]
    for some in (texts, texts + ["a, <|endoftext|>, b,<|ENDOFTEXT|>x"], [None], []):
        found = words.encode_all([t.encode() if t is not None else None for t in some])
        assert [np.frombuffer(x, "<u4").tolist() for x in found] == [plain.encode(t or "", add_special_tokens=False).ids + [1] for t in some]
    words = packing.WordTokens(TOKENIZER)
    words.encode_all([b"reshsh reshsh, Reshsh.", b"reshsh,.%%% reshsh!"])
    assert sum(b"reshsh" in w for w in words) == 1  # whatever marks stand behind it


def test_instruction_examples_keep_to_the_limit_of_loss(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    asked = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    examples = turns.join(asked, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text", "question")
    limits = packing.Limits(tokens=512, segments=8, loss=150)
    rows = packing.pack_documents(examples, TOKENIZER, limits, pool=64, prompt="question").collect()
    words = packing.WordTokens(TOKENIZER)
    parts = {r["doc_id"]: (len(words.ids((r["question"] or "").encode())) // 4, len(words.encode((r["text"] or "").encode())) // 4) for r in examples.collect()}
    done, sums = {}, {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        before, own = parts[r["doc_id"]]
        assert r["doc_tokens"] == before + own and r["start"] == done.get(r["doc_id"], 0)
        done[r["doc_id"]] = r["start"] + r["length"]
        assert r["loss_tokens"] == max(0, r["start"] + r["length"] - max(r["start"], before))
        total = sums.setdefault(r["sequence_id"], [0, 0, 0])
        total[0] += r["length"]
        total[1] += 1
        total[2] += r["loss_tokens"]
    assert done == {k: sum(v) for k, v in parts.items()}
    assert all(t <= 512 and n <= 8 and loss <= 150 for t, n, loss in sums.values())
    assert max(loss for _, _, loss in sums.values()) > 100


def check_packing(rows, ids_by_doc):
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 2048 or at & (at - 1) == 0
        assert len(pieces) <= packing.SEGMENTS
    docs: dict = {}
    for r in rows:
        docs.setdefault(r["doc_id"], []).append(r)
    for i, ids in ids_by_doc.items():
        at = 0
        for r in sorted(docs[i], key=lambda r: r["start"]):
            part = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(part))
            at += r["length"]
        assert at == len(ids)


def test_packing_round_trip(spark, documents):
    words = packing.WordTokens(TOKENIZER)
    rows = packing.pack_documents(documents, TOKENIZER).collect()
    check_packing(rows, {r["doc_id"]: np.frombuffer(words.encode(r["text"].encode() if r["text"] else None), "<u4") for r in documents.collect()})


def test_packing_odd_input(spark):
    rows = packing.pack_documents(odd(spark).where("doc_id <> 5"), TOKENIZER).collect()
    words = packing.WordTokens(TOKENIZER)
    check_packing(rows, {r["doc_id"]: np.frombuffer(words.encode(r["text"].encode() if r["text"] else None), "<u4") for r in odd(spark).where("doc_id <> 5").collect()})
    assert packing.pack_documents(odd(spark), TOKENIZER).where("doc_id = 5").agg(F.count_distinct("sequence_id", "offset")).first()[0] >= 2
    assert packing.pack_documents(empty(spark), TOKENIZER).count() == 0


def test_all_limits_hold_and_nothing_is_lost():
    rng = np.random.default_rng(8)
    flags = [rng.random(rng.integers(1, 400)) < 0.4 for _ in range(300)]
    pieces = [((i, f), len(f)) for i, f in enumerate(flags)]
    limits = packing.Limits(tokens=256, segments=4, loss=90)
    seen = {i: np.zeros(len(f), int) for i, f in enumerate(flags)}
    for sequence in packing.place(iter(pieces), limits, pool=32):
        assert sum(n for _, _, n, _ in sequence) <= 256 and len(sequence) <= 4
        assert sum(int(p[1][s : s + n].sum()) for p, s, n, _ in sequence) <= 90
        for p, s, n, loss in sequence:
            assert loss == p[1][s : s + n].sum()
            seen[p[0]][s : s + n] += 1
    assert all((x == 1).all() for x in seen.values())


# --- archives --------------------------------------------------------------------------------


def test_audit_finds_every_kind_of_damage(spark):
    rows = [(i, bytearray(f"record {i}".encode() * (i % 5 + 1))) for i in range(0, 9_000, 3)] + [(None, bytearray(b"lost"))]
    schema = "number long, bytes binary"
    bad = dict(rows)
    bad.pop(None)
    bad[9] = bytearray(b"RECORD 9" * 5)
    bad[30] = None
    del bad[4500]
    bad[4501] = bytearray(b"new")
    got = {r["number"]: r for r in warc_fixity.audit(table(spark, rows, schema), table(spark, list(bad.items()), schema)).collect()}
    assert {n: r["fault"] for n, r in got.items()} == {9: "resized" if len(bad[9]) != len(dict(rows)[9]) else "altered", 30: "resized", 4500: "missing", 4501: "extra"}
    before = sum(len(b) for n, b in rows if n is not None and n // 4096 == 1 and n < 4500)
    assert got[4500]["offset"] == before and got[4500]["file"] == 1
    assert warc_fixity.audit(table(spark, rows, schema), table(spark, rows, schema)).count() == 0
    assert warc_fixity.audit(table(spark, rows[:20], schema), table(spark, [], schema)).count() == 20
    assert warc_fixity.audit(table(spark, [], schema), table(spark, [], schema)).count() == 0


# --- classifiers --------------------------------------------------------------------------------


def test_machine_equals_its_pairwise_sum():
    rng = np.random.default_rng(9)
    m = quality.Machine(np.array([0.3]), rng.normal(size=50), rng.normal(size=(50, 4)))
    slots, values = np.array([3, 7, 20, 41]), np.array([0.5, 1.0, 2.0, -1.0], np.float32)
    pairs = sum(m.factors[a] @ m.factors[b] * x * y for (a, x), (b, y) in itertools.combinations(zip(slots, values), 2))
    want = 0.3 + (m.linear[slots] * values).sum() + pairs
    assert np.isclose(m.margins(slots, values, np.array([0]))[0], want, atol=1e-4)


def labelled(spark, label, folds, held):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", F.col(label).alias("label"))
    every = docs.join(labels, "doc_id")
    return every.where(fold("doc_id", folds) != held), every.where(fold("doc_id", folds) == held)


def auc(rows):
    good = [s for y, s in rows if y == 1]
    bad = [s for y, s in rows if y == 0]
    return np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])


def test_quality_held_out(spark):
    train, held = labelled(spark, "quality", 5, 0)
    machine = quality.train(train)
    assert auc([(r["label"], r["score"]) for r in quality.score(held, machine).collect()]) > 0.9
    got = quality.score(odd(spark).drop("score"), machine).collect()
    assert all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (0, 1)}) == 1
    assert quality.score(empty(spark).drop("score"), machine).count() == 0
    none = quality.train(odd(spark).where("label = 9"))
    assert {r["score"] for r in quality.score(odd(spark).drop("score"), none).collect()} == {0.5}


def test_toxicity_held_out_and_located(spark):
    train, held = labelled(spark, "toxic", 3, 1)
    model = toxicity.train(train)
    rows = toxicity.score(held, model).collect()
    assert auc([(r["label"], r["toxicity"]["score"]) for r in rows]) > 0.8
    for r in rows:
        for s in r["toxicity"]["offending"]:
            assert 0 <= s["start"] < s["end"] <= len(r["text"]) and s["score"] >= toxicity.OFFENDING
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(odd(spark), model).collect()}
    assert all(got[i]["score"] == 0 and got[i]["sentences"] == 0 for i in (0, 1, 2))
    assert toxicity.score(empty(spark), model).count() == 0
    toxicity.train(odd(spark))  # one label only


def test_noisy_or_of_planted_sentences(spark):
    rng = np.random.default_rng(10)
    say = lambda: " ".join(f"plain{rng.integers(0, 60)}" for _ in range(8))
    rows = []
    for i in range(400):
        parts = [say() for _ in range(rng.integers(2, 9))]
        if i % 4 == 0:
            parts[rng.integers(0, len(parts))] += " vilestuff"
        rows.append((i, ". ".join(parts), int(i % 4 == 0)))
    docs = table(spark, rows, "doc_id long, text string, label int")
    got = toxicity.score(docs, toxicity.train(docs)).collect()
    for r in got:
        assert (r["toxicity"]["score"] >= 0.7) == (r["label"] == 1)
        if r["label"]:
            worst = r["toxicity"]["offending"][0]
            assert "vilestuff" in r["text"][worst["start"] : worst["end"]]


def test_instances_do_not_depend_on_the_batch():
    texts = [b"Hello you. FINE!! day", b"", "À la\n\n...x".encode(), b"no end", b"1 2 3?! 4"]
    whole = toxicity.instances(texts)
    ends = np.concatenate(([0], np.cumsum(whole.sizes)))
    for i, t in enumerate(texts):
        one = toxicity.instances([t])
        at = np.flatnonzero(whole.text == i)
        assert one.sizes.tolist() == whole.sizes[at].tolist()
        assert one.begin.tolist() == whole.begin[at].tolist() and one.end.tolist() == whole.end[at].tolist()
        if len(at):
            assert one.slots.tolist() == whole.slots[ends[at[0]] : ends[at[-1] + 1]].tolist()


# --- language model --------------------------------------------------------------------------------


def test_kinds_are_counted_over_all_texts(spark):
    rows = [(" ".join([f"a{i % 7}"] * 5 + [f"only{i}"]).encode(),) for i in range(2500)]
    kinds = lm_scoring.find_kinds(spark.createDataFrame(rows, "text binary").repartition(3))
    used = {int(x) for (t,) in rows for x in lm_scoring._kind_slots(lm_scoring.word_hashes([t])[0])}
    known = np.flatnonzero((kinds.logs > kinds.logs.min(0)).any(1))
    assert set(known.tolist()) == used
    again = lm_scoring.find_kinds(spark.createDataFrame(rows, "text binary").repartition(5))
    assert np.array_equal(again.logs, kinds.logs)


def test_base_scores_match_the_formula(spark, documents, monkeypatch):
    monkeypatch.setattr(lm_scoring, "HEAD_WORDS", 50)
    train = documents.where(fold("doc_id", 10) != 0)
    model, vocabulary, totals = lm_scoring.train(train)
    counts: dict = {}
    for r in train.collect():
        for w in [*r["text"].encode().lower().split(), None]:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    assert (totals["tokens"], totals["types"]) == (n, v)
    got = {r["doc_id"]: r for r in lm_scoring.score(documents, model, vocabulary, totals).collect()}
    ahead = []
    for r in documents.collect():
        words = [*r["text"].encode().lower().split(), None]
        c = np.array([counts.get(w, 0) for w in words])
        assert np.isclose(got[r["doc_id"]]["base_score"], np.log10((c + 0.1) / (n + 0.1 * (v + 1))).sum())
        assert (got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["n_known"]) == (len(words), (c > 0).sum())
        ahead.append(got[r["doc_id"]]["score"] - got[r["doc_id"]]["base_score"])
    assert np.mean(ahead) > 0


def test_prefix_code_is_complete():
    code = lm_scoring.prefix_code(np.arange(256) ** 2.0)
    assert np.isclose((0.5 ** code.sizes.astype(float)).sum(), 1.0)
    paths = {tuple(zip(code.nodes[s : s + n], code.bits[s : s + n])) for s, n in zip(code.starts, code.sizes)}
    assert len(paths) == 256


def test_code_lengths_are_proper(spark):
    """Probabilities of all one-word continuations add up to no more than one."""
    docs = table(spark, [(i, "abc abd acd bcd") for i in range(30)])
    model, _, _ = lm_scoring.train(docs)
    words = [bytes(w) for n in (0, 1, 2) for w in itertools.product(b"abcd", repeat=n)]
    total = 0.0
    for w in words[1:]:
        p = lm_scoring.paths([w, lm_scoring.END], 0, model)
        total += 2.0 ** -lm_scoring.code_length(np.array([0, 1]), p)
    assert 0 < total <= 1.0


def test_language_model_odd_input(spark):
    model, vocabulary, totals = lm_scoring.train(odd(spark))
    got = lm_scoring.score(odd(spark), model, vocabulary, totals).collect()
    assert len(got) == odd(spark).count()
    assert all(r["n_tokens"] == 1 and r["n_known"] == 1 for r in got if r["doc_id"] in (0, 1, 2))
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)
    nothing = lm_scoring.train(empty(spark))
    got = lm_scoring.score(odd(spark), *nothing).collect()
    assert all(r["n_known"] == 0 and np.isclose(r["base_score"], 0.0) for r in got)
    assert lm_scoring.score(empty(spark), model, vocabulary, totals).count() == 0


# --- registered queries ------------------------------------------------------------------------------


@pytest.mark.parametrize("number", range(1, 11))
def test_one_query_per_operator(number):
    assert len([n for n in QUERIES if n.startswith(f"op{number}_")]) == 1


def test_mixture_of_words_is_sequential_and_rewards_order():
    rng = np.random.default_rng(4)
    ids = rng.integers(0, 30, 400)
    ids[200:260] = ids[100:160]  # a phrase comes back
    spelt, chance = np.log(rng.random(400) * 0.01 + 1e-6), rng.random(400) * 0.01
    nats = lm_scoring.mix_words(ids, spelt, chance)
    # the same by plain counting; probabilities of a step don't depend on what comes after
    once: dict = {}
    pairs: dict = {}
    last, p = -1, []
    for i, w in enumerate(ids.tolist()):
        after = sum(n for (a, _), n in pairs.items() if a == last)
        p.append((np.exp(spelt[i]), chance[i], once.get(w, 0) / (i + lm_scoring.CACHE_DOUBT), pairs.get((last, w), 0) / (after + lm_scoring.PAIR_DOUBT), min(after, lm_scoring.MIX_GATES - 1)))
        once[w] = once.get(w, 0) + 1
        pairs[(last, w)] = pairs.get((last, w), 0) + 1
        last = w
    weights, trust, at, want = lm_scoring.MIX_START.copy(), [lm_scoring.MIX_TRUST] * lm_scoring.MIX_GATES, 0, 0.0
    sizes = iter([*lm_scoring.BLOCKS, *[lm_scoring.BLOCKS[-1]] * 400])
    while at < 400:
        part = p[at : at + (size := next(sizes))]
        shares = [(q[4], weights[q[4]] * q[:4]) for q in part]
        want -= sum(np.log(s.sum()) for _, s in shares)
        for g in range(lm_scoring.MIX_GATES):
            own = [s / s.sum() for h, s in shares if h == g]
            if own:
                weights[g] = (weights[g] * trust[g] + np.sum(own, 0)) / (trust[g] + len(own))
                trust[g] += len(own)
        weights = np.maximum(weights, 1e-4)
        weights /= weights.sum(1, keepdims=True)
        at += size
    assert np.isclose(nats, want)
    order = rng.permutation(400)
    assert nats < lm_scoring.mix_words(ids[order], spelt[order], chance[order])
