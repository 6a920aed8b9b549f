"""Removal of passages that an earlier document has, by sharded Aho-Corasick automata.

A window is ``window`` consecutive words; it recurs if its words also start
somewhere in a document with a smaller id, and every word under a recurring
window goes. Windows are judged on the input.

1. Seeds. Of the runs of five words inside a window the one of least rank is its
   seed (hashed; runs of short words rank last), so equal windows have equal seeds
   and only about one position in five is a seed. Seeds of two documents or more
   are kept.
2. Passages. The windows of one occurrence of such a seed lie next to each other
   and are cut out together, as a passage of 13 to 21 words; a document has at most
   as many passages as seeds, however many documents share them. A seed of more
   than HOT_SEED occurrences gives a passage for each window instead, since its
   surroundings may be different everywhere and have to be spread over tasks.
3. Confirmation and automata. Equal passages are first reduced to one with its least
   and greatest document. Passages are dealt by their seed (of hot seeds: by their
   words); a shard counts its windows by document, compiles those of two documents
   or more into one automaton over word numbers, and streams its passages through
   it; each match tells the window's first document.
4. The answer for a distinct passage goes back to its occurrences in later documents,
   and documents drop the words under windows whose first document precedes them.

All groupings aggregate before they shuffle, and joins on hot passages can be
split. Words never pass a hash on their way into an automaton; hashes only
choose seeds, shards and equal passages (128 bits).

Results for odd input: a null or empty text has no words, and its kept text is
empty; documents shorter than a window lose nothing; repeats within one document
stay. Rows with equal ids don't remove each other's words, and each is judged by its
own text. Rows without an id lose nothing and remove nothing. An empty table gives
an empty table. Other columns are not read, and ``cut`` returns them unchanged, but
for one that has the name ``out``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm.common import chain_hash, free_name, spread, store, text_windows, texts_of, word_hashes_sizes

SEED_WORDS = 5
SHARD_WORDS = 60_000
LONG_WORD = 5  # runs whose words are shorter on average rank last
HOT_SEED = 20_000  # occurrences


@dataclass
class Windows:
    """All windows of a batch of texts: where they begin (in the batch's words), whose
    they are, their seeds' positions; and the hashes of the runs that seeds are."""

    at: np.ndarray
    row: np.ndarray
    seed: np.ndarray
    grams: np.ndarray
    hashes: np.ndarray
    begin: np.ndarray  # of each text in the batch's words

    def fresh(self) -> np.ndarray:
        """The windows whose seed is not that of the window before."""
        new = np.ones(len(self.at), bool)
        new[1:] = (self.seed[1:] != self.seed[:-1]) | (self.row[1:] != self.row[:-1])
        return new


def windows_of(texts: list[bytes | None], window: int) -> Windows:
    """Seeds are the least-ranked runs, the leftmost of equals, so along a text their
    positions never fall and equal neighbours are all there is to remove."""
    hashes, counts, sizes = word_hashes_sizes(texts)
    begin = np.cumsum(counts) - counts
    row = np.repeat(np.arange(len(texts)), counts)
    m = len(hashes) - window + 1
    if m <= 0:
        none = np.empty(0, np.int64)
        return Windows(none, none, none, np.empty(0, np.uint64), hashes, begin)
    grams = chain_hash(hashes, SEED_WORDS)
    total = np.concatenate(([0], np.cumsum(sizes)))
    top = np.uint64(1) << np.uint64(63)
    rank = grams & ~top
    rank[total[SEED_WORDS:] - total[:-SEED_WORDS] < SEED_WORDS * LONG_WORD] |= top
    # the least of a range is that of two ranges of half its length, or overlapping ones
    best, where, span = rank, np.arange(len(rank)), 1
    while span < window - SEED_WORDS + 1:
        step = min(span, window - SEED_WORDS + 1 - span)
        less = best[step:] < best[:-step]
        where = np.where(less, where[step:], where[:-step])
        best = np.minimum(best[step:], best[:-step])
        span += step
    at = np.flatnonzero(row[:m] == row[window - 1 :])
    return Windows(at, row[at], where[at], grams, hashes, begin)


def seeds(docs: DataFrame, window: int) -> DataFrame:
    """seed, doc_id, version, at: each document's seed positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_windows(batches):
            w = windows_of(texts_of(batch), window)
            new = w.fresh()
            if new.any():
                where, row = w.seed[new], pa.array(w.row[new])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(w.grams[where].view(np.int64)),
                        batch.column(0).take(row),
                        batch.column(1).take(row),
                        pa.array((where - w.begin[w.row[new]]).astype(np.int32)),
                    ],
                    names=["seed", "doc_id", "version", "at"],
                )

    return docs.mapInArrow(run, "seed long, doc_id long, version long, at int")


def passages(marked: DataFrame, window: int) -> DataFrame:
    """doc_id, version, start, shard, p1, p2, words: the windows of each recurring seed.

    ``marked`` has doc_id, version, text and hits, an array of (at, hot).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_windows(batches):
            texts = texts_of(batch)
            w = windows_of(texts, window)
            hits = batch.column(3)
            values = hits.flatten()
            place = np.repeat(w.begin, pc.list_value_length(hits).to_numpy(zero_copy_only=False)) + values.field("at").to_numpy()
            state = np.zeros(len(w.hashes), np.int8)
            state[place] = 1 + values.field("hot").to_numpy(zero_copy_only=False).astype(np.int8)
            live = np.flatnonzero(state[w.seed] > 0)
            if not len(live):
                continue
            at, row, seed = w.at[live], w.row[live], w.seed[live]
            hot = state[seed] == 2
            edge = np.flatnonzero((seed[1:] != seed[:-1]) | (row[1:] != row[:-1]) | hot[1:]) + 1
            first = np.concatenate(([0], edge))
            last = np.concatenate((edge, [len(at)])) - 1
            start = at[first] - w.begin[row[first]]
            stop = at[last] - w.begin[row[first]] + window
            words: list[bytes] = []
            whose = -1
            for r, a, b in zip(row[first].tolist(), start.tolist(), stop.tolist()):
                if r != whose:
                    whose, split_text = r, texts[r].split()
                words.append(b" ".join(split_text[a:b]))
            digests = np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in words), np.int64).reshape(-1, 2)
            shard = np.where(hot[first], digests[:, 0], w.grams[seed[first]].view(np.int64))
            whole = pa.array(row[first])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(whole),
                    batch.column(1).take(whole),
                    pa.array(start.astype(np.int32)),
                    pa.array(shard),
                    pa.array(digests[:, 0].copy()),
                    pa.array(digests[:, 1].copy()),
                    pa.array(words, pa.binary()),
                ],
                names=["doc_id", "version", "start", "shard", "p1", "p2", "words"],
            )

    schema = "doc_id long, version long, start int, shard long, p1 long, p2 long, words binary"
    return marked.select("doc_id", "version", "text", "hits").mapInArrow(run, schema)


def locate(table: pa.Table, window: int) -> pa.Table:
    """One shard: compile its confirmed windows, stream its passages through them.

    ``table`` has p1, p2, words, first and last (least and greatest document of
    the passage); returns p1, p2 and for each window the least document, or null.
    """
    numbers: dict[bytes, int] = {}
    texts = [tuple([numbers.setdefault(w, len(numbers) + 1) for w in t.split()]) for t in table["words"].to_pylist()]
    seen: dict[tuple, tuple[int, int]] = {}
    for words, low, high in zip(texts, table["first"].to_pylist(), table["last"].to_pylist()):
        for i in range(len(words) - window + 1):
            key = words[i : i + window]
            was = seen.get(key)
            seen[key] = (low, high) if was is None else (min(was[0], low), max(was[1], high))
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    some = False
    for key, (low, high) in seen.items():
        if low < high:
            automaton.add_word(key, low)
            some = True
    seen.clear()
    if some:
        automaton.make_automaton()
    firsts = []
    for words in texts:
        own: list[int | None] = [None] * (len(words) - window + 1)
        if some:
            for end, low in automaton.iter(words):
                own[end - window + 1] = low
        firsts.append(own)
    return pa.table({"p1": table["p1"], "p2": table["p2"], "firsts": pa.array(firsts, pa.list_(pa.int64()))})


def removed_windows(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, version (hash of the text) and the starts of its windows that recur in an earlier document."""
    texts = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text").where("doc_id is not null"))
    found = seeds(texts, window)
    often = found.groupBy("seed").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).where("low < high")
    shared = store(often.select("seed", (F.col("n") > HOT_SEED).alias("hot")), "seeds")
    by_doc = found.join(shared, "seed").groupBy("doc_id", "version").agg(F.collect_list(F.struct("at", "hot")).alias("hits"))
    by_doc = store(by_doc, "hits")  # the seeds' shuffle is gone before the texts move
    cut = store(passages(texts.join(by_doc, ["doc_id", "version"]), window), "passages")
    distinct = cut.groupBy("shard", "p1", "p2").agg(F.first("words").alias("words"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))

    # shards are many and small: a task takes a group of them as one automaton
    total = cut.agg(F.sum(F.length("words"))).first()[0] or 0
    groups = max(1, int(total / 6 / SHARD_WORDS))

    def run(table: pa.Table) -> pa.Table:
        return locate(table, window)

    located = (
        distinct.withColumn("group", F.pmod(F.xxhash64("shard"), F.lit(groups)))
        .groupBy("group")
        .applyInArrow(run, "p1 long, p2 long, firsts array<long>")
    )
    answers = store(located.select("*", F.array_min("firsts").alias("low")).where("low is not null"), "located")
    starts = (
        cut.select("doc_id", "version", "start", "p1", "p2")
        .join(answers, ["p1", "p2"])
        .where("low < doc_id")
        .select(
            "doc_id",
            "version",
            F.filter(F.transform("firsts", lambda x, i: F.when(x < F.col("doc_id"), F.col("start") + i)), lambda x: x.isNotNull()).alias("starts"),
        )
        .groupBy("doc_id", "version")
        .agg(F.flatten(F.collect_list("starts")).alias("starts"))
    )
    return store(starts, "starts")  # as above


def covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of n words lie under a window that starts at one of ``starts``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + window, n), -1)
    return np.cumsum(edge[:n]) > 0


def cut(docs: DataFrame, window: int = 13, out: str = "cut") -> DataFrame:
    """``docs`` with a struct ``out``: n_words, n_removed, kept_sha256 and kept, the kept
    words joined by one space (null where nothing was removed: the text stands)."""
    own_id, version, where = (free_name(docs, n) for n in ("_id", "_version", "_starts"))
    starts = removed_windows(docs, window).toDF(own_id, version, where)
    joined = docs.join(starts, (F.col("doc_id") == F.col(own_id)) & (F.xxhash64("text") == F.col(version)), "left").drop(own_id, version)

    @F.pandas_udf("n_words long, n_removed long, kept_sha256 string, kept string")
    def finish(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, gone in batches:
            rows = []
            for t, s in zip(texts, gone):
                words = t.encode("utf-8", "replace").split() if t else []
                n = len(words)
                if s is not None and len(s):
                    under = covered(n, np.asarray(s, np.int64), window)
                    words = [w for w, x in zip(words, under) if not x]
                kept = b" ".join(words)
                rows.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode() if len(words) < n else None))
            yield pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256", "kept"])

    # not deterministic, or a filter on the result would run it a second time
    return joined.withColumn(out, finish.asNondeterministic()("text", where)).drop(where)
