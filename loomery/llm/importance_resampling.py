"""Resampling towards a target distribution by hashed n-gram features.

Features are runs of 1 to ``runs`` consecutive words, hashed into buckets by the crc32 of
their bytes. A bucket's gain is the log ratio of its smoothed share in the target and in
the source; a document's weight is the sum of its features' gains. Gumbel noise drawn from
a hash of the id turns the highest scores into a sample without replacement.

The words are read by an Aho-Corasick dictionary: the distinct words of a window of text,
bounded by a delimiter on both sides, are its patterns, and each carries the crc32 and the
length of its bytes as payload. A scan over the window emits the payloads in order. The
crc32 of a longer run is composed from its neighbours' payloads alone (crc32 is linear, so
appending n bytes is n fixed shifts), so a feature's text is never built.

Two scans over the texts: one counts features per bucket (an array in each task, one row
for each bucket it met, summed by an aggregation), one weighs every document with the gains
(one number for each bucket, a parameter, sent to the tasks). The order of the draw comes
from a range sort of narrow rows that is written once: a row's rank is its place in its
partition and the sizes of those before, so no task ever holds them all.

Results for odd input: null and empty texts have no feature, weight 0 and are never drawn;
a null id is hashed like the empty text and comes after all ids in a tie. Repeated rows are
each counted, scored and ranked, rows of the same values next to each other. Without target
texts, or without documents, all counts of that side are 0. Texts of any length are scanned
in parts of WINDOW_BYTES that end at a delimiter. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomery.llm.common import WINDOW_BYTES, spread, store, text_windows, texts_of

# lower-case for A-Z, a space for every ASCII character that is neither letter nor digit
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


@lru_cache(1)
def _shifts() -> np.ndarray:
    """[k, i, b]: what byte i of a crc32, if it is b, becomes when 2**k zero bytes follow."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    steps = []
    bytes_of = np.arange(256, dtype=np.uint32)
    one = np.stack([table, *((bytes_of << np.uint32(8 * i)) >> np.uint32(8) for i in (1, 2, 3))])
    for _ in range(31):
        steps.append(one)
        one = np.stack([_apply(one, row) for row in one])
    return np.stack(steps)


def _apply(step: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return step[0][crc & 255] ^ step[1][(crc >> 8) & 255] ^ step[2][(crc >> 16) & 255] ^ step[3][crc >> 24]


def compose(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 of two byte strings in a row from the crc32 of each and the second one's length."""
    out = left.astype(np.uint32)
    for k, step in enumerate(_shifts()):
        if not (length >> k).any():
            break
        out = np.where((length >> k) & 1, _apply(step, out), out)
    return out ^ right


def _parts(texts: list[bytes | None], limit: int, keep: int) -> Iterator[tuple[int, bytes, int]]:
    """(number, plain text, words of it that the part before had) in parts of about ``limit`` bytes.

    A part repeats the last ``keep`` words of the one before, so that no run is lost.
    """
    for number, text in enumerate(texts):
        plain = text.translate(_PLAIN) if text else b""
        if len(plain) <= limit:
            yield number, plain, 0
            continue
        start, before = 0, b""
        while start < len(plain):
            stop = plain.find(b" ", start + limit)
            stop = len(plain) if stop < 0 else stop
            words = before.split()
            yield number, before + b" " + plain[start:stop], len(words)
            if keep:  # words end at a delimiter, so a tail is whole words but for its first
                tail = words + plain[start:stop].split()[-keep:]
                before = b" ".join(tail[-keep:])
            start = stop


def scan(texts: list[bytes | None], runs: int, buckets: int, limit: int = WINDOW_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For windows of the texts: (bucket of each feature, its text's number, words of every text)."""
    import ahocorasick

    def work(parts: list[tuple[int, bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        whole = b"  ".join(p for _, p, _ in parts)
        words = list(dict.fromkeys(whole.split()))
        n_words = np.zeros(len(texts), np.int64)
        if not words:
            return np.empty(0, np.int64), np.empty(0, np.int64), n_words
        crc = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        length = np.fromiter(map(len, words), np.int64, len(words))
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, word in enumerate(words):
            automaton.add_word(f" {word.decode('latin-1')} ", i)
        automaton.make_automaton()
        found = np.fromiter((x for pair in automaton.iter(f" {whole.decode('latin-1')} ") for x in pair), np.int64).reshape(-1, 2)
        ends = np.cumsum([len(p) + 2 for _, p, _ in parts])
        part = np.searchsorted(ends, found[:, 0] - 1, side="left")
        first = np.searchsorted(part, np.arange(len(parts)))
        fresh = np.arange(len(part)) - first[part] >= np.array([k for _, _, k in parts])[part]
        number = np.array([n for n, _, _ in parts])[part]
        np.add.at(n_words, number[fresh], 1)
        word_crc, word_length = crc[found[:, 1]], length[found[:, 1]]
        spaced = compose(np.full(len(crc), zlib.crc32(b" "), np.uint32), crc, length)[found[:, 1]] if runs > 1 else word_crc
        out, of = [], []
        running = word_crc
        for n in range(1, runs + 1):
            if n > 1:  # the run that ends one word further on
                running = compose(running[:-1], spaced[n - 1 :], word_length[n - 1 :] + 1)
            last = np.arange(n - 1, len(part))
            own = fresh[last] & (part[last] == part[last - n + 1])
            out.append(running[own].astype(np.int64) % buckets)
            of.append(number[last][own])
        return np.concatenate(out), np.concatenate(of), n_words

    waiting: list[tuple[int, bytes, int]] = []
    held = 0
    for entry in _parts(texts, limit, runs - 1):
        if waiting and held + len(entry[1]) > limit:
            yield work(waiting)
            waiting, held = [], 0
        waiting.append(entry)
        held += len(entry[1])
    if waiting:
        yield work(waiting)


def bucket_counts(texts: DataFrame, runs: int, buckets: int) -> DataFrame:
    """bucket, n: features of all texts (column ``text``) by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in text_windows(batches):
            for bucket, _, _ in scan(texts_of(batch), runs, buckets):
                total += np.bincount(bucket, minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["bucket", "n"])

    return spread(texts.select("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, runs: int, buckets: int) -> np.ndarray:
    """Gain of every bucket from the texts of both sides; ``buckets`` rows reach the driver."""
    s, t = (bucket_counts(x, runs, buckets) for x in (source, target))
    both = (
        source.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
        .join(s.withColumnRenamed("n", "s"), "bucket", "left")
        .join(t.withColumnRenamed("n", "t"), "bucket", "left")
        .select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    )
    rows = sorted(store(both, "bucket-counts").collect())
    s_all, t_all = sum(r["s"] for r in rows), sum(r["t"] for r in rows)
    return np.array([np.floor(1000 * np.log((r["t"] + 1.0) * (s_all + buckets) / ((r["s"] + 1.0) * (t_all + buckets)))) for r in rows], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, runs: int, seed: int) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in text_windows(batches):
            words, features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for bucket, number, n_words in scan(texts_of(batch), runs, len(own)):
                words += n_words
                np.add.at(features, number, 1)
                np.add.at(weight, number, own[bucket])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words), pa.array(features), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"]
            )

    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296.0)))
    weighed = spread(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")
    return weighed.withColumn("score", F.col("weight") + noise)


def draw(weighed: DataFrame, least_words: int, percent: int) -> DataFrame:
    """``weighed`` with ``rank``: 1, 2, 3, ... of the drawn ones, by falling score.

    Of the N rows with ``least_words`` words or more, floor(percent * N / 100) are drawn.
    """
    weighed = store(weighed, "weighed")
    able = F.col("n_words") >= least_words
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), "n_features"]
    columns = weighed.columns
    placed = store(
        weighed.where(able).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), "placed"
    )
    part = F.shiftright("_place", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row for each partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    rank = F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn("rank", rank)
    drawn = F.when(F.col("rank") <= F.floor(F.col("_all") * percent / 100), F.col("rank"))
    left = weighed.where(~able).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*columns, drawn.alias("rank")).unionByName(left)


def resample(docs: DataFrame, target: DataFrame, runs: int = 1, buckets: int = 10_000, seed: int = 2024, least_words: int = 20, percent: int = 10) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank (null where not drawn) for every row of ``docs``."""
    return draw(weigh(docs, gains(docs, target, runs, buckets), runs, seed), least_words, percent)
