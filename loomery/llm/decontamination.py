"""Benchmark decontamination: rare n-gram seeds that can't be missed, then Smith-Waterman alignment.

1. The n-grams of an item are its word bigrams. An alignment with m equal words
   and e changed, dropped or added ones has m - e - 1 equal bigrams at least, so one
   that reaches ``least`` has (2 * least - 1) * words - 1 or more, all within a
   bounded stretch of the text. Where that is none (up to five words at 0.6), the
   n-grams are the words, of which least * words must be equal.
   One pass over the texts counts the n-grams of items. The seeds are the rare ones:
   the most frequent are left out, as many as every alignment can do without (one of
   14 bigrams in a row at 0.6, where two of twelve must be equal). A text meets an item
   by its seeds; the other n-grams are looked up only around seeds that were found.
2. Stretches of texts with enough n-grams of an item are aligned with it: local
   alignment of words (match 2, mismatch -1, gap -1), so inserted, dropped and
   changed words only lower the score. The share of the best possible score that
   an alignment reaches is its similarity; pairs at ``least`` or more are leaks,
   and none of them is without a seed, however its words were edited.
3. A passage of an item is a leak too, however long the rest: PASSAGE_WORDS
   consecutive item words or more whose alignment reaches ``least`` of the best
   score of just these words. One of up to 2 * PASSAGE_WORDS - 1 words is in each,
   with two n-grams at least; stretches of text and item around two such n-grams are
   searched for the best passage (the one furthest above ``least``).

A row tells both: ``similarity`` is the share of the whole item, ``passage`` the
share of the best passage and ``passage_words`` its length in the item (null if
there is none). The place is that of the whole item's alignment where this is a
leak, else that of the passage.

Items go out in blocks of at most BLOCK_WORDS words, so what is sent to the
executors is bounded however long the list of items is; a block costs two scans
of the texts (counts, then matches) and shuffles its counts only. Where a window of
texts and a block have more than MOST_PAIRS seeds in common, the items are taken in
halves, so a task holds that many pairs, or those of one item.

Words are runs of letters and digits (any non-ASCII character counts as a
letter), lower-cased. Results for odd input: null and empty texts and items
never match; items of one or two words match like others (one word: wherever
it stands), those of fewer than PASSAGE_WORDS as a whole only; repeated rows and items each give rows of their own; of equally good places in
a text the first is reported; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm.common import chain_hash, spread, text_windows, texts_of, word_hashes

PASSAGE_WORDS = 13
BLOCK_WORDS = 1_000_000
LEAST = 0.6
MATCH, MISMATCH, GAP = 2, -1, -1
SIEVE_BITS = 22
MOST_PAIRS = 2_000_000

_plain = bytearray(range(256))
for _b in range(128):
    if not chr(_b).isalnum():
        _plain[_b] = 0x20
_PLAIN = bytes(_plain)


def plain(text: bytes | None) -> bytes | None:
    """Lower case, with everything but letters and digits turned into spaces, byte for byte where ASCII."""
    return text.decode("utf-8", "replace").lower().encode().translate(_PLAIN) if text else text


@dataclass
class Grams:
    """Hashes in order, with a sieve in front of the search in them."""

    hashes: np.ndarray
    sieve: np.ndarray
    bits: int

    @classmethod
    def of(cls, hashes: np.ndarray) -> Grams:
        bits = min(SIEVE_BITS, max(8, len(hashes).bit_length() + 5))
        sieve = np.zeros(1 << bits, bool)
        sieve[(hashes >> np.uint64(64 - bits)).astype(np.int64)] = True
        return cls(hashes, sieve, bits)

    def matches(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions in ``grams``, and for each the first of the equal hashes and their number."""
        maybe = np.flatnonzero(self.sieve[(grams >> np.uint64(64 - self.bits)).astype(np.int64)])
        low = np.searchsorted(self.hashes, grams[maybe], "left")
        n = np.searchsorted(self.hashes, grams[maybe], "right") - low
        return maybe[n > 0], low[n > 0], n[n > 0]


def _expand(low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) for each value of the ranges of ``n`` values from ``low``."""
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) + np.repeat(low - np.cumsum(n) + n, n)


@dataclass
class Block:
    """Test items with their word hashes, their seeds in order of hash, and their other n-grams."""

    ids: list
    words: list[np.ndarray]
    rare: list[np.ndarray]  # whether an n-gram of an item is a seed
    least: float
    seeds: Grams
    item: np.ndarray
    at: np.ndarray
    others: Grams  # distinct n-grams that some item has as no seed
    other: np.ndarray  # item after item, its n-grams that are no seeds: index in others, place in the item
    other_at: np.ndarray
    other_ends: np.ndarray
    need: np.ndarray  # n-grams that an alignment of an item holds at least
    size: np.ndarray
    slack: np.ndarray  # words that an alignment can have beyond the item's

    @property
    def reach(self) -> np.ndarray:
        """Words of a text that a leak of an item spans at most, with what is searched around it."""
        longest = 2 * PASSAGE_WORDS - 1
        return np.maximum(self.size + self.slack, longest + bounds(longest, self.least)[2]) + longest

    def halves(self) -> tuple[Block, Block]:
        mid = len(self.ids) // 2
        parts = ((self.ids[x], self.words[x], self.rare[x]) for x in (slice(mid), slice(mid, None)))
        first, second = (block_of(*part, self.least) for part in parts)
        return first, second


def bounds(size: int, least: float) -> tuple[int, int, int]:
    """(words of a seed, seeds an alignment holds at least, words it can have more than the item)."""
    pairs = math.ceil((2 * least - 1) * size - 1 - 1e-9)
    if size >= PASSAGE_WORDS:  # its passages must be found by the same seeds
        pairs *= math.ceil((2 * least - 1) * PASSAGE_WORDS - 1 - 1e-9) > 0
    slack = max(int((2 - 2 * least) * size + 1e-9), 0)
    return (2, pairs, slack) if pairs > 0 else (1, max(math.ceil(least * size - 1e-9), 1), slack)


def rare_grams(cost: np.ndarray, size: int, least: float) -> np.ndarray:
    """Which n-grams of an item of ``size`` words are seeds, given what each costs.

    The dearest are left out as long as fewer than an alignment must hold are missing
    from the item, if it is short, and from each of its stretches of PASSAGE_WORDS to
    2 * PASSAGE_WORDS - 1 words: every passage has one of these that reaches ``least``.
    """
    n, whole, _ = bounds(size, least)
    apart: dict[int, int] = {}  # so many n-grams left out must not lie in so many in a row
    for words in range(PASSAGE_WORDS, min(size, 2 * PASSAGE_WORDS - 1) + 1):
        must = (2 * least - 1) * words - 1 if n == 2 else (1 + 2 * least) / 3 * words
        must = math.ceil(must - 1e-9)
        apart[must] = max(apart.get(must, 0), words - n + 1)
    if size < PASSAGE_WORDS / least:  # an alignment of a longer item is as long as a passage
        apart[whole] = max(apart.get(whole, 0), len(cost))
    rare = np.ones(len(cost), bool)
    out: list[int] = []
    for p in np.argsort(-cost, kind="stable").tolist():
        k = bisect.bisect(out, p)
        out.insert(k, p)
        if all(out[j + must - 1] - out[j] >= row for must, row in apart.items() for j in range(max(k - must + 1, 0), min(k, len(out) - must) + 1)):
            rare[p] = False
        else:
            del out[k]
    return rare


def item_words(texts: list[bytes | None]) -> list[np.ndarray]:
    hashes, counts = word_hashes([plain(t) for t in texts])
    return [hashes[e - n : e] for e, n in zip(np.cumsum(counts), counts)]


def item_grams(words: list[np.ndarray], least: float) -> list[np.ndarray]:
    return [chain_hash(w, bounds(len(w), least)[0]) for w in words]


def _joined(parts: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, kind)


def block_of(ids: list, words: list[np.ndarray], rare: list[np.ndarray], least: float) -> Block:
    rules = [bounds(len(w), least) for w in words]
    grams = item_grams(words, least)
    every, is_rare = _joined(grams, np.uint64), _joined(rare, bool)
    item = np.repeat(np.arange(len(ids)), [len(g) for g in grams])
    at = _joined([np.arange(len(g)) for g in grams], np.int64)
    seeds = np.flatnonzero(is_rare)
    seeds = seeds[np.argsort(every[seeds], kind="stable")]
    others, other = np.unique(every[~is_rare], return_inverse=True)
    ends = np.searchsorted(item[~is_rare], np.arange(len(ids) + 1))
    size = np.array([len(w) for w in words], np.int64)
    need, slack = (np.array([r[i] for r in rules], np.int64) for i in (1, 2))
    return Block(
        ids, words, rare, least, Grams.of(every[seeds]), item[seeds], at[seeds], Grams.of(others), other.reshape(-1), at[~is_rare], ends, need, size, slack
    )


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: score, first and one past the last word in ``text``.

    One row per item word; the running maximum along a row stands for gaps in it.
    """
    n = len(text)
    score = np.zeros(n + 1, np.int64)
    begin = np.arange(n + 1)
    steps = np.arange(n + 1) * -GAP
    best = (0, 0, 0)
    for word in item:
        diagonal = score[:-1] + np.where(text == word, MATCH, MISMATCH)
        up = score[1:] + GAP
        take = diagonal >= up
        row = np.concatenate(([0], np.where(take, diagonal, up)))
        origin = np.concatenate(([0], np.where(take, begin[:-1], begin[1:])))
        fresh = row <= 0
        row[fresh] = 0
        origin[fresh] = np.arange(n + 1)[fresh]
        lifted = row + steps
        source = np.maximum.accumulate(np.where(lifted == np.maximum.accumulate(lifted), np.arange(n + 1), 0))
        across = lifted[source] - steps
        begin = np.where(across > row, origin[source], origin)
        score = np.maximum(across, row)
        end = int(np.argmax(score))
        if score[end] > best[0]:
            best = (int(score[end]), int(begin[end]), end)
    return best


@functools.cache
def _price(least: float) -> tuple[int, int]:
    """(worth of a score of 1, cost of an item word) in whole numbers."""
    part = Fraction(least).limit_denominator(1000)
    return part.denominator, MATCH * part.numerator


def may_hold(item: np.ndarray, text: np.ndarray, least: float, shortest: int = PASSAGE_WORDS) -> bool:
    """Whether the item's words that are anywhere in ``text`` could make a passage, whatever their order."""
    unit, cost = _price(least)
    there = (item[:, None] == text).any(1) if len(text) < 1000 else np.isin(item, text)
    sums = np.concatenate(([0], np.cumsum(np.where(there, MATCH * unit - cost, max(MISMATCH, GAP) * unit - cost))))
    return len(item) >= shortest and bool((sums[shortest:] >= np.minimum.accumulate(sums)[: len(sums) - shortest]).any())


def passage(item: np.ndarray, text: np.ndarray, least: float, shortest: int = PASSAGE_WORDS) -> tuple[float, int, int, int] | None:
    """The stretch of at least ``shortest`` item words whose alignment is furthest above
    ``least`` of its own best score: share, words in the item, first and one past the last word in ``text``.

    Every item word costs what it must bring, so a score of 0 is just enough. One
    layer for each length up to ``shortest``, the last one for all that are longer.
    """
    unit, cost = _price(least)
    n = len(text)
    columns = np.arange(n + 1)
    steps = columns * (-GAP * unit)
    low = -(1 << 50)
    score = np.full((shortest + 1, n + 1), low)
    origin = np.zeros((shortest + 1, n + 1), np.int64)
    best = None
    most = -1
    for i, word in enumerate(item):
        score[0], origin[0] = 0, i * (n + 1) + columns
        before, source = score[:-1].copy(), origin[:-1].copy()
        longer = score[-1] > before[-1]
        before[-1][longer], source[-1][longer] = score[-1][longer], origin[-1][longer]
        row, start = before + (GAP * unit - cost), source.copy()
        diagonal = before[:, :-1] + (np.where(text == word, MATCH, MISMATCH) * unit - cost)
        take = diagonal >= row[:, 1:]
        row[:, 1:][take], start[:, 1:][take] = diagonal[take], source[:, :-1][take]
        lifted = row + steps
        top = np.maximum.accumulate(lifted, axis=1)
        at = np.maximum.accumulate(np.where(lifted == top, columns, 0), axis=1)
        score[1:], origin[1:] = top - steps, np.take_along_axis(start, at, 1)
        end = int(np.argmax(score[-1]))
        if score[-1, end] > most:
            most = int(score[-1, end])
            first, begin = divmod(int(origin[-1, end]), n + 1)
            words = i + 1 - first
            best = ((most + cost * words) / (unit * MATCH * words), words, begin, end)
    return best


@dataclass
class Hits:
    """N-grams of items found in texts, in order of item, text and place."""

    item: np.ndarray
    at: np.ndarray
    where: np.ndarray
    text: np.ndarray
    place: np.ndarray


    def order(self) -> Hits:
        by = np.argsort(self.place, kind="stable")
        return Hits(*(x[by] for x in (self.item, self.at, self.where, self.text, self.place)))


def _hits(block: Block, hashes: np.ndarray, counts: np.ndarray) -> Hits | None:
    """All n-grams of items that a leak could hold: the seeds, and around each of them
    the others of its item. None if too many seeds are found for all items at once."""
    ends = np.cumsum(counts)
    starts = ends - counts
    apart = int(block.reach.max(initial=0)) + 8 * PASSAGE_WORDS

    def hits(item: np.ndarray, at: np.ndarray, where: np.ndarray) -> Hits:
        text = np.searchsorted(ends, where, "right")
        return Hits(item, at, where, text, item * (len(hashes) + (len(counts) + 1) * apart) + where + text * apart)

    def found(grams: Grams) -> tuple[np.ndarray, ...]:
        one, two = grams.matches(chain_hash(hashes, 1)), grams.matches(chain_hash(hashes, 2))
        whole = ~np.isin(two[0] + 1, ends)  # not from one text into the next
        return tuple(np.concatenate([x, y[whole]]) for x, y in zip(one, two))

    place, low, n = found(block.seeds)
    if n.sum() > MOST_PAIRS and len(block.ids) > 1:
        return None
    row, which = _expand(low, n)
    seeds = hits(block.item[which], block.at[which], place[row]).order()
    if not len(seeds.item) or not len(block.other):
        return seeds
    reach = block.reach[seeds.item]
    fresh = np.concatenate(([True], (np.diff(seeds.item) != 0) | (np.diff(seeds.text) != 0) | (np.diff(seeds.place) > 2 * reach[1:])))
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(fresh)) - 1
    item, text = seeds.item[first], seeds.text[first]
    begin = np.maximum(seeds.where[first] - reach[first], starts[text])
    end = np.minimum(seeds.where[last] + reach[first] + 1, ends[text])
    stretch, own = _expand(block.other_ends[item], block.other_ends[item + 1] - block.other_ends[item])
    place, which, _ = found(block.others)
    lists = np.sort(which * (len(hashes) + 1) + place)
    base = block.other[own] * (len(hashes) + 1)
    low = np.searchsorted(lists, base + begin[stretch])
    row, which = _expand(low, np.searchsorted(lists, base + end[stretch]) - low)
    others = hits(item[stretch][row], block.other_at[own][row], lists[which] % (len(hashes) + 1))
    return Hits(*(np.concatenate([getattr(x, f) for x in (seeds, others)]) for f in ("item", "at", "where", "text", "place"))).order()


def _regions(block: Block, hits: Hits, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, from, to) stretches of texts that hold enough of an item's seeds
    close to each other, overlapping ones joined."""
    need = block.need[hits.item]
    upto = np.searchsorted(hits.place, hits.place + (block.size + block.slack)[hits.item], "right")
    dense = np.flatnonzero(upto - np.arange(len(need)) >= need)
    marks = np.zeros(len(need) + 1, np.int64)
    np.add.at(marks, dense, 1)
    np.add.at(marks, upto[dense], -1)
    chosen = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
    item, text, at = hits.item[chosen], hits.text[chosen], hits.at[chosen]
    begin = hits.where[chosen] - at
    low = np.maximum(begin - block.slack[item], starts[text])
    high = np.minimum(begin + block.size[item] + block.slack[item], ends[text])
    order = np.lexsort((low, text, item))
    region: tuple[int, int, int, int] | None = None
    seen: set[int] = set()
    for t, i, a, b, q in zip(*(x[order].tolist() for x in (text, item, low, high, at))):
        if region is not None and region[:2] == (t, i) and a <= region[3]:
            region = (t, i, region[2], max(b, region[3]))
            seen.add(q)
            continue
        if region is not None and len(seen) >= block.need[region[1]]:
            yield region
        region, seen = (t, i, a, b), {q}
    if region is not None and len(seen) >= block.need[region[1]]:
        yield region


def _boxes(block: Block, hits: Hits, starts: np.ndarray, ends: np.ndarray, least: float) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(text, item, from, to, item from, item to) stretches around seeds of which a
    passage may hold as many as it must, overlapping ones joined."""
    longest = 2 * PASSAGE_WORDS - 1
    span = longest + bounds(longest, least)[2]
    marked = block.size[hits.item] >= PASSAGE_WORDS
    if bounds(PASSAGE_WORDS, least)[:2] >= (2, 2):
        pair = np.zeros(len(marked), bool)
        lag = 1
        while lag < len(marked):
            near = np.flatnonzero(marked[lag:] & (hits.place[lag:] - hits.place[:-lag] < span))
            if not len(near):
                break
            on = hits.at[near + lag] - hits.at[near]
            near = near[(on > 0) & (on < longest) & (hits.where[near + lag] > hits.where[near])]
            pair[near] = pair[near + lag] = True
            lag += 1
        marked = pair
    box: list[int] | None = None
    chosen = np.flatnonzero(marked)
    item, text, at, where = hits.item[chosen], hits.text[chosen], hits.at[chosen], hits.where[chosen]
    low, high = np.maximum(where - span, starts[text]), np.minimum(where + span + 1, ends[text])
    first, last = np.maximum(at - longest, 0), np.minimum(at + longest + 1, block.size[item])
    for t, i, a, b, c, d in zip(*(x.tolist() for x in (text, item, low, high, first, last))):
        if box is not None and box[:2] == [t, i] and a <= box[3] and c <= box[5] and box[4] <= d:
            box[3:] = max(b, box[3]), min(c, box[4]), max(d, box[5])
            continue
        if box is not None:
            yield tuple(box)
        box = [t, i, a, b, c, d]
    if box is not None:
        yield tuple(box)


def _aligned(block: Block, hashes: np.ndarray, counts: np.ndarray, least: float) -> list[tuple]:
    """(text, item, and the rest of a row of SCHEMA) for all leaks of texts."""
    ends = np.cumsum(counts)
    starts = ends - counts
    hits = _hits(block, hashes, counts)
    if hits is None:
        first, second = block.halves()
        late = [(t, i + len(first.ids), *x) for t, i, *x in _aligned(second, hashes, counts, least)]
        return sorted(_aligned(first, hashes, counts, least) + late, key=lambda x: x[:2])
    whole: dict[tuple[int, int], tuple[float, int, int]] = {}
    for t, i, a, b in _regions(block, hits, starts, ends):
        score, first, last = align(block.words[i], hashes[a:b])
        share = score / (MATCH * len(block.words[i]))
        if share >= least and share > whole.get((t, i), (0.0,))[0]:
            whole[t, i] = (share, a + first, a + last)
    parts: dict[tuple[int, int], tuple[float, float, int, int, int]] = {}
    for t, i, a, b, c, d in _boxes(block, hits, starts, ends, least):
        if not may_hold(block.words[i][c:d], hashes[a:b], least):
            continue
        found = passage(block.words[i][c:d], hashes[a:b], least)
        if found is not None:
            share, n, first, last = found
            over = (share - least) * n
            if (t, i) not in parts or over > parts[t, i][0]:
                parts[t, i] = (over, share, n, a + first, a + last)
    out: list[tuple] = []
    for t, i in sorted({*whole, *parts}):
        _, share, n, first, last = parts.get((t, i), (None,) * 5)
        if (t, i) not in whole:
            reach = int(block.size[i] + block.slack[i])
            score, _, _ = align(block.words[i], hashes[max(first - reach, starts[t]) : min(last + reach, ends[t])])
            whole[t, i] = (score / (MATCH * len(block.words[i])), first, last)
        similarity, a, b = whole[t, i]
        out.append((t, i, similarity, a - int(starts[t]), b - int(starts[t]), share, n))
    return out


SCHEMA = "doc_id long, item long, similarity double, start_word int, end_word int, passage double, passage_words int"


def occurrences(texts: DataFrame, grams: np.ndarray) -> np.ndarray:
    """How often each of the n-grams (distinct hashes in order) is in the texts, in one
    pass; a partition sends one row for each that it holds."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(Grams.of(grams))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        total = np.zeros(len(known.hashes), np.int64)
        for batch in text_windows(batches):
            hashes, _ = word_hashes([plain(t) for t in texts_of(batch)])
            for n in (1, 2):
                np.add.at(total, known.matches(chain_hash(hashes, n))[1], 1)
        held = np.flatnonzero(total)
        for a in range(0, len(held), 1 << 16):
            part = held[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["at", "n"])

    got = texts.select("text").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(grams), np.int64)
    out[got["at"].to_numpy()] = got["n"].to_numpy()
    shared.unpersist()
    return out


def _blocks(items: DataFrame, texts: DataFrame, least: float) -> Iterator[Broadcast]:
    """The items as broadcast blocks, with seeds that are rare in ``texts``; at least one, if an empty one."""
    items = items.select("item_id", "text").where("text is not null")
    words = items.agg(F.sum(F.size(F.split("text", r"\W+"))).alias("n")).first()["n"] or 0
    blocks = max(1, -(-int(words) // BLOCK_WORDS))
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        own = item_words([r["text"].encode() for r in part])
        grams = item_grams(own, least)
        distinct, shared_by = np.unique(_joined(grams, np.uint64), return_counts=True)
        cost = occurrences(texts, distinct) * shared_by if len(distinct) else shared_by
        rare = [rare_grams(cost[np.searchsorted(distinct, g)], len(w), least) for g, w in zip(grams, own)]
        yield items.sparkSession.sparkContext.broadcast(block_of([r["item_id"] for r in part], own, rare, least))


def leaks(docs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """One row per document and item that align: see SCHEMA (``item`` is item_id).

    ``docs`` has doc_id and text, ``items`` item_id and text.
    """
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    texts = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null"))
    result = None
    for shared in _blocks(items, texts, least):

        def match(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in text_windows(batches):
                hashes, counts = word_hashes([plain(t) for t in texts_of(batch)])
                found = _aligned(block, hashes, counts, least)
                rows = [(batch.column(0)[t].as_py(), block.ids[i], *x) for t, i, *x in found]
                if rows:
                    types = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(zip(*rows), types)], names=names)

        got = texts.mapInArrow(match, SCHEMA)
        result = got if result is None else result.unionByName(got)
    return result.withColumnRenamed("item", "item_id")


def clean(docs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """``docs`` without those whose id is that of one that holds a leak; rows without an id stay (see :func:`clean_rows`)."""
    return docs.join(leaks(docs, items, least).select(F.col("doc_id").alias("_leak")).distinct(), F.col("doc_id") == F.col("_leak"), "left_anti")


def _flag(shared: Broadcast, least: float):
    """Whether a text holds a leak of an item of the block."""

    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        hashes, counts = word_hashes([plain(t.encode()) if t else None for t in texts])
        found = np.zeros(len(texts), bool)
        found[[t for t, *_ in _aligned(shared.value, hashes, counts, least)]] = True
        return pd.Series(found)

    return run.asNondeterministic()


def clean_rows(docs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """``docs`` without the rows whose own text holds a leak, whatever their id, or none."""
    docs = spread(docs)
    for shared in _blocks(items, docs.where("text is not null"), least):
        docs = docs.where(~_flag(shared, least)("text"))
    return docs
