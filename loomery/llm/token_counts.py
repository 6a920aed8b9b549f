"""Token counts of a sentencepiece BPE model by rank-synchronous merging of ragged arrays.

The vocabulary is read from the model file; the merging is done here, for a batch of
texts at once:

1. Each text is normalised as its model says (prefix, marks for spaces) and cut into
   pre-tokens between two characters that no piece of the vocabulary has side by side.
   No merge can cross such a place, so the cut changes nothing.
2. The distinct pre-tokens of a batch lie in one ragged array of symbols (flat ids and
   the sequence of each). In every round each sequence's lowest-rank pair is merged,
   for all sequences simultaneously; sequences without a pair that merges leave.
3. What survives is counted: a piece is one token, a character that is no piece is one
   token per UTF-8 byte (byte fallback).

The library takes the best pair first and the leftmost of equals. All places of a
sequence's best pair may go in one round if the new symbol is in no pair of the same or a
better rank; else ("unsafe" pieces, as runs of spaces, whose scores are all equal) only
the leftmost goes, and for sequences of more than LONG symbols with such a pair, which
would need a round for each, the same order is kept by a heap.

Memory: texts pass in windows of characters; a longer text is worked on in parts that end
at a cut, so a part is only longer where the text has no cut.

Results for odd input: a null text counts as empty, an empty one has no token and no byte.
Repeated rows are each counted. Ids are not looked at. An empty table gives an empty one.
Strings of special tokens inside texts are ordinary text, as by the library's default.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm.common import _power_tables, mix64, spread, text_windows

PART = 1 << 20  # characters worked on at once
LONG = 256  # symbols of a sequence that may take a round for each merge
NEVER = np.int32(2**31 - 1)  # rank of a pair that doesn't merge


class Vocabulary:
    """Pieces, pairs and cuts of a sentencepiece BPE model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        if not any(model.is_byte(i) for i in ids):
            raise ValueError("the model has no pieces for bytes")
        normal = [i for i in ids if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
        pieces = {model.id_to_piece(i): model.get_score(i) for i in normal}
        chars = sorted(set("".join(pieces)))
        # symbol 0 is every character that no piece has
        self.symbols = {s: i for i, s in enumerate(dict.fromkeys([*chars, *pieces]), 1)}
        n = len(self.symbols) + 1
        self.n_symbols, self.n_chars = n, len(chars) + 1
        order = {score: rank for rank, score in enumerate(sorted(set(pieces.values()), reverse=True))}
        self.of_code = np.zeros(0x110000, np.int32)
        self.of_code[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.tokens = np.ones(n, np.int64)
        for s, i in self.symbols.items():
            if s not in pieces:
                self.tokens[i] = len(s.encode())
        pairs, into, ranks = [], [], []
        for piece, score in pieces.items():
            for at in range(1, len(piece)):
                left, right = self.symbols.get(piece[:at]), self.symbols.get(piece[at:])
                if left and right:
                    pairs.append(left * n + right)
                    into.append(self.symbols[piece])
                    ranks.append(order[score])
        by = np.argsort(np.array(pairs, np.int64))
        self.pairs, self.into, self.ranks = np.array(pairs, np.int64)[by], np.array(into, np.int32)[by], np.array(ranks, np.int32)[by]
        rank = np.full(n, NEVER, np.int32)
        rank[self.into] = self.ranks
        best = np.full(n, NEVER, np.int32)  # best rank of a pair that a symbol is in
        np.minimum.at(best, self.pairs // n, self.ranks)
        np.minimum.at(best, self.pairs % n, self.ranks)
        self.unsafe = (best <= rank) & (rank != NEVER)
        inside = np.zeros(self.n_chars**2, bool)  # characters side by side in a piece
        for piece in pieces:
            own = self.of_code[[ord(c) for c in piece]].astype(np.int64)
            inside[own[:-1] * self.n_chars + own[1:]] = True
        self.inside = np.packbits(inside)

    def joined(self, chars: np.ndarray) -> np.ndarray:
        """For each character but the last: whether a merge could join it to the next."""
        at = chars[:-1].astype(np.int64) * self.n_chars + chars[1:]
        return (self.inside[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of pairs; NEVER where they don't merge."""
        key = left.astype(np.int64) * self.n_symbols + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        found = self.pairs[at] == key
        return np.where(found, self.ranks[at], NEVER), self.into[at]


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge(vocab: Vocabulary, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Tokens of each sequence of a ragged array of symbols (no sequence is empty).

    Symbol 0 has to be counted by the caller; here it counts as one.
    """
    out = np.zeros(len(lengths), np.int64)
    sym = symbols.astype(np.int32)
    seq = np.repeat(np.arange(len(lengths)), lengths)

    def ranked(at: np.ndarray) -> None:
        """Rank and result of the pairs that start at these places."""
        inner = at[(at + 1 < len(sym)) & (seq[np.minimum(at + 1, len(sym) - 1)] == seq[at])]
        rank[at] = NEVER
        rank[inner], into[inner] = vocab.look_up(sym[inner], sym[inner + 1])

    rank, into = np.empty(len(sym), np.int32), np.zeros(len(sym), np.int32)
    ranked(np.arange(len(sym)))
    while len(sym):
        starts = np.flatnonzero(np.diff(seq, prepend=-1))
        sizes = np.diff(starts, append=len(sym))
        least = np.minimum.reduceat(rank, starts)
        of = np.repeat(np.arange(len(starts)), sizes)
        best = (rank == least[of]) & (rank != NEVER)
        unsafe = np.logical_or.reduceat(best & vocab.unsafe[into], starts)
        by_heap = unsafe & (sizes > LONG)
        for i in np.flatnonzero(by_heap):
            out[seq[starts[i]]] += _by_heap(vocab, sym[starts[i] : starts[i] + sizes[i]])
        # equal neighbours overlap: of each run every second place, of an unsafe sequence the first
        run_start = best & ~np.concatenate(([False], best[:-1] & (of[1:] == of[:-1])))
        place = np.arange(len(sym))
        chosen = best & ((place - np.maximum.accumulate(np.where(run_start, place, 0))) % 2 == 0)
        first = np.minimum.reduceat(np.where(best, place, len(sym)), starts)
        chosen &= ~unsafe[of] | (place == first[of])
        done = (least == NEVER) & ~by_heap
        ended = done[of]
        np.add.at(out, seq[ended], vocab.tokens[sym[ended]])
        chosen &= ~by_heap[of]
        sym[chosen] = into[chosen]
        swallowed = np.concatenate(([False], chosen[:-1]))
        stale = chosen | np.concatenate((chosen[1:], [False]))
        keep = ~(swallowed | ended | by_heap[of])
        sym, seq, rank, into, stale = sym[keep], seq[keep], rank[keep], into[keep], stale[keep]
        if len(sym):
            ranked(np.flatnonzero(stale))
    return out


def _by_heap(vocab: Vocabulary, symbols: np.ndarray) -> int:
    """Tokens of one sequence, its pairs taken from a heap by rank and place."""
    sym = symbols.tolist()
    after = list(range(1, len(sym) + 1))
    before = list(range(-1, len(sym) - 1))
    rank, into = vocab.look_up(symbols[:-1], symbols[1:])
    at = np.flatnonzero(rank != NEVER)
    heap = list(zip(rank[at].tolist(), at.tolist(), symbols[at].tolist(), symbols[at + 1].tolist(), into[at].tolist()))
    heapq.heapify(heap)
    known: dict[tuple[int, int], tuple[int, int]] = {}
    while heap:
        _, i, left, right, new = heapq.heappop(heap)
        j = after[i] if sym[i] == left else len(sym)
        if j >= len(sym) or sym[j] != right:
            continue
        sym[i], sym[j] = new, -1
        after[i] = after[j]
        if after[j] < len(sym):
            before[after[j]] = i
        for a in (before[i], i):
            b = after[a] if a >= 0 else len(sym)
            if a >= 0 and b < len(sym):
                pair = (sym[a], sym[b])
                if pair not in known:
                    r, m = vocab.look_up(np.array(pair[:1]), np.array(pair[1:]))
                    known[pair] = (int(r[0]), int(m[0]))
                if known[pair][0] != NEVER:
                    heapq.heappush(heap, (known[pair][0], a, *pair, known[pair][1]))
    left_over = np.array([s for s in sym if s >= 0])
    return int(vocab.tokens[left_over].sum())


def _parts(vocab: Vocabulary, texts: list[str], part: int) -> Iterator[tuple[list[str], list[int]]]:
    """(texts, their numbers) of at most ``part`` characters; long texts in parts that end at a cut."""
    own: list[str] = []
    numbers: list[int] = []
    held = 0
    for number, text in enumerate(texts):
        start = 0
        while start < len(text):
            stop = start + part
            while stop < len(text):
                tail = text[max(start, stop - 4096) : stop + 1]
                cuts = np.flatnonzero(~vocab.joined(vocab.of_code[np.frombuffer(tail.encode("utf-32-le"), np.uint32)]))
                if len(cuts):
                    stop = max(start, stop - 4096) + int(cuts[-1]) + 1
                    break
                stop += 4096
            piece = text[start:stop]
            if held and held + len(piece) > part:
                yield own, numbers
                own, numbers, held = [], [], 0
            own.append(piece)
            numbers.append(number)
            held += len(piece)
            start = stop
    if own:
        yield own, numbers


def count_tokens(vocab: Vocabulary, texts: list[str | None], part: int = PART) -> np.ndarray:
    """Tokens of each text."""
    total = np.zeros(len(texts), np.int64)
    for own, numbers in _parts(vocab, [vocab.model.normalize(t) if t else "" for t in texts], part):
        codes = np.frombuffer("".join(own).encode("utf-32-le"), np.uint32)
        chars = vocab.of_code[codes]
        lengths = np.fromiter(map(len, own), np.int64, len(own))
        edge = np.ones(len(codes), bool)
        edge[1:] = ~vocab.joined(chars)
        edge[np.cumsum(lengths)[:-1]] = True
        starts = np.flatnonzero(edge)
        sizes = np.diff(starts, append=len(codes))
        # a character outside the vocabulary stands alone; its code tells the count of its bytes
        alone = chars[starts] == 0
        up, down = _power_tables(len(codes) + 1)
        with np.errstate(over="ignore"):
            running = np.zeros(len(codes) + 1, np.uint64)
            np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=running[1:])
            keys = mix64((running[starts + sizes] - running[starts]) * down[starts] + sizes.astype(np.uint64))
        _, first, which = np.unique(keys, return_index=True, return_inverse=True)
        tokens = np.zeros(len(first), np.int64)
        lone = alone[first]
        code = codes[starts[first[lone]]]
        tokens[lone] = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        rest = first[~lone]
        if len(rest):
            size = sizes[rest]
            flat = np.repeat(starts[rest] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
            tokens[~lone] = merge(vocab, chars[flat], size)
        of = np.repeat(np.array(numbers), lengths)[starts]
        np.add.at(total, of, tokens[which])
    return total


def with_token_counts(docs: DataFrame, path: str, limit: int, out: str = "tokens") -> DataFrame:
    """``docs`` with a struct ``out``: n_bytes, n_tokens, over_limit (more than ``limit``).

    ``text`` is read, all other columns stay as they are (one named ``out`` is replaced).
    """

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocab = vocabulary(path)
        for column in batches:
            batch = pa.RecordBatch.from_arrays([pa.array(column, pa.string(), from_pandas=True)], names=["text"])
            parts = [count_tokens(vocab, w.column(0).to_pylist()) for w in text_windows([batch])]
            yield pd.Series(np.concatenate(parts) if parts else np.empty(0, np.int64))

    return spread(docs).withColumn(out, counted("text")).withColumn(
        out,
        F.struct(
            F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
            F.col(out).alias("n_tokens"),
            (F.col(out) > limit).alias("over_limit"),
        ),
    )
