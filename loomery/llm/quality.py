"""Document quality by a factorisation machine.

score = sigmoid(b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j) over hashed words,
structure statistics and metadata (the text's length). The pair term is computed
in linear time, per factor, as half of (sum v x)^2 - sum (v x)^2.

Training: Adagrad on a bounded sample of labelled rows, in parallel over a fixed
number of partitions whose models are averaged after each round.

Results for odd input: a null text scores as an empty one, and empty texts have a
score of their own (length and word statistics of nothing). Labels other than 0
and 1, and labels without a document, are skipped; a document labelled twice
counts twice. Without usable labels every score is 0.5. Repeated rows score
alike. Other columns are carried through untouched.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm.common import averaged_rounds, bounded_sample, sigmoid, spread, store, text_windows, texts_of

TRAIN_ROWS = 20_000  # the bound of the training sample
SHARDS = 6
ROUNDS = 10
WORD_SLOTS = 1 << 15
FACTORS = 4
BINS = 12
KNOWN_WORDS = 100_000

_PUNCT = frozenset(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_IS = np.zeros((5, 256), bool)
_IS[0, list(_PUNCT)] = True
_IS[1, 0x30:0x3A] = True
_IS[2, 0x41:0x5B] = True
_IS[3, [0x0A]] = True
_IS[4, 0x80:] = True
_CLASS = np.full(256, 5, np.uint8)
for _i in range(5):
    _CLASS[_IS[_i]] = _i
_EASY = frozenset(b".,;'-")

STATS = ("words", "mean_word", "symbols", "digits", "capitals", "line_words", "top_share", "distinct_share", "lone_symbols", "end_marks", "spread_chars", "echoes", "shouts", "length")
SLOTS = WORD_SLOTS + len(STATS) * BINS


def _bin(share: float) -> int:
    """0 to 11, finer near 0 and 1."""
    edges = (0.001, 0.01, 0.03, 0.06, 0.1, 0.2, 0.35, 0.5, 0.7, 0.85, 0.95)
    return sum(share >= e for e in edges)


def _log_bin(n: float, step: float = 1.0) -> int:
    return int(min(BINS - 1, np.log2(1.0 + n) / step))


class Features:
    """Slots and values of a text; slots of words are kept, to a bound."""

    def __init__(self):
        self.slots: dict[bytes, int] = {}

    def slot(self, word: bytes) -> int:
        got = self.slots.get(word)
        if got is None:
            if len(self.slots) >= KNOWN_WORDS:
                self.slots.clear()
            got = self.slots[word] = zlib.crc32(word) % WORD_SLOTS
        return got

    def __call__(self, text: bytes | None, length: int) -> tuple[np.ndarray, np.ndarray]:
        text = text or b""
        words = text.lower().split()
        counts = Counter(words)
        n = len(words)
        kinds = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=6) if text else np.zeros(6)
        size = max(len(text), 1)
        hard = size - len(text.translate(None, b"!\"#$%&()*+/:<=>?@[\\]^_`{|}~"))
        lines = kinds[3] + 1
        lone = sum(c for w, c in counts.items() if len(w) <= 3 and not w.isalnum() and w[0] < 0x80)
        stats = (
            _log_bin(n),
            int(min(BINS - 1, (size / max(n, 1)) / 1.5)),
            _bin(hard / size),
            _bin(kinds[1] / size),
            _bin(kinds[2] / size),
            _log_bin(n / lines),
            _bin(max(counts.values()) / n if n > 9 else 0.0),
            _bin(len(counts) / n if n > 9 else 1.0),
            _bin(lone / max(n, 1)),
            _bin((text.count(b".") + text.count(b"!") + text.count(b"?")) / max(n, 1)),
            _bin(len(set(text)) / 128),
            _bin(sum(map(eq, words, words[1:])) / n if n else 0.0),
            _bin(text.count(b"!!") / max(n, 1)),
            _log_bin(length, 1.6),
        )
        slots = np.fromiter((self.slot(w) for w in counts), np.int64, len(counts))
        values = np.fromiter(counts.values(), np.float32, len(counts))
        if n:
            values = np.sqrt(values) / np.sqrt(n)  # a unit vector
        base = WORD_SLOTS + np.arange(len(STATS)) * BINS
        return np.concatenate([slots, base + np.array(stats)]), np.concatenate([values, np.ones(len(STATS), np.float32)])


@dataclass
class Machine:
    bias: np.ndarray
    linear: np.ndarray
    factors: np.ndarray

    def margins(self, slots: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One value per row; rows are the non-empty runs from ``starts``."""
        x = values.astype(np.float32)[:, None]
        vx = self.factors[slots] * x
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat(vx * vx, starts, axis=0)
        flat = np.add.reduceat(self.linear[slots] * x[:, 0], starts)
        return self.bias[0] + flat + 0.5 * (sums * sums - squares).sum(1)


def featurise(df: DataFrame, label: str) -> DataFrame:
    """label, slots and values of rows with text and n_chars columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in text_windows(batches):
            got = [features(t, n or 0) for t, n in zip(texts_of(batch), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(2),
                    pa.array([s.astype(np.int32).tobytes() for s, _ in got], pa.binary()),
                    pa.array([v.astype(np.float32).tobytes() for _, v in got], pa.binary()),
                ],
                names=["label", "slots", "values"],
            )

    return df.select("text", "n_chars", F.col(label).cast("int").alias("label")).mapInArrow(run, "label int, slots binary, values binary")


def _step(batches: Iterator[pa.RecordBatch], model: dict[str, np.ndarray], round_: int, rate: float = 0.2, rows_at_once: int = 32):
    """One pass of Adagrad over a partition's rows."""
    labels, slots, values = [], [], []
    for b in batches:
        labels += b.column(0).to_pylist()
        slots += [np.frombuffer(x, np.int32) for x in b.column(1).to_pylist()]
        values += [np.frombuffer(x, np.float32) for x in b.column(2).to_pylist()]
    if not labels:
        return model, 0.0
    m = Machine(model["bias"], model["linear"], model["factors"])
    y = np.array(labels, np.float32)
    share = float(np.clip(y.mean(), 0.02, 0.98))
    pull = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))  # both labels weigh the same
    seen = {k: np.full_like(v, 0.1) for k, v in model.items()}
    order = np.random.default_rng(round_).permutation(len(y))
    for i in range(0, len(order), rows_at_once):
        pick = order[i : i + rows_at_once]
        s = np.concatenate([slots[j] for j in pick])
        x = np.concatenate([values[j] for j in pick])
        sizes = np.array([len(slots[j]) for j in pick])
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        error = (sigmoid(m.margins(s, x, starts)) - y[pick]) * pull[pick] / len(pick)
        each = np.repeat(error, sizes).astype(np.float32)
        vx = m.factors[s] * x[:, None]
        sums = np.repeat(np.add.reduceat(vx, starts, axis=0), sizes, axis=0)
        touched, where = np.unique(s, return_inverse=True)
        g_linear = np.bincount(where, weights=each * x, minlength=len(touched)) + 1e-5 * m.linear[touched]
        g_raw = (each * x)[:, None] * (sums - vx)
        g_factors = np.stack([np.bincount(where, weights=g_raw[:, f], minlength=len(touched)) for f in range(g_raw.shape[1])], 1) + 1e-5 * m.factors[touched]
        for name, grad, pace in (("linear", g_linear, rate), ("factors", g_factors, rate / 3)):
            table, past = getattr(m, name), seen[name]
            past[touched] += grad * grad * 100
            table[touched] -= (pace * grad / np.sqrt(past[touched])).astype(np.float32)
        g = float(error.sum())
        seen["bias"] += g * g
        m.bias -= np.float32(rate * g) / np.sqrt(seen["bias"])
    return {"bias": m.bias, "linear": m.linear, "factors": m.factors}, float(len(y))


def train(labelled: DataFrame, label: str = "label", most: int = TRAIN_ROWS, rounds: int = ROUNDS) -> Machine:
    """From rows of doc_id, text, n_chars and a 0/1 label."""
    usable = labelled.where(F.col(label).isin(0, 1))
    features = store(featurise(bounded_sample(usable, most).repartition(SHARDS), label), "quality-features")
    rng = np.random.default_rng(3)
    model = {
        "bias": np.zeros(1, np.float32),
        "linear": np.zeros(SLOTS, np.float32),
        "factors": rng.normal(0, 0.02, (SLOTS, FACTORS)).astype(np.float32),
    }
    model = averaged_rounds(features, model, _step, rounds)
    if not model["linear"].any():  # nothing was learnt
        model["factors"] = np.zeros_like(model["factors"])
    return Machine(model["bias"], model["linear"], model["factors"])


def scorer(df: DataFrame, machine: Machine):
    """A Column function (text, n_chars) -> score."""
    shared = df.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        features = Features()
        for texts, lengths in batches:
            out = np.empty(len(texts))
            for i in range(0, len(texts), 64):
                got = [
                    features(None if t is None else t.encode("utf-8", "replace"), 0 if pd.isna(n) else int(n))
                    for t, n in zip(texts[i : i + 64], lengths[i : i + 64])
                ]
                sizes = np.array([len(s) for s, _ in got])
                starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                out[i : i + 64] = sigmoid(shared.value.margins(np.concatenate([s for s, _ in got]), np.concatenate([v for _, v in got]), starts))
            yield pd.Series(out)

    return score


def score(df: DataFrame, machine: Machine, out: str = "score") -> DataFrame:
    """``df`` (text, n_chars, any others) with the score; a null n_chars is the text's length."""
    return spread(df).withColumn(out, scorer(df, machine)("text", F.coalesce(F.col("n_chars"), F.length("text").cast("long"))))
