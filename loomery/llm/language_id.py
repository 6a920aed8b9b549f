"""Language identification with error-correcting output codes.

Every language gets a codeword; one binary n-gram classifier per bit tells the
languages whose bit is 1 from those whose bit is 0, by log-likelihood ratios of
hashed character n-grams (1 to 4) counted over all training texts. Decoding
takes the codeword with the least weighted logistic loss; the weights are the
classifiers' divergences, so telling bits count more. Two codewords that lie
close together flag the text as ambiguous.

Results for odd input: a null text, or one without letters, gives ``und`` with
score 0; no training rows at all gives ``und`` everywhere; a single training
language is always predicted. Repeated rows are scored alike; ties go to the
language that sorts first. Other columns are carried through untouched.
"""

from __future__ import annotations

import itertools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.llm.common import spread, text_windows

UNKNOWN = "und"
ORDERS = (1, 2, 3, 4)
SLOT_BITS = 15  # per order
SLOTS = len(ORDERS) << SLOT_BITS
SHARPNESS = 8.0  # scale of a mean log ratio as a margin
SHORT = 12.0  # n-grams that draw the margins of very short texts to 0
AMBIGUOUS = 0.5  # least loss between the two nearest codewords

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """2 for letters, 1 for the marks that go with them, else 0."""
    if not _letters:
        _letters.append(np.fromiter(("ML".find(unicodedata.category(chr(i))[0]) + 1 for i in range(0x10000)), np.int8, 0x10000))
    return _letters[0]


def ngram_slots(text: str) -> np.ndarray:
    """Slots of the n-grams over lower-cased letters; other runs become one mark."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    low = codes < 0x10000
    kind = np.where(low, _letter_table()[codes & 0xFFFF], 0)
    if not low.all():
        kind[~low] = [2 * chr(c).isalpha() for c in codes[~low]]
    if not (kind == 2).any():
        return np.empty(0, np.int64)
    letter = kind > 0
    codes = np.where(letter, codes, 0)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    codes = np.concatenate(([np.uint32(0)], codes[keep], [np.uint32(0)])).astype(np.uint32)
    out = []
    gram = codes * np.uint32(0x9E3779B1) + np.uint32(0x85EBCA6B)
    base = gram
    for order, n in enumerate(ORDERS):
        if n > 1:
            gram = gram[:-1] * np.uint32(0x2C1B3C6D) + base[n - 1 :]
        if not len(gram):
            break
        spun = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x297A2D39)
        out.append((spun >> np.uint32(32 - SLOT_BITS)).astype(np.int64) + (order << SLOT_BITS))
    return np.concatenate(out)


def codebook(classes: int) -> np.ndarray:
    """0/1 codewords as rows. All different splits for up to seven classes, else
    the best-separated of 64 drawn codes of 10 log2 K bits."""
    if classes <= 1:
        return np.ones((classes, 1), np.int8)
    if classes <= 7:
        splits = [(1, *rest) for rest in itertools.product((0, 1), repeat=classes - 1) if not all(rest)]
        return np.array(splits, np.int8).T.copy()
    rng = np.random.default_rng(7)
    length = int(np.ceil(10 * np.log2(classes)))
    best, gap = None, -1
    for _ in range(64):
        code = rng.integers(0, 2, (classes, length), dtype=np.int8)
        code[0, code.sum(0) == 0] = 1
        code[0, code.sum(0) == classes] = 0
        apart = min(int((code[i] != code[j]).sum()) for i in range(classes) for j in range(i))
        if apart > gap:
            best, gap = code, apart
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits, 0/1
    ratios: np.ndarray  # slots x bits, log likelihood ratios
    weights: np.ndarray  # per bit


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Counts over all rows of ``labelled`` with a text and a language.

    Languages weigh the same however many texts they have. The driver gets one
    row per slot (a fixed number), never one per text.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(F.length("text") + 1).alias("n")).collect()}
    languages = sorted(sizes)
    code = codebook(len(languages))
    bits = code.shape[1] if languages else 1
    if not languages:
        return Model([], np.zeros((0, 1), np.int8), np.zeros((SLOTS, 1), np.float32), np.ones(1))
    number = {name: i for i, name in enumerate(languages)}
    even = np.array([1e9 / sizes[name] for name in languages])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS)
        ones = np.zeros((bits, SLOTS))
        for batch in text_windows(batches):
            by_lang: dict[str, list[np.ndarray]] = {}
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_lang.setdefault(name, []).append(ngram_slots(t))
            for name, parts in by_lang.items():
                seen = np.bincount(np.concatenate(parts), minlength=SLOTS) * even[number[name]]
                total += seen
                ones[code[number[name]] == 1] += seen
        slots = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(slots.astype(np.int32)), pa.array(total[slots]), *[pa.array(ones[b][slots]) for b in range(bits)]],
            names=["slot", "total", *[f"bit{b}" for b in range(bits)]],
        )

    names = ["total", *[f"bit{b}" for b in range(bits)]]
    counts = spread(rows).mapInArrow(count, "slot int, " + ", ".join(f"{n} double" for n in names))
    table = counts.groupBy("slot").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    slots = table["slot"].to_numpy()
    total = np.zeros(SLOTS)
    total[slots] = table["total"].to_numpy()
    ratios = np.zeros((SLOTS, bits), np.float32)
    weights = np.ones(bits)
    for b in range(bits):
        one = np.zeros(SLOTS)
        one[slots] = table[f"bit{b}"].to_numpy()
        zero = np.maximum(total - one, 0)
        alpha = max(total.sum(), 1.0) * 1e-7
        p, q = (one + alpha) / (one.sum() + alpha * SLOTS), (zero + alpha) / (zero.sum() + alpha * SLOTS)
        ratios[:, b] = np.log(p) - np.log(q)
        weights[b] = float(((p - q) * ratios[:, b]).sum())
    if len(languages) == 1:
        ratios[:] = 1.0
    weights = np.where(weights > 0, weights, 1e-9)
    return Model(languages, code, ratios, weights * bits / weights.sum())


def decode(model: Model, slots: np.ndarray) -> tuple[str, float, bool]:
    """Nearest codeword by weighted logistic loss: language, score, ambiguous."""
    if not len(slots) or not model.languages:
        return UNKNOWN, 0.0, False
    margins = model.ratios[slots].sum(0, dtype=np.float64) * (SHARPNESS / (len(slots) + SHORT))
    signs = model.code * 2.0 - 1.0
    losses = (np.logaddexp(0.0, -signs * margins) * model.weights).sum(1)
    best = int(np.argmin(losses))
    odds = np.exp(losses[best] - losses)
    second = np.partition(losses, 1)[1] if len(losses) > 1 else np.inf
    return model.languages[best], float(1.0 / odds.sum()), bool(second - losses[best] < AMBIGUOUS)


def predictor(df: DataFrame, model: Model):
    """A Column function text -> struct(lang, score, ambiguous)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, ambiguous boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [(UNKNOWN, 0.0, False) if t is None else decode(shared.value, ngram_slots(t)) for t in texts]
            yield pd.DataFrame(found, columns=["lang", "score", "ambiguous"])

    return predict


def identify(df: DataFrame, model: Model, text: str | Column = "text", out: str = "language") -> DataFrame:
    """``df`` with a struct column ``out`` of lang, score and ambiguous."""
    col = F.col(text) if isinstance(text, str) else text
    # not deterministic, or a filter on the result would run it a second time
    return spread(df).withColumn(out, predictor(df, model).asNondeterministic()(col))
