"""Toxicity as multiple-instance learning: sentences are the instances of a document.

A sentence scores p = sigmoid(b + sum of its words' weights); a document is
toxic with 1 - prod(1 - p), the noisy-or. Only documents are labelled; the
likelihood of their labels trains the sentence model, which then says where the
offending sentences are. Its words' weights are sums over hashed features: the
word, its beginning, its character 4-grams; runs of marks and capitals have weights too.

Training: Adagrad on a bounded sample of labelled rows, in parallel over a fixed
number of partitions whose models are averaged after each round.

Results for odd input: a null or empty text has no sentences and scores 0 (noisy-or
of nothing). Labels other than 0 and 1, and labels without a document, are
skipped. Without both labels in the sample nothing is learnt and every non-empty
text scores the same small prior. Repeated rows score alike; of equally bad
sentences the first is reported. Other columns are carried through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm.common import _power_tables, averaged_rounds, bounded_sample, mix64, sigmoid, spread, store, text_windows, texts_of

TRAIN_ROWS = 20_000  # the bound of the training sample
SHARDS = 6
ROUNDS = 6
SLOT_BITS = 18
SLOTS = 1 << SLOT_BITS
WINDOW = 1 << 20
PRIOR = -7.0  # bias of a sentence before training
OFFENDING = 0.5  # least score of a sentence that is reported

_IS_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?\n")] = True
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\x0b\x0c\r")] = True


@dataclass
class Instances:
    """The sentences (with a word) of a batch of texts and their slots, in order."""

    text: np.ndarray  # of each sentence
    begin: np.ndarray  # byte offsets in its text
    end: np.ndarray
    slots: np.ndarray
    sizes: np.ndarray  # slots per sentence


def _slots(values: np.ndarray, part: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix64(values + np.uint64(part) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int32)


def instances(texts: list[bytes | None]) -> Instances:
    """Sentences end with . ! ? or a line; a word counts once in a sentence. All on
    byte arrays of the whole batch: no Python object per word."""
    parts = [t or b"" for t in texts]
    raw = np.frombuffer(b"\n".join([b"", *parts, b"    "]), np.uint8)
    data = np.frombuffer(raw.tobytes().lower(), np.uint8)
    word = _IS_WORD[data]
    edge = np.diff(word.astype(np.int8))
    start, stop = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    ends = _ENDS[data]
    first = np.flatnonzero(ends[:-1] & ~ends[1:]) + 1  # where sentences begin
    of = np.searchsorted(first, start, "right") - 1
    if not len(start):
        none = np.empty(0, np.int64)
        return Instances(none, none, none, none, none)
    up, down = _power_tables(len(data) + 1)
    with np.errstate(over="ignore"):
        running = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=running[1:])

        def hashed(a, b):
            return mix64((running[b] - running[a]) * down[a])

        whole = hashed(start, stop)
        _, once = np.unique(mix64(whole + of.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), return_index=True)
        once.sort()
        start, stop, whole, own = start[once], stop[once], whole[once], of[once]
        slots, where = [_slots(whole, 1)], [own]
        for n in (4, 5, 6):
            long = stop - start > n
            slots.append(_slots(hashed(start[long], start[long] + n), n))
            where.append(own[long])
        shown = np.where(word, data, 0x20).astype(np.uint64)
        four = shown[:-3] | shown[1:-2] << np.uint64(8) | shown[2:-1] << np.uint64(16) | shown[3:] << np.uint64(24)
        grams = np.maximum(stop - start - 1, 0)
        at = np.arange(grams.sum()) + np.repeat(start - 1 - (np.cumsum(grams) - grams), grams)
        slots.append(_slots(four[at], 8))
        where.append(np.repeat(own, grams))
        # how it is said: runs of marks, and capitals only
        mark = ~word & ~_BLANK[data]
        turn = np.diff(np.concatenate(([0], mark.astype(np.int8), [0])))
        a, b = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        several = b - a > 1
        a, b = a[several], b[several]
        runs, owner = hashed(a, np.minimum(b, a + 4)), np.searchsorted(first, a, "right") - 1
        _, once = np.unique(mix64(runs + owner.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), return_index=True)
        slots.append(_slots(runs[once], 9))
        where.append(owner[once])
        bounds = np.append(first, len(raw))
        capitals = np.concatenate(([0], np.cumsum((raw >= 0x41) & (raw <= 0x5A))))
        smalls = np.concatenate(([0], np.cumsum((raw >= 0x61) & (raw <= 0x7A))))
        loud = np.flatnonzero((np.diff(capitals[bounds]) > 1) & (np.diff(smalls[bounds]) == 0))
        slots.append(_slots(np.zeros(len(loud), np.uint64), 10))
        where.append(loud)
    slot, sentence = np.concatenate(slots), np.concatenate(where)
    spoken = np.zeros(len(first), bool)
    spoken[own] = True
    keep = (sentence >= 0) & spoken[np.maximum(sentence, 0)]
    slot, sentence = slot[keep], sentence[keep]
    order = np.argsort(sentence, kind="stable")
    sizes = np.bincount(sentence, minlength=len(first))[spoken]
    begins = np.cumsum([1] + [len(t) + 1 for t in parts])
    text = np.searchsorted(begins, first[spoken], "right") - 1
    stops = np.append(first[1:], len(raw))[spoken]
    limit = begins[text] + np.array([len(t) for t in parts])[text]
    return Instances(text, first[spoken] - begins[text], np.minimum(stops, limit) - begins[text], slot[order], sizes)


@dataclass
class Model:
    bias: np.ndarray
    weights: np.ndarray


def featurise(df: DataFrame, label: str) -> DataFrame:
    """label, slots, and for every sentence the number of its slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_windows(batches, limit=WINDOW):
            got = instances(texts_of(batch))
            sentence_ends = np.searchsorted(got.text, np.arange(batch.num_rows + 1))
            slot_ends = np.concatenate(([0], np.cumsum(got.sizes)))[sentence_ends]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1),
                    pa.array([got.slots[a:b].astype(np.int32).tobytes() for a, b in zip(slot_ends, slot_ends[1:])], pa.binary()),
                    pa.array([got.sizes[a:b].astype(np.int32).tobytes() for a, b in zip(sentence_ends, sentence_ends[1:])], pa.binary()),
                ],
                names=["label", "slots", "sizes"],
            )

    return df.select("text", F.col(label).cast("int").alias("label")).mapInArrow(run, "label int, slots binary, sizes binary")


def _step(batches: Iterator[pa.RecordBatch], model: dict[str, np.ndarray], round_: int, rate: float = 0.5):
    """One pass over a partition's documents. For label 1 the gradient of
    -log(1 - prod(1 - p)) by a sentence's margin is -p (1 - P) / P; for label 0 it is p."""
    docs = []
    for b in batches:
        for y, s, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            if n:
                docs.append((y, np.frombuffer(s, np.int32), np.frombuffer(n, np.int32)))
    if not docs:
        return model, 0.0
    bias, weights = model["bias"], model["weights"]
    past = np.full(SLOTS, 1.0, np.float32)
    past_bias = 10.0
    for j in np.random.default_rng(round_).permutation(len(docs)):
        y, s, n = docs[j]
        starts = np.concatenate(([0], np.cumsum(n)[:-1]))
        z = bias[0] + np.add.reduceat(weights[s], starts)
        p = sigmoid(z)
        clear = float(np.log1p(-np.minimum(p.astype(np.float64), 1 - 1e-6)).sum())
        whole = -np.expm1(clear)
        g = p if y == 0 else -p * (1 - whole) / max(whole, 1e-9)
        if abs(g).max() < 1e-4:
            continue
        each = np.repeat(g, n).astype(np.float32)
        grad = np.bincount(s, weights=each, minlength=0)
        touched = np.flatnonzero(grad)
        grad = grad[touched].astype(np.float32)
        past[touched] += grad * grad
        weights[touched] -= rate * grad / np.sqrt(past[touched])
        total = float(g.sum())
        past_bias += total * total
        bias -= np.float32(0.05 * total / np.sqrt(past_bias))
    return {"bias": bias, "weights": weights}, float(len(docs))


def train(labelled: DataFrame, label: str = "label", most: int = TRAIN_ROWS, rounds: int = ROUNDS) -> Model:
    """From rows of doc_id, text and a 0/1 label."""
    usable = labelled.where(F.col(label).isin(0, 1))
    features = store(featurise(bounded_sample(usable, most).repartition(SHARDS), label), "toxicity-features")
    kinds = {r["label"] for r in features.select("label").distinct().collect()}
    model = {"bias": np.full(1, PRIOR, np.float32), "weights": np.zeros(SLOTS, np.float32)}
    if kinds == {0, 1}:
        model["weights"] = contrasts(features)
        model = averaged_rounds(features, model, _step, rounds)
    return Model(model["bias"], model["weights"])


def contrasts(features: DataFrame) -> np.ndarray:
    """Where the descent starts: log odds of the slots by document counts, where positive.

    Noisy-or has a poor gradient while every sentence looks alike; slots that
    lean to toxic documents beyond chance break the tie.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, SLOTS))
        rows = np.zeros(2)
        for b in batches:
            for y, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = np.unique(np.frombuffer(s, np.int32))
                counts[y][own] += 1
                rows[y] += 1
        slots = np.flatnonzero(counts.sum(0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(slots, -1).astype(np.int32)), *[pa.array(np.append(counts[y][slots], rows[y])) for y in (0, 1)]], names=["slot", "clean", "toxic"]
        )

    table = features.mapInArrow(run, "slot int, clean double, toxic double").groupBy("slot").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    slot, clean, toxic = (table[c].to_numpy() for c in ("slot", "clean", "toxic"))
    n_clean, n_toxic = clean[slot < 0].sum(), toxic[slot < 0].sum()
    clean, toxic, slot = clean[slot >= 0], toxic[slot >= 0], slot[slot >= 0]
    lean = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    expected = (toxic + clean) * n_toxic / (n_toxic + n_clean)
    beyond = (toxic - expected) / np.sqrt(expected + 1)  # about a z value
    weights = np.zeros(SLOTS, np.float32)
    weights[slot] = np.where((beyond > 3) & (toxic >= 3), np.clip(lean, 0, 4) * 0.8, 0)
    return weights


def scorer(df: DataFrame, model: Model):
    """A Column function text -> struct(score, sentences, offending spans, worst first)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, sentences long, offending array<struct<start:long,end:long,score:double>>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            data = [t.encode("utf-8", "replace") if t else b"" for t in texts]
            rows: list[tuple] = []
            at = 0
            while at < len(data):
                stop, size = at, 0
                while stop < len(data) and (stop == at or size + len(data[stop]) <= WINDOW):
                    size += len(data[stop])
                    stop += 1
                rows += document_scores(data[at:stop], shared.value)
                at = stop
            yield pd.DataFrame(rows, columns=["score", "sentences", "offending"])

    return score


def document_scores(texts: list[bytes], model: Model) -> list[tuple[float, int, list[dict]]]:
    """Noisy-or of each text's sentences; offending ones by character span, worst first."""
    got = instances(texts)
    rows: list[tuple[float, int, list[dict]]] = [(0.0, 0, [])] * len(texts)
    if not len(got.text):
        return rows
    p = sigmoid(model.bias[0] + np.add.reduceat(model.weights[got.slots].astype(np.float64), np.cumsum(got.sizes) - got.sizes))
    clear = np.log1p(-np.minimum(p, 1 - 1e-6))
    whole = -np.expm1(np.bincount(got.text, weights=clear, minlength=len(texts)))
    count = np.bincount(got.text, minlength=len(texts))
    spots: dict[int, list[dict]] = {}
    bad = np.flatnonzero(p >= OFFENDING)
    for i in bad[np.argsort(-p[bad], kind="stable")]:
        text = texts[got.text[i]]
        start = len(text[: got.begin[i]].decode("utf-8", "replace"))
        end = start + len(text[got.begin[i] : got.end[i]].decode("utf-8", "replace"))
        spots.setdefault(int(got.text[i]), []).append({"start": start, "end": end, "score": float(p[i])})
    return [(min(max(float(whole[i]), 0.0), 1.0), int(count[i]), spots.get(i, [])) for i in range(len(texts))]


def score(df: DataFrame, model: Model, text: str = "text", out: str = "toxicity") -> DataFrame:
    """``df`` with a struct column ``out``: score, sentences, offending spans."""
    return spread(df).withColumn(out, scorer(df, model)(F.col(text)))
