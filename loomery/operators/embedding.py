"""Embedding of texts through a pluggable encoder.

An encoder factory is a picklable callable without arguments that returns
``encode(list[str]) -> ndarray (n, dim)`` of unit rows. It is called once per
Python worker, never on the driver.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery import constants as k
from loomery.functions.text import content_hash

MAX_PLACES = 100_000  # words whose places a worker remembers, however many there are
_WORD = re.compile(r"\w{2,}")
_NO_WORD = {c: " " for c in range(128) if not re.match(r"\w", chr(c))}
_LOADED: dict = {}


def words_of(text: str) -> list[str]:
    """Runs of two or more word characters; in ASCII they are what blanks part."""
    if text.isascii():
        return [w for w in text.translate(_NO_WORD).split() if len(w) > 1]
    return _WORD.findall(text)


class HashedTermEncoder:
    """Deterministic default: term counts hashed into ``dim`` places, unit length."""

    def __init__(self, dim: int = k.EMBEDDING_DIM):
        self.dim = dim

    def __eq__(self, other):
        return type(other) is type(self) and other.dim == self.dim

    def __hash__(self):
        return hash((type(self), self.dim))

    def __call__(self):
        places: dict[str, int] = {}
        dim = self.dim

        def place(word: str) -> int:
            if len(places) >= MAX_PLACES:
                places.clear()
            p = places[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dim
            return p

        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim))
            for row, t in zip(out, texts):
                words = words_of(t.lower())
                found = list(map(places.get, words))
                if None in found:
                    found = [place(w) if p is None else p for w, p in zip(words, found)]
                if found:
                    row += np.bincount(found, minlength=dim)
                    row /= np.sqrt(np.dot(row, row))
            return out

        return encode


def _encode(factory):
    if factory not in _LOADED:
        _LOADED[factory] = factory()
    return _LOADED[factory]


def encode(factory: Callable = HashedTermEncoder(), batch: int = 256):
    """Iterator pandas UDF ``string -> array<float>``; whole texts."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fn = _encode(factory)
        for texts in batches:
            rows = []
            for at in range(0, len(texts), batch):
                rows.extend(fn([t or "" for t in texts.iloc[at : at + batch]]).astype(np.float32))
            yield pd.Series(rows)

    return run


def adjacent_similarity(factory: Callable = HashedTermEncoder()):
    """pandas UDF ``array<string> -> array<double>``: similarity of each text to the
    one before it; 0 when either is empty, null for the first."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fn = _encode(factory)
        for docs in batches:
            out = []
            for parts in docs:
                sims: list = []
                last = None
                for at in range(0, len(parts), 256):
                    v = fn(list(parts[at : at + 256]))
                    before = np.vstack([last if last is not None else np.zeros_like(v[:1]), v[:-1]])
                    sims.extend(np.round(np.einsum("ij,ij->i", before, v), 6).tolist())
                    last = v[-1:]
                if sims:
                    sims[0] = None
                out.append(sims)
            yield pd.Series(out)

    return run


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays in double; 0 when either is empty or null."""
    d = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.when((F.size(a) > 0) & (F.size(b) > 0), d), F.lit(0.0))


def embedding_misses(texts: DataFrame, store: DataFrame, text: str = "content") -> DataFrame:
    """Distinct (tenant, hash) pairs without a stored vector, with one text each."""
    hashed = texts.withColumn("content_hash", content_hash(F.col(text)))
    wanted = hashed.groupBy("tenant_id", "content_hash").agg(F.first(text).alias(text))
    return wanted.join(store.select("tenant_id", "content_hash"), ["tenant_id", "content_hash"], "left_anti")


def encode_missing(texts: DataFrame, store: DataFrame, factory: Callable = HashedTermEncoder(), text: str = "content") -> DataFrame:
    """New rows for the embedding store: only what it does not hold yet, once each."""
    new = embedding_misses(texts, store, text)
    return new.select("tenant_id", "content_hash", encode(factory)(F.col(text)).alias("embedding"))


def attach_embeddings(chunks: DataFrame, store: DataFrame) -> DataFrame:
    """Fill null embeddings of ``chunks`` from the store by content hash."""
    s = store.select("tenant_id", "content_hash", F.col("embedding").alias("_stored"))
    out = chunks.join(s, ["tenant_id", "content_hash"], "left")
    return out.withColumn("embedding", F.coalesce("embedding", "_stored")).drop("_stored")
