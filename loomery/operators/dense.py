"""Vector top k: exact, and approximate over centroid buckets.

Every corpus partition is scanned where it lies: a task multiplies its vectors
by the query matrix and sends on only its best k per query. A query batch is
shipped to the tasks up to a checked size; a larger one is met with the corpus
in a grid of shuffled blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery import constants as k_
from loomery.operators.topk import top_k
from loomery.session import materialize

MAX_SHIPPED_QUERIES = 4096
BLOCK_CELLS = 4_000_000
GRID_CORPUS_ROWS = 100_000
MAX_CENTROID_BYTES = 256 << 20  # shipped to the tasks
FINAL_SALTS = 16


def _unit(m: np.ndarray) -> np.ndarray:
    m = np.asarray(m, dtype=np.float64)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _stack(vectors) -> np.ndarray:
    return np.vstack([np.asarray(v, dtype=np.float64) for v in vectors])


class _Best:
    """Running best k per query, ordered by score then id."""

    def __init__(self, k: int):
        self.k = k
        self.kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if q in self.kept:
            s, i = self.kept[q]
            if len(s) == self.k:
                good = scores >= s[-1]
                scores, ids = scores[good], ids[good]
            if not len(scores):
                return
            scores, ids = np.concatenate([s, scores]), np.concatenate([i, ids])
        if len(scores) > self.k:
            cut = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            good = scores >= cut
            scores, ids = scores[good], ids[good]
        best = np.lexsort((ids, -scores))[: self.k]
        self.kept[q] = (scores[best], ids[best])

    def frame(self, query_ids) -> pd.DataFrame:
        if not self.kept:
            return pd.DataFrame({"query_id": [], "chunk_id": [], "dense_score": []}, dtype=object)
        sizes = [len(s) for s, _ in self.kept.values()]
        scores, ids = (np.concatenate(parts) for parts in zip(*self.kept.values()))
        asked = np.array([query_ids[q] for q in self.kept], dtype=object if isinstance(query_ids[0], str) else None)
        return pd.DataFrame({"query_id": _plain(np.repeat(asked, sizes)), "chunk_id": _plain(ids), "dense_score": scores})


def _plain(values: np.ndarray) -> pd.Series:
    """Texts stay objects, whatever text type pandas would choose."""
    return pd.Series(values, dtype=object if values.dtype.kind in "OU" else values.dtype)


def _score(best: _Best, wanted: np.ndarray, queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray) -> None:
    if not len(wanted) or not len(ids):
        return
    step = max(1, BLOCK_CELLS // len(wanted))
    for at in range(0, len(ids), step):
        s = np.round(queries[wanted] @ vectors[at : at + step].T, 6)
        for row, q in zip(s, wanted):
            best.add(int(q), row, ids[at : at + step])


def _schema(queries: DataFrame, corpus: DataFrame) -> str:
    return f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {corpus.schema['chunk_id'].dataType.simpleString()}, dense_score double"


def _finish(partial: DataFrame, k: int) -> DataFrame:
    # every scan task sends k rows per query: end a query's list in two rounds
    order = [F.desc("dense_score"), F.asc("chunk_id")]
    return top_k(partial, "query_id", order, k, salts=FINAL_SALTS, salt_on="chunk_id")


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int = k_.RETRIEVER_TOP_K, tenant: str | None = None) -> DataFrame:
    """Exact cosine top k: (query_id, chunk_id, dense_score, rank).

    ``queries``: query_id, embedding; ``corpus``: chunk_id, embedding, already
    filtered. With ``tenant`` a query only meets rows of its own tenant.
    """
    cols = ["embedding"] + ([tenant] if tenant else [])
    queries = queries.select("query_id", *cols)
    corpus = corpus.select("chunk_id", *cols)
    schema = _schema(queries, corpus)
    rows = queries.limit(MAX_SHIPPED_QUERIES + 1).collect()
    if len(rows) > MAX_SHIPPED_QUERIES:
        return _finish(_grid(queries, corpus, k, tenant, schema), k)
    if not rows:
        return _finish(corpus.sparkSession.createDataFrame([], schema), k)
    batch = (
        [r["query_id"] for r in rows],
        _unit(_stack([r["embedding"] for r in rows])),
        np.array([r[tenant] for r in rows]) if tenant else None,
    )
    shipped = corpus.sparkSession.sparkContext.broadcast(batch)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query_ids, q, owners = shipped.value
        best = _Best(k)
        for f in frames:
            if len(f):
                _meet(best, q, owners, f, tenant)
        yield best.frame(query_ids)

    return _finish(corpus.mapInPandas(scan, schema), k)


def _meet(best: _Best, q: np.ndarray, owners, f: pd.DataFrame, tenant: str | None) -> None:
    vectors, ids = _unit(_stack(f["embedding"])), f["chunk_id"].to_numpy()
    if tenant is None:
        _score(best, np.arange(len(q)), q, vectors, ids)
        return
    held = f[tenant].to_numpy()
    for t in pd.unique(f[tenant]):
        mine = held == t
        _score(best, np.flatnonzero(owners == t), q, vectors[mine], ids[mine])


def _grid(queries: DataFrame, corpus: DataFrame, k: int, tenant: str | None, schema: str) -> DataFrame:
    """Blocks of queries against blocks of the corpus, each pair one bounded task."""
    n_q = math.ceil(queries.count() / MAX_SHIPPED_QUERIES)
    n_c = max(1, math.ceil(corpus.count() / GRID_CORPUS_ROWS))
    # own column names on the query side: both sides may come from one table
    own = [F.col(tenant).alias("_qt")] if tenant else []
    q = queries.select(
        "query_id", F.col("embedding").alias("_qv"), *own, F.pmod(F.xxhash64("query_id"), F.lit(n_q)).alias("_j"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_c - 1).cast("bigint"))).alias("_i")
    )
    c = corpus.select(
        "*", F.pmod(F.xxhash64("chunk_id"), F.lit(n_c)).alias("_i"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_q - 1).cast("bigint"))).alias("_j")
    )

    def cell(qf: pd.DataFrame, cf: pd.DataFrame) -> pd.DataFrame:
        best = _Best(k)
        if len(qf) and len(cf):
            _meet(best, _unit(_stack(qf["_qv"])), qf["_qt"].to_numpy() if tenant else None, cf, tenant)
        return best.frame(qf["query_id"].tolist())

    return q.groupBy("_i", "_j").cogroup(c.groupBy("_i", "_j")).applyInPandas(cell, schema)


def train_centroids(corpus: DataFrame, lists: int = 16, seed: int = 7, max_iter: int = 10) -> np.ndarray:
    """Unit centroids by distributed k-means, as long as they can be shipped."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    dims = corpus.select(F.max(F.size("embedding"))).first()[0] or 0
    if 8 * lists * dims > MAX_CENTROID_BYTES:
        raise ValueError(f"{lists} centroids of {dims} entries are over {MAX_CENTROID_BYTES} bytes")
    data = corpus.select(array_to_vector("embedding").alias("features"))
    model = KMeans(k=lists, seed=seed, maxIter=max_iter).fit(data)
    return _unit(np.array(model.clusterCenters()))


def assign_lists(corpus: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Add ``list_id``, the nearest centroid. Write the result partitioned by it."""
    shipped = corpus.sparkSession.sparkContext.broadcast(centroids)

    @F.pandas_udf("int")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in batches:
            yield pd.Series(np.argmax(_stack(v) @ shipped.value.T, axis=1) if len(v) else [], dtype="int32")

    return corpus.withColumn("list_id", nearest("embedding"))


def ivf_topk(queries: DataFrame, listed: DataFrame, centroids: np.ndarray, k: int = k_.RETRIEVER_TOP_K, probes: int = 4) -> DataFrame:
    """Approximate top k: each query scans only its ``probes`` nearest lists, exactly.

    On a table partitioned by ``list_id`` the unprobed folders are never read.
    A list that holds much of the corpus stays spread over its scan tasks. A batch too
    large to be shipped meets the lists by a join on them.
    """
    rows = queries.select("query_id", "embedding").limit(MAX_SHIPPED_QUERIES + 1).collect()
    if len(rows) > MAX_SHIPPED_QUERIES:
        return ivf_grid_topk(queries, listed, centroids, k, probes)
    schema = _schema(queries, listed)
    if not rows:
        return _finish(listed.sparkSession.createDataFrame([], schema), k)
    q = _unit(_stack([r["embedding"] for r in rows]))
    probed = np.argsort(-(q @ centroids.T), axis=1)[:, :probes]
    shipped = listed.sparkSession.sparkContext.broadcast(([r["query_id"] for r in rows], q, probed))

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query_ids, qm, lists = shipped.value
        best = _Best(k)
        for f in frames:
            if not len(f):
                continue
            vectors, ids, where = _unit(_stack(f["embedding"])), f["chunk_id"].to_numpy(), f["list_id"].to_numpy()
            for lst in np.unique(where):
                mine = where == lst
                _score(best, np.flatnonzero((lists == lst).any(axis=1)), qm, vectors[mine], ids[mine])
        yield best.frame(query_ids)

    wanted = [int(x) for x in np.unique(probed)]
    part = listed.where(F.col("list_id").isin(wanted)).select("chunk_id", "embedding", "list_id")
    return _finish(part.mapInPandas(scan, schema), k)


def ivf_grid_topk(queries: DataFrame, listed: DataFrame, centroids: np.ndarray, k: int = k_.RETRIEVER_TOP_K, probes: int = 4) -> DataFrame:
    """Queries by list against blocks of the lists: an equi-join of bounded cells.

    A list with more than GRID_CORPUS_ROWS vectors, or more than MAX_SHIPPED_QUERIES
    queries that probe it, is cut into blocks on that side.
    """
    schema = _schema(queries, listed)
    shipped = queries.sparkSession.sparkContext.broadcast(centroids)

    @F.pandas_udf("array<int>")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in batches:
            best = np.argsort(-(_unit(_stack(v)) @ shipped.value.T), axis=1)[:, :probes] if len(v) else []
            yield pd.Series([x.astype(np.int32) for x in best], dtype=object)

    # stored: counted and joined
    asked = materialize(queries.select("query_id", F.col("embedding").alias("_qv"), F.explode(nearest("embedding")).alias("list_id")), "probes")
    n_q = asked.groupBy("list_id").agg(F.ceil(F.count("*") / MAX_SHIPPED_QUERIES).cast("int").alias("_nq"))
    n_c = listed.groupBy("list_id").agg(F.ceil(F.count("*") / GRID_CORPUS_ROWS).cast("int").alias("_nc"))
    blocks = materialize(n_q.join(n_c, "list_id"), "list-blocks")  # a row for each list, fewer than centroids

    def spread_over(df: DataFrame, own: str, id_: str, other: str, other_no: str, own_no: str) -> DataFrame:
        cut = blocks.select("list_id", F.col(own).alias(f"{own}{own_no}"), F.col(other).alias(f"{other}{own_no}"))  # names of its own on either side
        number = F.pmod(F.xxhash64(id_), F.col(f"{own}{own_no}")).cast("int")
        met = df.join(F.broadcast(cut), "list_id").withColumn(own_no, number)
        return met.select(*df.columns, own_no, F.explode(F.sequence(F.lit(0), F.col(f"{other}{own_no}") - 1)).alias(other_no))

    q = spread_over(asked, "_nq", "query_id", "_nc", "_i", "_j")
    c = spread_over(listed.select("chunk_id", "embedding", "list_id"), "_nc", "chunk_id", "_nq", "_j", "_i")

    def cell(qf: pd.DataFrame, cf: pd.DataFrame) -> pd.DataFrame:
        best = _Best(k)
        if len(qf) and len(cf):
            _meet(best, _unit(_stack(qf["_qv"])), None, cf, None)
        return best.frame(qf["query_id"].tolist())

    key = ["list_id", "_i", "_j"]
    return _finish(q.groupBy(*key).cogroup(c.groupBy(*key)).applyInPandas(cell, schema), k)


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, recall): share of the exact hits that the approximate search has."""
    hit = found.select("query_id", "chunk_id", F.lit(1).alias("_hit"))
    return exact.join(hit, ["query_id", "chunk_id"], "left").groupBy("query_id").agg((F.count("_hit") / F.count("*")).alias("recall"))


def tune_probes(queries: DataFrame, listed: DataFrame, centroids: np.ndarray, k: int = k_.RETRIEVER_TOP_K, target: float = 0.9, sample: int = 256) -> int:
    """The fewest probes whose recall is ``target`` or more for every one of at most ``sample``
    queries, measured against exact search; doubled and then halved in on."""
    some = materialize(queries.orderBy(F.xxhash64("query_id")).limit(sample).select("query_id", "embedding"), "tuning-queries")
    exact = materialize(dense_topk(some, listed.select("chunk_id", "embedding"), k).select("query_id", "chunk_id"), "exact-hits")

    def enough(probes: int) -> bool:
        least = recall(exact, ivf_topk(some, listed, centroids, k, probes)).agg(F.min("recall")).first()[0]
        return least is None or least >= target

    low, high = 0, 1
    while high < len(centroids) and not enough(high):
        low, high = high, min(2 * high, len(centroids))
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if enough(middle) else (middle, high)
    return high
