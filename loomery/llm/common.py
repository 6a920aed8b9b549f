"""What the operators of this package share: folds, words, hashes, small models.

Words are ``[^\\x20\\x09-\\x0D]+``. ``bytes.split`` and ``bytes.lower`` treat just
these characters and A-Z, whatever the locale, so all word code works on UTF-8.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW_BYTES = 1 << 20  # of text that a task works on at once
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES = 4 << 20  # of a batch on its way to Python


def fold(id_column: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    col = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def store(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write once under ``spark.checkpoint.dir`` (or to ``path`` there) and read that: lineage ends there.

    Where the setting is unset (tests), a folder of the local machine serves, and
    only on a local master. What is stored stays to the end, so it is packed tighter
    than by default; the shuffles that led to it go at once, not when the driver next
    collects its garbage.
    """
    spark = df.sparkSession
    path = path or new_folder(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


_local_root: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if "root" not in _local_root:
        import tempfile

        _local_root["root"] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local_root["root"]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with more underscores if ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of a batch on its way to Python, not only its rows: ten
    thousand long texts at once don't fit beside each other."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def spread(df: DataFrame) -> DataFrame:
    """One partition per core at least, when a small table scans as fewer.

    Tables with as many splits as cores pass unchanged, so large ones never move.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)


def text_windows(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = WINDOW_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``limit`` bytes of text (a longer text stands alone), so
    that what a task builds at once is bounded whatever the batch size."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.binary_length(batch.column(batch.schema.get_field_index(column)))
        ends = np.cumsum(np.nan_to_num(sizes.to_numpy(zero_copy_only=False).astype(np.float64)))
        start, base = 0, 0.0
        while start < n:
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            base, start = ends[stop - 1], stop


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    """UTF-8 of the texts without decoding them."""
    return batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()


# --- hashes ---------------------------------------------------------------

_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 over uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX_A
    x ^= x >> np.uint64(27)
    x *= _MIX_B
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of them."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            table = np.ones(size, np.uint64)
            with np.errstate(over="ignore"):
                table[1:] = np.cumprod(np.full(size - 1, base, np.uint64))
            out.append(table)
        _powers[size] = (out[0], out[1])
    return _powers[size]


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts in order, and each text's word count."""
    return word_hashes_sizes(texts)[:2]


def word_hashes_sizes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``word_hashes`` and the words' lengths in bytes.

    A word's hash is its polynomial over the bytes, taken as a difference of
    running sums, then mixed: no Python object per word.
    """
    data = np.frombuffer(b" ".join(t or b"" for t in texts) + b" ", np.uint8)
    lengths = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
    space = SPACE[data]
    edge = np.diff(np.concatenate(([True], space)).astype(np.int8))
    starts = np.flatnonzero(edge == -1)
    ends = np.flatnonzero(edge == 1)
    up, down = _power_tables(len(data) + 1)
    with np.errstate(over="ignore"):
        running = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=running[1:])
        hashes = mix64((running[ends] - running[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    text_ends = np.cumsum(lengths + 1)
    counts = np.diff(np.concatenate(([0], np.searchsorted(starts, text_ends))))
    return hashes, counts, ends - starts


def chain_hash(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of ``n`` consecutive values (empty if there are fewer)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = hashes[:m].copy()
        for i in range(1, n):
            out *= np.uint64(0xD6E8FEB86659FD93)
            out += hashes[i : m + i]
    return mix64(out)


# --- models trained on a bounded sample -----------------------------------


def bounded_sample(df: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """About ``most`` rows at most, drawn by a hash of the key (all, if fewer)."""
    n = df.count()
    if n <= most:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(1 << 20)) < int((1 << 20) * most / n))


def averaged_rounds(
    features: DataFrame,
    model: dict[str, np.ndarray],
    step: Callable[[Iterator[pa.RecordBatch], dict[str, np.ndarray], int], tuple[dict[str, np.ndarray], float]],
    rounds: int,
) -> dict[str, np.ndarray]:
    """Parallel stochastic descent: in each round every partition walks on from the
    common model and the weighted mean of the results is the next one.

    ``features`` has few partitions (the caller bounds them) and a model a fixed
    size, so what reaches the driver per round is bounded.
    """
    sc = features.sparkSession.sparkContext
    names = list(model)
    schema = "weight double, " + ", ".join(f"`{n}` binary" for n in names)
    for r in range(rounds):
        shared = sc.broadcast(model)

        def run(batches, shared=shared, r=r):
            own = {k: v.copy() for k, v in shared.value.items()}
            out, weight = step(batches, own, r)
            if weight > 0:
                yield pa.RecordBatch.from_pydict(
                    {"weight": pa.array([float(weight)])} | {n: pa.array([out[n].astype(np.float32).tobytes()], pa.binary()) for n in names}
                )

        rows = features.mapInArrow(run, schema).collect()
        shared.unpersist()
        total = sum(x["weight"] for x in rows)
        if not total:
            break
        rows.sort(key=lambda x: (x["weight"], bytes(x[names[0]])))
        model = {
            n: (sum(np.frombuffer(x[n], np.float32).astype(np.float64) * x["weight"] for x in rows) / total).astype(np.float32).reshape(model[n].shape)
            for n in names
        }
    return model


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))
