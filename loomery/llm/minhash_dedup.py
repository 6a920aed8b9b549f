"""Near-duplicate groups: banded MinHash candidates, sequential Bayesian verification.

1. A text is its set of distinct word shingles. Texts with the same set form a
   class; from here on only its representative (smallest id) takes part.
2. Signatures of BANDS x ROWS minima (a byte of each) are cut into bands. Every
   bucket's smallest member is its hub; a text is first compared with the HUBS hubs
   that most of its buckets have, so there are rows in proportion to the texts.
3. A pair's signatures are compared batch by batch. With a uniform prior the
   similarity's posterior after m matches of n is Beta(m+1, n-m+1); a pair is
   dropped as soon as the chance that it reaches the threshold is below ``miss``.
4. Survivors are verified exactly on their full sets, and linked.
5. Buckets whose members are still in different components then compare their
   members across these components inside the tasks, each pair in the first band it
   shares. A first pass over the signatures finds the members that pass step 3 with
   some other; only they travel on with their sets, are verified in the task, and a
   task emits a spanning forest of their links: fewer links than members, never
   pairs. Hot buckets are cut into blocks; blocks of their largest component don't
   meet each other. No link can slip through: within a component a link changes
   nothing.

The chance that no band meets for two texts at similarity s is (1 - s^5)^32:
3e-6 at 0.8. Labels spread over links by repeated minima with pointer jumping;
each round is written to the shared folder.

Results for odd input: null and empty texts have an empty set, are linked with
nothing and kept as a component of their own; a text with fewer words than a
shingle is one shingle, its whole sequence. Ids name documents: rows with equal
ids share a fate, compare by the greatest of their texts, and rows without an id are
kept, outside every group. An empty
table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomery.llm.common import chain_hash, mix64, spread, store, text_windows, texts_of, word_hashes

BANDS, ROWS = 32, 5
BATCH = 32  # signature values compared at a time
MISS = 1e-6  # posterior chance under which a pair is dropped
CHUNK = 2048  # shingles hashed at once
HUBS = 3  # that a text is compared with before its buckets
BLOCK = 4096  # members of a bucket that meet in one task
CELL_BYTES = 16 << 20  # of shingle sets that meet in one task
SET_STEP = 1 << 20  # shingles looked up at once


def shingle_sets(texts: list[bytes | None], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text (A-Z lowered)."""
    hashes, counts = word_hashes([t.lower() if t else t for t in texts])
    ends = np.cumsum(counts)
    out = []
    for end, n in zip(ends, counts):
        own = hashes[end - n : end]
        if n == 0:
            out.append(np.empty(0, np.uint64))
        elif n < size:
            out.append(chain_hash(own, int(n)) + np.uint64(n))
        else:
            out.append(np.unique(chain_hash(own, size)))
    return out


@lru_cache(1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    n = BANDS * ROWS
    return rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima of BANDS x ROWS hash functions over the set."""
    a, b = _permutations()
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), CHUNK):
        part = low[i : i + CHUNK, None] * a + b
        part ^= part >> np.uint32(15)
        part *= np.uint32(0x2C1B3C6D)
        np.minimum(out, part.min(0), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of the signatures' bytes, different between bands."""
    bands = sig.reshape(*sig.shape[:-1], BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(ROWS):
        key = mix64(key ^ bands[..., i])
    return key


def describe(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n_shingles, set_key (two hashes of the whole set), sig.

    ``sig`` keeps a byte of each minimum, which is enough to count matches (a few too
    many, so nothing more is pruned); its band keys are worked out where they are needed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_windows(batches):
            sets = shingle_sets(texts_of(batch), shingle)
            keys, sigs = [], []
            for s in sets:
                own = signature(s).astype(np.uint8) if len(s) else None
                with np.errstate(over="ignore"):
                    keys.append(np.array([s.sum(), mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(), len(s)], np.uint64).tobytes() if len(s) else None)
                sigs.append(own.tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())],
                names=["doc_id", "n_shingles", "set_key", "sig"],
            )

    return spread(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sig binary")


@lru_cache(8)
def fewest_matches(threshold: float, miss: float) -> tuple[int, ...]:
    """For n = BATCH, 2 BATCH, ...: the least m with P(similarity >= threshold | m of n) >= miss."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            p = np.exp(log - log.max())
            if p[grid >= threshold].sum() / p.sum() >= miss:
                out.append(m)
                break
    return tuple(out)


def _reaching(x: np.ndarray, y: np.ndarray, least: tuple[int, ...]) -> np.ndarray:
    """Rows of two signature matrices that sequential comparison doesn't rule out."""
    alive = np.arange(len(x))
    matches = np.zeros(len(x), np.int64)
    for i, m in enumerate(least):
        part = slice(i * BATCH, (i + 1) * BATCH)
        matches[alive] += (x[alive, part] == y[alive, part]).sum(1)
        alive = alive[matches[alive] >= m]
    return alive


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def prune(pairs: DataFrame, threshold: float, miss: float) -> DataFrame:
    """Pairs (a, b, sig_a, sig_b) that may reach the threshold."""
    least = fewest_matches(threshold, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                alive = pa.array(_reaching(_signatures(batch.column(2)), _signatures(batch.column(3)), least))
                yield pa.RecordBatch.from_arrays([batch.column(i).take(alive) for i in (0, 1)], names=["a", "b"])

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def deal(buckets: DataFrame, weight: str, most: int) -> DataFrame:
    """``buckets`` (band, rep, label, ...) with cells (x, y) and each row's block ``own``.

    A bucket whose ``weight`` sums up to ``most`` or less is one cell. A larger one is cut
    into blocks, and a cell is a pair of blocks. Members of its most frequent label don't
    have to meet each other, so their blocks meet those of the others only.
    """
    labels = buckets.groupBy("band", "label").agg(F.sum(weight).alias("w"))
    main = F.max(F.struct("w", "label"))
    large = labels.groupBy("band").agg(F.sum("w").alias("all"), main["w"].alias("w"), main["label"].alias("main")).where(F.col("all") > most)
    large = large.select("band", "main", F.ceil((F.col("all") - F.col("w")) / most).cast("int").alias("others"), F.ceil(F.col("w") / most).cast("int").alias("mains"))
    joined = buckets.join(store(large, "large-buckets"), "band", "left")
    number = F.xxhash64("rep", F.lit(5))
    is_main = F.col("label") == F.col("main")
    own = F.when(F.col("main").isNull(), 0).when(is_main, F.col("others") + F.pmod(number, F.col("mains"))).otherwise(F.pmod(number, F.col("others")))
    last = F.when(F.col("main").isNull(), 0).when(is_main, F.col("others") - 1).otherwise(F.col("others") + F.col("mains") - 1)
    met = joined.withColumn("own", own.cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    return met.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other")).drop("main", "others", "mains", "other")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each cell (band, x, y), from batches sorted by it."""
    rest: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
        edge = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), batch.num_rows]
        for i, j in zip(edge, edge[1:]):
            key = tuple(keys[i].tolist())
            if rest and key != last:
                yield pa.Table.from_batches(rest).combine_chunks()
                rest = []
            rest.append(batch.slice(i, j - i))
            last = key
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()


class Cell:
    """Members of a cell, and which of them may reach the threshold."""

    def __init__(self, table: pa.Table, percent: int, miss: float):
        self.own, self.no, self.rep, self.n, self.label = (table[c].to_numpy() for c in ("own", "no", "rep", "n", "label"))
        self.apart = table["x"][0] != table["y"][0]  # two blocks: only pairs between them
        self.sig = _signatures(table["sig"].combine_chunks())
        self.percent, self.least = percent, fewest_matches(percent / 100, miss)

    def near(self, i: int, group: np.ndarray) -> np.ndarray:
        """Members after ``i`` of another group that the signatures don't rule out, if
        this is the first band that they share with ``i``."""
        j = np.arange(i + 1, len(self.rep))
        small, large = np.minimum(self.n[j], self.n[i]), np.maximum(self.n[j], self.n[i])
        ok = (group[j] != group[i]) & (self.label[j] != self.label[i]) & (100 * small >= self.percent * large)
        if self.apart:
            ok &= self.own[j] != self.own[i]
        j = j[ok]
        if len(j):
            j = j[_reaching(np.broadcast_to(self.sig[i], (len(j), self.sig.shape[1])), self.sig[j], self.least)]
        if len(j):
            same = (self.sig[j] == self.sig[i]).reshape(-1, BANDS, ROWS).all(2)
            j = j[same.argmax(1) == self.no[i]]
        return j


def meeting(buckets: DataFrame, percent: int, miss: float) -> DataFrame:
    """band, no, rep, n, label of the members of a bucket that may reach the threshold
    with a member in another component; no pair leaves the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _cells(batches):
            cell = Cell(table, percent, miss)
            hit = np.zeros(len(cell.rep), bool)
            alone = np.arange(len(cell.rep))
            for i in range(len(alone) - 1):
                j = cell.near(i, alone)
                hit[j] = True
                hit[i] |= len(j) > 0
            at = pa.array(np.flatnonzero(hit))
            yield from table.select(["band", "no", "rep", "n", "label"]).take(at).combine_chunks().to_batches()

    dealt = deal(buckets.withColumn("one", F.lit(1)), "one", BLOCK).select("band", "x", "y", "own", "no", "rep", "n", "label", "sig")
    sorted_ = dealt.repartition("band", "x", "y").sortWithinPartitions("band", "x", "y", "own", "rep")
    return sorted_.mapInArrow(run, "band long, no int, rep long, n long, label long").distinct()


def forests(members: DataFrame, percent: int, miss: float) -> DataFrame:
    """Links (a, b) between members of a bucket in different components, verified on
    their full sets: of each cell a spanning forest, so fewer links than members.

    ``members`` has band, no, rep, n, label, sig and shingles (the set's hashes).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _cells(batches):
            cell = Cell(table, percent, miss)
            sets = table["shingles"].combine_chunks()
            cell.n = pc.binary_length(sets).to_numpy().astype(np.int64) // 8
            flat = np.frombuffer(b"".join(sets.to_pylist()), np.uint64)
            _, flat = np.unique(flat, return_inverse=True)
            ends = np.cumsum(cell.n)
            begin = ends - cell.n
            _, group = np.unique(cell.label, return_inverse=True)  # components, merged along the way
            mark = np.zeros(int(flat.max(initial=0)) + 1, bool)
            links: list[tuple[int, int]] = []
            for i in range(len(cell.rep) - 1):
                near = cell.near(i, group)
                if not len(near):
                    continue
                mark[flat[begin[i] : ends[i]]] = True
                for part in np.split(near, np.flatnonzero(np.diff(np.cumsum(cell.n[near]) // SET_STEP)) + 1):
                    size = cell.n[part]
                    at = np.repeat(begin[part] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                    both = np.add.reduceat(mark[flat[at]].astype(np.int64), np.cumsum(size) - size)
                    for j in part[100 * both >= percent * (cell.n[i] + size - both)].tolist():
                        if group[j] != group[i]:
                            links.append((int(cell.rep[i]), int(cell.rep[j])))
                            group[group == group[j]] = group[i]
                mark[flat[begin[i] : ends[i]]] = False
            out = np.array(links, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(out.min(1)), pa.array(out.max(1))], names=["a", "b"])

    dealt = deal(members.withColumn("bytes", 8 * F.col("n") + 200), "bytes", CELL_BYTES).select("band", "x", "y", "own", "no", "rep", "n", "label", "sig", "shingles")
    return dealt.repartition("band", "x", "y").sortWithinPartitions("band", "x", "y", "own", "rep").mapInArrow(run, "a long, b long")


def sets_of(docs: DataFrame, reps: DataFrame, shingle: int) -> DataFrame:
    """rep, shingles: the sets' hashes, sorted, of the documents named by ``reps``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_windows(batches):
            sets = [x.tobytes() for x in shingle_sets(texts_of(batch), shingle)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["rep", "shingles"])

    return _texts(docs, reps.select(F.col("rep").alias("doc_id"))).mapInArrow(run, "rep long, shingles binary")


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, text of the given ids, the greatest text where rows share an id."""
    return docs.select("doc_id", "text").join(ids.distinct(), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"))


def verify(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union on full sets.

    Pairs of one ``a`` come together, so its set is worked out once for them.
    """
    few = _texts(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")))
    joined = (
        pairs.join(few.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        .join(few.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        .select("a", "b", "text_a", "text_b")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, one = None, None
        for batch in text_windows(text_windows(batches, "text_a"), "text_b"):
            keep = []
            firsts = batch.column(0).to_pylist()
            others = shingle_sets(texts_of(batch, "text_b"), shingle)
            for i, (a, other) in enumerate(zip(firsts, others)):
                if a != last:
                    last, one = a, shingle_sets(texts_of(batch.slice(i, 1), "text_a"), shingle)[0]
                both = len(np.intersect1d(one, other, assume_unique=True))
                if both and 100 * both >= percent * (len(one) + len(other) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(keep, pa.int64())) for i in (0, 1)], names=["a", "b"])

    return joined.mapInArrow(run, "a long, b long")


def components(links: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """node, label: the smallest node reachable over undirected links (a, b).

    Every round takes the least label among a node and its neighbours, then the
    label's own label; it ends when no label falls.
    """
    both = store(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct().toDF("node", "other"), "links")
    labels = store(both.groupBy("node").agg(F.min("other").alias("label")).select("node", F.least("node", "label").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        lowered = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("beyond"))
        new = store(lowered.join(jump, "low", "left").select("node", F.col("label").alias("was"), F.least("low", "beyond").alias("label")), "labels")
        labels = new.select("node", "label")
        if not new.where("was <> label").limit(1).count():
            return labels


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text)."""
    threshold = percent / 100
    described = store(describe(docs, shingle), "signatures")
    classes = (
        described.where("set_key is not null and doc_id is not null")
        .groupBy("set_key")
        .agg(F.min(F.struct("doc_id", "n_shingles", "sig")).alias("least"))
        .select("set_key", F.col("least.doc_id").alias("rep"), F.col("least.n_shingles").alias("n"), "least.sig")
    )
    reps = store(classes, "classes")

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = band_keys(_signatures(batch.column(1))).view(np.int64).reshape(-1)
            take = pa.array(np.repeat(np.arange(batch.num_rows), BANDS))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), pa.array(keys), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), batch.num_rows))],
                names=["rep", "band", "no"],
            )

    # entries move once, whatever their number: a bucket's smallest member is found where they lie
    entries = reps.select("rep", "sig").mapInArrow(bands, "rep long, band long, no int")
    bucket = Window.partitionBy("band")
    ends = entries.select("*", F.min("rep").over(bucket).alias("low"), F.max("rep").over(bucket).alias("_high"))
    shared = store(ends.where("low < _high").drop("_high"), "buckets")  # only buckets with two members or more

    sigs = reps.select("rep", "sig")

    def verified(survivors: DataFrame) -> DataFrame:
        return store(verify(store(survivors.distinct(), "survivors"), docs, shingle, percent), "verified")

    order = Window.partitionBy("rep").orderBy(F.desc("times"), "low")  # a text is in BANDS buckets at most
    pairs = (
        shared.where("rep <> low")
        .groupBy("rep", "low")
        .agg(F.count("*").alias("times"))
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= HUBS)
        .select(F.col("low").alias("a"), F.col("rep").alias("b"))
    )
    with_sigs = (
        pairs.join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b")
        .join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a")
    )
    first = verified(prune(with_sigs, threshold, miss))
    part = components(first)
    named = shared.join(part.select(F.col("node").alias("rep"), "label"), "rep", "left").select("band", "no", "rep", F.coalesce("label", "rep").alias("label"))
    mixed = named.groupBy("band").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l < h").select("band")
    open_ = store(named.join(mixed, "band").join(reps.select("rep", "n", "sig"), "rep"), "open-buckets")
    meet = store(meeting(open_, percent, miss), "meeting")
    whole = sets_of(docs, meet, shingle).join(sigs, "rep")
    second = store(forests(meet.join(whole, "rep"), percent, miss), "forests")
    final = components(first.union(second))
    named_reps = reps.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("label", "rep").alias("component_id"))
    return described.join(named_reps, "set_key", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
