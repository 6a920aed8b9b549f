"""Whitening of embeddings by spectral divide and conquer on the covariance.

Entries are fixed-point integers x = floor(64 * c) + 1000000, so sums are exact. The fit
list holds each distinct x vector once, however many rows have it. Spark makes the fit list
(an aggregation, copies combined before the shuffle), its sums, and the covariance V, each
task adding the outer products of its centred rows; partial matrices are summed row by row
in two rounds, so what the driver gets is one matrix of dims x dims.

The eigenvectors come from polar decompositions: for a shift s inside the spectrum, the
polar factor U of V - s I is its matrix sign, (U + I) / 2 the projector on the eigenvectors
above s. Bases of its range and of the complement split V in two blocks, which are split on
until they are single components. The polar factor is iterated by QDWH, the dynamically
weighted Halley iteration in its QR form while ill-conditioned and in its Cholesky form
after, at most about seven steps. Components that are not asked for are not split.

The projection (dims x components, bounded by MAX_DIMS) is broadcast to map all rows.

Results for odd input: rows whose vector is null or empty, or holds a null or a non-finite
entry or one of 2**36 or more (which exact sums can't hold), are dropped, and so are rows of
another length than the most frequent one (the longer of equally frequent). Ids are passed
on, null ones and repeated rows too. A component without variance (at most 1e-13 of the
trace: fewer distinct vectors than dims, constant dims) has null as ``whitened`` and doesn't
count for ``identity_error``, which is 0 if no component has variance. A ``deviation``
beyond a long is null. An empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm.common import spread, store

SCALE, OFFSET = 64, 1_000_000
HUGE = float(1 << 36)  # entries from here on count as non-finite
MAX_DIMS = 4096  # rows of the matrix that the driver splits and the tasks get
SLOTS = 64  # partial sums of a matrix row that are added beside each other
FLAT = 1e-13  # share of the trace under which a component has no variance
ROWS_AT_ONCE = 4096


# --- polar decomposition and splitting --------------------------------------


def polar(a: np.ndarray, steps: int = 12) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by QDWH: its matrix sign."""
    n = len(a)
    eye = np.eye(n)
    norm = np.linalg.norm(a)
    x = a / norm
    low = max(1e-17, 0.1 / (np.sqrt(n) * max(np.linalg.cond(x, 1), 1.0)))  # under the smallest singular value
    for _ in range(steps):
        d = np.cbrt(4 * (1 - low**2) / low**4)
        root = np.sqrt(1 + d)
        p = root + np.sqrt(max(8 - 4 * d + 8 * (2 - low**2) / (low**2 * root), 0.0)) / 2
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        last = x
        if r > 100:
            z, _ = np.linalg.qr(np.vstack([np.sqrt(r) * x, eye]))
            x = q / r * x + (p - q / r) / np.sqrt(r) * (z[:n] @ z[n:].T)
        else:
            w = np.linalg.cholesky(eye + r * (x.T @ x))
            x = q / r * x + (p - q / r) * np.linalg.solve(w.T, np.linalg.solve(w, x.T)).T
        x = (x + x.T) / 2
        low = min(1.0, low * (p + q * low**2) / (1 + r * low**2))
        if np.linalg.norm(x - last) <= 1e-15 * n ** 0.5 or (1 - low < 1e-15 and np.linalg.norm(x - last) < 1e-8):
            break
    return x


def _halves(a: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the invariant subspaces above and below some shift, the second one empty
    for a multiple of the identity; None if no shift splits ``a``."""
    n = len(a)
    diagonal = np.sort(np.diag(a))
    off = np.sqrt(max(np.linalg.norm(a) ** 2 - (diagonal**2).sum(), 0.0))
    low, high = diagonal[0], diagonal[-1]  # Schur-Horn: the spectrum reaches at least as far
    middle = np.median(diagonal)
    rng = np.random.default_rng(n)
    shifts = [middle, (low + high) / 2, *(low + (high - low) * np.array([0.38, 0.62, 0.23, 0.77, 0.11, 0.89]))]
    shifts += [middle + off * t for t in (0.05, -0.05, 0.3, -0.3)]
    best: tuple[float, np.ndarray, int] | None = None
    for shift in shifts:
        b = a - shift * np.eye(n)
        if np.linalg.norm(b) <= 2e-15 * n * scale:
            return np.eye(n), np.empty((n, 0))  # a multiple of the identity: every basis serves
        try:
            projector = (polar(b) + np.eye(n)) / 2
        except np.linalg.LinAlgError:
            continue
        k = int(round(np.trace(projector)))
        if not 0 < k < n:
            continue
        q = projector @ rng.standard_normal((n, k))
        for _ in range(2):
            q, _ = np.linalg.qr(projector @ q)
        q, _ = np.linalg.qr(projector @ q, mode="complete")
        wrong = np.linalg.norm(q[:, :k].T @ a @ q[:, k:])
        if best is None or wrong < best[0]:
            best = (wrong, q, k)
        if wrong <= 1e-14 * n * scale:
            break
    if best is None or best[0] > 1e-8 * scale:
        return None
    return best[1][:, : best[2]], best[1][:, best[2] :]


def _rotate(a: np.ndarray) -> np.ndarray:
    """Eigenvectors of a small or clustered block by Jacobi rotations."""
    a, v = a.copy(), np.eye(len(a))
    for _ in range(60):
        if np.linalg.norm(a - np.diag(np.diag(a))) <= 1e-16 * np.linalg.norm(a):
            break
        for i in range(len(a) - 1):
            for j in range(i + 1, len(a)):
                if a[i, j]:
                    angle = 0.5 * np.arctan2(2 * a[i, j], a[j, j] - a[i, i])
                    c, s = np.cos(angle), np.sin(angle)
                    turn = np.array([[c, s], [-s, c]])
                    a[:, [i, j]] = a[:, [i, j]] @ turn
                    a[[i, j]] = turn.T @ a[[i, j]]
                    v[:, [i, j]] = v[:, [i, j]] @ turn
    return v


def eigenvectors(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(values falling, vectors as columns) of the ``most`` largest eigenvalues of a symmetric matrix."""
    scale = max(np.linalg.norm(v), 1e-300)
    found: list[np.ndarray] = []

    def descend(basis: np.ndarray) -> None:
        if sum(f.shape[1] for f in found) >= most:
            return  # what is left lies lower
        block = basis.T @ v @ basis
        block = (block + block.T) / 2
        if len(block) == 1:
            found.append(basis)
            return
        if len(block) > 2:
            halves = _halves(block, scale)
            if halves is not None and not halves[1].shape[1]:
                found.append(basis)
                return
            if halves is not None:
                for half in halves:
                    descend(np.linalg.qr(basis @ half)[0])
                return
        turned = _rotate(block)
        order = np.argsort(-np.diag(turned.T @ block @ turned), kind="stable")
        found.append(basis @ turned[:, order])

    descend(np.eye(len(v)))
    vectors = np.concatenate(found, axis=1)
    values = np.einsum("ij,ij->j", vectors, v @ vectors)
    order = np.argsort(-values, kind="stable")[:most]
    return values[order], vectors[:, order]


# --- rows -------------------------------------------------------------------


def _fixed(batch: pa.RecordBatch, column: str, dims: int) -> tuple[np.ndarray, pa.Array]:
    """(x vectors of the rows that count, their places) of a batch."""
    vectors = batch.column(batch.schema.get_field_index(column))
    at = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(vectors), dims), False).to_numpy(zero_copy_only=False))
    flat = vectors.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
    with np.errstate(invalid="ignore"):
        good = (np.abs(flat) < HUGE).all(1)  # a null reads as NaN
    return np.floor(SCALE * flat[good]).astype(np.int64) + OFFSET, pa.array(at[good])


def fit_list(rows: DataFrame, column: str, dims: int) -> DataFrame:
    """x (binary, little-endian longs): every distinct x vector once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                x, _ = _fixed(batch.slice(start, ROWS_AT_ONCE), column, dims)
                whole = np.unique(np.ascontiguousarray(x, "<i8").view(f"V{8 * dims}").ravel()) if len(x) else []
                yield pa.RecordBatch.from_arrays([pa.array([w.tobytes() for w in whole], pa.binary())], names=["x"])

    return spread(rows.select(column)).mapInArrow(run, "x binary").distinct()


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, dims)


def sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """(number of vectors, exact sum of each dimension)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * dims, 0
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                x = _vectors(batch.column(0).slice(start, ROWS_AT_ONCE), dims)
                total = [a + b for a, b in zip(total, x.sum(0).tolist())]
                n += len(x)
        if n:
            import decimal

            whole = [decimal.Decimal(t) for t in [*total, n]]
            yield pa.RecordBatch.from_arrays([pa.array(range(dims + 1), pa.int32()), pa.array(whole, pa.decimal128(28, 0))], names=["dim", "total"])

    rows = fit.mapInArrow(run, "dim int, total decimal(28,0)").groupBy("dim").agg(F.sum("total").alias("total")).collect()
    got = {r["dim"]: int(r["total"]) for r in rows}
    return got.get(dims, 0), [got.get(i, 0) for i in range(dims)]


class Centre:
    """n * x - S of int64 vectors, exact: with S = n * whole + rest, n * (x - whole) - rest."""

    def __init__(self, n: int, total: list[int]):
        self.n = n
        self.whole = np.array([t // n for t in total], np.int64)
        self.rest = np.array([t % n for t in total], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n in double precision."""
        return (x - self.whole) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Sum over the dimensions of (n * x - S)**2; null beyond a long."""
        size = (self.n**2 * self.centred(x) ** 2).sum(1)
        own = self.n * (x - self.whole) - self.rest
        with np.errstate(over="ignore"):
            return pa.array((own * own).sum(1), mask=size >= 2.0**63 * (1 - 1e-9))


def second_moments(fit: DataFrame, dims: int, centre: Centre, project: np.ndarray | None = None) -> np.ndarray:
    """Sum over the fit list of the outer products of the centred (and projected) vectors."""
    size = dims if project is None else project.shape[1]
    shared = fit.sparkSession.sparkContext.broadcast((centre, project))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, by = shared.value
        total, any_row = np.zeros((size, size)), False
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                c = own.centred(_vectors(batch.column(0).slice(start, ROWS_AT_ONCE), dims))
                c = c if by is None else c @ by
                total += c.T @ c
                any_row = True
        if any_row:
            slot = TaskContext.get().partitionId() % SLOTS
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(size, slot, np.int32)), pa.array(np.arange(size, dtype=np.int32)), pa.array([r.tobytes() for r in total], pa.binary())],
                names=["slot", "row", "part"],
            )

    def add(table: pa.Table) -> pa.Table:
        whole = np.sum([np.frombuffer(p) for p in table["part"].to_pylist()], axis=0)
        first = table.slice(0, 1)
        return pa.table({"slot": first["slot"], "row": first["row"], "part": pa.array([whole.tobytes()], pa.binary())})

    schema = "slot int, row int, part binary"
    parts = fit.mapInArrow(run, schema).groupBy("slot", "row").applyInArrow(add, schema)
    rows = parts.groupBy("row").applyInArrow(add, schema).collect()
    shared.unpersist()
    return np.stack([np.frombuffer(bytes(r["part"])) for r in sorted(rows, key=lambda r: r["row"])])


def whiten(rows: DataFrame, components: int = 16, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error: a row for each
    row of ``rows`` that counts and each of the ``components`` largest components."""
    out = f"`{id_column}` {rows.schema[id_column].dataType.simpleString()}, n long, deviation long, whitened array<double>"
    sizes = rows.where(F.size(column) > 0).groupBy(F.size(column).alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    dims = sizes[0]["dims"] if sizes else 0
    if dims > MAX_DIMS:
        raise ValueError(f"vectors of {dims} entries: at most {MAX_DIMS} are supported")
    n, total, fit = 0, [], None
    if dims:
        fit = store(fit_list(rows, column, dims), "fit-list")
        n, total = sums(fit, dims)
    if not n:
        nothing = rows.sparkSession.createDataFrame([], out)
        values, error, trace = np.zeros(0), 0.0, 1.0
    else:
        centre = Centre(n, total)
        covariance = second_moments(fit, dims, centre) / n
        trace = float(np.trace(covariance))
        values, vectors = eigenvectors(covariance, components)
        varied = values > FLAT * trace
        scaled = vectors / np.sqrt(np.where(varied, values, 1.0))
        error = 0.0
        if varied.any():
            own = second_moments(fit, dims, centre, scaled[:, varied]) / n
            error = float(np.abs(own - np.eye(len(own))).max())
    if not len(values):
        mapped = nothing
    else:
        shared = rows.sparkSession.sparkContext.broadcast((centre, scaled, varied))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, project, counts = shared.value
            width = project.shape[1]
            flat = np.flatnonzero(~counts)
            for batch in batches:
                for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                    part = batch.slice(start, ROWS_AT_ONCE)
                    x, at = _fixed(part, column, dims)
                    projected = own.centred(x) @ project
                    mask = np.zeros(projected.shape, bool)
                    mask[:, flat] = True
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) * width + 1, width, dtype=np.int32)), pa.array(projected.ravel(), mask=mask.ravel()))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(at), pa.array(np.full(len(x), own.n, np.int64)), own.deviation(x), lists], names=[id_column, "n", "deviation", "whitened"]
                    )

        mapped = spread(rows.select(id_column, column)).mapInArrow(run, out)
    shares = F.array(*[F.lit(float(max(v, 0.0) / trace) if trace > 0 else 0.0) for v in values]) if len(values) else F.array().cast("array<double>")
    single = mapped.select(id_column, "n", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return single.select(
        id_column,
        (F.col("place") + 1).alias("component"),
        "n",
        "deviation",
        "whitened",
        F.get(shares, F.col("place")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
