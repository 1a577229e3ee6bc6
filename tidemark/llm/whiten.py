"""Embedding whitening by a block Jacobi-Davidson method.

The covariance of the vectors is never formed: Spark multiplies it with a few vectors at a time (`Fit.product`), each task
centring its own rows before it multiplies, and only sums of the size of those vectors reach the driver. There, a subspace
holds approximations: Rayleigh-Ritz picks the best in it, pairs whose residuals are down to double precision are locked
(in the order of their eigenvalues, so that none is passed over), and for the next ones the projected correction equations
are solved by MINRES, all of a block at once, one product for each inner step. The subspace grows by the corrections and
is cut back to its best vectors when it is full.

Entries become whole numbers, floor(64 c) + 1,000,000, so that sums are exact. Vectors are written once to the shared
folder as blocks of rows, which every product reads; the blocks are deleted when the components are known. What is returned
reads the given table alone.

Defined results. Dropped: rows whose vector is null, is empty, or holds null or non-finite entries, and those of another
length than most vectors have (of equally frequent lengths, the greatest counts). Entries beyond 2^44 / 64 in size are taken
as that. Components of no variance (an eigenvalue under 1e-12 of the greatest) are not returned, as they cannot be scaled to
one: a single row, or equal rows alone, give no rows. deviation is null where it does not fit a long. Null and repeated ids:
each row for itself. Further columns are not carried.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, remove, shared_dir

SCALE, SHIFT, FARTHEST = 64, 1_000_000, 1 << 44
COMPONENTS = 32
#: Rows of a block.
BLOCK_ROWS = 1024
#: Corrections that are solved at once, inner steps for each, and vectors of the subspace in proportion to the components asked for.
BLOCK, INNER_STEPS, SUBSPACE = 16, 8, 4
#: A pair is locked when its residual, in proportion to the greatest eigenvalue, is down to this: some hundred roundings.
RESIDUAL = 512 * np.finfo(float).eps
OUTER_STEPS = 200
NO_VARIANCE = 1e-12


def whole_numbers(vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: places of the usable vectors of that length, and their entries as whole numbers less `SHIFT`."""
    sizes = np.asarray(vectors.value_lengths().fill_null(0))
    found = {}
    for length in np.unique(sizes[sizes > 0]).tolist():
        places = np.flatnonzero(sizes == length)
        flat = vectors.take(pa.array(places)).flatten().cast(pa.float64())
        values = np.asarray(flat.fill_null(np.nan)).reshape(len(places), length)
        good = np.isfinite(values).all(1)
        found[length] = places[good], np.clip(np.floor(values[good] * SCALE), -FARTHEST, FARTHEST).astype(np.int64)
    return found


@dataclass(frozen=True)
class Centre:
    """The fit list: how many vectors, and the sums of their whole numbers, less `SHIFT` each."""

    n: int
    sums: np.ndarray

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: whole numbers of any size if they may not fit."""
        most = max(int(np.abs(x).max(initial=0)), int(np.abs(self.sums).max(initial=0)) // max(self.n, 1) + 1)
        return x * self.n - self.sums if most * self.n < 1 << 61 else x.astype(object) * self.n - self.sums.astype(object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.deviations(x).astype(np.float64) / self.n


class Fit:
    """Blocks of vectors in the shared folder, and products with them."""

    def __init__(self, rows: DataFrame):
        self.spark = rows.sparkSession
        self.folder = f"{shared_dir(self.spark)}/whiten-{uuid.uuid4().hex}"

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for length, (_, x) in whole_numbers(batch.column("vector")).items():
                    parts = [x[k : k + BLOCK_ROWS] for k in range(0, len(x), BLOCK_ROWS)]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "length": pa.array([length] * len(parts), pa.int32()),
                            "block": pa.array([p.tobytes() for p in parts], pa.binary()),
                        }
                    )

        rows.mapInArrow(dealt, "length int, block binary").write.option("compression", "zstd").parquet(self.folder)
        blocks = self.spark.read.parquet(self.folder)
        sizes = blocks.groupBy("length").agg(F.sum(F.octet_length("block") / (8 * F.col("length"))).cast("bigint").alias("n"))
        most = sizes.orderBy(F.desc("n"), F.desc("length")).first()
        self.length, self.centre = 0, Centre(0, np.zeros(0, np.int64))
        if most is not None:
            self.length = most["length"]
            self.blocks = blocks.where(F.col("length") == self.length).select("block")
            sums = self.added(lambda x: x.sum(0), self.length, whole=True)
            self.centre = Centre(most["n"], sums)

    def added(self, part: Callable[[np.ndarray], np.ndarray], size: int, whole: bool = False) -> np.ndarray:
        """The sum over all blocks of what `part` makes of one: `size` numbers. Each task adds up its own."""
        length, kind = self.length, "bigint" if whole else "double"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for block in batch.column("block"):
                    own = part(np.frombuffer(block.as_buffer(), np.int64).reshape(-1, length))
                    total = own if total is None else total + own
            if total is not None:
                yield pa.RecordBatch.from_pydict({"place": pa.array(np.arange(size, dtype=np.int32)), "value": pa.array(total.reshape(-1))})

        rows = self.blocks.mapInArrow(run, f"place int, value {kind}").groupBy("place").agg(F.sum("value").alias("value")).toPandas()
        out = np.zeros(size, np.int64 if whole else np.float64)
        out[rows["place"].to_numpy()] = rows["value"].to_numpy()
        return out

    def product(self, w: np.ndarray) -> np.ndarray:
        """The covariance times the columns of w."""
        centre = self.centre

        def part(x: np.ndarray) -> np.ndarray:
            c = centre.centred(x)
            return c.T @ (c @ w)

        return self.added(part, w.size).reshape(w.shape) / centre.n

    def spread(self, scaled: np.ndarray) -> tuple[np.ndarray, float]:
        """The covariance of the centred vectors times `scaled`, itself centred, and the trace of the vectors' covariance."""
        centre, k = self.centre, scaled.shape[1]

        def part(x: np.ndarray) -> np.ndarray:
            c = centre.centred(x)
            z = c @ scaled
            return np.concatenate([(z.T @ z).ravel(), z.sum(0), [(c * c).sum()]])

        total = self.added(part, k * k + k + 1) / centre.n
        mean = total[k * k : -1]
        return total[: k * k].reshape(k, k) - np.outer(mean, mean), float(total[-1])


def orthonormal(new: np.ndarray, *held: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns of `new` add to the orthonormal columns held."""
    size = np.linalg.norm(new, axis=0)
    new = new[:, size > 0] / size[size > 0]
    for _ in range(2):  # once more, against what rounding left
        for h in held:
            new = new - h @ (h.T @ new)
        if not new.shape[1]:
            break
        u, s, _ = np.linalg.svd(new, full_matrices=False)
        new = u[:, s > 1e-10 * max(1.0, s[0])]
    return new


def minres(apply: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int, tolerance: float) -> np.ndarray:
    """Approximate solutions of apply(x) = right for every column at once, `apply` being symmetric; a column that is done no longer moves."""
    norm = np.linalg.norm(right, axis=0)
    x = np.zeros_like(right)
    before, now = np.zeros_like(right), right.copy()
    old_beta, beta, left = np.ones_like(norm), norm.copy(), norm.copy()
    cos, sin = np.full_like(norm, -1.0), np.zeros_like(norm)
    d_bar, eps = np.zeros_like(norm), np.zeros_like(norm)
    w, w_old = np.zeros_like(right), np.zeros_like(right)
    for step in range(steps):
        active = (left > tolerance * norm) & (beta > 1e-14 * norm) & (norm > 0)
        if not active.any():
            break
        safe = np.where(active, beta, 1.0)
        v = np.where(active, now / safe, 0.0)
        y = apply(v)
        if step:
            y = y - before * np.where(active, beta / old_beta, 0.0)
        alpha = (v * y).sum(0)
        y = y - now * (alpha / safe)
        before, now = now, y
        old_beta, beta = safe, np.linalg.norm(y, axis=0)
        old_eps = eps
        delta, gamma_bar = cos * d_bar + sin * alpha, sin * d_bar - cos * alpha
        eps, d_bar = sin * beta, -cos * beta
        gamma = np.maximum(np.hypot(gamma_bar, beta), np.finfo(float).tiny)
        cos, sin = gamma_bar / gamma, beta / gamma
        w, w_old = (v - w_old * old_eps - w * delta) / gamma, w
        x = x + np.where(active, w * (cos * left), 0.0)
        left = np.where(active, left * sin, left)
    return x


def eigenpairs(product: Callable[[np.ndarray], np.ndarray], size: int, wanted: int, block: int = BLOCK, inner: int = INNER_STEPS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The greatest eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix of which only products are known."""
    wanted = min(wanted, size)
    room = min(size, SUBSPACE * wanted + block)
    basis = orthonormal(np.random.default_rng(seed).standard_normal((size, min(size, wanted + block // 2))))
    image = product(basis)
    locked, values, greatest = np.zeros((size, 0)), [], 0.0
    for outer in range(1, OUTER_STEPS + 1):
        h = basis.T @ image
        ritz, turn = np.linalg.eigh((h + h.T) / 2)
        ritz, turn = ritz[::-1], turn[:, ::-1]
        basis, image = basis @ turn, image @ turn
        greatest = max([greatest, *ritz[:1], *values])
        rest = image - basis * ritz
        rest = rest - locked @ (locked.T @ rest)
        norms = np.linalg.norm(rest, axis=0)
        done = 0
        while done < len(ritz) and len(values) + done < wanted and norms[done] <= RESIDUAL * greatest:
            done += 1
        if done:
            locked, values = np.hstack([locked, basis[:, :done]]), [*values, *ritz[:done]]
            basis, image, rest, ritz, norms = basis[:, done:], image[:, done:], rest[:, done:], ritz[done:], norms[done:]
        if len(values) == wanted:
            break
        seek = [k for k in range(min(wanted - len(values), len(ritz))) if norms[k] > RESIDUAL * greatest][:block]
        shift = ritz[seek]
        # Corrections are sought across what is locked and the best vectors that are not.
        known = np.hstack([locked, basis[:, : wanted - len(values)]])

        def across(t: np.ndarray, known: np.ndarray = known) -> np.ndarray:
            return t - known @ (known.T @ t)

        def shifted(t: np.ndarray, shift: np.ndarray = shift, across: Callable = across) -> np.ndarray:
            t = across(t)
            return across(product(t) - t * shift)

        new = minres(shifted, -across(rest[:, seek]), inner, 0.5**outer)
        if basis.shape[1] + len(seek) > room - len(values):
            keep = min(basis.shape[1], wanted - len(values) + block)
            basis, image = basis[:, :keep], image[:, :keep]
        fresh = orthonormal(np.hstack([new, rest[:, seek]]) if basis.shape[1] + len(values) + 2 * len(seek) <= size else new, locked, basis)
        if not fresh.shape[1]:  # corrections within what there is: a direction at random, or a full space
            fresh = orthonormal(np.random.default_rng(seed + outer).standard_normal((size, len(seek))), locked, basis)
        if fresh.shape[1]:
            basis, image = np.hstack([basis, fresh]), np.hstack([image, product(fresh)])
        else:  # the whole space is held: its images anew, in which only rounding is left
            basis = orthonormal(basis, locked)
            image = product(basis)
    else:
        raise ArithmeticError(f"{wanted - len(values)} of {wanted} residuals did not reach double precision in {OUTER_STEPS} steps")
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], locked[:, order]


def whitened(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every usable row and every component."""
    bounded_batches(rows.sparkSession)
    id_type = rows.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    own = rows.select(rows[id_col].alias("id"), rows[vector_col].cast("array<double>").alias("vector"))
    fit = Fit(own.select("vector"))
    try:
        values, vectors = eigenpairs(fit.product, fit.length, components) if fit.length else (np.zeros(0), np.zeros((0, 0)))
        held = values > NO_VARIANCE * values[:1].max(initial=0.0)
        values, vectors = values[held], vectors[:, held]
        if not len(values):
            return rows.sparkSession.createDataFrame([], schema)
        scaled = vectors / np.sqrt(values)
        covariance, trace = fit.spread(scaled)
    finally:
        remove(rows.sparkSession, fit.folder)
    centre, length, k = fit.centre, fit.length, len(values)
    explained, error = values / trace, float(np.abs(covariance - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, x = whole_numbers(batch.column("vector")).get(length, (np.zeros(0, np.int64),) * 2)
            for a in range(0, len(places), BLOCK_ROWS):
                part = x[a : a + BLOCK_ROWS]
                off, m = centre.deviations(part), len(part)
                if off.dtype == object or int(np.abs(off).max()) ** 2 * length >= 1 << 63:
                    squares = [v if v < 1 << 63 else None for v in (off.astype(object) ** 2).sum(1).tolist()]
                else:
                    squares = (off * off).sum(1)
                which = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_pydict(
                    {
                        id_col: batch.column("id").take(pa.array(places[a : a + BLOCK_ROWS])).take(which),
                        "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        "n": pa.array(np.full(m * k, centre.n, np.int64)),
                        "deviation": pa.array(squares, pa.int64()).take(which),
                        "whitened": pa.array(((off.astype(np.float64) / centre.n) @ scaled).ravel()),
                        "explained": pa.array(np.tile(explained, m)),
                        "identity_error": pa.array(np.full(m * k, error)),
                    }
                )

    return own.mapInArrow(run, schema)
