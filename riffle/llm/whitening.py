"""Whitening of embeddings on their leading principal components, found by Jacobi-Davidson.

The covariance V is never built. A product of V with some vectors is one pass over the centred rows: every task gives
its part of sum(c (c . b)), and the parts are added up by a shuffle. The search works on a subspace held by the driver
(``dim`` times some ``2 k`` numbers): Rayleigh-Ritz gives the leading pairs; those whose residual is at the rounding error
of double precision are locked, in order; for the others the correction equation, projected on the complement of what is locked and
of the vector itself, is solved in part by MINRES, all columns in step, so each step is one pass. The solutions widen the subspace.

Centring is exact: entries become whole numbers x, sums S are whole, and n x - S is a whole number that is divided by n.

Defined results: vectors that are null, hold null or non-finite entries, or have another length than most are dropped;
repeated rows count as often as they come, also where their ids are null; entries beyond ``LIMIT`` after scaling count as
the limit; a deviation that does not fit 64 bits is null; components without variance (below ``FLOOR`` of the first one) are
not returned, so there are none for fewer than two different vectors; of equal eigenvalues any basis may come; an empty
table gives an empty result. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riffle.session import stored, table

#: Bound of scaled entries.
LIMIT = 1 << 40
#: Steps of MINRES for each correction, and rounds of the search at most without a new locked pair.
INNER, PATIENCE = 6, 40
#: Share of the first eigenvalue below which a component has no variance.
FLOOR = 1e-12
SEED = 11
Apply = Callable[[np.ndarray], np.ndarray]


def orthogonal(new: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``new`` adds to the orthonormal ``bases``."""
    held = np.concatenate([b for b in bases if b.shape[1]] or [np.zeros((len(new), 0))], axis=1)
    out = np.zeros((len(new), 0))
    for v in new.T:
        size = np.linalg.norm(v)
        if not size or held.shape[1] + out.shape[1] >= len(v):
            continue
        v = v / size
        for _ in range(3):
            v = v - held @ (held.T @ v)
            v = v - out @ (out.T @ v)
            if (size := np.linalg.norm(v)) < 1e-10:
                break
            v = v / size
        else:
            out = np.concatenate([out, v[:, None]], axis=1)
    return out


def minres(apply: Apply, rhs: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions of symmetric systems, one for each column of ``rhs``; ``apply`` takes all columns at once."""
    beta = np.linalg.norm(rhs, axis=0)
    live = beta > 0
    v_old, v = np.zeros_like(rhs), rhs / np.where(live, beta, 1)
    w_old, w, x = np.zeros_like(rhs), np.zeros_like(rhs), np.zeros_like(rhs)
    eta, c_old, c, s_old, s = beta.copy(), *(np.full(rhs.shape[1], f) for f in (1.0, 1.0, 0.0, 0.0))
    beta = np.zeros(rhs.shape[1])
    for _ in range(steps):
        y = apply(v) - v_old * beta
        alpha = (v * y).sum(axis=0)
        y = y - v * alpha
        beta_new = np.linalg.norm(y, axis=0)
        # the new column of the tridiagonal matrix under the two last rotations, and the next rotation
        delta = c * alpha - c_old * s * beta
        rho = np.hypot(delta, beta_new)
        live &= rho > 1e-14 * np.maximum(np.abs(alpha), 1e-300)
        safe = np.where(live, rho, 1)
        w_old, w = w, (v - w_old * (s_old * beta) - w * (s * alpha + c_old * c * beta)) / safe
        c_old, c, s_old, s = c, delta / safe, s, beta_new / safe
        x = x + np.where(live, w * (c * eta), 0)
        eta = -s * eta
        live &= beta_new > 1e-13 * np.maximum(np.abs(alpha), 1e-300)
        v_old, v, beta = v, y / np.where(beta_new > 0, beta_new, 1), beta_new
        if not live.any():
            break
    return x


def leading_pairs(apply: Apply, dim: int, k: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and unit eigenvectors (columns) of a symmetric operator without negative eigenvalues.

    Pairs are locked in order. A residual counts as double precision below some rounding errors of the largest eigenvalue;
    where the subspace has become the whole complement of the locked pairs, Rayleigh-Ritz leaves nothing to correct.
    """
    k = min(k, dim)
    rng = np.random.default_rng(seed)
    basis = orthogonal(rng.standard_normal((dim, min(dim, k + 8))))
    image = apply(basis)
    locked, values = np.zeros((dim, 0)), np.zeros(0)
    widest, waited = 3 * k + 16, 0
    while True:
        small = basis.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        ritz, image = basis @ turn, image @ turn
        basis = ritz
        left = k - locked.shape[1]
        residual = image - ritz * theta
        residual -= locked @ (locked.T @ residual)
        size = np.linalg.norm(residual, axis=0)
        most = max(float(values.max(initial=0)), float(theta.max(initial=0)))
        fine = size <= 32 * np.finfo(float).eps * np.sqrt(dim) * most
        whole = basis.shape[1] + locked.shape[1] >= dim
        n = left if whole else int(np.argmin(np.append(fine[:left], False)))
        locked, values = np.concatenate([locked, ritz[:, :n]], axis=1), np.concatenate([values, theta[:n]])
        basis, image, theta, residual = basis[:, n:], image[:, n:], theta[n:], residual[:, n:]
        if n == left:
            order = np.argsort(-values, kind="stable")
            return values[order], locked[:, order]
        waited = 0 if n else waited + 1
        if waited > PATIENCE:
            raise ArithmeticError("Jacobi-Davidson makes no progress")
        if basis.shape[1] > widest:
            basis, image = basis[:, : 2 * k], image[:, : 2 * k]
        u, shift = basis[:, : left - n], theta[: left - n]

        def project(t: np.ndarray, u: np.ndarray = u) -> np.ndarray:
            t = t - locked @ (locked.T @ t)
            return t - u * (u * t).sum(axis=0)

        corrections = minres(lambda t, shift=shift: project(apply(t) - t * shift), -project(residual[:, : left - n]), INNER)
        new = orthogonal(corrections, locked, basis)
        if not new.shape[1]:
            new = orthogonal(rng.standard_normal((dim, 2)), locked, basis)
        basis, image = np.concatenate([basis, new], axis=1), np.concatenate([image, apply(new)], axis=1)


def whole_entries(rows: DataFrame, scale: int = 64, shift: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """``vec_id, x`` of the vectors that take part, as whole numbers, and their length."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    found = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.coalesce(fine, F.lit(False)) & (F.size("v") > 0))
    x = F.transform("v", lambda c: F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), c * scale))) + shift)
    found = stored(found.select("vec_id", x.alias("x")))
    lengths = found.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = lengths.n if lengths else 1
    return found.where(F.size("x") == dim), dim


def _flat(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def summed(parts: DataFrame) -> np.ndarray:
    """Adds up the arrays (column ``part``) of all tasks, element by element; as many numbers come back as one array has."""
    each = parts.select(F.posexplode("part").alias("at", "v"))
    found = each.groupBy("at").agg(F.sum("v").alias("v")).toPandas()  # bounded: one row for each element
    return found.sort_values("at")["v"].to_numpy()


def sums(entries: DataFrame, dim: int) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import decimal

        n, total = 0, [0] * dim
        for batch in batches:
            x = _flat(batch.column(0), dim)
            for at in range(0, len(x), 1 << 20):  # LIMIT times as many rows still fit 64 bits
                total = [a + b for a, b in zip(total, x[at : at + (1 << 20)].sum(axis=0).tolist(), strict=True)]
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array([[decimal.Decimal(v) for v in (n, *total)]], pa.list_(pa.decimal128(38, 0)))], names=["part"])

    found = summed(entries.select("x").mapInArrow(run, "part array<decimal(38,0)>"))
    return (int(found[0]), [int(v) for v in found[1:]]) if len(found) else (0, [0] * dim)


def centred(entries: DataFrame, dim: int, n: int, total: list[int]) -> DataFrame:
    """``vec_id, deviation, c``: n x - S divided by n, and the sum of the squares of n x - S, exactly."""
    top = (1 << 63) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _flat(batch.column(1), dim)
            apart = np.array([n * int(x.max(initial=0)) - min(total), max(total) - n * int(x.min(initial=0))], object)
            most = int(max(map(abs, apart)))
            if most < 1 << 62 and n * int(np.abs(x).max(initial=0)) < 1 << 62 and max(map(abs, total)) < 1 << 62:
                d = n * x - np.array(total, np.int64)
            else:
                d = n * x.astype(object) - np.array(total, object)
            squares = (d * d).sum(axis=1) if most * most * dim < 1 << 62 else [s if (s := int((row.astype(object) ** 2).sum())) <= top else None for row in d]
            c = (d.astype(float) / n).reshape(-1)
            offsets = pa.array(np.arange(0, len(c) + 1, dim, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(squares, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(c))], names=["vec_id", "deviation", "c"])

    return entries.select("vec_id", "x").mapInArrow(run, "vec_id long, deviation long, c array<double>")


def covariance_product(rows: DataFrame, dim: int, n: int) -> Apply:
    """V times a block of vectors: one pass over the centred rows."""

    def apply(b: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(b.shape)
            for batch in batches:
                c = _flat(batch.column(0), dim)
                total += c.T @ (c @ b)
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["part"])

        return summed(rows.select("c").mapInArrow(run, "part array<double>")).reshape(b.shape) / n

    return apply


def identity_error(rows: DataFrame, map_to: np.ndarray, dim: int, n: int) -> float:
    """The largest entry of the covariance of the whitened rows, less the identity."""
    k = map_to.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = _flat(batch.column(0), dim) @ map_to
            total += np.concatenate([w.T @ w, w.sum(axis=0)[None]])
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["part"])

    total = summed(rows.select("c").mapInArrow(run, "part array<double>")).reshape(k + 1, k) / n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def trace(rows: DataFrame) -> float:
    """The sum of all variances, times the number of rows."""
    return float(rows.agg(F.sum(F.aggregate("c", F.lit(0.0), lambda a, v: a + v * v))).first()[0] or 0.0)


def whitened(rows: DataFrame, components: int = 32, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each row (vec_id, embedding) and leading component."""
    kind = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    entries, dim = whole_entries(rows, scale, shift)
    n, total = sums(entries, dim)
    if not n:
        return rows.sparkSession.createDataFrame([], kind)
    base = stored(centred(entries, dim, n, total))
    values, vectors = leading_pairs(covariance_product(base, dim, n), dim, components)
    some = int((values > max(FLOOR * float(values[0]), 0.0)).sum())
    if not some:
        return rows.sparkSession.createDataFrame([], kind)
    map_to = vectors[:, :some] / np.sqrt(values[:some])
    error, variance = identity_error(base, map_to, dim, n), trace(base) / n
    offset = np.arange(1, some + 1, dtype=np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = _flat(batch.column(2), dim) @ map_to
            at = pa.array(np.repeat(np.arange(len(w)), some))
            columns = [batch.column(0).take(at), pa.array(np.tile(offset, len(w))), pa.array(np.full(w.size, n)), batch.column(1).take(at), pa.array(w.ravel())]
            columns += [pa.array(np.tile(values[:some] / variance, len(w))), pa.array(np.full(w.size, error))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return base.select("vec_id", "deviation", "c").mapInArrow(run, kind)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {"op11_embedding_whitening": op11_embedding_whitening}
#: The search iterates, and eigenvectors come with either sign: no SQL gives the same rows.
ORACLES: dict[str, str] = {}
