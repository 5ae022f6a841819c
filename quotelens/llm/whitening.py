"""Whitening of embeddings: leading principal components by Jacobi-Davidson with distributed products.

The covariance is never formed. All that the solver asks of it are products with a few vectors, and
each product is one pass over the stored fit list: tasks centre their rows, multiply twice and give
one partial block, Spark adds the blocks up. The driver holds vectors of one embedding's length only.

The solver keeps a subspace. Rayleigh-Ritz in it gives the leading pairs; each pair that is not yet
exact asks for a correction, orthogonal to what is locked and to the pairs at hand, whose equation
some steps of MINRES solve (all pairs' equations share each pass); the corrections extend the
subspace, which restarts from its best vectors when it is full. Pairs are locked in order once their
residual is down to rounding, and a locked pair is given up again if a larger one turns up behind it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from .common import read, stored

SCALE, COMPONENTS = 256, 4
#: Pairs beyond the wanted ones that are followed too, so that close eigenvalues are told apart.
GUARD = 8
INNER, OUTER = 4, 400
#: A residual is rounding once it is below this share of the largest eigenvalue.
EXACT = 64 * np.finfo(float).eps
Product = Callable[[np.ndarray], np.ndarray]


def _orthonormal(block: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """Columns of a block made orthonormal and orthogonal to others (twice, for rounding); dependent ones go."""
    kept: list[np.ndarray] = []
    for column in block.T:
        size = np.linalg.norm(column)
        if not np.isfinite(size) or size == 0:
            continue
        column = column / size
        for _ in range(3):
            before = np.linalg.norm(column)
            for basis in (*against, np.array(kept).T if kept else None):
                if basis is not None and basis.shape[1]:
                    column = column - basis @ (basis.T @ column)
            after = np.linalg.norm(column)
            if after < 1e-12:
                break
            column = column / after
            if after > 0.7 * before:
                break
        if after >= 1e-12:
            kept.append(column)
    return np.array(kept).T if kept else np.zeros((len(block), 0))


def minres(product: Product, shifts: np.ndarray, right: np.ndarray, away: np.ndarray, steps: int, goal: float) -> np.ndarray:
    """Solve (A - shift) x = right for all columns side by side, in the complement of ``away``'s columns."""
    project = lambda block: block - away @ (away.T @ block)
    v = project(right)
    beta = np.linalg.norm(v, axis=0)
    x, v_old, d, d_old = np.zeros_like(v), np.zeros_like(v), np.zeros_like(v), np.zeros_like(v)
    start = np.where(beta > 0, beta, 1)
    v, residual, alive = v / start, beta.copy(), beta > 0
    cos, sin, cos_old, sin_old = np.ones(len(beta)), np.zeros(len(beta)), np.ones(len(beta)), np.zeros(len(beta))
    beta_now = np.zeros(len(beta))
    for _ in range(steps):
        if not alive.any():
            break
        w = project(product(v) - v * shifts) - v_old * beta_now
        alpha = (v * w).sum(0)
        w = project(w - v * alpha)
        beta_next = np.linalg.norm(w, axis=0)
        # Two earlier rotations, then the one that clears the entry below the diagonal.
        far = sin_old * beta_now
        near = cos_old * beta_now
        upper, diagonal = cos * near + sin * alpha, cos * alpha - sin * near
        length = np.hypot(diagonal, beta_next)
        alive &= length > 1e-300
        safe = np.where(alive, length, 1)
        cos_old, sin_old, cos, sin = cos, sin, np.where(alive, diagonal / safe, 1), np.where(alive, beta_next / safe, 0)
        d, d_old = np.where(alive, (v - d * upper - d_old * far) / safe, 0), d
        x = x + np.where(alive, d * (cos * residual), 0)
        residual = np.where(alive, -sin * residual, residual)
        alive &= (np.abs(residual) > goal * beta) & (beta_next > 1e-14 * np.maximum(np.abs(alpha), 1e-300))
        v_old, beta_now = v, beta_next
        v = w / np.where(beta_next > 0, beta_next, 1)
    return project(x)


class Pairs(NamedTuple):
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray


def leading(product: Product, size: int, wanted: int, seed: int = 7, inner: int = INNER) -> Pairs:
    """The ``wanted`` largest eigenpairs of a symmetric matrix without negative eigenvalues, known by its products.

    Fewer if the size is smaller. All residuals are down to rounding; raises if they can't be.
    """
    wanted = min(wanted, size)
    follow = min(size, wanted + GUARD)
    room = min(size, 5 * follow)
    basis = _orthonormal(np.random.default_rng(seed).standard_normal((size, follow)))
    image = product(basis)
    locked, locked_image, values = np.zeros((size, 0)), np.zeros((size, 0)), np.zeros(0)
    scale, best, stuck = 0.0, np.inf, 0
    for outer in range(OUTER):
        inside = basis.T @ image
        ritz, turn = np.linalg.eigh((inside + inside.T) / 2)
        ritz, turn = ritz[::-1], turn[:, ::-1]
        basis, image = basis @ turn, image @ turn
        scale = max(scale, np.abs(ritz).max(initial=0), np.abs(values).max(initial=0))
        if scale == 0:
            break
        if len(values) and len(ritz) and ritz[0] > values.min() + EXACT * scale:
            # A larger pair came up behind a locked one: give the locked ones back to the subspace.
            basis, image = np.hstack([locked, basis]), np.hstack([locked_image, image])
            locked, locked_image, values = locked[:, :0], locked_image[:, :0], values[:0]
            continue
        rest = image - locked @ (locked.T @ image) - basis * ritz
        norms = np.linalg.norm(rest, axis=0)
        done = 0
        while done < len(ritz) and len(values) + done < wanted and norms[done] <= EXACT * scale:
            done += 1
        if done:
            locked, locked_image = np.hstack([locked, basis[:, :done]]), np.hstack([locked_image, image[:, :done]])
            values = np.append(values, ritz[:done])
            basis, image, ritz, rest, norms = basis[:, done:], image[:, done:], ritz[done:], rest[:, done:], norms[done:]
        whole = basis.shape[1] + locked.shape[1] >= size
        if len(values) >= wanted:
            # The next pair must be known well enough to say that it is not larger than any locked one.
            if whole or not len(ritz) or ritz[0] + norms[0] <= values.min() or norms[0] <= np.sqrt(EXACT) * scale:
                break
        if whole or room <= basis.shape[1]:
            # Start anew from the best vectors with products of their own, free of what rounding piled up.
            basis = _orthonormal(basis[:, : size if whole else follow], locked)
            image = product(basis)
            if whole:
                stuck += 1
                if stuck > 3:
                    raise ArithmeticError(f"residuals stay at {norms.max() / scale:.1e} of the largest eigenvalue")
                continue
            inside = basis.T @ image
            ritz = np.diag(inside).copy()
            rest = image - locked @ (locked.T @ image) - basis * ritz
            norms = np.linalg.norm(rest, axis=0)
        open_pairs = min(len(ritz), follow - len(values))
        if norms[0] < best:
            best = norms[0]
        targets = [i for i in range(open_pairs) if norms[i] > EXACT * scale] or [0]
        away = np.hstack([locked, basis[:, :open_pairs]])
        corrections = minres(product, ritz[targets], -rest[:, targets], away, inner, 2.0 ** -(outer + 2))
        new = _orthonormal(corrections, locked, basis)
        if not new.shape[1]:
            new = _orthonormal(rest[:, targets], locked, basis)
        if not new.shape[1]:
            new = _orthonormal(np.random.default_rng(seed + outer + 1).standard_normal((size, 1)), locked, basis)
        basis, image = np.hstack([basis, new]), np.hstack([image, product(new)])
    else:
        raise ArithmeticError("the leading components did not settle")
    if scale == 0:
        return Pairs(np.zeros(wanted), np.eye(size)[:, :wanted], np.zeros(wanted))
    order = np.argsort(-values, kind="stable")
    vectors = locked[:, order]
    residuals = np.linalg.norm(locked_image[:, order] - vectors * values[order], axis=0)
    # Either sign is right; the entry of the largest size is made positive.
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return Pairs(values[order], vectors, residuals)


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact sums per dimension, as two halves that cannot overflow: x = high * 2^32 + low."""
    for batch in batches:
        if batch.num_rows:
            x = _rows(batch.column(0))
            high, low = (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(x.shape[1])), pa.array(high), pa.array(low)], ["i", "high", "low"])


def centred_product(fit: DataFrame, mean: np.ndarray, n: int) -> Product:
    """Products of the fit list's covariance (divisor n) with the columns of a block, one pass each."""

    def product(block: np.ndarray) -> np.ndarray:
        if not block.shape[1]:
            return block.copy()

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(block.shape)
            for batch in batches:
                if batch.num_rows:
                    centred = _rows(batch.column(0)) - mean
                    total += centred.T @ (centred @ block)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.reshape(-1))], ["i", "y"])

        parts = fit.select("x").mapInArrow(partial, "i long, y double").groupBy("i").agg(F.sum("y").alias("y"))
        out = np.zeros(block.size)
        for row in parts.collect():
            out[row.i] = row.y
        return out.reshape(block.shape) / n

    return product


class Whitening(NamedTuple):
    """What one vector length was fitted to; ``variance`` is the covariance's trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    variance: float
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)^2, exact; null where that is no long."""
        sums = np.array(self.sums, dtype=object)
        top = max((abs(int(e) * self.n - s) for row in (x.max(0), x.min(0)) for e, s in zip(row, self.sums)), default=0)
        if len(self.sums) * top * top < 2**63 and self.n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) < 2**63:
            return np.square(x * self.n - np.array(self.sums, np.int64)).sum(1).tolist()
        exact = [int(((row.astype(object) * self.n - sums) ** 2).sum()) for row in x]
        return [e if e < 2**63 else None for e in exact]


def fit(listed: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit on a stored list of x-vectors of one length; None where it is empty. Components without variance are left out."""
    totals = listed.select("x").mapInArrow(_sums, "i long, high long, low long").groupBy("i")
    halves = totals.agg(F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low")).orderBy("i").collect()
    n = listed.count()
    if not n or not halves:
        return None
    sums = [int(r.high) * 2**32 + int(r.low) for r in halves]
    mean = np.array([s / n for s in sums])
    found = leading(centred_product(listed, mean, n), len(sums), components)

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([float(np.square(_rows(batch.column(0)) - mean).sum())])], ["s"])

    variance = (listed.select("x").mapInArrow(squares, "s double").agg(F.sum("s")).first()[0] or 0.0) / n
    real = found.values > len(sums) * np.finfo(float).eps * max(variance, 0)
    kept = Whitening(n, sums, found.values[real], found.vectors[:, real], found.residuals[real], variance, 0.0)
    k = int(real.sum())
    if not k:
        return kept

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                w = kept.whiten(_rows(batch.column(0)))
                both = np.hstack([np.ones((len(w), 1)), w])
                total = both.T @ both
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.reshape(-1))], ["i", "y"])

    sums_of = {r.i: r.y for r in listed.select("x").mapInArrow(gram, "i long, y double").groupBy("i").agg(F.sum("y").alias("y")).collect()}
    moments = np.array([sums_of[i] for i in range((k + 1) ** 2)]).reshape(k + 1, k + 1) / n
    error = np.abs(moments[1:, 1:] - np.outer(moments[0, 1:], moments[0, 1:]) - np.eye(k)).max()
    return kept._replace(identity_error=float(error))


def scaled(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and x = floor(256 * entry) as longs, of the rows whose vector is neither null nor holds null or non-finite entries."""
    rows = vectors.select("vec_id", F.col(column).cast("array<double>").alias("v"))
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    usable = rows.where("v is not null").where(~F.exists("v", bad))
    return usable.select("vec_id", F.transform("v", lambda e: F.floor(e * F.lit(float(SCALE)))).alias("x"))


def _apply(fitted: Whitening):
    k = len(fitted.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                x = _rows(part.column(1))
                m = len(x)
                deviation = np.repeat(np.array(fitted.deviations(x), dtype=object), k)
                columns = [
                    part.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                    pa.array(np.full(m * k, fitted.n)),
                    pa.array(deviation, pa.int64()),
                    pa.array(fitted.whiten(x).reshape(-1)),
                    pa.array(np.tile(fitted.values / fitted.variance, m)),
                    pa.array(np.full(m * k, fitted.identity_error)),
                    pa.array(np.tile(fitted.values, m)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "eigenvalue"])

    return run


def whitened(vectors: DataFrame, components: int = COMPONENTS, column: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, eigenvalue: a row per usable row and component.

    The fit list holds each distinct x-vector once; rows that repeat, and null or repeated vec_ids,
    are rows of the result like others. Vectors of different lengths are fitted length by length.
    Components without variance (all, where only one distinct vector is left) cannot be whitened and
    give no rows, nor do empty vectors; an empty table gives an empty result. Entries whose 256-fold
    exceeds a long are held at its ends, and a deviation beyond a long is null. Other columns are
    ignored.
    """
    spark = vectors.sparkSession
    rows = scaled(vectors, column)
    listed = stored(rows.select("x").distinct())
    schema = StructType(
        [
            vectors.schema["vec_id"],
            StructField("component", IntegerType()),
            *(StructField(c, LongType()) for c in ("n", "deviation")),
            *(StructField(c, DoubleType()) for c in ("whitened", "explained", "identity_error", "eigenvalue")),
        ]
    )
    lengths = sorted(r.n for r in listed.select(F.size("x").alias("n")).distinct().collect() if r.n)
    out = spark.createDataFrame([], schema)
    for n in lengths:
        # One length is the rule, and its list is read as it stands.
        own = lambda frame: frame.where(F.size("x") == n)  # noqa: E731, B023
        fitted = fit(listed if len(lengths) == 1 else own(listed), components)
        if fitted is not None and len(fitted.values):
            out = out.unionByName(own(rows).mapInArrow(_apply(fitted), schema)) if len(lengths) > 1 else own(rows).mapInArrow(_apply(fitted), schema)
    return out


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    return whitened(read(spark, sf_dir, "embeddings"))
