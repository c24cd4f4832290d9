"""Embedding whitening: leading principal components by block Lanczos, with nothing but passes over the vectors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from . import common as C

#: A Ritz pair is done when its residual is below this share of the largest eigenvalue, an eigenvalue is none below it.
TOLERANCE = 1e-13
#: Basis vectors kept before the iteration restarts from its best ones.
BASIS = 160
SCALE, SHIFT = 1024, 100_000
#: Larger scaled entries count as this, so that they and their sums stay longs.
LARGEST = float(1 << 40)


def usable(vector: Column) -> Column:
    """Whether a vector is there and has finite entries only."""
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def fixed_point(vector: Column) -> Column:
    """Entries as longs: floor(1024 * c) + 100000, with floor(1024 * c) at most LARGEST in size."""
    inside = lambda c: F.greatest(F.least(c.cast("double") * SCALE, F.lit(LARGEST)), F.lit(-LARGEST))
    return F.transform(vector, lambda c: F.floor(inside(c)).cast("long") + SHIFT)


class Pass:
    """Sums over all vectors. Each task adds up its own rows in numpy and sends one number per cell of the sum."""

    def __init__(self, vectors: DataFrame, dim: int):
        self.vectors, self.dim = vectors, dim

    def total(self, of: Callable[[np.ndarray], np.ndarray], exact: bool = False) -> np.ndarray:
        """The sum over batches of ``of(batch)``, a flat array; exact: of longs."""
        dim, kind = self.dim, np.int64 if exact else np.float64

        def part(batches):
            done = None
            for batch in batches:
                if batch.num_rows:
                    x = of(matrix(batch.column(0), dim))
                    done = x if done is None else done + x
            if done is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(done)), pa.int64()), pa.array(done.astype(kind))], names=["at", "value"])

        found = self.vectors.select("x").mapInArrow(part, f"at long, value {'long' if exact else 'double'}")
        rows = found.groupBy("at").agg(F.sum("value").alias("value")).collect()
        out = np.zeros(max((r["at"] for r in rows), default=-1) + 1, kind)
        for r in rows:
            out[r["at"]] = r["value"]
        return out


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column of longs as rows of a matrix; entries that a shorter vector lacks are as if 0 before scaling."""
    sizes = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.full((len(sizes), dim), SHIFT, np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def orthonormal(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(q, r) with block = q r + what lies in the basis, q orthonormal and orthogonal to the basis; twice over, as once
    leaves rounding errors. Columns that vanish (breakdown) are replaced by random directions, with zeros in r; where the
    space has no more directions, columns are left out."""
    room = block.shape[0] - basis.shape[1]
    out, r = np.zeros((block.shape[0], 0)), np.zeros((0, block.shape[1]))
    for j in range(block.shape[1]):
        v, before = block[:, j].copy(), np.zeros(out.shape[1])
        for _ in range(2):
            v -= basis @ (basis.T @ v)
            c = out.T @ v
            v -= out @ c
            before += c
        size = np.linalg.norm(v)
        fresh = size <= scale * TOLERANCE
        if fresh and out.shape[1] >= room:
            r[:, j] = before
            continue
        if fresh:
            v, size = rng.standard_normal(len(v)), 0.0
            for _ in range(3):
                v -= basis @ (basis.T @ v)
                v -= out @ (out.T @ v)
                v /= np.linalg.norm(v)
        else:
            v /= size
        r = np.vstack([r, np.zeros(block.shape[1])])
        r[:-1, j], r[-1, j] = before, size
        out = np.column_stack([out, v])
    return out, r


def block_lanczos(apply: Callable[[np.ndarray], np.ndarray], dim: int, k: int, block: int = 8, basis_size: int = BASIS, seed: int = 7, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric non-negative matrix known by ``apply`` alone: the
    k largest, or all where there are fewer.

    Each step applies the matrix to one block, orthogonalises the outcome against the whole basis and keeps the
    coefficients, so that the projected matrix needs no further pass. It ends when the residuals of the k best pairs, which
    the last block's remainder gives, are below TOLERANCE times the largest eigenvalue, or when the basis spans the space. A
    basis of basis_size vectors is cut down to its best Ritz vectors, whose images are known too. A block that breaks
    down is filled up with random directions. A block has k columns at least: it then holds k directions of an eigenvalue
    of any multiplicity."""
    rng, k = np.random.default_rng(seed), min(k, dim)
    block = max(block, k)
    keep = max(2 * k, k + block)
    basis_size = max(basis_size, keep + 2 * block)
    basis, images = np.zeros((dim, 0)), np.zeros((dim, 0))
    now, _ = orthonormal(rng.standard_normal((dim, min(block, dim))), basis, rng, 1.0)
    for _ in range(rounds):
        image = apply(now)
        basis, images = np.column_stack([basis, now]), np.column_stack([images, image])
        small = basis.T @ images
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(values)[::-1]
        values, vectors = values[order], vectors[:, order]
        scale = max(abs(values[0]), np.finfo(float).tiny)
        rest = images - basis @ small
        if basis.shape[1] >= dim:
            break
        if basis.shape[1] >= k and np.linalg.norm(rest @ vectors[:, :k], axis=0).max() <= scale * TOLERANCE:
            break
        if basis.shape[1] + block > basis_size:
            basis, images = basis @ vectors[:, :keep], images @ vectors[:, :keep]
            rest = images - basis @ (basis.T @ images)
            sizes = np.linalg.norm(rest, axis=0)
            now, _ = orthonormal(rest[:, np.argsort(sizes)[::-1][:block]], basis, rng, scale)
        else:
            now, _ = orthonormal(rest[:, -now.shape[1] :], basis, rng, scale)
    found = basis @ vectors[:, :k]
    return values[:k], found / np.linalg.norm(found, axis=0)


def whiten(vectors: DataFrame, k: int = 8, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 8) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): every usable vector on each of the k leading
    components of the covariance (divisor n) of all usable ones, in fixed-point entries x.

    Vectors that are null or hold null or non-finite entries are left out; null ids, repeated ids and repeated vectors are
    rows of their own; shorter vectors are filled up with entries of 0; other columns are left out. Components with an
    eigenvalue of 0 can't be whitened and are left out, so an empty table, or one whose vectors are all the same, gives no
    rows. deviation is exact, and null where it does not fit a long (never below a million vectors of entries under 1).

    Passes over the vectors: numbers and sums (exact longs), trace from the deviations, one per Lanczos step, the
    covariance of the outcome. Entries of 2^30 or more count as 2^30. What a task sends is a sum of fixed size; the driver holds the basis, dim x BASIS numbers."""
    id_type = vectors.schema[id_col].dataType
    schema = StructType([
        StructField("vec_id", id_type), StructField("component", IntegerType()), StructField("n", LongType()), StructField("deviation", LongType()),
        StructField("whitened", DoubleType()), StructField("explained", DoubleType()), StructField("identity_error", DoubleType()),
    ])
    kept = C.kept_table(vectors.filter(usable(F.col(vector_col))).select(F.col(id_col).alias("vec_id"), fixed_point(F.col(vector_col)).alias("x")))
    n, dim = kept.agg(F.count("*"), F.max(F.size("x"))).first()
    if not n or not dim:
        return vectors.sparkSession.createDataFrame([], schema)
    sums = Pass(kept, dim)
    total = sums.total(lambda x: x.sum(axis=0), exact=True)
    base = total // n
    rest = (total - base * n) / n

    def centred(x):
        return (x - base) - rest

    trace = sums.total(lambda x: np.array([float(np.square(centred(x)).sum())]))[0] / n
    if not trace > 0:
        return vectors.sparkSession.createDataFrame([], schema)

    def covariance_times(v):
        def of(x):
            c = centred(x)
            return (c.T @ (c @ v)).ravel()

        return sums.total(of).reshape(dim, -1) / n

    values, axes = block_lanczos(covariance_times, dim, k, block)
    axes = axes[:, values > values[0] * TOLERANCE * dim]
    values = values[: axes.shape[1]]
    k = axes.shape[1]
    whitening = axes / np.sqrt(values)

    def moments(x):
        w = centred(x) @ whitening
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    sent = sums.total(moments)
    mean = sent[:k] / n
    error = float(np.abs(sent[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())
    explained = values / trace

    def part(batches):
        for batch in batches:
            x = matrix(batch.column(1), dim)
            m = len(x)
            w = centred(x) @ whitening
            gaps = n * x - total
            exact = np.square(gaps).sum(axis=1)
            fits = np.square(n * centred(x)).sum(axis=1) < 9.2e18
            rows = np.repeat(np.arange(m), k)
            columns = [
                batch.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)),
                pa.array(exact[rows], mask=~fits[rows]), pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return kept.mapInArrow(part, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
