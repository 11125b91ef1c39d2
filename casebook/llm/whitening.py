"""Whitening of vectors by the eigenvectors of their covariance, refined from float32 to double precision.

The covariance is summed up on Spark. Its eigenvectors are taken in float32 and corrected by the iteration of Ogita and
Aishima (2018), which needs products of matrices only; products run in double and at last in extended precision.
Where eigenvalues lie too close together for a correction, the vectors of such a cluster are turned by an eigenproblem
of the cluster's own size, shifted to its middle (the authors' second paper, 2019).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm.vectors import finite, matrix

BLOCK = 1 << 16  # entries of a matrix that travel in one row
PARTS = 32  # partial sums of tasks are added up in so many tasks first
ROUNDS = 12
NO_VARIANCE = 1e-13  # an eigenvalue below this part of the greatest is no variance but rounding


def _corrected(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """One correction of approximate eigenvectors: the new ones, its size, and which pairs lie too close for it."""
    r = np.eye(len(a), dtype=a.dtype) - x.T @ x
    s = x.T @ (a @ x)
    r, s = (r + r.T) / 2, (s + s.T) / 2  # else rounding over a small gap would cost orthogonality
    values = np.diag(s) / (1 - np.diag(r))
    spread = np.linalg.norm((s - np.diag(values)).astype(np.float64))
    bound = 2 * (spread + np.linalg.norm(a.astype(np.float64)) * np.linalg.norm(r.astype(np.float64)))
    gaps = values[None, :] - values[:, None]
    near = np.abs(gaps) <= bound
    e = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, gaps))
    np.fill_diagonal(near, False)
    return x + x @ e, float(np.abs(e).max()), near


def _clusters(near: np.ndarray) -> list[np.ndarray]:
    """Groups of columns joined by close pairs."""
    left, found = set(np.flatnonzero(near.any(1)).tolist()), []
    while left:
        group, edge = set(), {min(left)}
        while edge:
            group |= edge
            edge = set(np.flatnonzero(near[sorted(edge)].any(0)).tolist()) - group
        left -= group
        found.append(np.array(sorted(group)))
    return found


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, to double precision."""
    scale = float(np.abs(a).max()) if a.size else 0.0
    if scale == 0:
        return np.zeros(len(a)), np.eye(len(a))
    a = (a / scale + (a / scale).T) / 2
    x = np.linalg.eigh(a.astype(np.float32))[1]
    for kind, enough in ((np.float64, 1e-7), (np.longdouble, 1e-16)):
        b, x = a.astype(kind), x.astype(kind)
        for _ in range(ROUNDS):
            x, change, near = _corrected(b, x)
            for of in _clusters(near):
                part = x[:, of]
                middle = np.trace(part.T @ (b @ part)) / len(of)
                small = part.T @ (b @ part - middle * part)
                size = max(float(np.abs(small).max()), np.finfo(np.float64).tiny)
                x[:, of] = part @ np.linalg.eigh((small / size).astype(np.float64))[1].astype(kind)
            if change <= enough:
                break
    x = x / np.sqrt((x * x).sum(0))
    values = ((b @ x) * x).sum(0)
    order = np.argsort(-values, kind="stable")
    return (values[order] * scale).astype(np.float64), x[:, order].astype(np.float64)


@dataclass
class Whitening:
    """What a fit knows: size and sums of the fit list, its covariance, eigenvalues (falling) and eigenvectors."""

    n: int
    sums: list  # whole numbers, exact, where the vectors are
    whole: bool
    base: np.ndarray  # the mean is base + rest; whole vectors less their whole base lose no digit
    rest: np.ndarray
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @property
    def dims(self) -> int:
        return len(self.sums)

    @property
    def explained(self) -> np.ndarray:
        """Each component's share of the variance; 0 where there is none."""
        trace = float(np.trace(self.covariance))
        return self.values / trace if trace > 0 else np.zeros(self.dims)

    @property
    def varies(self) -> np.ndarray:
        """Which components have variance."""
        return self.values > NO_VARIANCE * max([0.0, *self.values[:1]])

    def centred(self, vectors: pa.Array) -> np.ndarray:
        return (matrix(vectors, self.dims, self.base.dtype) - self.base).astype(np.float64) - self.rest

    def projected(self, vectors: pa.Array, components: int) -> np.ndarray:
        """Whitened rows; components without variance are 0."""
        good = self.varies[:components]
        scale = np.where(good, 1 / np.sqrt(np.where(good, self.values[:components], 1)), 0)
        return self.centred(vectors) @ (self.vectors[:, :components] * scale)


def _usable(df: DataFrame, vector: str) -> DataFrame:
    return df.where(finite(vector)).select(F.col(vector).alias("v"))


def _gram(rows: DataFrame, dims: int, centred: Callable[[pa.Array], np.ndarray]) -> np.ndarray:
    """Sum over all rows of the products of each pair of columns that ``centred`` makes of them.

    Every task hands on one matrix, cut into blocks; these are added up in two steps of streams, so that no task holds
    more than one sum and one row of parts.
    """
    lines = max(1, BLOCK // max(1, dims))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            x = centred(batch.column(0))
            total += x.T @ x
        blocks = [total[i: i + lines].ravel() for i in range(0, dims, lines)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()),
                                          pa.array(blocks, pa.list_(pa.float64()))], names=["block", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[block] = sums.get(block, 0) + v.values.to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()),
                                          pa.array(list(sums.values()), pa.list_(pa.float64()))], names=["block", "v"])

    kind = "block int, v array<double>"
    parts = rows.mapInArrow(partial, kind).withColumn("part", F.spark_partition_id() % PARTS)
    parts = parts.repartition("part", "block").select("block", "v").mapInArrow(add, kind)
    found = dict(parts.repartition("block").mapInArrow(add, kind).collect())
    return np.concatenate([found[i] for i in sorted(found)]).reshape(dims, dims) if found else np.zeros((dims, dims))


def fit(df: DataFrame, vector: str = "embedding") -> Whitening | None:
    """The whitening of all rows of ``df`` whose vector is there and finite; None where there is no such row.

    Two passes: sums, then products of centred vectors. Vectors of whole numbers (``array<bigint>``) have exact sums.
    A shorter vector counts as if zeros followed; repeated rows count each. What reaches the driver is one matrix of
    the vectors' length.
    """
    rows = _usable(df, vector)
    whole = rows.schema["v"].dataType.elementType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims")).first()
    n, dims = size["n"], size["dims"]
    if not n:
        return None
    number = np.int64 if whole else np.float64

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(dims, number), np.zeros(dims, number)
        for batch in batches:
            x = matrix(batch.column(0), dims, number)
            high += (x >> 20).sum(0) if whole else x.sum(0)
            low += (x & 0xFFFFF).sum(0) if whole else 0
        yield pa.RecordBatch.from_arrays([pa.array([high.tolist()]), pa.array([low.tolist()])], names=["high", "low"])

    kind = "bigint" if whole else "double"
    parts = rows.mapInArrow(sums, f"high array<{kind}>, low array<{kind}>").where(F.size("high") > 0)
    added = parts.select(F.posexplode(F.arrays_zip("high", "low")).alias("at", "x")).groupBy("at").agg(
        *[F.sum(F.col(f"x.{c}").cast("decimal(38,0)") if whole else F.col(f"x.{c}")).alias(c) for c in ("high", "low")])
    each = {r["at"]: (int(r["high"]) << 20) + int(r["low"]) if whole else r["high"] for r in added.collect()}
    total = [each[i] for i in range(dims)]
    base = np.array([s // n if whole else s / n for s in total], dtype=number)
    rest = np.array([(s - n * int(b)) / n for s, b in zip(total, base, strict=True)]) if whole else np.zeros(dims)
    model = Whitening(n, total, whole, base, rest, np.zeros((dims, dims)), np.zeros(dims), np.eye(dims))
    model.covariance = _gram(rows, dims, model.centred) / n
    model.values, model.vectors = eigen(model.covariance)
    return model


def whiten(df: DataFrame, model: Whitening, vector: str = "embedding", components: int = 32,
           out: str = "whitened") -> DataFrame:
    """The rows of ``df`` whose vector is there and finite, with an array of its first ``components`` whitened
    coordinates, fewer if the vectors are shorter; null stands for a component without variance.

    All other columns stay; one named like ``out`` is replaced. No shuffle.
    """
    k = min(components, model.dims)
    good = model.varies[:k]
    rest = [c for c in df.columns if c != out]
    rows = df.where(finite(vector)).select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"),
                                           F.col(vector).alias("v"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = model.projected(batch.column(1), k)
            flat = pa.array(x.ravel(), mask=np.broadcast_to(~good, x.shape).ravel())
            ends = pa.array(np.arange(len(x) + 1) * k, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, flat)], names=["row", "w"])

    kind = f"row {rows.schema['row'].dataType.simpleString()}, w array<double>"
    done = rows.mapInArrow(of, kind)
    return done.select(*[F.col(f"row.`{c}`").alias(c) for c in rest], F.col("w").alias(out))


def identity_error(df: DataFrame, model: Whitening, vector: str = "embedding", components: int = 32) -> float | None:
    """Largest absolute entry of (covariance of the whitened rows - identity), over the components with variance,
    measured in one more pass over ``df``; None where there is none."""
    k = min(components, model.dims)
    good = np.flatnonzero(model.varies[:k])
    if not len(good):
        return None
    found = _gram(_usable(df, vector), k, lambda v: model.projected(v, k)) / model.n
    return float(np.abs(found[np.ix_(good, good)] - np.eye(len(good))).max())
