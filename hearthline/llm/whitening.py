"""Whitening of integer-quantised embeddings by matrix-free block subspace iteration.

An entry c becomes the whole number x = floor(256 c). Statistics are over the distinct x vectors: their number n, sums
S and covariance V = X'X / n of the centred rows, which is never formed. Each Spark pass multiplies one block Q:
every task computes X'(XQ) of its centred rows and sends d rows of block width, summed by dimension before and after
the shuffle. The driver keeps the blocks' images, takes Rayleigh-Ritz pairs of the space that the blocks span, and
orthonormalises (QR) the residuals of the wanted pairs as the next block, until the residuals of all k components
are below `tolerance` of the largest eigenvalue. The blocks kept make the iteration end after d / block passes at the
latest where d is small, however close eigenvalues are; where d is large, the space is cut back to the best Ritz
vectors before it grows beyond `most_blocks` blocks. A last pass measures the covariance of the whitened rows.

The driver holds d x (2 most_blocks + 2) x block numbers, whatever the number of rows.

Rows whose vector is null or holds null or non-finite entries are dropped. Vectors of other lengths than the longest
count as zero beyond their ends. Entries beyond a long's range are its ends; a deviation beyond a long is null.
There are no components of no variance: fewer than k where the rank is less, and no rows at all where all
vectors are equal or the table is empty. Repeated rows give repeated results. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import discard, stored

SCALE = 256.0
#: A component's eigenvalue is more than this share of the trace.
LEAST_SHARE = 1e-13
SEED = 11


@dataclass
class Fitted:
    """n distinct vectors, their sums S, components (columns), eigenvalues, trace, and the largest entry of the
    whitened covariance minus the identity."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float
    passes: int


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its entries are numbers."""
    return F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def packed(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id and x: the quantised vector's bytes, in the least of 1, 2, 4 or 8 bytes an entry that holds all of it, so
    that equal vectors are equal bytes; trailing zeros are cut, which pads vectors of unequal lengths."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for vector in batch.column("v"):
                values = np.floor(SCALE * vector.values.to_numpy(zero_copy_only=False).astype(np.float64))
                with np.errstate(invalid="ignore"):
                    x = np.trim_zeros(np.where(values >= 2.0**63, np.iinfo(np.int64).max, np.where(values < -(2.0**63), np.iinfo(np.int64).min, values.astype(np.int64))), "b")
                low, high = (int(x.min()), int(x.max())) if len(x) else (0, 0)
                size = next(s for s in (1, 2, 4, 8) if -(1 << 8 * s - 1) <= low and high < 1 << 8 * s - 1)
                out.append(bytes([size]) + x.astype(f"<i{size}").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary())], ["vec_id", "x"])

    slim = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    return slim.filter(finite(F.col("v"))).mapInArrow(run, "vec_id long, x binary")


def unpacked(column: pa.Array, d: int) -> np.ndarray:
    """The vectors as rows of longs."""
    rows = column.to_pylist()
    if rows and {(x[0], len(x)) for x in rows} == {(size := rows[0][0], 1 + size * d)}:
        return np.frombuffer(b"".join(x[1:] for x in rows), f"<i{size}").reshape(-1, d).astype(np.int64)
    out = np.zeros((len(column), d), np.int64)
    for row, data in zip(out, rows, strict=True):
        x = np.frombuffer(data, f"<i{data[0]}", offset=1)
        row[: len(x)] = x
    return out


def column_sums(distinct: DataFrame) -> tuple[int, int, list[int]]:
    """n, d and S. Sums of one task's rows stay below 2^63 by halves of 32 bits; tasks' sums add as decimals."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, []
        for batch in batches:
            d = max(((len(x) - 1) // x[0] for x in batch.column("x").to_pylist()), default=0)
            x = unpacked(batch.column("x"), d)
            high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
            sums += [0] * (d - len(sums))
            for k in range(d):
                sums[k] += (int(high[k]) << 32) + int(low[k])
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(sums))], pa.int32()), pa.array([str(n), *map(str, sums)])], ["dimension", "total"])

    rows = distinct.mapInArrow(run, "dimension int, total string").groupBy("dimension").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    found = {r["dimension"]: int(r["total"]) for r in rows}
    n = found.pop(-1, 0)
    return n, len(found), [found[k] for k in range(len(found))]


def product(distinct: DataFrame, mean: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """X'(XQ), (XQ)'(XQ) and the sum of squares of the centred rows X, in one pass."""
    d, b = block.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        image, gram, squares = np.zeros((d, b)), np.zeros((b, b)), 0.0
        for batch in batches:
            rows = unpacked(batch.column("x"), d) - mean
            y = rows @ block
            image += rows.T @ y
            gram += y.T @ y
            squares += float((rows * rows).sum())
        every = np.vstack([image, gram, np.full((1, b), squares)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d + b + 1), pa.int32()), *(pa.array(c) for c in every.T)], ["i", *(f"c{k}" for k in range(b))])

    parts = distinct.mapInArrow(run, ", ".join(["i int", *(f"c{k} double" for k in range(b))]))
    rows = sorted(parts.groupBy("i").agg(*(F.sum(f"c{k}").alias(f"c{k}") for k in range(b))).collect())
    every = np.array([tuple(r)[1:] for r in rows])
    return every[:d], every[d : d + b], float(every[d + b, 0])


def fit(distinct: DataFrame, k: int, block: int | None = None, most_blocks: int = 32, tolerance: float = 1e-13) -> Fitted:
    """Components of distinct (x), which should be stored: each pass reads it anew."""
    n, d, sums = column_sums(distinct)
    none = Fitted(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0, 0.0, 0)
    if n < 2 or not d:
        return none
    mean, k = np.array([s / n for s in sums]), min(k, d)
    width = min(d, block or k + 4)
    rng = np.random.default_rng(SEED)
    q = np.linalg.qr(rng.standard_normal((d, width)))[0]
    space, images, passes, best = np.zeros((d, 0)), np.zeros((d, 0)), 0, np.inf
    while True:
        image, _, squares = product(distinct, mean, q)
        passes += 1
        if squares == 0:
            return none
        space, images, trace = np.hstack([space, q]), np.hstack([images, image / n]), squares / n
        small = space.T @ images
        values, turns = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(values)[::-1]
        values, turns = values[order], turns[:, order]
        kept = min(width, len(values))
        ritz = space @ turns[:, :kept]
        residual = images @ turns[:, :kept] - ritz * values[:kept]
        errors = np.linalg.norm(residual, axis=0)
        if space.shape[1] >= d or errors[:k].max() <= tolerance * values[0]:
            break
        if d > most_blocks * width and space.shape[1] + width > most_blocks * width:
            if errors[:k].max() > best / 2 and errors[:k].max() <= 1e3 * tolerance * values[0]:
                break  # rounding lets the residuals fall no further
            best, cut = errors[:k].max(), turns[:, : 2 * width]
            space, images = space @ cut, images @ cut
        q = orthonormal(residual[:, : d - space.shape[1]], space, rng)
    rank = min(k, int((values > LEAST_SHARE * trace).sum()))
    components, _ = np.linalg.qr(ritz[:, :rank]) if rank else (ritz[:, :0], None)
    if not rank:
        return none
    # The last pass: Rayleigh-Ritz of the components themselves, and what whitening by them gives.
    _, gram, _ = product(distinct, mean, components)
    values, turns = np.linalg.eigh(gram / n)
    values, components = values[::-1], components @ turns[:, ::-1]
    scale = components_scale(values)
    white = (turns[:, ::-1].T @ (gram / n) @ turns[:, ::-1]) * scale[:, None] * scale[None, :]
    return Fitted(n, sums, components, values, trace, float(np.abs(white - np.eye(rank)).max()), passes + 1)


def orthonormal(block: np.ndarray, space: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The block's columns made orthonormal to the space and to each other; spent ones (of no length) become random."""
    norms = np.linalg.norm(block, axis=0)
    block = np.where(norms > 0, block / np.maximum(norms, 1e-300), rng.standard_normal(block.shape))
    for _ in range(4):  # cancellation leaves the first results askew
        block = block - space @ (space.T @ block)
        block = np.linalg.qr(block + 1e-18 * rng.standard_normal(block.shape))[0]
    return block


def components_scale(values: np.ndarray) -> np.ndarray:
    return 1 / np.sqrt(values)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sums of (n x - S)^2 over the dimensions, exact; null beyond a long."""
    reach = max((abs(s) for s in sums), default=0) + n * max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))
    if len(sums) * reach * reach < 1 << 63:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = (sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x)
    return [v if v < 1 << 63 else None for v in exact]


def whiten(vectors: DataFrame, k: int = 4, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every row and component up to k."""
    rows = packed(vectors, vec_id, embedding)
    distinct, at = stored(rows.select("x").distinct())
    found = fit(distinct, k)
    discard(vectors.sparkSession, at)
    rank, d = len(found.eigenvalues), len(found.sums)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, onto = np.array([s / found.n for s in found.sums]), found.components * components_scale(found.eigenvalues)
        share = found.eigenvalues / found.trace
        for batch in batches:
            x, m = unpacked(batch.column("x"), d), batch.num_rows
            white = (x - mean) @ onto
            columns = [
                pa.array(np.repeat(np.arange(m), rank)), pa.array(np.tile(np.arange(1, rank + 1, dtype=np.int32), m)), pa.array(np.full(m * rank, found.n)),
                pa.array(np.repeat(np.array(deviations(x, found.n, found.sums), object), rank), pa.int64()), pa.array(white.ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * rank, found.identity_error)),
            ]
            columns[0] = batch.column("vec_id").take(columns[0])
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return (rows if rank else rows.limit(0)).mapInArrow(run, schema)
