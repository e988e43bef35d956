"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The distinct vectors, as whole 256ths, are the fit list; its centred rows are the matrix X. Starting from a block of
`BLOCK` orthonormal directions, X is bidiagonalised block by block: products X v and X' u alternate, both computed by the
tasks that hold the rows, and every new left and right block is orthogonalised against all earlier ones, twice. The
singular values and right vectors of the small block-bidiagonal matrix give deviations and components; it grows until the
residuals of the wanted components are at rounding level or the space is exhausted. A block as wide as the number of
components finds repeated eigenvalues too, and needs that many times fewer scans than single vectors.

Left vectors are as long as the table and are never stored: a left block is X times a small matrix that the driver keeps,
so each task rebuilds its part from its rows, and a lost executor costs no state. What a task sends is a table of products
that depends on the dimensions only, summed by Spark before the driver sees it.

Defined cases: rows whose vector is null, empty, or holds null, NaN or infinite entries are dropped, and so are vectors of
another length than the commonest one (ties: the longest); equal vectors count once in the fit but every row is returned,
repeated or null vec_id included; entries beyond the range of long saturate; directions whose standard deviation is below
1e-7 of the largest have no component, so fewer than asked may come back, and none when all vectors are equal; an empty
table gives an empty result; deviations beyond 38 digits are null. Only the two named columns are read.
"""

from __future__ import annotations

from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import spread, staged

BLOCK = 8
#: Numbers of a block of rows that are centred at a time.
CELLS = 1 << 20
#: Directions weaker than this share of the strongest count as absent; residuals below RESIDUAL of it as converged.
WEAK, RESIDUAL = 1e-7, 1e-14


class Whitener(NamedTuple):
    """n vectors with the exact sums per dimension; components (a column each) with variances; trace of the covariance;
    the largest absolute entry of the whitened covariance minus the identity; bidiagonalisation steps taken."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float
    steps: int


def whole(table: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Usable rows as (key, x): entries times 256, rounded down, as long."""
    c = F.col(column)
    usable = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) != float("inf")))
    x = F.transform(c, lambda v: F.floor(F.lit(256.0) * v.cast("double")))
    d = table.select(F.col(key).alias("key"), F.when(c.isNotNull() & (F.size(c) > 0) & usable, x).alias("x")).filter("x is not null")
    top = d.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return d.filter(F.size("x") == F.lit(top["size"] if top else 0))


def _blocks(batches, cells: int):
    """(record batch, rows x dimensions as int64) of bounded size."""
    for batch in batches:
        lo = 0
        while lo < batch.num_rows:
            width = max(1, batch.column("x").slice(lo, 1).value_lengths()[0].as_py())
            part = batch.slice(lo, max(1, cells // width))
            yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, width)
            lo += part.num_rows


def _exact_sums(fit: DataFrame) -> list[int]:
    """Sum of every dimension, as whole numbers of any size."""
    cells = CELLS

    def run(batches):
        sums = 0
        for _, x in _blocks(batches, cells):
            safe = max(int(x.max()), -int(x.min())) < (1 << 62) // len(x)
            sums = sums + x.sum(axis=0, dtype=np.int64 if safe else object).astype(object)
        if not isinstance(sums, int):
            yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array([str(s) for s in sums])], ["i", "s"])

    parts = fit.select("x").mapInArrow(run, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    return [int(r["s"]) for r in parts.orderBy("i").collect()]


def _summed(fit: DataFrame, mean: np.ndarray, product, size: int) -> np.ndarray:
    """Sum over all rows of `product(centred rows)`, a flat array of `size` numbers."""
    cells = CELLS

    def run(batches):
        total = np.zeros(size)
        for _, x in _blocks(batches, cells):
            total += product(x - mean)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], ["i", "v"])

    out = np.zeros(size)
    for i, v in fit.select("x").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v")).collect():  # `size` rows
        out[i] = v
    return out


def _left_products(fit, mean, w, q):
    """Against the left vectors XW: (XW)'XQ, (XQ)'XQ, X'XQ and the sum of squares of X, in one scan."""
    m, d, b = w.shape[1], len(q), q.shape[1]

    def product(x):
        p = x @ q
        return np.concatenate([((x @ w).T @ p).ravel(), (p.T @ p).ravel(), (x.T @ p).ravel(), [(x * x).sum()]])

    out = _summed(fit, mean, product, m * b + b * b + d * b + 1)
    g, h, z, squares = np.split(out, np.cumsum([m * b, b * b, d * b]))
    return g.reshape(m, b), h.reshape(b, b), z.reshape(d, b), float(squares[0])


def bidiagonalise(fit: DataFrame, mean: np.ndarray, wanted: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Leading right singular vectors and values of the centred rows, their sum of squares, and the steps taken."""
    d = len(mean)
    v = np.linalg.qr(np.random.default_rng(0).standard_normal((d, min(block, d))))[0]
    right, w, y, small = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((0, 0))
    vectors, values, steps, squares = np.zeros((d, 0)), np.zeros(0), 0, 0.0
    while v.shape[1]:
        steps += 1
        g, _, _, squares = _left_products(fit, mean, w, v)  # X v against all left vectors
        if squares == 0:
            break
        q = v - w @ g
        again, h, z, _ = _left_products(fit, mean, w, q)  # once more, and X' of what is left
        q, h, z, g = q - w @ again, h - again.T @ again, z - y @ again, g + again
        size, basis = np.linalg.eigh((h + h.T) / 2)
        strong = size > (WEAK ** 2) * max(size.max(initial=0), (np.linalg.norm(small, 2) if small.size else 0) ** 2)
        scale = np.sqrt(size[strong])
        turn = basis[:, strong] / scale
        lower = (basis[:, strong] * scale).T  # new left block times this is what is left of X v
        old = small.shape
        grown = np.zeros((old[0] + len(scale), old[1] + v.shape[1]))
        grown[:old[0], :old[1]], grown[:old[0], old[1]:], grown[old[0]:, old[1]:] = small, g, lower
        small, right = grown, np.hstack([right, v])
        new = z @ turn  # X' of the new left block
        w, y = np.hstack([w, q @ turn]), np.hstack([y, new])
        rest = new
        for _ in range(2):
            rest = rest - right @ (right.T @ rest)
        left, values, turned = np.linalg.svd(small, full_matrices=False)
        vectors = right @ turned.T
        if not new.shape[1]:
            break
        tall, edge, wide = np.linalg.svd(rest, full_matrices=False)
        coupling = (edge[:, None] * wide) @ left[old[0]:, :wanted]
        if right.shape[1] >= d or len(values) >= min(wanted, d) and np.linalg.norm(coupling) <= RESIDUAL * values[0]:
            break
        v = tall[:, edge > RESIDUAL * values[0]][:, : d - right.shape[1]]
        for _ in range(2):
            v = np.linalg.qr(v - right @ (right.T @ v))[0]
    keep = np.flatnonzero(values > WEAK * values.max(initial=0))[:wanted]
    return vectors[:, keep], values[keep], squares, steps


def fit(x: DataFrame, components: int = 4, block: int = BLOCK) -> Whitener:
    """Components of the distinct vectors of `x` (from `whole`)."""
    rows = staged(spread(x.select("x").distinct()), "fit")
    n, sums = rows.count(), _exact_sums(rows)
    if not n:
        return Whitener(0, [], np.zeros((0, 0)), np.zeros(0), 0.0, 0.0, 0)
    mean = np.array([s / n for s in sums])
    vectors, values, squares, steps = bidiagonalise(rows, mean, components, max(block, components))
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), range(vectors.shape[1])] < 0, -1, 1) if vectors.size else vectors
    k, scaled = len(values), vectors / (values / np.sqrt(n)) if len(values) else vectors

    def moments(centred):
        t = centred @ scaled
        return np.concatenate([t.sum(axis=0), (t.T @ t).ravel()])

    error = 0.0
    if k:
        first, second = np.split(_summed(rows, mean, moments, k + k * k) / n, [k])
        error = float(np.abs(second.reshape(k, k) - np.outer(first, first) - np.eye(k)).max())
    return Whitener(n, sums, vectors, values ** 2 / n, squares / n, error, steps)


def whiten(x: DataFrame, model: Whitener) -> DataFrame:
    """A row per row of `x` and component: key, component, n, deviation, whitened, explained, identity_error."""
    n, k, cells = model.n, len(model.variances), CELLS
    mean, scaled = np.array([s / n for s in model.sums]), model.components / np.sqrt(model.variances) if k else model.components
    sums, explained = model.sums, model.variances / model.trace if k else model.variances
    error, digits = model.identity_error, pa.decimal128(38, 0)

    def deviations(rows: np.ndarray) -> pa.Array:
        bound = n * max(int(rows.max()), -int(rows.min())) + max(map(abs, sums))
        if bound * bound * rows.shape[1] < 1 << 62:
            off = n * rows - np.array(sums, np.int64)
            return pa.array((off * off).sum(axis=1)).cast(digits)
        exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in rows.tolist()]
        return pa.array([Decimal(e) if e < 10 ** 38 else None for e in exact], digits)

    def run(batches):
        for part, rows in _blocks(batches, cells):
            if not k:
                continue
            m = len(rows)
            at = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [part.column("key").take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                 deviations(rows).take(at), pa.array(((rows - mean) @ scaled).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = x.schema["key"].dataType.simpleString()
    return x.mapInArrow(run, f"key {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
