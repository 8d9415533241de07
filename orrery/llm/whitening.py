"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The centred rows X stay where they are. A step takes a direction v, forms the product X v, makes it orthogonal to all
left vectors before it, brings it back by the transpose, and makes that orthogonal to all directions before it: X V = U B
with B bidiagonal, whose small singular value decomposition gives components and deviations.

Left vectors have an entry for each row, but u = X c for a vector c as long as a row, so they are never stored: a pass
over the rows returns U'(X w), X'(X w) and |X w| ** 2 together, sums of a few hundred numbers that Spark adds up, and
nothing else leaves the rows. A lost executor costs the pass it was in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import materialize

#: A row's entries are whole numbers: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Entries of a larger size make a row as unsound as one that isn't finite: sums of them might not fit.
LARGEST = 2.0**40
#: Rows of so many dimensions are bidiagonalised whole; longer ones until the wanted components have settled.
WHOLE = 256
#: A direction or left vector that keeps less than this of the largest length so far is none.
NOTHING = 1e-11
#: What is left of a product after one orthogonalisation, in squares, below which it is made again.
AGAIN = 0.1


class Fit(NamedTuple):
    """n rows, their sums by dimension, unit components in columns, eigenvalues of the covariance, its trace, and the
    largest entry of the whitened rows' covariance minus the identity."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    error: float


def whole_rows(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int, int, np.ndarray]:
    """((id, raw), dimensions, n, sums): sound rows as whole numbers in a table, 64-bit little-endian."""
    v = F.col("v")
    rows = vectors.select(vectors[id_col].alias("id"), vectors[vector_col].cast("array<double>").alias("v"))
    sound = F.coalesce(F.size(v) > 0, F.lit(False)) & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST)), F.lit(False))
    rows = rows.filter(sound)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            size = lists.value_lengths().to_numpy()
            x = np.floor(SCALE * lists.flatten().to_numpy()).astype("<i8") + SHIFT
            offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32) * 8
            raw = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(x.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int32()), raw], names=["id", "dim", "raw"])

    table = materialize(rows.mapInArrow(pack, f"id {vectors.schema[id_col].dataType.simpleString()}, dim int, raw binary"), "whole")
    most = table.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("dim").desc()).first()
    if most is None:
        return table.select("id", "raw"), 0, 0, np.zeros(0, np.int64)
    dim, n = int(most["dim"]), int(most["n"])
    table = table.filter(F.col("dim") == dim).select("id", "raw")
    return table, dim, n, added(table, dim, lambda x: x.sum(0), "long", dim)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The rows of a batch as whole numbers."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view("<i8").reshape(len(column), dim) if len(column) else np.zeros((0, dim), np.int64)


def added(table: DataFrame, dim: int, f: Callable[[np.ndarray], np.ndarray], kind: str, size: int) -> np.ndarray:
    """The sum of f over blocks of rows: numbers within a task, then of all tasks, `size` in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = f(matrix(batch.column(0).slice(at, 4096), dim))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["k", "x"])

    sums = table.select("raw").mapInArrow(run, f"k int, x {kind}").groupBy("k").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros(size, np.int64 if kind == "long" else float)
    out[sums["k"].to_numpy()] = sums["x"].to_numpy()
    return out


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (n * x - sums) / float(n)


def bidiagonal(product: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, float]], dim: int, wanted: int, whole: int = WHOLE, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(V, B): orthogonal directions in columns, and the bidiagonal matrix of X in them and in its left vectors.

    product(w, C) gives C'X'X w, X'X w and |X w| ** 2. Where a direction leads nowhere new, the next one is a random one
    orthogonal to all before it, so that equal deviations and rows of a smaller rank are found too.
    """
    dice = np.random.default_rng(seed)

    def orthogonal(w: np.ndarray, of: np.ndarray) -> np.ndarray:
        for _ in range(2):
            w = w - of @ (of.T @ w)
        return w

    def fresh(of: np.ndarray) -> np.ndarray:
        w = orthogonal(orthogonal(dice.standard_normal(dim), of), of)
        return w / np.linalg.norm(w)

    directions, left, back = np.zeros((dim, 0)), np.zeros((dim, 0)), np.zeros((dim, 0))
    alphas, betas, scale = [], [], 0.0
    v = fresh(directions)
    while True:
        directions = np.column_stack([directions, v])
        w = v
        along, returned, square = product(w, left)
        first = square
        w, returned, square = w - left @ along, returned - back @ along, square - along @ along
        if square < AGAIN * first:  # what is left is small beside what was taken away
            along, returned, square = product(w, left)
            w, returned, square = w - left @ along, returned - back @ along, square - along @ along
        alpha = np.sqrt(max(square, 0.0))
        scale = max(scale, alpha)
        if alpha <= NOTHING * scale:
            alpha, w, returned = 0.0, np.zeros(dim), np.zeros(dim)
        else:
            w, returned = w / alpha, returned / alpha
        alphas.append(alpha)
        left, back = np.column_stack([left, w]), np.column_stack([back, returned])
        if len(alphas) == dim:
            break
        v = orthogonal(returned - alpha * v, directions)
        beta = np.linalg.norm(v)
        if beta <= NOTHING * scale:
            betas.append(0.0)
            v = fresh(directions)
        else:
            betas.append(beta)
            v = v / beta
            if dim > whole and len(alphas) >= wanted:
                p, s, _ = np.linalg.svd(np.diag(alphas) + np.diag(betas[:-1], 1))
                if (beta * np.abs(p[-1, :wanted]) <= 1e-14 * s[0]).all():
                    betas.pop()
                    break
    return directions, np.diag(alphas) + np.diag(betas, 1)


def fit(table: DataFrame, dim: int, n: int, sums: np.ndarray, wanted: int = 8, whole: int = WHOLE) -> Fit:
    """Components of the largest eigenvalues, `wanted` at most: fewer where the rows have a smaller rank."""

    def product(w: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        k = left.shape[1]

        def part(x: np.ndarray) -> np.ndarray:
            x = centred(x, n, sums)
            y = x @ w
            back = x.T @ y
            return np.concatenate([(x @ left).T @ y, back, [y @ y]])

        out = added(table, dim, part, "double", k + dim + 1)
        return out[:k], out[k:-1], float(out[-1])

    directions, b = bidiagonal(product, dim, wanted, whole)
    _, s, turn = np.linalg.svd(b)
    found = int((s[:wanted] > 1e-9 * s[0]).sum()) if s[0] > 0 else 0
    components, values = directions @ turn[:found].T, s[:found] ** 2 / n
    components /= np.linalg.norm(components, axis=0)

    def spread(x: np.ndarray) -> np.ndarray:
        x = centred(x, n, sums)
        z = x @ components / np.sqrt(values)
        return np.concatenate([(z.T @ z).ravel(), z.sum(0), [(x * x).sum()]])

    out = added(table, dim, spread, "double", found * found + found + 1)
    mean = out[found * found : -1] / n
    covariance = out[: found * found].reshape(found, found) / n - np.outer(mean, mean)
    error = float(np.abs(covariance - np.eye(found)).max()) if found else 0.0
    return Fit(n, sums, components, values, float(out[-1]) / n, error)


def whiten(vectors: DataFrame, wanted: int = 8, id_col: str = "vec_id", vector_col: str = "embedding", whole: int = WHOLE) -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error) of every sound row and each of the `wanted`
    components of the largest eigenvalues, numbered from 1.

    An entry c is the whole number floor(1024 c) + 100000; n rows with sums S. deviation: the sum over dimensions of
    (n x - S) ** 2, exact (an error where it doesn't fit 64 bits). whitened: x - S / n along the component, over the
    square root of its eigenvalue of the covariance (divisor n). explained: the eigenvalue's share of the trace.
    identity_error: how far the whitened rows' covariance is from the identity, one value.

    Rows that are null or empty or hold a null, a non-finite entry or one beyond LARGEST are dropped; where lengths
    differ, the most frequent one counts (the longest of several) and others are dropped. Repeated rows and null ids are
    rows of their own. Rows of rank r have r components at most, so one row, rows all alike and an empty table give
    none. Components of equal eigenvalues are some basis of their space. Other columns are left out.
    """
    table, dim, n, sums = whole_rows(vectors, id_col, vector_col)
    found = fit(table, dim, n, sums, wanted, whole) if n else Fit(0, sums, np.zeros((0, 0)), np.zeros(0), 1.0, 0.0)
    k = len(found.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x.slice(at, 4096) for x in batches for at in range(0, x.num_rows, 4096)) if k else ():
            x = n * matrix(batch.column(1), dim) - sums
            if float(np.abs(x).max()) ** 2 * dim < 2.0**62:
                deviation = pa.array(np.repeat((x * x).sum(1), k))
            else:
                deviation = pa.array([sum(c * c for c in row) for row in x.tolist() for _ in range(k)], pa.int64())
            z = (x / float(n)) @ found.components / np.sqrt(found.values)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), k)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), deviation, pa.array(z.ravel()), pa.array(np.tile(found.values / found.trace, len(x)))], names=[id_col, "component", "deviation", "whitened", "explained"])

    out = table.mapInArrow(run, f"`{id_col}` {vectors.schema[id_col].dataType.simpleString()}, component int, deviation long, whitened double, explained double")
    return out.select(id_col, "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(found.error).alias("identity_error"))
