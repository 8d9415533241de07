"""Near duplicates of embeddings by a subspace pigeonhole join.

Unit vectors of cosine c are sqrt(2 - 2 c) apart. A random rotation spreads that evenly over the dimensions, which
are split into blocks: vectors within the whole squared distance are within a block's proportional share of it in one
block at least. So each block is range-joined under its own budget, by boxes over all its coordinates: the vectors at
home are halved at medians, and visitors go on to a half only if its box is within the budget. Candidates are verified
there on the full vectors in double precision, and a pair counts in the first block that has it.

Vectors are written once, to files of the shared folder. A task of the join gets the numbers of chunks and of blocks, and
reads the chunks' files: no vector is copied for the blocks, boxes and chunks that it meets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import groupby
from math import isqrt
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from orrery.llm.common import discard, enter, filesystem, materialize, scratch, small_batches
from orrery.llm.components import Forest, components

BLOCKS = 8
#: Vectors of a chunk.
CHUNK = 32_768
#: Chunks that are at home together, as boxes of more vectors are smaller; chunks visit them one by one.
HOMES = 8
#: Bytes of a chunk in double precision: of longer vectors it holds fewer.
CHUNK_BYTES = 1 << 24
#: Added to a block's budget, so that rounding loses no candidate.
SLACK = 1e-6
#: Vectors at home in a box that isn't halved again.
LEAF = 48
#: The same in the join, where single precision and products of matrices make comparing cheaper than halving.
JOIN_LEAF = 256
#: Pairs that are compared at once, and candidates that are verified at once.
STEP, PIECE = 1 << 18, 1 << 16
#: Partitions of the join: a visit in a block each as long as there are few, and no more than many.
FEW_TASKS, MOST_TASKS = 96, 20_000


@lru_cache(maxsize=4)
def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random rotation, the same for the same dimension."""
    q, r = np.linalg.qr(np.random.default_rng((seed, dim)).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def block_edges(dim: int, blocks: int = BLOCKS) -> np.ndarray:
    """Where the blocks of near-equal width begin and end."""
    return np.linspace(0, dim, min(blocks, dim) + 1).astype(int)


def budgets(dim: int, cosine: float, blocks: int = BLOCKS) -> np.ndarray:
    """The squared distance of the threshold, in shares proportional to the blocks' dimensions."""
    return (2 - 2 * cosine) * np.diff(block_edges(dim, blocks)) / dim + SLACK


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    x /= np.abs(x).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    return x


def _turn(unit: np.ndarray, own: slice) -> np.ndarray:
    """A block of rotated vectors, summed in one order, so that a vector has the same bits wherever it is turned."""
    turn = rotation(unit.shape[1])[:, own]
    out = np.zeros((len(unit), turn.shape[1]))
    for k in range(unit.shape[1]):
        out += unit[:, k : k + 1] * turn[k]
    return out


def boxed(visitors: np.ndarray, home: np.ndarray, limit: float, leaf: int = LEAF) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of visitors and of home, box by box: all pairs within the squared distance are among them. Boxes hold `leaf`
    rows of home at most, unless those are all alike."""
    todo = [(np.arange(len(visitors)), np.ascontiguousarray(visitors.T), np.arange(len(home)))]
    while todo:
        i, at, j = todo.pop()
        own = home.take(j, axis=0)
        low, high = own.min(0), own.max(0)
        beyond = np.maximum(at, low[:, None])
        np.minimum(beyond, high[:, None], out=beyond)
        beyond -= at
        use = np.flatnonzero(np.einsum("ij,ij->j", beyond, beyond) <= limit + 1e-9)
        if not len(use):
            continue
        c = int((high - low).argmax())
        if len(j) <= leaf or high[c] == low[c]:
            yield i[use], j
            continue
        if 2 * len(use) < len(i):  # taking costs more than asking again
            i, at = i[use], at.take(use, axis=1)
        order = np.argpartition(own[:, c], len(j) // 2)
        todo += [(i, at, j[order[: len(j) // 2]]), (i, at, j[order[len(j) // 2 :]])]


def _sound(column: pa.Array, kind: type) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors) of a column of lists, by length. Null and zero vectors and those with null or non-finite
    components are left out."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    starts = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == dim)
        x = flat[starts[rows][:, None] + np.arange(dim)] + kind(0)  # -0.0 is 0.0
        use = np.isfinite(x).all(1) & (x != 0).any(1)
        yield rows[use], x[use]


def _packed(rows: DataFrame, kind: type) -> DataFrame:
    """(id, raw) of the rows (id, v) that can link: the bytes of v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, x in _sound(batch.column(1), kind):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), pa.array([v.tobytes() for v in x], pa.binary())], names=["id", "raw"])

    return rows.filter("id is not null").mapInArrow(run, "id long, raw binary")


def _named(rows: DataFrame, kind: type) -> DataFrame:
    """(id, digest) of all rows (id, v): digest is null where v can't link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests: list[bytes | None] = [None] * batch.num_rows
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for own, x in _sound(batch.column(1), kind):
                for i, v in zip(own.tolist(), x, strict=True):
                    if known[i]:
                        digests[i] = sha256(v.tobytes()).digest()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary())], names=["id", "digest"])

    return rows.mapInArrow(run, "id long, digest binary")


def _held(dim: int, chunk: int) -> int:
    return max(1, min(chunk, CHUNK_BYTES // (8 * dim)))


def _written(classes: DataFrame, folder: str, chunk: int, kind: type) -> DataFrame:
    """(digest, rep, copies, dim, path) of classes (raw, rep, copies), and the files: each has vectors of one length, as
    many as a chunk at most."""
    size = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        waiting: dict[int, list[pa.Table]] = {}

        def flush(dim: int, least: int) -> Iterator[pa.RecordBatch]:
            rows, held = pa.concat_tables(waiting[dim]), _held(dim, chunk)
            while rows.num_rows >= least:
                name, part, rows = uuid4().hex, rows.slice(0, held).combine_chunks(), rows.slice(held)
                raw = part["raw"].to_pylist()
                vectors = pa.FixedSizeBinaryArray.from_buffers(pa.binary(dim * size), len(raw), [None, pa.py_buffer(b"".join(raw))])
                kept = pa.table({"raw": vectors, "id": part["rep"], "copies": part["copies"]})
                with fs.open_output_stream(f"{base}/{name}.arrow") as sink, pa.ipc.new_file(sink, kept.schema) as writer:
                    writer.write_table(kept)
                yield from pa.table({"digest": pa.array([sha256(x).digest() for x in raw], pa.binary()), "rep": part["rep"], "copies": part["copies"], "dim": pa.array([dim] * len(raw), pa.int32()), "path": pa.array([f"{folder}/{name}.arrow"] * len(raw))}).combine_chunks().to_batches()
            waiting[dim] = [rows]

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            dims = pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False) // size
            for dim in np.unique(dims).tolist():
                waiting.setdefault(dim, []).append(rows.filter(pa.array(dims == dim)))
                if sum(x.num_rows for x in waiting[dim]) >= _held(dim, chunk):
                    yield from flush(dim, _held(dim, chunk))
        for dim in waiting:
            yield from flush(dim, 1)

    return classes.select("raw", "rep", "copies").mapInArrow(run, "digest binary, rep long, copies long, dim int, path string")


def _chunks(written: DataFrame, chunk: int) -> list[tuple[int, list[list[str]]]]:
    """The files of each chunk, by length of vectors. The driver sees a name for each chunk, or for each partition's rest."""
    out: dict[int, list[list[str]]] = {}
    full: dict[int, int] = {}
    for r in sorted(written.groupBy("dim", "path").count().collect()):
        if r.dim not in out or full[r.dim] + r["count"] > _held(r.dim, chunk):
            out.setdefault(r.dim, []).append([])
            full[r.dim] = 0
        out[r.dim][-1].append(r.path)
        full[r.dim] += r["count"]
    return list(out.items())


class Chunk:
    """Unit vectors of some files."""

    def __init__(self, files: list[str], dim: int, kind: type, blocks: int) -> None:
        tables = []
        for path in files:
            fs, name = filesystem(path)
            with fs.open_input_stream(name) as source:
                tables.append(pa.ipc.open_file(source.read()).read_all())
        self.ids, self.copies = (np.concatenate([t[c].to_numpy() for t in tables]) for c in ("id", "copies"))
        self.unit, self.edges = np.empty((len(self.ids), dim)), block_edges(dim, blocks)
        at = 0
        for raw in (x for t in tables for x in t["raw"].chunks):
            self.unit[at : at + len(raw)] = _unit(np.frombuffer(raw.buffers()[1], kind, len(raw) * dim).reshape(-1, dim))
            at += len(raw)
        self.single: dict[int, np.ndarray] = {}
        self.whole: dict[int, np.ndarray] = {}

    def small(self, block: int) -> np.ndarray:
        """A block of the turned vectors in single precision."""
        if block not in self.single:
            own = slice(self.edges[block], self.edges[block + 1])
            self.single[block] = (self.unit @ rotation(self.unit.shape[1])[:, own]).astype(np.float32)
        return self.single[block]

    def turned(self, rows: np.ndarray, block: int) -> np.ndarray:
        """A block of some rows in double precision. Many rows are turned once and all together."""
        own = slice(self.edges[block], self.edges[block + 1])
        if block not in self.whole and len(rows) < len(self.ids) / 4:
            return _turn(self.unit[rows], own)
        if block not in self.whole:
            self.whole[block] = _turn(self.unit, own)
        return self.whole[block][rows]

    def apart(self, other: Chunk, x: np.ndarray, y: np.ndarray, block: int) -> np.ndarray:
        """Squared distances in a block, in single precision."""
        d = self.small(block).take(x, axis=0) - other.small(block).take(y, axis=0)
        return np.einsum("ij,ij->i", d, d)

    def near(self, other: Chunk, x: np.ndarray, y: np.ndarray, block: int, limit: float) -> np.ndarray:
        return _near(self.turned(x, block), other.turned(y, block)) <= limit


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows to rows, summed dimension by dimension: the same bits wherever a pair meets."""
    out = np.zeros(len(x))
    for k in range(x.shape[1]):
        d = x[:, k] - y[:, k]
        out += d * d
    return out


def _lost(m: int) -> float:
    """Twice a bound of what single precision takes from a squared distance in m coordinates of vectors no longer than 1."""
    return 2 * (m + 4) * 2.0**-22


def _candidates(visitors: np.ndarray, home: np.ndarray, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows, PIECE of them or fewer at once: all within the squared distance, and few beyond."""
    limit += _lost(visitors.shape[1])
    square = [np.einsum("ij,ij->i", x, x, dtype=float).astype(np.float32)[:, None] for x in (visitors, home)]
    one = [np.ones_like(x) for x in square]
    left, right = np.hstack([-2 * visitors, square[0], one[0]]), np.hstack([home, one[1], square[1]])
    some: list[tuple[np.ndarray, np.ndarray]] = []
    n, room = 0, np.empty(STEP, np.float32)  # one memory for all products
    for i, j in boxed(visitors, home, limit, JOIN_LEAF):
        for jj in (j[k : k + STEP] for k in range(0, len(j), STEP)):
            step, there = max(1, STEP // len(jj)), np.ascontiguousarray(right.take(jj, axis=0).T)
            for at in range(0, len(i), step):
                ii = i[at : at + step]
                apart = np.matmul(left.take(ii, axis=0), there, out=room[: len(ii) * len(jj)].reshape(len(ii), len(jj)))
                some_near = np.flatnonzero(apart.min(1) <= np.float32(limit))
                if len(some_near):
                    p, q = np.nonzero(apart[some_near] <= np.float32(limit))
                    some.append((ii[some_near[p]], jj[q]))
                    n += len(p)
                if n >= PIECE:
                    x, y = (np.concatenate(z) for z in zip(*some, strict=True))
                    yield from ((x[k : k + PIECE], y[k : k + PIECE]) for k in range(0, n, PIECE))
                    some, n = [], 0
    if some:
        yield tuple(np.concatenate(z) for z in zip(*some, strict=True))


class Meeting:
    """A chunk that visits chunks at home, of which it may be the first itself: sums of copies linked to each vector, and
    links to a root for each."""

    def __init__(self, a: Chunk, b: Chunk, within: bool, cosine: float, limits: np.ndarray) -> None:
        self.a, self.b, self.within, self.cosine, self.limits = a, b, within, cosine, limits
        self.shift = 0 if within else len(a.ids)
        self.ids = b.ids if within else np.concatenate([a.ids, b.ids])
        self.n, self.forest = np.zeros(len(self.ids), np.int64), Forest(len(self.ids))

    def join(self, block: int) -> None:
        a, b = self.a, self.b
        lost = _lost(a.unit.shape[1])
        for x, y in _candidates(a.small(block), b.small(block), float(self.limits[block])):
            use = a.ids[x] != b.ids[y]
            if self.within:
                use &= x < y
            x, y = x[use], y[use]
            if len(self.limits) > 1:  # two blocks alone may be too far apart
                use = a.apart(b, x, y, block) + a.apart(b, x, y, (block + 1) % len(self.limits)) <= self.limits.sum() + lost
                x, y = x[use], y[use]
            for earlier in range(block):  # what is surely found there
                use = a.apart(b, x, y, earlier) >= self.limits[earlier] - lost
                x, y = x[use], y[use]
            use = np.einsum("ij,ij->i", a.unit[x], b.unit[y]) >= self.cosine
            x, y = x[use], y[use]
            for other in range(block, -1, -1):
                use = a.near(b, x, y, other, self.limits[other]) == (other == block)
                x, y = x[use], y[use]
            np.add.at(self.n, x, b.copies[y])
            np.add.at(self.n, y + self.shift, a.copies[x])
            self.forest.join(x, y + self.shift)

    def found(self) -> pa.RecordBatch:
        """(id, root, n): n of linked vectors, without a root; roots of those that aren't their own, without n."""
        root, linked = self.forest.settled(), np.flatnonzero(self.n)
        child = np.flatnonzero(root != np.arange(len(root)))
        none = np.r_[np.ones(len(linked), bool), np.zeros(len(child), bool)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([self.ids[linked], self.ids[child]])), pa.array(np.concatenate([self.ids[linked], self.ids[root[child]]]), mask=none), pa.array(np.concatenate([self.n[linked], np.zeros(len(child), np.int64)]))], names=["id", "root", "n"])


def _joined(spark: SparkSession, chunks: list[tuple[int, list[list[str]]]], cosine: float, blocks: int, kind: type) -> DataFrame:
    """What Meeting.found() gives, for each chunk and each HOMES chunks of its length that don't all come before it. A visit in a
    block is a row of the join."""
    visits = []
    for _, of in chunks:
        last = (len(of) - 1) // HOMES
        visits.append(HOMES * last * (last + 1) // 2 + len(of))
    first = np.cumsum([0] + [n * min(blocks, dim) for n, (dim, _) in zip(visits, chunks, strict=True)]).tolist()

    def visit(row: int) -> tuple[tuple[int, int, range], int]:
        """((place in chunks, number of the visitor, numbers of those at home), block)"""
        k = int(np.searchsorted(first, row, "right")) - 1
        n, block = divmod(row - first[k], min(blocks, chunks[k][0]))
        group = (isqrt(8 * (n // HOMES) + 1) - 1) // 2
        visitor = n - HOMES * group * (group + 1) // 2
        return (k, visitor, range(max(HOMES * group, visitor), min(HOMES * (group + 1), len(chunks[k][1])))), block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("embeddings")
        at, home = None, None
        rows = (visit(x) for batch in batches for x in batch.column(0).to_pylist())
        for (k, visitor, numbers), of in groupby(rows, key=lambda x: x[0]):
            dim, files = chunks[k]
            if at != (k, numbers):
                at, home = None, None  # freed before the next are read
                home = Chunk([x for n in numbers for x in files[n]], dim, kind, blocks)
                at = k, numbers
            met = Meeting(Chunk(files[visitor], dim, kind, blocks), home, visitor in numbers, cosine, budgets(dim, cosine, blocks))
            for _, block in of:
                met.join(block)
            yield met.found()

    return spark.range(0, first[-1], 1, max(1, min(first[-1], max(FEW_TASKS, sum(visits)), MOST_TASKS))).mapInArrow(run, "id long, root long, n long")


def near_vectors(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """(id_col, n_links, component_id, kept) of every row of vectors.

    n_links: other rows of cosine >= `cosine`; component_id: the smallest id reachable; kept: it is the row's own.
    Null and zero vectors, those with null or non-finite components, and rows of a null id link with nothing (a null
    id has a null component and isn't kept). Vectors of different lengths don't link. Rows that repeat an id are rows
    of their own and share its component. Equal vectors are one class with a count from the start; rows find their
    class by SHA-256.

    Vectors are cut into chunks as they come. A task has HOMES chunks and a visitor in memory, and returns counts and a
    link to a root for each vector, never pairs. On disk each vector is once in a shuffle and once in a file, however many
    chunks there are. The rotation spreads a threshold over all blocks, so the join is exact for any data. How many pairs
    its boxes leave to compare depends on the data, and visits grow with the square of the number of chunks: see README.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    element = getattr(vectors.schema[vector_col].dataType, "elementType", None)
    kind = np.float32 if isinstance(element, FloatType) else np.float64
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<float>" if kind is np.float32 else "array<double>").alias("v"))
    classes = _packed(rows, kind).groupBy("raw").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    folder = scratch(spark, "vectors")
    written = materialize(_written(classes, folder, chunk, kind), "classes")
    found = materialize(_joined(spark, _chunks(written, chunk), cosine, blocks, kind), "joined")
    discard(folder)
    counts = found.filter("root is null").groupBy(F.col("id").alias("of")).agg(F.sum("n").alias("n"))
    linked = components(found.filter("root is not null").select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "member")
    named = written.join(counts, F.col("rep") == F.col("of"), "left").join(linked, F.col("rep") == F.col("member"), "left")
    named = named.select(F.col("digest").alias("_digest"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = _named(rows, kind).join(named, F.col("digest") == F.col("_digest"), "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
