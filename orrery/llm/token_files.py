"""Token ids of a corpus in Arrow files of equal-length sequences.

The ids of all documents, in ascending order of their ids and each closed by an end id, are one stream. A shard holds
a range of documents: an Arrow file whose batches have a fixed-size list of ids and one of mask bits a row (the last
row is padded, its mask false), and a smaller Arrow file that says where each document starts. Lists of a fixed size
have no offsets, so row i of an uncompressed file is at a known place and is read without a copy.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import enter, filesystem, materialize, memory_of, partitions, shared_dir
from orrery.llm.segment_ids import SegmentIds, by_bytes, free, joined, text_bytes

#: Segments whose ids a Python worker keeps (some 40 bytes each); beyond it the memory starts anew.
REMEMBERED = 1_000_000
#: Segments that the library gets as one text.
TOGETHER = 64
SHARDS = "shard long, path string, docs_path string, n_docs long, n_ids long"


class Encoder:
    """Ids of whole texts by the tokenizers library, as it loads the file: the strings of special tokens are those
    tokens, unless special_as_text."""

    def __init__(self, path: str, special_as_text: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.kind = np.dtype("<u2" if len(names) <= 1 << 16 else "<u4")
        # a byte-level token has a character for each byte
        self.bytes_of = np.zeros(max(names.values()) + 1, np.int64)
        for name, i in names.items():
            self.bytes_of[i] = len(name)
        self.memory = SegmentIds(self.encode_new, self.kind, REMEMBERED)

    def encode_new(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        between = [i for i, x in enumerate(segments) if free(x)]
        texts = [b"".join([segments[i] for i in between[k : k + TOGETHER]]).decode() for k in range(0, len(between), TOGETHER)]
        ids = np.concatenate([np.zeros(0, np.int64), *[np.array(e.ids, np.int64) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]])
        reached, ends = np.cumsum(self.bytes_of[ids]), np.cumsum([len(segments[i]) for i in between])
        if len(ends) and (ends[-1] != reached[-1] or not np.isin(ends, reached).all()):
            raise ValueError("the tokenizer isn't byte-level: its tokens don't have the bytes of the text")
        sizes = np.zeros(len(segments), np.int64)
        sizes[between] = np.diff(np.searchsorted(reached, ends) + 1, prepend=0)
        alone = sorted(set(range(len(segments))).difference(between))
        others = [np.array(e.ids, np.int64) for e in self.tokenizer.encode_batch_fast([segments[i].decode() for i in alone], add_special_tokens=False)]
        sizes[alone] = [len(x) for x in others]
        ids = np.concatenate([ids, *others])
        order = np.array([*between, *alone], np.int64)
        first = np.empty(len(order), np.int64)
        first[order] = np.cumsum(sizes[order]) - sizes[order]
        return joined(ids, first, sizes), sizes

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a column, each closed by end_id, and where each text's begin and the last end."""
        flat, at = self.memory.encode(column)
        n = len(at) - 1
        out = np.full(len(flat) + n, end_id, self.kind)
        out[np.arange(len(flat)) + np.repeat(np.arange(n), np.diff(at))] = flat
        return out, at + np.arange(n + 1)


_ENCODERS: dict[tuple[str, bool], Encoder] = {}
memory_of("token_files", _ENCODERS.clear)


def encoder(path: str, special_as_text: bool = False) -> Encoder:
    if (path, special_as_text) not in _ENCODERS:
        _ENCODERS[path, special_as_text] = Encoder(path, special_as_text)
    return _ENCODERS[path, special_as_text]


def token_ids(docs: DataFrame, tokenizer_path: str, bounds: np.ndarray, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, special_as_text: bool = False) -> DataFrame:
    """(shard, id, tie, n, ids): the packed ids of each text with the end id, their number, and the range of ids, ascending
    from null, that the document lies in. bounds are where ranges end; one that repeats is an id of very many rows, which
    share the ranges between by a hash of the text (tie)."""
    bounds = np.asarray(bounds, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("token_files")
        own = encoder(tokenizer_path, special_as_text)
        for batch in (x for whole in batches for x in by_bytes(whole)):
            ids, at = own.encode(batch.column(2), end_id)
            packed = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at * own.kind.itemsize), pa.py_buffer(ids)])
            named, tie = batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(), batch.column(1).to_numpy()
            first, last = np.searchsorted(bounds, named, "left"), np.searchsorted(bounds, named, "right")
            share = (tie.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(33)  # as the sign says, 31 bits
            shard = first + ((last - first + 1) * share.astype(np.int64) >> 31)
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), batch.column(0), batch.column(1), pa.array(np.diff(at)), packed.cast(pa.binary())], names=["shard", "id", "tie", "n", "ids"])

    rows = docs.select(docs[id_col].cast("long").alias("id"), F.xxhash64(docs[text_col]).alias("tie"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, "shard int, id long, tie long, n long, ids binary")


#: Shards at most; the shards of a larger table are larger, so that what the driver holds of them is bounded.
MOST_SHARDS = 10_000


def shard_bounds(docs: DataFrame, id_col: str, text_col: str, bytes_a_shard: int, most: int = MOST_SHARDS) -> np.ndarray:
    """Ends of ranges of ids with about as many documents each, from one pass over the ids and the texts' sizes: a range
    for so many bytes, `most` at most."""
    rows = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(np.iinfo(np.int64).min)).alias("id"), F.octet_length(docs[text_col]).alias("size"))
    n = partitions(rows, rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0], bytes_a_shard)
    n = min(n, most)
    found = rows.agg(F.percentile_approx("id", [k / n for k in range(1, n)] or [0.5], max(10_000, 20 * n))).first()[0]
    return np.array(found if n > 1 and found else [], np.int64)


def sequence_schema(kind: np.dtype, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))])


class SequenceWriter:
    """Appends bytes of ids and writes batches of `rows` sequences of `length` ids as soon as they are full."""

    def __init__(self, sink, kind: np.dtype, length: int, rows: int) -> None:
        self.kind, self.length, self.rows = np.dtype(kind), length, rows
        self.schema = sequence_schema(self.kind, length)
        self.out, self.pending, self.held, self.n_ids = pa.ipc.new_file(sink, self.schema), [], 0, 0

    def append(self, ids: bytes) -> None:
        self.pending.append(ids)
        self.held += len(ids)
        full = self.length * self.rows * self.kind.itemsize
        if self.held >= full:
            data = b"".join(self.pending)
            for at in range(0, len(data) - full + 1, full):
                self._batch(np.frombuffer(data, self.kind, self.length * self.rows, at))
            rest = data[len(data) - len(data) % full :]
            self.pending, self.held = [rest], len(rest)

    def _batch(self, ids: np.ndarray) -> None:
        n = -(-len(ids) // self.length)
        self.n_ids += len(ids)
        padded = np.zeros(n * self.length, self.kind)
        padded[: len(ids)] = ids
        mask = np.arange(n * self.length) < len(ids)
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (padded, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if self.held:
            self._batch(np.frombuffer(b"".join(self.pending), self.kind))
        self.out.close()


def write_sequences(docs: DataFrame, tokenizer_path: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, length: int = 2048, rows: int = 64, bytes_a_shard: int = 1 << 24, special_as_text: bool = False) -> DataFrame:
    """Write docs; returns a row for each shard (SHARDS), in files, so that reading it never writes again.

    Whole texts in ascending order of id_col (null first; equal ids by a hash of the text, then by their packed ids), null
    and empty ones as the end id alone. Texts are encoded where they are and only packed ids are shuffled, to ranges of
    ids whose bounds are quantiles, so that shards are about equal whatever the ids are. A lost task writes files of a new
    name, and only names that a finished task returned are in the result. Empty tables give no shard. Other columns of
    docs aren't read. ids are 16-bit where the vocabulary allows it, else 32-bit.
    """
    folder = folder or shared_dir(docs.sparkSession, "sequences")
    bounds = shard_bounds(docs, id_col, text_col, bytes_a_shard)
    coded = token_ids(docs, tokenizer_path, bounds, id_col, text_col, end_id, special_as_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, kind = TaskContext.get().partitionId(), encoder(tokenizer_path, special_as_text).kind
        fs, base = filesystem(folder)
        name, first = f"{base}/{shard:08d}-{uuid4().hex}", next(batches, None)
        if first is None or first.num_rows == 0:
            return
        fs.create_dir(base, recursive=True)
        at, n_docs = 0, 0
        docs_schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])
        with fs.open_output_stream(f"{name}.arrow") as sink, fs.open_output_stream(f"{name}.docs.arrow") as docs_sink:
            writer, index = SequenceWriter(sink, kind, length, rows), pa.ipc.new_file(docs_sink, docs_schema)
            for batch in (x for whole in _chain(first, batches) for x in by_bytes(whole)):
                writer.append(text_bytes(batch.column(2))[0].tobytes())
                sizes = batch.column(1).to_numpy()
                starts = at + np.cumsum(sizes) - sizes
                index.write_batch(pa.RecordBatch.from_arrays([batch.column(0), pa.array(starts), pa.array(sizes)], schema=docs_schema))
                at, n_docs = at + int(sizes.sum()), n_docs + len(sizes)
            writer.close()
            index.close()
        yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [f"{folder}/{name.rpartition('/')[2]}.arrow"], "docs_path": [f"{folder}/{name.rpartition('/')[2]}.docs.arrow"], "n_docs": [n_docs], "n_ids": [at]})

    dealt = coded.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("id", "tie", "ids")
    return materialize(dealt.select("id", "n", "ids").mapInArrow(run, SHARDS), "shards")


def _chain(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


class SequenceReader:
    """Random access to a shard: row(i) is a view into the file's pages where the store is a local or mounted one."""

    def __init__(self, path: str) -> None:
        fs, name = filesystem(path)
        self.source = pa.memory_map(name) if fs.type_name == "local" else fs.open_input_file(name)
        self.file = pa.ipc.open_file(self.source)
        self.first = self.file.get_batch(0).num_rows if self.file.num_record_batches else 0  # all but the last are alike

    def __enter__(self) -> SequenceReader:
        return self

    def __exit__(self, *_: object) -> None:
        self.source.close()

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        batch = self.file.get_batch(i // self.first)
        ids, mask = (batch.column(k).slice(i % self.first, 1).flatten() for k in (0, 1))
        return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)

    def stream(self) -> Iterator[np.ndarray]:
        """The ids without padding, a batch at a time."""
        for k in range(self.file.num_record_batches):
            batch = self.file.get_batch(k)
            n = batch.column(1).flatten().true_count
            yield batch.column(0).flatten().to_numpy()[:n]


def read_documents(shards: DataFrame) -> DataFrame:
    """(id, start, n_ids, ids_le) of every document of the files: start counts the ids of all documents before it,
    ids_le has its ids as little-endian unsigned 32-bit integers. A task reads a shard batch by batch. Null and empty texts
    have the end id alone, null ids come back as nulls, repeated rows as often as they were written; no shards, no rows."""
    offset = F.sum("n_ids").over(Window.orderBy("shard")) - F.col("n_ids")  # a row for each file
    ordered = shards.select("shard", "path", "docs_path", offset.alias("offset"))
    n = max(1, shards.count())
    dealt = ordered.repartitionByRange(max(n, 1), "shard") if n > 1 else ordered

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _documents(row["path"], row["docs_path"], row["offset"])

    return dealt.mapInArrow(run, "id long, start long, n_ids long, ids_le binary")


def _documents(path: str, docs_path: str, offset: int) -> Iterator[pa.RecordBatch]:
    fs, name = filesystem(docs_path)
    with SequenceReader(path) as sequences, fs.open_input_file(name) as source:
        stream, held, index = sequences.stream(), np.zeros(0, np.uint32), pa.ipc.open_file(source)
        for k in range(index.num_record_batches):
            docs = index.get_batch(k)
            sizes, parts, have = docs.column(2).to_numpy(), [held], len(held)
            need = int(sizes.sum())
            while have < need:
                parts.append(next(stream).astype("<u4"))
                have += len(parts[-1])
            ids = np.concatenate(parts)
            ends = np.cumsum(sizes)
            raw = ids[:need].tobytes()
            out = [raw[4 * (e - s) : 4 * e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
            held = ids[need:]
            starts = pa.array(docs.column(1).to_numpy() + offset)
            yield pa.RecordBatch.from_arrays([docs.column(0), starts, docs.column(2), pa.array(out, pa.binary())], names=["id", "start", "n_ids", "ids_le"])
