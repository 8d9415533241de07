"""WARC archives written from, and read back as, a table of chunks.

A record is rows (record_id, chunk_no, data): payloads go to an archive, and come from one, a chunk at a time with
the digest carried along, so that no Python task ever holds a whole record, however large.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import filesystem, materialize, shared_dir

CHUNK = 1 << 18
#: Of gzip.
LEVEL = 4
#: Smaller payloads are written again rather than referred to.
LEAST_REVISIT = 100
ARCHIVES = "path string, n_records long, n_bytes long"
CHUNKS = "record_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, chunk_no int, n_chunks int, chunk_offset long, data binary, running_digest string"


def chunk_table(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", chunk: int = CHUNK, least: int = LEAST_REVISIT) -> DataFrame:
    """CHUNKS of every page: the payload is the column in UTF-8 (null: empty, one chunk without bytes).

    Of pages with equal payloads of at least `least` bytes, the one of the smallest id is a response; the others are
    revisits of it and have one empty chunk. Rows that share that smallest id are all responses. Equal payloads are
    found by SHA-256 and length, summed before the shuffle, so thousands of copies are a row a task; pages then meet
    the few digests that occur more than once, and payloads aren't shuffled where those are small. Null ids: such
    pages are responses and no one's target.

    A row has its chunk's offset, and a digest that carries on: SHA-256 of the chunk for the first, of the digest before
    (its hexadecimal digits) and the chunk for the others. A chunk that is lost, moved or changed shows at once.
    """
    payload = F.coalesce(pages[payload_col].cast("binary"), F.lit(b""))
    rows = pages.select(pages[id_col].cast("long").alias("record_id"), pages[url_col].alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    large = rows.filter((F.col("payload_bytes") >= least) & F.col("record_id").isNotNull()).select(F.col("record_id").alias("id"), F.col("payload_digest").alias("of"))
    first = large.groupBy(F.col("of").alias("digest")).agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    revisits = large.join(first, F.col("of") == F.col("digest")).filter("id > first").select("id", "digest", "first").distinct()
    revisits = materialize(revisits, "revisits")
    # an id that repeats may have several payloads, so the digest is part of the key
    joined = rows.join(revisits, (F.col("record_id") == F.col("id")) & (F.col("payload_digest") == F.col("digest")), "left")
    again = F.col("first").isNotNull()
    joined = joined.select("record_id", "url", "payload_bytes", "payload_digest", F.when(again, F.lit(b"")).otherwise(F.col("payload")).alias("payload"), again.alias("again"), F.col("first").alias("refers_to"))
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("payload") / F.lit(chunk))).cast("int")
    part = lambda k: F.substring("payload", k * F.lit(chunk) + 1, F.lit(chunk))
    carried = F.aggregate(
        F.sequence(F.lit(0), n - 1),
        F.array().cast("array<string>"),
        lambda done, k: F.concat(done, F.array(F.sha2(F.concat(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")).cast("binary"), part(k)), 256))),
    )
    digests = F.when(n > 1, carried).otherwise(F.array(F.when(F.col("again"), F.sha2(F.lit(b""), 256)).otherwise(F.col("payload_digest"))))
    joined = joined.withColumn("n_chunks", n).select("*", F.posexplode(digests).alias("chunk_no", "running_digest"))
    return joined.select(
        "record_id",
        "url",
        F.when(F.col("again"), "revisit").otherwise("response").alias("record_type"),
        "refers_to",
        "payload_bytes",
        "payload_digest",
        "chunk_no",
        "n_chunks",
        (F.col("chunk_no").cast("long") * chunk).alias("chunk_offset"),
        part(F.col("chunk_no")).alias("data"),
        "running_digest",
    )


def carried_on(before: str, data: bytes) -> str:
    """The digest that a chunk's row has; before: that of the chunk before, empty for the first."""
    return hashlib.sha256(before.encode() + data).hexdigest()


def _urn(record_id: int | None) -> str:
    return f"<urn:page:{'' if record_id is None else record_id}>"


def _record_id(urn: str) -> int | None:
    digits = urn[len("<urn:page:") : -1]
    return int(digits) if digits else None


def write_archives(chunks: DataFrame, folder: str | None = None, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write one archive a partition of chunks (rows of a record must follow each other in order); returns ARCHIVES.

    An archive is a gzip member for each record, as readers of WARC expect. A block is HTTP
    headers and the payload. Chunks must follow each other without a gap, and have the digests that carry on; a response's
    digest is computed over the chunks as they pass and must be the one that its header, written before them, names. A
    lost task writes a file of a new name, and only names
    that finished tasks returned are in the result, which is kept in files itself. An empty table has no archive.
    """
    folder = folder or shared_dir(chunks.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        name, sink, n, digest = f"{TaskContext.get().partitionId():06d}-{uuid4().hex}.warc.gz", None, 0, None
        at = (None, 0, 0, "")  # record, number and offset that come next, digest so far
        try:
            for batch in batches:
                for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                    if sink is None:
                        fs.create_dir(base, recursive=True)
                        sink = fs.open_output_stream(f"{base}/{name}", compression=None)
                    if row["chunk_no"] == 0:
                        at = (row["record_id"], 0, 0, "")
                        packer, digest = zlib.compressobj(LEVEL, wbits=31), hashlib.sha256()
                        sink.write(packer.compress(_head(row, date)))
                        n += 1
                    sink.write(packer.compress(row["data"]))
                    digest.update(row["data"])
                    carried = carried_on(at[3], row["data"]) if row["n_chunks"] > 1 else digest.hexdigest()
                    if (row["record_id"], row["chunk_no"], row["chunk_offset"], row["running_digest"]) != (*at[:3], carried):
                        raise ValueError(f"chunk {row['chunk_no']} of record {row['record_id']} is not what follows")
                    at = (at[0], at[1] + 1, at[2] + len(row["data"]), carried)
                    if row["chunk_no"] == row["n_chunks"] - 1:
                        sink.write(packer.compress(b"\r\n\r\n") + packer.flush())
                        if row["record_type"] == "response" and digest.hexdigest() != row["payload_digest"]:
                            raise ValueError(f"chunks of record {row['record_id']} don't give its digest")
        finally:
            if sink is not None:
                size = sink.tell()
                sink.close()
        if sink is not None:
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_records": [n], "n_bytes": [size]})

    return materialize(chunks.mapInArrow(run, ARCHIVES), "archives")


def _head(row: dict, date: str) -> bytes:
    stored = row["payload_bytes"] if row["record_type"] == "response" else 0
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    url = "".join(x for x in row["url"] or "" if x not in "\r\n")
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {_urn(row['record_id'])}", f"WARC-Date: {date}", f"WARC-Target-URI: {url}"]
    lines += [f"WARC-Payload-Digest: sha256:{row['payload_digest']}", "Content-Type: application/http;msgtype=response"]
    if row["record_type"] == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(row['refers_to'])}"]
    lines.append(f"Content-Length: {len(http) + stored}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def read_archives(archives: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """CHUNKS of every record, read from the archives' bytes a chunk at a time. data of a revisit is empty. The last
    chunk of a response is only given if its bytes have the digest of its header; a damaged archive raises an error.
    payload_bytes is what the record's HTTP header says, and for responses what was read. No archives give no rows; empty
    payloads (of null or empty ones) are one empty chunk."""
    n = archives.count()
    dealt = archives.select("path").repartition(n, "path") if n > 1 else archives.select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                yield from _read(path, chunk)

    return dealt.mapInArrow(run, CHUNKS)


def _read(path: str, chunk: int) -> Iterator[pa.RecordBatch]:
    fs, name = filesystem(path)
    schema = pa.schema([("record_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("chunk_no", pa.int32()), ("n_chunks", pa.int32()), ("chunk_offset", pa.int64()), ("data", pa.binary()), ("running_digest", pa.string())])
    rows: list[dict] = []
    held = 0
    with fs.open_input_stream(name, compression=None, buffer_size=1 << 20) as raw:
        lines = _Lines(_Members(raw))
        while (version := lines.line()) is not None:
            if version != b"WARC/1.1":
                raise ValueError(f"no record at {version[:40]!r} in {path}")
            head = lines.headers()
            left = int(head["content-length"])
            before = lines.taken
            lines.line()  # HTTP status
            size = int(lines.headers()["content-length"])
            left -= lines.taken - before
            digest, kind = hashlib.sha256(), head["warc-type"]
            own = {"record_id": _record_id(head["warc-record-id"]), "url": head["warc-target-uri"], "record_type": kind, "refers_to": _record_id(head["warc-refers-to"]) if kind == "revisit" else None, "payload_bytes": size, "payload_digest": head["warc-payload-digest"].removeprefix("sha256:")}
            n, carried = max(1, -(-left // chunk)), ""
            for k in range(n):
                data = lines.read(min(chunk, left))
                left -= len(data)
                digest.update(data)
                if k == n - 1 and kind == "response" and digest.hexdigest() != own["payload_digest"]:
                    raise ValueError(f"payload of {own['record_id']} in {path} is damaged")
                carried = carried_on(carried, data) if n > 1 else digest.hexdigest()
                rows.append(own | {"chunk_no": k, "n_chunks": n, "chunk_offset": k * chunk, "data": data, "running_digest": carried})
                held += len(data)
                if held >= 4 * chunk or len(rows) >= 4096:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
            if lines.read(4) != b"\r\n\r\n":
                raise ValueError(f"record {own['record_id']} in {path} has no end")
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


class _Members:
    """What the gzip members of a stream hold, at most n bytes a read."""

    def __init__(self, stream) -> None:
        self.stream, self.raw, self.unpacker = stream, b"", zlib.decompressobj(31)

    def read(self, n: int) -> bytes:
        while True:
            if self.unpacker.eof:
                self.raw, self.unpacker = self.unpacker.unused_data, zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.stream.read(1 << 16)
            try:
                out = self.unpacker.decompress(self.raw, n)
            except zlib.error as e:
                raise ValueError(f"the archive is damaged: {e}") from e
            ended = not self.raw
            self.raw = b"" if self.unpacker.eof else self.unpacker.unconsumed_tail
            if out or ended:
                return out


class _Lines:
    """Lines and runs of bytes from a stream."""

    def __init__(self, stream) -> None:
        self.stream, self.buffer, self.taken = stream, b"", 0

    def _more(self) -> bool:
        data = self.stream.read(1 << 16)
        self.buffer += data
        return bool(data)

    def line(self) -> bytes | None:
        while (end := self.buffer.find(b"\r\n")) < 0:
            if not self._more():
                if self.buffer:
                    raise ValueError("the archive ends in a line")
                return None
        out, self.buffer = self.buffer[:end], self.buffer[end + 2 :]
        self.taken += end + 2
        return out

    def headers(self) -> dict[str, str]:
        out = {}
        while line := self.line():
            name, _, value = line.decode().partition(":")
            out[name.strip().lower()] = value.strip()
        return out

    def read(self, n: int) -> bytes:
        parts, have = [self.buffer[:n]], min(n, len(self.buffer))
        self.buffer = self.buffer[have:]
        while have < n:
            parts.append(self.stream.read(n - have))
            have += len(parts[-1])
            if not parts[-1]:
                raise ValueError("the archive ends in a record")
        self.taken += n
        return b"".join(parts)
