"""Byte-level BPE encoding and decoding by a hierarchical-bitmap rank queue.

The parts of all new pre-tokens of a batch are one linked list in arrays. Each merge rank has a bucket of positions in
it; three levels of 64-bit words say which buckets hold any, so that find-first-set gives the next rank in three steps
however many and long the pre-tokens are. Entries are not removed when a neighbour's merge outdates them: they are
skipped when their bucket comes up.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from orrery.llm.common import enter, memory_of, small_batches
from orrery.llm.segment_ids import HashIndex, SegmentIds, by_bytes, free, joined, mixed

#: Segments whose ids a Python worker keeps (some 40 bytes each); beyond it the memory starts anew.
REMEMBERED = 500_000
#: Bytes of text that a worker encodes at once, or one longer text. Half as many bytes of pre-tokens are merged at once (some
#: 40 bytes of memory each): the more, the fewer times all ranks are gone through.
PIECE = 1 << 22


class RankQueue:
    """Positions by merge rank: a bucket of arrays for each rank, smallest rank first."""

    def __init__(self, n_ranks: int) -> None:
        self.leaf = [0] * ((n_ranks >> 6) + 1)
        self.mid = [0] * ((len(self.leaf) >> 6) + 1)
        self.top = 0
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        if len(ranks) > 1:
            order = np.argsort(ranks, kind="stable")
            ranks, positions = ranks[order], positions[order]
            cut = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            runs = zip(ranks[np.r_[0, cut]].tolist(), np.split(positions, cut), strict=True) if len(cut) else ((int(ranks[0]), positions),)
        else:
            runs = zip(ranks.tolist(), (positions,), strict=True)
        buckets = self.buckets
        for rank, own in runs:
            if (bucket := buckets.get(rank)) is not None:
                bucket.append(own)
                continue
            buckets[rank] = [own]
            word = rank >> 6
            self.leaf[word] |= 1 << (rank & 63)
            self.mid[word >> 6] |= 1 << (word & 63)
            self.top |= 1 << (word >> 6)

    def pop(self) -> tuple[int, np.ndarray]:
        """The smallest rank and its bucket; only where top is not 0."""
        t = (self.top & -self.top).bit_length() - 1
        m = self.mid[t]
        word = (t << 6) | ((m & -m).bit_length() - 1)
        x = self.leaf[word]
        rank = (word << 6) | ((x & -x).bit_length() - 1)
        bucket = self.buckets.pop(rank)
        self.leaf[word] = x = x & (x - 1)
        if not x:
            self.mid[t] = m = m & (m - 1)
            if not m:
                self.top &= self.top - 1
        return rank, bucket[0] if len(bucket) == 1 else np.concatenate(bucket)


class Codec:
    """Encodes and decodes by a table of ranks. pattern: matches of it are merged separately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        words = [b""] * (max(ranks.values(), default=-1) + 1)
        for word, rank in ranks.items():
            words[rank] = word
        self.words = np.frombuffer(b"".join(words), np.uint8)
        self.word_size = np.array([len(x) for x in words], np.int64)
        self.word_begin = np.cumsum(self.word_size) - self.word_size
        self.split = regex.compile(pattern).findall
        self.byte_rank = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        halves = [(ranks[w[:k]], ranks[w[k:]], r) for w, r in ranks.items() for k in range(1, len(w)) if w[:k] in ranks and w[k:] in ranks]
        left, right, whole = np.array(halves, np.int64).reshape(-1, 3).T
        key = mixed(left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64))
        order = np.argsort(key)
        self.pairs, self.pair_rank = HashIndex(key[order]), np.append(whole[order], -1).astype(np.int32)
        self.merged = PIECE // 2
        self.memory = SegmentIds(self.encode_new, np.dtype("<i4"), REMEMBERED)

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of neighbours, -1 where they don't merge (right: -1 behind the last)."""
        found = self.pair_rank[self.pairs.find(mixed(left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint32).astype(np.uint64)))]
        return np.where(right >= 0, found, -1)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens one after another, and how many each has.

        All pre-tokens share one linked list, with an end behind each. A rank's bucket is merged whole, leftmost first
        where its pairs overlap: within a pre-token that is the order of one merge at a time, unless a merge makes a
        pair of a smaller rank than its own; such pre-tokens are merged again, alone.
        """
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        start, n = np.cumsum(size) - size, int(size.sum())
        part = np.append(self.byte_rank[np.frombuffer(b"".join(pieces), np.uint8)], -1)  # the last is no part
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[start + size - 1], before[start] = n, -1
        due = np.full(n + 1, -1, np.int32)
        due[:n] = self._pair(part[:n], part[after[:n]])
        gone, here, early = np.zeros(n + 1, bool), np.zeros(n + 1, bool), set()
        queue = RankQueue(len(self.word_size))
        at = np.flatnonzero(due >= 0)
        queue.push(due[at], at)
        while queue.top:
            rank, at = queue.pop()
            at = at[due[at] == rank]  # others are stale: a neighbour's merge came first
            if not len(at):
                continue
            if len(at) > 1:
                at = np.sort(at)
                at = at[np.r_[True, at[1:] != at[:-1]]]
                chained = np.r_[False, after[at[:-1]] == at[1:]]
                if chained.any():
                    run = np.arange(len(at))
                    at = at[(run - np.maximum.accumulate(np.where(chained, 0, run))) % 2 == 0]
            right = after[at]
            end = after[right]
            part[at], due[right], gone[right] = rank, -1, True
            after[at], before[end] = end, at
            left = before[at]
            here[at] = True
            left = left[(left >= 0) & ~here[left]]
            here[at] = False
            changed = np.concatenate([at, left])
            due[changed] = ranks = self._pair(part[changed], part[after[changed]])
            found = ranks >= 0
            ranks, changed = ranks[found], changed[found]
            if len(ranks):
                if ranks.min() < rank:
                    early.update(np.searchsorted(start, changed[ranks < rank], "right").tolist())
                queue.push(ranks, changed)
        ids, sizes = part[:n][~gone[:n]], np.add.reduceat(~gone[:n], start, dtype=np.int64)
        if early:
            begin = np.cumsum(sizes) - sizes
            parts = [ids[b : b + s] for b, s in zip(begin.tolist(), sizes.tolist(), strict=True)]
            for k in early:
                parts[k - 1] = np.array(self.merge_alone(pieces[k - 1]), np.int32)
            ids, sizes = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return ids, sizes

    def merge_alone(self, piece: bytes) -> list[int]:
        """Ids of one pre-token, one merge at a time."""
        ranks, n, heap = self.ranks, len(piece), []
        after, before, due = list(range(1, n + 1)), list(range(-1, n - 1)), [-1] * n

        def ask(pos: int) -> None:
            r = ranks.get(piece[pos : after[after[pos]]]) if after[pos] < n else None
            due[pos] = -1 if r is None else r
            if r is not None:
                heappush(heap, (r, pos))

        for pos in range(n - 1):
            ask(pos)
        while heap:
            rank, pos = heappop(heap)
            if due[pos] != rank:
                continue
            right = after[pos]
            after[pos], due[right], due[pos] = after[right], -1, -1
            if after[pos] < n:
                before[after[pos]] = pos
                ask(pos)
            if before[pos] >= 0:
                ask(before[pos])
        ids, pos = [], 0
        while pos < n:
            ids.append(ranks[piece[pos : after[pos]]])
            pos = after[pos]
        return ids

    def encode_new(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments one after another, and how many each has; equal pre-tokens are merged once."""
        place: dict[str, int] = {}
        order, owned, n_pieces = [], [], []
        between = [i for i, x in enumerate(segments) if free(x)]
        for lo in range(0, len(between), 8192):  # side by side, as no match goes across their ends
            part = between[lo : lo + 8192]
            found = self.split(b"".join([segments[i] for i in part]).decode())
            ends = np.cumsum([len(segments[i].decode()) for i in part])
            at = np.searchsorted(np.cumsum([len(x) for x in found]), ends, "left") + 1
            order += part
            n_pieces += np.diff(at, prepend=0).tolist()
            owned += [place.setdefault(x, len(place)) for x in found]
        for i in sorted(set(range(len(segments))).difference(between)):
            found = self.split(segments[i].decode())
            order.append(i)
            n_pieces.append(len(found))
            owned += [place.setdefault(x, len(place)) for x in found]
        pieces = [x.encode() for x in place]
        whole = np.fromiter((self.ranks.get(x, -1) for x in pieces), np.int64, len(pieces))
        rest = np.flatnonzero(whole < 0).tolist()
        size = np.ones(len(pieces), np.int64)
        begin, ids = np.arange(len(pieces)), [whole.astype(np.int32)]
        total, lo = len(pieces), 0
        while lo < len(rest):
            hi, held = lo, 0
            while hi < len(rest) and (hi == lo or held + len(pieces[rest[hi]]) <= self.merged):
                held, hi = held + len(pieces[rest[hi]]), hi + 1
            own, sizes = self.merge([pieces[i] for i in rest[lo:hi]])
            size[rest[lo:hi]], begin[rest[lo:hi]] = sizes, total + np.cumsum(sizes) - sizes
            ids.append(own)
            total, lo = total + len(own), hi
        owned, n_pieces, back = np.array(owned, np.int64), np.array(n_pieces, np.int64), np.argsort(order)
        sums = np.concatenate([[0], np.cumsum(size[owned])])
        ends = np.cumsum(n_pieces)
        flat, first = joined(np.concatenate(ids), begin[owned], size[owned]), sums[ends - n_pieces]
        sizes = sums[ends] - first
        return joined(flat, first[back], sizes[back]), sizes[back]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column one after another, and where each text's begin and the last end."""
        return self.memory.encode(column)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The bytes of lists of ids."""
        size = self.word_size[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        step = 1 << 18
        parts = [joined(self.words, self.word_begin[ids[k : k + step]], size[k : k + step]) for k in range(0, len(ids), step)]
        data = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
        return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(ends[offsets].astype(np.int64)), pa.py_buffer(data)])


_CODECS: dict[tuple[str, str], Codec] = {}
memory_of("byte_bpe", _CODECS.clear)


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 word and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec; the vocabulary file is installed on every node, as the libraries are."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(load_ranks(path), pattern)
    return _CODECS[path, pattern]


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None, piece: int = PIECE) -> DataFrame:
    """Add the ids of every whole text, and with decoded_col the bytes that decoding those ids gives.

    Null and empty texts have no ids (an empty array). Each match of pattern is merged apart; special tokens are
    ordinary text. Nothing is shuffled: rows, repeated ones too, stay where they are and keep their other columns.
    A column named like an output is replaced. A text is encoded whole; memory is bounded by the longest text and
    a memory of REMEMBERED short segments per worker; `piece` bytes of text at a time, which a caller whose executors
    are full makes smaller.
    """
    small_batches(df.sparkSession)
    keep = [c for c in df.columns if c not in (ids_col, decoded_col)]
    # the text goes to the workers once, as the last column, and stays if it isn't named like an output
    stays = text_col in keep
    sent = [c for c in keep if c != text_col]
    schema = T.StructType([df.schema[c] for c in sent] + [df.schema[text_col]] * stays + [T.StructField(ids_col, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded_col, T.BinaryType())] if decoded_col else []))
    source = df.select(*[df[c] for c in sent], df[text_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("byte_bpe")
        own = codec(path, pattern)
        own.merged = piece // 2
        for batch in (x for whole in batches for x in by_bytes(whole, piece)):
            ids, offsets = own.encode(batch.column(batch.num_columns - 1))
            columns = [*batch.columns[: len(sent) + stays], pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))]
            if decoded_col:
                columns.append(own.decode(ids, offsets).cast(pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(run, schema).select(*keep, ids_col, *([decoded_col] if decoded_col else []))


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """Add the bytes of an array of ids; null gives empty bytes. Other columns stay; a column decoded_col is replaced."""
    keep = [c for c in df.columns if c != decoded_col]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(decoded_col, T.BinaryType())])
    source = df.select(*[df[c] for c in keep], df[ids_col].alias("_bpe_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("byte_bpe")
        own = codec(path, pattern)
        for batch in (x.slice(at, 1024) for x in batches for at in range(0, x.num_rows, 1024)):
            lists = batch.column(batch.num_columns - 1)
            sizes = lists.value_lengths().fill_null(0).to_numpy()
            out = own.decode(lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)])).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], out], names=schema.names)

    return source.mapInArrow(run, schema)
