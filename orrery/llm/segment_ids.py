"""Token ids of whole texts from the ids of their segments, which a Python worker remembers in arrays.

Texts are cut before ASCII white space that follows another character. Splitting patterns of byte-level tokenizers
never match across such a place, so segments are encoded apart and their ids joined. Cutting, looking up and joining
are array operations over the bytes of a batch; only segments that are new to the worker become Python objects.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are hashed at once.
PIECE = 1 << 19
#: Longer segments are encoded each time and not remembered.
LONGEST = 200
_P = np.uint64(0x9E3779B97F4A7C15)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings (null: empty), and where each begins and the last ends."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def by_bytes(batch: pa.RecordBatch, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose last column has so many bytes at most, or one longer row."""
    ends = text_bytes(batch.column(batch.num_columns - 1))[1]
    lo = 0
    while lo < batch.num_rows:
        hi = max(int(np.searchsorted(ends, ends[lo] + most, "right")) - 1, lo + 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def cuts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where segments begin: at each text that isn't empty, and before white space (tab to return, space) that follows
    another character. After a character that might be wider white space no segment begins."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    mark = np.zeros(len(data) + 1, bool)
    mark[1:-1] = space[1:] & ~space[:-1]
    at = np.flatnonzero(mark)
    odd = at[data[at - 1] >= 0x80]
    if len(odd):
        two, three = data[np.maximum(odd - 2, 0)], data[np.maximum(odd - 3, 0)]
        last, lead = data[odd - 1], (three == 0xE1) | (three == 0xE2) | (three == 0xE3)
        wide = ((two == 0xC2) & ((last == 0x85) | (last == 0xA0))) | (lead & np.isin(two, (0x80, 0x81, 0x9A)))
        mark[odd[wide]] = False
    mark[begins] = True
    return np.flatnonzero(mark[:-1])


def joined(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs values[begin : begin + size] one after another."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(begin - (ends - size), size) + np.arange(total)]


def free(segment: bytes) -> bool:
    """Whether a segment may stand between others: it begins with white space and its last character is none."""
    last = segment[-1]
    return segment[0] <= 32 and (32 < last < 0x80 or (last >= 0x80 and not segment[-4:].decode(errors="ignore")[-1:].isspace())) and segment[0] in b" \t\n\v\f\r"


class HashIndex:
    """Sorted 64-bit hashes; the top bits of a hash say where to look."""

    def __init__(self, sorted_hashes: np.ndarray) -> None:
        bits = max(1, int(len(sorted_hashes)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.hashes = np.append(sorted_hashes, np.uint64(2**64 - 1))
        counts = np.bincount((sorted_hashes >> self.shift).astype(np.int64), minlength=1 << bits)
        self.first = (np.cumsum(counts) - counts).astype(np.int32)
        self.size = len(sorted_hashes)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Places of the wanted hashes, -1 where absent."""
        at = self.first[wanted >> self.shift]
        there = self.hashes[at]
        out = np.where((there == wanted) & (at < self.size), at, -1)
        live = np.flatnonzero(there < wanted)
        while len(live):
            at[live] += 1
            there = self.hashes[at[live]]
            hit = (there == wanted[live]) & (at[live] < self.size)
            out[live[hit]] = at[live[hit]]
            live = live[there < wanted[live]]
        return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one mapping of 64-bit numbers that spreads them evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SegmentIds:
    """Ids of texts. encode_new gives the ids of new segments, joined, and how many each has."""

    def __init__(self, encode_new: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], kind: np.dtype, most: int) -> None:
        self.encode_new, self.kind, self.most = encode_new, np.dtype(kind), most
        random = np.random.default_rng(41)
        self.byte = random.integers(0, 2**64, (2, 256), np.uint64)
        self.power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(PIECE + LONGEST, _P)])
        self.inverse = np.multiply.accumulate(np.r_[np.uint64(1), np.full(PIECE + LONGEST, np.uint64(pow(int(_P), -1, 2**64)))])
        self.forget()

    def forget(self) -> None:
        self.key, self.check, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.begin, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.kind)
        self.index = HashIndex(self.key)

    def _hashes(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each run of the bytes."""
        out = []
        for table in self.byte:
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(table[data] * self.power[: len(data)], out=sums[1:])
            out.append(mixed((sums[end] - sums[begin]) * self.inverse[begin] + (end - begin).astype(np.uint64) * _P))
        return out[0], out[1]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column (null: empty) one after another, and where each text's begin and the last end."""
        if len(self.key) > self.most:
            self.forget()
        data, at = text_bytes(column)
        start = cuts(data, at[:-1][at[:-1] < at[1:]])
        end = np.append(start[1:], len(data)) if len(start) else start
        entry = np.full(len(start), -1, np.int32)
        n_known, new = len(self.begin), []
        short = end - start <= LONGEST
        lo = 0
        while lo < len(start):
            hi = max(int(np.searchsorted(end, start[lo] + PIECE, "right")), lo + 1)
            use = np.flatnonzero(short[lo:hi]) + lo
            if len(use):
                first = start[use[0]]
                own = data[first : end[use[-1]]]
                key, check = self._hashes(own, start[use] - first, end[use] - first)
                entry[use] = self._known(key, check)
                missed = np.flatnonzero(entry[use] < 0)
                if len(missed):
                    names, place = np.unique(key[missed], return_index=True)
                    place = missed[place]
                    numbers = np.arange(len(names), dtype=np.int32) + n_known + len(new)
                    new += [own[s:e].tobytes() for s, e in zip((start[use[place]] - first).tolist(), (end[use[place]] - first).tolist(), strict=True)]
                    # a hash that is there already with another check stays what it was; so few that they aren't remembered
                    clash = self.index.find(names) >= 0
                    self._insert(names[~clash], check[place][~clash], numbers[~clash])
                    entry[use[missed]] = self._known(key[missed], check[missed])
                    entry[use[place[clash]]] = numbers[clash]
            lo = hi
        alone = np.flatnonzero(entry < 0)  # long ones, and whatever has a hash of something else
        entry[alone] = np.arange(len(alone)) + n_known + len(new)
        new += [data[s:e].tobytes() for s, e in zip(start[alone].tolist(), end[alone].tolist(), strict=True)]
        if new:
            ids, sizes = self.encode_new(new)
            self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(sizes) - sizes])
            self.size, self.ids = np.concatenate([self.size, sizes]), np.concatenate([self.ids, ids.astype(self.kind)])
        step = 1 << 18
        parts = [joined(self.ids, self.begin[entry[k : k + step]], self.size[entry[k : k + step]]) for k in range(0, len(entry), step)]
        flat = np.concatenate(parts) if parts else np.zeros(0, self.kind)
        ends = np.concatenate([[0], np.cumsum(self.size[entry])]).astype(np.int64)
        offsets = ends[np.searchsorted(start, at)]
        if len(alone):
            kept = len(self.begin) - len(alone)
            self.ids = self.ids[: self.begin[kept]]
            self.begin, self.size = self.begin[:kept], self.size[:kept]
        return flat, offsets

    def _known(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        if not len(self.key):
            return np.full(len(key), -1, np.int32)
        place = self.index.find(key)
        return np.where((place >= 0) & (self.check[place] == check), self.entry[place], -1).astype(np.int32)

    def _insert(self, key: np.ndarray, check: np.ndarray, entry: np.ndarray) -> None:
        at = np.searchsorted(self.key, key)
        self.key, self.check, self.entry = np.insert(self.key, at, key), np.insert(self.check, at, check), np.insert(self.entry, at, entry)
        self.index = HashIndex(self.key)
