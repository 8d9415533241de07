"""Byte n-grams at every position of whole texts, and scores in sorted hash arrays: what the two language models share.

An n-gram of up to seven bytes is one 64-bit key: its length in the top byte, its bytes below.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.segment_ids import HashIndex, mixed

#: Marks before and behind a text: bytes that UTF-8 never has.
START, END = b"\xff", b"\xfe"
#: So many n-grams, the most frequent of all, have their scores in the workers; others are joined.
HELD = 1 << 19
#: Scores are log10 in whole billionths, so that sums don't depend on their order.
UNIT = 1e9
_BODY = (1 << 56) - 1


def windows(data: bytes, length: int) -> np.ndarray:
    """Keys of the n-grams of `length` bytes (7 at most) that begin at each byte, as far as they fit."""
    whole = np.ndarray((max(len(data) - length + 1, 0),), ">u8", data + bytes(8), strides=(1,))
    return (whole.astype(np.uint64) >> np.uint64(64 - 8 * length)) | np.uint64(length << 56)


def events(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-grams at all events of the texts, and where each text's begin. A text's events are its bytes and
    an end mark; start marks before it fill the first contexts."""
    data = b"".join([x for text in texts for x in (START * (order - 1), text, END)])
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + order
    begins = np.cumsum(sizes) - sizes
    keys = windows(data, order)
    use = np.ones(len(keys), bool)
    for back in range(1, order):  # windows that reach into the next text
        use[begins[1:] - back] = False
    return keys[use], begins - np.arange(len(texts)) * (order - 1)


def pieces(texts: list[bytes], most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of texts of so many bytes in all, or of one longer text."""
    at, size = 0, 0
    for i, text in enumerate(texts):
        if i > at and size + len(text) > most:
            yield at, i
            at, size = i, 0
        size += len(text)
    if at < len(texts):
        yield at, len(texts)


def length_of(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(56)).astype(np.int64)


def context_of(key: np.ndarray) -> np.ndarray:
    """The n-gram without its last byte."""
    return ((key & np.uint64(_BODY)) >> np.uint64(8)) | ((length_of(key) - 1).astype(np.uint64) << np.uint64(56))


def sums(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their weights."""
    if not len(key):
        return key, weight
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[start], np.add.reduceat(weight, start)


class Counts:
    """Numbers of n-grams, summed as pieces of text come."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, texts: list[bytes], order: int, weight: int = 1) -> None:
        for a, b in pieces(texts, 1 << 21):
            key = np.sort(events(texts[a:b], order)[0])
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            self.parts.append((key[start], weight * np.diff(start, append=len(key))))
            if len(self.parts) > 8:
                self.parts = [self.whole()]

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return sums(np.concatenate([k for k, _ in self.parts]), np.concatenate([n for _, n in self.parts]))


def context(gram: Column) -> Column:
    """The n-gram without its last byte."""
    body = F.shiftright(gram.bitwiseAND(F.lit(_BODY)), 8)
    return body.bitwiseOR(F.shiftleft(F.shiftrightunsigned(gram, 56) - 1, 56))


def last(gram: Column, k: int) -> Column:
    """The last k bytes of an n-gram."""
    return gram.bitwiseAND(F.lit((1 << (8 * k)) - 1)).bitwiseOR(F.lit(k << 56))


class Held:
    """Scores of n-grams in arrays sorted by a hash of the key; the hash is one-to-one, so what is found is exact."""

    def __init__(self, keys: np.ndarray, scores: np.ndarray) -> None:
        hashes = mixed(keys)
        order = np.argsort(hashes)
        self.hashes, self.scores = hashes[order], np.append(scores[order], 0)

    def __getstate__(self) -> tuple[np.ndarray, np.ndarray]:
        return self.hashes, self.scores

    def __setstate__(self, state: tuple[np.ndarray, np.ndarray]) -> None:
        self.hashes, self.scores = state

    @cached_property
    def index(self) -> HashIndex:
        return HashIndex(self.hashes)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The score of each key, 0 where it isn't held, and whether it is."""
        at = self.index.find(mixed(keys))
        return self.scores[at], at >= 0

    def text_scores(self, texts: list[bytes], order: int) -> tuple[list[int], list[np.ndarray]]:
        """Sum of the scores of each text's held n-grams, and the keys of its others, as often as they occur."""
        totals: list[int] = []
        rest: list[np.ndarray] = []
        for a, b in pieces(texts):
            key, begins = events(texts[a:b], order)
            score, there = self.find(key)
            totals += np.add.reduceat(score, begins).tolist()
            places = np.flatnonzero(~there)
            rest += np.split(key[places].view(np.int64), np.searchsorted(places, begins[1:]))
        return totals, rest


def most_frequent(table: DataFrame, most: int) -> DataFrame | None:
    """Rows of a table with counts n, the most frequent, `most` at most: whole grades of n, some 16 to a doubling."""
    grade = F.floor(F.log2("n") * 16).cast("int")  # about a thousand grades at any size
    bar, rows = None, 0
    for r in sorted(table.groupBy(grade.alias("grade")).count().collect(), key=lambda r: -r["grade"]):
        rows += r["count"]
        if rows > most:
            break
        bar = r["grade"]
    return None if bar is None else table.filter(grade >= bar)


def held_scores(table: DataFrame, most: int = HELD) -> dict[str | None, Held]:
    """By language, the scores of the most frequent n-grams of a table (lang, gram, n, score), `most` in all at most."""
    out: dict[str | None, Held] = {}
    if (top := most_frequent(table, most)) is not None:
        kept = top.select("lang", "gram", "score").toArrow()
        code = kept["lang"].combine_chunks().dictionary_encode(null_encoding="encode")
        index, key, score = code.indices.to_numpy(), kept["gram"].to_numpy().view(np.uint64), kept["score"].to_numpy()
        for i, lang in enumerate(code.dictionary.to_pylist()):
            out[lang] = Held(key[index == i], score[index == i])
    return out


NONE = Held(np.zeros(0, np.uint64), np.zeros(0, np.int64))
