"""Runs of periodic words, and texts without their repetitions.

A run is a stretch of words with smallest period q, of max(least, 3 q) words or more, that no neighbouring word extends.
Along a run each word equals the one q before it: its diagonal, the lag q, has a match of length minus q. The search is an
online dynamic programme over sparse diagonals: a word's earlier occurrences lengthen the matches of their lags, a
diagonal that an occurrence doesn't lengthen ends, and a match that ended long enough is a run.

A frequent word has many earlier occurrences, so lags are taken in octaves. A run of a lag of 2 ** k or more matches over
twice as many words, and so over a whole block of 2 ** k words that begins at a multiple of it: in that octave the
programme's words are blocks, and of a block's earlier occurrences those of the octave's lags count. There are no more
of them than words in the block, so an octave has no more steps than the text has words, whatever it repeats; single
words serve the lags below 2 ** 4. Ends of matches are then set to the word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from orrery.llm.common import enter, small_batches
from orrery.llm.segment_ids import by_bytes, mixed

#: Words of a run, and its length in periods, at least.
LEAST, TIMES = 24, 3
#: Lags below 2 ** FIRST are searched by single words.
FIRST = 4
#: Words whose texts are searched at once, or one longer text.
AT_ONCE = 1 << 18
_P = np.uint64(0x9E3779B97F4A7C15)
RUN = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())])


class Matches:
    """Equal stretches of a sequence of word numbers by sums of powers; what a caller emits it compares word by word."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(words), _P)])
        self.power = power
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(mixed(words.astype(np.uint64) + np.uint64(1)) * power[:-1], out=self.sums[1:])

    def blocks(self, at: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the stretches of `size` words that begin at `at`, brought to one power."""
        return (self.sums[at + size] - self.sums[at]) * self.power[len(self.words) - at]

    def _equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        lag = b - a
        return (self.sums[a + size] - self.sums[a]) * self.power[lag] == self.sums[b + size] - self.sums[b]

    def ahead(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from a < b on are equal, `most` at most."""
        low, high = np.zeros_like(most), most.copy()
        while (todo := np.flatnonzero(low < high)).size:
            mid = (low[todo] + high[todo] + 1) // 2
            same = self._equal(a[todo], b[todo], mid)
            low[todo[same]], high[todo[~same]] = mid[same], mid[~same] - 1
        return low

    def behind(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words before a < b are equal, `most` at most."""
        low, high = np.zeros_like(most), most.copy()
        while (todo := np.flatnonzero(low < high)).size:
            mid = (low[todo] + high[todo] + 1) // 2
            same = self._equal(a[todo] - mid, b[todo] - mid, mid)
            low[todo[same]], high[todo[~same]] = mid[same], mid[~same] - 1
        return low


def _diagonals(at: np.ndarray, lag: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, lag) of the matches on each diagonal: occurrences at places one step apart lengthen the same match."""
    order = np.lexsort((at, lag))
    at, lag = at[order], lag[order]
    new = np.r_[True, (lag[1:] != lag[:-1]) | (at[1:] != at[:-1] + step)]
    first = np.flatnonzero(new)
    return at[first], at[np.r_[first[1:], len(at)] - 1], lag[first]


def _places(begin: np.ndarray, end: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Every step-th number from begin to below end, of all ranges, and the range of each."""
    many = np.maximum(-((begin - end) // step), 0)
    ends = np.cumsum(many)
    own = np.repeat(np.arange(len(begin)), many)
    return begin[own] + step * (np.arange(len(own)) - (ends - many)[own]), own


def _octave(text: Matches, begin: np.ndarray, end: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag): blocks of `size` words at multiples of it in the texts [begin, end), and their earlier occurrences at
    lags of size to 2 size - 1."""
    place, own = _places(begin, end - size + 1, 1)
    hashes = text.blocks(place, size) + mixed(own.astype(np.uint64))  # texts apart
    order = np.argsort(hashes, kind="stable")  # equal blocks stay in their order
    hashes = hashes[order]
    first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
    count = np.diff(first, append=len(place))
    anchor, of = _places(begin + size, end - size + 1, size)
    group = np.searchsorted(hashes[first], text.blocks(anchor, size) + mixed(of.astype(np.uint64)))
    use = count[group] > 1
    anchor, group, of = anchor[use], group[use], of[use]
    n = len(text.words) + 1
    ranked = np.repeat(np.arange(len(first)), count) * n + place[order]
    low = np.searchsorted(ranked, group * n + np.maximum(anchor - 2 * size + 1, begin[of]))
    many = np.maximum(np.searchsorted(ranked, group * n + anchor - size, "right") - low, 0)
    ends = np.cumsum(many)
    rows = np.repeat(np.arange(len(anchor)), many)
    found = place[order][(low - (ends - many))[rows] + np.arange(len(rows))]
    return anchor[rows], anchor[rows] - found


def _with_repeats(text: Matches, begin: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """Which of the texts have a block of `size` words twice; only they can have a run of a lag of so many words."""
    place, own = _places(begin, end - size + 1, 1)
    hashes = text.blocks(place, size) + mixed(own.astype(np.uint64))
    ordered = np.sort(hashes)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(twice, hashes), len(twice) - 1)
    return np.unique(own[twice[at] == hashes])


def find_runs(words: np.ndarray, sizes: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs, by text, start and period. words: numbers of the words of texts one after
    another, sizes: how many each has. times is 3 at least: shorter runs needn't hold a whole block of their octave."""
    if times < 3:
        raise ValueError("runs of fewer than three periods aren't searched")
    begin = np.cumsum(sizes) - sizes
    end = begin + sizes
    long = np.flatnonzero(sizes >= least)
    if not len(long):
        return (np.zeros(0, np.int64),) * 4
    text = Matches(words)
    starts, lengths, periods = [], [], []

    def emit(first: np.ndarray, last: np.ndarray, lag: np.ndarray, own: np.ndarray) -> None:
        """Matches from first to last on diagonals, in texts `own`, that are long enough once their ends are set."""
        most = first - lag - begin[own]
        start = first - lag - text.behind(first - lag, first, most)
        stop = last + text.ahead(last - lag, last, end[own] - last)
        use = stop - start >= np.maximum(least, times * lag)
        starts.append(start[use])
        lengths.append((stop - start)[use])
        periods.append(lag[use])

    owner = np.repeat(np.arange(len(sizes)), sizes)
    for lag in range(1, 1 << FIRST):
        same = np.flatnonzero((words[lag:] == words[:-lag]) & (owner[lag:] == owner[:-lag])) + lag if len(words) > lag else np.zeros(0, np.int64)
        if len(same):
            first, last, lags = _diagonals(same, np.full(len(same), lag), 1)
            use = last + 1 - (first - lag) >= max(least, times * lag)
            emit(first[use], last[use], lags[use], owner[first[use]])
    size = 1 << FIRST
    live = np.flatnonzero(sizes >= max(least, times * size))
    live = live[_with_repeats(text, begin[live], end[live], size)] if len(live) else live
    while len(own := live[sizes[live] >= max(least, times * size)]):
        at, lag = _octave(text, begin[own], end[own], size)
        if len(at):
            first, last, lags = _diagonals(at, lag, size)
            emit(first, last, lags, owner[first])
        size *= 2
    start, length, period = np.concatenate(starts), np.concatenate(lengths), np.concatenate(periods)
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    # a stretch of a period has its multiples too: the smallest counts, once
    new = np.r_[True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])][: len(start)]
    start, length, period = start[new], length[new], period[new]
    exact = np.fromiter((np.array_equal(words[s : s + m - q], words[s + q : s + m]) for s, m, q in zip(start.tolist(), length.tolist(), period.tolist(), strict=True)), bool, len(start))
    start, length, period = start[exact], length[exact], period[exact]
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    return owner[start], start - begin[owner[start]], length, period


def kept_words(size: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which words of a text stay: those that no run contains behind its first period."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return np.cumsum(change[:-1]) == 0


def collapsed(docs: DataFrame, text_col: str = "text", runs_col: str = "runs", out_col: str = "collapsed", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Add the runs of every whole text, array of (start, length, period) by start and period, and the text of the words
    that stay, joined by one space: a word goes if a run contains it behind the run's first period.

    Words are runs of characters other than ASCII white space, numbered from 0. Null and empty texts have no words: no
    runs and an empty text. Rows stay where they are, repeated ones too, and nothing is shuffled; other columns stay, and
    columns named like an output are replaced. An empty table gives an empty one. A text is searched whole, a longer
    one alone: some 100 bytes a word, in time that grows with its length (times its logarithm), whatever it repeats.
    """
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in (runs_col, out_col)]
    stays = text_col in keep
    sent = [c for c in keep if c != text_col]
    schema = T.StructType([docs.schema[c] for c in sent] + [docs.schema[text_col]] * stays + [T.StructField(runs_col, T.ArrayType(RUN)), T.StructField(out_col, T.StringType())])
    source = docs.select(*[docs[c] for c in sent], docs[text_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("periodic")
        for batch in (x for whole in batches for x in by_bytes(whole, 1 << 21)):
            found, out = _search([(x or "").encode().split() for x in batch.column(batch.num_columns - 1).to_pylist()], least, times)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(sent) + stays], found, out], names=schema.names)

    return source.mapInArrow(run, schema).select(*keep, runs_col, out_col)


def _search(texts: list[list[bytes]], least: int, times: int) -> tuple[pa.Array, pa.Array]:
    numbers: dict[bytes, int] = {}
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    words = np.fromiter((numbers.setdefault(w, len(numbers)) for x in texts for w in x), np.int64, int(sizes.sum()))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    parts = []
    lo = 0
    while lo < len(texts):
        hi = max(int(np.searchsorted(ends, ends[lo] + AT_ONCE, "right")) - 1, lo + 1)
        own, *rest = find_runs(words[ends[lo] : ends[hi]], sizes[lo:hi], least, times)
        parts.append((own + lo, *rest))
        lo = hi
    own, start, length, period = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 4
    offsets = np.searchsorted(own, np.arange(len(texts) + 1)).astype(np.int32)
    out = []
    for k, x in enumerate(texts):
        part = slice(offsets[k], offsets[k + 1])
        if part.start < part.stop:
            stay = kept_words(len(x), start[part], length[part], period[part])
            x = [x[i] for i in np.flatnonzero(stay).tolist()]
        out.append(b" ".join(x))
    structs = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(period, pa.int64())], fields=[pa.field("start", pa.int64()), pa.field("length", pa.int64()), pa.field("period", pa.int64())])
    return pa.ListArray.from_arrays(pa.array(offsets), structs), pa.array(out, pa.binary()).cast(pa.string())
