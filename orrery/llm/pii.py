"""Personal data: patterns for four kinds, and a linear-chain conditional random field over word shapes.

The field is trained from a small labelled table and adds what the patterns miss: phone numbers without a plus, cards
in other groups, addresses that are spelled out. A line of a text is a chain, and all words of all lines count: the
scores of a batch's words are sums of array look-ups by word and by shape, and the lines of a batch are decoded side by
side. A line where no word's score can pay for a label, by a bound from the trained weights, has no labels; that is what
decoding it would give.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.common import enter, memory_of, small_batches
from orrery.llm.pii_labels import LABELLED
from orrery.llm.segment_ids import by_bytes

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *[f"{p}-{k}" for k in KINDS for p in "BI"])
SPANS = T.ArrayType(T.StructType().add("kind", T.StringType()).add("start", T.IntegerType()).add("end", T.IntegerType()).add("base", T.BooleanType()))


class Span(NamedTuple):
    kind: str
    start: int
    end: int


# ---- patterns -------------------------------------------------------------------------------------------------
# Possessive runs and a look-behind give the matches of the plain patterns in time linear in the text: a run of
# digits that fails from its start fails from its middle too, and a match of `ip` never ends inside such a run.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    """Whether the digits, every second from the right doubled, sum to a multiple of ten."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    free = 0  # where the last match ended
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield Span("email", start, m.end())
            free = m.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind that don't overlap others of it; those that fail its condition are dropped."""
    found = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        found += [Span("ip", *m.span()) for m in _IP.finditer(text) if all(int(x[-4:]) <= 255 and len(x.lstrip("0")) <= 3 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(Span("card", *m.span()))
        if "+" in text:
            found += [Span("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(x.isdigit() for x in m[0]) <= 15]
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


# ---- features -------------------------------------------------------------------------------------------------
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: Classes of bytes: capitals, letters (all beyond ASCII count as such), digits; other characters are themselves.
_CLASSES = bytes(65 if 65 <= b <= 90 else 57 if 48 <= b <= 57 else 97 if 97 <= b <= 122 or b >= 128 else b for b in range(256))
_RUNS, _DIGITS = re.compile(r"A+|a+"), re.compile(r"9+")
_BETWEEN = re.compile(r"[-./_]|[\[({]\.[\])}]")
_EDGES = ".,;:!?\"'"
#: Words that tell by themselves, also with one mark before and two behind.
NAMED = tuple("at dot call phone tel fax ring dial number card visa ip host server mail email write contact id order version page section isbn account ticket sum total units pages invoice serial ref reference part lot item case batch tracking patent sku people rows com org net de info co uk eu number code model flight policy telephone telefon mobile cell call rooms items years".split())
_OPEN, _CLOSE = ("", "(", "[", "{", '"', "'"), ("", ".", ",", ":", ";", "!", "?", ")", "]", "}", '"', "'", "),", ").", "],", "].", '",', '".')
NAME_OF = {(o + w + c).encode(): i for i, w in enumerate(NAMED, 1) for o in _OPEN for c in _CLOSE}


class Word(NamedTuple):
    """What the field sees of a word."""

    shape: str
    name: str
    own: list[str]


def classes(text: bytes) -> bytes:
    return text.translate(_CLASSES)


def seen(word: bytes) -> Word:
    """Of a word by its classes: runs of letters as one, digits one by one, no marks at the edges."""
    plain = word.decode()
    s = _RUNS.sub(lambda m: m[0][0], plain.strip(_EDGES))
    digits = s.count("9")
    return Word(s, "", ["bias", f"s={s}", f"g={_DIGITS.sub('9', s)}", f"q={_BETWEEN.sub('-', _DIGITS.sub('9', s))}", f"n={digits}|{len(_DIGITS.findall(s))}", f"d={digits}", f"k={bool(digits)}{'@' in s}{'[' in s or '(' in s or '{' in s}", f"end={plain[-1:] in _EDGES}"])


def named(word: bytes) -> str:
    i = NAME_OF.get(word.lower(), 0)
    return NAMED[i - 1] if i else ""


#: Features by the words around: the place of the word, and what is seen of it.
AROUND = [(-1, "shape"), (1, "shape"), (0, "name"), (-1, "name"), (1, "name"), (-2, "name"), (2, "name")]
PAIRS = (-1, 1)
#: Pairs of places that both hold telling words.
NAME_PAIRS = ((-1, 1), (1, 3), (0, 2), (-2, 0), (-3, -1), (3, 4), (2, 3), (1, 2), (0, 1))


def _features(words: list[str]) -> list[list[str]]:
    raw = [w.encode() for w in words]
    row = [seen(classes(w))._replace(name=named(w)) for w in raw]
    out = []
    for i, w in enumerate(row):
        at = lambda k: row[i + k] if 0 <= i + k < len(row) else Word("^" if k < 0 else "$", "", [])  # noqa: B023, E731
        out.append([*w.own, *[f"{k}{part}={getattr(at(k), part)}" for k, part in AROUND], *[f"{k}pair={w.shape}|{at(k).shape}" for k in PAIRS], *[f"{a}{b}names={at(a).name}|{at(b).name}" if at(a).name and at(b).name else "no names" for a, b in NAME_PAIRS]])
    return out


# ---- the field ------------------------------------------------------------------------------------------------
class Field(NamedTuple):
    index: dict[str, int]
    emit: np.ndarray  # by feature (the last row: unknown) and label
    step: np.ndarray  # from label to label
    begin: np.ndarray


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def _allowed() -> tuple[np.ndarray, np.ndarray]:
    """0 where a label may follow, a large loss where not: an inner label continues its own kind only."""
    ok = np.array([[not b.startswith("I-") or a[2:] == b[2:] for b in LABELS] for a in LABELS])
    return np.where(ok, 0.0, -1e4), np.where([x.startswith("I-") for x in LABELS], -1e4, 0.0)


def train(rows: list[tuple[list[str], list[str]]], rounds: int = 100, rate: float = 0.15, ridge: float = 0.02) -> Field:
    """Maximum likelihood with a ridge, by gradient steps with running second moments, over sentences side by side, longest
    first, so that those with a word at a place are always the first rows."""
    rows = sorted(rows, key=lambda r: -len(r[0]))
    names = sorted({f for words, _ in rows for fs in _features(words) for f in fs})
    index = {f: i for i, f in enumerate(names)}
    n, size, k = len(rows), max(len(w) for w, _ in rows), len(LABELS)
    width = len(_features(["x"])[0])
    feats, gold, mask = np.full((n, size, width), len(names)), np.zeros((n, size), int), np.zeros((n, size), bool)
    for i, (words, labels) in enumerate(rows):
        feats[i, : len(words)] = [[index[f] for f in fs] for fs in _features(words)]
        gold[i, : len(words)], mask[i, : len(words)] = [LABELS.index(x) for x in labels], True
    live = mask.sum(0)
    ban, ban0 = _allowed()
    emit, step, begin = np.zeros((len(names) + 1, k)), np.zeros((k, k)), np.zeros(k)
    moments = [np.zeros_like(x) for x in (emit, step, begin)]
    flat, score = feats[mask], np.zeros((n, size, k))
    # sums by feature: all places of all words in the order of their features, once
    order = np.argsort(flat.ravel(), kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(flat.ravel()[order]) != 0])
    met, of = flat.ravel()[order[starts]], order // width
    for turn in range(rounds):
        score[mask] = emit[flat].sum(1)
        a, b, steps = np.zeros((size, n, k)), np.zeros((size, n, k)), step + ban
        a[0] = begin + ban0 + score[:, 0]
        for t in range(1, size):
            a[t, : live[t]] = _lse(a[t - 1, : live[t], :, None] + steps, 1) + score[: live[t], t]
        for t in range(size - 2, -1, -1):
            b[t, : live[t + 1]] = _lse(steps + (score[: live[t + 1], t + 1] + b[t + 1, : live[t + 1]])[:, None, :], 2)
        z = _lse(a[mask.sum(1) - 1, np.arange(n)], 1)
        p = np.exp(a + b - z[:, None])
        d_emit, d_step, d_begin = np.zeros_like(emit), np.zeros_like(step), -p[0].sum(0)
        miss = np.eye(k)[gold[mask]] - np.moveaxis(p, 0, 1)[mask]
        d_emit[met] = np.add.reduceat(miss[of], starts)
        np.add.at(d_begin, gold[:, 0], 1.0)
        for t in range(1, size):
            m = live[t]
            pair = a[t - 1, :m, :, None] + steps + (score[:m, t] + b[t, :m])[:, None, :] - z[:m, None, None]
            d_step -= np.exp(pair).sum(0)
            np.add.at(d_step, (gold[:m, t - 1], gold[:m, t]), 1.0)
        for value, grad, moment in zip((emit, step, begin), (d_emit, d_step, d_begin), moments, strict=True):
            grad -= ridge * value
            moment *= 0.9
            moment += 0.1 * grad * grad
            value += rate * grad / (np.sqrt(moment) + 1e-6) * min(1.0, 3.0 / (1 + turn / 20))
    emit[-1] = 0.0
    return Field(index, emit, step + ban, begin + ban0)


class Tables:
    """The weights of a field as arrays: by word (those met so far), by shape, by telling word, by pair of shapes."""

    def __init__(self, field: Field, most: int = 200_000) -> None:
        self.field, self.most = field, most
        weight = lambda f: field.emit[field.index[f]] if f in field.index else np.zeros(len(LABELS))
        self.weight = weight
        shapes = sorted({f.split("=", 1)[1] for f in field.index if f[:2] == "s=" or f.startswith(("-1shape=", "1shape="))})
        self.shapes = {x: i + 1 for i, x in enumerate(shapes)}  # 0: any other
        by = {"shape": ["\0", *shapes], "name": ["", *NAMED]}
        self.around = [(k, part, np.array([weight(f"{k}{part}={x}") for x in by[part]], np.float32)) for k, part in AROUND]
        n = len(shapes) + 1
        self.pairs = {k: np.zeros((n, n, len(LABELS)), np.float32) for k in PAIRS}
        for f, i in field.index.items():
            for k in PAIRS:
                if f.startswith(f"{k}pair="):
                    a, b = f.split("=", 1)[1].split("|", 1) if f.count("|") == 1 else (None, None)
                    if a in self.shapes and b in self.shapes:
                        self.pairs[k][self.shapes[a], self.shapes[b]] = field.emit[i]
        none = weight("no names")
        self.name_pairs = {(a, b): np.array([[weight(f"{a}{b}names={x}|{y}") - none if x and y else 0 * none for y in by["name"]] for x in by["name"]], np.float32) for a, b in NAME_PAIRS}
        self.no_names = (len(NAME_PAIRS) * none).astype(np.float32)
        self.start, self.stop = self.shapes.get("^", 0), self.shapes.get("$", 0)
        stay = field.step[0, 0]
        first, inner = [LABELS.index(f"B-{k}") for k in KINDS], [LABELS.index(f"I-{k}") for k in KINDS]
        # at most: what a first word's steps gain on none, the way out of the span included, and an inner word's step
        leave = max(0.0, float(field.step[1:, 0].max() - stay))
        self.first, self.first_gain = first, np.array([max(field.step[:, b].max() - stay, field.begin[b] - field.begin[0]) + leave for b in first], np.float32)
        self.inner, self.inner_gain = inner, np.array([max(field.step[b, i], field.step[i, i]) - stay for b, i in zip(first, inner, strict=True)], np.float32)
        self.forget()

    def forget(self) -> None:
        self.types: dict[bytes, int] = {}
        self.shape_of, self.own = np.zeros(0, np.int32), np.zeros((0, len(LABELS)), np.float32)

    def scores(self, words: list[bytes], kinds: list[bytes], sizes: np.ndarray) -> np.ndarray:
        """Scores by word and label. words: in lower case; kinds: their classes; sizes: words of each line."""
        if len(self.types) > self.most:
            self.forget()
        types = self.types
        new = [w for w in set(kinds) if w not in types]
        if new:
            found = [seen(w) for w in new]
            types.update(zip(new, range(len(types), len(types) + len(new)), strict=True))
            self.shape_of = np.append(self.shape_of, np.array([self.shapes.get(x.shape, 0) for x in found], np.int32))
            self.own = np.concatenate([self.own, np.array([sum(self.weight(f) for f in x.own) for x in found], np.float32)])
        at = np.fromiter(map(types.__getitem__, kinds), np.int64, len(kinds))
        name = np.fromiter((NAME_OF.get(w, 0) for w in words), np.int64, len(words))
        ends = np.cumsum(sizes)
        before = np.arange(len(words)) - np.repeat(ends - sizes, sizes)
        after = np.repeat(sizes, sizes) - 1 - before
        out = self.own[at]
        seen_of = {"shape": self.shape_of[at], "name": name}
        outside = {"shape": {-1: self.start, 1: self.stop}, "name": {-1: 0, 1: 0}}

        def moved(part: str, k: int) -> np.ndarray:
            inside = (before >= -k) if k < 0 else (after >= k)
            return np.where(inside, np.roll(seen_of[part], -k), outside[part][1 if k > 0 else -1])

        for k, part, table in self.around:
            if part == "shape":
                out += table[moved(part, k)]
            else:
                telling = np.flatnonzero(seen_of[part])  # few; a plain word around weighs table[0]
                out += table[0]
                place = telling - k
                inside = (place >= 0) & (place < len(at))
                place, telling = place[inside], telling[inside]
                same = (after[place] >= k) if k > 0 else (before[place] >= -k)
                out[place[same]] += table[seen_of[part][telling[same]]] - table[0]
        for k in PAIRS:
            out += self.pairs[k][seen_of["shape"], moved("shape", k)]
        out += self.no_names
        telling = np.flatnonzero(name)
        for (a, b), table in self.name_pairs.items():
            place = telling - a
            place = place[(place >= 0) & (place < len(at))]
            for k in (a, b):
                place = place[(after[place] >= k) & (before[place] >= -k)]
            out[place] += table[name[place + a], name[place + b]]
        return out

    def open_lines(self, scores: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Lines that may hold a label. If any path is better than no labels, one of its spans gains: its first word by
        at most its score above none and its steps, its inner words likewise. So there is no such path where the best
        first word and all inner words above 0 don't sum to more than 0."""
        begins = np.cumsum(sizes) - sizes
        first = (scores[:, self.first] + self.first_gain).max(1) - scores[:, 0]
        inner = (scores[:, self.inner] + self.inner_gain).max(1) - scores[:, 0]
        return np.maximum.reduceat(first, begins) + np.add.reduceat(np.maximum(inner, 0), begins) > 0


def viterbi(field: Field, scores: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The best label of each word of lines of the given sizes. Lines run side by side, longest first, so that those
    still running are always the first rows."""
    order = np.argsort(-sizes, kind="stable")
    starts, long = (np.cumsum(sizes) - sizes)[order], sizes[order]
    live = np.searchsorted(-long, -np.arange(long[0] if len(long) else 0), "left")  # lines longer than t
    out = np.zeros(len(scores), np.int8)
    if not len(long):
        return out
    step, best, back = field.step.astype(np.float32).T[None], field.begin.astype(np.float32) + scores[starts], []
    for t in range(1, int(long[0])):
        ways = best[: live[t], None, :] + step  # by label, then by the one before
        back.append(ways.argmax(2).astype(np.int8))
        best[: live[t]] = ways.max(2) + scores[starts[: live[t]] + t]
    now = best.argmax(1)
    for t in range(int(long[0]) - 1, -1, -1):
        out[starts[: live[t]] + t] = now[: live[t]]
        if t:
            now[: live[t]] = back[t - 1][np.arange(live[t]), now[: live[t]]]
    return out


_EDGE = re.compile(r"^[^0-9A-Za-z+(\[]+|[^0-9A-Za-z)\]]+$")


#: Spelled marks become plain ones; what is left has one way to match.
_AT = re.compile(r"\s*[\[({]?\s*(?:@|\bat\b)\s*[\])}]?\s*", re.I)
_DOT = re.compile(r"\s*[\[({]?\s*(?:\.|\bdot\b)\s*[\])}]?\s*", re.I)
_ADDRESS = re.compile(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)+")
_IP_FORM = re.compile(r"[0-9]{1,3}(?:[\[({]?\.[\])}]?[0-9]{1,3}){3}")


def _fits(kind: str, found: str) -> bool:
    digits = re.sub(r"[^0-9]", "", found)
    if kind == "phone":
        return 9 <= len(digits) <= 15 and "." * 3 not in found
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "ip":
        return bool(_IP_FORM.fullmatch(found)) and all(int(x) <= 255 for x in re.findall(r"[0-9]+", found))
    return len(found) <= 320 and bool(_ADDRESS.fullmatch(_DOT.sub(".", _AT.sub("@", found))))


def _plain(word: str) -> bool:
    """A word with letters and no digit."""
    return not _DIGIT.search(word) and any(x.isalpha() for x in word)


def added_spans(tables: Tables, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
    """What the field finds beyond the patterns; a span that touches one of theirs, or lacks its kind's form, goes."""
    words: list[bytes] = []
    kinds: list[bytes] = []
    sizes, owner, number = [], [], []
    for i, text in enumerate(texts):
        raw = text.encode()
        kinds += classes(raw).split()
        for k, line in enumerate(raw.lower().split(b"\n")):
            if own := line.split():
                words += own
                sizes.append(len(own))
                owner.append(i)
                number.append(k)
    out: list[list[Span]] = [[] for _ in texts]
    if not words:
        return out
    n = np.array(sizes, np.int64)
    scores = tables.scores(words, kinds, n)
    lines = np.flatnonzero(tables.open_lines(scores, n))
    labels = viterbi(tables.field, scores[np.repeat(np.isin(np.arange(len(n)), lines), n)], n[lines])
    ends = np.cumsum(n[lines])
    for j in np.flatnonzero(np.add.reduceat((labels > 0).astype(np.int64), ends - n[lines])) if len(lines) else []:
        i, found = owner[lines[j]], labels[ends[j] - n[lines[j]] : ends[j]].tolist()
        split = texts[i].split("\n")
        offset = sum(map(len, split[: number[lines[j]]])) + number[lines[j]]
        chain = [(m.start() + offset, m.end() + offset) for m in _WORDS.finditer(split[number[lines[j]]])]
        k = 0
        while k < len(chain):
            name = LABELS[found[k]]
            end = k + 1
            if name != "O":
                while end < len(chain) and LABELS[found[end]] == f"I-{name[2:]}":
                    end += 1
                first, last = k, end
                if name[2:] != "email":  # numbers are cut to their digits
                    while first < last and _plain(texts[i][slice(*chain[first])]):
                        first += 1
                    while first < last and _plain(texts[i][slice(*chain[last - 1])]):
                        last -= 1
                start, stop = (chain[first][0], chain[last - 1][1]) if first < last else (chain[k][0], chain[k][0])
                inner = texts[i][start:stop]
                lead = _EDGE.match(inner)
                shift = lead.end() if lead and lead.start() == 0 else 0
                core = _EDGE.sub("", inner)
                span = Span(name[2:], start + shift, start + shift + len(core))
                if core and _fits(span.kind, core) and not any(span.start < s.end and s.start < span.end for s in base[i]):
                    out[i].append(span)
            k = end
    return out


_TABLES: dict[int, Tables] = {}
memory_of("pii", _TABLES.clear)


def _tables(field: Field) -> Tables:
    if id(field) not in _TABLES:
        _TABLES.clear()
        _TABLES[id(field)] = Tables(field)
    return _TABLES[id(field)]


# ---- Spark ----------------------------------------------------------------------------------------------------
def labelled_table(spark: SparkSession) -> DataFrame:
    """The labelled sentences that come with the package: words with their labels."""
    return spark.createDataFrame(parse_labelled(LABELLED), "words array<string>, labels array<string>")


def parse_labelled(lines: list[str]) -> list[tuple[list[str], list[str]]]:
    """Sentences with spans marked <kind:...>."""
    out = []
    for line in lines:
        words, labels = [], []
        for kind, inner, other in re.findall(r"<(\w+):([^>]*)>|([^<]+)", line):
            new = (inner or other).split()
            if kind and other == "" and words and not line[: line.find(f"<{kind}:{inner}>")].endswith(" "):
                raise ValueError(f"a span must be of whole words: {line}")
            words += new
            labels += [f"{'I' if i else 'B'}-{kind}" if kind else "O" for i in range(len(new))]
        out.append((words, labels))
    return out


def find_pii(docs: DataFrame, field: Field, text_col: str = "text", spans_col: str = "pii") -> DataFrame:
    """Add the spans of every whole text by start and kind: code points, end exclusive, base true for the patterns'.

    Null and empty texts have none. Rows stay where they are (nothing is shuffled), repeated ones get equal spans,
    other columns stay and one named spans_col is replaced. Time is linear in a text's length: no pattern looks back
    over a run of characters again.
    """
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c != spans_col]
    # the text goes to the workers once, as the last column
    sent = [c for c in keep if c != text_col]
    stays = text_col in keep
    schema = T.StructType([docs.schema[c] for c in sent] + [docs.schema[text_col]] * stays).add(spans_col, SPANS)
    source = docs.select(*[docs[c] for c in sent], docs[text_col])
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("pii")
        tables = _tables(shared.value)
        for batch in (x for whole in batches for x in by_bytes(whole, 1 << 20)):
            texts = [x or "" for x in batch.column(batch.num_columns - 1).to_pylist()]
            base = [base_spans(x) for x in texts]
            added = added_spans(tables, texts, base)
            rows = [sorted([(*s, True) for s in b] + [(*s, False) for s in a], key=lambda s: (s[1], KINDS.index(s[0]), s[2])) for b, a in zip(base, added, strict=True)]
            found = pa.array([[{"kind": k, "start": s, "end": e, "base": o} for k, s, e, o in r] for r in rows], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(sent) + stays], found], names=schema.names)

    return source.mapInArrow(run, schema).select(*keep, spans_col)


@cache
def _trained(rows: tuple[tuple[tuple[str, ...], tuple[str, ...]], ...]) -> Field:
    return train([(list(w), list(x)) for w, x in rows])


def trained_field(spark: SparkSession, labelled: DataFrame | None = None, most: int = 2000) -> Field:
    """The field of a labelled table (words, labels) of `most` sentences at most."""
    table = labelled if labelled is not None else labelled_table(spark)
    rows = [(tuple(r.words), tuple(r.labels)) for r in table.select("words", "labels").limit(most).collect()]
    return _trained(tuple(sorted(rows)))


def masked(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """docs with every span replaced by <KIND>; overlapping spans are replaced as one, by the first one's kind. Null texts
    stay null, empty ones empty; repeated rows are masked alike; an empty table gives an empty one."""
    found = find_pii(docs, field, text_col, "_pii")
    merged = F.aggregate(
        "_pii",
        F.struct(F.lit(1).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(
            s["start"] + 1 >= acc["at"],
            F.struct((s["end"] + 1).alias("at"), F.concat(acc["out"], F.substring(F.col(text_col), acc["at"], s["start"] + 1 - acc["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">")).alias("out")),
        ).otherwise(F.struct(F.greatest(acc["at"], s["end"] + 1).alias("at"), acc["out"].alias("out"))),
    )
    text = F.when(F.size("_pii") == 0, F.col(text_col)).otherwise(F.concat(merged["out"], F.col(text_col).substr(merged["at"], F.length(text_col))))
    return found.withColumn(text_col, text).select(*docs.columns)
