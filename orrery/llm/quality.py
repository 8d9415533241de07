"""Quality rules: counts of words, symbols and repetitions, and perplexity under n-gram models.

Each language has a modified Kneser-Ney model of byte n-grams at every position of its texts, white space included.
Spark counts them and derives discounts, totals and probabilities from all counts: nothing is pruned. Workers hold the
scores of the most frequent n-grams; those of all others are joined from the whole table. A language's documents spread
around a middle log perplexity; documents outside its band, above (noise, foreign text) or below (endless repetition of
common words), are rejected.

With labels, models are counted on all labelled good texts and on no others, so that junk can't predict junk. A language
has two, each of the texts of one fold by a hash of the text, and every text is judged by the model of the other fold,
which doesn't hold it. Bands lie around the perplexities of all good texts. N-grams that a model lacks back off, those
that workers don't hold by joins with the tables of each length.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm import ngrams
from orrery.llm.common import WORD, discard, enter, materialize, small_batches
from orrery.llm.ngrams import HELD, UNIT
from orrery.llm.segment_ids import by_bytes

ORDER = 5
#: Half-width of a band in half-widths of the shortest half of log10 perplexities, below and above its centre.
BELOW, ABOVE = 10.0, 10.0
#: With labels: a language of fewer good texts has no band. Such a band reaches so many times as far from the median as the
#: outer twentieth of good texts begins, and to half and twice the median perplexity at least.
LEAST = 8
BELOW_GOOD, ABOVE_GOOD, NARROW = 6.0, 6.0, float(np.log10(2))
SYMBOLS = "#*$%&|<>"
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_ppl double"


class Model(NamedTuple):
    """Per length: sorted keys of n-grams with log10 of their probability, sorted contexts with log10 of the mass
    that they leave to the shorter context."""

    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]


def ngram_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", order: int = ORDER) -> DataFrame:
    """(lang, gram, n) over all whole texts: the n-gram of `order` bytes that ends at each event. Summed within a
    task, so that what is shuffled is distinct n-grams a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str | None, ngrams.Counts] = {}
        enter("quality")
        for batch in (x for whole in batches for x in by_bytes(whole, 1 << 22)):
            held: dict[str | None, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(lang, []).append((text or "").encode().lower())
            for lang, texts in held.items():
                counts.setdefault(lang, ngrams.Counts()).add(texts, order)
        for lang, own in counts.items():
            key, n = own.whole()
            for at in range(0, len(key), 1 << 16):
                part = key[at : at + (1 << 16)]
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(part), pa.string()), "gram": part.view(np.int64), "n": n[at : at + (1 << 16)]})

    counted = docs.select(docs[lang_col].cast("string").alias("lang"), docs[text_col].alias("text")).mapInArrow(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def stored_counts(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n): modified Kneser-Ney counts of n-grams of every length.

    The longest n-grams count occurrences; shorter ones count the different bytes before them.
    """
    out = levels = counts.select("lang", "gram", "n")
    for k in range(order - 1, 0, -1):
        body = F.col("gram").bitwiseAND(F.lit((1 << (8 * k)) - 1)).bitwiseOR(F.lit(k << 56))
        levels = levels.groupBy("lang", body.alias("gram")).agg(F.count("*").alias("n"))
        out = out.unionByName(levels)
    return out


def _key(gram: str, length: int, drop: int) -> F.Column:
    """The context (drop = 8 bits) of an n-gram of `length` bytes, or its suffix (drop = 0)."""
    body = F.shiftright(F.col(gram).bitwiseAND(F.lit((1 << 56) - 1)), drop)
    return body.bitwiseAND(F.lit((1 << (8 * (length - 1))) - 1)).bitwiseOR(F.lit((length - 1) << 56))


def shares(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, len, gram, n, share, left) of all n-grams: the discounted share of their context, and the share that the
    context leaves to the shorter one. Discounts of counts 1, 2 and 3 or more are those of a language and length, from
    how many of all counts are 1, 2, 3 and 4 (0.5, 1, 1.5 where one is missing)."""
    length = F.shiftrightunsigned("gram", 56).cast("int")
    rows = counts.withColumn("len", length)
    f = rows.groupBy(F.col("lang").alias("of"), F.col("len").alias("of_len")).agg(*[F.sum((F.col("n") == i).cast("long")).alias(f"f{i}") for i in (1, 2, 3, 4)])
    known = F.least("f1", "f2", "f3", "f4") > 0
    y = F.col("f1") / (F.col("f1") + 2 * F.col("f2"))
    for i, fixed in ((1, 0.5), (2, 1.0), (3, 1.5)):
        estimate = F.lit(float(i)) - (i + 1) * y * F.col(f"f{i + 1}") / F.col(f"f{i}")
        f = f.withColumn(f"d{i}", F.when(known, F.least(F.greatest(estimate, F.lit(0.05)), F.lit(i - 0.05))).otherwise(F.lit(fixed)))
    context = F.lit(None).cast("long")
    for k in range(1, order + 1):
        context = F.when(F.col("len") == k, _key("gram", k, 8)).otherwise(context)
    # a context has 256 rows at most
    own = Window.partitionBy("lang", "context")
    kinds = [F.sum((F.col("n") == i).cast("long")).over(own) for i in (1, 2)]
    rows = rows.withColumn("context", context).withColumns({"total": F.sum("n").over(own), "n1": kinds[0], "n2": kinds[1], "n3": F.count("*").over(own)})
    rows = rows.join(f, F.col("lang").eqNullSafe(F.col("of")) & (F.col("len") == F.col("of_len")))
    d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    kept = F.col("d1") * F.col("n1") + F.col("d2") * F.col("n2") + F.col("d3") * (F.col("n3") - F.col("n1") - F.col("n2"))
    return rows.select("lang", "len", "gram", "n", ((F.col("n") - d) / F.col("total")).alias("share"), (kept / F.col("total")).alias("left"))


def probabilities(of: DataFrame, order: int = ORDER, stored: bool = False) -> list[DataFrame]:
    """By length, (lang, gram, n, p, left): probabilities from a table of shares, each in files if stored. A suffix of an
    n-gram is one too."""
    level = lambda x: materialize(x.select("lang", "gram", "n", "p", "left"), "level") if stored else x.select("lang", "gram", "n", "p", "left")
    out = [level(of.filter("len = 1").withColumn("p", F.col("share") + F.col("left") / 256))]
    for k in range(2, order + 1):
        lower = out[-1].select(F.col("lang").alias("of"), F.col("gram").alias("suffix"), F.col("p").alias("below"))
        own = of.filter(F.col("len") == k)
        joined = own.join(lower, own["lang"].eqNullSafe(lower["of"]) & (_key("gram", k, 0) == lower["suffix"]))
        out.append(level(joined.withColumn("p", F.col("share") + F.col("left") * F.col("below"))))
    return out


def _shares(docs: DataFrame, text_col: str, lang_col: str, order: int) -> DataFrame:
    counted = materialize(ngram_counts(docs, text_col, lang_col, order), "counted")  # each length below reads it
    out = materialize(shares(stored_counts(counted, order), order), "ngrams")
    discard(counted)
    return out


def event_scores(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", order: int = ORDER) -> DataFrame:
    """(lang, gram, n, score) of every n-gram at any event of docs: log10 of its probability in whole UNITs."""
    of = _shares(docs, text_col, lang_col, order)
    out = materialize(_scored(probabilities(of, order)[-1]), "scores")
    discard(of)
    return out


def _scored(last: DataFrame) -> DataFrame:
    return last.select("lang", "gram", "n", F.round(F.log10("p") * UNIT).cast("long").alias("score"))


def model_levels(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", order: int = ORDER) -> list[DataFrame]:
    """By length, the tables (lang, gram, n, p, left) of the whole model of each language, for texts that it never saw."""
    of = _shares(docs, text_col, lang_col, order)
    out = probabilities(of, order, stored=True)
    discard(of)
    return out


def backed_off(asked: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(lang, gram, n, score) of the n-grams of the whole order in asked (lang, gram, n), each once: an n-gram that a model
    lacks costs what its context leaves, and is asked for without its first byte. Only those go on to the next length."""
    steps: list[DataFrame] = []
    live = asked.select("lang", "gram", "n", F.col("gram").alias("at"), F.lit(0.0).alias("cost"))
    found = []
    for k in range(len(levels), 0, -1):
        own = levels[k - 1].select(F.col("lang").alias("of"), F.col("gram").alias("known"), "p", "left")
        contexts = own.groupBy(F.col("of").alias("in"), _key("known", k, 8).alias("context")).agg(F.min("left").alias("left"))
        joined = live.join(own.drop("left"), F.col("lang").eqNullSafe(F.col("of")) & (F.col("at") == F.col("known")), "left")
        joined = joined.join(contexts, F.col("lang").eqNullSafe(F.col("in")) & (_key("at", k, 8) == F.col("context")), "left")
        steps.append(materialize(joined.select("lang", "gram", "n", "at", "cost", "p", "left"), "asked"))
        found.append(steps[-1].filter("p is not null").withColumn("cost", F.col("cost") + F.log10("p")))
        rest = steps[-1].filter("p is null")
        live = rest.select("lang", "gram", "n", _key("at", k, 0).alias("at"), (F.col("cost") + F.coalesce(F.log10("left"), F.lit(0.0))).alias("cost"))
    found.append(live.withColumn("cost", F.col("cost") - F.log10(F.lit(256.0))))
    score = F.round(F.col("cost") * UNIT).cast("long").alias("score")
    out = materialize(reduce(DataFrame.unionByName, [x.select("lang", "gram", "n", score) for x in found]), "scores")
    discard(*steps)
    return out


def fit_models(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", order: int = ORDER, least_share: float = 0.0) -> dict[str | None, Model]:
    """The whole model of each language (null is one) on the driver, for small tables and for looking at one; judge()
    doesn't need it. With least_share, n-grams of a smaller share of the counts of their length aren't shown; the
    numbers of the others stay those of the whole model."""
    out: dict[str | None, Model] = {}
    levels = probabilities(_shares(docs, text_col, lang_col, order), order)
    whole = reduce(DataFrame.unionByName, [x.withColumn("k", F.lit(k)) for k, x in enumerate(levels, 1)]).toArrow()
    for k in range(1, order + 1):
        table = whole.filter(pc.equal(whole["k"], k))
        key, n = table["gram"].to_numpy().view(np.uint64), table["n"].to_numpy()
        p, left = np.log10(table["p"].to_numpy()), np.log10(table["left"].to_numpy())
        shown = n >= least_share * n.sum()
        langs = np.array(table["lang"].to_pylist(), object)
        for lang in dict.fromkeys(langs):
            own = np.flatnonzero(np.equal(langs, lang) & shown)
            own = own[np.argsort(key[own])]
            names, first = np.unique(ngrams.context_of(key[own]), return_index=True)
            model = out.setdefault(lang, Model([], []))
            model.grams.append((key[own], p[own]))
            model.contexts.append((names, left[own][first]))
    return out


class Backoff:
    """A whole model in sorted hash arrays: an n-gram that training lacks costs what its context leaves, and is asked for
    without its first byte."""

    def __init__(self, model: Model) -> None:
        held = lambda keys, values: ngrams.Held(keys, np.rint(values * UNIT).astype(np.int64))
        self.grams = [held(*x) for x in model.grams]
        self.contexts = [held(*x) for x in model.contexts]

    def scores(self, key: np.ndarray) -> np.ndarray:
        """log10 probabilities of n-grams of the whole order, in UNITs."""
        total, live = np.zeros(len(key), np.int64), np.arange(len(key))
        for k in range(len(self.grams), 0, -1):
            own = (key[live] & np.uint64((1 << (8 * k)) - 1)) | np.uint64(k << 56)
            score, there = self.grams[k - 1].find(own)
            total[live] += score
            live, own = live[~there], own[~there]
            if not len(live):
                break
            total[live] += self.contexts[k - 1].find(ngrams.context_of(own))[0]
        total[live] -= int(np.rint(np.log10(256) * UNIT))
        return total

    def text_scores(self, texts: list[bytes], order: int) -> tuple[list[int], list[np.ndarray]]:
        """As of held scores, with nothing left to join."""
        totals: list[int] = []
        for a, b in ngrams.pieces(texts):
            key, begins = ngrams.events(texts[a:b], order)
            totals += np.add.reduceat(self.scores(key), begins).tolist()
        return totals, [np.zeros(0, np.int64)] * len(texts)


def good_ids(labels: DataFrame, most: int | None = None) -> DataFrame:
    """(_good): ids that labels (doc_id, quality) call good; all of them, or about `most` different ones by a hash."""
    good = labels.filter("quality = 1").select(F.col("doc_id").alias("_good"))
    if most is None:
        return good
    good = good.distinct()
    place = F.shiftrightunsigned(F.xxhash64("_good", F.lit("sample")), 34)
    return good.filter(place < int(min(1.0, most / max(good.count(), 1)) * (1 << 30)))


def _model(text: str, lang: str, other: int) -> Column:
    """The model that a text helps to count (other = 0), or that of the other fold, which judges it (other = 1)."""
    fold = F.pmod(F.xxhash64(text) + other, F.lit(2)).cast("string")
    return F.concat(fold, F.coalesce(F.concat(F.lit(":"), F.col(lang)), F.lit("")))


def good_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str, most: int | None = None) -> DataFrame:
    """(_text, _lang, _model): texts of 50 words and more that labels call good, each once, and the model that counts it;
    all of them, or of about `most` ids. Where Spark joins by a shuffle, a Bloom filter of the ids keeps most other texts
    out of it, at any size of docs."""
    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"), docs[lang_col].cast("string").alias("_lang"))
    rows = rows.join(good_ids(labels, most), F.col("_id") == F.col("_good"), "left_semi").filter(F.regexp_count("_text", F.lit(WORD)) >= 50)
    conf, least = docs.sparkSession.conf, "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    before = conf.get(least)
    conf.set(least, "0")
    try:
        return materialize(rows.select("_text", "_lang").distinct().withColumn("_model", _model("_text", "_lang", 0)), "good")
    finally:
        conf.set(least, before)


def _repeated_words(words: list[str]) -> int:
    """Words in windows of three words that the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    n = Counter(windows)
    covered, total = -1, 0
    for i, w in enumerate(windows):
        if n[w] > 1:
            total += i + 2 - max(i - 1, covered)
            covered = i + 2
    return total


def _duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def measure(docs: DataFrame, table: DataFrame | None, text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None, order: int = ORDER, most: int = HELD, levels: list[DataFrame] | None = None) -> DataFrame:
    """keep, lang, digest of the words, and MEASURES of every whole text (null: no words). table: event_scores of docs;
    with levels, the model_levels of other texts, their scores. log_ppl is log10 of the perplexity by event under the
    text's language, null without words or a model. The result is in files."""
    keep = keep or []
    small_batches(docs.sparkSession)
    held, other = ngrams.held_scores(table, most), ngrams.NONE
    if levels is not None:  # a language without a model has no scores
        held, other = {r.lang: held.get(r.lang, ngrams.NONE) for r in levels[0].select("lang").distinct().collect()}, None
    shared = docs.sparkSession.sparkContext.broadcast(held)
    source = docs.select(*[docs[c] for c in keep], docs[lang_col].cast("string").alias("_lang"), docs[text_col].alias("_text"))
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    counts = [x.split()[0] for x in MEASURES.split(", ")][:-1]
    names = [*keep, "_lang", *counts, "_id", "_digest", "_events", "_score", "_rest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("quality")
        context = TaskContext.get()
        n_rows = (context.partitionId() if context else 0) << 33
        for batch in (x for whole in batches for x in by_bytes(whole, 1 << 21)):
            langs = batch.column(batch.num_columns - 2).to_pylist()
            texts = [x or "" for x in batch.column(batch.num_columns - 1).to_pylist()]
            rows = [x.encode().split() for x in texts]
            low = [x.encode().lower() for x in texts]
            score: list[int | None] = [None] * len(texts)
            rest = [np.zeros(0, np.int64)] * len(texts)
            for lang in dict.fromkeys(langs):
                own = [i for i, x in enumerate(langs) if x == lang and rows[i]]
                if own and (model := shared.value.get(lang, other)):
                    for i, s, r in zip(own, *model.text_scores([low[i] for i in own], order), strict=True):
                        score[i], rest[i] = s, r
            offsets = np.zeros(len(rest) + 1, np.int32)
            np.cumsum([len(r) for r in rest], out=offsets[1:])
            found = {
                "n_words": [len(w) for w in rows],
                "word_chars": [len(x) - sum(map(x.count, " \t\n\x0b\x0c\r")) for x in texts],
                "n_symbols": [sum(map(x.count, SYMBOLS)) for x in texts],
                "n_dup_lines": [_duplicate_lines(x) for x in texts],
                "n_repeat_words": [_repeated_words(w) for w in rows],
                "_id": range(n_rows, n_rows + len(texts)),
            }
            n_rows += len(texts)
            digests = [hashlib.md5(b" ".join(x.split()), usedforsecurity=False).digest() for x in low]
            columns = [*batch.columns[:-1], *[pa.array(v, pa.int64()) for v in found.values()], pa.array(digests, pa.binary()), pa.array([len(x) + 1 for x in low], pa.int64())]
            columns += [pa.array(score, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rest)))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    extra = "_id long, _digest binary, _events long, _score long, _rest array<long>"
    schema = ", ".join(x for x in (fields, "_lang string", *[f"{c} long" for c in counts], extra) if x)
    rows = materialize(source.mapInArrow(run, schema), "quality")
    made: list[DataFrame] = []
    left, settled = rows, None
    if levels is not None:
        made.append(materialize(rows.select(F.col("_lang").alias("lang"), F.explode("_rest").alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("n")), "asked"))
        made.append(table := backed_off(made[0], levels))
        made.append(left := _settled(rows, table, most))  # what many texts ask for isn't joined
        settled = left.select("_id", F.col("_sum").alias("score"))
    asked = left.select("_id", F.col("_lang").alias("of"), F.explode("_rest").alias("key"))
    more = asked.join(table, asked["of"].eqNullSafe(table["lang"]) & (asked["key"] == table["gram"])).select("_id", "score")
    more = (more if settled is None else more.unionByName(settled)).groupBy(F.col("_id").alias("_at")).agg(F.sum("score").alias("_more"))
    out = rows.drop("_rest").join(more, F.col("_id") == F.col("_at"), "left")
    log_ppl = -(F.col("_score") + F.coalesce("_more", F.lit(0))) / (F.col("_events") * UNIT)
    out = materialize(out.select(*keep, "_lang", "_digest", *counts, log_ppl.alias("log_ppl")), "measured")
    discard(rows, *made)
    return out


def _settled(rows: DataFrame, table: DataFrame, most: int) -> DataFrame:
    """(_id, _lang, _sum, _rest) of rows with keys in _rest: the sum of those that workers hold of a table of scores, the
    most frequent ones, and the others."""
    shared = rows.sparkSession.sparkContext.broadcast(ngrams.held_scores(table, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("quality")
        for batch in batches:
            sums, rest = [], []
            for lang, keys in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                key = keys.values.to_numpy(zero_copy_only=False)
                score, there = shared.value.get(lang, ngrams.NONE).find(key.view(np.uint64))
                sums.append(int(score.sum()))
                rest.append(key[~there])
            offsets = np.zeros(len(rest) + 1, np.int32)
            np.cumsum([len(r) for r in rest], out=offsets[1:])
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *rest])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums, pa.int64()), lists], names=["_id", "_lang", "_sum", "_rest"])

    asking = rows.filter(F.size("_rest") > 0).select("_id", "_lang", "_rest")
    return materialize(asking.mapInArrow(run, "_id long, _lang string, _sum long, _rest array<long>"), "settled")


def bands(measured: DataFrame, below: float = BELOW, above: float = ABOVE) -> DataFrame:
    """(of, low, high): multiples of a scale below and above a middle of a language's log perplexities, over distinct
    texts of 50 words and more (copies count once). A row for each language.

    Middle and scale are the centre and half-width of the shortest interval that holds half of them: texts of another
    kind, on either side or in one place, can't reach them as long as they are fewer than half.
    """
    distinct = measured.filter("n_words >= 50 and log_ppl is not null").groupBy(F.col("_lang").alias("of"), "_digest").agg(F.min("log_ppl").alias("log_ppl"))
    q = distinct.groupBy("of").agg(F.percentile_approx("log_ppl", [i / 200 for i in range(201)], 10000).alias("q"))
    halves = F.transform(F.sequence(F.lit(0), F.lit(100)), lambda i: F.struct((F.get("q", i + 100) - F.get("q", i)).alias("width"), F.get("q", i).alias("from")))
    least = F.array_min(halves)
    spread = F.greatest(least["width"], F.lit(1e-3)) / 2
    middle = least["from"] + least["width"] / 2
    return q.select("of", (middle - spread * below).alias("low"), (middle + spread * above).alias("high"))


def good_bands(good: DataFrame, below: float = BELOW_GOOD, above: float = ABOVE_GOOD, least: int = LEAST) -> DataFrame:
    """(of, low, high): from log perplexities of good texts under models that don't hold them, copies once, by language;
    languages of fewer than `least` have none."""
    distinct = good.filter("n_words >= 50 and log_ppl is not null").groupBy(F.col("_lang").alias("of"), "_digest").agg(F.min("log_ppl").alias("log_ppl"))
    q = distinct.groupBy("of").agg(F.percentile_approx("log_ppl", [0.05, 0.5, 0.95], 10000).alias("q"), F.count("*").alias("n"))
    low, middle, high = (F.get("q", F.lit(i)) for i in range(3))
    reach = lambda side: F.greatest(side, F.lit(NARROW))
    return q.filter(F.col("n") >= least).select("of", (middle - reach(below * (middle - low))).alias("low"), (middle + reach(above * (high - middle))).alias("high"))


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None, below: float | None = None, above: float | None = None, labels: DataFrame | None = None, id_col: str = "doc_id", sample: int | None = None) -> DataFrame:
    """keep, MEASURES, base_failed and kept for every row of docs.

    base_failed: fewer than 50 words, or more than half of them in windows of three words that repeat. Others are
    kept if their log perplexity lies in their language's band (languages without one: kept). Null and empty texts
    have no words and fail. Repeated rows are judged alike; an empty table gives an empty one. Columns of keep that
    are named like an output are replaced.

    labels (doc_id, quality) of ids in id_col: models and bands are of all labelled good texts, or of `sample` ids where a
    caller wants no more; a text is judged by the model of the fold that it isn't in. Without labels, or where they name no
    good text, models and bands are of all texts.
    """
    keep = [c for c in keep or [] if c not in (*[x.split()[0] for x in MEASURES.split(", ")], "base_failed", "kept")]
    rows = docs.select(F.struct(F.lit(None).cast("int").alias("_none"), *[docs[c] for c in keep]).alias("_row"), docs[text_col].alias("_judged"), docs[lang_col].cast("string").alias("_of"), *([] if labels is None else [docs[id_col].alias("_key")]))
    good = None if labels is None else good_sample(docs, labels, id_col, text_col, lang_col, sample)
    if good is None or good.isEmpty():
        table = event_scores(docs, text_col, lang_col)
        measured = measure(rows, table, "_judged", "_of", ["_row"])
        discard(table)
        limits = materialize(bands(measured, BELOW if below is None else below, ABOVE if above is None else above), "bands")
    else:
        levels = model_levels(good, "_text", "_model")
        asking = rows.withColumn("_by", _model("_judged", "_of", 1))
        measured = measure(asking, _scored(levels[-1]), "_judged", "_by", ["_row", "_of", "_key"], levels=levels).drop("_lang").withColumnRenamed("_of", "_lang")
        discard(good, *levels)
        own = measured.select("_key", "_lang", "_digest", "n_words", "log_ppl").join(good_ids(labels, sample), F.col("_key") == F.col("_good"), "left_semi")
        limits = materialize(good_bands(own, BELOW_GOOD if below is None else below, ABOVE_GOOD if above is None else above), "bands")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    inside = F.coalesce(F.col("log_ppl").between(F.col("low"), F.col("high")), F.lit(True))
    out = measured.join(limits, F.col("_lang").eqNullSafe(F.col("of")), "left").withColumn("base_failed", failed).withColumn("kept", ~failed & inside)
    return out.select(*[F.col("_row")[c].alias(c) for c in keep], *[x.split()[0] for x in MEASURES.split(", ")], "base_failed", "kept")


def accepted(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", labels: DataFrame | None = None, id_col: str = "doc_id", sample: int | None = None) -> DataFrame:
    """The rows of docs that judge() keeps, with their columns; they pass through it once, so no join fetches them.
    Null and empty texts go, as they have fewer than 50 words; nulls in other columns stay (a null language is one)."""
    rows = docs.select(F.struct("*").alias("_row"), docs[text_col].alias("_judged"), docs[lang_col].alias("_of"), *([docs[id_col].alias("_named")] if labels is not None else []))
    return judge(rows, "_judged", "_of", ["_row"], labels=labels, id_col="_named", sample=sample).filter("kept").select("_row.*")
