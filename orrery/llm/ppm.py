"""Scores of texts by prediction by partial matching, and by counts of words.

The model is a trie of byte contexts over whole texts, white space included, from the training documents: a byte is
predicted in the longest context that training saw; where it never followed there, an escape (half a count for each
different byte seen: method D) leads to the next shorter context, where bytes already offered are excluded. Marks before
a text fill its first contexts and an end mark closes it.

The trie is tables in Spark: n-grams of every length with counts, contexts with totals. Nothing is cut from it. Workers
hold the scores of the most frequent events and the counts of the most frequent words; all others are joined.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm import ngrams
from orrery.llm.common import discard, enter, materialize, small_batches
from orrery.llm.ngrams import HELD, UNIT
from orrery.llm.segment_ids import by_bytes

#: Bytes of the longest context.
ORDER = 5
#: The end of a text as a token: a byte that no word has.
END = b"\n"


def held_out(doc_id: Column, parts: int = 5, part: int = 1) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def _lower(column: pa.Array) -> list[bytes]:
    return [(x or "").encode().lower() for x in column.to_pylist()]


def corpus_counts(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """(word, gram, n) over rows of (train boolean, text), one of word and gram null: how often training rows have each
    word, and each n-gram of order + 1 bytes at an event. What only other rows have has 0, so that the table holds all
    that will be looked up. Summed within a task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("ppm")
        grams = ngrams.Counts()
        for batch in (x for whole in batches for x in by_bytes(whole)):
            seen: Counter[bytes] = Counter()
            other: set[bytes] = set()
            train = np.array(batch.column(0).to_pylist(), bool)
            low = _lower(batch.column(1))
            for own, text in zip(train.tolist(), low, strict=True):
                if own:
                    seen.update(text.split())
                else:
                    other.update(text.split())
            seen[END] += int(train.sum())
            for word in other:
                if word not in seen:
                    seen[word] = 0
            grams.add([x for x, own in zip(low, train, strict=True) if own], order + 1)
            grams.add([x for x, own in zip(low, train, strict=True) if not own], order + 1, 0)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.nulls(len(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["word", "gram", "n"])
        key, n = grams.whole()
        for at in range(0, len(key), 1 << 16):
            part = key[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(part), pa.binary()), pa.array(part.view(np.int64)), pa.array(n[at : at + (1 << 16)])], names=["word", "gram", "n"])

    return rows.mapInArrow(run, "word binary, gram long, n long").groupBy("word", "gram").agg(F.sum("n").alias("n"))


def event_scores(events: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, n, score): log10 probability, in whole UNITs, of every event of a table (gram, n) of n-grams of order + 1
    bytes; n is 0 where training doesn't have it. Events of training are found in their longest context; the others
    ask all contexts."""
    level = events.filter("n > 0").select("gram", "n")
    levels = [level]
    for k in range(order, 0, -1):
        level = level.groupBy(ngrams.last(F.col("gram"), k).alias("gram")).agg(F.sum("n").alias("n"))
        levels.append(level)
    whole = levels[0]
    for level in levels[1:]:
        whole = whole.unionByName(level)
    whole = materialize(whole, "grams")
    length = F.shiftrightunsigned("gram", 56)
    suffix = F.lit(None).cast("long")
    for k in range(2, order + 2):
        suffix = F.when(length == k, ngrams.last(F.col("gram"), k - 1)).otherwise(suffix)
    lower = whole.select(F.col("gram").alias("suffix"), F.col("n").alias("lower"))
    own = whole.withColumn("suffix", suffix).join(lower, "suffix", "left")
    # kinds: different bytes seen; shared: the sum that they have in the context one shorter
    contexts = own.groupBy(ngrams.context(F.col("gram")).alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.coalesce(F.sum("lower"), F.lit(0)).alias("shared"))
    contexts = materialize(contexts, "contexts")

    asked = events.filter("n = 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(order + 1))))
    part = F.lit(None).cast("long")
    for k in range(1, order + 2):
        part = F.when(F.col("k") == k, ngrams.last(F.col("gram"), k)).otherwise(part)
    asked = asked.select("gram", "k", part.alias("part")).withColumn("context", ngrams.context(F.col("part")))
    known = asked.join(whole.select(F.col("gram").alias("part"), "n"), "part", "left").join(contexts, "context", "left")
    columns = [F.max(F.when(F.col("k") == k, F.col(c))).cast("double").alias(f"{c}{k}") for k in range(order + 1, 0, -1) for c in ("n", "total", "kinds", "shared")]

    def fallen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, taken, kinds = (np.zeros(batch.num_rows) for _ in range(3))
            live = np.ones(batch.num_rows, bool)
            for k in range(order + 1, 0, -1):
                n, total, different, shared = (batch.column(f"{c}{k}").to_numpy(zero_copy_only=False) for c in ("n", "total", "kinds", "shared"))
                there = live & ~np.isnan(total)
                found = there & ~np.isnan(n)
                lost = there & np.isnan(n) & (different - kinds > 0)
                score[found] += np.log10((n - 0.5)[found] / (total - taken)[found])
                score[lost] += np.log10(0.5 * (different - kinds)[lost] / (total - taken)[lost])
                taken[there], kinds[there] = shared[there], different[there]
                live &= ~found
            score[live] -= np.log10(np.maximum(256 - kinds[live], 1.0))  # a byte never seen: all others alike
            yield pa.RecordBatch.from_arrays([batch.column("gram"), pa.array(np.zeros(len(score), np.int64)), pa.array(np.rint(score * UNIT).astype(np.int64))], names=["gram", "n", "score"])

    others = known.groupBy("gram").agg(*columns).mapInArrow(fallen, "gram long, n long, score long")
    seen = events.filter("n > 0").withColumn("context", ngrams.context(F.col("gram"))).join(contexts, "context")
    seen = seen.select("gram", "n", F.round(F.log10((F.col("n") - 0.5) / F.col("total")) * UNIT).cast("long").alias("score"))
    out = materialize(seen.unionByName(others), "scores")
    discard(whole, contexts)
    return out


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, parts: int = 5, part: int = 1, most: int = HELD) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs.

    Training rows are those whose crc32(id as text) mod parts isn't part (null ids train). Tokens are a text's words,
    A-Z lower-cased, and one end; null and empty texts have the end alone. base_score is the sum over tokens of
    log10((c + 0.5) / (N + 0.5 (V + 1))); score is the trie's log10 probability of the text (A-Z lower-cased, white
    space included) and its end. An empty table gives an empty one; repeated rows are scored alike, and each trains.
    Very long texts are read whole, alone in a batch.

    Workers hold the `most` most frequent words and events; what a text has besides is joined from the whole tables, in
    which no key is frequent, so that scores are the same whatever `most` is.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("id"), held_out(docs[id_col], parts, part).alias("held_out"), docs[text_col].alias("text"))
    counts = materialize(corpus_counts(rows.select((~F.col("held_out")).alias("train"), "text"), order), "counts")
    words, grams = counts.filter("gram is null").select("word", "n"), counts.filter("gram is not null").select("gram", "n")
    stats = words.filter("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    table = event_scores(grams, order)
    spark = docs.sparkSession
    events = spark.sparkContext.broadcast(ngrams.held_scores(table.filter("n > 0").withColumn("lang", F.lit(None).cast("string")), most).get(None, ngrams.NONE))
    top = ngrams.most_frequent(words.filter("n > 0"), most)
    frequent = top.toArrow() if top is not None else pa.table({"word": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})
    held = spark.sparkContext.broadcast((frequent["word"].to_pylist(), frequent["n"].to_numpy()))
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["row", "id", "held_out", "n_tokens", "n_known", "log_words", "log_bytes", "rest_words", "rest_events"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("ppm")
        place = {w: i for i, w in enumerate(held.value[0])}
        logs = np.log10(np.append(held.value[1], 0) + 0.5)
        n_rows = TaskContext.get().partitionId() << 33
        for batch in (x for whole in batches for x in by_bytes(whole, 1 << 21)):
            low = _lower(batch.column(2))
            split = [[*x.split(), END] for x in low]
            at = np.fromiter((place.get(w, -1) for x in split for w in x), np.int64, sum(map(len, split)))
            sizes = np.fromiter(map(len, split), np.int64, len(split))
            begins = np.cumsum(sizes) - sizes
            found = at >= 0
            missed = np.flatnonzero(~found)
            flat = [w for x in split for w in x]
            rest = pa.array([flat[i] for i in missed.tolist()], pa.binary())
            cut = pa.array(np.append(np.searchsorted(missed, begins), len(missed)).astype(np.int32))
            totals, other = events.value.text_scores(low, order + 1)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in other])]).astype(np.int32)
            columns = [
                pa.array(np.arange(n_rows, n_rows + len(low))),
                batch.column(0),
                batch.column(1),
                pa.array(sizes),
                pa.array(np.add.reduceat(found.astype(np.int64), begins)),
                pa.array(np.add.reduceat(np.where(found, logs[at], 0.0), begins)),
                pa.array(totals, pa.int64()),
                pa.ListArray.from_arrays(cut, rest),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(other))),
            ]
            n_rows += len(low)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"row long, id {id_type}, held_out boolean, n_tokens long, n_known long, log_words double, log_bytes long, rest_words array<binary>, rest_events array<long>"
    scored = materialize(rows.mapInArrow(run, schema), "scored")
    n = F.col("n")
    more_words = scored.select("row", F.explode("rest_words").alias("word")).join(words, "word").groupBy("row").agg(F.sum(F.log10(n + 0.5)).alias("more_words"), F.count_if(n > 0).alias("more_known"))
    more_bytes = scored.select("row", F.explode("rest_events").alias("gram")).join(table, "gram").groupBy("row").agg(F.sum("score").alias("more_bytes"))
    out = scored.drop("rest_words", "rest_events").join(more_words, "row", "left").join(more_bytes, "row", "left")
    base = F.col("log_words") + F.coalesce("more_words", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(stats.n + 0.5 * (stats.v + 1))))
    return out.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(stats.n).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        ((F.col("log_bytes") + F.coalesce("more_bytes", F.lit(0))) / UNIT).alias("score"),
    )
