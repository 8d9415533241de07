"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only.

Every document has a hash. A source whose target is q passes and a rest takes all of its documents q times, and
once more those whose hash is below the source's threshold. The threshold is found on sums of sizes by (source,
hash bucket): the bucket where the running sum passes the rest is the boundary, and only its documents are counted
again, by their next hash bits. Thresholds of growing budgets are nested: a larger one keeps all that a smaller took.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import WORD, materialize

#: Hash bits by level of refinement: 2 ** 36 buckets in all, of which 4096 a source are held at a time.
LEVELS = (12, 12, 12)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float = 1.0, most: float = 3.0) -> DataFrame:
    """Targets by source from a row (source, source_size) for each.

    Sources by code point, null last, weigh weights[0], weights[1], ... repeating. They share `share` of all sizes;
    a target stops at `most` times its source's size, and the excess is shared again by weight until none is above
    (with share > most, all are at their stop). That is a level L with target = min(weight * L, stop); over sources
    sorted by stop / weight, L is what the sources not stopped need. The windows hold one row a source.
    """
    n = len(weights)
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(n)) + 1).cast("int"))
    rows = sizes.withColumn("weight", w).withColumn("stop", F.col("source_size") * F.lit(float(most)))
    fill = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rows = (
        rows.withColumn("budget", F.sum("source_size").over(whole) * F.lit(float(share)))
        .withColumn("level", F.try_divide(F.col("budget") - F.coalesce(F.sum("stop").over(before), F.lit(0.0)), F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))))
        .withColumn("free", F.col("level") <= F.col("stop") / F.col("weight"))
    )
    level = F.min(F.when(F.col("free"), F.struct(F.col("stop") / F.col("weight"), F.col("level")))).over(whole)["level"]
    rows = rows.withColumn("target", F.when(level.isNull(), F.col("stop")).otherwise(F.least(F.col("weight") * level, F.col("stop"))))
    return rows.select("source", "source_size", "target")


def _prefix(docs: DataFrame, id_col: str, text_col: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(docs[id_col], docs[text_col]), 64 - sum(LEVELS))


def thresholds(rows: DataFrame, weights: Sequence[float], share: float = 1.0, most: int = 3) -> DataFrame:
    """(of, source_size, target, passes, threshold), a row for each source, from rows (source, size, prefix)."""
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    passes = F.least(F.floor(F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))), F.lit(most)).cast("long")
    rest = F.col("target") - F.col("passes") * F.col("source_size")
    found = targets.withColumn("passes", passes).withColumn("rest", rest).withColumn("at", F.lit(0).cast("long")).withColumn("final", F.lit(False))
    found = materialize(found, "mix-targets")
    deep = 0
    for bits in LEVELS:
        deep += bits
        found = materialize(_refine(rows, found, deep, bits), f"mix-level-{deep}")
    return found.select(F.col("source").alias("of"), "source_size", "target", "passes", F.col("at").alias("threshold"))


def _copies(prefix: Column, most: int) -> Column:
    return F.least(F.col("passes") + (prefix < F.col("threshold")).cast("long"), F.lit(most).cast("long"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    rows = docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"), word_count(docs[text_col]).alias("size"), _prefix(docs, id_col, text_col).alias("prefix"))
    return materialize(rows, "mix-sizes")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.0, most: int = 3) -> DataFrame:
    """(id_col, source, size, source_size, target, copies, taken) of every row of docs.

    size: words of the text (null: 0). copies: how often the mix takes the document, 0 to `most`; taken = size *
    copies. Sums of taken by source come within the size of one document (or of one group of rows that are alike in
    id and text, which go together) of the target. Reruns agree, as the hash is of id and text alone. Sources of no
    words, and empty tables, get targets of 0. A source that holds most rows is summed before any shuffle.
    """
    rows = _sized(docs, id_col, text_col, source_col)
    out = rows.join(thresholds(rows, weights, share, most), F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    copies = _copies(F.col("prefix"), most)
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.0, most: int = 3) -> DataFrame:
    """The mix itself: rows of docs as often as mix() takes them, with their columns. Only the thresholds, a row for
    each source, meet the documents, so no text is shuffled where they are few. Null and empty texts have no words and go
    with their hash as others do; a null source is one; an empty table gives an empty one."""
    bounds = thresholds(_sized(docs, id_col, text_col, source_col), weights, share, most)
    rows = docs.select(F.struct("*").alias("_row"), docs[source_col].alias("_source"), _prefix(docs, id_col, text_col).alias("_prefix"))
    rows = rows.join(bounds, F.col("_source").eqNullSafe(F.col("of")), "left").withColumn("_copies", _copies(F.col("_prefix"), most)).filter("_copies > 0")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("_row.*")


def _refine(rows: DataFrame, found: DataFrame, deep: int, bits: int) -> DataFrame:
    """From boundary buckets `at` of deep - bits bits to those of deep bits; at the last level to the nearest threshold."""
    total = sum(LEVELS)
    bucket = F.shiftrightunsigned("prefix", total - deep)
    here = found.select(F.col("source").alias("of"), "at", "rest")
    held = rows.join(here, F.col("source").eqNullSafe(F.col("of")) & (F.shiftrightunsigned("prefix", total - deep + bits) == F.col("at")))
    sums = held.groupBy("of", "rest", bucket.alias("bucket")).agg(F.sum("size").alias("held"))
    upto = F.sum("held").over(Window.partitionBy("of").orderBy("bucket"))
    sums = sums.withColumn("upto", upto).withColumn("below", F.col("upto") - F.col("held"))
    # the boundary is the first bucket whose sum passes the rest; where none does, the threshold is the range's end
    passing = sums.filter(F.col("upto") > F.col("rest")).groupBy("of").agg(F.min(F.struct("bucket", "below", "held")).alias("b"))
    out = found.join(passing, F.col("source").eqNullSafe(F.col("of")), "left").withColumn("none", F.col("b").isNull())
    start = F.col("at") * F.lit(1 << bits)
    end = F.when(F.col("final"), start).otherwise(start + F.lit(1 << bits))
    step = F.when(F.col("none"), F.col("rest")).otherwise(F.col("rest") - F.col("b.below"))
    at = F.col("b.bucket")
    if deep == total:
        at = at + (2 * step >= F.col("b.held")).cast("long")
    return out.select("source", "source_size", "target", "passes", step.alias("rest"), F.when(F.col("none"), end).otherwise(at).alias("at"), (F.col("final") | F.col("none")).alias("final"))
