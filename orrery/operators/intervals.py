"""Joins of intervals of whole numbers by bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlapping(left: DataFrame, left_from: Column, left_to: Column, right: DataFrame, right_from: Column, right_to: Column, width: int = 512, salts: int = 8) -> DataFrame:
    """All pairs of a left and a right row whose intervals [from, to] share a number, each once, with both sides' columns.

    Intervals are cut into bins of `width` numbers, and rows meet in the bin where the later of the two begins. Of the left
    only bins that the right has are made: an array of these bins, as long as the right's range has bins, goes to all
    left rows. A bin that most rows lie in is dealt to `salts` tasks, to which its right rows are copied. A null left_to
    is open: it reaches as far as the right does. Rows with a null from, a null right_to or an end before their begin have
    no pairs; columns of the two sides need different names.
    """
    bin_of = lambda c: F.floor(c / F.lit(width)).cast("long")
    right = right.withColumns({"_r0": right_from.cast("long"), "_r1": right_to.cast("long")}).filter("_r0 <= _r1")
    right = right.withColumn("_bin", F.explode(F.sequence(bin_of(F.col("_r0")), bin_of(F.col("_r1")))))
    asked = right.agg(F.collect_set("_bin").alias("_bins"), F.max("_r1").alias("_latest"))
    rows = left.withColumns({"_l0": left_from.cast("long"), "_end": left_to.cast("long"), "_salt": F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")})
    rows = rows.join(F.broadcast(asked)).withColumn("_l1", F.coalesce("_end", "_latest")).filter("_l0 <= _l1")
    rows = rows.withColumn("_bin", F.explode(F.filter("_bins", lambda b: b.between(bin_of(F.col("_l0")), bin_of(F.col("_l1")))))).drop("_end", "_bins", "_latest")
    copied = right.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumnRenamed("_bin", "_at")
    pairs = rows.join(copied, (F.col("_bin") == F.col("_at")) & (F.col("_salt") == F.col("_copy")) & (F.col("_l0") <= F.col("_r1")) & (F.col("_l1") >= F.col("_r0")))
    once = pairs.filter(F.col("_bin") == bin_of(F.greatest("_l0", "_r0")))
    return once.select(*[F.col(c) for c in left.columns], *[F.col(c) for c in right.columns if not c.startswith("_")])
