"""Positions and running sums in an order of all rows, by ranges of that order: a distributed prefix sum.

Rows are cut into ranges at quantiles of the rows themselves, so that no range is long however values are spread. A range
knows its sums; running sums over the ranges, a row for each, are the offsets of the next ones. Only rows of one range
are ever ordered together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.sources.shared import materialize

#: Rows of a range, about: ranges are cut at quantiles of a sample.
EACH = 1 << 16
_IN_TASK = (1 << 33) - 1


def ranges(rows: int, each: int = EACH) -> int:
    return max(1, -(-rows // each))


def spread_over(rows: int, each: int, most: int) -> int:
    """Rows of a file: `each`, or so many more that there are `most` files at most. What files cost to write, commit, list
    and open then doesn't grow with the table."""
    return max(each, -(-rows // most))


def ranked(rows: DataFrame, by: Sequence[Column], each: int = 1 << 20, name: str = "rank") -> DataFrame:
    """rows with `name`: their positions 0 to n - 1 in the order of `by`, ties in any order. The result is a table.

    Rows are range-partitioned and sorted once. A position is the offset of a row's task and its number there; offsets
    are a row for each task. Many rows that are equal in `by` make one long range: add columns that tell them apart.
    """
    source = materialize(rows, "unranked")
    spread = source.repartitionByRange(ranges(source.count(), each), *by).sortWithinPartitions(*by)
    table = materialize(spread.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    task = F.shiftright("_at", 33)
    tasks = table.groupBy(task.alias("_task")).agg(F.count("*").alias("_n"))
    offsets = tasks.select("_task", (F.sum("_n").over(Window.orderBy("_task")) - F.col("_n")).alias("_offset"))
    out = table.withColumn("_of", task).join(F.broadcast(offsets), F.col("_of") == F.col("_task"))  # a row for each task
    return out.withColumn(name, F.col("_offset") + F.col("_at").bitwiseAND(F.lit(_IN_TASK))).select(*rows.columns, name)


def running(rows: DataFrame, group: str, by: str, weight: str, each: int = EACH) -> DataFrame:
    """rows (group, by, weight) with hi, the sum of weight in a row's group up to it, and of its group: total, the sum of
    all, and top, the largest `by`. A pair (group, by) has one row, as after a groupBy of both.

    A range holds some `each` rows of any groups; a window holds a group's part of one range.
    """
    source = materialize(rows.select(group, by, weight), "summed")
    if (n := ranges(source.count(), each)) > 1:
        table = materialize(source.repartitionByRange(n, group, by).withColumn("_range", F.spark_partition_id()), "ranges")
    else:
        table = source.withColumn("_range", F.lit(0))
    parts = table.groupBy(group, "_range").agg(F.sum(weight).alias("_held"), F.max(by).alias("_top"))
    whole = Window.partitionBy(group)  # a row for each range
    parts = parts.select(
        F.col(group).alias("_group"),
        F.col("_range").alias("_part"),
        (F.sum("_held").over(whole.orderBy("_range")) - F.col("_held")).alias("_before"),
        F.sum("_held").over(whole).alias("total"),
        F.max("_top").over(whole).alias("top"),
    )
    own = Window.partitionBy(group, "_range").orderBy(by)
    out = table.withColumn("_own", F.sum(weight).over(own)).join(parts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_part")))
    return out.select(group, by, weight, (F.col("_before") + F.col("_own")).alias("hi"), "total", "top")
