"""Sampled distributions by group, and several of them on one grid."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import classify, rules
from orrery.functions.text import half_up_at
from orrery.operators import ranks
from orrery.sources.shared import materialize


def sampled_cdf(rows: DataFrame, group: Column, value: Column, points: int = 250, least_rows: int = 0, each: int = ranks.EACH) -> DataFrame:
    """(grp, i, m, f): of a group's n values in order, those at i = 0, step, 2 step, ... with f = (i + 1) / n.

    step is n div points, 1 at least. Where the last sampled value isn't the largest, the largest is added with f = 1.
    Values that are null or not above 0, and null groups, are left out; groups of least_rows rows and fewer too.

    Rows are summed by (group, value) first; places come from running sums over ranges of some `each` values, cut at
    quantiles, so that no window is longer however far a value lies from the others.
    """
    data = rows.select(group.alias("grp"), value.alias("m")).filter("grp is not null and m > 0").groupBy("grp", "m").agg(F.count("*").alias("k"))
    data = ranks.running(data, "grp", "m", "k", each).withColumnRenamed("total", "n").filter(F.col("n") > least_rows)
    data = data.withColumn("step", F.greatest(F.lit(1), F.floor(F.col("n") / points)).cast("long"))
    first = F.ceil((F.col("hi") - F.col("k")) / F.col("step")).cast("long") * F.col("step")
    last = F.floor((F.col("n") - 1) / F.col("step")).cast("long") * F.col("step")  # the last sampled place
    inside = F.when(first < F.col("hi"), F.sequence(first, F.col("hi") - 1, F.col("step"))).otherwise(F.array().cast("array<bigint>"))
    end = F.when((F.col("m") == F.col("top")) & (F.col("hi") - F.col("k") > last), F.array(F.col("n") - 1)).otherwise(F.array().cast("array<bigint>"))
    out = data.select("grp", F.explode(F.concat(inside, end)).alias("i"), "m", "n")
    return out.select("grp", "i", "m", ((F.col("i") + 1) / F.col("n").cast("double")).alias("f")).orderBy("grp", "i")


def top_groups(rows: DataFrame, group: Column, value: Column, k: int = 7) -> DataFrame:
    """(grp): the k groups of most rows with a value above 0, ties by name."""
    data = rows.select(group.alias("grp"), value.alias("m")).filter("grp is not null and m > 0")
    return data.groupBy("grp").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "grp").limit(k).select("grp")


def top_group_cdf(rows: DataFrame, group: Column, value: Column, k: int = 7, points: int = 250) -> DataFrame:
    """sampled_cdf of the k largest groups; k rows are broadcast to the rows."""
    data = rows.select(group.alias("grp"), value.alias("m"))
    kept = data.join(F.broadcast(top_groups(rows, group, value, k)), "grp", "left_semi")
    return sampled_cdf(kept, F.col("grp"), F.col("m"), points)


def segmented_cdf(objects: DataFrame, by: str = "all", classes: Sequence[str] = ("P", "R", "D", "C"), labels: Mapping[str, str] = rules.CLASS_LABELS, k: int = 7, points: int = 250) -> DataFrame:
    """sampled_cdf of masses by a segmentation: all, type (classes of more than 20 rows, by label), nation or site
    (the k largest)."""
    value = F.col("mass_kg").cast("double")
    if by == "all":
        return sampled_cdf(objects, F.lit("all"), value, points)
    if by == "type":
        label = classify.labelled(F.col("object_class"), labels)
        return sampled_cdf(objects.filter(F.col("object_class").isin(*classes)), label, value, points, least_rows=20)
    if by in ("nation", "site"):
        return top_group_cdf(objects, F.col("state" if by == "nation" else "site"), value, k, points)
    raise ValueError(f"no segmentation {by!r}: all, type, nation or site")


def common_grid(series: DataFrame) -> DataFrame:
    """(grp, log_m, f): all series at all log10 masses (two decimals) of any of them, each as a step function.

    At a grid place a series has the f of its last point at or before it; up to its first point the first f. This is a
    backward as-of join: points and grid places of a series are one ordered run, and f is carried forward.

    The result is every series at every place by definition. series is a summary: a few hundred points for each group
    that a chart shows, and two decimals of a logarithm bound the grid (62 thousand places for any double).
    """
    points = materialize(series.select("grp", F.log10(F.col("m").cast("double")).alias("x"), "f", "i"), "series")
    grid = points.select(half_up_at(F.col("x"), 2).alias("x")).distinct()
    ends = points.groupBy("grp").agg(F.min(F.struct("x", "i", "f")).alias("first"))
    # each series gets the places as one array, which is as long as the grid
    whole = grid.agg(F.collect_list("x").alias("places")).withColumn("one", F.lit(1))
    places = ends.select("grp", F.lit(1).alias("one")).join(F.broadcast(whole), "one").select("grp", F.explode("places").alias("x"))
    none = F.lit(None)
    run = points.select("grp", "x", "i", "f", F.lit(0).alias("kind")).unionByName(places.select("grp", "x", none.cast("long").alias("i"), none.cast("double").alias("f"), F.lit(1).alias("kind")))
    w = Window.partitionBy("grp").orderBy("x", "kind", "i").rowsBetween(Window.unboundedPreceding, 0)
    run = run.withColumn("carried", F.last("f", ignorenulls=True).over(w)).filter("kind = 1").join(ends, "grp")
    f = F.when(F.col("x") <= F.col("first.x"), F.col("first.f")).otherwise(F.col("carried"))
    return run.select("grp", F.col("x").alias("log_m"), f.alias("f")).orderBy("grp", "log_m")
