"""Sums by time bucket and segment, and what is read off such series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.text import half_up
from orrery.operators.mass import known


def segment_series(rows: DataFrame, bucket: Column, segment: Column, segments: Sequence[str], value: str = "mass_kg", counts: bool = False, least: int | None = None, spine: DataFrame | None = None) -> DataFrame:
    """bucket and a sum of value for each segment (and its count as <segment>_count), in order of the bucket.

    segment is the name of a row's segment; rows of other names make no bucket, nor do rows without one. Sums are
    rounded after summing. least: smallest bucket. spine: buckets that appear even where no row has them, as 0.
    """
    data = rows.select(bucket.alias("bucket"), segment.alias("segment"), known(F.col(value)).alias("value")).filter(F.col("bucket").isNotNull() & F.col("segment").isin(*segments))
    if least is not None:
        data = data.filter(F.col("bucket") >= least)
    sums = [half_up(F.coalesce(F.sum(F.when(F.col("segment") == s, F.col("value"))), F.lit(0))).alias(s) for s in segments]
    sums += [F.count_if(F.col("segment") == s).alias(f"{s}_count") for s in segments if counts]
    out = data.groupBy("bucket").agg(*sums)
    if spine is not None:
        names = [c for c in out.columns if c != "bucket"]
        out = spine.join(out, "bucket", "left").select("bucket", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])
    return out.orderBy("bucket")


def long_form(series: DataFrame, segments: Sequence[str]) -> DataFrame:
    """(bucket, segment, value)."""
    return series.unpivot("bucket", list(segments), "segment", "value")


def segment_share(series: DataFrame, segments: Sequence[str], least: int | None = None) -> DataFrame:
    """(segment, total, share) over the buckets from least on; share is null where the grand total is 0."""
    rows = series if least is None else series.filter(F.col("bucket") >= least)
    totals = rows.agg(*[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in segments])
    whole = sum((F.col(s) for s in segments[1:]), F.col(segments[0]))
    pairs = F.array(*[F.struct(F.lit(s).alias("segment"), F.col(s).cast("long").alias("total"), F.try_divide(F.col(s).cast("double"), whole.cast("double")).alias("share")) for s in segments])
    return totals.select(F.explode(pairs).alias("x")).select("x.*")


def row_shares(series: DataFrame, segments: Sequence[str]) -> DataFrame:
    """Each bucket with its total and the share of each segment in it."""
    whole = sum((F.col(s) for s in segments[1:]), F.col(segments[0]))
    return series.withColumn("total", whole).withColumns({f"{s}_share": F.try_divide(F.col(s).cast("double"), whole.cast("double")) for s in segments})


def peak(series: DataFrame, value: str) -> DataFrame:
    """(bucket, value) of the largest value, the first bucket on ties; no row of an empty series."""
    return series.orderBy(F.col(value).desc(), "bucket").select("bucket", F.col(value).alias("value")).limit(1)


def total(series: DataFrame, value: str) -> DataFrame:
    return series.agg(F.coalesce(F.sum(value), F.lit(0)).alias("total"))


def era_compare(series: DataFrame, value: str, start: int, split: int) -> DataFrame:
    """Totals, numbers of buckets and means from start to before split and from split on, and the ratio of the means."""
    early, late = F.col("bucket").between(start, split - 1), F.col("bucket") >= split
    out = series.agg(
        F.coalesce(F.sum(F.when(early, F.col(value))), F.lit(0)).alias("before_total"),
        F.count_if(early).alias("before_buckets"),
        F.coalesce(F.sum(F.when(late, F.col(value))), F.lit(0)).alias("after_total"),
        F.count_if(late).alias("after_buckets"),
    )
    mean = lambda e: F.coalesce(F.try_divide(F.col(f"{e}_total").cast("double"), F.col(f"{e}_buckets").cast("double")), F.lit(0.0))
    out = out.withColumn("before_mean", mean("before")).withColumn("after_mean", mean("after"))
    return out.withColumn("ratio", F.try_divide("after_mean", "before_mean"))
