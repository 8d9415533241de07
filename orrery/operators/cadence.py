"""Launch cadence by provider and vehicle, watchlists, and programs side by side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import classify, rules
from orrery.functions.dates import year_number


def attempts(launches: DataFrame, ordered: Sequence[rules.Rule] = rules.PROVIDERS) -> DataFrame:
    """(year, provider, vehicle, text, pos) of orbital launches with a year."""
    pos = F.col("pos") if "pos" in launches.columns else F.lit(None).cast("long")
    rows = launches.filter("orbital").select(
        year_number(F.col("ldate")).alias("year"),
        classify.provider(F.col("lv_family"), F.col("lv"), ordered).alias("provider"),
        F.coalesce("lv_family", "lv", F.lit("Unknown")).alias("vehicle"),
        classify.vehicle_text(F.col("lv_family"), F.col("lv")).alias("text"),
        pos.alias("pos"),
    )
    return rows.filter("year is not null")


def launch_rate(launches: DataFrame, least_year: int = 2019, ordered: Sequence[rules.Rule] = rules.PROVIDERS) -> DataFrame:
    """(level, year, provider, vehicle, n): level is year, provider, provider_vehicle or vehicle; other keys are null.

    One pass over the launches and one shuffle of partial sums serve all levels.
    """
    rows = attempts(launches, ordered).filter(F.col("year") >= least_year)
    out = rows.groupingSets([["year"], ["year", "provider"], ["year", "provider", "vehicle"], ["year", "vehicle"]], "year", "provider", "vehicle").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    level = F.when(F.col("g") == 3, "year").when(F.col("g") == 1, "provider").when(F.col("g") == 0, "provider_vehicle").otherwise("vehicle")
    return out.select(level.alias("level"), "year", "provider", "vehicle", "n").orderBy("level", "year", F.col("n").desc(), "provider", "vehicle")


def vehicle_providers(launches: DataFrame, least_year: int = 2019, ordered: Sequence[rules.Rule] = rules.PROVIDERS) -> DataFrame:
    """(year, vehicle, n, provider): the provider of a year's first launch of the vehicle in source order, or the
    first by name where the launches have no order."""
    rows = attempts(launches, ordered).filter(F.col("year") >= least_year)
    first = F.min(F.struct(F.coalesce("pos", F.lit(0)).alias("pos"), F.col("provider").alias("provider")))["provider"]
    return rows.groupBy("year", "vehicle").agg(F.count("*").alias("n"), first.alias("provider")).orderBy("year", F.col("n").desc(), "vehicle")


def nested_rate(rate: DataFrame, vehicles: DataFrame) -> DataFrame:
    """(year, providers, vehicles, total) with arrays, most launches first; ties by name."""
    by_count = lambda *names: F.struct((-F.col("n")).alias("rank"), *[F.col(n) for n in names], F.col("n").alias("count"))
    plain = lambda c, *f: F.transform(F.array_sort(F.collect_list(c)), lambda x: F.struct(*[x[n].alias(n) for n in f]))
    inner = rate.filter("level = 'provider_vehicle'").groupBy("year", "provider").agg(plain(by_count("vehicle"), "vehicle", "count").alias("vehicles"), F.sum("n").alias("n"))
    providers = inner.groupBy("year").agg(plain(by_count("provider", "vehicles"), "provider", "count", "vehicles").alias("providers"), F.sum("n").alias("total"))
    flat = vehicles.groupBy("year").agg(plain(by_count("vehicle", "provider"), "vehicle", "count", "provider").alias("vehicles"))
    return providers.join(flat, "year").select("year", "providers", "vehicles", "total").orderBy("year")


def provider_ranks(launches: DataFrame, least_year: int = 2019, ordered: Sequence[rules.Rule] = rules.PROVIDERS, key: str = "provider") -> DataFrame:
    """(year, <key>, n, rank, share, leader): rank by launches, ties by name; share of the year's launches."""
    rows = attempts(launches, ordered).filter(F.col("year") >= least_year).groupBy("year", key).agg(F.count("*").alias("n"))
    order = Window.partitionBy("year").orderBy(F.col("n").desc(), key)
    year = Window.partitionBy("year")
    return rows.select("year", key, "n", F.row_number().over(order).alias("rank"), F.try_divide(F.col("n").cast("double"), F.sum("n").over(year).cast("double")).alias("share"), F.first(key).over(order).alias("leader"))


def top_n(ranks: DataFrame, n: int, key: str = "provider", highlight: str | None = None) -> DataFrame:
    return ranks.filter(F.col("rank") <= n).withColumn("highlight", F.col(key).eqNullSafe(F.lit(highlight))).drop("leader")


def latest_complete_year(launches: DataFrame, least_year: int = 2019) -> DataFrame:
    """(year): the last but one of the years with launches, or the only one."""
    years = launches.filter("orbital").select(year_number(F.col("ldate")).alias("year")).filter(F.col("year") >= least_year).distinct()
    last = years.orderBy(F.col("year").desc()).limit(2)
    return last.agg(F.min("year").alias("year")).filter("year is not null")


def recent_years(launches: DataFrame, n: int = 6, least_year: int = 2019) -> DataFrame:
    years = launches.filter("orbital").select(year_number(F.col("ldate")).alias("year")).filter(F.col("year") >= least_year).distinct()
    return years.orderBy(F.col("year").desc()).limit(n)


def watchlist(launches: DataFrame, contenders: Sequence[tuple[int, str, str, Sequence[str]]] = rules.WATCHLIST) -> DataFrame:
    """(ord, vehicle, provider, status, first_year, total_launches) of every contender, over all years.

    A launch counts for each contender of which its text holds a pattern, once. Launches are summed by (year, text)
    first, so the patterns, which the caller lists, meet few rows.
    """
    spark = launches.sparkSession
    listed = spark.createDataFrame([(o, v, p, list(m)) for o, v, p, m in contenders], "ord int, vehicle string, provider string, patterns array<string>")
    seen = attempts(launches).groupBy("year", "text").agg(F.count("*").alias("n"))
    small = F.broadcast(listed.select("ord", "patterns"))  # as long as the caller's list
    hits = seen.join(small, F.exists("patterns", lambda p: F.col("text").contains(p)))
    sums = hits.groupBy("ord").agg(F.sum("n").alias("total_launches"), F.min("year").alias("first_year"))
    out = listed.join(sums, "ord", "left")
    total = F.coalesce("total_launches", F.lit(0))
    return out.select("ord", "vehicle", "provider", F.when(total > 0, "FLYING").otherwise("AWAITING").alias("status"), "first_year", total.cast("long").alias("total_launches")).orderBy("ord")


def program_years(launches: DataFrame, programs: Mapping[str, Column]) -> DataFrame:
    """(program, year, n) of orbital launches; programs maps names to conditions, of which the first that holds wins."""
    name = F.lit(None).cast("string")
    for key, test in reversed(list(programs.items())):
        name = F.when(test, F.lit(key)).otherwise(name)
    rows = launches.filter("orbital").select(name.alias("program"), year_number(F.col("ldate")).alias("year"))
    return rows.filter("program is not null and year is not null").groupBy("program", "year").agg(F.count("*").alias("n"))


def aligned_programs(launches: DataFrame, programs: Mapping[str, Column], required: bool = True) -> DataFrame:
    """(program_year, <program>_year, <program>_count ...): programs side by side by years since their first launch.

    Years without a launch within a program's span count 0; after its end they are null. required: a program without
    launches raises ValueError, which needs a pass over the launches.
    """
    by_year = program_years(launches, programs)
    if required:
        there = {r.program for r in by_year.select("program").distinct().collect()}  # a name for each program at most
        if missing := [p for p in programs if p not in there]:
            raise ValueError(f"no launches of {', '.join(missing)}: the comparison is not made")
    spans = by_year.groupBy("program").agg(F.min("year").alias("first"), F.max("year").alias("last"))
    spine = spans.select("program", F.explode(F.sequence("first", "last")).alias("year"), "first")
    rows = spine.join(by_year, ["program", "year"], "left").select("program", "year", (F.col("year") - F.col("first") + 1).alias("program_year"), F.coalesce("n", F.lit(0)).alias("n"))
    sums = [x for p in programs for x in (F.max(F.when(F.col("program") == p, F.col("year"))).alias(f"{p}_year"), F.max(F.when(F.col("program") == p, F.col("n"))).alias(f"{p}_count"))]
    return rows.groupBy("program_year").agg(*sums).orderBy("program_year")


def program_totals(launches: DataFrame, programs: Mapping[str, Column]) -> DataFrame:
    return program_years(launches, programs).groupBy("program").agg(F.min("year").alias("first_year"), F.sum("n").alias("total")).orderBy("program")


def program_events(aligned: DataFrame, events: DataFrame, programs: Sequence[str]) -> DataFrame:
    """events with the aligned series' value in their year; events where it has none are left out."""
    value = F.lit(None).cast("long")
    for p in programs:
        value = F.when(F.col("program") == p, F.col(f"{p}_count")).otherwise(value)
    return events.join(aligned, "program_year").withColumn("value", value).filter("value is not null").select(*events.columns, "value").orderBy("program", "program_year")


def cadence_events(spark, events: Sequence[tuple] = rules.CADENCE_EVENTS) -> DataFrame:
    return spark.createDataFrame(list(events), "program string, program_year int, calendar_year int, label string")
