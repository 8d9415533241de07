"""Summaries and mass by any key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import classify, rules
from orrery.functions.dates import year_number, year_text
from orrery.functions.text import half_up

ACTIVE = ("O", "OX")


def known(mass: Column) -> Column:
    """Mass with null as 0."""
    return F.coalesce(mass, F.lit(0))


def payloads(objects: DataFrame, payload: str = "P") -> DataFrame:
    return objects.filter(F.col("object_class") == payload)


def mass_by(objects: DataFrame, key: Column, payload: str = "P", top: int | None = None, unknown: str | None = "Unknown", order: str = "mass", above: float | None = None) -> DataFrame:
    """(label, mass_kg, count, payload_count) by key.

    A null key is the label `unknown`, or is left out where that is None. Null mass counts 0, its row counts. Mass is
    rounded after summing and before ordering: by mass, largest first, or by label; ties by label. With `above`,
    labels of a larger mass than it only; with top, the first of those.
    """
    return counted_by(objects.withColumn("n", F.lit(1)), key, payload, top, unknown, order, above)


def counted_by(rows: DataFrame, key: Column, payload: str = "P", top: int | None = None, unknown: str | None = "Unknown", order: str = "mass", above: float | None = None) -> DataFrame:
    """mass_by() of rows that stand for n objects each, mass_kg being the sum of theirs."""
    rows = rows.select((F.coalesce(key, F.lit(unknown)) if unknown is not None else key).alias("label"), "mass_kg", "object_class", "n")
    if unknown is None:
        rows = rows.filter("label is not null")
    own = F.coalesce(F.sum(F.when(F.col("object_class") == payload, F.col("n"))), F.lit(0)).cast("long")
    out = rows.groupBy("label").agg(half_up(F.sum(known(F.col("mass_kg")))).alias("mass_kg"), F.sum("n").cast("long").alias("count"), own.alias("payload_count"))
    out = out if above is None else out.filter(F.col("mass_kg") > above)
    out = out.orderBy(F.col("mass_kg").desc(), "label") if order == "mass" else out.orderBy("label")
    return out.limit(top) if top else out


def mass_by_year(objects: DataFrame, payload: str = "P") -> DataFrame:
    """Mass of all classes by launch year, oldest first; rows without a year are left out."""
    return mass_by(objects, year_text(F.col("ldate")), payload, unknown=None, order="label")


def mass_by_class(objects: DataFrame, payload: str = "P", labels: dict[str, str] | None = None) -> DataFrame:
    return mass_by(objects, classify.labelled(F.coalesce("object_class", F.lit("-")), labels or rules.CLASS_LABELS), payload)


def summary(objects: DataFrame, payload: str = "P", active: Sequence[str] = ACTIVE, constellation: str = "STARLINK", approximate: bool = False) -> DataFrame:
    """One row of totals. countries counts owners. approximate: distinct counts by sketches, for very many values."""
    is_payload = F.col("object_class") == payload
    is_active = is_payload & F.col("sat_state").isin(*active)
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    year = year_number(F.col("ldate"))
    return objects.agg(
        F.count("*").alias("total_objects"),
        F.count_if(is_payload).alias("total_payloads"),
        half_up(F.coalesce(F.sum(F.when(is_payload, known(F.col("mass_kg")))), F.lit(0))).alias("total_mass_kg"),
        F.count_if(is_active).alias("active_payloads"),
        F.count_if(is_active & F.upper("name").contains(constellation)).alias("constellation_active"),
        distinct(F.nullif("owner", F.lit(""))).alias("countries"),
        distinct(F.nullif("lv", F.lit(""))).alias("launch_vehicles"),
        F.coalesce(F.min(year), F.lit(0)).alias("first_launch_year"),
        F.coalesce(F.max(year), F.lit(0)).alias("last_launch_year"),
    )


def upmass_by_provider(objects: DataFrame, start: str, end: str, ordered: Sequence[rules.Rule] = rules.PROVIDERS, payload: str = "P") -> DataFrame:
    """(provider, mass_kg, count) of payloads launched from start to end, both included, largest mass first."""
    rows = payloads(objects, payload).filter(F.col("ldate").between(start, end))
    rows = rows.select(classify.provider(F.col("lv_family"), F.col("lv"), ordered).alias("provider"), "mass_kg")
    out = rows.groupBy("provider").agg(half_up(F.sum(known(F.col("mass_kg")))).alias("mass_kg"), F.count("*").alias("count"))
    return out.orderBy(F.col("mass_kg").desc(), "provider")


def upmass_totals(by_provider: DataFrame, start: str, end: str) -> DataFrame:
    """One row: the window, the sum of the rounded masses, the count."""
    return by_provider.agg(F.coalesce(F.sum("mass_kg"), F.lit(0)).alias("total_mass_kg"), F.coalesce(F.sum("count"), F.lit(0)).alias("total_count")).select(F.lit(start).alias("start"), F.lit(end).alias("end"), "total_mass_kg", "total_count")


def filter_values(objects: DataFrame, fields: Sequence[str] = ("owner", "op_orbit", "sat_state", "object_class")) -> DataFrame:
    """(field, value): distinct values by code unit, null and empty left out. One scan serves all fields."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")
    return objects.select(pairs).select("x.*").filter("value is not null and value <> ''").distinct().orderBy("field", "value")


def vehicles_flown(launches: DataFrame) -> DataFrame:
    """(year, vehicles): how many different vehicles flew."""
    vehicle = F.coalesce("lv_family", "lv", F.lit("Unknown"))
    return launches.filter("orbital and ldate is not null").groupBy(year_number(F.col("ldate")).alias("year")).agg(F.count_distinct(vehicle).alias("vehicles")).orderBy("year")
