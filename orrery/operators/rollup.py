"""One table of sums that merge, from which summaries, masses by key and series are read instead of from the objects."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.dates import year_number, year_text
from orrery.functions.text import half_up
from orrery.operators import mass

KEYS = ("object_class", "sat_state", "state", "op_orbit", "lv", "lv_family", "site")
LENGTHS = {"day": 10, "month": 7, "year": 4}


def rollup(objects: DataFrame, period: str = "day", keys: Sequence[str] = KEYS, constellation: str = "STARLINK") -> DataFrame:
    """(ldate, *keys, constellation, mass_kg, n, owners): for each period of launch and combination of keys the sum of
    masses (null: 0), the number of objects, and a sketch of their owners. ldate is cut to the period.

    Sums are of decimals where masses are, so that they are exact and merge in any order. Sketches tell distinct owners
    to within 1.6 % (one standard error), and exactly or nearly so where they are few.
    """
    when = F.substring("ldate", 1, LENGTHS[period]).alias("ldate")
    named = F.coalesce(F.upper("name").contains(constellation), F.lit(False)).alias("constellation")
    rows = objects.select(when, *keys, named, mass.known(F.col("mass_kg")).alias("mass_kg"), F.nullif("owner", F.lit("")).alias("owner"))
    return rows.groupBy("ldate", *keys, "constellation").agg(F.sum("mass_kg").alias("mass_kg"), F.count("*").alias("n"), F.hll_sketch_agg("owner").alias("owners"))


def merged(*parts: DataFrame) -> DataFrame:
    """The rollup of all objects from rollups of the same keys and period over parts of them."""
    whole = reduce(DataFrame.unionByName, parts)
    keys = [c for c in whole.columns if c not in ("mass_kg", "n", "owners")]
    return whole.groupBy(*keys).agg(F.sum("mass_kg").alias("mass_kg"), F.sum("n").alias("n"), F.hll_union_agg("owners").alias("owners"))


def mass_by(rolled: DataFrame, key: Column, payload: str = "P", top: int | None = None, unknown: str | None = "Unknown", order: str = "mass", above: float | None = None) -> DataFrame:
    """mass.mass_by() from a rollup: key is of its keys."""
    return mass.counted_by(rolled, key, payload, top, unknown, order, above)


def mass_by_year(rolled: DataFrame, payload: str = "P") -> DataFrame:
    return mass_by(rolled, year_text(F.col("ldate")), payload, unknown=None, order="label")


def summary(rolled: DataFrame, payload: str = "P", active: Sequence[str] = mass.ACTIVE) -> DataFrame:
    """mass.summary() from a rollup; countries is the sketches' estimate, all else is exact."""
    is_payload = F.col("object_class") == payload
    is_active = is_payload & F.col("sat_state").isin(*active)
    count = lambda which: F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0)).cast("long")
    year = year_number(F.col("ldate"))
    return rolled.agg(
        count(F.lit(True)).alias("total_objects"),
        count(is_payload).alias("total_payloads"),
        half_up(F.coalesce(F.sum(F.when(is_payload, F.col("mass_kg"))), F.lit(0))).alias("total_mass_kg"),
        count(is_active).alias("active_payloads"),
        count(is_active & F.col("constellation")).alias("constellation_active"),
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("owners")), F.lit(0)).alias("countries"),
        F.count_distinct(F.nullif("lv", F.lit(""))).alias("launch_vehicles"),
        F.coalesce(F.min(year), F.lit(0)).alias("first_launch_year"),
        F.coalesce(F.max(year), F.lit(0)).alias("last_launch_year"),
    )
