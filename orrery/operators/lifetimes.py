"""Lifetimes of objects, who is up on a day, and where."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import classify
from orrery.functions.dates import day_number, decay_day_number
from orrery.functions.text import half_up, half_up_at
from orrery.operators import intervals

LATEST_DAY = 30_000


def lifetimes(objects: DataFrame, launch_day: Column | None = None, decay_day: Column | None = None, decays: Column | None = None, latest: int = LATEST_DAY) -> DataFrame:
    """(lday, dday, p, a, i, c) by launch day: day numbers (dday -1: still up), rounded perigee, apogee (else perigee)
    and inclination, and class (null: U).

    Left out: objects without launch day, perigee or inclination or with a launch before day 0; those that decayed on
    a day that can't be read, before day 0, after `latest` or before their launch.
    """
    launch = launch_day if launch_day is not None else day_number(F.col("ldate"))
    ended = decays if decays is not None else F.coalesce(F.col("decay_date") != "", F.lit(False))
    decay = decay_day if decay_day is not None else decay_day_number(F.col("decay_date"))
    rows = objects.select(launch.alias("lday"), ended.alias("ended"), F.when(ended, decay).alias("dday"), "perigee_km", "apogee_km", "inc_deg", "object_class")
    rows = rows.filter("lday >= 0 and perigee_km is not null and inc_deg is not null").filter(~F.col("ended") | F.coalesce(F.col("dday").between(0, latest) & (F.col("lday") <= F.col("dday")), F.lit(False)))
    return rows.select(
        "lday",
        F.coalesce("dday", F.lit(-1)).alias("dday"),
        half_up(F.col("perigee_km").cast("double")).alias("p"),
        half_up(F.coalesce("apogee_km", "perigee_km").cast("double")).alias("a"),
        half_up_at(F.col("inc_deg").cast("double"), 1).alias("i"),
        F.coalesce("object_class", F.lit("U")).alias("c"),
    )


def lifetime_summary(table: DataFrame, today: int) -> DataFrame:
    """One row: total, decayed, in_orbit, day_min (0 of an empty table) and day_max (today at least)."""
    last = F.max(F.when(F.col("dday") >= 0, F.col("dday")).otherwise(F.col("lday")))
    return table.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("dday") >= 0).alias("decayed"),
        F.count_if(F.col("dday") < 0).alias("in_orbit"),
        F.coalesce(F.min("lday"), F.lit(0)).alias("day_min"),
        F.greatest(F.coalesce(last, F.lit(0)), F.lit(today)).alias("day_max"),
    )


def active_on(table: DataFrame, day: int) -> DataFrame:
    return table.filter((F.col("lday") <= day) & ((F.col("dday") < 0) | (F.col("dday") >= day)))


def active_daily(table: DataFrame) -> DataFrame:
    """(day, active) on each day on which the number changes: +1 at launch and -1 after decay, summed by day and then
    run over the days, which are a bounded number of rows."""
    steps = F.explode(F.array(F.struct(F.col("lday").alias("day"), F.lit(1).alias("d")), F.struct(F.when(F.col("dday") >= 0, F.col("dday") + 1).alias("day"), F.lit(-1).alias("d")))).alias("x")
    daily = table.select(steps).select("x.*").filter("day is not null").groupBy("day").agg(F.sum("d").alias("d"))
    return daily.select("day", F.sum("d").over(Window.orderBy("day")).alias("active")).orderBy("day")


def _altitudes(rows: DataFrame, day: Column, low: float) -> DataFrame:
    rows = rows.withColumn("frac", _left(day))
    rows = rows.withColumn("cur_p", F.col("p") * F.col("frac")).withColumn("cur_a", F.col("a") * F.col("frac"))
    return rows.withColumn("hot", (F.col("dday") >= 0) & (F.col("cur_p") < low))


def _left(day: Column) -> Column:
    """The share of its life that an object has left on a day; all of it where it is still up."""
    life = F.greatest(F.lit(1), F.col("dday") - F.col("lday"))
    return F.when(F.col("dday") < 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - (day - F.col("lday")).cast("double") / life))


def altitude_on(table: DataFrame, day: int, low: float = 100) -> DataFrame:
    """Active objects with frac, cur_p, cur_a and hot: the share of their life left scales a decaying object's perigee
    and apogee; hot ones decay and are below `low` km."""
    return _altitudes(active_on(table, day), F.lit(day), low)


def active_at(table: DataFrame, days: DataFrame, width: int = 512, salts: int = 8) -> DataFrame:
    """table's rows with each day of days (day) on which they are active: active_on() for many days at once, by bins.
    Days that repeat give rows that repeat; null days none."""
    end = F.when(F.col("dday") >= 0, F.col("dday"))
    return intervals.overlapping(table, F.col("lday"), end, days.select("day"), F.col("day"), F.col("day"), width, salts)


def active_during(table: DataFrame, windows: DataFrame, width: int = 512, salts: int = 8) -> DataFrame:
    """table's rows with each of windows (from_day, to_day, ...) that they are active in on some day."""
    end = F.when(F.col("dday") >= 0, F.col("dday"))
    return intervals.overlapping(table, F.col("lday"), end, windows, F.col("from_day"), F.col("to_day"), width, salts)


def altitude_at(table: DataFrame, days: DataFrame, low: float = 100, width: int = 512, salts: int = 8) -> DataFrame:
    """altitude_on() for many days at once: active objects of each day of days (day)."""
    return _altitudes(active_at(table, days, width, salts), F.col("day"), low)


def crossing_day(low: float) -> Column:
    """The first day on which a decaying object is below `low` km (above 0), null if none is: its altitude falls along a
    line from the perigee at launch to 0, so that the day follows from it; days beside it are tried, as the line is of
    rounded numbers."""
    if not low > 0:
        raise ValueError("the limit must be above 0 km")
    life = F.greatest(F.lit(1), F.col("dday") - F.col("lday"))
    near = F.col("lday") + F.when(F.col("p") > low, F.ceil(life * (F.lit(1.0) - F.lit(float(low)) / F.col("p")))).otherwise(0)
    days = F.sequence(F.greatest(F.col("lday").cast("long"), near.cast("long") - 2), near.cast("long") + 2)
    first = F.array_min(F.filter(days, lambda d: F.col("p") * _left(d) < low))
    return F.when((F.col("dday") >= 0) & (first <= F.col("dday")), first)


def near_reentry_daily(table: DataFrame, low: float = 100) -> DataFrame:
    """(day, active, near_reentry) on each day on which either number changes: objects that are up, and those of them that
    decay and are below `low` km. One pass: an object comes and goes in two pairs of steps, summed by day and run over
    the days, which are a bounded number of rows."""
    step = lambda day, up, hot: F.struct(day.cast("long").alias("day"), F.lit(up).alias("up"), F.lit(hot).alias("hot"))
    down = F.when(F.col("dday") >= 0, F.col("dday") + 1)
    cross = crossing_day(low)
    steps = F.array(step(F.col("lday"), 1, 0), step(down, -1, 0), step(cross, 0, 1), step(F.when(cross.isNotNull(), down), 0, -1))
    daily = table.select(F.explode(steps).alias("x")).select("x.*").filter("day is not null").groupBy("day").agg(F.sum("up").alias("up"), F.sum("hot").alias("hot"))
    w = Window.orderBy("day")
    return daily.select("day", F.sum("up").over(w).alias("active"), F.sum("hot").over(w).alias("near_reentry")).orderBy("day")


def hot_count(table: DataFrame, day: int, low: float = 100) -> DataFrame:
    return altitude_on(table, day, low).agg(F.count_if("hot").alias("near_reentry"))


def orbital_points(objects: DataFrame) -> DataFrame:
    """(p, i, c) of objects with perigee and inclination."""
    return objects.filter("perigee_km is not null and inc_deg is not null").select(F.col("perigee_km").alias("p"), F.col("inc_deg").alias("i"), F.coalesce("object_class", F.lit("U")).alias("c"))


def low_points(points: DataFrame, most: float = 2500, buckets: tuple[str, ...] = ("P", "R", "D", "C")) -> DataFrame:
    """Points of a perigee up to `most` km, classes beyond the buckets as _other."""
    return points.filter(F.col("p") <= most).withColumn("bucket", F.when(F.col("c").isin(*buckets), F.col("c")).otherwise("_other"))


def orbit_shapes(objects: DataFrame) -> DataFrame:
    return objects.withColumns(classify.orbit_shape(F.col("apogee_km"), F.col("perigee_km"), F.col("inc_deg")))
