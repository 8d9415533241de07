"""Tab-separated catalogs with a header behind #, into typed tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions.dates import iso_date, year_number
from orrery.functions.text import catalog_number, clean, is_orbital, number, object_class, orbit_class, trimmed, vehicle_family
from orrery.sources.shared import materialize


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path)


def header(spark: SparkSession, path: str, within: int) -> list[str]:
    """Names in lower case from the first of `within` lines that begins with # and holds a tab; [] without one."""
    for row in _lines(spark, path).limit(within).collect():
        if row.value.startswith("#") and "\t" in row.value:
            return [x.strip("﻿\xa0 \t\r\n").lower() for x in row.value[1:].split("\t")]
    return []


def _rows(spark: SparkSession, path: str, least: int, where: Callable[[Column], Column]) -> DataFrame:
    """(parts, file, block, line) of the lines that aren't comments, have enough fields and hold `where` of them: the
    fields, the file and split that a line is from, and its number in the task that reads it, which grows along a split."""
    lines = _lines(spark, path).select(F.split("value", "\t", -1).alias("parts"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").startswith("#").alias("comment"))
    return lines.filter(~F.col("comment") & (F.size("parts") >= least) & where(F.col("parts"))).select("parts", "file", "block", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("line"))


def in_order(rows: DataFrame) -> DataFrame:
    """rows of (file, block, line, ...) with pos for these three: positions 0 to n - 1 by file, in the order of their
    names, and by place in the file. rows is written once and numbered from what was written.

    Splits are counted, running sums over the splits, a row for each, are their offsets, and in a split a row's number is
    its line less the split's first one: no sort or window over rows.
    """
    table = materialize(rows, "lines")
    splits = table.groupBy("file", "block").agg(F.count("*").alias("_n"), F.min("line").alias("_first"))
    before = F.sum("_n").over(Window.orderBy("file", "block")) - F.col("_n")
    splits = splits.select(F.col("file").alias("_file"), F.col("block").alias("_block"), (before - F.col("_first")).alias("_shift"))
    out = table.join(splits, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")))
    rest = [c for c in rows.columns if c not in ("file", "block", "line")]
    return out.select((F.col("line") + F.col("_shift")).alias("pos"), *rest)


def _getter(names: list[str]) -> Callable[[str], Column]:
    """The raw field of a name, wherever it stands; a name that isn't there is null throughout."""

    def get(name: str) -> Column:
        return F.get(F.col("parts"), F.lit(names.index(name))) if name in names else F.lit(None).cast("string")

    return get


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """The object catalog: rows with a key and 10 fields at least, cleaned, with their positions 0 to n - 1 in it (pos);
    no vehicle yet. Without a header: empty."""
    names = header(spark, path, 10)
    get = _getter(names)
    key = clean(get("jcat"))
    rows = _rows(spark, path, 10, lambda _: key.isNotNull()) if names else _rows(spark, path, 10, lambda _: F.lit(False))
    launch = iso_date(get("ldate"))
    out = rows.select(
        "file",
        "block",
        "line",
        key.alias("jcat"),
        catalog_number(get("satcat")).alias("satno"),
        F.coalesce(clean(get("name")), key).alias("name"),
        clean(get("plname")).alias("pl_name"),
        clean(get("launch_tag")).alias("launch_tag"),
        launch.alias("ldate"),
        launch.try_cast("date").alias("launch_date"),
        clean(get("owner")).alias("owner"),
        clean(get("state")).alias("state"),
        object_class(get("type")).alias("object_class"),
        clean(get("type")).alias("obj_type"),
        orbit_class(get("oporbit")).alias("op_orbit"),
        clean(get("status")).alias("sat_state"),
        number(get("mass")).alias("mass_kg"),
        number(get("apogee")).alias("apogee_km"),
        number(get("perigee")).alias("perigee_km"),
        number(get("inc")).alias("inc_deg"),
        F.lit(None).cast("double").alias("period_min"),
        clean(get("ddate")).alias("decay_date"),
    )
    return in_order(out)


def last_wins(rows: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """One row a key: the content of the last, the place of the first. A key of very many rows is summed in its tasks."""
    content = [c for c in rows.columns if c not in (key, pos)]
    out = rows.groupBy(key).agg(F.max_by(F.struct(*content), F.col(pos)).alias("_last"), F.min(pos).alias(pos))
    return out.select(pos, key, *[F.col(f"_last.{c}").alias(c) for c in content])


def read_launches(spark: SparkSession, path: str) -> DataFrame:
    """The launch table: rows with a tag and 5 fields at least, cleaned, one a tag (last_wins) with the position of its
    first row."""
    names = header(spark, path, 5)
    get = _getter(names)
    tag = clean(get("launch_tag"))
    rows = _rows(spark, path, 5, lambda _: tag.isNotNull()) if names else _rows(spark, path, 5, lambda _: F.lit(False))
    vehicle, launch = clean(get("lv_type")), iso_date(get("launch_date"))
    out = rows.select("file", "block", "line", tag.alias("launch_tag"), vehicle.alias("lv"), vehicle_family(vehicle).alias("lv_family"), clean(get("launch_site")).alias("site"), launch.alias("ldate"), launch.try_cast("date").alias("launch_date"), is_orbital(trimmed(get("launchcode"))).alias("orbital"))
    return last_wins(in_order(out), "launch_tag")


def enrich(objects: DataFrame, launches: DataFrame) -> DataFrame:
    """objects with lv, lv_family and site of their launch; null where it isn't known. Spark broadcasts launches where
    their size allows it, and else sorts both sides and splits tags of very many objects."""
    bare = objects.drop("lv", "lv_family", "site")
    return bare.join(launches.select("launch_tag", "lv", "lv_family", "site"), "launch_tag", "left")


def write_silver(objects: DataFrame, launches: DataFrame, folder: str) -> None:
    """Both tables as Parquet, objects by launch year, so that year filters read their years only."""
    years = objects.withColumn("launch_year", year_number(F.col("ldate")))
    years.repartition("launch_year", F.pmod(F.xxhash64("jcat"), F.lit(8))).write.mode("overwrite").partitionBy("launch_year").parquet(f"{folder}/objects")
    launches.write.mode("overwrite").parquet(f"{folder}/launches")


def read_silver(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/objects"), spark.read.parquet(f"{folder}/launches")


def enrich_bucketed(spark: SparkSession, name: str) -> DataFrame:
    """enrich() of the tables that write_bucketed() made: both are bucketed by the join's keys, so nothing is shuffled."""
    objects, launches = spark.table(f"{name}_objects"), spark.table(f"{name}_launches")
    return objects.join(launches, ["launch_tag", "tag_part"], "left").drop("tag_part")


def write_bucketed(objects: DataFrame, launches: DataFrame, name: str, folder: str | None = None, buckets: int = 64, hot: float = 0.002, parts: int = 64) -> None:
    """Tables <name>_objects and <name>_launches (in a folder, or the warehouse), both in `buckets` buckets by launch tag and
    part. A tag that holds a larger
    share of all objects than `hot` is cut into `parts` parts, and its launch has a row for each, so that no bucket has
    all objects of one tag; there are 1 / hot such tags at most, and they are all that is broadcast."""
    bare = objects.drop("lv", "lv_family", "site", "tag_part", "_hot")
    counts = bare.groupBy("launch_tag").agg(F.count("*").alias("n")).filter("launch_tag is not null")
    total = bare.agg(F.count("*").alias("total"))
    large = materialize(counts.join(F.broadcast(total)).filter(F.col("n") > F.greatest(F.lit(1), F.col("total") * hot)).select(F.col("launch_tag").alias("_hot")), "hot")
    # objects without a tag match nothing, wherever they are
    part = F.when(F.col("_hot").isNotNull() | F.col("launch_tag").isNull(), F.pmod(F.xxhash64(*bare.columns), F.lit(parts))).otherwise(0).cast("int")
    marked = bare.join(F.broadcast(large), F.col("launch_tag") == F.col("_hot"), "left").withColumn("tag_part", part).drop("_hot")
    known = launches.select("launch_tag", "lv", "lv_family", "site").join(F.broadcast(large), F.col("launch_tag") == F.col("_hot"), "left")
    every = F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    known = known.withColumn("tag_part", F.explode(every)).drop("_hot")
    for rows, table in ((marked, "objects"), (known, "launches")):
        out = rows.repartition(buckets, "launch_tag", "tag_part").write.mode("overwrite").bucketBy(buckets, "launch_tag", "tag_part").sortBy("launch_tag", "tag_part")
        (out.option("path", f"{folder}/{table}") if folder else out).saveAsTable(f"{name}_{table}")


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def document(rows: DataFrame, name: str = "data") -> DataFrame:
    """One JSON document a row set of bounded size (a page, a top-k): its rows as an array in order."""
    return rows.agg(F.collect_list(F.struct("*")).alias(name)).select(F.to_json(F.struct(name)).alias("json"))
