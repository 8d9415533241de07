"""The catalog explorer: search, filters, sorting and pages."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.ranks import ranked, spread_over

SORTABLE = ("jcat", "satno", "name", "pl_name", "ldate", "lv", "lv_family", "site", "owner", "state", "object_class", "obj_type", "op_orbit", "sat_state", "mass_kg", "apogee_km", "perigee_km", "inc_deg")
MOST, USUAL = 500, 50
#: Rows of a file of sorted pages; files of a directory at most, which then hold more rows each.
EACH, MOST_FILES = 100_000, 1024


def page_arguments(page: object = 1, limit: object = USUAL) -> tuple[int, int]:
    """page 1 at least, limit 1 to 500, from the whole number that an argument begins with; 0 and what begins with none
    are page 1 and limit 50."""

    def number(x: object) -> int:
        found = re.match(r"\s*([+-]?[0-9]+)", str(x))
        return int(found[1]) if found else 0

    return max(1, number(page) or 1), min(MOST, max(1, number(limit) or USUAL))


def search(objects: DataFrame, text: str = "") -> DataFrame:
    """Rows whose name, payload name, key or catalog number holds the text, case ignored; % and _ are characters."""
    text = text.lower().strip()
    if not text:
        return objects
    found = F.lit(False)
    for c in ("name", "pl_name", "jcat"):
        found = found | F.coalesce(F.lower(c).contains(text), F.lit(False))
    return objects.filter(found | F.coalesce(F.col("satno").cast("string").contains(text), F.lit(False)))


def matching(objects: DataFrame, text: str = "", equal: Mapping[str, str | None] | None = None) -> DataFrame:
    """search() and equality on any columns; empty and None don't filter. Equalities reach a Parquet scan."""
    for name, value in (equal or {}).items():
        if value is not None and str(value).strip():
            objects = objects.filter(F.col(name) == str(value).strip())
    return search(objects, text)


def sort_key(objects: DataFrame, field: str, collation: str | None = "UNICODE") -> Column:
    c = F.col(field)
    return F.collate(c, collation) if collation and objects.schema[field].dataType.typeName() == "string" else c


def ordered(objects: DataFrame, field: str = "ldate", order: str = "desc", tie: str = "pos", collation: str | None = "UNICODE") -> DataFrame:
    """By a sortable field (others: ldate), nulls last in both directions, then by the source's order."""
    return objects.orderBy(*_order(objects, field, order, tie, collation))


def _order(objects: DataFrame, field: str, order: str, tie: str, collation: str | None) -> tuple[Column, Column]:
    key = sort_key(objects, sortable(objects, field), collation)
    return key.desc_nulls_last() if order == "desc" else key.asc_nulls_last(), F.col(tie).asc()


def sortable(objects: DataFrame, field: str) -> str:
    return field if field in SORTABLE and field in objects.columns else "ldate"


def explore(objects: DataFrame, text: str = "", equal: Mapping[str, str | None] | None = None, sort: str = "ldate", order: str = "desc", page: object = 1, limit: object = USUAL, tie: str = "pos", collation: str | None = "UNICODE") -> tuple[DataFrame, DataFrame]:
    """A page of the matching rows, and one row (total, page, limit, pages, first, last). A page past the end is empty.

    A low page takes a top-k; for deep ones see page_after(), which sorts nothing before them, and read_page(), which jumps.
    """
    page, limit = page_arguments(page, limit)
    rows = matching(objects, text, equal)
    out = ordered(rows, sort, order, tie, collation).offset((page - 1) * limit).limit(limit)
    return out, _range_shown(rows.agg(F.count("*").alias("total")), page, limit)


def _range_shown(total: DataFrame, page: int, limit: int) -> DataFrame:
    return total.select(
        "total",
        F.lit(page).alias("page"),
        F.lit(limit).alias("limit"),
        F.ceil(F.col("total") / limit).alias("pages"),
        F.when(F.col("total") > (page - 1) * limit, F.lit((page - 1) * limit + 1)).otherwise(0).alias("first"),
        F.when(F.col("total") > (page - 1) * limit, F.least(F.col("total"), F.lit(page * limit))).otherwise(0).alias("last"),
    )


def page_after(objects: DataFrame, field: str, order: str, last_value: object, last_tie: int, limit: object = USUAL, tie: str = "pos", collation: str | None = "UNICODE") -> DataFrame:
    """The page after a row known by its sort value and tie, in the order of explore(), without a sort of what comes
    before it. last_value None stands for the nulls at the end."""
    limit, field = page_arguments(1, limit)[1], sortable(objects, field)
    key, end = sort_key(objects, field, collation), F.col(tie) > last_tie
    if last_value is None:
        later = key.isNull() & end
    else:
        last = F.lit(last_value).cast(objects.schema[field].dataType)
        last = F.collate(last, collation) if collation and objects.schema[field].dataType.typeName() == "string" else last
        later = key.isNull() | (key < last if order == "desc" else key > last) | ((key == last) & end)
    return ordered(objects.filter(later), field, order, tie, collation).limit(limit)


def write_pages(objects: DataFrame, folder: str, field: str = "ldate", order: str = "desc", tie: str = "pos", collation: str | None = "UNICODE", each: int = EACH) -> None:
    """A directory of pages: objects in the order of explore(), sorted once by ranges, with their places in it (place), in
    files of `each` rows, or of more where these would be over MOST_FILES; a file's name says which. read_page() then reads
    one or two files for any page."""
    rows = ranked(objects.drop("place", "file"), _order(objects, field, order, tie, collation), name="place")
    total = rows.count()
    each = spread_over(total, each, MOST_FILES)
    rows.sparkSession.range(1, numPartitions=1).select(F.lit(total).cast("long").alias("total"), F.lit(each).alias("each")).write.mode("overwrite").parquet(f"{folder}/total")
    filed = rows.withColumn("file", F.floor(F.col("place") / F.lit(each)))
    filed.repartition("file").sortWithinPartitions("file", "place").write.mode("overwrite").partitionBy("file").parquet(f"{folder}/rows")


def read_page(spark: SparkSession, folder: str, page: object = 1, limit: object = USUAL) -> tuple[DataFrame, DataFrame]:
    """A page of all objects and the row of its range, as explore() gives them, from a directory of pages."""
    page, limit = page_arguments(page, limit)
    total = spark.read.parquet(f"{folder}/total")
    each, first = total.first()["each"], (page - 1) * limit
    rows = spark.read.parquet(f"{folder}/rows")
    rows = rows.filter(F.col("file").between(first // each, (first + limit - 1) // each) & F.col("place").between(first, first + limit - 1))
    return rows.orderBy("place").drop("place", "file"), _range_shown(total.select("total"), page, limit)
