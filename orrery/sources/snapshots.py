"""Silver by difference: snapshots of a catalog that share the years that didn't change.

A folder holds data/<snapshot>/part=<year>, snapshots/<snapshot> (a row for each year: number of rows, digest, path) and
CURRENT, a file with the name of the snapshot that readers take. A new snapshot writes only the years whose rows differ
and names the old paths of the others; CURRENT is replaced last, in one step, so that readers have the old snapshot or
the new one, whatever happens meanwhile. Old paths are never written to.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.dates import year_number
from orrery.sources.shared import materialize

#: The part of objects without a launch year, and of the launch table.
NO_YEAR, LAUNCHES = "none", "launches"
PARTS = "part string, rows long, digest string, path string"


def row_digest(rows: DataFrame, leave: tuple[str, ...] = ()) -> Column:
    """A hash of a row's columns by name, nulls included."""
    names = sorted(c for c in rows.columns if c not in leave)
    return F.xxhash64(*[x for c in names for x in (F.col(c), F.col(c).isNull())])


def _parted(objects: DataFrame, launches: DataFrame) -> tuple[DataFrame, DataFrame]:
    year = F.coalesce(year_number(F.col("ldate")).cast("string"), F.lit(NO_YEAR))
    return objects.withColumn("part", year), launches.withColumn("part", F.lit(LAUNCHES))


def _digests(rows: DataFrame) -> DataFrame:
    """(part, rows, digest): sums of row digests, which no order changes and equal rows don't cancel."""
    marked = rows.select("part", row_digest(rows, ("part",)).alias("d"))
    return marked.groupBy("part").agg(F.count("*").alias("rows"), F.concat_ws(":", F.sum(F.col("d").cast("decimal(38,0)")).cast("string"), F.bit_xor("d").cast("string")).alias("digest"))


def current(spark: SparkSession, folder: str) -> str | None:
    """The name of the snapshot that readers take; None where there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(f"{folder}/CURRENT")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.text(f"{folder}/CURRENT").first()[0].strip()


def _point(spark: SparkSession, folder: str, name: str) -> None:
    """CURRENT names the snapshot from now on: a file written beside it takes its place."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    new, place = hadoop.Path(f"{folder}/CURRENT-{uuid.uuid4().hex}"), hadoop.Path(f"{folder}/CURRENT")
    out = new.getFileSystem(conf).create(new, True)
    out.write(bytearray(f"{name}\n".encode()))
    out.close()
    context = hadoop.FileContext.getFileContext(place.getFileSystem(conf).getUri(), conf)
    over = spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(new, place, over)


def parts(spark: SparkSession, folder: str, name: str | None = None) -> DataFrame:
    """PARTS of a snapshot (None: the current one); empty without one."""
    name = name or current(spark, folder)
    return spark.read.schema(PARTS).parquet(f"{folder}/snapshots/{name}") if name else spark.createDataFrame([], PARTS)


def update(objects: DataFrame, launches: DataFrame, folder: str, each: int = 1_000_000) -> dict[str, list[str]]:
    """Make the tables the current snapshot of the folder; returns the parts that were changed, added and removed. Where
    nothing differs, nothing is written. Years are compared by digests of their rows, so the order of rows is none; a
    changed year is written in files of some `each` rows. Both tables are read twice: what is derived by joins had better be
    materialized before."""
    spark, old = objects.sparkSession, {r.part: r for r in parts(objects.sparkSession, folder).collect()}
    tables = _parted(objects, launches)
    new = {r.part: r for t in tables for r in _digests(t).collect()}  # a row for each year
    differ = lambda k: k in old and (old[k].rows, old[k].digest) != (new[k].rows, new[k].digest)
    found = {"changed": sorted(k for k in new if differ(k)), "added": sorted(new.keys() - old.keys()), "removed": sorted(old.keys() - new.keys())}
    write, name = found["changed"] + found["added"], uuid.uuid4().hex
    if not any(found.values()):
        return found
    for rows in tables:
        own = rows.filter(F.col("part").isin(write)) if write else rows.limit(0)
        spread = F.pmod(F.xxhash64("launch_tag", *(["jcat"] if "jcat" in rows.columns else [])), F.lit(max(1, -(-max([new[k].rows for k in write] or [1]) // each))))
        own.repartition("part", spread).write.mode("append").partitionBy("part").parquet(f"{folder}/data/{name}")
    listed = [(k, r.rows, r.digest, f"{folder}/data/{name}/part={k}" if k in write else old[k].path) for k, r in new.items()]
    spark.createDataFrame(listed, PARTS).coalesce(1).write.parquet(f"{folder}/snapshots/{name}")
    _point(spark, folder, name)
    return found


def read(spark: SparkSession, folder: str, years: list[str] | None = None, name: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(objects, launches) of a snapshot (None: the current one); of years, only their parts are read."""
    listed = {r.part: r.path for r in parts(spark, folder, name).collect()}
    if LAUNCHES not in listed and not listed:
        raise ValueError(f"no snapshot in {folder}")
    wanted = [p for k, p in listed.items() if k != LAUNCHES and (years is None or k in years)]
    other = [p for k, p in listed.items() if k != LAUNCHES]
    objects = spark.read.parquet(*(wanted or other or [listed[LAUNCHES]]))
    launches = spark.read.parquet(listed[LAUNCHES]) if LAUNCHES in listed else objects.limit(0)
    return (objects if wanted else objects.limit(0)), launches


def changes(old: DataFrame, new: DataFrame, key: str = "jcat") -> DataFrame:
    """(key, change): keys that were added, removed or changed between two tables, by digests of their rows. Rows that
    share a key are compared as one."""
    side = lambda rows, name: rows.select(F.col(key), row_digest(rows, (key,)).alias("d")).groupBy(key).agg(F.concat_ws(":", F.count("*"), F.sum(F.col("d").cast("decimal(38,0)")).cast("string")).alias(name))
    both = side(materialize(old, "old"), "before").withColumnRenamed(key, "_old").join(side(new, "after"), F.col("_old").eqNullSafe(F.col(key)), "full_outer")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "changed")
    return both.select(F.coalesce(key, "_old").alias(key), change.alias("change")).filter("change is not null")
