"""Substring search over names by a posting table of trigrams."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.explore import search
from orrery.operators.ranks import ranked, spread_over

#: Characters of a gram, rows of a block of neighbours, folders that grams are spread over.
GRAM, EACH, BUCKETS = 3, 8192, 64
#: Blocks of an index at most, which then hold more rows each.
MOST_BLOCKS = 1024


def texts(objects: DataFrame) -> list[Column]:
    """What a search looks into, in lower case."""
    return [F.lower(c) for c in ("name", "pl_name", "jcat")] + [F.col("satno").cast("string")]


def grams(held: DataFrame) -> DataFrame:
    """(block, gram), each once, from (block, text): the runs of GRAM characters; null and shorter texts have none."""
    places = held.filter(F.length("text") >= GRAM).select("block", "text", F.explode(F.sequence(F.lit(1), F.length("text") - (GRAM - 1))).alias("at"))
    return places.select("block", F.substring("text", F.col("at"), F.lit(GRAM)).alias("gram")).distinct()


def _bucket(gram: str) -> int:
    return zlib.crc32(gram.encode()) % BUCKETS


def write_index(objects: DataFrame, folder: str, tie: str = "pos", each: int = EACH) -> None:
    """objects in blocks of `each` neighbours in the order of `tie`, or of more where these would be over MOST_BLOCKS, a
    folder each, and (gram, block) for every gram of a block's texts, spread over BUCKETS folders and sorted."""
    rows = ranked(objects.drop("_place", "block"), [F.col(tie)], name="_place")
    each = spread_over(rows.count(), each, MOST_BLOCKS)
    rows = rows.withColumn("block", F.floor(F.col("_place") / F.lit(each))).drop("_place")
    rows.repartition("block").sortWithinPartitions("block").write.mode("overwrite").partitionBy("block").parquet(f"{folder}/rows")
    rows = rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/rows")
    # a block's grams are summed up where it is read; of texts that its rows share each is cut once, keys are all different
    key, others = texts(rows)[2], [t for i, t in enumerate(texts(rows)) if i != 2]
    shared = rows.select("block", F.explode(F.array(*others)).alias("text")).distinct()
    found = grams(shared.unionByName(rows.select("block", key.alias("text"))))
    found = found.withColumn("bucket", (F.crc32(F.col("gram").cast("binary")) % BUCKETS).cast("int"))
    found.repartitionByRange("bucket", "gram").sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/grams")


def search_index(spark: SparkSession, folder: str, text: str = "") -> DataFrame:
    """The rows of explore.search() on the indexed objects. Only blocks that hold all grams of the text are read, and what
    they hold is confirmed; a text of fewer than GRAM characters is searched everywhere."""
    rows, needle = spark.read.parquet(f"{folder}/rows"), text.lower().strip()
    wanted = sorted({needle[i : i + GRAM] for i in range(len(needle) - GRAM + 1)})
    if wanted:
        held = spark.read.parquet(f"{folder}/grams").filter(F.col("bucket").isin(sorted({_bucket(g) for g in wanted})) & F.col("gram").isin(wanted))
        blocks = held.groupBy(F.col("block").alias("_block")).agg(F.count("*").alias("n")).filter(F.col("n") == len(wanted)).select("_block")
        rows = rows.join(F.broadcast(blocks), F.col("block") == F.col("_block"), "left_semi")  # MOST_BLOCKS numbers at most
    return search(rows, text).drop("block")
