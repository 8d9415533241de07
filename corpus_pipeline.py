"""A corpus in five stages: quality rules, near duplicates, personal data, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. All but the last return the
columns of documents, whatever others docs has. Nulls in any column, empty and very long texts, repeated rows and empty
tables are fine in each; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import byte_bpe, minhash, mixing, pii, quality
from orrery.llm.common import discard, materialize, released


def _table_of(spark: SparkSession, path: str) -> DataFrame | None:
    """A table, None where there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the perplexity bands reject go: null and empty texts do, as they have under 50 words.
    Models and bands are of all texts that the table of labels calls good, or of all where there is no such table."""
    return quality.accepted(docs, labels=_table_of(spark, f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.8 and more stays, that of the smallest id; rows that share an id or have
    none are told apart by their texts. Texts without words stay."""
    return minhash.without_near_duplicates(docs, percent=80)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span becomes <KIND>, and n_chars follows the text; null texts stay null."""
    out = pii.masked(docs, pii.trained_field(spark))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, 0 to 3 times; a null source is one of its own, the last."""
    return mixing.mixture(docs, weights=(5, 2, 1), share=1.0, most=3)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, checked to decode to the text itself; null and empty texts have none."""
    coded = byte_bpe.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded_col="decoded", piece=1 << 20)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", drop_low_quality),
    ("near duplicates", drop_near_duplicates),
    ("personal data", mask_personal_data),
    ("source mix", mix_sources),
    ("token ids", encode_texts),
]

#: Models and hashes that SQL can't express decide; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, in a table. Each stage's own tables, and the stage before it, go when it is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        with released() as keep:
            docs = keep(materialize(stage(spark, docs, sf_dir), "stage"))
        if before is not None:
            discard(before)
        before = docs
    return docs
