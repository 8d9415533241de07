"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession

#: Without a setting a session on one machine (tests, notebooks) keeps tables between steps here.
LOCAL_DIR = "file:///tmp/checkpoints/orrery"
_TABLES: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below spark.checkpoint.dir. Where that is unset, a folder of this machine serves a local master
    only: executors elsewhere would each write to their own disk."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = LOCAL_DIR
    if base.startswith("/"):
        base = f"file://{base}"
    elif base.startswith("file:/") and not base.startswith("file:///"):
        base = "file:///" + base[len("file:/") :]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def temporary_dir(spark: SparkSession, name: str) -> str:
    """A new shared folder name that is deleted when the program ends."""
    path = shared_dir(spark, name)
    _TABLES[path] = spark
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends at files that outlive any executor. They are
    deleted when the program ends."""
    path = temporary_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    with suppress(Exception):  # the session may have ended; what is left over does no harm
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _delete_all() -> None:
    for path, spark in list(_TABLES.items()):
        delete(spark, path)
