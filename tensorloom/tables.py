"""Tables in the folder that driver and executors share: they cut long lineages and survive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder (single-machine tests).
FALLBACK = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; an error where a cluster names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (found or FALLBACK).rstrip("/")


#: Tables written so far, oldest first.
_made: list[str] = []


def made() -> int:
    """How many tables there are; for drop_between()."""
    return len(_made)


def drop_between(spark: SparkSession, first: int, last: int) -> None:
    """Deletes the tables written from the first-th up to the last-th: only where nothing that reads them is still to run."""
    for path in _made[first:last]:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again; the files go when the application ends, if drop_between() does not delete them before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tensorloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)
