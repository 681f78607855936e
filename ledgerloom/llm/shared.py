"""Shared-storage helpers: tables that outlive a lost executor."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Only a local master, where they are one process, gets a folder of its own
    instead (tests); elsewhere a missing setting is an error.
    """
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.conf.set("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="ledgerloom-"))
    return spark.conf.get("spark.checkpoint.dir")


def write_table(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder as Parquet and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgerloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._ledgerloom_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete a table of ``write_table`` once nothing reads it any more."""
    if path := getattr(df, "_ledgerloom_path", None):
        _delete(df.sparkSession, path)


def drop_all_tables(spark: SparkSession) -> None:
    """Delete all tables that this application has written, once none of its results is read any more."""
    _delete(spark, f"{shared_dir(spark)}/ledgerloom-{spark.sparkContext.applicationId}")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    with contextlib.suppress(Exception):
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
