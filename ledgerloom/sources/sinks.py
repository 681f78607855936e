"""Writing batches: idempotent upserts, per-batch replacement, append-only audit."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = ("order_matches", "bank_matches", "exceptions", "run_metrics", "rule_audit", "rule_proposals", "rules")
# What the store's enumerations may hold.
ENUMERATIONS = {
    "match_kind": ("exact", "rule", "assignment", "subset_sum", "llm_resolved"),
    "resolved_by": ("deterministic", "hungarian", "mincostflow", "subset_sum", "llm"),
    "status": ("open", "resolved", "escalated"),
    "record_type": ("order", "settlement", "bank_credit"),
}
ORDER_STATUS = ("captured", "refunded_partial", "refunded_full")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Only a local master, where they are one process, gets a folder of its own
    instead; elsewhere a missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.conf.set("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="ledgerloom-"))
    return spark.conf.get("spark.checkpoint.dir")


def kept(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back, so that a lost executor costs a re-read."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/ledgerloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._ledgerloom_path = path
    return out


def drop_kept(df: DataFrame) -> None:
    """Delete a table of ``kept`` that nothing reads any more."""
    if path := getattr(df, "_ledgerloom_path", None):
        delete_path(df.sparkSession, path)


def drop_all_kept(spark: SparkSession) -> None:
    """Delete all that this application has kept, once none of its results is read any more."""
    delete_path(spark, f"{shared_folder(spark)}/ledgerloom-{spark.sparkContext.applicationId}")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows by key, the last loaded one winning; within ``new`` a later file replaces an earlier one by ``load_seq``."""
    both = old.withColumn("_load", F.lit(-1).cast("bigint")).unionByName(new.withColumn("_load", F.col("load_seq").cast("bigint") if "load_seq" in new.columns else F.lit(0).cast("bigint")).drop("load_seq"))
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_load"), F.xxhash64(*[c for c in old.columns])))
    return both.withColumn("_rank", last).where("_rank = 1").drop("_rank", "_load")


def checked(df: DataFrame) -> DataFrame:
    """The rows, or an error at run time for a value outside its enumeration (a store without constraints has no other guard)."""
    for name, allowed in ENUMERATIONS.items():
        allowed = ORDER_STATUS if name == "status" and "order_id" in df.columns else allowed
        if name in df.columns:
            good = F.col(name).isNull() | F.col(name).isin(*allowed)
            df = df.withColumn(name, F.when(good, F.col(name)).otherwise(F.raise_error(F.concat(F.lit(f"{name} can't be "), F.col(name))).cast("string")))
    return df


def replace_batches(df: DataFrame, path: str, batches: Sequence[str] | None = None) -> None:
    """Write outputs; the batches that ``df`` holds replace their earlier runs, other batches stay.

    ``batches`` names the batches that were run: one without any row now loses
    the rows of its earlier run, too.
    """
    spark = df.sparkSession
    checked(df).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)
    if batches:
        written = {str(r[0]) for r in df.select("batch_id").distinct().collect()}  # a row for each batch
        for batch in sorted(set(map(str, batches)) - written):
            name = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(batch)
            delete_path(spark, f"{path}/batch_id={name}")


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any store that Spark can write."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def reset_store(spark: SparkSession, out: str) -> None:
    """Drop all output tables of a store; the next run starts from the seed library."""
    for name in TABLES:
        delete_path(spark, f"{out}/{name}")


def append_audit(spark: SparkSession, rows: Sequence[tuple[str, str, str]], path: str) -> None:
    """Append (event, fingerprint, detail JSON) rows; nothing is ever changed."""
    spark.createDataFrame(rows, "event string, fingerprint string, detail_json string").withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)
