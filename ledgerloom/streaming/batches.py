"""An extension: batches as they arrive, with Structured Streaming.

Directories of settlement Parquet files are a stream; every micro-batch's
settlements are aggregated by payout group with a watermark, or handed to a
function that reconciles whole batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def settlement_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def payout_totals(stream: DataFrame, lateness: str = "7 days") -> DataFrame:
    """Running sums of payout groups; a group closes once no settlement of its day can still come."""
    timed = stream.withColumn("settled_at", F.col("settled_date").cast("timestamp"))
    return timed.withWatermark("settled_at", lateness).groupBy(F.window("settled_at", "1 day"), "batch_id", "settlement_batch_id").agg(F.sum("net_amount_paise").alias("net_total"), F.count("*").alias("members"))


def reconcile_stream(stream: DataFrame, reconcile: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Call ``reconcile(rows, number)`` for every micro-batch; it must replace what it wrote for the same batch ids."""
    return stream.writeStream.foreachBatch(reconcile).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
