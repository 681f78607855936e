"""Scores against hidden truth.  The only module that reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config


TRUTH_SCHEMA = "order_id string, settlement_txn_id string, utr string, case_type string, trap_type string"


def read_truth(spark: SparkSession, path: str, batch_id: str) -> DataFrame:
    """A batch's truth file; empty fields are null."""
    return spark.read.csv(path, schema=TRUTH_SCHEMA, header=True, mode="FAILFAST").withColumn("batch_id", F.lit(batch_id))


def truth_pairs(truth: DataFrame) -> DataFrame:
    """(batch_id, kind, left, right) of true links: orders to settlements, credits to settlements."""
    orders = truth.where("order_id NOT IN ('ORPHAN', 'UNSETTLED') AND settlement_txn_id NOT IN ('ORPHAN', 'UNSETTLED')").select("batch_id", F.lit("order").alias("kind"), F.col("order_id").alias("left_id"), F.col("settlement_txn_id").alias("right_id"))
    bank = truth.where("utr NOT IN ('', 'ORPHAN', 'UNSETTLED') AND utr <> settlement_txn_id AND settlement_txn_id NOT IN ('ORPHAN', 'UNSETTLED')").select("batch_id", F.lit("bank").alias("kind"), F.col("utr").alias("left_id"), F.col("settlement_txn_id").alias("right_id"))
    return orders.unionByName(bank).distinct()


def score_batches(matches: DataFrame, exceptions: DataFrame, truth: DataFrame, config: Config) -> DataFrame:
    """One row per batch: precision, recall, false positives (per match row), cost and money at risk.

    ``matches`` has (batch_id, kind, left_id, right_id, money).
    """
    keys = ["batch_id", "kind", "left_id", "right_id"]
    claimed = matches.groupBy(*keys).agg(F.count("*").alias("rows"), F.sum("money").alias("money"))
    both = claimed.join(truth_pairs(truth).withColumn("true", F.lit(True)), keys, "full")
    is_claim, is_true = F.col("rows").isNotNull(), F.col("true").isNotNull()
    wrong = is_claim & ~is_true
    links = both.groupBy("batch_id").agg(
        F.count_if(is_claim).alias("claimed"), F.count_if(is_claim & is_true).alias("correct"), F.count_if(is_true).alias("true_pairs"), F.sum(F.when(wrong, F.col("rows"))).alias("false_positives"), F.sum(F.when(wrong, F.col("money"))).alias("false_money")
    ).where("true_pairs > 0")
    opened = exceptions.groupBy("batch_id").agg(F.count("*").alias("open_exceptions"), F.sum("money_at_risk_paise").alias("open_money"))
    out = links.join(opened, "batch_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    share = lambda a, b: F.when(zero(b) > 0, F.round(zero(a) / zero(b), 6)).otherwise(0.0)
    return out.select(
        "batch_id", share("correct", "claimed").alias("precision"), share("correct", "true_pairs").alias("recall"), zero("false_positives").alias("false_positives"), zero("open_exceptions").alias("open_exceptions"),
        (config.false_positive_cost * zero("false_positives") + config.exception_cost * zero("open_exceptions")).alias("cost"), (zero("open_money") + zero("false_money")).alias("money_at_risk_paise"),
    )


def false_positives_by_case(matches: DataFrame, truth: DataFrame) -> DataFrame:
    keys = ["batch_id", "kind", "left_id", "right_id"]
    wrong = matches.join(truth_pairs(truth), keys, "left_anti").withColumnRenamed("right_id", "settlement_txn_id")
    return wrong.join(truth.select("settlement_txn_id", "case_type").distinct(), "settlement_txn_id", "left").groupBy("case_type").agg(F.count("*").alias("false_positives"))


def latest_runs(runs: DataFrame) -> DataFrame:
    """The last run (largest ``run_id``) of each batch."""
    return runs.groupBy("batch_id").agg(F.max_by(F.struct("*"), "run_id").alias("run")).select("run.*")


def learning_curve(scores: DataFrame) -> DataFrame:
    """Scores of numbered batches in their order; named ones (adversarial sets) aside."""
    return scores.where(F.col("batch_id").rlike("^[0-9]+$")).orderBy(F.col("batch_id").cast("int"))
