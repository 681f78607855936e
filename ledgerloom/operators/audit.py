"""Contract audit: what was charged against what was agreed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.money import RATE, by_instrument, contract_fee


def audited(orders: DataFrame, settlements: DataFrame) -> DataFrame:
    """Settlements of captured orders with a positive gross that alone claim their order (within the batch)."""
    sole = settlements.groupBy("batch_id", "order_id_claimed").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("settlement_txn_id", "gross_amount_paise", "mdr_paise", "gst_on_mdr_paise", "net_amount_paise", "instrument", "settled_date")])
    captured = orders.where("status = 'captured'").select("batch_id", F.col("order_id").alias("order_id_claimed"))
    return sole.where("n = 1 AND gross_amount_paise > 0").join(captured, ["batch_id", "order_id_claimed"], "left_semi")


def with_leakage(population: DataFrame, config: Config) -> DataFrame:
    """Charged, agreed and leaked paise; differences within the noise are none."""
    agreed = contract_fee(F.col("gross_amount_paise"), F.col("instrument"), config)
    diff = F.col("charged") - F.col("agreed")
    df = population.withColumn("charged", F.col("gross_amount_paise") - F.col("net_amount_paise")).withColumn("agreed", agreed).where("agreed IS NOT NULL")
    return df.withColumn("leaked", F.when(F.abs(diff) <= config.noise_paise, F.lit(0).cast("bigint")).otherwise(diff))


def _sums() -> list[Column]:
    return [
        F.count("*").alias("transactions"), F.coalesce(F.sum("charged"), F.lit(0)).alias("charged_paise"), F.coalesce(F.sum("agreed"), F.lit(0)).alias("agreed_paise"), F.coalesce(F.sum("leaked"), F.lit(0)).alias("leaked_paise"),
        F.count_if(F.col("leaked") > 0).alias("overcharged"), F.count_if(F.col("leaked") < 0).alias("undercharged"), F.coalesce(F.sum(F.greatest("leaked", F.lit(0))), F.lit(0)).alias("gross_leaked_paise"),
    ]


def leakage_by_instrument(orders: DataFrame, settlements: DataFrame, config: Config) -> DataFrame:
    return with_leakage(audited(orders, settlements), config).groupBy("instrument").agg(*_sums())


def leakage_total(orders: DataFrame, settlements: DataFrame, config: Config) -> DataFrame:
    return with_leakage(audited(orders, settlements), config).groupBy("batch_id").agg(*_sums())


def worst_offenders(orders: DataFrame, settlements: DataFrame, config: Config, top: int = 10) -> DataFrame:
    rows = with_leakage(audited(orders, settlements), config).where("leaked > 0")
    return rows.orderBy(F.desc("leaked"), "settlement_txn_id").limit(top).select("settlement_txn_id", "instrument", "gross_amount_paise", "charged", "agreed", "leaked")


def observed_schedule(orders: DataFrame, settlements: DataFrame, config: Config, least: int = 3) -> DataFrame:
    """The fee each instrument was really charged, as a rate or a flat amount, whichever varies less."""
    rows = audited(orders, settlements).withColumn("deducted", F.col("gross_amount_paise") - F.col("net_amount_paise")).withColumn("ratio", F.col("deducted") / F.col("gross_amount_paise"))
    told = rows.groupBy("batch_id", "instrument").agg(
        F.count("*").alias("n"), F.stddev_pop("ratio").alias("ratio_spread"), (F.stddev_pop("deducted") / F.avg("gross_amount_paise")).alias("flat_spread"), F.median("ratio").alias("ratio"), F.median("deducted").alias("deducted")
    ).where(F.col("n") >= least)
    tax = 1 + float(config.gst)
    by_rate = F.col("ratio_spread") <= F.col("flat_spread")
    return told.select("batch_id", "instrument", "n", F.when(by_rate, F.round(F.col("ratio") / tax, 6)).alias("rate"), F.when(~by_rate, F.round(F.col("deducted") / tax)).cast("bigint").alias("flat_paise"))


def compare_to_contract(orders: DataFrame, settlements: DataFrame, config: Config) -> DataFrame:
    """Every contracted instrument and batch against what was observed; nulls where nothing was."""
    seen = observed_schedule(orders, settlements, config)
    spark = orders.sparkSession
    names = [*config.contract_rates, *config.contract_flat]
    contract = spark.createDataFrame([(n,) for n in names], "instrument string")
    contract = contract.withColumn("agreed_rate", by_instrument(F.col("instrument"), config.contract_rates, RATE).cast("double")).withColumn("agreed_flat", by_instrument(F.col("instrument"), config.contract_flat, "bigint"))
    rows = orders.select("batch_id").distinct().crossJoin(F.broadcast(contract)).join(seen, ["batch_id", "instrument"], "left")
    both_zero = (F.coalesce("rate", "flat_paise", F.lit(1)) == 0) & (F.coalesce("agreed_rate", "agreed_flat", F.lit(1)) == 0)
    same_shape = (F.col("rate").isNotNull() & F.col("agreed_rate").isNotNull()) | (F.col("flat_paise").isNotNull() & F.col("agreed_flat").isNotNull())
    close = F.when(F.col("agreed_flat").isNotNull(), F.abs(F.col("flat_paise") - F.col("agreed_flat")) <= 2).otherwise(F.abs(F.col("rate") - F.col("agreed_rate")) <= 1e-4)
    agrees = F.when(F.col("n").isNull(), F.lit(None).cast("boolean")).when(both_zero, True).when(~same_shape, False).otherwise(close)
    return rows.select("batch_id", "instrument", "n", "agreed_rate", "agreed_flat", "rate", "flat_paise", agrees.alias("agrees"))


def fee_shape(rate: Column, flat: Column) -> Column:
    """A flat amount in paise, or a percentage without needless zeros."""
    percent = F.regexp_replace(F.format_string("%.4f", rate * 100), r"\.?0+$", "")
    return F.when(flat.isNotNull(), F.format_string("flat %dp", flat)).when(rate.isNotNull(), F.concat(percent, F.lit("%")))


def contract_report(comparison: DataFrame) -> DataFrame:
    """Rows of ``compare_to_contract`` in words: what was contracted, what was observed, and the verdict."""
    verdict = F.when(F.col("agrees").isNull(), "no data").when(F.col("agrees"), "matches contract").otherwise("DEVIATES FROM CONTRACT")
    return comparison.select("batch_id", "instrument", fee_shape(F.col("agreed_rate"), F.col("agreed_flat")).alias("contracted"), fee_shape(F.col("rate"), F.col("flat_paise")).alias("observed"), F.coalesce("n", F.lit(0)).alias("n"), verdict.alias("verdict"))
