"""Order ledger, settlement report, bank credits and truth out of the star-schema test tables.

The recipe is integer arithmetic on the order key, so that an SQL engine gets
the same rows (``plans/oracle_base.py`` holds the same recipe as SQL).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import INSTRUMENTS, Config
from ..functions.money import apply_rate, rate_literal

#: The derived data has no holidays but weekends, over the years of the test tables.
DERIVED_CONFIG = Config(calendar_start="1994-01-01", calendar_end="2003-12-31", national_holidays=False)
RAISED_RATES = {"CARD_DEBIT": "0.0095", "CARD_CREDIT": "0.021"}
RAISED_FLAT = {"NETBANKING": 1300}
RAISED_BATCH = "2001"


@dataclass(frozen=True)
class Ledgers:
    orders: DataFrame
    settlements: DataFrame
    credits: DataFrame
    truth: DataFrame


def _keyed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/orders.parquet")
    code = F.pmod("o_orderkey", F.lit(100))
    instrument = F.element_at(F.array(*map(F.lit, INSTRUMENTS)), (F.pmod("o_custkey", F.lit(4)) + 1).cast("int"))
    day = F.to_date("o_orderdate")
    return raw.select(
        F.col("o_orderkey").alias("k"),
        code.alias("c"),
        F.year(day).cast("string").alias("batch_id"),
        F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string")).alias("order_id"),
        F.col("o_custkey").cast("string").alias("customer_name"),
        day.alias("order_date"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("gross_amount_paise"),
        instrument.alias("instrument"),
        F.when(code.between(5, 6), "refunded_full").when(code.between(7, 10), "refunded_partial").otherwise("captured").alias("status"),
    )


def fee_charged(gross: Column, instrument: Column, batch: Column) -> Column:
    raised = batch == RAISED_BATCH
    rate = lambda name, usual: F.when(raised, rate_literal(RAISED_RATES[name])).otherwise(rate_literal(usual))
    return (
        F.when(instrument == "UPI", F.lit(0).cast("bigint"))
        .when(instrument == "CARD_DEBIT", apply_rate(gross, rate("CARD_DEBIT", "0.009")))
        .when(instrument == "CARD_CREDIT", apply_rate(gross, rate("CARD_CREDIT", "0.02")))
        .otherwise(F.when(raised, RAISED_FLAT["NETBANKING"]).otherwise(1200).cast("bigint"))
    )


def derive(spark: SparkSession, sf_dir: str) -> Ledgers:
    keyed = _keyed_orders(spark, sf_dir)
    weekday = F.weekday("order_date")
    slow = F.when(weekday <= 2, 2).when(weekday <= 5, 4).otherwise(3)
    lag = F.when(F.col("instrument") == "UPI", F.when(weekday <= 3, 1).when(weekday <= 5, 3).otherwise(2)).otherwise(slow)
    split = F.col("c").between(11, 14)
    first_leg, second_leg = F.expr("(2 * gross_amount_paise) div 5"), F.expr("gross_amount_paise div 4")
    leg = lambda name, gross, extra, sign: F.struct(F.lit(name).alias("leg"), gross.cast("bigint").alias("gross"), F.lit(extra).alias("extra"), F.lit(sign).alias("sign"))
    whole = F.col("gross_amount_paise")
    legs = (
        F.when(F.col("c") == 14, F.array(leg("A", first_leg, 0, 1), leg("B", second_leg, 7, 1), leg("C", whole - first_leg - second_leg, 14, 1)))
        .when(split, F.array(leg("A", first_leg, 0, 1), leg("B", whole - first_leg, 7, 1)))
        .when(F.col("c") == 17, F.array(leg("O", whole, 0, 1), leg("CB", whole, 14, -1)))
        .when(F.col("c") == 19, F.array(leg("O", whole, 7, 1)))
        .otherwise(F.array(leg("O", whole, 0, 1)))
    )
    paid = keyed.where("c > 6").select("*", F.explode(legs).alias("l"))
    mdr = fee_charged(F.col("l.gross"), F.col("instrument"), F.col("batch_id"))
    paid = paid.withColumn("mdr", mdr).withColumn("gst", apply_rate(F.col("mdr"), rate_literal("0.18")))
    net = F.col("l.gross") - F.col("mdr") - F.col("gst") - F.when(F.col("c").between(7, 10), F.expr("gross_amount_paise div 4")).otherwise(0) - F.when(F.col("c").between(15, 16), 2).otherwise(0)
    paid = paid.withColumn("net", net.cast("bigint")).withColumn("settled_date", F.date_add("order_date", (lag + F.col("l.extra")).cast("int")))
    settlements = paid.select(
        F.when(F.col("l.leg") == "CB", F.concat(F.lit("CB-"), F.col("k").cast("string"))).otherwise(F.concat(F.lit("STL-"), F.col("k").cast("string"), F.lit("-"), F.col("l.leg"))).alias("settlement_txn_id"),
        "batch_id",
        F.when(F.col("c") == 18, F.concat(F.lit("GHOST-"), F.col("k").cast("string"))).otherwise(F.col("order_id")).alias("order_id_claimed"),
        "settled_date",
        (F.col("l.gross") * F.col("l.sign")).alias("gross_amount_paise"),
        (F.col("mdr") * F.col("l.sign")).alias("mdr_paise"),
        (F.col("gst") * F.col("l.sign")).alias("gst_on_mdr_paise"),
        (F.col("net") * F.col("l.sign")).alias("net_amount_paise"),
        F.concat(F.lit("SB-"), F.col("batch_id"), F.lit("-"), F.date_format("settled_date", "yyyyMMdd")).alias("settlement_batch_id"),
        "instrument",
    )
    groups = settlements.groupBy("batch_id", "settlement_batch_id").agg(
        F.min("settled_date").alias("credit_date"), F.sum("net_amount_paise").alias("total"), F.max_by("net_amount_paise", "settlement_txn_id").alias("last_net")
    )
    credits = groups.select(
        F.concat(F.lit("UTR-"), "settlement_batch_id").alias("utr"),
        "batch_id",
        "credit_date",
        (F.col("total") - F.when(F.dayofmonth("credit_date") == 13, F.col("last_net")).otherwise(0)).alias("credit_amount_paise"),
        F.lit("NEFT CREDIT").alias("narration"),
    )
    case = (
        F.when(F.col("c") <= 4, "missing_settlement").when(F.col("c") <= 6, "full_refund").when(F.col("c") <= 10, "partial_refund").when(F.col("c") <= 14, "split_settlement")
        .when(F.col("c") <= 16, "rounding_drift").when(F.col("c") == 17, "chargeback_reversal").when(F.col("c") == 18, "orphan_settlement").otherwise("clean")
    )
    known = keyed.select(F.col("order_id").alias("o"), case.alias("case_type"))
    joined = settlements.withColumn("o", F.regexp_replace("order_id_claimed", "^GHOST-", "ORD-")).join(known, "o")
    settled = joined.select(
        "batch_id", F.when(F.col("case_type") == "orphan_settlement", "ORPHAN").otherwise(F.col("o")).alias("order_id"), "settlement_txn_id", F.concat(F.lit("UTR-"), "settlement_batch_id").alias("utr"), "case_type"
    )
    open_ = keyed.where("c <= 6 OR c = 18").select("batch_id", "order_id", F.lit("UNSETTLED").alias("settlement_txn_id"), F.lit(None).cast("string").alias("utr"), case.alias("case_type"))
    return Ledgers(keyed.drop("k", "c"), settlements, credits, settled.unionByName(open_))
