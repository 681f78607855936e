"""Readers for the three CSV files of a batch, and the aggregator export's translation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The export's columns, row types and payment methods.
EXPORT_COLUMNS = (
    "entity_id type debit credit amount currency fee tax on_hold settled created_at settled_at settlement_id posted_at credit_type description notes payment_id settlement_utr order_id order_receipt method card_network card_issuer card_type dispute_id"
).split()
ROW_TYPES = ("payment", "refund", "adjustment")
METHODS = {("upi", ""): "UPI", ("netbanking", ""): "NETBANKING", ("card", "credit"): "CARD_CREDIT", ("card", "debit"): "CARD_DEBIT"}
_LONG = {"debit", "credit", "amount", "fee", "tax", "created_at", "settled_at"}
EXPORT_SCHEMA = ", ".join(f"{c} {'bigint' if c in _LONG else 'string'}" for c in EXPORT_COLUMNS)
ORDER_SCHEMA = "order_id string, customer_name string, order_datetime timestamp, gross_amount_paise bigint, instrument string, status string"
CREDIT_SCHEMA = "utr string, credit_datetime timestamp, credit_amount_paise bigint, narration string"


def read_csv(spark: SparkSession, path: str, schema: str, batch_id: str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, mode="FAILFAST").withColumn("batch_id", F.lit(batch_id))


def read_orders(spark: SparkSession, path: str, batch_id: str) -> DataFrame:
    return read_csv(spark, path, ORDER_SCHEMA, batch_id).withColumn("order_date", F.to_date("order_datetime"))


def read_credits(spark: SparkSession, path: str, batch_id: str) -> DataFrame:
    return read_csv(spark, path, CREDIT_SCHEMA, batch_id).withColumn("credit_date", F.to_date("credit_datetime"))


def read_export(spark: SparkSession, path: str, batch_id: str) -> DataFrame:
    return fold_export(spark.read.csv(path, schema=EXPORT_SCHEMA, header=True, mode="FAILFAST"), batch_id)


def instrument_of() -> Column:
    out = F.lit(None).cast("string")
    for (method, card), name in METHODS.items():
        out = F.when((F.coalesce("method", F.lit("")) == method) & (F.coalesce("card_type", F.lit("")) == card), name).otherwise(out)
    return out


def problems(export: DataFrame) -> list[str]:
    """What can't be translated, all of it named; values, not rows, come to the driver."""
    found = []
    kinds = export.where(~F.coalesce(F.col("type").isin(*ROW_TYPES), F.lit(False))).select("type").distinct()
    if rows := sorted(str(r[0]) for r in kinds.collect()):
        found.append(f"unknown row types: {', '.join(rows)}")
    money = export.where(F.col("type") != "refund").withColumn("instrument", instrument_of())
    if rows := sorted(f"{r[0]}/{r[1] or ''}" for r in money.where("instrument IS NULL").select("method", "card_type").distinct().collect()):
        found.append(f"unsupported methods: {', '.join(rows)}")
    payments = export.where("type <> 'refund'").select(F.col("entity_id").alias("payment_id"))
    lost = export.where("type = 'refund'").join(payments, "payment_id", "left_anti")
    if rows := sorted(str(r[0]) for r in lost.select("payment_id").distinct().collect()):
        found.append(f"refunds of payments that aren't there: {', '.join(rows)}")
    return found


def fold_export(export: DataFrame, batch_id: str, check: bool = True) -> DataFrame:
    """Settlements: the fee without its tax, refunds folded into their payment's net, adjustments reversed."""
    if check and (found := problems(export)):
        raise ValueError("; ".join(found))
    refunds = export.where("type = 'refund'").groupBy(F.col("payment_id").alias("entity_id")).agg(F.sum("debit").alias("refunded"))
    sign = F.when(F.col("type") == "adjustment", -1).otherwise(1)
    zone = F.from_utc_timestamp(F.timestamp_seconds("settled_at"), "Asia/Kolkata")
    return export.where("type <> 'refund'").join(refunds, "entity_id", "left").select(
        F.col("entity_id").alias("settlement_txn_id"), F.lit(batch_id).alias("batch_id"), F.col("order_receipt").alias("order_id_claimed"), F.to_date(zone).alias("settled_date"),
        (sign * F.col("amount")).alias("gross_amount_paise"), (sign * (F.col("fee") - F.col("tax"))).alias("mdr_paise"), (sign * F.col("tax")).alias("gst_on_mdr_paise"),
        (F.col("credit") - F.col("debit") - F.coalesce("refunded", F.lit(0))).cast("bigint").alias("net_amount_paise"), F.col("settlement_id").alias("settlement_batch_id"), instrument_of().alias("instrument"),
    )


def as_export(settlements: DataFrame) -> DataFrame:
    """The export that would translate to these settlements: a refund row wherever the net falls short by a paisa or more."""
    short = F.expr("gross_amount_paise - mdr_paise - gst_on_mdr_paise - net_amount_paise")
    back = {v: k for k, v in METHODS.items()}
    pick = lambda i: F.element_at(F.create_map(*[F.lit(x) for name, key in back.items() for x in (name, key[i])]), F.col("instrument"))
    net = F.expr("gross_amount_paise - mdr_paise - gst_on_mdr_paise")
    base = {
        "currency": F.lit("INR"), "settled_at": F.unix_timestamp(F.col("settled_date").cast("timestamp")) + 6 * 3600, "settlement_id": F.col("settlement_batch_id"), "order_receipt": F.col("order_id_claimed"), "method": pick(0), "card_type": pick(1),
    }
    own = base | {
        "entity_id": F.col("settlement_txn_id"), "type": F.when(F.col("gross_amount_paise") < 0, "adjustment").otherwise("payment"), "debit": F.greatest(-net, F.lit(0)), "credit": F.greatest(net, F.lit(0)), "amount": F.abs("gross_amount_paise"),
        "fee": F.abs(F.col("mdr_paise") + F.col("gst_on_mdr_paise")), "tax": F.abs("gst_on_mdr_paise"),
    }
    refund = base | {"entity_id": F.concat(F.lit("rfnd-"), "settlement_txn_id"), "type": F.lit("refund"), "debit": short, "credit": F.lit(0), "amount": short, "fee": F.lit(0), "tax": F.lit(0), "payment_id": F.col("settlement_txn_id")}
    full = lambda told: [told.get(c, F.lit(None)).cast("bigint" if c in _LONG else "string").alias(c) for c in EXPORT_COLUMNS]
    return settlements.select(*full(own)).unionByName(settlements.where(short > 0).select(*full(refund)))
