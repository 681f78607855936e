"""Totals and the money bridge."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import short_rupees


def _zero(c):
    return F.coalesce(c, F.lit(0)).cast("bigint")


def totals(orders: DataFrame, settlements: DataFrame, matched: DataFrame, instrument: str | None = None) -> DataFrame:
    """One row per batch and instrument and one per batch (instrument null): money settled and orders reconciled."""
    if instrument:
        orders, settlements = orders.where(F.col("instrument") == instrument), settlements.where(F.col("instrument") == instrument)
    money = settlements.groupingSets([["batch_id", "instrument"], ["batch_id"]], "batch_id", "instrument").agg(
        F.sum("gross_amount_paise").alias("gross"), F.sum("mdr_paise").alias("fees"), F.sum("gst_on_mdr_paise").alias("gst"), F.sum("net_amount_paise").alias("net"), F.count("*").alias("settlements")
    )
    flagged = orders.join(matched.select("batch_id", F.col("o_order_id").alias("order_id"), F.lit(1).alias("hit")).distinct(), ["batch_id", "order_id"], "left")
    counts = flagged.groupingSets([["batch_id", "instrument"], ["batch_id"]], "batch_id", "instrument").agg(F.count("*").alias("orders"), F.count("hit").alias("orders_reconciled"))
    m, c = money.alias("m"), counts.alias("c")
    both = c.join(m, (F.col("c.batch_id") == F.col("m.batch_id")) & F.col("c.instrument").eqNullSafe(F.col("m.instrument")), "left")
    return both.select("c.batch_id", "c.instrument", *[_zero(F.col(n)).alias(n) for n in ("gross", "fees", "gst", "net", "settlements", "orders", "orders_reconciled")])


MATCHED, EXCEPTION = "Matched", "Exception"


@dataclass(frozen=True)
class Filters:
    """What a summary looks at; a filter that is None isn't applied."""

    instruments: tuple[str, ...] | None = None
    date_from: str | None = None
    date_to: str | None = None
    statuses: tuple[str, ...] | None = None

    @property
    def dated(self) -> bool:
        return self.date_from is not None or self.date_to is not None

    def keeps(self, instrument: Column, day: Column, matched: Column) -> Column:
        out = F.lit(True)
        if self.instruments is not None:
            out &= instrument.isin(*self.instruments)
        if self.date_from is not None:
            out &= day >= F.to_date(F.lit(self.date_from))
        if self.date_to is not None:
            out &= day <= F.to_date(F.lit(self.date_to))
        if self.statuses is not None:
            out &= F.when(matched, MATCHED).otherwise(EXCEPTION).isin(*self.statuses)
        return F.coalesce(out, F.lit(False))


def filtered(orders: DataFrame, settlements: DataFrame, order_matches: DataFrame, filters: Filters) -> tuple[DataFrame, DataFrame]:
    """Orders (with ``matched``) and settlements (with ``o_status``, null for an orphan) that the filters keep.

    A settlement is dated by the order that it claims, so orphans drop out under a date filter.
    """
    by_order = order_matches.select("batch_id", F.col("o_order_id").alias("order_id"), F.lit(True).alias("hit")).distinct()
    by_settlement = order_matches.select("batch_id", F.col("s_id").alias("settlement_txn_id"), F.lit(True).alias("hit")).distinct()
    known = orders.select("batch_id", F.col("order_id").alias("order_id_claimed"), F.col("order_date").alias("o_date"), F.col("status").alias("o_status"))
    matched = F.coalesce("hit", F.lit(False))
    kept_orders = orders.join(by_order, ["batch_id", "order_id"], "left").withColumn("matched", matched).drop("hit")
    kept_settlements = settlements.join(known, ["batch_id", "order_id_claimed"], "left").join(by_settlement, ["batch_id", "settlement_txn_id"], "left").withColumn("matched", matched).drop("hit")
    return kept_orders.where(filters.keeps(F.col("instrument"), F.col("order_date"), F.col("matched"))), kept_settlements.where(filters.keeps(F.col("instrument"), F.col("o_date"), F.col("matched")))


def summary(orders: DataFrame, settlements: DataFrame, credits: DataFrame, order_matches: DataFrame, leaks: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """One row per batch and instrument, and one per batch (instrument null).

    ``leaks`` has the audited rows (batch_id, instrument, leaked).  A bank
    deposit bundles methods, dates and statuses, so the bank's total is null
    under any filter and in the rows of an instrument; the audit prices whole
    batches per instrument, so both overcharges are null under a filter by date
    or status.
    """
    o, s = filtered(orders, settlements, order_matches, filters)
    sets = [["batch_id", "instrument"], ["batch_id"]]
    by = lambda df, *measures: df.groupingSets(sets, "batch_id", "instrument").agg(*measures)
    sold = by(o, F.count("*").alias("orders_total"), F.count_if("matched").alias("orders_reconciled"), F.sum("gross_amount_paise").alias("gross_sales"))
    paid = by(s, F.sum("mdr_paise").alias("fees"), F.sum("gst_on_mdr_paise").alias("gst"), F.sum("net_amount_paise").alias("net_settled"))
    leaked = leaks if filters.instruments is None else leaks.where(F.col("instrument").isin(*filters.instruments))
    over = by(leaked, F.sum("leaked").alias("overcharge"), F.sum(F.greatest("leaked", F.lit(0))).alias("gross_overcharge"))
    keys = ["batch_id", F.coalesce("instrument", F.lit("")).alias("instrument")]
    plain = lambda df: df.select(*keys, *[c for c in df.columns if c not in ("batch_id", "instrument")])
    out = plain(sold).join(plain(paid), ["batch_id", "instrument"], "full").join(plain(over), ["batch_id", "instrument"], "left")
    money = ["gross_sales", "fees", "gst", "net_settled", "orders_total", "orders_reconciled"]
    unpriced = filters.dated or filters.statuses is not None
    out = out.select("batch_id", F.nullif("instrument", F.lit("")).alias("instrument"), *[_zero(F.col(c)).alias(c) for c in money], *[(F.lit(None).cast("bigint") if unpriced else _zero(F.col(c))).alias(c) for c in ("overcharge", "gross_overcharge")])
    if unpriced or filters.instruments is not None:
        return out.withColumn("bank_received", F.lit(None).cast("bigint"))
    bank = credits.groupBy("batch_id").agg(F.sum("credit_amount_paise").alias("bank"))
    return out.join(bank, "batch_id", "left").withColumn("bank_received", F.when(F.col("instrument").isNull(), _zero(F.col("bank")))).drop("bank")


def money_bridge(orders: DataFrame, settlements: DataFrame, order_matches: DataFrame | None = None, filters: Filters = Filters()) -> DataFrame:
    """From what was sold to what arrived, one row per batch; ``other`` is what the steps leave open.

    The filters are those of ``summary`` (a status filter needs the matches).
    """
    if order_matches is None:
        order_matches = orders.sparkSession.createDataFrame([], "batch_id string, o_order_id string, s_id string")
    kept_orders, rows = filtered(orders, settlements, order_matches, filters)
    claims = rows.where("gross_amount_paise > 0").select("batch_id", F.col("order_id_claimed").alias("order_id")).distinct()
    never = kept_orders.join(claims, ["batch_id", "order_id"], "left_anti").groupBy("batch_id").agg(F.sum("gross_amount_paise").alias("never_settled"))
    sales = kept_orders.groupBy("batch_id").agg(F.sum("gross_amount_paise").alias("total_sales"))
    gross, residual = F.col("gross_amount_paise"), F.expr("gross_amount_paise - mdr_paise - gst_on_mdr_paise - net_amount_paise")
    refunded = F.coalesce(F.col("o_status") == "refunded_partial", F.lit(False))
    moved = rows.groupBy("batch_id").agg(
        F.sum(F.when(gross < 0, -gross).otherwise(0)).alias("chargebacks"), F.sum(F.when(refunded, residual).otherwise(0)).alias("refunds"), F.sum(F.when(refunded, 0).otherwise(residual)).alias("rounding_drift"),
        F.sum("mdr_paise").alias("fees"), F.sum("gst_on_mdr_paise").alias("gst"), F.sum(F.when((gross > 0) & F.col("o_status").isNull(), gross).otherwise(0)).alias("orphans"), F.sum("net_amount_paise").alias("net_settled"),
    )
    out = orders.select("batch_id").distinct().join(sales, "batch_id", "left").join(never, "batch_id", "left").join(moved, "batch_id", "left")
    names = ["total_sales", "never_settled", "chargebacks", "refunds", "fees", "gst", "rounding_drift", "orphans", "net_settled"]
    out = out.select("batch_id", *[_zero(F.col(n)).alias(n) for n in names])
    return out.withColumn("other", F.expr("net_settled - (total_sales - never_settled - chargebacks - refunds - fees - gst - rounding_drift + orphans)"))


def bridge_sentence(bridge: DataFrame) -> DataFrame:
    """The bridge of each batch in a line: from sales to what arrived, steps of nothing left out."""
    steps = {"never_settled": "never settled", "chargebacks": "charged back", "refunds": "refunded", "fees": "fees", "gst": "tax on fees", "rounding_drift": "drift"}
    told = [F.when(F.col(c) != 0, F.concat(short_rupees(F.col(c)), F.lit(f" {words}"))) for c, words in steps.items()]
    back = F.when(F.col("orphans") != 0, F.concat(F.lit("plus "), short_rupees(F.col("orphans")), F.lit(" of orders that aren't in the ledger")))
    less = F.concat_ws(", ", *told, back)
    return bridge.select("batch_id", F.concat(short_rupees(F.col("total_sales")), F.lit(" sold, less "), less, F.lit(": "), short_rupees(F.col("net_settled")), F.lit(" settled")).alias("sentence"))


def run_metrics(orders: DataFrame, settlements: DataFrame, credits: DataFrame, order_matches: DataFrame, bank_matches: DataFrame, exceptions: DataFrame) -> DataFrame:
    """One row per batch: records, links, distinct records matched, match rate, exceptions and money at risk."""
    tagged = lambda df, name, money=None: df.select("batch_id", F.lit(name).alias("tag"), (F.col(money) if money else F.lit(0)).cast("bigint").alias("money"))
    orders_matched = order_matches.select("batch_id", "o_order_id").distinct()
    sides = order_matches.select("batch_id", "s_id").unionByName(bank_matches.select("batch_id", "s_id")).distinct()
    parts = {"orders": orders, "settlements": settlements, "credits": credits, "order_matches": order_matches, "orders_matched": orders_matched, "bank_matches": bank_matches, "settlements_matched": sides}
    rows = tagged(exceptions, "exceptions", "money_at_risk_paise")
    for name, df in parts.items():
        rows = rows.unionByName(tagged(df, name))
    # one pass over tagged rows, one row a batch
    out = rows.groupBy("batch_id").agg(*[F.count_if(F.col("tag") == name).alias(name) for name in [*parts, "exceptions"]], F.sum("money").alias("money_at_risk_paise")).where("orders > 0")
    rate = (F.col("orders_matched") + F.col("settlements_matched")) / (F.col("orders") + F.col("settlements") + F.col("credits"))
    return out.withColumn("match_rate", F.round(rate, 6))
