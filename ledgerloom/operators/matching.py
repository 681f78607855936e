"""Links between orders, settlements and bank credits."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config
from ..functions.calendar import calendar, with_lag
from ..functions.predicates import Rule
from .rules import explaining_rule, timing_verdict
from .solvers import subset_sums

#: Members of a leg list or a pool whose subsets are enumerated inside the engine.
ENUMERATED = 12


def pairs_of(orders: DataFrame, settlements: DataFrame) -> DataFrame:
    """Identity join: every settlement with the order of its batch that it claims."""
    o = orders.select(
        "batch_id", F.col("order_id").alias("o_order_id"), F.col("order_date").alias("o_date"), F.col("gross_amount_paise").alias("o_gross"), F.col("instrument").alias("o_instrument"), F.col("status").alias("o_status")
    )
    return o.join(named(settlements), (o["batch_id"] == F.col("s_batch")) & (o["o_order_id"] == F.col("s_claimed"))).drop("s_batch")


def named(settlements: DataFrame) -> DataFrame:
    return settlements.select(
        F.col("batch_id").alias("s_batch"), F.col("settlement_txn_id").alias("s_id"), F.col("order_id_claimed").alias("s_claimed"), F.col("settled_date").alias("s_date"),
        F.col("gross_amount_paise").alias("s_gross"), F.col("net_amount_paise").alias("s_net"), F.col("instrument").alias("s_instrument"),
    )


def unsettled(orders: DataFrame, settlements: DataFrame) -> DataFrame:
    claims = settlements.select("batch_id", F.col("order_id_claimed").alias("order_id"))
    return orders.join(claims, ["batch_id", "order_id"], "left_anti")


def orphans(orders: DataFrame, settlements: DataFrame) -> DataFrame:
    known = orders.select("batch_id", F.col("order_id").alias("order_id_claimed"))
    return settlements.join(known, ["batch_id", "order_id_claimed"], "left_anti")


def identity_outcomes(pairs: DataFrame, rules: Sequence[Rule], config: Config) -> DataFrame:
    """Pairs with lag, explaining rule and outcome: MATCH, FEE_UNEXPLAINED or TIMING_UNEXPLAINED."""
    lagged = with_lag(pairs, calendar(pairs.sparkSession, config), "o_date", "s_date")
    judged = lagged.withColumn("rule_id", explaining_rule(rules)).withColumn("timing", timing_verdict(rules))
    outcome = F.when(F.col("rule_id").isNull(), "FEE_UNEXPLAINED").when(~F.coalesce("timing", F.lit(True)), "TIMING_UNEXPLAINED").otherwise("MATCH")
    return judged.withColumn("outcome", outcome)


def subsets(items: Column, size: Column) -> Column:
    """All non-empty subsets of an array of up to ``ENUMERATED`` structs, as arrays, by bit mask."""
    masks = F.sequence(F.lit(1), F.pow(F.lit(2), size).cast("int") - 1)
    return F.transform(masks, lambda m: F.filter(items, lambda x, i: F.getbit(m, i) == 1))


def split_payouts(orders: DataFrame, settlements: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Legs of orders that two or more settlements claim and exactly one subset of them pays.

    A single leg that pays the whole order is a way of its own, so an order that
    could also be paid in parts stays open.  The subset must have two legs or
    more, each explained by a fee rule on its own gross.  Orders with more than
    ``ENUMERATED`` claims go to the solver.
    """
    pairs = pairs_of(orders, settlements)
    fee_rules = [r for r in rules if r.rule_type == "fee_formula"]
    leg_ok = pairs.withColumn("o_real", F.col("o_gross")).withColumn("o_gross", F.col("s_gross")).withColumn("rule_id", explaining_rule(fee_rules)).withColumn("o_gross", F.col("o_real")).drop("o_real")
    leg = F.struct("s_id", "s_gross", F.col("rule_id").isNotNull().alias("ok"), "rule_id")
    grouped = leg_ok.groupBy("batch_id", "o_order_id", "o_gross").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(leg)).alias("legs"))
    few, many = grouped.where(F.col("n").between(2, ENUMERATED)), grouped.where(F.col("n") > ENUMERATED)
    total = lambda s: F.aggregate(s, F.lit(0).cast("bigint"), lambda a, x: a + x["s_gross"])
    exact = few.withColumn("found", F.filter(subsets(F.col("legs"), F.col("n").cast("int")), lambda s: total(s) == F.col("o_gross")))
    unique = exact.where(F.size("found") == 1).select("batch_id", "o_order_id", F.get("found", F.lit(0)).alias("chosen"))
    unique = unique.where((F.size("chosen") > 1) & F.forall("chosen", lambda x: x["ok"]))
    chosen = unique.unionByName(solved_splits(many))
    return chosen.select("batch_id", "o_order_id", F.explode("chosen").alias("leg")).select("batch_id", "o_order_id", "leg.s_id", "leg.s_gross", "leg.rule_id")


def solved_splits(grouped: DataFrame) -> DataFrame:
    """The legs of each order whose only subset that pays it exactly has two or more, all of them explained."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (gross, legs) in enumerate(zip(batch.column("o_gross").to_pylist(), batch.column("legs").to_pylist(), strict=True)):
                found = subset_sums([x["s_gross"] for x in legs], gross, 0, 2)
                if len(found.solutions) == 1 and len(found.solutions[0]) > 1 and all(legs[i]["ok"] for i in found.solutions[0]):
                    chosen = pa.array([[legs[i] for i in found.solutions[0]]], batch.schema.field("legs").type)
                    yield pa.RecordBatch.from_arrays([*batch.select(["batch_id", "o_order_id"]).slice(k, 1).columns, chosen], names=["batch_id", "o_order_id", "chosen"])

    schema = T.StructType([grouped.schema["batch_id"], grouped.schema["o_order_id"], T.StructField("chosen", grouped.schema["legs"].dataType)])
    return grouped.select("batch_id", "o_order_id", "o_gross", "legs").mapInArrow(solve, schema)


def candidate_pairs(orders: DataFrame, settlements: DataFrame, config: Config) -> DataFrame:
    """Amount and date range join of leftovers.

    Settlements go to each order date their window can reach, orders to each
    power of 2.5 that their amount band touches (three at most), so the join is
    an equi-join on (batch, date, power) with the exact band as a residual filter.
    """
    days = calendar(orders.sparkSession, config)
    reach = 2 + config.window_days + 2 * (config.window_days // 5 + 1)  # calendar days that a window of working days may span
    o = orders.select("batch_id", F.col("order_id").alias("o_order_id"), F.col("order_date").alias("o_date"), F.col("gross_amount_paise").alias("o_gross"), F.col("instrument").alias("o_instrument"), F.col("status").alias("o_status"))
    s = named(settlements).withColumn("o_date", F.explode(F.sequence(F.date_sub("s_date", reach), F.col("s_date")))).withColumnRenamed("s_batch", "batch_id")
    slack = F.expr(f"(abs(o_gross) * {config.amount_slack_percent}) div 100")
    low, high = F.col("o_gross") - slack - config.amount_tolerance, F.col("o_gross") + config.amount_tolerance
    power = lambda x: F.when(x <= 1, 0).otherwise(F.floor(F.ln(x) / F.lit(math.log(2.5)))).cast("int")
    o = o.withColumn("power", F.explode(F.sequence(power(F.least(low, high)), power(F.greatest(low, high)))))
    near = o.join(s.withColumn("power", power(F.col("s_net"))), ["batch_id", "o_date", "power"]).drop("power").where(F.col("s_net").between(F.least(low, high), F.greatest(low, high)))
    return with_lag(near, days, "o_date", "s_date").where(F.col("lag_days").between(0, config.window_days))


def payout_sums(settlements: DataFrame) -> DataFrame:
    return settlements.groupBy("batch_id", "settlement_batch_id").agg(F.sum("net_amount_paise").alias("net_total"), F.min("settled_date").alias("group_date"), F.count("*").alias("members"))


def bank_group_hits(settlements: DataFrame, credits: DataFrame, config: Config) -> DataFrame:
    """Credits with the payout groups whose sum and date fit, and how many do."""
    groups = payout_sums(settlements)
    both = credits.join(groups, (credits["batch_id"] == groups["batch_id"]) & (credits["credit_amount_paise"] == groups["net_total"]) & (F.abs(F.datediff("credit_date", "group_date")) <= config.bank_window_days))
    hits = F.count("*").over(Window.partitionBy("utr"))
    return both.select(credits["batch_id"], "utr", "credit_amount_paise", "settlement_batch_id", "members", hits.alias("hits"))


def bank_matches(settlements: DataFrame, hits: DataFrame) -> DataFrame:
    one = hits.where("hits = 1").select("batch_id", "utr", "settlement_batch_id")
    return settlements.join(one, ["batch_id", "settlement_batch_id"]).select("batch_id", "utr", F.col("settlement_txn_id").alias("s_id"), "settlement_batch_id")


def bank_leftovers(credits: DataFrame, hits: DataFrame) -> DataFrame:
    return credits.join(hits.select("utr").distinct(), "utr", "left_anti")


def bank_pool(leftovers: DataFrame, settlements: DataFrame, config: Config) -> DataFrame:
    """Settlements within the bank window of each credit that no payout group explains."""
    near = leftovers.withColumn("settled_date", F.explode(F.sequence(F.date_sub("credit_date", config.bank_window_days), F.date_add("credit_date", config.bank_window_days))))
    return near.join(settlements, ["batch_id", "settled_date"]).select(
        "batch_id", "utr", "credit_amount_paise", F.col("settlement_txn_id").alias("s_id"), F.col("net_amount_paise").alias("s_net"), F.col("settlement_batch_id").alias("s_group"), F.col("settled_date").alias("s_date")
    )
