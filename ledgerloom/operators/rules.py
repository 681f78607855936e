"""Rule evaluation.

The library is driver-side data of a few rules, so it compiles into one Column
expression: "first rule that holds" is a coalesce over the rules in precedence
order, with no join and no broadcast.  A verdict is TRUE, FALSE or NULL (no
opinion); FALSE and NULL both let the next rule try.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import expected_net as expected_net_of
from ..functions.money import within_tolerance
from ..functions.predicates import Rule


class RuleConflictError(ValueError):
    """Two rules whose precedence contradicts itself."""


def ordered(rules: Sequence[Rule]) -> list[Rule]:
    """Active rules by priority, the more specific first, then by id."""
    if cycles(rules):
        raise RuleConflictError(f"contradicting precedence: {cycles(rules)}")
    return sorted((r for r in rules if r.status == "active"), key=lambda r: (r.priority, r.scope == "ALL", r.rule_id))


def cycles(rules: Sequence[Rule]) -> list[tuple[int, int]]:
    """Pairs of one type in which the scoped rule has the larger priority number than the one for all."""
    live = [r for r in rules if r.status == "active"]
    return sorted((s.rule_id, a.rule_id) for s in live for a in live if s.scope != "ALL" and a.scope == "ALL" and s.rule_type == a.rule_type and s.priority > a.priority)


def overlapping(table: DataFrame, at: int = 1_000_000) -> DataFrame:
    """(a, b) of the active rules of ``as_table`` of one type and scope that can both explain the same money, a below b.

    Nets with their tolerances are ranges, as windows are.  Ranges meet each
    other once for each different one, and only those that overlap meet the
    rules that have them, dealt out over all tasks.
    """
    rows = table.where("status = 'active'").where(F.col("rule_type").isin("fee_formula", "timing_window"))
    net = expected_net_of(F.lit(at).cast("bigint"), F.coalesce("rate", F.lit("0")), F.col("gst"), F.col("flat_paise"))
    fee = F.col("rule_type") == "fee_formula"
    low, high = F.when(fee, net - F.col("tolerance_paise")).otherwise(F.col("min_days")), F.when(fee, net + F.col("tolerance_paise")).otherwise(F.col("max_days"))
    rows = rows.select("rule_id", "rule_type", "scope_instrument", low.alias("low"), high.alias("high"))
    own, other = ["rule_type", "scope_instrument", "low", "high"], ["rule_type", "scope_instrument", "low2", "high2"]
    ranges = rows.select(*own).distinct()
    both = ranges.join(ranges.toDF(*other), ["rule_type", "scope_instrument"]).where("low <= high2 AND low2 <= high AND (low, high) <= (low2, high2)")
    tasks, parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8
    first = both.join(rows.withColumnRenamed("rule_id", "r"), own).withColumn("part", F.pmod(F.xxhash64("r"), F.lit(parts)))
    second = rows.toDF("r2", *other).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))
    pairs = first.repartition(tasks, *other, "part").join(second.repartition(tasks, *other, "part"), [*other, "part"])
    same = F.expr("low = low2 AND high = high2")
    return pairs.where(F.when(same, F.col("r") < F.col("r2")).otherwise(F.col("r") != F.col("r2"))).select(F.least("r", "r2").alias("a"), F.greatest("r", "r2").alias("b"))


def overlaps(spark: SparkSession, rules: Sequence[Rule], at: int = 1_000_000) -> list[tuple[int, int]]:
    """The pairs of ``overlapping`` of a library on the driver."""
    return sorted(tuple(r) for r in overlapping(as_table(spark, rules), at).collect())


def expected_net(rules: Sequence[Rule], gross: Column, instrument: Column) -> Column:
    """Net by the first fee rule in scope; null if there is none."""
    found = [F.when(r.covers(instrument), r.net_of(gross)) for r in ordered(rules) if r.rule_type == "fee_formula"]
    return F.coalesce(*found) if found else F.lit(None).cast("bigint")


def expected_window(rules: Sequence[Rule], instrument: Column) -> tuple[Column, Column]:
    """Working days by the first timing rule in scope; nulls if there is none."""
    rows = [r for r in ordered(rules) if r.rule_type == "timing_window"]
    pick = lambda name: F.coalesce(*[F.when(r.covers(instrument), F.lit(getattr(r, name))) for r in rows]) if rows else F.lit(None).cast("int")
    return pick("min_days"), pick("max_days")


def verdict(rule: Rule, rules: Sequence[Rule]) -> Column:
    """What ``rule`` says of a pair row (o_order_id, o_gross, o_status, s_claimed, s_gross, s_net, s_instrument, lag_days)."""
    o, s = F.col("o_gross"), F.col("s_gross")
    if rule.rule_type == "exact_id":
        said = F.col("o_order_id") == F.col("s_claimed")
    elif rule.rule_type == "fee_formula":
        same = o.isNull() | s.isNull() | (o == s)
        said = F.when(same, within_tolerance(F.col("s_net"), rule.net_of(F.coalesce(o, s)), rule.tolerance))
    elif rule.rule_type == "timing_window":
        said = F.col("lag_days").between(rule.min_days, rule.max_days)
    else:
        said = F.when(F.col("o_status") == "refunded_partial", F.col("s_net") < expected_net(rules, s, F.col("s_instrument")) - rule.tolerance)
    return F.when(rule.covers(F.col("s_instrument")), said)


def explaining_rule(rules: Sequence[Rule]) -> Column:
    """Id of the first fee or refund rule that holds; null if none does."""
    found = [F.when(verdict(r, rules), F.lit(r.rule_id)) for r in ordered(rules) if r.rule_type in ("fee_formula", "refund_pattern")]
    return F.coalesce(*found) if found else F.lit(None).cast("int")


def timing_verdict(rules: Sequence[Rule]) -> Column:
    """Whether the first timing rule in scope holds; null if there is none."""
    low, high = expected_window(rules, F.col("s_instrument"))
    return F.col("lag_days").between(low, high)


def as_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    rows = [(r.rule_id, r.rule_type, r.scope, r.priority, r.status, r.rate, r.gst, r.flat_paise, r.tolerance, r.min_days, r.max_days) for r in rules]
    return spark.createDataFrame(rows, "rule_id int, rule_type string, scope_instrument string, priority int, status string, rate string, gst string, flat_paise bigint, tolerance_paise int, min_days int, max_days int")


def promoted(rule: Rule, rule_id: int, priority: int) -> Rule:
    return replace(rule, rule_id=rule_id, priority=priority, status="active")
