"""All legs over all batches: links, verdicts and typed exceptions, set at a time."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.predicates import Rule
from ..operators import assignment as A
from ..operators import matching as M
from ..sources.sinks import kept

#: A library such as a few batches teach: identity, contract fees, usual timing, partial refunds.
LIBRARY = (
    Rule(1, "exact_id", priority=0),
    Rule(2, "fee_formula", "UPI", 50, rate="0", gst="0.18", tolerance=2),
    Rule(3, "fee_formula", "CARD_DEBIT", 50, rate="0.009", gst="0.18", tolerance=2),
    Rule(4, "fee_formula", "CARD_CREDIT", 50, rate="0.02", gst="0.18", tolerance=2),
    Rule(5, "fee_formula", "NETBANKING", 50, flat_paise=1200, gst="0.18", tolerance=2),
    Rule(6, "timing_window", "UPI", 50, min_days=1, max_days=1),
    Rule(7, "timing_window", "ALL", 80, min_days=2, max_days=2),
    Rule(8, "refund_pattern", "ALL", 80),
)
SEED = (Rule(1, "exact_id", priority=0),)


@dataclass
class Reconciliation:
    """Legs in order: split payouts, identity, assignment of what has no id, bank.

    Links that several results read (split legs, identity outcomes, candidates,
    bindings, bank hits) are written once to the shared folder; the other properties are plans.
    """

    orders: DataFrame
    settlements: DataFrame
    credits: DataFrame
    rules: Sequence[Rule]
    config: Config

    @cached_property
    def splits(self) -> DataFrame:
        return kept(M.split_payouts(self.orders, self.settlements, self.rules), "splits")

    @cached_property
    def identity(self) -> DataFrame:
        pairs = M.pairs_of(self.orders, self.settlements).join(self.splits.select("s_id"), "s_id", "left_anti")
        return kept(M.identity_outcomes(pairs, self.rules, self.config), "identity")

    @cached_property
    def open_orders(self) -> DataFrame:
        return M.unsettled(self.orders, self.settlements)

    @cached_property
    def open_settlements(self) -> DataFrame:
        return M.orphans(self.orders, self.settlements)

    @cached_property
    def candidates(self) -> DataFrame:
        return kept(A.costed(M.candidate_pairs(self.open_orders, self.open_settlements, self.config), self.rules, self.config), "candidates")

    @cached_property
    def members(self) -> DataFrame:
        return A.component_members(self.open_orders, self.open_settlements, self.candidates)

    @cached_property
    def assigned(self) -> DataFrame:
        return kept(A.solved_bindings(A.usable_pairs(self.open_orders, self.open_settlements, self.rules, self.config), self.config), "assigned")

    @cached_property
    def bank_hits(self) -> DataFrame:
        return kept(M.bank_group_hits(self.settlements, self.credits, self.config), "bank-hits")

    @cached_property
    def bank_found(self) -> DataFrame:
        return kept(A.bank_subsets(M.bank_pool(M.bank_leftovers(self.credits, self.bank_hits), self.settlements, self.config), self.config), "bank-subsets")

    def order_matches(self, assigned: bool = True) -> DataFrame:
        """(batch_id, o_order_id, s_id, rule_id, match_kind, resolved_by, confidence)."""
        row = lambda df, kind, by, conf: df.select("batch_id", "o_order_id", "s_id", "rule_id", F.lit(kind).alias("match_kind"), F.lit(by).alias("resolved_by"), F.lit(conf).alias("confidence"))
        legs = self.splits.withColumn("rule_id", F.lit(None).cast("int"))  # a sum proves the split; no rule is credited with it
        out = row(legs, "assignment", "subset_sum", 0.95).unionByName(row(self.identity.where("outcome = 'MATCH'"), "exact", "deterministic", 0.99))
        if not assigned:
            return out
        batch = self.open_settlements.select("batch_id", F.col("settlement_txn_id").alias("s_id"))
        found = self.assigned.join(batch, "s_id").withColumn("rule_id", F.lit(None).cast("int"))
        return out.unionByName(found.select("batch_id", "o_order_id", "s_id", "rule_id", F.lit("assignment").alias("match_kind"), F.col("method").alias("resolved_by"), F.lit(0.9).alias("confidence")))

    def bank_matches(self, subsets: bool = True) -> DataFrame:
        one = M.bank_matches(self.settlements, self.bank_hits).select("batch_id", "utr", "s_id", F.lit("exact").alias("match_kind"), F.lit(0.99).alias("confidence"))
        if not subsets:
            return one
        found = self.bank_found.where(F.size("members") > 0).select("batch_id", "utr", F.explode("members").alias("s_id"), F.lit("subset_sum").alias("match_kind"), "confidence")
        return one.unionByName(found)

    def exceptions(self, assigned: bool = True, bank: bool = True) -> DataFrame:
        """(batch_id, record_type, record_id, reason_code, money_at_risk_paise)."""
        row = lambda df, kind, key, reason, money: df.select("batch_id", F.lit(kind).alias("record_type"), F.col(key).alias("record_id"), reason.alias("reason_code"), F.abs(money).cast("bigint").alias("money_at_risk_paise"))
        open_orders, open_settlements = self.open_orders, self.open_settlements
        if assigned:
            open_orders = open_orders.join(self.assigned.select(F.col("o_order_id").alias("order_id")), "order_id", "left_anti")
            open_settlements = open_settlements.join(self.assigned.select(F.col("s_id").alias("settlement_txn_id")), "settlement_txn_id", "left_anti")
        money = F.when(F.col("outcome") == "FEE_UNEXPLAINED", F.col("s_gross") - F.col("s_net")).otherwise(F.col("s_net"))
        out = row(self.identity.where("outcome <> 'MATCH'"), "settlement", "s_id", F.col("outcome"), money)
        out = out.unionByName(row(open_orders, "order", "order_id", F.lit("NO_SETTLEMENT"), F.col("gross_amount_paise")))
        out = out.unionByName(row(open_settlements, "settlement", "settlement_txn_id", F.lit("ORPHAN_SETTLEMENT"), F.col("net_amount_paise")))
        if not bank:
            return out
        many = self.bank_hits.where("hits > 1").select("batch_id", "utr", "credit_amount_paise").distinct()
        out = out.unionByName(row(many, "bank_credit", "utr", F.lit("AMBIGUOUS_SUBSET"), F.col("credit_amount_paise")))
        left = M.bank_leftovers(self.credits, self.bank_hits).join(self.bank_found.select("utr", F.size("members").alias("n"), "reason"), "utr", "left").where("n IS NULL OR n = 0")
        return out.unionByName(row(left, "bank_credit", "utr", F.coalesce("reason", F.lit("NO_SUBSET_FOUND")), F.col("credit_amount_paise")))
