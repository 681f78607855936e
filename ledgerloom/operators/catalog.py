"""Read-only lookups: parameterised queries as DataFrames, and the same as plain data for a caller that asks by name.

``ReconCatalog`` returns DataFrames.  ``answer`` runs one of ``TOOLS`` and
returns JSON-ready data of a bounded size: one record with what hangs on it, a
top list, or totals.  What isn't found and what goes wrong is data, too.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.predicates import Rule, plain_english
from . import audit
from .rules import as_table

TOOLS = ("get_transaction", "list_exceptions", "explain_match", "sum_fees", "list_learned_rules", "trace_bulk_credit", "check_contract_compliance", "get_batch_metrics")


@dataclass
class ReconCatalog:
    orders: DataFrame
    settlements: DataFrame
    credits: DataFrame
    order_matches: DataFrame
    bank_matches: DataFrame
    exceptions: DataFrame
    rules: Sequence[Rule]
    config: Config
    proposals: Sequence = ()
    stats: dict[int, tuple[int, int]] = field(default_factory=dict)
    scores: DataFrame | None = None

    # -- DataFrames

    def record(self, record_id: str) -> DataFrame:
        """(record_type, record_id, batch_id, amount, day) of an id, be it an order, a settlement or a credit."""
        kinds = (("order", self.orders, "order_id", "gross_amount_paise", "order_date"), ("settlement", self.settlements, "settlement_txn_id", "net_amount_paise", "settled_date"), ("bank_credit", self.credits, "utr", "credit_amount_paise", "credit_date"))
        rows = [df.where(F.col(key) == record_id).select(F.lit(kind).alias("record_type"), F.col(key).alias("record_id"), "batch_id", F.col(amount).alias("amount"), F.col(day).alias("day")) for kind, df, key, amount, day in kinds]
        return rows[0].unionByName(rows[1]).unionByName(rows[2])

    def links(self) -> DataFrame:
        """All links: (left_id, right_id, match_kind, resolved_by, rule_id, confidence)."""
        own = self.order_matches.select(F.col("o_order_id").alias("left_id"), F.col("s_id").alias("right_id"), "match_kind", "resolved_by", "rule_id", "confidence")
        bank = self.bank_matches.select(F.col("utr").alias("left_id"), F.col("s_id").alias("right_id"), "match_kind", F.when(F.col("match_kind") == "exact", "deterministic").otherwise("subset_sum").alias("resolved_by"), F.lit(None).cast("int").alias("rule_id"), "confidence")
        return own.unionByName(bank)

    def matches_of(self, record_id: str) -> DataFrame:
        """Links of a record on either side."""
        return self.links().where((F.col("left_id") == record_id) | (F.col("right_id") == record_id))

    def exceptions_of(self, record_id: str) -> DataFrame:
        return self.exceptions.where(F.col("record_id") == record_id)

    def get_transaction(self, record_id: str) -> DataFrame:
        """The record with its matches and exceptions counted."""
        n = self.matches_of(record_id).agg(F.count("*").alias("matches"))
        e = self.exceptions_of(record_id).agg(F.count("*").alias("exceptions"))
        return self.record(record_id).select("record_type", "record_id", "amount").join(F.broadcast(n)).join(F.broadcast(e))  # one row each

    def matching_exceptions(self, batch_id: str | None = None, least: int = 0, status: str | None = None) -> DataFrame:
        rows = self.exceptions.where(F.col("money_at_risk_paise") >= least)
        rows = rows if batch_id is None else rows.where(F.col("batch_id") == batch_id)
        return rows if status is None or "status" not in rows.columns else rows.where(F.col("status") == status)

    def list_exceptions(self, batch_id: str | None = None, least: int = 0, top: int = 20, status: str | None = None) -> DataFrame:
        rows = self.matching_exceptions(batch_id, least, status)
        return rows.orderBy(F.desc("money_at_risk_paise"), "record_id").limit(top).select("record_type", "record_id", "reason_code", "money_at_risk_paise")

    def exception_totals(self, batch_id: str | None = None, least: int = 0, status: str | None = None) -> DataFrame:
        """How many exceptions match, and their money."""
        return self.matching_exceptions(batch_id, least, status).agg(F.count("*").alias("count_matching"), F.coalesce(F.sum("money_at_risk_paise"), F.lit(0)).cast("bigint").alias("total_money_at_risk"))

    def explain_match(self, record_id: str) -> DataFrame:
        """Links of an order or settlement, each with its rule in words and the exceptions filed for its settlement."""
        rows = self.order_matches.where((F.col("o_order_id") == record_id) | (F.col("s_id") == record_id))
        filed = self.exceptions.groupBy(F.col("record_id").alias("s_id")).agg(F.count("*").alias("exceptions"))
        words = F.create_map(*[F.lit(x) for r in self.rules for x in (r.rule_id, plain_english(r))]) if self.rules else F.create_map().cast("map<int,string>")
        return rows.join(filed, "s_id", "left").withColumn("exceptions", F.coalesce("exceptions", F.lit(0))).withColumn("rule", F.element_at(words, F.col("rule_id")))

    def sum_fees(self, start: str, end: str, instrument: str | None = None) -> DataFrame:
        rows = self.settlements.where(F.col("settled_date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
        rows = rows.where(F.col("instrument") == instrument) if instrument else rows
        zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
        return rows.agg(F.count("*").alias("transactions"), zero("mdr_paise").alias("mdr"), zero("gst_on_mdr_paise").alias("gst"), zero("gross_amount_paise").alias("gross"), zero("net_amount_paise").alias("net"))

    def list_learned_rules(self) -> DataFrame:
        words = {r.rule_id: plain_english(r) for r in self.rules}
        table = as_table(self.orders.sparkSession, self.rules)
        return table.withColumn("meaning", F.element_at(F.create_map(*[F.lit(x) for kv in words.items() for x in kv]), F.col("rule_id")))

    def trace_all(self) -> DataFrame:
        own = self.settlements.select(F.col("settlement_txn_id").alias("s_id"), "order_id_claimed", "net_amount_paise")
        return self.bank_matches.join(own, "s_id").select("utr", F.col("s_id").alias("settlement_txn_id"), "order_id_claimed", "net_amount_paise")

    def trace_bulk_credit(self, utr: str) -> DataFrame:
        return self.trace_all().where(F.col("utr") == utr)

    def traced_totals(self) -> DataFrame:
        """Each credit with how many settlements make it up, their total, and whether that is the credit to the paisa."""
        made = self.trace_all().groupBy("utr").agg(F.count("*").alias("constituents"), F.sum("net_amount_paise").alias("constituents_total"))
        out = self.credits.join(made, "utr", "left").select("utr", "credit_amount_paise", F.coalesce("constituents", F.lit(0)).alias("constituents"), F.coalesce("constituents_total", F.lit(0)).alias("constituents_total"))
        return out.withColumn("reconciles_exactly", F.col("constituents_total") == F.col("credit_amount_paise"))

    def check_contract_compliance(self) -> DataFrame:
        return audit.compare_to_contract(self.orders, self.settlements, self.config)

    def get_batch_metrics(self, scores: DataFrame, batch_id: str) -> DataFrame:
        return scores.where(F.col("batch_id") == batch_id)

    # -- plain data

    def answer(self, tool: str, **asked) -> dict:
        """The answer of one of ``TOOLS``; unknown tools, bad arguments and failures come as ``{"error": ...}``."""
        if tool not in TOOLS:
            return {"error": f"no such tool {tool}"}
        try:
            return getattr(self, f"_{tool}")(**asked)
        except TypeError as e:
            return {"error": f"bad arguments for {tool}: {e}"}
        except Exception as e:  # a lookup that fails must not end the caller's session
            return {"error": f"{type(e).__name__}: {e}"}

    def _get_transaction(self, record_id: str) -> dict:
        found = _rows(self.record(record_id))
        if not found:
            return {"found": False, "note": f"{record_id!r} is not in the reconciled data"}
        return {"found": True, "record_type": found[0]["record_type"], "record": found[0], "matches": _rows(self.matches_of(record_id)), "exceptions": _rows(self.exceptions_of(record_id))}

    def _list_exceptions(self, batch_id: str | None = None, min_money_at_risk_paise: int = 0, limit: int = 20, status: str | None = "open") -> dict:
        least = int(min_money_at_risk_paise or 0)
        rows = _rows(self.list_exceptions(batch_id, least, int(limit or 20), status))
        return _rows(self.exception_totals(batch_id, least, status))[0] | {"returned": len(rows), "exceptions": rows}

    def _explain_match(self, record_id: str) -> dict:
        rows = _rows(self.explain_match(record_id))
        if not rows:
            return {"found": False, "note": f"no match of {record_id!r} in the reconciled data"}
        counts = lambda i: dict(zip(("times_applied", "times_correct"), self.stats.get(i, (0, 0)), strict=True))
        return {"found": True, "matches": [r | (counts(r["rule_id"]) if r["rule_id"] else {}) for r in rows]}

    def _sum_fees(self, date_from: str, date_to: str, instrument: str | None = None) -> dict:
        sums = _rows(self.sum_fees(str(date_from)[:10], str(date_to)[:10], instrument))[0]
        return {"date_from": str(date_from)[:10], "date_to": str(date_to)[:10], "instrument": instrument or "ALL", **sums, "total_deducted": sums["mdr"] + sums["gst"]}

    def _list_learned_rules(self, include_rejected: bool = True) -> dict:
        active = sorted((r for r in self.rules if r.status == "active"), key=lambda r: r.priority)
        rows = []
        for r in active:
            applied, correct = self.stats.get(r.rule_id, (0, 0))
            rows.append({"rule_id": r.rule_id, "type": r.rule_type, "instrument": r.scope, "plain_english": plain_english(r), "times_applied": applied, "times_correct": correct})
        out = {"active_rules": rows, "active_count": len(rows)}
        if include_rejected:
            rejected = sorted((p for p in self.proposals if p.status == "rejected"), key=lambda p: -p.occurrences)[:10]
            out["rejected_proposals"] = [{"plain_english": plain_english(p.rule), "times_proposed": p.occurrences, "rejected_because": p.reason} for p in rejected]
        return out

    def _trace_bulk_credit(self, utr: str) -> dict:
        total = _rows(self.traced_totals().where(F.col("utr") == utr))
        if not total:
            return {"found": False, "note": f"no bank credit {utr!r} in the reconciled data"}
        return {"found": True, **total[0], "members": _rows(self.trace_bulk_credit(utr))}

    def _check_contract_compliance(self, batch_id: str | None = None) -> dict:
        own = lambda df: df if batch_id is None else df.where(F.col("batch_id") == batch_id)
        orders, settlements = own(self.orders), own(self.settlements)
        rows = _rows(audit.compare_to_contract(orders, settlements, self.config))
        leaks = _rows(audit.leakage_by_instrument(orders, settlements, self.config))
        return {
            "batch_id": batch_id or "all batches", "per_instrument": rows, "instruments_deviating": sorted({r["instrument"] for r in rows if r["agrees"] is False}), "total_fee_leakage_paise": sum(r["leaked_paise"] for r in leaks),
            "transactions_overcharged": sum(r["overcharged"] for r in leaks), "transactions_audited": sum(r["transactions"] for r in leaks), "worst_transactions": _rows(audit.worst_offenders(orders, settlements, self.config, 5)),
        }

    def _get_batch_metrics(self, batch_id: str | None = None) -> dict:
        if self.scores is None:
            return {"found": False, "note": "no scores were given"}
        if batch_id is None:
            return {"learning_curve": _rows(self.scores)}
        rows = _rows(self.get_batch_metrics(self.scores, batch_id))
        return rows[0] if rows else {"found": False, "note": f"no batch {batch_id!r}"}


def _rows(df: DataFrame) -> list[dict]:
    """Rows of a result that is small by what it is: a record's, a top list's, a batch's."""
    return [r.asDict(recursive=True) for r in df.collect()]
