"""Running batches one after the other: links and exceptions out, rules learned for the next."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.predicates import Rule
from ..operators import learning
from ..operators.audit import compare_to_contract, leakage_by_instrument
from ..operators.summary import run_metrics
from ..sources.sinks import append_audit, drop_kept, kept, replace_batches
from .batch import SEED, Reconciliation


@dataclass
class Library:
    """The only state that goes from batch to batch."""

    rules: list[Rule] = field(default_factory=lambda: list(SEED))
    proposals: list[learning.Proposal] = field(default_factory=list)
    audit: list[tuple[str, str, str]] = field(default_factory=list)
    stats: dict[int, tuple[int, int]] = field(default_factory=dict)  # rule: times applied, times correct

    def add_stats(self, rows: DataFrame) -> None:
        for r in rows.collect():  # a row for each rule
            applied, correct = self.stats.get(r["rule_id"], (0, 0))
            self.stats[r["rule_id"]] = applied + r["times_applied"], correct + r["times_correct"]

    def retire(self, spark: SparkSession, config: Config) -> DataFrame:
        """Take rules that stopped being right out of use; their rows (rule_id, times_applied, times_correct, accuracy)."""
        active = {r.rule_id: r for r in self.rules if r.status == "active"}
        table = spark.createDataFrame([(k, *v) for k, v in self.stats.items() if k in active], "rule_id int, times_applied bigint, times_correct bigint")
        gone = learning.retired(table, config).collect()
        names = {r["rule_id"] for r in gone}
        self.rules = [replace(r, status="retired") if r.rule_id in names else r for r in self.rules]
        self.audit += [("retired", active[r["rule_id"]].fingerprint(), json.dumps(r.asDict() | {"floor": config.retire_accuracy}, sort_keys=True)) for r in gone]
        return spark.createDataFrame(gone, "rule_id int, times_applied bigint, times_correct bigint, accuracy double")


def withdraw(out: str, gone: DataFrame, matches: DataFrame, exceptions: DataFrame, settlements: DataFrame) -> None:
    """Take retired rules' matches out of the stored batches and open them as exceptions.

    ``matches`` and ``exceptions`` are this batch's tables; stored ones have their columns.
    """
    read = gone.sparkSession.read
    try:
        old, opened = read.schema(matches.schema).parquet(f"{out}/order_matches"), read.schema(exceptions.schema).parquet(f"{out}/exceptions")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return
        raise
    batches = [r[0] for r in old.join(gone.select("rule_id"), "rule_id", "left_semi").select("batch_id").distinct().collect()]
    if batches:
        keep, lost = learning.reopened(old.where(F.col("batch_id").isin(batches)), gone, settlements)
        keep = kept(keep, "kept-matches")
        lost = kept(opened.where(F.col("batch_id").isin(batches)).unionByName(lost.withColumn("status", F.lit("open"))), "reopened")
        replace_batches(keep, f"{out}/order_matches", batches)
        replace_batches(lost, f"{out}/exceptions", batches)
        drop_kept(keep)
        drop_kept(lost)


def run_batch(
    orders: DataFrame, settlements: DataFrame, credits: DataFrame, library: Library, config: Config, out: str | None = None, propose=learning.statistical_proposer, all_settlements: DataFrame | None = None
) -> dict[str, DataFrame]:
    """One batch under a snapshot of the library; then rules are judged, gated and retired.

    A retired rule's matches, of this batch and of stored earlier ones (whose
    money ``all_settlements`` tells), become RULE_RETIRED exceptions.
    """
    spark = orders.sparkSession
    batches = [r[0] for r in orders.select("batch_id").unionByName(settlements.select("batch_id")).unionByName(credits.select("batch_id")).distinct().collect()]
    recon = Reconciliation(orders, settlements, credits, tuple(library.rules), config)
    matches, bank, exceptions = recon.order_matches(), recon.bank_matches(), recon.exceptions()
    seen = len(library.audit)
    library.add_stats(learning.rule_stats(matches))
    library.add_stats(learning.supporting_stats(matches, recon.identity, library.rules))
    library.proposals = learning.intake(library.proposals, propose(orders, settlements, config), library.rules, config, library.audit)
    rows = kept(learning.evidence(orders, settlements, matches, bank, config), "evidence")
    library.proposals, library.rules, audit = learning.review(library.proposals, library.rules, rows, config)
    library.audit += audit
    gone = library.retire(spark, config)
    matches, reopened = learning.reopened(matches, gone, settlements)
    exceptions = exceptions.unionByName(reopened)
    drop_kept(rows)
    tables = {
        "order_matches": matches,
        "bank_matches": bank,
        "exceptions": exceptions.withColumn("status", F.lit("open")),
        "run_metrics": run_metrics(orders, settlements, credits, matches, bank, exceptions),
        "leakage": leakage_by_instrument(orders, settlements, config),
        "contract": compare_to_contract(orders, settlements, config),
    }
    if out:
        withdraw(out, gone, tables["order_matches"], tables["exceptions"], settlements if all_settlements is None else all_settlements)
        for name in ("order_matches", "bank_matches", "exceptions", "run_metrics"):
            replace_batches(tables[name], f"{out}/{name}", batches)
        if len(library.audit) > seen:
            append_audit(spark, library.audit[seen:], f"{out}/rule_audit")
    return tables


def run_sequence(orders: DataFrame, settlements: DataFrame, credits: DataFrame, batches: Sequence[str], config: Config, out: str | None = None) -> tuple[Library, dict[str, dict[str, DataFrame]]]:
    """Batches in order; each is read by its partition only."""
    library, results = Library(), {}
    for batch in batches:
        own = [df.where(F.col("batch_id") == batch) for df in (orders, settlements, credits)]
        results[batch] = run_batch(*own, library, config, out, all_settlements=settlements)
    return library, results
