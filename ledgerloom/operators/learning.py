"""How the rule library grows: intake, backtest, gate, promotion, statistics, retirement, discovery."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import ESCALATED, Config
from ..functions.calendar import calendar, with_lag
from ..functions.predicates import REFUND_CONDITION, PredicateError, Rule, parse
from .matching import pairs_of
from .rules import as_table, cycles, ordered, overlaps, verdict


@dataclass(frozen=True)
class Proposal:
    rule: Rule
    confidence: float
    occurrences: int = 1
    status: str = "pending"
    reason: str = ""

    @property
    def fingerprint(self) -> str:
        return self.rule.fingerprint()


def intake(known: Sequence[Proposal], new: Sequence[tuple[str, float]], active: Sequence[Rule], config: Config, audit: list[tuple[str, str, str]] | None = None) -> list[Proposal]:
    """Merge proposed predicates: repeats count up, confidence is a running mean, tolerance is capped on merging.

    ``audit`` gets a row for each: proposed, or rejected as unreadable or as a
    duplicate of an active rule.
    """
    audit = [] if audit is None else audit
    out = {p.fingerprint: p for p in known}
    taken = {r.fingerprint(): r.rule_id for r in active if r.status == "active"}
    for text, confidence in new:
        try:
            rule = parse(text)
        except PredicateError as e:
            audit.append(("rejected", "", json.dumps({"gate": "schema", "error": str(e), "predicate": text})))
            continue
        key = rule.fingerprint()
        if key in taken:
            audit.append(("rejected", key, json.dumps({"gate": "duplicate", "of_rule": taken[key]})))
            continue
        audit.append(("proposed", key, json.dumps({"predicate": text, "confidence": confidence})))
        old = out.get(key)
        if old is None:
            out[key] = Proposal(rule, confidence)
        else:
            n = old.occurrences + 1
            tolerance = min(max(old.rule.tolerance, rule.tolerance), config.max_tolerance)
            out[key] = replace(old, rule=replace(old.rule, tolerance=tolerance), occurrences=n, confidence=old.confidence + (confidence - old.confidence) / n)
    return list(out.values())


def intake_table(proposals: DataFrame, config: Config) -> DataFrame:
    """The same merge for a table (fingerprint, confidence, tolerance)."""
    n = F.count("*")
    widest = F.max("tolerance")
    return proposals.groupBy("fingerprint").agg(n.alias("occurrences"), F.round(F.avg("confidence"), 6).alias("confidence"), F.when(n > 1, F.least(widest, F.lit(config.max_tolerance))).otherwise(widest).alias("tolerance"))


def evidence(orders: DataFrame, settlements: DataFrame, order_matches: DataFrame, bank_matched: DataFrame, config: Config) -> DataFrame:
    """Pairs that recorded matches or the bank vouch for.

    ``in_parts`` marks orders with more than one settlement row, be it a leg or a
    reversal: no rule is judged on them.  Both kinds of voucher are one list of
    (order or null, settlement), so the pairs are joined once.
    """
    pairs = pairs_of(orders, settlements).withColumn("claims", F.count("*").over(Window.partitionBy("batch_id", "o_order_id")))
    vouched = order_matches.select("s_id", "o_order_id").unionByName(bank_matched.select("s_id", F.lit(None).cast("string").alias("o_order_id")))
    vouched = vouched.groupBy("s_id").agg(F.collect_set("o_order_id").alias("bound"), F.count_if(F.col("o_order_id").isNull()).alias("by_bank"))
    both = pairs.join(vouched, "s_id").where((F.col("by_bank") > 0) | F.array_contains("bound", F.col("o_order_id"))).drop("bound", "by_bank")
    marked = both.withColumn("in_parts", F.col("claims") > 1).drop("claims")
    return with_lag(marked, calendar(orders.sparkSession, config), "o_date", "s_date")


def judged_by(rule: Rule, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """What a candidate says of an evidence row, and whether that counts."""
    says = verdict(rule, rules)
    return says, ~F.col("in_parts") & says.isNotNull() & ((F.col("o_status") == "captured") | F.lit(rule.rule_type == "refund_pattern"))


def counterexamples(rows: DataFrame, rule: Rule, rules: Sequence[Rule], most: int = 5) -> DataFrame:
    """The first ``most`` evidence rows, by order and settlement, that contradict a candidate (a report, not a measure)."""
    says, usable = judged_by(rule, rules)
    off = F.abs(F.col("s_net") - rule.net_of(F.col("s_gross"))) if rule.rule_type == "fee_formula" else F.lit(None).cast("bigint")
    return rows.where(usable & ~says).orderBy("o_order_id", "s_id").limit(most).select("o_order_id", "s_id", "s_gross", "s_net", off.alias("deviation"))


def backtest(rows: DataFrame, candidates: Sequence[Rule], rules: Sequence[Rule]) -> DataFrame:
    """Support, correct, wrong, skipped, precision and largest deviation of all candidates, in one pass over the evidence."""
    measures = []
    for r in candidates:
        says, usable = judged_by(r, rules)
        off = F.abs(F.col("s_net") - r.net_of(F.col("s_gross"))) if r.rule_type == "fee_formula" else F.lit(0).cast("bigint")
        wrong = usable & ~says
        measures.append(
            F.struct(
                F.lit(r.rule_id).alias("rule_id"), F.count_if(usable).alias("support"), F.count_if(usable & says).alias("correct"), F.count_if(wrong).alias("wrong"), F.count_if(~usable).alias("skipped"),
                F.coalesce(F.max(F.when(usable, off)), F.lit(0)).cast("bigint").alias("max_deviation"), F.coalesce(F.sum(F.when(wrong, F.abs("s_net"))), F.lit(0)).cast("bigint").alias("wrong_money"),
            )
        )
    found = rows.agg(*[m.alias(f"m{i}") for i, m in enumerate(measures)])
    found = found.select(F.explode(F.array(*[F.col(f"m{i}") for i in range(len(measures))])).alias("m")).select("m.*")
    return found.withColumn("precision", F.when(F.col("support") > 0, F.round(F.col("correct") / F.col("support"), 6)).otherwise(0.0))


def gate(proposals: DataFrame, config: Config) -> DataFrame:
    """Which gates fail for rows (fingerprint, occurrences, confidence, support, correct, wrong, max_deviation, wrong_money, conflicts), and the decision.

    Failing only for lack of evidence leaves a proposal pending; anything else rejects it.
    """
    noise = (F.col("wrong") > 0) & (F.col("max_deviation") <= config.noise_paise)
    precision = F.when(noise, 1.0).otherwise(F.when(F.col("support") > 0, F.col("correct") / F.col("support")).otherwise(0.0))
    fatal = (F.col("wrong") > 0) & (F.col("wrong_money") > config.gate_money_at_risk) & ~noise
    thin = F.col("support") < config.gate_support
    gates = {
        "occurrence": F.col("occurrences") < config.gate_occurrences,
        "confidence": F.col("confidence") < config.gate_confidence,
        "support": thin & ~fatal,
        "backtest": fatal | (~thin & (precision < config.gate_precision)),
        "conflict": F.col("conflicts") > 0,
    }
    failed = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in gates.items()]))
    soft = F.array(*map(F.lit, ("occurrence", "confidence", "support")))
    decision = F.when(F.size("failed") == 0, "promoted").when(F.size(F.array_except("failed", soft)) == 0, "pending").otherwise("rejected")
    return proposals.withColumn("failed", failed).withColumn("decision", decision).withColumn("failed", F.array_join("failed", "+"))


def most_frequent(proposals: DataFrame, most: int) -> DataFrame:
    """The ``most`` proposals (a report's limit) that were made most often."""
    return proposals.orderBy(F.desc("occurrences"), "fingerprint").limit(most)


def conflicts_of(spark: SparkSession, rule: Rule, rules: Sequence[Rule], config: Config) -> int:
    """Contradictions and overlaps that the rule would bring to the library at its priority."""
    trial = replace(rule, rule_id=-1, status="active", priority=config.priority_all if rule.scope == "ALL" else config.priority_scoped)
    together = [r for r in rules if r.status == "active"] + [trial]
    return sum(-1 in p for p in cycles(together)) + sum(-1 in p for p in overlaps(spark, together))


def review(proposals: Sequence[Proposal], rules: Sequence[Rule], rows: DataFrame, config: Config) -> tuple[list[Proposal], list[Rule], list[tuple[str, str, str]]]:
    """Gate pending proposals, most frequent first; a promotion counts for those after it.

    Only refund patterns consult the library's fee rules, so all other proposals
    are backtested together in one job; a refund pattern is backtested when its
    turn comes, against the library as promoted until then.
    """
    spark = rows.sparkSession
    rules, audit = list(rules), []
    pending = sorted((p for p in proposals if p.status == "pending"), key=lambda p: -p.occurrences)
    done = [p for p in proposals if p.status != "pending"]
    numbered = [replace(p.rule, rule_id=i) for i, p in enumerate(pending)]
    alone = [r for r in numbered if r.rule_type != "refund_pattern"]
    results = {r["rule_id"]: r for r in backtest(rows, alone, ()).collect()} if alone else {}
    for i, p in enumerate(pending):
        library = ordered(rules)
        r = results[i] if i in results else backtest(rows, [numbered[i]], library).first()
        row = [(p.fingerprint, p.occurrences, p.confidence, r["support"], r["correct"], r["wrong"], r["max_deviation"], r["wrong_money"], conflicts_of(spark, p.rule, rules, config))]
        got = gate(spark.createDataFrame(row, "fingerprint string, occurrences int, confidence double, support bigint, correct bigint, wrong bigint, max_deviation bigint, wrong_money bigint, conflicts int"), config).first()
        done.append(replace(p, status=got["decision"], reason=got["failed"]))
        against = [x.asDict() for x in counterexamples(rows, numbered[i], library).collect()] if r["wrong"] else []
        report = {"gates_failed": got["failed"], "occurrences": p.occurrences, "confidence": p.confidence, "conflicts": row[0][-1], "backtest": r.asDict() | {"rule_id": None, "counterexamples": against}}
        if got["decision"] == "promoted":
            rules.append(replace(p.rule, rule_id=1 + max([0, *(x.rule_id for x in rules)]), priority=config.priority_all if p.rule.scope == "ALL" else config.priority_scoped, status="active"))
            report["rule_id"] = rules[-1].rule_id
        audit.append((got["decision"], p.fingerprint, json.dumps(report, sort_keys=True)))
    return done, rules, audit


def contested_settlements(matches: DataFrame) -> DataFrame:
    """Settlements bound to more than one order."""
    return matches.groupBy("s_id").agg(F.count_distinct("o_order_id").alias("orders")).where("orders > 1")


def overbound_orders(matches: DataFrame) -> DataFrame:
    """Orders bound to more than two settlements."""
    return matches.groupBy("o_order_id").agg(F.count_distinct("s_id").alias("settlements")).where("settlements > 2")


def rule_stats(matches: DataFrame) -> DataFrame:
    """Times each rule explained a match, and how often nothing contests that match."""
    judged = matches.join(contested_settlements(matches).select("s_id", F.lit(True).alias("contested")), "s_id", "left").join(overbound_orders(matches).select("o_order_id", F.lit(True).alias("overbound")), "o_order_id", "left")
    good = F.col("contested").isNull() & F.col("overbound").isNull()
    return judged.where("rule_id IS NOT NULL").groupBy("rule_id").agg(F.count("*").alias("times_applied"), F.count_if(good).alias("times_correct"))


def supporting_stats(order_matches: DataFrame, pairs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Times each timing rule in scope supported an exact match; nothing contests a supporting rule."""
    matched = order_matches.where("match_kind = 'exact'").select("s_id").join(pairs.select("s_id", "s_instrument"), "s_id")
    timing = [r for r in rules if r.rule_type == "timing_window" and r.status == "active"]
    if not timing:
        return matched.select(F.lit(0).alias("rule_id"), F.lit(0).cast("bigint").alias("times_applied"), F.lit(0).cast("bigint").alias("times_correct")).limit(0)
    counts = matched.agg(*[F.count_if(r.covers(F.col("s_instrument"))).alias(f"r{r.rule_id}") for r in timing])
    rows = counts.select(F.explode(F.array(*[F.struct(F.lit(r.rule_id).alias("rule_id"), F.col(f"r{r.rule_id}").alias("times_applied")) for r in timing])).alias("x")).select("x.*")
    return rows.withColumn("times_correct", F.col("times_applied"))


def retired(stats: DataFrame, config: Config) -> DataFrame:
    accuracy = F.col("times_correct") / F.col("times_applied")
    return stats.where((F.col("times_applied") >= config.retire_after) & (accuracy < config.retire_accuracy)).select("rule_id", "times_applied", "times_correct", F.round(accuracy, 6).alias("accuracy"))


def reopened(matches: DataFrame, gone: DataFrame, settlements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Matches that stay, and the exceptions that retired rules' matches become, with their settlement's money."""
    gone = gone.select("rule_id")
    keep = matches.join(gone, "rule_id", "left_anti")
    money = settlements.select("batch_id", F.col("settlement_txn_id").alias("s_id"), F.abs("net_amount_paise").alias("money_at_risk_paise"))
    lost = matches.join(gone, "rule_id", "left_semi").join(money, ["batch_id", "s_id"])
    return keep.select(matches.columns), lost.select("batch_id", F.lit("settlement").alias("record_type"), F.col("s_id").alias("record_id"), F.lit("RULE_RETIRED").alias("reason_code"), "money_at_risk_paise")


def build_cases(exceptions: DataFrame, orders: DataFrame, settlements: DataFrame, proposals: Sequence[Proposal], config: Config, most: int = 5) -> DataFrame:
    """What a proposer is shown of each exception: the record, up to ``most`` candidate orders with their lags, and the ``most`` most frequent proposals.

    Candidates of a settlement are the order that it claims and the orders of its
    batch with its gross within its window, nearest date first; other records
    have none.  Lists of ``most`` are the feature: a case is read by a person or a model.
    """
    days = calendar(orders.sparkSession, config)
    e = exceptions.select("batch_id", "record_type", "record_id", "reason_code", "money_at_risk_paise")
    s = settlements.select("batch_id", F.col("settlement_txn_id").alias("record_id"), F.col("order_id_claimed").alias("claimed"), F.col("settled_date").alias("s_date"), F.col("gross_amount_paise").alias("gross"), F.col("net_amount_paise").alias("net"), "instrument")
    own = e.where("record_type = 'settlement'").join(s, ["batch_id", "record_id"])
    o = orders.select("batch_id", "order_id", F.col("order_date").alias("o_date"), F.col("gross_amount_paise").alias("gross"))
    claimed = own.join(o.drop("gross").withColumnRenamed("order_id", "claimed"), ["batch_id", "claimed"]).withColumn("order_id", F.col("claimed"))
    equal = own.join(o, ["batch_id", "gross"]).where("order_id <> claimed AND o_date <= s_date")
    columns = ["batch_id", "record_id", "order_id", "o_date", "s_date"]
    near = with_lag(claimed.select(columns).unionByName(equal.select(columns)), days, "o_date", "s_date").where(F.col("lag_days").between(0, config.window_days))
    place = F.row_number().over(Window.partitionBy("batch_id", "record_id").orderBy("lag_days", "order_id"))
    listed = near.withColumn("place", place).where(F.col("place") <= most).groupBy("batch_id", "record_id").agg(F.array_sort(F.collect_list(F.struct("lag_days", "order_id"))).alias("candidates"))
    prior = [f"{p.rule.rule_type}/{p.rule.scope}/{p.occurrences}/{p.status}" for p in sorted(proposals, key=lambda p: -p.occurrences)[:most]]
    record = s.select("batch_id", "record_id", F.to_json(F.struct("claimed", "s_date", "gross", "net", "instrument")).alias("record"))
    out = e.join(listed, ["batch_id", "record_id"], "left").join(record, ["batch_id", "record_id"], "left")
    none = F.array().cast("array<struct<lag_days:bigint,order_id:string>>")
    return out.withColumn("candidates", F.coalesce("candidates", none)).withColumn("prior_proposals", F.array(*map(F.lit, prior)).cast("array<string>"))


def escalation_queue(exceptions: DataFrame) -> DataFrame:
    """Exceptions worth a proposer's time, the most money first."""
    rank = F.row_number().over(Window.partitionBy("batch_id").orderBy(F.desc("money_at_risk_paise"), "record_id"))
    return exceptions.where(F.col("reason_code").isin(*ESCALATED)).withColumn("place", rank)


def discovery_pool(pairs: DataFrame, config: Config) -> DataFrame:
    """Samples of singly claimed captured orders for each batch and instrument, to learn timing from.

    Samples are a feature of discovery: a proposer reads a few cases.
    """
    alone = F.count("*").over(Window.partitionBy("batch_id", "o_order_id"))
    place = F.row_number().over(Window.partitionBy("batch_id", "s_instrument").orderBy("o_order_id", "s_id"))
    rows = pairs.where("o_status = 'captured'").withColumn("alone", alone).where("alone = 1").withColumn("place", place).where(F.col("place") <= config.discovery_samples * config.discovery_size)
    sampled = rows.withColumn("sample", F.expr(f"(place - 1) div {config.discovery_size}"))
    return sampled.withColumn("n", F.count("*").over(Window.partitionBy("batch_id", "s_instrument", "sample"))).where(F.col("n") >= config.discovery_least)


def confident(verdicts: DataFrame, config: Config) -> DataFrame:
    """A proposer's match below the floor is no match; its rule proposal survives."""
    low = (F.col("verdict") == "match") & (F.col("confidence") < config.confidence_floor)
    return verdicts.withColumns({"verdict": F.when(low, "insufficient_information").otherwise(F.col("verdict")), "candidate": F.when(~low, F.col("candidate"))})


#: A proposer reads cases of a batch and returns (predicate JSON, confidence); it never writes a match.
Proposer = Callable[[DataFrame], list[tuple[str, float]]]


def statistical_proposer(orders: DataFrame, settlements: DataFrame, config: Config) -> list[tuple[str, float]]:
    """Rules read off independent parts of a batch, each part proposing for itself.

    Fees come from each part's observed schedule, timing from the commonest lag
    of each instrument, and the refund pattern from parts in which partly
    refunded orders settle for less than charged amounts explain.
    """
    from .audit import observed_schedule

    part = F.pmod(F.xxhash64("order_id_claimed"), F.lit(config.discovery_samples)).alias("part")
    schedules, lags, refunds = [], [], []
    days = calendar(orders.sparkSession, config)
    for i in range(config.discovery_samples):
        own = settlements.where(part == i)
        schedules.append(observed_schedule(orders, own, config, config.discovery_least))
        lagged = with_lag(pairs_of(orders, own), days, "o_date", "s_date")
        lags.append(lagged.where("o_status = 'captured'").groupBy("batch_id", "s_instrument").agg(F.mode("lag_days", True).alias("lag"), F.count("*").alias("n")))
        refunds.append(lagged.where("o_status = 'refunded_partial' AND s_net < s_gross").agg(F.count("*").alias("n")))
    together = lambda dfs: [r for df in dfs for r in df.collect()]  # noqa: E731  parts x batches x instruments rows
    out = []
    for r in sorted(together(schedules), key=str):
        params = {"gst": float(config.gst)} | ({"flat_paise": r["flat_paise"]} if r["flat_paise"] is not None else {"rate": r["rate"]})
        out.append((json.dumps({"type": "fee_formula", "instrument": r["instrument"], "params": params, "tolerance_paise": 2}), 0.9))
    for r in sorted(together(lags), key=str):
        if r["n"] >= config.discovery_least:
            out.append((json.dumps({"type": "timing_window", "instrument": r["s_instrument"], "min_working_days": r["lag"], "max_working_days": r["lag"]}), 0.9))
    for r in together(refunds):
        if r["n"] >= config.discovery_least:
            out.append((json.dumps({"type": "refund_pattern", "condition": REFUND_CONDITION}), 0.9))
    return out


__all__ = ["Proposal", "Proposer", "as_table", "backtest", "build_cases", "confident", "conflicts_of", "counterexamples", "discovery_pool", "escalation_queue", "evidence", "gate", "intake", "intake_table", "most_frequent", "overbound_orders", "reopened", "retired", "review", "rule_stats", "statistical_proposer", "supporting_stats"]
