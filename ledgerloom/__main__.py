"""python -m ledgerloom: reconcile batches, score them, audit the contract, and ask the lookups."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import load
from .operators import audit, scoring
from .operators.catalog import TOOLS, ReconCatalog
from .operators.summary import bridge_sentence, money_bridge
from .plans.report import as_json, render
from .plans.run import run_batch
from .sources.sinks import drop_all_kept
from .sources.store import Store, batch_folder


#: Columns of the result tables, for a store that has no row of them yet.
RESULTS = {
    "order_matches": "o_order_id string, s_id string, rule_id int, match_kind string, resolved_by string, confidence double, batch_id string",
    "bank_matches": "utr string, s_id string, match_kind string, confidence double, batch_id string",
    "exceptions": "record_type string, record_id string, reason_code string, money_at_risk_paise bigint, status string, batch_id string",
}


def results(store: Store) -> dict[str, DataFrame]:
    found = {name: store.table(name) for name in RESULTS}
    return {name: store.spark.createDataFrame([], kind) if found[name] is None else found[name] for name, kind in RESULTS.items()}


def scored(store: Store, data: str, batches: list[str], config) -> DataFrame:
    """Scores of stored batches against their truth files."""
    found = results(store)
    orders, bank, exceptions = found["order_matches"], found["bank_matches"], found["exceptions"]
    _, settlements, _ = store.ledgers()
    money = settlements.select(F.col("settlement_txn_id").alias("right_id"), F.abs("net_amount_paise").alias("money"))
    links = orders.select("batch_id", F.lit("order").alias("kind"), F.col("o_order_id").alias("left_id"), F.col("s_id").alias("right_id"))
    links = links.unionByName(bank.select("batch_id", F.lit("bank").alias("kind"), F.col("utr").alias("left_id"), F.col("s_id").alias("right_id")))
    truth = None
    for b in batches:
        name = "truth.csv" if b.isdigit() else f"{b}_truth.csv"
        own = scoring.read_truth(store.spark, f"{batch_folder(data, b)}/{name}", b)
        truth = own if truth is None else truth.unionByName(own)
    return scoring.score_batches(links.join(money, "right_id").where(F.col("batch_id").isin(batches)), exceptions.where(F.col("batch_id").isin(batches)), truth, config)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="ledgerloom", description=__doc__)
    p.add_argument("--store", required=True, help="folder of the store")
    p.add_argument("--config", help="YAML file of settings")
    commands = p.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="load and reconcile one batch")
    run.add_argument("--data", required=True)
    run.add_argument("--batch", required=True)
    run.add_argument("--no-learning", action="store_true", help="propose no rules")
    for name in ("report", "contract"):
        c = commands.add_parser(name)
        c.add_argument("--data", required=name == "report")
        c.add_argument("--batch", action="append")
        c.add_argument("--json", action="store_true")
    ask = commands.add_parser("ask", help="a lookup: name and arguments as name=value")
    ask.add_argument("tool", choices=TOOLS)
    ask.add_argument("arguments", nargs="*")
    commands.add_parser("reset")
    told = p.parse_args(argv)

    spark = SparkSession.builder.appName("ledgerloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store, config = Store(spark, told.store.rstrip("/")), load(told.config)
    if told.command == "reset":
        store.reset()
        print("store reset")
    elif told.command == "run":
        store.ingest(told.data, told.batch)
        library = store.load_library()
        extra = {"propose": lambda *_: []} if told.no_learning else {}
        tables = run_batch(*store.ledgers(told.batch), library, config, store.path, all_settlements=store.ledgers()[1], **extra)
        store.save_library(library)
        print(render(tables["run_metrics"], f"Batch {told.batch}"))
    elif told.command == "report":
        batches = told.batch or sorted(r[0] for r in store.table("run_metrics").select("batch_id").distinct().collect())
        scores = scored(store, told.data, batches, config)
        events = store.table("rule_audit")
        activity = spark.createDataFrame([], "event string, n bigint") if events is None else events.groupBy("event").agg(F.count("*").alias("n"))
        if told.json:
            print(json.dumps({"learning_curve": json.loads(as_json(scoring.learning_curve(scores))), "batches": json.loads(as_json(scores)), "rules": json.loads(as_json(activity))}, indent=2))
        else:
            print("\n\n".join([render(scoring.learning_curve(scores), "Learning curve"), render(scores, "Batches"), render(activity, "Rule library")]))
    elif told.command == "contract":
        for b in told.batch or [None]:
            orders, settlements, _ = store.ledgers(b)
            bridge = money_bridge(orders, settlements)
            parts = {"Contract": audit.contract_report(audit.compare_to_contract(orders, settlements, config)), "Money bridge": bridge_sentence(bridge), "Leakage": audit.leakage_by_instrument(orders, settlements, config), "Worst offenders": audit.worst_offenders(orders, settlements, config)}
            for title, df in parts.items():
                print(as_json(df) if told.json else render(df, f"{title}, batch {b or 'all'}") + "\n")
    else:
        library = store.load_library()
        catalog = ReconCatalog(*store.ledgers(), **results(store), rules=library.rules, config=config, proposals=library.proposals, stats=library.stats, scores=store.table("run_metrics"))
        print(json.dumps(catalog.answer(told.tool, **dict(a.split("=", 1) for a in told.arguments)), default=str, ensure_ascii=False, indent=2))
    drop_all_kept(spark)


if __name__ == "__main__":
    main()
