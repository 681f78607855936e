"""The store: ledgers, results and the rule library of all batches as Parquet under one folder."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import Rule
from .export import read_credits, read_export, read_orders
from .sinks import delete_path, drop_kept, kept, replace_batches, reset_store, upsert

#: Ledger tables: their file, reader and key.
LEDGERS = {"orders": ("orders", read_orders, "order_id"), "settlements": ("settlements", read_export, "settlement_txn_id"), "bank_credits": ("bank_statement", read_credits, "utr")}


def batch_folder(data: str, batch_id: str) -> str:
    """Where a batch's files are: ``batch_<number>``, or a named folder of its own."""
    return f"{data}/batch_{batch_id}" if batch_id.isdigit() else f"{data}/{batch_id}"


@dataclass
class Store:
    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame | None:
        """A table with its batch as text, or None before its first row."""
        try:
            df = self.spark.read.parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise
        return df.withColumn("batch_id", F.col("batch_id").cast("string")) if "batch_id" in df.columns else df

    def ingest(self, data: str, batch_id: str) -> dict[str, int]:
        """Load a batch's three files; a row replaces one of its key, whichever batch that came with, and loading twice changes nothing."""
        folder, counts = batch_folder(data, batch_id), {}
        for name, (file, read, key) in LEDGERS.items():
            new = kept(read(self.spark, f"{folder}/{file}.csv", batch_id).withColumn("load_seq", F.monotonically_increasing_id()), f"new-{name}")
            counts[name] = new.count()
            old = self.table(name)
            columns = [c for c in new.columns if c != "load_seq"]
            old = new.limit(0).select(columns) if old is None else old.select(columns)
            touched = {batch_id} | {r[0] for r in old.join(new.select(key), key, "left_semi").select("batch_id").distinct().collect()}  # a row for each batch
            merged = kept(upsert(old.where(F.col("batch_id").isin(*touched)), new, key), f"merged-{name}")
            replace_batches(merged, f"{self.path}/{name}", sorted(touched))
            drop_kept(new)
            drop_kept(merged)
        return counts

    def ledgers(self, batch_id: str | None = None) -> list[DataFrame]:
        """Orders, settlements and credits, of one batch or of all."""
        found = [self.table(name) for name in LEDGERS]
        if any(df is None for df in found):
            raise ValueError(f"nothing is loaded in {self.path}")
        return found if batch_id is None else [df.where(F.col("batch_id") == batch_id) for df in found]

    # the library is driver-side data of some hundred rows: one JSON text

    def save_library(self, library) -> None:
        told = {
            "rules": [asdict(r) for r in library.rules],
            "proposals": [asdict(p) for p in library.proposals],
            "stats": {str(k): v for k, v in library.stats.items()},
        }
        self.spark.createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/rules")

    def load_library(self):
        from ..operators.learning import Proposal
        from ..plans.run import Library

        try:
            told = json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/rules").collect()))
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return Library()
            raise
        proposals = [Proposal(**(p | {"rule": Rule(**p["rule"])})) for p in told["proposals"]]
        return Library([Rule(**r) for r in told["rules"]], proposals, [], {int(k): tuple(v) for k, v in told["stats"].items()})

    def reset(self) -> None:
        reset_store(self.spark, self.path)
        for name in LEDGERS:
            delete_path(self.spark, f"{self.path}/{name}")
