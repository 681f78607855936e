"""Files in, store, command line: two small batches of our own."""

import json

import pytest

from ledgerloom.__main__ import main
from ledgerloom.operators.learning import Proposal
from ledgerloom.plans.run import Library
from ledgerloom.sources.export import EXPORT_COLUMNS
from ledgerloom.sources.store import Store, batch_folder

DAY = 86_400
START = 1_736_150_400  # Monday, 6 January 2025, in UTC


def write_batch(folder, number, n=30, extra=()):
    """Orders 100 rupees apart by UPI without a fee, settled a working day later, paid by the bank in one sum."""
    folder.mkdir(parents=True)
    orders, rows, truth = [], [], []
    for k in range(n):
        gross = 10_000 * (k + 1) + number
        orders.append(f"O-{number}-{k},name {k},2025-01-06T10:0{k % 10}:00,{gross},UPI,captured")
        rows.append({"entity_id": f"S-{number}-{k}", "type": "payment", "debit": 0, "credit": gross, "amount": gross, "fee": 0, "tax": 0, "settled_at": START + DAY, "settlement_id": f"G-{number}", "order_receipt": f"O-{number}-{k}", "method": "upi"})
        truth.append(f"O-{number}-{k},S-{number}-{k},U-{number},clean,")
    total = sum(r["credit"] for r in rows)
    (folder / "orders.csv").write_text("order_id,customer_name,order_datetime,gross_amount_paise,instrument,status\n" + "\n".join([*orders, *extra]) + "\n")
    (folder / "settlements.csv").write_text(",".join(EXPORT_COLUMNS) + "\n" + "\n".join(",".join(str(r.get(c, "")) for c in EXPORT_COLUMNS) for r in rows) + "\n")
    (folder / "bank_statement.csv").write_text(f"utr,credit_datetime,credit_amount_paise,narration\nU-{number},2025-01-07T21:30:00,{total},NEFT\n")
    (folder / "truth.csv").write_text("order_id,settlement_txn_id,utr,case_type,trap_type\n" + "\n".join(truth) + "\n")


@pytest.fixture(scope="module")
def data(tmp_path_factory):
    folder = tmp_path_factory.mktemp("data")
    write_batch(folder / "batch_1", 1)
    write_batch(folder / "batch_2", 2, extra=("O-1-0,moved here,2025-01-06T11:00:00,777,UPI,captured",))
    return str(folder)


def test_loading_twice_changes_nothing_and_a_later_key_wins(spark, data, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    with pytest.raises(ValueError, match="nothing"):
        store.ledgers()
    first = store.ingest(data, "1")
    assert first == store.ingest(data, "1") == {"orders": 30, "settlements": 30, "bank_credits": 1}
    assert [df.count() for df in store.ledgers()] == [30, 30, 1]
    store.ingest(data, "2")
    found = {r["order_id"]: r["batch_id"] for r in store.ledgers()[0].collect()}
    assert len(found) == 60 and found["O-1-0"] == "2" and store.ledgers("1")[0].count() == 29
    assert batch_folder("d", "7") == "d/batch_7" and batch_folder("d", "traps") == "d/traps"
    store.reset()
    assert store.table("orders") is None


def test_the_library_comes_back(spark, tmp_path):
    from ledgerloom.plans.batch import LIBRARY

    store = Store(spark, str(tmp_path / "s"))
    assert store.load_library().rules == Library().rules
    library = Library(list(LIBRARY), [Proposal(LIBRARY[3], 0.8, 4, "rejected", "backtest")], [], {2: (5, 4)})
    store.save_library(library)
    store.save_library(library)
    again = store.load_library()
    assert (again.rules, again.proposals, again.stats) == (library.rules, library.proposals, library.stats)


def test_batches_from_the_command_line(spark, data, tmp_path, capsys):
    store = str(tmp_path / "s")
    for batch in ("1", "2"):
        main(["--store", store, "run", "--data", data, "--batch", batch])
    out = capsys.readouterr().out
    assert "Batch 1" in out and "match_rate" in out
    main(["--store", store, "report", "--data", data, "--json"])
    told = json.loads(capsys.readouterr().out)
    assert [b["batch_id"] for b in told["learning_curve"]] == ["1", "2"] and all(b["false_positives"] == 0 and b["precision"] == 1.0 for b in told["batches"])
    assert {r["event"] for r in told["rules"]} >= {"proposed", "promoted"}
    main(["--store", store, "report", "--data", data, "--batch", "1"])
    main(["--store", store, "contract", "--batch", "2"])
    out = capsys.readouterr().out
    assert "Learning curve" in out and "Leakage, batch 2" in out
    main(["--store", store, "ask", "trace_bulk_credit", "utr=U-1"])
    traced = json.loads(capsys.readouterr().out)
    assert traced["reconciles_exactly"] and traced["constituents"] == 30
    main(["--store", store, "ask", "list_exceptions", "limit=2"])
    assert json.loads(capsys.readouterr().out)["count_matching"] >= 1
    main(["--store", store, "reset"])
    assert "reset" in capsys.readouterr().out and Store(spark, store).table("exceptions") is None
