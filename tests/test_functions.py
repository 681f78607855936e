import datetime as dt
import json
from decimal import ROUND_HALF_EVEN, Decimal

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom import config
from ledgerloom.functions import money as M
from ledgerloom.functions.calendar import add_working_days, calendar, in_range, with_lag
from ledgerloom.functions.predicates import TEMPLATES, PredicateError, Rule, cleaned, parse, plain_english, safe_calculate, valid_predicate

C = config.Config()


def col(spark, values, expr, kind="bigint"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(expr).collect()]


def test_apply_rate_rounds_half_to_even(spark):
    assert col(spark, [50, 150, 250, -50, -150], M.apply_rate(F.col("x"), M.rate_literal("0.01"))) == [0, 2, 2, 0, -2]
    amounts = [1, 7, 99, 12345, 10**12 + 7, -(10**12) - 3]
    want = [int((Decimal(a) * Decimal("0.0195")).quantize(Decimal(1), ROUND_HALF_EVEN)) for a in amounts]
    assert col(spark, amounts, M.apply_rate(F.col("x"), M.rate_literal("0.0195"))) == want


def test_fee_rounds_twice_and_flat_wins(spark):
    fee = M.fee_of(F.col("x"), M.rate_literal("0.02"), M.rate_literal("0.18"), F.lit(None).cast("bigint"))
    assert col(spark, [12325], fee) == [246 + 44]
    assert col(spark, [12325], M.fee_of(F.col("x"), M.rate_literal("0.02"), M.rate_literal("0.18"), F.lit(1000))) == [1180]


def test_contract_fee_is_null_for_an_unknown_instrument(spark):
    assert col(spark, [10000], M.contract_fee(F.col("x"), F.lit("WALLET"), C)) == [None]
    assert col(spark, [10000], M.contract_fee(F.col("x"), F.lit("NETBANKING"), C)) == [1416]


def test_format_paise(spark):
    shown = col(spark, [0, 5, 12345, 123456789, -1234567890, 999_999_999], M.format_paise(F.col("x")))
    assert shown == ["₹0.00", "₹0.05", "₹123.45", "₹12,34,567.89", "-₹1,23,45,678.90", "₹99,99,999.99"]
    assert col(spark, [99, 250_000, 12345678, 2_000_000_000], M.short_rupees(F.col("x"))) == ["₹0.99", "₹2.5K", "₹1.23L", "₹2.00Cr"]


def test_negative_tolerance_is_refused():
    with pytest.raises(ValueError, match="negative"):
        M.within_tolerance(F.lit(1), F.lit(2), -1)


@pytest.fixture(scope="module")
def days(spark):
    return calendar(spark, C).cache()


def test_calendar_counts_match_a_loop(spark, days):
    rows = {r["day"]: r for r in days.collect()}
    closed = lambda d: d.weekday() >= 5 or d.strftime("%m-%d") in config.FIXED_HOLIDAYS
    day, before = dt.date(2024, 1, 1), 0
    while day <= dt.date(2027, 12, 31):
        assert rows[day]["before"] == before and rows[day]["is_working"] != closed(day)
        before += not closed(day)
        day += dt.timedelta(days=1)
    assert not rows[dt.date(2025, 8, 15)]["is_working"] and not rows[dt.date(2026, 1, 26)]["is_working"]


def test_lag_is_half_open_and_signed(spark, days):
    df = spark.createDataFrame([(dt.date(2025, 1, 10), dt.date(2025, 1, 13)), (dt.date(2025, 1, 13), dt.date(2025, 1, 10)), (dt.date(2025, 1, 11), dt.date(2025, 1, 12))], "a date, b date")
    assert {(r.a, r.b): r.lag_days for r in with_lag(df, days, "a", "b").collect()} == {(dt.date(2025, 1, 10), dt.date(2025, 1, 13)): 1, (dt.date(2025, 1, 13), dt.date(2025, 1, 10)): -1, (dt.date(2025, 1, 11), dt.date(2025, 1, 12)): 0}


def test_adding_days_rolls_closed_days_forward(spark, days):
    friday, saturday = dt.date(2025, 1, 10), dt.date(2025, 1, 11)
    df = spark.createDataFrame([(friday, 2), (saturday, 0), (saturday, 1)], "d date, n int")
    assert {(r.d, r.n): r.due for r in add_working_days(df, days, "d", "n", "due").collect()} == {(friday, 2): dt.date(2025, 1, 14), (saturday, 0): dt.date(2025, 1, 13), (saturday, 1): dt.date(2025, 1, 14)}


def test_outside_the_calendar_is_an_error(spark):
    with pytest.raises(Exception, match="doesn't cover"):
        spark.createDataFrame([(dt.date(1999, 1, 1),)], "d date").select(in_range(F.col("d"), C)).collect()


@pytest.mark.parametrize(
    "bad",
    ['{"type": "magic"}', "nonsense", '{"type": "fee_formula"}', '{"type": "fee_formula", "params": {"rate": 2}}', '{"type": "fee_formula", "params": {"rate": true}}', '{"type": "timing_window", "min_working_days": 2, "max_working_days": 1}', '{"type": "refund_pattern"}', '{"type": "exact_id", "tolerance_paise": -1}', '{"type": "timing_window", "min_working_days": 1, "max_working_days": 2, "tolerance_paise": -2}']
    + [json.dumps({"type": "fee_formula", "params": {"rate": 0.1}, "expr": TEMPLATES["flat_paise"]}), json.dumps({"type": "fee_formula", "params": {"flat_paise": 1, "gst": 2}})],
)
def test_bad_predicates(spark, bad):
    with pytest.raises(PredicateError):
        parse(bad)
    assert col(spark, [bad], valid_predicate(F.col("x")), "string") == [False]


@pytest.mark.parametrize(
    "good",
    ['{"type": "exact_id", "tolerance_paise": 0}', '{"type": "fee_formula", "params": {"flat_paise": 5, "rate": 7}}', '{"type": "refund_pattern", "condition": "net < expected_net", "tolerance_paise": 3}', '{"type": "timing_window", "min_working_days": 0, "max_working_days": 1.5}']
    + [json.dumps({"type": "fee_formula", "params": {k: 0}, "expr": t}) for k, t in TEMPLATES.items()],
)
def test_good_predicates(spark, good):
    assert parse(good).tolerance == json.loads(good).get("tolerance_paise", 0)
    assert col(spark, [good], valid_predicate(F.col("x")), "string") == [True]


def test_a_proposers_sketch_becomes_a_predicate_or_nothing():
    assert cleaned({"type": "timing_window", "params": {"min_working_days": 1, "max_working_days": 2}}) == {"type": "timing_window", "instrument": "ALL", "tolerance_paise": 2, "min_working_days": 1, "max_working_days": 2}
    assert cleaned({"type": "refund_pattern", "instrument": "UPI"})["residual_explained_by"] == "partial_refund"
    assert cleaned({"type": "fee_formula", "params": {}}) is None and cleaned(None) is None and cleaned({"type": "magic"}) is None


def test_fingerprint_ignores_the_tolerance():
    text = '{"type": "fee_formula", "instrument": "UPI", "params": {"rate": 0.01, "gst": 0.18}, "tolerance_paise": %d}'
    assert parse(text % 2).fingerprint() == parse(text % 9).fingerprint()
    assert "tax" in plain_english(parse(text % 2))


@given(st.integers(-1000, 1000), st.integers(1, 50))
def test_calculator_does_arithmetic(a, b):
    assert safe_calculate(f"({a}) * {b} + round({a} / {b})") == a * b + round(a / b)


@pytest.mark.parametrize("bad", ["__import__('os')", "open('x')", "a + 1", "(1).__class__", "9 ** 9999", "[1][0]", "1 if 1 else 2", "True + 1"])
def test_calculator_refuses_the_rest(bad):
    with pytest.raises(ValueError):
        safe_calculate(bad)


def test_config_from_the_environment_and_its_invariant(tmp_path):
    assert config.load(environ={"LEDGERLOOM_WINDOW_DAYS": "9"}).window_days == 9
    with pytest.raises(ValueError):
        config.Config(unexplained_cost=10.0)
    (tmp_path / ".env").write_text("# a comment\n\nLEDGERLOOM_WINDOW_DAYS = '4'\nLEDGERLOOM_SUBSET_DELTA=7\nOTHER\n")
    told = config.load(environ={"LEDGERLOOM_SUBSET_DELTA": "9"}, env_file=str(tmp_path / ".env"))
    assert (told.window_days, told.subset_delta) == (4, 9)
    with pytest.raises(ValueError):
        config.Config(sink_cost=1000.0)


def test_rules_cover_their_scope(spark):
    rule = Rule(1, "fee_formula", "UPI", rate="0")
    assert col(spark, ["UPI", "CARD_DEBIT"], rule.covers(F.col("x")), "string") == [True, False]
