"""Rule predicates: a closed vocabulary of data, never code."""

from __future__ import annotations

import ast
import json
import math
import operator
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import expected_net, rate_literal

TYPES = ("exact_id", "fee_formula", "timing_window", "refund_pattern")
REFUND_CONDITION = "net < expected_net"
# The fee template that a predicate may name, by what its parameters hold.
TEMPLATES = {"rate": "net = gross - round(gross * {rate}) - round(round(gross * {rate}) * {gst})", "flat_paise": "net = gross - {flat_paise} - round({flat_paise} * {gst})"}
#: Numbers of each rule type: field, least, most, and whether it must be there.
_TOLERANCE = ("tolerance_paise", 0, None, False)
_GST = ("params.gst", 0, 1, False)
FIELDS = {
    "exact_id": [_TOLERANCE],
    "fee_formula": [_TOLERANCE, _GST],
    "timing_window": [_TOLERANCE, ("min_working_days", 0, None, True), ("max_working_days", 0, None, True)],
    "refund_pattern": [_TOLERANCE],
}
#: A fee's own amount: a flat one wins over a rate, which isn't looked at then.
FEES = {"flat_paise": ("params.flat_paise", 0, None, True), "rate": ("params.rate", 0, 1, True)}


class PredicateError(ValueError):
    """A predicate outside the vocabulary."""


@dataclass(frozen=True)
class Rule:
    rule_id: int
    rule_type: str
    scope: str = "ALL"
    priority: int = 100
    rate: str | None = None
    gst: str = "0"
    flat_paise: int | None = None
    tolerance: int = 0
    min_days: int | None = None
    max_days: int | None = None
    status: str = "active"

    def covers(self, instrument: Column) -> Column:
        return F.lit(True) if self.scope == "ALL" else instrument == self.scope

    def net_of(self, gross: Column) -> Column:
        flat = F.lit(self.flat_paise).cast("bigint")
        return expected_net(gross, rate_literal(self.rate or "0"), rate_literal(self.gst), flat)

    def fingerprint(self) -> str:
        """Canonical text without the tolerance, which doesn't tell rules apart."""
        number = lambda x: None if x is None else float(f"{float(x):.6f}")
        told = {"type": self.rule_type, "instrument": self.scope, "rate": number(self.rate), "gst": number(self.gst) if self.rule_type == "fee_formula" else None, "flat": self.flat_paise, "min": self.min_days, "max": self.max_days}
        return json.dumps({k: v for k, v in told.items() if v is not None}, sort_keys=True, separators=(",", ":"))


def parse(predicate: str | dict, rule_id: int = -1, priority: int = 100) -> Rule:
    """A checked rule, or PredicateError."""
    try:
        told = json.loads(predicate) if isinstance(predicate, str) else dict(predicate)
    except ValueError as e:
        raise PredicateError("not JSON") from e
    if not isinstance(told, dict) or told.get("type") not in TYPES:
        raise PredicateError("unknown rule type")
    kind, params = told["type"], told.get("params")
    fields, fee = list(FIELDS[kind]), None
    if kind == "fee_formula":
        fee = next((f for f in FEES if isinstance(params, dict) and f in params), None)
        if fee is None:
            raise PredicateError("a fee needs a rate or a flat amount")
        if told.get("expr") not in (None, TEMPLATES[fee]):
            raise PredicateError("the expression isn't the template of its parameters")
        fields.append(FEES[fee])
    flat = told | {f"params.{k}": v for k, v in params.items()} if isinstance(params, dict) else told
    numbers = {}
    for name, least, most, needed in fields:
        if name in flat or needed:
            value = flat.get(name)
            if type(value) not in (int, float, Decimal) or not least <= value <= (math.inf if most is None else most):
                raise PredicateError(f"{name} must be a number from {least}" + ("" if most is None else f" to {most}"))
            numbers[name.removeprefix("params.")] = value
    if kind == "timing_window" and numbers["max_working_days"] < numbers["min_working_days"]:
        raise PredicateError("the window ends before it begins")
    if kind == "refund_pattern" and told.get("condition") != REFUND_CONDITION:
        raise PredicateError("unknown refund condition")
    days = [int(numbers[k]) if k in numbers else None for k in ("min_working_days", "max_working_days")]
    rate, own = (str(numbers["rate"]) if fee == "rate" else None), (int(numbers["flat_paise"]) if fee == "flat_paise" else None)
    return Rule(rule_id, kind, told.get("instrument", "ALL"), priority, rate, str(numbers.get("gst", 0)), own, int(numbers.get("tolerance_paise", 0)), *days)


def cleaned(sketch: dict | None) -> dict | None:
    """A proposer's rule sketch (type, instrument, params, tolerance_paise) as a predicate, or None where it can't be one.

    Without a tolerance it gets 2 paise; a refund pattern gets its condition and
    what its shortfall is explained by.
    """
    if not isinstance(sketch, dict) or not sketch.get("type"):
        return None
    given = sketch.get("params") if isinstance(sketch.get("params"), dict) else {}
    extra = {
        "fee_formula": {"params": given},
        "timing_window": {k: given.get(k) for k in ("min_working_days", "max_working_days")},
        "refund_pattern": {"condition": REFUND_CONDITION, "residual_explained_by": "partial_refund"},
    }
    out = {"type": sketch["type"], "instrument": sketch.get("instrument", "ALL"), "tolerance_paise": sketch.get("tolerance_paise", 2)} | extra.get(sketch["type"], {})
    try:
        parse(out)
    except PredicateError:
        return None
    return out


def valid_predicate(text: Column) -> Column:
    """Whether a column of predicate JSON is within the vocabulary, in the engine's own functions."""
    value = F.try_parse_json(text)
    get = lambda name, kind: F.try_variant_get(value, f"$.{name}", kind)
    given = lambda name: get(name, "variant").isNotNull()

    def sound(field: tuple) -> Column:
        name, least, most, needed = field
        number = F.regexp_extract(F.schema_of_variant(get(name, "variant")), r"^\w+", 0).isin("BIGINT", "DOUBLE", "DECIMAL")
        fits = number & (get(name, "double") >= least) & (F.lit(True) if most is None else get(name, "double") <= most)
        fits = F.coalesce(fits, F.lit(False))
        return fits if needed else ~given(name) | fits

    every = lambda fields: reduce(operator.and_, map(sound, fields))
    template = lambda fee: ~given("expr") | F.coalesce(get("expr", "string") == TEMPLATES[fee], F.lit(False))
    fee = F.lit(False)
    for name, field in reversed(FEES.items()):
        fee = F.when(given(field[0]), sound(field) & template(name)).otherwise(fee)
    more = {
        "exact_id": F.lit(True),
        "fee_formula": fee,
        "timing_window": F.coalesce(get("max_working_days", "double") >= get("min_working_days", "double"), F.lit(False)),
        "refund_pattern": F.coalesce(get("condition", "string") == REFUND_CONDITION, F.lit(False)),
    }
    out = F.lit(False)
    for kind in TYPES:
        out = F.when(get("type", "string") == kind, every(FIELDS[kind]) & more[kind]).otherwise(out)
    return out


def plain_english(rule: Rule) -> str:
    who = "every instrument" if rule.scope == "ALL" else rule.scope
    if rule.rule_type == "fee_formula":
        fee = f"a flat {rule.flat_paise} paise" if rule.flat_paise is not None else f"{float(rule.rate):.4%} of the gross"
        return f"For {who}, the fee is {fee} plus {float(rule.gst):.0%} tax, within {rule.tolerance} paise."
    if rule.rule_type == "timing_window":
        return f"For {who}, money arrives {rule.min_days} to {rule.max_days} working days after the order."
    if rule.rule_type == "refund_pattern":
        return f"For {who}, a partly refunded order settles for less than its expected net."
    return f"For {who}, a settlement belongs to the order it names."


_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.Pow: operator.pow}
_CALLS = {"round": round, "abs": abs, "int": int, "min": min, "max": max}


def safe_calculate(text: str):
    """Arithmetic on numbers only; anything else is a ValueError."""

    def value(node):
        match node:
            case ast.Expression(body=body):
                return value(body)
            case ast.Constant(value=int() | float() as x) if not isinstance(x, bool):
                return x
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -value(x)
            case ast.UnaryOp(op=ast.UAdd(), operand=x):
                return value(x)
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _BINARY:
                left, right = value(a), value(b)
                if isinstance(op, ast.Pow) and (abs(right) > 64 or abs(left) > 1e6):
                    raise ValueError("power too large")
                return _BINARY[type(op)](left, right)
            case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in _CALLS:
                return _CALLS[name](*map(value, args))
        raise ValueError("only arithmetic is allowed")

    try:
        return value(ast.parse(text, mode="eval"))
    except (SyntaxError, ZeroDivisionError, TypeError, OverflowError, RecursionError, MemoryError) as e:
        raise ValueError(f"can't calculate: {e}") from e
