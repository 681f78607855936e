"""Money as integer paise: Column expressions that stay in whole-stage codegen."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Config

AMOUNT, RATE = "decimal(19,0)", "decimal(18,12)"


def rate_literal(rate: str | Decimal) -> Column:
    return F.lit(str(rate)).cast(RATE)


def apply_rate(amount: Column, rate: Column) -> Column:
    """Half-even percentage of integer paise, never through floating point."""
    return F.bround(amount.cast(AMOUNT) * rate.cast(RATE), 0).cast("bigint")


def fee_of(gross: Column, rate: Column, gst: Column, flat: Column) -> Column:
    """Fee and the tax on it: two roundings, the fee first; a flat fee wins over a rate."""
    fee = F.coalesce(flat.cast("bigint"), apply_rate(gross, rate))
    return fee + apply_rate(fee, gst)


def expected_net(gross: Column, rate: Column, gst: Column, flat: Column) -> Column:
    return gross - fee_of(gross, rate, gst, flat)


def by_instrument(instrument: Column, values: dict, kind: str) -> Column:
    out = F.lit(None).cast(kind)
    for name, value in values.items():
        out = F.when(instrument == name, F.lit(str(value)).cast(kind)).otherwise(out)
    return out


def contract_fee(gross: Column, instrument: Column, config: Config) -> Column:
    """Agreed fee with tax; null for an instrument the contract doesn't name."""
    rate, flat = by_instrument(instrument, config.contract_rates, RATE), by_instrument(instrument, config.contract_flat, "bigint")
    return F.when(rate.isNotNull() | flat.isNotNull(), fee_of(gross, F.coalesce(rate, rate_literal(0)), rate_literal(config.gst), flat))


def within_tolerance(a: Column, b: Column, tolerance: int) -> Column:
    if tolerance < 0:
        raise ValueError("a tolerance can't be negative")
    return F.abs(a - b) <= tolerance


def format_paise(amount: Column) -> Column:
    """Rupees with Indian grouping: sign, symbol, 12,34,567.89."""
    whole = ((F.abs(amount) - F.abs(amount) % 100) / 100).cast("bigint").cast("string")
    grouped = F.regexp_replace(whole, r"(?<=\d)(?=(\d{2})*\d{3}$)", ",")
    return F.concat(F.when(amount < 0, "-").otherwise(""), F.lit("₹"), grouped, F.lit("."), F.lpad((F.abs(amount) % 100).cast("string"), 2, "0"))


def short_rupees(amount: Column) -> Column:
    """Rupees in thousands, lakhs or crores."""
    rupees = F.abs(amount) / 100
    sign = F.when(amount < 0, "-").otherwise("")
    scaled = F.when(rupees >= 1e7, F.format_string("%.2fCr", rupees / 1e7)).when(rupees >= 1e5, F.format_string("%.2fL", rupees / 1e5)).when(rupees >= 1e3, F.format_string("%.1fK", rupees / 1e3))
    return F.concat(sign, F.lit("₹"), scaled.otherwise(F.format_string("%,.2f", rupees)))
