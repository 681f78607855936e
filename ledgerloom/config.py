"""Settings of the engine; every number a batch depends on is here."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, replace
from decimal import Decimal

# The contract, instruments and national holidays with a fixed date.
INSTRUMENTS = ("UPI", "CARD_DEBIT", "CARD_CREDIT", "NETBANKING")
CONTRACT_RATES = {"UPI": "0", "CARD_DEBIT": "0.009", "CARD_CREDIT": "0.02"}
CONTRACT_FLAT = {"NETBANKING": 1200}
FIXED_HOLIDAYS = ("01-26", "08-15", "10-02")
ESCALATED = ("FEE_UNEXPLAINED", "TIMING_UNEXPLAINED", "AMBIGUOUS_SUBSET", "NO_SUBSET_FOUND")


@dataclass(frozen=True)
class Config:
    calendar_start: str = "2024-01-01"
    calendar_end: str = "2027-12-31"
    extra_holidays: tuple[str, ...] = ()
    national_holidays: bool = True
    gst: str = "0.18"
    contract_rates: dict = field(default_factory=lambda: dict(CONTRACT_RATES))
    contract_flat: dict = field(default_factory=lambda: dict(CONTRACT_FLAT))
    amount_tolerance: int = 2
    amount_slack_percent: int = 60
    window_days: int = 6
    subset_delta: int = 300
    max_solutions: int = 5
    bank_window_days: int = 1
    weight_amount: float = 1.0
    weight_date: float = 0.5
    weight_instrument: float = 1.0
    weight_rule: float = 1.0
    mismatch_cost: float = 1000.0
    unexplained_cost: float = 120.0
    sink_cost: float = 50.0
    max_bindings: int = 2
    discovery_samples: int = 3
    discovery_size: int = 5
    discovery_least: int = 3
    gate_occurrences: int = 3
    gate_confidence: float = 0.8
    gate_precision: float = 0.98
    gate_support: int = 3
    gate_money_at_risk: int = 0
    max_tolerance: int = 10
    noise_paise: int = 5
    retire_accuracy: float = 0.95
    retire_after: int = 10
    priority_scoped: int = 50
    priority_all: int = 80
    false_positive_cost: int = 50
    exception_cost: int = 1
    confidence_floor: float = 0.75

    def __post_init__(self):
        if self.weight_rule * self.unexplained_cost <= 2 * self.sink_cost:
            raise ValueError("an unexplained pair must cost more than leaving both sides open")

    @property
    def gst_rate(self) -> Decimal:
        return Decimal(self.gst)


def read_env(path: str) -> dict[str, str]:
    """KEY=VALUE lines of a file; blank lines, comments and other lines are passed over, quotes around a value go."""
    told = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            key, equals, value = line.strip().partition("=")
            if equals and key and not key.startswith("#"):
                told[key.strip()] = value.strip().strip("'\"")
    return told


def load(path: str | None = None, environ: dict | None = None, env_file: str | None = None) -> Config:
    """Defaults, then a YAML file of field names, then LEDGERLOOM_<FIELD> variables: of a file, then of the environment."""
    config = Config()
    environ = (read_env(env_file) if env_file else {}) | dict(os.environ if environ is None else environ)
    kinds = {f.name: type(getattr(config, f.name)) for f in fields(Config)}
    told: dict = {}
    if path:
        import yaml

        with open(path) as f:
            told |= yaml.safe_load(f) or {}
    for name in kinds:
        value = environ.get(f"LEDGERLOOM_{name.upper()}")
        if value is not None:
            told[name] = value
    if unknown := set(told) - set(kinds):
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    cast = {k: tuple(v) if kinds[k] is tuple and not isinstance(v, str) else (str(v).lower() in ("1", "true", "yes") if kinds[k] is bool else kinds[k](v)) for k, v in told.items()}
    return replace(config, **cast)
