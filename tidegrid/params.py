"""Parameters of the storage and tariff models."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class BatteryParams:
    """Storage asset used by the arbitrage finance columns."""

    battery_mwh: float = 10.0
    efficiency: float = 0.85
    capex: float = 1_500_000.0
    annual_opex: float = 50_000.0
    min_spread: float = 10.0


@dataclass(frozen=True)
class TariffPlan:
    """Retail plan: rates in cents per kWh, daily charge in dollars."""

    name: str
    peak_rate: float
    offpeak_rate: float
    daily_charge: float


# The three retail plans compared by default.
DEFAULT_PLANS = (
    TariffPlan("current", 30.36 * (1 - 0.03), 23.76 * (1 - 0.03), 1.0120 * (1 - 0.03)),
    TariffPlan("new tariff", 56.551, 29.663, 1.2804),
    TariffPlan("alternative", 54.00, 27.5, 1.835),
)
