"""Annual cost of retail plans for many consumption profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.numeric import round_half_even
from tidegrid.params import DEFAULT_PLANS, TariffPlan

DAYS_PER_YEAR = 365.0


def tariff_cost(usage: DataFrame, plans: Sequence[TariffPlan] = DEFAULT_PLANS) -> DataFrame:
    """One row per usage row and plan with ``annual_cost`` in dollars.

    ``usage`` has ``annual_peak_kwh`` and ``annual_offpeak_kwh`` beside its own keys. The plans are
    literals exploded beside each row, so nothing is joined or shuffled.
    """
    plan_rows = F.array(
        *[
            F.struct(
                F.lit(p.name).alias("plan"),
                F.lit(float(p.peak_rate)).alias("peak_rate"),
                F.lit(float(p.offpeak_rate)).alias("offpeak_rate"),
                F.lit(float(p.daily_charge)).alias("daily_charge"),
            )
            for p in plans
        ]
    )
    keys = [c for c in usage.columns if c not in ("annual_peak_kwh", "annual_offpeak_kwh")]
    cost = (
        F.col("p.peak_rate") / 100.0 * F.col("annual_peak_kwh")
        + F.col("p.offpeak_rate") / 100.0 * F.col("annual_offpeak_kwh")
        + F.col("p.daily_charge") * DAYS_PER_YEAR
    )
    return usage.withColumn("p", F.explode(plan_rows)).select(
        *keys, "p.plan", "annual_peak_kwh", "annual_offpeak_kwh", round_half_even(cost, 2).alias("annual_cost")
    )
