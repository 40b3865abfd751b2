"""Best daily charge and discharge windows and the finance columns derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.calendar import INTERVAL_MINUTES, day_type, minutes, season
from tidegrid.functions.numeric import from_units, round_half_away, round_half_even
from tidegrid.operators.groups import MAX_GROUP_ROWS
from tidegrid.operators.windows import DAY, WINDOW_ROWS, best_windows
from tidegrid.params import BatteryParams


def _window_columns(side: str, window_rows: int) -> list[Column]:
    start = F.col(side)["window_start"]
    return [
        start.alias(f"{side}_start_time"),
        (start + minutes(INTERVAL_MINUTES * window_rows)).alias(f"{side}_end_time"),
        round_half_away(from_units(F.col(side)["window_units"], window_rows), 2).alias(f"{side}_avg_price"),
    ]


def daily_arbitrage(
    prices: DataFrame,
    window_rows: int = WINDOW_ROWS,
    *,
    strict_time: bool = False,
    trade_day_of: str = "calendar",
    max_group_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """Cheapest and dearest ``window_rows`` intervals of every region-day; days without a full window drop out."""
    best = best_windows(
        prices,
        window_rows,
        strict_time=strict_time,
        trade_day_of=trade_day_of,
        max_group_rows=max_group_rows,
    )
    return best.select(*DAY, *_window_columns("charge", window_rows), *_window_columns("discharge", window_rows))


def annual_arbitrage(
    prices: DataFrame,
    window_rows: int = WINDOW_ROWS,
    *,
    strict_time: bool = False,
    trade_day_of: str = "calendar",
    max_group_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """:func:`daily_arbitrage` with calendar attributes and volatilities.

    ``daily_price_volatility`` is the sample deviation of the two chosen window averages,
    ``|discharge - charge| / sqrt(2)``, and NULL when one window is both.
    """
    best = best_windows(
        prices,
        window_rows,
        volatility=True,
        strict_time=strict_time,
        trade_day_of=trade_day_of,
        max_group_rows=max_group_rows,
    )
    charge, discharge = F.col("charge"), F.col("discharge")
    gap = F.abs(from_units(discharge["window_units"] - charge["window_units"], window_rows))
    # The tie breakers are the window's period and its negative.
    spread = F.when(charge["tie"] != -discharge["tie"], gap / F.sqrt(F.lit(2.0)))
    month = F.month("trade_date")
    return best.select(
        *DAY,
        F.year("trade_date").alias("year"),
        month.alias("month"),
        F.quarter("trade_date").alias("quarter"),
        season(month).alias("season"),
        day_type("trade_date").alias("day_type"),
        *_window_columns("charge", window_rows),
        *_window_columns("discharge", window_rows),
        round_half_away(charge["window_price_volatility"], 2).alias("charge_volatility"),
        round_half_away(discharge["window_price_volatility"], 2).alias("discharge_volatility"),
        round_half_away(spread, 2).alias("daily_price_volatility"),
    )


def with_finance(daily: DataFrame, params: BatteryParams = BatteryParams()) -> DataFrame:
    """Add cost, revenue, profit, spread, indicators and ratios to daily windows.

    Prices are the rounded ones. The margin is NULL when revenue is 0; the return is scaled by 365 days
    in every year.
    """
    cost = F.col("charge_avg_price") * params.battery_mwh
    revenue = F.col("discharge_avg_price") * params.battery_mwh * params.efficiency
    priced = daily.withColumns(
        {
            "charging_cost": cost,
            "discharge_revenue": revenue,
            "daily_profit": revenue - cost,
            "price_spread": F.col("discharge_avg_price") - F.col("charge_avg_price"),
        }
    )
    profit, spread = F.col("daily_profit"), F.col("price_spread")
    return priced.withColumns(
        {
            "effective_spread": spread * params.efficiency,
            "is_profitable": profit > 0,
            "meets_threshold": spread >= params.min_spread,
            "daily_roi_percent": profit / params.capex * 100.0 * 365.0,
            "profit_margin_percent": F.try_divide(profit, F.col("discharge_revenue")) * 100.0,
        }
    )


def daily_report(daily: DataFrame, params: BatteryParams = BatteryParams()) -> DataFrame:
    """One-cycle-a-day report: windows, spread and money columns in cents."""
    cost = F.col("charge_avg_price") * params.battery_mwh
    revenue = F.col("discharge_avg_price") * params.battery_mwh * params.efficiency
    spread = F.col("discharge_avg_price") - F.col("charge_avg_price")
    return daily.select(
        "REGIONID",
        "trade_date",
        "charge_start_time",
        "charge_end_time",
        "charge_avg_price",
        "discharge_start_time",
        "discharge_end_time",
        "discharge_avg_price",
        round_half_even(spread, 2).alias("price_spread"),
        round_half_even(cost, 2).alias("charging_cost_total"),
        round_half_even(revenue, 2).alias("discharging_revenue_total"),
        round_half_even(revenue - cost, 2).alias("daily_profit"),
    )


# Column headings of the exported daily report.
DAILY_REPORT_HEADINGS = {
    "trade_date": "Date",
    "charge_start_time": "Charge_Window_Start",
    "charge_end_time": "Charge_Window_End",
    "charge_avg_price": "Charge_Price_$/MWh",
    "discharge_start_time": "Discharge_Window_Start",
    "discharge_end_time": "Discharge_Window_End",
    "discharge_avg_price": "Discharge_Price_$/MWh",
    "price_spread": "Price_Spread_$/MWh",
    "charging_cost_total": "Total_Charging_Cost_$",
    "discharging_revenue_total": "Total_Discharge_Revenue_$",
    "daily_profit": "Daily_Profit_$",
}
