"""Aggregate reports over prices and over daily arbitrage results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.calendar import month_name
from tidegrid.functions.numeric import exact_sum, money_mean, money_sum, round_half_even
from tidegrid.params import BatteryParams


def price_partials(prices: DataFrame) -> DataFrame:
    """Minimum, maximum, exact sum and count of prices by region, year and month, which can be merged."""
    return (
        prices.where(F.col("RRP").isNotNull())
        .groupBy("REGIONID", "year", "month")
        .agg(
            F.min("RRP").alias("min_price"),
            F.max("RRP").alias("max_price"),
            exact_sum("RRP").alias("sum_price"),
            F.count(F.lit(1)).alias("record_count"),
        )
    )


def merged_partials(partials: DataFrame) -> DataFrame:
    """One row per region, year and month from any number of :func:`price_partials`, with the mean ``avg_price``."""
    total, rows = F.sum("sum_price"), F.sum("record_count")
    return partials.groupBy("REGIONID", "year", "month").agg(
        F.min("min_price").alias("min_price"),
        F.max("max_price").alias("max_price"),
        total.cast("decimal(38,5)").alias("sum_price"),
        (total.cast("double") / rows.cast("double")).alias("avg_price"),
        rows.alias("record_count"),
    )


def price_summary(prices: DataFrame) -> DataFrame:
    """Minimum, maximum, mean and count of prices by region, year and month."""
    return price_partials(prices).select(
        "REGIONID",
        "year",
        "month",
        "min_price",
        "max_price",
        (F.col("sum_price").cast("double") / F.col("record_count").cast("double")).alias("avg_price"),
        "record_count",
    )


def year_profile(prices: DataFrame, year: int) -> DataFrame:
    """Date range, rows and number of regions of one year, as one row."""
    return prices.where(F.col("year") == year).agg(
        F.min("SETTLEMENTDATE").alias("min_date"),
        F.max("SETTLEMENTDATE").alias("max_date"),
        F.count(F.lit(1)).alias("total_records"),
        F.countDistinct("REGIONID").alias("regions"),
    )


def monthly_coverage(prices: DataFrame, year: int) -> DataFrame:
    """Rows and first and last stamp of every month of one year."""
    return (
        prices.where(F.col("year") == year)
        .groupBy("month")
        .agg(
            F.count(F.lit(1)).alias("records"),
            F.min("SETTLEMENTDATE").alias("start_date"),
            F.max("SETTLEMENTDATE").alias("end_date"),
        )
    )


def _year() -> Column:
    return F.year("trade_date").alias("year")


def _count_true(flag: str) -> Column:
    return F.count_if(F.col(flag))


def _daily_measures() -> list[Column]:
    return [
        round_half_even(money_sum("daily_profit"), 2).alias("daily_profit_sum"),
        round_half_even(money_mean("daily_profit"), 2).alias("daily_profit_mean"),
        round_half_even(F.stddev_samp("daily_profit"), 2).alias("daily_profit_std"),
        round_half_even(F.min("daily_profit"), 2).alias("daily_profit_min"),
        round_half_even(F.max("daily_profit"), 2).alias("daily_profit_max"),
        F.count("daily_profit").alias("daily_profit_count"),
        round_half_even(money_mean("price_spread"), 2).alias("price_spread_mean"),
        round_half_even(F.stddev_samp("price_spread"), 2).alias("price_spread_std"),
        round_half_even(money_mean("charge_avg_price"), 2).alias("charge_avg_price_mean"),
        round_half_even(money_mean("discharge_avg_price"), 2).alias("discharge_avg_price_mean"),
        _count_true("is_profitable").alias("is_profitable_sum"),
        round_half_even(money_mean("daily_price_volatility"), 2).alias("daily_price_volatility_mean"),
    ]


def _rate(part: str) -> Column:
    return round_half_even(F.col(part) / F.col("daily_profit_count") * 100.0, 1)


def monthly_summary(daily: DataFrame) -> DataFrame:
    """Profit, spread, price and success measures by region, year and month."""
    return (
        daily.groupBy("REGIONID", _year(), "month")
        .agg(*_daily_measures(), _count_true("meets_threshold").alias("meets_threshold_sum"))
        .withColumns(
            {
                "success_rate_percent": _rate("is_profitable_sum"),
                "threshold_rate_percent": _rate("meets_threshold_sum"),
                "month_name": month_name(F.col("month")),
            }
        )
    )


def seasonal_summary(daily: DataFrame) -> DataFrame:
    """Profit, spread, price and success measures by region, year and season."""
    return (
        daily.groupBy("REGIONID", _year(), "season")
        .agg(*_daily_measures())
        .withColumn("success_rate_percent", _rate("is_profitable_sum"))
    )


def annual_summary(daily: DataFrame, params: BatteryParams = BatteryParams()) -> DataFrame:
    """Totals, rates, return and payback by region and year; payback is infinite when costs are not covered."""
    total = F.coalesce(money_sum("daily_profit"), F.lit(0.0))
    profitable = _count_true("is_profitable")
    net = total - params.annual_opex
    payback = F.when(net > 0, params.capex / net).otherwise(F.lit(float("inf")))
    return daily.groupBy("REGIONID", _year()).agg(
        F.count(F.lit(1)).alias("total_days"),
        round_half_even(total, 2).alias("total_profit"),
        round_half_even(money_mean("daily_profit"), 2).alias("average_daily_profit"),
        round_half_even(F.max("daily_profit"), 2).alias("best_day_profit"),
        round_half_even(F.min("daily_profit"), 2).alias("worst_day_profit"),
        profitable.alias("profitable_days"),
        round_half_even(profitable / F.count(F.lit(1)) * 100.0, 2).alias("success_rate_percent"),
        round_half_even(money_mean("price_spread"), 2).alias("average_price_spread"),
        round_half_even(money_mean("daily_price_volatility"), 2).alias("average_daily_volatility"),
        round_half_even(net / params.capex * 100.0, 2).alias("annual_roi_percent"),
        round_half_even(payback, 2).alias("payback_period_years"),
    )


# Column headings of the exported annual summary.
ANNUAL_SUMMARY_HEADINGS = {
    "REGIONID": "Region",
    "year": "Year",
    "total_days": "Total_Days",
    "total_profit": "Total_Profit_$",
    "average_daily_profit": "Average_Daily_Profit_$",
    "best_day_profit": "Best_Day_Profit_$",
    "worst_day_profit": "Worst_Day_Profit_$",
    "profitable_days": "Profitable_Days",
    "success_rate_percent": "Success_Rate_%",
    "average_price_spread": "Average_Price_Spread_$/MWh",
    "average_daily_volatility": "Average_Daily_Volatility",
    "annual_roi_percent": "Annual_ROI_%",
    "payback_period_years": "Payback_Period_Years",
}


def best_days(daily: DataFrame) -> DataFrame:
    """The day with the highest profit of each region and year, the earliest on ties."""
    columns = daily.columns
    rank = F.struct(F.col("daily_profit"), (-F.unix_date(F.to_date("trade_date"))).alias("earliest"))
    return (
        daily.where(F.col("daily_profit").isNotNull())
        .groupBy("REGIONID", F.year("trade_date"))
        .agg(F.max_by(F.struct(*columns), rank).alias("best"))
        .select(*[F.col("best")[c].alias(c) for c in columns])
    )


def top_days(daily: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` region-days of the results in date order."""
    return (
        daily.select(
            "REGIONID",
            "trade_date",
            "charge_start_time",
            "charge_avg_price",
            "discharge_start_time",
            "discharge_avg_price",
            "daily_profit",
        )
        .orderBy("trade_date", "REGIONID")
        .limit(n)
    )


def display_days(daily: DataFrame) -> DataFrame:
    """Daily results as text: times to the minute, money with two decimals."""

    def span(side: str) -> Column:
        times = [F.date_format(f"{side}_{end}_time", "HH:mm") for end in ("start", "end")]
        return F.concat_ws(" - ", *times)

    def money(column: str, unit: str = "") -> Column:
        return F.format_string(f"$%.2f{unit}", round_half_even(F.col(column), 2))

    return daily.select(
        "REGIONID",
        F.date_format("trade_date", "yyyy-MM-dd").alias("date"),
        span("charge").alias("charge_window"),
        money("charge_avg_price", "/MWh").alias("charge_price"),
        money("charging_cost").alias("charging_cost"),
        span("discharge").alias("discharge_window"),
        money("discharge_avg_price", "/MWh").alias("discharge_price"),
        money("discharge_revenue").alias("discharge_revenue"),
        money("daily_profit").alias("daily_profit"),
        money("price_spread", "/MWh").alias("price_spread"),
    )


def key_insights(annual: DataFrame) -> DataFrame:
    """By year, totals over all regions and the best region by profit and by return; first region name on ties."""
    roi, profit, region = F.col("annual_roi_percent"), F.col("total_profit"), F.col("REGIONID")
    # min of (negated value, name): highest value first, then the first name.
    by_profit = F.min(F.struct((-profit).alias("order"), region.alias("name"), profit.alias("value")))
    by_roi = F.min(F.when(roi > 0, F.struct((-roi).alias("order"), region.alias("name"), roi.alias("value"))))
    return annual.groupBy("year").agg(
        money_sum(profit).alias("total_profit_all_regions"),
        by_profit["name"].alias("best_region"),
        by_profit["value"].alias("best_region_profit"),
        money_mean("success_rate_percent").alias("average_success_rate"),
        F.count_if(roi > 0).alias("profitable_regions"),
        F.count(F.lit(1)).alias("regions"),
        by_roi["name"].alias("best_roi_region"),
        by_roi["value"].alias("best_roi_percent"),
    )


def period_summary(report: DataFrame) -> DataFrame:
    """Days, total, mean, best, worst and profitable days of a daily report by region and year."""
    profit = F.col("daily_profit")
    return report.groupBy("REGIONID", _year()).agg(
        F.count(F.lit(1)).alias("days"),
        F.coalesce(money_sum(profit), F.lit(0.0)).alias("total_profit"),
        money_mean(profit).alias("average_daily_profit"),
        F.max(profit).alias("best_day_profit"),
        F.min(profit).alias("worst_day_profit"),
        F.count_if(profit > 0).alias("profitable_days"),
    )
