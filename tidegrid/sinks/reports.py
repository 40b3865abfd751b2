"""CSV reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.arbitrage import DAILY_REPORT_HEADINGS, with_finance
from tidegrid.operators.resample import resample
from tidegrid.params import BatteryParams
from tidegrid.plans.reports import (
    ANNUAL_SUMMARY_HEADINGS,
    annual_summary,
    best_days,
    monthly_summary,
    seasonal_summary,
)


def write_report(
    report: DataFrame,
    path: str,
    *,
    by: Sequence[str] = (),
    headings: Mapping[str, str] | None = None,
    single_file: bool = False,
) -> None:
    """Write a report as CSV with a header row.

    ``by`` makes one folder per value, the counterpart of one file per region. ``single_file`` is for
    reports known to be small, such as one row per region.
    """
    named = report.withColumnsRenamed(dict(headings)) if headings else report
    if single_file:
        named = named.coalesce(1)
    writer = named.write.mode("overwrite").option("header", True)
    if by:
        writer = writer.partitionBy(*by)
    writer.csv(path)


def write_report_pack(daily: DataFrame, folder: str, params: BatteryParams = BatteryParams()) -> None:
    """Annual, daily, monthly, seasonal and best-day reports of :func:`annual_arbitrage` results.

    The daily table is written once and the other reports read it back, so the windows are computed once
    and a lost executor costs no more than its own tasks.
    """
    spark = daily.sparkSession
    with_finance(daily, params).write.mode("overwrite").parquet(f"{folder}/daily_table")
    stored = spark.read.parquet(f"{folder}/daily_table")
    write_report(
        annual_summary(stored, params), f"{folder}/annual_summary", headings=ANNUAL_SUMMARY_HEADINGS, single_file=True
    )
    write_report(stored.hint("rebalance", "REGIONID"), f"{folder}/daily", by=["REGIONID"])
    write_report(monthly_summary(stored), f"{folder}/monthly", by=["REGIONID"])
    write_report(seasonal_summary(stored), f"{folder}/seasonal", by=["REGIONID"])
    write_report(best_days(stored), f"{folder}/best_days", single_file=True)


def write_monthly_optimiser(report: DataFrame, folder: str) -> None:
    """The daily optimiser report as CSV with its headings, a folder per region, year and month."""
    dated = report.withColumns({"year": F.year("trade_date"), "month": F.month("trade_date")})
    months = ["REGIONID", "year", "month"]
    write_report(dated.hint("rebalance", *months), folder, by=months, headings=DAILY_REPORT_HEADINGS)


def write_series(prices: DataFrame, folder: str, every: str, by: Sequence[str] = ("REGIONID",)) -> None:
    """The resampled series behind the charts as CSV, a folder per value of ``by``."""
    write_report(resample(prices, every, by), folder, by=by)
