import math
from datetime import datetime

import pytest
from conftest import SF
from pyspark.sql import functions as F

from tidegrid.operators.arbitrage import annual_arbitrage, daily_arbitrage, daily_report, with_finance
from tidegrid.params import BatteryParams
from tidegrid.plans import reports
from tidegrid.plans.catalog import order_prices
from tidegrid.sinks.reports import write_monthly_optimiser, write_report, write_report_pack, write_series
from tidegrid.sinks.tables import read_summary, replace_table, write_summary


def finance(spark, rows):
    names = "trade_date timestamp_ntz, REGIONID string, charge_avg_price double, discharge_avg_price double"
    daily = spark.createDataFrame(rows, names).withColumn("daily_price_volatility", F.lit(1.0))
    starts = {f"{side}_start_time": F.col("trade_date") for side in ("charge", "discharge")}
    return with_finance(daily.withColumns({"month": F.month("trade_date"), **starts}))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Daily results of several years, written once."""
    path = str(tmp_path_factory.mktemp("daily") / "t")
    with_finance(annual_arbitrage(order_prices(spark, SF), 2)).write.parquet(path)
    return spark.read.parquet(path)


def test_worked_amounts(spark):
    row = finance(spark, [(datetime(2024, 1, 1), "R", 50.0, 100.0)]).first()
    assert (row.charging_cost, row.discharge_revenue, row.daily_profit, row.price_spread) == (500, 850, 350, 50)
    assert row.effective_spread == 42.5 and row.is_profitable and row.meets_threshold
    assert row.daily_roi_percent == pytest.approx(350 / 1_500_000 * 100 * 365)
    assert row.profit_margin_percent == pytest.approx(350 / 850 * 100)


def test_edges_of_indicators(spark):
    rows = [(datetime(2024, 1, d), "R", c, e) for d, c, e in ((1, 0.0, 10.0), (2, -5.0, 0.0), (3, 20.0, 20.0))]
    found = finance(spark, rows).orderBy("trade_date").collect()
    assert [r.meets_threshold for r in found] == [True, False, False]
    assert found[1].profit_margin_percent is None and found[1].is_profitable
    assert not found[2].is_profitable


def test_payback(spark):
    day = datetime(2024, 1, 1)
    rows = [(day, "LOSS", 90.0, 10.0), (day, "GAIN", 10.0, 10_000.0)]
    found = {r.REGIONID: r for r in reports.annual_summary(finance(spark, rows)).collect()}
    assert found["LOSS"].payback_period_years == math.inf
    net = 10_000 * 8.5 - 100 - 50_000
    assert found["GAIN"].payback_period_years == round(1_500_000 / net, 2)
    assert found["GAIN"].annual_roi_percent == round(net / 1_500_000 * 100, 2)
    insight = reports.key_insights(reports.annual_summary(finance(spark, rows))).first()
    assert (insight.best_region, insight.best_roi_region, insight.profitable_regions) == ("GAIN", "GAIN", 1)
    none = reports.key_insights(reports.annual_summary(finance(spark, rows[:1]))).first()
    assert none.best_roi_region is None and none.profitable_regions == 0


def test_ties_go_to_the_first(spark):
    rows = [(datetime(2024, 1, d), r, 0.0, 10.0) for d in (3, 2) for r in ("B", "A")]
    daily = finance(spark, rows)
    assert {(r.REGIONID, r.trade_date.day) for r in reports.best_days(daily).collect()} == {("A", 2), ("B", 2)}
    assert reports.key_insights(reports.annual_summary(daily)).first().best_region == "A"
    first = [(r.trade_date.day, r.REGIONID) for r in reports.top_days(daily, 3).collect()]
    assert first == [(2, "A"), (2, "B"), (3, "A")]


def test_totals_reconcile(stored):
    total = stored.agg(F.sum("daily_profit")).first()[0]
    for report, column in (
        (reports.monthly_summary(stored), "daily_profit_sum"),
        (reports.seasonal_summary(stored), "daily_profit_sum"),
        (reports.annual_summary(stored), "total_profit"),
    ):
        assert report.agg(F.sum(column)).first()[0] == pytest.approx(total, abs=0.01 * report.count())
    assert stored.where("charge_avg_price > discharge_avg_price").isEmpty()


def test_parameters_change_the_result(spark):
    daily = spark.createDataFrame([(10.0, 30.0)], "charge_avg_price double, discharge_avg_price double")
    row = with_finance(daily, BatteryParams(battery_mwh=2, efficiency=0.5, min_spread=20.5)).first()
    assert (row.daily_profit, row.meets_threshold) == (10.0, False)


def test_empty_input_gives_empty_reports(spark, stored):
    empty = stored.where("REGIONID = 'nowhere'")
    assert empty.isEmpty()
    for report in (reports.monthly_summary, reports.seasonal_summary, reports.annual_summary, reports.best_days):
        assert report(empty).isEmpty()
    assert annual_arbitrage(order_prices(spark, SF).where("RRP > 1e9"), 2).isEmpty()


def test_report_pack(spark, stored, tmp_path):
    write_report_pack(annual_arbitrage(order_prices(spark, SF), 2), str(tmp_path))
    assert {p.name for p in tmp_path.iterdir()} >= {"annual_summary", "daily", "monthly", "seasonal", "best_days"}
    annual = spark.read.option("header", True).csv(str(tmp_path / "annual_summary"))
    assert {"Region", "Total_Profit_$", "Annual_ROI_%", "Payback_Period_Years"} <= set(annual.columns)
    assert annual.count() == stored.select("REGIONID", F.year("trade_date")).distinct().count() and "Year" in annual.columns
    daily = spark.read.option("header", True).csv(str(tmp_path / "daily"))
    assert daily.count() == stored.count() and "REGIONID" in daily.columns
    assert (tmp_path / "monthly" / "REGIONID=F").is_dir()


def test_replaced_tables(spark, stored, tmp_path):
    """A derived table is replaced as a whole; a summary only where its months occur again."""
    for limit in (5, 3):
        replace_table(spark.range(limit), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3

    prices = order_prices(spark, SF)
    write_summary(reports.price_summary(prices.where("year < 1999")), str(tmp_path / "s"))
    before = read_summary(spark, str(tmp_path / "s")).count()
    write_summary(reports.price_summary(prices.where("year = 1998 AND RRP > 0")), str(tmp_path / "s"))
    after = read_summary(spark, str(tmp_path / "s"))
    assert after.count() == before
    assert after.where("year = 1998").agg(F.min("min_price")).first()[0] > 0
    assert after.where("year = 1997").agg(F.min("min_price")).first()[0] < 0


def test_single_file_csv(spark, tmp_path):
    write_report(spark.range(100).repartition(5), str(tmp_path / "r"), single_file=True, headings={"id": "a $/MWh %"})
    parts = list((tmp_path / "r").glob("*.csv"))
    assert len(parts) == 1 and parts[0].read_text().splitlines()[0] == "a $/MWh %"


def test_years_are_reported_apart(make_prices, grid):
    """Two years of equal days give two rows that each carry one year's operating cost."""
    days = [f"{y}-01-0{d} 00:05" for y in (2023, 2024) for d in (1, 2)]
    prices = make_prices([r for d in days for r in grid(d, "R", [10] * 4 + [100] * 4)])
    table = with_finance(annual_arbitrage(prices, 4))
    annual = reports.annual_summary(table).collect()
    assert sorted(r.year for r in annual) == [2023, 2024] and {r.total_days for r in annual} == {2}
    assert len({r.annual_roi_percent for r in annual}) == 1
    for summary in (reports.monthly_summary(table), reports.seasonal_summary(table), reports.best_days(table)):
        assert summary.count() == 2
    assert sorted(r.year for r in reports.key_insights(reports.annual_summary(table)).collect()) == [2023, 2024]


def test_optimiser_report_and_series_round_trip(spark, make_prices, grid, tmp_path):
    prices = make_prices(grid("2024-01-31 23:30", "R", [5.0, 1.0, 9.0, 2.0, 7.0, 4.0] * 2))
    report = daily_report(daily_arbitrage(prices, 2))
    write_monthly_optimiser(report, str(tmp_path / "m"))
    back = spark.read.option("header", True).csv(str(tmp_path / "m"))
    assert {"Date", "Charge_Price_$/MWh", "Daily_Profit_$"} <= set(back.columns)
    want = sorted((r.trade_date.month, r.daily_profit) for r in report.collect())
    assert sorted((int(r["month"]), float(r["Daily_Profit_$"])) for r in back.collect()) == want and len(want) == 2
    write_series(prices, str(tmp_path / "s"), "hourly")
    series = spark.read.option("header", True).csv(str(tmp_path / "s"))
    assert sorted(float(r.mean_price) for r in series.collect()) == pytest.approx([28 / 6] * 2)
