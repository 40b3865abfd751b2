import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from tidegrid.operators.distribution import (
    describe_prices,
    exact_percentiles,
    price_flags,
    price_histogram,
)
from tidegrid.operators.resample import resample
from tidegrid.operators.selection import backfill_filter, filter_range, union_batches
from tidegrid.operators.tariff import tariff_cost
from tidegrid.params import TariffPlan
from tidegrid.plans.catalog import event_prices


@pytest.fixture(scope="module")
def three(make_prices):
    return make_prices([("2024-01-01 00:05", "R", p) for p in (3.0, 1.0, 10.0)])


def test_percentiles_interpolate(three):
    assert [round(v, 9) for v in exact_percentiles(three).first()] == [1.2, 2.0, 3.0, 6.5, 9.3]


def test_percentiles_of_one_value_and_of_none(make_prices):
    one = make_prices([("2024-01-01 00:05", "R", -4.25)])
    assert list(exact_percentiles(one).first()) == [-4.25] * 5
    described = describe_prices(one.where("RRP > 0")).first()
    assert described["count"] == 0 and described["mean"] is None and described["p50"] is None


@pytest.mark.parametrize("seed", range(4))
def test_percentiles_agree_with_built_in(spark, seed):
    draw = random.Random(seed)
    kinds = [lambda: draw.uniform(-1000, 17500), lambda: float(draw.choice([0, 0, 0, 1, 300]))]
    values = [(draw.choice(kinds)(),) for _ in range(draw.choice([2, 99, 1000]))]
    prices = spark.createDataFrame(values, "RRP double").repartition(4)
    levels = (0.0, 0.01, 0.25, 1 / 3, 0.5, 0.999, 1.0)
    built_in = prices.agg(F.percentile("RRP", F.array(*[F.lit(q) for q in levels]))).first()[0]
    assert list(exact_percentiles(prices, levels).first()) == pytest.approx(built_in, rel=1e-12, abs=1e-9)


def test_approximate_percentiles_are_close(spark):
    prices = event_prices(spark, SF)
    exact, near = describe_prices(prices).first(), describe_prices(prices, approximate=True).first()
    assert exact["count"] == near["count"] and near["p50"] == pytest.approx(exact["p50"], abs=0.5)


def test_histogram_edges_and_empty_bins(make_prices):
    prices = make_prices([("2024-01-01 00:05", "R", float(p)) for p in (0, 0, 1, 99, 100)])
    bins = price_histogram(prices).orderBy("bin").collect()
    assert len(bins) == 50 and bins[0].records == 3 and bins[49].records == 2
    assert bins[0].bin_start == 0.0 and bins[49].bin_end == 100.0
    flat = price_histogram(make_prices([("2024-01-01 00:05", "R", 7.0)] * 3)).orderBy("bin").collect()
    assert [b.records for b in flat] == [3] + [0] * 49


def test_histogram_counts_add_up(spark):
    prices = event_prices(spark, SF)
    assert price_histogram(prices).agg(F.sum("records")).first()[0] == prices.count()


def test_flags(make_prices):
    row = price_flags(make_prices([("2024-01-01 00:05", "R", p) for p in (-1.0, 300.0, 300.5, None)])).first()
    assert (row.records, row.negative_prices, row.high_prices) == (4, 1, 1)
    assert row.negative_percent == row.high_percent == 25.0


def test_weeks_are_labelled_by_sunday(make_prices):
    rows = [("2024-01-07 14:00", "R", 1.0), ("2024-01-08 00:00", "R", 3.0), ("2024-01-24 00:00", "R", 5.0)]
    weeks = resample(make_prices(rows), "weekly").orderBy("SETTLEMENTDATE").collect()
    assert [(w.SETTLEMENTDATE.day, w.mean_price) for w in weeks] == [(7, 1.0), (14, 3.0), (21, None), (28, 5.0)]
    assert weeks[0].std_price is None


def test_gaps_are_filled_per_key(make_prices):
    rows = [("2024-01-01 00:10", "A", 1.0), ("2024-01-01 00:20", "A", 2.0), ("2024-01-01 04:00", "A", 3.0)]
    rows += [("2024-01-01 02:00", "B", 9.0)]
    prices = make_prices(rows)
    blended = resample(prices, "hourly").orderBy("SETTLEMENTDATE").collect()
    assert [b.mean_price for b in blended] == [1.5, None, 9.0, None, 3.0]
    keyed = resample(prices, "hourly", by=["REGIONID"])
    assert Counter(r.REGIONID for r in keyed.collect()) == {"A": 5, "B": 1}
    assert resample(prices, "hourly", fill_gaps=False).count() == 3
    assert resample(prices, "5-minute") is prices
    with pytest.raises(ValueError):
        resample(prices, "yearly")


def test_buckets_cover_every_row(spark):
    prices = event_prices(spark, SF).where("RRP > 0")
    counted = prices.groupBy(F.to_date("SETTLEMENTDATE").alias("d")).count()
    days = resample(prices, "daily")
    assert days.count() == counted.count()


def test_range_ends_at_midnight_unless_told(make_prices):
    rows = [(f"2024-01-{d:02d} {t}", "R", 1.0) for d in (1, 2, 3) for t in ("00:00", "12:00")]
    prices = make_prices(rows + [("2024-01-02 00:00", "Q", 1.0)])
    assert filter_range(prices, ["R"], "2024-01-01", "2024-01-02").count() == 3
    assert filter_range(prices, ["R", "Q"], "2024-01-01", "2024-01-02", end_inclusive=True).count() == 5


def test_backfill_filter_bounds(make_prices):
    rows = [(t, "R", 1.0) for t in ("2023-12-31 23:55", "2024-01-01 00:00", "2024-06-08 23:55", "2024-06-09 00:00")]
    kept = backfill_filter(make_prices(rows), 2024, "2024-06-09").collect()
    assert sorted(r.SETTLEMENTDATE for r in kept) == [datetime(2024, 1, 1), datetime(2024, 6, 8, 23, 55)]


def test_union_matches_names(spark):
    a, b = spark.sql("SELECT 1 AS x, 'a' AS y"), spark.sql("SELECT 'b' AS y, 2 AS x")
    assert sorted(tuple(r) for r in union_batches([a, b]).collect()) == [(1, "a"), (2, "b")]


def test_tariff(spark):
    usage = spark.sql("SELECT 'home' AS customer, 236.17D AS annual_peak_kwh, 604.01D AS annual_offpeak_kwh")
    found = {r.plan: r.annual_cost for r in tariff_cost(usage).collect()}
    plan = (0.56551 * 236.17) + (0.29663 * 604.01) + 1.2804 * 365
    assert len(found) == 3 and found["new tariff"] == round(plan, 2)
    own = tariff_cost(usage, [TariffPlan("flat", 10, 10, 0)]).first()
    assert own.annual_cost == round(0.1 * 236.17 + 0.1 * 604.01, 2) and own.customer == "home"


def test_hot_bucket(spark):
    """A third of the rows in one hour, counted by partial aggregates."""
    base = datetime(2024, 1, 1)
    rows = [(base + timedelta(hours=i % 24 if i % 3 else 5), "R", float(i)) for i in range(3000)]
    prices = spark.createDataFrame(rows, "SETTLEMENTDATE timestamp_ntz, REGIONID string, RRP double")
    hours = {r.SETTLEMENTDATE.hour: r for r in resample(prices, "hourly").collect()}
    own = [p for at, _, p in rows if at.hour == 5]
    assert hours[5].max_price == max(own) and hours[5].mean_price == pytest.approx(sum(own) / len(own))


def scans(df):
    """File scans that ran: those of the final plans, a reused exchange or subquery counting once."""
    df.collect()
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    # Below generated code, marked by a star; initial plans have none. A subquery is printed wherever it is used.
    return len({line.lstrip(" :|+-") for before, line in zip(lines, lines[1:]) if "FileScan" in line and "*(" in before})


def test_statistics_scan_twice_and_histograms_once(spark):
    assert scans(price_histogram(event_prices(spark, SF))) == 1
    assert scans(describe_prices(event_prices(spark, SF))) == 2


@pytest.mark.parametrize("prices", [[1e-300, 2e-300, 3e-300], [-1e11, 1e11, 0.1], [5.0] * 1000, [1.0], [None, 2.0], []])
def test_percentiles_of_any_level_and_spacing(spark, make_prices, prices):
    df = make_prices([(f"2024-01-01 00:{i // 60 % 60:02d}:{i % 60:02d}", "R", p) for i, p in enumerate(prices)])
    known = sorted(p for p in prices if p is not None)
    got = exact_percentiles(df, (0.0, 0.05, 0.5, 0.95, 1.0)).first()
    if not known:
        assert list(got) == [None] * 5
        return
    want = np.percentile(known, [0, 5, 50, 95, 100])
    assert np.allclose(np.array(list(got), float), want, rtol=1e-12)


def test_percentiles_of_many_distinct_prices(spark):
    df = spark.range(200_000).select(
        F.lit(None).cast("timestamp_ntz").alias("SETTLEMENTDATE"), (F.xxhash64("id") % 10**9 / 1000).alias("RRP")
    )
    values = df.toPandas()["RRP"].to_numpy()
    got = exact_percentiles(df).first()
    assert np.allclose(list(got), np.percentile(values, [5, 25, 50, 75, 95]), rtol=1e-12)


def test_a_gap_of_two_thousand_years_is_filled_in_runs(spark, make_prices):
    df = make_prices([("0001-01-01 00:00", "R", 1.0), ("2024-01-01 00:00", "R", 3.0)])
    filled = resample(df, "daily", by=["REGIONID"])
    row = filled.agg(F.count("*").alias("n"), F.count("mean_price").alias("known"), F.countDistinct("SETTLEMENTDATE").alias("d"))
    days = (datetime(2024, 1, 1) - datetime(1, 1, 1)).days + 1
    assert tuple(row.first()) == (days, 2, days)
    weeks = resample(df, "weekly").agg(F.count("*").alias("n"), F.max("SETTLEMENTDATE").alias("last")).first()
    assert weeks.n == (weeks.last - datetime(1, 1, 7)).days // 7 + 1
