"""Frames against brute force, and the split form of every window operator against the plain one."""

import math
import random
from collections import defaultdict
from datetime import datetime, timedelta
from statistics import stdev

import pytest
from conftest import SF
from pyspark.sql import functions as F

from tidegrid.operators.arbitrage import annual_arbitrage, daily_arbitrage
from tidegrid.operators.groups import DIGIT_BITS, cut_groups, order_digits, oversized_groups, rows_before
from tidegrid.operators.windows import (
    monthly_extremes,
    period_of_day,
    ranked_windows,
    rolling_forward,
    rolling_trailing,
)
from tidegrid.plans.catalog import event_prices, order_prices


@pytest.fixture(scope="module")
def skewed(make_prices):
    """A third of the rows in one region-day, bursts in one second, many equal prices, sparse other days."""
    draw = random.Random(7)
    rows, start = [], datetime(2023, 12, 30)
    for _ in range(400):
        rows.append((start + timedelta(seconds=draw.randrange(86400)), "HOT", float(draw.choice([5, 5, 5, 7, -2]))))
    burst = start + timedelta(hours=9)
    rows += [(burst + timedelta(microseconds=i), "HOT", float(draw.randrange(4))) for i in range(90)]
    for region in ("A", "B"):
        for _ in range(300):
            at = start + timedelta(seconds=draw.randrange(6 * 86400))
            rows.append((at, region, draw.randrange(-5000, 30000) / 100))
    rows.append((start + timedelta(days=200), "A", 1.0))
    rows = list({(at, region): (at, region, price) for at, region, price in rows}.values())
    draw.shuffle(rows)
    return rows, make_prices(rows).repartition(5)


def by_day(rows):
    days = defaultdict(list)
    for at, region, price in sorted(rows):
        days[region, at.date()].append((at, price))
    return days


def rows_of(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


@pytest.mark.parametrize("rows_in_window, limit", [(4, None), (24, None), (1, 60), (4, 7), (24, 60), (24, 7)])
def test_forward_against_brute_force(skewed, rows_in_window, limit):
    rows, prices = skewed
    expected = {}
    for (region, _), day in by_day(rows).items():
        for i in range(len(day) - rows_in_window + 1):
            frame = [p for _, p in day[i : i + rows_in_window]]
            expected[region, day[i][0]] = (
                i + 1,
                round(math.fsum(frame) / rows_in_window, 9),
                min(frame),
                max(frame),
                round(stdev(frame), 9) if rows_in_window > 1 else None,
                rows_in_window,
            )
    found = rolling_forward(prices, rows_in_window, extremes=True, volatility=True, max_group_rows=limit).collect()
    assert len(found) == len(expected)
    for r in found:
        sd = r.window_price_volatility
        assert expected[r.REGIONID, r.window_start] == (
            r.period_of_day,
            round(r.window_avg_price, 9),
            r.window_min_price,
            r.window_max_price,
            None if sd is None else round(sd, 9),
            r.periods_in_window,
        )


@pytest.mark.parametrize("limit", [None, 25])
def test_forward_partial_frames(skewed, limit):
    rows, prices = skewed
    found = rolling_forward(prices, 24, complete_only=False, max_group_rows=limit)
    assert found.count() == len(rows)
    for r in found.where("REGIONID = 'A'").collect():
        day = by_day(rows)["A", r.trade_date.date()]
        frame = [p for at, p in day if at >= r.window_start][:24]
        assert r.periods_in_window == len(frame)
        assert r.window_avg_price == pytest.approx(math.fsum(frame) / len(frame), abs=1e-9)


@pytest.mark.parametrize("rows_in_window, limit", [(2, None), (24, None), (1, 60), (2, 7), (24, 60), (24, 7)])
def test_trailing_against_brute_force(skewed, rows_in_window, limit):
    rows, prices = skewed
    history = defaultdict(list)
    for at, region, price in sorted(rows):
        history[region].append((at, price))
    expected = {}
    for region, series in history.items():
        for i, (at, _) in enumerate(series):
            frame = [p for _, p in series[max(0, i - rows_in_window + 1) : i + 1]]
            expected[region, at] = (round(math.fsum(frame) / len(frame), 9), len(frame))
    found = rolling_trailing(prices, rows_in_window, max_group_rows=limit).collect()
    assert len(found) == len(expected)
    for r in found:
        assert expected[r.REGIONID, r.SETTLEMENTDATE] == (round(r.avg_rrp_2hr, 9), r.periods_in_window)
    full = rolling_trailing(prices, rows_in_window, complete_only=True, max_group_rows=limit).count()
    assert full == sum(n == rows_in_window for _, n in expected.values())


OPERATORS = {
    "period_of_day": lambda p, limit: period_of_day(p, max_group_rows=limit),
    "rolling_forward": lambda p, limit: rolling_forward(p, 6, extremes=True, max_group_rows=limit),
    "ranked_windows": lambda p, limit: ranked_windows(p, 6, max_group_rows=limit),
    "rolling_trailing": lambda p, limit: rolling_trailing(p, 6, max_group_rows=limit),
    "monthly_extremes": lambda p, limit: monthly_extremes(p, 6, max_group_rows=limit),
    "daily_arbitrage": lambda p, limit: daily_arbitrage(p, 6, max_group_rows=limit),
    "annual_arbitrage": lambda p, limit: annual_arbitrage(p, 6, max_group_rows=limit),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_split_groups_change_nothing(skewed, name):
    _, prices = skewed
    plain, split = OPERATORS[name](prices, None), OPERATORS[name](prices, 11)
    assert split.columns == plain.columns
    assert rows_of(split) == rows_of(plain)


@pytest.mark.parametrize("name", ["ranked_windows", "daily_arbitrage", "rolling_trailing"])
def test_split_groups_change_nothing_on_tables(spark, name):
    prices = order_prices(spark, SF) if name == "rolling_trailing" else event_prices(spark, SF)
    assert rows_of(OPERATORS[name](prices, 30)) == rows_of(OPERATORS[name](prices, None))


def test_split_ranks_use_the_checkpoint_folder(skewed, checkpoints):
    def files():
        return {p for p in checkpoints.rglob("part-*")}

    _, prices = skewed
    before = files()
    ranked_windows(prices, 6, max_group_rows=None).count()
    assert files() == before
    ranked_windows(prices, 6, max_group_rows=50).count()
    assert files() > before


def test_chunks_stay_bounded(skewed):
    """Only a slot that is itself larger than the limit makes a larger chunk."""
    _, prices = skewed
    slots = {"_at": F.col("SETTLEMENTDATE")}
    big = oversized_groups(prices, ["REGIONID"], 50)
    chunks = cut_groups(prices, ["REGIONID"], slots, 50, big).groupBy("REGIONID", "_chunk").count()
    sizes = [r["count"] for r in chunks.collect()]
    assert max(sizes) <= 50 and len(sizes) > 15


def test_digits_keep_the_order(spark):
    values = [-(2**63), -(2**40) - 5, -4097, -4096, -1, 0, 1, 4095, 4096, 2**36 - 1, 2**36, 2**63 - 1]
    table = spark.createDataFrame([(v,) for v in values], "v long")
    digits = order_digits(F.col("v"), "d")
    found = table.select("v", *[c.alias(n) for n, c in digits.items()]).collect()
    assert [r.v for r in sorted(found, key=lambda r: tuple(r)[1:])] == values
    assert all(0 <= d < 2**DIGIT_BITS for r in found for d in tuple(r)[2:])


def test_ranks_of_a_hot_day_are_summed_in_bounded_windows(spark):
    """30,000 different levels of one group: same running totals, and no window over more than a digit's values."""
    draw = random.Random(3)
    levels = {draw.randrange(-(10**12), 10**12): draw.randrange(1, 9) for _ in range(30000)}
    rows = [("R", v, n) for v, n in levels.items()]
    cells = spark.createDataFrame(rows, "k string, v long, _n long").withColumns(order_digits(F.col("v"), "d"))
    slots = [c for c in cells.columns if c.startswith("d")]
    so_far, expected = 0, {}
    for v in sorted(levels):
        expected[v] = so_far
        so_far += levels[v]
    assert {r.v: r._before for r in rows_before(cells, ["k"], slots).collect()} == expected
    for depth in range(len(slots)):
        widest = cells.groupBy("k", *slots[:depth]).agg(F.countDistinct(slots[depth]).alias("n")).agg(F.max("n")).first()[0]
        assert widest <= 2**DIGIT_BITS
    plan = rows_before(cells, ["k"], slots)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Window [" in line for line in plan.splitlines()) == len(slots)


def test_literal_ranking_agrees_with_struct_form(skewed):
    _, prices = skewed
    ranked = ranked_windows(prices, 6)
    literal = ranked.groupBy("REGIONID", "trade_date").agg(
        F.max(F.when(F.col("charge_rank") == 1, F.col("window_start"))).alias("charge_start_time"),
        F.max(F.when(F.col("discharge_rank") == 1, F.col("window_start"))).alias("discharge_start_time"),
    )
    assert rows_of(literal) == rows_of(daily_arbitrage(prices, 6).select(literal.columns))
    unique = ranked.groupBy("REGIONID", "trade_date").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("charge_rank").alias("c"),
        F.countDistinct("discharge_rank").alias("d"),
        F.max("charge_rank").alias("m"),
    )
    assert unique.where("n != c or n != d or n != m").isEmpty()


def test_known_dips_and_peaks(make_prices, grid):
    levels = [50.0] * 288
    levels[30:54] = [10.0] * 24
    levels[200:224] = [90.0] * 24
    best = daily_arbitrage(make_prices(grid("2024-01-01 00:00", "R", levels))).first()
    assert best.charge_start_time == datetime(2024, 1, 1, 2, 30)
    assert best.charge_end_time == datetime(2024, 1, 1, 4, 30)
    assert best.discharge_start_time == datetime(2024, 1, 1, 16, 40)
    assert (best.charge_avg_price, best.discharge_avg_price) == (10.0, 90.0)


def test_flat_day_and_short_days(make_prices, grid):
    rows = grid("2024-01-01 00:00", "R", [5.0] * 288)
    rows += grid("2024-01-02 00:00", "R", [5.0] * 23) + grid("2024-01-03 00:00", "R", range(24))
    found = {r.trade_date.day: r for r in annual_arbitrage(make_prices(rows)).collect()}
    assert found.keys() == {1, 3}
    assert found[1].charge_start_time == found[1].discharge_start_time == datetime(2024, 1, 1)
    assert found[1].daily_price_volatility is None and found[3].daily_price_volatility is None
    assert found[1].charge_volatility == 0.0


def test_missing_rows_and_strict_time(make_prices, grid):
    rows = grid("2024-01-01 00:00", "R", range(40))
    rows[10] = (rows[10][0], "R", None)
    prices = make_prices(rows)
    loose = {r.window_start.hour * 12 + r.window_start.minute // 5 for r in rolling_forward(prices).collect()}
    strict = rolling_forward(prices, strict_time=True).collect()
    assert loose == set(range(17)) - {10}
    assert {r.window_start.hour * 12 + r.window_start.minute // 5 for r in strict} == {11, 12, 13, 14, 15, 16}


def test_month_border(make_prices):
    rows = [("2023-12-31 23:55", "R", 1.0), ("2024-01-01 00:00", "R", 3.0), ("2024-01-01 00:05", "R", 8.0)]
    prices = make_prices(rows)
    trailing = rolling_trailing(prices, 2).orderBy("SETTLEMENTDATE").collect()
    assert [r.avg_rrp_2hr for r in trailing] == [1.0, 2.0, 5.5]
    days = {r.SETTLEMENTDATE: r.trade_date for r in period_of_day(prices, "market").collect()}
    assert days[datetime(2024, 1, 1)] == datetime(2023, 12, 31)


def test_extremes_flag_a_single_row_once(make_prices):
    rows = [("2024-01-01 00:05", "R", 1.0), ("2024-02-01 00:05", "R", 4.0), ("2024-02-01 00:10", "R", 4.0)]
    found = monthly_extremes(make_prices(rows), 1).orderBy("SETTLEMENTDATE").collect()
    flags = [(r.SETTLEMENTDATE.month, r.is_month_low, r.is_month_high) for r in found]
    assert flags == [(1, True, True), (2, True, True)]
    assert found[1].SETTLEMENTDATE == datetime(2024, 2, 1, 0, 5)


def test_rows_of_one_stamp_are_told_apart(make_prices):
    """The lowest and the highest average may stand on one stamp, and so may the two best windows."""
    rows = [("2024-01-01 00:05", "R", 1.0), ("2024-01-01 00:05", "R", 9.0)]
    ends = monthly_extremes(make_prices(rows), 1).collect()
    assert sorted((r.avg_rrp_2hr, r.is_month_low, r.is_month_high) for r in ends) == [(1.0, True, False), (9.0, False, True)]
    day = annual_arbitrage(make_prices(rows), 1).first()
    assert day.daily_price_volatility == pytest.approx(round(8 / 2**0.5, 2))
