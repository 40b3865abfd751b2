from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidegrid.functions import calendar as cal
from tidegrid.functions import numeric as num


def values(spark, expression, inputs, kind):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression).collect()]


def stamps(*texts):
    return [datetime.fromisoformat(t) for t in texts]


def test_period_id(spark):
    inputs = stamps(*[f"2024-01-01 {t}" for t in ("00:00", "00:05", "00:01", "00:06", "18:35", "23:55")])
    assert values(spark, cal.period_id("x"), inputs, "timestamp_ntz") == [288, 1, 1, 2, 223, 287]


def test_trade_day(spark):
    inputs = stamps("2024-01-01 00:00", "2024-01-01 00:05", "2023-12-31 23:55")
    first, last = datetime(2024, 1, 1), datetime(2023, 12, 31)
    assert values(spark, cal.trade_day("x"), inputs, "timestamp_ntz") == [first, first, last]
    assert values(spark, cal.trade_day("x", "market"), inputs, "timestamp_ntz") == [last, first, last]
    with pytest.raises(ValueError):
        cal.trade_day("x", "other")


def test_seasons_and_day_types(spark):
    months = values(spark, cal.season(F.col("x")), list(range(1, 13)), "int")
    assert months == ["Summer"] * 2 + ["Autumn"] * 3 + ["Winter"] * 3 + ["Spring"] * 3 + ["Summer"]
    week = [datetime(2024, 1, d) for d in range(7, 14)]  # Sunday first
    assert values(spark, cal.day_of_week("x"), week, "timestamp_ntz") == list(range(7))
    kinds = values(spark, cal.day_type("x"), week, "timestamp_ntz")
    assert kinds == ["Weekend"] + ["Weekday"] * 5 + ["Weekend"]
    assert values(spark, cal.month_name(F.col("x")), [1, 12], "int") == ["Jan", "Dec"]


def test_truncate_ignores_session_time_zone(spark):
    inputs = stamps("2024-03-10 02:30:15", "2024-10-06 02:59:59")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert values(spark, cal.truncate("hour", "x"), inputs, "timestamp_ntz") == stamps(
            "2024-03-10 02:00", "2024-10-06 02:00"
        )
        assert values(spark, cal.truncate("week", "x"), inputs, "timestamp_ntz") == stamps("2024-03-04", "2024-09-30")
        assert values(spark, cal.truncate("month", "x"), inputs, "timestamp_ntz") == stamps("2024-03-01", "2024-10-01")
        assert values(spark, cal.parse_timestamp("x"), ["2024/03/10 02:30:00"], "string") == stamps("2024-03-10 02:30")
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_parse_timestamp(spark):
    texts = ["2024/01/02 03:04:05", " 2024-01-02 03:04 ", "2024/01/02", "2024/13/01 00:00:00", "", None, "soon"]
    at = datetime(2024, 1, 2, 3, 4, 5)
    expected = [at, at.replace(second=0), datetime(2024, 1, 2), None, None, None, None]
    assert values(spark, cal.parse_timestamp("x"), texts, "string") == expected
    day_first = cal.parse_timestamp("x", ("dd/MM/yyyy HH:mm",))
    assert values(spark, day_first, ["02/01/2024 03:04"], "string") == [at.replace(second=0)]


def test_parse_number(spark):
    texts = ["12.5", " -3 ", "1e3", ".5", "12d", "0x10", "NaN", "Infinity", "1e999", "n/a", "", None]
    assert values(spark, num.parse_number("x"), texts, "string") == [12.5, -3.0, 1000.0, 0.5] + [None] * 8
    assert values(spark, num.parse_small_int("x"), ["7", "7.9", "40000", "x"], "string") == [7, 7, None, None]


def test_rounding(spark):
    inputs = [1.005, 0.125, -0.125, 2.5, None]
    assert values(spark, num.round_half_away(F.col("x"), 2), inputs, "double") == [1.0, 0.13, -0.13, 2.5, None]
    assert values(spark, num.round_half_even(F.col("x"), 2), inputs, "double") == [1.0, 0.12, -0.12, 2.5, None]
    assert values(spark, num.round_half_even(F.col("x"), 2), [float("inf")], "double") == [float("inf")]


def test_sums_do_not_depend_on_order(spark):
    rows = spark.range(10_000).select((F.col("id") * 0.1 - 300).alias("RRP"))
    means = {rows.repartition(n).agg(num.exact_mean("RRP")).first()[0] for n in (1, 3, 7)}
    assert means == {199.95}
    assert rows.where("RRP > 1e6").agg(num.exact_mean("RRP")).first()[0] is None


def test_sums_beyond_whole_units_and_any_finite_number(spark):
    """A unit total above 9.2e18 has the right mean; numbers of any notation and length are read."""
    big = spark.range(20).select(F.lit(9.0e11).alias("RRP"))
    assert big.agg(num.exact_mean("RRP")).first()[0] == 9.0e11
    texts = ["1e005", "1.5E+003", "1" * 100, "0" * 200 + "7.25", "1e999", "nan"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in frame.select(num.parse_number("t")).collect()]
    assert got == [100000.0, 1500.0, float("1" * 100), 7.25, None, None]
