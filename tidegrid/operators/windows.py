"""Row-frame price windows: forward and trailing sums, window ranks and monthly extremes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.calendar import INTERVAL_MINUTES, minutes, second_of_day, trade_day, truncate
from tidegrid.functions.numeric import from_units, price_units
from tidegrid.operators.groups import (
    MAX_GROUP_ROWS,
    cut_groups,
    lend_edges,
    number_rows,
    order_digits,
    oversized_groups,
    settle,
)

# Fixed value: 24 five-minute rows are the two-hour window.
WINDOW_ROWS = 24

DAY = ["REGIONID", "trade_date"]
TIME_ORDER = ["SETTLEMENTDATE", "RRP"]


def _time_slots() -> dict[str, Column]:
    return {"_day": F.to_date("SETTLEMENTDATE"), "_second": second_of_day("SETTLEMENTDATE")}


def period_of_day(
    prices: DataFrame, trade_day_of: str = "calendar", max_group_rows: int | None = MAX_GROUP_ROWS
) -> DataFrame:
    """Number the intervals of each region-day 1, 2, .. in time order."""
    dated = prices.withColumn("trade_date", trade_day("SETTLEMENTDATE", trade_day_of))
    big = oversized_groups(dated, DAY, max_group_rows)
    order = [F.col(c).asc_nulls_last() for c in TIME_ORDER]
    return number_rows(dated, DAY, order, _time_slots(), "period_of_day", max_group_rows, big)


def _dated_units(prices: DataFrame, trade_day_of: str) -> DataFrame:
    """Non-null prices with their trading day and exact units."""
    return (
        prices.where(F.col("RRP").isNotNull())
        .select("REGIONID", "SETTLEMENTDATE", "RRP")
        .withColumns({"trade_date": trade_day("SETTLEMENTDATE", trade_day_of), "_units": price_units("RRP")})
    )


def rolling_forward(
    prices: DataFrame,
    window_rows: int = WINDOW_ROWS,
    *,
    complete_only: bool = True,
    extremes: bool = False,
    volatility: bool = False,
    strict_time: bool = False,
    trade_day_of: str = "calendar",
    max_group_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """One row per window that starts at an interval and runs ``window_rows`` rows within its day.

    NULL prices are left out before rows are counted. ``complete_only`` drops the windows cut off by the
    end of the day; ``strict_time`` keeps only windows whose rows follow each other without a gap.
    """
    dated = _dated_units(prices, trade_day_of)
    big = oversized_groups(dated, DAY, max_group_rows)
    return _forward(dated, window_rows, complete_only, extremes, volatility, strict_time, max_group_rows, big)


def framed_rows(
    dated: DataFrame, window_rows: int, strict_time: bool, max_group_rows: int | None, big: DataFrame | None
) -> tuple[DataFrame, list[str]]:
    """All rows, numbered, with the sum of the complete window each of them starts; and the partition keys.

    The sum is the difference of two running sums, ``lead`` over the same sort, which costs the same for any
    window length. ``window_units`` is NULL on rows that start no complete window and on borrowed rows.
    ``_number`` counts within the partition, ``_base`` is what precedes the partition in its day.
    """
    part = DAY
    own = F.lit(True)
    if big is None:
        dated = dated.withColumn("_base", F.lit(0))
    else:
        part = [*DAY, "_chunk"]
        own = ~F.col("_halo")
        chunked = cut_groups(dated, DAY, _time_slots(), max_group_rows, big)
        dated = lend_edges(chunked, DAY, ["_chunk"], TIME_ORDER, ["_units"], window_rows - 1, trailing=False)
    rows = Window.partitionBy(*part).orderBy(*TIME_ORDER)
    so_far = rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = window_rows - 1
    framed = dated.withColumns(
        {"_number": F.row_number().over(rows).cast("bigint"), "_running": F.sum("_units").over(so_far)}
    ).withColumn("_reached", F.lead("_running", ahead).over(rows))
    if strict_time:
        last = F.lead("SETTLEMENTDATE", ahead).over(rows)
        framed = framed.withColumn("_span", last - F.col("SETTLEMENTDATE"))
        own = own & (F.col("_span") == minutes(INTERVAL_MINUTES * ahead))
    return framed.withColumn("window_units", F.when(own, F.col("_reached") - F.col("_running") + F.col("_units"))), part


def _forward(
    dated: DataFrame,
    window_rows: int,
    complete_only: bool,
    extremes: bool,
    volatility: bool,
    strict_time: bool,
    max_group_rows: int | None,
    big: DataFrame | None,
) -> DataFrame:
    """Forward frames; minimum, maximum and deviation need the sliding frame and are only made on request."""
    framed, part = framed_rows(dated, window_rows, strict_time, max_group_rows, big)
    frame = Window.partitionBy(*part).orderBy(*TIME_ORDER).rowsBetween(Window.currentRow, window_rows - 1)
    columns = {"periods_in_window": F.lit(window_rows).cast("bigint")}
    if not complete_only:
        columns["periods_in_window"] = F.count(F.lit(1)).over(frame)
        columns["window_units"] = F.sum("_units").over(frame)
    if extremes:
        columns["window_min_price"] = F.min("RRP").over(frame)
        columns["window_max_price"] = F.max("RRP").over(frame)
    if volatility:
        columns["window_price_volatility"] = F.stddev_samp("RRP").over(frame)
    kept = framed.withColumn("_complete", F.col("window_units").isNotNull()).withColumns(columns)
    if complete_only or strict_time:
        kept = kept.where("_complete")
    elif big is not None:
        kept = kept.where(~F.col("_halo"))
    asked = [c for c in ("window_min_price", "window_max_price", "window_price_volatility") if c in columns]
    return kept.select(
        *DAY,
        (F.col("_number") + F.col("_base")).alias("period_of_day"),
        F.col("SETTLEMENTDATE").alias("window_start"),
        "window_units",
        from_units(F.col("window_units"), F.col("periods_in_window")).alias("window_avg_price"),
        *asked,
        "periods_in_window",
    )


def best_windows(
    prices: DataFrame,
    window_rows: int = WINDOW_ROWS,
    *,
    volatility: bool = False,
    strict_time: bool = False,
    trade_day_of: str = "calendar",
    max_group_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """Structs ``charge`` and ``discharge`` of every region-day: the cheapest and the dearest window.

    Minimum and maximum of a struct pick them in one partial and final aggregate over the sort the windows
    already have; the period breaks ties in favour of the earliest. With ``volatility`` the winners are found
    first, so that the deviation is taken over their rows only and not over every window of the day.
    """
    dated = _dated_units(prices, trade_day_of)
    big = oversized_groups(dated, DAY, max_group_rows)
    framed, part = framed_rows(dated, window_rows, strict_time, max_group_rows, big)
    level, number, start = F.col("window_units"), F.col("_number"), F.col("SETTLEMENTDATE").alias("window_start")
    period = number + F.col("_base")
    low = F.struct(level, period.alias("tie"), start)
    high = F.struct(level, (-period).alias("tie"), start)
    if not volatility:
        complete = framed.where(level.isNotNull())
        return complete.groupBy(*DAY).agg(F.min(low).alias("charge"), F.max(high).alias("discharge"))

    def deviation(side: str) -> Column:
        first = F.abs(F.col(side)["tie"]) - F.col("_base")
        inside = number.between(first, first + window_rows - 1)
        return F.stddev_samp(F.when(inside, F.col("RRP"))).alias(f"{side}_volatility")

    whole = Window.partitionBy(*part)
    winners = (
        framed.withColumns(
            {
                "low": F.min(F.when(level.isNotNull(), low)).over(whole),
                "high": F.max(F.when(level.isNotNull(), high)).over(whole),
                "_base": F.max("_base").over(whole),
            }
        )
        .where(F.col("low").isNotNull())
        .groupBy(*part)
        .agg(F.max("low").alias("low"), F.max("high").alias("high"), deviation("low"), deviation("high"))
    )
    ends = [
        F.struct(f"{side}.*", F.col(f"{side}_volatility").alias("window_price_volatility")) for side in ("low", "high")
    ]
    return winners.groupBy(*DAY).agg(F.min(ends[0]).alias("charge"), F.max(ends[1]).alias("discharge"))


def rolling_trailing(
    prices: DataFrame,
    window_rows: int = WINDOW_ROWS,
    *,
    complete_only: bool = False,
    max_group_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """Average of each row and the ``window_rows - 1`` rows before it in its region, across day borders.

    A region's whole history never meets in one task: the unit of work is the region-month, which borrows
    the last rows of the months before it. The first rows of a region keep their shorter frames unless
    ``complete_only``.
    """
    monthly = (
        prices.where(F.col("RRP").isNotNull())
        .select("REGIONID", "SETTLEMENTDATE", "RRP")
        .withColumns({"month": truncate("month", "SETTLEMENTDATE"), "_units": price_units("RRP")})
    )
    big = oversized_groups(monthly, ["REGIONID", "month"], max_group_rows)
    chunk = ["month"]
    if big is not None:
        chunk = ["month", "_chunk"]
        monthly = cut_groups(monthly, ["REGIONID", "month"], _time_slots(), max_group_rows, big)
    shared = lend_edges(monthly, ["REGIONID"], chunk, TIME_ORDER, ["_units"], window_rows - 1, trailing=True)
    rows = Window.partitionBy("REGIONID", *chunk).orderBy(*TIME_ORDER)
    so_far = rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    framed = (
        shared.withColumns({"_number": F.row_number().over(rows), "_running": F.sum("_units").over(so_far)})
        .withColumn("_passed", F.coalesce(F.lag("_running", window_rows).over(rows), F.lit(0)))
        .where(~F.col("_halo"))
        .withColumn("window_units", F.col("_running") - F.col("_passed"))
        .withColumn("periods_in_window", F.least(F.col("_number"), F.lit(window_rows)).cast("bigint"))
    )
    if complete_only:
        framed = framed.where(F.col("periods_in_window") == window_rows)
    return framed.select(
        "REGIONID",
        "month",
        "SETTLEMENTDATE",
        "RRP",
        "window_units",
        from_units(F.col("window_units"), F.col("periods_in_window")).alias("avg_rrp_2hr"),
        "periods_in_window",
    )


def ranked_windows(
    prices: DataFrame,
    window_rows: int = WINDOW_ROWS,
    *,
    strict_time: bool = False,
    trade_day_of: str = "calendar",
    max_group_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """Complete windows with ``charge_rank`` (cheapest first) and ``discharge_rank`` (dearest first).

    Equal windows rank by time. To keep only the best window of a day use
    :func:`tidegrid.operators.arbitrage.daily_arbitrage`, which needs no ranking.
    """
    dated = _dated_units(prices, trade_day_of)
    big = oversized_groups(dated, DAY, max_group_rows)
    windows = _forward(dated, window_rows, True, False, False, strict_time, max_group_rows, big)
    if big is not None:
        windows = settle(windows)
    level, period = F.col("window_units"), F.col("period_of_day")
    # The levels of a hot day are counted digit by digit and equal ones numbered block by block, so neither a day with
    # many levels nor one frequent price becomes one task.
    block = F.floor(period / (max_group_rows or MAX_GROUP_ROWS))
    for name, order, first in (("charge_rank", level.asc(), level), ("discharge_rank", level.desc(), -level)):
        slots = {**order_digits(first, "_level"), "_block": block}
        windows = number_rows(windows, DAY, [order, period.asc()], slots, name, max_group_rows, big)
    return windows


def monthly_extremes(
    prices: DataFrame,
    window_rows: int = WINDOW_ROWS,
    *,
    complete_only: bool = False,
    max_group_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """Rows with the lowest and the highest trailing average of each region and month.

    Ties go to the earliest row. A row that is both appears once with both flags set.
    """
    trailing = rolling_trailing(
        prices, window_rows, complete_only=complete_only, max_group_rows=max_group_rows
    ).withColumn("_back", F.expr("timestamp_ntz'1970-01-01' - SETTLEMENTDATE"))
    value = [F.col("SETTLEMENTDATE").alias("at"), F.col("avg_rrp_2hr").alias("avg")]
    ends = trailing.groupBy("REGIONID", "month").agg(
        F.min(F.struct("avg_rrp_2hr", *value)).alias("low"),
        F.max(F.struct("avg_rrp_2hr", "_back", *value)).alias("high"),
    )
    low, high = F.col("low"), F.col("high")
    same = (low["at"] == high["at"]) & (low["avg"] == high["avg"])
    picks = F.array_compact(
        F.array(
            F.struct(low["at"].alias("at"), low["avg"].alias("avg"), F.lit(True).alias("lo"), same.alias("hi")),
            F.when(
                ~same,
                F.struct(
                    high["at"].alias("at"), high["avg"].alias("avg"), F.lit(False).alias("lo"), F.lit(True).alias("hi")
                ),
            ),
        )
    )
    return ends.select("REGIONID", "month", F.explode(picks).alias("pick")).select(
        "REGIONID",
        "month",
        F.col("pick.at").alias("SETTLEMENTDATE"),
        F.col("pick.avg").alias("avg_rrp_2hr"),
        F.col("pick.lo").alias("is_month_low"),
        F.col("pick.hi").alias("is_month_high"),
    )
