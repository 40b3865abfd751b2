"""Row selection, calendar columns and unions over price tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.calendar import at, day_of_week, day_type, season


def midnight(day: date | str) -> datetime:
    """Zone-less midnight of a day."""
    start = date.fromisoformat(day) if isinstance(day, str) else day
    return datetime(start.year, start.month, start.day)


def filter_range(
    prices: DataFrame,
    regions: Sequence[str],
    start: date | str,
    end: date | str,
    end_inclusive: bool = False,
) -> DataFrame:
    """Rows of some regions from midnight of ``start`` to midnight of ``end``, both stamps included.

    ``end_inclusive`` takes the whole of the end day instead. The year bounds let partitions be pruned.
    """
    first, last = midnight(start), midnight(end)
    stamp = F.col("SETTLEMENTDATE")
    until = stamp < at(last) + F.expr("INTERVAL 1 DAY") if end_inclusive else stamp <= at(last)
    chosen = prices.where(F.col("REGIONID").isin(*regions)).where(stamp >= at(first)).where(until)
    if "year" in prices.columns:
        chosen = chosen.where(F.col("year").between(first.year, last.year))
    return chosen


def within_backfill(stamp: Column, year: int, cutoff: date | str) -> Column:
    """Whether a stamp lies in one calendar year, strictly before a cutoff day."""
    start, following = datetime(year, 1, 1), datetime(year + 1, 1, 1)
    return (stamp >= at(start)) & (stamp < at(following)) & (stamp < at(midnight(cutoff)))


def backfill_filter(prices: DataFrame, year: int, cutoff: date | str) -> DataFrame:
    """Rows of one calendar year strictly before a cutoff day."""
    return prices.where(within_backfill(F.col("SETTLEMENTDATE"), year, cutoff))


def distinct_regions(prices: DataFrame) -> DataFrame:
    """The regions that occur."""
    return prices.select("REGIONID").where(F.col("REGIONID").isNotNull()).distinct()


def calendar_attrs(prices: DataFrame) -> DataFrame:
    """Month, quarter, season, day of week and day type of every row."""
    stamp = F.col("SETTLEMENTDATE")
    return prices.select(
        "SETTLEMENTDATE",
        "REGIONID",
        F.month(stamp).alias("month"),
        F.quarter(stamp).alias("quarter"),
        season(F.month(stamp)).alias("season"),
        day_of_week(stamp).alias("day_of_week"),
        day_type(stamp).alias("day_type"),
    )


def union_batches(batches: Sequence[DataFrame]) -> DataFrame:
    """All rows of the batches, columns matched by name."""
    return reduce(DataFrame.unionByName, batches)
