"""Typing and validation of landed text rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.calendar import parse_timestamp
from tidegrid.functions.numeric import PRICE_LIMIT, read_number, valid_price
from tidegrid.schema import PRICE_COLUMNS


class MissingColumnsError(ValueError):
    """Raised when an input lacks columns it must have."""


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` itself, or :class:`MissingColumnsError` naming what it lacks."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise MissingColumnsError(f"missing columns: {', '.join(missing)}")
    return df


def bare_text(column: str) -> Column:
    """Text without double quotes and surrounding blanks."""
    return F.trim(F.replace(F.col(column), F.lit('"'), F.lit("")))


def with_partition_columns(prices: DataFrame) -> DataFrame:
    """Add ``year`` and ``month`` of the settlement stamp."""
    return prices.withColumns({"year": F.year("SETTLEMENTDATE"), "month": F.month("SETTLEMENTDATE")})


def price_fault(number: Column) -> Column:
    """Why a number read from text is no price, or NULL."""
    return (
        F.when(number.isNull() | (F.abs(number) == F.lit(float("inf"))), "bad price")
        .when(F.abs(number) >= PRICE_LIMIT, "price out of range")
    )


def _typed(raw: DataFrame) -> DataFrame:
    """Typed columns beside the raw ones, and the first ``reason`` a row cannot be used, or NULL.

    Texts are read in a projection of their own. The row number in it keeps filters on what follows from being
    pushed below, where they would read the texts again.
    """
    require_columns(raw, PRICE_COLUMNS)
    read = raw.select(
        *[F.col(c).alias(f"raw_{c}") for c in PRICE_COLUMNS],
        parse_timestamp(bare_text("SETTLEMENTDATE")).alias("SETTLEMENTDATE"),
        F.nullif(bare_text("REGIONID"), F.lit("")).alias("REGIONID"),
        read_number(bare_text("PERIODID")).try_cast("bigint").try_cast("smallint").alias("PERIODID"),
        read_number(bare_text("RRP")).alias("RRP"),
        parse_timestamp(bare_text("LASTCHANGED")).alias("LASTCHANGED"),
        F.monotonically_increasing_id().alias("_row"),
        *[c for c in raw.columns if c == "filename"],
    )
    reason = (
        F.when(F.col("_row") < 0, "no row")
        .when(F.col("SETTLEMENTDATE").isNull(), "bad date")
        .when(F.col("REGIONID").isNull(), "no region")
        .when(price_fault(F.col("RRP")).isNotNull(), price_fault(F.col("RRP")))
        .when(F.col("PERIODID").isNull(), "bad period")
    )
    return read.withColumn("reason", reason)


def clean_prices(raw: DataFrame) -> DataFrame:
    """Typed price rows of text columns; a row with an unusable key field is dropped, its file is not."""
    good = _typed(raw).where(F.col("reason").isNull()).select(*PRICE_COLUMNS)
    return with_partition_columns(good)


def rejected_prices(raw: DataFrame) -> DataFrame:
    """The rows :func:`clean_prices` drops, as landed, with the first reason and their ``filename`` where known."""
    extra = [c for c in raw.columns if c == "filename"]
    return (
        _typed(raw)
        .where(F.col("reason").isNotNull())
        .select(*[F.col(f"raw_{c}").alias(c) for c in PRICE_COLUMNS], "reason", *extra)
    )


def drop_bad_numbers(prices: DataFrame) -> DataFrame:
    """NULL in place of what is no price (:func:`valid_price`) in tables written elsewhere."""
    return prices.withColumn("RRP", valid_price("RRP"))


def dedupe_prices(prices: DataFrame) -> DataFrame:
    """One row per region and settlement stamp: the one changed last.

    A partial aggregate keeps one candidate per task, so many copies of one row never travel.
    """
    carried = [c for c in prices.columns if c not in ("REGIONID", "SETTLEMENTDATE", "LASTCHANGED")]
    latest = F.max(F.struct("LASTCHANGED", *carried))
    return (
        prices.groupBy("REGIONID", "SETTLEMENTDATE")
        .agg(latest.alias("latest"))
        .select(
            *[
                F.col(c) if c in ("REGIONID", "SETTLEMENTDATE") else F.col("latest")[c].alias(c)
                for c in prices.columns
            ]
        )
    )


