"""Descriptive statistics, exact percentiles, histogram and threshold counts of prices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.numeric import exact_mean

# Percentiles of the price statistics.
PERCENTILES = (0.05, 0.25, 0.5, 0.75, 0.95)

# Histogram bins and the level above which a price counts as high.
HISTOGRAM_BINS = 50
HIGH_PRICE = 300.0

# A percentile of the sketch is off by at most one row in this many.
ACCURACY = 10_000


def percentile_name(q: float) -> str:
    """``p5``, ``p25``, .."""
    return f"p{round(q * 100, 6):g}"


def _bracket_shares(percentiles: Sequence[float]) -> list[float]:
    """Shares below and above each percentile by more than the sketch's error and the two rows it lies between."""
    margin = 5.0 / ACCURACY
    return [share for q in percentiles for share in (max(0.0, float(q) - margin), min(1.0, float(q) + margin))]


def _order_statistics(prices: DataFrame, percentiles: Sequence[float], known: Column) -> DataFrame:
    """Interpolated percentiles as one row, from the row count and the bracketing prices in ``known``.

    One scan counts the rows between the brackets and, inside them, the rows of each price. Counts of everything
    before a bracket are a few numbers; only prices inside one are ordered, each stretch on its own.
    """
    edges = [known["edges"][i] for i in range(2 * len(percentiles))]
    price = F.col("RRP")
    inside = F.lit(False)
    for low, high in zip(edges[::2], edges[1::2], strict=True):
        inside = inside | price.between(low, high)
    # As many edges lie below a price as below every other one of its stretch; what is outside comes first in it.
    stretch = sum(((edge < price).cast("int") for edge in edges), F.lit(0))
    counts = (
        prices.where(price.isNotNull())
        .select(stretch.alias("stretch"), F.when(inside, price).alias("price"))
        .groupBy("stretch", "price")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # What a stretch holds counts for every later one as rows before its first price.
    later = F.transform(
        F.sequence("stretch", F.lit(len(edges))),
        lambda at: F.struct(at.alias("stretch"), F.when(at == F.col("stretch"), F.col("price")).alias("price")),
    )
    spread = counts.select(F.explode(later).alias("to"), "n").groupBy("to.stretch", "to.price").agg(F.sum("n").alias("n"))
    within = Window.partitionBy("stretch").orderBy(F.col("price").asc_nulls_first())
    placed = spread.select("price", "n", (F.sum("n").over(within) - F.col("n")).alias("first"))

    def value(q: float) -> Column:
        rank = F.lit(float(q)) * (known["rows"] - 1)
        lower = F.floor(rank)
        ends = [
            F.max(F.when((at >= F.col("first")) & (at < F.col("first") + F.col("n")), F.col("price")))
            for at in (lower, F.ceil(rank))
        ]
        weight = F.max(rank - lower)
        return ends[0] * (1 - weight) + ends[1] * weight

    return placed.agg(*[value(q).alias(percentile_name(q)) for q in percentiles])


def _edges(percentiles: Sequence[float]) -> Column:
    """Bracketing prices, all in one array.

    Fewer rows than the sketch resolves are all taken: two rows of them are more than the brackets' margin.
    """
    whole = F.array(*[F.lit(float(end)) for _ in percentiles for end in ("-inf", "inf")])
    return F.when(F.col("rows") >= ACCURACY, F.col("brackets")).otherwise(whole).alias("edges")


def _sketch(shares: Sequence[float], accuracy: int) -> Column:
    return F.percentile_approx("RRP", [float(s) for s in shares], accuracy)


def exact_percentiles(prices: DataFrame, percentiles: Sequence[float] = PERCENTILES) -> DataFrame:
    """Linearly interpolated percentiles of ``RRP`` as one row, without gathering the values in one task.

    A first scan takes the row count and, from a mergeable sketch, two prices around each percentile; a second one
    finds the exact order statistics between them. Nothing is assumed of the level or the spacing of prices.
    """
    summary = prices.agg(F.count("RRP").alias("rows"), _sketch(_bracket_shares(percentiles), ACCURACY).alias("brackets"))
    return _order_statistics(prices, percentiles, summary.select(F.struct("rows", _edges(percentiles))).scalar())


def describe_prices(
    prices: DataFrame, percentiles: Sequence[float] = PERCENTILES, approximate: bool = False, accuracy: int = ACCURACY
) -> DataFrame:
    """Count, mean, deviation, extremes, percentiles and date range of prices, as one row.

    ``approximate`` takes the percentiles from a mergeable sketch in one pass over the data; exact ones take a second.
    """
    stats = [
        F.count("RRP").alias("count"),
        exact_mean("RRP").alias("mean"),
        F.stddev_samp("RRP").alias("std"),
        F.min("RRP").alias("min"),
        F.max("RRP").alias("max"),
        F.min("SETTLEMENTDATE").alias("first_date"),
        F.max("SETTLEMENTDATE").alias("last_date"),
    ]
    names = [percentile_name(q) for q in percentiles]
    if approximate:
        summary = prices.agg(*stats, _sketch(percentiles, accuracy).alias("_q"))
        return summary.select("*", *[F.col("_q")[i].alias(n) for i, n in enumerate(names)]).drop("_q")
    summary = prices.agg(
        *stats, F.count("RRP").alias("rows"), _sketch(_bracket_shares(percentiles), ACCURACY).alias("brackets")
    )
    known = summary.select(F.struct("*", _edges(percentiles))).scalar()
    exact = _order_statistics(prices, percentiles, known)
    # The scalar is one subquery wherever it is named.
    return exact.withColumn("_known", known).select("_known.*", *names).drop("rows", "brackets", "edges")


def price_histogram(prices: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Rows per equal-width price bin between minimum and maximum, empty bins included.

    The maximum belongs to the last bin; when all prices are equal they fall into the first. One scan counts the rows
    of each price; range and bins both follow from these counts.
    """
    counts = prices.where(F.col("RRP").isNotNull()).groupBy("RRP").agg(F.count(F.lit(1)).alias("n"))
    ends = F.struct(F.min("RRP").alias("low"), F.max("RRP").alias("high"), F.sum("n").alias("rows"))
    span = counts.agg(ends.alias("span")).scalar()
    width = (F.col("span.high") - F.col("span.low")) / bins
    position = F.floor((F.col("RRP") - F.col("span.low")) / width)
    binned = (
        counts.withColumn("span", span)
        .select(
            F.when(width == 0, F.lit(0)).otherwise(F.least(position, F.lit(bins - 1))).cast("bigint").alias("bin"), "n"
        )
        .groupBy("bin")
        .agg(F.sum("n").alias("records"))
    )
    edges = prices.sparkSession.range(0, bins, 1, 1).select(F.col("id").alias("bin")).withColumn("span", span)
    return edges.join(binned, "bin", "left").select(
        "bin",
        (F.col("span.low") + F.col("bin") * width).alias("bin_start"),
        (F.col("span.low") + (F.col("bin") + 1) * width).alias("bin_end"),
        F.coalesce("records", F.lit(0)).cast("bigint").alias("records"),
    )


def price_flags(prices: DataFrame, high_price: float = HIGH_PRICE) -> DataFrame:
    """Rows, negative and high prices and their shares in percent, as one row."""
    rows = F.count(F.lit(1))
    negative, high = F.count_if(F.col("RRP") < 0), F.count_if(F.col("RRP") > high_price)
    return prices.agg(
        rows.alias("records"),
        negative.alias("negative_prices"),
        (F.try_divide(negative.cast("double"), rows) * 100.0).alias("negative_percent"),
        high.alias("high_prices"),
        (F.try_divide(high.cast("double"), rows) * 100.0).alias("high_percent"),
    )
