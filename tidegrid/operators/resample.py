"""Time-bucket aggregation with empty buckets filled in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.calendar import truncate
from tidegrid.functions.numeric import exact_mean

_STEP = {"hourly": (1, "HOUR"), "daily": (1, "DAY"), "weekly": (7, "DAY")}
# Buckets of a gap that one row is spread into at a time.
RUN = 1000


def resample(prices: DataFrame, every: str, by: Sequence[str] = (), fill_gaps: bool = True) -> DataFrame:
    """Mean, minimum, maximum and sample deviation of prices per bucket.

    ``every`` is ``5-minute`` (the rows themselves), ``hourly``, ``daily`` or ``weekly``; a week runs from
    Monday to Sunday and is labelled by its Sunday. Without ``by`` all regions are blended. Buckets without
    rows between the first and the last one are emitted with NULL values: each bucket fills the gap up to
    the next, so only as many rows as there are calendar buckets are sorted.
    """
    if every == "5-minute":
        return prices
    if every not in _STEP:
        raise ValueError(f"every must be '5-minute' or one of {sorted(_STEP)}, not {every!r}")
    stamp = F.col("SETTLEMENTDATE")
    if every == "weekly":
        bucket = truncate("week", stamp) + F.expr("INTERVAL 6 DAYS")
    else:
        bucket = truncate({"hourly": "hour", "daily": "day"}[every], stamp)
    values = ["mean_price", "min_price", "max_price", "std_price"]
    filled = (
        prices.where(stamp.isNotNull())
        .groupBy(*by, bucket.alias("_bucket"))
        .agg(
            exact_mean("RRP").alias("mean_price"),
            F.min("RRP").alias("min_price"),
            F.max("RRP").alias("max_price"),
            F.stddev_samp("RRP").alias("std_price"),
        )
    )
    if not fill_gaps:
        return filled.withColumnRenamed("_bucket", "SETTLEMENTDATE").select(*by, "SETTLEMENTDATE", *values)
    size, unit = _STEP[every]
    following = F.lead("_bucket").over(Window.partitionBy(*by).orderBy("_bucket"))
    buckets = F.coalesce(F.floor(F.timestamp_diff(unit, F.col("_bucket"), following) / size), F.lit(1))
    # A gap of any length is cut in runs before it is spread out, so no row holds all of it.
    runs = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_buckets") - 1) / RUN)))
    last = F.least(F.col("_buckets"), (F.col("_run") + 1) * RUN) - 1
    spread = (
        filled.withColumn("_buckets", buckets)
        .withColumn("_run", runs)
        .withColumn("_step", F.explode(F.sequence(F.col("_run") * RUN, last)))
    )
    ahead = (F.col("_step") * size).cast("int")
    interval = F.make_dt_interval(F.lit(0), ahead) if unit == "HOUR" else F.make_dt_interval(ahead)
    own = F.col("_step") == 0
    return spread.select(
        *by, (F.col("_bucket") + interval).alias("SETTLEMENTDATE"), *[F.when(own, F.col(v)).alias(v) for v in values]
    )
