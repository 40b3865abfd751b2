"""Number parsing, exact price sums and the two rounding rules.

Prices are summed as whole units of 1e-5 $/MWh held in a BIGINT, so a sum does not depend on the
order in which partitions are merged and window ranks are stable between runs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS_PER_PRICE = 100_000

# What decimal notation is written with; a cast alone would also read names, type suffixes and hexadecimal.
_NUMBER_CHARACTERS = r"^[-+.0-9eE\s]*$"

# Prices from here on do not fit the exact type: no price anywhere, see `valid_price`.
PRICE_LIMIT = 1e12


def price_units(price: Column | str) -> Column:
    """Price in whole 1e-5 $/MWh units."""
    exact = F.col(price) if isinstance(price, str) else price
    return (exact.try_cast("decimal(18,5)") * UNITS_PER_PRICE).cast("bigint")


def from_units(units: Column, rows: Column | int = 1) -> Column:
    """Average price of ``rows`` intervals whose unit sum is ``units``."""
    divisor = F.lit(rows) if isinstance(rows, int) else rows
    return units.cast("double") / F.lit(float(UNITS_PER_PRICE)) / divisor.cast("double")


def exact_sum(price: Column | str) -> Column:
    """Aggregate: exact sum with five decimals, in the type that sums of such sums have."""
    exact = (F.col(price) if isinstance(price, str) else price).try_cast("decimal(18,5)")
    return F.sum(exact).cast("decimal(38,5)")


def exact_mean(price: Column | str) -> Column:
    """Aggregate: mean price from an exact sum; NULL prices are skipped.

    The sum has 28 digits, room for 1e18 rows of five-digit prices.
    """
    exact = (F.col(price) if isinstance(price, str) else price).try_cast("decimal(18,5)")
    return F.sum(exact).cast("double") / F.nullif(F.count(exact), F.lit(0)).cast("double")


def money_sum(amount: Column | str) -> Column:
    """Aggregate: order-independent sum of amounts that carry float noise far below 1e-6."""
    value = F.col(amount) if isinstance(amount, str) else amount
    return F.sum(value.cast("decimal(24,6)")).cast("double")


def money_mean(amount: Column | str) -> Column:
    """Aggregate: mean of amounts from :func:`money_sum`."""
    value = F.col(amount) if isinstance(amount, str) else amount
    return money_sum(value) / F.nullif(F.count(value), F.lit(0)).cast("double")


def round_half_away(value: Column, digits: int) -> Column:
    """Round the binary value half away from zero, as SQL engines do for DOUBLE."""
    scale = float(10**digits)
    return F.signum(value) * F.floor(F.abs(value) * scale + 0.5).cast("double") / scale


def round_half_even(value: Column, digits: int) -> Column:
    """Round the binary value half to even, as data-frame libraries do."""
    scale = float(10**digits)
    return F.rint(value * scale) / scale


def parse_number(text: Column | str) -> Column:
    """Finite number in ``text`` as DOUBLE, else NULL."""
    return finite(read_number(text))


def read_number(text: Column | str) -> Column:
    """Number in decimal notation of any length as DOUBLE, infinite where it is too large, else NULL."""
    value = F.col(text) if isinstance(text, str) else text
    return F.when(value.rlike(_NUMBER_CHARACTERS), value).try_cast("double")


def parse_small_int(text: Column | str) -> Column:
    """Number in ``text`` truncated to SMALLINT, NULL when out of range or not a number."""
    return parse_number(text).try_cast("bigint").try_cast("smallint")


def finite(value: Column | str) -> Column:
    """NULL instead of NaN or an infinity."""
    number = F.col(value) if isinstance(value, str) else value
    # NaN is larger than every number.
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def valid_price(value: Column | str) -> Column:
    """The price, or NULL for NaN, infinities and prices out of range.

    Every way into the engine applies it, so that counts, extremes and exact sums are over the same rows.
    """
    number = F.col(value) if isinstance(value, str) else value
    return F.when(F.abs(number) < PRICE_LIMIT, number)
