"""Calendar attributes of a zone-less settlement timestamp."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Intervals are five minutes long, 288 to a day.
INTERVAL_MINUTES = 5
PERIODS_PER_DAY = 288

# Southern-hemisphere seasons by month number; the other months are Spring.
SEASON_MONTHS = {"Summer": (12, 1, 2), "Autumn": (3, 4, 5), "Winter": (6, 7, 8)}

# Short month names in calendar order.
MONTH_NAMES = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def at(moment: datetime) -> Column:
    """Zone-less literal; a plain ``lit`` of a datetime would depend on the session time zone."""
    return F.lit(moment.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")


def truncate(unit: str, ts: Column | str) -> Column:
    """Start of the ``hour``, ``day``, ``week`` (Monday) or ``month``, zone-less in any session time zone."""
    day = F.to_date(ts)
    if unit == "hour":
        return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.hour(ts))
    if unit == "day":
        return day.cast("timestamp_ntz")
    if unit in ("week", "month"):
        return F.trunc(day, unit).cast("timestamp_ntz")
    raise ValueError(f"cannot truncate to {unit!r}")


def second_of_day(ts: Column | str) -> Column:
    """Seconds since midnight."""
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def minutes(count: int) -> Column:
    """Day-time interval of ``count`` minutes."""
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(count), F.lit(0))


def trade_day(ts: Column | str, trade_day_of: str = "calendar") -> Column:
    """Midnight of the trading day.

    ``calendar`` takes the day of the period-ending stamp itself, so 00:00 opens the new day;
    ``market`` counts 00:00 to the day that ends there.
    """
    stamp = F.col(ts) if isinstance(ts, str) else ts
    if trade_day_of == "market":
        stamp = stamp - minutes(INTERVAL_MINUTES)
    elif trade_day_of != "calendar":
        raise ValueError(f"trade_day_of must be 'calendar' or 'market', not {trade_day_of!r}")
    return F.to_date(stamp).cast("timestamp_ntz")


def period_id(ts: Column | str) -> Column:
    """Five-minute period 1..288 of a period-ending stamp; 00:00 is period 288."""
    minute_of_day = F.hour(ts) * 60 + F.minute(ts)
    return (
        F.when(minute_of_day == 0, F.lit(PERIODS_PER_DAY))
        .otherwise(F.floor((minute_of_day - 1) / INTERVAL_MINUTES) + 1)
        .cast("smallint")
    )


def season(month: Column) -> Column:
    """Season name of a month number."""
    named = F
    for name, numbers in SEASON_MONTHS.items():
        named = named.when(month.isin(*numbers), F.lit(name))
    return named.otherwise(F.lit("Spring"))


def day_of_week(ts: Column | str) -> Column:
    """0 = Sunday .. 6 = Saturday."""
    return F.dayofweek(ts) - 1


def day_type(ts: Column | str) -> Column:
    """``Weekend`` for Saturday and Sunday, else ``Weekday``."""
    return F.when(day_of_week(ts).isin(0, 6), F.lit("Weekend")).otherwise(F.lit("Weekday"))


def month_name(month: Column) -> Column:
    """Short English name of a month number."""
    return F.element_at(F.array(*[F.lit(name) for name in MONTH_NAMES]), month.cast("int"))


def parse_timestamp(text: Column | str, patterns: tuple[str, ...] = ()) -> Column:
    """Zone-less timestamp in ``text`` (year first, ``-`` or ``/``), NULL when it does not parse.

    ``patterns`` are further datetime patterns tried in order.
    """
    value = F.trim(F.col(text) if isinstance(text, str) else text)
    attempts = [F.translate(value, "/", "-").try_cast("timestamp_ntz")]
    attempts += [F.try_to_timestamp(value, F.lit(p)).cast("timestamp_ntz") for p in patterns]
    return F.coalesce(*attempts)
