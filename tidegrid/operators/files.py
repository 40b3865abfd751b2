"""File selection: dates in names, files not loaded yet, and the ledger of loaded files."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.calendar import at


def file_name(link: Column | str) -> Column:
    """Text after the last slash."""
    return F.element_at(F.split(link, "/"), -1)


def percent_decoded(text: Column) -> Column:
    """``text`` with ``%xx`` sequences replaced; unlike in a form, a plus sign stays one."""
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def file_date(link: Column) -> Column:
    """Midnight of the date in the first run of eight digits, read as YYYYMMDD, else as DDMMYYYY."""
    marked = F.concat(F.lit("#"), link)
    year_first = F.regexp_replace(marked, r"(?s)^.*?(\d{4})(\d{2})(\d{2}).*$", "$1-$2-$3")
    day_first = F.regexp_replace(marked, r"(?s)^.*?(\d{2})(\d{2})(\d{4}).*$", "$3-$2-$1")
    return F.coalesce(year_first.try_cast("date"), day_first.try_cast("date")).cast("timestamp_ntz")


def recent_files(links: DataFrame, as_of: datetime, days_back: int = 7, link: str = "link") -> DataFrame:
    """Links whose file date is not older than ``days_back`` days before ``as_of``; undated links drop out."""
    cutoff = at(as_of) - F.make_dt_interval(F.lit(days_back))
    return links.withColumn("file_date", file_date(F.col(link))).where(F.col("file_date") >= cutoff)


def unprocessed_files(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files whose name is not in the ledger.

    Neither side is forced to broadcast: both grow with the history, and adaptive execution picks the join
    by their measured size.
    """
    return files.join(ledger.select("filename"), "filename", "left_anti")


def ledger_merge(ledger: DataFrame, files: DataFrame) -> DataFrame:
    """The ledger with each new file name inserted once; names already present keep their entry."""
    return ledger.unionByName(ledger_additions(ledger, files))


def ledger_additions(ledger: DataFrame, files: DataFrame) -> DataFrame:
    """Ledger rows to append: one per new name, the earliest time when a name occurs more than once."""
    others = [c for c in ledger.columns if c not in ("filename", "processed_time")]
    # Without further columns a plain minimum aggregates by hash; a struct has to be sorted first.
    earliest = F.struct("processed_time", *others) if others else F.col("processed_time")
    first = files.groupBy("filename").agg(F.min(earliest).alias("entry"))
    entry = ["entry.*"] if others else [F.col("entry").alias("processed_time")]
    entries = first.select("filename", *entry)
    return entries.join(ledger.select("filename"), "filename", "left_anti").select(*ledger.columns)
