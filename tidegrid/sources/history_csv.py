"""Historical CSV files with a header row, columns in any order."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.calendar import parse_timestamp, period_id
from tidegrid.functions.numeric import read_number
from tidegrid.operators.clean import price_fault, with_partition_columns
from tidegrid.operators.files import percent_decoded
from tidegrid.operators.selection import within_backfill
from tidegrid.schema import PRICE_COLUMNS

# Headings a historical file must have.
REQUIRED = ("REGION", "SETTLEMENTDATE", "RRP")

# Stands for a separating comma while a line is cut; no line holds a line end.
_CUT = "\n"


def _cells(line: str) -> Column:
    """Fields of a CSV line of any width, without the quotes around them; empty ones are NULL.

    A line is split at its quotes. Commas of every second piece, the first included, stand outside quotes and
    separate fields; each step reads the line once.
    """
    outside = F.transform(
        F.split(line, '"', -1), lambda piece, i: F.when(i % 2 == 0, F.translate(piece, ",", _CUT)).otherwise(piece)
    )
    marked = F.split(F.array_join(outside, '"'), _CUT, -1)
    bare = F.when(F.col(line).contains('"'), marked).otherwise(F.split(line, ",", -1))

    def field(text: Column) -> Column:
        inner = F.when(text.endswith('"'), F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(F.lit(""))
        unquoted = F.replace(inner, F.lit('""'), F.lit('"'))
        return F.nullif(F.when(text.startswith('"'), unquoted).otherwise(text), F.lit(""))

    return F.transform(bare, field)


def read_history_csv(spark: SparkSession, paths: str | Sequence[str], year: int) -> DataFrame:
    """Text rows ``filename, REGION, SETTLEMENTDATE, RRP`` of the CSV files with ``year`` in their name.

    ``paths`` is a folder or a list of files.

    Columns are found by the heading of each file, so files may order them differently and have any number of
    them; a file that lacks a required heading contributes nothing. One scan reads the values, a second one only
    finds the headings, which a file holds in its first block.
    """
    lines = spark.read.option("pathGlobFilter", f"*{year}*.csv").text(paths if isinstance(paths, str) else list(paths))
    cells = lines.select(
        F.col("_metadata.file_path").alias("path"),
        percent_decoded(F.col("_metadata.file_name")).alias("filename"),
        F.col("_metadata.file_block_start").alias("block"),
        _cells("value").alias("cells"),
    )
    found = F.struct(*[F.array_position("cells", F.lit(name)).alias(name) for name in REQUIRED])
    headings = (
        cells.where(F.col("block") == 0)
        .where(" AND ".join(f"array_contains(cells, '{name}')" for name in REQUIRED))
        .select("path", found.alias("at"))
        .groupBy("path")
        .agg(F.min("at").alias("at"))
    )
    values = [F.get("cells", (F.col(f"at.{name}") - 1).cast("int")).alias(name) for name in REQUIRED]
    return cells.join(headings, "path").select("filename", *values).where(F.col("REGION") != REQUIRED[0])


def _judged(raw: DataFrame, year: int, cutoff: date | str) -> DataFrame:
    """Typed rows of one year before a cutoff day and rows without a date, with the first ``reason`` against them."""
    read = raw.select(
        *[F.col(c).alias(f"raw_{c}") for c in REQUIRED],
        parse_timestamp("SETTLEMENTDATE").alias("SETTLEMENTDATE"),
        F.col("REGION").alias("REGIONID"),
        read_number("RRP").alias("RRP"),
        F.monotonically_increasing_id().alias("_row"),
        *[c for c in raw.columns if c == "filename"],
    )
    reason = (
        F.when(F.col("_row") < 0, "no row")
        .when(F.col("SETTLEMENTDATE").isNull(), "bad date")
        .when(F.col("REGIONID").isNull(), "no region")
        .otherwise(price_fault(F.col("RRP")))
    )
    wanted = F.col("SETTLEMENTDATE").isNull() | within_backfill(F.col("SETTLEMENTDATE"), year, cutoff)
    return read.withColumn("reason", reason).where(wanted)


def clean_history(raw: DataFrame, year: int, cutoff: date | str) -> DataFrame:
    """Typed price rows of one year before a cutoff day, with the period derived from the stamp.

    Rows without a date, a region or a price are left out alone; :func:`rejected_history` lists them.
    """
    kept = _judged(raw, year, cutoff).where(F.col("reason").isNull())
    filled = kept.withColumns({"PERIODID": period_id("SETTLEMENTDATE"), "LASTCHANGED": F.col("SETTLEMENTDATE")})
    extra = [c for c in raw.columns if c == "filename"]
    return with_partition_columns(filled).select(*PRICE_COLUMNS, "year", "month", *extra)


def rejected_history(raw: DataFrame, year: int, cutoff: date | str) -> DataFrame:
    """The rows :func:`clean_history` leaves out for their content, in the columns of rejected market rows."""
    text = F.lit(None).cast("string")
    return (
        _judged(raw, year, cutoff)
        .where(F.col("reason").isNotNull())
        .select(
            F.col("raw_SETTLEMENTDATE").alias("SETTLEMENTDATE"),
            F.col("raw_REGION").alias("REGIONID"),
            text.alias("PERIODID"),
            F.col("raw_RRP").alias("RRP"),
            text.alias("LASTCHANGED"),
            "reason",
            *[c for c in raw.columns if c == "filename"],
        )
    )
