"""Readers of stored price tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.calendar import at, parse_timestamp
from tidegrid.operators.clean import drop_bad_numbers
from tidegrid.operators.files import percent_decoded
from tidegrid.schema import FLAT_PRICES, PARTITION_COLUMNS, PRICES


def load_prices(
    spark: SparkSession,
    root: str | Sequence[str],
    *,
    base: str | None = None,
    years: Sequence[int] | None = None,
    months: Sequence[int] | None = None,
    regions: Sequence[str] | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
) -> DataFrame:
    """The partitioned price table, or the part of it that the arguments name.

    ``root`` may be a list of folders below ``base``, from which partition values are read.
    ``years``, ``months`` and ``regions`` prune partitions. ``start`` and ``end`` (stamps, both included)
    filter rows and prune the months outside the range.
    """
    reader = spark.read.schema(PRICES)
    if base is not None:
        reader = reader.option("basePath", base)
    prices = reader.parquet(*([root] if isinstance(root, str) else root)).select(*PRICES.names)
    for column, values in (("year", years), ("month", months), ("REGIONID", regions)):
        if values is not None:
            prices = prices.where(F.col(column).isin(*values))
    month_number = F.col("year") * 12 + F.col("month")
    if start is not None:
        prices = prices.where(F.col("SETTLEMENTDATE") >= at(start))
        prices = prices.where(month_number >= start.year * 12 + start.month)
    if end is not None:
        prices = prices.where(F.col("SETTLEMENTDATE") <= at(end))
        prices = prices.where(month_number <= end.year * 12 + end.month)
    return drop_bad_numbers(prices)


def load_flat_prices(spark: SparkSession, pattern: str) -> DataFrame:
    """Price files matched by a path pattern, without partition columns."""
    return spark.read.schema(FLAT_PRICES).option("recursiveFileLookup", "true").parquet(pattern)


_FOREIGN = "SETTLEMENTDATE timestamp_ntz, PERIODID smallint, RRP double, changed string, path string"
_FOREIGN_ARROW = pa.schema(
    [
        ("SETTLEMENTDATE", pa.timestamp("us")),
        ("PERIODID", pa.int16()),
        ("RRP", pa.float64()),
        ("changed", pa.string()),
        ("path", pa.string()),
    ]
)


def _foreign_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole Parquet files, read row group by row group, with types brought to one form."""
    import pyarrow.parquet as pq

    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            source = pq.ParquetFile(pa.BufferReader(content.as_buffer()))
            names = ["SETTLEMENTDATE", "PERIODID", "RRP", "LASTCHANGED"]
            for part in source.iter_batches(columns=names):
                stamp = part.column("SETTLEMENTDATE").cast(pa.timestamp("us"), safe=False)
                changed = part.column("LASTCHANGED")
                if pa.types.is_timestamp(changed.type):
                    changed = changed.cast(pa.timestamp("us"), safe=False)
                columns = [
                    stamp,
                    part.column("PERIODID").cast(pa.int16()),
                    part.column("RRP").cast(pa.float64()),
                    changed.cast(pa.string()),
                    pa.array([path] * part.num_rows, pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=_FOREIGN_ARROW)


def read_foreign_prices(spark: SparkSession, root: str) -> DataFrame:
    """A price table written by other tools, brought to the canonical schema.

    Covers what Spark's Parquet reader rejects: nanosecond stamps, and ``LASTCHANGED`` stored as text in
    some files and as a stamp in others. Each file is one unit of work; partition values come from its path.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
    files = files.option("recursiveFileLookup", "true").load(root).select("path", "content")
    rows = files.mapInArrow(_foreign_rows, _FOREIGN)
    folder = {c: percent_decoded(F.regexp_extract("path", rf"/{c}=([^/]+)/", 1)) for c in PARTITION_COLUMNS}
    canonical = rows.select(
        "SETTLEMENTDATE",
        "PERIODID",
        "RRP",
        parse_timestamp("changed").alias("LASTCHANGED"),
        folder["year"].cast("int").alias("year"),
        folder["month"].cast("int").alias("month"),
        folder["REGIONID"].alias("REGIONID"),
    )
    return drop_bad_numbers(canonical)
