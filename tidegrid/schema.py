"""Canonical table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# Price table: one row per region and settlement interval, partitioned by year, month, REGIONID.
PRICES = T.StructType(
    [
        T.StructField("SETTLEMENTDATE", T.TimestampNTZType()),
        T.StructField("PERIODID", T.ShortType()),
        T.StructField("RRP", T.DoubleType()),
        T.StructField("LASTCHANGED", T.TimestampNTZType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
        T.StructField("REGIONID", T.StringType()),
    ]
)
# The columns of a price row in their order.
PRICE_COLUMNS = ["SETTLEMENTDATE", "REGIONID", "PERIODID", "RRP", "LASTCHANGED"]
PARTITION_COLUMNS = ["year", "month", "REGIONID"]

# Older flat layout without partition columns.
FLAT_PRICES = T.StructType(
    [
        T.StructField("settlementdate", T.TimestampNTZType()),
        T.StructField("regionid", T.StringType()),
        T.StructField("rrp", T.DoubleType()),
    ]
)

# Files without usable rows, as they were when a load gave up on them.
REJECTED_FILES = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("length", T.LongType()),
        T.StructField("modified", T.TimestampType()),
        T.StructField("load_id", T.StringType()),
    ]
)

# Rows without a usable price, as landed, with the reason.
REJECTED_ROWS = T.StructType(
    [
        *[T.StructField(name, T.StringType()) for name in PRICE_COLUMNS],
        T.StructField("reason", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("load_id", T.StringType()),
    ]
)

# Files already loaded; load_id is the partition the write of one batch owns.
LEDGER = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("processed_time", T.TimestampNTZType()),
        T.StructField("load_id", T.StringType()),
    ]
)

_PARTIALS = [
    T.StructField("min_price", T.DoubleType()),
    T.StructField("max_price", T.DoubleType()),
    T.StructField("sum_price", T.DecimalType(38, 5)),
    T.StructField("record_count", T.LongType()),
]

# Live parts of the price table with partial results, one row per part, month and region.
MANIFEST = T.StructType(
    [
        T.StructField("year", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
        T.StructField("part", T.StringType()),
        T.StructField("REGIONID", T.StringType()),
        *_PARTIALS,
    ]
)

SUMMARY = T.StructType(
    [
        T.StructField("REGIONID", T.StringType()),
        *_PARTIALS,
        T.StructField("avg_price", T.DoubleType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
    ]
)

# Layout of spark.read.format("binaryFile").
BINARY_FILE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)
