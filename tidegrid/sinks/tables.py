"""Parquet tables: the partitioned price table, the file ledger and derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.schema import LEDGER, PARTITION_COLUMNS, REJECTED_FILES, REJECTED_ROWS, SUMMARY

# Longer files are closed and continued in a new one.
MAX_ROWS_PER_FILE = 5_000_000


def write_prices(
    prices: DataFrame, root: str, load_id: str | None = None, max_rows_per_file: int = MAX_ROWS_PER_FILE
) -> None:
    """Write prices under ``year=/month=/REGIONID=`` directories, sorted by time inside each file.

    ``REBALANCE`` brings the rows of a directory together, so a directory gets few files, and lets adaptive
    execution split a directory that holds a large share of the rows over several tasks. Without
    ``load_id`` files are appended. With it the write owns ``root/load_id=..`` and replaces that folder, so
    repeating a failed batch cannot double its rows; a root uses one of the two ways.
    """
    files = (
        prices.hint("rebalance", *PARTITION_COLUMNS)
        .sortWithinPartitions(*PARTITION_COLUMNS, "SETTLEMENTDATE")
        .write.partitionBy(*PARTITION_COLUMNS)
        .option("maxRecordsPerFile", max_rows_per_file)
    )
    if load_id is None:
        files.mode("append").parquet(root)
    else:
        files.mode("overwrite").parquet(f"{root}/load_id={load_id}")


def create_ledger(spark: SparkSession, root: str) -> None:
    """An empty ledger where there is none."""
    spark.createDataFrame([], LEDGER).write.mode("ignore").partitionBy("load_id").parquet(root)


def read_ledger(spark: SparkSession, root: str) -> DataFrame:
    """The ledger of loaded files; :func:`create_ledger` makes it."""
    return spark.read.schema(LEDGER).parquet(root).select(*LEDGER.names)


def write_ledger(additions: DataFrame, root: str, load_id: str) -> None:
    """Record the files of one load; repeating the load replaces its entries."""
    additions.drop("load_id").write.mode("overwrite").parquet(f"{root}/load_id={load_id}")


def create_rejected(spark: SparkSession, files: str, rows: str) -> None:
    """Empty tables of files and of rows without usable prices where there are none."""
    for schema, root in ((REJECTED_FILES, files), (REJECTED_ROWS, rows)):
        spark.createDataFrame([], schema).write.mode("ignore").partitionBy("load_id").parquet(root)


def read_rejected_files(spark: SparkSession, root: str) -> DataFrame:
    """Files that some load could not use; one that a later load used is in the ledger as well."""
    return spark.read.schema(REJECTED_FILES).parquet(root).select(*REJECTED_FILES.names)


def read_rejected_rows(spark: SparkSession, root: str) -> DataFrame:
    """Rows of loaded files that hold no usable price."""
    return spark.read.schema(REJECTED_ROWS).parquet(root).select(*REJECTED_ROWS.names)


def write_rejected(rejected: DataFrame, root: str, load_id: str) -> None:
    """Record the files or rows that one load could not use; repeating the load replaces its entries."""
    rejected.drop("load_id").write.mode("overwrite").parquet(f"{root}/load_id={load_id}")


def replace_table(df: DataFrame, path: str) -> None:
    """Write ``df`` in place of whatever the table holds."""
    df.write.mode("overwrite").parquet(path)


def write_summary(summary: DataFrame, root: str) -> None:
    """Replace the months of ``price_summary`` that occur in ``summary`` and leave the others.

    A summary without the exact sum is stored with NULL in its place.
    """
    if "sum_price" not in summary.columns:
        summary = summary.withColumn("sum_price", F.lit(None).cast(SUMMARY["sum_price"].dataType))
    (
        summary.select(*SUMMARY.names)
        .hint("rebalance", "year", "month")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("year", "month")
        .parquet(root)
    )


def read_summary(spark: SparkSession, root: str) -> DataFrame:
    """The stored ``price_summary``, with the exact sum beside the mean."""
    names = ["REGIONID", "year", "month", "min_price", "max_price", "sum_price", "avg_price", "record_count"]
    return spark.read.schema(SUMMARY).parquet(root).select(*names)
