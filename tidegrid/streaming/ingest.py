"""Incremental ingest of landed files: every file once, every interval once, summary kept current."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import date, datetime
from itertools import batched

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidegrid.operators.clean import clean_prices, dedupe_prices, rejected_prices
from tidegrid.operators.files import file_name, ledger_additions, recent_files, unprocessed_files
from tidegrid.schema import BINARY_FILE, PRICES
from tidegrid.sinks.manifest import (
    Month,
    commit,
    create_manifest,
    live_parts,
    live_prices,
    parts_prices,
    read_manifest,
    remove_folder,
    remove_garbage,
    summary_of,
    write_part,
)
from tidegrid.sinks.tables import (
    create_ledger,
    create_rejected,
    read_ledger,
    read_rejected_files,
    write_ledger,
    write_rejected,
    write_summary,
)
from tidegrid.sources.history_csv import clean_history, read_history_csv, rejected_history
from tidegrid.sources.market_zip import decode_market_zips

# A month with this many parts is rewritten as one by the load that finds it.
MOST_PARTS = 8
_KEY = ["REGIONID", "SETTLEMENTDATE"]


@dataclass(frozen=True)
class Warehouse:
    """Folders of the tables below one root."""

    root: str

    @property
    def prices(self) -> str:
        return f"{self.root}/prices"

    @property
    def ledger(self) -> str:
        return f"{self.root}/ledger"

    @property
    def summary(self) -> str:
        return f"{self.root}/price_summary"

    @property
    def manifest(self) -> str:
        return f"{self.root}/manifest"

    @property
    def rejected(self) -> str:
        return f"{self.root}/rejected_files"

    @property
    def rejected_rows(self) -> str:
        return f"{self.root}/rejected_rows"

    def staging(self, load_id: str) -> str:
        return f"{self.root}/staging/{load_id}"

    def checkpoint(self, source: str) -> str:
        return f"{self.root}/checkpoints/{source}"


def create_tables(spark: SparkSession, warehouse: Warehouse) -> None:
    """Empty tables where there are none."""
    create_ledger(spark, warehouse.ledger)
    create_rejected(spark, warehouse.rejected, warehouse.rejected_rows)
    create_manifest(spark, warehouse.manifest)


def read_prices(spark: SparkSession, warehouse: Warehouse, **chosen: object) -> DataFrame:
    """The price table as of the newest commit; arguments as for ``load_prices``."""
    return live_prices(spark, warehouse.prices, warehouse.manifest, **chosen)


def _months(df: DataFrame) -> set[Month]:
    """The calendar months that occur, a short list whatever the table holds."""
    return {(r.year, r.month) for r in df.select("year", "month").distinct().collect()}


def upsert_prices(spark: SparkSession, prices: DataFrame, warehouse: Warehouse, load_id: str) -> set[Month]:
    """Add rows to the price table, one per region and stamp: the one changed last. Returns the months changed.

    Rows are first reduced to the latest of their own, then compared with the live rows of the months they touch,
    of which only keys and change stamps are read. New stamps are added as one more part of their month. Where a
    later change replaces a row, or a month has ``MOST_PARTS`` parts, the month is rewritten as one part. One commit
    switches everything. Rows that are live already change nothing, so a load may be repeated at any point.
    """
    attempt = f"{load_id}-{uuid.uuid4().hex[:8]}"
    staging = warehouse.staging(attempt)
    parts = live_parts(read_manifest(spark, warehouse.manifest))
    latest = dedupe_prices(prices.select(*PRICES.names))
    latest.write.parquet(f"{staging}/latest")
    fresh = spark.read.schema(PRICES).parquet(f"{staging}/latest")
    touched = _months(fresh)
    live = parts_prices(spark, warehouse.prices, parts, touched)
    known = live.select(*[F.col(c).alias(f"_{c}") for c in _KEY], F.col("LASTCHANGED").alias("_changed"), F.lit(1).alias("_live"))
    at_once = [F.col(c) == F.col(f"_{c}") for c in _KEY]
    later = F.col("LASTCHANGED") > F.col("_changed")
    never = F.col("_changed").isNull() & F.col("LASTCHANGED").isNotNull()
    winners = (
        fresh.join(known, at_once, "left")
        .where(F.col("_live").isNull() | later | never)
        .select(*PRICES.names, F.col("_live").isNotNull().alias("replaces"))
    )
    winners.write.parquet(f"{staging}/winners")
    won = spark.read.schema(winners.schema).parquet(f"{staging}/winners")
    changed = _months(won)
    if changed:
        full = {month for month in changed if len(parts.get(month, ())) + 1 > MOST_PARTS}
        rewritten = full | _months(won.where("replaces"))
        rows = won.select(*PRICES.names)
        if rewritten:
            # Live rows of the rewritten months that no winner replaces, each stamp being live once.
            gone = won.where("replaces").select(*[F.col(c).alias(f"_{c}") for c in _KEY])
            stays = parts_prices(spark, warehouse.prices, parts, rewritten).join(gone, at_once, "left_anti")
            rows = rows.unionByName(stays)
        added = write_part(rows, warehouse.prices, attempt)
        commit(spark, warehouse.manifest, added, rewritten)
    remove_folder(spark, staging)
    return changed


def compact_prices(spark: SparkSession, warehouse: Warehouse) -> set[Month]:
    """Rewrite every month of several parts as one, then delete what no newer version names. Returns those months."""
    parts = live_parts(read_manifest(spark, warehouse.manifest))
    several = {month for month, names in parts.items() if len(names) > 1}
    if several:
        rows = parts_prices(spark, warehouse.prices, parts, several)
        added = write_part(rows, warehouse.prices, f"compacted-{uuid.uuid4().hex[:8]}")
        commit(spark, warehouse.manifest, added, several)
    remove_garbage(spark, warehouse.prices, warehouse.manifest)
    return several


def refresh_summary(spark: SparkSession, warehouse: Warehouse) -> None:
    """Bring ``price_summary`` up to the newest commit from the partial results in the manifest; no price is read."""
    write_summary(summary_of(read_manifest(spark, warehouse.manifest)), warehouse.summary)


def _store(
    prices: DataFrame, rejected: DataFrame, files: DataFrame, warehouse: Warehouse, source: str, load_id: str
) -> None:
    """Prices, then summary, rejected rows and ledger: a file counts as loaded only once all of its rows are kept."""
    spark = prices.sparkSession
    upsert_prices(spark, prices, warehouse, load_id)
    if live_parts(read_manifest(spark, warehouse.manifest)):
        refresh_summary(spark, warehouse)
    write_rejected(rejected, warehouse.rejected_rows, load_id)
    entries = files.select(
        F.lit(source).alias("source"),
        "filename",
        F.current_timestamp().cast("timestamp_ntz").alias("processed_time"),
        F.lit(load_id).alias("load_id"),
    )
    earlier = _loaded(spark, warehouse, source, load_id)
    write_ledger(ledger_additions(earlier, entries), warehouse.ledger, load_id)


def _loaded(spark: SparkSession, warehouse: Warehouse, source: str, load_id: str) -> DataFrame:
    """Ledger entries of a source from other loads; a repeated load must not see its own."""
    ledger = read_ledger(spark, warehouse.ledger)
    return ledger.where((F.col("source") == source) & (F.col("load_id") != load_id))


def _new_files(files: DataFrame, loaded: DataFrame) -> DataFrame:
    """One path per file name that is not loaded yet."""
    named = files.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"))
    return unprocessed_files(named.groupBy("filename").agg(F.min("path").alias("path")), loaded)


def _literal_path(path: str) -> str:
    """``path`` with the characters escaped that would make it a pattern."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def _load_zips(spark: SparkSession, paths: list[str], warehouse: Warehouse, source: str, load_id: str) -> None:
    """Decode archives into the load's staging folder once and store their rows; the others become rejected files."""
    files = spark.read.format("binaryFile").load([_literal_path(path) for path in paths])
    decoded = decode_market_zips(files)
    staging = warehouse.staging(load_id)
    decoded.write.mode("overwrite").parquet(staging)
    raw = spark.read.schema(decoded.schema).parquet(staging)
    named = raw.select("filename").distinct()
    if not named.isEmpty():
        _store(clean_prices(raw), rejected_prices(raw), named, warehouse, source, load_id)
    unusable = _described(files).join(named, "filename", "left_anti").withColumn("source", F.lit(source))
    write_rejected(unusable.select("source", "filename", "length", "modified"), warehouse.rejected, load_id)
    remove_folder(spark, staging)


def _described(files: DataFrame) -> DataFrame:
    """Name, size and time of change of files; their contents are not read."""
    return files.select(
        "path", file_name("path").alias("filename"), "length", F.col("modificationTime").alias("modified")
    )


def _recent(files: DataFrame, days_back: int | None, as_of: datetime | None) -> DataFrame:
    """Files whose name carries a date of the last days; without ``days_back`` all of them."""
    if days_back is None:
        return files
    dated = files.withColumn("_name", file_name("path"))
    return recent_files(dated, as_of or datetime.now(), days_back, link="_name").drop("_name", "file_date")


def _rejected_paths(spark: SparkSession, files: DataFrame, warehouse: Warehouse, source: str) -> Iterator[str]:
    """Files that earlier loads could not use and that have changed since, in order of their names."""
    ledger = read_ledger(spark, warehouse.ledger).where(F.col("source") == source)
    failed = read_rejected_files(spark, warehouse.rejected).where(F.col("source") == source)
    changed = (
        _described(files)
        .join(failed.select("filename").distinct(), "filename", "left_semi")
        .join(failed.select("filename", "length", "modified"), ["filename", "length", "modified"], "left_anti")
    )
    return (r.path for r in _new_files(changed, ledger).orderBy("filename").toLocalIterator())


def _retry(spark: SparkSession, paths: Iterable[str], warehouse: Warehouse, source: str, at_once: int) -> None:
    """Load changed files again.

    The load is named after its files, so a retry repeated after a failure replaces its own output.
    """
    for some in batched(paths, at_once):
        digest = hashlib.sha256("\n".join(some).encode()).hexdigest()[:16]
        _load_zips(spark, list(some), warehouse, source, f"{source}-retry-{digest}-{uuid.uuid4().hex[:8]}")


def ingest_market_zips(
    spark: SparkSession,
    landing: str,
    warehouse: Warehouse,
    *,
    source: str = "current",
    max_files_per_batch: int = 1000,
    max_file_age: str | None = None,
    days_back: int | None = None,
    as_of: datetime | None = None,
) -> StreamingQuery:
    """Load the zip files of a landing folder that are not loaded yet, then stop.

    The stream's checkpoint remembers the files seen, the ledger the file names loaded. A micro-batch repeated after
    a failure finds its rows live and changes nothing. An interval that occurs in several archives is kept once, as
    changed last; rows without a usable price go to ``rejected_rows``.

    ``days_back`` opens only files whose name carries a date of that many days before ``as_of`` (now by default) or
    later. The date is read from the name, before any content. Files passed over for their date, or for having none,
    are seen once and not offered again: a date in the past does not come nearer. Files that gave no rows are listed
    in ``rejected_files`` with size and time of change, and tried again once either differs. Await the returned query
    before using the tables.
    """
    create_tables(spark, warehouse)
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(landing)
    again = _rejected_paths(spark, _recent(listed, days_back, as_of), warehouse, source)
    _retry(spark, again, warehouse, source, max_files_per_batch)
    stream = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE)
        .option("pathGlobFilter", "*.zip")
        .option("maxFilesPerTrigger", max_files_per_batch)
    )
    if max_file_age:
        stream = stream.option("maxFileAge", max_file_age)

    def load(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        load_id = f"{source}-{batch_id:09d}"
        # At most max_files_per_batch paths; the stream itself carries no file contents.
        chosen = [r.path for r in _new_files(batch, _loaded(session, warehouse, source, load_id)).collect()]
        if not chosen:
            return
        _load_zips(session, chosen, warehouse, source, load_id)

    return (
        _recent(stream.load(landing).select("path"), days_back, as_of)
        .writeStream.foreachBatch(load)
        .option("checkpointLocation", warehouse.checkpoint(source))
        .trigger(availableNow=True)
        .start()
    )


def backfill_history(
    spark: SparkSession,
    folder: str,
    warehouse: Warehouse,
    year: int,
    cutoff: date | str,
    load_id: str,
    *,
    source: str = "historic",
    files_at_once: int = 1000,
) -> None:
    """Load the historical CSV files of one year that are not loaded yet, ``files_at_once`` in one load.

    ``load_id`` names the run. Files of a finished load are not opened again, and repeating one changes nothing.
    """
    create_tables(spark, warehouse)
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{year}*.csv").load(folder)
    wanted = _new_files(files, read_ledger(spark, warehouse.ledger).where(F.col("source") == source))
    # Names come to the driver a load at a time; contents do not.
    paths = (r.path for r in wanted.orderBy("filename").toLocalIterator())
    for some in batched(paths, files_at_once):
        digest = hashlib.sha256("\n".join(some).encode()).hexdigest()[:16]
        raw = read_history_csv(spark, [_literal_path(path) for path in some], year)
        prices = clean_history(raw, year, cutoff)
        named = prices.select("filename").distinct()
        rejected = rejected_history(raw, year, cutoff)
        _store(prices.drop("filename"), rejected, named, warehouse, source, f"{load_id}-{digest}")
