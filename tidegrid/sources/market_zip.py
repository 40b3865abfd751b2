"""Market files: zip archives of multi-record CSV members."""

from __future__ import annotations

import csv
import io
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.schema import BINARY_FILE

# Record type of price rows, the fewest fields of a usable one, and field positions.
RECORD_TYPE = ["TRADING", "PRICE"]
MIN_FIELDS = 12
FIELD_POSITIONS = {"SETTLEMENTDATE": 4, "REGIONID": 6, "PERIODID": 7, "RRP": 8, "LASTCHANGED": 11}

_LINES = "path string, member string, line_no bigint, fields array<string>"
_LINES_ARROW = pa.schema(
    [("path", pa.string()), ("member", pa.string()), ("line_no", pa.int64()), ("fields", pa.list_(pa.string()))]
)
_BATCH_LINES = 10_000


def _member_lines(archive: zipfile.ZipFile, member: str) -> Iterator[str]:
    with archive.open(member) as raw:
        for line in io.TextIOWrapper(raw, encoding="utf-8"):
            yield from line.splitlines()


def _data_records(archive: zipfile.ZipFile) -> Iterator[tuple[str, int, list[str]]]:
    """Price data records that come after a price header record of their member."""
    for member in archive.namelist():
        if not member.lower().endswith(".csv"):
            continue
        headed = False
        for line_no, fields in enumerate(csv.reader(_member_lines(archive, member)), start=1):
            if fields[1:3] != RECORD_TYPE:
                continue
            if fields[0] == "I":
                headed = True
            elif fields[0] == "D" and headed:
                yield member, line_no, fields


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of every readable archive; an unreadable one yields nothing.

    An archive is decoded twice, first only to see that it reads to its end, so that no part of a bad file
    gets through and no file is held in memory uncompressed.
    """
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            data = content.as_py()
            try:
                with zipfile.ZipFile(io.BytesIO(data)) as archive:
                    for _ in _data_records(archive):
                        pass
            except (zipfile.BadZipFile, zipfile.LargeZipFile, UnicodeDecodeError, csv.Error, OSError,
                    EOFError, NotImplementedError, RuntimeError, ValueError, zlib.error):
                continue
            with zipfile.ZipFile(io.BytesIO(data)) as archive:
                rows = []
                for member, line_no, fields in _data_records(archive):
                    rows.append((path, member, line_no, fields))
                    if len(rows) == _BATCH_LINES:
                        yield _to_batch(rows)
                        rows = []
                if rows:
                    yield _to_batch(rows)


def _to_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(column, field.type) for column, field in zip(zip(*rows), _LINES_ARROW, strict=True)],
        schema=_LINES_ARROW,
    )


def decode_market_zips(files: DataFrame) -> DataFrame:
    """Raw price rows (all text) of ``binaryFile`` rows, with the file and line they come from."""
    records = files.select("path", "content").mapInArrow(_decode, _LINES)
    return records.where(F.size("fields") >= MIN_FIELDS).select(
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        "member",
        "line_no",
        *[F.col("fields")[position].alias(name) for name, position in FIELD_POSITIONS.items()],
    )


def read_market_zips(spark: SparkSession, folder: str) -> DataFrame:
    """Raw price rows of all ``.zip`` files of a folder."""
    return decode_market_zips(
        spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(folder).select(*BINARY_FILE.names)
    )
