"""Text helpers shared by the operators of this subpackage, and the shared folder they cut lineage in."""

from __future__ import annotations

import string
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase
#: Separators of words: the space and the control characters tab to carriage return.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
_SPACE_RUN = r"[\x20\x09-\x0D]+"
_ALNUM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Byte tables for Arrow-side code; every byte of a multi-byte UTF-8 character is above 0x7F and stays.
LOWER_BYTES = bytes.maketrans(_UPPER.encode(), _LOWER.encode())
ALNUM_BYTES = bytes(
    32 if b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else LOWER_BYTES[b]
    for b in range(256)
)


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Texts of ASCII alone take the faster built-in."""
    only_ascii = F.length(text) == F.octet_length(text)
    return F.when(only_ascii, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def _split(text: Column, gap: str, trimmed: str) -> Column:
    inner = F.btrim(text_or_empty(text), F.lit(trimmed))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, gap))


def space_words(text: Column) -> Column:
    """Array of words between white space; empty for NULL."""
    return _split(text, _SPACE_RUN, SPACES)


def alnum_words(text: Column) -> Column:
    """Array of lower-case words between ASCII characters other than letters and digits; empty for NULL."""
    gaps = "".join(chr(b) for b in range(128) if ALNUM_BYTES[b] == 32)
    return _split(ascii_lower(text_or_empty(text)), _ALNUM_GAP, gaps)


def count_space_words(text: Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below the one that ``spark.checkpoint.dir`` names, which all executors see.

    Where the setting is absent, one is made in the driver's temporary folder for a local master; a cluster must have it.
    """
    return f"{_root(spark)}/{uuid.uuid4().hex}"


_LOCAL_ROOTS: dict[str, str] = {}


def _root(spark: SparkSession) -> str:
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if context.applicationId not in _LOCAL_ROOTS:
            _LOCAL_ROOTS[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="tidegrid-")
        root = _LOCAL_ROOTS[context.applicationId]
    return root.rstrip("/")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back, for results read by several branches.

    The shuffle files of the write go when it ends, as nothing reads them again.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(folder)


def fenced(df: DataFrame, flag: str) -> DataFrame:
    """``df`` with ``flag`` tied to a row number, so that a filter on it is not pushed below the columns of ``df``.

    Pushed down, the filter would evaluate again, and inside every lambda, what the columns were computed from once.
    """
    numbered = df.withColumn("_fence", F.monotonically_increasing_id())
    return numbered.withColumn(flag, F.col(flag) & (F.col("_fence") >= 0)).drop("_fence")


def is_bucket(key: str, buckets: int, bucket: int) -> Column:
    """crc32 of the key as text, modulo ``buckets``, equals ``bucket``; a NULL key counts as empty text."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % buckets == bucket


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string array, one after the other, and the offsets of its rows; NULL is empty."""
    filled = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
    data = filled.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, text: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of an Arrow batch in runs of about ``most_bytes`` of text, so that work arrays stay small."""
    sizes = np.diff(text_bytes(batch.column(text))[1])
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


_CHUNK = 1 << 20
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_BYTE_VALUES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWER = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, count: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(count, base)]))


_POWERS = {"up": _powers(_POWER, 0), "down": _powers(_INVERSE, 0)}


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the white-space words of all rows, A-Z as a-z, and the offsets of rows in them.

    Works through the bytes in stretches that end between words, so memory beside the hashes stays small.
    """
    fold = np.frombuffer(LOWER_BYTES, np.uint8)
    hashes, starts_at = [], []
    breaks = np.zeros(len(data) + 1, bool)
    breaks[offsets] = True
    begin = 0
    while begin < len(data):
        end = min(begin + _CHUNK, len(data))
        while end < len(data):
            gaps = np.flatnonzero(_IS_SPACE[data[begin:end]] | breaks[begin:end])
            if len(gaps) and gaps[-1] > 0:
                end = begin + gaps[-1]
                break
            end = min(end + _CHUNK, len(data))
        part = fold[data[begin:end]]
        inside = ~_IS_SPACE[part]
        first = inside & np.concatenate([[True], ~inside[:-1] | breaks[begin + 1 : end]])
        last = inside & np.concatenate([~inside[1:] | breaks[begin + 1 : end], [True]])
        if len(_POWERS["up"]) <= len(part):
            size = 1 << len(part).bit_length()
            _POWERS["up"], _POWERS["down"] = _powers(_POWER, size), _powers(_INVERSE, size)
        reached = np.cumsum(_BYTE_VALUES[part] * _POWERS["up"][: len(part)] * inside)
        s, e = np.flatnonzero(first), np.flatnonzero(last)
        before = np.where(s > 0, reached[s - 1], np.uint64(0))
        hashes.append(mixed((reached[e] - before) * _POWERS["down"][s] + (e - s).astype(np.uint64)))
        starts_at.append(s + begin)
        begin = end
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts_at), offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = 5) -> Iterator[np.ndarray]:
    """For every row the sorted distinct hashes of its shingles of ``words`` words.

    A row with fewer words has its whole sequence as the one shingle, a row without words none.
    """
    hashes, bounds = word_hashes(data, offsets)
    factors = mixed(np.arange(1, words + 1, dtype=np.uint64) * _MIX[0]) | np.uint64(1)
    count = max(0, len(hashes) - words + 1)
    rolled = np.zeros(count, np.uint64)
    for k in range(words):
        rolled += hashes[k : k + count] * factors[k]
    rolled = mixed(rolled)
    for i in range(len(offsets) - 1):
        first, last = bounds[i], bounds[i + 1]
        if last - first >= words:
            yield np.unique(rolled[first : last - words + 1])
        elif last > first:
            own = hashes[first:last]
            yield mixed(np.array([(own * factors[: len(own)]).sum() + np.uint64(len(own))], np.uint64))
        else:
            yield np.empty(0, np.uint64)
