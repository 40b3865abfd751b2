"""Importance resampling of a corpus towards a target distribution of hashed n-grams.

Features are the words and pairs of neighbouring words of a text, hashed into buckets. A bucket's gain is the log
ratio of its smoothed shares in target and corpus; a document's weight is the mean gain of its features, and
documents are drawn without replacement by the largest weights after Gumbel noise.

Features are found for a batch at a time: texts are joined with a separator byte that no word contains, one regular
expression pass finds all words, a binary search of the document offsets tells whose each word is and masks pairs
that reach over a border, and ``bincount`` sums buckets and gains. The joined bytes are taken in stretches that end
between words, so a text of any length needs the memory of one stretch.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.llm.common import LOWER_BYTES, pieces, text_bytes, written

BUCKETS = 10_000
#: The separator is no word character and is never part of UTF-8 text beyond its own code point.
SEPARATOR = b"\x00"
STRETCH_BYTES = 1 << 20
#: Copies of one row are numbered in runs of this many.
COPIES_AT_ONCE = 1000
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")


def _crc_steps() -> np.ndarray:
    """The change of a CRC-32 by one more byte, for every low byte: the polynomial of zlib, eight bits at a time."""
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = np.where(steps & 1, np.uint32(0xEDB88320) ^ (steps >> np.uint32(1)), steps >> np.uint32(1))
    return steps


_CRC_STEPS = _crc_steps()


def _with_space(checks: np.ndarray) -> np.ndarray:
    """CRC-32 of every word with one space behind it."""
    state = ~checks
    return ~(_CRC_STEPS[(state ^ np.uint32(0x20)) & np.uint32(0xFF)] ^ (state >> np.uint32(8)))


def _stretches(joined: bytes) -> Iterator[tuple[int, int]]:
    """Bounds of pieces of about ``STRETCH_BYTES`` that end between words; one longer word stays whole."""
    begin = 0
    while begin < len(joined):
        end = min(begin + STRETCH_BYTES, len(joined))
        if end < len(joined):
            gap = _GAP.search(joined, end)
            end = gap.end() if gap else len(joined)
        yield begin, end
        begin = end


def joined_features(column: pa.Array, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Features of a column of texts, a stretch at a time: ``word_owner``, ``owner`` and ``bucket``.

    ``word_owner`` holds the row of every word, ``owner`` and ``bucket`` the row and bucket of every feature.
    """
    data, offsets = text_bytes(column)
    rows = len(offsets) - 1
    whole = data.tobytes()
    joined = SEPARATOR.join(whole[offsets[i] : offsets[i + 1]] for i in range(rows)).translate(LOWER_BYTES)
    del whole
    begins = offsets[:-1] + np.arange(rows)
    last_owner, last_check = -1, np.uint32(0)
    for begin, end in _stretches(joined):
        found = list(_WORD.finditer(joined, begin, end))
        if not found:
            continue
        words = [m.group() for m in found]
        starts = np.fromiter((m.start() for m in found), np.int64, len(found))
        checks = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        owners = np.searchsorted(begins, starts, "right") - 1
        # The word before each one; that of the first comes from the stretch before.
        before = np.concatenate([[last_check], checks[:-1]]).astype(np.uint32)
        same = owners == np.concatenate([[last_owner], owners[:-1]])
        spaced = _with_space(before).tolist()
        pairs = np.fromiter(map(zlib.crc32, words, spaced), np.uint32, len(words))[same]
        yield owners, np.concatenate([owners, owners[same]]), np.concatenate([checks, pairs]) % np.uint32(buckets)
        last_owner, last_check = owners[-1], checks[-1]


def feature_counts(texts: DataFrame, buckets: int = BUCKETS, text: str = "text") -> DataFrame:
    """``bucket, n``: features of all texts by bucket. Each task sums its own rows before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for piece in pieces(batch, text):
                for _, _, hashed in joined_features(piece.column(0), buckets):
                    total += np.bincount(hashed, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen])], ["bucket", "n"])

    partial = texts.select(text).mapInArrow(count, "bucket bigint, n bigint")
    return partial.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, gain`` of every bucket from the counts of corpus and target, empty ones included."""
    sides = raw.withColumnsRenamed({"n": "s"}).unionByName(
        target.withColumnsRenamed({"n": "t"}), allowMissingColumns=True
    )
    every = raw.sparkSession.range(0, buckets, 1, 1).select(F.col("id").alias("bucket"))
    totals = sides.unionByName(every, allowMissingColumns=True).groupBy("bucket").agg(
        F.coalesce(F.sum("s"), F.lit(0)).cast("double").alias("s"),
        F.coalesce(F.sum("t"), F.lit(0)).cast("double").alias("t"),
    )
    # As many rows as there are buckets, a parameter: one partition holds them.
    whole = Window.partitionBy()
    up = (F.col("t") + 1) * (F.sum("s").over(whole) + F.lit(float(buckets)))
    down = (F.col("s") + 1) * (F.sum("t").over(whole) + F.lit(float(buckets)))
    return totals.select("bucket", F.floor(F.lit(1000.0) * F.ln(up / down)).alias("gain"))


def with_weights(docs: DataFrame, gains: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``docs`` with ``n_words``, ``n_features`` and ``weight``, the floored mean gain of a document's features.

    The gains, one number a bucket, travel with the task; a document without features has weight 0.
    """
    table = np.zeros(buckets)
    for row in gains.collect():
        table[row.bucket] = row.gain
    names = ["n_words", "n_features", "weight"]
    base = docs.drop(*names)
    schema = T.StructType([*base.schema.fields, *[T.StructField(n, T.LongType()) for n in names]])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, "text")):
            rows = batch.num_rows
            words, features, total = (np.zeros(rows, np.int64) for _ in range(3))
            for word_owner, owner, hashed in joined_features(batch.column("text"), buckets):
                words += np.bincount(word_owner, minlength=rows)
                features += np.bincount(owner, minlength=rows)
                # Whole numbers far below 2 ** 53, exact as doubles.
                total += np.bincount(owner, table[hashed], rows).astype(np.int64)
            weight = np.where(features > 0, total // np.maximum(features, 1), 0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(x) for x in (words, features, weight)]], [*batch.schema.names, *names]
            )

    return base.mapInArrow(weigh, schema)


def noisy_score(seed: int) -> Column:
    """``weight`` plus Gumbel noise from a hash of seed and document id, in thousandths; a NULL id hashes as empty text."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    head = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    uniform = (head + F.lit(0.5)) / F.lit(4294967296.0)
    return F.col("weight") + F.floor(F.lit(-1000.0) * F.ln(-F.ln(uniform)))


def _ranked(scored: DataFrame, percent: int, row: list[str]) -> DataFrame:
    """The rows of ``scored`` that are open for the draw, with their ``rank`` among the drawn or NULL.

    Scores are whole thousandths: logarithms of counts below 1e18 and noise below 23,000 leave fewer than 150,000 of
    them, however many rows there are. Their running counts fit one task; inside a score rows are ranked by id.
    Equal rows are one row until their ranks are known.
    """
    equal = scored.where("_open").groupBy(*row).agg(F.count(F.lit(1)).alias("_copies"))
    levels = scored.where("_open").groupBy("score").agg(F.count(F.lit(1)).alias("_rows"))
    higher = Window.orderBy(F.col("score").desc())
    placed = levels.select(
        F.col("score").alias("_score"),
        (F.sum("_rows").over(higher) - F.col("_rows")).alias("_before"),
        F.floor(F.sum("_rows").over(Window.partitionBy()) * percent / 100).alias("_wanted"),
    )
    inside = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), *[c for c in row if c != "doc_id"])
    so_far = F.sum("_copies").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # Copies are numbered in runs, so that no row holds an array of all of them.
    runs = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_copies") - 1) / COPIES_AT_ONCE)))
    left = F.least(F.lit(COPIES_AT_ONCE).cast("bigint"), F.col("_copies") - F.col("_run") * COPIES_AT_ONCE)
    return (
        equal.join(placed, F.col("score") == F.col("_score"))
        .withColumn("_before", F.col("_before") + so_far - F.col("_copies"))
        .withColumn("_run", runs)
        .withColumn("_at", F.explode(F.sequence(F.lit(1).cast("bigint"), left)))
        .withColumn("_rank", F.col("_before") + F.col("_run") * COPIES_AT_ONCE + F.col("_at"))
        .select(*row, F.when(F.col("_rank") <= F.col("_wanted"), F.col("_rank")).alias("rank"))
    )


def resample(
    docs: DataFrame,
    target: DataFrame,
    *,
    buckets: int = BUCKETS,
    percent: int = 25,
    least_words: int = 20,
    seed: int = 7,
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs`` (``doc_id, text``), drawn towards ``target``.

    ``percent`` of the rows with at least ``least_words`` words are drawn, by highest score; ties go to the smaller
    id, a NULL id last. ``rank`` counts 1, 2, .. in that order and is NULL for all others. NULL and empty texts have
    no features and weight 0. Texts of any length count whole. Repeated rows are drawn one by one; equal ones get
    neighbouring ranks. An empty table gives no rows, an empty target gains from its smoothing alone. Other columns
    are ignored, whatever their names.
    """
    texts = docs.select("doc_id", "text")
    gains = bucket_gains(feature_counts(texts, buckets), feature_counts(target, buckets), buckets)
    row = ["doc_id", "n_features", "weight", "score"]
    scored = written(
        with_weights(texts, gains, buckets)
        .withColumns({"score": noisy_score(seed), "_open": F.col("n_words") >= least_words})
        .select(*row, "_open")
    )
    closed = scored.where(~F.col("_open")).select(*row, F.lit(None).cast("bigint").alias("rank"))
    return _ranked(scored, percent, row).unionByName(closed)
