"""Quality rules: text statistics and a hashed n-gram log-likelihood ratio.

Two multinomials over ``BUCKETS`` hashed word unigrams and bigrams are counted, one over a trusted target and one
over the raw corpus. A document's score is the mean log ratio of its n-grams, summed in whole 1e-6 units so that
the result never depends on the order of rows. The model has a fixed size and reaches the scoring pass as one
scalar array; scoring a document needs no shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import SPACES, fenced, space_words, text_or_empty, written

BUCKETS = 1 << 13
#: Buckets of a model whose threshold is learned.
MODEL_BUCKETS = 1 << 16
#: Share of the trusted documents that a learned threshold may reject.
REJECTED_SHARE = 0.005
UNITS = 1_000_000
#: Counts added to every bucket of either multinomial.
SMOOTHING = 1.0
#: A document is kept from this mean log ratio (natural logarithm) on.
THRESHOLD = -0.055
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def _from(items: Column, start: int, count: Column) -> Column:
    return F.slice(items, F.lit(start), F.greatest(count, F.lit(0)))


def _hashed(words: DataFrame) -> DataFrame:
    """Add the hashes of single words, word pairs and 3-word windows of ``_q_words``: ``_q_h1``, ``_q_h2``, ``_q_h3``."""
    n = F.size("_q_words")
    one, two = F.col("_q_h1"), F.col("_q_h2")
    return (
        words.withColumn("_q_h1", F.transform("_q_words", lambda w: F.xxhash64(w)))
        .withColumn("_q_h2", F.zip_with(_from(one, 1, n - 1), _from(one, 2, n - 1), lambda a, b: F.xxhash64(a, b)))
        .withColumn("_q_h3", F.zip_with(_from(two, 1, n - 2), _from(one, 3, n - 2), lambda a, b: F.xxhash64(a, b)))
    )


def _bucket(hashed: Column, buckets: int) -> Column:
    return F.pmod(hashed, F.lit(buckets)).cast("int")


def _positions(last: Column) -> Column:
    """0 .. ``last``, empty when ``last`` is negative."""
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _target(docs: DataFrame, labels: DataFrame, how: str) -> DataFrame:
    """``text, _good`` of ``docs``; ``_good`` where ``labels`` calls a document good and not toxic."""
    trusted = (
        labels.where(F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").alias("_labelled"))
        .agg(((F.min("quality") == 1) & (F.coalesce(F.max("toxic"), F.lit(0)) == 0)).alias("_good"))
        .where("_good")
    )
    # Always a shuffle: labels grow with the documents, so a broadcast would hold for small tables only.
    joined = docs.select("doc_id", "text").join(trusted.hint("merge"), F.col("doc_id") == F.col("_labelled"), how)
    return joined.select("text", "_good")


def _counts(docs: DataFrame, labels: DataFrame, buckets: int) -> DataFrame:
    """``bucket, raw, good``: n-grams of all documents and of the target, a row for every bucket."""
    words = _target(docs, labels, "left").select(
        space_words(F.col("text")).alias("_q_words"), F.col("_good").isNotNull().cast("bigint").alias("good")
    )
    grams = _hashed(words).select(F.explode(F.concat("_q_h1", "_q_h2")).alias("gram"), "good")
    counted = grams.groupBy(_bucket(F.col("gram"), buckets).alias("bucket")).agg(
        F.count(F.lit(1)).alias("raw"), F.sum("good").alias("good")
    )
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    return every.join(counted, "bucket", "left").select(
        "bucket", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("raw", "good")]
    )


def _in_one_row(full: DataFrame) -> DataFrame:
    return full.agg(
        F.sort_array(F.collect_list(F.struct("bucket", "raw", "good"))).alias("counts"),
        F.sum("raw").alias("raw"),
        F.sum("good").alias("good"),
    )


def _ratios(full: DataFrame, buckets: int, smoothing: float) -> DataFrame:
    def ratio(x: Column) -> Column:
        trusted_log = F.log((x["good"] + smoothing) / (F.col("good") + smoothing * buckets))
        raw_log = F.log((x["raw"] + smoothing) / (F.col("raw") + smoothing * buckets))
        return F.rint((trusted_log - raw_log) * UNITS).cast("bigint")

    neutral = F.transform("counts", lambda x: F.lit(0).cast("bigint"))
    ratios = F.when(F.col("good") > 0, F.transform("counts", ratio)).otherwise(neutral)
    return _in_one_row(full).select(ratios.alias("ratios"))


def log_ratios(
    docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING
) -> DataFrame:
    """One row with the array ``ratios``: of every bucket, in 1e-6 units, from counts over all documents.

    The target are documents that ``labels`` (``doc_id, quality, toxic``) calls good and not toxic. Of several labels
    the worst counts. Without any target n-gram all ratios are 0.
    """
    return _ratios(_counts(docs, labels, buckets), buckets, smoothing)


def held_out_scores(
    docs: DataFrame, labels: DataFrame, full: DataFrame, buckets: int, smoothing: float, min_words: int
) -> DataFrame:
    """``score`` of every target document of at least ``min_words`` words, its own n-grams taken out of the target.

    So it is scored as one without a label is, however small the target.
    """
    one = _in_one_row(full)
    raw_log = F.transform("counts", lambda x: F.struct(
        x["good"].alias("good"), F.log((x["raw"] + smoothing) / (F.col("raw") + smoothing * buckets)).alias("raw_log")
    ))
    table, all_good = one.select(raw_log.alias("t")).scalar(), full.agg(F.sum("good").alias("g")).scalar()
    s, starts = F.col("_q_sorted"), F.col("_q_starts")
    words = _target(docs, labels, "inner").select(space_words(F.col("text")).alias("_q_words"))
    grams = _hashed(words).select(
        F.size("_q_words").alias("n_words"),
        F.sort_array(F.transform(F.concat("_q_h1", "_q_h2"), lambda h: _bucket(h, buckets))).alias("_q_sorted"),
    )
    first = F.filter(_positions(F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    runs = F.transform(starts, lambda i, j: F.struct(
        F.get(s, i).alias("bucket"), (F.coalesce(F.get(starts, j + 1), F.size(s)) - i).cast("bigint").alias("n")
    ))

    def gain(total: Column, r: Column) -> Column:
        x = F.get(F.col("_q_table"), r["bucket"])
        return total + r["n"] * F.rint((F.log(x["good"] - r["n"] + smoothing) - x["raw_log"]) * UNITS).cast("bigint")

    summed = (
        grams.withColumn("_q_starts", first)
        .withColumn("_q_runs", runs)
        .withColumn("_q_table", table)
        .withColumn("_q_gain", F.aggregate("_q_runs", F.lit(0).cast("bigint"), gain))
    )
    n = F.size(s)
    score = F.col("_q_gain") / n / UNITS - F.log(all_good - n + smoothing * buckets)
    return summed.select(F.when(F.col("n_words") >= min_words, score).alias("score"))


def learned_threshold(scores: DataFrame) -> float:
    """The score, in whole 1e-3, that ``REJECTED_SHARE`` of ``scores`` lie below; ``THRESHOLD`` without any.

    Scores are counted by whole 1e-3 first, so the percentile reads a bounded number of rows. It skips NULL itself: a
    filter would be pushed below the scores and evaluate their arrays again.
    """
    cells = scores.groupBy(F.floor(F.col("score") * 1000).alias("cell")).agg(
        F.count(F.lit(1)).alias("n")
    )
    found = written(cells).agg(F.percentile("cell", F.lit(REJECTED_SHARE), F.col("n")).alias("cell")).first()
    return THRESHOLD if found["cell"] is None else math.floor(found["cell"]) / 1000


def text_statistics(text: Column, words: Column) -> dict[str, Column]:
    """Columns ``n_words, word_chars, n_symbols, n_dup_lines``."""
    lines = F.filter(F.split(text_or_empty(text), "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return {
        "n_words": F.size(words).cast("bigint"),
        "word_chars": F.length(F.concat_ws("", words)).cast("bigint"),
        "n_symbols": F.regexp_count(text_or_empty(text), F.lit(r"[#*$%&|<>]")).cast("bigint"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
    }


def _position_mask(words: Column) -> Column:
    """Low bits that hold any position in ``words``, so texts may have any length."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.length(F.bin(F.size(words)))) - 1


def _window_keys(windows: Column, mask: Column) -> Column:
    """Sorted numbers, one per window hash: its high bits, and its position in the low ones.

    Texts without an equal pair of hashes, found by the cheaper distinct count, get none.
    """
    packed = F.transform(windows, lambda h, i: h.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("bigint")))
    some = F.size(F.array_distinct(windows)) < F.size(windows)
    return F.when(some, F.sort_array(packed)).otherwise(F.array().cast("array<bigint>"))


def _repeated_starts(words: Column, keys: Column, mask: Column) -> Column:
    """Sorted positions of the windows that another position repeats.

    Neighbours with equal hash bits are compared word by word.
    """

    def same(a: Column, b: Column) -> Column:
        x, y = a.bitwiseAND(mask).cast("int"), b.bitwiseAND(mask).cast("int")
        equal = a.bitwiseXOR(b).bitwiseAND(F.bitwise_not(mask)) == 0
        for k in range(3):
            equal = equal & (F.get(words, x + k) == F.get(words, y + k))
        return F.coalesce(equal, F.lit(False))

    flagged = F.filter(keys, lambda k, i: same(k, F.get(keys, i - 1)) | same(k, F.get(keys, i + 1)))
    return F.sort_array(F.transform(flagged, lambda k: k.bitwiseAND(mask).cast("int")))


def _covered(starts: Column) -> Column:
    """Words inside the 3-word windows that begin at the sorted ``starts``."""

    def step(i: Column) -> Column:
        return F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - F.get(starts, i), F.lit(3))).cast("bigint")

    return F.aggregate(_positions(F.size(starts) - 1), F.lit(0).cast("bigint"), lambda a, i: a + step(i))


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    buckets: int = BUCKETS,
    smoothing: float = SMOOTHING,
    threshold: float | None = THRESHOLD,
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
) -> DataFrame:
    """``docs`` with text statistics, ``score`` (mean log ratio per n-gram), ``base_failed`` and ``kept``.

    NULL and empty texts have no words, score 0 and fail the base rules. Texts of one word have one unigram, very long ones count whole. Rows
    without a label are part of the raw corpus only. Repeated rows are judged alike, an empty table gives no rows,
    and columns named like an added one are replaced. ``threshold=None`` learns it from the scores of all target
    documents, each scored without its own n-grams, so that it fits the model whatever the size of the tables.
    """
    if threshold is None:
        full = written(_counts(docs, labels, buckets))
        table = _ratios(full, buckets, smoothing).scalar()
        threshold = learned_threshold(held_out_scores(docs, labels, full, buckets, smoothing, min_words))
    else:
        table = log_ratios(docs, labels, buckets, smoothing).scalar()
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed", "kept"]
    base = docs.drop(*[c for c in docs.columns if c in added or c.startswith("_q_")])
    w, mask = F.col("_q_words"), F.col("_q_mask")
    split = base.withColumn("_q_words", space_words(F.col("text"))).withColumn("_q_mask", _position_mask(w))
    # The table is named once below, so the optimizer puts the scalar there and no row carries a copy.
    gain = F.aggregate(
        F.concat("_q_h1", "_q_h2"),
        F.lit(0).cast("bigint"),
        lambda a, h: a + F.get(F.col("_q_table"), _bucket(h, buckets)),
    )
    measured = (
        _hashed(split)
        .withColumns({**text_statistics(F.col("text"), w), "_q_keys": _window_keys(F.col("_q_h3"), mask)})
        .withColumn("_q_starts", _repeated_starts(w, F.col("_q_keys"), mask))
    )
    grams = F.nullif(2 * F.col("n_words") - 1, F.lit(-1))
    failed = (F.col("n_words") < min_words) | (
        100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")
    )
    judged = (
        measured.withColumn("n_repeat_words", _covered(F.col("_q_starts")))
        .withColumn("_q_table", table)
        .withColumn("_q_gain", gain)
        .withColumns({"score": F.coalesce(F.col("_q_gain") / grams / UNITS, F.lit(0.0)), "base_failed": failed})
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
        .select(*base.columns, *added)
    )
    return fenced(judged, "kept")
