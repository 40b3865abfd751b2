"""Benchmark decontamination with a positional inverted index of the training tokens.

Every benchmark window is looked up through its rarest terms: their posting lists ``(document, position)``, adjusted
by the term's offset in the item, are diagonals (document position minus item position); only diagonals on which two
rare terms meet are candidates. Along them the item is compared with the document word by word, which gives exact
phrase matches, or with ``slack`` proximity matches in which that many words of a window may differ.

Only postings of the anchor terms leave the scan. Vocabulary and anchors are written tables, so Catalyst knows their
size and broadcasts them when they are below its threshold; beyond it the same joins shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import alnum_words, fenced, text_or_empty, written

WINDOW = 13


def _positions(first: Column, last: Column) -> Column:
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def _items(bench: DataFrame, window: int) -> DataFrame:
    """Distinct benchmark items that have words: ``item, item_id, item_words, need`` (words a match must have)."""
    words = alnum_words(F.col("text"))
    return (
        bench.select("item_id", words.alias("item_words"))
        .where(F.size("item_words") > 0)
        .distinct()
        .select(
            F.xxhash64(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.concat_ws(" ", "item_words")).alias("item"),
            "item_id",
            "item_words",
            F.least(F.size("item_words"), F.lit(window)).alias("need"),
        )
    )


def _tokens(docs: DataFrame) -> DataFrame:
    """Training postings: ``doc_id, text_key, position, term``."""
    words = docs.select("doc_id", "text_key", alnum_words(F.col("text")).alias("words"))
    return words.select("doc_id", "text_key", F.posexplode("words").alias("position", "term"))


def _anchors(items: DataFrame, docs: DataFrame, window: int, slack: int) -> DataFrame:
    """Rarest terms of every window that can occur: ``term, item, at, need``."""
    placed = items.select("item", "need", F.size("item_words").alias("words"), F.posexplode("item_words").alias("at", "term"))
    terms = written(placed.select("term").distinct())
    frequency = _tokens(docs).select("term").join(terms, "term", "left_semi").groupBy("term").agg(
        F.count(F.lit(1)).alias("frequency")
    )
    ranked = placed.join(frequency, "term", "left").withColumn(
        "rank", F.struct(F.coalesce("frequency", F.lit(0)).alias("frequency"), F.col("at").alias("at"))
    )
    # A short item is a single window: the frame that starts at its first word ends with the item.
    frame = Window.partitionBy("item").orderBy("at")
    full = F.sort_array(F.collect_list("rank").over(frame.rowsBetween(0, window - 1)))
    windows = ranked.withColumn("ranks", full).where(F.col("at") <= F.col("words") - F.col("need"))
    unseen = F.size(F.filter("ranks", lambda r: r["frequency"] == 0))
    chosen = windows.where(unseen <= slack).select("item", F.explode(F.slice("ranks", 1, slack + 2)).alias("rank"))
    anchors = chosen.where(F.col("rank.frequency") > 0).select("item", F.col("rank.at").alias("at")).distinct()
    return anchors.join(placed, ["item", "at"]).select("term", "item", "at", "need")


def _intervals(words: Column, hit: Column, slack: int) -> Column:
    """Stretches ``(first, end)`` of document words that match along one diagonal."""
    first = F.greatest(F.lit(0), -hit["diagonal"])
    last = F.least(F.size(hit["item_words"]), F.size(words) - hit["diagonal"]) - 1
    differ = F.filter(
        _positions(first, last),
        lambda i: F.get(hit["item_words"], i) != F.get(words, i + hit["diagonal"]),
    )
    # Between a difference and the one slack + 1 further on, at most slack words differ.
    edges = F.concat(F.array(first - 1), differ, F.array(last + 1))
    ends = F.transform(
        _positions(F.lit(0), F.greatest(F.size(edges) - 2, F.lit(0))),
        lambda j: F.struct(
            (F.get(edges, j) + 1 + hit["diagonal"]).alias("first"),
            (F.get(edges, F.least(j + slack + 1, F.size(edges) - 1)) + hit["diagonal"]).alias("end"),
        ),
    )
    return F.filter(ends, lambda s: s["end"] - s["first"] >= hit["need"])


def phrase_matches(docs: DataFrame, bench: DataFrame, window: int = WINDOW, slack: int = 0) -> DataFrame:
    """One row per document: ``doc_id, text_key, n_words, matches`` (array of ``item_id, first, end``).

    A match is a stretch of document words in which every ``window`` words stand in an item in the same order (all
    its words, if it has fewer); with ``slack`` up to that many words of each window may differ. ``end`` is exclusive.
    ``docs`` needs ``doc_id`` and ``text``.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64(text_or_empty(F.col("text"))).alias("text_key"))
    items = written(_items(bench, window))
    anchors = written(_anchors(items, keyed, window, slack))
    at_diagonal = (
        _tokens(keyed)
        .join(anchors, "term")
        .groupBy("doc_id", "text_key", "item", (F.col("position") - F.col("at")).alias("diagonal"))
        .agg(F.min("at").alias("low"), F.max("at").alias("high"), F.min("need").alias("need"))
    )
    met = at_diagonal.where((F.col("low") < F.col("high")) | (F.col("need") == 1))
    hits = (
        met.select("doc_id", "text_key", "item", "diagonal")
        .join(items, "item")
        .groupBy(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key"))
        .agg(F.collect_list(F.struct("item_id", "item_words", "need", "diagonal")).alias("hits"))
    )
    # Hits grow with the documents: always a shuffle, so the plan is the same at every size.
    found = keyed.join(
        hits.hint("merge"), F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key")), "left"
    ).select("doc_id", "text_key", alnum_words(F.col("text")).alias("words"), "hits")
    none = F.array().cast(found.schema["hits"].dataType)

    def named(hit: Column) -> Column:
        return F.transform(
            _intervals(F.col("words"), hit, slack),
            lambda s: F.struct(hit["item_id"].alias("item_id"), s["first"].alias("first"), s["end"].alias("end")),
        )

    return found.select(
        "doc_id",
        "text_key",
        F.size("words").cast("bigint").alias("n_words"),
        F.flatten(F.transform(F.coalesce("hits", none), named)).alias("matches"),
    )


def contamination(
    docs: DataFrame, bench: DataFrame, window: int = WINDOW, least_percent: int = 5
) -> DataFrame:
    """One row per document: ``doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated, matches``.

    ``n_hit`` counts document words inside any match, ``contaminated`` means at least ``least_percent`` of its words.
    NULL and empty texts have no words and are clean; items without words match nothing; an item with NULL id marks
    words but is not named or counted. Repeated rows are judged alike, very long texts whole. An empty benchmark leaves all clean, an empty
    table gives no rows. Only ``doc_id`` and ``text`` are read, so other columns cannot clash.
    """
    matches = phrase_matches(docs, bench, window)
    spans = F.array_sort(F.array_distinct(F.transform("matches", lambda m: F.struct(m["first"], m["end"]))))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("words"))

    def step(a: Column, s: Column) -> Column:
        fresh = F.greatest(F.lit(0), s["end"] - F.greatest(s["first"], a["end"]))
        return F.struct(F.greatest(a["end"], s["end"]).alias("end"), (a["words"] + fresh).alias("words"))

    ids = F.array_sort(
        F.array_distinct(F.array_compact(F.transform("matches", lambda m: m["item_id"].cast("string"))))
    )
    judged = (
        matches.withColumns({"_spans": spans, "_ids": ids})
        .select(
            "doc_id",
            "text_key",
            "n_words",
            F.aggregate("_spans", start, step, lambda a: a["words"]).alias("n_hit"),
            F.size("_ids").cast("bigint").alias("n_items"),
            F.sha2(F.concat_ws(",", "_ids"), 256).alias("items_sha256"),
            "matches",
        )
        .withColumn("contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= least_percent * F.col("n_words")))
    )
    return fenced(judged, "contaminated")
