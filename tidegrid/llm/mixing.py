"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target in words. A document's inclusion is its expected number of copies; the whole part is
certain, the fractional part is drawn: documents are ranked by random odds over inclusion odds and taken in
that order until the source's remaining words are used up. The draw is a hash, so reruns agree.

The rank of a source is never one sort. Documents are counted in ``CELLS`` cells of their rank value, the cell
in which the remaining words run out is found per source, cells before it are taken whole, and only the rows of
that one cell are sorted: about a ``CELLS``-th of a source, so a source of any share of the rows is spread out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import count_space_words, written

CELLS = 4096
# Inclusion weights are used to this many significant digits, so that a source has a bounded number of them.
WEIGHT_DIGITS = 3
_DRAW_BITS = 52


def with_size(docs: DataFrame, text: str = "text", name: str = "size") -> DataFrame:
    """Add the number of white-space words of a text; 0 for NULL."""
    return docs.withColumn(name, count_space_words(F.col(text)))


def source_targets(
    sized: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    budget_ratio: float = 1.5,
    max_copies: int = 2,
) -> DataFrame:
    """One row per source: ``source, source_size, weight, target``.

    Sources in code-point order, NULL last, take the weights in turn and share ``budget_ratio`` of all words.
    No target exceeds ``max_copies`` times its source; the excess goes to the others by weight. The order of
    the sources is global, so this small table (one row per source) is sorted as one partition.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = totals.withColumn(
        "weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), turn + 1).cast("bigint")
    ).withColumn("_cap", F.col("source_size") * max_copies)
    fill = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    budget = F.sum("source_size").over(everything) * F.lit(float(budget_ratio))
    capped_before = F.sum("_cap").over(fill) - F.col("_cap")
    weight_left = F.sum("weight").over(everything) - F.sum("weight").over(fill) + F.col("weight")
    filled = weighed.withColumns(
        {"_budget": budget, "_capped": F.col("_cap") * weight_left <= F.col("weight") * (budget - capped_before)}
    )
    level = F.col("_budget") - F.coalesce(F.sum(F.when(F.col("_capped"), F.col("_cap"))).over(everything), F.lit(0))
    open_weight = F.sum(F.when(~F.col("_capped"), F.col("weight"))).over(everything)
    target = F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise(F.col("weight") * level / open_weight)
    return filled.select("source", "source_size", "weight", target.alias("target"))


def by_length() -> Column:
    """Inclusion weight of the registered mix: the binary digits of a document's size, so long texts are drawn more often."""
    return F.length(F.bin("size")).cast("double")


def _weight(inclusion: str | Column) -> Column:
    """Relative inclusion to ``WEIGHT_DIGITS`` digits; 0 for NULL, NaN, infinite and negative values."""
    raw = (F.col(inclusion) if isinstance(inclusion, str) else inclusion).cast("double")
    shift = F.pow(F.lit(10.0), F.lit(WEIGHT_DIGITS - 1) - F.floor(F.log10(raw)))
    usable = (raw > 0) & (raw < float("inf")) & (shift > 0) & (shift < float("inf"))
    return F.when(usable, F.round(raw * shift) / shift).otherwise(0.0)


def inclusion_scales(weighted: DataFrame, targets: DataFrame, max_copies: int) -> DataFrame:
    """``targets`` with ``_mix_scale``: expected copies of a row of its source are its ``_mix_weight`` times it, at most
    ``max_copies``.

    What rows at the limit cannot take goes to the others by weight, so that the expected words of a source are its
    target (less only where rows of weight 0 would be needed). NULL where every row of some weight is at the limit.
    """
    cap = F.lit(float(max_copies))
    weights = weighted.where("_mix_weight > 0").groupBy("source", "_mix_weight").agg(F.sum("size").alias("_words"))
    weights = weights.select(F.col("source").alias("_of"), "_mix_weight", "_words")
    heaviest = Window.partitionBy("_of").orderBy(F.col("_mix_weight").desc())
    lightest = Window.partitionBy("_of").orderBy("_mix_weight")
    mass = F.col("_mix_weight") * F.col("_words")
    weighed = weights.join(targets, F.col("_of").eqNullSafe(F.col("source"))).withColumns(
        {"_heavier": F.sum("_words").over(heaviest) - F.col("_words"), "_lighter": F.sum(mass).over(lightest)}
    )
    full = cap * F.col("_lighter") <= F.col("_mix_weight") * (F.col("target") - cap * F.col("_heavier"))
    left = F.col("target") - cap * F.coalesce(F.sum(F.when(full, F.col("_words"))), F.lit(0))
    scale = left / F.nullif(F.sum(F.when(~full, mass)), F.lit(0.0))
    scales = weighed.groupBy("_of", "target").agg(scale.alias("_mix_scale")).drop("target")
    return targets.join(scales, F.col("source").eqNullSafe(F.col("_of")), "left").drop("_of")


def draw(seed: str) -> Column:
    """A number in (0, 1) from a hash of the document id and its size."""
    key = F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size"))
    head = F.conv(F.substring(F.md5(key), 1, _DRAW_BITS // 4), 16, 10).cast("bigint")
    return (head + F.lit(0.5)) / F.lit(float(2**_DRAW_BITS))


def mix_sources(
    sized: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    budget_ratio: float = 1.5,
    max_copies: int = 2,
    inclusion: str | Column | None = None,
    seed: str = "mix",
) -> DataFrame:
    """``sized`` (``doc_id, source, size`` and any other columns) with what the mix takes of every row.

    Adds ``source_size``, ``target`` (words of the source in the mix), ``copies`` and ``taken`` (words). The row at
    which a source reaches its target is taken if that brings the source nearer to it. ``inclusion`` is a column
    of relative inclusion weights within a source, used to three digits (NULL, NaN, infinite or negative counts as 0);
    without it all rows of a source have equal inclusion. Rows that reach ``max_copies`` leave the rest of their share to
    the others. Very long texts are rows like others. An empty table gives no rows, an empty text size 0 and taken 0; a NULL source is a source
    of its own; repeated rows are drawn one by one. Columns named like an added one are replaced.
    """
    added = ["source_size", "target", "copies", "taken"]
    base = sized.drop(*[c for c in sized.columns if c in added or c.startswith("_mix_")])
    targets = source_targets(base, weights, budget_ratio, max_copies).drop("weight")
    weighted = base
    if inclusion is not None:
        weighted = base.withColumn("_mix_weight", _weight(inclusion))
        targets = inclusion_scales(weighted, targets, max_copies)
    # One row per source, written so that its size is known: rows of a hot source are shuffled by it only if it is large.
    named = written(targets.withColumnRenamed("source", "_mix_source"))
    joined = weighted.join(named, F.col("source").eqNullSafe(F.col("_mix_source")), "left").drop("_mix_source")
    if inclusion is None:
        expected = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    else:
        scaled = F.coalesce(F.col("_mix_weight") * F.col("_mix_scale"), F.lit(float(max_copies)))
        expected = F.when(F.col("_mix_weight") > 0, scaled).otherwise(0.0)
    expected = F.least(expected, F.lit(float(max_copies)))
    chance = F.col("_mix_expected") - F.col("_mix_whole")
    odds = F.col("_mix_draw") / (F.lit(1.0) - F.col("_mix_draw"))
    order = F.when(chance > 0, odds * ((F.lit(1.0) - chance) / chance))
    ranked = (
        joined.withColumns({"_mix_expected": expected, "_mix_draw": draw(seed)})
        .withColumn("_mix_whole", F.floor("_mix_expected"))
        .withColumn("_mix_order", order)
        .withColumn(
            "_mix_cell",
            # ``least`` passes over NULL, which marks rows without a part to draw.
            F.when(
                F.col("_mix_order").isNotNull(),
                F.least(F.floor(F.col("_mix_order") / (F.col("_mix_order") + 1) * CELLS), F.lit(CELLS - 1)),
            ).cast("int"),
        )
    )
    # Certain copies and, by cell, what the draw can add.
    cells = ranked.groupBy("source", "_mix_cell").agg(
        F.sum(F.when(F.col("_mix_cell").isNotNull(), F.col("size"))).alias("words"),
        F.sum(F.col("_mix_whole") * F.col("size")).alias("certain"),
        F.first("target").alias("target"),
    )
    in_order = Window.partitionBy("source").orderBy(F.col("_mix_cell").asc_nulls_first())
    left = F.col("target") - F.sum("certain").over(Window.partitionBy("source"))
    cuts = (
        cells.withColumns({"_mix_left": left, "_mix_before": F.coalesce(F.sum("words").over(in_order), F.lit(0)) - F.coalesce("words", F.lit(0))})
        .where(F.col("_mix_before") <= F.col("_mix_left"))
        .groupBy("source")
        .agg(
            F.max(F.struct("_mix_before", "_mix_cell")).alias("_mix_last"),
            F.first("_mix_left").alias("_mix_left"),
        )
        .select(
            F.col("source").alias("_mix_source"),
            F.col("_mix_last._mix_cell").alias("_mix_cut"),
            F.col("_mix_last._mix_before").alias("_mix_before"),
            "_mix_left",
        )
    )
    placed = ranked.join(written(cuts), F.col("source").eqNullSafe(F.col("_mix_source")), "left").drop("_mix_source")
    at_cut = F.coalesce(F.col("_mix_cell") == F.col("_mix_cut"), F.lit(False))
    rows = Window.partitionBy("source").orderBy("_mix_order", "doc_id", "size")
    before = F.col("_mix_before") + F.sum("size").over(rows.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    near = F.coalesce(2 * before + F.col("size") <= 2 * F.col("_mix_left"), F.lit(False))
    edge = placed.where(at_cut).withColumn("_mix_drawn", near)
    rest = placed.where(~at_cut).withColumn(
        "_mix_drawn", F.coalesce(F.col("_mix_cell") < F.col("_mix_cut"), F.lit(False))
    )
    copies = F.col("_mix_whole") + F.col("_mix_drawn").cast("bigint")
    return edge.unionByName(rest).select(
        *[c for c in base.columns],
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )
