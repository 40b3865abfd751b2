"""Order-dependent work inside groups of any size.

A window partitioned by a group key puts the whole group in one task. That is right for a region-day
of 288 intervals and wrong for a group that holds a large share of the table. Each operator here first
counts the groups above ``max_group_rows`` (one partial aggregate over the key columns). If there are
none the plain window is used. Otherwise every such group is cut into runs of consecutive slots, so
that each run is a bounded unit of work, and the results are stitched together exactly.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows one task may sort and frame as a single group.
MAX_GROUP_ROWS = 1_000_000

# Bits of a slot of ``order_digits``: a window over one digit has at most 65,536 rows.
DIGIT_BITS = 16

# Key rows of (REGIONID, day) below this count are a few megabytes, safe to broadcast.
MAX_BROADCAST_KEYS = 50_000


def oversized_groups(df: DataFrame, keys: Sequence[str], max_group_rows: int | None) -> DataFrame | None:
    """Keys of the groups with more than ``max_group_rows`` rows, or None if there are none.

    Counts them in a job of its own. ``max_group_rows=None`` trusts the groups to be small and runs no job.
    """
    if max_group_rows is None:
        return None
    big = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max_group_rows).select(*keys)
    found = big.count()
    if not found:
        return None
    return F.broadcast(big) if found <= MAX_BROADCAST_KEYS else big


def settle(df: DataFrame) -> DataFrame:
    """``df`` checkpointed where the cluster names a checkpoint folder, else ``df``.

    For results that several branches of one plan read, so that they are not computed for each.
    """
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    return df.checkpoint() if folder else df


def order_digits(value: Column, name: str) -> dict[str, Column]:
    """Slots in the order of a BIGINT: its sign and highest bits first, then ``DIGIT_BITS`` bits at a time."""
    shifts = range(63 // DIGIT_BITS * DIGIT_BITS, -1, -DIGIT_BITS)
    digits = {f"{name}{i}": F.shiftright(value, shift) for i, shift in enumerate(shifts)}
    below = F.lit(2**DIGIT_BITS - 1)
    return {n: d if i == 0 else d.bitwiseAND(below) for i, (n, d) in enumerate(digits.items())}


def rows_before(counts: DataFrame, keys: Sequence[str], slots: Sequence[str]) -> DataFrame:
    """Add ``_before``: the sum of ``_n`` over the cells of the same ``keys`` that precede a cell in the order of ``slots``.

    No window holds all cells of a group. The cells are summed up slot by slot: a window covers the distinct
    values of one slot under one value of the slots before it, and hands its running total down to them.
    """
    before = None
    for depth in range(1, len(slots) + 1):
        path, parent = [*keys, *slots[:depth]], [*keys, *slots[: depth - 1]]
        level = counts if depth == len(slots) else counts.groupBy(*path).agg(F.sum("_n").alias("_n"))
        inside = Window.partitionBy(*parent).orderBy(slots[depth - 1])
        level = level.withColumn("_inside", F.sum("_n").over(inside) - F.col("_n"))
        if before is not None:
            level = level.join(before.select(*parent, "_before"), parent)
        total = F.col("_inside") if before is None else F.col("_before") + F.col("_inside")
        before = level.withColumn("_before", total).drop("_inside")
    return before


def cut_groups(
    df: DataFrame,
    keys: Sequence[str],
    slots: Mapping[str, Column],
    max_group_rows: int,
    big: DataFrame,
) -> DataFrame:
    """Add ``_chunk`` and ``_base``: the run a row belongs to and the rows of its group before that run.

    ``slots`` are named columns whose ascending order, the first one first, agrees with the row order inside a
    group. Rows of one slot stay together; neighbouring slots share a chunk while they fit into
    ``max_group_rows``. Groups not in ``big`` are one chunk.
    """
    slotted = df.withColumns(dict(slots))
    cell = [*keys, *slots]
    counts = slotted.join(big, list(keys), "left_semi").groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
    cuts = (
        rows_before(counts, keys, list(slots))
        .withColumn("_chunk", F.floor(F.col("_before") / max_group_rows))
        .withColumn("_base", F.min("_before").over(Window.partitionBy(*keys, "_chunk")))
        .select(*cell, "_chunk", "_base")
    )
    return (
        slotted.join(cuts, cell, "left")
        .drop(*slots)
        .withColumns({name: F.coalesce(F.col(name), F.lit(0)) for name in ("_chunk", "_base")})
    )


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    slots: Mapping[str, Column],
    name: str,
    max_group_rows: int | None,
    big: DataFrame | None,
) -> DataFrame:
    """``row_number()`` by ``keys`` in ``order`` as BIGINT column ``name``, for groups of any size."""
    if big is None:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    chunk = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    return (
        cut_groups(df, keys, slots, max_group_rows, big)
        .withColumn(name, F.row_number().over(chunk) + F.col("_base"))
        .select(*df.columns, name)
    )


def lend_edges(
    chunked: DataFrame,
    keys: Sequence[str],
    chunk: Sequence[str],
    order: Sequence[str],
    carry: Sequence[str],
    rows: int,
    trailing: bool,
) -> DataFrame:
    """Add to every chunk the ``rows`` neighbouring rows its frames reach into (``_halo`` marks them).

    A chunk lends its own edge: its first rows to the chunks before it, or its last rows to the chunks
    after it when ``trailing``. Only these edges are shuffled by ``keys``. Every chunk holds at least one
    row, so looking ``rows`` chunks away always finds enough of them.
    """
    marked = chunked.withColumn("_halo", F.lit(False))
    if rows <= 0:
        return marked
    direction = [F.col(c).desc() if trailing else F.col(c).asc() for c in order]
    edge_rank = F.row_number().over(Window.partitionBy(*keys, *chunk).orderBy(*direction))
    across = Window.partitionBy(*keys).orderBy(*chunk)
    reach = across.rowsBetween(-rows, -1) if trailing else across.rowsBetween(1, rows)
    fields = [*order, *[c for c in carry if c not in order]]
    edges = (
        chunked.select(*keys, *chunk, *fields)
        .withColumn("_rank", edge_rank)
        .where(F.col("_rank") <= rows)
        .groupBy(*keys, *chunk)
        .agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_edge"))
        .withColumn("_near", F.flatten(F.collect_list("_edge").over(reach)))
    )
    surplus = F.greatest(F.size("_near") - rows, F.lit(0)) if trailing else F.lit(0)
    borrowed = (
        edges.select(*keys, *chunk, F.explode(F.slice("_near", surplus + 1, F.lit(rows))).alias("_row"))
        .select(*keys, *chunk, *[F.col("_row")[f].alias(f) for f in fields])
        .withColumn("_halo", F.lit(True))
    )
    return marked.unionByName(borrowed, allowMissingColumns=True)
