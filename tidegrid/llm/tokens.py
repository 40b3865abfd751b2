"""Token counts as an exact histogram of encoded lengths.

Whole texts are encoded by a public byte-pair vocabulary and reduced to one row per distinct length. Suffix sums
over the lengths then answer documents, tokens and truncated totals for every context limit without another pass.
"""

from __future__ import annotations

import base64
import importlib.util
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Lengths are summed in blocks of this many, so that no window sees all of them.
BLOCK = 4096


@lru_cache(maxsize=4)
def _encoding(folder: str, vocabulary: str):
    """The encoder of a vocabulary file, once per worker process."""
    import tiktoken

    spec = importlib.util.spec_from_file_location("public_tokenizers_of_folder", f"{folder}/__init__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    lines = Path(folder, vocabulary).read_bytes().splitlines()
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=module.PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_token_count(docs: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` with ``n_tokens`` (long), the encoded length of the whole ``text``; 0 for NULL and empty texts.

    Very long texts are encoded whole, repeated rows one by one; an empty table gives no rows, and a column named
    ``n_tokens`` is replaced.
    """
    base = docs.drop("n_tokens")
    schema = T.StructType([*base.schema.fields, T.StructField("n_tokens", T.LongType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(folder, vocabulary).encode_ordinary
        for batch in batches:
            lengths = [len(encode(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lengths, pa.int64())], [*batch.schema.names, "n_tokens"]
            )

    return base.mapInArrow(add, schema)


def length_histogram(counted: DataFrame) -> DataFrame:
    """``n_tokens, n_docs``: documents by encoded length."""
    return counted.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """The histogram with, for every length ``n_tokens``:

    ``docs_from`` and ``tokens_from`` (documents of at least this length and their tokens), ``docs_below``,
    ``truncated_total`` (tokens left when every document is cut to this length) and ``total_docs``.

    Lengths are distinct, so there are as many rows as lengths. Sums run over blocks of ``BLOCK`` lengths and then
    inside each block. An empty histogram gives no rows.
    """
    block = F.floor(F.col("n_tokens") / BLOCK)
    tokens = F.col("n_tokens") * F.col("n_docs")
    blocked = histogram.select("n_tokens", "n_docs", block.alias("_block"))
    sums = blocked.groupBy("_block").agg(F.sum("n_docs").alias("_docs"), F.sum(tokens).alias("_tokens"))
    over_blocks = Window.orderBy(F.col("_block").desc())
    after = sums.select(
        "_block",
        (F.sum("_docs").over(over_blocks) - F.col("_docs")).alias("_docs_after"),
        (F.sum("_tokens").over(over_blocks) - F.col("_tokens")).alias("_tokens_after"),
        F.sum("_docs").over(Window.partitionBy()).alias("total_docs"),
        F.sum("_tokens").over(Window.partitionBy()).alias("total_tokens"),
    )
    inside = Window.partitionBy("_block").orderBy(F.col("n_tokens").desc())
    joined = blocked.join(after, "_block").withColumns(
        {
            "docs_from": F.sum("n_docs").over(inside) + F.col("_docs_after"),
            "tokens_from": F.sum(tokens).over(inside) + F.col("_tokens_after"),
        }
    )
    below = F.col("total_tokens") - F.col("tokens_from")
    return joined.select(
        "n_tokens",
        "n_docs",
        "docs_from",
        "tokens_from",
        (F.col("total_docs") - F.col("docs_from")).alias("docs_below"),
        (below + F.col("n_tokens") * F.col("docs_from")).alias("truncated_total"),
        "total_docs",
    )


def answer_limits(sums: DataFrame, limits: DataFrame) -> DataFrame:
    """For every context ``limit`` of ``limits``: ``docs_over`` (longer documents) and ``truncated_total``.

    Exact for limits between two lengths: documents of at least the next length are cut to the limit and the rest
    is whole. The next length is found in blocks, so no limit meets all lengths.
    """
    steps = sums.select("n_tokens", "docs_from", "tokens_from").withColumn("_limit", F.lit(None).cast("bigint"))
    asked = limits.select(F.col("limit").cast("bigint").alias("_limit")).where("_limit IS NOT NULL").distinct()
    totals = sums.agg(F.struct(F.max("tokens_from").alias("tokens"), F.max("n_tokens").alias("longest"))).scalar()
    # A limit stands just before the first longer length: its own place is limit + 1.
    line = steps.withColumn("_at", F.col("n_tokens")).unionByName(
        asked.withColumn("_at", F.col("_limit") + 1), allowMissingColumns=True
    ).withColumn("_block", F.floor(F.col("_at") / BLOCK))
    first = F.struct("n_tokens", "docs_from", "tokens_from")
    heads = line.where("n_tokens IS NOT NULL").groupBy("_block").agg(F.min(first).alias("_head"))
    blocks = line.select("_block").distinct().join(heads, "_block", "left")
    nexts = blocks.select(
        "_block",
        F.first("_head", True)
        .over(Window.orderBy("_block").rowsBetween(1, Window.unboundedFollowing))
        .alias("_next"),
    )
    onward = Window.partitionBy("_block").orderBy("_at").rangeBetween(0, Window.unboundedFollowing)
    ahead = F.first(F.when(F.col("n_tokens").isNotNull(), first), True).over(onward)
    found = line.withColumn("_ahead", ahead).join(nexts, "_block", "left").where("_limit IS NOT NULL")
    step = F.coalesce("_ahead", "_next")
    over = F.coalesce(step["docs_from"], F.lit(0))
    return found.select(
        F.col("_limit").alias("limit"),
        over.alias("docs_over"),
        (F.coalesce(totals["tokens"], F.lit(0)) - F.coalesce(step["tokens_from"], F.lit(0)) + F.col("_limit") * over).alias(
            "truncated_total"
        ),
    )


def length_at(share: float) -> Column:
    """Aggregate over :func:`suffix_sums`: the smallest length that at least ``share`` of all documents do not exceed."""
    reached = F.col("docs_below") + F.col("n_docs")
    return F.min(F.when(reached >= F.col("total_docs") * share, F.col("n_tokens")))
