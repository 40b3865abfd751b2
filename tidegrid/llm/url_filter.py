"""URL rules looked up by hashes of host-suffix and path-prefix expressions.

A URL is expanded into one expression per rule shape (labels in the rule's host, characters in its path) that it
is long enough for. Expressions meet rules in an equi-join on the first 32 bits of their SHA-256, so a rule list
of any size is joined without comparing patterns; full digests then confirm, and the longest rule wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.common import ascii_lower, text_or_empty

PREFIX_HEX = 8


def url_host(url: Column) -> Column:
    """Lower-cased text from the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty without ``://``."""
    return ascii_lower(F.regexp_extract(text_or_empty(url), r"^(?s:.*?)://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(text_or_empty(url), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """A small rule list ``(verdict, host, path)`` as a table; large lists come from files."""
    rows = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("verdict", "host", "path"), r)]) for r in rules])
    return spark.range(1).select(F.inline(rows))


def _expression(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("\n"), path)


def filter_urls(
    pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", keep: Sequence[str] = ("page_id",)
) -> DataFrame:
    """``keep`` columns of every row with ``host, path, rule, verdict``.

    ``rules`` has ``verdict, host, path``. A rule fits its host and all subdomains when the path starts with the
    rule's path. The longest rule wins, then the one with the longer host, then ``block``; without a rule ``verdict``
    is ``default`` and ``rule`` NULL. NULL URLs and URLs without ``://`` have empty host and path and fit only rules
    that have them empty. Repeated rows are judged one by one; an empty table gives no rows. Rules with a NULL host,
    path or verdict are skipped. Of ``pages`` only ``keep`` and ``url`` are read, so other columns cannot clash.
    """
    known = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").select(
        ascii_lower(F.col("host")).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")
    )
    labels = F.size(F.split("r_host", r"\.", -1))
    shapes = known.select(F.struct(labels.alias("labels"), F.length("r_path").alias("chars")).alias("shape"))
    # Labels and path lengths of rules: bounded by the lengths URLs can have, whatever the number of rules.
    shape_list = shapes.agg(F.collect_set("shape")).scalar()
    digest = F.sha2(_expression(F.col("r_host"), F.col("r_path")), 256)
    keyed = known.withColumn("r_digest", digest).withColumn("r_key", F.substring("r_digest", 1, PREFIX_HEX))

    read = pages.select(
        *[F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)],
        url_host(F.col(url)).alias("host"),
        url_path(F.col(url)).alias("path"),
        F.monotonically_increasing_id().alias("row"),
    )
    carried = list(read.columns)
    no_shape = F.array().cast("array<struct<labels:int,chars:int>>")
    fitting = F.filter(
        F.col("shapes"),
        lambda s: (s["labels"] <= F.size(F.split("host", r"\.", -1))) & (s["chars"] <= F.length("path")),
    )
    shape = F.col("shape")
    suffix = F.call_function("substring_index", F.col("host"), F.lit("."), -shape["labels"])
    prefix = F.substring(F.col("path"), F.lit(1), shape["chars"])
    shaped = read.withColumn("shapes", F.coalesce(shape_list, no_shape))
    expanded = shaped.withColumn("shape", F.explode_outer(fitting)).select(
        *carried,
        F.sha2(_expression(suffix, prefix), 256).alias("digest"),
    )
    confirmed = (F.col("key") == F.col("r_key")) & (F.col("digest") == F.col("r_digest"))
    joined = expanded.withColumn("key", F.substring("digest", 1, PREFIX_HEX)).join(keyed, confirmed, "left")
    found = F.when(
        F.col("r_digest").isNotNull(),
        F.struct(
            (F.length("r_host") + F.length("r_path")).alias("length"),
            F.length("r_host").alias("host_length"),
            (F.col("r_verdict") == "block").alias("blocks"),
            F.concat("r_host", "r_path").alias("rule"),
            F.col("r_verdict").alias("verdict"),
        ),
    )
    judged = [F.first(c).alias(c) for c in carried if c != "row"]
    best = joined.groupBy("row").agg(*judged, F.max(found).alias("best"))
    return best.select(
        *[F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)],
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
    )
