"""The live parts of the price table, switched by one commit.

Every load writes its rows into a part folder of its own. The manifest lists, by month, the parts whose rows count,
with the count, sum, minimum and maximum of each region in them. A commit writes the next version of the list as one
file; readers take the newest version whole, so they see the rows before a commit or after it and never a mixture.
Parts that no version names any more are garbage: what a failed attempt left, or what a rewrite replaced.

One writer commits at a time; a second one fails on the version both want to write and is to be repeated.
"""

from __future__ import annotations

from collections.abc import Collection, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.plans.reports import merged_partials, price_partials
from tidegrid.schema import MANIFEST, PRICES
from tidegrid.sinks.tables import write_prices
from tidegrid.sources.prices import load_prices

Month = tuple[int, int]


def create_manifest(spark: SparkSession, root: str) -> None:
    """Version 0, without parts, where there is no manifest."""
    spark.createDataFrame([], MANIFEST).coalesce(1).write.mode("ignore").parquet(f"{root}/version=0")


def current_version(spark: SparkSession, root: str) -> int:
    """The newest version; :func:`create_manifest` makes the first."""
    versions = spark.read.schema(f"{_ddl()}, version int").parquet(root)
    return versions.agg(F.max("version")).first()[0] or 0


def _ddl() -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in MANIFEST)


def read_manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The rows of one version, the newest by default."""
    wanted = current_version(spark, root) if version is None else version
    return spark.read.schema(MANIFEST).parquet(f"{root}/version={wanted}")


def live_parts(manifest: DataFrame) -> dict[Month, list[str]]:
    """Part names by month, as many as a file listing has folders."""
    found: dict[Month, list[str]] = {}
    for row in manifest.select("year", "month", "part").distinct().orderBy("year", "month", "part").collect():
        found.setdefault((row.year, row.month), []).append(row.part)
    return found


def parts_prices(
    spark: SparkSession, prices: str, parts: dict[Month, list[str]], months: Collection[Month] | None = None, **chosen: object
) -> DataFrame:
    """Rows of the live parts, of some ``months`` only where given; further arguments as for ``load_prices``."""
    folders = [
        f"{prices}/part={part}/year={year}/month={month}"
        for (year, month), names in parts.items()
        if months is None or (year, month) in months
        for part in names
    ]
    if not folders:
        return spark.createDataFrame([], PRICES)
    return load_prices(spark, folders, base=prices, **chosen)


def live_prices(spark: SparkSession, prices: str, manifest: str, **chosen: object) -> DataFrame:
    """The price table as of the newest commit; arguments as for ``load_prices``."""
    return parts_prices(spark, prices, live_parts(read_manifest(spark, manifest)), **chosen)


def write_part(rows: DataFrame, prices: str, part: str) -> DataFrame:
    """Write a new part and return its manifest rows, from what was written alone."""
    spark = rows.sparkSession
    write_prices(rows, f"{prices}/part={part}")
    written = load_prices(spark, f"{prices}/part={part}")
    return price_partials(written).withColumn("part", F.lit(part)).select(*MANIFEST.names)


def commit(spark: SparkSession, root: str, added: DataFrame, rewritten: Iterable[Month]) -> int:
    """The next version: ``added`` rows beside those of the current version outside ``rewritten`` months."""
    current = current_version(spark, root)
    kept = read_manifest(spark, root, current)
    for year, month in rewritten:
        kept = kept.where(~((F.col("year") == year) & (F.col("month") == month)))
    # One row per part, month and region: a list as short as that of the folders, in one file that appears at once.
    kept.unionByName(added).coalesce(1).write.mode("errorifexists").parquet(f"{root}/version={current + 1}")
    return current + 1


def summary_of(manifest: DataFrame) -> DataFrame:
    """``price_summary`` of all live rows, merged from the partial results of their parts."""
    return merged_partials(manifest)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the table's own file system, if it is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _folders(spark: SparkSession, path: str) -> list[str]:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(target):
        return []
    return [entry.getPath().getName() for entry in system.listStatus(target) if entry.isDirectory()]


def remove_garbage(spark: SparkSession, prices: str, manifest: str, keep_versions: int = 2) -> list[str]:
    """Delete old versions and the parts that none of the newest ``keep_versions`` names; the parts' names.

    Not to be run beside a load, whose part is named by no version yet, nor beside readers of older versions.
    """
    newest = current_version(spark, manifest)
    versions = [name for name in _folders(spark, manifest) if name.startswith("version=")]
    numbers = sorted((int(name.partition("=")[2]) for name in versions), reverse=True)
    kept = [n for n in numbers if n <= newest][: max(1, keep_versions)]
    named = {row.part for n in kept for row in read_manifest(spark, manifest, n).select("part").distinct().collect()}
    for number in set(numbers) - set(kept):
        remove_folder(spark, f"{manifest}/version={number}")
    garbage = [
        name for name in _folders(spark, prices) if name.startswith("part=") and name.partition("=")[2] not in named
    ]
    for name in garbage:
        remove_folder(spark, f"{prices}/{name}")
    return sorted(name.partition("=")[2] for name in garbage)
