"""Near-duplicate documents by SetSketch registers, banding, joint estimation and exact verification.

A SetSketch register is the truncated, exponentially spaced minimum of hashed set elements: the element-wise maximum
of two sketches is the sketch of the union, and the share of equal registers grows with the similarity. The steps:

1. Documents with the same shingle set are one class; everything below works on classes.
2. Bands of registers form buckets. A bucket of up to ``SMALL`` classes gives all its pairs. A larger one gives a pair
   of every member with its most central one.
3. For every pair the similarity is estimated from both sketches by maximum likelihood. Pairs whose estimate lies more
   than ``MARGIN`` standard deviations below the threshold are dropped.
4. The rest is verified on full shingle sets, best pairs first; pairs whose classes are connected by then are implied.
5. Where a larger bucket still holds several components, its classes are paired with random ones of other components.
6. Classes of larger buckets in which several components remain even so are joined on their rarest shingles. Sizes and
   positions in the order of rarity rule pairs out before they meet, so every pair that can reach the threshold is
   found, whatever many of them have in common.

No step gathers a bucket, a component or a group in one task: buckets are aggregates, small buckets have at most
``SMALL`` members, and components are found by joins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import pieces, shingle_sets, text_bytes, text_or_empty, written

SHINGLE_WORDS = 5
THRESHOLD_PERCENT = 75
BANDS = 48
BAND_REGISTERS = 5
REGISTERS = BANDS * BAND_REGISTERS
#: Base of the register spacing and rate of the hash values: 8-bit registers cover sets of 1 to about 1e8 elements.
BASE = 1.09
RATE = 20.0
MARGIN = 4.5
SMALL = 8
SALTED = 2

_MULTIPLIERS = np.random.default_rng(9).integers(1, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLOCK = 4096


def sketch(elements: np.ndarray) -> np.ndarray:
    """8-bit registers of a set of 64-bit hashes: ``floor(1 - log_b(smallest exponential hash))``."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max)
    for start in range(0, len(elements), _BLOCK):
        spread = elements[start : start + _BLOCK, None] * _MULTIPLIERS
        np.minimum(least, spread.min(axis=0), out=least)
    uniform = (least.astype(np.float64) + 0.5) / 2.0**64
    exponential = -np.log1p(-np.minimum(uniform, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, 255).astype(np.uint8)


def _probability(x: np.ndarray) -> np.ndarray:
    """Chance that a register of one set exceeds the other's, ``x`` being its share of own elements."""
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def estimate(more: np.ndarray, less: np.ndarray, equal: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity that maximises the likelihood of ``more`` registers greater in a, ``less`` in b, ``equal``."""
    a, b = size_a / (size_a + size_b), size_b / (size_a + size_b)
    low, high = np.zeros(len(a)), np.minimum(a / b, b / a)

    def likelihood(j: np.ndarray) -> np.ndarray:
        over, under = _probability(a - b * j), _probability(b - a * j)
        tiny = 1e-300
        return (
            more * np.log(np.maximum(over, tiny))
            + less * np.log(np.maximum(under, tiny))
            + equal * np.log(np.maximum(1 - over - under, tiny))
        )

    ratio = (np.sqrt(5) - 1) / 2
    for _ in range(40):
        left, right = high - ratio * (high - low), low + ratio * (high - low)
        better = likelihood(left) < likelihood(right)
        low, high = np.where(better, left, low), np.where(better, high, right)
    return (low + high) / 2


_SKETCHED = "doc_id bigint, text_key bigint, n_shingles bigint, digest binary, sketch binary"


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text"):
            data, offsets = text_bytes(part.column("text"))
            sizes, digests, sketches = [], [], []
            for elements in shingle_sets(data, offsets, SHINGLE_WORDS):
                sizes.append(len(elements))
                some = len(elements) > 0
                digests.append(hashlib.blake2b(elements.tobytes(), digest_size=16).digest() if some else None)
                sketches.append(sketch(elements).tobytes() if some else None)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_key"), pa.array(sizes, pa.int64()),
                 pa.array(digests, pa.binary()), pa.array(sketches, pa.binary())],
                ["doc_id", "text_key", "n_shingles", "digest", "sketch"],
            )


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text_or_empty(F.col("text"))).alias("text_key"), "text"
    )


def _large(df: DataFrame) -> DataFrame:
    """Join this side by a shuffle whatever its size now: it grows with the documents."""
    return df.hint("merge")


def _bands(classes: DataFrame) -> DataFrame:
    """``cls, size, band, key`` of every class and band."""
    band = F.col("band")
    return classes.select(
        "cls", F.col("n_shingles").alias("size"), "sketch", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")
    ).select(
        "cls",
        "size",
        "band",
        F.xxhash64(band, F.substring(F.col("sketch"), band * BAND_REGISTERS + 1, F.lit(BAND_REGISTERS))).alias("key"),
    )


def _shared(rows: DataFrame) -> DataFrame:
    """Rows ``cls, size, band, key`` of buckets with several classes, with the bucket's ``members``."""
    members = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    return rows.join(_large(members), "key")


def _sizes_fit(one: Column, two: Column) -> Column:
    """No larger similarity than that of the smaller size to the larger one is possible."""
    return 100 * F.least(one, two) >= THRESHOLD_PERCENT * F.greatest(one, two)


def _pairs(buckets: DataFrame) -> DataFrame:
    """Distinct candidate pairs ``a < b`` of bucket rows ``cls, size, key, members``.

    Pairs of sets too different in size for the threshold are not needed.
    """
    small = (
        buckets.where(F.col("members") <= SMALL)
        .groupBy("key")
        .agg(F.sort_array(F.collect_list(F.struct("cls", "size"))).alias("m"))
        .where(F.size("m") > 1)
    )
    at = F.posexplode("m").alias("i", "x")
    all_pairs = (
        small.select("m", at)
        .select("x", F.explode(F.slice("m", F.col("i") + 2, SMALL)).alias("y"))
        .where(_sizes_fit(F.col("x.size"), F.col("y.size")))
        .select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"))
    )
    hot = buckets.where(F.col("members") > SMALL)
    # A member is central when many of its buckets are large: it has the registers that most others share. Few
    # classes are the most central of all the buckets of a group, so its members meet the same ones again and again.
    central = hot.groupBy("cls").agg(F.sum(F.log("members")).alias("central"))
    hubs = hot.join(central, "cls").groupBy("key").agg(
        F.max_by(F.struct("cls", "size"), F.struct("central", "cls")).alias("hub")
    )
    starred = (
        hot.join(hubs, "key")
        .where((F.col("cls") != F.col("hub.cls")) & _sizes_fit(F.col("size"), F.col("hub.size")))
        .select(F.least("cls", "hub.cls").alias("a"), F.greatest("cls", "hub.cls").alias("b"))
    )
    return all_pairs.unionByName(starred).distinct()


def _salted_pairs(mixed: DataFrame) -> DataFrame:
    """Distinct pairs ``a < b`` of every class in a mixed bucket with ``SALTED`` random ones of another component."""
    hubs = mixed.groupBy("key").agg(
        F.array(
            *[F.min_by(F.struct("cls", "size", "comp"), F.xxhash64("cls", "key", F.lit(i))) for i in range(SALTED)]
        ).alias("hubs")
    )
    return (
        mixed.join(hubs, "key")
        .select("cls", "size", "comp", F.explode(F.array_distinct("hubs")).alias("hub"))
        .where((F.col("comp") != F.col("hub.comp")) & _sizes_fit(F.col("size"), F.col("hub.size")))
        .select(F.least("cls", "hub.cls").alias("a"), F.greatest("cls", "hub.cls").alias("b"))
        .distinct()
    )


_ESTIMATED = "a bigint, b bigint, similarity double"


def _estimate_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        left, right = (
            np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, REGISTERS)
            for c in ("sketch_a", "sketch_b")
        )
        more, less = (left > right).sum(axis=1), (left < right).sum(axis=1)
        sizes = [batch.column(c).to_numpy().astype(np.float64) for c in ("size_a", "size_b")]
        found = estimate(more, less, REGISTERS - more - less, *sizes)
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), pa.array(found)], ["a", "b", "similarity"]
        )


def _estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose sketches allow the threshold, with the estimate."""
    threshold = THRESHOLD_PERCENT / 100
    least = threshold - MARGIN * (threshold * (1 - threshold) / REGISTERS) ** 0.5
    narrow = classes.select("cls", "n_shingles", "sketch")
    sides = [
        narrow.select(*[F.col(c).alias(n) for c, n in (("cls", s), ("n_shingles", f"size_{s}"), ("sketch", f"sketch_{s}"))])
        for s in "ab"
    ]
    joined = pairs.join(_large(sides[0]), "a")
    joined = joined.join(_large(sides[1]), "b")
    chosen = joined.select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b")
    return chosen.mapInArrow(_estimate_rows, _ESTIMATED).where(F.col("similarity") >= least)


_VERIFIED = "a bigint, b bigint, linked boolean"


def _verify_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = []
        for part in pieces(batch, "text_a", 2 << 20):
            sides = [shingle_sets(*text_bytes(part.column(c)), SHINGLE_WORDS) for c in ("text_a", "text_b")]
            for x, y in zip(*sides, strict=True):
                common = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * common >= THRESHOLD_PERCENT * (len(x) + len(y) - common))
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"]
        )


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Links among ``pairs``, checked on the full sets."""
    sides = [texts.select(F.col("cls").alias(s), F.col("text").alias(f"text_{s}")) for s in "ab"]
    joined = pairs.select("a", "b").join(_large(sides[0]), "a").join(_large(sides[1]), "b")
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(_verify_rows, _VERIFIED).where("linked")


def connect(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``cls, comp`` of all classes in ``links`` (``a, b``) or ``labels``; ``comp`` is the smallest class of a component.

    Every round hooks each component to its smallest smaller neighbour and shortens the chains; the edges between
    components shrink until none is left. The rounds work on edges and hooks alone, the labels are renamed at the end.
    """
    own = links.select(F.explode(F.array("a", "b")).alias("cls")).select("cls", F.col("cls").alias("comp"))
    known = own if labels is None else labels.unionByName(own)
    known = known.groupBy("cls").agg(F.min("comp").alias("comp"))
    edges = links.select("a", "b")
    if labels is not None:
        edges = _renamed(edges, labels.select(F.col("cls").alias("from"), F.col("comp").alias("to")))
    rounds = []
    while True:
        edges = written(
            edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        )
        if edges.isEmpty():
            break
        hooks = edges.groupBy(F.col("b").alias("from")).agg(F.min("a").alias("to"))
        for _ in range(2):
            further = hooks.select(F.col("from").alias("to"), F.col("to").alias("next"))
            hooks = written(hooks.join(further, "to", "left").select("from", F.coalesce("next", "to").alias("to")))
        rounds.append(hooks)
        edges = _renamed(edges, hooks)
    for hooks in rounds:
        renamed = F.coalesce("to", "comp").alias("comp")
        known = known.join(hooks, F.col("comp") == F.col("from"), "left").select("cls", renamed)
    return written(known)


def _renamed(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges with every end that ``names`` (``from, to``) has renamed."""
    for side in "ab":
        other = "b" if side == "a" else "a"
        joined = edges.join(names, F.col(side) == F.col("from"), "left")
        edges = joined.select(other, F.coalesce("to", side).alias(side))
    return edges


def _open(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose classes are not yet connected."""
    for side in "ab":
        named = labels.select(F.col("cls").alias(side), F.col("comp").alias(f"comp_{side}"))
        pairs = pairs.join(named, side, "left")
    apart = F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b")
    return pairs.where(apart).select("a", "b")


def _link(pairs: DataFrame, texts: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Labels after verifying ``pairs``: first each class's most similar partner, then what is still apart."""
    # The best partner on either side first, which reduces the pairs before each counts for both of its classes.
    sides = [
        pairs.groupBy(F.col(one).alias("one")).agg(
            F.max(F.struct("similarity", (-F.col(two)).alias("other"))).alias("best")
        )
        for one, two in ("ab", "ba")
    ]
    best = (
        sides[0]
        .unionByName(sides[1])
        .groupBy("one")
        .agg((-F.max("best")["other"]).alias("two"))
        .select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b"))
        .distinct()
    )
    first = written(best)
    labels = connect(written(_verified(first, texts).select("a", "b")), labels)
    rest = written(_open(pairs.join(first, ["a", "b"], "left_anti"), labels))
    return connect(written(_verified(rest, texts).select("a", "b")), labels)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, text_key, n_shingles, component_id, kept``.

    Documents whose sets of ``SHINGLE_WORDS``-word shingles have a Jaccard similarity of at least
    ``THRESHOLD_PERCENT`` percent are linked; ``component_id`` is the smallest ``doc_id`` that links reach. Texts with
    fewer words have their whole sequence as the one shingle. NULL and empty texts have no shingle and no link.
    ``kept`` marks the smallest ``doc_id`` of a component (every row that repeats it); a NULL ``doc_id`` is smaller than
    none, so it is kept only where the component has no other, as is its NULL ``component_id``. ``text_key`` is a hash of
    the text that tells rows with equal ids apart. An empty table gives no rows. Only ``doc_id`` and ``text`` are read,
    so other columns cannot clash. Very long texts count whole.

    Sets are compared as sets of 64-bit hashes; a pair of similarity s is a candidate with probability
    1 - (1 - s^5)^48, more than 1 - 2e-6 at the threshold, and most documents have more than one way into a component.
    This holds in buckets of any size: what the hubs of a large one leave apart is compared by its rarest shingles.
    """
    keyed = _keyed(docs)
    sketched = written(keyed.select("doc_id", "text_key", "text").mapInArrow(_sketch_rows, _SKETCHED))
    cls = F.xxhash64("digest")
    classes = written(
        sketched.where(F.col("digest").isNotNull())
        .groupBy(cls.alias("cls"))
        .agg(
            F.min(F.struct("doc_id", "text_key")).alias("one"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("sketch").alias("sketch"),
        )
    )
    buckets = written(_shared(_bands(classes)))
    pairs = written(_estimated(_pairs(buckets), classes))
    texts = _texts(keyed, classes, buckets)
    labels = _link(pairs, texts)
    mixed = written(_mixed(buckets, labels))
    if not mixed.isEmpty():
        labels = _link(written(_estimated(_salted_pairs(mixed), classes)), texts, labels)
        apart = _mixed(buckets, labels).select("cls", "comp", "size").distinct()
        found = written(_estimated(_rare_pairs(written(apart), texts), classes))
        labels = connect(written(_verified(found, texts).select("a", "b")), labels)
    named = sketched.select("doc_id", "text_key", "n_shingles", F.when(F.col("digest").isNotNull(), cls).alias("cls"))
    placed = named.join(labels, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    smallest = placed.where("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("component"))
    joined = placed.join(_large(smallest), "comp", "left")
    component = F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return joined.select(
        "doc_id",
        "text_key",
        "n_shingles",
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def _texts(keyed: DataFrame, classes: DataFrame, buckets: DataFrame) -> DataFrame:
    """``cls, text`` of one document of every class that shares a bucket."""
    needed = classes.join(_large(buckets.select("cls").distinct()), "cls", "left_semi").select(
        "cls", F.col("one.doc_id").alias("_id"), F.col("one.text_key").alias("_key")
    )
    joined = keyed.join(_large(needed), (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    return written(joined.groupBy("cls").agg(F.first("text").alias("text")))


def _mixed(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """``key, cls, comp, size`` of the classes in large buckets that hold several components."""
    hot = buckets.where(F.col("members") > SMALL).join(labels, "cls", "left")
    hot = hot.select("key", "cls", "size", F.coalesce("comp", "cls").alias("comp"))
    several = hot.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    return hot.join(_large(several.select("key")), "key", "left_semi")


_SHINGLED = "cls bigint, comp bigint, size bigint, gram bigint"


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text", 1 << 20):
            sets = list(shingle_sets(*text_bytes(part.column("text")), SHINGLE_WORDS))
            of = pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets]))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c).take(of) for c in ("cls", "comp", "size")),
                 pa.array(np.concatenate(sets).view(np.int64))],
                ["cls", "comp", "size", "gram"],
            )


def _rare_pairs(mixed: DataFrame, texts: DataFrame) -> DataFrame:
    """Distinct pairs ``a < b`` of ``mixed`` in different components, among them all that reach the threshold.

    Shingles are ordered from the rarest to the most frequent, those of one component alone first: no pair needs them.
    If a pair's first common shingle leaves ``rest`` shingles of either set, itself included, the pair has no more than
    the smaller ``rest`` in common. Where that is too few for the two sizes they do not meet at this shingle.
    """
    rows = mixed.join(_large(texts), "cls").select("cls", "comp", "size", "text").mapInArrow(_shingle_rows, _SHINGLED)
    rows = written(rows)
    counts = [F.count(F.lit(1)).alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high")]
    common = rows.groupBy("gram").agg(*counts).where("low < high").select("gram", "n")
    ordered = (
        rows.join(_large(common), "gram")
        .groupBy("cls", "comp", "size")
        .agg(F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("grams"))
    )
    at = F.posexplode("grams").alias("i", "x")
    prefix = ordered.select("cls", "comp", "size", F.size("grams").alias("shared"), at).select(
        "cls", "comp", "size", F.col("x.gram").alias("gram"), (F.col("shared") - F.col("i")).cast("bigint").alias("rest")
    )
    # The sets of a linked pair have at least this share of either set in common.
    prefix = written(prefix.where(100 * F.col("rest") >= THRESHOLD_PERCENT * F.col("size")))

    def enough(rest: Column, one: Column, two: Column) -> Column:
        return (100 + THRESHOLD_PERCENT) * rest >= THRESHOLD_PERCENT * (one + two)

    met = prefix.groupBy("gram").agg(*counts, F.min("size").alias("least")).where("low < high").select("gram", "least")
    able = written(
        prefix.join(_large(met), "gram").where(enough(F.col("rest"), F.col("size"), F.col("least"))).drop("least")
    )
    x, y = able.alias("x"), able.alias("y")
    fits = (
        (F.col("x.gram") == F.col("y.gram"))
        & (F.col("x.cls") < F.col("y.cls"))
        & (F.col("x.comp") != F.col("y.comp"))
        & _sizes_fit(F.col("x.size"), F.col("y.size"))
        & enough(F.least("x.rest", "y.rest"), F.col("x.size"), F.col("y.size"))
    )
    return x.join(_large(y), fits).select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct()
