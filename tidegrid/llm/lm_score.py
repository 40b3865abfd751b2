"""Language-model scores by deleted interpolation of n-gram maximum-likelihood estimates.

A token's probability is a mixture of a uniform distribution and the relative frequencies of the token, of its bigram
and of its trigram. The weights depend on how often the contexts occur: each pair of context-frequency buckets has
its own, learned by expectation-maximisation on held-out training documents from counts of the others.

Documents are packed into batches of tokens. A batch asks for the counts of its distinct n-grams and gets them back in
the same order, so every n-gram crosses the network once per batch and no document does. Requests are dealt by the
hash of the n-gram into buckets of about ``BUCKET_KEYS``; a frequent n-gram is one key per batch, as any other.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import mixed, pieces, text_bytes, word_hashes, written

BATCH_TOKENS = 1_000_000
BUCKET_KEYS = 2_000_000
#: One in so many training documents is held out to learn the weights.
HELD_PART = 10
LEVELS = 12
ITERATIONS = 40
#: Tokens' worth of the overall weights that every bucket's own are mixed with, and the least uniform weight.
PRIOR_TOKENS = 20.0
LEAST_UNIFORM = 1e-4
_OCTAVES = 40
_STRETCH = 1 << 17

_END, _START = (np.uint64(0xA24BAED4963EE407 + k) for k in (0, 2))
_FACTORS = mixed(np.arange(11, 14, dtype=np.uint64)) | np.uint64(1)
RETAINED, HELD, TEST = 0, 1, 2


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers byte by byte of equal weight, compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return bytes([values.itemsize]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    size = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(f"u{size}")


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data).astype(np.uint64), dtype=np.uint64)


def _pack_counts(counts: np.ndarray) -> bytes:
    return _pack(counts.astype(np.min_scalar_type(int(counts.max(initial=0)))))


_BATCHES = "batch string, kind int, tokens bigint, docs bigint, doc_ids binary, no_id binary, lengths binary, words binary, ids binary"


class _Batch:
    """Documents of one kind being packed."""

    def __init__(self, kind: int) -> None:
        self.kind, self.tokens = kind, 0
        self.ids: list[np.ndarray] = []
        self.no_id: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.hashes: list[np.ndarray] = []

    def add(self, ids: np.ndarray, no_id: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> None:
        self.ids.append(ids)
        self.no_id.append(no_id)
        self.lengths.append(lengths)
        self.hashes.append(hashes)
        self.tokens += len(hashes)

    def row(self) -> pa.RecordBatch:
        words, ids = np.unique(np.concatenate(self.hashes), return_inverse=True)
        lengths = np.concatenate(self.lengths)
        columns = {
            "batch": uuid.uuid4().hex,
            "kind": pa.scalar(self.kind, pa.int32()),
            "tokens": self.tokens,
            "docs": len(lengths),
            "doc_ids": _pack(np.concatenate(self.ids)),
            "no_id": _pack(np.concatenate(self.no_id)),
            "lengths": _pack(lengths),
            "words": _pack_sorted(words),
            "ids": _pack(ids.astype(np.uint32)),
        }
        return pa.RecordBatch.from_pydict({k: pa.array([v]) for k, v in columns.items()})


def _pack_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_batches: dict[int, _Batch] = {}
    for batch in batches:
        for part in pieces(batch, "text"):
            hashes, bounds = word_hashes(*text_bytes(part.column("text")))
            # Every document ends with the end token.
            hashes = np.insert(hashes, bounds[1:], _END)
            lengths = np.diff(bounds) + 1
            ids = part.column("doc_id").fill_null(0).to_numpy().astype(np.int64)
            no_id = part.column("doc_id").is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
            kinds = part.column("kind").to_numpy()
            of = np.repeat(kinds, lengths)
            for kind in np.unique(kinds):
                own = kinds == kind
                held = open_batches.setdefault(int(kind), _Batch(int(kind)))
                held.add(ids[own], no_id[own], lengths[own].astype(np.int64), hashes[of == kind])
                if held.tokens >= BATCH_TOKENS:
                    yield open_batches.pop(int(kind)).row()
    for held in open_batches.values():
        yield held.row()


def _n_grams(words: np.ndarray, lengths: np.ndarray, order: int) -> np.ndarray:
    """Keys of the n-gram that ends at each token; starts of documents are filled up with the start token."""
    if order == 1:
        return words
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    key = words * _FACTORS[0]
    before = words
    for k in range(1, order):
        before = np.concatenate([[_START], before[:-1]]).astype(np.uint64)
        before[starts] = _START
        key = key + before * _FACTORS[k]
    return mixed(key)


def _tokens(row: dict) -> tuple[np.ndarray, np.ndarray]:
    words = _unpack_sorted(row["words"])
    return words[_unpack(row["ids"])], _unpack(row["lengths"]).astype(np.int64)


_REQUESTS = "part int, batch string, kind int, keys binary, counts binary"


def _requests(batches: DataFrame, order: int, buckets: int) -> DataFrame:
    def ask(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for row in batch.to_pylist():
                words, lengths = _tokens(row)
                keys, counts = np.unique(_n_grams(words, lengths, order), return_counts=True)
                parts = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
                cuts = np.searchsorted(parts, np.arange(buckets + 1, dtype=np.uint64))
                asked = [(b, cuts[b], cuts[b + 1]) for b in range(buckets) if cuts[b] < cuts[b + 1]]
                for first in range(0, len(asked), 256):
                    some = asked[first : first + 256]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([b for b, _, _ in some], pa.int32()),
                            pa.array([row["batch"]] * len(some)),
                            pa.array([row["kind"]] * len(some), pa.int32()),
                            pa.array([_pack_sorted(keys[s:e]) for _, s, e in some], pa.binary()),
                            pa.array([_pack_counts(counts[s:e]) for _, s, e in some], pa.binary()),
                        ],
                        ["part", "batch", "kind", "keys", "counts"],
                    )

    return batches.select("batch", "kind", "lengths", "words", "ids").mapInArrow(ask, _REQUESTS)


_ANSWERS = "batch string, part int, total binary, retained binary, distinct bigint"


def _answer(table: pa.Table) -> pa.Table:
    """Counts of one bucket's n-grams over all batches, for every batch in the order of its request."""
    rows = table.to_pylist()
    keys = [_unpack_sorted(r["keys"]) for r in rows]
    ends = np.cumsum([len(k) for k in keys])
    known, where = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.concatenate([_unpack(r["counts"]).astype(np.float64) for r in rows])
    kinds = np.repeat([r["kind"] for r in rows], np.diff(ends, prepend=0))
    retained = np.bincount(where, counts * (kinds == RETAINED), len(known)).astype(np.uint64)
    total = np.bincount(where, counts * (kinds != TEST), len(known)).astype(np.uint64)
    slices = np.split(where, ends[:-1])
    part = rows[0]["part"]
    return pa.table(
        {
            "batch": pa.array([r["batch"] for r in rows] + [None], pa.string()),
            "part": pa.array([part] * (len(rows) + 1), pa.int32()),
            "total": pa.array([_pack_counts(total[s]) for s in slices] + [None], pa.binary()),
            "retained": pa.array(
                [_pack_counts(retained[s]) if r["kind"] == HELD else None for r, s in zip(rows, slices, strict=True)]
                + [None],
                pa.binary(),
            ),
            "distinct": pa.array([None] * len(rows) + [int((total > 0).sum())], pa.int64()),
        }
    )


def _answered(rows: list[dict], order: int, field: str) -> np.ndarray:
    own = sorted((r for r in rows if r["order"] == order), key=lambda r: r["part"])
    return np.concatenate([_unpack(r[field]).astype(np.float64) for r in own])


def _counts(row: dict, field: str, documents: float) -> dict[str, np.ndarray]:
    """For every token the counts of its n-grams and of their contexts."""
    words, lengths = _tokens(row)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    found = {}
    for order in (1, 2, 3):
        _, where = np.unique(_n_grams(words, lengths, order), return_inverse=True)
        found[order] = _answered(row["answers"], order, field)[where]

    def context(counts: np.ndarray) -> np.ndarray:
        before = np.concatenate([[0.0], counts[:-1]])
        before[starts] = documents
        return before

    return {
        "c1": found[1], "c2": found[2], "c3": found[3],
        "h2": context(found[1]), "h3": context(found[2]), "lengths": lengths,
    }


def _levels(counts: np.ndarray) -> np.ndarray:
    """Context-frequency bucket: 0 for none, then one per power of four."""
    return np.where(counts > 0, np.minimum(np.log2(np.maximum(counts, 1)) // 2 + 1, LEVELS - 1), 0).astype(np.int64)


def _estimates(found: dict[str, np.ndarray], tokens: float) -> np.ndarray:
    """Maximum-likelihood estimates of orders 1 to 3, one row per token; 0 where the context is unknown."""
    one = found["c1"] / max(tokens, 1.0)
    two = np.divide(found["c2"], found["h2"], out=np.zeros_like(one), where=found["h2"] > 0)
    three = np.divide(found["c3"], found["h3"], out=np.zeros_like(one), where=found["h3"] > 0)
    return np.stack([one, two, three], axis=1)


_CELLS = "cell bigint, n bigint, log_1 double, log_2 double, log_3 double"


def learn_weights(cells: dict[str, np.ndarray], vocabulary: int) -> np.ndarray:
    """Mixture weights ``[bucket, order 0 .. 3]`` by expectation-maximisation.

    ``cells`` are held-out tokens by bucket and octave of each estimate, with the mean of each estimate's logarithm; they
    are at most ``LEVELS ** 2 * (_OCTAVES + 1) ** 3``, whatever the corpus.
    """
    buckets = LEVELS * LEVELS
    weights = np.full((buckets, 4), 0.25)
    n = cells["n"].astype(np.float64)
    if len(n):
        of = cells["bucket"]
        p = np.stack([np.full(len(n), 1.0 / (vocabulary + 1)), *(cells[f"p{k}"] for k in (1, 2, 3))], axis=1)
        overall = np.full(4, 0.25)
        for _ in range(ITERATIONS):
            share = overall * p
            overall = (share / share.sum(axis=1, keepdims=True) * n[:, None]).sum(axis=0) / n.sum()
        overall = np.maximum(overall, LEAST_UNIFORM)
        overall /= overall.sum()
        weights[:] = overall
        for _ in range(ITERATIONS):
            share = weights[of] * p
            share = share / share.sum(axis=1, keepdims=True) * n[:, None]
            gained = np.stack([np.bincount(of, share[:, k], buckets) for k in range(4)], axis=1)
            gained += PRIOR_TOKENS * overall
            weights = gained / gained.sum(axis=1, keepdims=True)
    # An unknown context has no estimate: its weight goes to the lower orders.
    h2, h3 = np.divmod(np.arange(buckets), LEVELS)
    weights[h2 == 0, 2] = 0
    weights[h3 == 0, 3] = 0
    weights[:, 0] = np.maximum(weights[:, 0], LEAST_UNIFORM)
    return weights / weights.sum(axis=1, keepdims=True)


_SCORES = (
    "doc_id bigint, kind int, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
)


def score_documents(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text, is_train``): ``doc_id, is_train, n_tokens, n_known, train_tokens,
    base_score, score``.

    The model learns from rows with ``is_train``; NULL counts as not. Tokens are the lower-cased words (A-Z) and one end
    token, so NULL and empty texts have one token. ``score`` is the mixture's log10 probability of all tokens,
    ``base_score`` that of add-one-half unigrams. Without training rows both are 0. Repeated rows count and are
    scored one by one; an empty table gives no rows. Other columns are ignored, whatever their names. A very long text counts whole; it is one
    batch, so a task holds its words. N-grams are told apart by 64-bit hashes.
    """
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % (5 * HELD_PART) < 5
    kind = F.when(~F.coalesce("is_train", F.lit(False)), TEST).when(held, HELD).otherwise(RETAINED)
    marked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", kind.alias("kind"))
    batches = written(marked.mapInArrow(_pack_documents, _BATCHES))
    sizes = {r["kind"]: r for r in batches.groupBy("kind").agg(F.sum("tokens").alias("t"), F.sum("docs").alias("d")).collect()}
    size = lambda name, *kinds: sum(sizes[k][name] for k in kinds if k in sizes)
    train_tokens, train_docs = size("t", RETAINED, HELD), size("d", RETAINED, HELD)
    buckets = max(1, -(-size("t", RETAINED, HELD, TEST) // BUCKET_KEYS))
    answers = None
    for order in (1, 2, 3):
        asked = _requests(batches, order, buckets)
        told = written(asked.groupBy("part").applyInArrow(_answer, _ANSWERS)).withColumn("order", F.lit(order))
        answers = told if answers is None else answers.unionByName(told)
    vocabulary = answers.where("order = 1").agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0]
    answer = F.struct("order", "part", "total", "retained")
    by_batch = answers.where("batch IS NOT NULL").groupBy("batch").agg(F.collect_list(answer).alias("answers"))
    ready = batches.join(by_batch.hint("merge"), "batch")

    retained_tokens, retained_docs = size("t", RETAINED), size("d", RETAINED)

    def cells(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                found = _counts(row, "retained", retained_docs)
                p = _estimates(found, retained_tokens)
                logs = np.log2(np.maximum(p, 2.0**-_OCTAVES))
                octaves = np.where(p > 0, np.minimum(-np.floor(logs), _OCTAVES - 1), _OCTAVES).astype(np.int64)
                cell = _levels(found["h2"]) * LEVELS + _levels(found["h3"])
                for k in range(3):
                    cell = cell * (_OCTAVES + 1) + octaves[:, k]
                keys, where, counts = np.unique(cell, return_inverse=True, return_counts=True)
                sums = [np.bincount(where, logs[:, k], len(keys)) for k in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(counts), *map(pa.array, sums)], ["cell", "n", "log_1", "log_2", "log_3"]
                )

    counted = ready.where(F.col("kind") == HELD).mapInArrow(cells, _CELLS).groupBy("cell")
    table = counted.agg(*[F.sum(c).alias(c) for c in ("n", "log_1", "log_2", "log_3")]).toArrow()
    code, n = table.column("cell").to_numpy(), table.column("n").to_numpy()
    learned = {"n": n}
    for k in (3, 2, 1):
        code, octave = np.divmod(code, _OCTAVES + 1)
        mean = np.exp2(table.column(f"log_{k}").to_numpy() / np.maximum(n, 1))
        learned[f"p{k}"] = np.where(octave == _OCTAVES, 0.0, mean)
    learned["bucket"] = code
    weights = learn_weights(learned, vocabulary)

    def score(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                found = _counts(row, "total", train_docs)
                chance = np.empty(len(found["c1"]))
                # In stretches: the weights of all tokens at once would be the largest array by far.
                for at in range(0, len(chance), _STRETCH):
                    few = {k: v[at : at + _STRETCH] for k, v in found.items() if k != "lengths"}
                    own = weights[_levels(few["h2"]) * LEVELS + _levels(few["h3"])]
                    mixture = own[:, 0] / (vocabulary + 1) + (own[:, 1:] * _estimates(few, train_tokens)).sum(axis=1)
                    chance[at : at + _STRETCH] = np.minimum(mixture, 1.0)
                base = (found["c1"] + 0.5) / (train_tokens + 0.5 * (vocabulary + 1))
                starts = np.concatenate([[0], np.cumsum(found["lengths"])[:-1]]).astype(np.int64)
                ids = pa.array(_unpack(row["doc_ids"]).view(np.int64), mask=_unpack(row["no_id"]).astype(bool))
                rows_out = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array([row["kind"]] * rows_out, pa.int32()),
                        pa.array(found["lengths"]),
                        pa.array(np.add.reduceat((found["c1"] > 0).astype(np.int64), starts)),
                        pa.array([train_tokens] * rows_out, pa.int64()),
                        pa.array(np.add.reduceat(np.log10(base), starts)),
                        pa.array(np.add.reduceat(np.log10(chance) if train_tokens else 0 * base, starts)),
                    ],
                    ["doc_id", "kind", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    scored = ready.mapInArrow(score, _SCORES)
    return scored.select(
        "doc_id", (F.col("kind") != TEST).alias("is_train"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
