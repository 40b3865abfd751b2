import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_fixtures import SF, awkward, make_docs  # noqa: F401
from pyspark.sql import functions as F

from tidegrid.llm import lm_score
from tidegrid.llm.common import is_bucket
from tidegrid.llm.lm_score import learn_weights, score_documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [w.translate(LOWER) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + ["</s>"]


def level(count):
    return min(int(math.log2(count)) // 2 + 1, lm_score.LEVELS - 1) if count else 0


def brute_force(rows, train, weights):
    """Base and model scores from plain counters."""
    grams = {n: Counter() for n in (1, 2, 3)}
    padded = lambda t: ["<s>", "<s>", *tokens(t)]
    documents = sum(train)
    for (_, text, *_), known in zip(rows, train):
        p = padded(text)
        for i in range(2, len(p)) if known else ():
            for n in grams:
                grams[n][tuple(p[i - n + 1 : i + 1])] += 1
    total, vocabulary = sum(grams[1].values()), len(grams[1])
    for _, text, *_ in rows:
        p, base, score = padded(text), 0.0, 0.0
        for i in range(2, len(p)):
            c1, c2, c3 = (grams[n][tuple(p[i - n + 1 : i + 1])] for n in (1, 2, 3))
            h2 = grams[1][(p[i - 1],)] if i > 2 else documents
            h3 = grams[2][tuple(p[i - 2 : i])] if i > 2 else documents
            w = weights[level(h2) * lm_score.LEVELS + level(h3)]
            parts = [1 / (vocabulary + 1), c1 / total, c2 / h2 if h2 else 0, c3 / h3 if h3 else 0]
            score += math.log10(sum(a * b for a, b in zip(w, parts)))
            base += math.log10((c1 + 0.5) / (total + 0.5 * (vocabulary + 1)))
        yield len(p) - 2, sum(grams[1][(t,)] > 0 for t in p[2:]), total, base, score


def test_equals_brute_force(spark, make_docs, awkward, monkeypatch):
    learned = []
    monkeypatch.setattr(lm_score, "learn_weights", lambda *a: learned.append(learn_weights(*a)) or learned[-1])
    monkeypatch.setattr(lm_score, "BATCH_TOKENS", 3000)
    monkeypatch.setattr(lm_score, "BUCKET_KEYS", 20_000)
    sample = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id BETWEEN 10 AND 90").select("doc_id", "text").collect()
    rows = [*map(tuple, sample), *((i, t) for i, t, *_ in awkward)]
    docs = make_docs(rows).withColumn("is_train", F.when(F.col("doc_id") != 8, ~is_bucket("doc_id", 5, 1)))
    train = [i != 8 and i is not None and zlib.crc32(str(i).encode()) % 5 != 1 for i, _ in rows]
    docs = docs.withColumn("is_train", F.when(F.col("doc_id").isNull(), False).otherwise(F.col("is_train")))
    got = score_documents(docs).collect()
    want = list(brute_force(rows, train, learned[0]))
    key = lambda r: (str(r[0]), r[1])
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    want = sorted(((i, *w) for (i, _), w in zip(rows, want)), key=key)
    for g, w in zip(got, want, strict=True):
        assert g[:4] == w[:4] and g[4:] == pytest.approx(w[4:], rel=1e-9, abs=1e-9)


def test_held_out_documents_score_above_unigrams(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("is_train", ~is_bucket("doc_id", 5, 1))
    total = score_documents(docs).where("NOT is_train").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert total.s > 0.85 * total.b


def test_em_raises_likelihood_and_finds_the_better_order():
    n = np.array([900, 100])
    bucket = np.full(2, 5 * lm_score.LEVELS + 5)
    cells = {"n": n, "bucket": bucket, "p1": np.array([0.01, 0.01]), "p2": np.array([0.5, 0.0]), "p3": np.array([0.0, 0.4])}
    w = learn_weights(cells, 1000)[bucket[0]]
    assert w[2] == pytest.approx(0.87, abs=0.05) and w.sum() == pytest.approx(1)
    empty = learn_weights({"n": np.array([], int)}, 10)
    assert np.allclose(empty.sum(axis=1), 1) and (empty[: lm_score.LEVELS, 2] == 0).all()


def test_without_training_rows_and_empty_table(make_docs):
    docs = make_docs([(1, "a b"), (2, None)]).withColumn("is_train", F.lit(False))
    assert {(r.base_score, r.score, r.train_tokens) for r in score_documents(docs).collect()} == {(0.0, 0.0, 0)}
    assert score_documents(docs.limit(0)).count() == 0
