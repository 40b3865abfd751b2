import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from llm_fixtures import SF, awkward, make_docs  # noqa: F401
from pyspark.sql import functions as F

from tidegrid.llm import resample as module
from tidegrid.llm.queries import QUERIES
from tidegrid.llm.resample import BUCKETS, bucket_gains, feature_counts, resample

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    runs = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
    return len(words), [zlib.crc32(r.encode()) % BUCKETS for r in runs]


def plain(docs, target):
    found = [(d, *features(t)) for d, t in docs]
    s, t = Counter(), Counter()
    for _, _, hashed in found:
        s.update(hashed)
    for text in target:
        t.update(features(text)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [
        math.floor(1000 * math.log((t[b] + 1) * (s_all + BUCKETS) / ((s[b] + 1) * (t_all + BUCKETS))))
        for b in range(BUCKETS)
    ]
    rows = []
    for doc_id, words, hashed in found:
        weight = sum(gain[b] for b in hashed) // len(hashed) if hashed else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((words, doc_id, len(hashed), weight, score))
    open_ = sorted((r for r in rows if r[0] >= 20), key=lambda r: (-r[4], r[1] is None, r[1] or 0, r[2], r[3]))
    drawn = 25 * len(open_) // 100
    ranked = [(*r[1:], i + 1 if i < drawn else None) for i, r in enumerate(open_)]
    return sorted(map(repr, ranked + [(*r[1:], None) for r in rows if r[0] < 20]))


def got(result):
    assert result.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert {t for _, t in result.dtypes} == {"bigint"}
    return sorted(repr(tuple(r)) for r in result.collect())


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert got(QUERIES["op11_importance_resampling"](spark, SF)) == plain(docs, target)


@pytest.mark.parametrize("stretch", [64, 1 << 20])
def test_awkward_rows(spark, make_docs, awkward, monkeypatch, stretch):
    monkeypatch.setattr(module, "STRETCH_BYTES", stretch)
    rows = [*awkward, (20, "\x00".join(["abİc D"] * 40)), (21, "x" * 500 + " y" * 30), (None, "z " * 25)]
    docs = make_docs(rows).withColumns({"rank": F.lit("x"), "_open": F.lit(1), "bucket": F.lit(2)})
    target = make_docs([(1, None), (2, "w1 w2 w3 same words")])
    assert got(resample(docs, target)) == plain([r[:2] for r in rows], [None, "w1 w2 w3 same words"])


def test_copies_and_ties(spark, make_docs, monkeypatch):
    monkeypatch.setattr(module, "COPIES_AT_ONCE", 7)
    words = " ".join(f"w{i}" for i in range(30))
    rows = [(5, words)] * 100 + [(i, words) for i in range(60)] + [(None, words)] * 3
    assert got(resample(make_docs(rows), make_docs([(1, words)]))) == plain(rows, [words])


def test_empty_tables(spark, make_docs):
    docs = make_docs([(i, "a b " * 15) for i in range(9)])
    none = make_docs([]).limit(0)
    assert resample(none, docs).count() == 0
    assert got(resample(docs, none)) == plain([(i, "a b " * 15) for i in range(9)], [])
    assert bucket_gains(feature_counts(none), feature_counts(none)).where("gain = 0").count() == BUCKETS
