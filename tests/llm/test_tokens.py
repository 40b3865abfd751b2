import pytest
from llm_fixtures import SF, awkward, make_docs  # noqa: F401
from pyspark.sql import functions as F

from tidegrid.llm import tokens
from tidegrid.llm.tokens import answer_limits, length_at, length_histogram, suffix_sums, with_token_count


@pytest.fixture(scope="module")
def lengths(spark):
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(300)
    encode = tokens._encoding(tokens.TOKENIZERS, tokens.VOCABULARY)
    return texts, [len(encode.encode_ordinary(r.text or "")) for r in texts.collect()], encode


def test_sums_equal_brute_force(lengths, monkeypatch):
    texts, want, _ = lengths
    monkeypatch.setattr(tokens, "BLOCK", 64)
    sums = suffix_sums(length_histogram(with_token_count(texts)))
    rows = sums.collect()
    assert len(rows) == len(set(want))
    for r in rows:
        n = r.n_tokens
        assert (r.n_docs, r.docs_from, r.docs_below) == (want.count(n), sum(x >= n for x in want), sum(x < n for x in want))
        assert (r.tokens_from, r.truncated_total) == (sum(x for x in want if x >= n), sum(min(x, n) for x in want))
    asked = [0, 1, 63, 64, 100, 512, 513, 5000, max(want), 10**6]
    limits = texts.sparkSession.createDataFrame([(x,) for x in [*asked, 64, None]], "limit long")
    got = {r["limit"]: (r.docs_over, r.truncated_total) for r in answer_limits(sums, limits).collect()}
    assert got == {x: (sum(n > x for n in want), sum(min(n, x) for n in want)) for x in asked}
    ordered = sorted(want)
    for share in (0.1, 0.5, 0.99, 1.0):
        reached = next(x for i, x in enumerate(ordered) if i + 1 >= share * len(ordered))
        assert sums.agg(length_at(share).alias("x")).first().x == max(y for y in want if y == reached)


def test_whole_texts_round_trip(lengths):
    texts, _, encode = lengths
    for r in texts.limit(20).collect():
        assert encode.decode(encode.encode_ordinary(r.text)) == r.text


def test_awkward_rows(make_docs, awkward):
    got = with_token_count(make_docs(awkward).withColumn("n_tokens", F.lit("x"))).collect()
    by = {r.doc_id: r.n_tokens for r in got}
    assert by[1] == by[2] == 0 and by[5] > 60_000 and len(got) == len(awkward)
    assert suffix_sums(length_histogram(with_token_count(make_docs(awkward).limit(0)))).count() == 0
