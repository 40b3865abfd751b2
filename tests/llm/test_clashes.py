"""Extra columns named like those an operator makes change nothing, and very long values are taken whole."""

import pytest
from llm_fixtures import awkward, make_docs  # noqa: F401
from pyspark.sql import functions as F

from tidegrid.llm.decontaminate import contamination
from tidegrid.llm.lm_score import score_documents
from tidegrid.llm.near_dedup import near_duplicates
from tidegrid.llm.queries import URL_RULES
from tidegrid.llm.tokens import with_token_count
from tidegrid.llm.url_filter import filter_urls, rule_table


def _train(docs):
    return docs.withColumn("is_train", F.coalesce(F.col("doc_id") != 6, F.lit(True)))


OPERATORS = {
    "lm_score": (lambda d, b: score_documents(_train(d)), ["kind", "n_tokens", "score", "batch", "order"]),
    "near_dedup": (lambda d, b: near_duplicates(d), ["cls", "digest", "n_shingles", "component_id", "kept", "_id"]),
    "decontamination": (lambda d, b: contamination(d, b), ["n_words", "n_hit", "matches", "text_key", "item_id", "words"]),
    "token_counts": (lambda d, b: with_token_count(d).select("doc_id", "n_tokens"), ["n_tokens"]),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_change_nothing(make_docs, awkward, spark, name):  # noqa: F811
    operator, clashes = OPERATORS[name]
    items = spark.createDataFrame([("i1", awkward[5][1]), (None, "word"), ("i2", None)], "item_id string, text string")
    docs = make_docs(awkward)
    plain = operator(docs, items)
    clashing = operator(docs.withColumns({c: F.lit("clash") for c in clashes}), items)
    assert clashing.columns == plain.columns
    rows = sorted(map(repr, plain.collect()))
    assert len(rows) == len(awkward) and sorted(map(repr, clashing.collect())) == rows


def test_very_long_urls_are_judged_whole(spark):
    labels, path = "a." * 20_000, "/fr/" + "x/" * 500_000
    rows = [(1, f"http://{labels}com{path}?q"), (2, f"http://{labels}com{path[3:]}"), (3, "x" * 1_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: r for r in filter_urls(pages, rule_table(spark, URL_RULES)).collect()}
    assert (got[1].host, got[1].path, got[1].rule) == (labels + "com", path, "com/fr/")
    assert (got[2].rule, got[3].host, got[3].path, got[3].rule) == (None, "", "", None)
