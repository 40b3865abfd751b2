import pytest
from llm_fixtures import SF, awkward, make_docs  # noqa: F401

import corpus_pipeline
from pyspark.sql import functions as F
from tidegrid.llm.common import written


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF))
        out[name] = docs
    return out


def test_order_and_columns(stages):
    assert list(stages) == ["documents", "quality_rules", "language_id", "near_dedup", "decontamination", "mixing"]
    for name in list(stages)[:-1]:
        assert stages[name].columns == stages["documents"].columns
    counts = [t.count() for t in stages.values()]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]


def test_stages_agree_with_brute_force(stages):
    from test_decontaminate import expected as contaminated
    from test_near_dedup import components
    from test_quality import expected as statistics

    rows = {n: [(r.doc_id, r.text) for r in t.collect()] for n, t in stages.items()}
    bench = stages["documents"].sparkSession.read.parquet(f"{SF}/benchmark.parquet").collect()
    assert not any(statistics(t)[-1] for _, t in rows["quality_rules"])
    first = {i for (i, _, c) in components(rows["language_id"]) if i == c}
    assert {i for i, _ in rows["near_dedup"]} == first
    items = [(b.item_id, b.text) for b in bench]
    assert {i for i, _ in rows["decontamination"]} == {i for i, t in rows["near_dedup"] if not contaminated(t, items)[-1]}
    mix = stages["mixing"].collect()
    assert all(r.copies in (1, 2) and r.taken == r.copies * r["size"] for r in mix)


def test_stages_take_awkward_rows(spark, make_docs, awkward):
    docs = make_docs([(i, t, "en", s) for i, t, _, s in awkward])
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, table, SF)
            assert got.count() <= table.count()


def test_run_equals_its_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stages["mixing"].collect()))


def test_clashing_columns_come_back_as_they_were(spark):
    extra = ("score", "n_words", "_fence", "_id", "_text_key", "row", "coverage", "text_key", "_q_words", "kept")
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    docs = written(docs.select("*", *[F.concat(F.lit(f"{name} "), "doc_id").alias(name) for name in extra]))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns and got.count() > 20, name
        assert got.where(" OR ".join(f"{c} != concat('{c} ', doc_id)" for c in extra)).isEmpty(), name
