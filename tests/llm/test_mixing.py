import pytest
from pyspark.sql import functions as F

from llm_fixtures import awkward, make_docs  # noqa: F401
from tidegrid.llm import mixing
from tidegrid.llm.mixing import mix_sources, source_targets, with_size


def sizes(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, size long")


def water_fill(totals, weights=(3, 1, 2)):
    """Targets by resharing the excess again and again."""
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(totals.values()), set(names)
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] >= 2 * totals[s]}
        if not full:
            return target | {s: share * weight[s] for s in open_}
        for s in full:
            target[s] = 2.0 * totals[s]
            left -= target[s]
        open_ -= full
    return target


@pytest.mark.parametrize("totals", [
    {"a": 100, "b": 50, "c": 10, None: 5}, {"a": 1, "b": 1000, "c": 1}, {"x": 7}, {"a": 0, "b": 9}, {"a": 5, "é": 50, "B": 500},
])
def test_targets_equal_water_filling(spark, totals):
    rows = [(i, s, t) for i, (s, t) in enumerate(totals.items())]
    got = {r.source: r.target for r in source_targets(sizes(spark, rows)).collect()}
    assert got == pytest.approx(water_fill(totals))


def test_mix_meets_targets_and_limits(spark):
    rows = [(i, f"s{i % 5}" if i % 3 else "hot", 20 + i * 7919 % 400) for i in range(6000)]
    table = sizes(spark, rows).withColumn("taken", F.lit("clash"))
    taken = mix_sources(table)
    again = mix_sources(table.repartition(7))
    assert sorted(map(tuple, taken.collect())) == sorted(map(tuple, again.collect()))
    for r in taken.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect():
        assert abs(r.t - r.g) <= 210
    assert taken.where("taken > 2 * size OR taken % greatest(size, 1) <> 0").count() == 0


def test_cells_do_not_change_the_draw(spark, monkeypatch):
    rows = [(i, f"s{i % 3}", 5 + i % 50) for i in range(900)]
    fine = sorted(map(tuple, mix_sources(sizes(spark, rows)).collect()))
    monkeypatch.setattr(mixing, "CELLS", 3)
    assert sorted(map(tuple, mix_sources(sizes(spark, rows)).collect())) == fine


def test_inclusion_weights_make_probabilities_unequal(spark):
    rows = [(i, "a" if i % 2 else "b", 10) for i in range(4000)]
    table = sizes(spark, rows).withColumn("w", F.when(F.col("doc_id") % 4 < 2, 1.0).otherwise(3.0))
    got = mix_sources(table, budget_ratio=0.5, inclusion="w").groupBy("source", "w").agg(F.avg("copies").alias("c")).collect()
    by = {(r.source, r.w): r.c for r in got}
    assert by["a", 3.0] / by["a", 1.0] == pytest.approx(3, rel=0.2)


def fill_inclusion(rows, target, cap=2.0):
    """Expected copies by giving out what rows at the limit leave, again and again."""
    free, left, got = dict(rows), target, {}
    while free:
        scale = left / sum(w * n for w, n in free.values())
        full = {i for i, (w, _) in free.items() if w * scale >= cap}
        if not full:
            return got | {i: w * scale for i, (w, _) in free.items()}
        got |= {i: cap for i in full}
        left -= cap * sum(free.pop(i)[1] for i in full)
    return got


def test_excess_of_rows_at_the_limit_is_reshared(spark):
    """Few heavy rows reach two copies; the rest of their share goes to the light ones and the target is met."""
    rows = [(i, "a", 10) for i in range(100)]
    table = sizes(spark, rows).withColumn("w", F.when(F.col("doc_id") < 20, 1000.0).otherwise(1.0))
    got = mix_sources(table, inclusion="w").collect()
    assert sum(r.taken for r in got) == 1500 and all(r.copies == 2 for r in got if r.w == 1000.0)


def test_inclusion_against_resharing_in_steps(spark):
    rows = [(i, f"s{i % 2}", 1 + i * 7919 % 300, float(1 + i % 7) ** 4) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, source string, size long, w double")
    got = {r.doc_id: r for r in mix_sources(table, inclusion=F.col("w")).collect()}
    for source in ("s0", "s1"):
        own = {i: (float(f"{w:.3g}"), n) for i, s, n, w in rows if s == source}
        want = fill_inclusion(own, next(r.target for r in got.values() if r.source == source))
        for i, copies in want.items():
            assert int(copies + 1e-9) <= got[i].copies <= int(copies - 1e-9) + 1
        assert abs(sum(got[i].taken for i in own) - next(got[i].target for i in own)) <= 150


def test_useless_inclusion_weights_count_as_zero(spark):
    weights = [None, float("nan"), float("inf"), -1.0, 0.0, 5e-324, 3.0]
    rows = [(i, "a" if i % 2 else None, 10, weights[i % 7]) for i in range(70)]
    table = spark.createDataFrame(rows, "doc_id long, source string, size long, w double")
    got = mix_sources(table, inclusion="w").collect()
    assert len(got) == 70 and all(r.copies == (2 if r.w == 3.0 else 0) for r in got)


def test_awkward_rows(make_docs, awkward):
    got = mix_sources(with_size(make_docs(awkward))).collect()
    assert len(got) == len(awkward)
    assert {r.doc_id: r["size"] for r in got if r.doc_id in (1, 2, 3, 4)} == {1: 0, 2: 0, 3: 0, 4: 1}
    assert mix_sources(with_size(make_docs(awkward)).limit(0)).count() == 0
    assert mix_sources(with_size(make_docs(awkward)), inclusion=mixing.by_length()).count() == len(awkward)
    assert mix_sources(with_size(make_docs(awkward)).limit(0), inclusion=mixing.by_length()).count() == 0
