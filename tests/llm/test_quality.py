import random
import re
from collections import Counter

import pytest

from llm_fixtures import awkward, make_docs  # noqa: F401
from tidegrid.llm.quality import quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    n = len(words)
    return (
        n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeated, len(inside),
        n < 50 or 100 * len(inside) > 50 * n,
    )


def random_texts(count):
    rng = random.Random(3)
    for i in range(count):
        vocabulary = [rng.choice("abcé#$|") * rng.randint(1, 3) + str(k) for k in range(rng.choice([3, 30, 3000]))]
        yield 100 + i, "".join(rng.choice(vocabulary) + rng.choice(["\n", " ", "  ", "\t"]) for _ in range(rng.randint(0, 400)))


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(i % 3 > 0), int(i % 7 == 0)) for i in range(100, 150)] + [(100, 0, 0), (None, 1, 0), (101, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_statistics_equal_brute_force(make_docs, labels, awkward):
    docs = make_docs([*awkward, *random_texts(80)]).selectExpr("*", "'x' AS n_words", "1 AS _q_words")
    for r in quality_rules(docs, labels).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == expected(r.text), r.doc_id
        assert not (r.kept and r.base_failed)


def test_ratio_equals_brute_force(make_docs, labels):
    import math

    import xxhash

    rows = list(random_texts(40))
    good_ids = {i for i in range(100, 150) if i % 3 and i % 7} - {100, 101}

    def spark_hash(values):
        seed = 42
        for v in values:
            data = v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True)
            seed = xxhash.xxh64_intdigest(data, seed=seed & (2**64 - 1))
        return seed - 2**64 if seed >= 2**63 else seed

    def grams(text):
        one = [spark_hash([w]) for w in WORD.findall(text)]
        return [h % 64 for h in one + [spark_hash(p) for p in zip(one, one[1:])]]

    raw, good = Counter(), Counter()
    for i, t in rows:
        raw.update(grams(t))
        if i in good_ids:
            good.update(grams(t))
    nr, ng = sum(raw.values()), sum(good.values())
    ratio = [round(1e6 * (math.log((good[b] + 1) / (ng + 64)) - math.log((raw[b] + 1) / (nr + 64)))) for b in range(64)]
    labels = labels.where("doc_id <> 101 OR quality IS NOT NULL")
    good_ids_with_101 = good_ids | ({101} if 101 % 3 and 101 % 7 else set())
    if good_ids_with_101 != good_ids:
        good.update(grams(dict(rows)[101]))
        ng = sum(good.values())
        ratio = [round(1e6 * (math.log((good[b] + 1) / (ng + 64)) - math.log((raw[b] + 1) / (nr + 64)))) for b in range(64)]
    for r in quality_rules(make_docs(rows), labels, buckets=64).collect():
        g = grams(r.text)
        want = sum(ratio[b] for b in g) / len(g) / 1e6 if g else 0.0
        assert r.score == pytest.approx(want, abs=1e-9)
        assert r.kept == (not r.base_failed and r.score >= -0.055)


def test_without_labels_only_base_rules_decide(make_docs, labels):
    docs = make_docs(list(random_texts(20)))
    assert all(r.kept != r.base_failed for r in quality_rules(docs, labels.limit(0)).collect())
    assert quality_rules(docs.limit(0), labels).count() == 0


def test_junk_goes_and_prose_stays(spark):
    from llm_fixtures import SF

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    judged = quality_rules(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("NOT base_failed").collect()
    junk = [r.kept for r in judged if r.n_symbols > 0.1 * r.n_words]
    clean = [r.kept for r in judged if r.n_symbols == 0 and "!! " not in r.text]
    assert sum(junk) <= 0.05 * len(junk) and sum(clean) >= 0.93 * len(clean)


def test_learned_threshold_rejects_noise_of_every_language(spark):
    from tidegrid.llm.queries import QUERIES

    sf = "/root/testdata/sf0.1"
    langs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").distinct()
    judged = QUERIES["op6_quality_rules"](spark, sf).where("NOT base_failed").join(langs, "doc_id").collect()
    noise = [r.kept for r in judged if r.n_symbols > 0.2 * r.n_words and r.lang in ("de", "es", "fr")]
    clean = [r.kept for r in judged if r.n_symbols == 0]
    print("noise kept", sum(noise), len(noise), "clean rejected", len(clean) - sum(clean), len(clean))
    assert noise and not any(noise) and sum(clean) >= 0.93 * len(clean)


def test_target_documents_are_scored_without_their_own_grams(make_docs, labels):
    import math

    from tidegrid.llm.quality import _counts, held_out_scores

    rows = [(103, " ".join(f"a{i % 40}" for i in range(60))), (104, " ".join(f"b{i % 50}" for i in range(70))), (7, "c " * 60)]
    docs = make_docs(rows)
    others = quality_rules(docs, labels.where("doc_id = 103"), buckets=64).where("doc_id = 104").first().score
    full = _counts(docs, labels.where("doc_id IN (103, 104)"), 64)
    got = held_out_scores(docs, labels.where("doc_id IN (103, 104)"), full, 64, 1.0, 50).collect()
    assert len(got) == 2 and any(math.isclose(r.score, others, abs_tol=2e-6) for r in got)
