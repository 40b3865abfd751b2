import hashlib
import random
import re

import pytest

from llm_fixtures import awkward, make_docs  # noqa: F401
from tidegrid.llm.decontaminate import contamination, phrase_matches

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def expected(text, items, window=13):
    w, hit, ids = words(text), set(), set()
    for item_id, item in items:
        v = words(item)
        n = min(len(v), window)
        phrases = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i : i + n]) in phrases:
                hit.update(range(i, i + n))
                if item_id is not None:
                    ids.add(str(item_id))
    names = ",".join(sorted(ids))
    return len(w), len(hit), len(ids), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


@pytest.fixture(scope="module")
def case():
    rng = random.Random(5)
    common, rare = ["the", "of", "a"], [f"r{i}" for i in range(60)]
    draw = lambda n: " ".join(rng.choice(common if rng.random() < 0.8 else rare) for _ in range(n))
    items = [(i, draw(rng.randint(1, 40))) for i in range(12)]
    items += [(20, "the"), (20, "a a a a"), (21, None), (22, ""), (None, draw(20)), (3, items[3][1]), (30, "the of " * 20)]
    docs = []
    for i in range(60):
        text = draw(rng.randint(0, 120))
        for _ in range(rng.randint(0, 2)):
            item = (rng.choice(items)[1] or "").upper().replace(" ", rng.choice([" ", ", ", "\n"]))
            text = f"{text} {item}! {draw(rng.randint(0, 30))}"
        docs.append((100 + i, text))
    return docs, items


@pytest.mark.parametrize("window", [13, 4])
def test_equals_brute_force(spark, make_docs, awkward, case, window):
    docs, items = case
    rows = [*docs, *awkward]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id")
    got = contamination(make_docs(rows), bench, window).collect()
    assert len(got) == len(rows)
    texts = dict((r[0], r[1]) for r in rows)
    for r in got:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == expected(texts[r.doc_id], items, window)


def test_empty_benchmark_and_documents(spark, make_docs, case):
    bench = spark.createDataFrame([], "item_id long, text string")
    docs = make_docs(case[0])
    assert {r.n_hit for r in contamination(docs, bench).collect()} == {0}
    full = spark.createDataFrame(case[1], "item_id long, text string")
    assert contamination(docs.limit(0), full).count() == 0


def test_proximity_allows_different_words(spark, make_docs):
    item = " ".join(f"t{i}" for i in range(20))
    near = " ".join("x" if i == 9 else f"t{i}" for i in range(20))
    far = " ".join("x" if i % 5 == 2 else f"t{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = make_docs([(1, f"a b {near} c"), (2, far), (3, f"z {item}")])
    exact = {r.doc_id: r.matches for r in phrase_matches(docs, bench).collect()}
    loose = {r.doc_id: r.matches for r in phrase_matches(docs, bench, slack=1).collect()}
    assert not exact[1] and not exact[2] and exact[3][0]["first"] == 1 and exact[3][0]["end"] == 21
    assert (min(m["first"] for m in loose[1]), max(m["end"] for m in loose[1])) == (2, 22) and not loose[2] and loose[3]
