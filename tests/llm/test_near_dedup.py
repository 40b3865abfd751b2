import random
import re

import numpy as np
import pyarrow as pa
import pytest
from llm_fixtures import awkward, make_docs  # noqa: F401

from tidegrid.llm import common, near_dedup
from tidegrid.llm.near_dedup import REGISTERS, connect, estimate, near_duplicates, sketch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = [x.translate(LOWER) for x in WORD.findall(text or "")]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(rows):
    """Brute force over all pairs."""
    sets = [shingles(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[root(i)] = root(j)
    smallest = {}
    for i, (doc_id, *_) in enumerate(rows):
        if doc_id is not None:
            smallest[root(i)] = min(doc_id, smallest.get(root(i), doc_id))
    return [(doc_id, len(sets[i]), smallest.get(root(i))) for i, (doc_id, *_) in enumerate(rows)]


def copies(seed=1):
    """Groups of near copies of different closeness, a group around a hub, and texts that share a long passage."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    rows, passage = [], [word() for _ in range(60)]

    def changed(base, times):
        text = list(base)
        for _ in range(times):
            text[rng.randrange(len(text))] = word()
        return " ".join(text).replace("w", rng.choice("wW"))

    for size, times in ((2, 1), (3, 3), (5, 2), (60, 2), (40, 4)):
        base = [word() for _ in range(120)]
        rows += [" ".join(base)] + [changed(base, rng.randint(0, times)) for _ in range(size)]
    for _ in range(80):
        own = [word() for _ in range(40)]
        rows.append(" ".join(own[:20] + passage + own[20:]))
    rows += ["a b c", "A B  c", "a b c d", "x y z u v", "x y z u v"]
    rng.shuffle(rows)
    return [(1000 + i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("small", [24, 4])
def test_equals_brute_force(make_docs, awkward, monkeypatch, small):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    rows = [*copies(), *((i, t) for i, t, *_ in awkward)]
    got = near_duplicates(make_docs(rows)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(components(rows), key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def template_pages(seed=5):
    """Pages that share most of their words, all alike but unlinked, and near copies among them just above the threshold."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**9)}"
    passage, rows = [word() for _ in range(166)], []
    for i in range(300):
        own = [word() for _ in range(34)]
        rows.append(passage + own)
        if i % 2:
            rows.append(passage + own[:7] + [word() for _ in range(27)])
    rng.shuffle(rows)
    return [(i, " ".join(r)) for i, r in enumerate(rows)]


def test_near_copies_among_pages_of_one_template(make_docs):
    rows = template_pages()
    want = components(rows)
    assert sum(i != c for i, _, c in want) == 150
    got = near_duplicates(make_docs(rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(want)


def test_empty_table(make_docs):
    assert near_duplicates(make_docs([(1, None)]).limit(0)).count() == 0
    assert [tuple(r)[2:] for r in near_duplicates(make_docs([(1, None)])).collect()] == [(0, 1, True)]


def test_sketches_merge_and_estimate(monkeypatch):
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2)
    a, b = pool[:2000], pool[500:2500]
    assert (np.maximum(sketch(a), sketch(b)) == sketch(np.concatenate([a, b]))).all()
    for shared in (1800, 1500, 900):
        other = np.concatenate([a[:shared], pool[2000 : 4000 - shared]])
        x, y = sketch(a), sketch(other)
        more, less = np.array([(x > y).sum()]), np.array([(x < y).sum()])
        sizes = np.array([2000.0]), np.array([float(len(other))])
        true = shared / (2000 + len(other) - shared)
        assert abs(estimate(more, less, REGISTERS - more - less, *sizes)[0] - true) < 0.12
    sizes = np.array([10.0]), np.array([10.0])
    zero = np.array([0])
    assert estimate(zero, zero, zero + REGISTERS, *sizes)[0] > 0.99


def test_stretches_of_bytes_do_not_change_hashes(monkeypatch):
    texts = pa.array([t for _, t in copies()] + [None, "", "x" * 500, "é\tB " * 50])
    data, offsets = common.text_bytes(texts)
    whole = common.word_hashes(data, offsets)
    monkeypatch.setattr(common, "_CHUNK", 37)
    parts = common.word_hashes(data, offsets)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_long_chains_become_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 900)], "a long, b long")
    got = {r.cls: r.comp for r in connect(links).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 900: 500}
