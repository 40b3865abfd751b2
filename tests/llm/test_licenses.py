import re

import pytest
from llm_fixtures import awkward, make_docs  # noqa: F401
from pyspark.sql import functions as F

from tidegrid.llm.licenses import BASE_PHRASES, evaluate, parse_expression, scan_licenses, scan_text

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

TEXTS = [
    "Released under the MIT License. Licensed under the Apache License, Version 2.0.",
    "CC BY-NC 4.0, cc_by_nc; CC BY NCX, accc by nc",
    "under the mit license under the mit license",
    "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause\ncode",
    "/* spdx-license-identifier: GPL-2.0-only WITH Classpath-exception-2.0 */",
    "SPDX-License-Identifier: MIT OR\nSPDX-License-Identifier: ISC",
    "İ under the MIT lİcense; é under the mit license é",
    "GNU General Public License, version 3",
]


def expected(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places = [
        (i, label)
        for phrase, label in BASE_PHRASES.items()
        for i in range(len(words))
        if words[i : i + phrase.count(" ") + 1] == phrase.split()
    ]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_base_equals_brute_force(make_docs, awkward):
    rows = [*((100 + i, t) for i, t in enumerate(TEXTS)), *awkward]
    texts = {r[0]: r[1] for r in rows}
    got = scan_licenses(make_docs(rows).withColumn("labels", F.lit(1))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == expected(texts[r.doc_id])
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    by = {r.doc_id: r for r in got}
    assert by[103].labels == "apache-2.0,bsd-3-clause,mit" and by[103].permissive and by[103].score == 1
    assert by[104].labels == "gpl-2.0-only" and by[104].permissive is False
    assert by[105].expressions == ["ISC"] and by[107].labels == "gpl" and by[107].score == 0.5
    assert scan_licenses(make_docs(awkward).limit(0)).count() == 0


@pytest.mark.parametrize("text, postfix", [
    ("MIT", ["MIT"]),
    ("MIT OR GPL-2.0 AND BSD", ["MIT", "GPL-2.0", "BSD", "and", "or"]),
    ("(MIT or GPL-2.0) and BSD", ["MIT", "GPL-2.0", "or", "BSD", "and"]),
    ("GPL-2.0 WITH x AND MIT", ["GPL-2.0", "x", "with", "MIT", "and"]),
    ("((MIT))", ["MIT"]),
    *((bad, None) for bad in ("", "MIT OR", "AND MIT", "(MIT", "MIT)", "MIT BSD", "MIT ? BSD", "()", "(MIT OR)", "MIT (BSD)")),
])
def test_shunting_yard(text, postfix):
    assert parse_expression(text) == postfix


def test_evaluation():
    truth = {"mit": True, "gpl-2.0": False}
    for text, free in (
        ("MIT OR GPL-2.0", True), ("MIT AND GPL-2.0", False), ("GPL-2.0 OR MIT AND GPL-2.0", False),
        ("(GPL-2.0 OR MIT) AND MIT", True), ("GPL-2.0 WITH MIT", False), ("CC-BY-NC-4.0", False), ("CC-BY-4.0", True),
    ):
        assert evaluate(parse_expression(text))[1] is free, text
    assert evaluate(parse_expression("MIT OR GPL-2.0"))[0] == list(truth)


@pytest.mark.parametrize("text, expressions", [
    ("SPDX-License-Identifier: MIT pragma solidity ^0.8", ["MIT"]),
    ("SPDX-License-Identifier: MIT. This file", ["MIT"]),
    ("SPDX-License-Identifier: (MIT OR GPL-2.0+), see below", ["(MIT OR GPL-2.0+)"]),
    ("SPDX-License-Identifier: MIT SPDX-License-Identifier: ISC-->", ["MIT", "ISC"]),
    ("SPDX-License-Identifier: (MIT OR", []),
    ("SPDX-License-Identifier:\nMIT", []),
    ("SPDX-License-Identifier: " + "MIT OR " * 2000 + "GPL-2.0", ["MIT OR " * 2000 + "GPL-2.0"]),
])
def test_expressions_end_where_no_token_continues_them(text, expressions):
    assert scan_text(text)["expressions"] == expressions
