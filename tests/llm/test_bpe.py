import hashlib
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_fixtures import SF, awkward, make_docs  # noqa: F401
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidegrid.llm import bpe
from tidegrid.llm.bpe import VOCABULARY_FILE, Automaton, bpe_round_trip, decode_ids, encoder
from tidegrid.llm.queries import QUERIES


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(VOCABULARY_FILE)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def ids_of(text):
    return [i for run in encoder(VOCABULARY_FILE).encode(text) for i in run]


def plain(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    packed = struct.pack(f"<{len(ids)}I", *ids)
    return len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_query_equals_library(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    result = QUERIES["op12_bpe"](spark, SF)
    assert result.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {r[0]: tuple(r[1:]) for r in result.collect()} == {d: plain(library, t) for d, t in docs}


TEXTS = st.one_of(
    st.text(max_size=60),
    st.text("aab hetsin'1 \n\t \x1c\u0085é中😀.,", max_size=60),
    st.lists(st.sampled_from(["<|endoftext|>", " ", "  ", "the", "'ll", "\n"]), max_size=12).map("".join),
)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_any_text_equals_library(library, text):
    ids = ids_of(text)
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert encoder(VOCABULARY_FILE).decode(ids).decode() == text


def test_every_character_equals_library(library):
    for code in [c for c in range(0x110000) if not 0xD800 <= c < 0xE000][::23]:
        text = f"a{chr(code)}1 {chr(code)}{chr(code)} !{chr(code)}"
        assert ids_of(text) == library.encode(text, add_special_tokens=False).ids, hex(code)


def merged(word, merges):
    """Byte-pair merging as defined: the first merge in the list that applies, leftmost first, until none does."""
    ids = list(word)
    for u, v, w in merges:
        at = 0
        while at < len(ids) - 1:
            if (ids[at], ids[at + 1]) == (u, v):
                ids[at : at + 2] = [w]
            at += 1
    return ids


@settings(max_examples=400, deadline=None)
@given(st.data())
def test_gadgets_equal_merging(data):
    labels = {b: bytes([b]) for b in range(3)}
    merges = []
    for _ in range(data.draw(st.integers(0, 9))):
        u, v = data.draw(st.sampled_from(sorted(labels))), data.draw(st.sampled_from(sorted(labels)))
        label = labels[u] + labels[v]
        # A token has one merge, as in every trained list.
        if label not in labels.values():
            merges.append((u, v, len(labels)))
            labels[len(labels)] = label
    automaton = Automaton(labels, merges)
    for word in data.draw(st.lists(st.lists(st.integers(0, 2), max_size=14), max_size=8)):
        assert list(automaton.encode(bytes(word))) == merged(word, merges)


def test_awkward_rows_and_clashing_columns(make_docs, awkward, library):
    rows = [*awkward, (9, "a" * 30_000), (10, "<|endoftext|>" * 3 + " x")]
    docs = make_docs(rows).withColumns({"n_tokens": F.lit("x"), "ids": F.lit(1)})
    coded = bpe_round_trip(docs, with_ids=True)
    result = decode_ids(coded).collect()
    assert sorted(repr((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)) for r in result) == sorted(
        repr((r[0], *plain(library, r[1]))) for r in rows
    )
    assert all(r.decoded == (r.text or "") and len(r.ids) == r.n_tokens for r in result)
    assert bpe_round_trip(docs.limit(0)).count() == 0


def test_memory_of_words_and_runs_is_bounded(monkeypatch, library):
    monkeypatch.setattr(bpe, "REMEMBERED_WORDS", 3)
    monkeypatch.setattr(bpe, "REMEMBERED_ARCS", 5)
    monkeypatch.setattr(bpe, "WORDS_AT_ONCE", 4)
    own = bpe.Encoder(VOCABULARY_FILE)
    text = "One two three four five six seven, and once more: one two three."
    runs = list(own.encode(text))
    assert [i for r in runs for i in r] == library.encode(text).ids and len(runs) > 2
    assert len(own._known) <= 3 and sum(map(len, own.automaton._arcs.values())) <= 5
