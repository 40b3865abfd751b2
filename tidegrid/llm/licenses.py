"""License scans: identifier tags and notice phrases found by Aho-Corasick, expressions evaluated by shunting-yard.

One automaton searches every text once for all phrases, over words joined by single spaces, so that a phrase
stands only where its words stand side by side. A second one finds identifier tags in the raw text; the expression
after a tag is read by a shunting-yard parser with ``with`` above ``and`` above ``or``.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidegrid.llm.common import ALNUM_BYTES, LOWER_BYTES

# The phrases of the base scan and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Phrases the method adds, with labels of its own.
NOTICE_PHRASES = {
    "permission is hereby granted free of charge": "mit",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "creative commons attribution": "cc-by",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc0 1 0": "cc0",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx-license-identifier:"
#: License families that count as permissive when an expression is evaluated.
PERMISSIVE = frozenset({"mit", "apache", "bsd", "isc", "cc0", "zlib", "unlicense", "cc-by", "0bsd"})

_RANK = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+:-]+")


def parse_expression(text: str) -> list[str] | None:
    """Reverse Polish form of a licence expression, or None when it is not one. Operators are lower-case."""
    output: list[str] = []
    stack: list[str] = []
    operand_next = True
    end = 0
    for found in _TOKEN.finditer(text):
        if text[end : found.start()].strip():
            return None
        end = found.end()
        token, word = found.group(), found.group().lower()
        if word in _RANK:
            if operand_next:
                return None
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[word]:
                output.append(stack.pop())
            stack.append(word)
            operand_next = True
        elif token == "(":
            if not operand_next:
                return None
            stack.append(token)
        elif token == ")":
            if operand_next:
                return None
            while stack and stack[-1] != "(":
                output.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        else:
            if not operand_next:
                return None
            output.append(token)
            operand_next = False
    if operand_next or text[end:].strip() or "(" in stack:
        return None
    return output + stack[::-1]


def leading_expression(text: str, at: int) -> str:
    """The text from ``at`` to the first token that cannot continue an expression, without trailing punctuation."""
    begin = end = None
    gap, depth, operand_next = at, 0, True
    for found in _TOKEN.finditer(text, at):
        between = text[gap : found.start()]
        if between.strip() or "\n" in between or "\r" in between:
            break
        token = found.group()
        name = token.rstrip(".:-")
        if token == "(":
            if not operand_next:
                break
            depth += 1
        elif token == ")":
            if operand_next or not depth:
                break
            depth -= 1
        elif token.lower() in _RANK:
            if operand_next:
                break
            operand_next = True
        else:
            if not operand_next or not name or token.lower() == TAG:
                break
            operand_next = False
        begin = found.start() if begin is None else begin
        end = found.start() + len(name) if name else found.end()
        gap = found.end()
        if name != token and token not in "()":
            break
    return "" if begin is None else text[begin:end]


def evaluate(postfix: Sequence[str], permissive: frozenset[str] = PERMISSIVE) -> tuple[list[str], bool]:
    """Licences named by a parsed expression, and whether it can be met with permissive ones alone.

    ``or`` needs one side, ``and`` both; the exception after ``with`` leaves its licence's answer as it is.
    """
    names: list[str] = []
    values: list[bool] = []
    for token in postfix:
        if token not in _RANK:
            name = token.lower()
            names.append(name)
            values.append(any(name == p or name.startswith(p + "-") for p in permissive) and "-nc" not in name)
            continue
        right, left = values.pop(), values.pop()
        if token == "with":
            names[-1] = "with:" + names[-1]
            values.append(left)
        else:
            values.append(left or right if token == "or" else left and right)
    return [n for n in names if not n.startswith("with:")], values[0]


@lru_cache(maxsize=8)
def _automaton(phrases: tuple[str, ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase in phrases:
        found.add_word(phrase, phrase)
    if phrases:
        found.make_automaton()
    return found


def _places(joined: str, phrases: tuple[str, ...], word_count: int) -> list[tuple[int, str]]:
    """``(word position, phrase)`` of every place; ``joined`` has a space before and after every word."""
    hits = [(end, f[1:-1]) for end, f in _automaton(tuple(f" {p} " for p in phrases)).iter(joined)] if phrases else []
    if not hits:
        return []
    starts, at = [], -1
    while len(starts) < word_count:
        at = joined.index(" ", at + 1)
        starts.append(at)
    return [(bisect_right(starts, end - len(p) - 1) - 1, p) for end, p in hits]


def scan_text(
    text: str | None,
    base: Mapping[str, str] = BASE_PHRASES,
    more: Mapping[str, str] = NOTICE_PHRASES,
) -> dict:
    """What one text holds: words, base places, labels and the expressions after identifier tags."""
    text = text or ""
    words = text.encode("utf-8", "replace").translate(ALNUM_BYTES).split(b" ")
    words = [w for w in words if w]
    # Latin-1 maps every byte to one character: positions stay those of bytes and phrases are ASCII.
    joined = " " + b" ".join(words).decode("latin-1") + " "
    places = _places(joined, (*base, *(p for p in more if p not in base)), len(words))
    own = [(at, p) for at, p in places if p in base]
    labels = {base[p] for _, p in own} | {more[p] for _, p in places if p in more}
    expressions: list[str] = []
    permissive: list[bool] = []
    lowered = text.encode("utf-8", "replace").translate(LOWER_BYTES)
    if TAG.encode() in lowered:
        for end, _ in _automaton((TAG,)).iter(lowered.decode("utf-8")):
            line = leading_expression(text, end + 1)
            parsed = parse_expression(line)
            if parsed:
                names, free = evaluate(parsed)
                labels.update(names)
                expressions.append(line)
                permissive.append(free)
    first, last = (min(own)[0], max(own)[0]) if own else (None, None)
    return {
        "n_words": len(words),
        "n_base": len(own),
        "first_word": first,
        "last_word": last,
        "base_labels": ",".join(sorted({base[p] for _, p in own})),
        "labels": ",".join(sorted(labels)),
        "score": 1.0 if expressions else 0.9 if own else 0.5 if places else 0.0,
        "spans": [{"first": at, "words": p.count(" ") + 1, "phrase": p} for at, p in sorted(places)],
        "expressions": expressions,
        "permissive": all(permissive) if permissive else None,
    }


_ADDED = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.StringType()),
        T.StructField("labels", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField(
            "spans",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("first", T.LongType()),
                        T.StructField("words", T.LongType()),
                        T.StructField("phrase", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField("expressions", T.ArrayType(T.StringType())),
        T.StructField("permissive", T.BooleanType()),
    ]
)
_ADDED_ARROW = {
    "n_words": pa.int64(),
    "n_base": pa.int64(),
    "first_word": pa.int64(),
    "last_word": pa.int64(),
    "base_labels": pa.string(),
    "labels": pa.string(),
    "score": pa.float64(),
    "spans": pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64()), ("phrase", pa.string())])),
    "expressions": pa.list_(pa.string()),
    "permissive": pa.bool_(),
}


def scan_licenses(
    docs: DataFrame,
    base: Mapping[str, str] = BASE_PHRASES,
    more: Mapping[str, str] = NOTICE_PHRASES,
) -> DataFrame:
    """``docs`` without ``text``, with what :func:`scan_text` finds in every whole text.

    ``first_word`` and ``last_word`` are the smallest and largest start of a base phrase, NULL without one.
    ``score`` is 1.0 with a valid identifier expression, 0.9 with a base phrase, 0.5 with another notice phrase and
    else 0. ``permissive`` is NULL without expressions. NULL and empty texts have no words and empty labels.
    Repeated rows are scanned one by one, an empty table gives no rows, and columns named like an added one are
    replaced. Texts of one word up to any length are scanned whole.
    """
    kept = [f for f in docs.schema.fields if f.name != "text" and f.name not in _ADDED_ARROW]
    schema = T.StructType([*kept, *_ADDED.fields])
    base, more, names = dict(base), dict(more), [f.name for f in kept]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan_text(t.as_py(), base, more) for t in batch.column("text")]
            added = [pa.array([f[n] for f in found], kind) for n, kind in _ADDED_ARROW.items()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *added], [*names, *_ADDED_ARROW])

    return docs.select(*names, "text").mapInArrow(scan, schema)
