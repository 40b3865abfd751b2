import hashlib
import re
import sys
import zlib
from functools import lru_cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_fixtures import SF
from pyspark.sql import functions as F

from tidegrid.llm.conversations import GONE, SuffixAutomaton, damage_and_repair, damaged, repair_conversations
from tidegrid.llm.queries import QUERIES

sys.setrecursionlimit(10_000)
SPACES = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(key.encode()) % 20
        if fate == 0:
            continue
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        if fate == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * (2 if fate == 3 else 1)


def plain_audit(rows):
    """Cheapest (cost, audit, lines) over all edit scripts, by trying every edit in every place."""
    accepted = {0, 3}
    steps = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}

    @lru_cache(maxsize=None)
    def best(at, state, inserted):
        found = []
        if at == len(rows) and state in accepted:
            found.append((0, "", ()))
        if inserted < 3:
            for role in ("user", "assistant"):
                if (state, role[0]) in steps:
                    cost, audit, lines = best(at, steps[state, role[0]], inserted + 1)
                    found.append((cost + 3, "I" + audit, (f"{role}:", *lines)))
        if at < len(rows):
            role, text, fault = rows[at]
            cost, audit, lines = best(at + 1, state, 0)
            found.append((cost + 4, "D" + audit, lines))
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault == "truncated" else 0
                for new, edit, price in ((role, "K", 0), ("user", "R", 3), ("assistant", "R", 3)):
                    if (state, new[:1]) in steps:
                        cost, audit, lines = best(at + 1, steps[state, new[:1]], 0)
                        found.append((cost + price + extra, edit + audit, (f"{new}:{text}", *lines)))
        return min(found) if found else (10**9, "", ())

    return best(0, 0, 0)


def plain_repair(conv, rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0))
    faulty, seen = [], set()
    for _, _, role, text in rows:
        bare = text.strip(SPACES)
        fault = ""
        if not bare:
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        elif bare[-1] not in ".!?":
            fault = "truncated"
        seen.add((role, text))
        faulty.append((role, text, fault))
    turns = [r[1] for r in rows if r[1] is not None]
    faults = [f for *_, f in faulty]
    initials = [r[:1] for r, *_ in faulty]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit, lines = plain_audit(tuple(faulty))
    return (
        conv,
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        faults.count("blank"),
        faults.count("duplicate"),
        faults.count("truncated"),
        illegal,
        cost,
        audit,
        hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def plain(rows):
    kept = list(plain_damage(rows))
    return {c: plain_repair(c, [r for r in kept if r[0] == c]) for c in {r[0] for r in rows}}


def check(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: tuple(r) for r in damage_and_repair(df).collect()}
    assert got == plain(rows)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    result = QUERIES["op13_conversation_repair"](spark, SF)
    assert result.columns[:9] == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r.conv_id: tuple(r) for r in result.collect()} == plain(rows)


def test_awkward_rows(spark):
    check(
        spark,
        [
            (None, 0, "user", "No id."),
            (None, None, None, None),
            (1, None, "user", "First of all."),
            (1, 5, "assistant", "Once."),
            (1, 5, "assistant", "Once."),
            (1, 9, "assistant", "Once."),
            (2, 1, "", "No role."),
            (2, 2, "unknown", "Known by its initial."),
            (2, 3, "User", "Upper case."),
            (3, 1, "user", " \t\n\x0b"),
            (4, None, "tool", "Only one" * 20_000),
            (5, 1, "system", "Alone."),
            (6, 1, "user", "é? 😀"),
            (6, 7, "assistant", "So? \n"),
            *[(7, t, "user", "Again and again.") for t in range(40)],
            *[(c, 0, "user", "Dropped, perhaps.") for c in range(100, 160)],
        ],
    )


def test_long_and_common_conversations(spark):
    rows = [(1, t, "ua"[t % 3 % 2] + "x", f"Row {t}{'.' if t % 7 else ''}") for t in range(150)]
    rows += [(c, t, ["system", "user", "assistant"][t], "Same.") for c in range(2, 60) for t in range(3)]
    check(spark, rows)


def test_empty_table_and_other_columns(spark):
    df = spark.createDataFrame([], "conv_id string, turn long, role string, text string")
    assert damage_and_repair(df).count() == 0
    named = spark.createDataFrame([("a", 1, "user", "Yes.")], df.schema).withColumns(
        {"_kind": F.lit("x"), "audit": F.lit("y"), "_digest": F.lit(1)}
    )
    assert [(r.conv_id, r.audit) for r in repair_conversations(named).collect()] == [("a", "KI")]
    assert damaged(named).columns == ["conv_id", "turn", "role", "text"]


def symbols(signature):
    roles = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    return tuple(
        ("tool", "t", "blank") if c == GONE else (roles[c.lower()], "t", "truncated" if c.isupper() else "")
        for c in signature
    )


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("suaxSUAX-", max_size=9), min_size=1, max_size=5))
def test_automaton_equals_brute_force(signatures):
    automaton = SuffixAutomaton()
    for signature in sorted(signatures, key=lambda s: s[::-1]):
        assert automaton.audit(signature) == plain_audit(symbols(signature))[:2]


def test_suffixes_are_worked_out_once(monkeypatch):
    asked = []
    inner = SuffixAutomaton._in_front
    monkeypatch.setattr(SuffixAutomaton, "_in_front", lambda self, *node: asked.append(node) or inner(self, *node))
    automaton = SuffixAutomaton()
    for length in range(1, 300):
        automaton.audit(("ua" * 200)[-length:])
    assert len(asked) == len(set(asked)) < 20


@pytest.mark.parametrize("text, fault", [("a.", 0), ("a. \n", 0), ("a", 1), ("a. ", 1)])
def test_truncation(spark, text, fault):
    df = spark.createDataFrame([(1, 1, "user", text)], "conv_id long, turn long, role string, text string")
    assert repair_conversations(df).first().truncated == fault
