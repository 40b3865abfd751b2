"""Repair of conversation structure with the fewest edits.

A row of a conversation is blank, a duplicate, truncated or sound, and its role may break the grammar
``(s?(ua)+)?`` of role initials. Rows are kept, given another role, deleted, or empty ones inserted, at least cost.

Only role and fault of a row decide its edits, so a conversation is reduced to a signature of one character a row.
Distinct signatures of all conversations are dealt in the order of their reversed text. Those with a common ending
are neighbours then, and form an automaton that shares suffixes: a node is a suffix, an arc leads from it to the
suffix one row shorter. Cost-to-go and the first edit of the best audit are worked out once per node and grammar
state; a signature only adds the nodes it does not share with the one before it.

A conversation of any length passes as a sorted stream twice, once without texts for its signature and once for the
digest of its repaired form; a task holds one character and the edits of a row, never its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import batched, groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidegrid.llm.common import written

# Costs of edits and the surcharge of truncated rows that stay.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

#: Signature characters: a row that must go, and rows by initial, in upper case when truncated.
GONE, OTHER = "-", "x"
#: The ending by which signatures are dealt to tasks.
ENDING = 64
_BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"

# Grammar states: nothing yet, after the system row, after a user row, after an assistant row.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
#: The role a new or changed row takes in each state, and the state after it.
_TURN = {_START: ("u", _USER), _SYSTEM: ("u", _USER), _USER: ("a", _ASSISTANT), _ASSISTANT: ("u", _USER)}
_ROLES = {"u": "user", "a": "assistant"}


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after the damage that a hash of ``conv_id:turn`` deals to every row.

    Of 20 values 0 drops the row, 1 empties its text, 2 removes its full stops, exclamation and question marks,
    3 repeats it and 4 makes its role ``user``. NULLs count as one space.
    """
    key = F.concat(_text("conv_id"), F.lit(":"), _text("turn"))
    marked = rows.select(
        "conv_id",
        "turn",
        _text("role").alias("role"),
        _text("text").alias("text"),
        (F.crc32(key.cast("binary")) % 20).alias("_fate"),
    ).where("_fate != 0")
    fate = F.col("_fate")
    text = F.when(fate == 1, "").when(fate == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(fate == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return marked.select(
        "conv_id",
        "turn",
        F.when(fate == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.explode(copies).alias("_copy"),
    ).drop("_copy")


def _fault_free(text: Column) -> Column:
    """NULL for a blank text, else whether its last character that is no white space ends a sentence."""
    last = F.right(F.rtrim(text, F.lit(_BLANKS)), F.lit(1))
    return F.when(last != "", last.isin(".", "!", "?"))


def _slim(rows: DataFrame) -> DataFrame:
    """Rows without texts: the place in order and what the signature needs.

    Beside them stands a marker where each role and text comes first in its conversation: a row is
    a duplicate unless such a marker is just before it. Markers come from an aggregate, which reduces before it
    shuffles, so a text that fills a conversation is no hot key.
    """
    digest = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    facts = rows.select(
        "conv_id",
        "turn",
        digest.alias("_digest"),
        F.left("role", F.lit(1)).alias("_initial"),
        _fault_free(F.col("text")).alias("_whole"),
    )
    # A NULL turn is the first; its struct has a smaller first field than those of turns.
    order = F.struct(F.col("turn").isNotNull().alias("set"), F.col("turn").alias("turn"))
    firsts = facts.groupBy("conv_id", "_digest").agg(F.min(order).alias("_first"))
    return facts.withColumn("_kind", F.lit(_ROW)).unionByName(
        firsts.select("conv_id", F.col("_first.turn").alias("turn"), "_digest", F.lit(_MARKER).alias("_kind")),
        allowMissingColumns=True,
    )


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal"]
#: Kinds of rows in a stream, in their order: the conversation's own, markers, rows.
_HEAD, _MARKER, _ROW = range(3)
_ROWS_AT_ONCE = 256


def _schema(key: str, *more: str) -> str:
    return ", ".join([f"conv_id {key}", *[f"{c} bigint" for c in _COUNTS], *more])


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of a sorted stream, few at a time as texts may be long."""
    for batch in batches:
        for begin in range(0, batch.num_rows, _ROWS_AT_ONCE):
            yield from zip(*(c.to_pylist() for c in batch.slice(begin, _ROWS_AT_ONCE).columns), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for some in batched(rows, _ROWS_AT_ONCE):
        columns = zip(zip(*some), schema.types, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], schema=schema)


class _Counter:
    """What the stream of one conversation's rows, in order, adds up to."""

    def __init__(self, key: object) -> None:
        self.key = key
        self.low = self.high = self.turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.signature = bytearray()
        self.marker = self.initial = None

    def add(self, turn: int | None, digest: bytes, initial: str | None, whole: bool | None, kind: int) -> None:
        if kind != _ROW:
            self.marker = (turn, digest)
            return
        if turn is not None and turn != self.turn:
            self.low = turn if self.low is None else self.low
            self.high = self.turn = turn
            self.turns += 1
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        first, self.marker = self.marker == (turn, digest), None
        place = initial if initial in ("s", "u", "a") else OTHER
        if whole is None:
            self.blank += 1
            place = GONE
        elif not first:
            self.duplicate += 1
            place = GONE
        elif not whole:
            self.truncated += 1
            place = place.upper()
        self.signature += place.encode()

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.key, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.signature.decode())


def _signatures(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per conversation: counts of its faults and its signature, empty for one without rows."""
    heads = conversations.select("conv_id", F.lit(_HEAD).alias("_kind"))
    ordered = (
        _slim(rows)
        .unionByName(heads, allowMissingColumns=True)
        .select("conv_id", "turn", "_digest", "_initial", "_whole", "_kind")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), F.col("_digest").asc_nulls_first(), "_kind")
    )
    schema = _schema(rows.schema["conv_id"].dataType.simpleString(), "signature string")
    arrow = _arrow_schema(rows, "signature")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def signed() -> Iterator[tuple]:
            for key, parts in groupby(_stream(batches), itemgetter(0)):
                counter = _Counter(key)
                for part in parts:
                    counter.add(*part[1:])
                yield counter.row()

        return _batches(signed(), arrow)

    return ordered.mapInArrow(scan, schema)


def _arrow_schema(rows: DataFrame, *more: str) -> pa.Schema:
    key = to_arrow_type(rows.schema["conv_id"].dataType)
    counts = [(c, pa.int64()) for c in _COUNTS]
    return pa.schema([("conv_id", key), *counts, *[(c, pa.int64() if c == "cost" else pa.string()) for c in more]])


class SuffixAutomaton:
    """The nodes of the signature at hand, from its end: those of a common ending are kept for the next one.

    A node is known by its costs-to-go less the least of them; two suffixes with equal ones have equal edits in
    front of them, so what a row adds to a node is worked out once.
    """

    def __init__(self) -> None:
        end = {_START: 0, _SYSTEM: 2 * INSERT, _USER: INSERT, _ASSISTANT: 0}
        edits = {_START: None, _ASSISTANT: None, _SYSTEM: ("I", _USER), _USER: ("I", _ASSISTANT)}
        self._reversed = ""
        self._costs = [tuple(end[s] for s in range(4))]
        self._least = [0]
        self._edits: list[tuple] = [tuple((edits[s], False) for s in range(4))]
        self._added: dict[tuple[str, tuple[int, ...]], tuple] = {}

    def _in_front(self, symbol: str, costs: tuple[int, ...]) -> tuple:
        """Costs, their least and the first edit per state of a suffix with ``symbol`` before a node.

        An edit is its initial, the state after it, and whether it takes the row. Equal costs go to the edit whose
        initial comes first in ASCII; audits that start alike are told apart further on.
        """
        choices: list[list[tuple[int, str, int, bool]]] = []
        for state in range(4):
            role, after = _TURN[state]
            found = [(DELETE + costs[state], "D", state, True)]
            if symbol != GONE:
                surcharge = TRUNCATED if symbol.isupper() else 0
                initial = symbol.lower()
                if initial == role:
                    found.append((surcharge + costs[after], "K", after, True))
                elif initial == "s" and state == _START:
                    found.append((surcharge + costs[_SYSTEM], "K", _SYSTEM, True))
                found.append((REROLE + surcharge + costs[after], "R", after, True))
            choices.append(found)
        best = [min(found) for found in choices]
        # Rows are inserted before this one where that is cheaper; three in a row are never needed.
        for _ in range(3):
            for state in range(4):
                after = _TURN[state][1]
                best[state] = min(best[state], (INSERT + best[after][0], "I", after, False))
        least = min(b[0] for b in best)
        return tuple(b[0] - least for b in best), least, tuple(((b[1], b[2]), b[3]) for b in best)

    def audit(self, signature: str) -> tuple[int, str]:
        """Least cost of a signature and the ASCII-least audit of that cost."""
        backwards = signature[::-1]
        shared = 0
        for a, b in zip(backwards, self._reversed):
            if a != b:
                break
            shared += 1
        for kept in (self._costs, self._least, self._edits):
            del kept[shared + 1 :]
        for symbol in backwards[shared:]:
            node = (symbol, self._costs[-1])
            if node not in self._added:
                self._added[node] = self._in_front(*node)
            costs, least, edits = self._added[node]
            self._costs.append(costs)
            self._least.append(self._least[-1] + least)
            self._edits.append(edits)
        self._reversed = backwards
        at, state, audit = len(backwards), _START, []
        cost = self._least[at] + self._costs[at][_START]
        while True:
            edit, takes = self._edits[at][state]
            if edit is None:
                break
            audit.append(edit[0])
            state = edit[1]
            at -= takes
        return cost, "".join(audit)


def with_audits(signed: DataFrame) -> DataFrame:
    """``signed`` with ``cost`` and ``audit`` in place of ``signature``.

    Conversations are dealt by their last ``ENDING`` rows, then by a hash of the signature and by id, so that a
    common ending, or a common conversation, is cut over tasks where it outgrows one; each task works through its own
    in the order of the reversed signature, where equal endings are neighbours.
    """
    backwards = F.reverse("signature")
    dealt = (
        signed.withColumns({"_end": F.substring(backwards, 1, ENDING), "_hash": F.xxhash64("signature")})
        .repartitionByRange("_end", "_hash", "conv_id")
        .sortWithinPartitions(backwards)
        .select("conv_id", *_COUNTS, "signature")
    )
    schema = _schema(signed.schema["conv_id"].dataType.simpleString(), "cost bigint", "audit string")
    arrow = _arrow_schema(signed, "cost", "audit")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved() -> Iterator[tuple]:
            automaton = SuffixAutomaton()
            for signature, parts in groupby(_stream(batches), itemgetter(-1)):
                answer = automaton.audit(signature)
                for part in parts:
                    yield *part[:-1], *answer

        return _batches(solved(), arrow)

    return dealt.mapInArrow(solve, schema)


class _Repair:
    """One conversation on its way through the stream: the edits ahead and the digest so far."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at = audit, 0
        self.state, self.digest, self.rows = _START, hashlib.sha256(), 0

    def _put(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) if self.rows else ''}{role}:{text}".encode())
        self.rows += 1

    def _turn(self, text: str) -> None:
        role, self.state = _TURN[self.state]
        self._put(_ROLES[role], text)

    def insert(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self._turn("")

    def add(self, role: str, text: str) -> None:
        self.insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            self._turn(text)
        elif edit == "K":
            self.state = _SYSTEM if self.state == _START and role.startswith("s") else _TURN[self.state][1]
            self._put(role, text)

    def hexdigest(self) -> str:
        self.insert()
        return self.digest.hexdigest()


def _with_digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """``audits`` with ``repaired_sha256``: they come first in each conversation's stream, then its rows in order."""
    digest = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    body = rows.select("conv_id", "turn", "role", "text", F.unhex(digest).alias("_digest"), F.lit(_ROW).alias("_kind"))
    names = ["conv_id", *_COUNTS, "cost", "audit"]
    ordered = (
        audits.withColumn("_kind", F.lit(_HEAD))
        .unionByName(body, allowMissingColumns=True)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "_kind", F.col("turn").asc_nulls_first(), F.col("_digest").asc_nulls_first())
        .select(*names, "role", "text")
    )
    schema = _schema(
        rows.schema["conv_id"].dataType.simpleString(), "cost bigint", "audit string", "repaired_sha256 string"
    )
    arrow = _arrow_schema(rows, "cost", "audit", "repaired_sha256")

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def repaired() -> Iterator[tuple]:
            for _, parts in groupby(_stream(batches), itemgetter(0)):
                head = next(parts)[: len(names)]
                repair = _Repair(head[-1])
                for part in parts:
                    repair.add(*part[-2:])
                yield *head, repair.hexdigest()

        return _batches(repaired(), arrow)

    return ordered.mapInArrow(repair, schema)


def repair_conversations(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """One row per conversation of ``rows`` (``conv_id, turn, role, text``): its faults, cheapest edits and digest.

    ``gaps`` are turns missing between the first and the last, ``blank, duplicate, truncated`` count each row's first
    fault, ``illegal`` neighbouring rows whose initials do not follow each other. ``cost`` and ``audit`` are those of
    the cheapest edits, the ASCII-least audit on ties, ``repaired_sha256`` the digest of the repaired ``role:text``
    lines. ``conversations`` lists the ``conv_id`` to report, once each, among them all of ``rows``; those without
    rows have zeros, an empty audit and the digest of nothing.

    Rows are taken by turn, a NULL turn first; rows of one turn in the order of a digest of role and text, so the
    order in which they are read never matters. A NULL ``conv_id`` is a conversation of its own; a NULL role or text
    counts as one space. Empty texts are blank, texts and conversations of any length count whole, repeated rows are
    duplicates. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    filled = rows.select("conv_id", "turn", _text("role").alias("role"), _text("text").alias("text"))
    every = (rows if conversations is None else conversations).select("conv_id").distinct()
    audits = with_audits(written(_signatures(filled, every)))
    return _with_digests(filled, audits)


def damage_and_repair(rows: DataFrame) -> DataFrame:
    """:func:`repair_conversations` of the rows after :func:`damaged`, for every conversation of ``rows``."""
    return repair_conversations(damaged(rows), rows)
