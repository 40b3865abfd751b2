"""BPE encoding and decoding by an automaton over tokens.

The automaton reads token sequences and accepts exactly those that byte-pair merging can leave behind. It starts as
one state with an arc for every byte. Each merge ``u v -> w``, in order of rank, adds one gadget: arcs labelled ``u``
move to a copy of their target without the arc ``v``, and every state with an arc ``u`` gets an arc ``w`` to where
``v`` led. A word has one accepted path that spells it, so encoding follows arcs over a byte trie of the tokens, and
decoding concatenates the bytes of the arc labels.

Copies are kept as what a state lost and the state it was copied from, so that compiling takes one step a merge.
Whether an old arc ``u`` gave a state the arc ``w`` is settled when that arc is first asked for; the answer stays in
the transition table.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import batched, chain
from operator import methodcaller

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

VOCABULARY_FILE = "/opt/tokenizers/byte_bpe_50k.json"
#: Words and transitions one worker remembers before it starts anew; results do not depend on it.
REMEMBERED_WORDS = 400_000
REMEMBERED_ARCS = 1_000_000
WORDS_AT_ONCE = 8192

# The pattern that splits texts into words, and the characters that stand for bytes in the file.
WORDS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
_NO_ARCS: dict[int, int] = {}
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def _byte_characters() -> dict[str, int]:
    """The character of every byte: printable ones stand for themselves, the others are numbered from U+0100."""
    others = [b for b in range(256) if b not in _PRINTABLE]
    return {chr(b): b for b in _PRINTABLE} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Automaton:
    """The compiled automaton of one merge list.

    ``labels`` are the bytes of each token id, ``merges`` pairs of ids with the id they become, in order of rank.
    """

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]]) -> None:
        self.labels = labels
        # States: which of them lost an arc, and when; the state each was copied from, and the time of the copy.
        self._lost_by: dict[int, dict[int, int]] = {}
        self._copied: list[tuple[int, int]] = [(-1, 0)]
        # Arcs with one label have one target; a state that only one label reaches needs no further copy.
        self.target = dict.fromkeys(labels, 0)
        self._only: list[int] = [-1]
        self._made: dict[int, tuple[int, int]] = {}
        self._never: set[int] = set()
        for time, (u, v, w) in enumerate(merges, start=1):
            self._gadget(time, u, v, w)
        self._end = len(merges) + 1
        self._arcs: dict[int, dict[int, int]] = {}
        self._remembered = 0
        self._trie: dict[int, list] = {}
        for token, label in labels.items():
            self._add_to_trie(token, label)

    def _gadget(self, time: int, u: int, v: int, w: int) -> None:
        reached = self.target[u]
        if not self._has(reached, v, time - 1):
            # Earlier merges leave no ``u v`` behind, so nothing ever becomes ``w``.
            self._never.add(w)
            return
        # ``w`` leads where ``v`` led before this merge changes any target, which matters where u is v.
        followed = self.target[v]
        self.target[w] = followed
        if self._only[followed] != -1:
            self._only[followed] = -1
        if self._only[reached] != u:
            self._copied.append((reached, time))
            self._only.append(u)
            reached = self.target[u] = len(self._only) - 1
        self._lost_by.setdefault(v, {})[reached] = time
        self._made[w] = (u, time)

    def _add_to_trie(self, token: int, label: bytes) -> None:
        """A trie node is ``[token or None, children]``."""
        children = self._trie
        for byte in label:
            node = children.setdefault(byte, [None, {}])
            children = node[1]
        node[0] = token

    def _lost_at(self, state: int, token: int, before: int) -> bool:
        """Whether ``state`` lost its arc ``token`` before a time, itself or as the states it was copied from."""
        lost_by = self._lost_by.get(token)
        if lost_by is None:
            return False
        while state != -1:
            when = lost_by.get(state)
            if when is not None and when <= before:
                return True
            state, copied = self._copied[state]
            if copied <= before:
                before = copied - 1
        return False

    def _has(self, state: int, token: int, time: int) -> bool:
        """Whether ``state`` has an arc ``token`` at a time: if it had the arc of the first part when the token was made,
        and lost neither since."""
        while token not in self._never and not self._lost_at(state, token, time):
            if token not in self._made:
                return True
            token, time = self._made[token]
        return False

    def step(self, state: int, token: int) -> int:
        """Target of the arc ``token`` of ``state``, or -1."""
        arcs = self._arcs.get(state)
        if arcs is None:
            arcs = self._arcs[state] = {}
        found = arcs.get(token)
        if found is None:
            found = self.target[token] if self._has(state, token, self._end) else -1
            self._remembered += 1
            if self._remembered > REMEMBERED_ARCS:
                self._arcs.clear()
                self._remembered = 0
            else:
                arcs[token] = found
        return found

    def encode(self, word: bytes) -> list[int]:
        """Token ids of one word.

        Every prefix has one accepted path, so a place that led nowhere needs no second visit, whichever way it is
        reached: each is left at most once, by the longest arc first, and time is linear in the word.
        """
        size, arcs, step, labels = len(word), self._arcs, self.step, self.labels
        visited = bytearray(size + 1)
        at, state, path, waiting = 0, 0, [], []
        while at < size:
            if not visited[at]:
                visited[at] = 1
                choices, children = [], self._trie
                for byte in word[at:] if at else word:
                    node = children.get(byte)
                    if node is None:
                        break
                    token, children = node
                    if token is not None:
                        choices.append(token)
                waiting.append((at, state, choices))
            else:
                at, state, choices = waiting[-1]
            known = arcs.get(state, _NO_ARCS)
            while choices:
                token = choices.pop()
                end = at + len(labels[token])
                if not visited[end]:
                    following = known.get(token)
                    if following is None:
                        following = step(state, token)
                    if following != -1:
                        path.append(token)
                        at, state = end, following
                        break
            else:
                waiting.pop()
                path.pop()
                at = waiting[-1][0]
        return path


class Encoder:
    """Whole texts to ids and back, by the automaton of a vocabulary file; added tokens are matched first."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            read = json.load(file)
        byte_of = _byte_characters()
        ids = read["model"]["vocab"]
        labels = {i: bytes(byte_of[c] for c in token) for token, i in ids.items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in read["model"]["merges"]]
        self.automaton = Automaton(labels, [(ids[u], ids[v], ids[u + v]) for u, v in pairs])
        self._added = {t["content"]: t["id"] for t in read["added_tokens"]}
        self._labels: dict[int, bytes] = labels | {i: token.encode() for token, i in self._added.items()}
        longest_first = sorted(self._added, key=len, reverse=True)
        self._split = regex.compile("|".join(map(regex.escape, longest_first))) if longest_first else None
        self._words = regex.compile(WORDS)
        self._known: dict[str, list[int]] = {}

    def _segments(self, text: str) -> Iterator[tuple[str, int]]:
        """Stretches of text, each with the added token behind it or -1."""
        begin = 0
        for match in self._split.finditer(text) if self._split else ():
            yield text[begin : match.start()], self._added[match.group()]
            begin = match.end()
        yield text[begin:], -1

    def encode(self, text: str) -> Iterator[array]:
        """Ids of a whole text, a run at a time."""
        known = self._known
        for segment, added in self._segments(text):
            words = map(methodcaller("group"), self._words.finditer(segment))
            for some in batched(words, WORDS_AT_ONCE):
                found = list(map(known.get, some))
                if None in found:
                    found = [ids or self._learn(word) for ids, word in zip(found, some)]
                yield array("I", chain.from_iterable(found))
            if added != -1:
                yield array("I", [added])

    def _learn(self, word: str) -> list[int]:
        ids = self._known.get(word) or self.automaton.encode(word.encode())
        if len(word) <= 64:
            if len(self._known) >= REMEMBERED_WORDS:
                self._known.clear()
            self._known[word] = ids
        return ids

    def decode(self, ids: array) -> bytes:
        """The bytes of the arc labels, one after the other."""
        return b"".join(map(self._labels.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The compiled encoder of a vocabulary file, once per worker process."""
    return Encoder(path)


def _little_endian(run: array) -> bytes:
    import sys

    if sys.byteorder == "big":
        run = array("I", run)
        run.byteswap()
    return run.tobytes()


def bpe_round_trip(docs: DataFrame, path: str = VOCABULARY_FILE, with_ids: bool = False) -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of every whole ``text``.

    The digests are over the ids as little-endian 32-bit numbers and over the text decoded from them in UTF-8; both
    grow run by run, so beside the text only the ids of 8,192 words are held. ``with_ids`` adds ``ids`` (array of integers).
    NULL and empty texts have no tokens and the digests of nothing. Words of any length take time in proportion to
    it. Ties and repeated rows are encoded one by one, an empty table gives no rows. Columns named like an added one
    are replaced; all others stay.
    """
    added = [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
    if with_ids:
        added.append(T.StructField("ids", T.ArrayType(T.LongType())))
    base = docs.drop(*[field.name for field in added])
    names = [field.name for field in added]

    def round_trip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            counts, id_digests, text_digests, ids = [], [], [], []
            for value in batch.column("text").cast(pa.large_binary()):
                data = value.as_py()
                count, of_ids, of_text, all_ids = 0, hashlib.sha256(), hashlib.sha256(), array("I")
                for run in own.encode(data.decode("utf-8", "replace") if data else ""):
                    count += len(run)
                    of_ids.update(_little_endian(run))
                    of_text.update(own.decode(run))
                    if with_ids:
                        all_ids.extend(run)
                counts.append(count)
                id_digests.append(of_ids.hexdigest())
                text_digests.append(of_text.hexdigest())
                ids.append(all_ids.tolist())
            columns = [pa.array(counts, pa.int64()), pa.array(id_digests), pa.array(text_digests)]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names])

    return base.mapInArrow(round_trip, T.StructType([*base.schema.fields, *added]))


def decode_ids(encoded: DataFrame, path: str = VOCABULARY_FILE, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the text of its array of token ids; NULL ids give NULL, none an empty text."""
    base = encoded.drop("decoded")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            rows = [None if r is None else own.decode(r).decode("utf-8", "replace") for r in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.string())], [*batch.schema.names, "decoded"])

    return base.mapInArrow(texts, T.StructType([*base.schema.fields, T.StructField("decoded", T.StringType())]))
