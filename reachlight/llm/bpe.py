"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For each prefix of a piece the last token of its encoding is unique. It is found among the tokens that the automaton
reports as suffixes of the prefix: the one that is compatible with the last token of the prefix before it. Following
these back from the end gives the ids, in time linear in the piece, however long it is.

Short pieces, which nearly all are, take fewer steps from the front: the longest token that fits and is compatible with
the one before; where none is, the one before is shortened. Both ways end at the one encoding whose neighbours are all
compatible.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from reachlight.llm import frame
from reachlight.llm.lengths import LOOSE, PATTERN, VOCABULARY

#: Pieces, and pairs of tokens, that a worker remembers; beyond, it forgets them all and begins anew.
PIECES, PAIRS = 250_000, 400_000
#: Bytes of a piece up to which it is encoded from the front.
SHORT = 40


class Remembered(dict):
    """Ids of pieces, packed as 32-bit integers, encoded when they are first asked for."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        got = self.encode(piece)
        if len(piece) < 40:
            if len(self) >= PIECES:
                self.clear()
            self[piece] = got
        return got


class Bpe:
    """An encoder for a file of ranks: a lower rank is merged first, and the ranks are the ids."""

    def __init__(self, vocabulary: str = VOCABULARY, pattern: str = PATTERN):
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.cut = regex.compile(pattern)
        self.bytes = {i: b for b, i in ranks.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        reachable = []
        for b, i in sorted(ranks.items(), key=lambda x: x[1]):
            if len(b) == 1:
                reachable.append(b)
            elif pair := self._last_merge(b, ranks):
                self.parts[i] = pair
                self.merged[pair] = i
                reachable.append(b)
        self.automaton = ahocorasick.Automaton()
        for b in reachable:
            self.automaton.add_word(b.decode("latin-1"), (len(b), ranks[b]))
        self.automaton.make_automaton()
        self.ids = {b: ranks[b] for b in reachable}
        self.longest = max(map(len, reachable), default=0)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known = Remembered(lambda piece: array("i", self.encode_bytes(piece.encode("utf-8", "replace"))).tobytes())
        self.pieces = Remembered(self.packed_cut)

    @staticmethod
    def _last_merge(b: bytes, ranks: dict[bytes, int]) -> tuple[int, int] | None:
        """The two ids that merge into the token b last; None if merging in order of rank never makes b."""
        own, parts = ranks[b], [b[i : i + 1] for i in range(len(b))]
        while len(parts) > 2:
            best = min(((ranks.get(parts[i] + parts[i + 1], own), i) for i in range(len(parts) - 1)))
            if best[0] >= own:
                return None
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return (ranks[parts[0]], ranks[parts[1]]) if parts[0] in ranks and parts[1] in ranks else None

    def compatible(self, a: int, b: int) -> bool:
        """Whether the encoding of the bytes of a and b is just these two tokens.

        Merges are undone from the later one on; if two parts that meet at the border would have been merged before
        the merge that was undone last, the border would have been crossed.
        """
        limit = 1 << 60
        parts, merged = self.parts, self.merged
        while True:
            if merged.get((a, b), limit) < limit:
                return False
            left, right = parts.get(a), parts.get(b)
            if left is not None and (a > b or right is None):
                limit, a = a, left[1]
            elif right is not None:
                limit, b = b + 1, right[0]
            else:
                return True

    def encode_short(self, data: bytes) -> list[int]:
        """The ids of one piece, tried from the front; ``dead`` has the places from which no compatible rest leads to the end."""
        token_at, pairs, known, n = self.ids.get, self.pairs, self.pairs.get, len(data)
        ids: list[int] = []
        starts: list[int] = []
        dead: set[int] = set()
        at, end = 0, min(n, self.longest)
        while at < n:
            while end > at:
                token = token_at(data[at:end])
                if token is not None and end not in dead:
                    if not ids:
                        break
                    ok = known((ids[-1], token))
                    if ok is None:
                        if len(pairs) >= PAIRS:
                            pairs.clear()
                        ok = pairs[ids[-1], token] = self.compatible(ids[-1], token)
                    if ok:
                        break
                end -= 1
            if end > at:
                ids.append(token)
                starts.append(at)
                at, end = end, min(n, end + self.longest)
            else:
                dead.add(at)
                ids.pop()
                end, at = at - 1, starts.pop()
        return ids

    def encode_bytes(self, data: bytes) -> list[int]:
        """The ids of one piece."""
        if len(data) <= SHORT:
            return self.encode_short(data)
        last: list[int] = [0] * (len(data) + 1)  # last token of each prefix, and its length
        size: list[int] = [0] * (len(data) + 1)
        pairs = self.pairs
        for end, (n, token) in self.automaton.iter(data.decode("latin-1")):
            end += 1
            if size[end]:
                continue
            start = end - n
            if start:
                before = last[start]
                if not size[start]:
                    continue
                ok = pairs.get((before, token))
                if ok is None:
                    if len(pairs) >= PAIRS:
                        pairs.clear()
                    ok = pairs[before, token] = self.compatible(before, token)
                if not ok:
                    continue
            last[end], size[end] = token, n
        ids, at = [], len(data)
        while at:
            ids.append(last[at])
            at -= size[at]
        ids.reverse()
        return ids

    def packed_cut(self, text: str) -> bytes:
        """The packed ids of a text that is cut by the pattern first; pieces are remembered."""
        return b"".join(map(self.known.__getitem__, self.cut.findall(text)))

    def packed(self, text: str) -> bytes:
        """The packed ids of a text. Where single spaces alone part the words, the words are cut and remembered one by one."""
        if LOOSE.search(text) or "\0" in text:
            return self.packed_cut(text)
        return b"".join(map(self.pieces.__getitem__, text.replace(" ", "\0 ").split("\0")))

    def encode(self, text: str) -> list[int]:
        """The exact ids of a text."""
        return array("i", self.packed(text)).tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; bytes that aren't UTF-8 become U+FFFD. An unknown id raises KeyError."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def shared(vocabulary: str, pattern: str) -> Bpe:
    """One encoder for a worker process, with all that it remembers."""
    return Bpe(vocabulary, pattern)


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, ids array<int>, n_tokens int, exact boolean): each document's whole text; exact: decoding gives it back.

    A null text has nulls, an empty one no ids. Repeated rows give repeated rows; other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared(vocabulary, pattern)
        for batch in batches:
            for part in frame.steps(batch, 1):
                texts = part.column(1).to_pylist()
                ids = [None if t is None else np.frombuffer(bpe.packed(t), np.int32) for t in texts]
                none = pa.array([i is None for i in ids], pa.bool_())
                first = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([0 if i is None else len(i) for i in ids], out=first[1:])
                flat = np.concatenate([*[i for i in ids if i is not None], np.zeros(0, np.int32)])
                yield pa.record_batch([
                    part.column(0), pa.ListArray.from_arrays(pa.array(first), pa.array(flat), mask=none), pa.array(np.diff(first), pa.int32(), mask=none.to_numpy(False)),
                    pa.array([None if i is None else bpe.decode(i.tolist()) == t for i, t in zip(ids, texts)], pa.bool_()),
                ], ["doc_id", "ids", "n_tokens", "exact"])

    return frame.plain(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, ids array<int>, n_tokens int, exact boolean")


def decoded(rows: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, text) of rows with doc_id and ids. Null ids, and arrays that hold a null or an unknown id, give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared(vocabulary, pattern)
        for batch in batches:
            texts = [None if ids is None or any(i not in bpe.bytes for i in ids) else bpe.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return frame.plain(rows, doc_id="long", ids="array<int>").mapInArrow(run, "doc_id long, text string")


def query(spark: SparkSession, folder: str) -> DataFrame:
    """The ids of all documents."""
    return encoded(frame.read(spark, folder, "documents"))
