"""Quality rule: repeated substrings of a text by its suffix array and longest common prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from reachlight.llm import frame
from reachlight.llm.words import P, P_INVERSE, mix, powers

#: Characters from which on a repeated substring counts.
SHORTEST = 60
#: A text is rejected if repeats cover more than this share of it, or one of them is longer than this.
MOST_COVERED, LONGEST = 0.35, 4000

SCHEMA = "doc_id long, n_chars long, covered double, longest_repeat long"


def suffixes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, longest common prefix of each suffix with the one before it; the first has 0).

    Prefix doubling from runs of several characters, in which only suffixes that still tie are sorted again. Ranks of
    each round are kept, and the common prefixes are found by descending through them.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # the first round compares as many characters as fit into 64 bits; 0 is past the end
    _, small = np.unique(codes, return_inverse=True)
    bits = max(1, int(small.max() + 1).bit_length())
    h = max(1, min(63 // bits, 16))
    padded = np.concatenate([small.astype(np.uint64) + np.uint64(1), np.zeros(h, np.uint64)])
    key = np.zeros(n, np.uint64)
    for k in range(h):
        key = (key << np.uint64(bits)) | padded[k : k + n]
    sa = np.argsort(key, kind="stable")
    ordered = key[sa]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    # a rank is the place of the first suffix of its group, so it doesn't change when other groups are split
    rank = np.empty(n, np.int64)
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[sa] = head
    rounds = [(h, rank.copy())]
    tied = np.flatnonzero(~(new & np.r_[new[1:], True]))
    while len(tied):
        at = sa[tied]
        after = at + h
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.lexsort((second, head[tied]))
        at, second = at[order], second[order]
        sa[tied] = at
        group = head[tied]
        new = np.r_[True, (group[1:] != group[:-1]) | (second[1:] != second[:-1])]
        fresh = np.maximum.accumulate(np.where(new, tied, 0))
        head[tied] = fresh
        rank[at] = fresh
        h *= 2
        rounds.append((h, rank.copy()))
        tied = tied[~(new & np.r_[new[1:], True])]
    lcp = np.zeros(n, np.int64)
    i, j, live = sa[:-1].copy(), sa[1:].copy(), np.arange(1, n)
    for h, r in reversed(rounds):
        ok = (i < n) & (j < n)
        same = np.zeros(len(i), bool)
        same[ok] = r[i[ok]] == r[j[ok]]
        lcp[live[same]] += h
        i[same] += h
        j[same] += h
    # what is left is shorter than the first round's run
    for _ in range(rounds[0][0]):
        ok = (i < n) & (j < n)
        ok[ok] = codes[i[ok]] == codes[j[ok]]
        if not ok.any():
            break
        i, j, live = i[ok] + 1, j[ok] + 1, live[ok]
        lcp[live] += 1
    return sa, lcp


def intervals(lcp: np.ndarray, shortest: int) -> list[tuple[int, int, int]]:
    """The lcp intervals (length, first, last): suffixes sa[first..last] share just ``length`` characters, >= shortest."""
    out, stack = [], []
    for i in range(1, len(lcp) + 1):
        now = int(lcp[i]) if i < len(lcp) else 0
        begin = i - 1
        while stack and stack[-1][0] > now:
            length, begin = stack.pop()
            out.append((length, begin, i - 1))
        if now >= shortest and (not stack or stack[-1][0] < now):
            stack.append((now, begin))
    return out


def repeats(text: str, shortest: int = SHORTEST) -> tuple[float, int]:
    """(covered share of characters, longest repeat) of a text. Occurrences may overlap, and the first counts too.

    A suffix's deepest lcp interval is as long as the larger of its two common prefixes; the union of the spans of
    all intervals' occurrences is therefore the union of [i, i + that length) over the suffixes i. Texts in which no
    run of ``shortest`` characters occurs twice are recognised by sorting such runs' hashes, without a suffix array.
    """
    n = len(text)
    if n <= shortest:
        return 0.0, 0
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not _twice(codes, shortest):
        return 0.0, 0
    sa, lcp = suffixes(codes)
    reach = np.maximum(lcp, np.r_[lcp[1:], 0])
    long = reach >= shortest
    if not long.any():
        return 0.0, 0
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, sa[long], 1)
    np.add.at(change, sa[long] + reach[long], -1)
    return float(np.count_nonzero(np.cumsum(change[:-1]) > 0)) / n, int(lcp.max())


def _twice(codes: np.ndarray, n: int) -> bool:
    """Whether any run of n characters may occur twice: true for certain if one does, by hashes of all runs."""
    # every n // 2-th run of n // 2 characters is looked for at all places: a repeat of n characters holds one of them whole
    m = max(1, n // 2)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers(P, len(codes)), out=sums[1:])
    h = mix((sums[m:] - sums[:-m]) * powers(P_INVERSE, len(codes) + 1)[: len(codes) - m + 1])
    grid = np.sort(h[::m])
    if (grid[1:] == grid[:-1]).any():
        return True
    # all places against the grid by a small table first
    bits = max(12, int(len(grid) * 16).bit_length())
    seen = np.zeros(1 << bits, bool)
    shift = np.uint64(64 - bits)
    seen[(grid >> shift).astype(np.int64)] = True
    place = np.arange(len(h))
    maybe = np.flatnonzero(seen[(h >> shift).astype(np.int64)] & (place % m != 0))
    if not len(maybe):
        return False
    found = h[maybe]
    at = np.minimum(np.searchsorted(grid, found), len(grid) - 1)
    return bool((grid[at] == found).any())


def measures(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """One row for each document: SCHEMA. A null text has null measures, an empty one 0.

    Every substring is looked at, whatever the text's length; repeated rows give repeated rows; other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in frame.steps(batch, 1):
                texts = part.column(1).to_pylist()
                found = [(None, None) if t is None else repeats(t, shortest) for t in texts]
                yield pa.record_batch([part.column(0), pa.array([None if t is None else len(t) for t in texts], pa.int64()), pa.array([c for c, _ in found], pa.float64()), pa.array([r for _, r in found], pa.int64())], ["doc_id", "n_chars", "covered", "longest_repeat"])

    return frame.plain(docs, doc_id="long", text="string").mapInArrow(frame.trimmed(run), SCHEMA)


def clean(docs: DataFrame, text: str = "text", shortest: int = SHORTEST, most_covered: float = MOST_COVERED, longest: int = LONGEST) -> DataFrame:
    """The rows of docs whose text repeats itself little, with all columns. Null texts go, empty ones stay."""

    def judge(texts: pa.Array) -> list[bool]:
        found = (None if t is None else repeats(t, shortest) for t in texts.to_pylist())
        return [f is not None and f[0] <= most_covered and f[1] <= longest for f in found]

    return frame.keep_rows(docs, judge, text=text)


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Of all documents those that pass the rule, with its measures."""
    return measures(frame.read(spark, folder, "documents")).where((f"covered <= {MOST_COVERED} AND longest_repeat <= {LONGEST}"))
