"""Near duplicates: documents whose n-gram sets have a Jaccard similarity of at least a threshold, as classes or as pairs.

Identical sets are one set to the search. Sets meet by equal segments of the universe of n-grams (segments.py: by size
bands, by the pigeonhole rule, with one-deletion neighbourhoods, cheapest look-ups first), candidates are sifted by
sketches that can't reject a similar pair, and what is left is verified by whole sets. Pairs are expanded to all
documents that have the sets only where all pairs are asked for.

Pairs within a large group of edited copies are as many as its size squared. Such groups are told by equal pairs of
minimal hashes (clumps) before sets meet: sets of one clump don't meet by segments, but are all compared with each other
by products of matrices, of which just each document's number of links and its least partner are kept. Which sets are in
a clump decides on the work alone: each pair is found either within a clump or by segments.

What is shuffled grows with the n-grams: some ten bytes for each look-up or index row, a sketch of two to four bits for
each n-gram of a candidate, and each set of a similar pair about once, since pairs are compared in blocks by group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachlight.llm import blobs, frame
from reachlight.llm import segments as sg
from reachlight.llm.words import mix

#: Words in an n-gram, and the least similarity.
N, THRESHOLD = 2, 0.6
#: Rows that meet in one step, rows that a task holds before it sends them, bytes of sketches in a chunk, chunks at least.
GROUP, HELD, CHUNK_BYTES, CHUNKS = 1 << 19, 1 << 20, 40 << 20, 4
#: Bytes of sets in a block in which pairs are compared, and pairs of one label in one block at most.
BLOCK_BYTES, SPLIT = 1 << 22, 1_000_000
#: Places of the table of frequencies in a slice, in which it is summed; documents after which a task sends its counts.
SLICE, COUNTED = 1 << 16, 20_000
#: Sets that share a pair of minimal hashes, from which on they are a clump; documents and n-grams in a part of one; n-grams in a product of matrices.
HUB, PART, PART_GRAMS, COLUMNS = 64, 1024, 1 << 19, 2048


def profile(texts: DataFrame, n: int, threshold: float) -> DataFrame:
    """(kind, id, size, h1, h2, data, keys): 0, a document's size, set hash, sketch and pairs of minimal hashes; 1, counts of a slice of the table of frequencies; 2, a band with too few segments for a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, counts, poor, docs = sg.Plan(threshold), np.zeros(1 << sg.BITS, np.uint16), set(), 0

        def out(kind, ids, size, h1, h2, data, keys=None) -> pa.RecordBatch:
            k = len(ids)
            keys = pa.nulls(k, pa.list_(pa.int64())) if keys is None else keys
            return pa.record_batch([pa.array(np.full(k, kind, np.int32)), pa.array(ids, pa.int64()), pa.array(size, pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), data, keys], ["kind", "id", "size", "h1", "h2", "data", "keys"])

        def table() -> pa.RecordBatch:
            slices = [blobs.put(counts[i : i + SLICE]) for i in range(0, 1 << sg.BITS, SLICE)]
            none = np.zeros(len(slices), np.int64)
            return out(1, np.arange(len(slices)), none.astype(np.int32), none, none, pa.array(slices, pa.binary()))

        for batch in batches:
            for part in frame.steps(batch, 1):
                tokens, first = sg.sets(part.column(1).to_pylist(), n)
                for i in range(0, part.num_rows, COUNTED):  # a document adds a few at most to a place
                    np.add.at(counts, sg.place_of(tokens[first[i] : first[min(i + COUNTED, part.num_rows)]]), np.uint16(1))
                    docs += min(COUNTED, part.num_rows - i)
                    if docs >= COUNTED:
                        yield table()
                        docs = 0
                        counts[:] = 0
                poor |= sg.poor_bands(tokens, first, plan)
                data, at = sg.sketches(tokens, first)
                sketch = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])
                keys = sg.minimal(tokens, first)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1]), pa.int32()), pa.array(keys.ravel()))
                full = out(0, part.column(0), np.diff(first), *sg.set_hashes(tokens, first), sketch, lists)
                yield full.filter(pa.array(np.diff(first) > 0))
        yield table()
        none = np.zeros(len(poor), np.int64)
        yield out(2, np.array(sorted(poor), np.int64), none.astype(np.int32), none, none, pa.array([None] * len(poor), pa.binary()))

    return texts.mapInArrow(frame.trimmed(run), "kind int, id long, size int, h1 long, h2 long, data binary, keys array<long>")


def cost_table(known: DataFrame) -> np.ndarray:
    """A byte for each place of the table of frequencies, whatever the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[i] = sums.get(i, 0) + blobs.get(data)[0].astype(np.int64)
        yield pa.record_batch([pa.array(list(sums), pa.int64()), pa.array([sg.costs(c).tobytes() for c in sums.values()], pa.binary())], ["id", "data"])

    table = np.zeros(1 << sg.BITS, np.uint8)
    for r in known.where("kind = 1").select("id", "data").repartition("id").mapInArrow(frame.trimmed(run), "id long, data binary").collect():
        table[r.id * SLICE : (r.id + 1) * SLICE] = np.frombuffer(r.data, np.uint8)
    return table


def _sent(rows: sg.Rows, ids: np.ndarray, size: np.ndarray, clump: np.ndarray, groups: int, plan: sg.Plan) -> Iterator[pa.RecordBatch]:
    """The rows as blobs, one for each group of signatures."""
    if len(rows) < 1 << 24:
        key = (rows.sig << np.uint64(24)) | np.arange(len(rows)).astype(np.uint64)
        key.sort()
        order = (key & sg.LOW24).astype(np.int64)
    else:
        order = np.argsort(rows.sig)
    sig, doc, flags, before = rows.sig[order], rows.doc[order], rows.flags[order], rows.before[order]
    code = (255 * rows.rank[order] // (plan.indexed(size)[doc] + 1)).astype(np.uint8)
    group = ((sig * np.uint64(groups)) >> np.uint64(40)).astype(np.int64)
    # each group's documents by their ids, found for all groups at once, as there are many of few rows in large tables
    by_id = np.argsort(ids, kind="stable")
    place = np.empty(len(size), np.int64)
    place[by_id] = np.arange(len(size))
    held, which = np.unique(group * len(size) + place[doc], return_inverse=True)
    in_group, held = held // len(size), by_id[held % len(size)]
    of = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    edge, edge_held = np.r_[of, len(group)].tolist(), np.r_[np.searchsorted(in_group, group[of]), len(held)].tolist()
    held_ids, held_size, held_clump = ids[held], size[held].astype(np.uint32), clump[held]
    out_group, out = group[of], []
    for lo, hi, first, last in zip(edge[:-1], edge[1:], edge_held[:-1], edge_held[1:]):
        at, here = slice(lo, hi), slice(first, last)
        kind = np.uint16 if last - first <= 1 << 16 else np.uint32
        out.append(blobs.put(blobs.steps(held_ids[here]), held_size[here], held_clump[here], blobs.steps(sig[at]), (which[at] - first).astype(kind), code[at], flags[at], before[at]))
    yield pa.record_batch([pa.array(out_group, pa.int32()), pa.array(out, pa.binary())], ["group", "data"])


def signatures(texts: DataFrame, n: int, threshold: float, cost: np.ndarray, poor: set[int], groups: int) -> DataFrame:
    """(group, data): look-ups and index rows of all sets of (doc_id, text, clump), packed by ranges of their signatures."""
    sent = texts.sparkSession.sparkContext.broadcast((cost, poor))  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, held = sg.Plan(threshold), []

        def out() -> Iterator[pa.RecordBatch]:
            start = np.cumsum([0] + [len(i) for _, i, *_ in held])
            for (rows, *_), s in zip(held, start):
                rows.doc = rows.doc + s
            rows = sg.Rows.joined([r for r, *_ in held])
            if len(rows):
                yield from _sent(rows, *[np.concatenate([h[k] for h in held]) for k in (1, 2, 3)], groups, plan)
            held.clear()

        for batch in batches:
            for part in frame.steps(batch, 1):
                tokens, first = sg.sets(part.column(1).to_pylist(), n)
                held.append((sg.rows_of(tokens, first, sent.value[0], plan, sent.value[1]), part.column(0).to_numpy(), np.diff(first), part.column(2).to_numpy()))
                if sum(len(r) for r, *_ in held) > HELD:
                    yield from out()
        yield from out()

    return texts.mapInArrow(frame.trimmed(run), "group int, data binary")


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list]]]:
    """(key, the other columns' values) of rows that are ordered by their first column."""
    key, held = None, []
    for batch in batches:
        keys = batch.column(0).to_numpy()
        edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True]) if len(keys) else np.zeros(0, np.int64)
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if keys[lo] != key:
                if held:
                    yield key, held
                key, held = keys[lo], [[] for _ in batch.columns[1:]]
            for h, c in zip(held, batch.columns[1:]):
                h.extend(c.slice(lo, hi - lo).to_pylist())
    if held:
        yield key, held


def _pair_blobs(a: np.ndarray, b: np.ndarray, key: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(key, blob) of distinct pairs."""
    order = np.argsort(key, kind="stable")
    edge = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1], True])
    for lo, hi in zip(edge[:-1], edge[1:]):
        at = order[lo:hi]
        ids = np.unique(np.concatenate([a[at], b[at]]))
        code = np.unique(np.searchsorted(ids, a[at]) * len(ids) + np.searchsorted(ids, b[at]))
        yield int(key[at[0]]), blobs.put(blobs.steps(ids), blobs.steps(code))


def _pairs_of(many: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of blobs, in order."""
    got = [[blobs.sums(x) for x in blobs.get(m)] for m in many]
    ids = np.unique(np.concatenate([i.view(np.int64) for i, _ in got]))
    codes = []
    for own, code in got:
        at, k = np.searchsorted(ids, own.view(np.int64)), np.uint64(len(own))
        codes.append(at[(code // k).astype(np.int64)] * len(ids) + at[(code % k).astype(np.int64)])
    code = np.unique(np.concatenate(codes))
    return ids[code // len(ids)], ids[code % len(ids)]


def chunk_of(ids: np.ndarray, chunks: int) -> np.ndarray:
    return (mix(ids.view(np.uint64)) % np.uint64(chunks)).astype(np.int64)


def candidates(rows: DataFrame, threshold: float, chunks: int) -> DataFrame:
    """(block, data): pairs (a, b), a < b, of documents that meet in a signature, may be similar by sizes and ranks and
    aren't of one clump, by the chunks of both. A pair may come several times."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = sg.Plan(threshold)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                a, b = (np.concatenate(x) for x in zip(*held))
                held.clear()
                x, y = chunk_of(a, chunks), chunk_of(b, chunks)
                found = list(_pair_blobs(a, b, np.minimum(x, y) * chunks + np.maximum(x, y)))
                yield pa.record_batch([pa.array([k for k, _ in found], pa.int32()), pa.array([d for _, d in found], pa.binary())], ["block", "data"])

        for _, (many,) in _by_key(batches):
            got = [blobs.get(m) for m in many]
            columns = [[] for _ in range(7)]
            for ids, size, clump, sig, which, code, flags, before in got:
                doc = which.astype(np.int64)
                s = size.astype(np.int64)[doc]
                rank = -(-(code.astype(np.int64) * (plan.indexed(s) + 1)) // 255)  # no more than the rank that was
                for c, v in zip(columns, (blobs.sums(sig), blobs.sums(ids).view(np.int64)[doc], s, rank, flags, before, clump[doc])):
                    c.append(v)
            *columns, clump = [np.concatenate(c) for c in columns]
            for a, b in sg.met(*columns, plan, clump):
                if len(a):
                    held.append((a, b))
                    if sum(len(x) for x, _ in held) > HELD:
                        yield from out()
        yield from out()

    return rows.repartition("group").sortWithinPartitions("group").mapInArrow(frame.trimmed(meet), "block int, data binary")


def sifted(pairs: DataFrame, own: DataFrame, threshold: float, chunks: int) -> DataFrame:
    """Distinct pairs (a, b) of candidates() whose sketches may be of similar sets; own: (id, size, data) with sketches.

    Sketches go to the blocks in chunks, each to as many blocks as there are chunks; pairs become rows only after that.
    """

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, size = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            chunk = chunk_of(ids, chunks)
            for c in np.unique(chunk).tolist():
                at = np.flatnonzero(chunk == c)
                flat = np.frombuffer(b"".join(batch.column(2).take(pa.array(at)).to_pylist()), np.uint64)
                data = blobs.put(ids[at], size[at], flat)
                to = sorted({min(c, k) * chunks + max(c, k) for k in range(chunks)})
                yield pa.record_batch([pa.array(to, pa.int32()), pa.array([True] * len(to)), pa.array([data] * len(to), pa.binary())], ["block", "sketches", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, sift = None, [], None
        for batch in batches:
            for block, first, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if block != key:
                    key, held, sift = block, [], None
                if first:
                    held.append(blobs.get(data.as_py()))
                    continue
                if sift is None:  # a block's sketches come before its pairs
                    sift, held = Sieve(*[np.concatenate(c) for c in zip(*held)], threshold), []
                a, b = _pairs_of([data.as_py()])
                keep = sift.keep(a, b)
                yield pa.record_batch([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    sent = own.mapInArrow(frame.trimmed(sketches), "block int, sketches boolean, data binary").union(pairs.select("block", F.lit(False), "data"))
    return sent.repartition("block").sortWithinPartitions("block", F.desc("sketches")).mapInArrow(frame.trimmed(run), "a long, b long").distinct()


def placed(pairs: DataFrame, blocks: int) -> DataFrame:
    """(block, a, b): each pair with the block that it is compared in.

    A document's label is its least partner's least partner, so that nearly all of a group of copies have one label
    and a set is sent to few places, however many partners it has. Labels of very many pairs are split by b.
    """
    least = pairs.select(F.col("a").alias("doc"), F.col("b").alias("to")).union(pairs.select("b", "a")).groupBy("doc").agg(F.least(F.col("doc"), F.min("to")).alias("label"))
    first = frame.stored(least)
    second = first.join(frame.sized(first.select(F.col("doc").alias("label"), F.col("label").alias("far")), 16), "label").select(F.col("doc").alias("b"), F.col("far").alias("label"))
    labelled = frame.stored(pairs.join(frame.sized(second, 16), "b").select("a", "b", "label"))
    many = labelled.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > SPLIT)
    parts = F.coalesce(F.ceil(F.col("n") / SPLIT), F.lit(1).cast("long"))
    split = labelled.join(frame.sized(many, 16), "label", "left")
    return split.select(F.pmod(F.xxhash64("label", F.pmod(F.xxhash64("b"), parts)), F.lit(blocks)).cast("int").alias("block"), "a", "b")


Compare = Callable[[np.ndarray, list, np.ndarray, np.ndarray], pa.RecordBatch]


def compared(pairs: DataFrame, blocks: int, payload: Callable[[DataFrame], DataFrame], compare: Compare, schema: str) -> DataFrame:
    """What ``compare`` makes of each block's documents and pairs.

    payload(need) gives (block, doc, data) for need, (doc_id, blocks) of all documents in pairs.
    """
    pairs = placed(pairs, blocks)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = list(_pair_blobs(batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(0).to_numpy()))
                yield pa.record_batch([pa.array([k for k, _ in found], pa.int32()), pa.nulls(len(found), pa.int64()), pa.array([d for _, d in found], pa.binary())], ["block", "doc", "data"])

    need = pairs.select("block", F.explode(F.array("a", "b")).alias("doc_id")).distinct().groupBy("doc_id").agg(F.collect_list("block").alias("blocks"))
    held, asked = payload(frame.stored(need)), pairs.mapInArrow(frame.trimmed(pack), "block int, doc long, data binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (docs, data) in _by_key(batches):
            own = [i for i, d in enumerate(docs) if d is not None]
            asks = [x for d, x in zip(docs, data) if d is None]
            yield compare(np.array([docs[i] for i in own], np.int64), [data[i] for i in own], *_pairs_of(asks))

    return held.unionByName(asked).repartition("block").sortWithinPartitions("block").mapInArrow(frame.trimmed(run), schema)


def _rows_of_pairs(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, pair) for ascending ids; an id that has several rows is taken with each."""
    fa, fb = np.searchsorted(ids, a), np.searchsorted(ids, b)
    na, nb = np.searchsorted(ids, a, "right") - fa, np.searchsorted(ids, b, "right") - fb
    many = na * nb
    pair = np.repeat(np.arange(len(a)), many)
    k = np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many)
    return fa[pair] + k // nb[pair], fb[pair] + k % nb[pair], pair


class Sieve:
    """Sketches of documents, for pairs whose sketches differ in no more places than their sets may in n-grams."""

    def __init__(self, ids: np.ndarray, size: np.ndarray, flat: np.ndarray, threshold: float):
        order = np.argsort(ids, kind="stable")
        words = np.where(size > 0, sg.sketch_bits(size) // 64, 0)
        self.plan, self.flat = sg.Plan(threshold), flat
        self.ids, self.size, self.words, self.at = (c[order] for c in (ids, size.astype(np.int64), words, np.cumsum(words) - words))

    def keep(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Places of the pairs that stay, in order."""
        ra, rb, pair = _rows_of_pairs(self.ids, a, b)
        less = self.words[ra] <= self.words[rb]
        small, large = np.where(less, ra, rb), np.where(less, rb, ra)
        w_small, w_large = self.words[small], self.words[large]
        differ = np.zeros(len(pair), np.int64)
        for w in np.unique(w_small):
            for w2 in np.unique(w_large[w_small == w]):
                fold, where = w2 // w, np.flatnonzero((w_small == w) & (w_large == w2))
                for i in range(0, len(where), max(1, (1 << 20) // int(w2))):
                    now = where[i : i + max(1, (1 << 20) // int(w2))]
                    x = self.flat[self.at[small[now]][:, None] + np.arange(w)]
                    y = self.flat[self.at[large[now]][:, None] + np.arange(w2)].reshape(len(now), fold, w)
                    differ[now] = np.bitwise_count(x ^ np.bitwise_xor.reduce(y, axis=1)).sum(axis=1)
        return np.unique(pair[differ <= self.plan.exact(self.size[ra], self.size[rb])])


def sifting(threshold: float) -> Compare:
    """Pairs that a Sieve keeps, of sketches that each follow four bytes of their set's size."""

    def compare(ids: np.ndarray, data: list, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        size = np.array([int.from_bytes(d[:4], "little") for d in data], np.int64)
        keep = Sieve(ids, size, np.frombuffer(b"".join(d[4:] for d in data), np.uint64), threshold).keep(a, b)
        return pa.record_batch([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    return compare


def verifying(threshold: float) -> Compare:
    """The Jaccard similarity of the pairs that are similar enough; of several rows with one id the most similar counts."""

    def compare(ids: np.ndarray, data: list, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(ids, kind="stable")
        ids, sets = ids[order], [unpack(data[i]) for i in order]
        size = np.array([len(s) for s in sets], np.int64)
        start = np.cumsum(size) - size
        _, codes = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True)
        ra, rb, pair = _rows_of_pairs(ids, a, b)
        order = np.argsort(ra, kind="stable")
        ra, rb, pair = ra[order], rb[order], pair[order]
        mark = np.zeros(int(codes.max(initial=0)) + 1, bool)
        common = np.zeros(len(pair), np.int64)
        edge = np.flatnonzero(np.r_[True, ra[1:] != ra[:-1], True]) if len(ra) else np.zeros(0, np.int64)
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
            mine = codes[start[ra[lo]] : start[ra[lo]] + size[ra[lo]]]
            mark[mine] = True
            for i in range(lo, hi, 2000):
                r = rb[i : min(hi, i + 2000)]
                n = size[r]
                where = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[r], n)
                common[i : i + len(r)] = np.add.reduceat(mark[codes[where]].astype(np.int64), np.cumsum(n) - n)
            mark[mine] = False
        jaccard = np.zeros(len(a))
        np.maximum.at(jaccard, pair, common / np.maximum(1, size[ra] + size[rb] - common))
        keep = np.flatnonzero(jaccard >= threshold - 1e-12)
        return pa.record_batch([pa.array(a[keep]), pa.array(b[keep]), pa.array(jaccard[keep])], ["doc_a", "doc_b", "jaccard"])

    return compare


def pack(tokens: np.ndarray) -> bytes:
    """A set as the differences of its n-grams, in planes of five bytes."""
    return np.ascontiguousarray(blobs.steps(tokens).view(np.uint8).reshape(-1, 8)[:, :5].T).tobytes()


def unpack(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(packed, np.uint8).reshape(5, -1).T
    return blobs.sums(out.view(np.uint64).ravel())


def clumps(own: DataFrame) -> DataFrame:
    """(doc, clump, size): the sets of (id, size, keys) that share a key with HUB sets or more. A clump is named after the least document of such a key."""
    keyed = own.select("id", "size", F.explode("keys").alias("key"))
    hubs = frame.stored(keyed.groupBy("key").agg(F.min("id").alias("lead"), F.count("*").alias("n")).where(F.col("n") >= HUB).select("key", "lead"))
    named = keyed.join(frame.sized(hubs, 16), "key").groupBy("id").agg(F.min("lead").alias("lead"), F.first("size").alias("size"))
    return frame.stored(named.select(F.col("id").alias("doc"), F.xxhash64("lead").bitwiseOR(F.lit(1)).alias("clump"), "size"))  # never 0, which is none


def common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each set of ``a`` and each of ``b`` share."""
    out = np.zeros((len(a), len(b)), np.float32)
    sides = []
    for sets in (a, b):
        flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
        sides.append((flat, np.repeat(np.arange(len(sets)), [len(s) for s in sets])))
    both = np.intersect1d(sides[0][0], sides[1][0])
    for k, (flat, row) in enumerate(sides):
        at = np.minimum(np.searchsorted(both, flat), max(0, len(both) - 1))
        on = both[at] == flat if len(both) else np.zeros(len(flat), bool)
        at, row = at[on], row[on]
        order = np.argsort(at, kind="stable")
        sides[k] = (at[order], row[order], len((a, b)[k]))
    for c in range(0, len(both), COLUMNS):
        ones = []
        for at, row, count in sides:
            lo, hi = np.searchsorted(at, [c, c + COLUMNS])
            m = np.zeros((count, min(COLUMNS, len(both) - c)), np.float32)
            m[row[lo:hi], at[lo:hi] - c] = 1
            ones.append(m)
        out += ones[0] @ ones[1].T
    return out


def within(clumped: DataFrame, texts: DataFrame, n: int, threshold: float, every: bool) -> DataFrame:
    """Similar pairs of one clump (doc_a, doc_b, jaccard); if not ``every``, (doc, least, links) instead: for each block of
    pairs, a document's least one that pairs lead to, and its partners' documents. clumped: (doc, clump, size, n), with n documents of a set."""
    whole = clumped.groupBy("clump").agg(F.greatest(F.ceil(F.count("*") / PART), F.ceil(F.sum("size") / PART_GRAMS)).alias("parts"))
    told = clumped.join(frame.sized(frame.stored(whole), 16), "clump").withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts")))
    told = frame.stored(told.select("doc", "clump", "n", F.col("part").cast("int").alias("part"), F.col("parts").cast("int").alias("parts")))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in frame.steps(batch, 1):
                tokens, first = sg.sets(part.column(1).to_pylist(), n)
                packed = pa.array([pack(tokens[first[i] : first[i + 1]]) for i in range(part.num_rows)], pa.binary())
                yield pa.record_batch([*[part.column(i) for i in (0, 2, 3, 4, 5)], packed], ["doc", "clump", "n", "part", "parts", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (docs, many, part, other, data) in _by_key(batches):
            ids, at = np.unique(np.array(docs, np.int64), return_index=True)  # rows that are all alike are one document
            part, many, data, itself = np.array(part)[at], np.array(many, np.int64)[at], [unpack(data[i]) for i in at], part[0] == other[0]
            low = part == min(part[0], other[0])
            a, b = np.flatnonzero(low), np.flatnonzero(low if itself else ~low)
            size = np.array([len(x) for x in data])
            both = common([data[i] for i in a], [data[i] for i in b]).astype(np.float64)
            both /= np.maximum(1, size[a][:, None] + size[b] - both)
            if itself:
                both[np.tril_indices(len(a)) if every else np.diag_indices(len(a))] = 0
            close = both >= threshold - 1e-12
            if every:
                x, y = np.nonzero(close)
                x, y, j = ids[a[x]], ids[b[y]], both[close]
                yield pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(j)], ["doc_a", "doc_b", "jaccard"])
                continue
            count = np.zeros(len(ids), np.int64)
            count[a] = close @ many[b]
            count[b] = many[a] @ close
            least, before = np.arange(len(ids)), None
            while len(a) and len(b) and (before is None or (least != before).any()):
                before = least.copy()
                least[a] = np.minimum(least[a], np.where(close, least[b], len(ids)).min(axis=1))
                least[b] = np.minimum(least[b], np.where(close, least[a][:, None], len(ids)).min(axis=0))
            on = count > 0
            yield pa.record_batch([pa.array(ids[on]), pa.array(ids[least[on]]), pa.array(count[on])], ["doc", "least", "links"])

    sets = texts.join(frame.sized(told, 32), F.col("doc_id") == F.col("doc")).select("doc_id", "text", "clump", "n", "part", "parts").mapInArrow(frame.trimmed(make), "doc long, clump long, n long, part int, parts int, data binary")
    each = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # two parts meet in one block; a block of a part with itself has each set once
    block = F.xxhash64("clump", F.least("part", "other"), F.greatest("part", "other"))
    sent = each.select(block.alias("block"), "doc", "n", "part", "other", "data").repartition("block").sortWithinPartitions("block")
    return sent.mapInArrow(frame.trimmed(run), "doc_a long, doc_b long, jaccard double" if every else "doc long, least long, links long")


def links(texts: DataFrame, n: int, threshold: float, every: bool) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(pairs, inner, twins, sets) of (doc_id, text), where a doc_id has one text: similar pairs (doc_a, doc_b, jaccard) of
    documents of which one stands for each distinct set; the pairs within clumps, as within() gives them; (doc, least) of
    all others and the one that stands for them; (least, n) of those that stand for n documents, if several."""
    known = frame.stored(profile(texts, n, threshold))
    cost, poor = cost_table(known), {r.id for r in known.where("kind = 2").select("id").distinct().collect()}  # one for each band at most
    own = known.where("kind = 0")
    grams = own.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    groups, compare = max(1, ceil(grams / GROUP)), max(1, ceil(5 * grams / BLOCK_BYTES))
    chunks = max(min(CHUNKS, groups), ceil(0.3 * grams / CHUNK_BYTES))  # sketches take some 0.3 bytes for each n-gram
    # the least document of each set stands for it
    same = frame.stored(own.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1"))
    twins = frame.stored(own.select("id", "h1", "h2").join(frame.sized(same.drop("n"), 24), ["h1", "h2"]).where("id != least").select(F.col("id").alias("doc"), "least").distinct())
    rest = texts.join(frame.sized(twins, 8), F.col("doc_id") == F.col("doc"), "left_anti")
    stand = same.select("least", "n")
    clumped = clumps(own.select("id", "size", "keys").join(frame.sized(twins, 8), F.col("id") == F.col("doc"), "left_anti"))
    known_n = clumped.join(frame.sized(stand, 16), F.col("doc") == F.col("least"), "left").select("doc", "clump", "size", F.coalesce("n", F.lit(1).cast("long")).alias("n"))
    inner = frame.stored(within(frame.stored(known_n), rest, n, threshold, every))
    rest = rest.join(frame.sized(clumped, 16), F.col("doc_id") == F.col("doc"), "left").select("doc_id", "text", F.coalesce("clump", F.lit(0).cast("long")).alias("clump"))
    met = candidates(signatures(rest, n, threshold, cost, poor, groups), threshold, chunks)

    def whole(need: DataFrame) -> DataFrame:
        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in frame.steps(batch, 1):
                    tokens, first = sg.sets(part.column(1).to_pylist(), n)
                    packed = pa.array([pack(tokens[first[i] : first[i + 1]]) for i in range(part.num_rows)], pa.binary())
                    blocks = part.column(2)
                    row = pa.array(np.repeat(np.arange(len(packed)), np.diff(blocks.offsets.to_numpy())))
                    yield pa.record_batch([blocks.flatten(), part.column(0).take(row), packed.take(row)], ["block", "doc", "data"])

        return texts.join(frame.sized(need, 64), "doc_id").select("doc_id", "text", "blocks").mapInArrow(frame.trimmed(make), "block int, doc long, data binary")

    left = frame.stored(sifted(met, own.select("id", "size", "data"), threshold, chunks))
    return compared(left, compare, whole, verifying(threshold), "doc_a long, doc_b long, jaccard double"), inner, twins, stand


def expanded(pairs: DataFrame, twins: DataFrame) -> DataFrame:
    """(x, y, jaccard): the pairs of all documents, from those of one for each set."""
    least = twins.select("least").distinct()
    members = frame.stored(twins.union(least.select("least", "least")))
    other = members.select(F.col("doc").alias("doc2"), F.col("least").alias("least2"))
    sent, sent2 = frame.sized(members, 16), frame.sized(other, 16)
    wide = pairs.join(sent, F.col("doc_a") == F.col("least"), "left").join(sent2, F.col("doc_b") == F.col("least2"), "left")
    within = members.join(sent2, F.col("least") == F.col("least2")).where("doc < doc2").select(F.col("doc").alias("x"), F.col("doc2").alias("y"), F.lit(1.0).alias("jaccard"))
    return wide.select(F.coalesce("doc", "doc_a").alias("x"), F.coalesce("doc2", "doc_b").alias("y"), "jaccard").union(within)


def _checked(threshold: float) -> None:
    if not 0.5 <= threshold <= 1:
        raise ValueError("threshold must be from 0.5 to 1")


def _repeated(texts: DataFrame) -> bool:
    return texts.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() > 0


def _joins(inner: DataFrame) -> DataFrame:
    """Pairs that join the same groups as those within clumps; their similarity isn't told."""
    return inner.where("doc != least").select("least", "doc", F.lit(None).cast("double"))


def _edges(docs: DataFrame, n: int, threshold: float, every: bool) -> DataFrame:
    """(doc_a, doc_b, jaccard): all pairs, or, if not ``every``, pairs that join the same groups."""
    _checked(threshold)
    texts = frame.plain(docs, doc_id="long", text="string").where("doc_id IS NOT NULL AND text IS NOT NULL")
    repeated = _repeated(texts)
    key = F.xxhash64("doc_id", "text")
    # where a doc_id has several rows, each text of it is searched by a key of its own
    pairs, inner, twins, _ = links(texts.select(key.alias("doc_id"), "text") if repeated else texts, n, threshold, every)
    if every:
        found = expanded(pairs.union(inner), twins)
    else:
        found = pairs.toDF("x", "y", "jaccard").union(_joins(inner)).union(twins.select("least", "doc", F.lit(1.0)))
    if repeated:
        ids = frame.stored(texts.select(key.alias("x"), F.col("doc_id").alias("u")).distinct())
        found = found.join(frame.sized(ids, 16), "x").join(frame.sized(ids.toDF("y", "v"), 16), "y").select(F.col("u").alias("x"), F.col("v").alias("y"), "jaccard").where("x != y")
    found = found.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "jaccard")
    return found.groupBy("doc_a", "doc_b").agg(F.max("jaccard").alias("jaccard")) if repeated else found


def similar(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_a, doc_b, jaccard), doc_a < doc_b: every pair of documents whose n-gram sets are at least so similar.

    Whole texts are compared, every document is looked up, and there is no limit on partners. N-grams are of lower-cased
    words and told apart by 40 bits of their hashes, identical sets by 128; a pair is lost only if different signatures
    have one print of 32 bits, that is with a chance of some 1e-9, or if more
    segments are lost than segments.py reckons with, which has a chance of that order for a pair of the least
    similarity and far less above. Null ids, null texts and texts without words are in no
    pair. Rows that repeat a doc_id are one document: it isn't paired with itself, and of different texts the most
    similar counts. Ties in size or similarity change nothing. An empty table gives no rows; other columns aren't read.
    """
    return _edges(docs, n, threshold, True)


def groups(pairs: DataFrame) -> DataFrame:
    """(doc, least): each document of a pair with the least doc_id that pairs lead to from it.

    Each round every document points to its least neighbour, pointers are followed to their ends, and pairs are
    replaced by those of the ends, until none is left; a group of copies takes one or two rounds.
    """
    edges = frame.stored(pairs.select(F.col("doc_a").alias("u"), F.col("doc_b").alias("v")).distinct())
    labels = frame.stored(edges.select("u").union(edges.select("v")).distinct().select(F.col("u").alias("doc"), F.col("u").alias("least")))
    while not edges.isEmpty():
        both = edges.union(edges.select("v", "u"))
        points = frame.stored(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("to")))
        while True:
            far = points.select(F.col("u").alias("w"), F.col("to").alias("end"))
            new = frame.stored(points.join(far, points["to"] == far["w"]).select("u", F.col("end").alias("to"), (F.col("end") != F.col("to")).alias("moved")))
            points = new.select("u", "to")
            if new.where("moved").isEmpty():
                break
        ends = points.select(F.col("u").alias("least"), F.col("to"))
        labels = frame.stored(labels.join(ends, "least", "left").select("doc", F.coalesce("to", "least").alias("least")))
        a, b = points.toDF("u", "eu"), points.toDF("v", "ev")
        edges = frame.stored(edges.join(a, "u").join(b, "v").where("eu != ev").select(F.least("eu", "ev").alias("u"), F.greatest("eu", "ev").alias("v")).distinct())
    return labels


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs without those documents that are in a group with a lesser doc_id, with all columns.

    Groups are joined by pairs of similar(); identical sets aren't paired with each other, one pair leads from each to
    the least. Null ids stay, and so do null texts and texts without words. Rows that repeat a doc_id are one document:
    all of them stay or go. An empty table stays empty.
    """
    at = frame.position(docs, doc_id)
    edges = _edges(frame.plain(docs, **{doc_id: "long", text: "string"}).toDF("doc_id", "text"), n, threshold, False)
    gone = frame.stored(groups(edges).where("doc != least").select(F.col("doc").alias("gone")))
    bare = frame.unnamed(docs)
    return bare.join(frame.sized(gone, 8), F.col(f"c{at}").cast("long") == F.col("gone"), "left_anti").toDF(*docs.columns)


def classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, links): each document with the least doc_id that pairs of similar() lead to from it, its own if
    there is none, and with the number of documents that it is paired with, identical ones included.

    Every pair counts, but none is a row. Ids that are null are left out; null texts and texts without words have no
    links. Rows that repeat a doc_id are one document, as in similar(), and only where there are such rows are all pairs
    made, as partners then have to be told apart by their ids. An empty table gives no rows; other columns aren't read.
    """
    _checked(threshold)
    rows = frame.plain(docs, doc_id="long", text="string").where("doc_id IS NOT NULL")
    texts = rows.where("text IS NOT NULL")
    none = F.lit(None).cast("long")
    if _repeated(texts):
        pairs = frame.stored(similar(docs, n, threshold).select("doc_a", "doc_b"))
        linked = pairs.union(pairs.select("doc_b", "doc_a")).groupBy("doc_a").agg(F.count("*").alias("links"))
        told = groups(pairs).select("doc", F.col("least").alias("class"), F.lit(0).cast("long").alias("links")).union(linked.select("doc_a", none, "links"))
        twins = rows.sparkSession.createDataFrame([], "doc long, least long")
    else:
        pairs, inner, twins, sets = links(texts, n, threshold, False)
        pairs = frame.stored(pairs)
        joins = groups(pairs.union(_joins(inner)))
        ends = pairs.select(F.col("doc_a").alias("doc"), F.col("doc_b").alias("to")).union(pairs.select("doc_b", "doc_a"))
        linked = ends.join(frame.sized(sets, 16), F.col("to") == F.col("least"), "left").select("doc", none, F.coalesce("n", F.lit(1).cast("long")).alias("links"))
        told = joins.select("doc", F.col("least").alias("class"), F.lit(0).cast("long").alias("links")).union(linked).union(inner.select("doc", none, "links")).union(sets.select("least", none, F.col("n") - 1))
    told = frame.stored(told.groupBy("doc").agg(F.max("class").alias("class"), F.sum("links").alias("links")).toDF("set", "class", "links"))
    ids = rows.select("doc_id").distinct().join(frame.sized(twins, 16), F.col("doc_id") == F.col("doc"), "left").select("doc_id", F.coalesce("least", "doc_id").alias("own"))
    found = ids.join(frame.sized(told, 24), F.col("own") == F.col("set"), "left")
    return found.select("doc_id", F.coalesce("class", "own").alias("class_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its class of near duplicates and its number of links."""
    return classes(frame.read(spark, folder, "documents"))
