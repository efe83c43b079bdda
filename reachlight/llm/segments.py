"""Sets of n-grams, and the look-ups that make similar sets meet: numpy only, for many sets at once.

Sets whose sizes lie in one band share one partition of the universe of n-grams into segments. Two sets of s <= t
n-grams with at least the least similarity differ in at most H = floor(c (s + t)) n-grams, so that a set has at most H
segments that the other doesn't have just the same. All sets rank their segments alike, by the cost of looking one up
and then by its hash: the first segment of that order that two similar sets have in common is among the first H + 1 of
both.

H + 1 counts every differing n-gram as a lost segment of either set. An n-gram that only the other set has costs a set
a segment just if it falls into one that the set has, and where it falls is the hash's choice, made before any ranking
by cost. So of a set's segments at most those are lost that its own differing n-grams lie in, and as many as a binomial
variable says of the other's; its upper bound holds but for a chance of e ** -SURE, whichever segments are cheap. Where
that is less than H, it is taken.

One n-gram of DEEP lies in larger segments, which are indexed with their one-deletion neighbourhoods as well: such a
look-up fails only if two n-grams or more differ in it, so it stands for two others, and a set takes it where it is
cheaper than they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor

import numpy as np

from reachlight.llm.words import Words, grams, mix

#: Sets whose band ends below SMALL have each n-gram as a segment of its own; others have so many n-grams in a segment on average.
SMALL, LOAD = 36, 1 / 16
#: One n-gram of DEEP is in a segment with a neighbourhood; n-grams in such a segment on average.
DEEP, LOAD_DEEP = 64, 3.0
#: Places of the table of n-gram frequencies, 2 ** BITS, a byte each.
BITS = 24
#: From this size on, too few segments for H + 1 look-ups have a chance below 1e-30 and aren't looked for.
NEVER_POOR = 200
#: Minus the logarithm of the chance that more segments are lost than is reckoned with.
SURE = 21.0
#: Pairs of minimal hashes for each set, by which large groups of similar sets are told.
KEYS = 6
#: Pairs that are looked at at once.
BLOCK = 1 << 19

PROBE, INDEX, PROBE_LESS, INDEX_LESS = 1, 2, 4, 8
TOKEN = np.uint64((1 << 40) - 1)
LOW24 = np.uint64((1 << 24) - 1)


def u64(x) -> np.uint64:
    return np.uint64(x)


def sets(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, first): each text's distinct n-grams, 40 bits of their hashes, ascending; first has the total at its end.

    A text of fewer than n words has one n-gram, of all its words; one without words has none.
    """
    words = Words(texts)
    h, doc = grams(words.hashes, words.first, n)
    for k in range(1, n):
        few = np.flatnonzero(words.count == k)
        if len(few):
            own = np.zeros(len(few), np.uint64)
            for j in range(k):
                own = mix(own * np.uint64(31) + words.hashes[words.first[few] + j])
            h, doc = np.concatenate([h, own]), np.concatenate([doc, few])
    key = (doc.astype(np.uint64) << u64(40)) | (h >> u64(24))
    key.sort()
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    return key & TOKEN, np.searchsorted(key >> u64(40), np.arange(len(texts) + 1).astype(np.uint64))


def set_hashes(tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set, in two numbers."""
    sums = []
    for salt in (0x1B873593, 0x2545F4914F6CDD1D):
        total = np.zeros(len(tokens) + 1, np.uint64)
        np.cumsum(mix(tokens ^ u64(salt)), out=total[1:])
        sums.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
    return sums[0], sums[1]


def minimal(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(sets, KEYS): pairs of minimal hashes. Sets of a similarity j share each of them with a chance of j squared; sets without n-grams have zeros."""
    keys = np.zeros((len(first) - 1, KEYS), np.int64)
    have = np.flatnonzero(np.diff(first) > 0)
    for k in range(KEYS if len(have) else 0):
        h = mix(tokens ^ u64(0x3C6EF372 + (k << 40)))
        low, high = np.minimum.reduceat(h & u64(0xFFFFFFFF), first[have]), np.minimum.reduceat(h >> u64(32), first[have])
        keys[have, k] = mix((high << u64(32) | low) + u64(k)).view(np.int64)
    return keys


def sketch_bits(size: np.ndarray) -> np.ndarray:
    """Bits of a set's sketch: a power of two, at least 64 and one and a half times the size."""
    return np.maximum(64, 1 << np.ceil(np.log2(np.maximum(1.5 * size, 2))).astype(np.int64))


def sketches(tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): for each set the parity of the n-grams at each place. Two sketches differ in no more places than their sets in n-grams."""
    size = np.diff(first)
    bits = np.where(size > 0, sketch_bits(size), 0)
    at = np.r_[0, np.cumsum(bits)]
    doc = np.repeat(np.arange(len(size)), size)
    place = at[doc] + (mix(tokens ^ u64(0x7F4A7C15)) & (bits[doc] - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(place, minlength=int(at[-1])) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little"), at // 8


def _tails() -> np.ndarray:
    """Least k, for means of 0, 1/8, 2/8, ..., that a sum of independent hits reaches with a chance of at most e ** -SURE (Chernoff)."""
    mean = np.arange(1, 1 << 15) / 8
    low, high = mean.copy(), mean + 10 * SURE + 10 * np.sqrt(SURE * mean)
    for _ in range(60):
        k = (low + high) / 2
        over = k * np.log(k / mean) - k + mean >= SURE
        low, high = np.where(over, low, k), np.where(over, k, high)
    return np.r_[0, np.ceil(high)].astype(np.int64)


TAILS = _tails()


def hits(n: np.ndarray, p: np.ndarray | float) -> np.ndarray:
    """How many of n n-grams fall into segments that take up a share p of all, but for a chance of e ** -SURE."""
    mean = n * np.minimum(p, 1.0)
    at = np.ceil(8 * mean).astype(np.int64)
    beyond = np.ceil(mean + SURE / 3 + np.sqrt(SURE**2 / 9 + 2 * SURE * mean)).astype(np.int64)  # Bernstein
    return np.minimum(n, np.where(at < len(TAILS), TAILS[np.minimum(at, len(TAILS) - 1)], beyond))


class Plan:
    """Size bands, segments and look-ups for a threshold."""

    def __init__(self, threshold: float):
        self.threshold, self.share = threshold, threshold / (1 + threshold)
        self.ends = np.array([0])

    def bands(self, size: np.ndarray) -> np.ndarray:
        """The band of each size; sets without n-grams are in band 0."""
        ends, most = self.ends.tolist(), int(size.max(initial=0))
        while ends[-1] < most:
            ends.append(max(ends[-1] + 1, floor((ends[-1] + 1) / self.threshold + 1e-9)))
        self.ends = np.array(ends)
        return np.searchsorted(self.ends, size)

    def segments(self) -> tuple[np.ndarray, np.ndarray]:
        """For each band the segments without and with a neighbourhood; 0: each n-gram is one."""
        end = self.ends.astype(float)
        plain, deep = np.ceil(end * (1 - 1 / DEEP) / LOAD), np.ceil(end / DEEP / LOAD_DEEP)
        return np.where(end < SMALL, 0, plain).astype(np.uint64), np.where(end < SMALL, 0, deep).astype(np.uint64)

    def differing(self, s: np.ndarray, t: np.ndarray) -> np.ndarray:
        """The most n-grams in which similar sets of these sizes differ, or one more."""
        return np.floor((1 - 2 * self.share) * (s + t) + 1e-9).astype(np.int64)

    def filled(self, size: np.ndarray, band: np.ndarray) -> np.ndarray:
        """The most of a band's segments that a set has n-grams in, as a share; 0 where each n-gram is a segment."""
        plain, _ = self.segments()
        m = plain[band].astype(float)
        return np.where(m > 0, size / np.maximum(m, 1) + 1 / DEEP, 0.0)

    def lost(self, own: np.ndarray, other: np.ndarray, filled: np.ndarray, upto: np.ndarray | None = None) -> np.ndarray:
        """The most segments of a set of size ``own`` that a similar one hasn't just the same, of size ``other``, or from that to ``upto``."""
        upto = other if upto is None else upto
        more = own - np.ceil(self.share * (own + other) - 1e-9).astype(np.int64)
        less = upto - np.ceil(self.share * (own + upto) - 1e-9).astype(np.int64) + (upto != other)
        return np.minimum(self.differing(own, upto), np.maximum(more, 0) + hits(np.maximum(less, 0), filled))

    def _most(self, own: np.ndarray, low: np.ndarray, high: np.ndarray, filled: np.ndarray) -> np.ndarray:
        """lost(), the most over all sizes from low to high."""
        most = np.zeros(len(own), np.int64)
        for i in range(16):
            a, b = low + (high - low) * i // 16, low + (high - low) * (i + 1) // 16
            most = np.maximum(most, self.lost(own, a, filled, b))
        return most

    def probes(self, size: np.ndarray, band: np.ndarray) -> np.ndarray:
        """The most segments that a set has and a similar one of the band, no larger, has not; -1: there is none."""
        top, low = np.minimum(size, self.ends[band]), np.maximum(self.ends[np.maximum(band - 1, 0)] + 1, np.ceil(self.threshold * size - 1e-9).astype(np.int64))
        return np.where((band > 0) & (top >= low), self._most(size, np.minimum(low, top), top, self.filled(size, band)), -1)

    def indexed(self, size: np.ndarray) -> np.ndarray:
        """The most segments that a set has and a similar one, no smaller, has not; -1 for an empty set."""
        band = self.bands(size)
        return np.where(size > 0, self._most(size, size, np.floor(size / self.threshold + 1e-9).astype(np.int64), self.filled(size, band)), -1)

    def exact(self, s: np.ndarray, t: np.ndarray) -> np.ndarray:
        """The most n-grams in which similar sets of these sizes differ."""
        return s + t - 2 * np.ceil(self.share * (s + t) - 1e-9).astype(np.int64)


def place_of(tokens: np.ndarray) -> np.ndarray:
    """Where the table of frequencies counts an n-gram."""
    return (tokens >> u64(40 - BITS)).astype(np.int64)


def costs(counts: np.ndarray) -> np.ndarray:
    """A byte for each place of the table: eight times the logarithm of its count."""
    return np.minimum(255, np.round(8 * np.log2(counts + 1.0))).astype(np.uint8)


def special(band: int) -> int:
    """The signature that joins all of a band, for sets that have too few segments in it."""
    return int(mix(np.array([band], np.uint64) + u64(1 << 41))[0] >> u64(24))


class Rows:
    """Signatures of many sets: sig (40 bits), doc (place of its set), rank, flags, before (print of the one ranked before; 0: none)."""

    KINDS = (np.uint64, np.int32, np.int32, np.uint8, np.uint32)

    def __init__(self, *columns: np.ndarray):
        self.sig, self.doc, self.rank, self.flags, self.before = (c.astype(k, copy=False) for c, k in zip(columns, self.KINDS))

    def __len__(self) -> int:
        return len(self.sig)

    @staticmethod
    def joined(many: list[Rows]) -> Rows:
        parts = [m for m in many if len(m)] or [Rows(*[np.zeros(0)] * 5)]
        return Rows(*[np.concatenate([getattr(p, c) for p in parts]) for c in ("sig", "doc", "rank", "flags", "before")])


def print_of(sig: np.ndarray) -> np.ndarray:
    return np.maximum(sig & u64(0xFFFFFFFF), u64(1)).astype(np.uint32)


def cut(tokens: np.ndarray, first: np.ndarray, band: np.ndarray, probe: np.ndarray, index: np.ndarray, cost: np.ndarray, plan: Plan) -> tuple[Rows, np.ndarray]:
    """Look-ups (at most ``probe`` differing n-grams) and index rows (at most ``index``) of sets in the given bands' partitions.

    -1 leaves a set out. Also returned: which sets have too few segments for their look-ups.
    """
    size = np.diff(first)
    on = (size > 0) & ((probe >= 0) | (index >= 0))
    doc = np.repeat(np.arange(len(size)), size)
    take = on[doc]
    doc, t = doc[take], tokens[take]
    if not len(t):
        return Rows.joined([]), np.zeros(len(size), bool)
    plain, deep = plan.segments()
    salt = mix(np.arange(len(plan.ends)).astype(np.uint64) + u64(0xB5297A4D))
    b = band[doc]
    h = mix(t + salt[b])
    m = plain[b]
    low, high = h & u64(0xFFFFFFFF), h >> u64(32)
    within = np.arange(len(t)) - np.searchsorted(doc, np.arange(len(size)))[doc]
    place = np.where(m > 0, (high * m) >> u64(32), within.astype(np.uint64))
    far = (m > 0) & (low % u64(DEEP) == 0)
    place = np.where(far, m + ((high * deep[b]) >> u64(32)), place)
    if len(size) <= 1 << 16 and int(place.max()) < 1 << 24 and len(t) < 1 << 24:
        key = (doc.astype(np.uint64) << u64(48)) | (place << u64(24)) | np.arange(len(t)).astype(np.uint64)
        key.sort()
        order = (key & LOW24).astype(np.int64)
    else:
        order = np.lexsort((place, doc))
    doc, t, place, far, b = doc[order], t[order], place[order], far[order], b[order]
    start = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])])
    count = np.diff(np.r_[start, len(t)])
    parts = mix(t ^ u64(0x5BD1E995))
    content = np.add.reduceat(parts, start) + salt[b[start]]
    sig = mix(content) >> u64(24)
    own = np.minimum.reduceat(cost[place_of(t)], start).astype(np.int64)
    seg_doc, seg_far = doc[start], far[start]
    # segments without a neighbourhood, ranked; those of several n-grams are somewhat cheaper than their rarest n-gram
    at = np.flatnonzero(~seg_far)
    price = np.maximum(0, own[at] - 4 * np.minimum(count[at] - 1, 3))
    if len(size) <= 1 << 16 and len(at) < 1 << 24:
        key = (seg_doc[at].astype(np.uint64) << u64(48)) | (price.astype(np.uint64) << u64(40)) | ((sig[at] & u64(0xFFFF)) << u64(24)) | np.arange(len(at)).astype(np.uint64)
        key.sort()
        order = (key & LOW24).astype(np.int64)
    else:
        order = np.lexsort((sig[at] & u64(0xFFFF), price, seg_doc[at]))
    at, price = at[order], price[order]
    d, s = seg_doc[at], sig[at]
    begin = np.searchsorted(d, np.arange(len(size) + 1))
    rank, units = np.arange(len(d)) - begin[d], np.diff(begin)
    before = np.zeros(len(d), np.uint32)
    before[1:] = print_of(s[:-1])
    before[rank == 0] = 0
    # look-ups with a neighbourhood, where they are cheaper than the two that they stand for
    deeps = np.flatnonzero(seg_far & (count > 1) & (probe[seg_doc] >= 0))
    dearest = np.zeros(len(size))
    have = units > 0
    dearest[have] = price[begin[:-1][have] + np.minimum(np.maximum(probe, 0), units - 1)[have]]
    dd = seg_doc[deeps]
    cheap = (own[deeps] - 8.0 * np.minimum(count[deeps] - 1, 4) + 8 * np.log2(1.0 + count[deeps]) < dearest[dd] + 8) | (units[dd] <= probe[dd])
    used = np.zeros(len(start), bool)
    used[deeps[cheap]] = True
    limit = np.where(probe >= 0, np.maximum(probe - 2 * np.bincount(dd[cheap], minlength=len(size)), -1), -1)
    asks, holds = rank <= limit[d], rank <= index[d]
    keep = asks | holds
    out = [Rows(s[keep], d[keep], rank[keep], (asks * PROBE + holds * INDEX)[keep], before[keep])]
    # rows of segments with a neighbourhood: the whole, and all but one n-gram
    whole = np.flatnonzero(seg_far)
    flags = used[whole] * PROBE + (index[seg_doc[whole]] >= 0) * INDEX
    whole, flags = whole[flags > 0], flags[flags > 0]
    zero = np.zeros(len(whole))
    out.append(Rows(sig[whole], seg_doc[whole], zero, flags, zero))
    segment = np.repeat(np.arange(len(start)), count)
    less = seg_far[segment] & (count[segment] > 1)
    segment, less = segment[less], mix(content[segment[less]] - parts[less]) >> u64(24)
    flags = used[segment] * PROBE_LESS + (index[seg_doc[segment]] >= 0) * INDEX_LESS
    on = flags > 0
    zero = np.zeros(int(on.sum()))
    out.append(Rows(less[on], seg_doc[segment[on]], zero, flags[on], zero))
    return Rows.joined(out), (limit >= units) & (size > 0) & (probe >= 0)


def rows_of(tokens: np.ndarray, first: np.ndarray, cost: np.ndarray, plan: Plan, poor: set[int]) -> Rows:
    """All rows of the sets: those of their own band's partition, and look-ups in the next lower one."""
    size = np.diff(first)
    band = plan.bands(size)
    none = np.full(len(size), -1)
    out = []
    for b, index in ((band, plan.indexed(size)), (np.maximum(band - 1, 0), none)):
        probe = plan.probes(size, b)
        rows, short = cut(tokens, first, b, probe, index, cost, plan)
        out.append(rows)
        for p in poor:
            at = np.flatnonzero((b == p) & (short | (index >= 0)))
            flags = short[at] * PROBE + (index[at] >= 0) * INDEX
            zero = np.zeros(len(at))
            out.append(Rows(np.full(len(at), special(p)), at, zero, flags, zero))
    return Rows.joined(out)


def poor_bands(tokens: np.ndarray, first: np.ndarray, plan: Plan) -> set[int]:
    """Bands in which a set has too few segments for its look-ups; only sets below NEVER_POOR are tried."""
    size = np.diff(first)
    band, few = plan.bands(size), (size < NEVER_POOR)
    flat, found = np.zeros(1 << BITS, np.uint8), set()
    for b in (band, np.maximum(band - 1, 0)):
        probe = np.where(few & (plan.ends[b] >= SMALL), plan.probes(size, b), -1)
        _, short = cut(tokens, first, b, probe, np.full(len(size), -1), flat, plan)
        found |= set(b[short].tolist())
    return found


def met(sig: np.ndarray, ids: np.ndarray, size: np.ndarray, rank: np.ndarray, flags: np.ndarray, before: np.ndarray, plan: Plan, clump: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(least, greatest) ids of the rows that share a signature and may be similar. A pair may come several times; rows of one clump other than 0 aren't paired."""
    clump = np.zeros(len(sig), np.int64) if clump is None else clump
    if clump.any():  # the rows of a signature are then in order of their clumps
        order = np.argsort(clump, kind="stable")
        sig, ids, size, rank, flags, before, clump = (c[order] for c in (sig, ids, size, rank, flags, before, clump))
    if len(sig) < 1 << 24:
        key = (sig << u64(24)) | np.arange(len(sig)).astype(np.uint64)
        key.sort()
        order, ordered = (key & LOW24).astype(np.int64), key >> u64(24)
    else:
        order = np.argsort(sig, kind="stable")
        ordered = sig[order]
    edge = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1], True]) if len(sig) else np.zeros(1, np.int64)
    width = np.diff(edge)
    several = np.repeat(width > 1, width)
    order, width = order[several], width[width > 1]
    edge = np.r_[0, np.cumsum(width)]
    ids, size, rank, flags, before, clump = ids[order], size[order], rank[order], flags[order], before[order], clump[order]
    group = np.repeat(np.arange(len(width)), width)
    # each row's neighbours of the same clump: where they begin, and how many there are
    bound = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (clump[1:] != clump[:-1]), True]) if len(group) else np.zeros(1, np.int64)
    run = np.repeat(bound[:-1], np.diff(bound))
    alike = np.where(clump != 0, np.repeat(np.diff(bound), np.diff(bound)), 0)
    wide = width[group] - alike
    # a set may be looked up in its own band or in the next lower one: the larger share holds for both
    own = plan.bands(size)
    filled = np.maximum(plan.filled(size, own), plan.filled(size, np.maximum(own - 1, 0)))
    asks = np.flatnonzero(flags & (PROBE | PROBE_LESS))
    upto = np.cumsum(wide[asks])
    done = 0
    while done < len(asks):
        stop = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + BLOCK, "right")))
        now = asks[done:stop]
        done = stop
        w = wide[now]
        x = np.repeat(now, w)
        y = np.arange(len(x)) - np.repeat(np.cumsum(w) - w, w) + np.repeat(edge[group[now]], w)
        y += np.where(y >= run[x], alike[x], 0)
        ok = (size[y] >= plan.threshold * size[x] - 1e-9) & ((size[y] < size[x]) | (size[y] == size[x]) & ((ids[y] < ids[x]) | (ids[y] == ids[x]) & (y < x)))
        x, y = x[ok], y[ok]
        sx, sy, fx, fy, px, py = size[x], size[y], flags[x], flags[y], filled[x], filled[y]
        ok = ((fx & PROBE > 0) & (fy & (INDEX | INDEX_LESS) > 0)) | ((fx & PROBE_LESS > 0) & (fy & INDEX > 0))
        # no more segments of either set than may be lost come before the first that both have
        ok &= (rank[x] <= plan.lost(sx, sy, px)) & (rank[y] <= plan.lost(sy, sx, py)) & (ids[x] != ids[y])
        # a pair that has the segment before in common too has met there
        ok &= (before[x] == 0) | (before[x] != before[y])
        x, y = ids[x[ok]], ids[y[ok]]
        yield np.minimum(x, y), np.maximum(x, y)
