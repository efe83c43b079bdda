"""Packing: non-negative least squares over shallow length combinations, then greedy packing of what is left."""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reachlight.llm import frame

#: Tokens that a window holds. Tokens are UTF-8 bytes, as in byte-level models; any length column can be given instead.
WINDOW = 8192
#: Lengths are rounded up to multiples of WINDOW / BINS for planning.
BINS = 128
#: Most pieces in a combination that is enumerated.
DEPTH = 3
#: Pieces of one bin are ranked in so many groups, so that a common length isn't ranked by one task.
GROUPS = 64


@lru_cache
def combinations(bins: int, depth: int) -> tuple[tuple[int, ...], ...]:
    """All non-increasing tuples of at most ``depth`` lengths that fill the window exactly."""

    def fill(left: int, most: int, depth: int):
        if left <= most:
            yield (left,)
        if depth > 1:
            for first in range(min(left - 1, most), 0, -1):
                if first * depth < left:
                    break
                for rest in fill(left - first, first, depth - 1):
                    yield (first, *rest)

    return tuple(fill(bins, bins, depth))


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 0) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by the active-set method of Lawson and Hanson on the normal equations."""
    rows, n = a.shape
    x, passive = np.zeros(n), np.zeros(n, bool)
    g, h = a.T @ a, a.T @ b
    tolerance = 1e-9 * max(1.0, float(np.abs(h).max(initial=0)))
    for _ in range(rounds or 6 * rows):
        w = h - g[:, passive] @ x[passive]
        w[passive] = -np.inf
        j = int(np.argmax(w))
        if w[j] <= tolerance:
            break
        passive[j] = True
        while True:
            at = np.flatnonzero(passive)
            s = np.linalg.lstsq(g[np.ix_(at, at)], h[at], rcond=None)[0]
            if s.min() > 0:
                x[:] = 0
                x[at] = s
                break
            low = s <= 0
            step = np.min(x[at][low] / np.maximum(x[at][low] - s[low], 1e-300))
            x[at] += step * (s - x[at])
            gone = at[(x[at] <= 1e-12 * max(1.0, x.max())) | (low & (x[at] <= tolerance))]
            if not len(gone):
                gone = at[[int(np.argmin(x[at]))]]
            x[gone] = 0
            passive[gone] = False
    return x


def plan(counts: np.ndarray, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(combination, how many windows) that hold exactly counts[i] pieces of each length i; counts[0] isn't used.

    Repeat counts come from non-negative least squares against the histogram, in which lacking long pieces weigh
    more, and are rounded down to what the histogram still has; what is left is packed greedily.
    """
    bins = len(counts) - 1
    left = counts.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if left[1:].sum() and bins:
        combos = combinations(bins, depth)
        a = np.zeros((bins, len(combos)))
        for j, c in enumerate(combos):
            for length in c:
                a[length - 1, j] += 1
        weight = np.sqrt(np.arange(1, bins + 1) / bins)
        scale = max(1.0, float(left.max()))
        x = nnls(a * weight[:, None], left[1:] / scale * weight) * scale
        for j in np.argsort(-x, kind="stable"):
            if x[j] <= 0:
                break
            uses = Counter(combos[j])
            n = min(int(np.rint(x[j])), *(int(left[k]) // m for k, m in uses.items()))
            if n > 0:
                out.append((combos[j], n))
                for k, m in uses.items():
                    left[k] -= n * m
    return out + greedy(left)


def greedy(left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Packs what is left: the longest piece first, then ever the longest that still fits. Alike windows are made together."""
    left, bins, out = left.copy(), len(left) - 1, []
    while left[1:].any():
        room, pack = bins, []
        spare = left.copy()
        while room and (fits := np.flatnonzero(spare[1 : room + 1])).size:
            k = int(fits[-1]) + 1
            m = min(room // k, int(spare[k]))
            pack += [k] * m
            spare[k] -= m
            room -= k * m
        uses = Counter(pack)
        n = min(int(left[k]) // m for k, m in uses.items())
        out.append((tuple(pack), n))
        for k, m in uses.items():
            left[k] -= n * m
    return out


def pack(docs: DataFrame, window: int = WINDOW, bins: int = BINS, depth: int = DEPTH, length: str | None = None) -> DataFrame:
    """Every token of every document in just one window: (pack long, slot int, offset int, doc_id long, start long, tokens int).

    A document longer than the window is cut into whole windows and a rest; each piece is a row: tokens
    [start, start + tokens) of doc_id lie at offset of window ``pack``. Pieces begin at multiples of window / bins.
    The plan depends on the histogram alone, of bins + 1 numbers; ties among pieces of one bin go by doc_id, start.
    Null or empty texts have no tokens and no row; a null doc_id is packed like any other; repeated rows are packed
    once each; an empty table gives no rows. ``length``: a column of token counts to be used in place of UTF-8 bytes.
    """
    if window % bins:
        raise ValueError("bins must divide window")
    spark, unit = docs.sparkSession, window // bins
    if length:
        sized = frame.plain(docs, doc_id="long", **{length: "long"}).toDF("doc_id", "n")
    else:
        sized = frame.plain(docs, doc_id="long", text="string").select("doc_id", F.octet_length("text").cast("long").alias("n"))
    whole = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / window))
    pieces = sized.where("n > 0").select("doc_id", "n", F.explode(whole).alias("i")).select("doc_id", (F.col("i") * window).alias("start"), F.least(F.lit(window), F.col("n") - F.col("i") * window).cast("int").alias("tokens"))
    pieces = pieces.select("*", F.ceil(F.col("tokens") / unit).cast("int").alias("bin"), F.pmod(F.xxhash64("doc_id", "start"), F.lit(GROUPS)).cast("int").alias("g"))
    held = pieces.groupBy("bin", "g").agg(F.count("*").alias("n")).toPandas()  # at most bins * GROUPS rows
    counts = np.zeros(bins + 1, np.int64)
    np.add.at(counts, held["bin"].to_numpy(int), held["n"].to_numpy(int))
    held = held.sort_values(["bin", "g"])
    held["base"] = held.groupby("bin")["n"].cumsum() - held["n"]
    slots, first_pack, taken = [], 0, np.zeros(bins + 1, np.int64)
    for combo, n in plan(counts, depth):
        offset = slot = 0
        for k, m in Counter(combo).items():
            # piece r of this bin, r in [lo, lo + n * m): window first_pack + r // m, its place r % m
            slots.append((k, int(taken[k]), int(taken[k] + n * m), first_pack, m, slot, offset))
            taken[k] += n * m
            slot += m
            offset += k * m * unit
        first_pack += n
    bases = spark.createDataFrame(held[["bin", "g", "base"]], "bin int, g int, base long")
    table = spark.createDataFrame(pd.DataFrame(slots, columns=["bin", "lo", "hi", "pack0", "m", "slot0", "offset0"]), "bin int, lo long, hi long, pack0 long, m int, slot0 int, offset0 int")
    order = Window.partitionBy("bin", "g").orderBy("doc_id", "start")
    ranked = pieces.withColumn("rank", F.row_number().over(order) - 1).join(F.broadcast(bases), ["bin", "g"]).withColumn("rank", F.col("rank") + F.col("base"))

    # both tables have a size that bins and depth bound, whatever the number of documents
    placed = ranked.join(F.broadcast(table.groupBy("bin").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "pack0", "m", "slot0", "offset0"))).alias("ranges"))), "bin")

    def at(r: Column) -> Column:
        return (F.col("rank") >= r["lo"]) & (F.col("rank") < r["hi"])

    placed = placed.withColumn("r", F.filter("ranges", at)[0]).withColumn("i", F.col("rank") - F.col("r.lo"))
    return placed.select(
        (F.col("r.pack0") + F.floor(F.col("i") / F.col("r.m"))).alias("pack"),
        (F.col("r.slot0") + F.pmod(F.col("i"), F.col("r.m"))).cast("int").alias("slot"),
        (F.col("r.offset0") + F.pmod(F.col("i"), F.col("r.m")) * F.col("bin") * unit).cast("int").alias("offset"),
        "doc_id", "start", "tokens",
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into windows of WINDOW bytes."""
    return pack(frame.read(spark, folder, "documents"))
