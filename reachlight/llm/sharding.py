"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, overfull ranges subdivided."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reachlight.llm import frame

#: Bytes of text that a shard should hold.
TARGET = 64 << 20
#: Expected sample rows for each shard.
OVERSAMPLE = 24
#: A range is overfull from this many times the target on.
OVERFULL = 1.25
#: Splitters are sent to every task; this many bytes are some 500,000 shards.
BROADCAST_BYTES = 32 << 20


def sample(keyed: DataFrame, total: int, wanted: int) -> DataFrame:
    """Rows (k, u, weight) drawn with a chance in proportion to size; weights estimate the bytes they stand for.

    The draw is a hash of the row, so that a recomputed task draws the same rows.
    """
    step = max(1.0, total / max(1, wanted))
    chance = F.least(F.lit(1.0), F.col("size") / F.lit(step))
    return keyed.where(F.pmod(F.xxhash64("u", F.lit(17)), F.lit(1 << 30)) < chance * (1 << 30)).select("k", "u", F.greatest(F.col("size").cast("double"), F.lit(step)).alias("weight"))


def splitters(drawn: pd.DataFrame, shards: int, target: float) -> pd.DataFrame:
    """Lower bounds (k, u) of the shards, in order, from a weighted sample.

    Quantile boundaries fall on keys. A range that holds over OVERFULL * target is one key or a few heavy ones; it is
    subdivided at quantiles of (k, u), where u spreads the records of one key.
    """
    drawn = drawn.sort_values(["k", "u"], kind="stable").reset_index(drop=True)
    if not len(drawn):
        return pd.DataFrame({"k": pd.Series(dtype=object), "u": pd.Series(dtype="int64")})
    per_key = drawn.groupby("k", sort=True)["weight"].sum()
    before = np.concatenate([[0.0], np.cumsum(per_key.to_numpy())])
    total = before[-1]
    place = np.minimum(np.floor(before[:-1] * shards / total + 1e-9), shards - 1).astype(int)
    starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    bounds = []
    least = np.iinfo(np.int64).min
    keys, ks = per_key.index.to_numpy(), drawn["k"].to_numpy()
    us, weights = drawn["u"].to_numpy(), drawn["weight"].to_numpy()
    for i, s in enumerate(starts):
        e = starts[i + 1] if i + 1 < len(starts) else len(keys)
        bounds.append((keys[s], least))
        held = before[e] - before[s]
        if held <= OVERFULL * target:
            continue
        lo, hi = np.searchsorted(ks, keys[s], "left"), np.searchsorted(ks, keys[e - 1], "right")
        run = np.cumsum(weights[lo:hi])
        parts = int(np.ceil(held / target))
        for q in range(1, parts):
            at = lo + int(np.searchsorted(run, held * q / parts))
            if at < hi and (ks[at], us[at]) > bounds[-1]:
                bounds.append((ks[at], us[at]))
    return pd.DataFrame(bounds, columns=["k", "u"])


def shard(docs: DataFrame, key: str = "source", text: str = "text", target: int = TARGET, oversample: int = OVERSAMPLE) -> DataFrame:
    """All rows and columns of docs with shard (int), range-partitioned by ``key``: one task holds one shard.

    Shards follow the order of the key: a lower key is never in a higher shard. Rows of a key that is too heavy for
    one shard are spread over neighbouring ones by a hash of the row. Null keys sort as the empty string; a null or
    empty text weighs 1 byte; a text longer than the target fills a shard by itself with whatever hashes beside it.
    Repeated rows hash alike and stay together. An empty table stays empty. If docs has a column shard already, the
    added one is called shard_.
    """
    name = frame.fresh(docs, "shard")
    kept = frame.unnamed(docs)
    at_key, at_text = frame.position(docs, key), frame.position(docs, text)

    def k(df: DataFrame) -> Column:
        return F.coalesce(F.col(f"c{at_key}").cast("string"), F.lit(""))

    # maps and variants can't be hashed; rows are told apart by the other columns
    hashed = [F.col(f.name) for f in kept.schema if not re.search("map<|variant", f.dataType.simpleString())]
    size = F.greatest(F.coalesce(F.octet_length(F.col(f"c{at_text}").cast("string")), F.lit(1)), F.lit(1)).cast("long")
    unit = F.xxhash64(*hashed)
    keyed = kept.select(k(kept).alias("k"), unit.alias("u"), size.alias("size"))
    total = keyed.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-total // target))
    # one key's weight is found from the sample, so the sample grows with the shards: some 40 bytes for each row
    drawn = sample(keyed, total, shards * oversample)
    bounds = splitters(drawn.toPandas(), shards, target)
    many = max(1, len(bounds))
    if many == 1:
        return kept.withColumn("shard", F.lit(0)).coalesce(1).toDF(*docs.columns, name)
    if int(bounds["k"].str.len().sum()) + 16 * many > BROADCAST_BYTES:
        raise ValueError(f"{many} shards need splitters of over {BROADCAST_BYTES} bytes; choose a larger target")
    sent = docs.sparkSession.sparkContext.broadcast((bounds["k"].to_numpy(object), bounds["u"].to_numpy()))

    @F.pandas_udf("int")
    def place(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        ks, us = sent.value
        for a, b in parts:
            codes, values = pd.factorize(a)
            lo, hi = np.searchsorted(ks, values.to_numpy(object), "left")[codes], np.searchsorted(ks, values.to_numpy(object), "right")[codes]
            out = hi - 1
            own = b.to_numpy()
            for i in np.flatnonzero(hi - lo > 1):
                out[i] = lo[i] + np.searchsorted(us[lo[i] : hi[i]], own[i], "right") - 1
            # a run of boundaries on this key that doesn't begin at its least hash: what is below belongs to the range before
            yield pd.Series(np.maximum(np.where((hi - lo == 1) & (us[np.maximum(hi - 1, 0)] > own), hi - 2, out), 0).astype("int32"))

    return kept.withColumn("shard", place(k(kept), unit)).repartitionById(many, F.col("shard")).toDF(*docs.columns, name)


def query(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, range-partitioned by source; source src0 is hot."""
    return shard(frame.read(spark, folder, "documents"))
