"""Token counts: an exact histogram of encoded lengths whose suffix sums answer every context limit."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reachlight.llm import frame

#: A vocabulary file of ranks, and how its texts are cut before merging.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose count a worker remembers; beyond, it forgets all and begins anew.
REMEMBERED = 300_000
#: Lengths are summed in blocks of so many, so that no step holds the whole histogram in one task.
BLOCK = 4096
#: A space between two characters that are both no white space: pieces on its sides are encoded independently.
LOOSE = re.compile(r"\s \S|\s\s|^ | $")


def encoder(vocabulary: str, pattern: str = PATTERN):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Counter:
    """Counts tokens, remembering the counts of pieces between single spaces.

    With ``pattern`` a token never holds a space but as its first character, so such pieces can be encoded one by
    one. A text that has other white space beside a space is encoded as a whole.
    """

    def __init__(self, encode):
        self.encode, self.known = encode, {}

    def piece(self, piece: str) -> int:
        n = len(self.encode(piece))
        if len(piece) < 40:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[piece] = n
        return n

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        if LOOSE.search(text):
            return len(self.encode(text))
        pieces = text.replace(" ", "\0 ").split("\0") if "\0" not in text else [text]
        known = self.known
        total = 0
        for p in pieces:
            n = known.get(p)
            total += self.piece(p) if n is None else n
        return total


def encoded_lengths(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(n_tokens long) for each document: the length of its whole text in tokens.

    A null text counts as no document and gives no row; an empty one gives 0. Other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(encoder(vocabulary, pattern))
        for batch in batches:
            for part in frame.steps(batch, 0):
                yield pa.record_batch([pa.array([count(t) for t in part.column(0).to_pylist()], pa.int64())], ["n_tokens"])

    return frame.plain(docs, text="string").where("text IS NOT NULL").mapInArrow(run, "n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """For each length that occurs, what a context limit of that length means for the whole corpus.

    n_docs: documents of this length; docs_up_to, docs_over: documents no longer, and longer; quantile: docs_up_to as
    a share of all; tokens_over: tokens in longer documents; total_tokens: of all; truncated_tokens: what is left if
    every document is cut to this length; lost_tokens: the rest. Between two lengths a limit L gives
    truncated = lower row's truncated + (L - lower length) * lower row's docs_over, so the rows answer every limit.
    Empty input gives no rows; null lengths are left out.
    """
    # encoded once: both the blocks and the rows below are made of the counts
    counts = frame.cut(
        lengths.where("n_tokens IS NOT NULL").groupBy("n_tokens").agg(F.count("*").alias("n_docs"))
        .withColumns({"block": F.floor(F.col("n_tokens") / BLOCK), "tokens": F.col("n_tokens") * F.col("n_docs")})
    )
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    whole = Window.partitionBy(F.lit(1))

    def zero(c: Column) -> Column:
        return F.coalesce(c, F.lit(0).cast("long"))

    blocks = blocks.select("block", zero(F.sum("d").over(after)).alias("d_after"), zero(F.sum("t").over(after)).alias("t_after"), F.sum("d").over(whole).alias("all_docs"), F.sum("t").over(whole).alias("all_tokens"))
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    rows = counts.join(blocks, "block").withColumns({"docs_over": F.col("d_after") + zero(F.sum("n_docs").over(within)), "tokens_over": F.col("t_after") + zero(F.sum("tokens").over(within))})
    cut = F.col("all_tokens") - F.col("tokens_over") + F.col("docs_over") * F.col("n_tokens")
    return rows.select(
        F.col("n_tokens"), "n_docs", (F.col("all_docs") - F.col("docs_over")).alias("docs_up_to"), "docs_over",
        ((F.col("all_docs") - F.col("docs_over")) / F.col("all_docs")).alias("quantile"), "tokens_over",
        F.col("all_tokens").alias("total_tokens"), cut.alias("truncated_tokens"), (F.col("all_tokens") - cut).alias("lost_tokens"),
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Every context limit's totals over all documents."""
    return histogram(encoded_lengths(frame.read(spark, folder, "documents")))
