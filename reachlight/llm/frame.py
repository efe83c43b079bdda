"""Shared plumbing of the text operators: picking columns by position, cutting Arrow batches, shared storage, sampling."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on, whatever the size of an Arrow batch.
STEP_BYTES = 1 << 21
#: Bytes of a table that is sent to every task at most; a larger one is joined by a shuffle.
SENT_BYTES = 64 << 20


def position(df: DataFrame, name: str) -> int:
    """Index of the column called ``name``: the first that is spelled so, else the first that differs by case alone."""
    for test in (lambda c: c == name, lambda c: c.lower() == name.lower()):
        for i, c in enumerate(df.columns):
            if test(c):
                return i
    raise ValueError(f"no column {name!r} among {df.columns}")


def unnamed(df: DataFrame) -> DataFrame:
    """The same rows under the names c0, c1, ... so that clashing names can't be ambiguous."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def plain(df: DataFrame, **kinds: str) -> DataFrame:
    """Just the wanted columns, cast to the given types; any other column is left unread."""
    at = {name: position(df, name) for name in kinds}
    bare = unnamed(df)
    return bare.select(*[F.col(f"c{at[name]}").cast(kind).alias(name) for name, kind in kinds.items()])


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def trimmed(run: Run) -> Run:
    """``run``, and at its end the worker gives back what it has freed. Workers outlive their tasks, and an executor's memory holds the idle ones too."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's alone
        if trim:
            trim(0)

    return whole


def keep_rows(df: DataFrame, judge, **columns: str) -> DataFrame:
    """Rows of ``df`` that ``judge`` keeps, with all their columns.

    judge(batch of the given columns, in the given order) returns a boolean list or array. Each name is that of a
    parameter-like label, each value the column's name in df.
    """
    at = [position(df, c) for c in columns.values()]
    bare = unnamed(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, at[-1]):
                yield part.filter(pa.array(judge(*[part.column(i) for i in at]), pa.bool_()))

    return bare.mapInArrow(trimmed(run), bare.schema).toDF(*df.columns)


def steps(batch: pa.RecordBatch, text: int, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``most`` bytes each; a row is never cut."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    yield batch.slice(start)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, one machine gets a temporary folder and a cluster an error."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    have = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not folder and have.isDefined():
        folder = have.get()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="reachlight-")
    if not have.isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def own_folder(spark: SparkSession) -> str:
    """This application's own folder in the shared one."""
    return f"{shared_folder(spark)}/reachlight-{spark.sparkContext.applicationId}"


def tidied(spark: SparkSession) -> None:
    """Deletes all that stored() has written in this application. Results that were made of it can't be read any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, checkpointed to the shared folder: later steps don't recompute them when an executor is lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written as Parquet to the shared folder and read again: compressed, unlike a checkpoint."""
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    del df
    # what was shuffled on the way is needed no more; its files go when Python and then the driver's JVM let go of the plan
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def sized(df: DataFrame, row_bytes: int) -> DataFrame:
    """df, marked to be sent to every task if its rows of about ``row_bytes`` take no more than SENT_BYTES; else as it is, for a shuffle."""
    return F.broadcast(df) if df.limit(SENT_BYTES // row_bytes + 1).count() * row_bytes <= SENT_BYTES else df


def sampled(rows: DataFrame, key: str, most: int) -> DataFrame:
    """``most`` rows with a key, or all if there are fewer: those whose whole rows' hashes are least.

    A threshold on the hash leaves about twice as many before they are sorted, so that what all tasks send doesn't grow
    with their number. Rows are told apart by all their columns: rows that repeat a key are drawn one by one, and rows
    that are alike in everything count once. Rows without a key are left out.
    """
    rows = rows.where(F.col(key).isNotNull())
    n = rows.count()
    place = F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 30))
    share = 2.0 * most / max(n, 1)
    while True:
        few = rows.where(place < int((1 << 30) * share)) if share < 1 else rows
        # of rows that are all alike many may lie under the threshold together, or none: it is raised until enough are distinct
        few = few.dropDuplicates()
        if share >= 1 or few.limit(most).count() >= most:
            return few.orderBy(place, *rows.columns).limit(most)
        share *= 8


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")
