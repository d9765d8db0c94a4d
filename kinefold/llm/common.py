"""Shared helpers of the corpus operators: scratch tables, Arrow batches, bounded broadcasts."""

from __future__ import annotations

import pickle
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of one Arrow batch: what a Python worker holds at once.
BATCH_ROWS = 1024
BATCH_BYTES = 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that a worker's memory does not follow the length of the texts. All operators set the same values; those that need fewer rows at once slice a batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or a temporary one where it is unset and everything runs in one process (tests)."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="kinefold-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/kinefold-{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: it is computed once, its lineage ends, and lost executors cost nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.scratch = path
    return table


def discard(table: DataFrame) -> None:
    """Delete a materialized table that nothing reads any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of at most so many rows."""
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df does not have yet (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def add_column(df: DataFrame, name: str, column: Column) -> DataFrame:
    """df with one more column under a name that is free: nothing that is there is overwritten."""
    return df.withColumn(free_name(df, name), column)


def per_batch(make: Callable[[], Callable[..., pa.Array]], returns: T.DataType) -> Callable[..., Column]:
    """A column function from make(), which builds in each task a function from Arrow arrays to one Arrow array of as many values."""
    from pyspark.sql.functions import arrow_udf

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = make()
        for x in batches:
            yield work(x)

    return arrow_udf(run, returns)


def per_batches(make: Callable[[], Callable[..., pa.Array]], returns: T.DataType) -> Callable[..., Column]:
    """per_batch for functions of several columns."""
    from pyspark.sql.functions import arrow_udf

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        work = make()
        for xs in batches:
            yield work(*xs)

    return arrow_udf(run, returns)


def ship(spark: SparkSession, value: object) -> Callable[[], object]:
    """Broadcast a model of proven size, with its class; returns what gives it in a task."""
    handle = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get() -> object:
        return pickle.loads(handle.value)

    return get


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and the offsets where each begins and ends (null: empty)."""
    arr = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if arr.null_count:
        arr = arr.fill_null("")
    arr = arr.cast(pa.large_binary())
    _, where, data = arr.buffers()
    offsets = np.frombuffer(where, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def chunks(offsets: np.ndarray, nbytes: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most nbytes together (a longer text alone)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + nbytes, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


#: Rows of one key beyond which its row of the other side is broadcast: one in so many rows of the left side at most.
SPREAD_ROWS = 50_000


def join_spread(left: DataFrame, right: DataFrame, key: str, rows: str, spread: str) -> DataFrame:
    """Inner join of left with right, which has one row per key and in column rows how many of left have that key.

    Keys of more than SPREAD_ROWS rows are broadcast (there is at most one in SPREAD_ROWS rows of left), and
    their rows are dealt by a hash of the column spread instead of the key, so that no task gets a whole hot key.
    """
    others = [c for c in right.columns if c not in (key, rows)]
    hot = right.where(F.col(rows) > SPREAD_ROWS).select(F.col(key).alias("_hot"), F.struct(*others).alias("_given"))
    deal = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(spread), F.lit(1 << 20)) + 1).otherwise(0)
    dealt = left.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn("_deal", deal)
    rest = right.where(F.col(rows) <= SPREAD_ROWS).select(F.col(key).alias("_key"), F.struct(*others).alias("_found"), F.lit(0).cast("long").alias("_zero"))
    joined = dealt.join(rest, (F.col(key) == F.col("_key")) & (F.col("_deal") == F.col("_zero")), "left")
    whole = joined.withColumn("_all", F.coalesce("_given", "_found")).where("_all is not null")
    return whole.select(*left.columns, *(F.col(f"_all.{c}").alias(c) for c in others))


def crc_fold(column: Column, folds: int) -> Column:
    """crc32 of the id's text, modulo folds: which rows a classifier may learn from."""
    return F.crc32(column.cast("string")) % folds


def crc32_of(values: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(values, dtype="<u4").tobytes())


def hash_sample(df: DataFrame, key: str, limit: int, seed: int = 7) -> DataFrame:
    """At most limit rows, those of the smallest hash of key: the same on every run. For fitting models only.

    Rows whose hash lies beyond what about 1.3 limit rows have are left out before the sort, so that what reaches
    the driver or the last task follows the limit and not the number of partitions; all rows are sorted
    in the rare case that too few were left.
    """
    h = free_name(df, "_order")
    hashed = df.withColumn(h, F.xxhash64(F.lit(seed), F.col(key)))
    n = df.count()
    if n > 2 * limit:
        share = (1.3 * limit + 50) / n
        below = hashed.where(F.col(h) < F.lit(int(-(2**63) + share * 2**64)))
        hashed = below if below.count() >= limit else hashed
    return hashed.orderBy(h, key).limit(limit).drop(h)
