"""Tables written in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession) -> str:
    """A new path in spark.checkpoint.dir; in a temporary folder where it is unset and everything runs in one process (tests)."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="kinefold-"))
        found = context.getCheckpointDir()
    return f"{found.rstrip('/')}/kinefold-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme that Spark takes it to have, so that libraries on the executors open the same store: without one it is the default file system's, which need not be the local disk."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return re.sub(r"^file:/(?!/)", "file:///", own.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(own).toString())


#: Bytes of a file that a task reads, of compressed rows that it takes from a shuffle, and of input for each partition of one: groups of this data take some fifteen times that in memory.
READ_BYTES, SHUFFLE_BYTES, INPUT_A_PARTITION = 16 << 20, 8 << 20, 4 << 20


def bounded_tasks(spark: SparkSession, path: str) -> None:
    """Have the session's tasks keep their size as the table at path grows: there are more of them. Smaller sizes and more partitions that were set stay."""
    size_of = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for name, most in (("spark.sql.files.maxPartitionBytes", READ_BYTES), ("spark.sql.adaptive.advisoryPartitionSizeInBytes", SHUFFLE_BYTES)):
        if size_of(spark.conf.get(name)) > most:
            spark.conf.set(name, f"{most}b")
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = own.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(own).getLength()
    if size // INPUT_A_PARTITION > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.shuffle.partitions", str(size // INPUT_A_PARTITION))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: it is computed once, and its lineage ends."""
    path = f"{shared_path(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
