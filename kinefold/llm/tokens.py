"""Token ids as Parquet: list columns with dictionary or delta encoding, sized row groups and pages.

Documents are dealt into ranges of (doc_id, hash of the text), sorted, and encoded; each task writes its
range as one file with pyarrow, straight from the encoder's arrays, with page indexes, and renames it to its
part number when it is whole, so that a repeated task replaces its own file. Part k holds smaller ids than
part k + 1, and each row its place within the part, so that a document's place in the whole stream is one
addition. Column indexes let a reader take some documents' ids, or the metadata alone, without the rest.
Folders that pyarrow cannot open are written and read by Spark, with the same rows.

Defined cases: a null or empty text has only the end id; rows with equal doc_id keep the order of
their texts' hashes and texts (one id may fill several parts); a null doc_id comes first; an empty table
gives an empty data set; columns other than those named are not written.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinefold.llm.common import bound_batches, crc32_of, slices
from kinefold.llm.encoding import shared_encoder, vocabulary_path
from kinefold.sources.tables import qualified

END_ID = 2
#: Texts that the encoder takes at once; bounds the arrays in memory.
TEXTS_AT_ONCE = 64
#: Bytes of text in a part, about.
PART_BYTES = 64 << 20
#: Parts whose starts may be broadcast.
BROADCAST_PARTS = 200_000
_NAMES = ["doc_id", "part", "local_start", "n_tokens", "ids"]


def _store(path: str):
    """The file system of a folder (with a scheme) and its path there, or None where pyarrow has none for it."""
    from pyarrow import fs

    try:
        return fs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, OSError):
        return None


def encode_batches(tokenizer: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function from a part's (doc_id, text) to its rows; each row's place counts from the part's first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, before, part = shared_encoder(tokenizer), 0, TaskContext.get().partitionId()
        for batch in batches:
            for own in slices(batch, TEXTS_AT_ONCE):
                rows = encoder.encode(own.column("text").to_pylist())
                sizes = np.array([len(x) + 1 for x in rows], np.int64)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                flat = np.full(int(ends[-1]), end_id, np.int32)
                inside = np.ones(len(flat), bool)
                inside[ends[1:] - 1] = False
                flat[inside] = np.concatenate(rows)
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                columns = [own.column("doc_id"), pa.array(np.full(len(rows), part, np.int32)), pa.array(before + ends[:-1]), pa.array(sizes), ids]
                before += int(ends[-1])
                yield pa.RecordBatch.from_arrays(columns, _NAMES)

    return run


def write_tokens(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = END_ID, encoding: str = "dictionary", row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10, partitions: int | None = None) -> None:
    """Write columns doc_id, part, local_start, n_tokens, ids in ascending doc_id order."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding {encoding!r}")
    spark = docs.sparkSession
    path = qualified(spark, path)
    bound_batches(spark)
    if partitions is None:
        size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    kind = docs.schema[doc_id].dataType.simpleString()
    ordered = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("tie", F.xxhash64("text")).repartitionByRange(partitions, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    encode = encode_batches(tokenizer or vocabulary_path(), end_id)
    rows = f"doc_id {kind}, part int, local_start long, n_tokens long, ids array<int>"
    store = _store(path)
    if store is None:
        (
            ordered.mapInArrow(encode, rows)
            .write.option("compression", "zstd")
            .option("parquet.writer.version", "v2")
            .option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
            .option("parquet.block.size", str(row_group_bytes))
            .option("parquet.page.size", str(page_bytes))
            .option("parquet.dictionary.page.size", str(1 << 20))
            .parquet(path)
        )
        return
    store[0].create_dir(store[1], recursive=True)
    options = {"compression": "zstd", "version": "2.6", "data_page_version": "2.0", "data_page_size": page_bytes, "write_page_index": True, "store_schema": False}
    options |= {"use_dictionary": True} if encoding == "dictionary" else {"use_dictionary": False, "column_encoding": {"part": "DELTA_BINARY_PACKED", "local_start": "DELTA_BINARY_PACKED", "n_tokens": "DELTA_BINARY_PACKED", "ids.list.element": "DELTA_BINARY_PACKED"}}

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, folder = _store(path)
        part = TaskContext.get().partitionId()
        n = _write_part(files, folder, part, encode(batches), row_group_bytes, options)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n_docs": pa.array([n], pa.int64())})

    written = ordered.mapInArrow(write, "part int, n_docs long").agg(F.sum("n_docs")).first()[0]
    if not written:  # an empty data set has columns too
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(spark.createDataFrame([], rows).schema)
        _write_part(*store, 0, iter([pa.RecordBatch.from_pylist([], schema)]), row_group_bytes, options)


def part_file(part: int) -> str:
    return f"part-{part:06d}.parquet"


def _write_part(files, folder: str, part: int, batches: Iterator[pa.RecordBatch], row_group_bytes: int, options: dict) -> int:
    """Write a part's rows as one file in row groups of about so many bytes; nothing is left behind for no rows. Returns how many."""
    import pyarrow.parquet as pq

    unready = f"{folder}/_{part_file(part)}.{uuid.uuid4().hex}"
    writer, held, size, n = None, [], 0, 0

    def flush() -> None:
        nonlocal held, size
        if held:
            table = pa.Table.from_batches(held)
            writer.write_table(table, row_group_size=max(1, table.num_rows))
        held, size = [], 0

    try:
        for batch in batches:
            if writer is None:
                writer = pq.ParquetWriter(unready, batch.schema, filesystem=files, **options)
            held.append(batch)
            size += batch.nbytes
            n += batch.num_rows
            if size >= row_group_bytes:
                flush()
        flush()
    finally:
        if writer is not None:
            writer.close()
    if writer is not None:
        files.move(unready, f"{folder}/{part_file(part)}")
    return n


def read_tokens(spark: SparkSession, path: str, columns: list[str] | None = None, doc_ids: tuple[int, int] | None = None) -> DataFrame:
    """The written rows, or some columns of the documents in an inclusive range of ids: filter and columns reach the scan."""
    rows = spark.read.parquet(path)
    if doc_ids:
        rows = rows.where(F.col("doc_id").between(*doc_ids))
    return rows.select(*columns) if columns else rows


def stream_starts(spark: SparkSession, path: str) -> DataFrame:
    """Ids before each part: a row a part, from the metadata columns alone."""
    from pyspark.sql import Window

    sums = read_tokens(spark, path, ["part", "n_tokens"]).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return sums.select("part", F.coalesce(before, F.lit(0)).alias("part_start"))


def _digest(rows: pa.RecordBatch | pa.Table, starts: np.ndarray) -> pa.RecordBatch:
    ids = rows.column("ids")
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    flat, where = ids.values.to_numpy(), ids.offsets.to_numpy()
    crc = pa.array([crc32_of(flat[a:b]) for a, b in zip(where[:-1], where[1:], strict=True)], pa.int64())
    return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(starts + rows.column("local_start").to_numpy()), pa.array(np.diff(where).astype(np.int64)), crc], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, read back from the files: doc_id, start in the whole stream, n_tokens, ids_crc32."""
    bound_batches(spark)
    path = qualified(spark, path)
    kind = spark.read.parquet(path).schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, n_tokens long, ids_crc32 long"
    starts = stream_starts(spark, path)
    parts = starts.count()
    if _store(path) is None:
        joined = read_tokens(spark, path).join(F.broadcast(starts) if parts <= BROADCAST_PARTS else starts, "part")

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for own in slices(batch, 4 * TEXTS_AT_ONCE):
                    yield _digest(own, own.column("part_start").to_numpy())

        return joined.mapInArrow(check, schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        files, folder = _store(path)
        for batch in batches:
            for part, start in zip(batch.column("part").to_pylist(), batch.column("part_start").to_pylist(), strict=True):
                with files.open_input_file(f"{folder}/{part_file(part)}") as source, pq.ParquetFile(source, pre_buffer=False) as file:
                    for rows in file.iter_batches(4 * TEXTS_AT_ONCE, columns=["doc_id", "local_start", "ids"], use_threads=False):
                        yield _digest(rows, np.int64(start))

    return starts.repartition(max(1, parts)).mapInArrow(read, schema)
