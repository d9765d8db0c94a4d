"""Best-fit decreasing packing of token pieces into sequences of a fixed capacity.

Documents are encoded and cut into pieces; only the pieces' places and lengths travel on. They are
dealt at random into shards of a bounded size and each shard is packed by best-fit decreasing: a
segment tree over the remaining capacities finds the tightest open bin in logarithmic time. A
shard wastes about half a sequence against packing all pieces at once.

Defined cases: a null or empty text is a piece of the end id alone; longer documents than the
capacity are cut so that only their first piece may be short; equal rows are packed each; an empty
table gives no rows; other columns are not carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinefold.llm.common import bound_batches, crc32_of, materialize, per_batch
from kinefold.llm.encoding import shared_encoder, vocabulary_path
from kinefold.llm.tokens import END_ID, TEXTS_AT_ONCE

CAPACITY = 1024
SHARD_PIECES = 8192


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece. The tree's leaves are the remaining capacities 0..capacity; a node counts the open bins below it."""
    size = 1 << capacity.bit_length()
    tree = [0] * (2 * size)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    made = 0

    def count(room: int, by: int) -> None:
        node = room + size
        while node:
            tree[node] += by
            node >>= 1

    def tightest(need: int) -> int:
        """The smallest remaining capacity of at least need that some bin has, or -1."""
        node = need + size
        if tree[node]:
            return need
        while node > 1:
            if not node & 1 and tree[node + 1]:
                node += 1
                while node < size:
                    node = 2 * node if tree[2 * node] else 2 * node + 1
                return node - size
            node >>= 1
        return -1

    for k in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[k])
        room = tightest(need)
        if room < 0:
            number, room = made, capacity
            made += 1
        else:
            number = open_bins[room].pop()
            count(room, -1)
        bins[k], offsets[k] = number, capacity - room
        if room > need:
            open_bins[room - need].append(number)
            count(room - need, 1)
    return bins, offsets


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Starts and lengths of a document's pieces: all full but perhaps the first."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(k, capacity) for k in range(first, n, capacity)]


_PIECES = T.ArrayType(T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]))
_PIECES_ARROW = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))


def pieces_of(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    bound_batches(docs.sparkSession)
    path = tokenizer or vocabulary_path()

    def make():
        encoder = shared_encoder(path)

        def work(texts: pa.Array) -> pa.Array:
            own, rows = texts.to_pylist(), []
            for k in range(0, len(own), TEXTS_AT_ONCE):
                for ids in encoder.encode(own[k : k + TEXTS_AT_ONCE]):
                    ids = np.append(ids, np.int32(end_id))
                    rows.append([{"piece": p, "start": a, "length": n, "ids_crc32": crc32_of(ids[a : a + n])} for p, (a, n) in enumerate(cut(len(ids), capacity))])
            return pa.array(rows, _PIECES_ARROW)

        return work

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return own.select("doc_id", F.explode(per_batch(make, _PIECES)(F.col("text"))).alias("p")).select("doc_id", "p.*")


def pack(docs: DataFrame, *, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES, **kwargs) -> DataFrame:
    """Pieces with sequence_id and offset: the pieces of a sequence lie without gaps from 0."""
    pieces = materialize(pieces_of(docs, capacity=capacity, **kwargs).withColumn("row", F.monotonically_increasing_id()), "pieces")
    shards = max(1, -(-pieces.count() // shard_pieces))
    # Dealt by the row's written number: equal rows, and those without an id, are spread like any others.
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    kind = pieces.schema["doc_id"].dataType.simpleString()

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("row", "ascending")])
        bins, offsets = best_fit_decreasing(table["length"].to_numpy(), capacity)
        shard = table["shard"].to_numpy() << 32
        return table.drop_columns(["row", "shard"]).append_column("sequence_id", pa.array(shard + bins)).append_column("offset", pa.array(offsets))

    return dealt.groupBy("shard").applyInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
