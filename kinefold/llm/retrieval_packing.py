"""Packing by lexical retrieval: a window holds a seed document and its nearest unused neighbours by BM25.

Documents are encoded once; their ids are the terms. How many documents hold each term is counted by Spark over all of them
(a row a term of the vocabulary, so the table is bounded and goes to every task). A document's two heaviest terms place it on a
line, which Spark cuts into ranges: related documents become neighbours, and a term that a third of all documents lead with
is cut by the row number. Each range is a run of shards of bounded size. A shard has an inverted
index; a window asks it with its seed's heaviest terms and takes unused documents in the order of their scores until it is
full. The document that no longer fits is cut, and its rest is the seed of the next window, so that every
sequence but the last of a range is full.

Defined cases: a null or empty text is the end id alone; such documents have no terms and follow in the order of
the line, as do documents that no question finds; equal scores are taken in the order of the line; equal rows are
packed each; an empty table gives no rows; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from kinefold.llm.common import bound_batches, crc32_of, discard, materialize, per_batch, ship, slices
from kinefold.llm.encoding import shared_chunk_encoder, vocabulary_path
from kinefold.llm.tokens import END_ID, TEXTS_AT_ONCE

CAPACITY = 4096
#: BM25's saturation of term counts and its share of length normalisation.
K1, B = 1.2, 0.75
#: Terms of a seed, the heaviest, that its question is made of.
QUERY_TERMS = 24
#: Ids and documents of a shard: what one index holds.
SHARD_IDS, SHARD_DOCS = 2_000_000, 16_384
#: Ids of a range, and the most ranges: beyond, ranges grow (they stream through their task).
RANGE_IDS, MOST_RANGES = 2_000_000, 100_000


def idf_of(documents: np.ndarray, n: int) -> np.ndarray:
    """Weights of terms by how many of n documents hold them."""
    return np.log1p((n - documents + 0.5) / (documents + 0.5))


def term_weights(tf: np.ndarray, idf: np.ndarray, length: np.ndarray | int, mean_length: float) -> np.ndarray:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))


def counts_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids in order, and how often each is there."""
    own = np.sort(ids, kind="stable")  # by radix where ids have two bytes
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    return own[first], np.diff(np.append(first, len(own)))


def heaviest(terms: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """The n terms of the largest weights, heaviest first; of equal ones the smaller term."""
    if len(terms) > 4 * n:
        least = np.partition(weights, len(weights) - n)[len(weights) - n]
        near = weights >= least
        terms, weights = terms[near], weights[near]
    return terms[np.lexsort((terms, -weights))[:n]]


def two_heaviest(terms: np.ndarray, weights: np.ndarray) -> list[int]:
    """heaviest(terms, weights, 2), for terms in order."""
    out = []
    for _ in range(min(2, len(terms))):
        k = int(weights.argmax())
        out.append(int(terms[k]))
        weights[k] = -np.inf
    return out


class Shard:
    """The inverted index of some documents' ids."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float) -> None:
        counted = [counts_of(x) for x in docs]
        self.edges = np.concatenate([[0], np.cumsum([len(t) for t, _ in counted])]).astype(np.int64)
        self.terms = np.concatenate([t for t, _ in counted]).astype(np.int64)
        tf = np.concatenate([c for _, c in counted])
        owner = np.repeat(np.arange(len(docs)), np.diff(self.edges))
        lengths = np.array([len(x) for x in docs], np.float64)
        self.weights = term_weights(tf, idf[self.terms], lengths[owner], mean_length)
        order = np.argsort(self.terms.astype(np.uint32), kind="stable")
        self.found, self.gains = owner[order], self.weights[order]
        self.postings = np.concatenate([[0], np.cumsum(np.bincount(self.terms, minlength=len(idf)))])
        self.unused = np.ones(len(docs), bool)

    def question(self, doc: int) -> np.ndarray:
        own = slice(self.edges[doc], self.edges[doc + 1])
        return heaviest(self.terms[own], self.weights[own], QUERY_TERMS)

    def neighbours(self, doc: int) -> list[int]:
        """Unused documents that share a term of the question, best first."""
        runs = [(self.postings[t], self.postings[t + 1]) for t in self.question(doc).tolist()]
        if not runs:
            return []
        scores = np.bincount(np.concatenate([self.found[a:b] for a, b in runs]), np.concatenate([self.gains[a:b] for a, b in runs]), len(self.unused))
        near = np.flatnonzero((scores > 0) & self.unused)
        return near[np.argsort(-np.round(scores[near], 9), kind="stable")].tolist()


def fill(lengths: np.ndarray, shard: Shard, capacity: int, sequence: int, offset: int) -> tuple[list[tuple[int, int, int, int, int]], int, int]:
    """Pieces (document, start, length, sequence, offset) of all documents of a shard, and where the next shard goes on."""
    pieces, following, doc, start = [], 0, None, 0
    queue: Iterator[int] = iter(())
    while True:
        if doc is None:  # the best neighbour that is left, or the next of the line, which becomes a seed
            doc = next((k for k in queue if shard.unused[k]), None)
            if doc is None:
                while following < len(lengths) and not shard.unused[following]:
                    following += 1
                if following == len(lengths):
                    return pieces, sequence, offset
                doc = following
                shard.unused[doc] = False
                queue = iter(shard.neighbours(doc))
            shard.unused[doc] = False
        took = min(int(lengths[doc]) - start, capacity - offset)
        pieces.append((doc, start, took, sequence, offset))
        start, offset = start + took, offset + took
        whole = start == lengths[doc]
        if offset == capacity:
            sequence, offset = sequence + 1, 0
            queue = iter(()) if whole else iter(shard.neighbours(doc)) if lengths[doc] - start < capacity else queue
        if whole:
            doc, start = None, 0


def _encoded(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, n_tokens and ids (unsigned integers of width bytes each) of each document; and, with a term, how many of a task's documents hold it."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = docs.sparkSession.createDataFrame([], f"doc_id {kind}, n_tokens long, width int, ids binary, term int, held long").schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_chunk_encoder(path)
        dtype = np.dtype("<u2" if max(encoder.size, end_id + 1) <= 1 << 16 else "<u4")
        held = np.zeros(max(encoder.size, end_id + 1), np.int64)
        for batch in batches:
            for own in slices(batch, TEXTS_AT_ONCE):
                rows = [x.astype(dtype) for x in encoder.encode(own.column("text").to_pylist())]
                for x in rows:
                    held[counts_of(x)[0]] += 1
                n, end = len(rows), np.array([end_id], dtype).tobytes()
                yield pa.RecordBatch.from_arrays([own.column("doc_id").cast(arrow[0].type), pa.array([len(x) + 1 for x in rows], pa.int64()), pa.array([dtype.itemsize] * n, pa.int32()), pa.array([x.tobytes() + end for x in rows], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())], schema=arrow)
        terms = np.flatnonzero(held)
        if len(terms):
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(terms), f.type) for f in list(arrow)[:4]), pa.array(terms, pa.int32()), pa.array(held[terms])], schema=arrow)

    return docs.mapInArrow(run, schema)


def _ids(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{width}")


def pack_related(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, shard_ids: int = SHARD_IDS, shard_docs: int = SHARD_DOCS, range_ids: int = RANGE_IDS) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. The pieces of a sequence lie without gaps from 0."""
    spark = docs.sparkSession
    bound_batches(spark)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    encoded = materialize(_encoded(own, tokenizer or vocabulary_path("word_bpe_49k.json"), end_id), "encoded")
    n, total = encoded.where("term is null").agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    held = encoded.where("term is not null").groupBy("term").agg(F.sum("held").alias("held")).toPandas()  # a row a term of the vocabulary
    idf = np.zeros(1 + int(max(held["term"].max(), end_id)) if len(held) else 1 + end_id)
    idf[held["term"].to_numpy(np.int64)] = idf_of(held["held"].to_numpy(np.float64), n)
    mean_length = max(1.0, (total - n) / max(1, n))
    model = ship(spark, (idf, mean_length))

    def make():
        weights, mean = model()

        def work(rows: pa.Array) -> pa.Array:
            leads = []
            for raw, width in zip(rows.field("ids").to_pylist(), rows.field("width").to_pylist(), strict=True):
                ids = _ids(raw, width)[:-1]
                terms, tf = counts_of(ids)
                leads.append(two_heaviest(terms, term_weights(tf, weights[terms], len(ids), mean)))
            return pa.array(leads, pa.list_(pa.int32()))

        return work

    placed = encoded.where("term is null").select("doc_id", "n_tokens", "width", "ids", per_batch(make, "array<int>")(F.struct("ids", "width")).alias("leads"))
    placed = materialize(placed.select("doc_id", "n_tokens", "width", "ids", F.get("leads", F.lit(0)).alias("first"), F.get("leads", F.lit(1)).alias("second")), "placed")
    discard(encoded)
    ranges = min(MOST_RANGES, max(1, -(-int(total) // range_ids)))
    line = placed.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(ranges, "first", "second", "row").sortWithinPartitions("first", "second", "row")
    kind = placed.schema["doc_id"].dataType.simpleString()
    schema = spark.createDataFrame([], f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long").schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        weights, mean = model()
        sequence, offset = TaskContext.get().partitionId() << 40, 0
        names, held_ids, size = [], [], 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, offset
            shard = Shard([x[:-1] for x in held_ids], weights, mean)
            lengths = np.array([len(x) for x in held_ids], np.int64)
            pieces, sequence, offset = fill(lengths, shard, capacity, sequence, offset)
            for k in range(0, len(pieces), 10_000):
                doc, start, took, number, place = zip(*pieces[k : k + 10_000], strict=True)
                crc = [crc32_of(held_ids[d][a : a + m]) for d, a, m in zip(doc, start, took, strict=True)]
                columns = [[names[d] for d in doc], start, took, crc, lengths[list(doc)], number, place]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for name, raw, width in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "width")), strict=True):
                names.append(name)
                held_ids.append(_ids(raw, width))
                size += len(held_ids[-1])
                if size >= shard_ids or len(names) >= shard_docs:
                    yield from packed()
                    names, held_ids, size = [], [], 0
        if names:
            yield from packed()

    return line.select("doc_id", "ids", "width").mapInArrow(run, schema)
