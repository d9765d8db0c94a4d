"""Lempel-Ziv phrase fingerprints: parse a text into dictionary phrases, hash the set of phrases,
and keep one minimum for each of LANES slices of the hash space. The share of lanes that agree
estimates how many phrases two texts share, much as compressing them together would.

Defined cases: a null text is an empty one; an empty text has only empty lanes, is wholly like another empty
text and unlike any other; equal texts have equal fingerprints. Ids are whole numbers, or texts of such (any other
id is an error); a null id comes first; rows of one id are in the order of their texts. The output is named
fingerprint, with underscores behind it where docs has such a column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinefold.llm.common import add_column, bound_batches, per_batch
from kinefold.llm.decontaminate import _POWERS

LANES = 128
_EMPTY = "----"
_FREE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Bytes of text in a bucket, about.
PART_BYTES = 32 << 20
#: Code points that are hashed at once.
GROUP_CHARS = 1 << 19


def parse(text: str, seen: set[str], ends: list[int], at: int = 0, stop: int | None = None) -> None:
    """LZ78 from position at: add each phrase, the shortest new string, to seen and its end to ends, as long as it ends by stop.

    A phrase's beginnings are phrases too, so the length of the next phrase is found by steps up or
    down from the length of the one before. A last phrase that is known already is left out.
    """
    add, push, n, size = seen.add, ends.append, len(text), 4
    stop = n if stop is None else stop
    while at < stop:
        phrase = text[at : at + size]
        if phrase in seen:
            size += 1
            phrase = text[at : at + size]
            while phrase in seen:
                if at + size >= n:
                    return
                size += 1
                phrase = text[at : at + size]
        else:
            while size > 1:
                shorter = text[at : at + size - 1]
                if shorter in seen:
                    break
                phrase = shorter
                size -= 1
        if at + size > stop:
            return
        add(phrase)
        at += size
        push(at)


def phrase_hashes(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit hashes of the strings from each start to the next."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _POWERS.get(len(points))
    mixed = (points + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * up[: len(points)]
    h = np.add.reduceat(mixed, starts) * down[starts]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def lanes(hashes: np.ndarray, count: int = LANES) -> np.ndarray:
    """The least hash of each slice, or all ones where it has none."""
    out = np.full(count, _FREE)
    np.minimum.at(out, (hashes >> np.uint64(64 - count.bit_length() + 1)).astype(np.int64), hashes)
    return out


def to_text(minima: np.ndarray) -> str:
    return "".join(_EMPTY if m == _FREE else f"{int(m) & 0xFFFF:04x}" for m in minima)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    used = (a != _FREE) | (b != _FREE)
    n = int(used.sum())
    return 1.0 if n == 0 else float(((a == b) & used).sum()) / n


def _hashes_of(text: str, ends: list[int], base: int = 0) -> np.ndarray:
    """Hashes of the phrases that end at ends, the first of which begins at base."""
    if not ends:
        return np.zeros(0, np.uint64)
    starts = np.array([base, *ends[:-1]], np.int64)
    out = []
    k = 0
    while k < len(starts):  # pieces, so that a very long text needs little memory
        to = max(k + 1, int(np.searchsorted(starts, starts[k] + GROUP_CHARS)))
        out.append(phrase_hashes(_points(text[int(starts[k]) : ends[to - 1]]), starts[k:to] - starts[k]))
        k = to
    return np.concatenate(out)


def minima_of(text: str) -> np.ndarray:
    ends: list[int] = []
    parse(text, set(), ends)
    return lanes(_hashes_of(text, ends))


def minima_of_pair(text: str, following: str) -> tuple[np.ndarray, np.ndarray, str]:
    """Minima of a text and of its edited form, and that form: the last half gives way to as much of the following text."""
    keep = len(text) - len(text) // 2
    edited = text[:keep] + following[: len(text) // 2]
    seen: set[str] = set()
    ends: list[int] = []
    parse(text, seen, ends, stop=keep)
    count, at, shared = len(ends), ends[-1] if ends else 0, seen.copy()
    parse(text, seen, ends, at)
    hashes = _hashes_of(text, ends)
    more: list[int] = []
    parse(edited, shared, more, at)
    return lanes(hashes), lanes(np.concatenate([hashes[:count], _hashes_of(edited, more, at)])), edited


def fingerprint(docs: DataFrame, *, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of each whole text as a string."""
    bound_batches(docs.sparkSession)

    def make():
        def work(texts: pa.Array) -> pa.Array:
            known: dict[str, str] = {}
            for x in (rows := [x or "" for x in texts.to_pylist()]):
                if x not in known:
                    known[x] = to_text(minima_of(x))
            return pa.array([known[x] for x in rows])

        return work

    return add_column(docs, out, per_batch(make, T.StringType())(F.col(text)))


def in_order(docs: DataFrame, *, doc_id: str, text: str, parts: int) -> DataFrame:
    """Rows (bucket, halo, id, text), dealt by ranges of ids and sorted: in each bucket its documents in order, and after them, with halo 1, the document that follows the last (after the very last: the first). Text is moved once."""
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("key")
    ids = docs.select(key)
    bounds = sorted(set(ids.approxQuantile("key", [k / parts for k in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    edges = np.array(bounds, np.float64)

    def make_bucket():
        def work(keys: pa.Array) -> pa.Array:
            return pa.array(np.searchsorted(edges, keys.to_numpy().astype(np.float64), "right").astype(np.int32))

        return work

    bucket = per_batch(make_bucket, T.IntegerType())
    firsts = sorted((r.bucket, r.first) for r in ids.withColumn("bucket", bucket(F.col("key"))).groupBy("bucket").agg(F.min("key").alias("first")).collect())
    before = {first: firsts[k - 1][0] for k, (_, first) in enumerate(firsts)}

    def make_targets():
        def work(keys: pa.Array) -> pa.Array:
            own = keys.to_numpy()
            at = np.searchsorted(edges, own.astype(np.float64), "right")
            return pa.array([[{"bucket": int(b), "halo": 0}] + ([{"bucket": before[k], "halo": 1}] if k in before else []) for k, b in zip(own.tolist(), at, strict=True)], pa.list_(pa.struct([("bucket", pa.int32()), ("halo", pa.int32())])))

        return work

    targets = per_batch(make_targets, T.ArrayType(T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("halo", T.IntegerType())])))
    rows = docs.select(key, F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("key", "doc_id", "text", F.explode(targets(F.col("key"))).alias("t"))
    return rows.select("t.bucket", "t.halo", "key", "doc_id", "text").repartition(max(1, parts // 4), "bucket").sortWithinPartitions("bucket", "halo", "key", "text")


def compare_edited(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: fingerprints of its text and of its edited text, and how like its own is to that and to the next document's."""
    import hashlib

    spark = docs.sparkSession
    bound_batches(spark)
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the document whose follower has not come yet: bucket, id, text
        early: dict[str, np.ndarray] = {}
        for batch in batches:
            out = []
            for bucket, halo, doc, own in zip(*(batch.column(c).to_pylist() for c in ("bucket", "halo", "doc_id", "text")), strict=True):
                if held and held[0] == bucket:
                    a, b, edited = minima_of_pair(held[2], own)
                    following = a if own == held[2] else minima_of(own) if halo else None
                    out.append([held[1], len(held[2]), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), a, b, following])
                held = None if halo else (bucket, doc, own)
            # A document's own minima serve the one before it.
            yield from _rows(out, early, names, batch.schema.field("doc_id").type)

    def _rows(out, early, names, id_type):
        waiting = early.pop("row", None)
        done = []
        for row in [waiting, *out] if waiting else out:
            if done and done[-1][5] is None:
                done[-1][5] = row[3]
            done.append(row)
        if done and done[-1][5] is None:
            early["row"] = done.pop()
        if done:
            columns = [pa.array([r[0] for r in done], id_type), pa.array([r[1] for r in done], pa.int64()), pa.array([r[2] for r in done])]
            columns += [pa.array([to_text(r[3]) for r in done]), pa.array([to_text(r[4]) for r in done])]
            columns += [pa.array([likeness(r[3], r[4]) for r in done]), pa.array([likeness(r[3], r[5]) for r in done])]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(docs, doc_id=doc_id, text=text, parts=parts).mapInArrow(run, schema)
