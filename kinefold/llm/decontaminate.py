"""Benchmark decontamination with suffix arrays over shards of the training texts.

A shard is a run of whole documents inside one Arrow batch. Its suffix array is sparse: it holds
the word positions whose first words (four, or the whole window if it is shorter) begin some
benchmark window; no other suffix can hold a window. Every benchmark suffix is then found in it by
binary search: the matching range gives all occurrences. A document's items are the union of its windows' sets of
items, which windows of equal sets share; an item's longest verbatim match begins at one of the two neighbours of the item's
own suffix among the text's suffixes in order, so no step is taken for an item and an occurrence. Nothing is
shuffled, and memory follows the shard, not the corpus.

Words are compared by 64-bit hashes of their bytes, so a false match needs as many hash collisions in a row as
the window has words (13; one for an item of one word).

A benchmark larger than BLOCK_CHARS is taken block by block: each block's index is broadcast alone. The corpus is written
once, with row numbers; each further block reads numbers and texts and writes only the rows in which it found
something, and these are joined to the rest by the number at the end.

Defined cases: a null or empty text has no words and is not contaminated; benchmark rows with a
null id, or without words, are left out; repeated items and documents each count as they stand;
an empty benchmark contaminates nothing.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable
from functools import reduce
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinefold.llm.common import bound_batches, chunks, free_name, materialize, per_batch, ship, utf8

WINDOW = 13
#: Words of a suffix that the sort looks at, at least (never fewer than the window); longer matches are widened word by word.
DEPTH = 64
PREFIX = 4
SHARD_BYTES = 4 << 20
#: Characters of benchmark text in one broadcast index; a larger benchmark is taken in blocks.
BLOCK_CHARS = 4_000_000

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[0x30:0x3A] = _IN_WORD[0x61:0x7B] = _IN_WORD[0x80:] = True
_RNG = np.random.default_rng(20240611)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[~_IN_WORD] = 0
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = _RNG.integers(1, 2**63, PREFIX, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Powers:
    """Powers of the hash base and of its inverse modulo 2**64."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n, tables = 1 << n.bit_length(), []
            for base in (_BASE, pow(_BASE, -1, 2**64)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                tables.append(np.multiply.accumulate(steps))
            self.up, self.down = tables
        return self.up, self.down


_POWERS = _Powers()


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of texts that lie side by side: the hash of every word, and the text it is in."""
    base = int(offsets[0])
    folded = _FOLD[data[base : int(offsets[-1])]]
    inside = _IN_WORD[folded]
    if not inside.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1] - base
    edges = edges[edges < len(inside)]
    first[edges] |= inside[edges]
    starts = np.flatnonzero(first)
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # pieces of a few MB, so that a very long text needs little memory
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + (2 << 20))))
        lo, hi = starts[at], starts[to] if to < len(starts) else len(folded)
        up, down = _POWERS.get(int(hi - lo))
        own = starts[at:to] - lo
        hashes[at:to] = np.add.reduceat(_BYTE[folded[lo:hi]] * up[: hi - lo], own) * down[own]
        at = to
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    hashes ^= hashes >> np.uint64(32)
    return hashes, np.searchsorted(offsets, starts + base, "right") - 1


def _prefix_keys(hashes: np.ndarray, k: int) -> np.ndarray:
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    key = hashes[:n] * _MIX[0]
    for j in range(1, k):
        key = key + hashes[j : n + j] * _MIX[j]
    return key ^ (key >> np.uint64(31))


class _Members:
    """A set of 64-bit values: a bit table over the top bits first, then a sorted search."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = np.unique(values)
        self.shift = np.uint64(64 - max(16, min(24, int(len(self.values) * 16).bit_length())))
        self.bits = np.zeros(1 << (64 - int(self.shift)), bool)
        self.bits[self.values >> self.shift] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where members stand in values, and their ranks."""
        at = np.flatnonzero(self.bits[values >> self.shift])
        got = values[at]
        rank = np.minimum(np.searchsorted(self.values, got), len(self.values) - 1)
        same = self.values[rank] == got
        return at[same], rank[same]


class BenchmarkIndex:
    """The words and windows of a block of benchmark items."""

    def __init__(self, items: list[tuple[object, str]], window: int = WINDOW) -> None:
        self.items, rows = [], []
        self.depth = max(DEPTH, window)
        for item, text in items:
            hashes, _ = words_of(np.frombuffer((raw := (text or "").encode()), np.uint8), np.array([0, len(raw)]))
            if item is not None and len(hashes):
                self.items.append(str(item))
                rows.append(hashes)
        self.vocabulary = _Members(np.concatenate(rows)) if rows else None
        self.sequences: list[np.ndarray] = []
        where: dict[bytes, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        keys: dict[int, dict[int, list[bytes]]] = defaultdict(lambda: defaultdict(list))
        for k, hashes in enumerate(rows):
            ids = (np.searchsorted(self.vocabulary.values, hashes) + 1).astype(">u4")
            self.sequences.append(ids)
            size = min(window, len(ids))
            prefix = min(PREFIX, size)
            prefixes = _prefix_keys(hashes, prefix)
            for j in range(len(ids) - size + 1):
                query = ids[j : j + size].tobytes()
                if query not in where:
                    keys[prefix][int(prefixes[j])].append(query)
                where[query][k].append(j)
        self.raw = [x.tobytes() for x in self.sequences]
        self.longest = max(map(len, self.sequences), default=0)
        # Windows of the same items share one set of them; the places of a window are (item, word).
        sets: dict[tuple[int, ...], int] = {}
        self.set_of = {q: sets.setdefault(tuple(own), len(sets)) for q, own in where.items()}
        self.sets = [frozenset(x) for x in sets]
        self.where = {q: [(k, j) for k, js in own.items() for j in js] for q, own in where.items()}
        self.prefixes = {}
        for k, by_key in keys.items():
            members = _Members(np.array(list(by_key), np.uint64))
            self.prefixes[k] = (members, [by_key[int(v)] for v in members.values])

    def search(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, list, list]]:
        """Of a shard, per text: words, spans (first word, words) and for each item found its longest match (item, item's word, text's word, words; of equals the first in the text, then in the item)."""
        hashes, owner = words_of(data, offsets)
        n = len(offsets) - 1
        counts = np.bincount(owner, minlength=n)
        firsts = np.concatenate([[0], np.cumsum(counts)])
        out: list[tuple[int, list, list]] = [(int(c), [], []) for c in counts]
        suffixes, queries = [], []
        for k, (members, by_rank) in self.prefixes.items():
            at, rank = members.find(_prefix_keys(hashes, k))
            same = owner[at] == owner[at + k - 1] if len(at) else np.zeros(0, bool)
            suffixes.append(at[same])
            queries += [q for r in np.unique(rank[same]) for q in by_rank[r]]
        if not queries:
            return out
        ids = np.zeros(len(hashes), ">u4")
        at, rank = self.vocabulary.find(hashes)
        ids[at] = rank + 1
        raw = ids.tobytes()
        at = np.unique(np.concatenate(suffixes))
        text_of, ends = dict(zip(at.tolist(), owner[at].tolist(), strict=True)), dict(zip(at.tolist(), firsts[owner[at] + 1].tolist(), strict=True))

        def suffix(p: int) -> bytes:
            return raw[4 * p : 4 * min(p + self.longest, ends[p])]

        array = sorted((raw[4 * p : 4 * min(p + self.depth, end)], p) for p, end in ends.items())
        keys = [x[0] for x in array]
        if self.longest > self.depth:
            array = [(key, p) for key, run in groupby(array, itemgetter(0)) for p in _in_full([p for _, p in run], suffix)]
        found: dict[int, dict[bytes, list[int]]] = defaultdict(dict)
        for query in queries:
            lo = bisect_left(keys, query)
            hi = bisect_left(keys, query + b"\xff\xff\xff\xff", lo)
            size = len(query) // 4
            for _, p in array[lo:hi]:
                text = text_of[p]
                out[text][1].append((p - int(firsts[text]), size))
                found[text].setdefault(query, []).append(p)
        for text, windows in found.items():
            first = int(firsts[text])
            items = frozenset().union(*(self.sets[k] for k in {self.set_of[q] for q in windows}))
            best = self._longest(windows, raw, suffix, ends)
            out[text][2].extend((self.items[k], best[k][1], best[k][0] - first, best[k][2]) for k in sorted(items))
        return [(c, _merged(spans), matches) for c, spans, matches in out]

    def _longest(self, windows: dict[bytes, list[int]], raw: bytes, suffix: Callable[[int], bytes], ends: dict[int, int]) -> dict[int, tuple[int, int, int]]:
        """Of one text, from the places of its windows in the order of their suffixes: each item's longest match (word of the shard, item's word, words)."""
        best: dict[int, tuple[int, int, int]] = {}
        earliest: dict[bytes, int] = {}
        for query, places in windows.items():
            least = len(query) // 4
            for item, j in self.where[query]:
                own = self.raw[item]
                had = best.get(item)
                if had and len(own) // 4 - j < had[2]:
                    continue
                at = bisect_left(places, own[4 * j :], key=suffix) if len(places) > 1 else 0
                size = max(_common(own, j, raw, p, min(len(own) // 4 - j, ends[p] - p), least) for p in places[max(0, at - 1) : at + 1])
                if had and size < had[2]:
                    continue
                prefix = own[4 * j : 4 * (j + size)]
                p = earliest.get(prefix)
                if p is None:
                    lo = bisect_left(places, prefix, key=suffix)
                    p = earliest[prefix] = min(places[lo : bisect_left(places, prefix + b"\xff\xff\xff\xff", lo, key=suffix)])
                if not had or (-size, p, j) < (-had[2], had[0], had[1]):
                    best[item] = (p, j, size)
        return best


def _in_full(places: list[int], suffix: Callable[[int], bytes]) -> list[int]:
    """Places of suffixes that agree in the words that were sorted, by the words behind these."""
    return sorted(places, key=suffix) if len(places) > 1 else places


def _common(a: bytes, i: int, b: bytes, j: int, most: int, known: int) -> int:
    """Words that agree from word i of a and word j of b, at most most; the first known ones do."""
    at, step = known, 16
    while at < most:
        n = min(step, most - at)
        x, y = a[4 * (i + at) : 4 * (i + at + n)], b[4 * (j + at) : 4 * (j + at + n)]
        if x != y:
            while n > 1:  # halve the piece that holds the first difference
                half = n // 2
                if x[: 4 * half] == y[: 4 * half]:
                    at, x, y, n = at + half, x[4 * half :], y[4 * half :], n - half
                else:
                    x, y, n = x[: 4 * half], y[: 4 * half], half
            return at
        at, step = at + n, 4 * step
    return most


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans (first, words) without overlaps."""
    out: list[tuple[int, int]] = []
    for start, size in sorted(spans):
        if out and start <= sum(out[-1]):
            out[-1] = (out[-1][0], max(sum(out[-1]), start + size) - out[-1][0])
        else:
            out.append((start, size))
    return out


_BLOCK = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
        T.StructField("matches", T.ArrayType(T.StructType([T.StructField("item_id", T.StringType()), T.StructField("item_word", T.IntegerType()), T.StructField("doc_word", T.IntegerType()), T.StructField("n_words", T.IntegerType())]))),
    ]
)
_BLOCK_ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int32()))), ("matches", pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int32()), ("doc_word", pa.int32()), ("n_words", pa.int32())])))])


def benchmark_blocks(benchmark: DataFrame, *, item_id: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> list[DataFrame]:
    """The benchmark's items with an id, in blocks of about so many characters."""
    bench = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("body")).where("item is not null")
    n = max(1, -(-(bench.agg(F.sum(F.length("body"))).first()[0] or 0) // block_chars))
    return [bench if n == 1 else bench.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k) for k in range(n)]


def find_matches(docs: DataFrame, block: DataFrame, *, text: str = "text", window: int = WINDOW, out: str = "overlap") -> DataFrame:
    """docs with a struct column: words, merged hit spans and each item's longest match, for one block of the benchmark (item, body)."""
    spark = docs.sparkSession
    bound_batches(spark)
    get_index = ship(spark, BenchmarkIndex([(r.item, r.body) for r in block.collect()], window))

    def make():
        index = get_index()

        def work(texts: pa.Array) -> pa.Array:
            data, offsets = utf8(texts)
            rows = []
            for i, j in chunks(offsets, SHARD_BYTES):
                rows += [{"n_words": n, "spans": spans, "matches": [dict(zip(("item_id", "item_word", "doc_word", "n_words"), m, strict=True)) for m in matches]} for n, spans, matches in index.search(data, offsets[i : j + 1])]
            return pa.array(rows, _BLOCK_ARROW)

        return work

    return docs.withColumn(out, per_batch(make, _BLOCK)(F.col(text)))


_SUMMARY = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType())])
_SUMMARY_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])


def _summary(blocks: list[dict]) -> dict:
    hit, items = 0, set()
    end = 0
    for start, size in sorted(tuple(s) for b in blocks for s in b["spans"]):
        hit += max(0, start + size - max(start, end))
        end = max(end, start + size)
    for b in blocks:
        items.update(m["item_id"] for m in b["matches"])
    n = blocks[0]["n_words"]
    return {"n_words": n, "n_hit": hit, "n_items": len(items), "items_sha256": hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), "contaminated": hit > 0 and 20 * hit >= n}


def contamination(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS, out: str = "contamination") -> DataFrame:
    """docs with a struct column: n_words, n_hit, n_items, items_sha256, contaminated. One row per input row, all its columns kept."""
    name, columns = free_name(docs, out), docs.columns
    first, *rest = benchmark_blocks(benchmark, item_id=item_id, item_text=item_text, block_chars=block_chars)
    found, row, more = free_name(docs, "overlap"), free_name(docs, "row"), free_name(docs, "more")
    docs = find_matches(docs, first, text=text, window=window, out=found)
    overlaps = F.array(found)
    if rest:
        docs = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
        hits = []
        for k, block in enumerate(rest):
            own = find_matches(docs.select(row, text), block, text=text, window=window, out=more)
            hits.append(materialize(own.where(F.size(f"`{more}`.spans") > 0).select(row, more), f"block{k + 1}"))
        hits = reduce(DataFrame.union, hits).groupBy(row).agg(F.collect_list(more).alias(more))  # at most one a block
        docs = docs.join(hits, row, "left")
        overlaps = F.concat(overlaps, F.coalesce(F.col(more), F.array().cast(docs.schema[more].dataType)))

    def make():
        def work(found: pa.Array) -> pa.Array:
            return pa.array([_summary(x) for x in found.to_pylist()], _SUMMARY_ARROW)

        return work

    return docs.withColumn(name, per_batch(make, _SUMMARY)(overlaps)).select(*(F.col(f"`{c}`") for c in columns), name)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **kwargs) -> DataFrame:
    """docs without the contaminated rows."""
    out = free_name(docs, "contamination")
    return contamination(docs, benchmark, out=out, **kwargs).where(~F.col(f"`{out}`.contaminated")).drop(out)
