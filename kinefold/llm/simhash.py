"""SimHash near-duplicates, found with vantage-point trees.

A fingerprint's 64 bits are cut into blocks; two fingerprints within r bits agree wholly in all but
r of the blocks, that is, they lie at distance 0 in the Hamming metric of some choice of the other
blocks. For each choice a vantage-point tree, grown from a bounded sample, deals all distinct
fingerprints into shards by their distance to vantage points in that metric. A query's ball has
radius 0 there, so it reaches one shard a choice instead of most shards (over all 64 bits a ball
of radius 4 crosses about seven in ten boundaries). Within a shard a second tree over all
64 bits joins the fingerprints: sides of a split only meet where the triangle bound lets them.
A shard that is too full is cut into parts and each pair of parts is a task of its own.

A shard returns a spanning forest of its links, never all pairs; components come from star
contraction with tables written between rounds.

Links and components are found among distinct fingerprints; joins back to documents and to hubs deal rows
of a frequent key over all tasks (common.join_spread).

Defined cases: a null, empty or blank text has fingerprint zero and is linked like any other; equal
rows share a component; a row without doc_id is linked, but names no component (component_id is null where no
row of a component has an id); ids may be of any type with an order; an empty table gives no rows. Where a component
leaves one row, it is that of the smallest id (rows without one last), of equal ids the smallest hash of the
whole row, and of wholly equal rows one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinefold.llm.common import bound_batches, discard, free_name, hash_sample, join_spread, materialize, per_batch, ship

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Distinct fingerprints that a shard should hold, and those beyond which it is cut into parts.
SHARD_ROWS = 1024
PART_ROWS = 20_000
#: Distinct fingerprints from which the trees are grown.
SAMPLE_ROWS = 20_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([digest(joined)], np.uint64)
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(sizes) - 1
        starts = (ends - sizes + 1)[: len(words) - shingle + 1].tolist()
        hashes = np.array([digest(joined[a:b]) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, text: str = "text", out: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """docs with the fingerprint as a long."""
    bound_batches(docs.sparkSession)

    def make():
        def work(texts: pa.Array) -> pa.Array:
            known: dict[str | None, int] = {}
            rows = []
            for x in texts.to_pylist():
                if x not in known:
                    known[x] = fingerprint(x, shingle)
                rows.append(known[x])
            return pa.array(np.array(rows, np.uint64).view(np.int64))

        return work

    return docs.withColumn(free_name(docs, out), per_batch(make, T.LongType())(F.col(text)))


class VantageTree:
    """A vantage-point tree over the bits of a mask; leaves are numbered."""

    def __init__(self, sample: np.ndarray, mask: int, leaf_rows: int, seed: int = 1) -> None:
        self.mask = np.uint64(mask)
        self.vantage, self.bound, self.child = [], [], []
        self.leaves = 0
        rng = np.random.default_rng(seed)
        self.root = self._grow(np.unique(sample & self.mask, return_counts=True), leaf_rows, rng)
        self.vantage, self.bound, self.child = np.array(self.vantage, np.uint64), np.array(self.bound, np.int64), np.array(self.child, np.int64).reshape(-1, 2)

    def _grow(self, rows: tuple[np.ndarray, np.ndarray], leaf_rows: int, rng: np.random.Generator) -> int:
        """A node's number, or -1 less a leaf's."""
        values, counts = rows
        if counts.sum() > leaf_rows and len(values) > 1:
            v = values[rng.integers(len(values))]
            d = np.bitwise_count(values ^ v).astype(np.int64)
            order = np.argsort(d, kind="stable")
            middle = int(d[order][np.searchsorted(np.cumsum(counts[order]), counts.sum() / 2)])
            middle = min(middle, int(d.max()) - 1)
            node = len(self.vantage)
            self.vantage.append(v)
            self.bound.append(middle)
            self.child.append(None)
            near = d <= middle
            self.child[node] = [self._grow((values[near], counts[near]), leaf_rows, rng), self._grow((values[~near], counts[~near]), leaf_rows, rng)]
            return node
        self.leaves += 1
        return -self.leaves

    def leaf(self, values: np.ndarray) -> np.ndarray:
        """The one leaf that a ball of radius 0 around each value reaches."""
        values = values & self.mask
        at = np.full(len(values), self.root)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            far = np.bitwise_count(values[inner] ^ self.vantage[node]).astype(np.int64) > self.bound[node]
            at[inner] = self.child[node, far.astype(np.int64)]
        return -at - 1


def near_pairs(x: np.ndarray, radius: int, block: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of values within the radius, in blocks: a vantage-point tree's self-join."""

    def brute(a: np.ndarray, b: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for k in range(0, len(a), block):
            other = a[k:] if b is None else b
            i, j = np.nonzero(np.bitwise_count(x[a[k : k + block], None] ^ x[None, other]) <= radius)
            if b is None:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield a[k : k + block][i], other[j]

    todo = [np.arange(len(x))]
    while todo:
        own = todo.pop()
        d = np.bitwise_count(x[own] ^ x[own[0]]).astype(np.int64) if len(own) > block else None
        if d is None or (middle := min(int(np.median(d)), int(d.max()) - 1)) < int(d.min()):
            yield from brute(own, None)
            continue
        near = d <= middle
        todo += [own[near], own[~near]]
        # Across the split: only values whose distances to the vantage point differ by the radius at most.
        for ring in range(max(0, middle - radius + 1), middle + 1):
            yield from brute(own[d == ring], own[(d > middle) & (d <= ring + radius)])


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index that each index is linked to."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            ra, rb = root[a], root[b]
            open_ = ra != rb
            if not open_.any():
                break
            a, b = a[open_], b[open_]
            hi, lo = np.maximum(ra[open_], rb[open_]), np.minimum(ra[open_], rb[open_])
            np.minimum.at(root, hi, lo)
            while (root[root] != root).any():
                root = root[root]
    return root


def choices(rows: int, radius: int, shard_rows: int) -> list[int]:
    """Masks of the block choices: as few blocks as still let shards be small."""
    for blocks in range(radius + 1, 2 * radius + 1):
        cuts = [round(64 * k / blocks) for k in range(blocks + 1)]
        masks = [sum(((1 << (cuts[k + 1] - cuts[k])) - 1) << cuts[k] for k in own) for own in combinations(range(blocks), blocks - radius)]
        if rows >> min(m.bit_count() for m in masks) <= shard_rows:
            break
    return masks


def links(distinct: DataFrame, *, radius: int = RADIUS, shard_rows: int = SHARD_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """Links (a, b), a > b, between near ones of the distinct fingerprints (column fp): a forest for each shard."""
    spark = distinct.sparkSession
    rows = distinct.count()
    sample = np.array([r.fp for r in hash_sample(distinct.select("fp"), "fp", SAMPLE_ROWS).collect()], np.int64).view(np.uint64)
    masks = choices(rows, radius, shard_rows)
    leaf_rows = max(2, int(len(sample) * shard_rows / max(rows, 1)))
    get_trees = ship(spark, [VantageTree(sample, m, leaf_rows) for m in masks])

    def make():
        trees = get_trees()

        def work(fps: pa.Array) -> pa.Array:
            values = fps.to_numpy().view(np.uint64)
            leaves = np.stack([t.leaf(values) for t in trees], axis=1) * len(trees) + np.arange(len(trees))
            return pa.ListArray.from_arrays(pa.array(np.arange(0, leaves.size + 1, len(trees)), pa.int32()), pa.array(leaves.ravel(), pa.int64()))

        return work

    dealt = materialize(distinct.select("fp", F.explode(per_batch(make, T.ArrayType(T.LongType()))(F.col("fp"))).alias("shard")), "shards")
    full = dealt.groupBy("shard").count().where(F.col("count") > part_rows).select("shard", F.ceil(F.col("count") / part_rows).cast("int").alias("parts"))
    # Part p of a full shard goes to the tasks (p, q) and (q, p) of all parts q; other shards have one task.
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    tasks = (
        dealt.join(full, "shard", "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("part", part)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("shard", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "fp")
    )

    def search(table: pa.Table) -> pa.Table:
        fps = np.sort(table["fp"].to_numpy())
        root = forest(len(fps), near_pairs(fps.view(np.uint64), radius))
        linked = np.flatnonzero(root != np.arange(len(fps)))
        return pa.table({"a": pa.array(fps[linked]), "b": pa.array(fps[root[linked]])})

    return tasks.groupBy("shard", "lo", "hi").applyInArrow(search, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """Each node a that is not its component's smallest, with that smallest b: star contraction until nothing changes."""
    edges = materialize(edges.distinct(), "edges")
    mark = None
    while True:  # as many rounds as it takes; their number grows with the logarithm of the longest path
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(now) == mark:
            return edges
        mark = tuple(now)
        # Large star: every larger neighbour of u goes to the smallest of u and its neighbours.
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = join_spread(both.where("b > a"), least, "a", "n", "b").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: u and its smaller neighbours go to the smallest of them.
        smallest = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        joined = join_spread(large, smallest, "a", "n", "b")
        small = joined.select("a", F.col("m").alias("b")).union(joined.select(F.col("b").alias("a"), F.col("m").alias("b")))
        before, edges = edges, materialize(small.where("a <> b").distinct(), "edges")
        discard(before)


def _owners(fps: DataFrame, radius: int) -> DataFrame:
    """One row per distinct fingerprint of fps (doc_id, fp): fp, component_id, rows."""
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")), "distinct")
    found = components(links(distinct.select("fp"), radius=radius)).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    rooted = distinct.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n"))
    return materialize(join_spread(rooted, smallest, "root", "n", "fp").select("fp", "component_id", "root", "rows"), "owners")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, fp (long), component_id (the smallest doc_id that links reach)."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fps = materialize(fingerprints(own, text="text", shingle=shingle).select("doc_id", "fp"), "fingerprints")
    return join_spread(fps, _owners(fps, radius), "fp", "rows", "doc_id").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One document of each component; all columns kept."""
    row = F.xxhash64(*(F.to_json(F.struct(F.col(f"`{c}`").alias("c"))) if "map<" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes))  # maps have no hash of their own
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), row.alias("row"))
    fps = materialize(fingerprints(own, text="text", shingle=shingle).select("doc_id", "fp", "row"), "fingerprints")
    placed = join_spread(fps, _owners(fps.select("doc_id", "fp"), radius), "fp", "rows", "row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "fp"))
    kept = materialize(placed.groupBy("root").agg(first.alias("k"), F.count(F.lit(1)).alias("n")).select("k.row", "k.doc_id", "n"), "kept")
    # Of most rows that stay there is one; only those of which there may be several equal ones are told apart.
    id_, hash_, n = free_name(docs, "kept_id"), free_name(docs, "kept_row"), free_name(docs, "kept_n")
    names = kept.select(F.col("doc_id").alias(id_), F.col("row").alias(hash_), F.col("n").alias(n))
    staying = docs.withColumn(hash_, row).join(names.withColumnRenamed(hash_, f"{hash_}_"), (F.col(hash_) == F.col(f"{hash_}_")) & F.col(doc_id).eqNullSafe(F.col(id_))).drop(f"{hash_}_", id_)
    alone = staying.where(F.col(n) == 1)
    return alone.unionByName(staying.where(F.col(n) > 1).dropDuplicates([hash_, doc_id])).select(*(F.col(f"`{c}`") for c in docs.columns))
