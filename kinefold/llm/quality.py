"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms are the shapes of a text, not its words, so that neighbours share a kind of writing and not a
language: n-grams of character classes with runs folded, repeated words at short distances, and
coarse counts. Their weighted counts, reduced by a singular value decomposition, give each
document a vector. The vectors of a bounded sample of labelled rows (SAMPLE_ROWS of each class)
are broadcast; every document is compared with all of them by exact cosine, in blocks, and its
nearest neighbours vote with their similarity as weight. A monotone curve fitted leave-one-out on the
sample turns votes into scores, with the best threshold at 0.7.

Defined cases: a null or empty text has no terms and gets the vote of the sample as a whole; equal
texts get equal scores; labels of the same document are averaged; without training rows of both classes
every score is 0. The output is named score, with underscores behind it where docs has such a column.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinefold.llm.common import add_column, bound_batches, chunks, crc_fold, hash_sample, per_batch, ship, utf8
from kinefold.llm.toxicity import best_cut, fit_logistic

SAMPLE_ROWS = 1500
TERMS = 1024
FACTORS = 48
NEIGHBOURS = 25
THRESHOLD = 0.7
CHUNK_BYTES = 1 << 20


def _classes() -> np.ndarray:
    """A class for each byte: letters by case, digits, bytes of other scripts, and every mark its own."""
    table = np.arange(256, dtype=np.int64)
    table[ord("a") : ord("z") + 1] = ord("a")
    table[ord("A") : ord("Z") + 1] = ord("A")
    table[ord("0") : ord("9") + 1] = ord("0")
    table[128:] = ord("a")
    return table


_CLASS = _classes()
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_REPEATS = 8


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Term frequencies of texts that lie side by side, a row each."""
    n = len(offsets) - 1
    out = np.zeros((n, TERMS), np.float32)
    shapes = TERMS - 32
    for i, j in chunks(offsets, CHUNK_BYTES):
        for a in range(int(offsets[i]), max(int(offsets[j]), int(offsets[i]) + 1), 8 * CHUNK_BYTES):  # a long text in pieces
            b = min(int(offsets[j]), a + 8 * CHUNK_BYTES)
            raw = data[a:b]
            if not len(raw):
                continue
            owner = np.searchsorted(offsets[i : j + 1], np.arange(a, b), "right") - 1
            classes = _CLASS[raw]
            keep = np.ones(len(raw), bool)
            keep[1:] = (classes[1:] != classes[:-1]) | (owner[1:] != owner[:-1]) | ((classes[1:] != ord("a")) & (classes[1:] != ord("A")) & (classes[1:] != ord("0")))
            folded, whose = classes[keep], owner[keep]
            for size in (2, 3, 4):
                if len(folded) < size:
                    continue
                m = len(folded) - size + 1
                key = np.zeros(m, np.int64)
                for k in range(size):
                    key = (key * 131 + folded[k : k + m] + 7 * size) & 0xFFFFFFFF
                key = (key * 2654435761 & 0xFFFFFFFF) >> 12
                same = whose[:m] == whose[size - 1 :]
                counts = np.bincount(whose[:m][same] * shapes + key[same] % shapes, minlength=(j - i) * shapes)
                out[i:j, :shapes] += counts.reshape(j - i, shapes)
            # Words: hashes of what stands between blanks, compared with those a little before.
            word = ~_SPACE[raw]
            first = word.copy()
            first[1:] &= ~word[:-1] | (owner[1:] != owner[:-1])
            starts = np.flatnonzero(first)
            if not len(starts):
                continue
            position = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))[: len(raw)] if starts[0] == 0 else np.concatenate([np.zeros(starts[0], np.int64), np.arange(starts[0], len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))])
            value = np.where(word, (raw.astype(np.uint64) + np.uint64(1)) * (np.uint64(0x9E3779B97F4A7C15) * (2 * position.astype(np.uint64) + np.uint64(1))), np.uint64(0))
            hashes = np.add.reduceat(value, starts)
            whose = owner[starts]
            for back in range(1, _REPEATS + 1):
                if len(hashes) > back:
                    same = (hashes[back:] == hashes[:-back]) & (whose[back:] == whose[:-back])
                    out[i:j, shapes + back] += 2 * np.bincount(whose[back:][same], minlength=j - i)
            pairs = np.unique(np.stack([whose.astype(np.uint64), hashes]), axis=1)[0].astype(np.int64)
            total, distinct = np.bincount(whose, minlength=j - i), np.bincount(pairs, minlength=j - i)
            out[i:j, shapes + 20] += 4 * (total - distinct)
            out[i:j, shapes + 21] += total
    return out


def weigh(counts: np.ndarray) -> np.ndarray:
    """Square roots of relative frequencies: rows of length 1 (or 0)."""
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))


class QualityModel:
    def __init__(self, counts: np.ndarray, labels: np.ndarray, *, factors: int = FACTORS, neighbours: int = NEIGHBOURS, threshold: float = THRESHOLD) -> None:
        x = weigh(counts)
        self.mean = x.mean(axis=0)
        self.idf = np.log((1 + len(x)) / (1 + (counts > 0).sum(axis=0))) + 0.3
        x = (x - self.mean) * self.idf
        rng = np.random.default_rng(5)
        q = np.linalg.qr(x.T @ (x @ rng.standard_normal((x.shape[1], factors + 10))))[0]
        _, s, vt = np.linalg.svd(x @ q, full_matrices=False)
        self.basis = (q @ vt.T)[:, : min(factors, len(s))].astype(np.float32)
        self.labels = labels.astype(np.float32)
        self.k = min(neighbours, max(1, len(x) - 1))
        self.vectors = self._unit(x.astype(np.float32) @ self.basis)
        self.default = float(self.labels.mean())
        votes = self.vote(self.vectors, own=True)
        self.curve = fit_logistic(votes[:, None], labels.astype(float))
        self.shift = 0.0
        cut = best_cut(self.calibrate(votes), labels.astype(float))
        self.shift = math.log(threshold / (1 - threshold)) - math.log(cut / (1 - cut))

    @staticmethod
    def _unit(v: np.ndarray) -> np.ndarray:
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def vote(self, vectors: np.ndarray, own: bool = False, block: int = 512) -> np.ndarray:
        """Votes of the nearest labelled vectors, block by block; own leaves out the vector itself."""
        out = np.empty(len(vectors))
        for a in range(0, len(vectors), block):
            near = vectors[a : a + block] @ self.vectors.T
            if own:
                near[np.arange(len(near)), np.arange(a, a + len(near))] = -2
            best = np.argpartition(-near, self.k - 1, axis=1)[:, : self.k]
            weight = np.maximum(np.take_along_axis(near, best, axis=1), 1e-3) ** 4
            out[a : a + block] = (weight * self.labels[best]).sum(axis=1) / weight.sum(axis=1)
        return out

    def calibrate(self, votes: np.ndarray) -> np.ndarray:
        w, mean, scale = self.curve
        z = (votes - mean[0]) / scale[0] * w[0] + w[1] + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        counts = term_counts(data, offsets)
        x = (weigh(counts) - self.mean) * self.idf
        votes = self.vote(self._unit(x.astype(np.float32) @ self.basis))
        return self.calibrate(np.where(counts.sum(axis=1) > 0, votes, self.default))


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 4, held: int = 2, sample_rows: int = SAMPLE_ROWS) -> QualityModel | None:
    """Learn from labelled rows whose fold is not the held one: at most sample_rows of each class; only their counts reach the driver."""
    bound_batches(docs.sparkSession)
    truth = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & (crc_fold(F.col(doc_id), folds) != held)).groupBy(F.col(doc_id).alias("id")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    chosen = hash_sample(truth.where("y = 1"), "id", sample_rows).union(hash_sample(truth.where("y = 0"), "id", sample_rows))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")

    def make():
        def work(texts: pa.Array) -> pa.Array:
            return pa.array([x.astype(np.float32).tobytes() for x in term_counts(*utf8(texts))], pa.binary())

        return work

    got = {r.id: r for r in rows.select("id", "y", per_batch(make, T.BinaryType())(F.col("text")).alias("x")).collect()}
    got = [got[k] for k in sorted(got)]
    if len({r.y for r in got}) < 2:
        return None
    return QualityModel(np.stack([np.frombuffer(r.x, np.float32) for r in got]), np.array([r.y for r in got]))


def score_quality(docs: DataFrame, model: QualityModel | None, *, text: str = "text", out: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 of each whole text."""
    bound_batches(docs.sparkSession)
    get = ship(docs.sparkSession, model)

    def make():
        own = get()

        def work(texts: pa.Array) -> pa.Array:
            return pa.array(own.score(*utf8(texts)) if own else np.zeros(len(texts)), pa.float64())

        return work

    return add_column(docs, out, per_batch(make, T.DoubleType())(F.col(text)))
