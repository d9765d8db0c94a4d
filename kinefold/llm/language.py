"""Language identification with a byte convolutional network.

Text is folded to byte classes and cut into fixed windows that overlap by the widest filter less one,
so that no n-gram is lost. Filters of several widths slide over each window, their largest responses feed a softmax,
and a document's answer is the windows' mean, weighted by their letters. The network is trained with
numpy on the driver, on windows of a bounded sample: SAMPLE_DOCS of each language, WINDOWS_A_DOC of each document. Every
language is learned; beyond SAMPLE_LANGUAGES of them each gives fewer documents, LEAST_DOCS at least.

Defined cases: a null text, or one without letters, is `und` with score 0; equal texts get equal
answers (scores are rounded to four places); without training rows every answer is `und`. Texts are read in
runs of windows, so that a very long one needs no more memory than its bytes. The output is named language, with
underscores behind it where docs has such a column.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinefold.llm.common import add_column, bound_batches, crc_fold, per_batch, ship

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
SAMPLE_DOCS = 400
WINDOWS_A_DOC = 4
#: Languages that give SAMPLE_DOCS each; more of them share as many documents in all.
SAMPLE_LANGUAGES = 64
#: Few enough for many languages, and too many for a draw to miss a language.
LEAST_DOCS = 40
#: Windows that go through the filters at once.
BLOCK = 512
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_STEP = WINDOW - max(WIDTHS) + 1


def _classes() -> np.ndarray:
    """0 pads; letters without case; digits; other ASCII; and each byte of longer characters."""
    table = np.full(256, 28, np.uint8)
    for k in range(26):
        table[ord("a") + k] = table[ord("A") + k] = k + 1
    table[ord("0") : ord("9") + 1] = 27
    table[128:192] = 29 + np.arange(64)
    table[192:] = 93 + np.arange(64)
    return table


_CLASS = _classes()
CLASSES = int(_CLASS.max()) + 1


def windows_of(text: str) -> np.ndarray:
    """The whole text as rows of byte classes."""
    codes = _CLASS[np.frombuffer(text.encode(), np.uint8)]
    n = max(1, -(-max(len(codes) - WINDOW, 0) // _STEP) + 1)
    padded = np.zeros((n - 1) * _STEP + WINDOW, np.uint8)
    padded[: len(codes)] = codes
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::_STEP]


class ByteNetwork:
    def __init__(self, languages: list[str], seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.filters = [(rng.standard_normal((w, CLASSES, FILTERS)) * 0.3).astype(np.float32) for w in WIDTHS]
        for f in self.filters:
            f[:, 0] = 0
        self.out = (rng.standard_normal((FILTERS * len(WIDTHS) + 1, len(languages))) * 0.1).astype(np.float32)
        self.tables = None

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.02, seed: int = 4) -> None:
        """Adam on the cross-entropy; a filter learns where its response was largest."""
        rng = np.random.default_rng(seed)
        weights = [*self.filters, self.out]
        m, v, t = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        share = np.bincount(y, minlength=len(self.languages))
        balance = (len(y) / len(self.languages) / np.maximum(share, 1)).astype(np.float32)
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for k in range(0, len(order), batch):
                rows = order[k : k + batch]
                own, n = x[rows], len(rows)
                pooled, where = [], []
                for w, f in zip(WIDTHS, self.filters, strict=True):
                    z = sum(f[j][own[:, j : WINDOW - w + 1 + j]] for j in range(w))
                    best = z.argmax(axis=1)
                    where.append(best)
                    pooled.append(np.take_along_axis(z, best[:, None], axis=1)[:, 0])
                h = np.maximum(np.concatenate(pooled, axis=1), 0)
                h1 = np.hstack([h, np.ones((n, 1), np.float32)])
                d = self._softmax(h1 @ self.out)
                d[np.arange(n), y[rows]] -= 1
                d *= balance[y[rows]][:, None] / n
                grads = []
                dh = (d @ self.out[:-1].T) * (h > 0)
                for q, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
                    g = np.zeros_like(f)
                    part = dh[:, q * FILTERS : (q + 1) * FILTERS]
                    for j in range(w):
                        np.add.at(g[j], (own[np.arange(n)[:, None], where[q] + j], np.arange(FILTERS)[None]), part)
                    g[:, 0] = 0
                    grads.append(g)
                grads.append(h1.T @ d)
                t += 1
                step = rate * (1 - epoch / epochs)
                for i, (weight, g) in enumerate(zip(weights, grads, strict=True)):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    weight -= step * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        self.tables = None

    def _pair_tables(self) -> list[list[np.ndarray]]:
        """Responses to each pair of classes, so that a filter is two look-ups at most."""
        out = []
        for f in self.filters:
            pairs = [(f[j][:, None] + f[j + 1][None]).reshape(-1, FILTERS) for j in range(0, len(f) - 1, 2)]
            out.append(pairs + ([f[-1]] if len(f) % 2 else []))
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of each window."""
        self.tables = self.tables or self._pair_tables()
        out = []
        for k in range(0, len(x), BLOCK):
            own = x[k : k + BLOCK].astype(np.int32)
            pairs = own[:, :-1] * CLASSES + own[:, 1:]
            pooled = []
            for w, tables in zip(WIDTHS, self.tables, strict=True):
                size = WINDOW - w + 1
                z = tables[0][pairs[:, :size]]
                for j, table in enumerate(tables[1:], 1):
                    z += table[(pairs if len(table) > CLASSES else own)[:, 2 * j : 2 * j + size]]
                pooled.append(z.max(axis=1))
            h = np.maximum(np.concatenate(pooled, axis=1), 0)
            out.append(self._softmax(h @ self.out[:-1] + self.out[-1]))
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)))

    def answer(self, texts: list[str | None]) -> list[tuple[str, float]]:
        sums, weights = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        rows: list[np.ndarray] = []
        owners: list[np.ndarray] = []

        def flush() -> None:
            if rows:
                stacked, owner = np.concatenate(rows), np.concatenate(owners)
                letters = ((stacked > 0) & (stacked != 27) & (stacked != 28)).sum(axis=1) + 1e-3
                np.add.at(sums, owner, self.predict(stacked) * letters[:, None])
                np.add.at(weights, owner, letters)
                rows.clear()
                owners.clear()

        held = 0
        for k, x in enumerate(texts):
            if x and _LETTER.search(x):
                own = windows_of(x)
                for a in range(0, len(own), 4 * BLOCK):
                    rows.append(own[a : a + 4 * BLOCK])
                    owners.append(np.full(len(rows[-1]), k))
                    held += len(rows[-1])
                    if held >= 4 * BLOCK:
                        flush()
                        held = 0
        flush()
        best = sums.argmax(axis=1)
        top = sums[np.arange(len(texts)), best] / np.maximum(weights, 1e-9)
        return [(self.languages[b], min(1.0, round(float(p), 4))) if w else (UNKNOWN, 0.0) for b, p, w in zip(best.tolist(), top, weights, strict=True)]


def train(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 4, held: int = 2) -> ByteNetwork | None:
    """Learn from rows with a language whose fold is not the held one."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text")).where(F.col("lang").isNotNull() & (F.coalesce(crc_fold(F.col("id"), folds), F.lit(0)) != held))
    counts = rows.groupBy("lang").count().orderBy("lang").collect()
    if not counts:
        return None
    docs_each = min(SAMPLE_DOCS, max(LEAST_DOCS, SAMPLE_DOCS * SAMPLE_LANGUAGES // len(counts)))
    keep = spark.createDataFrame([(r.lang, min(1.0, docs_each / r["count"])) for r in counts], "lang string, share double")
    draw = F.pmod(F.xxhash64(F.lit(11), "id", F.length("text")), F.lit(1_000_003)) / 1_000_003
    chosen = rows.join(F.broadcast(keep), "lang").where(draw < F.col("share"))

    def make():
        def work(texts: pa.Array) -> pa.Array:
            out = []
            for x in texts.to_pylist():
                own = windows_of(x) if x and _LETTER.search(x) else np.zeros((0, WINDOW), np.uint8)
                at = np.unique(np.linspace(0, len(own) - 1, WINDOWS_A_DOC).astype(int)) if len(own) else []
                out.append([own[k].tobytes() for k in at])
            return pa.array(out, pa.list_(pa.binary()))

        return work

    drawn = chosen.select("lang", F.explode(per_batch(make, T.ArrayType(T.BinaryType()))(F.col("text"))).alias("w")).collect()
    drawn.sort(key=lambda r: (r.lang, bytes(r.w)))
    languages = sorted({r.lang for r in drawn})
    if not languages:
        return None
    model = ByteNetwork(languages)
    number = {x: k for k, x in enumerate(languages)}
    model.train(np.stack([np.frombuffer(r.w, np.uint8) for r in drawn]).astype(np.int32), np.array([number[r.lang] for r in drawn]))
    return model


_ANSWER = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
_ANSWER_ARROW = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])


def identify(docs: DataFrame, model: ByteNetwork | None, *, text: str = "text", out: str = "language") -> DataFrame:
    """docs with a struct column: lang_pred and score of each whole text."""
    bound_batches(docs.sparkSession)
    get = ship(docs.sparkSession, model)

    def make():
        own = get()

        def work(texts: pa.Array) -> pa.Array:
            rows = texts.to_pylist()
            found = own.answer(rows) if own else [(UNKNOWN, 0.0)] * len(rows)
            return pa.array([{"lang_pred": a, "score": p} for a, p in found], _ANSWER_ARROW)

        return work

    return add_column(docs, out, per_batch(make, _ANSWER)(F.col(text)))
