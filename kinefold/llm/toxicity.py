"""Toxicity by compression distance.

Two zstandard dictionaries: one of ordinary text (its frequent words, and the words that begin like
toxic ones), one with the beginnings of words, and whole words, that toxic training texts hold far more often
than ordinary ones, behind the same ordinary text. Every window of words of a document is compressed
with both; the bytes that the toxic dictionary saves are the window's gain. A logistic curve over a
document's gains makes the score, shifted so that its best threshold is 0.7.

Before compression each of a word's first bytes is written as a code of all bytes up to it, so that
a beginning is matched by that beginning alone, not by syllables inside other words.

Both dictionaries are chosen by document frequencies that Spark counts over a bounded sample of
labelled rows (SAMPLE_ROWS toxic ones, twice as many others): zstandard's own trainer keeps what is common, and what
is common in toxic text is common in ordinary text too. A text with one label is one row, and a fragment
counts once for each group of near copies (op8's components of the sample) and label. The curve is fitted
on gains from dictionaries that were chosen without the row's own fold of groups.

Defined cases: a null, empty or wordless text has no gain and gets the score of that; equal texts
get equal scores; labels of the same document are averaged and ties are toxic; without training
rows of both classes every score is 0. The output is named score, with underscores behind it where docs has such a column.
"""

from __future__ import annotations

import math
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinefold.llm.common import add_column, bound_batches, crc_fold, hash_sample, materialize, per_batch, per_batches, ship
from kinefold.llm.simhash import near_duplicates

SAMPLE_ROWS = 3000
WINDOW_WORDS = 6
FRAGMENTS, FREQUENT, ALIKE = 400, 1500, 3000
#: A fragment's least share of the toxic groups (and least number), and how much oftener it must be there.
LEAST_SHARE, LEAST_GROUPS, RATIO = 0.015, 4, 12
FOLDS = 3
THRESHOLD = 0.7
#: Bytes of a word that are coded, lengths of beginnings that may be fragments, and what a window must gain to count.
HEAD, BEGINNINGS, GAIN = 6, (4, 5, 6), 5
_WORD = re.compile(r"\w+")
#: Both dictionaries end with this, and so does every window: zstandard takes no match in a block's last bytes, and stores blocks that hardly shrink as they are.
_TAIL = bytes(range(128, 192))


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def fragments_of(text: str | None) -> dict[str, bool]:
    """Whole words (with a blank behind) and beginnings of longer words, and whether the text has several such words."""
    out: dict[str, bool] = {}
    for w in words(text):
        for g in (w + " ", *(w[:n] for n in BEGINNINGS if len(w) > n)):
            out[g] = g in out
    return out


class _Codes(dict):
    """Words as they are compressed, with the blank before them; remembered up to a bound."""

    def __missing__(self, word: str) -> bytes:
        if len(self) > 200_000:
            self.clear()
        raw, so_far, out = word.encode("utf-8", "surrogatepass"), 0, b" "
        for k in range(min(HEAD, len(raw))):
            so_far = crc32(raw[k : k + 1], so_far)
            out += (so_far & 0xFFFF).to_bytes(2, "little")
        out = self[word] = out + raw[HEAD:]
        return out


class Compressors:
    """The two dictionaries, ready to measure windows."""

    def __init__(self, ordinary: list[str], toxic: list[str], window_words: int = WINDOW_WORDS) -> None:
        self.window_words = window_words
        self.ordinary, self.toxic = ordinary, toxic
        self.pair = None

    def _open(self) -> tuple:
        import zstandard as zs

        self.codes = _Codes()
        plain, toxic = (b"".join(self.codes[w] for w in own) + b" " for own in (self.ordinary, self.toxic))
        made = []
        for raw in (plain, plain + toxic):
            content = zs.ZstdCompressionDict(raw + _TAIL, dict_type=zs.DICT_TYPE_RAWCONTENT)
            params = zs.ZstdCompressionParameters(compression_level=3, strategy=zs.STRATEGY_GREEDY, min_match=5, window_log=18, hash_log=16, chain_log=16, search_log=6, write_content_size=0, write_checksum=0, write_dict_id=0)
            made.append(zs.ZstdCompressor(dict_data=content, compression_params=params).compress)
        return tuple(made)

    def gains(self, text: str | None) -> np.ndarray:
        """Bytes that the toxic dictionary saves in each window of the whole text."""
        self.pair = self.pair or self._open()
        plain, toxic = self.pair
        own, n, code = words(text), self.window_words, self.codes.__getitem__
        out = []
        for k in range(0, len(own), n):
            window = b"".join(map(code, own[k : k + n])) + b" " + _TAIL
            out.append(len(plain(window)) - len(toxic(window)))
        return np.array(out, float)

    def features(self, text: str | None) -> list[float]:
        g = self.gains(text)
        if not len(g):
            return [0.0] * 6
        top, n = np.sort(g)[::-1], int((g >= GAIN).sum())
        return [float(top[0]), float(max(0.0, top[0] - 4) ** 2) / 4, float(top[2]) if len(top) > 2 else 0.0, math.log1p(n), math.sqrt(n / len(g)), float(g.mean())]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton's method on rows of some weights; returns coefficients (bias last), means and scales."""
    share = np.full(len(x), 1.0) if weights is None else weights * (len(x) / weights.sum())
    mean = np.average(x, axis=0, weights=share)
    scale = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=share)) + 1e-6
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -50, 50)))
        step = np.linalg.solve((z * (share * p * (1 - p))[:, None]).T @ z + ridge * len(x) / 100 * np.eye(len(w)), z.T @ (share * (p - y)) + ridge * len(x) / 100 * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w, mean, scale


def best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The probability that splits the classes with the fewest errors; of a range, its middle."""
    order = np.argsort(p)
    p, y = p[order], y[order]
    errors = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])
    edges = np.concatenate([[p[0] / 2], (p[1:] + p[:-1]) / 2, [(1 + p[-1]) / 2]])
    errors[1:-1][p[1:] == p[:-1]] = len(p) + 1
    return float(np.clip(np.median(edges[errors == errors.min()]), 1e-4, 1 - 1e-4))


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


class ToxicityModel:
    def __init__(self, compressors: Compressors, x: np.ndarray, y: np.ndarray, threshold: float = THRESHOLD) -> None:
        self.compressors = compressors
        self.weights, self.mean, self.scale = fit_logistic(x, y)
        self.shift = 0.0
        self.shift = _logit(threshold) - _logit(best_cut(np.array([self._score(r) for r in x]), y))

    def _score(self, features: list[float]) -> float:
        z = (np.asarray(features) - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1] + self.shift
        return float(1 / (1 + math.exp(-min(50.0, max(-50.0, z)))))

    def score(self, text: str | None) -> float:
        return self._score(self.compressors.features(text))


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 3, held: int = 1, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel | None:
    """Learn from labelled rows whose fold is not the held one: at most sample_rows toxic rows and twice as many others."""
    spark = docs.sparkSession
    truth = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & (crc_fold(F.col(doc_id), folds) != held)).groupBy(F.col(doc_id).alias("id")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    chosen = hash_sample(truth.where("y = 1"), "id", sample_rows).union(hash_sample(truth.where("y = 0"), "id", 2 * sample_rows))
    # Copies would lend their words a weight that many documents should have: words are counted by groups of near copies, and no text is left out.
    sampled = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id").withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))
    first = sampled.groupBy("key", "y").agg(F.min("id").alias("id"))
    texts = materialize(sampled.join(first, ["key", "y", "id"], "left_semi").dropDuplicates(["key", "y"]), "toxicity_texts")
    groups = near_duplicates(texts.dropDuplicates(["key"]), doc_id="key").select(F.col("doc_id").alias("key"), F.col("component_id").alias("group"))
    rows = materialize(texts.join(groups, "key").withColumn("fold", F.pmod(F.xxhash64(F.lit(3), "group"), F.lit(FOLDS)).cast("int")), "toxicity_sample")
    n = {(r.y, r.fold): r.n for r in rows.groupBy("y", "fold").agg(F.countDistinct("group").alias("n")).collect()}
    if len({y for y, _ in n}) < 2:
        return None

    candidates = _candidates(rows, n)
    heads = sorted({c.gram.strip()[:3] for c in candidates})
    counts = materialize(_seen(rows.where("y = 0"), None).where(F.endswith("gram", F.lit(" "))).groupBy(F.rtrim("gram").alias("word")).agg(F.count(F.lit(1)).alias("b")), "ordinary_words")
    frequent = [r.word for r in counts.orderBy(F.desc("b"), "word").limit(2 * FREQUENT).collect()]
    alike = [r.word for r in counts.where(F.substring("word", 1, 3).isin(heads)).orderBy(F.desc("b"), "word").limit(2 * ALIKE).collect()]
    # One pair of dictionaries without each fold, and the last from all.
    pairs = [_compressors(candidates, n, [k for k in range(FOLDS) if k != skip], frequent, alike) for skip in (*range(FOLDS), None)]
    get = ship(spark, pairs[:-1])

    def make_features():
        own = get()

        def work(texts: pa.Array, folds: pa.Array) -> pa.Array:
            return pa.array([own[k].features(x) for x, k in zip(texts.to_pylist(), folds.to_pylist(), strict=True)], pa.list_(pa.float64()))

        return work

    fitted = rows.select("key", "y", per_batches(make_features, T.ArrayType(T.DoubleType()))(F.col("text"), F.col("fold")).alias("x")).collect()
    fitted.sort(key=lambda r: (r.key, r.y))
    return ToxicityModel(pairs[-1], np.array([r.x for r in fitted]), np.array([r.y for r in fitted], float))


def _seen(rows: DataFrame, grams: list[str] | None) -> DataFrame:
    """(gram, y, fold, group, many): each group's fragments once, those of a list or all."""
    get = ship(rows.sparkSession, None if grams is None else frozenset(grams))

    def make():
        wanted = get()

        def work(texts: pa.Array) -> pa.Array:
            return pa.array([[{"gram": g, "many": m} for g, m in fragments_of(x).items() if wanted is None or g in wanted] for x in texts.to_pylist()], pa.list_(pa.struct([("gram", pa.string()), ("many", pa.bool_())])))

        return work

    kind = T.ArrayType(T.StructType([T.StructField("gram", T.StringType()), T.StructField("many", T.BooleanType())]))
    each = rows.select("y", "fold", "group", F.explode(per_batch(make, kind)(F.col("text"))).alias("g")).select("y", "fold", "group", "g.*")
    return each.groupBy("gram", "y", "fold", "group").agg(F.max("many").alias("many"))


def _candidates(rows: DataFrame, n: dict[tuple[int, int], int]) -> list:
    """Per gram and fold the groups of either class that hold it once and several times, for grams of enough toxic groups; as many as the sample's bound allows."""
    least = max(LEAST_GROUPS, LEAST_SHARE * min(sum(v for (y, k), v in n.items() if y == 1 and k != skip) for skip in range(FOLDS)))
    toxic = materialize(_seen(rows.where("y = 1"), None).groupBy("gram", "fold").agg(F.count(F.lit(1)).alias("once"), F.count_if("many").alias("many")), "toxic_grams")
    often = toxic.groupBy("gram").agg(F.sum("once").alias("once")).where(F.col("once") >= least)
    grams = sorted(r.gram for r in often.collect() if len(r.gram.strip()) > 3)
    found = toxic.join(F.broadcast(often.select("gram")), "gram").select("gram", F.lit(1).alias("y"), "fold", "once", "many")
    other = _seen(rows.where("y = 0"), grams).groupBy("gram", "fold").agg(F.count(F.lit(1)).alias("once"), F.count_if("many").alias("many"))
    return found.union(other.select("gram", F.lit(0).alias("y"), "fold", "once", "many")).where(F.length(F.trim("gram")) > 3).collect()


def _compressors(candidates: list, n: dict[tuple[int, int], int], folds: list[int], frequent: list[str], alike: list[str]) -> Compressors:
    """Dictionaries from the counts of some folds."""
    totals = [max(1, sum(n.get((y, k), 0) for k in folds)) for y in (0, 1)]
    sums: dict[str, np.ndarray] = {}
    for r in candidates:
        if r.fold in folds:
            sums.setdefault(r.gram, np.zeros((2, 2)))[r.y] += (r.once, r.many)
    ranked = []
    for gram, own in sums.items():
        best = 0.0
        for ordinary, toxic in own.T:
            ratio = toxic / totals[1] / ((ordinary + 0.5) / totals[0])
            if toxic >= max(LEAST_GROUPS, LEAST_SHARE * totals[1]) and ratio > RATIO:
                best = max(best, toxic * math.log(ratio))
        if best:
            ranked.append((-best, -len(gram), gram))
    chosen: list[str] = []
    for *_, gram in sorted(ranked):  # of equals the longest: a longer match gains more
        if len(chosen) < FRAGMENTS and not any(gram.startswith(x) or x.startswith(gram) for x in chosen):
            chosen.append(gram)
    begins = tuple(chosen)
    plain = [[w for w in own if not f"{w} ".startswith(begins)][:most] for own, most in ((frequent, FREQUENT), (alike, ALIKE))]
    return Compressors(plain[0][::-1] + plain[1][::-1], [x.strip() for x in chosen[::-1]])


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, *, text: str = "text", out: str = "score") -> DataFrame:
    """docs with a score from 0 to 1; every window of every text counts."""
    bound_batches(docs.sparkSession)
    get = ship(docs.sparkSession, model)

    def make():
        own = get()

        def work(texts: pa.Array) -> pa.Array:
            known: dict[str | None, float] = {}
            for x in (rows := texts.to_pylist()):
                if x not in known:
                    known[x] = own.score(x) if own else 0.0
            return pa.array([known[x] for x in rows], pa.float64())

        return work

    return add_column(docs, out, per_batch(make, T.DoubleType())(F.col(text)))
