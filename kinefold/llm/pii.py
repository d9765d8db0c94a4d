"""Personal data by weak supervision.

Fixed patterns find emails, addresses, cards and phones; these spans always stay. Wider patterns
propose more spans. On every proposal five labelers vote for, against or not at all: the strict
pattern, a check of the digits or parts, a gazetteer, the words before it, and its neighbours.
Spark counts the patterns of the whole corpus: kind, votes, length and number of digits (both capped
as features at LONGEST, so that there is a bounded number of patterns at any size). Expectation-maximisation on
that table estimates how reliable each labeler is, and a logistic classifier over all patterns, weighted by their
counts and trained on the estimated truth, decides which proposals become spans.

Defined cases: a null or empty text has no spans; equal texts have equal spans; a proposal that
overlaps a fixed span, or one accepted before it, is dropped; with no proposals nothing is learned
and only fixed spans remain. Columns named like the output are kept, and the output gets another underscore.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinefold.llm.common import add_column, bound_batches, materialize, per_batch, ship
from kinefold.llm.toxicity import fit_logistic

#: Kinds in the order of a span list; the last is only proposed.
KINDS = ("email", "ip", "card", "phone", "secret")
#: Length and digits from which a span is simply long.
LONGEST = 64
LABELERS = ("pattern", "checksum", "gazetteer", "context", "neighbours")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# No digit before: a match that began inside a run of digits would have begun at its start.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
# A run with fewer than 14 digits fails from each of its digits, and matches are maximal.
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){13,}+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_WIDER = (
    (0, re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\[dot\]|\(dot\)| dot ) ?[A-Za-z0-9-]{2,24}){1,3}", re.I)),
    (1, re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
    (2, re.compile(r"(?<![0-9])[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9])")),
    (3, re.compile(r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")),
    (3, re.compile(r"(?<![0-9+])00[1-9](?:[ ().-]?[0-9]){8,13}(?![0-9])")),
    (4, re.compile(r"(?:token|secret|passwd|password|api[_-]?key|key)\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9+/_-]{16,}+)", re.I)),
)
# Words before a span that speak for its kind.
_WORDS = {
    0: ("mail", "email", "e-mail", "contact", "write", "correo", "courriel"),
    1: ("ip", "host", "server", "address", "adresse"),
    2: ("card", "visa", "mastercard", "credit", "karte", "tarjeta", "carte"),
    3: ("phone", "tel", "call", "fax", "mobile", "telefon", "telefono", "cell"),
    4: ("token", "secret", "password", "key", "passwd"),
}
# Endings of host names, and leading digits of cards.
_ENDINGS = frozenset("com org net edu gov io de fr es uk eu info".split())
_ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65")
_NEAR = 40


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d)
        if k % 2:
            x = 2 * x - 9 * (x > 4)
        total += x
    return total % 10 == 0


def _digits(span: str) -> str:
    return "".join(c for c in span if c in "0123456789")


def fixed_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns: leftmost, non-overlapping for each kind, in order of kinds."""
    out = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            out.append((0, start, end))
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p) <= 3 or not p[:-3].strip("0") for p in m[0].split(".")) and all(int(p[-3:]) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m[0])) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def _votes(text: str, kind: int, start: int, end: int, fixed: bool) -> list[int]:
    span, digits = text[start:end], _digits(text[start:end])
    before = text[max(0, start - _NEAR) : start].lower()
    after = text[end : end + 1]
    if kind == 2:
        check = 1 if luhn(digits) else -1
    elif kind == 3:
        check = 1 if 10 <= len(digits) <= 15 and len(set(digits)) > 3 else -1
    elif kind == 4:
        check = 1 if len(set(span)) >= 8 and digits and len(digits) < len(span) else -1
    else:
        check = 1 if kind == 0 or ":" in span or span.count(".") == 3 else -1
    if kind == 0:
        book = 1 if re.split(r"[^a-z0-9]+", span.lower())[-1] in _ENDINGS else 0
    elif kind == 2:
        book = 1 if digits.startswith(_ISSUERS) else -1
    else:
        book = 0
    near = set(re.findall(r"[\w-]+", before))
    context = 1 if any(w in near for w in _WORDS[kind]) else 0
    edge = -1 if (text[start - 1 : start].isalnum() or after.isalnum()) else 1 if kind < 4 else 0
    return [1 if fixed else 0, check, book, context, edge]


def proposals(text: str | None) -> list[dict]:
    """Fixed spans and wider ones, each with its votes, in order of start and kind."""
    if not text:
        return []
    base = fixed_spans(text)
    taken = sorted((s, e) for _, s, e in base)
    starts, furthest = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))

    def free(s: int, e: int) -> bool:
        k = bisect_left(starts, e)
        return k == 0 or furthest[k - 1] <= s

    found = [(k, s, e, True) for k, s, e in base]
    for kind, pattern in _WIDER:
        for m in pattern.finditer(text):
            s, e = m.span(1) if kind == 4 else m.span()
            if free(s, e):
                found.append((kind, s, e, False))
    found.sort(key=lambda x: (x[1], x[0], x[2]))
    return [{"kind": k, "start": s, "end": e, "fixed": f, "votes": _votes(text, k, s, e, f), "digits": len(_digits(text[s:e]))} for k, s, e, f in found]


_PROPOSAL = T.ArrayType(T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("fixed", T.BooleanType()), T.StructField("votes", T.ArrayType(T.IntegerType())), T.StructField("digits", T.IntegerType())]))
_PROPOSAL_ARROW = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("fixed", pa.bool_()), ("votes", pa.list_(pa.int32())), ("digits", pa.int32())]))


def propose(docs: DataFrame, *, text: str = "text", out: str = "proposals") -> DataFrame:
    bound_batches(docs.sparkSession)

    def make():
        def work(texts: pa.Array) -> pa.Array:
            return pa.array([proposals(x) for x in texts.to_pylist()], _PROPOSAL_ARROW)

        return work

    return add_column(docs, out, per_batch(make, _PROPOSAL)(F.col(text)))


def estimate(table: list[tuple[int, tuple[int, ...], int]], rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over (kind, votes, count): each labeler's accuracy, and each kind's share of true spans."""
    votes = np.array([v for _, v, _ in table], float)
    kinds, counts = np.array([k for k, _, _ in table]), np.array([n for _, _, n in table], float)
    accuracy, share = np.full(votes.shape[1], 0.8), np.full(len(KINDS), 0.5)
    for _ in range(rounds):
        p = posterior(votes, kinds, accuracy, share)
        agree = np.where(votes > 0, p[:, None], 1 - p[:, None]) * (votes != 0)
        accuracy = np.clip((counts @ agree + 8) / (counts @ (votes != 0) + 10), 0.55, 0.99)
        for k in range(len(KINDS)):
            own = kinds == k
            share[k] = np.clip((counts[own] @ p[own] + 1) / (counts[own].sum() + 2), 0.02, 0.98)
    return accuracy, share


def posterior(votes: np.ndarray, kinds: np.ndarray, accuracy: np.ndarray, share: np.ndarray) -> np.ndarray:
    z = votes @ np.log(accuracy / (1 - accuracy)) + np.log(share / (1 - share))[kinds]
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


class SpanModel:
    """Which proposals are spans. patterns: (kind, size, digits, votes, count)."""

    def __init__(self, patterns: list[tuple[int, int, int, tuple[int, ...], int]]) -> None:
        self.curve = None
        self.accuracy, self.share = np.full(len(LABELERS), 0.8), np.full(len(KINDS), 0.5)
        if patterns:
            votes: dict[tuple, int] = {}
            for kind, _, _, own, n in patterns:
                votes[kind, own] = votes.get((kind, own), 0) + n
            self.accuracy, self.share = estimate(sorted((k, v, n) for (k, v), n in votes.items()))
            x = np.array([self.features(kind, size, digits, own) for kind, size, digits, own, _ in patterns])
            y = posterior(np.array([p[3] for p in patterns], float), np.array([p[0] for p in patterns]), self.accuracy, self.share)
            self.curve = fit_logistic(x, y, weights=np.array([p[4] for p in patterns], float))

    @staticmethod
    def features(kind: int, size: int, digits: int, votes: tuple[int, ...]) -> list[float]:
        size, digits = min(size, LONGEST), min(digits, LONGEST)
        return [float(kind == k) for k in range(len(KINDS))] + [size / LONGEST, digits / max(size, 1)] + [float(v) for v in votes]

    def accepts(self, p: dict) -> bool:
        if p["fixed"]:
            return True
        if self.curve is None:
            return False
        w, mean, scale = self.curve
        return float((np.array(self.features(p["kind"], p["end"] - p["start"], p["digits"], p["votes"])) - mean) / scale @ w[:-1] + w[-1]) > 0

    def spans(self, found: list[dict]) -> list[tuple[int, int, int]]:
        out, end = [], -1
        for p in found:
            if self.accepts(p) and (p["fixed"] or p["start"] >= end):
                out.append((p["kind"], p["start"], p["end"]))
                end = max(end, p["end"]) if not p["fixed"] else end
        return out


def train(proposed: DataFrame, *, column: str = "proposals") -> SpanModel:
    """Learn from the patterns of all proposals: a table whose size the features bound, not the corpus."""
    each = proposed.select(F.explode(column).alias("p")).select("p.kind", F.least(F.col("p.end") - F.col("p.start"), F.lit(LONGEST)).alias("size"), F.least("p.digits", F.lit(LONGEST)).alias("digits"), "p.votes")
    counts = each.groupBy("kind", "size", "digits", "votes").count().collect()
    return SpanModel(sorted((r.kind, r.size, r.digits, tuple(r.votes), r["count"]) for r in counts))


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], x[0])))


_FOUND = T.StructType([T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:4]] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_spans", T.LongType())])
_FOUND_ARROW = pa.struct([(f"n_{k}", pa.int64()) for k in KINDS[:4]] + [("base_sha256", pa.string()), ("spans", pa.string()), ("n_spans", pa.int64())])


def find_pii(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, counts and digest of the fixed spans, and all spans as kind:start:end with their number. Texts are read once."""
    proposed = materialize(propose(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), text="text").select("doc_id", "proposals"), "proposals")
    get = ship(docs.sparkSession, train(proposed))

    def make():
        model = get()

        def work(found: pa.Array) -> pa.Array:
            rows = []
            for own in found.to_pylist():
                base = [(p["kind"], p["start"], p["end"]) for p in own if p["fixed"]]
                spans = model.spans(own)
                rows.append({f"n_{name}": sum(k == number for k, _, _ in base) for number, name in enumerate(KINDS[:4])} | {"base_sha256": hashlib.sha256(render(base).encode()).hexdigest(), "spans": render(spans), "n_spans": len(spans)})
            return pa.array(rows, _FOUND_ARROW)

        return work

    return proposed.select("doc_id", per_batch(make, _FOUND)(F.col("proposals")).alias("f")).select("doc_id", "f.*")


def redact(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """docs with every span of the text replaced by its kind in angle brackets; all rows and columns stay."""
    spark = docs.sparkSession
    get = ship(spark, train(materialize(propose(docs.select(text), text=text).select("proposals").where(F.size("proposals") > 0), "proposals")))
    bound_batches(spark)

    def make():
        model = get()

        def clean(x: str | None) -> str | None:
            spans = sorted((s, e, k) for k, s, e in model.spans(proposals(x)))
            if not spans:
                return x
            out, at = [], 0
            for s, e, k in spans:
                if s >= at:
                    out += [x[at:s], f"<{KINDS[k].upper()}>"]
                at = max(at, e)
            return "".join([*out, x[at:]])

        def work(texts: pa.Array) -> pa.Array:
            return pa.array([clean(x) for x in texts.to_pylist()], pa.string())

        return work

    return docs.withColumn(text, per_batch(make, T.StringType())(F.col(text)))
