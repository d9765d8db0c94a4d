"""Fill-in-the-middle against the contract's words, and back."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from kinefold.llm import infill
from kinefold.llm import queries as q

DATA = "/root/testdata/sf0.001"


def plainly(doc_id, text, fim=100):
    """The output of one document, from the rule's words."""
    text = text or ""
    h = hashlib.sha256(f"7:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= fim:
        return n, "plain", None, None, text
    if h4 % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    text = lambda: "".join(rng.choice(["a", "é", "日", "\n", "\n", " ", "😀", "\r"]) for _ in range(rng.randint(0, 60)))
    rows = [(k, text()) for k in range(300)]
    rows += [(400, None), (401, ""), (402, "x<P>y"), (403, "a\n<M>"), (404, "<S>"), (405, "no line end"), (406, "\n"), (407, "\n\n\n"), (408, "< P>\n<p>\n"), (None, "no id\nat all\n"), (5, "again\nthe same id\n"), (5, "again\nthe same id\n"), (409, "long lines é\n" * 40_000), (410, "é" * 300_000)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"part": F.lit("clash"), "piece": F.lit(1), "key": F.lit(2)})


@pytest.mark.parametrize("piece_bytes", [4, 100, 64 << 10])
def test_digests(docs, piece_bytes):
    want = sorted(((r.doc_id, *(x := plainly(r.doc_id, r.text))[:4], sha(x[4]), sha(r.text or "")) for r in docs.collect()), key=str)
    small = docs if piece_bytes > 50 else docs.where("doc_id is null or doc_id < 409")
    got = infill.digests(small, piece_bytes=piece_bytes)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == [w for w in want if small is docs or w[0] is None or w[0] < 409]


@pytest.mark.parametrize("share", [100, 30])
def test_outputs_and_back(docs, share):
    own = infill.fill_in_middle(docs, fim_percent=share)
    got = sorted(map(tuple, own.collect()), key=str)
    assert got == sorted(((r.doc_id, *plainly(r.doc_id, r.text, share)) for r in docs.collect()), key=str)
    assert {"plain", "psm", "spm"} == {r[2] for r in got}
    back = sorted(map(tuple, infill.restore(own).collect()), key=str)
    assert back == sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=str)


def test_one_shuffle_and_no_rows(docs):
    plan = infill.digests(docs)._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("Exchange") == 1
    assert infill.digests(docs.where("false")).count() == infill.fill_in_middle(docs.where("false")).count() == 0


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in q.op13_fill_in_middle(spark, DATA).collect()}
    assert got == {d: (*(x := plainly(d, t))[:4], sha(x[4]), sha(t or "")) for d, t in texts.items()}


def test_odd_rows(odd, nothing):
    assert infill.digests(odd).count() == 10 and infill.digests(nothing).count() == 0
