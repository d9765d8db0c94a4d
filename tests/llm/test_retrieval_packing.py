"""Packing by retrieval against a plain BM25 over word lists, and the contract's invariants."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinefold.llm import queries as q
from kinefold.llm import retrieval_packing as rp
from kinefold.llm.encoding import ChunkEncoder, vocabulary_path

DATA = "/root/testdata/sf0.001"
TOKENIZER = vocabulary_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    return ChunkEncoder(TOKENIZER, chunks=40)


ODD = ["", " ", "a\n\nb", "Ab\tCd\u3000E", "x\x1cy \x85z", "it's WE'LL", "<|endoftext|> hi<|startoftext|>", "e\u0301 \u0301x", "日本語 テスト", "İstanbul ΣΑΣ", "a" * 300, "1234 5,6", "a..b", ". .,", "a,.b c.", "x\x01y.", ",a", "a ,b", "a\n.b", "e\u0301,b", "\u0301.", None]


def test_encoder(encoder, library):
    assert [x.tolist() for x in encoder.encode(ODD)] == [library(x) for x in ODD]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abEİ é\u0301,.'s\n\t1!日 \x1cΣß", max_size=12), max_size=4))
def test_encoder_equals_the_library(encoder, library, texts):
    assert [x.tolist() for x in encoder.encode(texts)] == [library(x) for x in texts]


def plainly(docs, capacity):
    """The order of packing by plain loops over all documents: [(doc, start, length, sequence, offset)]."""
    n, bags = len(docs), [Counter(x[:-1]) for x in docs]
    df = Counter(t for bag in bags for t in bag)
    mean = max(1, sum(len(x) - 1 for x in docs) / n)
    gain = lambda t, d: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * bags[d][t] * (rp.K1 + 1) / (bags[d][t] + rp.K1 * (1 - rp.B + rp.B * (len(docs[d]) - 1) / mean)) if t in bags[d] else 0.0
    top = lambda d, m: sorted(bags[d], key=lambda t: (-gain(t, d), t))[:m]
    line = sorted(range(n), key=lambda d: [x for x in top(d, 2)] + [-1] * (2 - len(top(d, 2))))
    left, out, sequence, offset, doc, start, queue = list(line), [], 0, 0, None, 0, []

    def near(d):
        question = top(d, rp.QUERY_TERMS)
        scored = [(round(sum(gain(t, o) for t in question), 9), -line.index(o), o) for o in left]
        return [o for s, _, o in sorted(scored, reverse=True) if s > 0]

    while doc is not None or left:
        if doc is None:
            queue = [o for o in queue if o in left]
            if queue:
                doc = queue.pop(0)
                left.remove(doc)
            else:
                doc = left.pop(0)
                queue = near(doc)
        took = min(len(docs[doc]) - start, capacity - offset)
        out.append((doc, start, took, sequence, offset))
        start, offset = start + took, offset + took
        whole = start == len(docs[doc])
        if offset == capacity:
            sequence, offset = sequence + 1, 0
            queue = [] if whole else near(doc) if len(docs[doc]) - start < capacity else queue
        if whole:
            doc, start = None, 0
    return out


@pytest.mark.parametrize("capacity", [16, 64])
def test_same_packing_as_plain_loops(spark, library, capacity):
    rng = random.Random(capacity)
    topics = [["river", "boat", "fish", "water"], ["engine", "wheel", "road", "driver"], ["bread", "oven", "flour"]]
    rows = [(k, " ".join(rng.choice(rng.choice(topics[k % 3 :]) if rng.random() < 0.2 else topics[k % 3]) for _ in range(rng.randint(0, 20)))) for k in range(60)]
    rows += [(60, "boat " * 150), (61, None), (62, ""), (63, rows[5][1]), (64, rows[5][1])]
    docs = [[*library(t), 2] for _, t in rows]
    got = rp.pack_related(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), capacity=capacity).collect()
    assert [(r.doc_id, r.start, r.length, r.sequence_id, r.offset) for r in got] == plainly(docs, capacity)


def check(rows, want, capacity, ends):
    """want: doc -> ids. Every id lies in one piece, sequences have no gaps, and at most so many are not full."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by_doc) == set(want)
    for d, pieces in by_doc.items():
        ids, at = np.array(want[d], "<u4"), 0
        for start, n, crc, whole in sorted(pieces):
            assert start == at and n > 0 and whole == len(ids) and crc == zlib.crc32(ids[start : start + n].tobytes())
            at += n
        assert at == len(ids)
    short = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        short += at < capacity
        assert at <= capacity
    assert short <= ends


def test_ranges_and_shards(spark, library):
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice("ab cd ef gh ij kl mn op qr".split()) for _ in range(rng.randint(0, 30)))) for k in range(400)] + [(k, "the same words again and again") for k in range(400, 700)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = rp.pack_related(df, capacity=32, range_ids=2000, shard_ids=500, shard_docs=40).collect()
    check(got, {d: [*library(t), 2] for d, t in rows}, 32, -(-sum(len(library(t)) + 1 for _, t in rows) // 2000))
    of_copies = Counter(r.sequence_id >> 40 for r in got if r.doc_id >= 400)
    assert len(of_copies) > 1 and max(of_copies.values()) < 300


def test_query(spark, library):
    docs = {r.doc_id: [*library(r.text), 2] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = q.op12_retrieval_packing(spark, DATA)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    check(got.collect(), docs, 4096, 1)


def test_neighbours_share_windows(spark):
    """Windows hold texts of one language far more often than chance."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    own = rp.pack_related(docs, capacity=2048).join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null")
    share = own.groupBy("sequence_id", "lang").agg(F.sum("length").alias("n")).groupBy("sequence_id").agg(F.max("n").alias("most"), F.sum("n").alias("all")).agg(F.sum("most") / F.sum("all")).first()[0]
    assert share > 0.8


def test_odd_rows(odd, nothing):
    assert rp.pack_related(odd).where("start = 0").count() == 10 and rp.pack_related(nothing).count() == 0
