"""Alignment of two tokenizers against both libraries on whole texts, and plain counts."""

import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinefold.llm import alignment
from kinefold.llm import queries as q
from kinefold.llm.encoding import byte_letters, vocabulary_path

DATA = "/root/testdata/sf0.001"
A, B = vocabulary_path(), vocabulary_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def whole():
    """Groups and links of a whole text by the libraries alone, or None."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    names, letters = {k: x for x, k in a.get_vocab().items()}, byte_letters()
    of_a = lambda k: bytes(letters[c] for c in names[k])
    of_b = lambda k: bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("\u2581", " ").encode()

    def run(text):
        if not text:
            return None
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        if not b"".join(map(of_a, ids_a)) == b"".join(map(of_b, ids_b)) == f" {text}".encode():
            return None
        ends = lambda ids, of: [sum(len(of(x)) for x in ids[: k + 1]) for k in range(len(ids))]
        ends_a, ends_b = (ends(ids_a, of_a), ends(ids_b, of_b)) if len(ids_a) < 500 else (fast(ids_a, of_a), fast(ids_b, of_b))
        links = [(x, y) for x, y in pairs(ids_a, ends_a, ids_b, ends_b)]
        both = sorted(set(ends_a) & set(ends_b))
        groups, before = [], 0
        at_a, at_b = dict(zip(ends_a, range(len(ends_a)), strict=True)), dict(zip(ends_b, range(len(ends_b)), strict=True))
        i = j = 0
        for end in both:
            groups.append(",".join(map(str, ids_a[i : at_a[end] + 1])) + "|" + ",".join(map(str, ids_b[j : at_b[end] + 1])))
            i, j, before = at_a[end] + 1, at_b[end] + 1, end
        return ids_a, ids_b, groups, links

    def fast(ids, of):
        out, at = [], 0
        for x in ids:
            at += len(of(x))
            out.append(at)
        return out

    def pairs(ids_a, ends_a, ids_b, ends_b):
        where = {}
        for y, e in zip(ids_b, ends_b, strict=True):
            where.setdefault(e, []).append(y)
        for x, e in zip(ids_a, ends_a, strict=True):
            for y in where.get(e, []):
                yield x, y

    return run


def plainly(rows, whole):
    """The contract's columns by plain loops over (doc_id, text)."""
    known = {t: whole(t) for _, t in rows}
    count = Counter(link for _, t in rows if known[t] for link in known[t][3])
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for d, t in rows:
        if not known[t]:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = known[t]
        out.append((d, len(a), len(b), len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


ODD = ["", None, " ", "  ", "a", " a", "a ", "a  b", "a   b ", "a \n b", "\n\n a", "a\n", "\t \tx", "<s> </s> <unk> <|endoftext|>", "日本語 テスト  です", "e\u0301 ﬁ Ａ", "x\u3000y \u00a0z", "a\x01b \x01", "\u2581 a\u2581b", "it's we'll", "😀 👩‍👩‍👧", "1234567 89", "<0x41>", "a\x00b", "\x1c x \x85 y", "..., ,,, --- ???", "a,b.c", "x².y 2.5 ².", "a\nb\n\nc", "a.\n,b", "_, a_,b a_.", "٣,٤", "\n", "a\n b", "a \nb"]


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(A, B, pieces=30)


def groups_of(aligner, text):
    told, numbers = aligner.align([text])
    return told[0] and (told[0], [list(aligner.pairs)[k] for k in numbers[0].tolist()])


def check_text(aligner, whole, text):
    got, want = groups_of(aligner, text), whole(text)
    if want is None:
        assert got is None
        return
    a, b, groups, links = want
    assert got == ((len(a), len(b), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest()), links) and len(groups) == len(links)


def test_odd_texts(aligner, whole):
    for x in ODD:
        if x:
            check_text(aligner, whole, x)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abE é\u0301,.'\n\t1²_日😀\u2581\u3000\x01<s>", min_size=1, max_size=30))
def test_words_are_aligned_as_whole_texts(aligner, whole, text):
    check_text(aligner, whole, text)


def test_measures(spark, whole):
    rng = random.Random(5)
    vocab = "the The tokenizer unbelievable Straße naïve 日本 x1y2 , . \n  -- https://a.example/b?c=d".split(" ")
    rows = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 25)))) for k in range(150)]
    rows += [(1000 + k, rows[3][1]) for k in range(200)] + [(2000 + k, x) for k, x in enumerate(ODD)] + [(None, "no id"), (7, rows[9][1]), (7, rows[9][1]), (3000, "ab " * 30_000), (3001, "z" * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"block": F.lit(1), "text_key": F.lit("clash")})
    want = sorted(plainly(rows, whole), key=str)
    for most in (alignment.BROADCAST_PAIRS, 0):  # by a broadcast, and by a join of every task's pairs
        got = alignment.align(df, broadcast_pairs=most)
        assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert sorted(map(tuple, got.collect()), key=str) == want
    counted = Counter(link for _, t in rows if whole(t) for link in whole(t)[3])
    assert {(r.a, r.b): r["count"] for r in alignment.linked_ids(df).collect()} == dict(counted)


def test_query(spark, whole):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert sorted(map(tuple, q.op11_cross_tokenizer_alignment(spark, DATA).collect())) == sorted(plainly(rows, whole))


def test_odd_rows(odd, nothing):
    assert alignment.align(odd).count() == 10 and alignment.align(nothing).count() == 0 and alignment.linked_ids(nothing).count() == 0
