"""Operators with one right answer, against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinefold.llm import lempel_ziv as lz
from kinefold.llm import packing, pii, simhash, tokens
from kinefold.llm.common import scratch_path
from kinefold.llm.decontaminate import contamination, decontaminate
from kinefold.llm.encoding import WordEncoder, shared_encoder, vocabulary_path

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_contamination(text, items):
    own, hit, found = words(text), set(), set()
    for item, body in items:
        w = words(body)
        n = min(13, len(w))
        for j in range(len(w) - n + 1) if w else ():
            for p in range(len(own) - n + 1):
                if own[p : p + n] == w[j : j + n]:
                    hit.update(range(p, p + n))
                    found.add(str(item))
    return len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(own)


def test_contamination(spark):
    rng = random.Random(1)
    vocab = ["a", "B", "c1", "é", "zz"]
    text = lambda n: rng.choice([" ", ", ", "-"]).join(rng.choice(vocab) for _ in range(n))
    items = [(k, text(rng.randint(1, 30))) for k in range(12)] + [(90, ""), (91, None), (92, "é"), (93, "a a")]
    docs = [(k, text(rng.randint(0, 80))) for k in range(60)] + [(100, items[0][1] + " tail"), (101, None), (102, items[3][1] * 2)]
    for block in (4_000_000, 40):
        got = contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_chars=block).select("doc_id", "contamination.*").collect()
        assert {r.doc_id: tuple(r)[1:] for r in got} == {d: brute_contamination(t, items) for d, t in docs}


def test_contamination_of_odd_rows(spark, odd, nothing):
    bench = spark.createDataFrame([(None, "x y"), (1, None), (2, "words of a text")], "item_id long, text string")
    kept = decontaminate(odd, bench)
    assert kept.columns == odd.columns and kept.count() == 7
    assert decontaminate(nothing, bench).count() == 0
    assert decontaminate(odd, bench.where("false")).count() == 10


def test_longest_matches():
    from kinefold.llm.decontaminate import BenchmarkIndex

    item = " ".join(f"w{k}" for k in range(100))
    text = ("x " + " ".join(f"w{k}" for k in range(5, 95)) + " y").encode()
    found = BenchmarkIndex([("q", item)]).search(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert found[0][2] == [("q", 5, 1, 90)]


def test_matches_against_brute_force():
    """Words, hit words and every item's longest match of texts with few words, so that windows repeat."""
    from kinefold.llm.decontaminate import BenchmarkIndex

    rng = random.Random(3)
    for _ in range(120):
        window, letters = rng.choice([2, 3, 13]), "abcdefgh"[: rng.choice([2, 3, 5])]
        some = lambda most: " ".join(rng.choice(letters) for _ in range(rng.randint(0, rng.choice(most))))  # noqa: B023, E731
        items = [(k, some([5, 30, 150])) for k in range(rng.randint(0, 6))]
        docs = [some([10, 120]) for _ in range(3)] + [(items[0][1] + " ") * 3 if items else ""]
        raw = [x.encode() for x in docs]
        got = BenchmarkIndex(items, window).search(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        for doc, (n, spans, matches) in zip(docs, got, strict=True):
            w, hit, want = doc.split(), set(), []
            for item, body in items:
                v = body.split()
                size, found = min(window, len(v)), []
                for p in range(len(w) if v else 0):
                    for j in range(len(v) - size + 1):
                        if w[p : p + size] == v[j : j + size]:
                            same = size
                            while p + same < len(w) and j + same < len(v) and w[p + same] == v[j + same]:
                                same += 1
                            hit.update(range(p, p + size))
                            found.append((-same, p, j))
                if found:
                    same, p, j = min(found)
                    want.append((str(item), j, p, -same))
            assert n == len(w) and {x for a, c in spans for x in range(a, a + c)} == hit and sorted(matches) == sorted(want)


def test_a_passage_of_all_items_costs_no_step_an_occurrence_and_item():
    import time

    from kinefold.llm.decontaminate import BenchmarkIndex

    shared = " ".join(f"shared{k}" for k in range(40))
    index = BenchmarkIndex([(k, shared + " " + " ".join(f"own{k}x{i}" for i in range(30))) for k in range(800)])
    text = " ".join(f"{shared} between{k}" for k in range(50)).encode()
    began = time.process_time()
    n, spans, matches = index.search(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]
    assert n == 2050 and len(spans) == 50 and len(matches) == 800 and {m[1:] for m in matches} == {(0, 0, 40)}
    assert time.process_time() - began < 3  # about 0.25; it was 11


def test_blocks_write_no_text_of_the_corpus_again(spark, monkeypatch):
    """Many blocks: the rows are written once, and of each further block only the numbers of rows with a hit."""
    from kinefold.llm import decontaminate as module

    written = []

    def spy(df, name):
        table = materialize(df, name)
        written.append((name, df.columns, table.count()))
        return table

    materialize = module.materialize
    monkeypatch.setattr(module, "materialize", spy)
    items = [(k, f"item{k} has words of its own number{k}") for k in range(40)]
    docs = [(k, f"before item{k} has words of its own number{k} after" if k < 30 else "nothing of the kind", k) for k in [*range(60), 3, 3]]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string, row long"), spark.createDataFrame(items, "item_id long, text string")
    got = contamination(df, bench, block_chars=300)
    assert got.columns == ["doc_id", "text", "row", "contamination"]
    assert sorted((r.doc_id, r.row, *r.contamination) for r in got.collect()) == sorted((d, k, *brute_contamination(t, items)) for d, t, k in docs)
    assert len(written) > 3 and written[0][2] == 62 and all("text" not in columns and n < 31 for _, columns, n in written[1:])


ODD_TEXTS = ["", " ", "  ", "a  b", "a   b", "a \n b", "\n\n a", "it's we'll  x", "<|endoftext|> hi", "日本語 テスト  です", "a,b.c", "a ,b", "x .y", "..a", "a.,b", ".\nB", "\n,a", "a\x01b,c", "é é", "½ ² ٣,٤", "x\x85 y", "tab\t\t x \t", "a\n\nb", "a\n\n", "a\n", "\n", "\n\n\nb", "a\r\nb", "a\n b\n,c\n\n.d", "a\t\n\nb", "\n\tb\n\n\tc"]


@pytest.fixture(scope="module")
def encoder():
    return WordEncoder(vocabulary_path(), pieces=50, added=True)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_encoder_on_odd_texts(encoder, library):
    for x, ids in zip(ODD_TEXTS, encoder.encode(ODD_TEXTS), strict=True):
        assert ids.tolist() == library(x), x


def test_added_tokens_are_matched_as_in_the_library(spark):
    from tokenizers import Tokenizer

    default = Tokenizer.from_file(vocabulary_path())
    texts = ["a <|endoftext|> hi", "<|endoftext|>", "x<|endoftext|><|endoftext|>, y", "<|endoftext", None, "", "plain words, more."]
    want = [default.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert 50256 in want[0]
    assert [x.tolist() for x in shared_encoder(vocabulary_path()).encode(texts)] == want
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = scratch_path(spark, "t")
    tokens.write_tokens(docs, path)
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in tokens.token_digests(spark, path).collect()}
    assert got == {k: (len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4").tobytes())) for k, x in enumerate(want)}
    packed = packing.pack(docs).groupBy("doc_id").count().count()
    assert packed == len(texts)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab é,.\n\t'1!?日 ", max_size=12), max_size=4))
def test_encoder_equals_the_library(encoder, library, texts):
    assert [x.tolist() for x in encoder.encode(texts)] == [library(x) for x in texts]


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_round_trip(spark, odd, nothing, library, encoding):
    path = scratch_path(spark, "t")
    tokens.write_tokens(odd, path, encoding=encoding, row_group_bytes=1 << 20, page_bytes=1 << 12)
    ids = lambda x: np.array([*library(x), 2], "<u4")
    rows = sorted(((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in odd.collect()))
    at, want = 0, []
    for d, t in rows:
        x = ids(t)
        want.append((d, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.start, r.n_tokens, r.ids_crc32) for r in tokens.token_digests(spark, path).collect())
    assert got == sorted(want)
    plan = tokens.read_tokens(spark, path, ["doc_id", "n_tokens"], (3, 5))._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,3)" in plan and "ids" not in plan.split("ReadSchema")[1].split("\n")[0]
    empty = scratch_path(spark, "t")
    tokens.write_tokens(nothing, empty)
    assert tokens.token_digests(spark, empty).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=60))
def test_packing_is_gapless_and_tight(lengths):
    bins, offsets = packing.best_fit_decreasing(np.array(lengths, int), 16)
    for b in set(bins.tolist()):
        own = sorted((offsets[k], lengths[k]) for k in np.flatnonzero(bins == b))
        assert own[0][0] == 0 and all(a + n == c for (a, n), (c, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= 16
    # Best fit by looking at every bin.
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= n]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - n)
        else:
            room.append(16 - n)
    assert len(set(bins.tolist())) == len(room)


def test_pack_odd_rows(spark, odd, nothing, library):
    rows = packing.pack(odd, capacity=64).collect()
    assert sum(r.length for r in rows) == sum(len(library(r.text)) + 1 for r in odd.collect())
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= 64
    assert packing.pack(nothing).count() == 0


def test_equal_pieces_are_spread_over_shards(spark):
    """Equal rows, and rows without an id, make no large shard."""
    docs = spark.range(20_000).selectExpr("CAST(NULL AS long) AS doc_id", "'' AS text")
    packed = packing.pack(docs, shard_pieces=1000)
    shards = [r["count"] for r in packed.selectExpr("sequence_id >> 32 AS shard").groupBy("shard").count().collect()]
    assert len(shards) == 20 and sum(shards) == 20_000 and max(shards) < 1300
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert packed.groupBy("sequence_id").agg({"offset": "max", "*": "count"}).where("`max(offset)` + 1 <> `count(1)`").count() == 0


def test_simhash_components(spark, odd, nothing, monkeypatch):
    import xxhash

    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(30)) for _ in range(40)]
    docs = [(k, t) for k, t in enumerate(base)]
    docs += [(100 + k, t + " end") for k, t in enumerate(base[:20])] + [(200 + k, t) for k, t in enumerate(base[:10])]

    def fp(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), seed=42) for i in range(max(1, len(w) - 3))]
        return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))

    prints = {d: fp(t) for d, t in docs}
    root = {d: d for d in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if bin(prints[a] ^ prints[b]).count("1") <= 4 and root[a] < root[b]:
                    root[b], changed = root[a], True
    got = simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.fp & (2**64 - 1) for r in got} == prints
    assert {r.doc_id: r.component_id for r in got} == root
    rows = simhash.near_duplicates(odd).collect()
    assert {r.component_id for r in rows if r.doc_id in (2, 3, 4)} == {2} and {r.component_id for r in rows if r.doc_id in (1, 8)} == {1}
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 5, 6, 7]
    assert simhash.near_duplicates(nothing).count() == 0


def test_vantage_trees_lose_no_pair():
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, 60, dtype=np.uint64)
    x = np.unique(np.concatenate([centres] + [centres ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) for _ in range(12)]))
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if int(x[i] ^ x[j]).bit_count() <= 4}
    got = {tuple(sorted(p)) for a, b in simhash.near_pairs(x, 4, block=16) for p in zip(a.tolist(), b.tolist(), strict=True)}
    assert got == want
    for rows in (1000, 10**8, 10**10, 10**13):
        masks = simhash.choices(rows, 4, 1024)
        trees = [simhash.VantageTree(x, m, 8) for m in masks]
        leaves = [t.leaf(x) for t in trees]
        assert all(any(leaf[i] == leaf[j] for leaf in leaves) for i, j in want)


def test_full_shards_are_cut(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 2**40, 300).tolist()
    x += [v ^ 5 for v in x[:100]]
    df = spark.createDataFrame([(v, k) for k, v in enumerate(dict.fromkeys(x))], "fp long, rep long")
    pairs = lambda **k: {(r.a, r.b) for r in simhash.components(simhash.links(df, **k)).collect()}
    assert pairs(part_rows=10) == pairs()


def test_lempel_ziv_against_a_plain_parse(spark, odd, nothing):
    def parse(t):
        seen, ends, a = set(), [], 0
        for e in range(1, len(t) + 1):
            if t[a:e] not in seen:
                seen.add(t[a:e])
                ends.append(e)
                a = e
        return ends

    rng = random.Random(2)
    for n in [0, 1, 2, 5, 50, 400]:
        t, u = ("".join(rng.choice("abé日") for _ in range(n)) for _ in range(2))
        ends = []
        lz.parse(t, set(), ends)
        assert ends == parse(t)
        a, b, edited = lz.minima_of_pair(t, u)
        assert edited == t[: n - n // 2] + u[: n // 2] and (a == lz.minima_of(t)).all() and (b == lz.minima_of(edited)).all()
    for parts in (odd, spark.range(0, 300).selectExpr("id AS doc_id", "repeat(concat('w', id % 7, ' '), cast(id % 50 as int)) AS text")):
        rows = sorted(((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in parts.collect()))
        texts = [t for _, t in rows]
        want = []
        for k, (d, t) in enumerate(rows):
            u = texts[(k + 1) % len(texts)]
            want.append((d, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + u[: len(t) // 2]).encode()).hexdigest()))
        got = [(r.doc_id if r.doc_id is not None else -1, r.n_chars, r.edited_sha256) for r in lz.compare_edited(parts).collect()]
        assert sorted(got) == sorted(want)
    assert lz.compare_edited(nothing).count() == 0
    assert lz.likeness(lz.minima_of(""), lz.minima_of("")) == 1.0 and lz.likeness(lz.minima_of(""), lz.minima_of("x")) == 0.0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a1.@+- 4()20", max_size=120))
def test_fixed_spans(text):
    digits = lambda s: re.sub(r"\D", "", s)
    good = {"email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m.split(".")), "card": lambda m: 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m)), "phone": lambda m: 10 <= len(digits(m)) <= 15}
    want = sorted((m.start(), n, m.end()) for n, k in enumerate(PATTERNS) for m in re.finditer(PATTERNS[k], text) if good[k](m[0]))
    assert sorted((s, k, e) for k, s, e in pii.fixed_spans(text)) == want


def test_pii_of_odd_rows(spark, odd, nothing):
    assert pii.find_pii(odd).where("spans <> ''").count() == 0
    assert pii.find_pii(nothing).count() == 0
    df = spark.createDataFrame([(k, f"write to a{k}.b@mail.example.com or call +1 (555) 555-010{k % 10}, token = \"ab12cd34ef56ab78cd90{k:04d}\"") for k in range(40)], "doc_id long, text string")
    out = pii.redact(df)
    assert out.where("text like '%@%' or text like '%+1%' or text not like '%<EMAIL>%<PHONE>%'").count() == 0 and out.columns == df.columns
    assert pii.redact(odd).exceptAll(odd).count() == 0


def test_a_repeated_word_and_wide_windows(spark):
    """One word over and over: memory follows the text, not the pairs of places; windows wider than the sorted depth find their matches."""
    import tracemalloc

    from kinefold.llm.decontaminate import BenchmarkIndex

    index = BenchmarkIndex([("q", "word " * 212)])
    peaks = []
    for n in (2000, 8000):
        text = ("word " * n).encode()
        tracemalloc.start()
        found = index.search(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert found == [(n, [(0, n)], [("q", 0, 0, 212)])]
    assert peaks[1] < 40e6
    item = " ".join(f"w{k}" for k in range(120))
    docs = spark.createDataFrame([(1, "x " + item + " y"), (2, " ".join(item.split()[:79]))], "doc_id long, text string")
    for window in (13, 64, 65, 80):
        got = {r.doc_id: r.n_hit for r in contamination(docs, spark.createDataFrame([(1, item)], "item_id long, text string"), window=window).select("doc_id", "contamination.n_hit").collect()}
        assert got == {1: 120, 2: 79 if window <= 79 else 0}


def test_packed_pieces_against_plain_cuts(spark, library):
    """Every contract column of op3: pieces, starts, lengths and digests from the library's ids."""
    docs = [(k, " ".join(f"tok{j * 7 % 13}" for j in range(n))) for k, n in enumerate([0, 1, 5, 40, 41, 90, 300])] + [(50, None), (51, "a <|endoftext|> b"), (51, "a <|endoftext|> b")]
    want = []
    for d, x in docs:
        ids = [*library(x), 2]
        first = len(ids) % 64 or min(len(ids), 64)
        for p, a in enumerate([0, *range(first, len(ids), 64)]):
            n = first if p == 0 else 64
            want.append((d, p, a, n, zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes())))
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), capacity=64).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)


def test_lempel_ziv_columns_against_brute_force(spark):
    """Every column of op7 from the sets of phrases, and the likeness near the true share of them."""

    def phrases(t):
        seen, a = set(), 0
        for e in range(1, len(t) + 1):
            if t[a:e] not in seen:
                seen.add(t[a:e])
                a = e
        return seen

    def minima(t):
        out = {}
        for x in phrases(t):
            h = int(lz.phrase_hashes(lz._points(x), np.array([0]))[0])
            out[h >> 57] = min(h, out.get(h >> 57, h))
        return out

    def shown(m):
        return "".join(f"{m[k] & 0xFFFF:04x}" if k in m else "----" for k in range(128))

    def like(a, b):
        used = a.keys() | b.keys()
        return sum(a.get(k) == b.get(k) for k in used) / len(used) if used else 1.0

    rng = random.Random(8)
    words_ = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    docs = [(k, " ".join(rng.choice(words_) for _ in range(rng.choice([0, 3, 40, 200])))) for k in range(40)]
    docs += [(100, docs[3][1]), (101, docs[3][1]), (102, None)]
    texts = [t or "" for _, t in sorted(docs)]
    got = {r.doc_id: r for r in lz.compare_edited(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    gaps = []
    for k, (d, _) in enumerate(sorted(docs)):
        own, following = texts[k], texts[(k + 1) % len(texts)]
        edited = own[: len(own) - len(own) // 2] + following[: len(own) // 2]
        a, b, c, r = minima(own), minima(edited), minima(following), got[d]
        assert (r.n_chars, r.fingerprint, r.edited_fingerprint) == (len(own), shown(a), shown(b))
        assert r.near_edited == pytest.approx(like(a, b)) and r.near_next == pytest.approx(like(a, c))
        p, q = phrases(own), phrases(edited)
        if len(p | q) > 200:
            gaps.append(abs(len(p & q) / len(p | q) - r.near_edited))
    assert gaps and sum(gaps) / len(gaps) < 0.06


def test_pii_columns_against_the_patterns(spark):
    """Counts, digest and order of the fixed spans of op9; added spans are learned and never overlap fixed ones."""
    rng = random.Random(4)
    parts = ["mail a.b@c-d.org now", "host 10.0.0.255", "300.1.1.1", "card 4111 1111 1111 1111", "call +44 (20) 7946-0958", "555-123-4567", "token = abcdEFGH1234ijklMNOP", "john at example dot com", "plain words", "1.2.3.4@x.y"]
    docs = [(k, " ; ".join(rng.choice(parts) for _ in range(rng.randint(0, 6)))) for k in range(80)] + [(200, None), (201, "")]
    digits = lambda s: re.sub(r"\D", "", s)
    good = {"email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m.split(".")), "card": lambda m: 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m)), "phone": lambda m: 10 <= len(digits(m)) <= 15}
    added = 0
    for r in pii.find_pii(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        text = dict(docs)[r.doc_id] or ""
        want = sorted((m.start(), n, m.end()) for n, k in enumerate(PATTERNS) for m in re.finditer(PATTERNS[k], text) if good[k](m[0]))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in want) for n in range(4)]
        listed = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert r.n_spans == len(spans) and set(listed) <= set(spans)
        added += len(spans) - len(listed)
    assert added


def test_pii_wider_spans_need_no_digit_elsewhere():
    """What is proposed in a text does not hang on what else it holds."""
    for text in ("password=abcdefghijklmnopqrst", "see abcd:abcd:abcd:abcd:abcd:abcd:abcd:abcd there", "write to some.one at example point", "someone [at] example [dot] org"):
        assert [(p["kind"], p["start"], p["end"]) for p in pii.proposals(text)] == [(p["kind"], p["start"], p["end"]) for p in pii.proposals(f"{text} 1")], text
    assert len(pii.proposals("password=abcdefghijklmnopqrst")) == 1


def test_pii_overlaps_of_a_long_span():
    """A wider span inside a long fixed one is none, however many fixed ones lie between."""
    text = "token=" + "a" * 16 + ".9.8.7.6.1.2.3.4@" + "1.2.3.4." * 3 + "x.org"
    base = pii.fixed_spans(text)
    for p in pii.proposals(text):
        if not p["fixed"]:
            assert not any(s < p["end"] and e > p["start"] for _, s, e in base)


def test_duplicates_of_rows_with_maps(spark):
    """Maps have no hash of their own; the stage takes them all the same."""
    rows = [(1, "the same words in every one of these rows", {"a": 1}), (2, "the same words in every one of these rows", {"b": 2}), (3, "another text altogether, about something else", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, more map<string,int>")
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_token_files_lie_where_spark_reads(spark, tmp_path):
    """A path without a scheme is the default file system's."""
    from kinefold.sources.tables import qualified

    assert qualified(spark, str(tmp_path)) == f"file://{tmp_path}" and qualified(spark, f"file:{tmp_path}/x") == f"file://{tmp_path}/x"


def test_pii_estimates_reliabilities():
    """Expectation-maximisation finds which labeler lies, on votes drawn from known accuracies."""
    rng = np.random.default_rng(2)
    true, accuracy = rng.random(20_000) < 0.6, [0.95, 0.9, 0.85, 0.8, 0.6]
    votes = np.stack([np.where(rng.random(20_000) < a, true, ~true) * 2 - 1 for a in accuracy], axis=1)
    own, counts = np.unique(votes, axis=0, return_counts=True)
    found, share = pii.estimate([(0, tuple(v), int(n)) for v, n in zip(own.tolist(), counts, strict=True)])
    assert np.abs(found - accuracy).max() < 0.05 and abs(share[0] - 0.6) < 0.05
    key = " token = " + "abC9" * 100
    assert pii.proposals(key)[-1]["end"] == len(key)


def test_rows_that_stay(spark):
    """One row of each component: the smallest id, rows without one last; clashing names and text ids do no harm."""
    a, b = "the same words over and over again in one text", "quite another text with words of its own that nobody shares"
    rows = [("3", a, 1), ("2", a, 1), (None, a, 1), (None, b, 2), (None, b, 2), ("2", b, 3), ("9", None, 4), ("9", None, 4)]
    df = spark.createDataFrame(rows, "doc_id string, text string, gone int").withColumnRenamed("gone", "again").selectExpr("*", "1 AS gone", "2 AS row", "3 AS fp", "4 AS kept_id", "5 AS n")
    got = simhash.drop_near_duplicates(df)
    assert got.columns == df.columns and sorted((r.doc_id, r.text, r.again) for r in got.where("text is not null").collect()) == sorted([("2", a, 1), ("2", b, 3)]) and got.where("text is null").count() == 1


def test_hot_keys_are_spread(spark, monkeypatch):
    from kinefold.llm import common

    left = spark.createDataFrame([(k % 3 if k % 10 else 7, k) for k in range(1000)], "key long, id long")
    right = left.groupBy("key").count().selectExpr("key", "count AS n", "if(key = 1, null, key * 10) AS v").where("key <> 2")
    plain = sorted((r.key, r.id, r.v or -1) for r in left.join(right, "key").collect())
    for most in (0, 150, 10**9):
        monkeypatch.setattr(common, "SPREAD_ROWS", most)
        assert sorted((r.key, r.id, r.v or -1) for r in common.join_spread(left, right, "key", "n", "id").collect()) == plain


def test_samples_are_the_smallest_hashes(spark):
    from pyspark.sql import functions as F

    from kinefold.llm.common import hash_sample

    df = spark.range(5000).repartition(9)
    h = F.xxhash64(F.lit(7), F.col("id"))
    for limit in (1, 50, 4000, 9000):
        assert [r.id for r in hash_sample(df, "id", limit).collect()] == [r.id for r in df.orderBy(h, "id").limit(limit).collect()]
