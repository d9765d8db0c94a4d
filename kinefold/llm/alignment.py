"""Alignment of two tokenizers: which ids of one go with which ids of the other.

Texts are shuffled whole, so that each distinct text is tokenised and aligned once, with its number of copies as its
weight. Both tokenisations of a text end a token at every cut before a blank-led word, so words are aligned
one by one and remembered. A task gives each text as the codes of its links, and each id pair it has met with its weighted
count. Spark adds up the counts of all tasks and finds the highest count of each second id. Where the pairs are few enough
they are broadcast and the texts stay where they are; otherwise every task's pairs are joined with the counts and sent back
beside its texts. Either way a link's figures are one look-up. The measures are joined to the document ids by the sha256 of the text; a text that
many documents share is one key there, which adaptive execution splits among tasks.

Defined cases: texts that are null or empty, or whose tokens do not give the text back (a tokenizer that
normalises), have no tokens: zeros and an empty digest; they count for no pair. Equal texts, also with equal ids, count each.
Special tokens in texts are ordinary text. An empty table gives no rows; other columns are not carried.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from kinefold.llm.common import bound_batches, materialize, ship, slices
from kinefold.llm.encoding import OPEN, PLAIN, KnownPieces, byte_letters, cut_pieces, kept_encoder, piece_flags, vocabulary_path

#: Texts whose links are gathered at once.
TEXTS_AT_ONCE = 64
#: Links after which a task adds up its counts.
LINKS_AT_ONCE = 1 << 20
#: Pairs whose counts may be broadcast (17 bytes each).
BROADCAST_PAIRS = 2_000_000
#: Before a blank that follows another character than a blank and precedes no white space, tokens of both kinds end.
_CUT = re.compile(r"(?<=[^ ])(?= \S)")


class Aligner:
    """Pieces of a text and what both tokenizers make of them, remembered. Pairs of ids are numbered in the order in which they come."""

    def __init__(self, first: str, second: str, pieces: int = 500_000) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True  # their strings are ordinary text
        self.merge, letters = self.a.model.tokenize, byte_letters()
        self.letters = {b: x for x, b in letters.items()}
        names = self.a.get_vocab()
        self.a_bytes = dict.fromkeys(range(max(names.values()) + 1), b"") | {k: bytes(map(letters.__getitem__, x)) if all(c in letters for c in x) else x.encode() for x, k in names.items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        own = [self.b.id_to_piece(k) for k in range(self.b.vocab_size())]
        crosses = re.compile(r"[^▁]▁|\n|[^\W_][,.]")
        if any(crosses.search(x) and not any(c.isalnum() and not (c.isalpha() or c.isdecimal()) for c in x) for x in own):
            raise ValueError(f"{second}: a piece lies across a cut of texts, so their pieces are not independent")
        self.b_bytes = [bytes([int(x[1:-1], 16)]) if self.b.is_byte(k) else x.replace("▁", " ").encode() for k, x in enumerate(own)]
        self.a_size, self.b_size = [len(self.a_bytes[k]) for k in range(len(self.a_bytes))], list(map(len, self.b_bytes))
        self.a_name, self.b_name = list(map(str, range(len(self.a_size)))), list(map(str, range(len(self.b_size))))
        self.led = len(self.b.encode("\n"))  # what a line end and the blank before it give
        self.most = pieces
        self.forget_pairs()

    def forget_pieces(self) -> None:
        self.known = KnownPieces(self._learn)
        self.groups: list[str] = []
        self.n_a, self.n_b, self.faithful = array("i"), array("i"), array("b")

    def forget_pairs(self) -> None:
        """Number the pairs anew; pieces hold numbers, so they go too."""
        self.pairs: dict[tuple[int, int], int] = {}
        self.codes = array("Q")
        self.forget_pieces()

    def _pair(self, a: int, b: int) -> int:
        number = self.pairs.get((a, b))
        if number is None:
            number = self.pairs[a, b] = len(self.pairs)
            self.codes.append(a * len(self.b_size) + b)
        return number

    def _ids_a(self, piece: str) -> list[int]:
        if PLAIN.fullmatch(piece):
            return [x.id for x in self.merge(piece.encode().decode("latin-1").translate(self.letters))]
        return self.a.encode(piece, add_special_tokens=False).ids

    def _ids_b(self, pieces: list[str]) -> list[list[int]]:
        """The library puts a blank before a text. A piece without one follows a line end, which nothing merges with."""
        found = self.b.encode([x[1:] if x[:1] == " " else "\n" + x for x in pieces], num_threads=1)
        return [ids if x[:1] == " " else ids[self.led :] for x, ids in zip(pieces, found, strict=True)]

    def _learn(self, piece: str) -> tuple[list[int], int]:
        return self._store(piece, self._ids_b([piece])[0])

    def _store(self, piece: str, b: list[int]) -> tuple[list[int], int]:
        """Numbers of the piece's links, and what the cuts have to know of it."""
        raw, a = piece.encode(), self._ids_a(piece)
        faithful = b"".join([self.b_bytes[x] for x in b]) == raw == b"".join([self.a_bytes[x] for x in a])
        links, text = self._groups(a, b) if faithful and raw else ([], "")
        self.groups.append(text)
        self.n_a.append(len(a))
        self.n_b.append(len(b))
        self.faithful.append(faithful)
        flags = piece_flags(piece)
        last = piece[-1:]
        return links, flags if not last or last.isalpha() or last.isdecimal() else flags | OPEN

    def _groups(self, a: list[int], b: list[int]) -> tuple[list[int], str]:
        if len(a) == 1 or len(b) == 1:
            cuts = [(len(a), len(b))]
        else:
            ends_a, ends_b = accumulate([self.a_size[x] for x in a]), dict(zip(accumulate([self.b_size[x] for x in b]), range(1, len(b) + 1), strict=True))
            cuts = [(k, ends_b[end]) for k, end in enumerate(ends_a, 1) if end in ends_b]
        links, groups, i, j = [], [], 0, 0
        for to_i, to_j in cuts:
            groups.append(f"{','.join([self.a_name[x] for x in a[i:to_i]])}|{','.join([self.b_name[x] for x in b[j:to_j]])}")
            links.append(self._pair(a[to_i - 1], b[to_j - 1]))
            i, j = to_i, to_j
        return links, ";".join(groups)

    def _numbers(self, pieces: list[list[str]]) -> np.ndarray:
        """Numbers of the pieces; unseen ones are learned together."""
        unseen = list(dict.fromkeys(x for x in chain.from_iterable(pieces) if x not in self.known))
        for piece, b in zip(unseen, self._ids_b(unseen), strict=True):
            self.known.add(piece, *self._store(piece, b))
        return np.fromiter(map(self.known.__getitem__, chain.from_iterable(pieces)), np.int64, sum(map(len, pieces)))

    def align(self, texts: list[str]) -> tuple[list[tuple[int, int, int, str] | None], list[np.ndarray]]:
        """Per text (n_a, n_b, n_links, digest of the groups), or None where tokens do not give it back, and the numbers of its links. No token is empty, so each group ends in one link."""
        if len(self.known) > self.most or self.known.chars > 32 * self.most:
            self.forget_pieces()
        pieces = [cut_pieces(f" {x}") for x in texts]
        at = self._numbers(pieces)
        edges = np.cumsum([0, *map(len, pieces)])
        again = np.unique(np.searchsorted(edges, self.known.odd(at), "right") - 1).tolist()
        again += [k for k, x in enumerate(texts) if "\1" in x]
        if again:  # several blanks, a blank before other white space, or a mark behind another sign
            for k in again:
                pieces[k] = _CUT.split(f" {texts[k]}")
            at = self._numbers(pieces)
            edges = np.cumsum([0, *map(len, pieces)])
        links, ends = self.known.ids(at)
        sums = [np.concatenate([[0], np.cumsum(np.frombuffer(x, kind)[at], dtype=np.int64)])[edges] for x, kind in ((self.n_a, np.int32), (self.n_b, np.int32), (self.faithful, np.int8))]
        n_a, n_b, good = (np.diff(x).tolist() for x in sums)
        places, groups = ends[edges].tolist(), [self.groups[k] for k in at.tolist()]
        told, numbers = [], []
        for k in range(len(texts)):
            numbers.append(links[places[k] : places[k + 1]])
            own = groups[edges[k] : edges[k + 1]]
            if good[k] < len(own):
                told.append(None)
                continue
            digest = hashlib.sha256(";".join(filter(None, own)).encode()).hexdigest()
            told.append((n_a[k], n_b[k], len(numbers[-1]), digest))
        return told, numbers


_TEXTS = "block int, text_key binary, n_a long, n_b long, n_links long, groups_sha256 string, width int, links binary"
_PAIRS = "code long, b int, links_here long"


def _aligned(distinct: DataFrame, first: str, second: str) -> DataFrame:
    """A row for each text (text_key, copies, text) with its links' codes, and one for each pair that a task has met, with its count there. block is the task; a code is the first id times the size of the second vocabulary, plus the second id."""
    schema = distinct.sparkSession.createDataFrame([], f"{_TEXTS}, {_PAIRS}").schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner, block = kept_encoder("aligner", f"{first} {second}", lambda: Aligner(first, second)), TaskContext.get().partitionId()
        if len(aligner.pairs) > aligner.most:
            aligner.forget_pairs()
        width = 4 if len(aligner.a_size) * len(aligner.b_size) <= 1 << 32 else 8
        counts, held, waiting = np.zeros(0, np.int64), [], 0

        def add_up() -> None:
            nonlocal counts, held, waiting
            if held:
                numbers, weights = (np.concatenate(x) for x in zip(*held, strict=True))
                own = np.bincount(numbers, weights).astype(np.int64)  # exact below 2**53
                counts = np.pad(counts, (0, max(0, len(own) - len(counts))))
                counts[: len(own)] += own
            held, waiting = [], 0

        for batch in batches:
            for own in slices(batch, TEXTS_AT_ONCE):
                keys, copies = own.column("text_key").to_pylist(), own.column("copies").to_pylist()
                measured = aligner.align(own.column("text").to_pylist())
                codes, rows = np.array(aligner.codes, f"<u{width}"), []
                for key, weight, told, numbers in zip(keys, copies, *measured, strict=True):
                    if told is None:
                        continue
                    rows.append((block, key, *told, width, codes[numbers].tobytes(), None, None, None))
                    held.append((numbers, np.full(len(numbers), weight, np.float64)))
                    waiting += len(numbers)
                if waiting >= LINKS_AT_ONCE:
                    add_up()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
        add_up()
        met = np.flatnonzero(counts)
        codes = np.array(aligner.codes, np.int64)[met] if len(met) else met
        for k in range(0, len(met), 100_000):
            own = codes[k : k + 100_000]
            columns = [pa.array(np.full(len(own), block, np.int32)), *(pa.nulls(len(own), f.type) for f in list(arrow)[1:8]), pa.array(own), pa.array((own % len(aligner.b_size)).astype(np.int32)), pa.array(counts[met[k : k + 100_000]])]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return distinct.mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Id pairs (code, b) with the number of links that hold them, over all documents, and best: no other pair of that b has more."""
    counts = materialize(aligned.where("code is not null").groupBy("code", "b").agg(F.sum("links_here").alias("count")), "pair-counts")
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))  # a row a piece of the vocabulary
    return counts.join(F.broadcast(highest), "b").select("code", "b", "count", (F.col("count") == F.col("highest")).alias("best"))


class Counted:
    """Pairs' figures by their codes."""

    def __init__(self, code: np.ndarray, count: np.ndarray, best: np.ndarray) -> None:
        order = np.argsort(code)
        self.code, self.count, self.best = code[order].astype(np.uint64), count[order].astype(np.int64), best[order].astype(np.int64)

    def measure(self, texts: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
        """Rows of texts with n_best and count_sum."""
        links = [np.frombuffer(x, f"<u{w}").astype(np.uint64) for x, w in zip(texts.column("links").to_pylist(), texts.column("width").to_pylist(), strict=True)]
        at = np.searchsorted(self.code, np.concatenate(links)) if len(self.code) else np.zeros(0, np.int64)
        ends = np.cumsum([0, *map(len, links)])
        sums = [pa.array(np.diff(np.concatenate([[0], np.cumsum(of[at])])[ends])) for of in (self.best, self.count)]
        return pa.RecordBatch.from_arrays([*(texts.column(c) for c in ("text_key", "n_a", "n_b", "n_links", "n_links")), *sums, texts.column("groups_sha256")], schema=schema)


def _measured(aligned: DataFrame, counts: DataFrame, broadcast_pairs: int) -> DataFrame:
    """text_key with its measures."""
    spark = aligned.sparkSession
    schema = spark.createDataFrame([], "text_key binary, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string").schema
    arrow = to_arrow_schema(schema)
    texts = aligned.where("code is null").select("block", F.lit(1).alias("kind"), "text_key", "n_a", "n_b", "n_links", "groups_sha256", "width", "links")
    counts = materialize(counts, "counted")
    if counts.count() <= broadcast_pairs:
        own = counts.select("code", "count", "best").toPandas()
        model = ship(spark, Counted(*(own[c].to_numpy() for c in ("code", "count", "best"))))

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counted = model()
            for batch in batches:
                for own in slices(batch, TEXTS_AT_ONCE):
                    yield counted.measure(own, arrow)

        return texts.mapInArrow(look_up, schema)

    found = aligned.where("code is not null").select("block", "code").join(counts, "code").select("block", F.lit(0).alias("kind"), "code", "count", "best")
    both = found.unionByName(texts, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each block's pairs, then its texts."""
        block, parts, counted = None, [], None
        for batch in batches:
            blocks, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            edges = np.flatnonzero((blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for a, b in zip([0, *edges], [*edges, len(blocks)], strict=True):
                if blocks[a] != block:
                    block, parts, counted = blocks[a], [], None
                own = batch.slice(a, b - a)
                if kinds[a] == 0:
                    parts.append([own.column(c).to_numpy(zero_copy_only=False) for c in ("code", "count", "best")])
                    continue
                if counted is None:
                    counted, parts = Counted(*(np.concatenate(x) for x in zip(*parts, strict=True))), []
                for some in slices(own, TEXTS_AT_ONCE):
                    yield counted.measure(some, arrow)

    return both.mapInArrow(run, schema)


def _distinct_aligned(docs: DataFrame, text: str, first: str | None, second: str | None) -> DataFrame:
    distinct = docs.select(F.col(text).alias("text")).where("text <> ''").groupBy("text").agg(F.count("*").alias("copies"))
    keyed = distinct.select(_key("text").alias("text_key"), "copies", "text")
    return materialize(_aligned(keyed, first or vocabulary_path(), second or vocabulary_path("piece_bpe_32k.model")), "aligned")


def _key(text: str) -> Column:
    return F.unhex(F.sha2(text, 256))


def align(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", first: str | None = None, second: str | None = None, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. first: a byte-level file of tokenizers; second: a model of sentencepiece."""
    bound_batches(docs.sparkSession)
    aligned = _distinct_aligned(docs, text, first, second)
    measures = _measured(aligned, pair_counts(aligned), broadcast_pairs)
    joined = docs.select(F.col(doc_id).alias("doc_id"), _key(text).alias("text_key")).join(measures, "text_key", "left")
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    return joined.select("doc_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in numbers), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


def linked_ids(docs: DataFrame, *, text: str = "text", first: str | None = None, second: str | None = None) -> DataFrame:
    """The table of linked ids itself: a, b, count, best."""
    bound_batches(docs.sparkSession)
    counts = pair_counts(_distinct_aligned(docs, text, first, second))
    size = _vocabulary_size(second or vocabulary_path("piece_bpe_32k.model"))
    return counts.select(F.floor(F.col("code") / size).cast("int").alias("a"), "b", "count", "best")


def _vocabulary_size(model: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model).vocab_size()
