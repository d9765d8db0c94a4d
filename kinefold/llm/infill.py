"""Fill-in-the-middle: texts cut into prefix, middle and suffix, and put together in another order.

Each document is cut into lines, and two draws from its id say where the prefix and the middle end. Its output is emitted
as pieces of whole lines, keyed by document and place in the output. One shuffle deals documents to partitions and sorts
each by (document, place): Spark's repartition and sortWithinPartitions, the DataFrame form of
repartitionAndSortWithinPartitions. The pieces then stream through incremental digests, so no task holds a whole text. For
restoration the stream of the output is parsed at its marks, each piece gets its place in the text, and the
same partition is sorted again, without a second shuffle.

Defined cases: a null text is empty; an empty text, or one that holds a mark, is plain; a null doc_id draws as the
text "null"; every row is a document of its own, also with an id or a text that others have; an empty table gives no
rows; other columns are not carried. Rows are told apart by their places in the input (monotonically_increasing_id), so the
input must come in the same order when a task is repeated, as files and written tables do.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from kinefold.llm.common import bound_batches, utf8

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of a piece: whole lines up to so many; a longer line is cut between two characters.
PIECE_BYTES = 64 << 10
#: Rows and bytes of the batches that go back to Spark.
OUT_ROWS, OUT_BYTES = 4096, 4 << 20
#: Where the part after a mark lies in the text.
_ORDER = {PREFIX.encode(): 0, MIDDLE.encode(): 1, SUFFIX.encode(): 2}
_MARK = re.compile(b"|".join(map(re.escape, _ORDER)))
#: The row that precedes a document's pieces tells about it.
_INFO = ["n", "form", "prefix_chars", "middle_chars", "output_sha256"]


def draws(seed: int, doc_id: object) -> list[int]:
    """Four numbers below 2**32 that follow from the id alone."""
    h = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[k : k + 8], 16) for k in range(0, 32, 8)]


def cut_points(text: bytes, h1: int, h2: int) -> tuple[int, int, int]:
    """How many lines there are, and the bytes at which prefix and middle end."""
    lines = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    ends = np.append(lines, len(text)) if text and not text.endswith(b"\n") else lines
    n = len(ends)
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    at = lambda units: int(ends[units - 1]) if units else 0
    return n, at(first), at(second)


def code_points(text: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def pieces_between(text: bytes, begin: int, end: int, size: int) -> Iterator[bytes]:
    """A part of the text in pieces of whole lines, of at most size bytes."""
    while begin < end:
        to = min(begin + size, end)
        if to < end:
            line = text.rfind(b"\n", begin, to) + 1
            if line:
                to = line
            else:
                while text[to] & 0xC0 == 0x80:
                    to -= 1
        yield text[begin:to]
        begin = to


def arrange(text: bytes, doc_id: object, *, seed: int, fim_percent: int, spm_percent: int, piece_bytes: int) -> tuple[tuple, Iterator[bytes]]:
    """What a document's header tells, and its pieces in output order."""
    h1, h2, h3, h4 = draws(seed, doc_id)
    n, a, b = cut_points(text, h1, h2)
    part = lambda begin, end: pieces_between(text, begin, end, piece_bytes)
    if not text or _MARK.search(text) or h3 % 100 >= fim_percent:
        return (n, "plain", None, None, None), part(0, len(text))
    parts = {PREFIX: (0, a), SUFFIX: (b, len(text)), MIDDLE: (a, b)}
    form, order = ("spm", (SUFFIX, PREFIX, MIDDLE)) if h4 % 100 < spm_percent else ("psm", (PREFIX, SUFFIX, MIDDLE))
    pieces = (x for mark in order for x in (mark.encode(), *part(*parts[mark])))
    return (n, form, code_points(text[:a]), code_points(text[a:b]), None), pieces


class _Rows:
    """Rows gathered into batches of a bounded size."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, row: tuple, size: int = 64) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += size
        if len(self.rows) >= OUT_ROWS or self.size >= OUT_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*self.rows, strict=True), self.schema, strict=True)], schema=self.schema)
        self.rows, self.size = [], 0


def _schema(kind: str) -> str:
    return f"key long, part int, place long, doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, piece binary"


def _sorted_stream(docs: DataFrame, emit: Callable[[pa.RecordBatch], Iterator[tuple]], columns: list[str]) -> DataFrame:
    """The pieces that emit gives for a batch of documents, each document's together and in order. A row with part -1 precedes them."""
    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = docs.sparkSession.createDataFrame([], _schema(kind)).schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(arrow)
        for batch in batches:
            for row in emit(batch):
                yield from rows.add(row, 64 + len(row[-1] or b""))
        yield from rows.flush()

    keyed = docs.select(F.monotonically_increasing_id().alias("key"), *columns)
    return keyed.mapInArrow(run, schema).repartition("key").sortWithinPartitions("key", "part", "place")


def cut(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", seed: int = 7, fim_percent: int = 100, spm_percent: int = 50, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """The outputs as pieces, in order within each partition: key, part (-1: the row that tells of the document; 0: its pieces), place, doc_id, n, form, prefix_chars, middle_chars, piece."""

    def emit(batch: pa.RecordBatch) -> Iterator[tuple]:
        data, where = utf8(batch.column("text"))
        for k, (key, own) in enumerate(zip(batch.column("key").to_pylist(), batch.column("doc_id").to_pylist(), strict=True)):
            info, pieces = arrange(data[where[k] : where[k + 1]].tobytes(), own, seed=seed, fim_percent=fim_percent, spm_percent=spm_percent, piece_bytes=piece_bytes)
            yield (key, -1, 0, own, *info, None)
            for place, piece in enumerate(pieces):
                yield (key, 0, place, None, *[None] * len(_INFO), piece)

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return _sorted_stream(own, emit, ["doc_id", "text"])


def parse(form: str, piece: bytes, part: int) -> Iterator[tuple[int, bytes]]:
    """What of a piece of an output belongs to which part of the text; part is the one that the piece before ended in."""
    if form == "plain":
        yield 0, piece
        return
    at = 0
    for mark in _MARK.finditer(piece):
        if mark.start() > at:
            yield part, piece[at : mark.start()]
        part, at = _ORDER[mark[0]], mark.end()
        yield part, b""
    if at < len(piece):
        yield part, piece[at:]


def restoration(outputs: DataFrame) -> DataFrame:
    """From cut()'s stream: the same documents as pieces of their texts, in order, and with the sha256 of the output in the first row. Each partition is sorted anew; nothing is shuffled."""
    schema = outputs.schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, info, sha, part, place = _Rows(arrow), None, None, 0, 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[1] < 0:
                    if info:
                        yield from rows.add((*info[:-2], sha.hexdigest(), None))
                    info, sha, part, place = row, hashlib.sha256(), 0, 0
                    continue
                sha.update(row[-1])
                for part, piece in parse(info[5], row[-1], part):  # noqa: B020  the part goes on into the next piece
                    if piece:
                        yield from rows.add((row[0], part, place, None, *[None] * len(_INFO), piece), 64 + len(piece))
                        place += 1
        if info:
            yield from rows.add((*info[:-2], sha.hexdigest(), None))
        yield from rows.flush()

    return outputs.mapInArrow(run, schema).sortWithinPartitions("key", "part", "place")


def _folded(pieces: DataFrame, start: Callable[[], object], add: Callable[[object, bytes], None], end: Callable[[object], object], name: str, kind: str) -> DataFrame:
    """One row a document: what its first row tells, and the fold of its pieces."""
    own = pieces.schema["doc_id"].dataType.simpleString()
    schema = pieces.sparkSession.createDataFrame([], f"doc_id {own}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, {name} {kind}").schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, info, state = _Rows(arrow), None, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[1] < 0:
                    if info:
                        value = end(state)
                        yield from rows.add((*info[3:9], value), 64 + len(value))
                    info, state = row, start()
                else:
                    add(state, row[-1])
        if info:
            yield from rows.add((*info[3:9], end(state)))
        yield from rows.flush()

    return pieces.mapInArrow(run, schema)


def fill_in_middle(docs: DataFrame, **kwargs) -> DataFrame:
    """One row a document: doc_id, n lines, form (plain, psm or spm), prefix_chars, middle_chars, output (the whole text to train on)."""
    found = _folded(cut(docs, **kwargs), list, list.append, lambda pieces: b"".join(pieces).decode(), "output", "string")
    return found.drop("output_sha256")


def restore(outputs: DataFrame, *, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """The texts of fill_in_middle's rows (doc_id, form, output): doc_id, text."""

    def emit(batch: pa.RecordBatch) -> Iterator[tuple]:
        data, where = utf8(batch.column("output"))
        for k, (key, own, form) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "form")), strict=True)):
            yield (key, -1, 0, own, None, form, None, None, None, None)
            parsed = parse(form, data[where[k] : where[k + 1]].tobytes(), 0)
            pieces = ((part, x) for part, piece in parsed for x in pieces_between(piece, 0, len(piece), piece_bytes))
            for place, (part, piece) in enumerate(pieces):
                yield (key, part, place, None, *[None] * len(_INFO), piece)

    stream = _sorted_stream(outputs, emit, ["doc_id", "form", "output"])
    return _folded(stream, list, list.append, lambda pieces: b"".join(pieces).decode(), "text", "string").select("doc_id", "text")


def digests(docs: DataFrame, **kwargs) -> DataFrame:
    """One row a document: doc_id, n, form, prefix_chars, middle_chars, and the sha256 of its output and of the text restored from that."""
    return _folded(restoration(cut(docs, **kwargs)), hashlib.sha256, lambda sha, piece: sha.update(piece), lambda sha: sha.hexdigest(), "restored_sha256", "string")
