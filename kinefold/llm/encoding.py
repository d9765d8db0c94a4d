"""Byte-level BPE encoding with the tokenizers library, remembered word by word.

The library splits a text into pre-tokens and merges bytes inside each, so a text's ids are the ids
of its pre-tokens in order. A space that stands before a non-space always begins a pre-token;
texts are cut there and each piece's ids are kept in a bounded table. Only unseen pieces reach
the library's pre-tokenizer, and only unseen pre-tokens its model. The library matches the tokenizer's
added tokens (<|endoftext|>) before all that, so texts that hold one go to it whole.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Callable
from itertools import chain

import numpy as np

_CUT = re.compile(r"(?= \S)")
#: A word of common letters, with a space before it or not: one pre-token.
PLAIN = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


#: What the cuts of a text have to know of a piece: it ends in a mark, suits no cut at all, begins with a mark, is empty, is a line end, begins with a blank or nothing.
OPEN, _ODD, _MARK, _EMPTY, _LINE, _BLANK = 1, 2, 4, 8, 16, 32


def piece_flags(piece: str) -> int:
    if not piece:
        return _EMPTY | _BLANK
    if piece == "\n":
        return OPEN | _LINE | _BLANK
    out = 0 if piece[-1].isalnum() else OPEN
    if piece[0].isspace():
        out |= _BLANK
    if piece[-1].isspace() or out & _BLANK and piece[1].isspace():
        out |= _ODD
    return out | _MARK if piece[0] in ",." else out


class KnownPieces(dict):
    """Numbers of pieces; an unseen one is learned when it is asked for."""

    def __init__(self, learn: Callable[[str], tuple[list[int], int]]) -> None:
        self.learn, self.flat, self.begin, self.flags = learn, array("i"), array("q", [0]), array("b")
        self.chars = 0

    def __missing__(self, piece: str) -> int:
        return self.add(piece, *self.learn(piece))

    def add(self, piece: str, ids: list[int], flags: int) -> int:
        self.flat.fromlist(ids)
        self.begin.append(len(self.flat))
        self.flags.append(flags)
        self.chars += len(piece)
        number = self[piece] = len(self)
        return number

    def odd(self, at: np.ndarray) -> np.ndarray:
        """Which of the pieces, side by side, the cuts do not suit: a mark is a pre-token of its own behind a letter or digit only, and of several blanks the last one alone is cut off."""
        f = np.frombuffer(self.flags, np.int8)[at]
        out = f & _ODD > 0
        out[1:] |= (f[:-1] & OPEN > 0) & (f[1:] & _MARK > 0)
        out[1:-1] |= (f[:-2] & _EMPTY > 0) & (f[1:-1] & _LINE > 0) & (f[2:] & _BLANK > 0)
        return np.flatnonzero(out)

    def ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces side by side, and where each piece's end."""
        begin = np.frombuffer(self.begin, np.int64)
        first = begin[at]
        n = begin[at + 1] - first
        ends = np.concatenate([[0], np.cumsum(n)])
        return np.frombuffer(self.flat, np.int32)[np.arange(ends[-1]) + np.repeat(first - ends[:-1], n)] if ends[-1] else np.zeros(0, np.int32), ends


def cut_pieces(text: str) -> list[str]:
    """A text's pieces, cut before blanks and marks and around line ends."""
    return text.replace(" ", "\1 ").replace(",", "\1,").replace(".", "\1.").replace("\n", "\1\n\1").split("\1")


class WordEncoder:
    """Ids of whole texts as numpy arrays, without special tokens around. Strings of added tokens get their ids as in the library where added is set, and are ordinary text otherwise."""

    def __init__(self, path: str, pieces: int = 500_000, added: bool = False) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.split, self.merge = tokenizer.pre_tokenizer.pre_tokenize_str, tokenizer.model.tokenize
        self.whole = tokenizer
        names = [re.escape(x.content) for x in tokenizer.get_added_tokens_decoder().values()] if added else []
        self.added = re.compile("|".join(names)) if names else None
        self.most = pieces
        self.letters = self._byte_letters()
        self.blank = self.letters[ord(" ")]
        self.known = KnownPieces(self._learn)

    def _byte_letters(self) -> dict[int, str]:
        """The letter that stands for each byte, read off the pre-tokenizer itself."""
        table = {}
        for code in range(0x800):
            char = chr(code)
            shown, raw = "".join(x for x, _ in self.split(char)), char.encode()
            if len(shown) == len(raw):
                table.update(zip(raw, shown, strict=True))
        return table

    def _learn(self, piece: str) -> tuple[list[int], int]:
        word = piece[1:] if piece[:1] == " " else piece
        if word.isascii() and word.isalpha():
            return [x.id for x in self.merge(piece if word is piece else self.blank + word)], 0
        if PLAIN.fullmatch(piece):
            return [x.id for x in self.merge(piece.encode().decode("latin-1").translate(self.letters))], 0
        return [x.id for letters, _ in self.split(piece) for x in self.merge(letters)], piece_flags(piece)

    def _numbers(self, pieces: list[list[str]]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, chain.from_iterable(pieces)), np.int32, sum(map(len, pieces)))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        held = [k for k, x in enumerate(texts) if x and self.added and self.added.search(x)]
        if not held:
            return self._encode(texts)
        rest = list(texts)
        for k in held:
            rest[k] = None
        out = self._encode(rest)
        for k in held:
            out[k] = np.array(self.whole.encode(texts[k], add_special_tokens=False).ids, np.int32)
        return out

    def _encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if not texts:
            return []
        if len(self.known) > self.most or len(self.known.flat) > 8 * self.most or self.known.chars > 16 * self.most:
            self.known = KnownPieces(self._learn)
        pieces = [cut_pieces(x) if x else [] for x in texts]
        at = self._numbers(pieces)
        edges = np.cumsum([0, *map(len, pieces)])
        again = np.unique(np.searchsorted(edges, self.known.odd(at), "right") - 1).tolist()
        again += [k for k, x in enumerate(texts) if x and "\1" in x]
        if again:  # texts that those cuts do not suit are cut before single blanks alone
            for k in again:
                pieces[k] = _CUT.split(texts[k])
            at = self._numbers(pieces)
            edges = np.cumsum([0, *map(len, pieces)])
        ids, ends = self.known.ids(at)
        return np.split(ids, ends[edges[1:-1]])


def byte_letters() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest in order from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


#: Latin letters that are single characters in lower case as well.
_LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-įı-ɏ]+")


class ChunkEncoder:
    """Ids of tokenizers that lower-case, drop white space and look up runs of letters: a text's ids are those of its chunks in order.

    Texts are cut at blanks, at line ends and before marks that follow a letter or digit. Only unseen chunks reach the library, and words of
    Latin letters its model alone.
    """

    def __init__(self, path: str, chunks: int = 1_000_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole, self.most = Tokenizer.from_file(path), chunks
        self.merge = self.whole.model.tokenize
        self.letters = {b: x for x, b in byte_letters().items()}
        self.size = self.whole.get_vocab_size()
        for text, cut in (("Ab çé", ["Ab", "çé"]), ("ab,cd.", ["ab", ",cd", "."])):
            if self._ids(text) != [x for chunk in cut for x in self._learn(chunk)[0]]:
                raise ValueError(f"{path}: the ids of a text are not those of its chunks")
        cut = [re.escape(x.content) for x in self.whole.get_added_tokens_decoder().values() if set(x.content) & set(",.\n")]
        self.whole_texts = re.compile("|".join(cut)) if cut else None
        self.known = KnownPieces(self._learn)

    def _ids(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids

    def _learn(self, chunk: str) -> tuple[list[int], int]:
        if chunk.isascii() and chunk.isalpha():
            return [x.id for x in self.merge(chunk.lower())], 0
        if _LATIN.fullmatch(chunk):
            return [x.id for x in self.merge(chunk.lower().encode().decode("latin-1").translate(self.letters))], 0
        flags = (0 if not chunk or chunk[-1].lower()[-1].isalnum() else OPEN) | (_MARK if chunk[:1] in (",", ".") else 0)
        return self._ids(chunk), flags

    def _numbers(self, chunks: list[list[str]]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, chain.from_iterable(chunks)), np.int32, sum(map(len, chunks)))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if not texts:
            return []
        if len(self.known) > self.most or len(self.known.flat) > 8 * self.most or self.known.chars > 16 * self.most:
            self.known = KnownPieces(self._learn)
        chunks = [x.replace("\n", "\1").replace(" ", "\1").replace(",", "\1,").replace(".", "\1.").split("\1") if x else [] for x in texts]
        at = self._numbers(chunks)
        edges = np.cumsum([0, *map(len, chunks)])
        again = np.unique(np.searchsorted(edges, self.known.odd(at), "right") - 1).tolist()
        again += [k for k, x in enumerate(texts) if x and ("\1" in x or self.whole_texts and self.whole_texts.search(x))]
        if again:  # a mark behind another mark, or an added token that holds one: cut at blanks alone
            for k in again:
                chunks[k] = texts[k].split(" ")
            at = self._numbers(chunks)
            edges = np.cumsum([0, *map(len, chunks)])
        ids, ends = self.known.ids(at)
        return np.split(ids, ends[edges[1:-1]])


def kept_encoder(kind: str, path: str, make: Callable[[], object]) -> object:
    """An encoder of this worker process: what it has learned serves the tasks that follow. It hangs on a module of the process, as functions that arrive by value have new globals each time."""
    kept = vars(sys).setdefault("_kinefold_encoders", {})
    if (kind, path) not in kept:
        kept[kind, path] = make()
    return kept[kind, path]


def shared_encoder(path: str) -> WordEncoder:
    """The word encoder of this process, added tokens matched."""
    return kept_encoder("words", path, lambda: WordEncoder(path, added=True))


def shared_chunk_encoder(path: str) -> ChunkEncoder:
    return kept_encoder("chunks", path, lambda: ChunkEncoder(path))
