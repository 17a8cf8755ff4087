"""Token ids of whole texts by public tokenizers, piece by piece.

Encoding is local: no token reaches over the blank before a word. A text is therefore cut at its blanks,
each different piece is encoded once by the library and remembered, and the ids of a text are those of its
pieces in order. A text with white space of another shape is given to the library whole, so the ids are
always those of encoding the whole text.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex

from kerbwise.llm import words as W

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces remembered by one worker, some 150 bytes each. Half of them are dropped at a time, those not met lately.
REMEMBERED = 1_200_000
#: White space other than one blank, or one line feed, between two words; beyond ASCII by its UTF-8 bytes.
DOUBLED = [b"  ", b"\n\n", b" \n", b"\n "]
CONTROLS = [bytes([c]) for c in (*range(9, 10), *range(11, 14), *range(28, 32))]
WIDE_SPACE = [b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80"]
GENERAL_SPACE = re.compile(rb"\xe2\x80[\x80-\x8a\xa8\xa9\xaf]")
#: Characters below U+0250 but for control characters: composed already, and lower-cased one by one.
PLAIN = re.compile("[\x09-\x0d\x20-\x7e\xa0-\u024f]*")


def other_space(text: bytes) -> bool:
    if text[:1] in (b" ", b"\n") or text[-1:] in (b" ", b"\n") or any(c in text for c in DOUBLED) or any(c in text for c in CONTROLS):
        return True
    if text.isascii():
        return False
    return any(c in text for c in WIDE_SPACE) or (b"\xe2\x80" in text and GENERAL_SPACE.search(text) is not None)


class Remembered(dict):
    """Ids of each piece met, as bytes of little-endian unsigned 32-bit numbers; ``ids`` gives those of a new one."""

    def __init__(self, ids: Callable, limit: int = REMEMBERED):
        super().__init__()
        self.ids, self.half, self.old = ids, limit // 2, {}

    def __missing__(self, piece):
        found = self.old.get(piece) or self.ids(piece)
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[piece] = found
        return found


class Encoder:
    """Ids of texts, as bytes of little-endian unsigned 32-bit numbers."""

    def __init__(self):
        self.known = Remembered(self.piece)

    def split(self, text: bytes) -> list[bytes] | None:
        """Pieces of a text; None if it must be encoded whole. A piece that does not begin with a line feed stands
        for itself after a blank."""
        return None if other_space(text) else text.replace(b"\n", b" \n").split(b" ")

    def piece(self, piece: bytes) -> bytes:
        raise NotImplementedError

    def whole(self, text: bytes) -> list[int]:
        raise NotImplementedError

    def encode(self, text: bytes) -> bytes:
        pieces = self.split(text)
        return array("I", self.whole(text)).tobytes() if pieces is None else b"".join(map(self.known.__getitem__, pieces))


def byte_letters() -> dict[int, str]:
    """How vocabularies of byte pairs write each byte: printable Latin-1 characters as themselves, the other bytes,
    in order, as the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(plain)))}


class LibraryBpe(Encoder):
    """Byte pairs of the tokenizers library. The runs that ``pattern`` finds in a piece of plain characters are given to
    the library's model one by one; other pieces go through the whole library."""

    pattern: re.Pattern

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.letters = byte_letters()
        self.runs = Remembered(self.run, REMEMBERED // 4)

    def run(self, run: str) -> bytes:
        if not run.isascii() or " " in run or "\n" in run:
            run = run.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(run)]).tobytes()

    @property
    def size(self) -> int:
        return self.library.get_vocab_size()


class WordBpe(LibraryBpe):
    """A tokenizer that drops white space (``word_bpe_49k.json``): words are pieces, whatever stands between them.
    Composed characters, lower case and the splitting pattern never look over an ASCII blank."""

    pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")

    def split(self, text: bytes) -> list[bytes]:
        return (text if b"<|" in text else text.lower()).split()  # a special token is told by its letters' case

    def piece(self, piece: bytes) -> bytes:
        text = piece.decode()
        if text.isalpha() and text.isascii():
            return self.runs[text.lower()]
        if PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join([self.runs[r] for r in self.pattern.findall(text.lower())])
        return array("I", self.whole(piece)).tobytes()

    def whole(self, text: bytes) -> list[int]:
        return self.library.encode(text.decode(), add_special_tokens=False).ids


class ByteBpe(LibraryBpe):
    """Byte pairs (``byte_bpe_50k.json``) of a blank and the text. Strings of special tokens are plain text. A run of
    the splitting pattern takes the one blank before it and never one after it."""

    pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

    def __init__(self, path: str):
        super().__init__(path)
        self.library.encode_special_tokens = True

    def piece(self, piece: bytes) -> bytes:
        text = piece.decode()
        if text.isalpha() and text.isascii():
            return self.runs[" " + text]
        text = text if text[:1] == "\n" else " " + text
        if PLAIN.fullmatch(text):
            return b"".join([self.runs[r] for r in self.pattern.findall(text)])
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def whole(self, text: bytes) -> list[int]:
        return self.library.encode(" " + text.decode(), add_special_tokens=False).ids

    def token_bytes(self) -> list[bytes]:
        byte = {c: b for b, c in self.letters.items()}
        entries = {i: t for t, i in self.library.get_vocab().items()}
        return [bytes(byte.get(c, 63) for c in entries.get(i, "")) for i in range(max(entries) + 1)]


class PieceBpe(Encoder):
    """Sentence pieces (``piece_bpe_32k.model``), which put a blank before the text by themselves. A merge is a piece of
    the vocabulary; where none holds a blank after another character, or a line feed, no merge reaches over them."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        entries = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.local = not any("\n" in p or "▁" in p.lstrip("▁") for p in entries)
        self.blank = self.library.piece_to_id("▁")
        self.entries = entries

    def split(self, text: bytes) -> list[bytes] | None:
        return super().split(text) if self.local and b"\xe2\x96\x81" not in text else None

    def piece(self, piece: bytes) -> bytes:
        ids = self.library.encode(piece.decode())
        return array("I", ids[1:] if piece[:1] == b"\n" and ids[0] == self.blank else ids).tobytes()

    def whole(self, text: bytes) -> list[int]:
        return self.library.encode(text.decode())

    def token_bytes(self) -> list[bytes]:
        one = re.compile("<0x([0-9A-Fa-f]{2})>")
        return [bytes([int(m[1], 16)]) if (m := one.fullmatch(p)) else p.replace("▁", " ").encode() for p in self.entries]


class Pair(Encoder):
    """A byte-level and a sentence-piece tokenizer at once: each piece is looked up once for both. A piece's numbers are the ids of
    the first, a mark, the ids of the second, a mark."""

    MARK = 0xFFFFFFFF

    def __init__(self, first: ByteBpe, second: PieceBpe, limit: int = REMEMBERED // 2):
        self.first, self.second = first, second
        self.known = Remembered(self.piece, limit)
        self.mark = array("I", [self.MARK]).tobytes()

    def piece(self, piece: bytes) -> bytes:
        return self.first.piece(piece) + self.mark + self.second.piece(piece) + self.mark

    def split(self, text: bytes) -> list[bytes] | None:
        return self.second.split(text)  # the first takes any text without other white space

    def whole(self, text: bytes) -> list[int]:
        return [*self.first.whole(text), self.MARK, *self.second.whole(text), self.MARK]

    def both(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each tokenizer all ids of the texts, and where each text's begin and end."""
        found = [self.encode(t) if t else b"" for t in texts]
        numbers = np.frombuffer(b"".join(found), "<u4")
        mark = numbers == self.MARK
        side = np.cumsum(mark) & 1
        at = np.cumsum([0, *[len(x) // 4 for x in found]])
        out = []
        for i in (0, 1):
            own = ~mark & (side == i)
            out.append((numbers[own].astype(np.int32), np.r_[0, np.cumsum(own)][at].astype(np.int32)))
        return out


_held: dict[tuple[type, str], Encoder] = {}


def held(kind: type, path: str) -> Encoder:
    """The encoder of this worker, kept between tasks."""
    if (kind, path) not in _held:
        _held[kind, path] = kind(path)
    return _held[kind, path]


def held_pair(byte_path: str, piece_path: str) -> Pair:
    if (Pair, byte_path + piece_path) not in _held:
        _held[Pair, byte_path + piece_path] = Pair(held(ByteBpe, byte_path), held(PieceBpe, piece_path))
    return _held[Pair, byte_path + piece_path]


def runs(texts: pa.Array):
    """Whole texts in runs of about a megabyte: first row, the texts as bytes (null as empty)."""
    for row, data, offsets in W.chunks(texts):
        flat = data.tobytes()
        yield row, [flat[i:j] for i, j in zip(offsets[:-1], offsets[1:])]
