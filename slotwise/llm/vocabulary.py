"""Token ids of whole texts by a public tokenizer file, each distinct word met once.

Texts of plain letters, digits and signs are cut at white space, where the tokenizers'
words end too; the library's model encodes the pieces a task hasn't met yet.  Any other
text (further scripts, control characters, special tokens) goes to the library whole.
Either way the ids are the library's.  What a worker remembers is bounded.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Iterable

import numpy as np

# The words of the two tokenizers' patterns, for the plain characters below.
_SPACE = "\t\n\x0b\x0c\r "
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-įı-ňŊ-ž"
_DIGIT = "0-9²³¹¼-¾"
_CUTS = "'s|'t|'re|'ve|'m|'ll|'d"
PLAIN = re.compile(f"[{_SPACE}\x21-\x7e¡-įı-ňŊ-ž]*")
LOWER_WORDS = re.compile(f"{_CUTS}|[{_LETTER}]+|[{_DIGIT}]|[^{_SPACE}{_LETTER}{_DIGIT}]+")
SPACED_WORDS = re.compile(
    f"{_CUTS}| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^{_SPACE}{_LETTER}{_DIGIT}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
SPACED_PIECES = re.compile(r" ?\S+|\s+(?!\S)|\s+")
_ODD_SPACE = ("  ", " \n", "\n\n", "\t", "\r", "\x0b", "\x0c")  # what needs the pattern to be cut
_MARKS = tuple(".,;:!?")  # a word and one of them are cut apart
KNOWN_MOST = 400_000  # pieces in each of the two generations a worker remembers
assert array("I").itemsize == 4 and sys.byteorder == "little"
MARK = "<|"  # begins every special token


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    """The tokenizer of a file, without truncation or padding, one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if visible, else one from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)]


class Memory(dict):
    """Remembers what it was asked lately: a full generation becomes the old one, the oldest goes."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def turn(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()

    def missing(self, wanted: set) -> list:
        """Of the wanted keys those not remembered; the others can be read until the next call."""
        self.turn()
        lacking = wanted - self.keys()
        for key in lacking & self.old.keys():
            self[key] = self.old[key]
        return list(lacking - self.old.keys())


class Pieces(Memory):
    """Makes what it is asked for and doesn't remember; ``turn`` between texts keeps it bounded."""

    def __init__(self, most: int, make):
        super().__init__(most)
        self.make = make

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        ids = self[piece] = self.make(piece) if ids is None else ids
        return ids


class WordIds:
    """Encodes texts into little-endian unsigned 32-bit ids, add_special_tokens=False."""

    def __init__(self, path: str, lower: bool):
        self.tokenizer = load(path)
        self.model = self.tokenizer.model
        self.lower = lower  # a lower-casing tokenizer that drops white space
        self.words = (LOWER_WORDS if lower else SPACED_WORDS).findall
        self.letters = dict(enumerate(byte_letters()))
        self.space = self.letters[ord(" ")]
        self.known = Pieces(KNOWN_MOST, self._apart)
        self.after_space = Pieces(KNOWN_MOST, self._spaced)

    def _apart(self, piece: str) -> bytes:
        """Ids of a piece at the beginning of a text or line, or of any if the tokenizer drops white space."""
        word, mark = piece[:-1], piece[-1:]
        if mark in _MARKS and word.isalpha():
            return self.known[word] + self.known[mark]
        return self._ids((piece,) if piece.isalpha() else self.words(piece))

    def _spaced(self, piece: str) -> bytes:
        """Ids of a space and a piece, or of a piece that begins with a line end."""
        if piece[:1] == "\n":
            return self.known["\n"] + self.known[piece[1:]] if len(piece) > 1 else self.known["\n"]
        word, mark = piece[:-1], piece[-1:]
        if mark in _MARKS and word.isalpha():
            return self.after_space[word] + self.known[mark]
        if piece.isalpha() and piece.isascii():
            return array("I", [t.id for t in self.model.tokenize(self.space + piece)]).tobytes()
        return self._ids(self.words(" " + piece))

    def _ids(self, words: Iterable[str]) -> bytes:
        tokenize, letters = self.model.tokenize, self.letters
        spelled = [w if w.isalpha() and w.isascii() else w.encode().decode("latin-1").translate(letters) for w in words]
        return array("I", [t.id for w in spelled for t in tokenize(w)]).tobytes()

    def _plain(self, text: str) -> bytes:
        """Ids of a plain text: of parts whose ids don't depend on each other."""
        known = self.known.__getitem__
        if self.lower:
            return b"".join(map(known, text.lower().split()))
        if text.endswith((" ", "\n")) or any(map(text.__contains__, _ODD_SPACE)):
            return b"".join(map(known, SPACED_PIECES.findall(text)))
        first, *rest = text.replace("\n", " \n").split(" ")  # a space or line end stays with what follows it
        return b"".join([known(first), *map(self.after_space.__getitem__, rest)])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        whole = []
        for i, text in enumerate(texts):
            if not text:
                continue
            if MARK in text or not PLAIN.fullmatch(text):
                whole.append(i)
            else:
                out[i] = self._plain(text)
                self.known.turn()
                self.after_space.turn()
        for i, found in zip(whole, self.tokenizer.encode_batch([texts[i] for i in whole], add_special_tokens=False)):
            out[i] = np.array(found.ids, "<u4").tobytes()
        return out


_loaded: dict[tuple[str, bool], WordIds] = {}


def word_ids(path: str, lower: bool) -> WordIds:
    """The encoder of a file, one per worker process."""
    if (path, lower) not in _loaded:
        _loaded[path, lower] = WordIds(path, lower)
    return _loaded[path, lower]


def runs(texts: list[str | None], most: int = 1 << 21):
    """Start and end of runs of texts of about ``most`` characters; a longer text comes alone."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if i > first and size + n > most:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(texts):
        yield first, len(texts)
