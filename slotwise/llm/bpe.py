"""BPE encoding over a trie of words, and decoding.

The distinct words of a run of texts form a trie; sorted, they are that trie read depth
first.  On the way down each prefix keeps the last token of its encoding: a prefix's
encoding is that of a shorter prefix plus one token, and exactly one token that ends it
can stand next to the shorter prefix's last token.  So a shared prefix is encoded once,
and a word's tokens are read off from its end.

Two tokens can stand side by side if no merge would have crossed the border between them
while they were put together: the pieces that lie left and right of the border, in the
order in which their merges happen, must never be a pair of an earlier merge.

Texts are cut into words as the tokenizer's file says: by the pattern for plain texts
(see ``vocabulary``), by the library's normaliser and pre-tokenizer for others.

Defined cases: a null text counts as empty; an empty text has no ids and decodes to an
empty text; special tokens written in a text are single ids; equal texts get equal rows;
a word of any length is one path of the trie; further columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.store import in_small_batches
from slotwise.llm.vocabulary import LOWER_WORDS, MARK, PLAIN, Memory, byte_letters, load, runs

KNOWN_MOST = 400_000  # words in each of the two generations a worker remembers
NEIGHBOURS_MOST = 500_000  # pairs of tokens it remembers


class Place:
    """A beginning of tokens with the tokens that end there, longest first, and the places one letter on."""

    __slots__ = ("letters", "inner", "last", "after")

    def __init__(self, letters: str, inner: list, last: list):
        self.letters, self.inner, self.last = letters, inner, last
        self.after: dict[str, Place] = {}


class Merges:
    """Tokens of a BPE file whose words end in a suffix, with their merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {pair: i for i, pair in reversed(list(enumerate(pairs)))}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {**self.ids, **self.specials}
        self.inner: dict[str, str] = {}  # letters to token, inside a word
        self.last: dict[str, str] = {}  # letters to token, at the end of a word
        self._left: dict[str, list[tuple[str, int]]] = {}
        self._right: dict[str, list[tuple[str, int]]] = {}
        made_by = {}
        for i, (a, b) in reversed(list(enumerate(pairs))):
            made_by[a + b] = (a, b, i)
        self._made_by = made_by
        twice = {a + b for a, b in pairs if self.rank[a, b] != made_by[a + b][2]}
        for token in self.ids:
            if token in self.specials:
                continue
            if token in twice and not self._derive(token):
                continue
            ends = bool(self.end) and token.endswith(self.end)
            letters = token[: -len(self.end)] if ends else token
            if token in made_by or len(letters) == 1:
                (self.last if ends else self.inner)[letters] = token
        if not self.end:
            self.last = self.inner
        self._starts = {t[:n] for t in [*self.inner, *self.last] for n in range(len(t) + 1)}
        self._places: dict[str, Place] = {}
        self._lefts: dict[str, dict[str, bool]] = {}  # by token: which others can stand left of it
        self._met = 0

    def _derive(self, token: str) -> bool:
        """For a token that several merges make: the merge its own letters lead to."""
        ends = self.end and token.endswith(self.end)
        parts = list(token[: -len(self.end)]) if ends else list(token)
        if ends:
            parts[-1] += self.end
        while len(parts) > 1:
            ranked = [(self.rank.get((a, b), len(self.rank)), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, i = min(ranked)
            if rank == len(self.rank):
                return False
            if len(parts) == 2:
                self._made_by[token] = (*parts, rank)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return True

    def _spine(self, token: str, side: int) -> list[tuple[str, int]]:
        """Pieces of a token at its left (0) or right (1) border, smallest first, with the rank that made each."""
        held = self._right if side else self._left
        if token not in held:
            made = self._made_by.get(token)
            below = self._spine(made[side], side) if made else []
            held[token] = [*below, (token, made[2] if made else -1)]
        return held[token]

    def place(self, letters: str) -> Place:
        """Where a reader stands after these letters: at their longest end that begins a token."""
        while letters not in self._starts:
            letters = letters[1:]
        if letters not in self._places:
            ends = [letters[i:] for i in range(len(letters))]
            inner, last = ([self._ending(held[e], len(e)) for e in ends if e in held] for held in (self.inner, self.last))
            self._places[letters] = Place(letters, inner, last)
        return self._places[letters]

    def _ending(self, token: str, length: int) -> tuple[int, str, dict[str, bool]]:
        return length, token, self._lefts.setdefault(token, {})

    def meets(self, left: str, right: str) -> bool:
        """Whether the two tokens can be neighbours in an encoding; remembered by the right one."""
        if self._met > NEIGHBOURS_MOST:
            for lefts in self._lefts.values():
                lefts.clear()
            self._met = 0
        self._met += 1
        met = self._lefts.setdefault(right, {})[left] = self._no_merge_across(left, right)
        return met

    def _no_merge_across(self, left: str, right: str) -> bool:
        a, b = self._spine(left, 1), self._spine(right, 0)
        never = len(self.rank)
        i = j = 0
        while True:
            crossing = self.rank.get((a[i][0], b[j][0]), never)
            next_a = a[i + 1][1] if i + 1 < len(a) else never
            next_b = b[j + 1][1] if j + 1 < len(b) else never
            # Of equal merges the leftmost comes first: the left token's own, then the crossing one.
            if crossing < next_a and crossing <= next_b and crossing < never:
                return False
            if next_a == never and next_b == never:
                return True
            if next_a <= next_b:
                i += 1
            else:
                j += 1


def encode_words(words: Iterator[str], merges: Merges) -> Iterator[tuple[str, list[str]]]:
    """Each word (as byte letters) with its tokens; sorted words share their prefixes."""
    path = ""
    state: list[str] = [""]  # last token of each prefix of the path
    places = [merges.place("")]  # and where the reader of the tokens stands there
    meets, suffix = merges.meets, len(merges.end)
    for word in sorted(words):
        n = len(word)
        same = 0
        top = min(n - 1, len(path))
        while same < top and path[same] == word[same]:
            same += 1
        del state[same + 1 :], places[same + 1 :]
        for end in range(same + 1, n):
            place = _next_place(places[-1], word[end - 1], merges)
            places.append(place)
            state.append(_last_token(word, end, state, place.inner, meets))
        path = word[: n - 1]
        token = _last_token(word, n, state, _next_place(places[-1], word[-1], merges).last, meets)
        tokens = [token]
        at = n - len(token) + suffix
        while at > 0:
            token = state[at]
            tokens.append(token)
            at -= len(token)
        yield word, tokens[::-1]


def _next_place(place: Place, letter: str, merges: Merges) -> Place:
    after = place.after.get(letter)
    if after is None:
        after = place.after[letter] = merges.place(place.letters + letter)
    return after


def _last_token(word, end, state, endings, meets) -> str:
    for length, token, lefts in endings:
        if length == end:
            return token
        left = state[end - length]
        met = lefts.get(left)
        if met or met is None and meets(left, token):
            return token
    raise ValueError(f"no token ends {word[:end]!r}; the file lacks a letter")


class TrieEncoder:
    """Encodes and decodes texts with the merges of one file."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.library = load(path)
        self.letters = byte_letters()
        self.specials = re.compile("|".join(map(re.escape, sorted(self.merges.specials, key=len, reverse=True))) or "(?!)")
        self.numbers = {i: str(i) for i in self.merges.ids.values()}  # of an id: its text form
        self.tokens = {i: t for t, i in self.merges.ids.items()}
        self.plain = Memory(KNOWN_MOST)  # ids of a piece of plain text, four bytes each
        self.other = Memory(KNOWN_MOST)  # the same by word of another text

    def _spell(self, word: str) -> str:
        if word.isascii():  # visible letters stand for themselves
            return word
        letters = self.letters
        return "".join([letters[b] for b in word.encode()])

    def _other_words(self, text: str) -> list[str]:
        """Words, as byte letters, of a text that the plain pattern can't cut; specials as they are."""
        out, at = [], 0
        for special in [*self.specials.finditer(text), None]:
            part = text[at : special.start() if special else len(text)]
            normal = self.library.normalizer.normalize_str(part) if self.library.normalizer else part
            out += [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)] if normal else []
            if special:
                out.append(special.group())
                at = special.end()
        return out

    def encode(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """Per text: how many ids, the ids joined by a space, the tokens joined by a space."""
        cut = []
        for text in texts:
            if not text or (MARK not in text and PLAIN.fullmatch(text)):
                cut.append((self.plain, (text or "").lower().split()))
            else:
                cut.append((self.other, self._other_words(text)))
        words_of = {p: self._plain_words(p) for p in self._missing(self.plain, cut)}
        words_of_other = {w: [w] for w in self._missing(self.other, cut)}
        every = set().union(*words_of.values(), words_of_other)
        ids = self.merges.ids
        codes = {s: [ids[s]] for s in every & self.merges.specials.keys() & words_of_other.keys()}
        codes.update((w, [ids[t] for t in tokens]) for w, tokens in encode_words(every - codes.keys(), self.merges))
        for held, new in ((self.plain, words_of), (self.other, words_of_other)):
            for piece, words in new.items():
                held[piece] = array("I", [i for w in words for i in codes[w]]).tobytes()
        number, token = self.numbers.__getitem__, self.tokens.__getitem__
        for held, pieces in cut:
            found = array("I", b"".join([held[p] for p in pieces]))
            yield len(found), " ".join(map(number, found)), " ".join(map(token, found))

    def _plain_words(self, piece: str) -> list[str]:
        """Words, as byte letters, of a piece without white space."""
        return [piece] if piece.isascii() and piece.isalpha() else [self._spell(w) for w in LOWER_WORDS.findall(piece)]

    @staticmethod
    def _missing(held: Memory, cut: list) -> list[str]:
        return held.missing(set().union(*[pieces for into, pieces in cut if into is held]))


_loaded: dict[str, TrieEncoder] = {}


def trie_encoder(path: str) -> TrieEncoder:
    if path not in _loaded:
        _loaded[path] = TrieEncoder(path)
    return _loaded[path]


def encoded(docs: DataFrame, path: str, digests: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens and either (ids, decoded) or the SHA-256 of both.

    Decoding joins the tokens' texts by a space, as the library does for a file without
    a decoder.  ``ids`` are in their text form, joined by a space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = trie_encoder(path)
        show = (lambda s: hashlib.sha256(s.encode()).hexdigest()) if digests else (lambda s: s)
        for batch in batches:
            texts, names = batch.column("text").to_pylist(), batch.column("doc_id")
            for start, end in runs(texts):
                rows = [(n, show(i), show(d)) for n, i, d in encoder.encode(texts[start:end])]
                yield pa.RecordBatch.from_arrays(
                    [
                        names.slice(start, end - start),
                        pa.array([r[0] for r in rows], pa.int64()),
                        pa.array([r[1] for r in rows], pa.string()),
                        pa.array([r[2] for r in rows], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids", "decoded"],
                )

    rows = in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, "doc_id long, n_tokens long, ids string, decoded string")
    if digests:
        out = out.withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})
    return out
