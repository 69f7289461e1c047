"""Fingerprints of the words and word shingles of whole texts, vectorised with numpy.

A word is a run of bytes other than space and \\x09-\\x0D, with A-Z lowered.  Its
fingerprint is a polynomial over random 64-bit letters, mixed; two different words
share one with a probability near 2**-64.  Texts are hashed in slabs of a few MB, cut
between words, so memory does not follow the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SLAB = 1 << 21  # bytes hashed at once
U = np.uint64

_rng = np.random.default_rng(20240607)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_LETTER = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1]
_LETTER[SPACE] = 0
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_TRIPLE = [U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB)]
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLAB + 4096)
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers.append(np.cumprod(steps, dtype=np.uint64))
        del _powers[:-2]
    return _powers


def slab_words(slab: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the words of a slab, and where each begins."""
    b = np.frombuffer(slab, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    power, inverse = _power_tables(len(b) + 1)
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = ~SPACE[b]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_LETTER[b] * power[: len(b)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64)), start


def words_of(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of whole texts: first text, word fingerprints, bounds of each text in them.

    A text longer than a slab comes alone, hashed piece by piece; null is an empty text.
    """
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        if held and size + len(raw) > SLAB:
            yield first, *_joined(held)
            first, held, size = i, [], 0
        if len(raw) > SLAB:
            words = np.concatenate([slab_words(piece)[0] for piece in _pieces(raw)])
            yield i, words, np.array([0, len(words)])
            first = i + 1
            continue
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield first, *_joined(held)


def _joined(held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    words, start = slab_words(b" ".join(held))
    ends = np.cumsum([len(x) + 1 for x in held])
    return words, np.concatenate([[0], np.searchsorted(start, ends)])


def _pieces(raw: bytes) -> Iterator[bytes]:
    """Cuts of about a slab, each between two words."""
    at = 0
    while at < len(raw):
        end = at + SLAB
        while end < len(raw) and not SPACE[raw[end]]:
            end += 1
        yield raw[at:end]
        at = end


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """One fingerprint per run of ``k`` words of one text; a shorter text is one run itself."""
    n = len(words)
    if n == 0:
        return words
    if n < k:
        return mix(np.array([int((words * odd_numbers(n)).sum()) + n & (1 << 64) - 1], np.uint64))
    out = np.zeros(n - k + 1, np.uint64)
    for i, odd in enumerate(odd_numbers(k)):
        out += words[i : n - k + 1 + i] * odd
    return mix(out)


def odd_numbers(n: int) -> np.ndarray:
    """``n`` fixed odd multipliers."""
    if n <= len(_TRIPLE):
        return np.array(_TRIPLE[:n])
    return np.concatenate([_TRIPLE, mix(np.arange(n - len(_TRIPLE), dtype=np.uint64) + U(77)) | U(1)])
