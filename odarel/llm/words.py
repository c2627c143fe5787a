"""Words of a text as 64-bit hashes, and hashes of runs of words."""

from __future__ import annotations

from functools import cache

import numpy as np

#: A-Z to lower case; every other ASCII byte but digits and letters to a space.
#: Bytes from 0x80 on, so all non-ASCII characters, belong to words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: ASCII white space to a space, all else as it is.
SPLIT = bytes(32 if c in b" \t\n\r\x0b\x0c" else c for c in range(256))
#: Bytes hashed at once; a piece ends between words.
PIECE = 1 << 20

_BYTES = np.random.default_rng(23).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    """The first n powers of _BASE modulo 2**64."""
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            steps = np.full(max(n, 64), _BASE)
            steps[0] = 1
            _powers = np.multiply.accumulate(steps)
    return _powers[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread each hash over all its bits."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(31))
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def _hash_piece(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    inside = data != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.concatenate([[0], edges])
    if inside[-1]:
        edges = np.concatenate([edges, [len(data)]])
    lengths = edges[1::2] - edges[0::2]
    if not len(lengths):
        return np.zeros(0, np.uint64)
    begin = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum())) - np.repeat(begin, lengths)
    with np.errstate(over="ignore"):
        values = _BYTES[data[inside]] * _power(int(lengths.max()))[at]
        return mix(np.add.reduceat(values, begin) + lengths.astype(np.uint64))


def word_hashes(raw: bytes, table: bytes = FOLD) -> np.ndarray:
    """A hash per word of UTF-8 bytes, in order; ``table`` maps what separates words to a space.

    A word's bytes are digits of a number in a fixed odd base, each byte standing for
    64 random bits; all words of a piece are summed up at once.
    """
    raw = raw.translate(table)
    if len(raw) <= PIECE:
        return _hash_piece(raw) if raw else np.zeros(0, np.uint64)
    out, at = [], 0
    while at < len(raw):
        end = len(raw) if at + PIECE >= len(raw) else raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        out.append(_hash_piece(raw[at:end]))
        at = end + 1
    return np.concatenate(out)


def text_hashes(text: str | None, table: bytes = FOLD) -> np.ndarray:
    """With the default table: of the words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, A-Z in lower case."""
    return word_hashes(text.encode("utf-8", "surrogatepass"), table) if text else np.zeros(0, np.uint64)


@cache
def multipliers(k: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash for each run of k words, mixed so that any bits of it serve."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i, m in enumerate(multipliers(k, seed)):
            out += words[i : i + n] * m
    return mix(out)
