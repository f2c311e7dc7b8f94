"""One-permutation MinHash fingerprints with optimal densification and packed low-order bits."""

from __future__ import annotations

import numpy as np
import xxhash

from tidewater.llm.common import ascii_words, word_shingles

BINS = 512  # a power of two
BITS = 4  # low-order bits kept of each bin's minimum
WIDTH = 5
SEED = 20

_BIN_BITS = BINS.bit_length() - 1


ROUNDS = 64  # of asking, made at a time
_asked: list[np.ndarray] = []


def _donors(chunk: int) -> np.ndarray:
    """donors[r, b]: the bin that empty bin ``b`` asks in round ``chunk * ROUNDS + r``; one fixed universal hash for all texts."""
    while len(_asked) <= chunk:
        r = np.arange(len(_asked) * ROUNDS, (len(_asked) + 1) * ROUNDS, dtype=np.uint64)[:, None]
        b = np.arange(BINS, dtype=np.uint64)[None, :]
        x = (r << np.uint64(32)) + b + np.uint64(1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)  # splitmix64
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        _asked.append(((x ^ (x >> np.uint64(31))) >> np.uint64(64 - _BIN_BITS)).astype(np.int16))
    return _asked[chunk]


def densified(values: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Every empty bin asks bins in a fixed pseudo-random order of its own until it finds a filled one.

    Rounds are made as they are needed, so every bin ends filled from the bin it
    found: with k filled bins one round in ``BINS / k`` hits.  One filled bin
    fills all without asking.
    """
    out = values.copy()
    have = np.flatnonzero(filled)
    if len(have) == 1:
        out[:] = values[have[0]]
        return out
    empty, chunk = np.flatnonzero(~filled), 0
    while len(empty):
        donors = _donors(chunk)[:, empty]
        hits = filled[donors]
        found = hits.any(axis=0)
        first = hits.argmax(axis=0)
        out[empty[found]] = values[donors[first[found], np.flatnonzero(found)]]
        empty, chunk = empty[~found], chunk + 1
    return out


def minima(text: str) -> np.ndarray | None:
    """The smallest shingle hash of every bin, empty bins filled; None for a text without words.

    Each shingle is hashed once: the top bits choose its bin, the rest is its
    value.  Empty bins are filled by optimal densification (``densified``), so
    two texts make the same choice exactly when their filled bins allow it.
    """
    shingles = word_shingles(ascii_words(text), WIDTH)
    if not shingles:
        return None
    digest = xxhash.xxh3_64_intdigest
    hashes = np.sort(np.array([digest(s, SEED) for s in set(shingles)], dtype=np.uint64))
    bins = (hashes >> np.uint64(64 - _BIN_BITS)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
    values = np.zeros(BINS, np.uint64)
    filled = np.zeros(BINS, bool)
    values[bins[first]], filled[bins[first]] = hashes[first], True
    return densified(values, filled)


def pack(values: np.ndarray | None) -> bytes:
    """The low bits of every bin's minimum, two bins to a byte; no bytes for a text without words."""
    if values is None:
        return b""
    # The low bits of the raw hash are shared by nothing but the same shingle.
    low = (values & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return (low[0::2] << 4 | low[1::2]).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Estimated share of common shingles (Jaccard), from the share of equal bins.

    Bins of unlike minima agree by chance in one of ``2 ** BITS`` cases; that
    share is taken off.  Two texts without words are alike, one is unlike any other.
    """
    if not a or not b:
        return float(a == b)
    x = np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)
    equal = ((x & 15 == 0).sum() + (x >> 4 == 0).sum()) / BINS
    chance = 1.0 / (1 << BITS)
    return float(max(0.0, (equal - chance) / (1.0 - chance)))
