"""Hashed text features: words and their stems, and the look of words."""

from __future__ import annotations

import re
from collections import Counter
from itertools import islice
from operator import eq

import numpy as np
import xxhash

_LETTERS = re.compile(r"\w+")
#: Hash seeds of the kinds of features, and tokens remembered per task.
WORD_SEED, SHAPE_SEED = 1, 2
STEMS = (4, 5)  # letters; also their hash seeds
MEMORY = 200_000
REPEATED = 7  # a fixed feature number: share of words equal to the one before
_RUN = re.compile(r"(.)\1+")


def _hash(text: str, seed: int) -> int:
    # 60 bits: words practically never share a feature, so a clean word does not inherit a weight.
    return (xxhash.xxh3_64_intdigest(text, seed) >> 4) + 16


def word_features(token: str) -> tuple[int, ...]:
    """Of one white-space token, lower-cased: its words and their first four and five letters."""
    out = []
    for word in (token,) if token.isalnum() else _LETTERS.findall(token):
        out.append(_hash(word, WORD_SEED))
        for n in STEMS:
            if len(word) > n:
                out.append(_hash(word[:n], n))
    return tuple(out)


class _Classes(dict):
    """For ``str.translate``: letters to A or a, digits to 0, white space and the rest as they are."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        found = self[code] = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        return found


_CLASSES = _Classes()


def shape(classes: str) -> str:
    """The look of a whole token from its character classes, runs to one: ``THAT!!`` is ``A!``, ``word.`` is ``a.``."""
    return _RUN.sub(r"\1", classes)


def shape_features(classes: str) -> tuple[int, ...]:
    return (_hash(shape(classes), SHAPE_SEED),)


class Memory(dict):
    """Features of a token, made on first use; starts afresh when full."""

    def __init__(self, make, weights: dict[int, float] | None = None):
        super().__init__()
        self.make, self.weights = make, weights

    def __missing__(self, token: str):
        if len(self) >= MEMORY:
            self.clear()
        found = self.make(token)
        if self.weights is not None:  # only what weighs something
            found = tuple(f for f in found if f in self.weights)
        self[token] = found
        return found


def presence(text: str, memory: Memory) -> set[int]:
    """Word and stem features of the whole text."""
    out: set[int] = set()
    for token in set(text.lower().split()):
        out.update(memory[token])
    return out


def looks(text: str, memory: Memory) -> dict[int, float]:
    """Share of the words with each shape, and of words that repeat the one before; square roots, so that few count."""
    tokens = text.split()
    if not tokens:
        return {}
    sums: Counter[int] = Counter()
    for classes, n in Counter(text.translate(_CLASSES).split()).items():
        for f in memory[classes]:
            sums[f] += n
    repeated = sum(map(eq, tokens, islice(tokens, 1, None)))
    if repeated:
        sums[REPEATED] = repeated
    return {f: float(np.sqrt(n / len(tokens))) for f, n in sums.items()}
