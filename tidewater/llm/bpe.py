"""Byte-level BPE with a whole-token shortcut.

Offline, on the driver, every vocabulary string is encoded alone by the
tokenizer; those that come back as exactly their own id are *whole tokens*.
BPE merges never cross a pre-token, so a pre-token that is a whole token is
that one id wherever it stands.  In the tasks a text is cut into pre-tokens,
whole tokens are looked up, and only the rest is merged.  Where the vocabulary
numbers its merges in order (checked offline), the rest goes through the rank
merges of ``tiktoken``, which then are the same merges; else through the tokenizer.

Cutting a text costs more than looking its pieces up, so ordinary text is cut
at single spaces and single line ends by ``str.split``: between two non-white
characters a lone space always starts the next pre-token and a lone line end
is a pre-token of its own.  Text with any other white space next to white
space is cut by the pre-token pattern itself.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from functools import lru_cache

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

# Fixed value: the published pre-token pattern of byte-level BPE.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
UNEVEN_SPACE = re.compile(r"\s\s|\A\s|\s\Z")
#: White space for Python but not for the tokenizer; texts with these go to the tokenizer whole.
SEPARATORS = re.compile("[\x1c-\x1f]")
#: Units remembered per task; beyond it the memory starts afresh (results do not depend on it).
MEMORY = 300_000


def special_strings(path: str) -> dict[str, int]:
    """Special strings the tokenizer finds inside texts; refuses tokenizers that this module does not reproduce."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError(f"{path}: a byte-level BPE tokenizer without normaliser and prefix space is needed")
    added = spec.get("added_tokens") or []
    if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{path}: added tokens with matching rules are not supported")
    return {t["content"]: t["id"] for t in added}


@lru_cache(maxsize=4)
def whole_tokens(path: str) -> dict[str, int]:
    """Vocabulary strings proved to encode alone as their own single id."""
    tokenizer = Tokenizer.from_file(path)
    special = special_strings(path)
    ids = sorted(tokenizer.get_vocab().values())
    strings = [tokenizer.decode([i], skip_special_tokens=False) for i in ids]
    sound = [(i, s) for i, s in zip(ids, strings) if s and "�" not in s and s not in special]
    proofs = tokenizer.encode_batch([s for _, s in sound], add_special_tokens=False)
    return {s: i for (i, s), e in zip(sound, proofs) if e.ids == [i] and PRETOKEN.fullmatch(s)}


def _byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def rank_merges(path: str) -> tiktoken.Encoding | None:
    """The vocabulary as merge ranks, if merging by rank is merging in the tokenizer's order; else None."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    if model.get("type") != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix"):
        return None
    vocabulary = model["vocab"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [vocabulary["".join(p)] for p in pairs]
    special = special_strings(path)
    plain = {t: i for t, i in vocabulary.items() if t not in special}
    alphabet = _byte_alphabet()
    if made != sorted(set(made)) or len(plain) != len(made) + 256 or any(len(t) > 1 and i < made[0] for t, i in plain.items()):
        return None
    if not set(alphabet) <= set(plain):
        return None
    ranks = {bytes(alphabet[c] for c in t): i for t, i in plain.items()}
    return tiktoken.Encoding("own", pat_str=PRETOKEN.pattern, mergeable_ranks=ranks, special_tokens={})


class Units(dict):
    """Encoded form of a unit (a word, with or without the space before it), made on first use."""

    def __init__(self, prefix: str, encode):
        super().__init__()
        self.prefix, self.encode = prefix, encode

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= MEMORY:
            self.clear()
        out = self[unit] = self.encode(self.prefix + unit)
        return out


class ByteBpe:
    """Encodes texts to little-endian unsigned 32-bit ids, as the tokenizer does without added special tokens."""

    def __init__(self, path: str, whole: dict[str, int]):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = special_strings(path)
        self.special_cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.whole = {s: np.uint32(i).astype("<u4").tobytes() for s, i in whole.items()}
        ranks = rank_merges(path)
        self.ranks = ranks
        self.merge_piece = ranks._core_bpe.encode_single_piece if ranks and sys.byteorder == "little" else None
        self.bare, self.spaced = Units("", self._unit), Units(" ", self._unit)

    def _merge(self, piece: str) -> bytes:
        """Ids of one pre-token."""
        if self.merge_piece:
            return array("I", self.merge_piece(piece.encode("utf-8"))).tobytes()
        return self._encode(piece)

    def _encode(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _unit(self, unit: str) -> bytes:
        whole = self.whole
        return b"".join([whole.get(p) or self._merge(p) for p in PRETOKEN.findall(unit)])

    def _plain(self, text: str) -> bytes:
        if SEPARATORS.search(text):
            return self._encode(text)
        if UNEVEN_SPACE.search(text):
            bare = self.bare
            return b"".join([bare[p] for p in PRETOKEN.findall(text)])
        bare, spaced, out = self.bare, self.spaced, []
        for n, line in enumerate(text.split("\n")):
            if n:
                out.append(bare["\n"])
            words = line.split(" ")
            out.append(bare[words[0]])
            out += [spaced[w] for w in words[1:]]
        return b"".join(out)

    def _whole_text(self, text: str) -> bytes:
        """Ids without the shortcut: rank merges cut and merge a whole text faster than it can be looked up piece by piece."""
        if self.ranks is None or SEPARATORS.search(text):
            return self._plain(text)
        return np.asarray(self.ranks.encode_ordinary(text), dtype="<u4").tobytes()

    def _around_special(self, text: str, encode) -> bytes:
        if not text:
            return b""
        if self.special_cut is None or not self.special_cut.search(text):
            return encode(text)
        return b"".join(
            np.uint32(self.special[part]).astype("<u4").tobytes() if part in self.special else encode(part)
            for part in self.special_cut.split(text)
            if part
        )

    def ids(self, text: str) -> bytes:
        return self._around_special(text, self._whole_text)

    def count(self, text: str) -> int:
        """Tokens, by the whole-token shortcut."""
        return len(self._around_special(text, self._plain)) // 4


_loaded: dict[str, ByteBpe] = {}


def load(path: str, whole: dict[str, int]) -> ByteBpe:
    """One encoder per Python worker and tokenizer file."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path, whole)
    return _loaded[path]
