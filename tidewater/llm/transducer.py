"""Byte-level BPE as a bounded-lookahead streaming transducer, and its inverse.

Encoding.  A merge list is *proper* when both parts of every merge are bytes or
made by earlier merges; merging then runs merge by merge in list order.  Take
two texts that agree up to byte n.  What they differ in reaches left of n only
through merges: the part at n merges with the token left of it in one text and
not in the other, the token there now differs, and can in turn take part in a
*later* merge with the token further left.  So the reach is bounded by the
heaviest chain of merges of rising rank, each taking on its right a token that
the one before may have left behind, weighed by the bytes each takes on its
left.  ``lookahead`` computes that weight from the merge list; tokens that end at
least so many bytes before the end of what has been read are stable whatever
follows.  ``PieceEncoder`` holds a window of bytes, merges it, emits the stable
tokens and keeps the rest: a token boundary splits the merging exactly.

Pre-tokens.  Merges never cross pre-tokens.  A lone space between two non-white
characters always starts one, so text is cut there; what has no such space (a
run of letters of any length, say) is cut by the pattern as soon as two more
characters are known, and a run that fills the window is fed to the piece
encoder as it comes.  Encodings of short units are remembered in a bounded table.

Decoding.  Bytes of the tokens go through a UTF-8 state machine: the state is
the beginning of a character (three bytes at most), so tokens that hold a part
of a character come out when the rest arrives.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tidewater.llm.common import ship_package, slices, text_or_empty

# The published pre-token pattern of byte-level BPE, with its white space spelled out.
OTHER_WHITE = "\\t\\x0b-\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WHITE = "\\n " + OTHER_WHITE
LETTER, NUMBER = r"\p{L}", r"\p{N}"


def _patterns(letter: str, number: str, other: str) -> tuple[regex.Pattern, list[regex.Pattern]]:
    """The pattern of a pre-token, and those of runs of letters, numbers, other characters and white space."""
    piece = rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
    return regex.compile(f"(?V1){piece}"), [regex.compile(f"(?V1){c}+") for c in (letter, number, other, f"[{WHITE}]")]


PATTERNS = _patterns(LETTER, NUMBER, f"[^{WHITE}{LETTER}{NUMBER}]")
#: A lone space between two non-white characters.
CUT = re.compile(rf"(?<=[^{WHITE}]) (?=[^{WHITE}])")
#: What text with lone spaces and lone line ends only does not hold.
UNEVEN = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c")
OTHER = re.compile(f"[{OTHER_WHITE}]")
WHITE_RUN = 3
#: Characters read at a time; also the longest run kept before it goes on in parts.
WINDOW = 1 << 15
#: Units remembered per worker (twice: a full memory becomes the older one), and the longest of them in characters.
MEMORY, LONGEST_UNIT = 200_000, 64
#: Bytes of a piece that no piece encoder emits early (its window is larger).
SHORT_PIECE = 256


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the rest from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Merges:
    """A proper merge list: ids of bytes, and for a pair of ids its rank and the id it becomes."""

    def __init__(self, byte_ids: list[int], rules: list[tuple[int, int, int]], lengths: dict[int, int]):
        self.byte_ids, self.rules, self.lengths = byte_ids, rules, lengths
        #: By left id: the ranks of its merges by right id.  By rank: the id made.
        self.ranks: dict[int, dict[int, int]] = {i: {} for i in lengths}
        for rank, (a, b, _) in enumerate(rules):
            self.ranks.setdefault(a, {})[b] = rank
        self.made = [made for *_, made in rules]
        self.never = len(rules)
        self.longest = max(lengths.values())
        known = set(byte_ids)
        for a, b, made in rules:
            if a not in known or b not in known or made in known:
                raise ValueError("a merge list is needed whose merges join bytes or earlier merges, each into a token of its own")
            known.add(made)

    def merge(self, data: bytes) -> list[int]:
        """Ids of ``data`` as one piece."""
        ids = [self.byte_ids[b] for b in data]
        return self._short(ids) if len(ids) <= 24 else self._long(ids)

    def _short(self, ids: list[int]) -> list[int]:
        ranks, made, never = self.ranks, self.made, self.never
        found = [ranks[a].get(b, never) for a, b in zip(ids, ids[1:])]
        while found:
            best = min(found)
            if best == never:
                break
            i = found.index(best)  # the leftmost of the lowest rank
            new = ids[i] = made[best]
            del ids[i + 1], found[i]
            if i:
                found[i - 1] = ranks[ids[i - 1]].get(new, never)
            if i < len(found):
                found[i] = ranks[new].get(ids[i + 1], never)
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        n, ranks, never = len(ids), self.ranks, self.never
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := ranks[a].get(b, never)) != never]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or ranks[ids[i]].get(ids[j], never) != rank:
                continue  # one of the two has merged since
            ids[i], ids[j] = self.made[rank], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                self._push(heap, ids, i, after[i])
            if before[i] >= 0:
                self._push(heap, ids, before[i], i)
        return [i for i in ids if i >= 0]

    def _push(self, heap: list, ids: list[int], i: int, j: int) -> None:
        rank = self.ranks[ids[i]].get(ids[j], self.never)
        if rank != self.never:
            heapq.heappush(heap, (rank, i))

    def lookahead(self) -> int:
        """Bytes that must follow a token's end before it is stable: the heaviest chain of merges (see the module text).

        Merge j may follow merge i < j in a chain if the token that j takes on
        its right is what i left at its place: i's left part alone, or a token
        that begins with it and is made by merge i or later.
        """
        rank_of = {made: rank for rank, (_, _, made) in enumerate(self.rules)}
        ranks: dict[int, list[int]] = {}
        heaviest: dict[int, list[int]] = {}  # per left part: the heaviest chain that ends in its first merges
        longest = 0
        for j, (left, right, _) in enumerate(self.rules):
            before = heaviest[right][-1] if right in heaviest else 0
            made, spine = rank_of.get(right), right
            while spine in rank_of:
                spine = self.rules[rank_of[spine]][0]
                if spine in ranks:
                    upto = bisect_right(ranks[spine], made)
                    if upto:
                        before = max(before, heaviest[spine][upto - 1])
            weight = self.lengths[left] + before
            longest = max(longest, weight)
            ranks.setdefault(left, []).append(j)
            chain = heaviest.setdefault(left, [])
            chain.append(max(weight, chain[-1] if chain else 0))
        return longest


class PieceEncoder:
    """One pre-token of any length, fed as bytes; emits tokens once no continuation can change them."""

    def __init__(self, merges: Merges, lookahead: int):
        self.merges, self.lookahead = merges, lookahead
        #: Bytes held at most before tokens are emitted; more than the lookahead and a token, so that some always are.
        self.window = max(4 * lookahead, 2 * (lookahead + merges.longest), 1024)
        self.held = b""

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        for a in range(0, len(data), self.window):
            self.held += data[a : a + self.window]
            if len(self.held) > self.window:
                out += self._emit(len(self.held) - self.lookahead)
        return out

    def finish(self) -> list[int]:
        return self._emit(len(self.held))

    def _emit(self, stable: int) -> list[int]:
        ids, lengths = self.merges.merge(self.held), self.merges.lengths
        at = done = 0
        for i in ids:
            if at + lengths[i] > stable:
                break
            at += lengths[i]
            done += 1
        self.held = self.held[at:]
        return ids[:done]


class Vocabulary:
    """A tokenizer file: merges, bytes of every id, special strings; refuses files that this module does not reproduce."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        odd = [k for k in ("dropout", "ignore_merges", "end_of_word_suffix", "continuing_subword_prefix", "fuse_unk") if model.get(k)]
        if model.get("type") != "BPE" or odd or spec.get("normalizer"):
            raise ValueError(f"{path}: a plain byte-level BPE without a normaliser is needed")
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError(f"{path}: the byte-level pre-token pattern without a prefix space is needed")
        if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path}: added tokens with matching rules are not supported")
        alphabet, ids = byte_alphabet(), model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        used = [c for c in alphabet] + ["".join(p) for p in pairs]
        self.special = {t["content"]: t["id"] for t in added}
        raw = {t: bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t in (*ids, *self.special)}
        self.bytes_of = {i: raw[t] for t, i in (ids | self.special).items()}
        self.merges = Merges(
            [ids[c] for c, _ in sorted(alphabet.items(), key=lambda p: p[1])],
            [(ids[a], ids[b], ids[a + b]) for a, b in pairs],
            {ids[t]: len(raw[t]) for t in used},
        )


@lru_cache(maxsize=4)
def odd_characters(path: str) -> str:
    """Characters that ``regex`` takes for letters or numbers and the tokenizer does not, as the inside of a character class.

    The two libraries may know different versions of Unicode; only characters
    that this Python does not know yet are asked about.
    """
    pre = Tokenizer.from_file(path).pre_tokenizer
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    new = [c for c in regex.findall(rf"[{LETTER}{NUMBER}]", every) if unicodedata.category(c) == "Cn"]
    odd = [ord(c) for c in new if len(pre.pre_tokenize_str(f"!{c}!")) == 1]
    starts = [c for i, c in enumerate(odd) if i == 0 or odd[i - 1] != c - 1]
    ends = [c for i, c in enumerate(odd) if i + 1 == len(odd) or odd[i + 1] != c + 1]
    return "".join(f"\\U{a:08x}-\\U{z:08x}" for a, z in zip(starts, ends))


class Encoder:
    """A text of any length, fed in parts; yields little-endian 32-bit ids as soon as they are stable."""

    def __init__(self, vocabulary: Vocabulary, lookahead: int, odd: str = "", window: int = WINDOW):
        if window < 8:
            raise ValueError("a window holds eight characters at least")
        self.merges, self.lookahead, self.window = vocabulary.merges, lookahead, window
        self.special = {s: self._pack([i]) for s, i in vocabulary.special.items()}
        self.special_cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.special_tail = max(map(len, self.special), default=1) - 1
        #: Ids of units met lately, and of those met before them; never None or empty.
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.text = ""
        self.run: tuple[int, PieceEncoder] | None = None  # its class of characters
        self.odd = re.compile(f"[{odd}]") if odd else None
        self.corrected = (
            _patterns(f"[{LETTER}--[{odd}]]", f"[{NUMBER}--[{odd}]]", f"(?:[^{WHITE}{LETTER}{NUMBER}]|[{odd}])") if odd else PATTERNS
        )
        self.piece, self.runs = PATTERNS

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return np.asarray(ids, "<i4").tobytes()

    def feed(self, text: str) -> bytes:
        """Ids that are stable once ``text`` has been read."""
        out = []
        if self.odd and not text.isascii() and self.odd.search(text):
            # Slower patterns, which differ from the others at odd characters only, to the end of this text.
            self.piece, self.runs = self.corrected
        for a in range(0, len(text), self.window):
            self.text += text[a : a + self.window]
            out.append(self._advance(final=False))
        return b"".join(out)

    def finish(self) -> bytes:
        """The ids of what is held; the encoder is then ready for another text."""
        out = self._advance(final=True)
        self.piece, self.runs = PATTERNS
        return out

    def encode(self, text: str) -> bytes:
        return self.feed(text) + self.finish()

    def _advance(self, final: bool) -> bytes:
        out = []
        if self.special_cut is not None:
            # A special string ends the pre-token before it as the end of the text does.
            parts = self.special_cut.split(self.text)
            for part, mark in zip(parts[::2], parts[1::2]):
                out += [self._plain(part, True)[0], self.special[mark]]
            self.text = parts[-1]
        # The tail that may become a special string waits.
        wait = 0 if final or not self.special else self._special_prefix()
        ready, waiting = (self.text[:-wait], self.text[-wait:]) if wait else (self.text, "")
        ids, rest = self._plain(ready, final)
        out.append(ids)
        self.text = rest + waiting
        return b"".join(out)

    def _special_prefix(self) -> int:
        for n in range(min(self.special_tail, len(self.text)), 0, -1):
            tail = self.text[-n:]
            if any(s.startswith(tail) for s in self.special):
                return n
        return 0

    def _plain(self, text: str, final: bool) -> tuple[bytes, str]:
        """(ids, unread rest) of text without special strings; ``final``: nothing follows it."""
        out = []
        if self.run:
            ids, text = self._go_on(text, final)
            out.append(ids)
        if final:
            out.append(self._whole(text))
            return b"".join(out), ""
        if self.run:
            return b"".join(out), text
        cut = self._last_cut(text)
        if cut:
            out.append(self._whole(text[:cut]))
            text = text[cut:]
        if len(text) >= self.window:
            ids, text = self._no_space(text)
            out.append(ids)
        return b"".join(out), text

    @staticmethod
    def _last_cut(text: str) -> int:
        """Place of the last lone space between two non-white characters, 0 if there is none."""
        at = text.rfind(" ", 1, -1)
        while at > 0:
            if CUT.match(text, at):
                return at
            at = text.rfind(" ", 1, at)
        return 0

    def _no_space(self, text: str) -> tuple[bytes, str]:
        """A window without a cut: pieces that two further characters cannot change, then the open run, if it is long."""
        out, at = [], 0
        for m in self.piece.finditer(text):
            if m.end() > len(text) - 2:
                break
            out.append(self._unit(m.group()))
            at = m.end()
        text = text[at:]
        if len(text) >= self.window:
            # One piece fills the window: its class goes on.  A space before it, if any, belongs to it.
            kind = next(i for i, p in enumerate(self.runs) if p.match(text[1] if text[0] == " " else text[0]))
            self.run = kind, PieceEncoder(self.merges, self.lookahead)
            ids, text = self._go_on(text, False, skip=1 if text[0] == " " else 0)
            out.append(ids)
        return b"".join(out), text

    def _go_on(self, text: str, final: bool, skip: int = 0) -> tuple[bytes, str]:
        """Feed the open run as far as it goes."""
        kind, piece = self.run
        m = self.runs[kind].match(text, skip)
        end = m.end() if m else skip
        if kind == WHITE_RUN:
            # White space: the last character may belong to the next piece, so one always waits.
            if end == len(text) and not final:
                end -= 1
                return self._pack(piece.feed(text[:end].encode())), text[end:]
            if end < len(text):
                end -= 1
        ids = piece.feed(text[:end].encode())
        if final or end < len(text):
            self.run = None
            ids += piece.finish()
        return self._pack(ids), text[end:]

    @staticmethod
    def _even(text: str) -> bool:
        """No white space but lone spaces and lone line ends between non-white characters, a space in front allowed."""
        if any(u in text for u in UNEVEN) or text[0] == "\n" or text[-1] in " \n":
            return False
        return text.isascii() or not OTHER.search(text)

    def _whole(self, text: str) -> bytes:
        """Ids of text that nothing changes from outside."""
        if not text:
            return b""
        if self._even(text):
            out = []
            for n, line in enumerate(text.split("\n")):
                if n:
                    out.append(self._unit("\n"))
                first, *rest = line.split(" ")
                if first:
                    out.append(self._unit(first))
                known = self.memory
                out += [known.get(u) or self._unit(u) for u in [" " + w for w in rest]]
            return b"".join(out)
        return b"".join([self._unit(m) for m in self.piece.findall(text)])

    def _unit(self, unit: str) -> bytes:
        """Ids of a pre-token, or of a few that start with a lone space."""
        found = self.memory.get(unit) or self.older.get(unit)
        if found is None:
            pieces = self.piece.findall(unit)
            found = self._piece(unit) if len(pieces) == 1 else b"".join([self.memory.get(p) or self._unit(p) for p in pieces])
        if len(unit) <= LONGEST_UNIT:
            if len(self.memory) >= MEMORY:
                self.memory, self.older = {}, self.memory
            self.memory[unit] = found
        return found

    def _piece(self, piece: str) -> bytes:
        data = piece.encode()
        if len(data) <= SHORT_PIECE:
            # What a piece encoder that holds it all would emit at its end.
            return array("i", self.merges.merge(data)).tobytes()
        stream = PieceEncoder(self.merges, self.lookahead)
        return self._pack(stream.feed(data) + stream.finish())


#: First and last allowed second byte after the lead bytes that narrow it (no overlong forms, no surrogates, no more than U+10FFFF).
SECOND = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}


def open_character(data: bytes) -> int:
    """How many bytes at the end begin a UTF-8 character that further bytes may complete: 0 to 3."""
    for n in range(1, min(3, len(data)) + 1):
        lead = data[-n]
        if 0x80 <= lead <= 0xBF:
            continue
        length = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0
        if n >= length:
            return 0
        low, high = SECOND.get(lead, (0x80, 0xBF))
        return n if n == 1 or low <= data[1 - n] <= high else 0
    return 0


class Decoder:
    """Ids fed in parts; yields text as soon as its characters are whole.  Bytes that are none become U+FFFD."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of, self.state = bytes_of, b""

    def feed(self, ids: list[int]) -> str:
        """Text that the ids complete; unknown ids stand for nothing."""
        known = self.bytes_of
        data = self.state + b"".join([known.get(i, b"") for i in ids])
        cut = len(data) - open_character(data)
        self.state = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        """What is held of an unfinished character; the decoder is then ready for other ids."""
        held, self.state = self.state, b""
        return held.decode("utf-8", "replace")

    def decode(self, ids: np.ndarray, part: int = 1 << 14) -> str:
        pieces = [self.feed(ids[a : a + part].tolist()) for a in range(0, len(ids), part)]
        return "".join([*pieces, self.finish()])


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """One per process and tokenizer file."""
    return Vocabulary(path)


@lru_cache(maxsize=4)
def _encoder(path: str, lookahead: int, odd: str) -> Encoder:
    """One per process and file: workers keep the units they know from task to task."""
    return Encoder(vocabulary(path), lookahead, odd)


def with_ids(docs: DataFrame, tokenizer: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the token ids of every text, special strings inside texts as the tokenizer takes them by default.

    NULL text counts as empty (no ids).  An existing column named ``out`` is
    replaced, every other column passes through; repeated rows are encoded each;
    an empty table gives an empty one.  A text of any length is read in windows;
    beside the ids themselves a task holds a bounded window and table of units.
    The tokenizer file has the same path on every executor; the lookahead is
    computed once on the driver.
    """
    ship_package(docs.sparkSession)
    lookahead, odd = vocabulary(tokenizer).merges.lookahead(), odd_characters(tokenizer)
    kept = [c for c in docs.columns if c != out]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, lookahead, odd)
        for part in (p for batch in batches for p in slices(batch, 256)):
            rows = [np.frombuffer(encoder.encode(t), "<i4") for t in part.column(part.num_columns - 1).to_pylist()]
            ends = np.cumsum([0, *map(len, rows)])
            values = np.concatenate(rows) if rows else np.empty(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids], names)

    names = [*kept, out]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField(out, T.ArrayType(T.IntegerType()))])
    return docs.select(*[docs[c] for c in kept], text_or_empty(text).alias(out)).mapInArrow(encode, schema)


def with_text(rows: DataFrame, tokenizer: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """``rows`` with the text of every list of ids, special tokens included.

    NULL lists give NULL, NULL and unknown ids stand for nothing; an existing
    column named ``out`` is replaced; an empty table gives an empty one.
    """
    ship_package(rows.sparkSession)

    @F.pandas_udf("string")
    def decode(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import pandas as pd

        decoder = Decoder(vocabulary(tokenizer).bytes_of)
        for s in lists:
            yield pd.Series([None if v is None else decoder.decode(np.asarray(v)) for v in s], dtype=object)

    return rows.withColumn(out, decode(ids))
