"""Bitwise logistic context mixing over many texts at once, in numpy.

A text is its lower-cased words, one space after another, and an end sign.
Every byte is a path of yes/no decisions through a fixed code tree.  For every
decision, predictors look up a logit under a hash of their context (the three
or the five bytes before; the word so far) and the tree node.  A mixer adds
the logits with weights and predicts ``sigmoid(w . logits)``.  The weight set
is gated by how strongly each predictor speaks at this very decision.  The
weights of the text move along the errors, and the result is refined by an
adaptive probability map that tracks how often predictions like it came true.
Weights and map move after every sixteen decisions, about four bytes; each of
the sixteen adds its update to its own set.

Texts run side by side as lanes: step ``t`` handles the ``t``-th decision of
every lane, so each text is coded strictly in order, by its own state alone.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ORDERS = (3, 5)  # bytes of context; the last predictor's context is the word so far
INPUTS = len(ORDERS) + 1
TABLE_BITS = 22
SLOTS = 1 << TABLE_BITS
LEVELS = 3  # of a predictor's logit: none, weak, strong
STRONG = 20  # tenths
CELL_BITS = 6  # of a logit where start weights are fitted
CELLS = 1 << CELL_BITS
GATES = LEVELS**INPUTS
PAD = max(ORDERS)
END = 10
LOGIT_UNIT = 0.1  # tables hold logits in tenths, in one byte
PRIOR = 0.1  # added to both counts
RATE = 0.01
MAP_RATE = 0.02
MAP_BINS = 24
#: Decisions of a lane between two updates: about four bytes'.
GROUP = 16
#: Bytes whose decisions are made at once (small, so that they stay in cache), and bytes that run side by side: the more,
#: the less the long texts among them run alone at the end.
BLOCK = 1 << 14
SIDE_BY_SIDE = 4 << 20
#: Bytes of which equal ones in equal contexts are counted at once; half as many where they are looked up.
GATHERED = 4 << 20
#: What a lane holds beside its text, in bytes.
LANE_BYTES = 512

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_ROOT = 0x5851F42D4C957F2D  # odd
_ROOT_INVERSE = pow(_ROOT, -1, 1 << 64)


@dataclass
class Code:
    """Decisions of every byte: ``length`` of them, from ``first`` on in ``bit`` and ``salt``."""

    length: np.ndarray
    first: np.ndarray
    bit: np.ndarray
    salt: np.ndarray  # of the node, spread over the bits of a slot


def code_tree(counts: np.ndarray) -> Code:
    """Huffman tree over all 256 bytes, each counted at least once."""
    heap = [(int(c) + 1, i, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    children: dict[int, tuple[int, int]] = {}
    name = 256
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        children[name] = (a[2], b[2])
        heapq.heappush(heap, (a[0] + b[0], name, name))
        name += 1
    paths: dict[int, list[tuple[int, int]]] = {}
    stack: list[tuple[int, list[tuple[int, int]]]] = [(heap[0][2], [])]
    while stack:
        at, path = stack.pop()
        if at < 256:
            paths[at] = path
        else:
            for bit, child in enumerate(children[at]):
                stack.append((child, [*path, (bit, at - 256)]))
    length = np.array([len(paths[s]) for s in range(256)], np.int64)
    flat = [d for s in range(256) for d in paths[s]]
    node = np.array([n + 1 for _, n in flat], np.uint64)
    salt = (node * _MULTIPLIERS[-2] >> np.uint64(64 - TABLE_BITS)).astype(np.uint32)
    return Code(length, np.r_[0, np.cumsum(length)[:-1]], np.array([b for b, _ in flat], np.uint8), salt)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        up = np.full(size, _ROOT, np.uint64)
        down = np.full(size, _ROOT_INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers[size] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _powers[size]


@dataclass
class Decisions:
    """All decisions of a block of texts, text after text."""

    bit: np.ndarray
    slot: list[np.ndarray]  # per predictor
    text: np.ndarray  # decisions per text
    steps: np.ndarray  # decisions per byte


def _gram_contexts(grams: np.ndarray) -> list[np.ndarray]:
    """Per order, the context of a byte, spread over the bits of a slot; ``grams``: the five bytes before it, the nearest highest."""
    contexts = []
    for wanted, multiplier in zip(ORDERS, _MULTIPLIERS):
        mixed = grams << np.uint64(64 - 8 * PAD)
        mixed >>= np.uint64(64 - 8 * wanted)
        mixed += np.uint64(wanted)
        mixed *= multiplier
        mixed >>= np.uint64(64 - TABLE_BITS)
        contexts.append(mixed.astype(np.uint32))
    return contexts


def _word_context(word: np.ndarray) -> np.ndarray:
    """The same of the word so far, from its polynomial, which is lost."""
    word ^= word >> np.uint64(29)
    word *= _MULTIPLIERS[-1]
    word >>= np.uint64(64 - TABLE_BITS)
    return word.astype(np.uint32)


def _eights(flat: np.ndarray) -> np.ndarray:
    """For every byte but the first ``PAD``, eight bytes from the fifth before it on, as one number; a view."""
    return np.ndarray(max(len(flat) - PAD, 0), "<u8", flat.tobytes() + bytes(8), strides=(1,))


def _contexts(flat: np.ndarray) -> list[np.ndarray]:
    """Per predictor, the context of every byte of ``flat`` but the first ``PAD``, spread over the bits of a slot."""
    n = len(flat)
    up, down = _power_tables(n)
    wide = flat.astype(np.uint64)
    wide += np.uint64(1)
    wide *= up[:n]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(wide, out=sums[1:])
    start = np.zeros(n, np.int64)  # of the word that a byte belongs to
    gap = 1 + np.flatnonzero((flat[:-1] == 32) | (flat[:-1] == END))
    start[gap] = gap
    np.maximum.accumulate(start, out=start)
    start = start[PAD:]
    word = sums[PAD:-1] - sums.take(start)
    word *= down.take(start)
    return [*_gram_contexts(_eights(flat).astype(np.uint64)), _word_context(word)]


def _decide(flat: np.ndarray, contexts: list[np.ndarray], code: Code) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """All decisions of the bytes ``flat``: outcome, slot per predictor, and which byte they belong to."""
    steps = code.length.take(flat)
    ends = np.cumsum(steps)
    byte = np.repeat(np.arange(len(flat)), steps)
    entry = (code.first.take(flat) - ends + steps).take(byte)
    entry += np.arange(len(entry))
    salt = code.salt.take(entry)
    slot = []
    for c in contexts:
        spread = c.take(byte)
        spread ^= salt
        slot.append(spread)
    return code.bit.take(entry), slot, byte


def _padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts in one array, each after ``PAD`` end signs and with its own; and which of its bytes but the first ``PAD`` are a text's."""
    pad = bytes([END]) * PAD
    flat = np.frombuffer(b"".join([pad + t + b"\n" for t in texts]), np.uint8)
    sizes = np.array([len(t) + 1 + PAD for t in texts], np.int64)
    firsts = np.cumsum(sizes) - sizes
    real = np.ones(len(flat), bool)
    for p in range(PAD):
        real[firsts + p] = False
    return flat, real[PAD:]


def decisions(texts: list[bytes], code: Code) -> Decisions:
    """``texts``: word bytes joined by spaces, without the end sign."""
    if not texts:
        return Decisions(np.zeros(0, np.uint8), [np.zeros(0, np.uint32)] * INPUTS, np.zeros(0, np.int64), np.zeros(0, np.int64))
    flat, real = _padded(texts)
    own = flat[PAD:][real]
    bit, slot, _ = _decide(own, [c[real] for c in _contexts(flat)], code)
    steps = code.length.take(own)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return Decisions(bit, slot, np.add.reduceat(steps, np.r_[0, ends[:-1]]), steps)


def _early_and_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.BinaryArray]:
    """All bytes of the texts by what determines them and their contexts.

    Within a word, from its sixth byte on (the gap after it counts as one), the
    word so far holds the five bytes before.  Earlier, the five bytes hold the
    word so far.  Returns the padded texts, which of their bytes but the first
    ``PAD`` are a text's and which of these are early, the runs of six bytes
    that end in early bytes, and all words with the gap after each.
    """
    flat, real = _padded(texts)
    gap = (flat == 32) | (flat == END)
    early = gap[PAD - 1 : -1].copy()  # one of the five bytes before is a gap
    for p in range(PAD - 1):
        early |= gap[p : p - PAD]
    early &= real
    grams = _eights(flat)[early].astype(np.uint64, copy=False)
    grams &= np.uint64((1 << 8 * (PAD + 1)) - 1)
    ends = np.r_[0, 1 + np.flatnonzero(gap)].astype(np.int32)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(flat)])
    return flat, real, early, grams, words


def _of_grams(grams: np.ndarray) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """The last byte of every run, and its contexts; some runs at a time."""
    for a in range(0, len(grams), BLOCK):
        part = grams[a : a + BLOCK]
        word, power = np.zeros(len(part), np.uint64), np.ones(len(part), np.uint64)
        for p in range(PAD):
            byte = part >> np.uint64(8 * p) & np.uint64(255)
            on = ((byte != 32) & (byte != END)).astype(np.uint64)
            word = (word + (byte + np.uint64(1)) * power) * on
            power = power * (on * np.uint64(_ROOT)) + (np.uint64(1) - on)
        yield (part >> np.uint64(8 * PAD)).astype(np.uint8), [*_gram_contexts(part), _word_context(word)]


def _of_words(words: pa.BinaryArray, size: np.ndarray) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
    """All bytes of the words from the sixth on, their contexts, and which word they are from; some words at a time."""
    begin = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words)]
    cuts = np.flatnonzero(np.diff(np.r_[-1, np.cumsum(size) // BLOCK]))
    for a, z in zip(cuts, np.r_[cuts[1:], len(words)]):
        line = np.frombuffer(words.buffers()[2], np.uint8)[begin[a] : begin[z - 1] + size[z - 1]]
        own = size[a:z]
        inside = np.arange(len(line)) - np.repeat(np.cumsum(own) - own, own)
        late = np.flatnonzero(inside[PAD:] >= PAD)
        yield line[PAD:][late], [c[late] for c in _contexts(line)], np.repeat(np.arange(a, z), own)[PAD:][late]


def _sizes(words: pa.BinaryArray) -> np.ndarray:
    return pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)


def distinct(texts: list[bytes]) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
    """Every byte with its contexts, equal ones mostly once: the bytes, their contexts per predictor, how often they occur."""
    _, _, _, grams, words = _early_and_words(texts)
    grams.sort()
    new = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
    times = np.diff(np.r_[new, len(grams)])
    at = 0
    for flat, contexts in _of_grams(grams[new]):
        yield flat, contexts, times[at : at + len(flat)]
        at += len(flat)
    found = words.value_counts()
    found = found.filter(pc.greater(pc.binary_length(found.field("values")), PAD))
    often = found.field("counts").to_numpy()
    for flat, contexts, word in _of_words(found.field("values"), _sizes(found.field("values"))):
        yield flat, contexts, often.take(word)


def blocks(texts: list[bytes], size: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes (one text at least)."""
    a, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t) + 1 + PAD
        if total >= size:
            yield a, i + 1
            a, total = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def _gathered(texts: list[bytes], code: Code) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
    """All decisions of the texts, those of bytes equal in all contexts at once: outcome, slot per predictor, how often."""
    for a, z in blocks(texts, GATHERED):
        for flat, contexts, times in distinct(texts[a:z]):
            bit, slot, byte = _decide(flat, contexts, code)
            yield bit, slot, times.take(byte)


class Counts:
    """How often each slot saw a no and a yes: ``table[predictor, 2 * slot + bit]``."""

    def __init__(self):
        self.table = np.zeros((INPUTS, 2 * SLOTS), np.uint32)

    def add(self, texts: list[bytes], code: Code, known_word: list[np.ndarray] | None = None) -> None:
        """``known_word``: per text, for every byte and the end sign, whether its word may teach the word predictor (all by default)."""
        if known_word is None:
            for bit, slot, times in _gathered(texts, code):
                times = times.astype(np.uint32)
                for i in range(INPUTS):
                    np.add.at(self.table[i], slot[i] << np.uint32(1) | bit, times)
            return
        for a, z in blocks(texts, BLOCK):
            d = decisions(texts[a:z], code)
            for i, slot in enumerate(d.slot):
                slot <<= np.uint32(1)
                slot |= d.bit
                if i == INPUTS - 1:
                    slot = slot[np.repeat(np.concatenate(known_word[a:z]), d.steps)]
                np.add.at(self.table[i], slot, np.uint32(1))


def _logit_units(no: np.ndarray, yes: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(np.log((yes + PRIOR) / (no + PRIOR)) / LOGIT_UNIT), -127, 127)


def logits(table: np.ndarray) -> np.ndarray:
    """Table of logits in units of ``LOGIT_UNIT``, one signed byte each; 0 where nothing was seen."""
    out = np.empty((INPUTS, SLOTS), np.int8)
    for i in range(INPUTS):
        no, yes = table[i, 0::2].astype(np.float32), table[i, 1::2].astype(np.float32)
        out[i] = _logit_units(no, yes)
    return out


#: By predictor and logit byte: its share of the gate.
_LEVEL = np.array(
    [[(int(v != 0) + int(abs(v) >= STRONG)) * LEVELS**i for v in np.arange(256).astype(np.uint8).view(np.int8).astype(int)] for i in range(INPUTS)], np.uint8
)


def _words(bit: np.ndarray, slots: list[np.ndarray], tables: np.ndarray) -> np.ndarray:
    """One 32-bit word per decision: the predictors' logits in a byte each, above them the outcome and the gate, ``gate << 2``."""
    out = bit.astype("<u4")
    out |= np.uint32(2)  # a decision, unlike the padding of a lane's last group
    for i in reversed(range(INPUTS)):
        out <<= np.uint32(8)
        out |= tables[i].take(slots[i].astype(np.int64)).view(np.uint8)
    v = out.view(np.int8)
    level = ((v != 0).view(np.int8) + ((v >= STRONG) | (v <= -STRONG)).view(np.int8)).view("<u4")
    for i in range(INPUTS):
        out += (level >> np.uint32(8 * i) & np.uint32(255)) * np.uint32(LEVELS**i << 8 * INPUTS + 2)
    return out


def _all_words(texts: list[bytes], code: Code, tables: np.ndarray) -> Iterator[np.ndarray]:
    """``_words`` of every text; bytes equal in all contexts are looked up once."""
    for a, z in blocks(texts, GATHERED // 2):
        yield from _words_of_block(texts[a:z], code, tables)


def _words_of_block(texts: list[bytes], code: Code, tables: np.ndarray) -> Iterator[np.ndarray]:
    flat, real, early, grams, words = _early_and_words(texts)
    grams = pa.array(grams).dictionary_encode()
    words = words.dictionary_encode()
    size = _sizes(words.dictionary)
    found, steps = [], []
    for part in chain(_of_grams(grams.dictionary.to_numpy()), _of_words(words.dictionary, size)):
        bit, slots, _ = _decide(part[0], part[1], code)
        found.append(_words(bit, slots, tables))
        steps.append(code.length.take(part[0]))
    found, steps = np.concatenate(found), np.concatenate(steps)
    # Where the decisions of every byte are found.
    begin = np.cumsum(steps) - steps
    at = np.empty(len(early), np.int32)
    at[early] = grams.indices.to_numpy()
    late = np.maximum(size - PAD, 0)  # bytes of each different word
    words = words.indices.to_numpy()
    own = late.take(words)
    of_word = (len(grams.dictionary) + np.cumsum(late) - late).take(words)
    at[real & ~early] = np.repeat(of_word - np.cumsum(own) + own, own) + np.arange(own.sum())
    at, flat = at[real], flat[PAD:][real]
    del real, early, grams, words, of_word, own, steps
    a = 0
    for i, j in blocks(texts, BLOCK):
        sizes = [len(t) + 1 for t in texts[i:j]]
        z = a + sum(sizes)
        steps = code.length.take(flat[a:z])
        ends = np.cumsum(steps)
        which = np.repeat(begin.take(at[a:z]) - ends + steps, steps)
        which += np.arange(len(which))
        yield from np.split(found.take(which), ends[np.cumsum(sizes)[:-1] - 1])
        a = z


def _gate(inputs: np.ndarray) -> np.ndarray:
    """Weight set of each row of logit bytes: how strongly each predictor speaks."""
    gate = _LEVEL[0].take(inputs[:, 0].view(np.uint8))
    for i in range(1, INPUTS):
        gate += _LEVEL[i].take(inputs[:, i].view(np.uint8))
    return gate


def _cells() -> tuple[np.ndarray, np.ndarray]:
    """By logit byte: its cell; by cell: its logit.  No cell reaches over two levels of a gate."""
    v = np.arange(256).astype(np.uint8).view(np.int8).astype(int)
    size = np.where(abs(v) < STRONG, (abs(v) + 1) // 2, STRONG // 2 + 1 + (abs(v) - STRONG) // 6)
    cell = (np.sign(v) * size + CELLS // 2).clip(0, CELLS - 1)
    middle = np.bincount(cell, v, CELLS) / np.maximum(np.bincount(cell, minlength=CELLS), 1)
    return cell.astype(np.uint8), middle


_CELL, _MIDDLE = _cells()


def left_out(table: np.ndarray) -> np.ndarray:
    """By predictor and ``2 * slot + bit``: cell of the logit that the slot has without one decision of that outcome."""
    out = np.empty(table.shape, np.uint8)
    for i in range(INPUTS):
        no, yes = table[i, 0::2].astype(np.float32), table[i, 1::2].astype(np.float32)
        out[i, 0::2] = _CELL[_logit_units(np.maximum(no - 1, 0), yes).astype(np.int8).view(np.uint8)]
        out[i, 1::2] = _CELL[_logit_units(no, np.maximum(yes - 1, 0)).astype(np.int8).view(np.uint8)]
    return out


class Outcomes:
    """How often the predictors' cells met a no and a yes: ``table[cell of each predictor, bit]``, flat.

    The texts are among the counted.  Each decision takes its own occurrence
    out of the counts first, so that what is gathered holds for unseen text.
    """

    def __init__(self):
        self.table = np.zeros(2 << CELL_BITS * INPUTS, np.uint64)

    def add(self, texts: list[bytes], code: Code, cells: np.ndarray) -> None:
        for bit, slot, times in _gathered(texts, code):
            at = np.zeros(len(bit), np.uint32)
            for i in range(INPUTS):
                at <<= np.uint32(CELL_BITS)
                at |= cells[i].take((slot[i] << np.uint32(1) | bit).astype(np.int64))
            at <<= np.uint32(1)
            at |= bit
            np.add.at(self.table, at, times.astype(np.uint64))


def fit_weights(outcomes: np.ndarray, rounds: int = 8) -> np.ndarray:
    """Weight sets (gate, predictor) that lanes start from, fitted on all decisions of ``Outcomes.table``.

    Newton steps of a logistic regression per gate, held towards even weights
    by a light ridge.
    """
    even = 1.2 / INPUTS
    weights = np.full((GATES, INPUTS), even)
    rows = np.flatnonzero(outcomes)
    if not len(rows):
        return weights.astype(np.float32)
    times = outcomes[rows].astype(np.float64)
    units = np.stack([_MIDDLE[rows >> 1 + CELL_BITS * (INPUTS - 1 - i) & CELLS - 1] for i in range(INPUTS)], axis=1)
    gate = _gate(np.trunc(units).astype(np.int8))
    ridge = 20.0
    for g in range(GATES):
        of = gate == g
        if not of.any():
            continue
        own, target, n = units[of] * LOGIT_UNIT, rows[of] & 1, times[of]
        w = weights[g].copy()
        for _ in range(rounds):
            p = 1.0 / (1.0 + np.exp(-np.clip(own @ w, -30, 30)))
            slope = own.T @ (n * (target - p)) - ridge * (w - even)
            bend = (own * (n * p * (1 - p))[:, None]).T @ own + ridge * np.eye(INPUTS)
            step = np.linalg.solve(bend, slope)
            w += step * min(1.0, 0.5 / max(1e-9, np.abs(step).max()))
        weights[g] = w
    return weights.astype(np.float32)


def train_weights(texts: list[bytes], code: Code, table: np.ndarray, rounds: int = 8) -> np.ndarray:
    """``fit_weights`` on all of ``texts``, which are among those counted in ``table``."""
    outcomes = Outcomes()
    outcomes.add(texts, code, left_out(table))
    return fit_weights(outcomes.table, rounds)


def bits_of(texts: list[bytes], code: Code, tables: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Total bits of every text under the model."""
    out = [_side_by_side(texts[a:z], code, tables, weights) for a, z in blocks(texts, SIDE_BY_SIDE)]
    return np.concatenate(out) if out else np.zeros(0)


def _side_by_side(texts: list[bytes], code: Code, tables: np.ndarray, weights: np.ndarray) -> np.ndarray:
    flat = np.frombuffer(b"".join([t + b"\n" for t in texts]), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    size = np.add.reduceat(code.length.astype(np.uint8).take(flat), np.r_[0, ends[:-1]], dtype=np.int64)  # decisions of every text
    del flat
    groups = -(-size // GROUP)
    first = (np.cumsum(groups) - groups) * GROUP
    # One lane a text, longest first, so that the lanes still running are always the first ones.
    order = np.argsort(-groups, kind="stable")
    running = np.searchsorted(-groups[order], -np.arange(1, int(groups.max(initial=0)) + 1), side="right")  # lanes with a t-th group
    rows = np.zeros(int(groups.sum()) * GROUP, "<u4")
    for a, words in zip(first.tolist(), _all_words(texts, code, tables)):
        rows[a : a + len(words)] = words
    cost = np.empty(len(texts))
    cost[order] = _run(rows.view(np.int8).reshape(-1, INPUTS + 1), running, first[order], weights, len(order))
    return cost


def _run(rows: np.ndarray, running: np.ndarray, first: np.ndarray, weights: np.ndarray, lanes: int) -> np.ndarray:
    """Bits of every lane, all lanes a group of decisions at a time; ``first``: the row where a lane begins."""
    unit = np.float32(LOGIT_UNIT)
    # Weights that came in a pickle have a float32 type of their own, which makes np.add.at below four times slower.
    weights = np.ascontiguousarray(weights).view(np.float32)
    held = [np.tile(weights[:, i] * unit, lanes) for i in range(INPUTS)]  # per predictor, of (lane, gate), for logits in units
    base = np.arange(lanes, dtype=np.int64)[:, None] * GATES
    centers = (np.arange(MAP_BINS) + 0.5 - MAP_BINS / 2).astype(np.float32)
    adapted = np.tile((1.0 / (1.0 + np.exp(-centers))).astype(np.float32), lanes)
    map_base = np.arange(lanes, dtype=np.int64)[:, None] * MAP_BINS
    cost = np.zeros(lanes)
    rate, map_rate = np.float32(RATE) * unit * unit, np.float32(MAP_RATE)
    half, quarter, one = np.float32(MAP_BINS / 2), np.float32(0.25), np.float32(1)
    most = np.float32(MAP_BINS / 2 - 0.5)
    groups = np.ascontiguousarray(rows).view("<u4").reshape(-1, GROUP)
    turn = np.asarray(first[:lanes]) // GROUP
    for t, n in enumerate(running.tolist()):
        now = groups.take(turn[:n] + t, axis=0)
        units = now.view(np.int8).reshape(n, GROUP, INPUTS + 1)
        x = [units[:, :, i].astype(np.float32) for i in range(INPUTS)]
        now >>= np.uint32(8 * INPUTS)
        bit = (now & np.uint32(1)).astype(np.float32)
        row = (now >> np.uint32(2)).astype(np.int64)  # every decision's own weight set
        row += base[:n]
        logit = held[0].take(row)
        logit *= x[0]
        for i in range(1, INPUTS):
            pull = held[i].take(row)
            pull *= x[i]
            logit += pull
        np.minimum(logit, most, out=logit)
        np.maximum(logit, -most, out=logit)
        p = np.negative(logit)
        np.exp(p, out=p)
        p += one
        np.reciprocal(p, out=p)
        error = bit - p
        error *= rate
        row = row.ravel()
        for i in range(INPUTS):
            x[i] *= error
            np.add.at(held[i], row, x[i].ravel())
        logit += half
        cell = logit.astype(np.int64)
        cell += map_base[:n]
        seen = adapted.take(cell)
        p += (seen - p) * quarter
        seen += (bit - seen) * map_rate
        adapted[cell] = seen
        # The chance given to what did happen; neither p nor the map ever reaches 0 or 1.
        p -= bit
        np.abs(p, out=p)
        np.subtract(one, p, out=p)
        np.log2(p, out=p)
        if t + 1 == len(running) or running[t + 1] < n:  # some lanes may end here
            p *= (now >> np.uint32(1) & np.uint32(1)).astype(np.float32)
        p = (p[:, : GROUP // 2] + p[:, GROUP // 2 :]).ravel()
        while len(p) > n:
            p = p[0::2] + p[1::2]
        cost[:n] -= p
    return cost
