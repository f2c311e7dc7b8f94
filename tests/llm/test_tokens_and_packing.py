from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.helpers import ROWS, awkward, empty
from tidewater.llm import bpe, packing, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "a", "9", "é", "中文", "😀", "'s", "_", "!!", "<|endoftext|>", " ", "\x1c", "\x85", " the", "don't"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_ids_and_counts_equal_the_tokenizer(tokenizer):
    encoder = bpe.ByteBpe(PATH, bpe.whole_tokens(PATH))
    rng = random.Random(3)
    for _ in range(1500):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12)))
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == want
        assert encoder.count(text) == len(want)


def test_merging_without_ranks_gives_the_same(tokenizer):
    encoder = bpe.ByteBpe(PATH, bpe.whole_tokens(PATH))
    encoder.ranks = encoder.merge_piece = None
    for text in ("Thnd*** unheard wordlike", "a  b\n\n\nc", "x\x1cy"):
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        bpe.special_strings(public_tokenizers.path("word_bpe_49k.json"))


def test_token_counts_on_awkward_rows(spark, tokenizer):
    got = sorted(map(tuple, token_counts.token_counts(awkward(spark), PATH, limit=100).collect()), key=repr)
    want = []
    for key, text, *_ in ROWS:
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        want.append((key, len((text or "").encode()), n, n > 100))
    assert got == sorted(want, key=repr)
    assert token_counts.token_counts(empty(spark), PATH).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_plan_covers_the_histogram_and_fits(seed):
    rng = random.Random(seed)
    histogram = {rng.randint(1, 64): rng.randint(1, 40) for _ in range(rng.randint(1, 50))}
    lines = packing.plan(histogram, 64)
    used: dict[int, int] = {}
    for times, bin_ in lines:
        assert sum(bin_) <= 64
        for length in bin_:
            used[length] = used.get(length, 0) + times
    assert used == histogram
    total = sum(a * n for a, n in histogram.items())
    assert sum(t for t, _ in lines) <= 1.25 * -(-total // 64) + 1 + sum(n for a, n in histogram.items() if a > 32)


def test_best_two_replace_the_smallest():
    # Greedy fills 60 + 30 (gap 10); 22 + 18 fill the place of the 30 exactly.
    lines = packing.plan({60: 1, 30: 1, 22: 1, 18: 1}, 100)
    assert sorted(map(sorted, (b for _, b in lines)), key=len) == [[30], [18, 22, 60]]


def test_packing_places_every_token_once(spark, tokenizer):
    out = packing.pack(awkward(spark), PATH, end_id=2, capacity=128).collect()
    by_sequence: dict[int, list] = {}
    texts: dict[tuple, int] = {}
    for r in out:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        ids = np.frombuffer(bytes(r["ids"]), "<u4")
        assert len(ids) == r["length"] <= 128
        texts[(r["doc_id"], r["piece"])] = zlib.crc32(bytes(r["ids"]))
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 128
    for key, text, *_ in ROWS:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 128 or 128
        cuts = [0, *range(first, len(ids), 128)]
        for p, a in enumerate(cuts):
            z = cuts[p + 1] if p + 1 < len(cuts) else len(ids)
            assert texts[(key, p)] == zlib.crc32(np.array(ids[a:z], "<u4").tobytes())
    assert len(out) == sum(len([0, *range((n := len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) % 128 or 128, n, 128)]) for _, t, *_ in ROWS)
    assert packing.pack(empty(spark), PATH).collect() == []
