from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from tests.llm.helpers import ROWS, awkward, empty
from tidewater.llm import mixing, simhash
from tidewater.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes: dict, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        open_ = sum(weight[s] for s in names if s not in capped)
        out = {s: most * sizes[s] if s in capped else rest * weight[s] / open_ for s in names}
        over = {s for s in names if out[s] > most * sizes[s] + 1e-9} - capped
        if not over:
            return out
        capped |= over


def test_mix_meets_its_targets(spark):
    rng = random.Random(5)
    data = [(i, " ".join(["w"] * rng.randint(0, 40)), "en", rng.choice(["hot"] * 6 + ["b", "ç", None]), 0) for i in range(3000)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    out = mixing.mix(docs).collect()
    size = {i: len(WORD.findall(t)) for i, t, *_ in data}
    sizes: dict = {}
    for i, _, _, s, _ in data:
        sizes[s] = sizes.get(s, 0) + size[i]
    want = plain_targets(sizes)
    assert len(out) == len(data)
    taken: dict = {}
    for r in out:
        assert r["size"] == size[r["doc_id"]] and r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 40
    assert sorted(map(tuple, mixing.mix(docs).collect()), key=repr) == sorted(map(tuple, out), key=repr)


def test_mix_on_awkward_and_empty_tables(spark):
    out = mixing.mix(awkward(spark)).collect()
    assert len(out) == len(ROWS)
    assert {r["doc_id"]: r["size"] for r in out}[3] == 0
    assert mixing.mix(empty(spark)).collect() == []
    blank = spark.createDataFrame([(1, None, None, "a", None)], "doc_id long, text string, lang string, source string, n_chars long")
    (row,) = mixing.mix(blank).collect()
    assert (row["size"], row["target"], row["taken"]) == (0, 0.0, 0)


def plain_fingerprint(text: str, width: int = 4) -> int:
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), text.encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def plain_components(prints: list[tuple]) -> dict:
    label = list(range(len(prints)))
    for _ in prints:
        for i, (_, a) in enumerate(prints):
            for j, (_, b) in enumerate(prints):
                if (a ^ b).bit_count() <= 4:
                    label[i] = label[j] = min(label[i], label[j])
    groups: dict = {}
    for i, (key, _) in enumerate(prints):
        groups.setdefault(label[i], []).append(key)
    return {label_: min((k for k in keys if k is not None), default=None) for label_, keys in groups.items()}, label


def test_simhash_on_awkward_rows(spark):
    out = sorted(map(tuple, simhash.near_duplicates(awkward(spark)).collect()), key=repr)
    prints = [(key, plain_fingerprint(text or "")) for key, text, *_ in ROWS]
    name, label = plain_components(prints)
    want = sorted([(key, f"{fp:016x}", name[label[i]]) for i, (key, fp) in enumerate(prints)], key=repr)
    assert out == want
    assert simhash.near_duplicates(empty(spark)).collect() == []


def test_links_find_every_pair_within_four_bits(spark):
    rng = random.Random(11)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = set(base)
    for b in base:
        for d in range(0, 8):
            values.add(b ^ sum(1 << k for k in rng.sample(range(64), d)))
    signed = [int(np.uint64(v).astype(np.int64)) for v in values]
    got = {tuple(r) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), 4).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    assert got == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, k) for k in range(2, 50)] + [(70, 69), (69, 68)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 1 for i in range(1, 50)}, 68: 68, 69: 68, 70: 68}


def test_one_document_of_a_group_stays(spark):
    docs = awkward(spark)
    kept = simhash.first_of_group(docs, simhash.near_duplicates(docs))
    assert kept.columns == docs.columns
    assert sorted([r["doc_id"] for r in kept.collect()], key=repr) == sorted([1, 3, 6, 7, 8, None], key=repr)


def test_groups_without_ids_and_an_id_with_two_texts_all_stay(spark):
    texts = ["red apples fall from old trees in autumn", "the ferry to the island leaves at noon", "granite hills above the northern lake", "seven wise owls count the stars"]
    data = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (4, texts[1]), (5, texts[2]), (5, texts[3]), (6, texts[3]), (None, "parrots of every colour fill the market")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    want = sorted([(None, texts[0]), (4, texts[1]), (5, texts[2]), (5, texts[3]), data[-1]], key=repr)
    for labelled in (False, True):
        kept = simhash.first_of_group(docs, simhash.near_duplicates(docs, labelled=labelled))
        assert kept.columns == docs.columns
        assert sorted([(r["doc_id"], r["text"]) for r in kept.collect()], key=repr) == want
