from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_CHECK
from tests.llm.helpers import ROWS, awkward, empty
from tidewater.llm import language_model, mixer, ordinal, quality, toxicity
from tidewater.llm.common import read_table


def test_cumulative_link_recovers_ordered_grades():
    rng = np.random.default_rng(1)
    truth = rng.normal(0, 2, 30)
    rows, score = [], []
    for _ in range(3000):
        f = rng.choice(30, 6, replace=False)
        rows.append((f.astype(np.int64), np.ones(6)))
        score.append(truth[f].sum() + rng.logistic())
    grades = np.digitize(score, [-3.0, 2.0])
    model = ordinal.fit(rows, grades, l1=1e-5, least_z=0)
    assert model.thresholds == sorted(model.thresholds)
    z = np.array([sum(model.weights.get(int(i), 0.0) for i in f) for f, _ in rows])
    tails = model.tails(z)
    assert (tails[:, 0] >= tails[:, 1]).all()
    assert ((tails >= 0.5).sum(axis=1) == grades).mean() > 0.75


def test_constant_grades_give_a_constant_model():
    model = ordinal.fit([(np.array([1]), np.ones(1))] * 3, np.zeros(3, int))
    assert model.tails(np.zeros(1))[0, 0] < 0.01


@pytest.fixture(scope="module")
def labelled(spark):
    return read_table(spark, SF_CHECK, "documents"), read_table(spark, SF_CHECK, "labels")


def test_toxicity_on_labels(spark, labelled):
    docs, labels = labelled
    out = toxicity.toxicity(docs, labels).join(labels.select("doc_id", F.col("toxic").alias("truth")), "doc_id").collect()
    assert sum(r["toxic"] for r in out if r["truth"] == 0) == 0
    found = [r["toxic"] for r in out if r["truth"] == 1]
    assert sum(found) >= 0.5 * len(found)
    assert all((r["expected_severity"] >= r["p_toxic"] - 1e-9) for r in out)


def test_quality_keeps_clean_documents(spark, labelled):
    docs, labels = labelled
    out = quality.quality(docs, labels).join(labels.select("doc_id", F.col("quality").alias("truth"), F.col("toxic").alias("bad")), "doc_id").collect()
    clean = [r["keep"] for r in out if r["truth"] == 1 and r["bad"] == 0]
    junk = [r["keep"] for r in out if r["truth"] == 0]
    assert sum(clean) >= 0.98 * len(clean) and sum(junk) <= 0.2 * len(junk)


def test_classifiers_on_awkward_and_empty_tables(spark, labelled):
    _, labels = labelled
    marks = spark.createDataFrame([(1, 1, 0), (6, 0, 0), (7, None, None), (None, 1, 1), (8, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(awkward(spark), marks).count() == len(ROWS)
    assert quality.quality(awkward(spark), marks).count() == len(ROWS)
    assert toxicity.toxicity(empty(spark), labels).collect() == []
    assert quality.quality(empty(spark), labels).collect() == []
    assert toxicity.toxicity(awkward(spark), marks.limit(0)).count() == len(ROWS)


def test_code_is_a_prefix_code():
    code = mixer.code_tree(np.r_[np.arange(255), 100000])
    assert sum(2.0 ** -int(n) for n in code.length) == pytest.approx(1.0)
    assert code.length[255] == 1


def test_lanes_do_not_depend_on_their_neighbours():
    texts = [b"the cat sat", b"", b"on the mat " * 300, b"x"]
    code = mixer.code_tree(np.bincount(np.frombuffer(b"".join(texts), np.uint8), minlength=256))
    counts = mixer.Counts()
    counts.add(texts, code, [np.ones(len(t) + 1, bool) for t in texts])
    tables = mixer.logits(counts.table)
    weights = mixer.train_weights(texts, code, counts.table)
    together = mixer.bits_of(texts, code, tables, weights)
    alone = [mixer.bits_of([t], code, tables, weights)[0] for t in texts]
    assert together == pytest.approx(alone, rel=1e-4)
    assert together[2] < 8 * len(texts[2]) / 8


def plain_base(rows: list[tuple]) -> dict:
    words = [(k, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [b"\n"]) for k, t in rows]
    held = [k is not None and zlib.crc32(str(k).encode()) % 5 == 1 for k, _ in words]
    counts: Counter = Counter()
    for (_, w), h in zip(words, held):
        if not h:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    room = math.log10(n + 0.5 * (v + 1))
    return [(k, h, len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10(counts[x] + 0.5) - room for x in w)) for (k, w), h in zip(words, held)]


@pytest.mark.parametrize("small_head", [False, True])
def test_base_score_is_exact(spark, monkeypatch, small_head):
    if small_head:  # nearly all words take the way through the shuffle
        monkeypatch.setattr(language_model, "HEAD", 3)
    out = sorted(language_model.score(awkward(spark)).collect(), key=repr)
    want = plain_base([(k, t) for k, t, *_ in ROWS])
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in out), key=repr)
    assert got == sorted((w[:5] for w in want), key=repr)
    assert sorted(r["base_score"] for r in out) == pytest.approx(sorted(w[5] for w in want))
    assert all(r["score"] < 0 and r["bits_per_byte"] > 0 for r in out)


def test_language_model_on_an_empty_table(spark):
    assert language_model.score(empty(spark)).collect() == []


def test_words_outside_the_head_teach_the_word_predictor(spark, monkeypatch):
    whole = sorted((tuple(r) for r in language_model.score(awkward(spark)).select("doc_id", "bits_per_byte").collect()), key=repr)
    monkeypatch.setattr(language_model, "HEAD", 3)
    small = sorted((tuple(r) for r in language_model.score(awkward(spark)).select("doc_id", "bits_per_byte").collect()), key=repr)
    assert [k for k, _ in small] == [k for k, _ in whole]
    assert [b for _, b in small] == pytest.approx([b for _, b in whole], rel=1e-5)


def test_every_decision_takes_its_own_gate():
    rng = np.random.default_rng(3)
    rows = rng.integers(-40, 40, (2 * mixer.GROUP, mixer.INPUTS + 1)).astype(np.int8)
    rows[rng.random(rows.shape) < 0.3] = 0
    bit = rng.integers(0, 2, len(rows))
    gate = mixer._gate(rows).astype(int)
    rows[:, mixer.INPUTS] = gate << 2 | 2 | bit
    start = rng.normal(0.4, 0.3, (mixer.GATES, mixer.INPUTS)).astype(np.float32)
    got = mixer._run(rows, np.array([1, 1]), [0, mixer.GROUP, 2 * mixer.GROUP], start, 1)
    weights, seen, want = start.astype(float) * mixer.LOGIT_UNIT, 1 / (1 + np.exp(mixer.MAP_BINS / 2 - 0.5 - np.arange(mixer.MAP_BINS))), 0.0
    for a in range(0, len(rows), mixer.GROUP):
        old, moved = weights.copy(), seen.copy()
        for i in range(a, a + mixer.GROUP):
            x = rows[i, : mixer.INPUTS].astype(float)
            logit = np.clip(x @ old[gate[i]], 0.5 - mixer.MAP_BINS / 2, mixer.MAP_BINS / 2 - 0.5)
            p, cell = 1 / (1 + math.exp(-logit)), int(logit + mixer.MAP_BINS / 2)
            weights[gate[i]] += x * (bit[i] - p) * mixer.RATE * mixer.LOGIT_UNIT**2
            p += (seen[cell] - p) / 4
            moved[cell] = seen[cell] + (bit[i] - seen[cell]) * mixer.MAP_RATE
            want -= math.log2(p if bit[i] else 1 - p)
        seen = moved
    assert got[0] == pytest.approx(want, rel=1e-4)


def test_start_weights_come_from_all_sampled_texts():
    rng = np.random.default_rng(7)
    texts = [rng.choice(list(b"ab "), 3_000_000).astype(np.uint8).tobytes(), b"zebra zone zoo " * 40_000]
    code = mixer.code_tree(np.bincount(np.frombuffer(b"".join(texts), np.uint8), minlength=256))
    counts = mixer.Counts()
    counts.add(texts, code)
    forth, back = mixer.train_weights(texts, code, counts.table), mixer.train_weights(texts[::-1], code, counts.table)
    assert forth == pytest.approx(back, rel=1e-4, abs=1e-5)


def test_the_model_learns_from_every_training_text(spark, monkeypatch):
    seen = {}
    tree, fit = mixer.code_tree, getattr(mixer, "fit_weights", None)
    monkeypatch.setattr(mixer, "code_tree", lambda counts: (seen.update(bytes=np.array(counts)), tree(counts))[1])
    monkeypatch.setattr(mixer, "fit_weights", lambda table: (seen.update(table=table.copy()), fit(table))[1], raising=False)
    rows = [(i, f"  Row {i % 977}\tof {'many few'.split()[i % 2]} ") for i in range(4500)]
    language_model.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    train = [" ".join(t.lower().split()).encode() + b"\n" for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    counts = np.bincount(np.frombuffer(b"".join(train), np.uint8), minlength=256)
    assert seen["bytes"].tolist() == counts.tolist()
    assert seen["table"].sum() == (counts * tree(counts).length).sum()  # every decision of every training text
    assert seen["table"][1::2].sum() == sum(mixer.decisions([t[:-1]], tree(counts)).bit.sum() for t in train)


def test_texts_that_wait_for_others_are_all_scored_alike(spark, monkeypatch):
    rows = [(i, "word " * (i % 40) + "x" * (i % 7) + str(i)) for i in range(300)] + [(None, None), (7, "twice"), (7, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    whole = sorted((tuple(r) for r in language_model.score(docs).collect()), key=repr)
    monkeypatch.setattr(language_model, "WAITING", 5000, raising=False)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        parts = sorted((tuple(r) for r in language_model.score(docs).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(whole) == len(rows) and [p[:5] for p in parts] == [w[:5] for w in whole]
    assert [p[6] for p in parts] == pytest.approx([w[6] for w in whole], rel=1e-4)


def test_equal_bytes_in_equal_contexts_are_handled_once():
    rng = np.random.default_rng(11)
    words = ["a", "of", "word", "words", "wordsmith", "wordsmiths", "naïveté", "\x00\x01", "x" * 40, "abcde", "abcdef"]
    texts = ["", "a", "wordsmith", "x" * 9, *(" ".join(rng.choice(words, rng.integers(0, 30))) for _ in range(300))]
    texts = [t.encode() for t in texts] * 3
    code = mixer.code_tree(np.bincount(np.frombuffer(b"\n".join(texts), np.uint8), minlength=256))
    met = list(mixer.distinct(texts))
    assert sum(times.sum() for _, _, times in met) == sum(len(t) + 1 for t in texts)
    assert sum(len(flat) for flat, _, _ in met) < sum(len(t) + 1 for t in texts) / 10
    # Tables as by every decision on its own.
    plain = np.zeros((mixer.INPUTS, 2 * mixer.SLOTS), np.uint32)
    parts = [mixer.decisions([t], code) for t in texts]
    for d in parts:
        for table, slot in zip(plain, d.slot):
            np.add.at(table, slot.astype(np.int64) * 2 + d.bit, np.uint32(1))
    counts = mixer.Counts()
    counts.add(texts, code)
    assert (counts.table == plain).all()
    tables, cells, want = mixer.logits(plain), mixer.left_out(plain), np.zeros(2 << mixer.CELL_BITS * mixer.INPUTS, np.uint64)
    for d, got in zip(parts, mixer._all_words(texts, code, tables), strict=True):
        at = 0
        units = np.stack([t[s] for t, s in zip(tables, d.slot)], axis=1)
        for i, s in enumerate(d.slot):
            at = at * mixer.CELLS + cells[i][s.astype(np.int64) * 2 + d.bit].astype(np.int64)
        np.add.at(want, at * 2 + d.bit, np.uint64(1))
        rows = got.view(np.int8).reshape(-1, mixer.INPUTS + 1)
        assert (rows[:, : mixer.INPUTS] == units).all()
        assert (rows[:, mixer.INPUTS] == (mixer._gate(units) << 2 | 2 | d.bit)).all()
    outcomes = mixer.Outcomes()
    outcomes.add(texts, code, cells)
    assert (outcomes.table == want).all()
