from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tests.conftest import SF_SMALL
from tests.llm.test_mixing_and_simhash import plain_fingerprint
from tidewater.llm import mixing, ordinal, quality, toxicity


def test_registered_queries():
    names = {n for n in entry.queries() if n.startswith("op")}
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, SF_SMALL)
    clean = stages["toxicity"](spark, good, SF_SMALL)
    assert good.columns == clean.columns == columns
    single = stages["near_duplicates"](spark, clean, SF_SMALL).cache()
    assert single.columns == columns
    prints = [(r["doc_id"], plain_fingerprint(r["text"])) for r in single.collect()]
    assert all((a ^ b).bit_count() > 4 for i, (_, a) in enumerate(prints) for _, b in prints[:i])
    mixed = stages["mixing"](spark, single, SF_SMALL)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(single).collect()}
    got: dict = {}
    for r in mixed.select("doc_id").collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert mixed.columns == columns and got == {k: c for k, c in copies.items() if c}


WORDS = "amber brook cedar delta ember frost grove haven inlet jetty knoll ledge marsh north ocean prairie quarry ridge shore tundra".split()


def fixture_rows() -> tuple[list[tuple], list[tuple]]:
    """Good, poor and abusive texts with labels, copies, near copies, NULL ids, empty and NULL texts, an id twice, a long text."""
    rng = random.Random(21)
    docs, labels = [], []
    for i in range(260):
        kind = "poor" if i % 6 == 1 else "toxic" if i % 6 == 3 else "good"
        words = [rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(rng.randint(20, 60))]
        if kind == "poor":
            words = [w.upper() + "!!" if j % 2 else "CLICK" for j, w in enumerate(words)]
        if kind == "toxic":
            for j in range(0, len(words), 4):
                words[j] = rng.choice(["vilewordone", "vilewordtwo", "vilewordthree"])
        docs.append((i, " ".join(words), "en", "abc"[i % 3] if i % 10 else None, 0))
        if i % 5:
            labels.append((i, int(kind != "poor"), int(kind == "toxic")))
    good = [d for d in docs if d[0] % 6 not in (1, 3)]
    docs += [(1000 + i, good[2][1], "en", "a", 0) for i in range(30)]  # copies
    docs += [(1100 + i, good[5][1] + f" tail{i}", "en", "b", 0) for i in range(4)]
    docs += [(None, "a text without any id lies here among the others for once", "en", "a", 0), (None, None, "en", "c", None)]
    docs += [(good[7][0], "the same id with quite another text than it had before", "fr", "b", 1), good[9], good[9]]
    docs += [(2000, "", "en", "c", 0), (2001, " \t ", "en", None, 3), (2002, " ".join(f"{w}{k}" for k in range(400) for w in WORDS[:9]), "en", "c", 0)]
    return docs, labels


def plain_features(text: str, with_looks: bool) -> dict[int, float]:
    """Words, stems and looks of the whole text, token by token."""
    import xxhash

    number = lambda x, seed: (xxhash.xxh3_64_intdigest(x, seed) >> 4) + 16
    out: dict[int, float] = {}
    for token in text.lower().split():
        for word in re.findall(r"\w+", token) if not token.isalnum() else [token]:
            out[number(word, 1)] = 1.0
            for n in (4, 5):
                if len(word) > n:
                    out[number(word[:n], n)] = 1.0
    tokens = text.split()
    if with_looks and tokens:
        sums: dict[int, float] = {}
        for token in tokens:
            look = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in token)
            look = re.sub(r"(.)\1+", r"\1", look)
            sums[number(look, 2)] = sums.get(number(look, 2), 0) + 1
        again = sum(x == y for x, y in zip(tokens, tokens[1:]))
        if again:
            sums[7] = again
        out |= {f: (n / len(tokens)) ** 0.5 for f, n in sums.items()}
    return out


def plain_tail(model, text: str | None, with_looks: bool) -> float:
    z = sum(model.weights.get(f, 0.0) * v for f, v in plain_features(text or "", with_looks).items())
    return 1 / (1 + math.exp(-(z - model.thresholds[0])))


def plain_groups(rows: list[tuple]) -> list[tuple]:
    """One row of every group of fingerprints within four bits, the one with the smallest id."""
    prints = [plain_fingerprint(r[1] or "") for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    best: dict = {}
    for r, g in zip(rows, label):
        if g not in best or (r[0] is None, r[0] or 0) < (best[g][0] is None, best[g][0] or 0):
            best[g] = r
    return list(best.values())


def test_run_equals_a_plain_pipeline(spark, tmp_dir):
    docs, labels = fixture_rows()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    frame = spark.createDataFrame(docs, schema)
    for clash in ("taken", "fingerprint", "sequence_id", "llm_label", "size", "quality", "score"):
        frame = frame.withColumn(clash, F.lit("mine"))
    frame.repartition(3).write.parquet(f"{tmp_dir}/documents.parquet")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    marks.write.parquet(f"{tmp_dir}/labels.parquet")
    got = corpus_pipeline.run(spark, tmp_dir).collect()

    judge = quality.train(frame, marks.withColumn("grade", quality.rating()), "grade")
    good = [r for r in docs if plain_tail(judge, r[1], True) >= 0.5]
    assert 0 < len(good) < len(docs)
    guard = toxicity.train(spark.createDataFrame(good, schema), marks)
    clean = [r for r in good if plain_tail(guard, r[1], False) < 0.5]
    assert 0 < len(clean) < len(good) and not any("vileword" in (r[1] or "") for r in clean)
    single = plain_groups(clean)
    assert 30 < len(clean) - len(single)
    copies = mixing.mix(spark.createDataFrame(single, schema)).collect()
    taken = {r["doc_id"]: [] for r in copies}
    for r in copies:
        taken[r["doc_id"]].append((r["size"], r["copies"]))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want: Counter = Counter()
    for key, text, *_ in single:
        words = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        times = next(c for n, c in taken[key] if n == words)
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)]
        for piece, (a, z) in enumerate(zip(cuts, cuts[1:])):
            want[key, piece, a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes())] += times
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == +want
    by_sequence: dict = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by_sequence.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 1024


def test_empty_tables_go_through_every_stage(spark, tmp_dir):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_dir}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_dir}/labels.parquet")
    assert corpus_pipeline.run(spark, tmp_dir).collect() == []


def test_plain_scorers_agree_with_the_operators(spark):
    docs, labels = spark.read.parquet(f"{SF_SMALL}/documents.parquet"), spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    judge = quality.train(docs, labels.withColumn("llm_rating", quality.rating()), "llm_rating")
    for r in quality.quality(docs, labels).collect():
        assert r["tail_probability"] == pytest.approx(plain_tail(judge, texts[r["doc_id"]], True), abs=1e-9)
    guard = toxicity.train(docs, labels)
    for r in toxicity.toxicity(docs, labels).collect():
        assert r["p_toxic"] == pytest.approx(plain_tail(guard, texts[r["doc_id"]], False), abs=1e-9)


def test_features_are_chosen_as_the_plain_test_chooses(spark):
    docs, labels = spark.read.parquet(f"{SF_SMALL}/documents.parquet"), spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    rated = labels.withColumn("grade", quality.rating())
    made = toxicity.labelled_features(toxicity.labelled_sample(docs, rated, "grade", 500, "doc_id", "text"), quality._features)
    rows = made.collect()
    x = ordinal.Sparse([(np.array(r["f"]), np.array(r["v"])) for r in rows])
    ordinal.select_features(x, np.array([r["g"] for r in rows], float), 5, 2.0, 300)
    assert toxicity.chosen_features(made, 5, 2.0, 300) == sorted(x.names.tolist())


def test_mixing_takes_each_of_several_texts_of_one_id_by_its_own_copies(spark):
    data = [(i % 5 or None, f"word{i} and {i} more", "en", "ab"[i % 2], 0) for i in range(40)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    want = sorted(r["copies"] for r in mixing.mix(docs).collect() if r["copies"])
    got: dict = {}
    for r in corpus_pipeline.mixing_stage(spark, docs, SF_SMALL).collect():
        got[r["doc_id"], r["text"]] = got.get((r["doc_id"], r["text"]), 0) + 1
    assert sorted(got.values()) == want
