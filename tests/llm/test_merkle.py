"""The manifest against a plain build, over pages so small that every tier and path is used."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import awkward, empty
from tidewater.llm import merkle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row: dict) -> str:
    return sha(*["-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in FIELDS])


def plain_levels(digests: list[str], arity: int) -> list[list[str]]:
    levels = [digests]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha(*below[a : a + arity]) for a in range(0, len(below), arity)])
    return levels


def walk(levels: list[list[str]], at: int, digest: str, arity: int) -> tuple[str, str]:
    """(digest folded to the top, siblings met)"""
    proof = ""
    for below in levels[:-1]:
        first = at // arity * arity
        run = below[first : first + arity]
        proof += "".join(d for i, d in enumerate(run) if first + i != at)
        run[at - first] = digest
        digest, at = sha(*run), at // arity
    return digest, proof


def tampered(row: dict) -> bool:
    return row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0


def plain_manifest(rows: list[dict], arity: int) -> list[tuple]:
    nulls_first = lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0)
    trees: dict = {}
    for r in rows:
        trees.setdefault(r["lang"], []).append(r)
    names = sorted(trees, key=nulls_first)
    built = {}
    for name in names:
        own = sorted(trees[name], key=lambda r: (nulls_first(r["doc_id"]), plain_leaf(r)))
        built[name] = own, plain_levels([plain_leaf(r) for r in own], arity)
    top = plain_levels([built[name][1][-1][0] for name in names], arity)
    out = []
    for t, name in enumerate(names):
        own, levels = built[name]
        for i, r in enumerate(own):
            changed = {**r, "n_chars": r["n_chars"] + 1} if tampered(r) and r["n_chars"] is not None else r
            digest, proof = walk(levels, i, plain_leaf(changed), arity)
            digest, upper = walk(top, t, digest, arity)
            root = top[-1][0]
            out.append((r["doc_id"], plain_leaf(r), levels[-1][0], root, proof + upper, digest, digest == root))
    return out


def run(df, arity: int = 2) -> list[tuple]:
    fields = [F.col(f) for f in FIELDS]
    changed = [F.col("n_chars") + 1 if f == "n_chars" else F.col(f) for f in FIELDS]
    out = merkle.manifest(df, fields, changed, F.crc32(F.col("doc_id").cast("string")) % 7 == 0, arity=arity)
    return [tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified").collect()]


def ordered(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("arity,page", [(2, 4), (2, 4096), (3, 9)])
def test_manifest_equals_the_plain_build(spark, monkeypatch, arity, page):
    monkeypatch.setattr(merkle, "PAGE", page)
    # One tree of two thirds of the rows, a lone leaf, the NULL and the empty tree, several tiers, a short last run.
    data = [(i, f"text {i * 7 % 41} é", "en" if i % 3 else None if i % 2 else f"l{i % 12}", "s", i) for i in range(150)]
    data += [(1000, "alone", "zz", None, None), (1001, "", "", "", 0)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = run(df, arity)
    assert ordered(got) == ordered(plain_manifest([r.asDict() for r in df.collect()], arity))
    assert {r[-1] for r in got} == {True, False}


def test_nulls_repeats_ties_long_texts_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(merkle, "PAGE", 2)
    df = awkward(spark).withColumn("tree", F.lit("x")).withColumn("pos", F.lit("x")).withColumn("leaf", F.lit("x"))
    plain = plain_manifest([r.asDict() for r in df.collect()], 2)
    assert ordered(run(df)) == ordered(plain)


def test_empty_table_and_small_sums(spark):
    assert run(empty(spark)) == []
    one = empty(spark).sparkSession.createDataFrame([(5, "t", None, None, None)], empty(spark).schema)
    (row,) = run(one)
    assert row[1] == row[2] == row[3] == row[5] and row[4] == "" and row[6]


def test_resuming_a_state_hashes_only_what_is_right_of_the_slot():
    children = [sha(str(i)) for i in range(3)]
    parent = merkle.Parent(children)
    for slot in range(3):
        changed = [*children[:slot], sha("new"), *children[slot + 1 :]]
        assert parent.resume(slot, sha("new")) == sha(*changed)
    assert parent.digest == sha(*children) and len(parent.states) == 3
