"""Encoding against the tokenizers library, stability against every continuation, decoding against the whole bytes."""

from __future__ import annotations

import hashlib
import itertools
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.helpers import ROWS, awkward, empty
from tidewater.llm import queries, transducer
from tidewater.llm.transducer import Decoder, Encoder, Merges, PieceEncoder, open_character, vocabulary

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = (
    "a aa the 're 'r ' 1 22 ! --- ==== <|endoftext|> <|endof < |> 中 é 😀 'll 'L Ⅷ ² _ \x1c \x85 ÿ"
).split(" ") + [" ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "　", "́", "᠎", "\u0558", "\u058b", "\U0003fc3d"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def lookahead():
    return vocabulary(PATH).merges.lookahead()


def random_text(rng: random.Random) -> str:
    return "".join(rng.choice(PARTS) * rng.choice([1, 1, 1, 2, 7, 60]) for _ in range(rng.randint(0, 14)))


def test_any_text_in_any_window_equals_the_library(library, lookahead):
    rng = random.Random(11)
    odd = transducer.odd_characters(PATH)
    encoders = [Encoder(vocabulary(PATH), lookahead, odd, window=w) for w in (8, 9, 16, 64, 1 << 15)]
    for _ in range(1500):
        text = random_text(rng)
        want = library.encode(text, add_special_tokens=False).ids
        encoder = rng.choice(encoders)
        assert np.frombuffer(encoder.encode(text), "<i4").tolist() == want, (encoder.window, text)


def test_every_character_is_cut_as_the_library_cuts_it(library, lookahead):
    encoder = Encoder(vocabulary(PATH), lookahead, transducer.odd_characters(PATH))
    for first in range(0, 0x110000, 8192):
        text = "".join(f"a{chr(c)}a1{chr(c)}1!{chr(c)}!\n" for c in range(first, first + 8192) if not 0xD800 <= c <= 0xDFFF)
        cut = [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]
        pattern = encoder.corrected[0] if encoder.odd and encoder.odd.search(text) else transducer.PATTERNS[0]
        assert pattern.findall(text) == cut


def test_parts_of_any_size_give_the_same_ids_and_come_early(library, lookahead):
    rng = random.Random(12)
    for run in ("x" * 40_000, "-=" * 20_000, " " * 30_000 + "y", "é" * 20_000 + "'s", "\n" * 20_000 + " b", "7" * 30_000 + "<|endoftext|>" + "7" * 9):
        encoder, out, at, early = Encoder(vocabulary(PATH), lookahead, window=256), [], 0, 0
        while at < len(run):
            n = rng.randint(1, 700)
            out.append(encoder.feed(run[at : at + n]))
            at += n
            held = len(encoder.text) + (len(encoder.run[1].held) if encoder.run else 0)
            assert held <= 256 + 1024 + 4 * lookahead  # constant, whatever has been read
            early += len(out[-1])
        out.append(encoder.finish())
        assert np.frombuffer(b"".join(out), "<i4").tolist() == library.encode(run, add_special_tokens=False).ids
        assert early > 0


def merges_of(rules: list[str], alphabet: str) -> Merges:
    ids = {c: i for i, c in enumerate(alphabet)}
    out = []
    for rule in rules:
        a, b = rule.split("+")
        ids[a + b] = len(ids)
        out.append((ids[a], ids[b], ids[a + b]))
    byte_ids = [ids.get(chr(b), -1) for b in range(256)]
    return Merges(byte_ids, out, {i: len(t) for t, i in ids.items()})


def plain_merge(merges: Merges, data: bytes) -> list[int]:
    """Rule by rule, left to right."""
    ids = [merges.byte_ids[b] for b in data]
    for a, b, made in merges.rules:
        out, i = [], 0
        while i < len(ids):
            if ids[i : i + 2] == [a, b]:
                out.append(made)
                i += 2
            else:
                out.append(ids[i])
                i += 1
        ids = out
    return ids


def random_merges(rng: random.Random) -> Merges:
    tokens, rules = list("ab"), []
    for _ in range(rng.randint(1, 6)):
        a, b = rng.choice(tokens), rng.choice(tokens)
        if a + b not in tokens and len(a + b) <= 5:
            tokens.append(a + b)
            rules.append(f"{a}+{b}")
    return merges_of(rules, "ab")


def test_no_continuation_changes_a_stable_token():
    rng = random.Random(3)
    for _ in range(120):
        merges = random_merges(rng)
        reach = merges.lookahead()
        for _ in range(6):
            text = "".join(rng.choice("ab") for _ in range(rng.randint(1, reach + 6)))
            whole = merges.merge(text.encode())
            for tail in map("".join, itertools.chain.from_iterable(itertools.product("ab", repeat=n) for n in range(1, 6))):
                other = merges.merge((text + tail).encode())
                end = 0
                for mine, theirs in zip(whole, other):
                    end += merges.lengths[mine]
                    if end > len(text) - reach:
                        break
                    assert mine == theirs, (merges.rules, text, tail, reach)


def test_merging_equals_rule_by_rule_and_pieces_equal_the_whole():
    rng = random.Random(4)
    for _ in range(200):
        merges = random_merges(rng)
        data = "".join(rng.choice("ab") for _ in range(rng.randint(0, 80))).encode()
        assert merges.merge(data) == plain_merge(merges, data)
        piece = PieceEncoder(merges, merges.lookahead())
        piece.window = 2 * (merges.lookahead() + merges.longest)
        got = []
        for i in range(0, len(data), 3):
            got += piece.feed(data[i : i + 3])
        assert got + piece.finish() == plain_merge(merges, data)


def test_lookahead_of_a_chain_and_of_no_merges():
    # c decides whether b merges, b whether a does: two bytes reach back through two later merges.
    assert merges_of([], "ab").lookahead() == 0
    chain = merges_of(["c+d", "b+c", "a+b"], "abcd")
    assert chain.lookahead() == 3
    assert [len(chain.merge(t)) for t in (b"abcd", b"abc")] == [2, 2]
    with pytest.raises(ValueError):
        Merges([0, 1], [(0, 5, 6)], {0: 1, 1: 1, 6: 2})


def test_decoding_in_parts_equals_decoding_whole(library):
    rng = random.Random(5)
    bytes_of = vocabulary(PATH).bytes_of
    for _ in range(800):
        ids = [rng.randrange(50_257) for _ in range(rng.randint(0, 12))]
        want = b"".join(bytes_of[i] for i in ids).decode("utf-8", "replace")
        assert Decoder(bytes_of).decode(np.array(ids, np.int32), rng.randint(1, 4)) == want == library.decode(ids, skip_special_tokens=False)
    decoder, text = Decoder(bytes_of), "😀é中"
    steps = [decoder.feed([i]) for i in library.encode(text).ids]
    assert "".join(steps) == text and "" in steps and decoder.finish() == ""


def test_open_character_is_what_more_bytes_can_complete():
    for first in range(256):
        for data in (bytes([first]), bytes([first, 0x80]), bytes([first, 0x9F]), bytes([first, 0xBF, 0xBF]), bytes([0x41, first])):
            n = open_character(data)
            if n:
                tails = [bytes(t) for k in (1, 2, 3) for t in itertools.product([0x80, 0x8F, 0x90, 0x9F, 0xA0, 0xBF], repeat=k)]
                assert any("�" not in (data[len(data) - n :] + t).decode("utf-8", "replace") for t in tails)
            assert data[: len(data) - n].decode("utf-8", "replace") + "|" == (data[: len(data) - n] + b"|").decode("utf-8", "replace")


def test_awkward_table_round_trip(spark, library):
    frame = awkward(spark).withColumn("ids", F.lit("mine")).withColumn("decoded", F.lit("x"))
    encoded = transducer.with_ids(frame, PATH)
    assert sorted(encoded.columns) == sorted(frame.columns)
    for r in encoded.collect():
        assert r["ids"] == library.encode(r["text"] or "", add_special_tokens=False).ids
    back = transducer.with_text(encoded, PATH, out="decoded").collect()
    assert all(r["decoded"] == (r["text"] or "") for r in back) and len(back) == len(ROWS)
    nothing = transducer.with_ids(empty(spark), PATH)
    assert transducer.with_text(nothing, PATH, out="back").collect() == []
    lists = spark.createDataFrame([(1, None), (2, []), (3, [None, 99_999_999, 50_256, 65])], "id int, ids array<int>")
    assert {r["id"]: r["back"] for r in transducer.with_text(lists, PATH, out="back").collect()} == {1: None, 2: "", 3: "<|endoftext|>" + library.decode([65])}


def test_query_digests(spark, library):
    for r in queries.op11_bpe(spark, "/root/testdata/sf0.001").join(
        spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.col("text").alias("plain")), "doc_id"
    ).collect():
        text = r["plain"] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
