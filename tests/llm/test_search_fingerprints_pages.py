from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import ROWS, awkward, empty
from tidewater.llm import extraction, fingerprints, oph, topk
from tidewater.llm.mtree import MTree


def plain_top(rows: list[tuple[int, np.ndarray]], k: int) -> list[tuple]:
    """Every row against every other, repeated ids included."""
    out = []
    for at, (q, v) in enumerate(rows):
        if q % 50 == 0:
            scored = sorted((-int(w @ v), i) for j, (i, w) in enumerate(rows) if j != at and len(w) == len(v))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def test_top_k_equals_brute_force_with_ties_repeats_and_bad_vectors(spark):
    rng = np.random.default_rng(2)
    data = [(i, [float(x) for x in rng.normal(0, 0.4, 8)]) for i in range(700)]
    data += [(i, data[0][1]) for i in range(700, 900)]  # copies of one vector
    data += [(i % 120, [float(x) for x in rng.normal(0, 0.4, 8)]) for i in range(180)]  # ids that are there already, with other vectors
    data += [data[50], data[50], data[7]]  # whole rows again
    data += [(2000 + i, [float(x) for x in rng.normal(0, 0.4, 5)]) for i in range(60)]  # another length
    data += [(3000, [0.5] * 3), (3001, [9.0] * 3)]  # fewer candidates than k
    good = [(i, np.floor(256 * np.float32(v).astype(float))) for i, v in data]
    data += [(1000, None), (1050, [1.0, None] + [0.0] * 6), (1100, [float("nan")] * 8), (1150, [float("inf")] + [0.0] * 7), (1200, []), (None, [0.1] * 8)]
    rows = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x")).withColumn("row", F.lit("x")).repartition(4)
    got = sorted(map(tuple, topk.top_k(rows, F.col("vec_id") % 50 == 0, tree_rows=150).collect()))
    assert got == plain_top(good, 5)
    assert topk.top_k(rows.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_a_block_finds_what_each_query_finds():
    rng = np.random.default_rng(6)
    vectors = np.floor(rng.normal(0, 40, (900, 12)))
    vectors[100:160] = vectors[0]
    ids = rng.integers(0, 500, 900)
    tree = MTree(ids, vectors, float((vectors**2).sum(axis=1).max()), page=16, rows=np.arange(900))
    asked = np.arange(0, 900, 7)
    score, at = tree.search_block(vectors[asked], 5, asked, np.full(len(asked), -np.inf))
    for q, own_scores, own_at in zip(asked, score, at):
        all_scores = vectors @ vectors[q]
        want = sorted((-all_scores[i], ids[i], i) for i in range(900) if i != q)[:5]
        assert [(-s, ids[i], i) for s, i in zip(own_scores, own_at)] == want
    bound = score[:, -1]
    again = tree.search_block(vectors[asked], 5, asked, bound)
    assert (again[0] == score).all() and (again[1] == at).all()  # ties at the bound are not lost


def test_tree_skips_computations_and_stays_exact():
    rng = np.random.default_rng(4)
    centers = rng.normal(0, 300, (20, 6))
    vectors = np.floor(centers[rng.integers(0, 20, 3000)] + rng.normal(0, 5, (3000, 6)))
    tree = MTree(np.arange(3000), vectors, float((vectors**2).sum(axis=1).max()))
    for q in range(0, 3000, 300):
        scores = vectors @ vectors[q]
        want = sorted(((int(s), i) for i, s in enumerate(scores) if i != q), key=lambda x: (-x[0], x[1]))[:5]
        assert tree.search(vectors[q], 5, q) == want
    assert tree.computed < 0.7 * 10 * 3000


def test_edit_likeness_on_awkward_rows(spark):
    out = fingerprints.edit_likeness(awkward(spark)).collect()
    assert len(out) == len(ROWS)
    texts = {k: t or "" for k, t, *_ in ROWS}
    order = [8, 7, 6, 5, 4, 3, 2, 2, 1, None]
    following = {k: order[(i + 1) % len(order)] for i, k in enumerate(order)}
    seen: dict = {}
    for r in out:
        text = texts[r["doc_id"]]
        assert r["n_chars"] == len(text)
        options = {following[r["doc_id"]]} | ({2} if r["doc_id"] == 2 else set())
        shas = set()
        for n in options:
            cut = len(text) // 3
            shas.add(hashlib.sha256((text[: len(text) - cut] + texts[n][:cut]).encode()).hexdigest())
        assert r["edited_sha256"] in shas
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert seen.setdefault(text, r["fingerprint"]) == r["fingerprint"]
    assert fingerprints.edit_likeness(empty(spark)).collect() == []
    lone = fingerprints.edit_likeness(awkward(spark).filter("doc_id = 8")).collect()
    assert len(lone) == 1 and lone[0]["near_next"] == 1.0


def plain_minima(text: str) -> list[int] | None:
    """One-permutation MinHash with optimal densification, bin by bin."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return None
    shingles = {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    bins: dict[int, int] = {}
    for s in shingles:
        h = xxhash.xxh3_64_intdigest(s, 20)
        b = h >> 55
        bins[b] = min(bins.get(b, h), h)
    out = []
    for b in range(512):
        at, r = b, 0
        while at not in bins:
            x = ((r << 32) + b + 1) % 2**64
            x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) % 2**64
            x = ((x ^ x >> 27) * 0x94D049BB133111EB) % 2**64
            at, r = (x ^ x >> 31) >> 55, r + 1
        out.append(bins[at])
    return out


def test_minima_equal_the_plain_densification():
    for n in (1, 4, 5, 6, 7, 9, 14, 40, 300, 5000):
        text = " ".join(f"w{i * i % 1009}x{i}" for i in range(n))
        assert oph.minima(text).tolist() == plain_minima(text), n
    assert plain_minima(" ") is None


def test_ties_and_null_keys_spread_over_the_ranges(spark):
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text number {i} with words of its own") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    made = fingerprints.edit_likeness(df)
    sizes = sorted(r["count"] for r in made.groupBy(F.spark_partition_id().alias("p")).count().collect())
    assert sum(sizes) == 900 and len(sizes) >= 6 and sizes[-1] < 3 * 900 / len(sizes)
    # Every row has the true successor, whatever range it lies in.
    order = {t: h for t, h in df.select("text", F.xxhash64("text")).collect()}
    listed = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), order[r[1]]))
    want = []
    for (k, t), (_, nxt) in zip(listed, listed[1:] + listed[:1]):
        cut = len(t) // 3
        want.append((k, hashlib.sha256((t[: len(t) - cut] + nxt[:cut]).encode()).hexdigest()))
    assert sorted([(r["doc_id"], r["edited_sha256"]) for r in made.collect()], key=repr) == sorted(want, key=repr)


def test_likeness_estimates_jaccard():
    words = [f"w{i}" for i in range(1000)]
    for shared in (900, 600, 200):
        a, b = " ".join(words), " ".join(words[:shared] + [f"z{i}" for i in range(1000 - shared)])
        common = shared - 4
        true = common / (2 * 996 - common)
        assert abs(oph.likeness(oph.pack(oph.minima(a)), oph.pack(oph.minima(b))) - true) < 0.12
    assert oph.likeness(b"", b"") == 1.0 and oph.likeness(b"", oph.pack(oph.minima("a"))) == 0.0
    assert oph.minima(" \n") is None


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";x(0);</script></head><body>
<header class="site">Site name</header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Title &amp; more</h1><p><b>First   line<br>goes on.<p>Second &eacute;.</p><form>Name <input></form>
<div class="ad">Buy</div><div>In a block</div><section id="comments"><p>Nice post!</p></section></article>
<aside>Related</aside><footer>Imprint"""


def test_article_without_its_surroundings():
    assert extraction.main_text(PAGE) == "Title & more\nFirst line goes on.\nSecond é.\nIn a block"


def test_pages_without_article_use_the_text_density():
    menu = "".join(f"<div><a href='/{i}'>x{i}</a><a href='/y'>y</a></div>" for i in range(12))
    prose = "".join(f"<p>{'Long running prose without any links at all. ' * 5}</p>" for _ in range(6))
    got = extraction.main_text(f"<body>{menu}<h2>Head</h2>{prose}{menu}</body>")
    assert got.count("Long running") == 30 and "x3" not in got


def test_uniform_pages_keep_every_line():
    lines = [" ".join(["Each sentence here is like the others."] * (1 + i * 7 % 4)) for i in range(20)]
    assert extraction.main_text("<body>" + "".join(f"<p>{t}</p>" for t in lines) + "</body>").split("\n") == lines


def test_comments_never_come_out_however_long():
    thread = "<section class='comments'>" + "".join(f"<p>{'A reader says what readers say at length. ' * 5}</p>" for _ in range(20)) + "</section>"
    story = "<h1>Title</h1><p>The story itself is short.</p><p>It has two paragraphs.</p>"
    for page in (f"<article>{story}{thread}</article>", f"<article>{story}</article>{thread}", f"<body>{story}{thread}</body>", f"<main>{thread}{story}</main>"):
        assert extraction.main_text(page) == "Title\nThe story itself is short.\nIt has two paragraphs.", page


def plain_clusters(ratios: list[float]) -> list[bool]:
    """Gaussian of five lines renormalised at the ends, then the threshold by exhausting the halving rule."""
    n = len(ratios)
    curve = np.zeros(n)
    for i in range(n):
        w = np.array([np.exp(-((j - i) ** 2) / 8.0) if abs(j - i) <= 2 else 0.0 for j in range(n)])
        curve[i] = (w * ratios).sum() / w.sum()
    threshold = (curve.min() + curve.max()) / 2
    for _ in range(50):
        high, low = curve[curve >= threshold], curve[curve < threshold]
        if not len(high) or not len(low):
            break
        moved = (high.mean() + low.mean()) / 2
        if abs(moved - threshold) < 1e-9:
            break
        threshold = moved
    return [bool(c) for c in curve >= threshold]


def test_ratios_and_clusters_equal_a_plain_version():
    rng = np.random.default_rng(9)
    for n in (1, 2, 3, 7, 40):
        ratios = [float(x) for x in rng.choice([2, 5, 30, 120, 400], n) * rng.uniform(0.7, 1.3, n)]
        assert extraction.clusters(ratios) == plain_clusters(ratios)
    parser = extraction._Lines()
    parser.feed("<body><div><a href='/'>Home</a></div><p>Twelve chars</p><br><p>Two <b>bold</b> words</p></body>")
    parser.close()
    parser.end_line()
    # (text, tags since the line before, article, heading, mostly links): the ratio of a line is its characters by its tags.
    assert parser.kept() == [("Home", 5, 0, False, True), ("Twelve chars", 2, 0, False, False), ("Two bold words", 5, 0, False, False)]


def test_very_long_and_deeply_nested_pages():
    deep = "<div>" * 3000 + "<p>Down here.</p>" + "</div>" * 3000
    assert extraction.main_text(deep) == "Down here."
    long = "<article>" + "".join(f"<p>Paragraph {i} has its words.</p>" for i in range(20_000)) + "</article>"
    assert extraction.main_text(long).count("\n") == 19_999


def test_extract_on_odd_pages(spark):
    pages = [(1, "u", None), (2, "u", ""), (3, None, "<p>unclosed"), (4, "u", "<![foo[ <p>a</p> &#x; &bogus; <"), (5, "u", "plain"), (5, "u", "plain")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("old"))
    got = sorted(map(tuple, extraction.extract(df).select("page_id", "text").collect()))
    assert [t for _, t in got[:3]] == ["", "", "unclosed"] and got[-2:] == [(5, "plain"), (5, "plain")]
    assert extraction.extract(df.limit(0)).collect() == []


def test_a_teaser_article_does_not_displace_the_body():
    body = "".join(f"<div>{f'Sentence {i} of the body goes on for a while here. ' * 6}</div>" for i in range(8))
    teaser = "<article><h2>Related</h2><p>One short teaser.</p></article>"
    got = extraction.main_text(f"<body><h1>Head</h1>{body}{teaser}</body>")
    assert got.startswith("Head") and got.count("of the body") >= 42 and "teaser" not in got
    long = "<article><h2>Own</h2>" + f"<p>{'Marked text that is long enough to be content. ' * 6}</p>" * 4 + "</article>"
    both = extraction.main_text(f"<body>{body}{long}</body>")
    assert both.count("of the body") >= 24 and both.count("Marked text") == 24 and "Own" in both


def test_skipped_elements_do_not_swallow_the_article():
    text = "The first sentence of the story. The second sentence of the story."
    article = f"<article><h1>Title</h1><p>{text}</p></article>"
    want = f"Title\n{text}"
    pages = [
        f"<html><head><title>T</title><meta charset=utf-8><body>{article}</body></html>",
        f"<html><head><title>T</title>{article}</html>",
        f"<html><head><title>T</title><noscript><p>No script.</noscript></head><body>{article}</body></html>",
        f"<body><div><noscript><p>No script.</noscript>{article}</div></body>",
        f"<body><form action='/x'>{article}</form></body>",
        f"<body><div id='page'><div class='layout has-sidebar'>{article}<div class='sidebar'>Menu here</div></div></div></body>",
        *[f"<body><div class='{name}'>{article}</div></body>" for name in ("no-sidebar", "content with-menu", "layout has-sidebar")],
    ]
    assert [extraction.main_text(p) for p in pages] == [want] * len(pages)
    bulk = "".join(f"<p>{text * 3}</p>" for _ in range(6))
    assert extraction.main_text(f"<body><div class='no-sidebar'>{bulk}</div></body>") == extraction.main_text(f"<body><div>{bulk}</div></body>") != ""
    math = "<p>Let <math><mi>x</mi><annotation encoding='tex'>\\xi</annotation></math> be a number, and go on from there.</p>"
    assert extraction.main_text(f"<article>{math}</article>") == "Let x be a number, and go on from there."
    comments = "<div id='comments'><article><p>Nice post!</p></article></div>"
    assert extraction.main_text(f"<body>{article}{comments}</body>") == want
