"""Registered queries ``opN_*``: each operator over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import extraction, fingerprints, language_model, merkle, mixing, orchard, packing, quality, simhash, token_counts, topk, toxicity, transducer
from tidewater.llm.common import read_table

BPE_FILE = "byte_bpe_50k.json"


def op1_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(read_table(spark, sf_dir, "documents"))


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path(BPE_FILE), end_id=2, capacity=1024, payload="crc32")


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"), weights=(5, 2, 1), max_repeat=3)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"), width=4, distance=4)


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_likeness(read_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extraction.extract(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_FILE), limit=1024)


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    tokenizer = public_tokenizers.path(BPE_FILE)
    encoded = transducer.with_ids(docs, tokenizer, out="ids").drop("text")
    decoded = transducer.with_text(encoded, tokenizer, ids="ids", out="decoded")
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orchard.cluster(read_table(spark, sf_dir, "embeddings"), k=16, rounds=3, scale=64, dim=64, seed=1)


def _op12_sql(rounds: int) -> str:
    """Every distance of every round, with the smallest taken; means by floor division of exact sums."""
    distance = "CAST(list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    ctes = []
    for r in range(rounds + 1):
        ctes.append(
            f"""a{r} AS (SELECT rid, vec_id, v, cluster, distance FROM (
  SELECT k.rid, k.vec_id, k.v, c.c AS cluster, {distance} AS distance FROM kept k, c{r} c)
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY distance, cluster) = 1)"""
        )
        if r < rounds:
            ctes.append(
                f"""s{r} AS (SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY cluster, i),
m{r} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{r} GROUP BY cluster),
c{r + 1} AS (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m ON m.cluster = c.c)"""
            )
    return f"""
WITH kept AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), vec_id NULLS LAST, v) - 1 AS c, v FROM kept QUALIFY c < 16),
{", ".join(ctes)}
SELECT a.vec_id, CAST(a.cluster AS INTEGER) AS cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = a.cluster
"""


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    # Wider than a long, so that the largest long plus one is a number too.
    tampered = [F.col("n_chars").cast("decimal(20,0)") + 1 if i == 3 else f for i, f in enumerate(fields)]
    tested = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    made = merkle.manifest(docs, fields, tampered, tested, key="doc_id", tree="lang", arity=2)
    proof = F.sha2("proof", 256).alias("proof_sha256")
    return made.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", "verified")


#: Fields, CRC-32 bit by bit, all levels of all trees, then two walks from the leaves to the root.
OP13_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, lang, n_chars, coalesce(CAST(strlen(CAST(doc_id AS VARCHAR)) AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR), '-')
      || coalesce(CAST(strlen(source) AS VARCHAR) || ':' || source, '-') || coalesce(CAST(strlen(lang) AS VARCHAR) || ':' || lang, '-') AS head,
    coalesce(CAST(strlen(text) AS VARCHAR) || ':' || text, '-') AS tail,
    xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) AS crc
  FROM documents),
n AS (SELECT doc_id, lang, sha256(head || coalesce(CAST(strlen(CAST(n_chars AS VARCHAR)) AS VARCHAR) || ':' || CAST(n_chars AS VARCHAR), '-') || tail) AS leaf,
    sha256(head || coalesce(CAST(strlen(CAST(n_chars + 1 AS VARCHAR)) AS VARCHAR) || ':' || CAST(n_chars + 1 AS VARCHAR), '-') || tail) AS changed,
    coalesce(crc % 7 = 0, false) AS tested
  FROM d),
leaves AS (SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, leaf, CASE WHEN tested THEN changed ELSE leaf END AS used,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
  FROM n),
low AS (
  SELECT 0 AS lvl, tree, pos, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT lvl + 1, tree, pos // 2, any_value((n + 1) // 2), sha256(string_agg(digest, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY lvl, tree, pos // 2),
subroots AS (SELECT tree, digest, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT 0 AS lvl, tree AS pos, n, digest FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 2, any_value((n + 1) // 2), sha256(string_agg(digest, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY lvl, pos // 2),
up AS (
  SELECT row_number() OVER () AS id, 0 AS lvl, tree, pos, n, doc_id, leaf, used AS folded, '' AS proof FROM leaves
  UNION ALL
  SELECT u.id, u.lvl + 1, u.tree, u.pos // 2, (u.n + 1) // 2, u.doc_id, u.leaf,
    sha256(CASE WHEN u.pos % 2 = 1 THEN s.digest || u.folded ELSE u.folded || coalesce(s.digest, '') END), u.proof || coalesce(s.digest, '')
  FROM up u LEFT JOIN low s ON s.lvl = u.lvl AND s.tree = u.tree AND s.pos = xor(u.pos, 1) WHERE u.n > 1),
over AS (
  SELECT u.id, 0 AS lvl, u.tree AS pos, r.n, u.doc_id, u.leaf, r.digest AS subroot, u.folded, u.proof
  FROM up u JOIN subroots r ON r.tree = u.tree WHERE u.n = 1
  UNION ALL
  SELECT o.id, o.lvl + 1, o.pos // 2, (o.n + 1) // 2, o.doc_id, o.leaf, o.subroot,
    sha256(CASE WHEN o.pos % 2 = 1 THEN s.digest || o.folded ELSE o.folded || coalesce(s.digest, '') END), o.proof || coalesce(s.digest, '')
  FROM over o LEFT JOIN high s ON s.lvl = o.lvl AND s.pos = xor(o.pos, 1) WHERE o.n > 1)
SELECT o.doc_id, o.leaf, o.subroot, r.digest AS root, sha256(o.proof) AS proof_sha256, o.folded AS folded_root, o.folded = r.digest AS verified
FROM over o, (SELECT digest FROM high WHERE n = 1) r WHERE o.n = 1
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_model": op1_language_model,
    "op2_pack": op2_pack,
    "op3_mix": op3_mix,
    "op4_simhash": op4_simhash,
    "op5_top_k": op5_top_k,
    "op6_fingerprints": op6_fingerprints,
    "op7_toxicity": op7_toxicity,
    "op8_quality": op8_quality,
    "op9_token_counts": op9_token_counts,
    "op10_extract": op10_extract,
    "op11_bpe": op11_bpe,
    "op12_clusters": op12_clusters,
    "op13_merkle": op13_merkle,
}

#: Oracles where SQL can express the operator.
ORACLES: dict[str, str] = {
    "op12_clusters": _op12_sql(rounds=3),
    "op13_merkle": OP13_SQL,
}
