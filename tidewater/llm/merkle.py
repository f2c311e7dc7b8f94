"""Merkle manifest of a table: leaf, sub-tree root and root digests, sibling proofs, and folding of replaced leaves.

A parent's digest is the hash of its children's digests, so a parent keeps a
*midstate* before each child slot: a copy of the running hash after the
children to the left.  Folding a replaced child resumes the state of its slot
with the replacement and the siblings to its right; nothing to its left is
hashed again.

Trees are built in tiers of pages.  A page is ``arity ** depth`` neighbouring
nodes, at most ``PAGE``; its levels are hashed in one task, and page roots are
the nodes of the next tier.  A table of 10^10 rows has three tiers.  On the way
down a page gets the path above its root, one entry of left and right siblings
per level, so the states above are made once per page and not once per leaf.
Hash states do not leave a process, so each task that folds makes the states of
its own page, from digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import settle, ship_package
from tidewater.operators.rank_index import RANGE, build_rank_index

#: Most nodes of a page; also the most rows a group of this module ever holds.
PAGE = 4096
#: Rows of a (range, tree) table that may be broadcast: 32 bytes each.
SMALL = 200_000

PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """``-`` for NULL, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    """Lowercase hex SHA-256 of the fields of a row."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def page_depth(arity: int) -> int:
    """Levels of a page."""
    depth = 1
    while arity ** (depth + 1) <= PAGE:
        depth += 1
    return depth


def height(n: int, arity: int, depth: int) -> int:
    """Levels above ``n`` nodes of one tree within a page: until one node is left, ``depth`` at most."""
    levels = 0
    while n > 1 and levels < depth:
        n, levels = -(-n // arity), levels + 1
    return levels


class Parent:
    """One inner node: the digests of its children and the hash state before each of their slots."""

    __slots__ = ("children", "states", "digest")

    def __init__(self, children: list[str]):
        self.children = children
        state = hashlib.sha256()
        self.states = []
        for child in children:
            self.states.append(state.copy())
            state.update(child.encode())
        self.digest = state.hexdigest()

    def resume(self, slot: int, digest: str) -> str:
        """The digest with another child in ``slot``."""
        state = self.states[slot].copy()
        state.update("".join([digest, *self.children[slot + 1 :]]).encode())
        return state.hexdigest()


class Page:
    """The levels above neighbouring nodes of one tree, bottom first."""

    def __init__(self, digests: list[str], levels: int, arity: int):
        self.arity, self.levels = arity, []
        for _ in range(levels):
            parents = [Parent(digests[a : a + arity]) for a in range(0, len(digests), arity)]
            self.levels.append(parents)
            digests = [p.digest for p in parents]
        self.root = digests[0]

    def path(self, at: int) -> list[tuple[str, str]]:
        """(left siblings, right siblings) of node ``at`` and of its ancestors, bottom first."""
        out = []
        for parents in self.levels:
            at, slot = divmod(at, self.arity)
            children = parents[at].children
            out.append(("".join(children[:slot]), "".join(children[slot + 1 :])))
        return out

    def fold(self, at: int, digest: str) -> str:
        """The page's root with another digest for node ``at``."""
        for parents in self.levels:
            at, slot = divmod(at, self.arity)
            digest = parents[at].resume(slot, digest)
        return digest


class Above:
    """The path above a page, its states made once: after the left siblings of every level."""

    def __init__(self, path: list[dict]):
        self.steps = [(hashlib.sha256(e["left"].encode()), e["right"]) for e in path]
        self.proof = "".join(e["left"] + e["right"] for e in path)

    def fold(self, digest: str) -> str:
        for before, right in self.steps:
            state = before.copy()
            state.update((digest + right).encode())
            digest = state.hexdigest()
        return digest


def _paged(nodes: DataFrame, arity: int) -> DataFrame:
    size = arity ** page_depth(arity)
    return nodes.withColumn("page", F.expr(f"pos div {size}"))


def _in_order(table: pa.Table) -> pa.Table:
    return table.take(pa.array(np.argsort(table["pos"].to_numpy(), kind="stable")))


def _page_roots(nodes: DataFrame, arity: int) -> DataFrame:
    """(tree, pos, n, digest) of the page roots of ``nodes`` (tree, pos, n, digest)."""
    depth = page_depth(arity)

    def roots(table: pa.Table) -> pa.Table:
        table = _in_order(table)
        n = table["n"][0].as_py()
        page = Page(table["digest"].to_pylist(), height(n, arity, depth), arity)
        return pa.table(
            {
                "tree": pa.array([table["tree"][0].as_py()], pa.int64()),
                "pos": pa.array([table["page"][0].as_py()], pa.int64()),
                "n": pa.array([-(-n // arity**depth)], pa.int64()),
                "digest": pa.array([page.root], pa.string()),
            }
        )

    paged = _paged(nodes.select("tree", "pos", "n", "digest"), arity)
    return paged.groupBy("tree", "page").applyInArrow(roots, "tree long, pos long, n long, digest string")


def _climb(nodes: DataFrame, arity: int) -> list[DataFrame]:
    """``nodes`` and the tiers above it; the last holds one node per tree."""
    tiers = [nodes]
    while (tiers[-1].agg(F.max("n").alias("n")).first()["n"] or 0) > 1:
        tiers.append(settle(_page_roots(tiers[-1], arity)))
    return tiers


def _paths(nodes: DataFrame, above: DataFrame, arity: int) -> DataFrame:
    """(tree, pos, path, top): the path of every node, given those of the pages (``above``: tree, pos, path, top)."""
    depth = page_depth(arity)

    def paths(key: tuple, table: pa.Table, over: pa.Table) -> pa.Table:
        table = _in_order(table)
        page = Page(table["digest"].to_pylist(), height(table["n"][0].as_py(), arity, depth), arity)
        rest, top = over["path"][0].as_py(), over["top"][0].as_py()
        own = [[{"left": a, "right": b} for a, b in page.path(i)] + rest for i in range(table.num_rows)]
        entry = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        return pa.table({"tree": table["tree"], "pos": table["pos"], "path": pa.array(own, entry), "top": pa.array([top] * table.num_rows, pa.string())})

    paged = _paged(nodes.select("tree", "pos", "n", "digest"), arity)
    lids = above.select("tree", F.col("pos").alias("page"), "path", "top")
    return (
        paged.groupBy("tree", "page").cogroup(lids.groupBy("tree", "page")).applyInArrow(paths, f"tree long, pos long, path {PATH}, top string")
    )


def _descend(tiers: list[DataFrame], above: DataFrame, arity: int) -> DataFrame:
    """Paths of the nodes of the second tier from the bottom, or ``above`` itself where there is one tier only."""
    for nodes in reversed(tiers[1:-1]):
        above = settle(_paths(nodes, above, arity))
    return above


def manifest(
    rows: DataFrame,
    fields: Sequence[Column],
    replaced: Sequence[Column] | None = None,
    when: Column | None = None,
    key: str = "doc_id",
    tree: str = "lang",
    arity: int = 2,
) -> DataFrame:
    """Every row's leaf, its tree's ``subroot``, the ``root`` over all subroots, its proof, and the root it folds to.

    A leaf is the digest of ``fields``.  The leaves of one value of ``tree``
    ascend by ``key``; every ``arity`` consecutive nodes (the last run may be
    shorter, even one) become their digest until one is left; subroots, ordered
    by ``tree``, likewise give the root.  ``proof`` is the concatenated sibling
    digests from the leaf's run up to the root's, left to right.  Where ``when``
    holds, ``replacement`` is the digest of ``replaced`` and ``folded_root`` the
    root it folds to with the original siblings; elsewhere that of the leaf.

    Returns key, leaf, replacement (NULL where nothing is replaced), subroot,
    root, proof, folded_root, verified.  NULL in a field counts as ``-``; NULL
    keys come first in their tree, the NULL tree first of all, apart from the
    empty string's; rows with equal keys ascend by leaf, equal rows keep one
    fixed order; every row is a leaf, repeats included.  Texts may be of any
    length (hashed by the JVM).  Other columns, whatever their names, take no
    part.  An empty table gives an empty result.

    Plan: digests are written first; a rank index (range shuffle) numbers them
    exactly; pages of at most ``PAGE`` leaves are the only groups, so neither a
    hot tree nor equal keys meet in one task.
    """
    if arity < 2:
        raise ValueError("a tree needs at least two children per node")
    spark = rows.sparkSession
    ship_package(spark)
    key_type = rows.schema[key].dataType
    new = F.when(when, leaf_digest(replaced)) if replaced is not None and when is not None else F.lit(None).cast("string")
    leaves = settle(
        rows.select(
            F.col(tree).alias("of"), F.col(key).alias("key"), leaf_digest(fields).alias("leaf"), new.alias("replacement"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    index = build_rank_index(leaves, [("of", True), ("key", True), ("leaf", True), ("row", True)])
    numbered = index.numbered("at", first=0, keep_range=True)
    parts = settle(numbered.groupBy(RANGE, "of").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows")))
    sizes = parts.groupBy("of").agg(F.min("first").alias("first"), F.sum("rows").alias("n"))
    trees = build_rank_index(sizes, [("of", True)])
    places = trees.numbered("tree", first=0).select(F.col("of").alias("tree_of"), F.col("first").alias("start"), "n", "tree")
    spots = settle(
        parts.join(places, parts["of"].eqNullSafe(places["tree_of"])).select(F.col(RANGE).alias("in_range"), "tree_of", "start", "n", "tree")
    )
    # At most one row per (range, tree); beyond the bound the join goes by (range, tree), never by the tree alone.
    lookup = F.broadcast(spots) if spots.count() <= SMALL else spots
    nodes = numbered.join(lookup, (F.col(RANGE) == F.col("in_range")) & F.col("of").eqNullSafe(F.col("tree_of")))
    nodes = settle(nodes.select("tree", (F.col("at") - F.col("start")).alias("pos"), "n", F.col("leaf").alias("digest"), "key", "replacement"))

    tiers = _climb(nodes, arity)
    subroots = tiers[-1].select("tree", "digest")
    top = _climb(
        settle(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(trees.total).cast("long").alias("n"), "digest")),
        arity,
    )
    empty_path = F.from_json(F.lit("[]"), PATH)
    crown = top[-1].select("tree", "pos", empty_path.alias("path"), F.col("digest").alias("top"))
    over_trees = _paths(top[0], _descend(top, crown, arity), arity) if len(top) > 1 else crown
    lids = over_trees.select(F.col("pos").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", F.col("top"))
    over_pages = _descend(tiers, lids, arity)
    over_pages = settle(over_pages.join(subroots.withColumnRenamed("digest", "subroot"), "tree"))

    depth = page_depth(arity)
    schema = T.StructType(
        [
            T.StructField("key", key_type),
            *[T.StructField(c, T.StringType()) for c in ("leaf", "replacement", "subroot", "root", "proof", "folded_root")],
        ]
    )

    def fold(group: tuple, table: pa.Table, over: pa.Table) -> pa.Table:
        table = _in_order(table)
        digests = table["digest"].to_pylist()
        page = Page(digests, height(table["n"][0].as_py(), arity, depth), arity)
        above = Above(over["path"][0].as_py())
        proofs, folded = [], []
        for i, (digest, new) in enumerate(zip(digests, table["replacement"].to_pylist())):
            proofs.append("".join([a + b for a, b in page.path(i)]) + above.proof)
            folded.append(above.fold(page.fold(i, digest if new is None else new)))
        n = table.num_rows
        return pa.table(
            {
                "key": table["key"],
                "leaf": table["digest"],
                "replacement": table["replacement"],
                "subroot": pa.array([over["subroot"][0].as_py()] * n, pa.string()),
                "root": pa.array([over["top"][0].as_py()] * n, pa.string()),
                "proof": pa.array(proofs, pa.string()),
                "folded_root": pa.array(folded, pa.string()),
            }
        )

    lids0 = over_pages.select("tree", F.col("pos").alias("page"), "path", "top", "subroot")
    out = _paged(nodes, arity).groupBy("tree", "page").cogroup(lids0.groupBy("tree", "page")).applyInArrow(fold, schema)
    return out.select(F.col("key").alias(key), *schema.names[1:], (F.col("folded_root") == F.col("root")).alias("verified"))
