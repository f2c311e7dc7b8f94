"""Exact top-k search by inner product over a forest of paged M-trees."""

from __future__ import annotations

import math
import pickle
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import settle, ship_package
from tidewater.llm.mtree import SLACK, MTree

#: Vectors in one tree, queries or roots handled together, and pivots that deal vectors to trees (fitted on a sample of that size).
TREE_ROWS = 8192
BLOCK_ROWS = 2048
MAX_PIVOTS = 256


def usable(vector: str) -> Column:
    """Neither NULL nor empty, and no component NULL or non-finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf)))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False))


def quantized(vector: str, scale: int) -> Column:
    """``floor(scale * x)`` of every component, in doubles."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))


def _matrix(values: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in values])


def _lanes(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``pivot``: the nearest pivot of the vector's length (0 where there is none)."""
    by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {len(p) for p in pivots}:
        at = [i for i, p in enumerate(pivots) if len(p) == dim]
        by_dim[dim] = (np.asarray(at), np.asarray([pivots[i] for i in at], np.float64))

    @F.pandas_udf("int")
    def pivot(v: pd.Series) -> pd.Series:
        out = np.zeros(len(v), np.int32)
        dims = np.array([len(x) for x in v])
        for dim in np.unique(dims):
            if dim in by_dim:
                at, centers = by_dim[dim]
                own = np.flatnonzero(dims == dim)
                points = _matrix(v.iloc[own])
                near = (np.einsum("ij,ij->i", centers, centers) - 2 * points @ centers.T).argmin(axis=1)
                out[own] = at[near]
        return pd.Series(out)

    return rows.withColumn("pivot", pivot("v"))


def top_k(
    rows: DataFrame,
    queries: Column,
    k: int = 5,
    scale: int = 256,
    key: str = "vec_id",
    vector: str = "embedding",
    tree_rows: int = TREE_ROWS,
) -> DataFrame:
    """For every row that satisfies ``queries``, the k rows with the highest integer inner product.

    Components become ``floor(scale * x)``.  A query's own row is no candidate,
    other rows with its key are; fewer than k candidates are all returned; ties
    go to the smaller key, among rows of one key in a fixed order.  NULL keys,
    and vectors that are NULL, empty or hold a NULL or non-finite component take
    no part; vectors of another length than the query's are no candidates.
    Repeated rows are queries and candidates each.  Returns query_id, rank (from
    1), vec_id, score; an empty table gives an empty result.

    Plan: vectors are dealt to trees by nearest pivot, large groups (also
    copies of one vector) split evenly, so a tree holds about ``tree_rows``.
    A query first searches the tree it lies in; its k-th score then bounds the
    search in all other trees, and trees whose root lies beyond that bound are
    never opened.  The queries of a tree search it in blocks.  Recall is 1 by
    construction.
    """
    spark = rows.sparkSession
    ship_package(spark)
    usable_rows = rows.filter(F.col(key).isNotNull() & usable(vector)).select(
        F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), quantized(vector, scale).alias("v"),
        F.coalesce(queries, F.lit(False)).alias("is_query"), F.size(vector).alias("dim"),
    )
    base = settle(usable_rows)  # from here on a row keeps its number
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    facts = base.agg(F.count(F.lit(1)).alias("n"), F.max(norm2).alias("norm2")).first()
    n, largest = facts["n"], facts["norm2"] or 0.0
    n_pivots = max(1, min(MAX_PIVOTS, n // tree_rows))
    # Bounded: at most MAX_PIVOTS vectors, chosen by hash.
    pivots = [np.asarray(r["v"]) for r in base.orderBy(F.xxhash64("id"), "id", "row").limit(n_pivots).select("v").collect()]
    laned = _lanes(base, pivots)
    splits = laned.groupBy("dim", "pivot").agg(F.ceil(F.count(F.lit(1)) / tree_rows).cast("int").alias("trees"))
    part = F.pmod(F.xxhash64("row", F.lit(7)), F.col("trees"))
    dealt = laned.join(splits, ["dim", "pivot"]).withColumn("tree_id", F.concat_ws("/", "dim", "pivot", part))

    def build(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tree = MTree(pdf["id"].to_numpy(np.int64), _matrix(pdf["v"]), largest, rows=pdf["row"].to_numpy(np.int64))
        return pd.DataFrame(
            {"tree_id": [group[0]], "dim": [len(pdf["v"].iloc[0])], "center": [tree.center.tolist()], "radius": [tree.covering], "tree": [pickle.dumps(tree, 5)]}
        )

    dealt = settle(dealt.select("row", "id", "v", "is_query", "dim", "tree_id"))
    trees = settle(
        dealt.select("row", "id", "v", "tree_id").groupBy("tree_id").applyInPandas(build, "tree_id string, dim int, center array<double>, radius double, tree binary")
    )
    asked = dealt.filter("is_query").select(F.col("row").alias("asker"), F.col("id").alias("query_id"), "v", "dim", F.col("tree_id").alias("own_tree"))

    def best_of(found: DataFrame) -> DataFrame:
        by = Window.partitionBy("asker").orderBy(F.col("score").desc(), F.col("vec_id"), F.col("row"))
        return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)

    near = asked.select("asker", "query_id", "v", F.lit(-math.inf).alias("bound"), F.col("own_tree").alias("tree_id"))
    first = settle(best_of(_search(near, trees, k)))
    bounds = first.filter(F.col("rank") == k).select("asker", F.col("score").cast("double").alias("bound"))
    bounded = asked.join(bounds, "asker", "left").withColumn("bound", F.coalesce("bound", F.lit(-math.inf)))
    rest = _search(_routes(bounded, trees, largest), trees, k)
    return best_of(first.select(*rest.columns).union(rest)).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )


def _routes(asked: DataFrame, trees: DataFrame, norm2: float) -> DataFrame:
    """(asker, query_id, v, bound, tree_id): the trees other than its own that hold a query's bound in reach.

    Blocks of queries meet blocks of tree roots; a root is a center and a
    covering radius, one per ``TREE_ROWS`` vectors.
    """
    n_roots, n_queries = trees.count(), asked.count()
    q_blocks, r_blocks = -(-n_queries // BLOCK_ROWS) or 1, -(-n_roots // BLOCK_ROWS) or 1
    names = ["asker", "query_id", "v", "bound"]

    def route(key: tuple, queries: pd.DataFrame, roots: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(roots):
            return pd.DataFrame(columns=[*names, "tree_id"])
        vectors, centers, own_tree = _matrix(queries["v"]), _matrix(roots["center"]), roots["tree_id"].to_numpy()
        bound, radius = queries["bound"].to_numpy(np.float64), roots["radius"].to_numpy(np.float64)
        base = np.einsum("ij,ij->i", vectors, vectors) + norm2
        known = np.isfinite(bound)
        reach = np.where(known, np.sqrt(np.maximum(base - 2 * np.where(known, bound, 0.0), 0.0)) + SLACK * (1.0 + np.sqrt(base)), np.inf)
        squares = np.einsum("ij,ij->i", vectors, vectors)[:, None] + np.einsum("ij,ij->i", centers, centers)
        far = np.sqrt(np.maximum(squares - 2 * (np.c_[vectors, np.zeros(len(vectors))] @ centers.T), 0.0))
        near = (far - radius <= reach[:, None]) & (queries["own_tree"].to_numpy()[:, None] != own_tree)
        q, t = np.nonzero(near)
        out = queries[names].iloc[q].reset_index(drop=True)
        out["tree_id"] = own_tree[t]
        return out

    q = asked.withColumn("qb", F.pmod(F.xxhash64("asker"), F.lit(q_blocks)).cast("int")).withColumn(
        "rb", F.explode(F.sequence(F.lit(0), F.lit(r_blocks - 1)))
    )
    r = trees.select("dim", "tree_id", "center", "radius", F.pmod(F.xxhash64("tree_id"), F.lit(r_blocks)).cast("int").alias("rb")).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))
    )
    return (
        q.groupBy("dim", "qb", "rb")
        .cogroup(r.groupBy("dim", "qb", "rb"))
        .applyInPandas(route, "asker long, query_id long, v array<double>, bound double, tree_id string")
    )


def _search(plan: DataFrame, trees: DataFrame, k: int) -> DataFrame:
    """(asker, query_id, row, vec_id, score) of the k best of every planned (query, tree); a tree's queries go in blocks."""
    plan = settle(plan)
    load = plan.groupBy("tree_id").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("lanes"))
    planned = plan.join(load, "tree_id").withColumn("lane", F.pmod(F.xxhash64("asker"), F.col("lanes")).cast("int"))
    copies = trees.select("tree_id", "tree").join(load, "tree_id").withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)))
    names = ["asker", "query_id", "row", "vec_id", "score"]

    def search(key: tuple, queries: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(queries):
            return pd.DataFrame(columns=names).astype("int64")
        tree: MTree = pickle.loads(own["tree"].iloc[0])
        asker, query_id = queries["asker"].to_numpy(np.int64), queries["query_id"].to_numpy(np.int64)
        score, at = tree.search_block(_matrix(queries["v"]), k, asker, queries["bound"].to_numpy(np.float64))
        q, nth = np.nonzero(at >= 0)
        place = at[q, nth]
        return pd.DataFrame(dict(zip(names, (asker[q], query_id[q], tree.row_ids[place], tree.ids[place], score[q, nth].astype(np.int64)))))

    return (
        planned.select("tree_id", "lane", "asker", "query_id", "v", "bound")
        .groupBy("tree_id", "lane")
        .cogroup(copies.select("tree_id", "lane", "tree").groupBy("tree_id", "lane"))
        .applyInPandas(search, "asker long, query_id long, row long, vec_id long, score long")
    )
