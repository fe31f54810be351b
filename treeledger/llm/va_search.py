"""Exact top-k search with vector-approximation files.

1. Every vector becomes integers, and equal vectors one class: only its k + 1 smallest ids can matter to a query.
2. A dimension is cut into 2 ** bits equal cells between its least and greatest value; a vector's approximation is one
   small unsigned number a dimension. For a query the half cell widths give one error bound, so cell centres and that
   bound enclose every inner product.
3. Blocks of approximations are scanned against blocks of queries (numpy, a grid of block pairs). A pair of blocks keeps
   what its own k-th lower bound can't exclude, and all blocks together what the k-th lower bound over all excludes not.
4. Exact vectors are read in bound order: first the k classes of greatest upper bound; with the k-th exact score of
   these, only classes whose upper bound reaches it are read, the rest can't enter the result, which is then certain.

The work is the number of queries times the number of vectors, in blocks of fixed size; nothing but the cell edges (two
numbers a dimension) goes through the driver.

Cases: vectors that are null, empty, or hold null or non-finite components take no part, neither do null ids. Vectors
of different lengths are not compared. Repeated rows are candidates each, but one query; rows that share an id but not the
vector are candidates and queries of their own. A query never meets its own id.
An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeledger.llm.common import few, materialize, scratch

SCALE = 256
BITS = 6
VECTOR_BLOCK = 16_384
QUERY_BLOCK = 1_024


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """id, v array<bigint>: floor(scale * x) of every component, of the rows that take part."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    v = F.transform(vec_col, lambda x: x.cast("double"))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("x")).where("id is not null and size(x) > 0")
    return rows.where(F.forall("x", fine)).select("id", F.transform("x", lambda x: F.floor(x * scale).cast("long")).alias("v"))


def _classes(vectors: DataFrame, k: int) -> DataFrame:
    """class (a number), v, ids: the k + 1 least ids of equal vectors, each as often as it comes, up to k times. To be
    written at once, as the numbers hang on the partitions."""
    order = Window.partitionBy("v").orderBy("id")
    each = vectors.groupBy("v", "id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
    first = each.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    ids = F.flatten(F.array_sort(F.collect_list(F.transform(F.sequence(F.lit(1), "n"), lambda _: F.col("id")))))
    return first.groupBy("v").agg(ids.alias("ids")).select(F.monotonically_increasing_id().alias("class"), "v", "ids")


def _edges(classes: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Least and greatest component by vector length and dimension."""
    each = classes.select(F.size("v").alias("d"), F.posexplode("v").alias("i", "x")).groupBy("d", "i").agg(F.min("x"), F.max("x"))
    found: dict[int, dict[int, tuple]] = {}
    for d, i, lo, hi in each.collect():
        found.setdefault(d, {})[i] = (lo, hi)
    return {d: tuple(np.array([x[i][j] for i in range(d)], float) for j in (0, 1)) for d, x in found.items()}


def _cells(v: np.ndarray, lo: np.ndarray, hi: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    width = np.maximum((hi - lo) / 2**bits, 1e-9)
    return np.clip(np.floor((v - lo) / width), 0, 2**bits - 1).astype(np.uint8), width


def approximate(classes: DataFrame, edges: dict, bits: int = BITS) -> DataFrame:
    """class, d, cells binary: the vector-approximation file, one byte a dimension."""

    def run(batches):
        for p in batches:
            out = []
            for c, v in zip(p["class"], p["v"], strict=True):
                lo, hi = edges[len(v)]
                out.append((c, len(v), _cells(np.asarray(v, float), lo, hi, bits)[0].tobytes()))
            yield pd.DataFrame(out, columns=["class", "d", "cells"])

    return classes.select("class", "v").mapInPandas(run, "class long, d int, cells binary")


def _scan(edges: dict, k: int, bits: int):
    """A block of approximations against a block of queries: (q, qc, class, lower, upper) that the block can't exclude."""

    def run(key, queries: pd.DataFrame, files: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"q": [], "qc": [], "class": [], "lower": [], "upper": []}).astype({"q": "int64", "qc": "int64", "class": "int64"})
        if queries.empty or files.empty:
            return none
        lo, hi = edges[int(key[0])]
        width = np.maximum((hi - lo) / 2**bits, 1e-9)
        centre = lo + (np.frombuffer(b"".join(files["cells"]), np.uint8).reshape(len(files), -1) + 0.5) * width
        q = np.stack(queries["v"].to_numpy()).astype(float)
        mid = q @ centre.T
        slack = np.abs(q) @ (width / 2) + 1e-9 * (1 + np.abs(q) @ np.maximum(np.abs(lo), np.abs(hi)))
        # a query's own class may lose one id, its own; other classes count once each, so the k-th bound is safe
        n = mid.shape[1]
        own = files["class"].to_numpy()[None, :] == queries["class"].to_numpy()[:, None]
        kth = np.where(own, -np.inf, mid)
        kth = np.partition(kth, n - k, axis=1)[:, n - k] - slack if n >= k else np.full(len(q), -np.inf)
        i, j = np.nonzero(mid + slack[:, None] >= kth[:, None])
        return pd.DataFrame({
            "q": queries["id"].to_numpy()[i], "qc": queries["class"].to_numpy()[i], "class": files["class"].to_numpy()[j],
            "lower": np.where(own[i, j], -np.inf, mid[i, j] - slack[i]), "upper": mid[i, j] + slack[i],
        })

    return run


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)


def top_k(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
          scale: int = SCALE, bits: int = BITS, vector_block: int = VECTOR_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where is_query, the k other rows of greatest inner product of
    integer vectors; ties go to the smaller id. is_query is over the column named id_col."""
    wanted = rows.where(is_query).select(F.col(id_col).cast("long").alias("id")).distinct()
    with scratch(rows.sparkSession):
        return _search(rows, wanted, k, id_col, vec_col, scale, bits, vector_block, query_block)


def _search(rows, wanted, k, id_col, vec_col, scale, bits, vector_block, query_block) -> DataFrame:
    vectors = materialize(integer_vectors(rows, id_col, vec_col, scale), "vectors")
    classes = materialize(_classes(vectors, k), "classes", keep=True)
    edges = _edges(classes)
    files = materialize(approximate(classes, edges, bits), "approximation")
    # a query: its id, its vector and the class of that, which tell it from others
    queries = vectors.join(wanted, "id", "left_semi").distinct()
    queries = queries.join(classes.select("v", "class"), "v").select("id", "class", "v", F.size("v").alias("d"))
    queries = materialize(queries, "queries", keep=True)

    n_blocks = max(1, -(-files.count() // vector_block))
    q_blocks = max(1, -(-queries.count() // query_block))
    left = queries.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(q_blocks)).cast("int")).withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    right = files.withColumn("vb", F.pmod(F.xxhash64("class"), F.lit(n_blocks)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    key = ["d", "vb", "qb"]
    near = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_scan(edges, k, bits), "q long, qc long, class long, lower double, upper double")
    near = materialize(near, "bounds")

    query = ["q", "qc"]
    by_query = lambda table: F.broadcast(table) if few(table) else table  # noqa: E731, a row a query
    best = Window.partitionBy(*query).orderBy(F.desc("lower"))
    kth = near.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).groupBy(*query).agg(F.min("lower").alias("kth"), F.count("*").alias("n"))
    kth = materialize(kth, "lower-bounds")
    near = near.join(by_query(kth), query).where((F.col("n") < k) | (F.col("upper") >= F.col("kth"))).select(*query, "class", "upper")
    near = materialize(near, "candidates", keep=True)

    def exact(pairs: DataFrame) -> DataFrame:
        members = pairs.join(classes.select("class", F.col("v").alias("b"), "ids"), "class")
        asked = queries.select(F.col("id").alias("q"), F.col("class").alias("qc"), F.col("v").alias("a"))
        scored = members.join(asked, query).withColumn("score", _dot("a", "b")).select(*query, "score", F.explode("ids").alias("vec_id"))
        return scored.where("vec_id <> q")

    # only the heads of the orders are ranked: partitions cut theirs before rows of a query meet
    by_bound = Window.partitionBy(*query).orderBy(F.desc("upper"), "class")
    head = near.withColumn("r", F.row_number().over(by_bound)).where(F.col("r") <= k + 1)
    head = materialize(head.select(*query, "class", "upper"), "head")
    first = materialize(exact(head), "read1", keep=True)
    rank = Window.partitionBy(*query).orderBy(F.desc("score"), "vec_id")
    certain = first.withColumn("r", F.row_number().over(rank)).where(F.col("r") == k).select(*query, F.col("score").alias("kth"))
    read = head.groupBy(*query).agg(F.max(F.struct(-F.col("upper"), "class")).alias("read"))
    state = materialize(read.join(certain, query, "left"), "certain", keep=True)
    rest = near.join(by_query(state), query).where(F.struct(-F.col("upper"), F.col("class")) > F.col("read"))
    rest = rest.where("kth is null or upper >= kth").select(*query, "class", "upper")
    found = first.unionByName(exact(rest))
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select(
        F.col("q").alias("query_id"), "rank", "vec_id", "score"
    )
