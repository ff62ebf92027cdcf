"""Exact top-k inner products by norm-bucketed retrieval.

Vectors become integers, floor(256 x), and are range-partitioned by length (the vector's norm), longest first: a
range is a bucket. Queries are dealt into chunks alike. First every query meets the bucket of the longest vectors,
which gives it a lower bound for its k-th score. A pair of chunk and bucket is then kept only if the product of
their greatest norms reaches the least bound of the chunk. Inside a pair, each query turns its bound into a cosine
threshold local to the bucket. A high threshold prunes by coordinates: on the query's largest coordinates, a
vector's normalised coordinate must lie in the interval that the threshold allows. Others prune by length: only
vectors at least as long as bound / |query|. What is left is verified by exact integer products.

Of a bucket, a chunk gets only the vectors that are long enough for one of its queries; the others aren't shuffled.

A group that a task holds is one chunk and one bucket, of bounded sizes; rows are shuffled once for each pair that
isn't pruned; no side is broadcast.

Cases: vectors that are null, empty, or hold a null or a component that isn't finite take no part; vectors of other
dimensions than the query's aren't compared with it; rows that share the query's vec_id are its own; equal vectors
are ranked by vec_id; queries without candidates give no rows; an empty table gives none; other columns aren't read;
a null vec_id takes no part. Scores beyond 64 bits are held at the ends of that range.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm import common

#: Rows of a bucket and of a chunk of queries, about.
BUCKET, CHUNK = 4096, 2048
#: From this local cosine threshold on, coordinates prune; below, lengths alone.
COORDINATES_FROM = 0.5
FOCUS = 3
HITS = "query_id long, vec_id long, score long"
SCALE = 256


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, dim, v (array<double> of whole numbers), norm: of all rows that take part."""
    x = F.col(vector_col)
    sound = F.size(x) > 0
    sound = sound & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & x.isNotNull()).where(sound)
    # doubles hold the floors exactly; the largest are beyond any 64-bit integer anyway
    v = F.transform(x, lambda e: F.when(F.abs(e.cast("double")) < 2.0**44, F.floor(e.cast("double") * SCALE).cast("double")).otherwise(e.cast("double") * SCALE))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e))
    return rows.select("id", F.size("v").alias("dim"), "v", norm.alias("norm"))


def _ranges(rows: DataFrame, n: int, name: str) -> DataFrame:
    parts = rows.repartitionByRange(n, F.col("dim"), F.col("norm").desc(), F.col("id"))
    return parts.select(F.spark_partition_id().alias(name), "*")


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer products as a matrix of int64."""
    if np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * q.shape[1] < 2.0**53:
        return (q @ v.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in q], object) @ np.array([[int(x) for x in r] for r in v], object).T
    return np.array([[max(-(2**63), min(2**63 - 1, x)) for x in r] for r in exact], np.int64).reshape(len(q), len(v))


def search_pair(queries: pd.DataFrame, bucket: pd.DataFrame, k: int) -> pd.DataFrame:
    """The hits of a chunk's queries (id, norm, bound, v) in one bucket (id, norm, v), k at most for each query."""
    hits: list[tuple[int, int, int]] = []
    for dim, mine in queries.groupby("dim"):
        own = bucket[bucket["dim"] == dim].sort_values("norm", ascending=False)
        if not len(own):
            continue
        v, norm, ids = np.stack(own["v"].to_numpy()), own["norm"].to_numpy(), own["id"].to_numpy()
        q, qn, qids = np.stack(mine["v"].to_numpy()), mine["norm"].to_numpy(), mine["id"].to_numpy()
        bound = mine["bound"].to_numpy(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            local = bound / (qn * norm[0])
            unit = np.where(norm[:, None] > 0, v / norm[:, None], 0)
        local[~(qn * norm[0] > 0)] = np.where(bound[~(qn * norm[0] > 0)] > 0, np.inf, -np.inf)
        local[np.isnan(bound)] = -np.inf
        sharp = (local >= COORDINATES_FROM) & (local <= 1 + 1e-9)
        for i in np.flatnonzero(sharp):
            need = bound[i] / qn[i]
            some = np.arange(np.searchsorted(-norm, -need * (1 - 1e-9), side="right"))
            cos = np.minimum(need / norm[some], 1.0)
            for f in np.argsort(-np.abs(q[i]))[:FOCUS]:
                c = q[i, f] / qn[i]
                spread = np.sqrt(np.maximum((1 - cos**2) * (1 - c * c), 0)) + 1e-9
                x = unit[some, f]
                # with a cosine of at least cos, the coordinate lies within spread of c * cos, or on c's side of it
                low = np.where(-c > cos, -1, c * cos - spread)
                high = np.where(c > cos, 1, c * cos + spread)
                ok = (x >= low) & (x <= high)
                some, cos = some[ok], cos[ok]
            _best(hits, qids[i : i + 1], ids[some], _products(q[i : i + 1], v[some]), bound[i : i + 1], k)
        flat = np.flatnonzero(local < COORDINATES_FROM)
        for a in range(0, len(flat), 256):
            part = flat[a : a + 256]
            need = np.where(bound[part] > 0, bound[part] / np.maximum(qn[part], 1e-300), -1)
            some = slice(0, int(np.searchsorted(-norm, -need.min() * (1 - 1e-9), side="right")) if need.min() > 0 else len(norm))
            _best(hits, qids[part], ids[some], _products(q[part], v[some]), bound[part], k)
    return pd.DataFrame(hits, columns=["query_id", "vec_id", "score"]).astype("int64")


def _best(hits: list, qids: np.ndarray, ids: np.ndarray, scores: np.ndarray, bound: np.ndarray, k: int) -> None:
    for qid, row, least in zip(qids.tolist(), scores, bound):
        other = np.flatnonzero((ids != qid) & ((row >= least) if least == least else True))
        if len(other) > k:
            cut = np.partition(row[other], -k)[-k]
            other = other[row[other] >= cut]
        order = np.lexsort((ids[other], -row[other]))[:k]
        hits += [(qid, int(ids[j]), int(row[j])) for j in other[order]]


def _search(pairs: DataFrame, queries: DataFrame, buckets: DataFrame, k: int) -> DataFrame:
    """pairs: b_no, q_no and need, the least length of a vector that any query of the chunk can still take."""
    left = pairs.join(queries, "q_no").select(*(F.col(c).alias(f"{c}_") for c in ("b_no", "q_no")), "id", "dim", "norm", "bound", "v")
    right = pairs.join(buckets, "b_no").where(F.col("norm") * (1 + 1e-9) >= F.col("need"))  # the others aren't sent
    right = right.select("b_no", "q_no", *(F.col(c).alias(c) for c in ("id", "dim", "norm", "v")))
    both = left.groupBy("b_no_", "q_no_").cogroup(right.groupBy("b_no", "q_no"))
    return both.applyInPandas(lambda q, b: search_pair(q, b, k), HITS)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for each query; queries are the rows whose id is divisible by `every`."""
    rows = common.written(integers(vectors, id_col, vector_col), "integers")
    n, n_q = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("id") % every == 0, 1))).first()
    buckets = common.written(_ranges(rows, max(1, math.ceil(n / BUCKET)), "b_no"), "buckets")
    queries = common.written(_ranges(rows.where(F.col("id") % every == 0), max(1, math.ceil(n_q / CHUNK)), "q_no"), "queries")
    b_meta = buckets.groupBy("dim", "b_no").agg(F.max("norm").alias("b_norm"))
    q_meta = queries.groupBy("dim", "q_no").agg(F.max("norm").alias("q_norm"))
    # the bucket of the longest vectors of each dimension gives every query a first bound
    first = b_meta.groupBy("dim").agg(F.max_by("b_no", "b_norm").alias("b_no"))
    seeds = q_meta.join(first, "dim").select("b_no", "q_no", F.lit(float("-inf")).alias("need")).distinct()
    unbound = queries.withColumn("bound", F.lit(None).cast("double"))
    found = common.written(_search(seeds, unbound, buckets, k), "hits")
    bounds = found.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).cast("double").alias("bound"))
    bounded = common.written(queries.join(bounds, "id", "left").select(*queries.columns, "bound"), "bounds")
    # pairs of a chunk and a bucket, by their figures alone: a chunk and a bucket are thousands of rows each
    # what a vector's length must be for a query: its bound over its own length; no bound or none above zero asks nothing
    need = F.when((F.col("bound") > 0) & (F.col("norm") > 0), F.col("bound") / F.col("norm")).when(F.col("bound") > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    least = bounded.groupBy("dim", "q_no").agg(F.min(need).alias("need"))
    pairs = least.join(b_meta, "dim").where("b_norm * (1 + 1e-9) >= need").groupBy("b_no", "q_no").agg(F.min("need").alias("need"))
    rest = pairs.join(seeds.select("b_no", "q_no"), ["b_no", "q_no"], "left_anti")
    hits = found.union(_search(rest, bounded, buckets, k))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_norm_bucket_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(common.table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
