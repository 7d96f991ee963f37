"""Exact top-k search by inner product: term at a time, exhaustive.

Vectors are integer term weights. Candidate blocks hold a posting list per term; each non-zero term of a query adds
its weighted postings into the query's row of a dense score array. Every block selects its best by partition, and the
selections are merged. Queries and candidates meet block by block, so that no side has to fit a broadcast.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CANDIDATE_BLOCK = 4096
QUERY_BLOCK = 2048
SAFE = 1 << 24  # weights below this cannot overflow a score of 2**14 terms


def integer_weights(vector: str, scale: int = 1024) -> Column:
    """floor(scale * x) of every component."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * float(scale)).cast("long"))


def usable(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(False))


def postings(vectors: list[np.ndarray]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(term, rows, weights) of the non-zero weights, term by term."""
    rows = np.repeat(np.arange(len(vectors)), [len(v) for v in vectors])
    terms = np.concatenate([np.arange(len(v)) for v in vectors]) if vectors else np.empty(0, int)
    weights = np.concatenate(vectors) if vectors else np.empty(0, np.int64)
    there = np.flatnonzero(weights)
    order = there[np.argsort(terms[there], kind="stable")]
    cuts = np.flatnonzero(np.diff(terms[order])) + 1
    return [(int(terms[part[0]]), rows[part], weights[part]) for part in np.split(order, cuts) if len(part)]


def block_scores(queries: list[np.ndarray], candidates: list[np.ndarray]) -> np.ndarray:
    """The score of each query with each candidate; a missing term weighs nothing."""
    large = any(len(v) and np.abs(v).max() >= SAFE for v in (*queries, *candidates))
    scores = np.zeros((len(queries), len(candidates)), object if large else np.int64)
    asked = {term: (rows, weights) for term, rows, weights in postings(queries)}
    for term, rows, weights in postings(candidates):
        if term in asked:
            of, by = asked[term]
            if large:
                by, weights = by.astype(object), weights.astype(object)
            for query, weight in zip(of, by):
                scores[query, rows] += weight * weights
    if large:
        limit = (1 << 63) - 1
        scores = np.array([[min(max(x, -limit - 1), limit) for x in row] for row in scores], np.int64).reshape(scores.shape)
    return scores


def best_of(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k highest scores of other ids, ties to the smaller id."""
    other = ids != own
    ids, scores = ids[other], scores[other]
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = scores > least
        level = np.flatnonzero(scores == least)
        need = k - int(above.sum())
        level = level[np.argpartition(ids[level], need - 1)[:need]]
        chosen = np.concatenate([np.flatnonzero(above), level])
        ids, scores = ids[chosen], scores[chosen]
    return ids, scores


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, vector: str = "embedding",
          key: str = "vec_id") -> DataFrame:
    """The k best candidates of each query: (query_id, rank from 1, vec_id, score), ties to the smaller id.

    Candidates are all rows but those of the query's own id. Rows with a null key, and vectors that are null or hold
    null or non-finite components, take no part; an empty vector scores 0. A shorter vector lacks its last terms. Of
    rows that share a key the smallest vector, component by component, stands. Scores beyond a long become the nearest
    long. ``is_query`` is a condition on ``key``. Other columns are ignored.
    """
    rows = vectors.select(vectors[key].cast("long").alias("id"), vectors[vector].alias("v"))
    rows = rows.where(F.col("id").isNotNull() & usable("v")).select("id", integer_weights("v", scale).alias("v"))
    rows = rows.groupBy("id").agg(F.min("v").alias("v"))
    asked = rows.where(is_query)
    n, m = (int(x) for x in rows.agg(F.count(F.lit(1)), F.count_if(is_query)).first())
    blocks, rounds = max(1, -(-n // CANDIDATE_BLOCK)), max(1, -(-m // QUERY_BLOCK))
    left = rows.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"),
                       F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
    right = asked.select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
                         F.pmod(F.xxhash64("id"), F.lit(rounds)).cast("int").alias("round"))

    def search(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        ids = candidates["id"].to_numpy()
        scores = block_scores(queries["v"].tolist(), candidates["v"].tolist())
        found = [(own, *best_of(row, ids, own, k)) for own, row in zip(queries["id"].tolist(), scores)]
        if not found:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        return pd.DataFrame({"query_id": np.repeat([f[0] for f in found], [len(f[1]) for f in found]),
                             "vec_id": np.concatenate([f[1] for f in found]),
                             "score": np.concatenate([f[2] for f in found])}).astype("int64")

    found = left.groupBy("block", "round").cogroup(right.groupBy("block", "round")).applyInPandas(
        search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
