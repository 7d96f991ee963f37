"""Near-duplicate embeddings by collision counting over sorted one-dimensional projections.

Each vector of a label is projected on many random directions. A pair whose cosine reaches the limit falls into the
query-centred window of a projection with a known probability; pairs that collide often enough are verified by their
cosine in double precision. Window and count are set so that a pair at the limit is missed with a given probability.
A label's vectors are dealt into blocks; every two blocks meet in one task, which counts, verifies and returns counts of
links and a spanning forest, never the pairs. In many dimensions one projection separates too little to keep two blocks
apart, so the number of meetings grows with the square of a label's blocks.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb, erf, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailsplit.llm.components import connected_components
from tailsplit.llm.forest import Groups
from tailsplit.llm.topk import usable
from tailsplit.scratch import materialize

BLOCK_ROWS = 2048
PROJECTIONS, SWEPT = 64, 24
WINDOW = 1.5  # half width of a window, in standard deviations of the projected difference of a pair at the limit
MISSED = 1e-6  # probability to miss a pair at the limit by either of the two counts


@lru_cache(maxsize=None)
def calibrated_count(projections: int = PROJECTIONS, window: float = WINDOW, missed: float = MISSED) -> int:
    """The largest count of collisions that a pair at the limit fails to reach with probability ``missed`` at most."""
    p = erf(window / sqrt(2))
    below, count = 0.0, 0
    while count < projections:
        below += comb(projections, count) * p**count * (1 - p) ** (projections - count)
        if below > missed:
            break
        count += 1
    return count


def directions(dim: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, count))


class Lines:
    """Sorted one-dimensional projections of a block."""

    def __init__(self, rows: np.ndarray, axes: np.ndarray):
        self.places = np.ascontiguousarray((rows @ axes).T)
        self.order = self.places.argsort(1, kind="stable")
        self.sorted = np.take_along_axis(self.places, self.order, 1)


def candidates(asked: np.ndarray, lines: Lines, half: float):
    """(query, row) pairs that collide in enough projections; ``asked`` has a row of places for each projection.

    The first projections are swept in sorted order for all pairs, the others are looked up for those that pass.
    """
    counts = np.zeros((asked.shape[1], lines.places.shape[1]), np.uint8)
    for m in range(SWEPT):
        line, order = lines.sorted[m], lines.order[m]
        begin = np.searchsorted(line, asked[m] - half, "left").tolist()
        end = np.searchsorted(line, asked[m] + half, "right").tolist()
        for q, (b, e) in enumerate(zip(begin, end)):
            if e > b:
                counts[q, order[b:e]] += 1
    i, j = np.nonzero(counts >= calibrated_count(SWEPT))
    total = counts[i, j].astype(np.int64)
    for m in range(SWEPT, PROJECTIONS):
        total += np.abs(asked[m][i] - lines.places[m][j]) <= half
    passed = total >= calibrated_count()
    return i[passed], j[passed]


def link_blocks(left: np.ndarray, right: np.ndarray, same: bool, limit: float, seed: int):
    """(i, j) of linked unit vectors of two blocks; within one block every pair once."""
    half = WINDOW * sqrt(max(0.0, 2 - 2 * limit)) + 1e-9
    axes = directions(left.shape[1], PROJECTIONS, seed)
    lines = Lines(right, axes)
    for at in range(0, len(left), 256):
        i, j = candidates((left[at:at + 256] @ axes).T, lines, half)
        if same:
            i, j = i[i + at < j], j[i + at < j]
        true = np.concatenate([np.einsum("ij,ij->i", left[i[b:b + 65_536] + at], right[j[b:b + 65_536]]) >= limit
                               for b in range(0, len(i), 65_536)]) if len(i) else np.zeros(0, bool)
        yield i[true] + at, j[true]


def near_duplicates(vectors: DataFrame, limit: float = 0.93, seed: int = 7, vector: str = "embedding",
                    key: str = "vec_id", label: str = "label") -> DataFrame:
    """Links between vectors of equal label whose cosine is at least ``limit``.

    One row for each row: ``key`` (a whole number), ``n_links`` (other rows linked directly), ``component_id`` (the
    smallest key that links reach) and ``kept`` (whether it is that key). Vectors that are null, empty, zero or hold
    null or non-finite components, and rows with a null label, link with nothing; vectors of different length do not
    link. Rows of one label with equal vectors are linked and go through the search once. Rows with a null key have 0
    links, a null component and are not kept; rows that repeat a key are linked as rows of their own. Other columns are
    ignored.
    """
    all_rows = vectors.select(vectors[key].cast("long").alias("id"), F.col(label).alias("label"),
                              F.transform(vectors[vector], lambda x: x.cast("double")).alias("v"))
    fit = (F.col("id").isNotNull() & F.col("label").isNotNull() & usable("v")
           & F.coalesce(F.exists("v", lambda x: x != 0.0), F.lit(False)))
    rows = all_rows.withColumn("fit", F.coalesce(fit, F.lit(False)))
    kinds = rows.where("fit").groupBy("label", "v").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies"))
    kinds = materialize(kinds.select("*", F.size("v").alias("dim"), F.monotonically_increasing_id().alias("kind")), "vectors")
    sizes = kinds.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "blocks", F.ceil(F.col("n") / BLOCK_ROWS).cast("int"))
    placed = kinds.join(sizes, ["label", "dim"]).withColumn("block", F.pmod(F.xxhash64("kind"), F.col("blocks")).cast("int"))
    # A block stands left in its own round and right in those before, so that every two blocks meet once.
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("label", "dim", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"),
                         (F.col("block") <= F.col("other")).alias("left"), "kind", "copies", "v")

    def search(group: pd.DataFrame) -> pd.DataFrame:
        same = bool((group["a"].iloc[0] == group["b"].iloc[0]))
        group = group.sort_values(["left", "kind"], ascending=[False, True], ignore_index=True)
        unit = np.stack(group["v"].tolist())
        unit = unit / np.abs(unit).max(1, keepdims=True)
        unit = unit / np.sqrt((unit * unit).sum(1, keepdims=True))
        n, cut = len(unit), len(unit) if same else int(group["left"].sum())
        first = 0 if same else cut
        copies, links, groups = group["copies"].to_numpy(), np.zeros(n, np.int64), Groups(n)
        for i, j in link_blocks(unit[:cut], unit[first:], same, limit, seed):
            j = j + first
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            groups.join(i, j)
        root = groups.roots(np.arange(n))
        hit = np.flatnonzero(links)
        names = group["kind"].to_numpy()
        return pd.DataFrame({"u": names[hit], "v": names[root[hit]], "n": links[hit]})

    found = materialize(dealt.groupBy("label", "dim", "a", "b").applyInPandas(search, "u long, v long, n long"), "links")
    links = found.groupBy(F.col("u").alias("kind")).agg(F.sum("n").alias("n"))
    groups = connected_components(found.select("u", "v")).withColumnRenamed("node", "kind")
    grouped = kinds.join(links, "kind", "left").join(groups, "kind", "left").withColumn(
        "component", F.coalesce("component", "kind"))
    least = grouped.groupBy("component").agg(F.min("node").alias("least"))
    named = grouped.join(least, "component").select(
        F.col("label").alias("l"), F.col("v").alias("w"), F.col("least").alias("component"),
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.join(named, F.col("fit") & (rows.label == named.l) & (rows.v == named.w), "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
