"""SimHash near duplicates: fingerprints partitioned by vantage points, exact for a Hamming radius.

A small tree of vantage points, built on a bounded sample, cuts the space of fingerprints into shards. A fingerprint
lives in one shard and visits every other shard that its ball reaches (triangle inequality), in one direction only. A
shard searches its residents with a vantage-point tree of its own and returns a spanning forest of the links found, so
that a group of k near copies gives k rows and not k squared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tailsplit.llm.components import connected_components
from tailsplit.llm.forest import Groups
from tailsplit.llm.textblock import text_blocks
from tailsplit.scratch import materialize, row_count

SHARD_ROWS = 65_536
SAMPLE_ROWS = 16_384  # vantage points and radii come from so many fingerprints at most
LEAF = 512
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str, words: int = 4, seed: int = 42) -> int:
    """64 bits: the majority of the XXH64 values of all word shingles; 0 for a text without words."""
    parts = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    n = max(1, len(parts) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = (ends - np.fromiter(map(len, parts), np.int64, len(parts)) - 1)[:n].tolist()
    stops = (ends[words - 1:] - 1).tolist() if len(parts) >= words else [len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts, stops)), ">u8", n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        part = hashes[at:at + 65_536]
        counts += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42, text: str = "text", key: str = "doc_id",
                 carry: list[str] | None = None) -> DataFrame:
    """(key, the columns to carry, fp): the fingerprint of each whole text as a signed long."""
    names = [key, *(carry or [])]
    source = docs.select(*[docs[c] for c in names], docs[text].alias("__text"))
    schema = T.StructType([*source.drop("__text").schema.fields, T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_blocks(batch.column("__text")):
                found = np.array([fingerprint(t, words, seed) for t in texts], np.uint64).view(np.int64)
                kept = [batch.column(c).slice(first, len(texts)) for c in names]
                yield pa.record_batch([*kept, pa.array(found)], schema.names)

    return source.mapInArrow(run, schema)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of unsigned numbers."""
    return np.bitwise_count(np.bitwise_xor(a, b)).astype(np.int16)


def shard_tree(sample: np.ndarray, depth: int):
    """Nested (vantage point, radius, inside, outside); None is a shard."""
    if depth == 0 or len(sample) < 2:
        return None
    point = sample[len(sample) // 2]
    far = distance(sample, point)
    radius = int(np.median(far))
    if radius == far.max():
        radius -= 1
    inside = far <= radius
    if inside.all() or not inside.any():
        return None
    return point, radius, shard_tree(sample[inside], depth - 1), shard_tree(sample[~inside], depth - 1)


def route(tree, prints: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, shard, whether it lives there); shards are numbered from the left, visits lead to the right only."""
    items, shards, homes, count = [], [], [], 0

    def down(node, which: np.ndarray, home: np.ndarray) -> None:
        nonlocal count
        if node is None:
            items.append(which)
            shards.append(np.full(len(which), count))
            homes.append(home)
            count += 1
            return
        point, radius, inside, outside = node
        far = distance(prints[which], point)
        go = far - reach <= radius
        down(inside, which[go], home[go] & (far[go] <= radius))
        go = far + reach > radius
        down(outside, which[go], home[go] & (far[go] > radius))

    down(tree, np.arange(len(prints)), np.ones(len(prints), bool))
    item, shard, home = np.concatenate(items), np.concatenate(shards), np.concatenate(homes)
    own = np.zeros(len(prints), np.int64)
    own[item[home]] = shard[home]
    keep = shard >= own[item]
    return item[keep], shard[keep], home[keep]


def link_shard(prints: np.ndarray, home: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of all links with a resident: (item, smallest item of its group)."""
    groups = Groups(len(prints))

    def search(residents: np.ndarray, queries: np.ndarray) -> None:
        if not len(residents) or not len(queries):
            return
        if len(residents) > LEAF:
            point = prints[residents[len(residents) // 2]]
            near, far = distance(prints[residents], point), distance(prints[queries], point)
            radius = int(np.median(near))
            if radius == near.max():
                radius -= 1
            inside = near <= radius
            if inside.any() and not inside.all():
                search(residents[inside], queries[far - reach <= radius])
                search(residents[~inside], queries[far + reach > radius])
                return
        for at in range(0, len(residents), LEAF):
            some = residents[at:at + LEAF]
            for begin in range(0, len(queries), 4 * LEAF):
                asked = queries[begin:begin + 4 * LEAF]
                linked = np.bitwise_count(prints[asked][:, None] ^ prints[some][None, :]) <= reach
                rows = linked.any(1)
                groups.join_where(linked[rows], asked[rows], some)

    search(np.flatnonzero(home), np.arange(len(prints)))
    return groups.edges()


def near_duplicates(docs: DataFrame, words: int = 4, bits: int = 4, seed: int = 42, text: str = "text",
                    key: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """The fingerprint and the group of every document.

    One row a document, repeated rows included: ``key`` (a whole number), the columns to ``carry``, ``fp`` (signed
    long) and ``component_id``,
    the smallest key that links of at most ``bits`` differing bits reach. Equal fingerprints are linked, also those of
    texts that are null, empty or without words (0). A row with a null key links nothing; it gets the component of its
    fingerprint, null if no row with a key has it. Other columns are ignored.
    """
    prints = materialize(fingerprints(docs, words, seed, text, key, carry).withColumn(key, F.col(key).cast("long")), "prints")
    nodes = materialize(prints.where(F.col(key).isNotNull()).groupBy("fp").agg(F.min(key).alias("node")), "nodes")
    n = row_count(nodes)
    depth = max(0, int(np.ceil(np.log2(max(1, n / SHARD_ROWS)))))
    sample = [r.fp for r in nodes.orderBy(F.xxhash64("fp"), "fp").select("fp").limit(SAMPLE_ROWS).collect()]
    tree = shard_tree(np.array(sample, np.int64).view(np.uint64), depth)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            item, shard, home = route(tree, batch.column("fp").to_numpy().view(np.uint64), bits)
            picked = batch.take(pa.array(item))
            yield pa.record_batch([picked.column("fp"), picked.column("node"), pa.array(shard.astype(np.int32)),
                                   pa.array(home)], ["fp", "node", "shard", "home"])

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node", ignore_index=True)
        item, root = link_shard(rows["fp"].to_numpy().view(np.uint64), rows["home"].to_numpy(), bits)
        names = rows["node"].to_numpy()
        return pd.DataFrame({"u": names[item], "v": names[root]})

    dealt = nodes.mapInArrow(deal, "fp long, node long, shard int, home boolean")
    edges = materialize(dealt.groupBy("shard").applyInPandas(search, "u long, v long"), "forest")
    groups = connected_components(edges)
    named = nodes.join(groups, "node", "left").select(
        F.col("fp").alias("p"), F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, prints.fp == named.p, "left").select(key, *(carry or []), "fp", "component_id")
