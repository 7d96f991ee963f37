"""Near duplicates, repeated passages and vectors against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tailsplit.llm import components, simhash, substring, topk, vectors
from tests.llm import cases


def plain_print(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(nodes, linked):
    """The smallest node that each reaches."""
    group = {x: x for x in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(group[a], group[b])
            if group[a] != low or group[b] != low:
                group[a] = group[b] = low
                changed = True
    return group


@pytest.mark.parametrize("clashing", [False, True])
def test_fingerprints_and_groups(spark, clashing):
    prints = [(key, plain_print(text)) for key, text in cases.texts()]
    keyed = [(k, p) for k, p in prints if k is not None]
    group = closure({k for k, _ in keyed}, [(a, b) for a, p in keyed for b, q in keyed if (p ^ q).bit_count() <= 4])
    by_print = {p: group[k] for k, p in keyed}
    want = sorted(((k, p, by_print.get(p)) for k, p in prints), key=str)
    found = simhash.near_duplicates(cases.documents(spark, clashing)).collect()
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in found), key=str) == want


def test_shards_lose_no_link(spark, monkeypatch):
    rng = random.Random(3)
    prints = [rng.getrandbits(64) for _ in range(300)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for p in prints for _ in range(2)]
    monkeypatch.setattr(simhash, "SHARD_ROWS", 100)
    monkeypatch.setattr(simhash, "LEAF", 8)
    rows = [(i, p - 2**64 if p >= 2**63 else p) for i, p in enumerate(prints)]
    frame = spark.createDataFrame(rows, "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *a: frame)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame).collect()}
    assert got == closure(range(len(prints)), [(a, b) for a in range(len(prints)) for b in range(a)
                                               if (prints[a] ^ prints[b]).bit_count() <= 4])


def plain_repeats(docs, length):
    """Per row (key, n_words, n_removed, digest); of repeated rows one counts as a document."""
    order = sorted({(k, t) for k, t in docs}, key=lambda d: (d[0] is not None, d[0] or 0, crc(d[1])))
    seen, out = set(), {}
    for k, t in order:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = set()
        for i in range(len(words) - length + 1):
            window = tuple(words[i:i + length])
            if window in seen:
                gone.update(range(i, i + length))
            seen.add(window)
        kept = [w for i, w in enumerate(words) if i not in gone]
        out[k, t] = (k, len(words), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return [out[d] for d in docs]


def crc(text):
    import zlib

    return zlib.crc32((text or "").encode())


@pytest.mark.parametrize("clashing", [False, True])
def test_repeats_of_odd_documents(spark, clashing):
    found = substring.remove_repeats(cases.documents(spark, clashing), 20, carry=["source"])
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found.collect()]
    assert sorted(got, key=str) == sorted(plain_repeats(cases.texts(), 20), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_repeats_of_random_documents(spark, seed):
    rng = random.Random(seed)
    passages = [[rng.choice("abcdefgh") for _ in range(rng.randint(1, 60))] for _ in range(6)]
    docs = [(i, " ".join(w for _ in range(rng.randint(0, 6)) for w in rng.choice(passages))) for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(frame, 20).collect()]
    assert sorted(got) == sorted(plain_repeats(docs, 20))


@pytest.mark.parametrize("batch", [7, 10_000])
def test_repeats_of_a_passage_in_most_documents(spark, batch):
    """Batches of seven rows cut the runs of an anchor."""
    rng = random.Random(batch)
    common = [f"c{i}" for i in range(45)]  # in the same and in other surroundings
    docs = []
    for i in range(90):
        before, after = ([f"{rng.choice('xyz')}{rng.randint(0, 2)}" for _ in range(rng.randint(0, 25))] for _ in range(2))
        words = [*before, *common, *after] if i % 3 else common * (1 + i % 2)
        docs.append((None if i == 7 else i % 80, " ".join(words)))
    docs += docs[:9]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, batch)
    try:
        got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(frame, 20).collect()]
    finally:
        spark.conf.set(name, before)
    assert sorted(got, key=str) == sorted(plain_repeats(docs, 20), key=str)


VECTORS = [(0, [1.0, 0.0, 0.5], "a"), (1, [1.0, 0.0, 0.5], "a"), (2, [1.0, 0.01, 0.5], "a"), (3, [0.0, 1.0, 0.0], "a"),
           (4, [1.0, 0.0, 0.5], "b"), (5, None, "a"), (6, [0.0, 0.0, 0.0], "a"), (7, [float("nan"), 1.0, 0.0], "a"),
           (8, [None, 1.0, 0.0], "a"), (9, [float("inf"), 1.0, 0.0], "a"), (10, [0.0, 1.0, 0.01], None),
           (11, [0.0, 2.0, 0.01], "a"), (12, [], "a"), (None, [1.0, 0.0, 0.5], "a")]
SCHEMA = "vec_id long, embedding array<float>, label string"


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def test_vector_links(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 24))
    rows = VECTORS[:-1] + [(100 + i, (base[i % 40] + rng.standard_normal(24) * 0.25).tolist(), "cd"[i % 2])
                           for i in range(200)]
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 16)
    good = {k: (np.float32(v).astype(float), c) for k, v, c in rows if usable(v) and any(v) and c is not None}
    cosine = lambda a, b: len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93
    links = [(a, b) for a, (v, c) in good.items() for b, (w, d) in good.items() if a != b and c == d and cosine(v, w)]
    group = closure({k for k, _, _ in rows}, links)
    n = {k: sum(a == k for a, _ in links) for k in group}
    got = vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {
        k: (n[k], g, k == g) for k, g in group.items()}


def test_vector_edges(spark):
    found = vectors.near_duplicates(spark.createDataFrame(VECTORS, SCHEMA).withColumn("node", F.lit("x"))).collect()
    assert len(found) == len(VECTORS)
    assert [(r.n_links, r.component_id, r.kept) for r in found if r.vec_id is None] == [(0, None, False)]
    assert vectors.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = VECTORS + [(100 + i, rng.integers(-2, 3, 3).astype(float).tolist(), None) for i in range(90)]
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    ints = {k: [int(np.floor(1024 * float(np.float32(x)))) for x in v] for k, v, _ in rows if k is not None and usable(v)}
    want = []
    for q in (k for k in ints if k % 10 == 0):
        scored = sorted((-sum(a * b for a, b in zip(ints[q], v)), k) for k, v in ints.items() if k != q)[:7]
        want += [(q, rank, k, -s) for rank, (s, k) in enumerate(scored, 1)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in topk.top_k(frame, F.col("id") % 10 == 0, k=7).collect()]
    assert sorted(got) == sorted(want)
    assert topk.top_k(frame.limit(0), F.col("id") % 10 == 0).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 99), rng.randint(0, 99)) for _ in range(70)] + [(7, 7), (200, 200)]
    frame = spark.createDataFrame([*edges, (None, 3)], "u long, v long")
    nodes = {x for e in edges for x in e}
    got = {r.node: r.component for r in components.connected_components(frame).collect()}
    assert got == closure(nodes, edges)
    assert components.connected_components(frame.limit(0)).count() == 0


def test_no_documents(spark):
    assert simhash.near_duplicates(cases.none_at_all(spark)).count() == 0
    assert substring.remove_repeats(cases.none_at_all(spark)).count() == 0
