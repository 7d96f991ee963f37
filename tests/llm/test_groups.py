"""Shards, spelling variants and the trie of conversations against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tailsplit.llm import prefixes, sharding, spelling
from tailsplit.operators import joins
from tests.llm import cases

CONVERSATIONS = "conv_id long, turn long, role string, text string"


# --- shards ------------------------------------------------------------------------------

def plain_shards(rows, shards):
    """(key, size, crc, shard, slot) in the documented order."""
    narrow = []
    for key, text, _, source, _ in rows:
        raw = (text or "").encode()
        turn = hashlib.md5(("42" if key is None else f"42:{key}").encode()).hexdigest()
        narrow.append((source is not None, source or "", turn, key, zlib.crc32(raw), len(raw) + 1))
    low = lambda v: (v is not None, v)
    strata = defaultdict(list)
    for r in narrow:
        strata["none" if not r[0] else "s" + r[1]].append(r)
    order = []
    for name, group in strata.items():
        group.sort(key=lambda r: (r[2], low(r[3]), r[4], r[5]))
        order += [((2 * i + 1) / (2 * len(group)), r[2], low(r[3]), r[4], r[5], name, r) for i, r in enumerate(group)]
    order.sort(key=lambda x: x[:6])
    n, seen, out = len(order), Counter(), []
    for place, entry in enumerate(order):
        shard = place * shards // n
        out.append((entry[-1][3], entry[-1][5], entry[-1][4], shard, seen[shard]))
        seen[shard] += 1
    return sorted(out, key=str)


@pytest.mark.parametrize("clashing", [False, True])
@pytest.mark.parametrize("shards", [1, 4, 16, 50])
def test_shards(spark, clashing, shards):
    got = sharding.shard(cases.documents(spark, clashing), shards).collect()
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    assert sorted(((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in got), key=str) == plain_shards(cases.rows(), shards)


def test_shards_of_many_sources(spark, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(joins, "HEAD_ROWS", 1)
    got = sharding.shard(cases.documents(spark), 4).collect()
    assert sorted(((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in got), key=str) == plain_shards(cases.rows(), 4)


def test_every_shard_has_the_mixture(spark):
    rng = random.Random(1)
    rows = [(i, f"text {i % 7}", "en", rng.choices(["hot", "b", "c", None], [60, 30, 9, 1])[0], 6) for i in range(2000)]
    source = {r[0]: r[3] for r in rows}
    got = sharding.shard(spark.createDataFrame(rows, cases.DOCUMENTS)).collect()
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    total, inside = Counter(source.values()), Counter((r.shard, source[r.doc_id]) for r in got)
    for s in range(16):
        for name, n in total.items():
            assert abs(inside[s, name] - n / 16) < 2
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))


def test_no_documents_no_shards(spark):
    assert sharding.shard(cases.none_at_all(spark)).count() == 0


# --- spelling ----------------------------------------------------------------------------

def plain_words(rows, shortest, dropped=31, least=2):
    counts = Counter()
    for key, text in rows:
        for raw in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = raw.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % dropped == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}


def plain_near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(counts, ratio=10):
    near = {w: [v for v in counts if plain_near(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), form[w] and counts[form[w]]))
    return sorted(out, key=str)


def spelt(rng, n):
    """Texts whose words are edits of each other, some frequent, with letters of both halves of Latin-1."""
    base = ["".join(rng.choices("abcdefghinoéßÿ", k=rng.randint(2, 9))) for _ in range(12)]
    texts = []
    for i in range(n):
        words = []
        for _ in range(12):
            w = rng.choices(base, [2 ** -k for k in range(12)])[0]
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                at = rng.randrange(len(w) + 1)
                w = w[:at] + rng.choice(["", "a", "é", "X"]) + w[at + rng.randint(0, 1):]
            words.append(w or "a")
        texts.append((i, " ".join(words) + rng.choice(["", " x" * 3, "1abc_def"])))
    return texts


@pytest.mark.parametrize("small", [False, True])
def test_variants(spark, monkeypatch, small):
    if small:  # cells, shards and nodes of a few words, so that every level of the trie is dealt out
        for name, value in {"CELL_WORDS": 3, "SHARD_WORDS": 10, "LEAF": 2, "BLOCK": 64, "FLUSH": 50, "WIDTH": 4}.items():
            monkeypatch.setattr(spelling, name, value)
    texts = spelt(random.Random(11), 150)
    want = plain_variants(plain_words(texts, 3, dropped=5))
    got = spelling.variants(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), shortest=3, dropped=5)
    got = got.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert any(w[1] is not None and w[2] != w[1] for w in want)
    assert sorted((tuple(r) for r in got), key=str) == want


@pytest.mark.parametrize("clashing", [False, True])
def test_variants_of_odd_documents(spark, clashing):
    got = spelling.variants(cases.documents(spark, clashing), shortest=4).select(
        "word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_variants(plain_words(cases.texts(), 4))


def test_very_long_words(spark):
    long = "ab" * 60_000
    rows = [(i, t) for i, t in enumerate([long, long, long + "c", long + "c", long[1:], long[1:], "z" + long[1:], "z" + long[1:]])]
    got = spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((len(r.word), r.n, r.n_near) for r in got) == sorted(
        (len(w), n, near) for w, _, _, n, near, _ in plain_long(plain_words(rows, 7)))


def plain_long(counts):
    words = list(counts)
    return [(w, None, w, counts[w], sum(spelling.one_edit(w.encode("latin-1"), v.encode("latin-1")) for v in words), None)
            for w in words]


def test_one_edit():
    rng = random.Random(2)
    for _ in range(3000):
        a, b = ("".join(rng.choices("ab", k=rng.randint(0, 5))) for _ in range(2))
        assert spelling.one_edit(a.encode(), b.encode()) == plain_near(a, b)
        known = spelling.Words([a.encode(), b.encode()])
        assert known.one_edit_apart(np.array([0]), np.array([1]))[0] == plain_near(a, b)


def test_no_words(spark):
    assert spelling.variants(cases.none_at_all(spark)).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")).count() == 0


# --- conversations -----------------------------------------------------------------------

def digest_of(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def plain_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append(((turn is not None, turn or 0), digest_of(role or "", text or ""), (role or "", text or "")))
    original = {c: [x[2] for x in sorted(v)] for c, v in turns.items()}
    whole = {}
    for c, own in original.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        whole[c] = tuple(original.get(base, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, path in whole.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    out = []
    for path, inside in members.items():
        below = [p for p in members if p[:len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        leaves = sum(not any(len(q) == len(p) + 1 and q[:len(p)] == p for q in below) for p in below)
        saved = sum((len(members[p]) - 1) * (len(p[-1][1]) if p else 0) for p in below)
        ends = ",".join(str(c) for c in sorted(c for c in inside if len(whole[c]) == len(path)))
        out.append((min(inside), len(path), min(members[path[:-1]]) if path else None, len(inside), len(kids), leaves, saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def talk(rng, convs):
    rows = []
    for c in convs:
        for turn in range(rng.choice([1, 2, 3, 4, 9])):
            rows.append((c, rng.choice([turn, turn, turn, None]), rng.choice(["user", "assistant", None]),
                         rng.choice(["hello", "hello", "hi", "", None, "how are you 🙂"])))
    return rows + rows[:5] + [(None, 1, "user", "nobody's")]


@pytest.mark.parametrize("small", [False, True])
def test_trie(spark, monkeypatch, small):
    if small:  # many blocks, rounds and stretches
        for name, value in {"BLOCK_NODES": 20, "LAST_ARCS": 8, "STRETCH": 16, "BLOB": 6}.items():
            monkeypatch.setattr(prefixes, name, value)
    rng = random.Random(4)
    rows = talk(rng, [*range(0, 60), *range(98, 130), 207, 209, 350, -5, -100, -101, 10**15, 10**15 + 1])
    rows += [(300 + i, t, "user", "the same") for i in range(40) for t in range(3)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, CONVERSATIONS).repartition(3)
    got = prefixes.prefix_trie(frame).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_trie(rows)


def test_trie_beyond_a_broadcast(spark, monkeypatch):
    """Parents that are too many to be broadcast as a whole, some of them with many children."""
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 5)
    monkeypatch.setattr(joins, "HEAD_ROWS", 2)
    for name, value in {"BLOCK_NODES": 20, "LAST_ARCS": 8, "STRETCH": 16}.items():
        monkeypatch.setattr(prefixes, name, value)
    rng = random.Random(5)
    rows = talk(rng, [*range(0, 40), *range(98, 110), -5, -100])
    rows += [(300 + i, t, "user", "the same" if t < 8 else f"end {i}") for i in range(30) for t in range(9)]
    rng.shuffle(rows)
    got = prefixes.prefix_trie(spark.createDataFrame(rows, CONVERSATIONS).repartition(3)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_trie(rows)


def test_one_long_conversation(spark):
    rows = [(7, t, "user", f"turn {t}") for t in range(3000)] + [(8, 0, "user", "x")]
    got = prefixes.prefix_trie(spark.createDataFrame(rows, CONVERSATIONS))
    assert got.count() == 3001 - zlib.crc32(b"7") % 6 + (1 if zlib.crc32(b"8") % 6 == 0 else 0)
    assert got.where("n_children = 0").count() == got.where("depth = 0").first().n_leaves


def test_odd_conversations(spark):
    schema = CONVERSATIONS + ", id long, depth long, a long, conv string, place long, parent long"
    rows = [(1, 0, "user", "a"), (1, 1, None, None), (1, 1, None, None), (2, None, "user", "x" * 200_000), (3, 0, "", "")]
    got = prefixes.prefix_trie(spark.createDataFrame([(*r, 9, 9, 9, "clash", 9, 9) for r in rows], schema)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_trie(rows)
    assert prefixes.prefix_trie(spark.createDataFrame([], CONVERSATIONS)).count() == 0
    assert prefixes.prefix_trie(spark.createDataFrame([(None, 1, "user", "a")], CONVERSATIONS)).count() == 0
