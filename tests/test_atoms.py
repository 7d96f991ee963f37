import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tailsplit.operators import atoms


def plain_cover(held):
    """The rounds of greedy_cover on sets."""
    left, taken = dict(held), set()
    left = {r: set(a) for r, a in left.items() if a}
    while left:
        most = max(map(len, left.values()))
        strong = {r: a for r, a in left.items() if 2 * len(a) >= most}
        votes = {}
        for atom in set().union(*strong.values()):
            best = min((-len(a), r) for r, a in strong.items() if atom in a)[1]
            votes[best] = votes.get(best, 0) + 1
        won = {r for r, n in votes.items() if 2 * n >= len(strong[r])}
        taken |= won
        gone = set().union(*(left[r] for r in won))
        left = {r: a - gone for r, a in left.items() if a - gone}
    return taken


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_greedy_cover(spark, seed):
    r = random.Random(seed)
    held = {i: set(r.sample(range(30), r.randrange(1, 8))) for i in range(1, 13)}
    rows = [(a, i) for i, s in held.items() for a in s]
    every = set().union(*held.values())
    seen = []
    for parts in (1, 6):
        r.shuffle(rows)
        df = spark.createDataFrame(rows, "atom int, rank long").repartition(parts)
        seen.append(sorted(x["rank"] for x in atoms.greedy_cover(df).collect()))
    assert seen[0] == seen[1] == sorted(plain_cover(held))
    assert set().union(*(held[i] for i in seen[0])) == every
    fewest = next(k for k in range(1, 13) if any(set().union(*(held[i] for i in c)) == every
                                                 for c in combinations(held, k)))
    assert len(seen[0]) <= 2 * fewest


def test_cover_of_nothing_and_of_a_hot_atom(spark):
    assert atoms.greedy_cover(spark.createDataFrame([], "atom int, rank long")).count() == 0
    hot = spark.range(3000).selectExpr("'all' AS atom", "id AS rank")
    assert [x["rank"] for x in atoms.greedy_cover(hot).collect()] == [0]


def balanced(spark, texts, picked, fewest):
    rows = spark.createDataFrame([(i, float(i), p) for i, p in enumerate(picked)], "row_id long, key double, picked boolean")
    docs = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")
    return atoms.balance_atoms(rows, atoms.atom_rows(docs), fewest=fewest)


def test_size_is_kept_where_single_holders_grow_it(spark):
    # Each missing atom has its own likely holder, and one unlikely row that holds them all. Of the
    # picked rows each is the most likely holder of some atom, though one row holds all of them.
    texts = ["a", "b", "c", "a b c", "x", "y", "z", "x y z"]
    picked = [True] * 4 + [False] * 4
    _, plain = balanced(spark, texts, picked, False)
    assert plain == {"missing_atoms": 3, "moved_in": 3, "moved_out": 1, "grown_by": 2}
    out, report = balanced(spark, texts, picked, True)
    assert report == {"missing_atoms": 3, "moved_in": 1, "moved_out": 1, "grown_by": 0}
    assert {r["row_id"] for r in out.filter("picked").collect()} == {0, 1, 2, 7}
    # Here the likely holders would leave no row free: a cover of the picked side frees two.
    texts = ["a", "b", "a b", "x", "y"]
    picked = [True] * 3 + [False] * 2
    assert balanced(spark, texts, picked, False)[1]["grown_by"] == 1
    out, report = balanced(spark, texts, picked, True)
    assert report["moved_in"] == 2 and report["grown_by"] == 0
    assert {r["row_id"] for r in out.filter("picked").collect()} == {2, 3, 4}


@pytest.mark.parametrize("seed", [1, 2])
def test_nothing_is_lost(spark, seed):
    r = random.Random(seed)
    texts = [" ".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randrange(6))) for _ in range(60)]
    picked = [i < 40 for i in range(60)]
    out, report = balanced(spark, texts, picked, True)
    train = {x["row_id"] for x in out.filter("picked").collect()}
    assert set().union(*(texts[i].split() for i in range(60))) == set().union(*(texts[i].split() for i in train))
    assert len(train) == 40 + report["grown_by"]


def test_letter_triples_cover_every_place_and_do_not_walk_a_long_text_again(spark):
    import time

    from tailsplit.queries.scoring import letter_triples
    texts = [None, "", "a", "ab", "abc", "aé\U0001f600b\nc", "\U0001f600" * 4, "日本語 x", "abcdefghij" * 30_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")
    began = time.time()
    got = {r["row_id"]: r["t"] or [] for r in rows.select("row_id", letter_triples(F.col("text")).alias("t")).collect()}
    assert time.time() - began < 20
    assert got == {i: [t[k:k + 3] for k in range(len(t or "") - 2)] for i, t in enumerate(texts)}
