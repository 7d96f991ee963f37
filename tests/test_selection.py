import random

import pytest
from pyspark.sql import functions as F

from tailsplit.operators import selection
from tailsplit.operators.selection import choose, order_by
from tailsplit.plans import splits


def model(data, wanted):
    """First k of each label by (missing, key, id)."""
    out = set()
    for label, k in wanted.items():
        mine = [(key is None, _rank(key), i) for i, (lab, key) in enumerate(data) if lab == label]
        out |= {t[2] for t in sorted(mine)[:max(k, 0)]}
    return out


def _rank(key):
    if key is None:
        return 0
    if isinstance(key, float) and key != key:
        return (1, 0.0)
    return key.encode() if isinstance(key, str) else (0, key)


def check(spark, data, wanted, kind, border_rows):
    rows = spark.createDataFrame([(i, lab, key) for i, (lab, key) in enumerate(data)],
                                 f"row_id long, label string, key {kind}").repartition(5, "row_id")
    sizes = [(lab, sum(1 for x in data if x[0] == lab), k) for lab, k in wanted.items()]
    table = spark.createDataFrame(sizes, "label string, n long, k long")
    got = choose(rows, table, ["label"], order_by(rows), border_rows=border_rows)
    assert got.columns == ["row_id", "label", "key", "chosen"]
    found = got.collect()
    assert len(found) == len(data)
    assert {r["row_id"] for r in found if r["chosen"]} == model(data, wanted)


@pytest.mark.parametrize("border_rows", [1, 20, 4096])
def test_numbers(spark, border_rows):
    r = random.Random(border_rows)
    odd = [None, float("nan"), float("inf"), float("-inf"), 1e308, -1e308, 0.0, 5e-324]
    # A third of all rows share one key; one class holds most rows; tails are heavy.
    data = [(r.choice("aaaab"), r.choice([1.5, r.choice(odd), r.lognormvariate(0, 4)])) for _ in range(900)]
    n = sum(1 for x in data if x[0] == "a")
    for k in (1, n // 3, n - 1):
        check(spark, data, {"a": k, "b": 7}, "double", border_rows)
    check(spark, data, {"a": 0, "b": 10 ** 6}, "double", border_rows)


@pytest.mark.parametrize("border_rows", [1, 4096])
def test_strings_and_whole_numbers(spark, border_rows):
    r = random.Random(7)
    words = [None, "", "a", "a\0", "b", "żółw", "\U0001F600", "aaaaaaab", "aaaaaaaa"]
    data = [(r.choice("ab"), r.choice([r.choice(words), f"{r.getrandbits(64):016x}"])) for _ in range(500)]
    check(spark, data, {"a": 90, "b": 120}, "string", border_rows)
    data = [(r.choice("ab"), r.choice([None, 2 ** 62, 2 ** 62 + 1, -2 ** 62, r.randrange(50)])) for _ in range(500)]
    check(spark, data, {"a": 100, "b": 200}, "long", border_rows)


def test_empty_and_unknown_groups(spark):
    rows = spark.createDataFrame([(1, "a", 1.0)], "row_id long, label string, key double")
    none = spark.createDataFrame([], "label string, n long, k long")
    assert [r["chosen"] for r in choose(rows, none, ["label"], order_by(rows)).collect()] == [False]
    assert choose(rows.limit(0), none, ["label"], order_by(rows)).count() == 0


def test_same_for_any_partitioning_and_no_range_sort(spark, monkeypatch):
    monkeypatch.setattr(selection, "BORDER_ROWS", 50)
    rows = spark.range(5000).select(F.col("id").alias("row_id"), (F.col("id") % 3).alias("label"),
                                    F.when(F.col("id") % 5 > 0, (F.col("id") * 7919 % 4001).cast("double")).alias("key"))
    seen = []
    for parts in (1, 4, 17):
        out = splits.split_classes(rows.repartition(parts, "row_id"), "label", 500, 300)
        seen.append({(r["row_id"], r["split"]) for r in out.collect()})
        assert "rangepartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    assert seen[0] == seen[1] == seen[2]
    ordered = rows.toPandas().sort_values(["label", "key", "row_id"], na_position="last")
    sizes = {0: (168, 100), 1: (166, 100), 2: (166, 100)}
    best = ordered.sort_values(["key", "row_id"], na_position="last").iloc[0]["label"]
    for label, group in ordered.groupby("label"):
        k = sum(sizes[0]) if label == best else sum(sizes[1])
        want = set(group["row_id"].tail(k))
        assert {i for i, s in seen[0] if s != "train" and i % 3 == label} == want


def test_border_is_the_only_sort(spark, monkeypatch):
    """Of many rows with distinct keys only those of one range are sorted."""
    monkeypatch.setattr(selection, "BORDER_ROWS", 100)
    rows = spark.range(200_000).select(F.lit(0).alias("g"), F.struct(F.col("id")).alias("_o"),
                                       F.col("id").cast("double").alias("_m"))
    state = spark.createDataFrame([(0, 200_000, 123_457)], "g int, _n long, _k long")
    calls = []
    monkeypatch.setattr(selection, "rank_rows", lambda *a: calls.append(a))
    assert selection.borders(rows, state, ["g"]).first()["_border"]["id"] == 123_456
    assert not calls
