import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tailsplit.operators import targets
from tailsplit.plans import splits

SCHEMA = "row_id long, label string, length long, key double"


def make(n, seed, labels=("a", "b", "c"), lengths=6):
    r = random.Random(seed)
    return [(i, r.choice(labels), r.randint(1, lengths), float(r.randint(-8, 8))) for i in range(n)]


def sizes(pdf, test, dev):
    """Targets per class by the stated rule."""
    order = pdf.sort_values(["key", "row_id"])["label"].drop_duplicates().tolist()
    out = {}
    for i, label in enumerate(order):
        n = (pdf["label"] == label).sum()
        te = min(test // len(order) + (test % len(order) if i == 0 else 0), n)
        de = min(dev // len(order) + (dev % len(order) if i == 0 else 0), n - te)
        out[label] = (te, de)
    return out


@pytest.mark.parametrize("seed,test,dev", [(1, 10, 10), (2, 11, 7), (3, 200, 200), (4, 0, 0)])
def test_class_split(spark, seed, test, dev):
    data = make(120, seed)
    pdf = pd.DataFrame(data, columns=["row_id", "label", "length", "key"])
    got = splits.split_classes(spark.createDataFrame(data, SCHEMA), "label", test, dev).toPandas()
    assert sorted(got["row_id"]) == list(range(120))
    for label, (te, de) in sizes(pdf, test, dev).items():
        mine = got[got["label"] == label]
        assert (mine["split"] == "test").sum() == te
        assert (mine["split"] == "dev").sum() == de
        ordered = pdf[pdf["label"] == label].sort_values(["key", "row_id"])["row_id"].tolist()
        want = set(ordered[len(ordered) - te - de:])
        assert set(mine[mine["split"].isin(["test", "dev"])]["row_id"]) == want


def test_seed_and_partitioning(spark):
    df = spark.createDataFrame(make(200, 5), SCHEMA)

    def run(frame, seed):
        return sorted(tuple(r) for r in splits.split_classes(frame, "label", 20, 20, seed).select("row_id", "split").collect())
    assert run(df, 42) == run(df.repartition(13, "length"), 42)
    assert run(df, 42) != run(df, 43)


def test_null_labels_are_dropped_and_missing_scores_are_least_likely(spark):
    data = [(0, "a", 1, None), (1, "a", 1, 1.0), (2, "a", 1, 5.0), (3, None, 1, 0.0), (4, "b", 1, 2.0)]
    got = {r["row_id"]: r["split"] for r in splits.split_classes(spark.createDataFrame(data, SCHEMA), "label", 1, 0).collect()}
    assert got[3] == "dropped"
    # Class a holds the best row, so it takes the remainder, and gives its row without a score.
    assert got[0] == "test"
    assert got[1] == got[2] == got[4] == "train"


def qcut(values, k):
    """Right-closed quantile bins, equal edges collapsed."""
    edges = np.unique(np.quantile(values, [i / k for i in range(k + 1)]))
    return [int(sum(e < v for e in edges[1:-1])) for v in values]


@pytest.mark.parametrize("k", [2, 4, 7])
@pytest.mark.parametrize("lengths", [1, 3, 40])
def test_quantile_buckets(spark, k, lengths):
    data = make(90, k * 100 + lengths, lengths=lengths)
    df = spark.createDataFrame(data, SCHEMA)
    hist = targets.length_histogram(df, ["label"])
    got = targets.assign_buckets(df, targets.quantile_buckets(hist, k, ["label"]), ["label"]).toPandas()
    for label, mine in got.groupby("label"):
        assert mine["length_bucket"].tolist() == qcut(mine["length"].to_numpy(), k)


def reference_bucket_split(pdf, label, te, de, buckets, seed):
    """Evaluation rows of one class: cut by bucket, then exact by moving rows at the border."""
    import hashlib
    mine = pdf[pdf["label"] == label].sort_values(["key", "row_id"])
    want = te + de
    picked = []
    for b in sorted(mine[buckets].unique()):
        part = mine[mine[buckets] == b]
        share = want * len(part) / len(mine)
        draw = int(hashlib.md5(f"{seed}:{label}:{b}".encode()).hexdigest()[:8], 16) / 2 ** 32
        n = min(int(share) + (draw < share - int(share)), len(part))
        picked += part["row_id"].tolist()[len(part) - n:]
    inside = [r for r in mine["row_id"] if r in set(picked)]
    outside = [r for r in mine["row_id"] if r not in set(picked)]
    if len(inside) < want:
        move = outside[::-1][:want - len(inside)]
        return set(inside) | set(move)
    return set(inside[len(inside) - want:])


@pytest.mark.parametrize("kind", [3, splits.UNIQUE_LENGTHS])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_bucket_split(spark, kind, seed):
    data = make(150, seed, lengths=9)
    pdf = pd.DataFrame(data, columns=["row_id", "label", "length", "key"])
    got = splits.split_classes_buckets(spark.createDataFrame(data, SCHEMA), "label", 17, 13, kind, seed).toPandas()
    merged = pdf.merge(got[["row_id", "length_bucket", "split"]], on="row_id")
    assert len(merged) == 150
    for label, (te, de) in sizes(pdf, 17, 13).items():
        mine = merged[merged["label"] == label]
        assert (mine["split"] == "test").sum() == te and (mine["split"] == "dev").sum() == de
        want = reference_bucket_split(merged, label, te, de, "length_bucket", seed)
        assert set(mine[mine["split"] != "train"]["row_id"]) == want


@pytest.mark.parametrize("kind", [3, splits.UNIQUE_LENGTHS])
@pytest.mark.parametrize("size", [0, 37, 100, 150, 400])
def test_fixed_train_buckets_exact_size(spark, kind, size):
    data = make(150, size, lengths=9)
    rows = spark.createDataFrame(data, SCHEMA).drop("label")
    got = splits.halve_rest(splits.fixed_train_buckets(rows, size, kind)).toPandas()
    n_train = min(size, 150)
    assert sorted(got["row_id"]) == list(range(150))
    assert (got["split"] == "train").sum() == n_train
    assert (got["split"] == "dev").sum() == (150 - n_train) // 2


@pytest.mark.parametrize("picked_end,needed", [("least", 2), ("least", -2), ("most", 2), ("most", -2)])
def test_rebalance_moves_the_border_rows(spark, picked_end, needed):
    least = picked_end == "least"
    rows = spark.createDataFrame([(i, float(i), (i >= 5) == least) for i in range(10)], "row_id long, key double, picked boolean")
    wanted = spark.createDataFrame([(needed,)], "needed long")
    before = {r["row_id"]: r["picked"] for r in rows.collect()}
    after = {r["row_id"]: r["picked"] for r in splits.rebalance(rows, wanted, [], picked_end).collect()}
    moved = {i for i in range(10) if before[i] != after[i]}
    border = {("least", 2): {3, 4}, ("least", -2): {5, 6}, ("most", 2): {5, 6}, ("most", -2): {3, 4}}
    assert moved == border[(picked_end, needed)]


def test_percent_split(spark):
    rows = spark.range(30).withColumnRenamed("id", "row_id")
    got = splits.percent_split(rows, 5).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"validation": 2, "train": 28}


def test_audit_finds_faults(spark):
    pool = spark.range(5).withColumnRenamed("id", "row_id")
    bad = spark.createDataFrame([(0,), (0,), (1,), (9,)], "row_id long")
    got = splits.split_audit(bad, pool).first()
    assert (got["n_repeated"], got["n_missing"], got["n_foreign"]) == (1, 3, 1)


def test_sort_outputs(spark):
    rows = spark.createDataFrame([(1, 1.0, "train"), (2, 2.0, "train"), (3, 3.0, "dev"), (4, 4.0, "dev")],
                                 "row_id long, key double, split string")
    got = {r["row_id"]: r["order_in_split"] for r in splits.sort_outputs(rows).collect()}
    assert got == {2: 1, 1: 2, 3: 1, 4: 2}


def test_uniform_draw_is_spread(spark):
    draws = spark.range(400).select(targets.seeded_uniform(7, F.col("id")).alias("u")).toPandas()["u"]
    assert draws.between(0, 1, inclusive="left").all()
    assert abs(draws.mean() - 0.5) < 0.08
