import pytest
from pyspark.sql import functions as F

from tailsplit.operators import joins
from tailsplit.scratch import materialize


@pytest.fixture(scope="module")
def tables(spark):
    # Key "hot" holds a third of all rows; null keys and keys without a partner occur too.
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None)
                                  .when(F.col("id") % 50 == 2, F.lit("nowhere")).otherwise(
        F.concat(F.lit("k"), (F.col("id") % 200).cast("string"))).alias("k"))
    dim = df.filter("k IS NOT NULL AND k <> 'nowhere'").groupBy("k").agg(F.count("*").alias("n")).withColumn(
        "v", F.length("k"))
    return df, materialize(dim, "dim")


def rows(df):
    return sorted((tuple(r) for r in df.select("id", "k", "n", "v").collect()), key=str)


def test_every_path_agrees(tables):
    df, dim = tables
    plain = rows(df.join(dim, "k", "left"))
    assert rows(joins.lookup(df, dim, ["k"], freq="n")) == plain
    assert rows(joins.lookup(df, dim, ["k"], rows=1)) == plain
    for head in (1, 10, 1000):
        assert rows(joins.lookup(df, dim, ["k"], freq="n", spread_by=["id"], rows=1, head_rows=head)) == plain


def test_head_is_bounded(tables):
    _, dim = tables
    total = dim.agg(F.sum("n")).first()[0]
    for head in (1, 3, 10, 50):
        assert dim.filter(F.col("n") * head >= total).count() <= head


def test_hot_key_is_spread(tables):
    """The rows the broadcast answered do not meet in one partition of the second join."""
    df, dim = tables
    out = joins.lookup(df, dim, ["k"], freq="n", spread_by=["id"], rows=1, head_rows=10)
    plan = out._jdf.queryExecution().toString()
    assert "_slot" in plan
    slots = df.filter("k = 'hot'").select(F.pmod(F.xxhash64("id"), F.lit(joins.SPREAD)).alias("s")).distinct().count()
    assert slots > 500


def test_fits_broadcast_counts_rows_and_bytes(spark):
    df = materialize(spark.range(100).select("id", F.repeat(F.lit("x"), 100).alias("t")), "t")
    assert joins.fits_broadcast(df)
    assert not joins.fits_broadcast(df, rows=99)
    assert not joins.fits_broadcast(df, size=5000)


def test_join_scores_checks_counts(spark):
    a = spark.createDataFrame([(1,), (2,)], "row_id long")
    b = spark.createDataFrame([(1, 0.5), (3, 0.1)], "row_id long, ll double")
    with pytest.raises(ValueError):
        joins.join_scores(a, b)


def test_label_ids(spark):
    df = spark.createDataFrame([("b",), ("a",), ("-1",), (None,), ("a",)], "label string")
    dim = materialize(joins.label_ids(df.filter("label <> '-1'"), "label"), "dim")
    got = {r["label"]: r["label_id"] for r in joins.join_label_ids(df, "label", dim).collect()}
    assert got == {"a": 0, "b": 1, "-1": -1, None: None}


def test_a_missing_prediction_is_wrong(spark):
    from tailsplit.operators import metrics

    gold = spark.createDataFrame([(1, "a"), (2, "b")], "row_id long, gold string")
    both = joins.join_predictions(gold, spark.createDataFrame([(1, "a"), (3, "c")], "row_id long, pred string"))
    assert both.count() == 2
    assert metrics.accuracy(both, "pred", "gold").first().accuracy == 0.5


def test_turn_ids_of_long_conversations_differ(spark):
    turns = spark.createDataFrame([(c, t, "user", f"{c} {t}") for c in (1, 2) for t in range(1003)],
                                  "conv_id long, turn int, role string, text string")
    got = joins.next_turn_pairs(turns)
    assert got.count() == got.select("row_id").distinct().count() == 2 * 1002
    far = spark.createDataFrame([(1, 2 ** 31 - 1), (2, 0), (-1, 5)], "conv_id long, turn int")
    assert far.select(joins.turn_id()).distinct().count() == 3


def test_answered_rows_stay_out_of_the_shuffle(tables):
    """Read twice, the rows that the broadcast answers and those without a key are not exchanged."""
    df, dim = tables
    plain = rows(df.join(dim, "k", "left"))
    for head in (0, 1, 10, 1000):
        assert rows(joins.lookup(df, dim, ["k"], freq="n", rows=1, head_rows=head, reread=True)) == plain
    settled, rest = joins.settled_and_open(df, dim.filter("k = 'hot'"), ["k"])
    assert settled.filter("k = 'hot' OR k IS NULL").count() == settled.count() == df.filter("k = 'hot' OR k IS NULL").count()
    assert settled.count() + rest.count() == df.count()


def test_the_head_takes_the_room_it_has(tables):
    _, dim = tables
    assert dim.filter(joins.head_of(dim, "n", 1)).select("k").collect() == [("hot",)]
    assert dim.filter(joins.head_of(dim, "n", dim.count())).count() == dim.count()
    for room in (0, 1, 5, 50):
        assert dim.filter(joins.head_of(dim, "n", room)).count() <= room


@pytest.mark.parametrize("kinds", [("string", "string"), ("string", "int"), ("int", "int")])
def test_settled_and_open(spark, kinds):
    """Strings are looked up by one number; keys of other types, which may differ on both sides, are compared as they are."""
    make = {"string": str, "int": int}
    rows = [(i, *(None if (i + k) % 7 == 0 else make[kind]((i * k) % 5) for k, kind in enumerate(kinds, 1))) for i in range(60)]
    head = [(*(make[kind](v) for v, kind in zip(pair, kinds)), n) for n, pair in enumerate([(0, 0), (1, 2), (3, 1)])]
    df = spark.createDataFrame(rows, f"id long, a {kinds[0]}, b {kinds[1]}")
    wide = [k.replace("int", "long") for k in kinds]
    dim = spark.createDataFrame(head, f"a {wide[0]}, b {wide[1]}, n long")
    settled, rest = joins.settled_and_open(df, dim, ["a", "b"])
    known = {h[:2]: h[2] for h in head}
    want = {r[0]: known.get(r[1:]) for r in rows if None in r or r[1:] in known}
    assert {r["id"]: r["n"] for r in settled.collect()} == want
    assert sorted(r["id"] for r in rest.collect()) == [r[0] for r in rows if r[0] not in want]
    plan = settled._jdf.queryExecution().optimizedPlan().toString()
    assert ("xxhash64" in plan) == (kinds == ("string", "string"))
