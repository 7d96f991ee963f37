import math

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tailsplit.operators import ranking
from tailsplit.operators.metrics import exact_median

scores = st.one_of(st.none(), st.just(float("nan")), st.integers(-3, 3).map(float))
rows = st.lists(st.tuples(st.sampled_from(["a", "b", None]), scores), min_size=1, max_size=40)


def frame(spark, data, parts=4):
    out = [(i, label, score) for i, (label, score) in enumerate(data)]
    return spark.createDataFrame(out, "row_id long, label string, score double").repartition(parts, "row_id")


def model(data, kind):
    """Stable sort, most likely first, missing scores last, inside each class."""
    def key(score):
        missing = score is None or math.isnan(score)
        return (missing, 0 if missing else (-score if kind == "ll" else score))
    ordered = sorted(range(len(data)), key=lambda i: (key(data[i][1]), i))
    seen, out = {}, {}
    for i in ordered:
        label = data[i][0]
        seen[label] = seen.get(label, 0) + 1
        out[i] = seen[label]
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=rows, kind=st.sampled_from(["ll", "ppl"]))
def test_rank_in_class(spark, data, kind):
    df = frame(spark, data).withColumn("key", ranking.likelihood_key("score", kind))
    got = ranking.rank_rows(df, ranking.key_order(), ["label"])
    assert {r["row_id"]: r["rank"] for r in got.collect()} == model(data, kind)


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_same_for_any_partitioning(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        # A third of the rows share one key and one class.
        df = spark.range(3000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, 0).otherwise(
            F.col("id") % 7).alias("label"), F.when(F.col("id") % 3 == 0, 1.0).otherwise(
            (F.col("id") * 37 % 101).cast("double")).alias("key"))
        got = ranking.rank_rows(df.repartition(parts, "row_id"), ranking.key_order(), ["label"]).toPandas()
        pdf = df.toPandas().sort_values(["label", "key", "row_id"])
        pdf["rank"] = pdf.groupby("label").cumcount() + 1
        assert got.sort_values("row_id")["rank"].tolist() == pdf.sort_values("row_id")["rank"].tolist()
        total = ranking.running_total(df, "row_id", [F.col("row_id")], ["label"]).toPandas().sort_values("row_id")
        want = pdf.sort_values("row_id").groupby("label")["row_id"].cumsum() - pdf.sort_values("row_id")["row_id"]
        assert total["offset"].tolist() == want.tolist()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("k", [3, 1500])
def test_first_in_group(spark, k):
    df = spark.range(4000).select(F.col("id").alias("row_id"), (F.col("id") % 2).alias("g"))
    got = ranking.first_in_group(df, [F.col("row_id").desc()], ["g"], k).groupBy("g").agg(
        F.count("*").alias("n"), F.min("row_id").alias("low")).toPandas().sort_values("g")
    assert got["n"].tolist() == [k, k]
    assert got["low"].tolist() == [4000 - 2 * k, 4001 - 2 * k]


def test_row_ids_keep_file_order(spark, tmp_path):
    path = str(tmp_path / "in.csv")
    with open(path, "w") as f:
        f.write("text\n" + "\n".join(f"line {i}" for i in range(500)) + "\n")
    df = ranking.with_row_id(spark.read.option("header", True).csv(path))
    got = df.toPandas().sort_values("row_id")
    assert got["row_id"].tolist() == list(range(500))
    assert got["text"].tolist() == [f"line {i}" for i in range(500)]


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0], [5.0] * 9 + [1.0, 2.0], [3.0, 1.0, 2.0, 10.0]])
def test_exact_median(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert exact_median(df, "v") == pd.Series(values).median()
