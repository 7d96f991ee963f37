"""How many rows each class and each length bucket gives to the evaluation side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailsplit.operators.joins import lookup
from tailsplit.scratch import materialize


def class_targets(rows: DataFrame, label: str, key: str, test: int, dev: int, row_id: str = "row_id") -> DataFrame:
    """(label, class_rows, test_target, dev_target) for every non-null class.

    The sizes are divided evenly; the class that holds the most likely row of all takes the
    remainders. A class smaller than its target gives all it has, test first.
    """
    per_class = rows.filter(F.col(label).isNotNull()).groupBy(label).agg(
        F.count(F.lit(1)).alias("class_rows"),
        F.min(F.struct(F.col(key).isNull().alias("missing"), F.col(key).alias("key"),
                       F.col(row_id).alias("id"))).alias("best"))
    per_class = materialize(per_class, "classes")
    overall = per_class.agg(F.count(F.lit(1)).alias("k"), F.min("best.missing").alias("m"),
                            F.min("best").alias("best")).first()
    k = max(overall["k"], 1)
    first = F.col("best.id") == F.lit(overall["best"]["id"] if overall["best"] else None)

    def share(size: int) -> Column:
        return F.lit(size // k) + F.when(first, F.lit(size % k)).otherwise(F.lit(0))

    wanted = per_class.select(label, "class_rows", share(test).cast("long").alias("t"),
                              share(dev).cast("long").alias("d"))
    given = F.least("t", "class_rows")
    return wanted.select(label, "class_rows", given.alias("test_target"),
                         F.least(F.col("d"), F.col("class_rows") - given).alias("dev_target"))


def length_histogram(rows: DataFrame, by: Sequence[str] = (), length: str = "length") -> DataFrame:
    """Distinct lengths with their counts, the small table all bucket work runs on."""
    return rows.groupBy(*by, length).agg(F.count(F.lit(1)).alias("n_rows"))


def quantile_buckets(histogram: DataFrame, k: int, by: Sequence[str] = (), length: str = "length") -> DataFrame:
    """(by, length, n_rows, length_bucket): buckets between exact length quantiles, right edge closed.

    The quantiles come from the histogram with its counts as weights. Equal edges collapse.
    """
    by = list(by)
    cuts = F.array(*[F.lit(i / k) for i in range(k + 1)])
    edges = F.array_distinct(F.percentile(length, cuts, F.col("n_rows")))
    inner = F.slice(F.col("_edges"), 2, F.greatest(F.size("_edges") - 2, F.lit(0)))
    if by:
        edge_table = materialize(histogram.groupBy(*by).agg(edges.alias("_edges")), "edges")
        with_edges = lookup(histogram, edge_table, by)
    else:
        only = histogram.agg(edges.alias("_edges")).first()[0] or []
        with_edges = histogram.withColumn("_edges", F.array(*[F.lit(float(e)) for e in only]))
    bucket = F.size(F.filter(inner, lambda e: e < F.col(length)))
    return with_edges.withColumn("length_bucket", bucket.cast("long")).drop("_edges")


def unique_length_buckets(histogram: DataFrame, by: Sequence[str] = (), length: str = "length") -> DataFrame:
    """(by, length, n_rows, length_bucket): one bucket per distinct length, counted from zero.

    The window runs over distinct lengths, not over rows.
    """
    window = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    bucket = F.dense_rank().over(window.orderBy(length)) - 1
    return histogram.withColumn("length_bucket", bucket.cast("long"))


def assign_buckets(rows: DataFrame, buckets: DataFrame, by: Sequence[str] = (), length: str = "length",
                   row_id: str = "row_id") -> DataFrame:
    """Attach the bucket of each row's length; common lengths are handled by their counts."""
    table = buckets.select(*by, length, "n_rows", "length_bucket")
    return lookup(rows, table, [*by, length], freq="n_rows", spread_by=[row_id]).drop("n_rows")


def bucket_counts(buckets: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows per bucket, from the histogram."""
    return buckets.groupBy(*by, "length_bucket").agg(F.sum("n_rows").alias("bucket_rows"))


def seeded_uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the parts only."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def bucket_targets(counts: DataFrame, target: Column, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """Proportional share of ``target`` per bucket, its fraction rounded at random.

    ``target`` is the number wanted of the whole class (or table); adds ``bucket_target``.
    """
    window = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    share = F.col("_wanted") * F.col("bucket_rows") / F.sum("bucket_rows").over(window)
    draw = seeded_uniform(seed, *[F.col(c) for c in by], F.col("length_bucket"))
    whole = F.floor("_share")
    extra = F.when(draw < F.col("_share") - whole, F.lit(1)).otherwise(F.lit(0))
    return (counts.withColumn("_wanted", target.cast("double")).withColumn("_share", share)
            .withColumn("bucket_target", F.least((whole + extra).cast("long"), F.col("bucket_rows")))
            .drop("_wanted", "_share"))
