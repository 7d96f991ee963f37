"""The split recipes: who goes to train, dev and test.

Each takes a narrow table (row_id, label, key, length) and returns it with a ``split`` column;
texts are joined back by ``row_id`` only where they are written. The table is read several times,
so pass a written one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailsplit.operators.clean import clean_report, label_given, not_na, not_placeholder
from tailsplit.operators.joins import lookup
from tailsplit.operators.ranking import key_order, rank_rows, seeded_order
from tailsplit.operators.selection import choose, order_by
from tailsplit.operators.targets import (assign_buckets, bucket_counts, bucket_targets, class_targets,
                                         length_histogram, quantile_buckets, unique_length_buckets)
from tailsplit.scratch import materialize, row_count
from tailsplit.sources.readers import origin_id

UNIQUE_LENGTHS = "unique"


def shuffle_halves(evaluation: DataFrame, label: str, seed: int) -> DataFrame:
    """Shuffle each class by the seed; the first ``test_target`` rows are test, the others dev."""
    mixed = evaluation.withColumn("_mix", seeded_order(seed))
    wanted = evaluation.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.max("test_target").alias("k"))
    chosen = choose(mixed, wanted, [label], order_by(mixed, "_mix"), "_test")
    return chosen.withColumn("split", F.when(F.col("_test"), "test").otherwise("dev")).drop("_mix", "_test")


def split_standard(rows: DataFrame, label: str, first: str, second: str, split: str = "split",
                   row_id: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """The original splits without unusable rows, ids naming their origin; and the report of what went."""
    keep = label_given(label) & not_placeholder(first) & not_na(second)
    tagged = rows.withColumn("origin_id", origin_id(F.col(split), F.col(row_id)))
    return tagged.filter(keep), clean_report(rows, keep, split)


def dropped(rows: DataFrame, label: str) -> DataFrame:
    """Rows without a label belong to no class; they are reported, not lost."""
    return rows.filter(F.col(label).isNull()).withColumn("split", F.lit("dropped"))


def split_classes(rows: DataFrame, label: str, test: int, dev: int, seed: int = 42, key: str = "key") -> DataFrame:
    """The least likely rows of every class become dev and test, the others train."""
    targets = materialize(class_targets(rows, label, key, test, dev), "targets")
    wanted = targets.select(label, F.col("class_rows").alias("n"),
                            (F.col("class_rows") - F.col("test_target") - F.col("dev_target")).alias("k"))
    sided = choose(rows.filter(F.col(label).isNotNull()), wanted, [label], order_by(rows, key), "_train")
    train = sided.filter("_train").withColumn("split", F.lit("train"))
    halves = shuffle_halves(lookup(sided.filter(~F.col("_train")), targets, [label]), label, seed)
    columns = [*rows.columns, "split"]
    return train.select(columns).unionByName(halves.select(columns)).unionByName(dropped(rows, label))


def buckets_of(rows: DataFrame, buckets: int | str, by: list[str]) -> DataFrame:
    """Bucket table (by, length, n_rows, length_bucket) for ``buckets`` quantiles or unique lengths."""
    histogram = materialize(length_histogram(rows, by), "histogram")
    if buckets == UNIQUE_LENGTHS:
        return materialize(unique_length_buckets(histogram, by), "buckets")
    return materialize(quantile_buckets(histogram, int(buckets), by), "buckets")


def rebalance(rows: DataFrame, needed: DataFrame, by: list[str], picked_end: str, key: str = "key") -> DataFrame:
    """Flip rows between the sides until the sizes are exact.

    ``rows`` has the boolean ``picked``; ``needed`` says per group how many more rows must be
    picked (negative: how many go back). ``picked_end`` is the end of the likelihood order the
    picked side takes, ``most`` or ``least``. Rows join it from that end and leave it from the
    other, so the rows that move are always those nearest to the border of the two sides.
    """
    by, columns = list(by), rows.columns
    if not by:
        by, rows, needed = ["_all"], rows.withColumn("_all", F.lit(0)), needed.withColumn("_all", F.lit(0))
    sided = lookup(rows, needed.select(*by, F.col("needed").alias("_needed")), by)
    side = F.when(F.col("_needed") > 0, ~F.col("picked")).when(F.col("_needed") < 0, F.col("picked")).otherwise(F.lit(False))
    # Seen along the order, the rows that move are the last or the first ones of their side.
    last = (F.col("_needed") > 0) == F.lit(picked_end == "least")
    wanted = sided.filter(side).groupBy(*by, "_needed").agg(F.count(F.lit(1)).alias("n"))
    wanted = wanted.select(*by, "n", F.when(last, F.col("n") - F.abs("_needed")).otherwise(F.abs("_needed")).alias("k"))
    cut = choose(sided, wanted, by, order_by(rows, key), "_first", side)
    moved = side & (F.col("_first") != last)
    return cut.withColumn("picked", F.col("picked") != moved).select(*columns)


def bucket_cut(rows: DataFrame, label: str, test: int, dev: int, buckets: int | str, seed: int = 42,
               key: str = "key") -> tuple[DataFrame, DataFrame]:
    """Evaluation side by length bucket, ``picked`` before and after the sizes were made exact."""
    known = rows.filter(F.col(label).isNotNull())
    targets = materialize(class_targets(rows, label, key, test, dev), "targets")
    table = buckets_of(known, buckets, [label])
    counts = lookup(bucket_counts(table, [label]), targets, [label])
    cuts = materialize(bucket_targets(counts, F.col("test_target") + F.col("dev_target"), seed, [label]).select(
        label, "length_bucket", "bucket_rows", "bucket_target"), "cuts")

    wanted = cuts.select(label, "length_bucket", F.col("bucket_rows").alias("n"),
                         (F.col("bucket_rows") - F.col("bucket_target")).alias("k"))
    cut = choose(assign_buckets(known, table, [label]), wanted, [label, "length_bucket"], order_by(known, key), "_kept")
    picked = materialize(cut.withColumn("picked", ~F.col("_kept")).drop("_kept"), "picked")

    have = picked.groupBy(label).agg(F.count_if("picked").alias("have"))
    needed = materialize(lookup(have, targets, [label]).select(
        label, (F.col("test_target") + F.col("dev_target") - F.col("have")).alias("needed")), "needed")
    return picked, lookup(rebalance(picked, needed, [label], "least", key), targets, [label])


def split_classes_buckets(rows: DataFrame, label: str, test: int, dev: int, buckets: int | str,
                          seed: int = 42, key: str = "key") -> DataFrame:
    """As ``split_classes``, but each length bucket gives its share of the evaluation rows."""
    _, exact = bucket_cut(rows, label, test, dev, buckets, seed, key)
    columns = [*rows.columns, "length_bucket", "split"]
    train = exact.filter(~F.col("picked")).withColumn("split", F.lit("train"))
    halves = shuffle_halves(exact.filter("picked"), label, seed)
    lost = dropped(rows, label).withColumn("length_bucket", F.lit(None).cast("long"))
    return train.select(columns).unionByName(halves.select(columns)).unionByName(lost.select(columns))


def fixed_train(rows: DataFrame, size: int, key: str = "key") -> DataFrame:
    """The ``size`` most likely rows are picked for train; no classes."""
    wanted = rows.agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.lit(size))
    return choose(rows, wanted, [], order_by(rows, key), "picked")


def fixed_train_buckets(rows: DataFrame, size: int, buckets: int | str, seed: int = 42,
                        key: str = "key") -> DataFrame:
    """Most likely rows of each length bucket, then moved to the exact train ``size``."""
    table = buckets_of(rows, buckets, [])
    cuts = materialize(bucket_targets(bucket_counts(table), F.lit(size), seed), "cuts")
    wanted = cuts.select("length_bucket", F.col("bucket_rows").alias("n"), F.col("bucket_target").alias("k"))
    picked = materialize(choose(assign_buckets(rows, table), wanted, ["length_bucket"], order_by(rows, key), "picked"),
                         "picked")
    needed = picked.agg((F.least(F.lit(size), F.count(F.lit(1))) - F.count_if("picked")).alias("needed"))
    return rebalance(picked, needed, [], "most", key)


def halve_rest(rows: DataFrame, seed: int = 42) -> DataFrame:
    """Rows not picked for train are shuffled; the first half (rounded down) is dev, the rest test."""
    rest = rows.filter(~F.col("picked")).withColumn("_mix", seeded_order(seed))
    wanted = rest.agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.floor(F.col("n") / 2))
    rest = choose(rest, wanted, [], order_by(rest, "_mix"), "_dev")
    rest = rest.withColumn("split", F.when(F.col("_dev"), "dev").otherwise("test"))
    train = rows.filter("picked").withColumn("split", F.lit("train"))
    return train.unionByName(rest.select(train.columns))


def percent_split(rows: DataFrame, percent: float = 5, row_id: str = "row_id") -> DataFrame:
    """The first ``percent`` of the rows by position are validation, the rest train.

    ``row_id`` must be a consecutive position counted from zero (see ``with_row_id``).
    """
    cut = int(row_count(rows) * percent / 100 + 0.5)
    return rows.withColumn("split", F.when(F.col(row_id) < cut, "validation").otherwise("train"))


def sort_outputs(rows: DataFrame, key: str = "key") -> DataFrame:
    """``order_in_split``: train from its least likely row on, the others from their most likely."""
    train = rank_rows(rows.filter(F.col("split") == "train"), key_order(key, reverse=True), name="order_in_split")
    other = rank_rows(rows.filter(F.col("split") != "train"), key_order(key), ["split"], "order_in_split")
    return train.unionByName(other)


def split_report(rows: DataFrame, label: str) -> DataFrame:
    """Size, mean score and mean length of every split and class."""
    return rows.groupBy("split", label).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.round(F.avg("ll_score"), 6).alias("mean_ll"),
        F.round(F.avg("length"), 6).alias("mean_length"),
    )


def split_audit(rows: DataFrame, pool: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Rows in more than one split, and rows of the pool in none; all zero for a sound split."""
    per_row = rows.groupBy(row_id).agg(F.count(F.lit(1)).alias("n"))
    seen = pool.select(row_id).join(per_row, row_id, "full")
    inside = pool.select(row_id, F.lit(1).alias("in_pool"))
    checked = seen.join(inside, row_id, "left")
    return checked.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("n") > 1).alias("n_repeated"),
        F.count_if(F.col("n").isNull()).alias("n_missing"),
        F.count_if(F.col("in_pool").isNull()).alias("n_foreign"),
    )
