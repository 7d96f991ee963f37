"""Metrics of prediction tables, each a one-row DataFrame or a long (metric, value) table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailsplit.functions.text import tokens, white_split


def exact_median(df: DataFrame, value: str) -> float | None:
    """Exact median of any numeric column: the middle ranks of a range-partitioned order.

    Equal values are counted first, so that a value repeated in most rows is one entry.
    """
    from tailsplit.operators.ranking import running_total

    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    placed = running_total(counts, "_n", [F.col(value).asc()], name="_before")
    total = placed.agg(F.sum("_n")).first()[0]
    if not total:
        return None
    low, high = (total - 1) // 2, total // 2

    def holds(i: int) -> Column:
        return (F.col("_before") <= i) & (F.lit(i) < F.col("_before") + F.col("_n"))

    at = placed.agg(F.max(F.when(holds(low), F.col(value))), F.max(F.when(holds(high), F.col(value)))).first()
    return (at[0] + at[1]) / 2


def accuracy_of(pred: str, label: str) -> Column:
    """Share of the labelled rows whose prediction is right; a missing prediction is wrong."""
    right = F.coalesce(F.col(pred) == F.col(label), F.lit(False))
    return F.round(F.avg(F.when(F.col(label).isNotNull(), right.cast("double"))), 6)


def squared_error_of(pred: str, label: str) -> Column:
    """Mean squared error of the labelled rows; null if one of them has no prediction, so that a gap earns nothing."""
    missing = F.count_if(F.col(label).isNotNull() & F.col(pred).isNull())
    return F.when(missing == 0, F.round(F.avg(F.pow(F.col(pred) - F.col(label), 2)), 6))


def sequence_accuracy_of(pred: str, ref: str) -> Column:
    """Share of the rows with a reference whose white-space separated tokens are the same; a missing prediction is wrong."""
    same = F.coalesce(white_split(pred) == white_split(ref), F.lit(False))
    return F.round(F.avg(F.when(F.col(ref).isNotNull(), same.cast("double"))), 6)


def generated_length_of(ids: str, pad: int) -> Column:
    """Mean number of ids that are not padding, over the rows that have any; a missing row has no length."""
    return F.round(F.avg(F.size(F.filter(F.col(ids), lambda i: i != F.lit(pad)))), 6)


def missing_share_of(pred: str, label: str) -> Column:
    """Share of the labelled rows without a prediction."""
    return F.round(F.avg(F.when(F.col(label).isNotNull(), F.col(pred).isNull().cast("double"))), 6)


def metrics_table(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """(metric, value) of many metrics from one pass over ``df``: their states merge in one aggregate."""
    return long_metrics(df.agg(*[value.cast("double").alias(name) for name, value in metrics.items()]))


def accuracy(df: DataFrame, pred: str, label: str) -> DataFrame:
    return df.agg(accuracy_of(pred, label).alias("accuracy"))


def argmax(values: Column) -> Column:
    """Index, from zero, of the first largest element."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("long")


def mse(df: DataFrame, pred: str, label: str) -> DataFrame:
    return df.agg(squared_error_of(pred, label).alias("mse"))


def long_metrics(df: DataFrame) -> DataFrame:
    """A one-row metric table as (metric, value) rows."""
    return df.unpivot([], df.columns, "metric", "value")


def combined_score(metrics: DataFrame) -> DataFrame:
    """The metrics plus their mean, if there is more than one."""
    mean = metrics.agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return metrics.select("metric", "value").unionByName(
        mean.select(F.lit("combined_score").alias("metric"), "value"))


def merge_metrics(matched: DataFrame, mismatched: DataFrame, suffix: str = "_mm") -> DataFrame:
    """Both metric tables in one, the second under suffixed names."""
    return matched.unionByName(mismatched.withColumn("metric", F.concat("metric", F.lit(suffix))))


def round_metrics(metrics: DataFrame, digits: int = 4) -> DataFrame:
    return metrics.withColumn("value", F.round("value", digits))


def sequence_accuracy(df: DataFrame, pred: str, ref: str) -> DataFrame:
    return df.agg(sequence_accuracy_of(pred, ref).alias("seq_accuracy"))


def generated_length(df: DataFrame, ids: str, pad: int) -> DataFrame:
    return df.agg(generated_length_of(ids, pad).alias("gen_len"))


def _grams(toks: Column, n: int) -> Column:
    count = F.greatest(F.size(toks) - (n - 1), F.lit(0))
    parts = [F.slice(toks, F.lit(i + 1), count) for i in range(n)]
    return F.transform(F.arrays_zip(*[p.alias(f"g{i}") for i, p in enumerate(parts)]),
                       lambda g: F.concat_ws(" ", *[g[f"g{i}"] for i in range(n)]))


def rouge_n(df: DataFrame, pred: str, ref: str, n: int, row_id: str = "row_id") -> DataFrame:
    """(row_id, rouge): n-gram overlap F-measure of every pair, in percent.

    Both sides' n-grams are counted in one aggregation, so no join is needed.
    """
    sides = F.array(*[F.struct(F.lit(s).alias("side"), _grams(tokens(c), n).alias("grams"))
                      for s, c in (("p", pred), ("r", ref))])
    grams = df.select(row_id, F.explode(sides).alias("s")).select(
        row_id, "s.side", F.explode_outer("s.grams").alias("gram"))
    counted = grams.groupBy(row_id, "gram").agg(
        F.count_if((F.col("side") == "p") & F.col("gram").isNotNull()).alias("np"),
        F.count_if((F.col("side") == "r") & F.col("gram").isNotNull()).alias("nr"))
    per_row = counted.groupBy(row_id).agg(
        F.sum(F.least("np", "nr")).alias("m"), F.sum("np").alias("p"), F.sum("nr").alias("r"))
    f = F.coalesce(F.try_divide(F.lit(200.0) * F.col("m"), (F.col("p") + F.col("r")).cast("double")), F.lit(0.0))
    return per_row.select(row_id, F.round(f, 6).alias("rouge"))


def _common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, one bit per token of ``a``."""
    masks: dict[str, int] = {}
    for i, t in enumerate(a):
        masks[t] = masks.get(t, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for t in b:
        hit = row & masks.get(t, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def rouge_l(df: DataFrame, pred: str, ref: str, row_id: str = "row_id") -> DataFrame:
    """(row_id, rouge): longest-common-subsequence F-measure of every pair, in percent; a missing side has no tokens."""
    @F.pandas_udf("long")
    def common(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([_common_length(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="int64")

    staged = df.select(row_id, *[F.coalesce(tokens(c), F.array().cast("array<string>")).alias(n)
                                 for c, n in ((pred, "a"), (ref, "b"))])
    total = (F.size("a") + F.size("b")).cast("double")
    f = F.coalesce(F.try_divide(F.lit(200.0) * common("a", "b"), total), F.lit(0.0))
    return staged.select(row_id, F.round(f, 6).alias("rouge"))


def run_counts(rows: DataFrame, limits: dict[str, int | None], stage: str = "split") -> DataFrame:
    """(metric, value): rows used per stage, the smaller of its limit and its size."""
    limit: Column = F.lit(None).cast("long")
    for name, n in limits.items():
        if n is not None:
            limit = F.when(F.col(stage) == name, F.lit(n).cast("long")).otherwise(limit)
    counts = rows.groupBy(stage).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.concat(F.col(stage), F.lit("_samples")).alias("metric"), F.least("n", limit).alias("value"))
