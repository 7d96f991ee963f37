"""Comparison of two result tables, and of bags of units."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sides(pred: DataFrame, gold: DataFrame, columns: Sequence[str]) -> DataFrame:
    return pred.select(*columns, F.lit("pred").alias("side")).unionByName(
        gold.select(*columns, F.lit("gold").alias("side")))


def bag_counts(pred: DataFrame, gold: DataFrame, by: Sequence[str], key: Sequence[str]) -> DataFrame:
    """(by, key, p, g): how often each key occurs on each side, in one aggregation and without a join."""
    return _sides(pred, gold, [*by, *key]).groupBy(*by, *key).agg(
        F.count_if(F.col("side") == "pred").alias("p"), F.count_if(F.col("side") == "gold").alias("g"))


def multiset_match(pred: DataFrame, gold: DataFrame, by: Sequence[str], key: Sequence[str]) -> DataFrame:
    """(by, label_total, pred_total, cnt): multiset intersection of both sides' keys."""
    return bag_counts(pred, gold, by, key).groupBy(*by).agg(
        F.sum("g").alias("label_total"), F.sum("p").alias("pred_total"), F.sum(F.least("p", "g")).alias("cnt"))


def result_set_match(pred: DataFrame, gold: DataFrame, columns: Sequence[str], by: Sequence[str] = (),
                     position: str | None = None) -> DataFrame:
    """(by, same_result): whether two results hold the same rows, as bags, or in order with ``position``.

    With ``by``, many pairs of results are compared in one job.
    """
    key = [*columns, *([position] if position else [])]
    counts = bag_counts(pred, gold, by, key)
    same = F.coalesce(F.bool_and(F.col("p") == F.col("g")), F.lit(True)).alias("same_result")
    return counts.groupBy(*by).agg(same) if by else counts.agg(same)


def _hashes(names: Sequence[str], *keys: Column) -> list[Column]:
    """Two 64-bit hashes of the keys. Null and empty values differ."""
    parts = [part for key in keys for part in (key.isNull(), key)]
    return [F.xxhash64(F.lit(salt), *parts).alias(name) for salt, name in enumerate(names)]


def _halves(hashes: Sequence[str]) -> list[Column]:
    """Both halves of each hash. Their sums, as whole numbers, tell one bag of hashes from another.

    They merge in any order. Halves of 32 bits leave room for 2^31 rows; beyond that a sum fails and is never wrong.
    Two different bags agree with a chance of about 2^-128.
    """
    return [half for h in hashes for half in (F.shiftright(h, 32), F.col(h).bitwiseAND(F.lit(0xFFFFFFFF)))]


RUN_BITS = 16  # cells are first added up over runs of 2^16 rows of a result


def aligned_match(cells: DataFrame, columns: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, same_result): whether both results have the same output columns, each with the same values in the same order.

    ``columns`` (by, side, ordinal, name) has a row per output column, so that empty results have columns too; ``cells``
    (by, side, ordinal, pos, value) a row per value, ``pos`` being the number of the row in its result. Sides are "pred" and
    "gold". Columns are aligned by name, wherever they stand; of one name the last column counts. A result without
    columns, that of a failed query, is the same as none. Cells of a column that is not listed are ignored.

    Cells and names are exchanged once, as two hashes, and cells are added up where they arrive: adding them up before would
    hold nearly every cell where the rows of a result lie scattered. Runs of rows keep a long result from ending in one task.
    One more exchange brings the columns of a result together; all that follows stays in place. Groups and sums are
    numbers, so that Spark hashes them instead of sorting. Names listed for one place count as one of them.
    """
    by = list(by)
    place = [*by, "_sign", "ordinal"]
    sign = F.when(F.col("side") == "pred", 1).when(F.col("side") == "gold", -1).alias("_sign")
    run = F.shiftright(F.col("pos").cast("long"), RUN_BITS)
    both = cells.select(*by, sign, "ordinal", run.alias("_run"), F.lit(False).alias("_named"),
                        *_hashes(["_h0", "_h1"], F.col("pos"), F.col("value"))).unionByName(
        columns.filter(F.col("name").isNotNull()).select(
            *by, sign, "ordinal", F.lit(0).cast("long").alias("_run"), F.lit(True).alias("_named"),
            *_hashes(["_h0", "_h1"], F.col("name"))))
    sums = ["_s0", "_s1", "_s2", "_s3"]
    name, cell = (lambda h: F.when(F.col("_named"), h)), (lambda part: F.when(F.col("_named"), 0).otherwise(part))
    runs = both.repartition(*place, "_run").groupBy(*place, "_run").agg(
        F.max(name(F.col("_h0"))).alias("_n0"), F.max(name(F.col("_h1"))).alias("_n1"),
        *[F.sum(cell(half)).alias(s) for s, half in zip(sums, _halves(["_h0", "_h1"]), strict=True)])
    lists = (runs.repartition(*by) if by else runs).groupBy(*place).agg(
        F.max("_n0").alias("_n0"), F.max("_n1").alias("_n1"), *[F.sum(s).alias(s) for s in sums])
    last = lists.filter(F.col("_n0").isNotNull()).select(
        *place, "_n0", "_n1", *_hashes(["_l0", "_l1"], *[F.col(s) for s in sums])).groupBy(*by, "_sign", "_n0", "_n1").agg(
        *[F.max_by(h, "ordinal").alias(h) for h in ("_l0", "_l1")])
    signed = last.select(*by, "_sign", *_hashes(["_h0", "_h1"], *[F.col(c) for c in ("_n0", "_n1", "_l0", "_l1")]))
    apart = signed.groupBy(*by).agg(
        *[F.sum(F.col("_sign") * half).alias(s) for s, half in zip(sums, _halves(["_h0", "_h1"]), strict=True)])
    return apart.select(*by, reduce(lambda a, b: a & b, [F.col(s) == 0 for s in sums]).alias("same_result"))


def result_differences(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """The rows only one side has, repeats counted."""
    return pred.exceptAll(gold).withColumn("side", F.lit("pred")).unionByName(
        gold.exceptAll(pred).withColumn("side", F.lit("gold")))
