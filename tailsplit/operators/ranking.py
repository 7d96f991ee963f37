"""Ranks and running totals over whole tables without a single-task window.

Rows are range-partitioned by (group, order), sorted inside each partition and written once
with the position they got. Every (group, partition) run then needs one offset, the number of
rows of its group in earlier partitions. A group holding most of the table is spread over as
many partitions as its share asks for, because the range keys end in a unique id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailsplit.operators.joins import fits_broadcast, same
from tailsplit.scratch import materialize

# Partition number and row number as laid out by monotonically_increasing_id.
ROW_BITS = 33
# Above this k Spark plans no group limit before the shuffle of a top-k window.
GROUP_LIMIT = 1000


def _place(df: DataFrame, order: Sequence[Column], by: Sequence[str]) -> DataFrame:
    keys = [F.col(c).asc_nulls_first() for c in by] + list(order)
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = placed.withColumn("_at", F.monotonically_increasing_id())
    return materialize(placed, "placed").withColumn("_part", F.shiftright("_at", ROW_BITS))


def _earlier(by: Sequence[str]):
    # One row per (group, partition): its size is bounded by the partition count per group.
    return (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)


def _attach(placed: DataFrame, runs: DataFrame, by: Sequence[str]) -> DataFrame:
    # Without groups there is one run per partition; with groups the runs are written and measured.
    small = True
    if by:
        runs = materialize(runs, "runs")
        small = fits_broadcast(runs)
    right = runs
    for c in [*by, "_part"]:
        right = right.withColumnRenamed(c, f"_r_{c}")
    right = F.broadcast(right) if small else right
    cond = placed["_part"] == right["_r__part"]
    for c in by:
        cond = cond & same(placed[c], right[f"_r_{c}"])
    return placed.join(right, cond, "inner").drop(*[f"_r_{c}" for c in [*by, "_part"]])


def rank_rows(df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Add ``name``: 1-based position of each row inside its group ``by``, in ``order``.

    ``order`` must end in a column that is unique inside the group; the result then depends on
    the data only, not on how it was partitioned.
    """
    by = list(by)
    placed = _place(df, order, by)
    runs = placed.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    runs = runs.select(*by, "_part", (F.coalesce(F.sum("_n").over(_earlier(by)), F.lit(0))
                                      - F.col("_first") + 1).alias("_shift"))
    ranked = _attach(placed, runs, by)
    return ranked.select(*df.columns, (F.col("_at") + F.col("_shift")).alias(name))


def running_total(df: DataFrame, value: str, order: Sequence[Column], by: Sequence[str] = (),
                  name: str = "offset") -> DataFrame:
    """Add ``name``: sum of ``value`` over the rows of the group that come before this one."""
    by = list(by)
    placed = _place(df, order, by)
    runs = placed.groupBy(*by, "_part").agg(F.sum(value).alias("_n"))
    runs = runs.select(*by, "_part", F.coalesce(F.sum("_n").over(_earlier(by)), F.lit(0)).alias("_base"))
    # Inside one range partition a window is safe: it holds one partition's rows.
    inside = Window.partitionBy(*by, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    attached = _attach(placed, runs, by)
    return attached.select(*df.columns,
                           (F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0))).alias(name))


def first_in_group(df: DataFrame, order: Sequence[Column], by: Sequence[str], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of every group, with their rank.

    For small ``k`` the window below is cut to ``k`` rows per group and task before the shuffle
    (Spark's window group limit); for large ``k`` rows are ranked by range.
    """
    if k <= GROUP_LIMIT:
        window = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
        ranked = df.withColumn(name, F.row_number().over(window.orderBy(*order)).cast("long"))
    else:
        ranked = rank_rows(df, order, by, name)
    return ranked.filter(F.col(name) <= F.lit(k))


def with_row_id(df: DataFrame, order: Sequence[Column] = (), name: str = "row_id") -> DataFrame:
    """Consecutive ids from zero, assigned once at ingest.

    Without ``order``, file order is kept: file path, then the block inside the file, then the
    row inside the block. ``order`` must name a unique key when it is given.
    """
    if order:
        return rank_rows(df, order, name=name).withColumn(name, F.col(name) - 1)
    columns = df.columns
    staged = df.select(*columns, F.col("_metadata.file_path").alias("_file"),
                       F.col("_metadata.file_block_start").alias("_block"),
                       F.monotonically_increasing_id().alias("_row"))
    # The position is frozen before the sort: it would change if the scan were planned twice.
    staged = materialize(staged, "ingest")
    ranked = rank_rows(staged, [F.col("_file"), F.col("_block"), F.col("_row")], name=name)
    return ranked.select((F.col(name) - 1).alias(name), *columns)


def seeded_order(seed: int, row_id: str = "row_id") -> Column:
    """Pseudo-random sort key that depends on the seed and the id only."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row_id).cast("string")))


def likelihood_key(score: str, kind: str) -> Column:
    """A key that is ascending from most to least likely; NaN counts as missing and sorts last."""
    clean = F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double"))
    if kind == "ll":
        clean = -clean
    elif kind != "ppl":
        raise ValueError(f"unknown score kind {kind!r}")
    return F.round(clean, 6)


def key_order(key: str = "key", row_id: str = "row_id", reverse: bool = False) -> list[Column]:
    """Most likely first, missing scores last, ties by id; or exactly the reverse."""
    if reverse:
        return [F.col(key).desc_nulls_first(), F.col(row_id).desc()]
    return [F.col(key).asc_nulls_last(), F.col(row_id).asc()]
