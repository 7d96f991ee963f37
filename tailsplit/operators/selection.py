"""The first k rows of every group without ranking the group: distributed selection.

A cut needs only the k-th row of its group, the border. Counts of a coarse measure of the order,
combined before their shuffle, tell the range that holds it; that range is counted again, finer,
until few rows are left, and only these are sorted. A row is then compared with the border of its
group, so that neither texts nor ids are joined back and no group is ever sorted whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailsplit.operators.joins import lookup
from tailsplit.operators.ranking import rank_rows
from tailsplit.scratch import materialize

# Ranges a group is counted by in one pass, and the rows of one range that are sorted at last.
BINS = 1024
BORDER_ROWS = 4096
# A pass cuts the open range by up to BINS; heavy tails need some passes more.
ROUNDS = 8
LARGEST = 1.7e308


@dataclass(frozen=True)
class Order:
    """Ascending ``parts``, unique as a whole, and a number that never falls along them."""

    parts: tuple[Column, ...]
    measure: Column

    @property
    def place(self) -> Column:
        return F.struct(*self.parts)


def order_by(rows: DataFrame, key: str = "key", row_id: str = "row_id") -> Order:
    """By ``key``, missing ones last, ties by id: the order of ``ranking.key_order``."""
    missing = F.col(key).isNull()
    parts = (missing.alias("missing"), F.col(key).alias("key"), F.col(row_id).alias("id"))
    if dict(rows.dtypes)[key] == "string":
        # The first bytes as a number; strings are ordered by their bytes.
        digits = F.rpad(F.hex(F.substring(F.encode(F.col(key), "utf-8"), 1, 6)), 12, "0")
        number = F.conv(digits, 16, 10).cast("double")
    else:
        number = F.col(key).cast("double")
        number = F.when(F.isnan(number), F.lit(LARGEST)).otherwise(
            F.greatest(F.least(number, F.lit(LARGEST)), F.lit(-LARGEST)))
    return Order(parts, F.when(missing, F.lit(LARGEST)).otherwise(number))


def _halved(low: str, high: str) -> Column:
    # Halves first: the difference of two large numbers must not overflow.
    return F.col(high) / F.lit(2.0) - F.col(low) / F.lit(2.0)


def _narrowed(rows: DataFrame, state: DataFrame, by: list[str]) -> DataFrame:
    """One pass: the range of each group that holds its border, with the rows left to skip in it."""
    inside = lookup(rows, state, by, freq="_n", spread_by=["_o"]).filter(F.col("_m").between(F.col("_low"), F.col("_high")))
    width = _halved("_low", "_high")
    share = F.when(width > 0, _halved("_low", "_m") / width).otherwise(F.lit(0.0))
    bin_of = F.least(F.floor(share * F.lit(float(BINS))), F.lit(BINS - 1)).cast("int")
    counts = inside.groupBy(*by, "_k", bin_of.alias("_bin")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_low"), F.max("_m").alias("_high"))
    # At most BINS rows of a group meet in this window.
    upto = Window.partitionBy(*by).orderBy("_bin")
    counts = counts.withColumn("_upto", F.sum("_n").over(upto))
    before = F.col("_upto") - F.col("_n")
    return counts.filter((before < F.col("_k")) & (F.col("_k") <= F.col("_upto"))).select(
        *by, "_n", (F.col("_k") - before).alias("_k"), "_low", "_high")


def _open_rows(state: DataFrame) -> tuple[int, int]:
    """Rows of the fullest range, and of the fullest one that can be cut further."""
    full, wide = state.agg(F.max("_n"), F.max(F.when(F.col("_low") < F.col("_high"), F.col("_n")))).first()
    return full or 0, wide or 0


def borders(rows: DataFrame, state: DataFrame, by: list[str], border_rows: int | None = None) -> DataFrame:
    """(by, _border): the ``_k``-th place ``_o`` of every group of ``state`` (by, _n, _k), by rows (by, _o, _m)."""
    border_rows = BORDER_ROWS if border_rows is None else border_rows
    # Groups without a cut inside are out; the others are read with a measured table.
    full = state.agg(F.max("_n")).first()[0] or 0
    state = state.withColumns({"_low": F.lit(-LARGEST), "_high": F.lit(LARGEST)})
    if full > border_rows:
        known = rows.groupBy(*by).agg(F.min("_m").alias("_low"), F.max("_m").alias("_high"))
        state = materialize(state.drop("_low", "_high").join(known, by), "ranges")
        full, wide = _open_rows(state)
        for _ in range(ROUNDS):
            if wide <= border_rows:
                break
            state = materialize(_narrowed(rows, state, by), "ranges")
            full, wide = _open_rows(state)
    left = lookup(rows, state, by, freq="_n", spread_by=["_o"]).filter(F.col("_m").between(F.col("_low"), F.col("_high")))
    left = left.select(*by, "_o", "_k")
    if full <= border_rows:
        ranked = left.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("_o")))
    else:
        # Many rows share one measure: they are ranked by range.
        ranked = rank_rows(left, [F.col("_o").asc()], by, "_r")
    return ranked.filter(F.col("_r") == F.col("_k")).select(*by, F.col("_o").alias("_border"))


def choose(rows: DataFrame, wanted: DataFrame, by: Sequence[str], order: Order, name: str = "chosen",
           among: Column | None = None, border_rows: int | None = None) -> DataFrame:
    """Add ``name``: is the row one of the first ``k`` of its group in ``order``?

    ``wanted`` (by, n, k) holds the size of every group, of its rows ``among`` if that is given, and
    the number wanted. False for groups that ``wanted`` lacks; without meaning for rows not among.
    ``rows`` is read several times: pass a written table with what the cut needs.
    """
    by, columns = list(by), rows.columns
    if not by:
        by, rows, wanted = ["_g"], rows.withColumn("_g", F.lit(0)), wanted.withColumn("_g", F.lit(0))
    state = materialize(wanted.select(*by, F.col("n").alias("_n"), F.col("k").alias("_k")), "wanted")
    cut = state.filter((F.col("_k") > 0) & (F.col("_k") < F.col("_n")))
    cut.observed_size = state.observed_size
    narrow = (rows if among is None else rows.filter(among)).select(
        *by, order.place.alias("_o"), order.measure.alias("_m"))
    table = materialize(state.join(borders(narrow, cut, by, border_rows), by, "left"), "borders")
    first = F.when(F.col("_k") <= 0, F.lit(False)).when(F.col("_k") >= F.col("_n"), F.lit(True)).otherwise(
        order.place <= F.col("_border"))
    return lookup(rows, table, by, freq="_n", spread_by=columns).select(
        *columns, F.coalesce(first, F.lit(False)).alias(name))
