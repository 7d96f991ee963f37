"""Row filters and their report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailsplit.functions.text import strip

# Fixed values of the raw files.
NO_LABEL = "-"
PLACEHOLDER = "Cannot see picture to describe."
NOT_AVAILABLE = "n/a"


def label_given(label: str) -> Column:
    """False only for rows whose annotators did not agree; a null label is kept for the splits to report."""
    return F.coalesce(F.col(label).cast("string") != F.lit(NO_LABEL), F.lit(True))


def not_placeholder(text: str, placeholder: str = PLACEHOLDER) -> Column:
    return F.coalesce(F.col(text) != F.lit(placeholder), F.lit(True))


def not_na(text: str) -> Column:
    return F.coalesce(F.lower(text) != F.lit(NOT_AVAILABLE), F.lit(True))


def nonblank(line: str) -> Column:
    """A line with something other than white space on it."""
    return F.length(strip(line)) > 0


def clean_report(df: DataFrame, keep: Column, split: str = "split") -> DataFrame:
    """Base, dropped and retained rows per split, in one aggregation."""
    return df.groupBy(split).agg(
        F.count(F.lit(1)).alias("base_rows"),
        F.count_if(~keep).alias("dropped_rows"),
        F.count_if(keep).alias("retained_rows"),
    )
