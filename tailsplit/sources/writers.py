"""Writers. Every task writes its own files; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter
from pyspark.sql import functions as F


def delimited(writer: DataFrameWriter, sep: str = ",", header: bool = False) -> DataFrameWriter:
    """Every field quoted and kept with its white space; a missing value becomes an empty field."""
    return (writer.option("sep", sep).option("header", header).option("escape", '"').option("quoteAll", True)
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))


def write_scores(scores: DataFrame, path: str) -> None:
    """Scores keyed by ``row_id``."""
    scores.write.mode("overwrite").parquet(path)


def write_split_csv(rows: DataFrame, path: str, split: str = "split") -> None:
    """A folder per split with headered CSV files."""
    delimited(rows.write.mode("overwrite").partitionBy(split), header=True).csv(path)


def write_split_tsv(rows: DataFrame, path: str, columns: tuple[str, ...] = ("query", "parse"),
                    split: str = "split") -> None:
    """A folder per split with headerless tab-separated files."""
    delimited(rows.select(*columns, split).write.mode("overwrite").partitionBy(split), sep="\t").csv(path)


def write_manifest(rows: DataFrame, path: str, split: str = "split", row_id: str = "row_id") -> None:
    """(split, row_id) as JSON lines, a folder per split."""
    rows.select(split, row_id).write.mode("overwrite").partitionBy(split).json(path)


def prediction_lines(rows: DataFrame, prediction: str, regression: bool = False, row_id: str = "row_id") -> DataFrame:
    """(index, prediction) as printed: three decimals for a regression, the label otherwise."""
    shown = F.printf(F.lit("%.3f"), F.col(prediction)) if regression else F.col(prediction).cast("string")
    return rows.select(F.col(row_id).alias("index"), shown.alias("prediction"))


def write_predictions(rows: DataFrame, path: str, prediction: str, regression: bool = False,
                      row_id: str = "row_id") -> None:
    """Tab-separated ``index, prediction`` with a header."""
    (prediction_lines(rows, prediction, regression, row_id).write.mode("overwrite")
     .option("sep", "\t").option("header", True).option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))


def write_generated(rows: DataFrame, path: str, prediction: str) -> None:
    """One prediction per line; line breaks inside a prediction become spaces."""
    rows.select(F.regexp_replace(prediction, r"[\r\n]+", " ").alias("value")).write.mode("overwrite").text(path)


def write_json_rows(rows: DataFrame, path: str) -> None:
    """One JSON object per row."""
    rows.write.mode("overwrite").json(path)
