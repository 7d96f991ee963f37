"""Database catalogs as tables: (db_id, table_name, column_name, pos, col_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

META_SCHEMA = ("db_id string, table_names_original array<string>, "
               "column_names_original array<struct<table_idx: int, column_name: string>>, "
               "foreign_keys array<struct<col1: int, col2: int>>")
RAW_META_SCHEMA = ("db_id string, table_names_original array<string>, "
                   "column_names_original array<array<string>>, foreign_keys array<array<int>>")
ALL_COLUMNS = "__all__"


def read_meta(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """JSON arrays with one object per database: one array per file, or one per line.

    Only files with an array per line can be read by several tasks.
    """
    raw = spark.read.schema(RAW_META_SCHEMA).option("multiLine", multi_line).json(path)
    return raw.select(
        "db_id", "table_names_original",
        F.transform("column_names_original", lambda c: F.struct(
            c[0].cast("int").alias("table_idx"), c[1].alias("column_name"))).alias("column_names_original"),
        F.transform("foreign_keys", lambda k: F.struct(k[0].alias("col1"), k[1].alias("col2"))).alias("foreign_keys"))


def column_id(table: Column, column: Column) -> Column:
    """Lower-case ``__table.column__``; the column of no table is ``__all__``."""
    return F.when(table.isNull(), F.lit(ALL_COLUMNS)).otherwise(
        F.concat(F.lit("__"), F.lower(table), F.lit("."), F.lower(column), F.lit("__")))


def catalog_rows(meta: DataFrame) -> DataFrame:
    """One row per column, ``pos`` being its index in the metadata."""
    cols = meta.select("db_id", "table_names_original", F.posexplode("column_names_original").alias("pos", "c"))
    table = F.when(F.col("c.table_idx") >= 0, F.get("table_names_original", F.col("c.table_idx")))
    return cols.select("db_id", F.lower(table).alias("table_name"), F.lower("c.column_name").alias("column_name"),
                       F.col("pos").cast("long").alias("pos"), column_id(table, F.col("c.column_name")).alias("col_id"))


def foreign_keys(meta: DataFrame) -> DataFrame:
    """(db_id, col1, col2) column index pairs."""
    return meta.select("db_id", F.explode("foreign_keys").alias("k")).select("db_id", "k.col1", "k.col2")


def session_catalog(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Catalog rows of the tables and views a session knows; names only, no data is read."""
    rows = []
    for t in spark.catalog.listTables(database):
        for i, c in enumerate(spark.catalog.listColumns(t.name, None if t.isTemporary else database)):
            rows.append((t.name.lower(), c.name.lower(), i, f"__{t.name.lower()}.{c.name.lower()}__"))
    return spark.createDataFrame(rows, "table_name string, column_name string, pos long, col_id string")
