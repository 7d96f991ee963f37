"""Intermediate tables on shared storage.

A table written here cuts the lineage, survives the loss of an executor, freezes
partition-dependent values, and gives the planner a true size, so that Spark's own
broadcast threshold decides on evidence.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_local_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Folder for this application's tables, below ``spark.checkpoint.dir``.

    Where that setting is missing, a local-mode session gets a temporary folder; a cluster
    session is refused, because no machine-local folder is visible to every executor.
    """
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if shared:
        return f"{shared.rstrip('/')}/tailsplit/{context.applicationId}"
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.applicationId not in _local_roots:
        _local_roots[context.applicationId] = tempfile.mkdtemp(prefix="tailsplit-")
    return _local_roots[context.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    """A path nobody has used yet."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def row_width(df: DataFrame) -> Column:
    """Rough size of a row in bytes."""
    width = F.lit(0).cast("long")
    for name, kind in df.dtypes:
        if kind == "string":
            width = width + F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0))
        elif kind.startswith("array"):
            width = width + F.greatest(F.size(F.col(f"`{name}`")), F.lit(0)) * 16
        else:
            width = width + F.lit(16 if kind.startswith("struct") else 8)
    return width


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as parquet and return it read back with the same columns.

    Rows and bytes are observed while the table is written, so that asking for its size later
    costs no further job.
    """
    path = new_path(df.sparkSession, name)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row_width(df)), F.lit(0)).alias("bytes")
               ).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.observed_size = (seen.get["rows"], seen.get["bytes"])
    return out


def size_of(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes) of a table: as observed when it was written, else counted."""
    known = getattr(df, "observed_size", None)
    return known or tuple(df.agg(F.count(F.lit(1)), F.coalesce(F.sum(row_width(df)), F.lit(0))).first())


def row_count(df: DataFrame) -> int:
    known = getattr(df, "observed_size", None)
    return known[0] if known else df.count()
