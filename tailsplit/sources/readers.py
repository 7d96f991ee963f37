"""Readers. Schemas are stated, never inferred; row ids are assigned once, after reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tailsplit.functions.text import strip
from tailsplit.operators.clean import nonblank

# File extensions and the readers they stand for.
FORMATS = {"csv": "csv", "tsv": "tsv", "json": "json", "jsonl": "json", "txt": "text", "parquet": "parquet"}
TEXT_TO_SQL = "query string, parse string"


def read_csv(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """Headered CSV with quoted fields; a row or field that does not fit the schema fails the read.

    A quoted line break forces one task per file; pass ``multi_line=False`` for files without
    any, which Spark then splits.
    """
    return (spark.read.schema(schema).option("header", True).option("multiLine", multi_line)
            .option("escape", '"').option("enforceSchema", False).option("mode", "FAILFAST").csv(path))


def read_tsv(spark: SparkSession, path: str, schema: str = TEXT_TO_SQL, multi_line: bool = True) -> DataFrame:
    """Headerless tab-separated file with the columns named by ``schema``; a row that does not fit it fails the read."""
    return (spark.read.schema(schema).option("sep", "\t").option("multiLine", multi_line)
            .option("escape", '"').option("mode", "FAILFAST").csv(path))


def exists(spark: SparkSession, path: str) -> bool:
    """True if a path (or glob) names something, on any file system the session knows."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    return found is not None and len(found) > 0


def read_query_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``name.tsv`` without header, or ``name.csv`` with one where there is no tsv."""
    tsv = f"{folder}/{name}.tsv"
    return read_tsv(spark, tsv) if exists(spark, tsv) else read_csv(spark, f"{folder}/{name}.csv", TEXT_TO_SQL)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; keys outside the schema are dropped, a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_lines(spark: SparkSession, path: str, columns: list[str], sep: str = "\t") -> DataFrame:
    """Non-blank lines cut at ``sep`` into ``columns``; missing fields are null."""
    line = F.split(strip("value"), sep)
    return (spark.read.text(path).filter(nonblank("value"))
            .select(*[F.get(line, F.lit(i)).alias(c) for i, c in enumerate(columns)]))


def read_corpus(spark: SparkSession, path: str, whole_files: bool = False, keep_breaks: bool = False) -> DataFrame:
    """Raw text: a row per line (optionally with its line break) or per file."""
    df = spark.read.text(path, wholetext=whole_files).withColumnRenamed("value", "text")
    if keep_breaks and not whole_files:
        df = df.withColumn("text", F.concat("text", F.lit("\n")))
    return df


def load(spark: SparkSession, files: dict[str, str], schema: str | None = None) -> DataFrame:
    """One table with a ``split`` column from a file per split; the extensions must agree."""
    kinds = {path.rstrip("/").rsplit(".", 1)[-1].lower() for path in files.values()}
    if len(kinds) != 1:
        raise ValueError(f"files of different types: {sorted(kinds)}")
    kind = FORMATS.get(kinds.pop())
    if kind is None:
        raise ValueError("unknown file type")
    if schema is None and kind not in ("text", "parquet"):
        raise ValueError("state the schema of a csv, tsv or json file")
    readers = {
        "csv": lambda p: read_csv(spark, p, schema), "tsv": lambda p: read_tsv(spark, p, schema),
        "json": lambda p: read_jsonl(spark, p, schema), "text": lambda p: read_corpus(spark, p),
        "parquet": lambda p: spark.read.parquet(p),
    }
    parts = [readers[kind](p).withColumn("split", F.lit(name)) for name, p in files.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give a scan with fewer splits than cores one partition per core.

    A large table already has more splits than cores and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


# Column contracts of the known text tasks: first text, second text, label.
TASK_COLUMNS = {
    "cola": ("sentence", None),
    "mnli": ("premise", "hypothesis"),
    "snli": ("premise", "hypothesis"),
    "snli-hypo": ("hypothesis", None),
    "mrpc": ("sentence1", "sentence2"),
    "qnli": ("question", "sentence"),
    "qqp": ("question1", "question2"),
    "rte": ("sentence1", "sentence2"),
    "sst2": ("sentence", None),
    "stsb": ("sentence1", "sentence2"),
    "wnli": ("sentence1", "sentence2"),
    "boolq": ("passage", "question"),
}


def sentence_columns(df: DataFrame, task: str | None = None, label: str = "label") -> tuple[str, str | None]:
    """The one or two text columns: by task, by the usual names, else the first that are no label."""
    if task is not None:
        return TASK_COLUMNS[task]
    other = [c for c in df.columns if c != label]
    if {"sentence1", "sentence2"} <= set(other):
        return "sentence1", "sentence2"
    return other[0], other[1] if len(other) > 1 else None


def text_column(df: DataFrame, preferred: str = "text") -> str:
    """The corpus text column."""
    return preferred if preferred in df.columns else df.columns[0]


def rename_prefixes(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Rename every column that starts with a given prefix, keeping the rest of its name."""
    names = names or {"sentence1": "premise", "sentence2": "hypothesis"}
    return df.withColumnsRenamed({c: new + c[len(old):] for c in df.columns for old, new in names.items()
                                  if c.startswith(old)})


def alias_label(df: DataFrame, gold: str = "gold_label", label: str = "label", rename: bool = False) -> DataFrame:
    """Copy (or rename) the gold label to ``label`` where there is no such column."""
    if label in df.columns or gold not in df.columns:
        return df
    return df.withColumnRenamed(gold, label) if rename else df.withColumn(label, F.col(gold))


def tag_origin(df: DataFrame, split: str, row_id: str = "row_id") -> DataFrame:
    """Add ``split`` and the string id ``split_i``."""
    return df.withColumns({"split": F.lit(split), "origin_id": origin_id(F.lit(split), F.col(row_id))})


def origin_id(split: Column, row_id: Column) -> Column:
    return F.concat(split, F.lit("_"), row_id.cast("string"))
