"""The corpus pipeline: from all documents to packed sequences.

Each stage works on what the one before kept, written as Parquet and read again. A stage accepts documents with nulls
in any column, empty and very long texts, repeated rows, and extra columns, which it drops; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tailsplit.llm import langid, packing, simhash, substring, toxicity
from tailsplit.scratch import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOXIC = 0.7  # score from which a document goes


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of an identified language; those without a letter, or whose evidence favours no language, go."""
    return langid.identify(docs.select(COLUMNS)).where("accepted").select(COLUMNS)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity limit. The model learns from the labelled ones among them that are not held out."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, columns=COLUMNS).where(F.col("score") < TOXIC).select(COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id, of repeated ids one row.

    Of documents without an id one stays for each fingerprint that no group with an id has.
    """
    marked = docs.select(*COLUMNS, F.xxhash64("text", "lang", "source", "n_chars").alias("mark"),
                         F.col("doc_id").isNull().alias("no_id"),
                         F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"))
    found = simhash.near_duplicates(marked, words=4, bits=4, carry=["mark", "no_id", "id"])
    group = F.when(F.col("component_id").isNull(), F.col("fp"))
    first = found.groupBy("component_id", group.alias("fp")).agg(F.min(F.struct("no_id", "id", "mark")).alias("first"))
    stays = materialize(first.select("first.*"), "stays")
    kept = marked.join(stays, ["no_id", "id", "mark"], "left_semi")
    copy = Window.partitionBy("no_id", "id", "mark").orderBy("mark")
    return kept.withColumn("copy", F.row_number().over(copy)).where("copy = 1").select(COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 20 words and more that also stand earlier."""
    found = substring.remove_repeats(docs, 20, carry=["lang", "source"])
    return found.select("doc_id", F.col("kept").alias("text"), "lang", "source",
                        F.char_length("kept").cast(docs.schema["n_chars"].dataType).alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024, 0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language),
    ("toxicity", not_toxic),
    ("near_duplicates", one_of_each_group),
    ("repeats", without_repeats),
    ("packing", packed),
]
ORACLE_SQL: str | None = None  # fingerprints, models and tokens are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table ``documents`` to packed pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
