"""Shards that all match the mixture of the sources: proportional stratified interleaving.

The rows of each source are put into a seeded random order and ranked. The rank divided by the size of the source is a
number between 0 and 1; sorted by it, the sources interleave in proportion, so that any stretch of the whole order holds
each of them in its share. Stretches of equal length are the shards. Only narrow rows travel; both ranks are taken over
ranges, so that a source with most of the rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailsplit.operators.joins import lookup
from tailsplit.operators.ranking import rank_rows, seeded_order
from tailsplit.scratch import materialize, row_count

LAW = "rows"  # the counts of any two shards are at most one apart


def shard(docs: DataFrame, shards: int = 16, seed: int = 42, by: str = "source", text: str = "text",
          key: str = "doc_id") -> DataFrame:
    """One row for each document: ``key``, ``size`` (UTF-8 bytes of the text and one), ``text_crc32``, ``law``, ``shard``
    (from 0), ``slot`` (its place there, without gaps from 0) and ``grown_shard`` (null: this law is not the law by key).

    The numbers of rows of two shards differ by at most one, and the share of a source in a shard from its share in the
    table by less than two rows. Sources interleave by (2 rank - 1) / (2 rows of the source); ties go by the seeded
    order, an md5 of seed and key. A null text counts as empty, a null source is a source of its own, a null key takes
    part like any other. Equal texts are placed apart from each other, each row by its own key; rows equal in key,
    source and text are placed once each and cannot be told apart. An empty table gives no rows. Other columns are
    ignored.
    """
    body = F.coalesce(docs[text], F.lit(""))
    rows = materialize(docs.select(
        docs[key].alias("k"), (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("s"), docs[by]), F.lit("none")).alias("stratum"),
        seeded_order(seed, f"`{key}`").alias("turn")), "narrow")
    last = [F.col(c).asc_nulls_first() for c in ("turn", "k", "text_crc32", "size")]
    ranked = rank_rows(rows, last, by=["stratum"], name="rank")
    totals = materialize(rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("total")), "totals")
    ranked = lookup(ranked, totals.withColumn("freq", F.col("total")), ["stratum"], freq="freq", spread_by=["turn", "rank"],
                    measured=totals)
    share = (2 * F.col("rank") - 1).cast("double") / (2 * F.col("total")).cast("double")
    placed = rank_rows(ranked.select("k", "size", "text_crc32", "stratum", "turn", share.alias("share")),
                       [F.col("share").asc(), *last, F.col("stratum").asc()], name="place")
    n = F.lit(max(row_count(rows), 1)).cast("long")
    number = F.expr(f"(place - 1) * {shards}L div n")
    before = F.expr(f"(number * n + {shards - 1}L) div {shards}L")  # rows in earlier shards
    return placed.withColumn("n", n).withColumn("number", number).select(
        F.col("k").alias(key), "size", "text_crc32", F.lit(LAW).alias("law"), F.col("number").cast("int").alias("shard"),
        (F.col("place") - 1 - before).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
