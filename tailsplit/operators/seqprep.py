"""Vocabularies, encoding and padded batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailsplit.functions import arrays
from tailsplit.functions.text import tokens
from tailsplit.operators.joins import lookup
from tailsplit.operators.ranking import rank_rows
from tailsplit.operators.windows import batch_groups
from tailsplit.scratch import materialize

# Ids below the vocabulary.
PAD = 0
UNKNOWN = 1
FIRST = 2


def vocabulary(counts: DataFrame) -> DataFrame:
    """(token, n, id): ids by falling frequency, then by token, from FIRST on."""
    ranked = rank_rows(counts, [F.col("n").desc(), F.col("token").asc()], name="_r")
    return materialize(ranked.select("token", "n", (F.col("_r") + (FIRST - 1)).cast("int").alias("id")), "vocabulary")


def encode(df: DataFrame, vocab: DataFrame, columns: dict[str, str], row_id: str = "row_id") -> DataFrame:
    """(row_id, one id array per entry of ``columns`` {output: text column}).

    Only the tokens of one row are ever put together.
    """
    sides = F.array(*[F.struct(F.lit(out).alias("out"), tokens(text).alias("toks"))
                      for out, text in columns.items()])
    toks = df.select(row_id, F.explode(sides).alias("s")).select(
        row_id, "s.out", F.posexplode_outer("s.toks").alias("pos", "token"))
    known = lookup(toks, vocab, ["token"], freq="n", spread_by=[row_id, "pos"], reread=True)
    entry = F.struct("pos", F.coalesce("id", F.lit(UNKNOWN)).alias("id"))
    used = F.col("token").isNotNull()
    packed = known.groupBy(row_id).agg(*[
        F.sort_array(F.collect_list(F.when(used & (F.col("out") == out), entry))).alias(out) for out in columns])
    return packed.select(row_id, *[F.col(out)["id"].alias(out) for out in columns])


def pad_batches(encoded: DataFrame, ids: str, labels: str, batch: int, multiple: int | None = 8,
                row_id: str = "row_id") -> DataFrame:
    """Batches padded to their longest row: inputs on the left, labels on the right, with both masks."""
    encoded = materialize(encoded, "encoded")
    sized = encoded.select(row_id, F.size(ids).alias("_n"), F.size(labels).alias("_m"))
    grouped = encoded.join(batch_groups(sized, {"_w": "_n", "_v": "_m"}, batch, row_id), row_id)
    width, label_width = arrays.round_up(F.col("_w"), multiple), arrays.round_up(F.col("_v"), multiple)
    return grouped.select(
        row_id, "batch_id",
        arrays.pad_to(F.col(ids), width, PAD, "left").alias("input_ids"),
        arrays.attention(F.col(ids), width, "left").alias("attention_mask"),
        arrays.pad_to(F.col(labels), label_width, arrays.IGNORE).alias("labels"),
        arrays.attention(F.col(labels), label_width).alias("labels_attention_mask"))
