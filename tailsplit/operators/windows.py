"""Strided windows over token sequences, per row and over a whole corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tailsplit.functions.text import tokens
from tailsplit.operators import lm
from tailsplit.operators.ranking import rank_rows, running_total
from tailsplit.scratch import materialize

# The step between windows and the longest input of the default scorer.
STRIDE = 512
MAX_LEN = 1024


def window_bounds(start, n, stride: int, max_len: int) -> dict:
    """begin_loc, end_loc and n_scored of the window that scores from ``start`` on."""
    end = F.least(start + stride, n)
    return {"begin_loc": F.greatest(start + stride - max_len, F.lit(0)), "end_loc": end, "n_scored": end - start}


def token_windows(df: DataFrame, text: str = "text", row_id: str = "row_id", stride: int = STRIDE,
                  max_len: int = MAX_LEN) -> DataFrame:
    """(row_id, window_start, begin_loc, end_loc, n_scored): every token is scored in exactly one window."""
    sized = df.select(row_id, F.size(tokens(text)).cast("long").alias("_n")).filter("_n > 0")
    starts = sized.select(row_id, "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1,
                                                             F.lit(stride).cast("long"))).alias("window_start"))
    return starts.withColumns(window_bounds(F.col("window_start"), F.col("_n"), stride, max_len)).drop("_n")


def token_occurrences(df: DataFrame, text: str = "text", row_id: str = "row_id") -> DataFrame:
    """(row_id, pos, ctx, token) of every token, the first one without context."""
    toks = df.select(row_id, tokens(text).alias("_toks"))
    both = lm.with_context(F.col("_toks"), F.lit(None).cast("string"))
    return toks.select(row_id, F.posexplode(both).alias("pos", "_o")).select(
        row_id, F.col("pos").cast("long").alias("pos"), "_o.ctx", "_o.token")


def score_tokens(df: DataFrame, model: lm.Bigram, text: str = "text", row_id: str = "row_id") -> DataFrame:
    """(row_id, pos, token, ll): the log-likelihood of every single token given the one before it."""
    scored = lm.with_bigram_lp(token_occurrences(df, text, row_id), model, [row_id, "pos"])
    return scored.select(row_id, "pos", "token", lm.micro(F.col("lp")).alias("ll"))


def score_strided(df: DataFrame, model: lm.Bigram, text: str = "text", row_id: str = "row_id",
                  stride: int = STRIDE, max_len: int = MAX_LEN) -> DataFrame:
    """(row_id, n_windows, n_tokens, ll_score, ppl_score) as a sum over strided windows.

    A token at the very start of its window has no context.
    """
    start = F.col("pos") - F.col("pos") % F.lit(stride)
    begin = F.greatest(start + stride - max_len, F.lit(0))
    occ = token_occurrences(df, text, row_id).withColumn("window_start", start)
    occ = occ.withColumn("ctx", F.when(F.col("pos") > begin, F.col("ctx"))).drop("pos")
    scored = lm.with_bigram_lp(occ, model, [row_id, "window_start"])
    per_window = scored.groupBy(row_id, "window_start").agg(F.count("lp").alias("n"), F.sum("lp").alias("s"))
    totals = per_window.groupBy(row_id).agg(F.count(F.lit(1)).alias("n_windows"), F.sum("n").alias("n_tokens"),
                                            F.sum("s").alias("s"))
    return totals.select(row_id, "n_windows", "n_tokens", lm.micro(F.col("s")).alias("ll_score"),
                         F.round(F.exp(-(F.col("s") / F.lit(lm.NANO)) / F.col("n_tokens")), 6).alias("ppl_score"))


def corpus_windows(df: DataFrame, model: lm.Unigram, text: str = "text", row_id: str = "row_id",
                   stride: int = STRIDE, max_len: int = MAX_LEN) -> DataFrame:
    """(window_start, begin_loc, end_loc, n_scored, ll) over all rows read as one text in id order.

    The joined text never exists: each row gets the number of tokens before it from a running
    total over ranges, and its tokens their place from that.
    """
    counts = materialize(df.select(row_id, F.size(tokens(text)).cast("long").alias("_n")), "lengths")
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    offsets = running_total(counts, "_n", [F.col(row_id).asc()], name="_before").drop("_n")
    placed = df.select(row_id, F.col(text).alias("_text")).join(offsets, row_id)
    toks = placed.select("_before", F.posexplode(tokens("_text")).alias("_pos", "token"))
    place = F.col("_before") + F.col("_pos")
    # Frequent tokens are added up per window before the shuffle.
    occurrences = toks.select((place - place % F.lit(stride)).alias("window_start"), "token")
    per_window = lm.unigram_sums(occurrences, model, ["window_start"]).drop("n_tokens")
    bounds = window_bounds(F.col("window_start"), F.lit(total), stride, max_len)
    return per_window.withColumns(bounds).withColumn("ll", lm.micro(F.col("s"))).drop("s")


def batch_groups(rows: DataFrame, sizes: dict[str, str], batch: int, row_id: str = "row_id") -> DataFrame:
    """(row_id, batch_id, one width per entry of ``sizes`` {width: size column}).

    Groups of ``batch`` rows in id order, with the longest size in each. Pass a narrow table.
    """
    ranked = rank_rows(rows.select(row_id, *sizes.values()), [F.col(row_id).asc()], name="_r")
    grouped = ranked.withColumn("batch_id", F.floor((F.col("_r") - 1) / batch).cast("long"))
    # A batch holds at most ``batch`` rows, and so does the window.
    group = Window.partitionBy("batch_id")
    return grouped.select(row_id, "batch_id", *[F.max(size).over(group).alias(width) for width, size in sizes.items()])
