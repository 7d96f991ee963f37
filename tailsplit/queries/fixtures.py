"""Inputs of the registered queries, as DataFrames and as the same CTEs in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tailsplit.operators.joins import TURNS, next_turn_pairs
from tailsplit.sources.readers import spread

SEED = 42


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    """The unlabelled pool."""
    return spread(table(spark, sf, "documents"), "doc_id").withColumnRenamed("doc_id", "row_id")


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """The labelled pool; class = quality."""
    return docs(spark, sf).join(table(spark, sf, "labels").withColumnRenamed("doc_id", "row_id"), "row_id")


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """(row_id, prefix, target, label) of consecutive turns."""
    return next_turn_pairs(table(spark, sf, "conversations"))


def sql_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in the text-to-SQL shape, whole texts."""
    query, parse = sql_shape()
    return docs(spark, sf).select("row_id", query.alias("query"), parse.alias("parse"))


def sql_shape() -> tuple[Column, Column]:
    return (F.concat(F.col("source"), F.lit(": "), F.col("text"), F.lit(" | "), F.col("lang")),
            F.concat(F.lit("select text from "), F.col("lang"), F.lit(" where "), F.col("text")))


# --- the same in SQL ---------------------------------------------------------------------

D = "d AS (SELECT doc_id AS row_id, text, lang, source, n_chars FROM documents)"
DL = ("dl AS (SELECT doc_id AS row_id, text, lang, source, n_chars, quality, toxic "
      "FROM documents JOIN labels USING (doc_id))")
CV = (f"cv AS (SELECT a.conv_id*{TURNS}+a.turn AS row_id, a.conv_id, a.turn, a.text AS prefix, b.text AS target, "
      "b.role AS label FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)")
SQLROWS = ("sqlrows AS (SELECT doc_id AS row_id, source || ': ' || text || ' | ' || lang AS query, "
           "'select text from ' || lang || ' where ' || text AS parse FROM documents)")


def tok(col: str) -> str:
    return rf"regexp_extract_all(lower({col}), '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}\s]')"


def words(col: str) -> str:
    return rf"regexp_extract_all(lower({col}), '[\p{{L}}\p{{N}}]+')"


def unigram(src: str, text: str = "text") -> str:
    """CTEs tok(row_id, token), uni(token, n), tot(nn, vv), lps(token, lp)."""
    return f"""
    tok AS (SELECT row_id, unnest({tok(text)}) AS token FROM {src}),
    uni AS (SELECT token, count(*) AS n FROM tok GROUP BY token),
    tot AS (SELECT sum(n)::DOUBLE AS nn, count(*)::DOUBLE AS vv FROM uni),
    lps AS (SELECT token, round(ln((n + 1.0) / (nn + vv)) * 1e9)::BIGINT AS lp FROM uni, tot)"""


def bigram(src: str, text: str = "text") -> str:
    """CTEs of ``unigram`` and big(ctx, token, n_pair), ctxs(ctx, n_ctx)."""
    return unigram(src, text) + f""",
    seqs AS (SELECT {tok(text)} AS t FROM {src}),
    steps AS (SELECT unnest(t[1:len(t)-1]) AS ctx, unnest(t[2:len(t)]) AS token FROM seqs WHERE len(t) > 1),
    big AS (SELECT ctx, token, count(*) AS n_pair FROM steps GROUP BY ctx, token),
    ctxs AS (SELECT ctx, sum(n_pair)::BIGINT AS n_ctx FROM big GROUP BY ctx)"""


P1 = "((coalesce(uni.n, 0) + 1.0) / (tot.nn + tot.vv))"
P2 = (f"(CASE WHEN ctxs.n_ctx IS NULL THEN {P1} ELSE 0.7 * (coalesce(big.n_pair, 0) / ctxs.n_ctx::DOUBLE) "
      f"+ (1 - 0.7::DOUBLE) * {P1} END)")


def bigram_lp(occ: str, extra: str) -> str:
    """CTE occ_lp(extra…, token, lp) from an occurrence CTE with ctx and token."""
    return f"""
    occ_lp AS (SELECT {extra}, occ.token, CASE WHEN occ.token IS NOT NULL THEN round(ln({P2}) * 1e9)::BIGINT END AS lp
      FROM {occ} AS occ CROSS JOIN tot LEFT JOIN uni ON uni.token = occ.token LEFT JOIN ctxs ON ctxs.ctx = occ.ctx
      LEFT JOIN big ON big.ctx = occ.ctx AND big.token = occ.token)"""


def row_scores(src: str, lp_rows: str) -> str:
    """CTE scores(row_id, n_tokens, ll_score, ppl_score)."""
    return f"""
    sums AS (SELECT s.row_id, count(o.lp) AS n_tokens, coalesce(sum(o.lp), 0)::BIGINT AS s
             FROM {src} s LEFT JOIN {lp_rows} o USING (row_id) GROUP BY s.row_id),
    scores AS (SELECT row_id, n_tokens, round(s / 1000.0::DOUBLE) / 1e6 AS ll_score,
               CASE WHEN n_tokens > 0 THEN round(exp(-(s / 1e9::DOUBLE) / n_tokens), 6) END AS ppl_score FROM sums)"""


def text_scores(src: str, text: str = "text") -> str:
    """Unigram CTEs down to ``scores``."""
    return unigram(src, text) + """,
    occ_lp AS (SELECT tok.row_id, lps.lp FROM tok JOIN lps USING (token)),""" + row_scores(src, "occ_lp")


def with_(*ctes: str) -> str:
    return "WITH " + ", ".join(c.strip() for c in ctes) + " "
