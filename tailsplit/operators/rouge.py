"""Overlap scores of generated texts over a corpus: stems, sentences, and resampled bounds.

Texts are cut into sentences of tokens; on request every distinct token of the corpus is stemmed once and
the stems are looked up. Pairs are scored in Arrow batches. The corpus figure comes with bounds from a
Poisson bootstrap: each row adds itself to 1,000 running sums with weights drawn from a hash of its id, so
that one pass with partial aggregation gives all resampled means, whatever the partitioning.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from math import exp, factorial, isqrt

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailsplit.functions.stem import stem
from tailsplit.functions.text import tokens
from tailsplit.operators.joins import lookup
from tailsplit.scratch import materialize

METRICS = ("rouge1", "rouge2", "rougeL", "rougeLsum")
SAMPLES = 1000
SEED = 42
# Weights come from the sixteen bits of four hexadecimal digits, eight of them from one md5.
DIGITS, PER_HASH, STEPS = 4, 8, 1 << 16
# A weight is the number of these steps that a draw reaches: the cumulative Poisson distribution of mean 1.
WEIGHT_STEPS = [round(STEPS * sum(exp(-1) / factorial(i) for i in range(k + 1))) for k in range(8)]
# A sentence ends at a line break, or at the white space after a full stop, a question or an exclamation mark.
SENTENCE_END = r"\n+|(?<=[.!?])\s+"
MICRO = 1e6


# --- sentences of stems ------------------------------------------------------------------

def sentences(df: DataFrame, pred: str, ref: str, row_id: str = "row_id", stemmed: bool = False) -> DataFrame:
    """(row_id, p, r): both sides as lists of sentences, each a list of tokens or of their stems.

    A missing side has no sentences. Stems are worked out on the distinct tokens and looked up with their counts, so a common
    token stalls no task; the largest unit put together again is one text.
    """
    def parts(name: str) -> Column:
        cut = F.transform(F.split(F.col(name), SENTENCE_END), lambda s: tokens(s))
        return F.coalesce(F.filter(cut, lambda s: F.size(s) > 0), F.array().cast("array<array<string>>"))

    staged = df.select(row_id, parts(pred).alias("p"), parts(ref).alias("r"))
    if not stemmed:
        return staged
    words = staged.select(row_id, F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("parts"))
                                                     for s in ("p", "r")])).alias("s"))
    words = words.select(row_id, "s.side", F.posexplode("s.parts").alias("at", "tokens"))
    words = materialize(words.select(row_id, "side", "at", F.posexplode("tokens").alias("pos", "token")), "words")
    table = materialize(stem_table(words), "stems")
    found = lookup(words, table, ["token"], freq="n", spread_by=[row_id, "pos"])
    lists = found.groupBy(row_id, "side", "at").agg(F.array_sort(F.collect_list(F.struct("pos", "stem"))).alias("w"))
    lists = lists.select(row_id, "side", "at", F.col("w.stem").alias("w"))
    sides = lists.groupBy(row_id).agg(*[
        F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("at", "w")))).alias(s) for s in ("p", "r")])
    # Rows without any token are added again.
    empty = F.array().cast("array<array<string>>")
    return df.select(row_id).join(sides, row_id, "left").select(
        row_id, *[F.coalesce(F.col(f"{s}.w"), empty).alias(s) for s in ("p", "r")])


def stem_table(words: DataFrame) -> DataFrame:
    """(token, stem, n) of every distinct token, each stemmed once."""
    @F.pandas_udf("string")
    def stems(batch: pd.Series) -> pd.Series:
        return batch.map(stem)

    counts = words.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("token", stems("token").alias("stem"), "n")


# --- scores of a pair --------------------------------------------------------------------

def common_positions(a: Sequence[str], b: Sequence[str]) -> list[int]:
    """Ascending positions of ``a`` on one longest common subsequence with ``b``.

    One bit per token of ``a`` and row per token of ``b``; a zero bit is a step of the length. Of the
    rows only every n-th is kept, and those between are worked out again on the way back, so that
    memory grows with len(a) * sqrt(len(b)) bits.
    """
    masks: dict[str, int] = {}
    for i, t in enumerate(a):
        masks[t] = masks.get(t, 0) | (1 << i)
    full = (1 << len(a)) - 1

    def after(row: int, token: str) -> int:
        hit = row & masks.get(token, 0)
        return ((row + hit) | (row - hit)) & full

    step = isqrt(len(b)) + 1
    kept, row = [], full
    for j, t in enumerate(b):
        if j % step == 0:
            kept.append(row)
        row = after(row, t)

    out: list[int] = []
    i, j = len(a), len(b)
    block, rows = -1, []
    while i and j:
        if (j - 1) // step != block:
            block = (j - 1) // step
            rows = [kept[block]]
            for t in b[block * step:(block + 1) * step]:
                rows.append(after(rows[-1], t))
        here, above = rows[j - block * step], rows[j - 1 - block * step]
        bit = 1 << (i - 1)
        if here & bit:
            i -= 1
            continue
        j -= 1
        # The step at i was not there a token earlier: this token made it, by matching at i.
        if above & bit:
            i -= 1
            out.append(i)
    return out[::-1]


def union_hits(pred: Sequence[Sequence[str]], ref: Sequence[Sequence[str]]) -> int:
    """Tokens of the reference on a common subsequence with any predicted sentence, each occurrence used once."""
    free_p, free_r = Counter(t for s in pred for t in s), Counter(t for s in ref for t in s)
    hits = 0
    for sentence in ref:
        union = sorted({i for other in pred for i in common_positions(sentence, other)})
        for i in union:
            token = sentence[i]
            if free_p[token] > 0 and free_r[token] > 0:
                free_p[token] -= 1
                free_r[token] -= 1
                hits += 1
    return hits


def _f(hits: int, n: int, m: int) -> float:
    return 200.0 * hits / (n + m) if n + m else 0.0


def score_pair(pred: Sequence[Sequence[str]], ref: Sequence[Sequence[str]]) -> tuple[float, ...]:
    """The four F-measures of one pair, in percent."""
    p, r = [t for s in pred for t in s], [t for s in ref for t in s]
    pairs_p, pairs_r = Counter(zip(p, p[1:])), Counter(zip(r, r[1:]))
    one = sum((Counter(p) & Counter(r)).values())
    two = sum((pairs_p & pairs_r).values())
    return (_f(one, len(p), len(r)), _f(two, max(len(p) - 1, 0), max(len(r) - 1, 0)),
            _f(len(common_positions(p, r)), len(p), len(r)), _f(union_hits(pred, ref), len(p), len(r)))


def pair_scores(df: DataFrame, pred: str, ref: str, row_id: str = "row_id", stemmed: bool = False) -> DataFrame:
    """(row_id, rouge1, rouge2, rougeL, rougeLsum) of every pair, in percent with six decimals."""
    @F.pandas_udf("rouge1 double, rouge2 double, rougeL double, rougeLsum double")
    def scores(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ps, rs in batches:
            rows = [score_pair([list(s) for s in p], [list(s) for s in r]) for p, r in zip(ps, rs, strict=True)]
            yield pd.DataFrame(rows, columns=list(METRICS), dtype="float64")

    scored = sentences(df, pred, ref, row_id, stemmed).select(row_id, scores("p", "r").alias("s"))
    return scored.select(row_id, *[F.round(F.col(f"s.{m}"), 6).alias(m) for m in METRICS])


# --- the corpus figure -------------------------------------------------------------------

def draws(row_id: str, seed: int, samples: int) -> Column:
    """array<(sample, w)>: the Poisson weight of a row in every sample."""
    def of_hash(block: Column) -> Column:
        digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row_id).cast("string"), block.cast("string")))
        return F.transform(F.sequence(F.lit(0), F.lit(PER_HASH - 1)), lambda j: F.struct(
            (block * PER_HASH + j).alias("sample"),
            F.conv(F.substr(digest, j * DIGITS + 1, F.lit(DIGITS)), 16, 10).cast("int").alias("draw")))

    blocks = F.sequence(F.lit(0), F.lit((samples - 1) // PER_HASH))
    return F.filter(F.flatten(F.transform(blocks, of_hash)), lambda d: d["sample"] < samples)


def bootstrap(scores: DataFrame, metrics: Sequence[str], row_id: str = "row_id", samples: int = SAMPLES,
              seed: int = SEED) -> DataFrame:
    """(metric, mean, low, mid, high): the mean of each score and the 2.5th, 50th and 97.5th percentile of resampled means.

    Scores enter as whole millionths and weights are whole, so no sum depends on the order of the rows.
    A sample that drew no row is left out; a null score counts in no mean. An empty table gives nulls.
    """
    drawn = F.col("_d.draw")
    weight = sum((F.when(drawn >= s, 1).otherwise(0) for s in WEIGHT_STEPS[1:]), F.when(drawn >= WEIGHT_STEPS[0], 1).otherwise(0))
    units = scores.select(row_id, *[F.round(F.col(m) * MICRO).cast("long").alias(m) for m in metrics])
    rows = units.select(*metrics, F.explode(draws(row_id, seed, samples)).alias("_d")).select(
        *metrics, F.col("_d.sample").alias("sample"), weight.cast("long").alias("w")).filter("w > 0")
    sums = rows.groupBy("sample").agg(*[part for m in metrics for part in (
        F.sum(F.col(m) * F.col("w")).alias(f"{m}_s"), F.sum(F.when(F.col(m).isNotNull(), F.col("w"))).alias(f"{m}_w"))])
    means = [F.try_divide(F.col(f"{m}_s"), F.col(f"{m}_w")) / F.lit(MICRO) for m in metrics]
    cuts = F.array(*[F.lit(q) for q in (0.025, 0.5, 0.975)])
    bounds = sums.select(*[mean.alias(m) for m, mean in zip(metrics, means, strict=True)]).agg(
        *[F.percentile(m, cuts).alias(m) for m in metrics])
    plain = units.agg(*[(F.avg(m) / F.lit(MICRO)).alias(f"{m}_mean") for m in metrics])
    one = bounds.crossJoin(F.broadcast(plain))  # one row on either side
    out = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_mean").alias("mean"), F.col(m).alias("b"))
                              for m in metrics])).alias("o")
    return one.select(out).select("o.metric", F.round("o.mean", 4).alias("mean"), *[
        F.round(F.col("o.b")[i], 4).alias(n) for i, n in enumerate(("low", "mid", "high"))])


def corpus_rouge(df: DataFrame, pred: str, ref: str, row_id: str = "row_id", stemmed: bool = True,
                 samples: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """(metric, mean, low, mid, high) of the four overlap scores of a prediction table."""
    scores = materialize(pair_scores(df, pred, ref, row_id, stemmed), "pair_scores")
    return bootstrap(scores, METRICS, row_id, samples, seed)
