"""Count-based language models, fitted and applied as joins and aggregations.

Log-probabilities are summed in whole billionths. Integer sums do not depend on the order of
the rows, so a score is the same for every partitioning and ties between equal texts hold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailsplit.functions.text import split_last_word, tokens
from tailsplit.operators import joins
from tailsplit.operators.joins import lookup
from tailsplit.operators.ranking import first_in_group
from tailsplit.scratch import materialize

NANO = 1e9
# Weights of the models: add-k smoothing and the share of the pair estimate.
ADD_K = 1.0
PAIR_WEIGHT = 0.7
# Stands for a missing context in the table of log-probabilities; no token is empty.
NO_CONTEXT = ""
# The most frequent pairs that are broadcast, at most.
HEAD_PAIRS = 400_000


@dataclass(frozen=True)
class Unigram:
    """Token counts (token, n) with their totals."""

    counts: DataFrame
    total: int
    vocabulary: int
    add_k: float = ADD_K

    @property
    def denominator(self) -> float:
        return self.total + self.add_k * self.vocabulary

    def probability(self, n: Column) -> Column:
        return (F.coalesce(n, F.lit(0)) + F.lit(self.add_k)) / F.lit(self.denominator)


@dataclass(frozen=True)
class Bigram:
    """Pair counts (ctx, token, n_pair) and context totals (ctx, n_ctx) on top of a unigram model."""

    unigram: Unigram
    pairs: DataFrame
    contexts: DataFrame
    weight: float = PAIR_WEIGHT

    def probability(self, n: Column, n_pair: Column, n_ctx: Column) -> Column:
        """Interpolated; a context never seen leaves the unigram estimate alone."""
        base = self.unigram.probability(n)
        pair = F.coalesce(n_pair, F.lit(0)) / n_ctx
        return F.when(n_ctx.isNull(), base).otherwise(F.lit(self.weight) * pair + F.lit(1 - self.weight) * base)

    def scored(self, pairs: DataFrame) -> DataFrame:
        """(_c, token, lp): the log-probability of pairs seen, worked out once per pair."""
        both = lookup(pairs, self.unigram.counts, ["token"], freq="n", reread=True)
        both = lookup(both, self.contexts, ["ctx"], freq="n_ctx", reread=True)
        p = self.probability(F.col("n"), F.col("n_pair"), F.col("n_ctx"))
        return both.select(F.col("ctx").alias("_c"), "token", nano_log(p).alias("lp"))

    def scored_parts(self) -> tuple[DataFrame, DataFrame]:
        """The most frequent of the pairs and of the tokens without context, and all others, as (_c, token, lp)."""
        alone = unigram_table(self.unigram)
        hot_pair = joins.head_of(self.pairs, "n_pair", HEAD_PAIRS)
        hot_token = joins.head_of(self.unigram.counts, "n")
        return tuple(self.scored(self.pairs.filter(pair)).unionByName(
            alone.filter(token).select(F.lit(NO_CONTEXT).alias("_c"), "token", "lp"))
            for pair, token in ((hot_pair, hot_token), (~hot_pair, ~hot_token)))


def fit_unigram(df: DataFrame, text: str = "text", add_k: float = ADD_K) -> Unigram:
    """Token counts of a whole corpus; the counts are combined before the shuffle."""
    return _unigram(df.select(F.explode(tokens(text)).alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("n")), add_k)


def _unigram(counts: DataFrame, add_k: float) -> Unigram:
    counts = materialize(counts, "unigram")
    total, size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    return Unigram(counts, total, size, add_k)


def fit_bigram(df: DataFrame, text: str = "text", add_k: float = ADD_K, weight: float = PAIR_WEIGHT) -> Bigram:
    """Neighbouring-pair counts, and from them the context and the unigram counts.

    The texts are read once: every token is counted with the token before it, the first one of
    a row with a null context, so that the pair counts of a token add up to its own count.
    """
    # Counted as one string, which takes less of the shuffle than two: no token holds a space.
    pairs = df.select(F.explode(with_context(tokens(text), F.lit(""))).alias("o"))
    counted = pairs.select(F.concat("o.ctx", F.lit(" "), "o.token").alias("key")).groupBy("key").agg(
        F.count(F.lit(1)).alias("n_pair")).sortWithinPartitions("key").select(
        F.nullif(F.substring_index("key", " ", 1), F.lit("")).alias("ctx"),
        F.substring_index("key", " ", -1).alias("token"), "n_pair")
    # Neighbours with the same context take less room, in the file and wherever the pairs are exchanged.
    counted = materialize(counted, "pairs")
    unigram = _unigram(counted.groupBy("token").agg(F.sum("n_pair").alias("n")), add_k)
    pairs = counted.filter(F.col("ctx").isNotNull())
    pairs.observed_size = counted.observed_size
    contexts = materialize(pairs.groupBy("ctx").agg(F.sum("n_pair").alias("n_ctx")), "contexts")
    return Bigram(unigram, pairs, contexts, weight)


def nano_log(p: Column) -> Column:
    """ln(p) in whole billionths."""
    return F.round(F.log(p) * F.lit(NANO)).cast("long")


def micro(s: Column) -> Column:
    """A sum of billionths as a number with six decimals; the rounding is done on whole units."""
    return F.round(s / F.lit(1000.0)) / F.lit(1e6)


def unigram_table(model: Unigram) -> DataFrame:
    """(token, n, lp): counts with their log-probability in billionths."""
    return model.counts.withColumn("lp", nano_log(model.probability(F.col("n"))))


def with_unigram_lp(occurrences: DataFrame, model: Unigram, spread_by: list[str]) -> DataFrame:
    """Add ``lp`` to (…, token) rows."""
    unseen = nano_log(model.probability(F.lit(0)))
    joined = lookup(occurrences, unigram_table(model), ["token"], freq="n", spread_by=spread_by,
                    measured=model.counts, reread=True).drop("n")
    return joined.withColumn("lp", F.when(F.col("token").isNotNull(), F.coalesce("lp", unseen)))


def with_bigram_lp(occurrences: DataFrame, model: Bigram, spread_by: list[str]) -> DataFrame:
    """Add ``lp`` to (…, ctx, token) rows; a null ``ctx`` means no context.

    Counts of tokens and contexts that can be broadcast are, and only the pair is looked up. Of larger ones the
    log-probability is worked out once per pair, and only occurrences of pairs that are not among the most frequent
    are exchanged, once; pairs the model never saw go on to the counts, in a shuffle of their own. Occurrences
    that were written and are fewer than the pairs meet the counts themselves.
    """
    def counted(rows: DataFrame, reread: bool = False) -> DataFrame:
        rows = lookup(rows, model.unigram.counts, ["token"], freq="n", spread_by=spread_by, reread=reread)
        return lookup(rows, model.contexts, ["ctx"], freq="n_ctx", spread_by=spread_by, reread=reread)

    def lp_of(n_pair: Column) -> Column:
        p = model.probability(F.col("n"), n_pair, F.col("n_ctx"))
        return F.when(F.col("token").isNotNull(), nano_log(p))

    columns = occurrences.columns
    written = getattr(occurrences, "observed_size", None)
    few = written is not None and written[0] <= joins.size_of(model.pairs)[0]
    if few or (joins.fits_broadcast(model.unigram.counts) and joins.fits_broadcast(model.contexts)):
        out = lookup(counted(occurrences, reread=True), model.pairs, ["ctx", "token"], freq="n_pair", spread_by=spread_by,
                     reread=not few)
        return out.select(*columns, lp_of(F.col("n_pair")).alias("lp"))
    # The context goes as a part of the key and is taken from it again.
    plain = [F.nullif("_c", F.lit(NO_CONTEXT)).alias("ctx") if c == "ctx" else F.col(c) for c in columns]
    keyed = occurrences.withColumn("_c", F.coalesce("ctx", F.lit(NO_CONTEXT))).drop("ctx")
    head, tail = model.scored_parts()
    settled, rest = joins.settled_and_open(keyed, head, ["_c", "token"])
    tail = tail.select(*[F.col(c).alias(f"_tail{c}") for c in ("_c", "token")], "lp")
    out = rest.join(tail, joins.alike(["_c", "token"], ["_tail_c", "_tailtoken"]), "left").select(*plain, "lp")
    # No token is null here. Saying so keeps the join an outer one on both sides of the union, so that it is exchanged once.
    seen = out.filter(F.col("lp").isNotNull() | F.col("token").isNull())
    unseen = counted(out.filter(F.col("lp").isNull()).drop("lp")).select(*columns, lp_of(F.lit(0)).alias("lp"))
    return settled.select(*plain, "lp").unionByName(seen).unionByName(unseen)


def row_scores(scored: DataFrame, row_id: str = "row_id", keep: Sequence[str] = ()) -> DataFrame:
    """(row_id, keep…, n_tokens, ll_score, ppl_score) from scored occurrences."""
    return _scores(scored.groupBy(row_id, *keep).agg(
        F.count("lp").alias("n_tokens"), F.coalesce(F.sum("lp"), F.lit(0)).alias("s")), row_id, keep)


def _scores(sums: DataFrame, row_id: str, keep: Sequence[str]) -> DataFrame:
    """Scores from sums of billionths; an empty text has likelihood 0 and no perplexity."""
    return sums.select(row_id, *keep, "n_tokens", micro(F.col("s")).alias("ll_score"),
                       F.round(F.exp(-F.try_divide(F.col("s") / F.lit(NANO), F.col("n_tokens"))), 6).alias("ppl_score"))


def score_text(df: DataFrame, model: Unigram, text: str = "text", row_id: str = "row_id",
               keep: Sequence[str] = ()) -> DataFrame:
    """Unconditional log-likelihood and perplexity per row, with the narrow columns ``keep``.

    A vocabulary that can be broadcast folds all tokens of a row into one partial sum before the
    shuffle. Of a larger one the frequent tokens still do, and only the rare ones are shuffled,
    once per row and token, to meet their counts.
    """
    occurrences = df.select(row_id, *keep, F.explode_outer(tokens(text)).alias("token"))
    return _scores(unigram_sums(occurrences, model, [row_id, *keep]), row_id, keep)


def unigram_sums(occurrences: DataFrame, model: Unigram, by: Sequence[str]) -> DataFrame:
    """(by…, n_tokens, s): tokens of every group and the sum of their log-probabilities, from (by…, token) rows."""
    if joins.fits_broadcast(model.counts):
        return with_unigram_lp(occurrences, model, list(by)).groupBy(*by).agg(
            F.count("lp").alias("n_tokens"), F.coalesce(F.sum("lp"), F.lit(0)).alias("s"))

    table, unseen = unigram_table(model), nano_log(model.probability(F.lit(0)))
    frequent = joins.head_of(model.counts, "n")
    head = table.filter(frequent).select("token", "lp")
    rare = F.when(F.col("lp").isNull(), F.col("token")).alias("token")
    folded = occurrences.join(F.broadcast(head), "token", "left").groupBy(*by, rare).agg(
        F.count(occurrences["token"]).alias("m"), F.sum("lp").alias("known"))
    # The folded rows, one per group, have no token left and get a key of their own.
    salt = F.pmod(F.xxhash64(*by), F.lit(joins.SPREAD)).cast("int") + 1
    folded = folded.withColumn("_slot", F.when(F.col("token").isNull(), salt).otherwise(F.lit(0)))
    tail = table.filter(~frequent).select("token", "lp", F.lit(0).alias("_slot"))
    part = F.when(F.col("token").isNull(), F.coalesce("known", F.lit(0))).otherwise(
        F.col("m") * F.coalesce("lp", unseen))
    return folded.join(tail, ["token", "_slot"], "left").withColumn("part", part).groupBy(*by).agg(
        F.sum("m").alias("n_tokens"), F.sum("part").alias("s"))


def with_context(toks: Column, before: Column) -> Column:
    """array<(ctx, token)>: every token with the one before it, ``before`` standing ahead of the first."""
    shifted = F.slice(F.concat(F.array(before), toks), F.lit(1), F.size(toks))
    return F.arrays_zip(shifted.alias("ctx"), toks.alias("token"))


def conditional_occurrences(df: DataFrame, prefix: str, target: str, keep: list[str]) -> DataFrame:
    """(keep…, pos, ctx, token) for the tokens of ``target``; the first context is the last prefix token."""
    staged = df.select(*keep, F.try_element_at(tokens(prefix), F.lit(-1)).alias("_last"),
                       tokens(target).alias("_toks"))
    return staged.select(*keep, F.posexplode_outer(with_context(F.col("_toks"), F.col("_last"))).alias("pos", "_o")
                         ).select(*keep, "pos", "_o.ctx", "_o.token")


def score_conditional(df: DataFrame, model: Bigram, prefix: str = "prefix", target: str = "target",
                      row_id: str = "row_id", keep: Sequence[str] = ()) -> DataFrame:
    """Likelihood of ``target`` given ``prefix``, with the narrow columns ``keep``; prefix tokens are context only."""
    occurrences = conditional_occurrences(df, prefix, target, [row_id, *keep])
    return row_scores(with_bigram_lp(occurrences, model, [row_id, "pos"]), row_id, keep)


def score_last_word(df: DataFrame, model: Bigram, text: str = "text", row_id: str = "row_id") -> DataFrame:
    """(row_id, pos, token, ctx, ll, ll_score, ppl_score): the final word given all before it.

    One row per token of the last word; join ``ctx`` to ``top_next_tokens`` for the alternatives.
    """
    context, last = split_last_word(text)
    staged = df.select(row_id, context.alias("_prefix"), last.alias("_target"))
    occ = materialize(conditional_occurrences(staged, "_prefix", "_target", [row_id]), "last_tokens")
    scored = materialize(with_bigram_lp(occ, model, [row_id]), "last_word")
    return scored.join(row_scores(scored, row_id).drop("n_tokens"), row_id).select(
        row_id, F.col("pos").cast("long").alias("pos"), "token", "ctx", micro(F.col("lp")).alias("ll"),
        "ll_score", "ppl_score")


def last_word_rows(df: DataFrame, model: Bigram, text: str = "text", row_id: str = "row_id", k: int = 10) -> DataFrame:
    """(row_id, pos, token, ll, token_rank, alternatives): one row per token of the last word, for a prediction log.

    ``alternatives`` are the ``k`` most probable tokens at that place, the best one last; ``token_rank`` tells which of them
    the token is, 1 for the best, null if it is none. A text without tokens in its last word has no row. Followers are
    ranked for the contexts asked only; after a context never seen, or none, the most frequent tokens stand.
    """
    context, last = split_last_word(text)
    staged = df.select(row_id, context.alias("_prefix"), last.alias("_target"))
    occ = conditional_occurrences(staged, "_prefix", "_target", [row_id]).filter(F.col("token").isNotNull())
    occ = materialize(occ, "last_tokens")
    scored = materialize(with_bigram_lp(occ, model, [row_id, "pos"]), "last_word")
    asked = materialize(scored.filter(F.col("ctx").isNotNull()).groupBy("ctx").agg(F.count(F.lit(1)).alias("_n")), "asked")
    # At most k rows a context.
    listed = top_next_tokens(model, asked.select("ctx"), k).groupBy("ctx").agg(F.sort_array(
        F.collect_list(F.struct((-F.col("next_rank")).alias("r"), "token")))["token"].alias("alternatives"))
    listed = materialize(listed.join(asked, "ctx"), "alternatives")
    frequent = [r["token"] for r in reversed(_most_frequent(model.unigram, k))]
    always = F.array(*[F.lit(t) for t in frequent]).cast("array<string>")
    known = lookup(scored, listed, ["ctx"], freq="_n", spread_by=[row_id, "pos"]).withColumn(
        "alternatives", F.coalesce("alternatives", always))
    at = F.array_position("alternatives", F.col("token"))
    return known.select(row_id, F.col("pos").cast("long").alias("pos"), "token", micro(F.col("lp")).alias("ll"),
                        F.when(at > 0, F.size("alternatives") - at + 1).alias("token_rank"), "alternatives")


def score_summary(scores: DataFrame) -> DataFrame:
    """Mean, median, largest, smallest and spread of both scores, one row per score.

    The exact median runs on an ordered rank, not on a per-group buffer.
    """
    from tailsplit.operators.metrics import exact_median

    long = [scores.select(F.col(c).alias("value")).filter(F.col("value").isNotNull()) for c in
            ("ll_score", "ppl_score")]
    out = None
    for name, values in zip(("ll_score", "ppl_score"), long, strict=True):
        row = values.agg(F.lit(name).alias("score"), F.round(F.avg("value"), 6).alias("mean_value"),
                         F.max("value").alias("max_value"), F.min("value").alias("min_value"),
                         F.round(F.stddev_pop("value"), 6).alias("std_value"))
        row = row.withColumn("median_value", F.round(F.lit(exact_median(values, "value")).cast("double"), 6))
        out = row if out is None else out.unionByName(row)
    return out


def corpus_perplexity(scored: DataFrame, times: str | None = None) -> DataFrame:
    """Perplexity of a whole corpus from its scored tokens; infinite where exp overflows.

    ``times`` names the column that tells how often a token occurs, where they were counted.
    The sum has 38 digits, since billionths of many tokens outgrow a long.
    """
    if times is None:
        n_tokens, part = F.count("lp"), F.col("lp").cast("decimal(38,0)")
    else:
        n_tokens = F.coalesce(F.sum(F.when(F.col("lp").isNotNull(), F.col(times))), F.lit(0))
        part = F.col("lp").cast("decimal(19,0)") * F.col(times).cast("decimal(18,0)")
    total = F.sum(part.cast("decimal(38,0)")).cast("double")
    return scored.agg(n_tokens.alias("n_tokens"), total.alias("s")).select(
        "n_tokens",
        F.round(F.col("s") / F.lit(NANO) / F.col("n_tokens"), 6).alias("mean_ll"),
        F.round(safe_exp(-F.col("s") / F.lit(NANO) / F.col("n_tokens")), 6).alias("ppl"))


def safe_exp(x: Column) -> Column:
    """exp with overflow to infinity."""
    return F.when(x > 709, F.lit(float("inf"))).otherwise(F.exp(F.least(x, F.lit(709.0))))


def _most_frequent(model: Unigram, k: int) -> list:
    """The ``k`` most frequent tokens as rows, ties in the order of the tokens."""
    return model.counts.orderBy(F.col("n").desc(), F.col("token")).limit(k).collect()


def top_next_tokens(model: Bigram, contexts: DataFrame | None = None, k: int = 10) -> DataFrame:
    """(ctx, next_rank, token, p): the ``k`` most probable next tokens of every context.

    Candidates are the followers seen after the context and the ``k`` most frequent tokens of
    all. That is enough: a token never seen after the context is ranked by its own frequency,
    so one outside the top ``k`` is beaten by ``k`` others. The window keeps only ``k`` rows
    per context and task before its shuffle.
    """
    known, pairs = model.contexts.select("ctx"), model.pairs
    if contexts is not None:
        known = materialize(known.join(contexts, "ctx", "left_semi"), "contexts")
        pairs = pairs.join(known, "ctx", "left_semi")
    frequent = _most_frequent(model.unigram, k)
    every = F.explode(F.array(*[F.struct(F.lit(r["token"]).alias("token"), F.lit(0).cast("long").alias("n_pair"))
                                for r in frequent]))
    guesses = known.select("ctx", every.alias("_c")).select("ctx", "_c.token", "_c.n_pair")
    candidates = pairs.select("ctx", "token", "n_pair").unionByName(guesses).groupBy("ctx", "token").agg(
        F.max("n_pair").alias("n_pair"))
    scored = lookup(candidates, model.unigram.counts, ["token"], freq="n", spread_by=["ctx"])
    scored = lookup(scored, model.contexts, ["ctx"], freq="n_ctx", spread_by=["token"])
    p = model.probability(F.col("n"), F.col("n_pair"), F.col("n_ctx"))
    scored = scored.select("ctx", "token", F.round(p, 9).alias("p"))
    return first_in_group(scored, [F.col("p").desc(), F.col("token").asc()], ["ctx"], k, "next_rank")


def score_external(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], tuple]], columns: list[str],
                   row_id: str = "row_id", batch_rows: int | None = None) -> DataFrame:
    """Scores of a user's own model, run on Arrow batches where the rows are.

    ``load`` is called once per task and returns ``f(frame) -> (ll, n_tokens)``, two sequences
    aligned with the frame. ``batch_rows`` cuts larger Arrow batches into model batches.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = load()
        for frame in frames:
            step = batch_rows or max(len(frame), 1)
            for start in range(0, len(frame), step):
                part = frame.iloc[start:start + step]
                ll, n = score(part[columns])
                yield pd.DataFrame({row_id: part[row_id].to_numpy(), "n_tokens": list(n), "ll": list(ll)})

    kind = dict(df.dtypes)[row_id]
    raw = df.select(row_id, *columns).mapInPandas(run, f"{row_id} {kind}, n_tokens long, ll double")
    return raw.select(row_id, "n_tokens", F.round("ll", 6).alias("ll_score"),
                      F.round(F.exp(-F.try_divide(F.col("ll"), F.col("n_tokens").cast("double"))), 6).alias("ppl_score"))
