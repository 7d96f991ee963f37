"""Queries of the scorers, of token windows and of atoms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tailsplit.functions.prompts import nli_prompt
from tailsplit.functions.text import leading_letters, token_length
from tailsplit.operators import atoms, joins, lm, ranking, windows
from tailsplit.operators.joins import join_scores, turn_id
from tailsplit.plans import splits
from tailsplit.queries.fixtures import (CV, D, SEED, bigram, bigram_lp, docs, pairs, row_scores, table, text_scores, tok,
                                        unigram, with_, words)
from tailsplit.queries.registry import query
from tailsplit.queries.splitting import (REST, SCORED_SQL, SIDED, base_sql, fixed_sql, four_fifths, halves_sql, labelled,
                                         pool, split_score, tenth)
from tailsplit.scratch import materialize, new_path
from tailsplit.sources.writers import write_json_rows, write_scores

TURNS = f"turns AS (SELECT conv_id*{joins.TURNS}+turn AS row_id, text FROM conversations)"


def turns(spark, sf):
    return table(spark, sf, "conversations").select(turn_id().alias("row_id"), "text")


# --- fitting and unconditional scores ----------------------------------------------------

@query("lm_unigram_fit", with_(D, unigram("d")) + "SELECT token, n FROM uni")
def lm_unigram_fit(spark, sf):
    return lm.fit_unigram(docs(spark, sf)).counts


@query("lm_bigram_fit", with_(D, bigram("d")) + "SELECT ctx, token, n_pair FROM big")
def lm_bigram_fit(spark, sf):
    return lm.fit_bigram(docs(spark, sf)).pairs


@query("score_text", with_(D, text_scores("d")) + "SELECT row_id, n_tokens, ll_score, ppl_score FROM scores")
def score_text(spark, sf):
    rows = docs(spark, sf)
    return lm.score_text(rows, lm.fit_unigram(rows))


@query("row_nll", with_(D, text_scores("d")) + "SELECT row_id, n_tokens, -ll_score AS nll, ppl_score FROM scores")
def row_nll(spark, sf):
    return score_text(spark, sf).select("row_id", "n_tokens", (-F.col("ll_score")).alias("nll"), "ppl_score")


@query("custom_ppl", base_sql("custom", "d") + "SELECT row_id, length, ppl_score FROM base")
def custom_ppl(spark, sf):
    return pool(spark, sf, "custom").select("row_id", "length", "ppl_score")


@query("token_length", with_(D) + f"SELECT row_id, len({tok('text')}) AS length FROM d")
def token_len(spark, sf):
    return docs(spark, sf).select("row_id", token_length("text").alias("length"))


SUMMARY = ", ".join(f"round({f}, 6) AS {n}_value" for f, n in (
    ("avg(v)", "mean"), ("median(v)", "median"), ("max(v)", "max"), ("min(v)", "min"), ("stddev_pop(v)", "std")))


@query("score_summary", with_(D, text_scores("d")) + f"""
       SELECT 'll_score' AS score, {SUMMARY} FROM (SELECT ll_score AS v FROM scores)
       UNION ALL SELECT 'ppl_score', {SUMMARY} FROM (SELECT ppl_score AS v FROM scores)""")
def score_summary(spark, sf):
    return lm.score_summary(materialize(score_text(spark, sf), "scores"))


@query("corpus_ppl", with_(D, text_scores("d")) + """
       SELECT count(*) AS n_tokens, round(sum(lp) / 1e9::DOUBLE / count(*), 6) AS mean_ll,
       round(exp(-sum(lp) / 1e9::DOUBLE / count(*)), 6) AS ppl FROM occ_lp""")
def corpus_ppl(spark, sf):
    rows = docs(spark, sf)
    model = lm.fit_unigram(rows)
    # Equal tokens have equal scores: counted before the shuffle, each is looked up once.
    occ = rows.select(F.explode(lm.tokens("text")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("times"))
    occ = materialize(occ, "counted")
    return lm.corpus_perplexity(lm.with_unigram_lp(occ, model, ["token"]), "times")


@query("join_scores", with_(D, text_scores("d")) +
       "SELECT row_id, source, lang, ll_score, ppl_score FROM d JOIN scores USING (row_id)")
def joined_scores(spark, sf):
    scores = materialize(score_text(spark, sf), "scores")
    return join_scores(docs(spark, sf).select("row_id", "source", "lang"), scores).drop("n_tokens")


@query("src_scores", with_(D, text_scores("d")) + "SELECT row_id, n_tokens, ll_score, ppl_score FROM scores")
def src_scores(spark, sf):
    path = new_path(spark, "scores")
    write_scores(score_text(spark, sf), path)
    return spark.read.schema("row_id long, n_tokens long, ll_score double, ppl_score double").parquet(path)


@query("sink_scores", with_(D, text_scores("d")) + "SELECT count(*) AS n_rows, sum(n_tokens)::BIGINT AS n_tokens FROM scores")
def sink_scores(spark, sf):
    return src_scores(spark, sf).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_tokens").alias("n_tokens"))


# --- conditional scores ------------------------------------------------------------------

def cond_occ(src: str, prefix: str, target: str) -> str:
    """CTE occ(row_id, pos, ctx, token): the last prefix token is the first context."""
    return f"""
    cseq AS (SELECT row_id, {tok(target)} AS t, {tok(prefix)}[-1] AS last FROM {src}),
    occ AS (SELECT row_id, unnest(range(len(t)))::BIGINT AS pos, unnest(list_concat([last], t)[1:len(t)]) AS ctx, unnest(t) AS token FROM cseq)"""


@query("score_conditional", with_(TURNS, CV, bigram("turns"), cond_occ("cv", "prefix", "target"),
                                  bigram_lp("occ", "occ.row_id"), row_scores("cv", "occ_lp")) +
       "SELECT row_id, n_tokens, ll_score, ppl_score FROM scores")
def score_conditional(spark, sf):
    return lm.score_conditional(pairs(spark, sf), lm.fit_bigram(turns(spark, sf)))


@query("split_score_conditional", with_(TURNS, CV, bigram("turns"), cond_occ("cv", "prefix", "target"),
                                        bigram_lp("occ", "occ.row_id"), row_scores("cv", "occ_lp"), """
       base AS (SELECT row_id, label, n_tokens AS length, ll_score, -ll_score AS key FROM cv JOIN scores USING (row_id))""")
       + SIDED + halves_sql(", ll_score") + "SELECT * FROM final")
def split_score_conditional(spark, sf):
    """Classes split by the likelihood of the second text given the first, with the length of the second."""
    scores = lm.score_conditional(pairs(spark, sf), lm.fit_bigram(turns(spark, sf)), keep=["label"])
    base = materialize(scores.withColumnRenamed("n_tokens", "length").drop("ppl_score").withColumn(
        "key", ranking.likelihood_key("ll_score", "ll")), "base")
    return splits.split_classes(base, "label", tenth(base), tenth(base), SEED).drop("key")


LABELLED_PREFIX = ("lab AS (SELECT row_id, 'Premise: ' || prefix || CASE label WHEN 'user' THEN ' This hypothesis is entailed:' "
                   "WHEN 'assistant' THEN ' This hypothesis is a contradiction:' ELSE ' This hypothesis is neutral:' END AS pre, "
                   "' ' || target AS tgt FROM cv)")
LABELLED_TEXT = "labtext AS (SELECT row_id, pre || tgt AS text FROM lab)"


def label_prompts(spark, sf):
    """Turn pairs with the role of the answer standing for the class."""
    rows = pairs(spark, sf)
    label = F.when(F.col("label") == "user", "entailment").when(F.col("label") == "assistant", "contradiction").otherwise(
        "neutral")
    pre, tgt = nli_prompt(F.col("prefix"), F.col("target"), label)
    return rows.select("row_id", "label", pre.alias("pre"), tgt.alias("tgt"))


@query("score_with_label", with_(CV, LABELLED_PREFIX, LABELLED_TEXT, bigram("labtext"), cond_occ("lab", "pre", "tgt"),
                                 bigram_lp("occ", "occ.row_id"), row_scores("lab", "occ_lp")) +
       "SELECT row_id, n_tokens, ll_score, ppl_score FROM scores")
def score_with_label(spark, sf):
    rows = label_prompts(spark, sf)
    model = lm.fit_bigram(rows.select(F.concat("pre", "tgt").alias("text")))
    return lm.score_conditional(rows, model, "pre", "tgt")


SPLIT_LAST = ("lw AS (SELECT row_id, CASE WHEN contains(text, ' ') THEN regexp_replace(text, ' [^ ]*$', '') ELSE '' END AS context, "
              "' ' || regexp_extract(text, '[^ ]*$') AS last_word FROM d)")


@query("score_last_word", with_(D, SPLIT_LAST, bigram("d"), cond_occ("lw", "context", "last_word"),
                                bigram_lp("occ", "occ.row_id, occ.pos, occ.ctx"), row_scores("lw", "occ_lp")) + """
       SELECT row_id, pos, token, ctx, round(lp / 1000.0::DOUBLE) / 1e6 AS ll, ll_score, ppl_score
       FROM occ_lp JOIN scores USING (row_id)""")
def score_last_word(spark, sf):
    rows = docs(spark, sf)
    return lm.score_last_word(rows, lm.fit_bigram(rows)).filter(F.col("token").isNotNull())


@query("topk_next_token", with_(D, bigram("d")) + """,
    frequent AS (SELECT token FROM uni ORDER BY n DESC, token LIMIT 10),
    cand AS (SELECT ctx, token, max(n_pair) AS n_pair FROM (SELECT ctx, token, n_pair FROM big
      UNION ALL SELECT ctx, token, 0 FROM ctxs CROSS JOIN frequent) GROUP BY ctx, token),
    probs AS (SELECT c.ctx, c.token, round(0.7 * (c.n_pair / n_ctx::DOUBLE) + (1 - 0.7::DOUBLE) * ((n + 1.0) / (nn + vv)), 9) AS p
      FROM cand c JOIN ctxs USING (ctx) JOIN uni ON uni.token = c.token CROSS JOIN tot)
    SELECT * FROM (SELECT ctx, token, p, row_number() OVER (PARTITION BY ctx ORDER BY p DESC, token) AS next_rank FROM probs) WHERE next_rank <= 10""")
def topk_next_token(spark, sf):
    return lm.top_next_tokens(lm.fit_bigram(docs(spark, sf)), k=10)


@query("last_word_log", with_(D, SPLIT_LAST, bigram("d"), cond_occ("lw", "context", "last_word"),
                              bigram_lp("occ", "occ.row_id, occ.pos, occ.ctx"), """
    frequent AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) AS next_rank FROM uni QUALIFY next_rank <= 10),
    known AS (SELECT ctx, n_ctx FROM ctxs WHERE ctx IN (SELECT ctx FROM occ)),
    cand AS (SELECT ctx, token, max(n_pair) AS n_pair FROM (SELECT ctx, token, n_pair FROM big WHERE ctx IN (SELECT ctx FROM known)
      UNION ALL SELECT ctx, token, 0 FROM known CROSS JOIN frequent) GROUP BY ctx, token),
    probs AS (SELECT c.ctx, c.token, round(0.7 * (c.n_pair / n_ctx::DOUBLE) + (1 - 0.7::DOUBLE) * ((n + 1.0) / (nn + vv)), 9) AS p
      FROM cand c JOIN known USING (ctx) JOIN uni ON uni.token = c.token CROSS JOIN tot),
    tops AS (SELECT ctx, token, row_number() OVER (PARTITION BY ctx ORDER BY p DESC, token) AS next_rank FROM probs QUALIFY next_rank <= 10),
    alts AS (SELECT ctx, list(token ORDER BY next_rank) AS best FROM tops GROUP BY ctx),
    fallback AS (SELECT list(token ORDER BY next_rank) AS often FROM frequent),
    said AS (SELECT row_id, pos, token, lp, coalesce(best, often) AS best FROM occ_lp CROSS JOIN fallback
      LEFT JOIN alts ON alts.ctx = occ_lp.ctx WHERE token IS NOT NULL)""") + """
       SELECT row_id, pos, token, round(lp / 1000.0::DOUBLE) / 1e6 AS ll, nullif(list_position(best, token), 0)::BIGINT AS token_rank,
       array_to_string(list_reverse(best), ' ') AS alternatives FROM said""")
def last_word_log(spark, sf):
    """The log of last words as JSON lines, read back."""
    rows = docs(spark, sf)
    log = lm.last_word_rows(rows, lm.fit_bigram(rows))
    path = new_path(spark, "last_words")
    write_json_rows(log, path)
    return spark.read.schema(log.schema).json(path).withColumn("alternatives", F.array_join("alternatives", " "))


def text_stats(frame: pd.DataFrame):
    """Stand-in for a user's model: a length-based score."""
    n = frame["text"].str.split().str.len()
    return -(frame["text"].str.len() * 0.5), n


@query("score_external", """SELECT doc_id AS row_id, len(list_filter(regexp_split_to_array(text, '[\\s\\x1c-\\x1f\\x85\\p{Z}]+'), lambda x: x <> '')) AS n_tokens,
       -(length(text) * 0.5::DOUBLE) AS ll_score FROM documents""")
def score_external(spark, sf):
    return lm.score_external(docs(spark, sf), lambda: text_stats, ["text"], batch_rows=256).drop("ppl_score")


# --- token windows -----------------------------------------------------------------------

@query("token_windows", with_(D) + f"""
       SELECT row_id, w AS window_start, greatest(w + 512 - 1024, 0) AS begin_loc, least(w + 512, n) AS end_loc,
       least(w + 512, n) - w AS n_scored FROM (SELECT row_id, n, unnest(range(0, n, 512)) AS w
       FROM (SELECT row_id, len({tok('text')}) AS n FROM d))""")
def token_windows(spark, sf):
    return windows.token_windows(docs(spark, sf))


DOC_OCC = cond_occ("d0", "nothing", "text")
D0 = "d0 AS (SELECT row_id, text, '' AS nothing FROM d)"


@query("score_tokens", with_(D, D0, bigram("d"), DOC_OCC, bigram_lp("occ", "occ.row_id, occ.pos")) +
       "SELECT row_id, pos, token, round(lp / 1000.0::DOUBLE) / 1e6 AS ll FROM occ_lp")
def score_tokens(spark, sf):
    rows = docs(spark, sf)
    return windows.score_tokens(rows, lm.fit_bigram(rows))


@query("score_strided", with_(D, D0, bigram("d"), DOC_OCC, """
       wocc AS (SELECT row_id, pos, token, CASE WHEN pos > greatest((pos // 512) * 512 + 512 - 512, 0) THEN ctx END AS ctx FROM occ)""",
                              bigram_lp("wocc", "occ.row_id, occ.pos")) + """
       SELECT row_id, count(DISTINCT pos // 512) AS n_windows, count(*) AS n_tokens, round(sum(lp) / 1000.0::DOUBLE) / 1e6 AS ll_score,
       round(exp(-(sum(lp) / 1e9::DOUBLE) / count(*)), 6) AS ppl_score FROM occ_lp GROUP BY row_id""")
def score_strided(spark, sf):
    rows = docs(spark, sf)
    # Windows as long as the stride, so that every window starts without context.
    return windows.score_strided(rows, lm.fit_bigram(rows), stride=512, max_len=512)


@query("score_strided_overlap", with_(D, D0, bigram("d"), DOC_OCC, """
       wocc AS (SELECT row_id, pos, token, CASE WHEN pos > greatest((pos // 512) * 512 + 512 - 1024, 0) THEN ctx END AS ctx FROM occ)""",
                                      bigram_lp("wocc", "occ.row_id, occ.pos")) + """
       SELECT row_id, count(DISTINCT pos // 512) AS n_windows, count(*) AS n_tokens, round(sum(lp) / 1000.0::DOUBLE) / 1e6 AS ll_score,
       round(exp(-(sum(lp) / 1e9::DOUBLE) / count(*)), 6) AS ppl_score FROM occ_lp GROUP BY row_id""")
def score_strided_overlap(spark, sf):
    """Windows of 1024 tokens every 512: a token has its context across the border of the scored parts."""
    rows = docs(spark, sf)
    return windows.score_strided(rows, lm.fit_bigram(rows))


@query("corpus_token_stream", with_(D, unigram("d")) + f""",
       lens AS (SELECT row_id, {tok('text')} AS t FROM d),
       offs AS (SELECT row_id, t, coalesce(sum(len(t)) OVER (ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM lens),
       place AS (SELECT off + unnest(range(len(t))) AS g, unnest(t) AS token FROM offs),
       wins AS (SELECT (g // 512) * 512 AS window_start, sum(lp) AS s, count(*) AS n_scored FROM place JOIN lps USING (token) GROUP BY 1)
       SELECT window_start, greatest(window_start + 512 - 1024, 0) AS begin_loc, window_start + n_scored AS end_loc, n_scored,
       round(s / 1000.0::DOUBLE) / 1e6 AS ll FROM wins""")
def corpus_token_stream(spark, sf):
    rows = docs(spark, sf)
    return windows.corpus_windows(rows, lm.fit_unigram(rows))


@query("batch_groups", with_(D) + f"""
       SELECT row_id, length, batch_id, max(length) OVER (PARTITION BY batch_id) AS batch_width FROM
       (SELECT row_id, len({tok('text')}) AS length, (row_number() OVER (ORDER BY row_id) - 1) // 8 AS batch_id FROM d)""")
def batch_groups(spark, sf):
    rows = docs(spark, sf).select("row_id", token_length("text").alias("length"))
    return rows.join(windows.batch_groups(rows, {"batch_width": "length"}, 8), "row_id")


# --- atoms -------------------------------------------------------------------------------

def stems(text: str) -> str:
    return f"list_transform({words(text)}, lambda w: substr(w, 1, 3))"


def stem_list(col):
    from tailsplit.functions.text import word_list
    return F.transform(word_list(col), lambda w: F.substring(w, 1, 3))


SIDE_ATOMS = base_sql("ll") + SCORED_SQL + f""",
    sides AS (SELECT CASE WHEN split = 'train' THEN 'train' ELSE 'eval' END AS side, text FROM final JOIN dl USING (row_id)),
    counts AS (SELECT side, atom, count(*) AS n FROM (SELECT side, unnest({stems('text')}) AS atom FROM sides) GROUP BY side, atom)"""


def side_counts(spark, sf):
    sides = split_score(spark, sf).select("row_id", F.when(F.col("split") == "train", "train").otherwise("eval").alias("side"))
    texts = labelled(spark, sf).select("row_id", "text").join(sides, "row_id")
    return atoms.atom_counts(texts, "side", extract=stem_list)


@query("atom_counts", SIDE_ATOMS + "SELECT side, atom, n FROM counts")
def atom_counts(spark, sf):
    return side_counts(spark, sf)


@query("atom_divergence", SIDE_ATOMS + """,
       per_atom AS (SELECT atom, coalesce(sum(n) FILTER (side = 'train'), 0) AS a, coalesce(sum(n) FILTER (side = 'eval'), 0) AS b FROM counts GROUP BY atom),
       tots AS (SELECT sum(a)::DOUBLE AS ta, sum(b)::DOUBLE AS tb FROM per_atom)
       SELECT round(1 - sum(sqrt((a / ta) * (b / tb))), 6) AS divergence FROM per_atom, tots""")
def atom_divergence(spark, sf):
    return atoms.atom_divergence(side_counts(spark, sf), "train", "eval", "side")


HELD = fixed_sql(None) + f""",
    held AS (SELECT DISTINCT row_id, rank, picked, unnest({stems('text')}) AS atom FROM sided JOIN d USING (row_id)),
    missing AS (SELECT atom, min(rank) AS rank, count(*) AS n_holders FROM held GROUP BY atom HAVING NOT bool_or(picked))"""


def fixed_rows(spark, sf):
    base = pool(spark, sf)
    return materialize(splits.fixed_train(base, four_fifths(base)), "fixed")


def held_atoms(spark, sf):
    stem_rows = atoms.atom_rows(docs(spark, sf), extract=leading_letters)
    return atoms.holders(ranking.rank_rows(fixed_rows(spark, sf), ranking.key_order()), stem_rows)


@query("missing_atoms", HELD + "SELECT atom, rank, n_holders FROM missing")
def missing_atoms(spark, sf):
    return atoms.missing_atoms(held_atoms(spark, sf))


@query("atom_carriers", HELD + "SELECT DISTINCT row_id FROM held JOIN missing USING (atom)")
def atom_carriers(spark, sf):
    held = materialize(held_atoms(spark, sf), "held")
    return atoms.atom_carriers(held, atoms.missing_atoms(held))


BALANCED = HELD + """,
    inn AS (SELECT DISTINCT rank FROM missing),
    kept AS (SELECT atom, rank FROM held WHERE picked OR rank IN (SELECT rank FROM inn)),
    keepers AS (SELECT DISTINCT r FROM (SELECT min(rank) AS r FROM kept GROUP BY atom)),
    gone AS (SELECT rank FROM (SELECT rank, row_number() OVER (ORDER BY rank DESC) AS t FROM sided
      WHERE picked AND rank NOT IN (SELECT r FROM keepers)) WHERE t <= (SELECT count(*) FROM inn)),
    balanced AS (SELECT row_id, rank, picked AS before,
      picked <> (rank IN (SELECT rank FROM inn) OR rank IN (SELECT rank FROM gone)) AS picked FROM sided)"""


@query("balance_atoms", BALANCED + "SELECT row_id, rank, picked FROM balanced")
def balance_atoms(spark, sf):
    rows = fixed_rows(spark, sf)
    balanced, _ = atoms.balance_atoms(rows, atoms.atom_rows(docs(spark, sf), extract=leading_letters))
    return balanced.select("row_id", "rank", "picked")


TRIGRAMS = "[text[i:i+2] for i in range(1, length(text) - 1)]"


def letter_triples(col):
    """All runs of three letters of a text: atoms of which many are missing and one row holds several."""
    letters = F.split(col, "")  # cut once: a substring by place walks through the text from its start
    n = F.greatest(F.size(letters) - 2, F.lit(0))
    first, second, third = (F.slice(letters, F.lit(i), n) for i in (1, 2, 3))
    return F.zip_with(F.zip_with(first, second, lambda a, b: F.concat(a, b)), third, lambda a, b: F.concat(a, b))


@query("balance_atoms_cover", f"""WITH d AS (SELECT text FROM documents), a AS (SELECT DISTINCT unnest({TRIGRAMS}) AS atom FROM d)
       SELECT (SELECT (count(*) * 8) // 10 FROM d) AS n_before, (SELECT (count(*) * 8) // 10 FROM d) AS n_after,
       (SELECT count(*) FROM a) AS n_atoms, 0::BIGINT AS n_missing""")
def balance_atoms_cover(spark, sf):
    """Sizes of the train side and what it lacks, after few rows that hold many missing atoms moved in."""
    before = fixed_rows(spark, sf)
    held = materialize(atoms.atom_rows(docs(spark, sf), extract=letter_triples), "atoms")
    after, _ = atoms.balance_atoms(before, held, fewest=True)
    after = materialize(after, "balanced")
    sizes = before.agg(F.count_if("picked").alias("n_before")).crossJoin(after.agg(F.count_if("picked").alias("n_after")))
    lacking = atoms.holders(after, held).groupBy("atom").agg(F.bool_or("picked").alias("there")).agg(
        F.count(F.lit(1)).alias("n_atoms"), F.count_if(~F.col("there")).alias("n_missing"))
    return sizes.crossJoin(lacking)  # one row on either side


@query("split_fixed_train_balanced", BALANCED.replace("sided AS (", "sided0 AS (").replace("held AS", "sided AS (SELECT * FROM sided0), held AS", 1)
       .replace("balanced AS (", "swapped AS (") + REST.replace("FROM sided)", "FROM swapped)").replace("turn FROM sided", "turn FROM swapped") +
       "SELECT row_id, split FROM final")
def split_fixed_train_balanced(spark, sf):
    rows = fixed_rows(spark, sf)
    balanced, _ = atoms.balance_atoms(rows, atoms.atom_rows(docs(spark, sf), extract=leading_letters))
    return splits.halve_rest(materialize(balanced, "balanced"), SEED).select("row_id", "split")
