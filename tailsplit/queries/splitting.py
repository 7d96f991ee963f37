"""Queries of ranks, targets, buckets and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailsplit.functions.text import custom_perplexity, token_length
from tailsplit.operators import lm, ranking, targets
from tailsplit.plans import splits
from tailsplit.queries.fixtures import D, DL, SEED, docs, labelled, text_scores, tok, with_
from tailsplit.queries.registry import query
from tailsplit.scratch import materialize, row_count

K_BUCKETS = 4


def scored(pool: DataFrame, label: str | None, kind: str) -> DataFrame:
    """Narrow table (row_id, label, length, ll_score, ppl_score, key), written once."""
    keep = ["label"] if label else []
    rows = pool.withColumn("label", F.col(label)) if label else pool
    if kind in ("random", "length"):
        key = ranking.seeded_order(SEED) if kind == "random" else F.col("length")
        narrow = rows.select("row_id", *keep, token_length("text").alias("length"))
        return materialize(narrow.withColumn("key", key), "base")
    # The scorer counts the tokens anyway, so the texts are not cut a second time for the length.
    base = lm.score_text(rows, lm.fit_unigram(rows), keep=keep).withColumnRenamed("n_tokens", "length")
    if kind == "custom":
        base = base.withColumn("ppl_score", F.round(custom_perplexity("ll_score", "length"), 6))
    column, by = ("ll_score", "ll") if kind == "ll" else ("ppl_score", "ppl")
    return materialize(base.withColumn("key", ranking.likelihood_key(column, by)), "base")


def classes(spark, sf, kind="ll"):
    return scored(labelled(spark, sf), "quality", kind)


def pool(spark, sf, kind="ll"):
    return scored(docs(spark, sf), None, kind)


def tenth(base: DataFrame) -> int:
    return row_count(base) // 10


# --- SQL ---------------------------------------------------------------------------------

KEYS = {"ll": "-ll_score", "ppl": "ppl_score", "custom": "ppl_score"}


def base_sql(kind: str, src: str = "dl") -> str:
    label = "quality AS label, " if src == "dl" else ""
    table = DL if src == "dl" else D
    if kind == "random":
        return with_(table, f"base AS (SELECT row_id, {label}len({tok('text')}) AS length, "
                            f"md5('{SEED}:' || row_id) AS key FROM {src})")
    if kind == "length":
        return with_(table, f"base AS (SELECT row_id, {label}len({tok('text')}) AS length, "
                            f"len({tok('text')}) AS key FROM {src})")
    ppl = "round(exp(-ll_score / nullif(length, 0)::DOUBLE), 6)" if kind == "custom" else "ppl_score"
    return with_(table, text_scores(src), f"""
    base0 AS (SELECT row_id, {label}len({tok('text')}) AS length, ll_score, ppl_score FROM {src} JOIN scores USING (row_id)),
    base AS (SELECT *, {KEYS[kind]} AS key FROM (SELECT * REPLACE ({ppl} AS ppl_score) FROM base0))""")


TARGETS = """,
    size AS (SELECT count(*) // 10 AS te FROM base),
    cls AS (SELECT label, count(*) AS class_rows, min(r) AS best FROM
            (SELECT label, row_number() OVER (ORDER BY key NULLS LAST, row_id) AS r FROM base) GROUP BY label),
    k AS (SELECT count(*) AS k, min(best) AS first FROM cls),
    want AS (SELECT label, class_rows, te // k + CASE WHEN best = first THEN te % k ELSE 0 END AS w FROM cls, k, size),
    tg AS (SELECT label, class_rows, least(w, class_rows)::BIGINT AS test_target,
           least(w, class_rows - least(w, class_rows))::BIGINT AS dev_target FROM want)"""

RANKED = """,
    ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY key NULLS LAST, row_id) AS rank FROM base)"""

SIDED = TARGETS + RANKED + """,
    sided AS (SELECT ranked.*, test_target, dev_target, rank > class_rows - test_target - dev_target AS picked
              FROM ranked JOIN tg USING (label))"""


def halves_sql(extra: str = "") -> str:
    return f""",
    mixed AS (SELECT *, CASE WHEN picked THEN row_number() OVER (PARTITION BY label, picked
              ORDER BY md5('{SEED}:' || row_id), row_id) END AS turn FROM sided),
    final AS (SELECT row_id, label, length{extra}, CASE WHEN NOT picked THEN 'train'
              WHEN turn <= test_target THEN 'test' ELSE 'dev' END AS split FROM mixed)"""


def hist_sql(by: str) -> str:
    group = f"{by}, length" if by else "length"
    return f""",
    hist AS (SELECT {group}, count(*) AS n_rows FROM base GROUP BY {group})"""


def buckets_sql(kind: str, by: str) -> str:
    """CTE buckets(by, length, n_rows, length_bucket)."""
    if kind == "unique":
        over = f"PARTITION BY {by} ORDER BY length" if by else "ORDER BY length"
        return hist_sql(by) + f""",
    buckets AS (SELECT *, dense_rank() OVER ({over}) - 1 AS length_bucket FROM hist)"""
    cuts = [i / K_BUCKETS for i in range(K_BUCKETS + 1)]
    sel, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    # Equal edges collapse; the two outer ones never cut.
    edge_rows = f""",
    edges0 AS (SELECT {sel}quantile_cont(length, {cuts}) AS q FROM base {group}),
    edges AS (SELECT {sel}list_sort(list_distinct(q)) AS q FROM edges0)"""
    join = f"hist JOIN edges USING ({by})" if by else "hist, edges"
    return hist_sql(by) + edge_rows + f""",
    buckets AS (SELECT {sel}length, n_rows, len(list_filter(q[2:len(q)-1], lambda e: e < length)) AS length_bucket FROM {join})"""


def cut_targets_sql(wanted: str, by: str) -> str:
    """CTE cuts(by, length_bucket, bucket_rows, bucket_target)."""
    cols = f"{by}, length_bucket" if by else "length_bucket"
    over = f"PARTITION BY {by}" if by else ""
    seed = f"'{SEED}:' || {by} || ':' || length_bucket" if by else f"'{SEED}:' || length_bucket"
    join = f"JOIN tg USING ({by})" if by else ""
    return f""",
    cnt AS (SELECT {cols}, sum(n_rows)::BIGINT AS bucket_rows FROM buckets GROUP BY {cols}),
    shares AS (SELECT {cols}, bucket_rows, ({wanted})::DOUBLE * bucket_rows / (sum(bucket_rows) OVER ({over}))::DOUBLE AS share,
               ('0x' || substr(md5({seed}), 1, 8))::BIGINT / 4294967296.0 AS draw FROM cnt {join}),
    cuts AS (SELECT {cols}, bucket_rows, least((floor(share) + CASE WHEN draw < share - floor(share) THEN 1 ELSE 0 END)::BIGINT,
             bucket_rows)::BIGINT AS bucket_target FROM shares)"""


def bucket_split_sql(kind: str) -> str:
    """Class-balanced bucketed split down to ``final``."""
    return base_sql("ll") + TARGETS + buckets_sql(kind, "label") + cut_targets_sql("test_target + dev_target", "label") + """,
    rk AS (SELECT base.*, length_bucket, row_number() OVER (PARTITION BY label, length_bucket ORDER BY key NULLS LAST, row_id) AS r
           FROM base JOIN buckets USING (label, length)),
    cut AS (SELECT rk.*, r > bucket_rows - bucket_target AS side FROM rk JOIN cuts USING (label, length_bucket)),
    need AS (SELECT label, any_value(test_target) + any_value(dev_target) - count_if(side) AS needed
             FROM cut JOIN tg USING (label) GROUP BY label),
    turns AS (SELECT cut.*, needed,
              row_number() OVER (PARTITION BY label, side ORDER BY key DESC NULLS FIRST, row_id DESC) AS from_least,
              row_number() OVER (PARTITION BY label, side ORDER BY key NULLS LAST, row_id) AS from_most
              FROM cut JOIN need USING (label)),
    sided AS (SELECT turns.*, test_target, dev_target,
              CASE WHEN needed > 0 AND NOT side AND from_least <= needed THEN true
                   WHEN needed < 0 AND side AND from_most <= -needed THEN false ELSE side END AS picked
              FROM turns JOIN tg USING (label))""" + halves_sql(", length_bucket, ll_score")


FIXED = "(SELECT (count(*) * 8) // 10 FROM base)"


def fixed_sql(kind: str | None) -> str:
    """Fixed-size train split down to ``sided(…, picked)``."""
    if kind is None:
        return base_sql("ll", "d") + f""",
    rk AS (SELECT *, row_number() OVER (ORDER BY key NULLS LAST, row_id) AS rank FROM base),
    sided AS (SELECT *, rank <= {FIXED} AS picked FROM rk)"""
    return base_sql("ll", "d") + buckets_sql(kind, "") + cut_targets_sql(FIXED, "") + f""",
    rk AS (SELECT base.*, length_bucket, row_number() OVER (PARTITION BY length_bucket ORDER BY key NULLS LAST, row_id) AS r
           FROM base JOIN buckets USING (length)),
    cut AS (SELECT rk.*, r <= bucket_target AS side FROM rk JOIN cuts USING (length_bucket)),
    need AS (SELECT {FIXED} - count_if(side) AS needed FROM cut),
    turns AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY key DESC NULLS FIRST, row_id DESC) AS from_least,
              row_number() OVER (PARTITION BY side ORDER BY key NULLS LAST, row_id) AS from_most FROM cut, need),
    sided AS (SELECT *, CASE WHEN needed > 0 AND NOT side AND from_most <= needed THEN true
              WHEN needed < 0 AND side AND from_least <= -needed THEN false ELSE side END AS picked FROM turns)"""


REST = f""",
    mixed AS (SELECT *, row_number() OVER (PARTITION BY picked ORDER BY md5('{SEED}:' || row_id), row_id) AS turn FROM sided),
    final AS (SELECT *, CASE WHEN picked THEN 'train' WHEN turn <= (SELECT count_if(NOT picked) // 2 FROM sided) THEN 'dev'
              ELSE 'test' END AS split FROM mixed)"""

SPLIT_SQL = SIDED + halves_sql()
SCORED_SQL = SIDED + halves_sql(", ll_score, ppl_score")


# --- sorting and ranks -------------------------------------------------------------------

@query("sort_stable", base_sql("ll", "d") +
       "SELECT row_id, ll_score, row_number() OVER (ORDER BY key NULLS LAST, row_id) AS rank FROM base")
def sort_stable(spark, sf):
    return ranking.rank_rows(pool(spark, sf), ranking.key_order()).select("row_id", "ll_score", "rank")


@query("rank_global", base_sql("ppl", "d") +
       "SELECT row_id, ppl_score, row_number() OVER (ORDER BY key NULLS LAST, row_id) AS rank FROM base")
def rank_global(spark, sf):
    return ranking.rank_rows(pool(spark, sf, "ppl"), ranking.key_order()).select("row_id", "ppl_score", "rank")


@query("rank_class", base_sql("ll") + RANKED + "SELECT row_id, label, ll_score, rank FROM ranked")
def rank_class(spark, sf):
    return ranking.rank_rows(classes(spark, sf), ranking.key_order(), ["label"]).select(
        "row_id", "label", "ll_score", "rank")


@query("rank_class_large", """SELECT o_orderkey, o_orderpriority,
       row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS rank FROM orders""")
def rank_class_large(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderpriority", "o_totalprice")
    order = [F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey").asc()]
    return ranking.rank_rows(orders, order, ["o_orderpriority"]).drop("o_totalprice")


@query("rank_class_bucket", base_sql("ll") + buckets_sql("quantile", "label") + """
       SELECT row_id, label, length_bucket, row_number() OVER (PARTITION BY label, length_bucket
       ORDER BY key NULLS LAST, row_id) AS rank FROM base JOIN buckets USING (label, length)""")
def rank_class_bucket(spark, sf):
    base = classes(spark, sf)
    rows = targets.assign_buckets(base, splits.buckets_of(base, K_BUCKETS, ["label"]), ["label"])
    return ranking.rank_rows(rows, ranking.key_order(), ["label", "length_bucket"]).select(
        "row_id", "label", "length_bucket", "rank")


# --- targets and buckets -----------------------------------------------------------------

@query("class_targets", base_sql("ll") + TARGETS + "SELECT label, class_rows, test_target, dev_target FROM tg")
def class_targets(spark, sf):
    base = classes(spark, sf)
    return targets.class_targets(base, "label", "key", tenth(base), tenth(base))


@query("filter_class", base_sql("ll") + "SELECT row_id, ll_score, row_number() OVER (ORDER BY key NULLS LAST, row_id) AS rank FROM base WHERE label = 1")
def filter_class(spark, sf):
    one = classes(spark, sf).filter(F.col("label") == 1)
    return ranking.rank_rows(one, ranking.key_order()).select("row_id", "ll_score", "rank")


@query("length_histogram", base_sql("length") + hist_sql("label") + "SELECT label, length, n_rows FROM hist")
def length_histogram(spark, sf):
    return targets.length_histogram(classes(spark, sf, "length"), ["label"])


@query("bucket_quantile", base_sql("length") + buckets_sql("quantile", "label") +
       "SELECT row_id, label, length, length_bucket FROM base JOIN buckets USING (label, length)")
def bucket_quantile(spark, sf):
    base = classes(spark, sf, "length")
    return targets.assign_buckets(base, splits.buckets_of(base, K_BUCKETS, ["label"]), ["label"]).drop("key")


@query("bucket_unique_length", base_sql("length") + buckets_sql("unique", "label") +
       "SELECT row_id, label, length, length_bucket FROM base JOIN buckets USING (label, length)")
def bucket_unique_length(spark, sf):
    base = classes(spark, sf, "length")
    return targets.assign_buckets(base, splits.buckets_of(base, "unique", ["label"]), ["label"]).drop("key")


@query("bucket_counts", base_sql("length") + buckets_sql("quantile", "label") +
       "SELECT label, length_bucket, sum(n_rows)::BIGINT AS bucket_rows FROM buckets GROUP BY label, length_bucket")
def bucket_counts(spark, sf):
    return targets.bucket_counts(splits.buckets_of(classes(spark, sf, "length"), K_BUCKETS, ["label"]), ["label"])


@query("bucket_targets", base_sql("ll") + TARGETS + buckets_sql("quantile", "label") +
       cut_targets_sql("test_target + dev_target", "label") + "SELECT label, length_bucket, bucket_rows, bucket_target FROM cuts")
def bucket_targets(spark, sf):
    base = classes(spark, sf)
    wanted = targets.class_targets(base, "label", "key", tenth(base), tenth(base))
    counts = targets.bucket_counts(splits.buckets_of(base, K_BUCKETS, ["label"]), ["label"]).join(wanted, "label")
    return targets.bucket_targets(counts, F.col("test_target") + F.col("dev_target"), SEED, ["label"]).select(
        "label", "length_bucket", "bucket_rows", "bucket_target")


# --- class-balanced splits ---------------------------------------------------------------

def class_split(spark, sf, kind: str) -> DataFrame:
    base = classes(spark, sf, kind)
    return splits.split_classes(base, "label", tenth(base), tenth(base), SEED).drop("key")


@query("split_random", base_sql("random") + SPLIT_SQL + "SELECT * FROM final")
def split_random(spark, sf):
    return class_split(spark, sf, "random")


@query("split_length", base_sql("length") + SPLIT_SQL + "SELECT * FROM final")
def split_length(spark, sf):
    return class_split(spark, sf, "length")


@query("split_score", base_sql("ll") + SCORED_SQL + "SELECT * FROM final")
def split_score(spark, sf):
    return class_split(spark, sf, "ll")


@query("split_score_ppl", base_sql("ppl") + SCORED_SQL + "SELECT * FROM final")
def split_score_ppl(spark, sf):
    return class_split(spark, sf, "ppl")


@query("split_score_custom_ppl", base_sql("custom") + SCORED_SQL + "SELECT * FROM final")
def split_score_custom_ppl(spark, sf):
    return class_split(spark, sf, "custom")


def bucket_split(spark, sf, kind) -> DataFrame:
    base = classes(spark, sf)
    return splits.split_classes_buckets(base, "label", tenth(base), tenth(base), kind, SEED).drop("key", "ppl_score")


@query("split_score_qbuckets", bucket_split_sql("quantile") + "SELECT * FROM final")
def split_score_qbuckets(spark, sf):
    return bucket_split(spark, sf, K_BUCKETS)


@query("split_score_ubuckets", bucket_split_sql("unique") + "SELECT * FROM final")
def split_score_ubuckets(spark, sf):
    return bucket_split(spark, sf, splits.UNIQUE_LENGTHS)


@query("split_complement", base_sql("ll") + SCORED_SQL +
       "SELECT row_id, label FROM base EXCEPT SELECT row_id, label FROM final WHERE split IN ('dev', 'test')")
def split_complement(spark, sf):
    return split_score(spark, sf).filter(F.col("split") == "train").select("row_id", "label")


@query("shuffle_halves", base_sql("ll") + SCORED_SQL + "SELECT row_id, label, split FROM final WHERE split <> 'train'")
def shuffle_halves(spark, sf):
    base = classes(spark, sf)
    wanted = targets.class_targets(base, "label", "key", tenth(base), tenth(base))
    ranked = ranking.rank_rows(base, ranking.key_order(), ["label"]).join(wanted, "label")
    rest = ranked.filter(F.col("rank") > F.col("class_rows") - F.col("test_target") - F.col("dev_target"))
    return splits.shuffle_halves(rest, "label", SEED).select("row_id", "label", "split")


@query("split_report", base_sql("ll") + SCORED_SQL + """
       SELECT split, label, count(*) AS n_rows, round(avg(ll_score), 6) AS mean_ll, round(avg(length), 6) AS mean_length
       FROM final GROUP BY split, label""")
def split_report(spark, sf):
    return splits.split_report(split_score(spark, sf), "label")


@query("split_audit", """SELECT count(*) AS n_rows, 0::BIGINT AS n_repeated, 0::BIGINT AS n_missing, 0::BIGINT AS n_foreign
       FROM documents JOIN labels USING (doc_id)""")
def split_audit(spark, sf):
    base = classes(spark, sf)
    return splits.split_audit(splits.split_classes(base, "label", tenth(base), tenth(base), SEED), base)


@query("sort_outputs", base_sql("ll") + SCORED_SQL + """
       SELECT row_id, split, row_number() OVER (PARTITION BY split ORDER BY
         CASE WHEN split = 'train' THEN ll_score ELSE -ll_score END,
         CASE WHEN split = 'train' THEN -row_id ELSE row_id END) AS order_in_split FROM final""")
def sort_outputs(spark, sf):
    base = classes(spark, sf)
    rows = splits.split_classes(base, "label", tenth(base), tenth(base), SEED)
    return splits.sort_outputs(rows).select("row_id", "split", "order_in_split")


@query("rebalance_split", bucket_split_sql("quantile") + """
       SELECT label, count_if(side)::BIGINT AS before_rows, count_if(picked)::BIGINT AS after_rows, count_if(side <> picked)::BIGINT AS moved_rows
       FROM sided GROUP BY label""")
def rebalance_split(spark, sf):
    base = classes(spark, sf)
    before, after = splits.bucket_cut(base, "label", tenth(base), tenth(base), K_BUCKETS, SEED)
    both = before.select("row_id", "label", F.col("picked").alias("side")).join(
        after.select("row_id", "picked"), "row_id")
    return both.groupBy("label").agg(
        F.count_if("side").alias("before_rows"), F.count_if("picked").alias("after_rows"),
        F.count_if(F.col("side") != F.col("picked")).alias("moved_rows"))


# --- fixed-size train --------------------------------------------------------------------

def four_fifths(base: DataFrame) -> int:
    return row_count(base) * 8 // 10


@query("split_fixed_train", fixed_sql(None) + REST + "SELECT row_id, length, ll_score, split FROM final")
def split_fixed_train(spark, sf):
    base = pool(spark, sf)
    return splits.halve_rest(splits.fixed_train(base, four_fifths(base)), SEED).select(
        "row_id", "length", "ll_score", "split")


@query("split_fixed_train_buckets", fixed_sql("quantile") + REST +
       "SELECT row_id, length, length_bucket, ll_score, split FROM final")
def split_fixed_train_buckets(spark, sf):
    base = pool(spark, sf)
    rows = splits.fixed_train_buckets(base, four_fifths(base), K_BUCKETS, SEED)
    return splits.halve_rest(rows, SEED).select("row_id", "length", "length_bucket", "ll_score", "split")


@query("split_fixed_train_ubuckets", fixed_sql("unique") + REST +
       "SELECT row_id, length, length_bucket, ll_score, split FROM final")
def split_fixed_train_ubuckets(spark, sf):
    base = pool(spark, sf)
    rows = splits.fixed_train_buckets(base, four_fifths(base), splits.UNIQUE_LENGTHS, SEED)
    return splits.halve_rest(rows, SEED).select("row_id", "length", "length_bucket", "ll_score", "split")


@query("percent_split", """WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_id FROM documents)
       SELECT doc_id, row_id, CASE WHEN row_id < floor((SELECT count(*) FROM documents) * 5 / 100.0 + 0.5)
       THEN 'validation' ELSE 'train' END AS split FROM p""")
def percent_split(spark, sf):
    ids = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id")
    return splits.percent_split(ranking.with_row_id(ids, [F.col("doc_id")]))


@query("head_n", "SELECT doc_id AS row_id, text FROM documents ORDER BY doc_id LIMIT 100")
def head_n(spark, sf):
    return docs(spark, sf).select("row_id", "text").orderBy("row_id").limit(100)


@query("sample_rows", base_sql("ll") + SCORED_SQL +
       f"SELECT row_id, label FROM final WHERE split = 'train' ORDER BY md5('{SEED}:' || row_id), row_id LIMIT 3")
def sample_rows(spark, sf):
    train = split_score(spark, sf).filter(F.col("split") == "train")
    return train.orderBy(ranking.seeded_order(SEED), "row_id").limit(3).select("row_id", "label")
