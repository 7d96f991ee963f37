"""Queries of sources, sinks, projections, filters, joins, metrics and sequence preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tailsplit.functions import arrays, prompts, text as tx
from tailsplit.operators import clean, joins, lm, metrics, rouge, seqprep
from tailsplit.operators.windows import batch_groups
from tailsplit.plans import splits
from tailsplit.queries.fixtures import (CV, D, DL, SQLROWS, docs, labelled, pairs, sql_rows, table, tok, unigram,
                                        with_)
from tailsplit.queries.registry import query
from tailsplit.queries.scoring import TURNS, turns
from tailsplit.queries.splitting import SCORED_SQL, SPLIT_SQL, base_sql, split_score
from tailsplit.scratch import materialize, new_path
from tailsplit.sources import catalog, readers, writers

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations")
WHITE = tx.WHITE


def stripped(col: str) -> str:
    return rf"regexp_replace({col}, '^{WHITE}+|{WHITE}+\z', '', 'g')"


# --- sources -----------------------------------------------------------------------------

@query("src_csv", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def src_csv(spark, sf):
    path = new_path(spark, "csv")
    writers.delimited(table(spark, sf, "documents").write, header=True).csv(path)
    return readers.read_csv(spark, path, "doc_id long, text string, lang string, source string, n_chars long")


@query("src_tsv", with_(SQLROWS) + "SELECT query, parse FROM sqlrows")
def src_tsv(spark, sf):
    path = new_path(spark, "tsv")
    rows = sql_rows(spark, sf).select("query", "parse")
    writers.delimited(rows.write, sep="\t").csv(f"{path}/train.tsv")
    return readers.read_query_table(spark, path, "train")


@query("src_jsonl", with_(CV) + "SELECT row_id, prefix, target, label FROM cv")
def src_jsonl(spark, sf):
    path = new_path(spark, "jsonl")
    pairs(spark, sf).withColumn("extra", F.lit(1)).write.json(path)
    return readers.read_jsonl(spark, path, "row_id long, prefix string, target string, label string")


def metadata_file(spark, sf) -> str:
    """Database metadata as JSON: every order is a database, its lines name tables and columns."""
    lines = table(spark, sf, "lineitem").select(
        F.concat(F.lit("db"), F.col("l_orderkey").cast("string")).alias("db_id"),
        F.concat(F.lit("T"), (F.col("l_suppkey") % 3).cast("string")).alias("t"),
        F.concat(F.lit("Col"), (F.col("l_partkey") % 7).cast("string")).alias("c")).distinct()
    made = lines.groupBy("db_id").agg(F.array_sort(F.collect_set("t")).alias("tables"),
                                      F.array_sort(F.collect_set(F.struct("t", "c"))).alias("cols"))
    named = F.transform("cols", lambda x: F.array((F.array_position("tables", x["t"]) - 1).cast("string"), x["c"]))
    meta = made.select(F.array(F.struct(
        "db_id", F.col("tables").alias("table_names_original"),
        F.concat(F.array(F.array(F.lit("-1"), F.lit("*"))), named).alias("column_names_original"),
        F.array().cast("array<array<int>>").alias("foreign_keys"))).alias("value"))
    path = new_path(spark, "meta")
    meta.select(F.to_json("value").alias("value")).write.text(path)
    return path


@query("src_json_meta", """WITH c AS (SELECT DISTINCT 'db' || l_orderkey AS db_id, 't' || (l_suppkey % 3) AS table_name, 'col' || (l_partkey % 7) AS column_name FROM lineitem)
       SELECT db_id, table_name, column_name, row_number() OVER (PARTITION BY db_id ORDER BY table_name, column_name) AS pos,
       '__' || table_name || '.' || column_name || '__' AS col_id FROM c
       UNION ALL SELECT DISTINCT db_id, NULL, '*', 0, '__all__' FROM c""")
def src_json_meta(spark, sf):
    return catalog.catalog_rows(catalog.read_meta(spark, metadata_file(spark, sf), multi_line=False))


def catalog_sql() -> str:
    """Columns of all tables with the number of values in each."""
    parts = []
    for name in TABLES:
        parts.append(f"""SELECT '{name}' AS table_name, lower(column_name) AS column_name, row_number() OVER () - 1 AS pos,
            '__{name}.' || lower(column_name) || '__' AS col_id FROM (DESCRIBE {name})""")
    counts = [f"SELECT '{name}' AS table_name, lower(c) AS column_name, n FROM (UNPIVOT (SELECT count(COLUMNS(*)) FROM {name}) ON COLUMNS(*) INTO NAME c VALUE n)"
              for name in TABLES]
    return f"""WITH cols AS ({' UNION ALL '.join(parts)}), counts AS ({' UNION ALL '.join(counts)})
        SELECT cols.*, n AS n_values FROM cols JOIN counts USING (table_name, column_name)"""


@query("src_catalog", catalog_sql())
def src_catalog(spark, sf):
    counts = None
    for name in TABLES:
        data = table(spark, sf, name)
        data.createOrReplaceTempView(name)
        one = data.agg(*[F.count(c).alias(c.lower()) for c in data.columns])
        one = one.unpivot([], one.columns, "column_name", "n_values").withColumn("table_name", F.lit(name))
        counts = one if counts is None else counts.unionByName(one)
    known = catalog.session_catalog(spark).filter(F.col("table_name").isin(*TABLES))
    return known.join(counts, ["table_name", "column_name"])


@query("src_lines", with_(SQLROWS) + rf"""SELECT regexp_replace(query, '{WHITE}+', ' ', 'g') AS sql, 'db' AS db_id FROM sqlrows""")
def src_lines(spark, sf):
    path = new_path(spark, "lines")
    one_line = F.regexp_replace("query", f"{WHITE}+", " ")
    sql_rows(spark, sf).select(F.concat(one_line, F.lit("\tdb\n")).alias("value")).write.text(path)
    return readers.read_lines(spark, path, ["sql", "db_id"])


@query("src_text_corpus", r"""SELECT line || chr(10) AS text FROM (SELECT unnest(string_split_regex(text, '\r\n|\n|\r')) AS line FROM documents)""")
def src_text_corpus(spark, sf):
    path = new_path(spark, "corpus")
    table(spark, sf, "documents").select("text").write.text(path)
    return readers.read_corpus(spark, path, keep_breaks=True)


@query("src_by_ext", with_(D) + """SELECT row_id, lang, 'train' AS split FROM d UNION ALL SELECT row_id, source, 'validation' FROM d""")
def src_by_ext(spark, sf):
    base = new_path(spark, "ext")
    rows = docs(spark, sf)
    rows.select("row_id", "lang").write.json(f"{base}/train.json")
    rows.select("row_id", F.col("source").alias("lang")).write.json(f"{base}/val.json")
    return readers.load(spark, {"train": f"{base}/train.json", "validation": f"{base}/val.json"}, "row_id long, lang string")


# --- sinks -------------------------------------------------------------------------------

@query("sink_split_csv", base_sql("ll") + SCORED_SQL + "SELECT split, row_id, text FROM final JOIN dl USING (row_id)")
def sink_split_csv(spark, sf):
    path = new_path(spark, "split_csv")
    rows = split_score(spark, sf).select("row_id", "split").join(labelled(spark, sf).select("row_id", "text"), "row_id")
    writers.write_split_csv(rows.select("row_id", "text", "split"), path)
    return readers.read_csv(spark, path, "row_id long, text string, split string")


@query("sink_split_tsv", base_sql("ll") + SCORED_SQL + ", " + SQLROWS + " "
       "SELECT split, query, parse FROM final JOIN sqlrows USING (row_id)")
def sink_split_tsv(spark, sf):
    path = new_path(spark, "split_tsv")
    rows = split_score(spark, sf).select("row_id", "split").join(sql_rows(spark, sf), "row_id")
    writers.write_split_tsv(rows, path)
    return readers.read_tsv(spark, path, "query string, parse string, split string")


@query("sink_split_idx", base_sql("ll") + SCORED_SQL + "SELECT split, row_id FROM final")
def sink_split_idx(spark, sf):
    path = new_path(spark, "manifest")
    writers.write_manifest(split_score(spark, sf), path)
    return spark.read.schema("row_id long, split string").json(path)


@query("sink_predictions", with_(DL) + """SELECT row_id AS "index", printf('%.3f', n_chars / 1000.0::DOUBLE) AS prediction FROM dl""")
def sink_predictions(spark, sf):
    path = new_path(spark, "predictions")
    rows = labelled(spark, sf).select("row_id", (F.col("n_chars") / 1000.0).alias("p"))
    writers.write_predictions(rows, path, "p", regression=True)
    return spark.read.schema("index long, prediction string").option("sep", "\t").option("header", True).csv(path)


@query("sink_generated", with_(CV) + rf"""SELECT {stripped(r"regexp_replace(target, '[\r\n]+', ' ', 'g')")} AS text FROM cv WHERE {stripped('target')} <> ''""")
def sink_generated(spark, sf):
    path = new_path(spark, "generated")
    writers.write_generated(pairs(spark, sf), path, "target")
    return readers.read_lines(spark, path, ["text"], sep="\u0001")


# --- projections -------------------------------------------------------------------------

@query("rename_prefix", with_(CV) + "SELECT row_id, prefix AS premise, length(prefix) AS premise_len, target AS hypothesis FROM cv")
def rename_prefix(spark, sf):
    raw = pairs(spark, sf).select("row_id", F.col("prefix").alias("sentence1"),
                                  F.length("prefix").cast("long").alias("sentence1_len"), F.col("target").alias("sentence2"))
    return readers.rename_prefixes(raw)


@query("alias_label", with_(DL) + "SELECT row_id, quality AS gold_label, quality AS label FROM dl")
def alias_label(spark, sf):
    return readers.alias_label(labelled(spark, sf).select("row_id", F.col("quality").alias("gold_label")))


AFTER_NAME = "substr(query, instr(query, ':') + 1)"


@query("split_query_fields", with_(SQLROWS) + f""", b AS (SELECT row_id,
       CASE WHEN contains(query, ':') THEN split_part(query, ':', 1) ELSE '' END AS table_name,
       CASE WHEN contains(query, ':') THEN {AFTER_NAME} ELSE query END AS body, contains(query, ' | ') AS has FROM sqlrows)
       SELECT row_id, table_name, CASE WHEN has AND contains(body, ' | ') THEN left(body, instr(body, ' | ') - 1) ELSE body END AS query,
       CASE WHEN has AND contains(body, ' | ') THEN substr(body, instr(body, ' | ')) ELSE '' END AS table_schema_str FROM b""")
def split_query_fields(spark, sf):
    return tx.split_query_fields(sql_rows(spark, sf).drop("parse"))


@query("split_query_fields_all", """WITH q AS (SELECT doc_id AS row_id, text AS query FROM documents),
       f AS (SELECT bool_and(contains(query, ':')) AS n, bool_and(contains(query, ' | ')) AS s FROM q)
       SELECT row_id, CASE WHEN n THEN split_part(query, ':', 1) ELSE '' END AS table_name, query,
       CASE WHEN s THEN substr(query, instr(query, ' | ')) ELSE '' END AS table_schema_str FROM q, f""")
def split_query_fields_all(spark, sf):
    return tx.split_query_fields_all(docs(spark, sf).select("row_id", F.col("text").alias("query")))


@query("strip_fields", with_(SQLROWS) + f"""SELECT row_id, {stripped(AFTER_NAME)} AS no_name,
       {stripped(f"split_part({AFTER_NAME}, ' | ', 1)")} AS question FROM sqlrows""")
def strip_fields(spark, sf):
    return sql_rows(spark, sf).select("row_id", tx.strip_name("query").alias("no_name"),
                                      tx.question_only("query").alias("question"))


@query("prompt_sql", with_(D) + f"""SELECT row_id, 'Ask: ' || source || ':' AS prefix, ' ' || {stripped('text')} AS target FROM d""")
def prompt_sql(spark, sf):
    prefix, target = prompts.sql_prompt(F.col("text"), "Ask: ", F.col("source"), space_after_prefix=True)
    return docs(spark, sf).select("row_id", prefix.alias("prefix"), target.alias("target"))


@query("prompt_nli", with_(CV) + """SELECT row_id, 'Premise: ' || prefix || ' Hypothesis:' AS plain_prefix,
       'Premise: ' || prefix || CASE label WHEN 'user' THEN ' This hypothesis is entailed:'
         WHEN 'assistant' THEN ' This hypothesis is a contradiction:' ELSE ' This hypothesis is neutral:' END AS named_prefix,
       ' ' || target AS target FROM cv""")
def prompt_nli(spark, sf):
    rows = pairs(spark, sf)
    label = F.when(F.col("label") == "user", "entailment").when(F.col("label") == "assistant", "contradiction").otherwise("neutral")
    plain, body = prompts.nli_prompt(F.col("prefix"), F.col("target"))
    named, _ = prompts.nli_prompt(F.col("prefix"), F.col("target"), label)
    return rows.select("row_id", plain.alias("plain_prefix"), named.alias("named_prefix"), body.alias("target"))


@query("prompt_qa", with_(CV) + """SELECT row_id, 'Passage: ' || prefix || ' Ask a question about the passage:' AS prefix,
       ' ' || target AS target FROM cv""")
def prompt_qa(spark, sf):
    prefix, target = prompts.qa_prompt(F.col("prefix"), F.col("target"))
    return pairs(spark, sf).select("row_id", prefix.alias("prefix"), target.alias("target"))


@query("prompt_batch_text", with_(D) + """SELECT row_id, '<s>' || source AS prefix, ' ' || text || '</s>' AS target,
       '<s>' || text || '</s>' AS alone FROM d""")
def prompt_batch_text(spark, sf):
    prefix, target = prompts.batch_text(F.col("text"), F.col("source"), space=True, begin="<s>", end="</s>")
    _, alone = prompts.batch_text(F.col("text"), begin="<s>", end="</s>")
    return docs(spark, sf).select("row_id", prefix.alias("prefix"), target.alias("target"), alone.alias("alone"))


@query("prompt_seq2seq", with_(SQLROWS) + """SELECT row_id, '<s>parse: ' || query || ' SQL:' AS source, parse || '</s>' AS target FROM sqlrows""")
def prompt_seq2seq(spark, sf):
    source, target = prompts.seq2seq_text(F.col("query"), F.col("parse"), "parse: ", "SQL:", "<s>", "</s>")
    return sql_rows(spark, sf).select("row_id", source.alias("source"), target.alias("target"))


@query("split_last_word", with_(D) + """SELECT row_id, CASE WHEN contains(text, ' ') THEN regexp_replace(text, ' [^ ]*$', '') ELSE '' END AS context,
       ' ' || regexp_extract(text, '[^ ]*$') AS last_word FROM d""")
def split_last_word(spark, sf):
    context, last = tx.split_last_word("text")
    return docs(spark, sf).select("row_id", context.alias("context"), last.alias("last_word"))


@query("tag_origin", with_(D) + "SELECT row_id, 'train' AS split, 'train_' || row_id AS origin_id FROM d")
def tag_origin(spark, sf):
    return readers.tag_origin(docs(spark, sf).select("row_id"), "train")


@query("select_sentence_cols", with_(DL) + "SELECT text AS sentence1, lang AS sentence2, quality AS label FROM dl")
def select_sentence_cols(spark, sf):
    rows = labelled(spark, sf).select("text", "lang", F.col("quality").alias("label"))
    first, second = readers.sentence_columns(rows)
    return rows.select(F.col(first).alias("sentence1"), F.col(second).alias("sentence2"), "label")


@query("normalize_pred", with_(SQLROWS) + f"""SELECT row_id, replace({stripped("query || ' < = 3 '")}, '< =', ' <=') AS pred,
       {stripped('parse')} AS label FROM sqlrows""")
def normalize_pred(spark, sf):
    return sql_rows(spark, sf).select(
        "row_id", tx.normalize_prediction(F.concat("query", F.lit(" < = 3 "))).alias("pred"),
        tx.normalize_prediction("parse", repair=False).alias("label"))


# --- filters -----------------------------------------------------------------------------

NO_LABEL = "CASE WHEN toxic = 1 THEN '-' ELSE quality::VARCHAR END"


def annotated(spark, sf):
    """Toxic documents stand for those whose annotators did not agree."""
    label = F.when(F.col("toxic") == 1, "-").otherwise(F.col("quality").cast("string"))
    return labelled(spark, sf).withColumn("gold_label", label)


@query("clean_labels", with_(DL) + f"SELECT row_id, {NO_LABEL} AS gold_label FROM dl WHERE {NO_LABEL} <> '-'")
def clean_labels(spark, sf):
    return annotated(spark, sf).filter(clean.label_given("gold_label")).select("row_id", "gold_label")


# Turns of users stand for pictures nobody described.
PREMISE = f"CASE WHEN label = 'user' THEN '{clean.PLACEHOLDER}' ELSE prefix END"
HYPOTHESIS = "CASE WHEN label = 'user' THEN 'N/A' ELSE target END"


def described(spark, sf):
    user = F.col("label") == "user"
    return pairs(spark, sf).select("row_id", F.when(user, clean.PLACEHOLDER).otherwise(F.col("prefix")).alias("premise"),
                                   F.when(user, "N/A").otherwise(F.col("target")).alias("hypothesis"))


@query("clean_placeholder", with_(CV) + f"SELECT row_id, prefix AS premise FROM cv WHERE {PREMISE} <> '{clean.PLACEHOLDER}'")
def clean_placeholder(spark, sf):
    return described(spark, sf).filter(clean.not_placeholder("premise")).select("row_id", "premise")


@query("clean_na_text", with_(CV) + f"SELECT row_id, target AS hypothesis FROM cv WHERE lower({HYPOTHESIS}) <> 'n/a'")
def clean_na_text(spark, sf):
    return described(spark, sf).filter(clean.not_na("hypothesis")).select("row_id", "hypothesis")


@query("clean_report", with_(DL) + f"""SELECT lang AS split, count(*) AS base_rows, count_if({NO_LABEL} = '-')::BIGINT AS dropped_rows,
       count_if({NO_LABEL} <> '-')::BIGINT AS retained_rows FROM dl GROUP BY lang""")
def clean_report(spark, sf):
    return clean.clean_report(annotated(spark, sf).withColumn("split", F.col("lang")), clean.label_given("gold_label"))


@query("nonblank_lines", rf"""SELECT row_id, line FROM (SELECT doc_id AS row_id, unnest(string_split(text, chr(10))) AS line FROM documents)
       WHERE {stripped('line')} <> ''""")
def nonblank_lines(spark, sf):
    lines = docs(spark, sf).select("row_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.filter(clean.nonblank("line"))


@query("union_originals", with_(D) + """SELECT origin_id, lang, split FROM (SELECT 'train_' || row_id AS origin_id, lang, 'train' AS split FROM d
       UNION ALL SELECT 'dev_' || item_id, 'xx', 'dev' FROM benchmark)""")
def union_originals(spark, sf):
    return originals(spark, sf).select("origin_id", "lang", "split")


def originals(spark, sf):
    train = readers.tag_origin(docs(spark, sf).select("row_id", "lang", "text"), "train")
    dev = readers.tag_origin(table(spark, sf, "benchmark").select(
        F.col("item_id").alias("row_id"), F.lit("xx").alias("lang"), "text"), "dev")
    return train.unionByName(dev)


@query("union_parts", with_(D) + "SELECT row_id, lang FROM d UNION ALL SELECT item_id, 'xx' FROM benchmark")
def union_parts(spark, sf):
    return originals(spark, sf).select("row_id", "lang")


ORIGINAL_TEST = "CASE WHEN lang = 'en' THEN 'test' WHEN lang = 'fr' THEN 'dev' ELSE 'train' END"


@query("split_standard", with_(DL) + f"""SELECT row_id, {ORIGINAL_TEST} AS split, {NO_LABEL} AS gold_label,
       {ORIGINAL_TEST} || '_' || row_id AS origin_id FROM dl WHERE {NO_LABEL} <> '-'
       AND text <> '{clean.PLACEHOLDER}' AND lower(source) <> 'n/a'""")
def split_standard(spark, sf):
    split = F.when(F.col("lang") == "en", "test").when(F.col("lang") == "fr", "dev").otherwise("train")
    kept, _ = splits.split_standard(annotated(spark, sf).withColumn("split", split), "gold_label", "text", "source")
    return kept.select("row_id", "split", "gold_label", "origin_id")


# --- joins -------------------------------------------------------------------------------

@query("join_pred_gold", with_(CV) + "SELECT row_id, lower(target) AS pred, target AS gold FROM cv")
def join_pred_gold(spark, sf):
    rows = pairs(spark, sf)
    return joins.join_predictions(rows.select("row_id", F.col("target").alias("gold")),
                                  rows.select("row_id", F.lower("target").alias("pred")))


@query("join_label_ids", with_(DL) + """SELECT row_id, lang, dense_rank() OVER (ORDER BY lang) - 1 AS label_id FROM dl""")
def join_label_ids(spark, sf):
    rows = labelled(spark, sf).select("row_id", "lang")
    out = joins.join_label_ids(rows, "lang", materialize(joins.label_ids(rows, "lang"), "labels"))
    return out.withColumn("label_id", F.col("label_id").cast("long"))


@query("distinct_labels", with_(DL) + "SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS label_id FROM (SELECT DISTINCT lang FROM dl)")
def distinct_labels(spark, sf):
    return joins.label_ids(labelled(spark, sf), "lang").withColumn("label_id", F.col("label_id").cast("long"))


@query("next_turn_pairs", with_(CV) + "SELECT row_id, prefix, target, label FROM cv")
def next_turn_pairs(spark, sf):
    return pairs(spark, sf).select("row_id", "prefix", "target", "label")


# --- metrics -----------------------------------------------------------------------------

@query("accuracy", with_(DL) + "SELECT round(avg((1 - toxic = quality)::INT), 6) AS accuracy FROM dl")
def accuracy(spark, sf):
    return metrics.accuracy(labelled(spark, sf).withColumn("pred", 1 - F.col("toxic")), "pred", "quality")


@query("argmax_pred", "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::BIGINT AS pred FROM embeddings")
def argmax_pred(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", metrics.argmax(F.col("embedding")).alias("pred"))


def event_errors(spark, sf):
    return table(spark, sf, "events").withColumn("pred", F.round("value"))


@query("mse", "SELECT round(avg(pow(round(value) - value, 2)), 6) AS mse FROM events")
def mse(spark, sf):
    return metrics.mse(event_errors(spark, sf), "pred", "value")


def two_metrics(spark, sf):
    both = labelled(spark, sf).agg(
        F.avg((F.col("toxic") == F.col("quality")).cast("double")).alias("accuracy"),
        F.avg(F.col("n_chars").cast("double")).alias("mean_chars"))
    return metrics.long_metrics(both)


TWO = """two AS (SELECT 'accuracy' AS metric, avg((toxic = quality)::INT) AS value FROM dl
    UNION ALL SELECT 'mean_chars', avg(n_chars::DOUBLE) FROM dl)"""


@query("combined_score", with_(DL, TWO) + "SELECT metric, round(value, 6) AS value FROM (SELECT * FROM two UNION ALL SELECT 'combined_score', avg(value) FROM two)")
def combined_score(spark, sf):
    return metrics.round_metrics(metrics.combined_score(two_metrics(spark, sf)), 6)


@query("metric_merge", with_(DL, TWO) + "SELECT metric, round(value, 6) AS value FROM two UNION ALL SELECT metric || '_mm', round(value + 1, 6) FROM two")
def metric_merge(spark, sf):
    first = materialize(two_metrics(spark, sf), "metrics")
    merged = metrics.merge_metrics(first, first.withColumn("value", F.col("value") + 1))
    return metrics.round_metrics(merged, 6)


@query("round_metrics", with_(DL, TWO) + "SELECT metric, round(value, 4) AS value FROM two")
def round_metrics(spark, sf):
    return metrics.round_metrics(two_metrics(spark, sf))


def white(col: str) -> str:
    return rf"list_filter(regexp_split_to_array({col}, '{WHITE}+'), lambda t: t <> '')"


@query("seq_accuracy", with_(CV) + f"SELECT round(avg(({white('lower(target)')} = {white('target')})::INT), 6) AS seq_accuracy FROM cv")
def seq_accuracy(spark, sf):
    return metrics.sequence_accuracy(pairs(spark, sf).withColumn("pred", F.lower("target")), "pred", "target")


@query("metrics_table", f"""WITH gold AS (SELECT conv_id, turn, role, text, length(text) AS n FROM conversations),
       rows AS (SELECT role, text, n, CASE WHEN conv_id % 7 > 0 THEN 'user' END AS p_role,
         CASE WHEN conv_id % 7 > 0 THEN CASE WHEN turn % 2 = 0 THEN text ELSE upper(text) END END AS p_text,
         CASE WHEN turn > 0 THEN n END AS n_known, CASE WHEN turn > 0 THEN n + turn END AS n_pred, conv_id FROM gold),
       m AS (SELECT avg(coalesce(p_role = role, false)::INT) FILTER (role IS NOT NULL) AS accuracy,
         avg(coalesce({white('p_text')} = {white('text')}, false)::INT) FILTER (text IS NOT NULL) AS seq_accuracy,
         avg(coalesce(p_text = text, false)::INT) FILTER (text IS NOT NULL) AS exact_match,
         avg(pow(n_pred - n_known, 2)) AS mse, NULL::DOUBLE AS mse_missing,
         avg((p_text IS NULL)::INT) FILTER (text IS NOT NULL) AS missing,
         avg((p_text IS NOT NULL)::INT * 2) FILTER (p_text IS NOT NULL) AS gen_len FROM rows)
       """ + " UNION ALL ".join(f"SELECT '{m}' AS metric, round({m}::DOUBLE, 6) AS value FROM m" for m in (
           "accuracy", "seq_accuracy", "exact_match", "mse", "mse_missing", "missing", "gen_len")))
def metrics_table(spark, sf):
    """Predictions for six of seven conversations, joined to all references."""
    gold = table(spark, sf, "conversations").withColumn("n", F.char_length("text").cast("long"))
    made = gold.where(F.col("conv_id") % 7 > 0).select(
        "conv_id", "turn", F.lit("user").alias("p_role"),
        F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(F.upper("text")).alias("p_text"),
        (F.col("n") + 1).alias("p_n"), F.array(F.lit(5), F.lit(0), F.lit(6), F.lit(0)).alias("ids"))
    rows = gold.join(made, ["conv_id", "turn"], "left").withColumn("n_known", F.when(F.col("turn") > 0, F.col("n"))).withColumn(
        "n_pred", F.col("n_known") + F.col("turn"))
    return metrics.metrics_table(rows, {
        "accuracy": metrics.accuracy_of("p_role", "role"), "seq_accuracy": metrics.sequence_accuracy_of("p_text", "text"),
        "exact_match": metrics.accuracy_of("p_text", "text"), "mse": metrics.squared_error_of("n_pred", "n_known"),
        "mse_missing": metrics.squared_error_of("p_n", "n"), "missing": metrics.missing_share_of("p_text", "text"),
        "gen_len": metrics.generated_length_of("ids", 0)})


def grams(side: str, col: str, n: int) -> str:
    window = " || ' ' || ".join(f"t[i + {k}]" for k in range(n))
    return f"""{side} AS (SELECT row_id, {window} AS gram, count(*) AS n FROM (SELECT row_id, t, unnest(range(1, len(t) - {n - 2})) AS i
        FROM (SELECT row_id, {tok(col)} AS t FROM cv)) GROUP BY ALL)"""


def rouge_sql(n: int) -> str:
    return with_(CV, grams("gp", "prefix", n), grams("gr", "target", n)) + """,
    m AS (SELECT row_id, sum(least(gp.n, gr.n)) AS m FROM gp JOIN gr USING (row_id, gram) GROUP BY row_id),
    p AS (SELECT row_id, sum(n) AS p FROM gp GROUP BY row_id), r AS (SELECT row_id, sum(n) AS r FROM gr GROUP BY row_id)
    SELECT row_id, round(CASE WHEN coalesce(p, 0) + coalesce(r, 0) > 0 THEN 200.0 * coalesce(m, 0) / (coalesce(p, 0) + coalesce(r, 0))::DOUBLE ELSE 0 END, 6) AS rouge
    FROM cv LEFT JOIN m USING (row_id) LEFT JOIN p USING (row_id) LEFT JOIN r USING (row_id)"""


@query("rouge_n", rouge_sql(1))
def rouge_n(spark, sf):
    return metrics.rouge_n(pairs(spark, sf), "prefix", "target", 1)


@query("rouge_2", rouge_sql(2))
def rouge_2(spark, sf):
    return metrics.rouge_n(pairs(spark, sf), "prefix", "target", 2)


@query("rouge_l")
def rouge_l(spark, sf):
    return metrics.rouge_l(pairs(spark, sf), "prefix", "target")


STEPS_SQL = " + ".join(f"(v >= {step})::BIGINT" for step in rouge.WEIGHT_STEPS)


def rouge_corpus_sql() -> str:
    """Unstemmed overlap of one and two tokens with the bounds from the same weights."""
    rows = ", ".join(f"f{n} AS ({rouge_sql(n)})" for n in (1, 2))
    sums = ", ".join(f"sum(w * m{n}) / sum(w)::DOUBLE / 1e6 AS x{n}" for n in (1, 2))
    picks = " UNION ALL ".join(
        f"""SELECT 'rouge{n}' AS metric, (SELECT round(avg(m{n}) / 1e6, 4) FROM units) AS mean, round(quantile_cont(x{n}, 0.025), 4) AS low,
        round(quantile_cont(x{n}, 0.5), 4) AS mid, round(quantile_cont(x{n}, 0.975), 4) AS high FROM means""" for n in (1, 2))
    return f"""WITH {rows}, units AS (SELECT f1.row_id, round(f1.rouge * 1e6)::BIGINT AS m1, round(f2.rouge * 1e6)::BIGINT AS m2
        FROM f1 JOIN f2 USING (row_id)),
    hashes AS (SELECT m1, m2, b, md5('{rouge.SEED}:' || row_id || ':' || b) AS h FROM units, range({rouge.SAMPLES // rouge.PER_HASH}) t(b)),
    drawn AS (SELECT m1, m2, b * {rouge.PER_HASH} + j AS sample, ('0x' || substr(h, j * 4 + 1, 4))::BIGINT AS v FROM hashes, range({rouge.PER_HASH}) u(j)),
    means AS (SELECT {sums} FROM (SELECT sample, m1, m2, {STEPS_SQL} AS w FROM drawn) WHERE w > 0 GROUP BY sample)
    {picks}"""


@query("rouge_corpus", rouge_corpus_sql())
def rouge_corpus(spark, sf):
    both = materialize(rouge.pair_scores(pairs(spark, sf), "prefix", "target"), "pair_scores")
    return rouge.bootstrap(both, ["rouge1", "rouge2"])


@query("rouge_corpus_stemmed")
def rouge_corpus_stemmed(spark, sf):
    """All four scores on stems, with sentence-level subsequences."""
    return rouge.corpus_rouge(pairs(spark, sf), "prefix", "target")


@query("run_counts", base_sql("random") + SPLIT_SQL + """SELECT split || '_samples' AS metric, least(count(*),
       CASE split WHEN 'train' THEN 1000 WHEN 'dev' THEN 20 END) AS value FROM final GROUP BY split""")
def run_counts(spark, sf):
    from tailsplit.queries.splitting import split_random
    return metrics.run_counts(split_random(spark, sf), {"train": 1000, "dev": 20, "test": None})


# --- sequence preparation ----------------------------------------------------------------

VOCAB = "voc AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) + 1 AS id FROM uni)"


def joined(col: str) -> str:
    """An id list as text."""
    return f"array_to_string({col}, ',')"


def show(col):
    return F.array_join(F.transform(col, lambda i: i.cast("string")), ",")


def encoded_sql(name: str, src: str, columns: dict[str, str]) -> str:
    sides = " UNION ALL ".join(
        f"SELECT row_id, '{out}' AS out, unnest({tok(col)}) AS token, unnest(range(len({tok(col)}))) AS pos FROM {src}"
        for out, col in columns.items())
    picks = ", ".join(f"coalesce(list(id ORDER BY pos) FILTER (out = '{out}'), []) AS {out}" for out in columns)
    return f"""{name}_s AS ({sides}),
    {name} AS (SELECT s.row_id, {picks} FROM {src} s LEFT JOIN (SELECT row_id, out, pos, coalesce(id, 1) AS id
      FROM {name}_s LEFT JOIN voc USING (token)) USING (row_id) GROUP BY s.row_id)"""


DOC_IDS = with_(D, unigram("d"), VOCAB, encoded_sql("enc", "d", {"ids": "text"}))
PAIR_IDS = with_(TURNS, CV, unigram("turns"), VOCAB, encoded_sql("enc", "cv", {"a": "prefix", "b": "target"}))


def doc_ids(spark, sf):
    rows = docs(spark, sf)
    return seqprep.encode(rows, seqprep.vocabulary(lm.fit_unigram(rows).counts), {"ids": "text"})


def pair_ids(spark, sf):
    vocab = seqprep.vocabulary(lm.fit_unigram(turns(spark, sf)).counts)
    return seqprep.encode(pairs(spark, sf), vocab, {"a": "prefix", "b": "target"})


@query("encode_tokens", DOC_IDS + f"SELECT row_id, {joined('ids')} AS ids FROM enc")
def encode_tokens(spark, sf):
    return doc_ids(spark, sf).select("row_id", show("ids").alias("ids"))


@query("label_mask", PAIR_IDS + f"SELECT row_id, {joined('list_concat(list_transform(a, lambda x: -100), b)')} AS labels FROM enc")
def label_mask(spark, sf):
    segment = F.concat(F.transform("a", lambda _: F.lit(0)), F.transform("b", lambda _: F.lit(1)))
    return pair_ids(spark, sf).select("row_id", show(arrays.label_mask(F.concat("a", "b"), segment)).alias("labels"))


PADDED = DOC_IDS + """, bat AS (SELECT *, (row_number() OVER (ORDER BY row_id) - 1) // 8 AS batch_id FROM enc),
    wid AS (SELECT *, ((max(len(ids)) OVER (PARTITION BY batch_id) + 7) // 8) * 8 AS w FROM bat),
    pad AS (SELECT *, list_transform(range(w - len(ids)), lambda x: 0) AS zeros FROM wid)"""


@query("mask_pad_labels", PADDED + f"""SELECT row_id, {joined('list_concat(ids, list_transform(zeros, lambda x: -100))')} AS labels FROM pad""")
def mask_pad_labels(spark, sf):
    return padded(spark, sf).select("row_id", show(arrays.mask_pad(F.col("padded"), seqprep.PAD)).alias("labels"))


@query("unmask_labels", PADDED + f"SELECT row_id, {joined('list_concat(ids, zeros)')} AS ids FROM pad")
def unmask_labels(spark, sf):
    labels = arrays.mask_pad(F.col("padded"), seqprep.PAD)
    return padded(spark, sf).select("row_id", show(arrays.unmask(labels, seqprep.PAD)).alias("ids"))


def padded(spark, sf):
    rows = materialize(doc_ids(spark, sf), "ids")
    widths = batch_groups(rows.select("row_id", F.size("ids").alias("n")), {"width": "n"}, 8)
    return rows.join(widths, "row_id").select(
        "row_id", arrays.pad_to(F.col("ids"), arrays.round_up(F.col("width"), 8), seqprep.PAD).alias("padded"))


@query("gen_len", PADDED + "SELECT round(avg(len(ids)), 6) AS gen_len FROM pad")
def gen_len(spark, sf):
    return metrics.generated_length(padded(spark, sf), "padded", seqprep.PAD)


@query("pad_batch", PADDED + f"""SELECT row_id, batch_id, {joined('list_concat(zeros, ids)')} AS input_ids,
       {joined('list_concat(zeros, list_transform(ids, lambda x: 1))')} AS attention_mask,
       {joined('list_concat(ids, list_transform(zeros, lambda x: -100))')} AS labels,
       {joined('list_concat(list_transform(ids, lambda x: 1), zeros)')} AS labels_attention_mask FROM pad""")
def pad_batch(spark, sf):
    rows = doc_ids(spark, sf).withColumn("labels", F.col("ids"))
    out = seqprep.pad_batches(rows, "ids", "labels", 8)
    return out.select("row_id", "batch_id", *[show(c).alias(c) for c in (
        "input_ids", "attention_mask", "labels", "labels_attention_mask")])


LIMIT = 64


@query("truncate_pair", PAIR_IDS + f"""SELECT row_id, {joined(f'a[1:greatest({LIMIT} - len(b), 0)]')} AS first_only,
       CASE WHEN len(a) + len(b) <= {LIMIT} THEN len(a) WHEN least(len(a), len(b)) > {LIMIT // 2} THEN {LIMIT // 2}
            WHEN len(a) > len(b) THEN {LIMIT} - len(b) ELSE len(a) END AS kept_a,
       CASE WHEN len(a) + len(b) <= {LIMIT} THEN len(b) WHEN least(len(a), len(b)) > {LIMIT // 2} THEN {LIMIT // 2}
            WHEN len(a) > len(b) THEN len(b) ELSE {LIMIT} - len(a) END AS kept_b FROM enc""")
def truncate_pair(spark, sf):
    only, _ = arrays.truncate_first(F.col("a"), F.col("b"), LIMIT)
    both = arrays.truncate_longest(F.col("a"), F.col("b"), LIMIT)
    return pair_ids(spark, sf).select("row_id", show(only).alias("first_only"), F.size(both[0]).cast("long").alias("kept_a"),
                                      F.size(both[1]).cast("long").alias("kept_b"))


@query("cut_prompt", PAIR_IDS + f""", w AS (SELECT max(len(b)) AS w FROM enc)
       SELECT row_id, {joined('list_concat(b, list_transform(range(w - len(b)), lambda x: 0))')} AS generated FROM enc, w""")
def cut_prompt(spark, sf):
    rows = materialize(pair_ids(spark, sf), "ids")
    width = rows.agg(F.max(F.size("b"))).first()[0]
    cut = arrays.cut_prompt(F.concat("a", "b"), F.size("a"), F.lit(width), seqprep.PAD)
    return rows.select("row_id", show(cut).alias("generated"))


@query("concat_prompt_target", PAIR_IDS + f"""SELECT row_id, {joined('list_concat(a, b)')} AS ids,
       {joined('list_concat(list_transform(a, lambda x: -100), b)')} AS labels FROM enc""")
def concat_prompt_target(spark, sf):
    ids, labels = arrays.concat_prompt_target(F.col("a"), F.col("b"))
    return pair_ids(spark, sf).select("row_id", show(ids).alias("ids"), show(labels).alias("labels"))
