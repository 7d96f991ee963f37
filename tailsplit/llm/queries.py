"""The registered queries of the operators in this folder, and their SQL where SQL can express them.

Each query applies its operator with production parameters to a whole table and derives the result columns from it.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tailsplit.llm import (bpe, html_text, langid, packing, prefixes, sharding, simhash, spelling, substring, topk,
                           toxicity, vectors, warc)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op3_packing(spark: SparkSession, sf: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return packing.pack(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024, 0)


@query
def op8_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """All documents encoded and decoded."""
    return bpe.round_trip_digests(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@query
def op6_simhash(spark: SparkSession, sf: str) -> DataFrame:
    """All documents by fingerprints that differ in at most 4 bits."""
    found = simhash.near_duplicates(table(spark, sf, "documents"), words=4, bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op5_substring(spark: SparkSession, sf: str) -> DataFrame:
    """All documents without windows of 20 words that also start earlier."""
    found = substring.remove_repeats(table(spark, sf, "documents"), 20)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL["op5_substring"] = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, len(w)::BIGINT AS n_words, w, unnest(range(1, len(w) - 18)) AS s FROM words),
windows AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS span FROM starts),
judged AS (SELECT doc_id, s, row_number() OVER (PARTITION BY span ORDER BY doc_id, s) > 1 AS again FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM judged WHERE again),
lists AS (SELECT doc_id, list(i) AS removed FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(removed), 0)::BIGINT AS n_removed,
       sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(removed, []), i)), ' ')) AS kept_sha256
FROM words LEFT JOIN lists USING (doc_id)"""


@query
def op7_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The 10 best of all vectors for every hundredth one."""
    return topk.top_k(table(spark, sf, "embeddings"), F.col("id") % 100 == 0, k=10, scale=1024)


SQL["op7_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS w FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
terms AS (SELECT vec_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM v),
scores AS (SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score
           FROM terms q JOIN terms c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY ALL),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank,
                  vec_id, score FROM scores)
SELECT * FROM ranked WHERE rank <= 10"""


@query
def op10_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """All vectors against those of their label, cosine 0.93."""
    return vectors.near_duplicates(table(spark, sf, "embeddings"), limit=0.93)


SQL["op10_vectors"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
          WHERE list_cosine_similarity(a.w, b.w) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(degree.n, 0)::BIGINT AS n_links, coalesce(component_id, e.vec_id) AS component_id,
       coalesce(component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN least ON least.a = e.vec_id LEFT JOIN degree ON degree.a = e.vec_id"""


@query
def op9_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """The toxicity of all documents, learnt from the labelled ones that are not held out."""
    docs = table(spark, sf, "documents")
    model = toxicity.fit(docs, table(spark, sf, "labels"))
    return toxicity.score(docs, model, columns=["doc_id"]).select(
        "doc_id", toxicity.held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op2_html(spark: SparkSession, sf: str) -> DataFrame:
    """The main text of all pages."""
    return html_text.extract(table(spark, sf, "pages")).select("page_id", "url", "text", "n_chars")


def crawl(spark: SparkSession, sf: str) -> DataFrame:
    """Pages and documents with the evidence of their language; a document's source stands for its host."""
    pages = table(spark, sf, "pages").withColumns(
        {"lang": langid.declared_in(F.col("html")), "source": langid.host_of(F.col("url"))})
    pages = html_text.extract(pages).select(F.lit(None).cast("long").alias("doc_id"), "page_id", "text", "lang", "source")
    documents = table(spark, sf, "documents").select(
        "doc_id", F.lit(None).cast("long").alias("page_id"), "text", "lang", "source")
    return documents.unionByName(pages)


@query
def op1_langid(spark: SparkSession, sf: str) -> DataFrame:
    """The language of all pages and documents."""
    found = langid.identify(crawl(spark, sf))
    return found.select("doc_id", "page_id", F.col("source").alias("host"), F.col("lang").alias("declared"), "language",
                        F.round("posterior", 6).alias("posterior"), "accepted")


ARCHIVE_PAGES = 4096


def replicas(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All pages as records of archives, and a replica in which records are lost, cut short or altered by their address.

    One archive holds the pages of 4096 consecutive ids. Pages without an id are dealt out by their hash to archives of
    their own. Rows that repeat an id, address and text are one record.
    """
    record = warc.record_of(F.col("url"), F.col("html"))
    fate = F.conv(F.substring(F.md5(F.coalesce("url", F.lit("")).cast("binary")), 1, 4), 16, 10).cast("int") % 100
    harmed = F.when(fate == 1, F.substring(record, 1, 100)).when(fate == 2, F.concat(record, F.lit(" "))).otherwise(record)
    rows = table(spark, sf, "pages").select(
        F.col("page_id").cast("long").alias("page_id"), F.octet_length(record).cast("long").alias("length"),
        warc.record_hash(record).alias("digest"), warc.record_hash(F.when(fate != 0, harmed)).alias("copy")).distinct()
    own = F.concat(F.lit("x"), F.pmod(F.crc32(F.col("digest").cast("binary")), F.lit(4096)).cast("string"))
    named = rows.withColumn("archive", F.coalesce(F.floor(F.col("page_id") / ARCHIVE_PAGES).cast("string"), own))
    laid = warc.materialize(warc.lay_out(named, "archive", ["page_id", "digest"], "length"), "records")
    return laid.drop("copy"), laid.where(F.col("copy").isNotNull()).select("archive", "offset", F.col("copy").alias("digest"))


@query
def op4_warc(spark: SparkSession, sf: str) -> DataFrame:
    """The records of all pages that differ between two replicas, found from the roots down."""
    original, replica = replicas(spark, sf)
    found = warc.audit(original, replica)
    return original.join(found, ["archive", "offset"]).select(
        "page_id", "archive", "offset", "length", "kind", "left_hash", "right_hash")


SQL["op4_warc"] = r"""
WITH raw AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
records AS (SELECT DISTINCT page_id, url, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10)
  || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10)
  || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM raw),
laid AS (SELECT page_id, url, record, strlen(record)::BIGINT AS length, sha256(record) AS digest,
                (page_id // 4096)::VARCHAR AS archive FROM records),
placed AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY archive ORDER BY page_id, digest
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM laid),
fates AS (SELECT *, ('0x' || md5(url)[1:4])::INT % 100 AS fate FROM placed)
SELECT page_id, archive, "offset", length, CASE fate WHEN 0 THEN 'missing' ELSE 'changed' END AS kind, digest AS left_hash,
       CASE fate WHEN 1 THEN sha256(record[1:100]) WHEN 2 THEN sha256(record || ' ') END AS right_hash
FROM fates WHERE fate < 3"""


@query
def op11_sharding(spark: SparkSession, sf: str) -> DataFrame:
    """All documents in 16 shards that match the mixture of the sources."""
    return sharding.shard(table(spark, sf, "documents"), shards=16)


# crc32 in SQL: the table of its 256 steps by the polynomial, and a text's bytes folded over it.
CRC_TABLE = """crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8),
  lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS steps)"""


def crc32_sql(text: str) -> str:
    octets = f"list_transform(regexp_extract_all(hex({text}), '..'), lambda x: ('0x' || x)::BIGINT)"
    fold = f"list_reduce({octets}, lambda c, y: xor(c // 256, steps[xor(c, y) % 256 + 1]), 4294967295::BIGINT)"
    return f"xor({fold}, 4294967295::BIGINT)"


SQL["op11_sharding"] = f"""
WITH {CRC_TABLE},
rows AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 1 AS size, {crc32_sql("coalesce(text, '')")} AS text_crc32,
                coalesce('s' || source, 'none') AS stratum, md5('42:' || doc_id) AS turn FROM documents, crc),
ranked AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY turn, doc_id, text_crc32, size) AS rank,
                  count(*) OVER (PARTITION BY stratum) AS total FROM rows),
placed AS (SELECT *, row_number() OVER (ORDER BY (2 * rank - 1)::DOUBLE / (2 * total)::DOUBLE, turn, doc_id, text_crc32, size,
                  stratum) - 1 AS place, count(*) OVER () AS n FROM ranked)
SELECT doc_id, size, text_crc32, 'rows' AS law, (place * 16 // n)::INT AS shard,
       (place - (place * 16 // n * n + 15) // 16)::BIGINT AS slot, NULL::INT AS grown_shard FROM placed"""


@query
def op12_spelling(spark: SparkSession, sf: str) -> DataFrame:
    """All words of the documents with the form that they vary."""
    return spelling.variants(table(spark, sf, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


SQL["op12_spelling"] = rf"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS raw FROM documents),
lowered AS (SELECT doc_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
            FROM runs WHERE length(raw) >= 7 GROUP BY ALL),
hashed AS (SELECT run, n, {crc32_sql("concat(doc_id, ':', run)")} AS h FROM lowered, crc),
spelt AS (SELECT CASE WHEN h % 31 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
places AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words),
holes AS (SELECT DISTINCT word, i, word[1:i - 1] || '_' || word[i + 1:] AS mask FROM places),
shorter AS (SELECT DISTINCT word, word[1:i - 1] || word[i + 1:] AS short FROM places),
near AS (SELECT a.word, b.word AS other FROM holes a JOIN holes b ON a.mask = b.mask AND a.i = b.i AND a.word <> b.word
         UNION SELECT s.word, w.word FROM shorter s JOIN words w ON w.word = s.short
         UNION SELECT w.word, s.word FROM shorter s JOIN words w ON w.word = s.short),
ranked AS (SELECT near.word, other, n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near,
                  row_number() OVER (PARTITION BY near.word ORDER BY n DESC, other) AS r FROM near JOIN words ON words.word = other),
joined AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form,
                  CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n
           FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.r = 1),
chain AS (SELECT word, word AS link FROM joined
          UNION ALL SELECT chain.word, joined.form FROM chain JOIN joined ON joined.word = link WHERE joined.form IS NOT NULL),
roots AS (SELECT chain.word, link AS root FROM chain JOIN joined ON joined.word = link WHERE joined.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM joined JOIN roots USING (word)"""


@query
def op13_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return prefixes.prefix_trie(table(spark, sf, "conversations"))


SQL["op13_prefixes"] = rf"""
WITH {CRC_TABLE},
turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                   md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
          FROM conversations WHERE conv_id IS NOT NULL),
numbers AS (SELECT DISTINCT conv_id FROM turns),
convs AS (SELECT conv_id, {crc32_sql("conv_id::VARCHAR")} % 6 AS h FROM numbers, crc),
heads AS (SELECT c.conv_id, t.place, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 100
          WHERE t.place <= c.h),
tails AS (SELECT c.conv_id, t.place - c.h + (SELECT count(*) FROM heads x WHERE x.conv_id = c.conv_id) AS place, t.role, t.text
          FROM convs c JOIN turns t USING (conv_id) WHERE t.place > c.h),
rebuilt AS (SELECT * FROM heads UNION ALL SELECT * FROM tails),
lists AS (SELECT conv_id, list({{'r': role, 't': text}} ORDER BY place) FILTER (place IS NOT NULL) AS turns
          FROM convs LEFT JOIN rebuilt USING (conv_id) GROUP BY conv_id),
whole AS (SELECT conv_id, coalesce(turns, []) AS turns FROM lists),
occ AS (SELECT conv_id, d AS depth, turns[1:d] AS path, d = len(turns) AS last,
               CASE WHEN d > 0 THEN length(turns[d].t) ELSE 0 END AS chars
        FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM whole)),
tops AS (SELECT *, min(conv_id) OVER (PARTITION BY path) AS top FROM occ),
nodes AS (SELECT top, depth, min(chars) AS chars, count(*) AS n_convs,
                 coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '') AS ends FROM tops GROUP BY top, depth),
ups AS (SELECT n.*, p.top AS up FROM nodes n LEFT JOIN tops p ON p.conv_id = n.top AND p.depth = n.depth - 1),
kids AS (SELECT up AS top, depth - 1 AS depth, count(*) AS n FROM ups WHERE depth > 0 GROUP BY ALL),
full_nodes AS (SELECT ups.*, coalesce(kids.n, 0) AS n_children FROM ups LEFT JOIN kids USING (top, depth)),
sums AS (SELECT a.top, a.depth, count(*) FILTER (f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.chars) AS saved
         FROM full_nodes f JOIN tops a ON a.conv_id = f.top AND a.depth <= f.depth GROUP BY ALL)
SELECT top AS conv_id, depth::BIGINT AS depth, up AS parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children,
       n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(ends) AS ends_sha256
FROM full_nodes JOIN sums USING (top, depth)"""
