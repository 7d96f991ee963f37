"""Language identification by Bayesian fusion of evidence.

The posterior of a language multiplies the likelihood of the text (letter trigrams), of the declared markup language
and of the address suffix with a prior of the host. All tables come from the whole corpus by grouped aggregation: the
trigrams under the languages declared, the rest from the expected language of every text. A host's prior is smoothed
towards that of its domain and this towards the whole corpus; a row's own text does not count in the prior it gets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tailsplit.llm.textblock import (END_CLASS, LETTER, char_classes, code_points, documents_of, release_memory,
                                     text_blocks)
from tailsplit.operators.joins import lookup
from tailsplit.scratch import materialize

BUCKETS = 1 << 16
TEMPER = 0.1  # trigrams depend on each other: their evidence counts by this power
KAPPA = 5.0  # rows' worth of the level above in a smoothed level
ALPHA = 0.5  # added to each count of declared languages and suffixes
ACCEPT = 0.5  # least posterior of an identified text
LANGUAGES = 64  # so many declared codes are told apart by default
OTHER_CODES = "other"  # the language of all other codes


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of all letter trigrams; what is no letter counts as a blank, and a trigram has a letter."""
    codes = code_points([t.lower() for t in texts])
    kinds = char_classes()[codes]
    letter = kinds == LETTER
    plain = np.where(letter, codes, np.uint32(32)).astype(np.uint32)
    if len(codes) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ends = kinds == END_CLASS
    use = (letter[:-2] | letter[1:-1] | letter[2:]) & ~(ends[:-2] | ends[1:-1])
    mixed = (plain[:-2] * np.uint32(0x9E3779B1)) ^ (plain[1:-1] * np.uint32(0x85EBCA6B)) ^ (plain[2:] * np.uint32(0xC2B2AE35))
    mixed ^= mixed >> np.uint32(15)
    at = np.flatnonzero(use)
    return ((mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(16))[at].astype(np.int64), documents_of(codes, at)


def declared_code(column: Column) -> Column:
    """The primary code of a declared language in lower case, null if it is none of two or three letters."""
    code = F.lower(F.regexp_extract(F.trim(column), "^([A-Za-z]{2,3})(?:$|[-_])", 1))
    return F.when(code != "", code)


def host_of(address: Column) -> Column:
    host = F.lower(F.regexp_extract(address, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def declared_in(page: Column) -> Column:
    """The language that a page's html element declares."""
    return F.regexp_extract(page, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z_-]+)", 1)


def fit_text(rows: DataFrame, languages: list[str], text: str) -> np.ndarray:
    """log P(bucket | language), one row a language, from all texts that declare one of the languages."""
    place = {code: i for i, code in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}  # only for languages that the task meets
        for batch in batches:
            said = [place[x] for x in batch.column("__declared").to_pylist()]
            for row, texts in text_blocks(batch.column("__text")):
                bucket, text = trigrams(texts)
                met, own = np.unique(np.array(said[row:row + len(texts)], np.int64), return_inverse=True)
                found = np.bincount(own[text] * BUCKETS + bucket, minlength=len(met) * BUCKETS).reshape(-1, BUCKETS)
                for i, line in zip(met.tolist(), found):
                    counts[i] = counts[i] + line if i in counts else line
        for i, line in counts.items():
            there = np.flatnonzero(line)
            yield pa.record_batch([pa.array(np.full(len(there), i)), pa.array(there), pa.array(line[there])],
                                  ["l", "bucket", "n"])

    told = rows.where(F.col("__declared").isin(languages)).select(F.col(text).alias("__text"), "__declared")
    total = np.zeros((len(languages), BUCKETS))
    # At most BUCKETS rows for each language come back, however large the corpus.
    for r in told.mapInArrow(run, "l long, bucket long, n long").groupBy("l", "bucket").agg(F.sum("n").alias("n")).collect():
        total[r.l, r.bucket] = r.n
    return np.log((total + 0.5) / (total + 0.5).sum(1, keepdims=True)).astype(np.float32)


def text_evidence(rows: DataFrame, model: np.ndarray, text: str) -> DataFrame:
    """All columns with ``__ll`` (tempered log likelihood of each language), ``__p`` (its probability by the text alone,
    null without letters) and ``__grams``."""
    values = T.ArrayType(T.DoubleType())
    schema = T.StructType([*rows.schema.fields, T.StructField("__ll", values), T.StructField("__p", values),
                           T.StructField("__grams", T.LongType())])
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for batch in batches:
            found, grams = [], []
            for _, texts in text_blocks(batch.column(at)):
                bucket, own = trigrams(texts)
                sums = np.stack([np.bincount(own, line[bucket], len(texts)) for line in model], 1) * TEMPER
                found.append(sums - sums.max(1, keepdims=True))
                grams.append(np.bincount(own, minlength=len(texts)))
            logs = np.concatenate(found) if found else np.empty((0, len(model)))
            count = np.concatenate(grams).astype(np.int64) if grams else np.empty(0, np.int64)
            yield pa.record_batch([*batch.columns, _lists(logs), _lists(softmax(logs), count == 0), pa.array(count)],
                                  schema.names)

    return rows.mapInArrow(run, schema)


def _lists(rows: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()),
                                    mask=None if missing is None else pa.array(missing))


def _matrix(column: pa.Array, k: int) -> np.ndarray:
    """The lists as rows of k numbers; a null list is all 0."""
    out = np.zeros((len(column), k))
    there = column.is_valid().to_numpy(zero_copy_only=False)
    out[there] = column.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
    return out


def softmax(logs: np.ndarray) -> np.ndarray:
    raw = np.exp(logs - logs.max(1, keepdims=True))
    return raw / raw.sum(1, keepdims=True)


def fuse(told: DataFrame, columns: list[str], languages: list[str], base_rate: np.ndarray) -> DataFrame:
    """The columns with the most probable language by all evidence, its posterior, and whether it is accepted."""
    k, names = len(languages), np.array(languages, object)
    source = told.select(*[F.col(f"`{c}`") for c in columns], "__ll", "__p", "__grams", "n", "up", "ls", "ld")
    schema = T.StructType([*[source.schema[c] for c in columns], T.StructField("language", T.StringType()),
                           T.StructField("posterior", T.DoubleType()), T.StructField("accepted", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logs, own, n, up, ls, ld = (_matrix(batch.column(c), k) for c in ("__ll", "__p", "n", "up", "ls", "ld"))
            up[up.sum(1) == 0] = base_rate
            others = np.maximum(n - own * (n.sum(1, keepdims=True) > 0), 0.0)
            prior = (others + KAPPA * up) / (others.sum(1, keepdims=True) + KAPPA)
            post = softmax(logs + np.log(prior) + ls + ld) if len(logs) else logs
            best = post.argmax(1)
            value = post[np.arange(len(post)), best]
            lettered = batch.column("__grams").to_numpy() > 0
            yield pa.record_batch([*batch.columns[:len(columns)], pa.array(names[best], pa.string()), pa.array(value),
                                   pa.array(lettered & (value >= ACCEPT))], schema.names)

    return source.mapInArrow(run, schema)


def _sums(cells: DataFrame, key: str, k: int) -> DataFrame:
    named = cells.where(F.col(key).isNotNull()) if key else cells
    return (named.groupBy(key) if key else named.groupBy()).agg(*[F.sum(f"p{i}").alias(f"p{i}") for i in range(k)])


def _array(k: int) -> Column:
    return F.array(*[F.coalesce(F.col(f"p{i}"), F.lit(0.0)) for i in range(k)])


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def _smooth(counts: Column, above: Column) -> Column:
    return F.zip_with(counts, above, lambda n, p: (n + KAPPA * p) / (_total(counts) + KAPPA))


def identify(rows: DataFrame, text: str = "text", declared: str = "lang", host: str = "source",
             languages: list[str] | None = None) -> DataFrame:
    """All columns of ``rows`` with ``language``, ``posterior`` and ``accepted``.

    ``declared`` names a column with a declared language and ``host`` one with a host name. A host with a dot has a
    suffix (its last label) and a domain (the last two). ``languages`` are those to tell apart, by default the LANGUAGES
    codes that most rows declare; if there are more, the rows with any other code make up one more language, called
    OTHER_CODES. A row is accepted if its text has letters and the posterior of its language is at least ``ACCEPT``. A text
    that is null, empty or without letters is judged by the other evidence and not accepted; null or malformed
    declarations, suffixes and hosts say nothing. Repeated rows are judged each. Without any language the result columns
    are null and nothing is accepted. Columns that are called as the results are replaced.
    """
    plain = rows.drop("language", "posterior", "accepted")
    columns = plain.columns
    name = F.lower(F.trim(F.col(f"`{host}`")))
    labels = F.when(name.contains("."), F.split(name, r"\."))
    base = plain.withColumns({
        "__declared": declared_code(F.col(f"`{declared}`")), "__host": F.when(name != "", name),
        "__suffix": F.element_at(labels, -1), "__domain": F.concat_ws(".", F.slice(labels, -2, 2))})
    base = base.withColumn("__domain", F.when(F.col("__domain") != "", F.col("__domain")))
    if languages is None:
        # Codes have two or three letters, so that there are 18,252 of them at most.
        said = base.where("__declared is not null").groupBy("__declared").count().collect()
        often = [r["__declared"] for r in sorted(said, key=lambda r: (-r["count"], r["__declared"]))]
        languages = sorted(often[:LANGUAGES])
        if len(often) > LANGUAGES:
            common = F.col("__declared").isin(languages)
            base = base.withColumn("__declared", F.when(common | F.col("__declared").isNull(), F.col("__declared"))
                                   .otherwise(F.lit(OTHER_CODES)))
            languages.append(OTHER_CODES)
    k = len(languages)
    if not k:
        return plain.select("*", F.lit(None).cast("string").alias("language"),
                            F.lit(None).cast("double").alias("posterior"), F.lit(False).alias("accepted"))
    seen = text_evidence(base, fit_text(base, languages, text), text)

    narrow = seen.select("__declared", "__suffix", "__domain", "__host", F.col("__p").alias("p"))
    cells = materialize(narrow.where("p is not null").groupBy("__declared", "__suffix", "__domain", "__host").agg(
        *[F.sum(F.col("p")[i]).alias(f"p{i}") for i in range(k)]), "cells")
    whole = [float(x or 0.0) for x in _sums(cells, "", k).first()]
    base_rate = F.array(*[F.lit((n + 1.0) / (sum(whole) + k)) for n in whole])
    every = F.array(*[F.lit(n) for n in whole])

    def likelihoods(key: str, column: str) -> DataFrame:
        """log P(value | language) of every value of a column, with some room for values never seen."""
        values = _sums(cells, key, k)
        kinds = values.count() + 1
        return values.select(key, F.zip_with(_array(k), every, lambda n, t: F.log((n + ALPHA) / (t + ALPHA * kinds))).alias(column))

    domains = _sums(cells, "__domain", k).select("__domain", _smooth(_array(k), base_rate).alias("up"))
    hosts = cells.groupBy("__host", "__domain", "__suffix").agg(*[F.sum(f"p{i}").alias(f"p{i}") for i in range(k)])
    hosts = hosts.where(F.col("__host").isNotNull()).withColumn("n", _array(k)).join(domains, "__domain", "left").join(
        likelihoods("__suffix", "ls"), "__suffix", "left")
    hosts = materialize(hosts.select("__host", "n", F.coalesce("up", base_rate).alias("up"), "ls",
                                     _total(F.col("n")).alias("rows")), "hosts")
    told = lookup(seen, hosts, ["__host"], freq="rows", spread_by=["__host", "__grams", text])
    told = told.join(F.broadcast(likelihoods("__declared", "ld")), "__declared", "left")

    return fuse(told, columns, languages, np.array([(n + 1.0) / (sum(whole) + k) for n in whole]))
