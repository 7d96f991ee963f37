import math
import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tailsplit.operators import joins, lm, windows

TEXTS = ["the cat sat on the mat", "the dog sat", "", "a, b; the the the", "rare words only once", None]


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    many = [" ".join(r.choices(words, weights=range(40, 0, -1), k=r.randint(1, 30))) for _ in range(60)]
    return spark.createDataFrame(list(enumerate([*TEXTS, *many])), "row_id long, text string")


def toks(text):
    import regex
    return regex.findall(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]", (text or "").lower())


def models(rows):
    uni, pairs, ctx = Counter(), Counter(), Counter()
    for text in rows:
        t = toks(text)
        uni.update(t)
        pairs.update(zip(t, t[1:], strict=False))
        ctx.update(t[:-1])
    return uni, pairs, ctx


def p1(uni, t):
    return (uni[t] + 1) / (sum(uni.values()) + len(uni))


def p2(m, c, t):
    uni, pairs, ctx = m
    return p1(uni, t) if not ctx[c] else 0.7 * pairs[c, t] / ctx[c] + 0.3 * p1(uni, t)


def paths(monkeypatch, small):
    if not small:
        monkeypatch.setattr(joins, "BROADCAST_ROWS", 3)
        monkeypatch.setattr(joins, "HEAD_ROWS", 5)


@pytest.mark.parametrize("small", [True, False])
def test_score_text(corpus, monkeypatch, small):
    paths(monkeypatch, small)
    rows = {r["row_id"]: r["text"] for r in corpus.collect()}
    uni, _, _ = models(rows.values())
    got = lm.score_text(corpus, lm.fit_unigram(corpus)).collect()
    assert len(got) == len(rows)
    for r in got:
        t = toks(rows[r["row_id"]])
        ll = sum(math.log(p1(uni, x)) for x in t)
        assert r["n_tokens"] == len(t)
        assert abs(r["ll_score"] - ll) < 2e-6
        assert r["ppl_score"] is None if not t else abs(r["ppl_score"] - math.exp(-ll / len(t))) < 1e-5


@pytest.mark.parametrize("small", [True, False])
def test_score_conditional(spark, corpus, monkeypatch, small):
    paths(monkeypatch, small)
    m = models([r["text"] for r in corpus.collect()])
    pairs = [(0, "the cat", "sat on"), (1, "", "the dog"), (2, "unseen thing", "the zebra"), (3, "the", "")]
    got = lm.score_conditional(spark.createDataFrame(pairs, "row_id long, prefix string, target string"),
                               lm.fit_bigram(corpus)).collect()
    for r in got:
        _, prefix, target = pairs[r["row_id"]]
        seq = [(toks(prefix) or [None])[-1], *toks(target)]
        ll = sum(math.log(p2(m, c, t)) for c, t in zip(seq, seq[1:], strict=False))
        assert abs(r["ll_score"] - ll) < 2e-6
        assert r["n_tokens"] == len(seq) - 1


def test_bigram_counts(corpus):
    uni, pairs, ctx = models([r["text"] for r in corpus.collect()])
    model = lm.fit_bigram(corpus)
    assert {r["token"]: r["n"] for r in model.unigram.counts.collect()} == dict(uni)
    assert {(r["ctx"], r["token"]): r["n_pair"] for r in model.pairs.collect()} == dict(pairs)
    assert {r["ctx"]: r["n_ctx"] for r in model.contexts.collect()} == {k: v for k, v in ctx.items() if v}


@pytest.mark.parametrize("k", [1, 3, 10])
def test_top_next_tokens_is_exact(corpus, k):
    m = models([r["text"] for r in corpus.collect()])
    got = lm.top_next_tokens(lm.fit_bigram(corpus), k=k).toPandas()
    for ctx, mine in got.groupby("ctx"):
        want = sorted(m[0], key=lambda t: (-round(p2(m, ctx, t), 9), t))[:k]
        assert mine.sort_values("next_rank")["token"].tolist() == want


def test_last_word(corpus):
    m = models([r["text"] for r in corpus.collect()])
    got = {r["row_id"]: r for r in lm.score_last_word(corpus, lm.fit_bigram(corpus)).filter("row_id < 2").collect()}
    assert got[0]["token"] == "mat" and got[0]["ctx"] == "the"
    assert abs(got[0]["ll"] - math.log(p2(m, "the", "mat"))) < 2e-6


@pytest.mark.parametrize("broadcast_rows", [500_000, 0])
def test_last_word_rows(spark, corpus, monkeypatch, broadcast_rows):
    from tailsplit.operators import joins

    monkeypatch.setattr(joins, "BROADCAST_ROWS", broadcast_rows)
    m = models([r["text"] for r in corpus.collect()])
    model = lm.fit_bigram(corpus)
    texts = [(1, "the cat saw the"), (2, "zebra the"), (3, "the"), (4, ""), (5, None), (6, "on the mat.the never-seen"), (7, "the  ")]
    found = lm.last_word_rows(spark.createDataFrame(texts, "row_id long, text string"), model, k=4).collect()
    got = {(r["row_id"], r["pos"]): r for r in found}
    contexts = {(1, 0): "saw", (2, 0): "zebra", (3, 0): None, (6, 0): "the", (6, 1): "never", (6, 2): "-"}
    assert len(found) == len(got) and set(got) == set(contexts)
    for place, ctx in contexts.items():
        best = sorted(m[0], key=lambda t: (-round(p2(m, ctx, t), 9), t))[:4]
        r = got[place]
        assert r["alternatives"] == best[::-1]
        assert r["token_rank"] == (best.index(r["token"]) + 1 if r["token"] in best else None)
        assert abs(r["ll"] - math.log(p2(m, ctx, r["token"]))) < 2e-6


def test_strided_windows(corpus):
    m = models([r["text"] for r in corpus.collect()])
    rows = {r["row_id"]: toks(r["text"]) for r in corpus.collect()}
    got = windows.score_strided(corpus, lm.fit_bigram(corpus), stride=4, max_len=6).collect()
    for r in got:
        t, ll = rows[r["row_id"]], 0.0
        for start in range(0, len(t), 4):
            begin = max(start + 4 - 6, 0)
            for pos in range(start, min(start + 4, len(t))):
                ll += math.log(p2(m, t[pos - 1] if pos > begin else None, t[pos]))
        assert abs(r["ll_score"] - ll) < 2e-6
        assert r["n_windows"] == -(-len(t) // 4)


def test_token_windows_cover_each_token_once(corpus):
    got = windows.token_windows(corpus, stride=4, max_len=6).toPandas()
    rows = {r["row_id"]: len(toks(r["text"])) for r in corpus.collect()}
    for row_id, n in rows.items():
        mine = got[got["row_id"] == row_id].sort_values("window_start")
        assert mine["n_scored"].sum() == n
        assert ((mine["end_loc"] - mine["begin_loc"]) <= 6).all()


def test_corpus_windows(corpus):
    rows = [toks(r["text"]) for r in corpus.orderBy("row_id").collect()]
    stream = [t for r in rows for t in r]
    uni = Counter(stream)
    got = windows.corpus_windows(corpus, lm.fit_unigram(corpus), stride=16, max_len=32).orderBy("window_start").collect()
    assert [r["window_start"] for r in got] == list(range(0, len(stream), 16))
    for r in got:
        part = stream[r["window_start"]:r["end_loc"]]
        assert abs(r["ll"] - sum(math.log(p1(uni, t)) for t in part)) < 2e-6


def test_score_does_not_depend_on_partitions(corpus):
    model = lm.fit_unigram(corpus)
    one = lm.score_text(corpus.coalesce(1), model).orderBy("row_id").collect()
    many = lm.score_text(corpus.repartition(11), lm.fit_unigram(corpus.repartition(7))).orderBy("row_id").collect()
    assert one == many


def test_external_model_is_loaded_per_task_and_batched(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(1, 8)], "row_id long, text string").coalesce(1)

    def load():
        def score(frame: pd.DataFrame):
            assert len(frame) <= 3
            return [-float(len(t)) for t in frame["text"]], [len(t) for t in frame["text"]]
        return score
    got = lm.score_external(df, load, ["text"], batch_rows=3).orderBy("row_id").collect()
    assert [r["ll_score"] for r in got] == [-float(i) for i in range(1, 8)]
    assert all(abs(r["ppl_score"] - math.e) < 1e-5 for r in got)


def test_summary(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0), (1, 3.0, None), (2, 2.0, 4.0)], "row_id long, ll_score double, ppl_score double")
    got = {r["score"]: r for r in lm.score_summary(df).collect()}
    assert (got["ll_score"]["median_value"], got["ll_score"]["mean_value"]) == (2.0, 2.0)
    assert (got["ppl_score"]["median_value"], got["ppl_score"]["max_value"]) == (3.0, 4.0)


def test_perplexity_overflow(spark):
    row = spark.range(1).select(lm.safe_exp(F.lit(800.0)).alias("a"), lm.safe_exp(F.lit(1.0)).alias("b")).first()
    assert row["a"] == float("inf") and abs(row["b"] - math.e) < 1e-12


def test_corpus_perplexity_outgrows_a_long(spark):
    lp = -9_000_000_000_000_000_000
    row = lm.corpus_perplexity(spark.createDataFrame([(lp,)] * 4, "lp long")).first()
    assert (row.n_tokens, row.mean_ll) == (4, lp / 1e9)


@pytest.mark.parametrize("limit", [joins.BROADCAST_ROWS, 0])
def test_unseen_pairs_and_one_exchange_of_the_occurrences(spark, monkeypatch, limit):
    """Pairs, tokens and contexts the model never saw, with and without broadcasts."""
    monkeypatch.setattr(joins, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(joins, "HEAD_ROWS", 4)
    seen = spark.createDataFrame([(1, "a b c a b"), (2, "b a"), (3, None), (4, "")], "row_id long, text string")
    model = lm.fit_bigram(seen)
    uni = {r["token"]: r["n"] for r in model.unigram.counts.collect()}
    big = {(r["ctx"], r["token"]): r["n_pair"] for r in model.pairs.collect()}
    ctx = {r["ctx"]: r["n_ctx"] for r in model.contexts.collect()}
    asked = [(c, t) for c in (None, "a", "b", "c", "z") for t in ("a", "b", "c", "z", None)]
    occ = spark.createDataFrame([(i, c, t) for i, (c, t) in enumerate(asked)], "row_id long, ctx string, token string")
    out = lm.with_bigram_lp(occ, model, ["row_id"])
    assert out.columns == ["row_id", "ctx", "token", "lp"]
    got = {r["row_id"]: r["lp"] for r in out.collect()}
    assert len(got) == out.count() == len(asked)
    for i, (c, t) in enumerate(asked):
        base = (uni.get(t, 0) + 1.0) / (sum(uni.values()) + len(uni))
        p = base if c not in ctx else 0.7 * (big.get((c, t), 0) / ctx[c]) + (1 - 0.7) * base
        assert got[i] == (None if t is None else round(math.log(p) * 1e9)), (c, t)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def many_texts(spark):
    texts = [(i, " ".join(f"w{(i * j) % 23}" for j in range(i % 40)) + " the end") for i in range(60)]
    return spark.createDataFrame([*texts, (60, None), (61, "")], "row_id long, text string")


def test_windows_of_a_corpus_add_up_frequent_tokens_before_the_shuffle(spark, monkeypatch):
    """a vocabulary beyond broadcast size gives the same windows, without a shuffled row per token."""
    from tailsplit.operators import windows

    df = many_texts(spark)
    model = lm.fit_unigram(df)
    want = sorted(windows.corpus_windows(df, model, stride=16, max_len=32).collect())
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(joins, "HEAD_ROWS", 5)
    got = windows.corpus_windows(df, model, stride=16, max_len=32)
    assert sorted(got.collect()) == want
    assert "known" in plan_of(got) and "_pos" not in plan_of(got).split("known")[0]


def test_pair_scores_exchange_open_occurrences_only(spark, monkeypatch):
    """answered occurrences get no slot in a shuffle, and the results do not depend on the way."""
    from tailsplit.operators import windows

    df = many_texts(spark)
    model = lm.fit_bigram(df)
    ways = [lambda: windows.score_tokens(df, model), lambda: windows.score_strided(df, model, stride=8, max_len=16),
            lambda: lm.score_last_word(df, model), lambda: lm.last_word_rows(df, model, k=3)]
    want = [sorted(map(str, way().collect())) for way in ways]
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    for head in (0, 4, 1000):
        monkeypatch.setattr(joins, "HEAD_ROWS", head)
        monkeypatch.setattr(lm, "HEAD_PAIRS", head)
        assert [sorted(map(str, way().collect())) for way in ways] == want
    settled = plan_of(windows.score_tokens(df, model)).split("LeftOuter")[0]
    assert "_slot" not in settled


def test_last_words_are_not_scored_by_all_pairs(spark, monkeypatch):
    """fewer occurrences than pairs meet the counts themselves."""
    df = many_texts(spark).filter("row_id < 30")
    model = lm.fit_bigram(df)
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(lm.Bigram, "scored", None)
    assert lm.score_last_word(df, model).count() > 0


def test_perplexity_of_counted_tokens(spark):
    """tokens counted before they are scored give the same perplexity."""
    rows = [("a", -5, 3), ("b", -7, 2), ("c", None, 4)]
    counted = spark.createDataFrame(rows, "token string, lp long, times long")
    single = spark.createDataFrame([(t, lp) for t, lp, n in rows for _ in range(n)], "token string, lp long")
    assert lm.corpus_perplexity(counted, "times").first() == lm.corpus_perplexity(single).first()
    none = counted.filter("false")
    assert lm.corpus_perplexity(none, "times").first() == lm.corpus_perplexity(none).first()


def test_ids_without_a_shuffle_of_frequent_tokens(spark, monkeypatch):
    """only tokens that the broadcast does not answer are exchanged to meet the vocabulary."""
    from tailsplit.operators import seqprep

    df = many_texts(spark)
    vocab = seqprep.vocabulary(lm.fit_unigram(df).counts)
    want = sorted(seqprep.encode(df, vocab, {"ids": "text"}).collect())
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(joins, "HEAD_ROWS", 5)
    got = seqprep.encode(df, vocab, {"ids": "text"})
    assert sorted(got.collect()) == want
    assert "_slot" not in plan_of(got)
