import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tailsplit.functions.stem import stem
from tailsplit.operators import rouge

# Examples of the published description, through all steps.
STEMS = """caresses caress ponies poni caress caress cats cat feed feed agreed agre plastered plaster bled bled
motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss
fizzed fizz failing fail filing file happy happi relational relat conditional condit rational ration digitizer digit
operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit
sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope
goodness good revival reviv allowance allow inference infer airliner airlin adjustable adjust defensible defens
irritant irrit replacement replac adjustment adjust dependent depend adoption adopt communism commun activate activ
homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas roll roll
generalizations gener oscillators oscil""".split()


@pytest.mark.parametrize("word, want", list(zip(STEMS[::2], STEMS[1::2])))
def test_stems(word, want):
    assert stem(word) == want


def test_stem_leaves_the_rest():
    assert [stem(w) for w in ("sky", "", "is", "2nds", "żółwies", "!")] == ["sky", "", "is", "2nds", "żółwies", "!"]


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_common_positions_against_the_table():
    r = random.Random(3)
    for _ in range(400):
        a, b = [[r.choice("abcd") for _ in range(r.randrange(25))] for _ in range(2)]
        at = rouge.common_positions(a, b)
        assert at == sorted(set(at)) and len(at) == lcs(a, b)
        rest = iter(b)
        assert all(a[i] in rest for i in at)
    long = [str(r.randrange(40)) for _ in range(3000)]
    other = [str(r.randrange(40)) for _ in range(2500)]
    at = rouge.common_positions(long, other)
    rest = iter(other)
    assert all(long[i] in rest for i in at)
    assert len(at) == len(rouge.common_positions(other, long))


def test_union_of_sentences():
    """Published example: w1..w5 against two sentences that share w1 w2 and w1 w3 w5; four tokens in the union."""
    assert rouge.union_hits(["w1 w2 w6 w7 w8".split(), "w1 w3 w8 w9 w5".split()], ["w1 w2 w3 w4 w5".split()]) == 4
    assert rouge.union_hits([["a"]], [["a"], ["a"]]) == 1
    assert rouge.union_hits([], [["a"]]) == rouge.union_hits([["a"]], []) == 0


def plain_scores(pred, ref):
    """Straight from the definition, on the tokens of simple texts."""
    def f(hits, n, m):
        return round(200 * hits / (n + m), 6) if n + m else 0.0
    cut = [[[stem(w) for w in s.split()] for s in (text or "").split("\n") if s.split()] for text in (pred, ref)]
    p, r = [sum(c, []) for c in cut]
    bp, br = list(zip(p, p[1:])), list(zip(r, r[1:]))
    one = sum(min(p.count(t), r.count(t)) for t in set(p))
    two = sum(min(bp.count(t), br.count(t)) for t in set(bp))
    return f(one, len(p), len(r)), f(two, len(bp), len(br)), f(lcs(p, r), len(p), len(r))


def test_pairs_with_stems(spark):
    r = random.Random(5)
    words = ["running", "run", "runs", "happy", "happily", "cat", "cats", "the", "relational"]

    def text():
        return "\n".join(" ".join(r.choices(words, k=r.randrange(5))) for _ in range(r.randrange(4)))
    data = [(i, text(), text()) for i in range(120)]
    data += [(200, None, "the cat"), (201, "the cat", None), (202, None, None), (203, "", ""), (204, "Cats!", "cat !")]
    df = spark.createDataFrame(data, "row_id long, p string, r string").repartition(5, "row_id")
    got = {x["row_id"]: x for x in rouge.pair_scores(df, "p", "r", stemmed=True).collect()}
    assert len(got) == len(data)
    for i, p, t in data[:-1]:
        assert (got[i].rouge1, got[i].rouge2, got[i].rougeL) == plain_scores(p, t), (p, t)
        assert got[i].rougeLsum <= got[i].rouge1
    assert got[204].rouge1 == got[204].rougeLsum == 100.0
    assert rouge.pair_scores(df, "p", "r").filter("row_id = 204").first().rouge1 == 50.0


def test_bootstrap(spark):
    rows = spark.range(400).select(F.col("id").alias("row_id"), (F.col("id") % 101).cast("double").alias("x"),
                                   F.when(F.col("id") % 2 == 0, 7.0).alias("y"))
    got = {r["metric"]: r for r in rouge.bootstrap(rows, ["x", "y"]).collect()}
    again = {r["metric"]: r for r in rouge.bootstrap(rows.repartition(13), ["x", "y"]).collect()}
    assert got == again
    values = np.arange(400) % 101
    spread = values.std() / 20
    x = got["x"]
    assert x["mean"] == round(values.mean(), 4)
    assert abs(x["mid"] - x["mean"]) < spread / 3
    assert abs((x["high"] - x["low"]) / 2 - 1.96 * spread) < spread / 3
    assert [got["y"][c] for c in ("mean", "low", "mid", "high")] == [7.0] * 4
    none = rouge.bootstrap(rows.limit(0), ["x"]).collect()
    assert [(r["metric"], r["mid"]) for r in none] == [("x", None)]


def test_weights_are_poisson(spark):
    d = spark.range(200).select(F.explode(rouge.draws("id", 1, 1000)).alias("d")).select("d.draw", "d.sample").toPandas()
    assert d["sample"].nunique() == 1000 and len(d) == 200_000
    w = sum((d["draw"] >= s).astype(int) for s in rouge.WEIGHT_STEPS)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03
