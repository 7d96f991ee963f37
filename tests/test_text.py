import pytest
from pyspark.sql import functions as F

from tailsplit.functions import arrays, prompts, text as tx
from tailsplit.operators import clean


def one(spark, column, **values):
    kinds = {k: "array<int>" if isinstance(v, list) else "string" for k, v in values.items()}
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in kinds.items()))
    columns = column if isinstance(column, tuple) else (column,)
    got = row.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return got[0] if len(columns) == 1 else tuple(got)


def test_tokens(spark):
    assert one(spark, tx.tokens("t"), t="Don't stop, Été 42!") == ["don", "'", "t", "stop", ",", "été", "42", "!"]
    assert one(spark, tx.token_length("t"), t="") == 0


@pytest.mark.parametrize("query,want", [
    ("db: how many? | a | b", ("db", " how many?", " | a | b")),
    ("no marks", ("", "no marks", "")),
    ("a:b:c", ("a", "b:c", "")),
    ("how | x", ("", "how", " | x")),
])
def test_query_fields(spark, query, want):
    got = tx.split_query_fields(spark.createDataFrame([(query,)], "query string")).first()
    assert (got["table_name"], got["query"], got["table_schema_str"]) == want


def test_query_fields_all_or_none(spark):
    df = spark.createDataFrame([("a: b | c",), ("d e | f",)], "query string")
    got = {(r["table_name"], r["query"], r["table_schema_str"]) for r in tx.split_query_fields_all(df).collect()}
    assert got == {("", "a: b", " | c"), ("", "d e", " | f")}


def test_question_and_last_word(spark):
    assert one(spark, tx.question_only("q"), q="db:  how many? \t | t") == "how many?"
    assert one(spark, tx.split_last_word("q"), q="one two  three") == ("one two ", " three")
    assert one(spark, tx.split_last_word("q"), q="one") == ("", " one")
    assert one(spark, tx.split_last_word("q"), q="one ") == ("one", " ")


def test_normalize(spark):
    assert one(spark, tx.normalize_prediction("p"), p=" a < = 3\n") == "a  <= 3"
    assert one(spark, tx.normalize_prediction("p", repair=False), p=" a < = 3\n") == "a < = 3"


def test_prompts(spark):
    p, h, q = F.col("p"), F.col("h"), F.col("l")
    assert one(spark, prompts.nli_prompt(p, h), p="A.", h="B.", l="x") == ("Premise: A. Hypothesis:", " B.")
    for label, words in (("contradiction", "is a contradiction"), ("entailment", "is entailed"), ("neutral", "is neutral")):
        got = one(spark, prompts.nli_prompt(p, h, q)[0], p="A.", h="B.", l=label)
        assert got == f"Premise: A. This hypothesis {words}:"
    assert one(spark, prompts.qa_prompt(p, h), p="A.", h="B?") == ("Passage: A. Ask a question about the passage:", " B?")
    assert one(spark, prompts.sql_prompt(h, "P ", p, True), p="db", h=" q ") == ("P db:", " q")
    assert one(spark, prompts.sql_prompt(h, "P "), p="db", h=" q ") == ("P ", "q")
    assert one(spark, prompts.seq2seq_text(p, h, "x: ", "SQL:", "<", ">"), p="a", h="b") == ("<x: a SQL:", "b>")


def test_white_space(spark):
    assert one(spark, tx.strip("t"), t=" \t a b  \n") == "a b"
    assert one(spark, tx.white_split("t"), t=" a b \n c ") == ["a", "b", "c"]
    assert one(spark, clean.nonblank("t"), t="  \t") is False


def test_clean(spark):
    df = spark.createDataFrame([("-", "x", "y"), ("a", clean.PLACEHOLDER, "y"), ("a", "x", "N/A"), ("a", "x", "y"), (None, "x", "y")],
                               "label string, p string, h string").withColumn("split", F.lit("train"))
    keep = clean.label_given("label") & clean.not_placeholder("p") & clean.not_na("h")
    got = clean.clean_report(df, keep).first()
    assert (got["base_rows"], got["dropped_rows"], got["retained_rows"]) == (5, 3, 2)


def fast_longest_first(n1, n2, limit):
    """The published rule of the fast tokenizers, written out."""
    if n1 + n2 <= limit:
        return n1, n2
    short, long = min(n1, n2), max(n1, n2)
    long = short if short > limit else max(short, limit - short)
    if short + long > limit:
        short = limit // 2
        long = short + limit % 2
    return (long, short) if n1 > n2 else (short, long)


def test_truncation(spark):
    cases = [(a, b) for a in range(0, 14) for b in range(0, 14)]
    df = spark.createDataFrame([(list(range(a)), list(range(b))) for a, b in cases], "a array<int>, b array<int>")
    for limit in (5, 8):
        first, second = arrays.truncate_longest(F.col("a"), F.col("b"), limit)
        only, _ = arrays.truncate_first(F.col("a"), F.col("b"), limit)
        for r in df.select("a", "b", first.alias("x"), second.alias("y"), only.alias("o")).collect():
            a, b = len(r["a"]), len(r["b"])
            assert (len(r["x"]), len(r["y"])) == fast_longest_first(a, b, limit)
            assert len(r["o"]) == min(a, max(limit - b, 0))
            assert r["x"] == r["a"][:len(r["x"])]


def test_masks_and_padding(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, arrays.label_mask(a, b), a=[5, 6, 7], b=[0, 1, 1]) == [-100, 6, 7]
    assert one(spark, arrays.mask_pad(a, 0), a=[5, 0, 0]) == [5, -100, -100]
    assert one(spark, arrays.unmask(a, 0), a=[5, -100]) == [5, 0]
    assert one(spark, arrays.pad_to(a, F.lit(4), 0, "left"), a=[1, 2]) == [0, 0, 1, 2]
    assert one(spark, arrays.attention(a, F.lit(4)), a=[1, 2]) == [1, 1, 0, 0]
    assert one(spark, arrays.round_up(F.size(a), 8), a=[1] * 9) == 16
    assert one(spark, arrays.cut_prompt(a, F.lit(2), F.lit(4), 9), a=[1, 2, 3]) == [3, 9, 9, 9]
    assert one(spark, arrays.concat_prompt_target(a, b), a=[1, 2], b=[3]) == ([1, 2, 3], [-100, -100, 3])
