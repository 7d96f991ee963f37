"""Language, toxicity, main text and fixity on made cases whose answers are known."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tailsplit.llm import html_text, langid, toxicity, warc
from tests.llm import cases

WORDS = {"en": "the and of to in that with was for this have from they were which",
         "fr": "le la les des dans est une pour que avec sur nous vous sont pas",
         "de": "der die und ist nicht mit auf eine dem sich werden auch aus bei nach"}


def prose(code, n, rng):
    return " ".join(rng.choice(WORDS[code].split()) for _ in range(n))


def test_language_follows_the_text(spark):
    rng = random.Random(1)
    rows = [(i, prose(code, 40, rng), code, f"www.site{i % 7}.{'com' if code == 'en' else code}")
            for i, code in enumerate(["en", "fr", "de"] * 60)]
    wrong = [(1000, prose("fr", 80, rng), "en", "www.site1.com"), (1001, prose("de", 80, rng), None, None)]
    found = langid.identify(spark.createDataFrame(rows + wrong, "doc_id long, text string, lang string, source string"))
    got = {r.doc_id: (r.language, r.accepted) for r in found.collect()}
    assert got == {**{i: (code, True) for i, _, code, _ in rows}, 1000: ("fr", True), 1001: ("de", True)}


def test_host_and_declaration_decide_where_the_text_does_not(spark):
    rng = random.Random(2)
    rows = [(i, prose(code, 40, rng), code, f"{code}.example.org") for i, code in enumerate(["en", "fr"] * 40)]
    rows += [(900, "xq", None, "fr.example.org"), (901, "xq", "en", None), (902, "", "fr", "fr.example.org")]
    found = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    got = {r.doc_id: r for r in found.where("doc_id >= 900").collect()}
    assert [got[i].language for i in (900, 901, 902)] == ["fr", "en", "fr"]
    assert not got[902].accepted


@pytest.mark.parametrize("clashing", [False, True])
def test_language_of_odd_documents(spark, clashing):
    docs = cases.documents(spark, clashing)
    found = langid.identify(docs)
    assert found.columns == [c for c in docs.columns if c != "posterior"] + ["language", "posterior", "accepted"]
    rows = found.collect()
    assert len(rows) == len(cases.texts())
    assert all(0 <= r.posterior <= 1 for r in rows)
    assert not any(r.accepted for r in rows if not any(c.isalpha() for c in r.text or ""))
    none = langid.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {(r.language, r.posterior, r.accepted) for r in none.collect()} == {(None, None, False)}
    assert langid.identify(cases.none_at_all(spark)).count() == 0


def labelled(spark, n=1200):
    rng = random.Random(7)
    docs, labels = [], []
    for i in range(n):
        bad = i % 6 == 0
        words = [rng.choice(WORDS["en"].split() + cases.PROSE.split()) for _ in range(30)]
        if bad:
            words[rng.randrange(30)] = rng.choice(["blarghead", "snivelwit", "grotfiend"])
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return (spark.createDataFrame(docs, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, toxic int"), labels)


def test_toxic_texts_are_found_also_with_letters_put_in(spark):
    docs, labels, truth = labelled(spark)
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: (r.score, r.held) for r in toxicity.score(docs, model, columns=["doc_id"]).withColumn(
        "held", toxicity.held_out("doc_id")).collect()}
    held = [(got[i][0], y) for i, y in truth if got[i][1]]
    assert sum(s >= 0.7 for s, y in held if y) >= 0.9 * sum(y for _, y in held)
    assert sum(s >= 0.7 for s, y in held if not y) == 0
    odd = spark.createDataFrame([(0, f"{cases.PROSE} you blar-ghead"), (1, f"{cases.PROSE} snivvelwit now"),
                                 (2, "b l a r g h e a d of this"), (3, cases.PROSE)], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in toxicity.score(odd, model).collect()}
    assert min(scores[0], scores[1], scores[2]) > 0.5 > scores[3]


@pytest.mark.parametrize("clashing", [False, True])
def test_scores_of_odd_documents(spark, clashing):
    docs, labels, _ = labelled(spark, 300)
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(cases.documents(spark, clashing), model).collect()
    assert len(rows) == len(cases.texts())
    assert all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not (r.text or "").strip()}) == 1
    assert toxicity.score(cases.none_at_all(spark), model).count() == 0


def test_without_labels_nothing_is_toxic(spark):
    labels = spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0)):
        model = toxicity.fit(cases.documents(spark), known)
        assert {r.score < 0.01 for r in toxicity.score(cases.documents(spark), model).collect()} == {True}


PAGE = ("<html><head><title>No</title><style>p{}</style><script>var a = '</p>';</script></head><body><nav><ul>"
        "<li><a href=/>Home</a><li><a href=/b>News of the day</a></ul></nav><article><h1>Of mills</h1><p>" + cases.PROSE
        + " &amp;\n  more of it.</p><p>Then it was night.</p><p>" + cases.PROSE + " again.</p></article>"
        "<div class=comments><p>" + cases.PROSE + " says a reader</p></div><footer>All rights reserved</footer></body></html>")


def test_main_text(spark):
    rows = [(0, "http://a", PAGE, "x"), (1, None, None, "x"), (2, "u", "", "x"), (3, "u", "<p>" * 5000, "x"),
            (4, "u", "<div><p>broken <b", "x"), (0, "http://a", PAGE, "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, blocks string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract(frame).collect())
    want = f"Of mills\n\n{cases.PROSE} & more of it.\n\nThen it was night.\n\n{cases.PROSE} again."
    assert got[:2] == [(0, want, len(want))] * 2
    assert got[2:4] == [(1, "", 0), (2, "", 0)]
    assert all(n == len(t) for _, t, n in got)
    assert html_text.extract(frame.limit(0)).count() == 0


def test_audit_finds_every_difference(spark):
    rng = random.Random(9)
    digest = lambda x: hashlib.sha256(str(x).encode()).hexdigest()
    left, right, want, places = [], [], {}, set()
    while len(places) < 800:
        places.add((rng.choice(["a", "b", "c"]), rng.randrange(0, 40_000_000)))
    for i, (name, at) in enumerate(sorted(places)):
        fate = rng.randrange(60)
        if fate != 1:
            left.append((name, at, digest(i)))
        if fate != 0:
            right.append((name, at, digest(-i if fate == 2 else i)))
        if fate < 3 and i:
            want[name, at] = ["missing", "added", "changed"][fate]
    left += [("only left", 5, digest(1)), ("a", 7, digest(1)), ("a", 7, digest(2)), (None, None, None), ("n", 1, None)]
    right += [("a", 7, digest(2)), ("a", 7, digest(1)), (None, None, None), ("n", 1, ""), ("twice", 1, None)]
    want |= {("only left", 5): "missing", ("twice", 1): "added", ("n", 1): "changed"}
    schema = "archive string, offset long, digest string"
    one, two = (spark.createDataFrame(x, schema).withColumn("node", F.lit("x")) for x in (left, right))
    found = {(r.archive, r.offset): r.kind for r in warc.audit(one, two).collect()}
    assert found == want
    assert warc.audit(one, one).count() == 0
    assert warc.audit(one.limit(0), two.limit(0)).count() == 0
    assert warc.audit(one, two.limit(0)).where("kind = 'missing'").count() == len({x[:2] for x in left})


def test_repeats_at_one_offset_count(spark):
    rows = [("a", 0, "aa"), ("a", 0, "aa"), ("a", 0, "bb")]
    schema = "archive string, offset long, digest string"
    one, two = spark.createDataFrame(rows, schema), spark.createDataFrame(rows[1:], schema)
    assert [tuple(r)[:3] for r in warc.audit(one, two).collect()] == [("a", 0, "changed")]


def test_any_number_of_declared_codes(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    codes = [a + b + c for a in letters for b in letters for c in letters][:2000]
    rows = [(i, f"{cases.PROSE} {code}", code, f"{code}.example.com", 1) for i, code in enumerate(codes)]
    rows += [(9000 + i, cases.FRENCH, "fr", "a.fr", 1) for i in range(5)] + [(9100 + i, cases.PROSE, "en", None, 1) for i in range(5)]
    got = langid.identify(spark.createDataFrame(rows, cases.DOCUMENTS)).collect()
    assert len(got) == len(rows)
    assert all(r.language == "fr" for r in got if 9000 <= r.doc_id < 9005)
    assert {r.language for r in got} <= {"fr", "en", langid.OTHER_CODES, *codes}


def test_training_rows_are_bounded(spark):
    docs = spark.createDataFrame([(3, f"text {i}", "en", "s", 1) for i in range(3000)] + [(i, "a", "en", "s", 1) for i in range(4, 30)],
                                 cases.DOCUMENTS)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(30)] * 2, "doc_id long, quality int, toxic int")
    assert toxicity._training(docs, labels, "text", "doc_id", "toxic", 3).count() <= 3
    assert toxicity._training(docs, labels, "text", "doc_id", "toxic", 10_000).count() <= 27
