import pytest
from pyspark.sql import functions as F

from tailsplit.operators import atoms, metrics, seqprep
from tailsplit.scratch import materialize, scratch_root
from tailsplit.sources import readers, writers

TRICKY = [(1, 'say "hi", please', "a"), (2, "two\nlines\ttab", "b"), (3, "back\\slash", None), (4, " spaced ", "")]


def test_csv_keeps_quotes_and_line_breaks(spark, tmp_path):
    df = spark.createDataFrame([t[:2] for t in TRICKY], "row_id long, text string").withColumn("split", F.lit("dev"))
    path = str(tmp_path / "out")
    writers.write_split_csv(df, path)
    got = readers.read_csv(spark, path, "row_id long, text string, split string").collect()
    assert {(r["row_id"], r["text"], r["split"]) for r in got} == {(i, t, "dev") for i, t, _ in TRICKY}


def test_query_table_prefers_tsv(spark, tmp_path):
    (tmp_path / "train.tsv").write_text("db: q | s\tselect 1\n")
    (tmp_path / "train.csv").write_text("query,parse\nx,y\n")
    (tmp_path / "dev.csv").write_text('query,parse\n"a ""b""",c\n')
    assert tuple(readers.read_query_table(spark, str(tmp_path), "train").first()) == ("db: q | s", "select 1")
    assert tuple(readers.read_query_table(spark, str(tmp_path), "dev").first()) == ('a "b"', "c")


def test_lines(spark, tmp_path):
    (tmp_path / "gold.txt").write_text("select 1\tdb1\n\n   \n select 2 \tdb2 \nselect 3\n")
    got = readers.read_lines(spark, str(tmp_path / "gold.txt"), ["sql", "db_id"]).collect()
    assert {tuple(r) for r in got} == {("select 1", "db1"), ("select 2 ", "db2"), ("select 3", None)}


def test_load_wants_one_kind(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"t": "x", "extra": 1}\n')
    (tmp_path / "b.jsonl").write_text('{"t": "y"}\n')
    got = readers.load(spark, {"train": str(tmp_path / "a.jsonl"), "test": str(tmp_path / "b.jsonl")}, "t string")
    assert {tuple(r) for r in got.collect()} == {("x", "train"), ("y", "test")}
    with pytest.raises(ValueError):
        readers.load(spark, {"train": "a.csv", "test": "b.json"}, "t string")
    with pytest.raises(ValueError):
        readers.load(spark, {"train": "a.csv"})


def test_corpus(spark, tmp_path):
    (tmp_path / "c.txt").write_text("one\ntwo\n")
    path = str(tmp_path / "c.txt")
    assert [r["text"] for r in readers.read_corpus(spark, path).collect()] == ["one", "two"]
    assert [r["text"] for r in readers.read_corpus(spark, path, keep_breaks=True).collect()] == ["one\n", "two\n"]
    assert [r["text"] for r in readers.read_corpus(spark, path, whole_files=True).collect()] == ["one\ntwo\n"]


def test_columns(spark):
    df = spark.createDataFrame([("a", "b", "l")], "sentence1 string, sentence2_parse string, gold_label string")
    assert readers.rename_prefixes(df).columns == ["premise", "hypothesis_parse", "gold_label"]
    assert readers.alias_label(df).columns[-1] == "label"
    assert readers.alias_label(df, rename=True).columns[-1] == "label"
    assert readers.sentence_columns(df, "boolq") == ("passage", "question")
    assert readers.sentence_columns(df.withColumn("sentence2", F.lit(1))) == ("sentence1", "sentence2")
    assert readers.sentence_columns(df.select("gold_label")) == ("gold_label", None)
    assert readers.text_column(df) == "sentence1"


def test_prediction_files(spark, tmp_path):
    df = spark.createDataFrame([(0, 1.23456, "a\nb"), (1, -2.0, "c")], "row_id long, p double, t string")
    writers.write_predictions(df.coalesce(1), str(tmp_path / "p"), "p", regression=True)
    lines = spark.read.text(str(tmp_path / "p")).collect()
    assert {r["value"] for r in lines} == {"index\tprediction", "0\t1.235", "1\t-2.000"}
    writers.write_generated(df, str(tmp_path / "g"), "t")
    assert {r["value"] for r in spark.read.text(str(tmp_path / "g")).collect()} == {"a b", "c"}


def test_scratch_is_below_the_checkpoint_folder(spark):
    assert scratch_root(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


def test_scratch_refuses_a_cluster_without_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            applicationId, master = "app", "yarn"

            @staticmethod
            def getConf():
                return Conf()
    with pytest.raises(RuntimeError):
        scratch_root(Session)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1]


def test_rouge(spark, sf):
    from tailsplit.functions.text import tokens
    from tailsplit.queries.fixtures import pairs
    rows = pairs(spark, sf)
    want = {r["row_id"]: (list(r["a"]), list(r["b"])) for r in rows.select(
        "row_id", tokens("prefix").alias("a"), tokens("target").alias("b")).collect()}
    for r in metrics.rouge_l(rows, "prefix", "target").collect():
        a, b = want[r["row_id"]]
        assert abs(r["rouge"] - (200 * lcs(a, b) / (len(a) + len(b)) if a or b else 0)) < 1e-5
    df = spark.createDataFrame([(1, "a b a", "a a b"), (2, "", ""), (3, "a", "b")], "row_id long, p string, r string")
    got = {r["row_id"]: r["rouge"] for r in metrics.rouge_n(df, "p", "r", 2).collect()}
    assert got == {1: 50.0, 2: 0.0, 3: 0.0}


def test_small_metrics(spark):
    df = spark.createDataFrame([(1, "a b", "a  b", [3, 9, 0]), (2, "a", "b", [0, 0, 0])], "row_id long, p string, r string, ids array<int>")
    assert metrics.sequence_accuracy(df, "p", "r").first()[0] == 0.5
    assert metrics.generated_length(df, "ids", 0).first()[0] == 1.0
    assert {r[0] for r in df.select(metrics.argmax(F.col("ids"))).collect()} == {1, 0}
    long = metrics.long_metrics(spark.createDataFrame([(1.0, 2.00004)], "x double, y double"))
    got = {r["metric"]: r["value"] for r in metrics.round_metrics(metrics.combined_score(long)).collect()}
    assert got == {"x": 1.0, "y": 2.0, "combined_score": 1.5}
    assert metrics.combined_score(long.filter("metric = 'x'")).count() == 1


def test_encode(spark):
    df = spark.createDataFrame([(1, "b a b", "c"), (2, "", "a z")], "row_id long, s string, t string")
    counts = spark.createDataFrame([("a", 2), ("b", 2), ("c", 1)], "token string, n long")
    got = {r["row_id"]: (r["x"], r["y"]) for r in seqprep.encode(df, seqprep.vocabulary(counts), {"x": "s", "y": "t"}).collect()}
    assert got == {1: ([3, 2, 3], [4]), 2: ([], [2, 1])}


@pytest.mark.parametrize("size", [4, 8])
def test_balance_atoms(spark, size):
    texts = ["a b", "a b", "a c", "b c", "a b c", "a", "d a", "b e", "d e", "a b"]
    rows = spark.createDataFrame([(i, float(i), i < size) for i in range(10)], "row_id long, key double, picked boolean")
    held = atoms.atom_rows(spark.createDataFrame(list(enumerate(texts)), "row_id long, text string"))
    out, report = atoms.balance_atoms(rows, held)
    got = {r["row_id"]: r["picked"] for r in materialize(out, "balanced").collect()}
    train = {a for i, p in got.items() if p for a in texts[i].split()}
    test = {a for i, p in got.items() if not p for a in texts[i].split()}
    assert test <= train
    assert sum(got.values()) == size + report["grown_by"]
    assert report["moved_in"] - report["moved_out"] == report["grown_by"]


def test_divergence(spark):
    counts = spark.createDataFrame([("x", "a", 1), ("x", "b", 1), ("y", "a", 2)], "side string, atom string, n long")
    assert abs(atoms.atom_divergence(counts, "x", "y", "side").first()[0] - (1 - 0.5 ** 0.5)) < 1e-6
    same = spark.createDataFrame([("x", "a", 1), ("y", "a", 5)], "side string, atom string, n long")
    assert atoms.atom_divergence(same, "x", "y", "side").first()[0] == 0.0


def test_missing_predictions_earn_nothing(spark):
    df = spark.createDataFrame([(1, "a b", "a b", 1.0, 1.0), (2, None, "c", None, 2.0), (3, None, None, 3.0, None)],
                               "row_id long, p string, r string, x double, y double")
    assert {r.row_id: r.rouge for r in metrics.rouge_l(df, "p", "r").collect()} == {1: 100.0, 2: 0.0, 3: 0.0}
    assert {r.row_id: r.rouge for r in metrics.rouge_n(df, "p", "r", 1).collect()}[2] == 0.0
    assert metrics.mse(df, "x", "y").first()[0] is None
    assert metrics.mse(df.where("row_id <> 2"), "x", "y").first()[0] == 0.0
    assert metrics.sequence_accuracy(df, "p", "r").first()[0] == 0.5
    table = metrics.metrics_table(df, {"accuracy": metrics.accuracy_of("p", "r"), "missing": metrics.missing_share_of("p", "r"),
                                       "mse": metrics.squared_error_of("x", "y")})
    assert {r.metric: r.value for r in table.collect()} == {"accuracy": 0.5, "missing": 0.5, "mse": None}


@pytest.mark.parametrize("multi_line", [True, False])
def test_malformed_rows_of_delimited_files_fail(spark, tmp_path, multi_line):
    good, bad, short = [tmp_path / n for n in ("good.csv", "bad.csv", "short.tsv")]
    good.write_text('a,b\n1,"x, y"\n\n2,\n')
    bad.write_text("a,b\n1,x\nmany,y\n")
    short.write_text("select 1\n")
    rows = readers.read_csv(spark, str(good), "a long, b string", multi_line).collect()
    assert [(r.a, r.b) for r in rows] == [(1, "x, y"), (2, None)] or [(r.a, r.b) for r in rows] == [(1, "x, y"), (2, "")]
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_csv(spark, str(bad), "a long, b string", multi_line).collect()
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_tsv(spark, str(short), multi_line=multi_line).collect()
