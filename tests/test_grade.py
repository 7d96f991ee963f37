import pytest
from pyspark.sql import functions as F

from tailsplit.operators import fk, grade as g, joins
from tailsplit.operators.compare import aligned_match, multiset_match, result_differences, result_set_match
from tailsplit.sources import catalog

FIELDS = ["query_id", "side", "clause", "pos", "unit", "unit_no_agg", "has_agg", "is_not", "op", "conn", "parent_id", "link"]
SCHEMA = ("query_id long, side string, clause string, pos long, unit string, unit_no_agg string, has_agg boolean, "
          "is_not boolean, op string, conn string, parent_id long, link string")


def unit(query_id, side, clause, pos=0, unit="u", no_agg=None, agg=False, neg=False, op=None, conn=None, parent=None,
         link=None):
    return (query_id, side, clause, pos, unit, no_agg or unit, agg, neg, op, conn, parent, link)


def both(*units):
    return [(u[0], side, *u[2:]) for u in units for side in ("pred", "gold")]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def graded(spark, rows):
    partial, exact = g.grade(frame(spark, rows))
    return ({(r["query_id"], r["type"]): (r["label_total"], r["pred_total"], r["cnt"], r["score"]) for r in partial.collect()},
            {r["query_id"]: r["exact"] for r in exact.collect()})


def test_same_query_matches_whatever_the_literals(spark):
    rows = both(unit(1, "", "select", 0, "max(share)", "share", agg=True), unit(1, "", "select", 1, "min(share)", "share", agg=True),
                unit(1, "", "from", 0, "performance"), unit(1, "", "where", 0, "type !=", "type", op="!="))
    partial, exact = graded(spark, rows)
    assert exact == {1: 1}
    assert all(v[3] == 1 for v in partial.values())
    assert {t for _, t in partial} == set(g.PARTIAL_TYPES)


def test_aggregate_and_operator_only_differences(spark):
    rows = [unit(1, "gold", "select", 0, "max(a)", "a"), unit(1, "pred", "select", 0, "min(a)", "a"),
            unit(1, "gold", "where", 0, "b =", "b"), unit(1, "pred", "where", 0, "b >", "b")]
    partial, exact = graded(spark, rows)
    assert partial[1, "select"] == (1, 1, 0, 0) and partial[1, "select(no AGG)"] == (1, 1, 1, 1)
    assert partial[1, "where"] == (1, 1, 0, 0) and partial[1, "where(no OP)"] == (1, 1, 1, 1)
    assert exact == {1: 0}


def test_multisets_and_totals(spark):
    rows = [unit(1, "gold", "select", i, u) for i, u in enumerate("aab")] + [unit(1, "pred", "select", i, u) for i, u in enumerate("aac")]
    assert graded(spark, rows)[0][1, "select"] == (3, 3, 2, 0)


def test_group_prefix_and_having(spark):
    rows = [unit(1, "gold", "groupBy", 0, "__t.c__"), unit(1, "pred", "groupBy", 0, "__s.c__")]
    partial, _ = graded(spark, rows)
    assert partial[1, "group(no Having)"] == (1, 1, 1, 1)
    assert partial[1, "group"] == (1, 1, 0, 0)
    swapped = both(unit(2, "", "having", 0, "h")) + [
        unit(2, "gold", "groupBy", 0, "a"), unit(2, "gold", "groupBy", 1, "b"),
        unit(2, "pred", "groupBy", 0, "b"), unit(2, "pred", "groupBy", 1, "a")]
    partial, _ = graded(spark, swapped)
    assert partial[2, "group(no Having)"][3] == 1 and partial[2, "group"][3] == 0


def test_order_needs_limit_parity_not_value(spark):
    order = both(unit(1, "", "orderBy", 0, "a", op="desc"), unit(2, "", "orderBy", 0, "a", op="desc"))
    rows = order + [unit(1, "gold", "limit", 0, "3"), unit(1, "pred", "limit", 0, "5"), unit(2, "gold", "limit", 0, "3")]
    partial, _ = graded(spark, rows)
    assert partial[1, "order"] == (1, 1, 1, 1)
    assert partial[2, "order"] == (1, 1, 0, 0)


def test_connectors_on_one_side_swap_the_totals(spark):
    rows = both(unit(1, "", "where", 0, "a")) + [unit(1, "gold", "where", 1, "b", conn="or")]
    assert graded(spark, rows)[0][1, "and/or"] == (0, 1, 0, 0)
    assert graded(spark, both(unit(2, "", "where", 0, "a")))[0][2, "and/or"] == (1, 1, 1, 1)


def test_keywords(spark):
    rows = [unit(1, "gold", "where", 0, "a", op="like", neg=True, conn="or"), unit(1, "gold", "on", 0, "j", op="in"),
            unit(1, "gold", "orderBy", 0, "o", op="desc"), unit(1, "pred", "where", 0, "a", op="like"),
            unit(2, "gold", "select", 0, "x", parent=1, link="union")]
    partial, _ = graded(spark, rows)
    # where not or in like order desc union | where like
    assert partial[1, "keywords"] == (8, 2, 2, 0)


def test_keyword_sets_meet(spark):
    rows = [unit(1, "gold", "where", 0, "a", op="like"), unit(1, "gold", "where", 1, "b", neg=True), unit(1, "pred", "where", 0, "a"),
            unit(2, "gold", "where", 0, "a"), unit(2, "pred", "where", 0, "b"), unit(3, "pred", "limit", 0, "1"),
            unit(None, "gold", "limit", 0, "1"), unit(None, "pred", "limit", 0, "2"), unit(4, "gold", "select", 0, "a")]
    got = {r["keyword"]: (r["n_pred"], r["n_gold"], r["n_both"], r["n_matched"]) for r in g.keyword_counts(frame(spark, rows)).collect()}
    assert got == {"where": (2, 2, 2, 1), "like": (0, 1, 0, 0), "not": (0, 1, 0, 0), "limit": (2, 1, 1, 1)}
    got = {r["query_id"]: (r["type"], r["label_total"], r["pred_total"], r["cnt"]) for r in g.keyword_match(frame(spark, rows)).collect()}
    assert got == {1: ("keywords", 3, 1, 1), 2: ("keywords", 1, 1, 1), 3: ("keywords", 0, 1, 0), None: ("keywords", 1, 1, 1)}


def test_words_unknown_and_known(spark):
    """Known words of a query are one number; any other word still counts, once a side."""
    rows = both(unit(1, "", "orderBy", 0, "a", op="nulls last"), unit(1, "", "orderBy", 1, "b", op="nulls last"),
                unit(1, "", "where", 0, "w", conn="xor")) + [
        unit(1, "gold", "orderBy", 2, "c", op="where"), unit(1, "pred", "orderBy", 2, "c", op="random"),
        unit(1, "gold", "where", 1, "v", conn="and"), unit(2, "pred", "on", 0, "j", parent=1, link="union"), unit(3, None, "limit", 0, "1")]
    got = {r["query_id"]: r for r in g.compare_sides(frame(spark, rows)).collect()}
    # order, nulls last, where on both sides; random and union only in the prediction.
    assert [got[1][f"keywords|{c}"] for c in ("gold", "pred", "match")] == [3, 5, 3]
    assert [got[1][f"connectors|{c}"] for c in ("gold", "pred", "match")] == [2, 1, 1]
    assert {q: r["has_gold"] for q, r in got.items()} == {1: True, 2: False, 3: False}
    kinds = ("where", "where(no OP)", "connectors", "keywords")
    listed = frame(spark, both(unit(1, "", "where", 0, "a", op="like", neg=True, conn="or"))).withColumn("_bits", F.lit(0).cast("long"))
    assert listed.select(F.inline(g._entries(kinds, packed=True))).count() == 4


def test_missing_prediction_is_an_empty_query(spark):
    partial, exact = graded(spark, [unit(1, "gold", "select", 0, "a"), unit(1, "gold", "from", 0, "t")])
    assert exact == {1: 0}
    assert partial[1, "select"] == (1, 0, 0, 0)


def test_tables_must_agree(spark):
    rows = both(unit(1, "", "select", 0, "a"), unit(1, "", "from", 0, "t")) + [unit(1, "pred", "from", 1, "s")]
    partial, exact = graded(spark, rows)
    assert all(v[3] == 1 for v in partial.values()) and exact == {1: 0}


@pytest.mark.parametrize("leaf_matches", [True, False])
def test_nested_set_operations_are_graded_bottom_up(spark, leaf_matches):
    rows = both(unit(1, "", "select", 0, "a"), unit(2, "", "select", 0, "b", parent=1, link="union"),
                unit(3, "", "select", 0, "c", parent=2, link="except"))
    rows.append(unit(4, "gold", "select", 0, "d", parent=3, link="intersect"))
    rows.append(unit(4, "pred", "select", 0, "d" if leaf_matches else "x", parent=3, link="intersect"))
    partial, exact = graded(spark, rows)
    want = int(leaf_matches)
    assert exact == {1: want, 2: want, 3: want, 4: want}
    assert partial[1, "IUEN"] == (1, 1, want, want)


def test_set_operation_on_one_side(spark):
    rows = both(unit(1, "", "select", 0, "a")) + [unit(2, "gold", "select", 0, "b", parent=1, link="union")]
    partial, exact = graded(spark, rows)
    assert partial[1, "IUEN"] == (1, 0, 0, 0) and exact[1] == 0


HARDNESS = {
    "easy": [unit(1, "gold", "select", 0, "a"), unit(1, "gold", "from", 0, "t"), unit(1, "gold", "where", 0, "w")],
    "medium": [unit(1, "gold", "select", i, "a") for i in range(2)] + [unit(1, "gold", "where", 0, "w")],
    "hard": [unit(1, "gold", "select", 0, "a"), unit(1, "gold", "where", 0, "w"), unit(1, "gold", "groupBy", 0, "g"),
             unit(1, "gold", "orderBy", 0, "o")],
    "extra": [unit(1, "gold", "select", 0, "a"), unit(1, "gold", "where", 0, "w", conn="or", op="like"),
              unit(1, "gold", "where", 1, "v"), unit(1, "gold", "groupBy", 0, "g"), unit(1, "gold", "orderBy", 0, "o")],
}


@pytest.mark.parametrize("level", list(HARDNESS))
def test_hardness(spark, level):
    assert g.hardness(frame(spark, HARDNESS[level])).first()["hardness"] == level


def test_one_nested_query_is_hard(spark):
    rows = [unit(1, "gold", "select", 0, "a"), unit(2, "gold", "select", 0, "a", parent=1, link="where")]
    got = {r["query_id"]: r["hardness"] for r in g.hardness(frame(spark, rows)).collect()}
    assert got == {1: "hard", 2: "easy"}


def test_levels_skip_unreadable_gold_and_subqueries(spark):
    rows = frame(spark, both(unit(1, "", "select", 0, "a"), unit(2, "", "select", 0, "b", parent=1, link="union"))
                 + [unit(3, "pred", "select", 0, "a")] + [unit(4, "gold", "select", 0, "z")])
    levels = g.graded_roots(rows, g.hardness(rows))
    partial, exact = g.grade(rows)
    got = {r["level"]: (r["n_queries"], r["exact"]) for r in g.eval_levels(levels, exact).collect()}
    assert got == {"hard": (1, 1.0), "easy": (1, 0.0), "all": (2, 0.5)}
    part = {(r["level"], r["type"]): (r["acc"], r["rec"], r["f1"]) for r in g.eval_partial(levels, partial).collect()}
    assert part["all", "select"] == (1.0, 0.5, 0.666667)
    # Neither side is ever present: both averages are 0 and f1 is 1.
    assert part["all", "where"] == (0.0, 0.0, 1.0)


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "a long, b long")


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("pairs,want", [
    ([(i, i + 1) for i in range(40)], {0: 41}),
    ([(50, i) for i in range(40)] + [(100, 101)], {0: 41, 100: 2}),
    ([(1, 2), (3, 4), (2, 3), (7, 7), (9, 8)], {1: 4, 7: 1, 8: 2}),
])
def test_canonical_ids(spark, monkeypatch, pairs, want, small):
    if not small:
        monkeypatch.setattr(joins, "BROADCAST_ROWS", 2)
        monkeypatch.setattr(joins, "HEAD_ROWS", 3)
        monkeypatch.setattr(fk, "fits_broadcast", lambda df: False)
    got = fk.canonical_ids(edges_of(spark, pairs), "a", "b").groupBy("canonical_id").count().collect()
    assert {r["canonical_id"]: r["count"] for r in got} == want


def test_canonical_columns_only_for_tables_of_the_query(spark):
    schema = "query_id long, side string, clause string, pos long, unit string, db_id string, col_id string, is_distinct boolean"
    rows = spark.createDataFrame([
        (1, "gold", "from", 0, "s", "d", "__s.x__", None), (1, "gold", "select", 0, "u", "d", "__s.k__", True),
        (1, "gold", "select", 1, "v", "d", "__r.k__", True), (1, "gold", "select", 2, "w", "d", "__all__", True)], schema)
    canon = spark.createDataFrame([("d", "__s.k__", "__a.k__"), ("d", "__r.k__", "__a.k__")], "db_id string, col_id string, canonical_id string")
    got = {(r["clause"], r["pos"]): (r["col_id"], r["is_distinct"]) for r in g.canonical_columns(rows, canon).collect()}
    assert got["select", 0] == ("__a.k__", None)
    assert got["select", 1] == ("__r.k__", None)
    assert got["select", 2] == ("__all__", None)


def test_foreign_keys_from_metadata(spark, tmp_path):
    path = str(tmp_path / "tables.json")
    with open(path, "w") as f:
        f.write("""[{"db_id": "shop", "table_names_original": ["A", "B"],
                "column_names_original": [[-1, "*"], [0, "Id"], [1, "A_Id"]], "foreign_keys": [[2, 1]]}]""")
    meta = catalog.read_meta(spark, path)
    rows = {r["pos"]: r["col_id"] for r in catalog.catalog_rows(meta).collect()}
    assert rows == {0: "__all__", 1: "__a.id__", 2: "__b.a_id__"}
    got = fk.canonical_ids(catalog.foreign_keys(meta), "col1", "col2", ["db_id"]).collect()
    assert {(r["id"], r["canonical_id"]) for r in got} == {(1, 1), (2, 1)}
    named = fk.foreign_key_map(meta).collect()
    assert {(r["col_id"], r["canonical_id"]) for r in named} == {("__a.id__", "__a.id__"), ("__b.a_id__", "__a.id__")}


def test_result_sets(spark):
    a = spark.createDataFrame([(1, 0, "x"), (1, 1, "y")], "q long, i long, v string")
    b = spark.createDataFrame([(1, 0, "y"), (1, 1, "x")], "q long, i long, v string")
    assert result_set_match(a, b, ["v"], ["q"]).first()["same_result"]
    assert not result_set_match(a, b, ["v"], ["q"], position="i").first()["same_result"]
    assert not result_set_match(a.select("v").union(a.select("v")), b.select("v"), ["v"]).first()["same_result"]
    assert result_differences(a.select("v"), b.select("v")).count() == 0
    got = multiset_match(a, b.filter("v = 'x'"), ["q"], ["v"]).first()
    assert (got["label_total"], got["pred_total"], got["cnt"]) == (1, 2, 1)


def test_results_align_by_column_in_order(spark):
    def result(names, rows):
        return names, rows

    gold = result(["a", "b"], [("1", "x"), ("2", None), ("2", "")])
    preds = {
        1: (gold, True),
        2: (result(["b", "a"], [("x", "1"), (None, "2"), ("", "2")]), True),
        3: (result(["a", "b"], [("2", None), ("1", "x"), ("2", "")]), False),
        4: (result(["a", "b"], [("1", "x"), ("2", ""), ("2", None)]), False),
        5: (result(["a", "b"], [("1", "x"), ("2", None)]), False),
        6: (result(["a", "b", "c"], [("1", "x", "0"), ("2", None, "0"), ("2", "", "0")]), False),
        7: (result(["a", "b", "a"], [("7", "x", "1"), ("8", None, "2"), ("9", "", "2")]), True),
        8: (result(["a", "b", "a"], [("1", "x", "7"), ("2", None, "8"), ("2", "", "9")]), False),
        9: (result([], []), False),
        10: (result(["a", "b"], []), False),
        11: (result(["b", "a"], []), True),
    }
    cells, columns = [], []
    for q, (pred, _) in preds.items():
        for side, (names, rows) in (("gold", (gold[0], []) if q == 11 else gold), ("pred", pred)):
            columns += [(q, side, i, n) for i, n in enumerate(names)]
            cells += [(q, side, i, pos, v) for pos, row in enumerate(rows) for i, v in enumerate(row)]
    got = aligned_match(spark.createDataFrame(cells, "q long, side string, ordinal long, pos long, value string").repartition(7),
                        spark.createDataFrame(columns, "q long, side string, ordinal long, name string"), ["q"])
    assert {r["q"]: r["same_result"] for r in got.collect()} == {q: want for q, (_, want) in preds.items()}
    assert aligned_match(spark.createDataFrame([], "q long, side string, ordinal long, pos long, value string"),
                         spark.createDataFrame([], "q long, side string, ordinal long, name string"), ["q"]).count() == 0


def test_results_of_many_runs_align_without_sorting(spark, tmp_path):
    """Rows may lie scattered and far apart; places may repeat. Cells are not held before the exchange, nor groups sorted."""
    from tailsplit.queries import grading
    step = 1 << 15
    gold = [(pos * step, str(pos % 3)) for pos in range(9)]
    preds = {1: (gold, True), 2: (gold[:-1], False), 3: (gold[:-1] + [(8 * step, "x")], False),
             4: ([(4 * step, v) if pos == 3 * step else (pos, v) for pos, v in gold], False), 5: (gold + gold[:1], False)}
    cells, columns = [], []
    for q, (pred, _) in preds.items():
        for side, rows in (("gold", gold), ("pred", pred)):
            columns += [(q, side, 0, "a"), (q, side, 0, "a"), (q, side, 1, None)]
            cells += [(q, side, o, pos, v + side * o) for pos, v in rows for o in (0, 1)]
    columns.append((6, "gold", 0, None))
    got = aligned_match(
        spark.createDataFrame(cells, "q long, side string, ordinal long, pos long, value string").repartition(5, "pos"),
        spark.createDataFrame(columns, "q long, side string, ordinal long, name string"), ["q"])
    assert {r["q"]: r["same_result"] for r in got.collect()} == {q: want for q, (_, want) in preds.items()}

    spark.createDataFrame([(k,) for k in range(40)], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(k, 3, 4, n, 0.1, "N") for k in range(40) for n in (1, 2)],
                          "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_discount double, l_returnflag string"
                          ).write.parquet(str(tmp_path / "lineitem.parquet"))
    plan = grading.result_columns_match(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "lambda" not in plan and plan.count("Exchange hashpartitioning") == 2
    scan = plan[plan.rindex("Exchange hashpartitioning"):]
    assert "l_linenumber" in scan and "Aggregate" not in scan


def test_orders_without_a_parent_are_not_gathered_by_the_join(spark, tmp_path):
    from tailsplit.queries import grading
    n = 3000
    lines = spark.range(n).selectExpr(
        "id as l_orderkey", "id as l_partkey", "id as l_suppkey", "cast(id % 7 + 1 as int) as l_linenumber", "20.0D as l_quantity",
        "0.05D as l_discount", "0.02D as l_tax", "'N' as l_returnflag", "'O' as l_linestatus").where("id <> 44")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        rows = grading.clauses(spark, str(tmp_path))
        sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("at")).count().collect()]
        kids = {r["query_id"]: r["parent_id"] for r in rows.where("parent_id is not null").collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 2 * (n - 1) and max(sizes) < n
    # The parent of 45 is not there.
    assert kids == {k: k - 1 for k in range(n) if k % 30 == 15 and k != 45}
