"""Queries with sub-queries: blanked, linked, folded and graded."""

import itertools
import random

import pytest

from tailsplit.operators import grade as g
from tailsplit.operators import trees
from tailsplit.operators.trees import clause_tables
from tailsplit.scratch import materialize

UNITS = ("query_id long, side string, node long, clause string, pos long, agg string, unit_op string, agg1 string, col1 string, "
         "distinct1 boolean, agg2 string, col2 string, distinct2 boolean, is_not boolean, op string, conn string, value1 string, "
         "value2 string, sub1 long, sub2 long, db_id string")
FIELDS = [f.split()[0] for f in UNITS.split(", ")]
NODES = "query_id long, side string, node long, parent long, link string"
CANONICAL = "db_id string, col_id string, canonical_id string"
LINKED = [("d", "__a.x__", "__a.x__"), ("d", "__b.x__", "__a.x__"), ("other", "__c.x__", "__a.x__")]


def unit(node, clause, col=None, side="gold", query_id=1, **more):
    row = dict.fromkeys(FIELDS) | {"query_id": query_id, "side": side, "node": node, "clause": clause, "pos": 1, "col1": col,
                                   "db_id": "d"} | more
    return row


class Cases:
    """Pairs of queries, graded all at once."""

    def __init__(self):
        self.rows, self.nodes, self.wanted = [], [], {}

    def add(self, wanted, gold, pred, gold_nodes=(), pred_nodes=()):
        """``wanted``: does the prediction match, and how many sub-queries does the gold side have."""
        number = len(self.wanted) + 1
        self.wanted[str(number)] = wanted
        for side, units, below in (("gold", gold, gold_nodes), ("pred", pred, pred_nodes)):
            self.rows += [tuple((u | {"side": side, "query_id": number})[f] for f in FIELDS) for u in units]
            self.nodes += [(number, side, n, p, link) for n, p, link in [(0, None, None), *below]]

    def tables(self, spark):
        return clause_tables(spark.createDataFrame(self.rows, UNITS), spark.createDataFrame(self.nodes, NODES),
                             spark.createDataFrame(LINKED, CANONICAL))

    def check(self, spark):
        clauses, nested = self.tables(spark)
        clauses = materialize(clauses)
        hard = {r.query_id: r.c2 for r in g.hardness(clauses, nested).collect()}
        got = {r.query_id: (r.exact, hard[r.query_id]) for r in g.grade(clauses)[1].collect() if r.query_id in self.wanted}
        assert got == self.wanted


BASE = [unit(0, "from", "__a__"), unit(0, "from", "__b__", pos=2), unit(0, "select", "__a.x__")]


def nest(depth, link="value", value="1", column="__a.z__"):
    """Units and nodes of sub-queries inside each other; the innermost has a literal and a column."""
    units, nodes = list(BASE), []
    for level in range(depth):
        clause = "from" if link == "from" and level == 0 else "where"
        units.append(unit(level, clause, None if clause == "from" else "__a.x__", pos=9, op="in", sub1=level + 1))
        nodes.append((level + 1, level, "from" if clause == "from" else "value"))
    units.append(unit(depth, "where", column, op="=", value1=value))
    return units, nodes


def test_matches(spark):
    cases = Cases()
    where = unit(0, "where", "__a.x__", op="=", value1="1")
    cases.add((1, 0), [*BASE, where], [*BASE, where | {"value1": "2"}])
    cases.add((1, 0), [*BASE, where], [*BASE, where | {"col1": "__b.x__", "distinct1": True}])
    cases.add((0, 0), [*BASE, where], [*BASE, where | {"col1": "__a.y__"}])
    # A link of another database, and a table that the query does not read.
    cases.add((0, 0), [*BASE, where], [*BASE, where | {"col1": "__c.x__"}])
    alone = [BASE[0], BASE[2]]
    cases.add((0, 0), [*alone, where], [*alone, where | {"col1": "__b.x__"}])
    # Gaps in positions do not matter, the order does.
    order = [unit(0, "orderBy", c, pos=p, op="asc") for c, p in (("__a.x__", 1), ("__a.y__", 2))]
    cases.add((1, 0), [*BASE, *order], [*BASE, *[o | {"pos": o["pos"] * 10} for o in order]])
    cases.add((0, 0), [*BASE, *order], [*BASE, *[o | {"pos": -o["pos"]} for o in order]])
    # Sub-queries are compared as a whole, whatever their numbers and the order of rows.
    rng = random.Random(3)
    for depth in (1, 2, 6):
        units, nodes = nest(depth)
        cases.add((1, 1), units, rng.sample(nest(depth, value="2")[0], len(units)), nodes, rng.sample(nodes, len(nodes)))
        cases.add((0, 1), units, nest(depth, column="__a.y__")[0], nodes, nodes)
        cases.add((0, 1), units, units[:-1] + [units[-1] | {"distinct1": True}], nodes, nodes)
        other = [u | {"node": u["node"] and u["node"] + 50, "sub1": u["sub1"] and u["sub1"] + 50} for u in units]
        cases.add((1, 1), units, other, nodes, [(n + 50, p and p + 50, link) for n, p, link in nodes])
        cases.add((0, 1), units, [u for u in units if u["node"] < depth], nodes, nodes)
    # Literals below a table count.
    units, nodes = nest(2, "from")
    cases.add((1, 0), units, units, nodes, nodes)
    cases.add((0, 0), units, nest(2, "from", value="2")[0], nodes, nodes)
    # A set operation is graded as a query, inside a sub-query it is a part of it.
    inside = [*BASE, unit(5, "select", "__a.x__"), unit(5, "from", "__a__")]
    other = [*BASE, unit(5, "select", "__b.x__"), unit(5, "from", "__a__")]
    cases.add((1, 1), inside, other, [(5, 0, "union")], [(5, 0, "union")])
    cases.add((0, 1), inside, other, [(5, 0, "union")], [(5, 0, "except")])
    deeper = [*inside, unit(6, "select", "__a.x__")]
    for link, same in (("union", 1), ("except", 0)):
        cases.add((same, 1), deeper, deeper, [(5, 0, "union"), (6, 5, "union")], [(5, 0, "union"), (6, 5, link)])
        units, nodes = nest(1)
        more = [*units, unit(7, "select", "__a.x__")]
        cases.add((same, 1), more, more, [*nodes, (7, 1, "union")], [*nodes, (7, 1, link)])
    cases.check(spark)


def test_units_are_written_once(spark, monkeypatch):
    """As they stand in the clause table; neither before that nor with the columns that they are made of."""
    written = []
    monkeypatch.setattr(trees, "materialize", lambda df, name="table": written.append((name, df.columns)) or materialize(df, name))
    cases = Cases()
    units, nodes = nest(2)
    cases.add((1, 1), units, units, nodes, nodes)
    cases.check(spark)
    assert [name for name, columns in written if {"unit", "col1"} & {*columns}] == ["rebuilt"]
    assert not {"col1", "value1", "operand"} & {*dict(written)["rebuilt"]}


@pytest.mark.parametrize("nodes", [[(3, 2, "value")], [(3, 2, "value"), (2, 3, "value")]])
def test_a_lost_sub_query_is_an_error(spark, nodes):
    cases = Cases()
    cases.add(None, BASE, BASE, nodes)
    with pytest.raises(ValueError):
        cases.tables(spark)


def test_sub_queries_in_a_table_list_are_not_nested(spark):
    fields = ["query_id", "side", "clause", "pos", "unit", "unit_no_agg", "has_agg", "is_not", "op", "conn", "parent_id", "link"]
    rows = [(1, "gold", "select", 0, "a", "a", False, False, None, None, None, None)]
    rows += [(2 + i, "gold", "select", 0, "a", "a", False, False, None, None, 1, link) for i, link in enumerate(["from", "where"])]
    schema = "query_id long, side string, clause string, pos long, unit string, unit_no_agg string, has_agg boolean, is_not boolean, op string, conn string, parent_id long, link string"
    assert [c.split()[0] for c in schema.split(", ")] == fields
    assert g.hardness(spark.createDataFrame(rows, schema)).where("query_id = 1").first()["c2"] == 1


def test_tables_and_columns(spark):
    rows = spark.createDataFrame([("__t__",), ("__t.c__",), ("t.c",), ("*",)], "id string")
    assert [r[0] for r in rows.select(g.table_of(rows["id"])).collect()] == ["__t", "__t", "t", None]
    clauses = spark.createDataFrame([(1, "gold", "from", "__t__", "d"), (2, "pred", "from", "__t__", "e")],
                                    "query_id long, side string, clause string, col_id string, db_id string")
    catalog = spark.createDataFrame(list(itertools.product(["d"], ["__t.a__", "__u.a__"])) + [("e", "__t.b__")],
                                    "db_id string, col_id string")
    assert sorted(tuple(r) for r in g.valid_columns(clauses, catalog).collect()) == [(1, "gold", "__t.a__"), (2, "pred", "__t.b__")]
