"""Queries of clause-table grading and of column groups.

The clause tables are made from every row of lineitem: an order is a query, its lines are the
units. The prediction side loses the lines taxed at eight percent and has another unit where
the discount is ten percent, so that some queries match and some do not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailsplit.operators import fk, joins
from tailsplit.operators import grade as g
from tailsplit.operators.compare import aligned_match, multiset_match, result_set_match
from tailsplit.queries.fixtures import table, with_
from tailsplit.queries.registry import query
from tailsplit.scratch import materialize
from tailsplit.sources.readers import spread

BY_LINE = ("select", "from", "where", "groupBy", "having", "orderBy", "limit")


def clauses(spark, sf) -> DataFrame:
    lines = spread(table(spark, sf, "lineitem"), "l_orderkey")
    clause = F.element_at(F.array(*[F.lit(c) for c in BY_LINE]), F.col("l_linenumber"))
    col_id = F.concat(F.lit("__t"), (F.col("l_suppkey") % 3).cast("string"), F.lit(".c"),
                      (F.col("l_suppkey") % 5).cast("string"), F.lit("__"))

    def hangs(key) -> Column:
        return F.coalesce((key % 2 == 1) & (key % 15 == 0), F.lit(False))

    nested = hangs(F.col("l_orderkey"))
    link = F.element_at(F.array(*[F.lit(s) for s in g.SET_OPS]), (F.floor(F.col("l_orderkey") / 30) % 3 + 1).cast("int"))
    rows = lines.select(
        F.col("l_orderkey").alias("query_id"), clause.alias("clause"), F.col("l_linenumber").cast("long").alias("pos"),
        col_id.alias("col_id"), F.col("l_returnflag").alias("flag"), (F.col("l_returnflag") == "A").alias("has_agg"),
        (F.col("l_linestatus") == "F").alias("is_not"),
        F.when(clause == "orderBy", F.when(F.col("l_returnflag") == "A", "desc").otherwise("asc"))
        .when(F.col("l_discount") == 0.0, "in").when(F.col("l_discount") == 0.01, "like").otherwise("=").alias("op"),
        F.when(F.col("l_tax") == 0.0, None).when(F.col("l_quantity") > 25, "or").otherwise("and").alias("conn"),
        F.when(nested, F.col("l_orderkey") - 1).alias("parent_id"), F.when(nested, link).alias("link"),
        F.concat(F.lit("db"), F.col("l_returnflag")).alias("db_id"),
        F.col("l_quantity").cast("long").cast("string").alias("value"),
        (F.col("l_linestatus") == "O").alias("is_subquery"), "l_tax", "l_discount")
    # Only the lines that may hang on another order look for it: null keys would all gather in one task of the join.
    above = lines.where(hangs(F.col("l_orderkey") + 1)).select(F.col("l_orderkey").alias("parent_id")).distinct()
    inner = rows.where(F.col("parent_id").isNotNull()).join(above.withColumn("_exists", F.lit(True)), "parent_id", "left")
    rows = rows.where(F.col("parent_id").isNull()).withColumn("_exists", F.lit(None).cast("boolean")).unionByName(inner)
    found = F.col("_exists").isNotNull()
    unit = (F.when(F.col("clause").isin("groupBy", "from"), F.col("col_id"))
            .when(F.col("clause").isin("where", "having"),
                  F.concat_ws(" ", F.col("is_not").cast("string"), "op", "col_id"))
            .otherwise(F.concat_ws(" ", "flag", "op", "col_id")))
    # One scan serves both sides.
    sides = rows.withColumns({
        "unit": unit, "unit_no_agg": F.col("col_id"), "parent_id": F.when(found, F.col("parent_id")),
        "link": F.when(found, F.col("link")), "side": F.explode(F.array(F.lit("gold"), F.lit("pred")))})
    changed = (F.col("side") == "pred") & (F.col("l_discount") == 0.1)
    sides = sides.filter((F.col("side") == "gold") | (F.col("l_tax") != 0.08)).withColumn(
        "unit", F.when(changed, F.concat(F.lit("X"), F.col("unit"))).otherwise(F.col("unit")))
    keep = ["query_id", "side", "clause", "pos", "unit", "unit_no_agg", "has_agg", "is_not", "op", "conn", "parent_id",
            "link", "db_id", "col_id", "value", "is_subquery"]
    return sides.select(keep)


CL = """
    lines AS (SELECT *, list_extract(['select','from','where','groupBy','having','orderBy','limit'], l_linenumber) AS clause,
      '__t' || (l_suppkey % 3) || '.c' || (l_suppkey % 5) || '__' AS col_id,
      (l_orderkey % 2 = 1 AND l_orderkey % 15 = 0 AND l_orderkey - 1 IN (SELECT l_orderkey FROM lineitem)) AS nested FROM lineitem),
    ops AS (SELECT *, CASE WHEN clause = 'orderBy' THEN CASE WHEN l_returnflag = 'A' THEN 'desc' ELSE 'asc' END
      WHEN l_discount = 0.0 THEN 'in' WHEN l_discount = 0.01 THEN 'like' ELSE '=' END AS op FROM lines),
    gold AS (SELECT l_orderkey AS query_id, 'gold' AS side, clause, l_linenumber::BIGINT AS pos,
      CASE WHEN clause IN ('groupBy','from') THEN col_id
           WHEN clause IN ('where','having') THEN (CASE WHEN l_linestatus = 'F' THEN 'true' ELSE 'false' END) || ' ' || op || ' ' || col_id
           ELSE l_returnflag || ' ' || op || ' ' || col_id END AS unit, col_id AS unit_no_agg,
      l_returnflag = 'A' AS has_agg, l_linestatus = 'F' AS is_not, op,
      CASE WHEN l_tax = 0 THEN NULL WHEN l_quantity > 25 THEN 'or' ELSE 'and' END AS conn,
      CASE WHEN nested THEN l_orderkey - 1 END AS parent_id,
      CASE WHEN nested THEN list_extract(['intersect','except','union'], (l_orderkey // 30) % 3 + 1) END AS link,
      'db' || l_returnflag AS db_id, col_id, (l_quantity::BIGINT)::VARCHAR AS value, l_linestatus = 'O' AS is_subquery,
      l_tax, l_discount FROM ops),
    pred AS (SELECT * REPLACE ('pred' AS side, CASE WHEN l_discount = 0.1 THEN 'X' || unit ELSE unit END AS unit)
      FROM gold WHERE l_tax <> 0.08),
    cl AS (SELECT * FROM gold UNION ALL SELECT * FROM pred),
    qs AS (SELECT query_id, bool_or(side = 'gold') AS has_gold, bool_and(parent_id IS NULL) AS is_root FROM cl GROUP BY query_id)"""


def units_sql(kind: str, clause: str, key: str) -> str:
    """SELECT (query_id, type, label_total, pred_total, cnt) of one unit type."""
    return f"""SELECT query_id, '{kind}' AS type, sum(gn)::BIGINT AS label_total, sum(pn)::BIGINT AS pred_total,
      sum(least(pn, gn))::BIGINT AS cnt FROM (SELECT query_id, {key} AS key, count_if(side = 'pred') AS pn,
      count_if(side = 'gold') AS gn FROM cl WHERE clause = '{clause}' GROUP BY query_id, key) GROUP BY query_id"""


LISTS = """
    lists AS (SELECT query_id,
      list(unit ORDER BY unit) FILTER (side='pred' AND clause='from') AS from_p,
      list(unit ORDER BY unit) FILTER (side='gold' AND clause='from') AS from_g,
      list(unit_no_agg ORDER BY pos, unit_no_agg) FILTER (side='pred' AND clause='groupBy') AS group_p,
      list(unit_no_agg ORDER BY pos, unit_no_agg) FILTER (side='gold' AND clause='groupBy') AS group_g,
      list(concat_ws('|', unit, conn) ORDER BY pos, unit, conn) FILTER (side='pred' AND clause='having') AS having_p,
      list(concat_ws('|', unit, conn) ORDER BY pos, unit, conn) FILTER (side='gold' AND clause='having') AS having_g,
      list(unit ORDER BY pos, unit) FILTER (side='pred' AND clause='orderBy') AS order_p,
      list(unit ORDER BY pos, unit) FILTER (side='gold' AND clause='orderBy') AS order_g,
      count_if(side='pred' AND clause='limit') > 0 AS limit_p, count_if(side='gold' AND clause='limit') > 0 AS limit_g,
      coalesce(list_sort(list(DISTINCT conn) FILTER (side='pred' AND clause='where' AND conn IS NOT NULL)), []) AS ao_p,
      coalesce(list_sort(list(DISTINCT conn) FILTER (side='gold' AND clause='where' AND conn IS NOT NULL)), []) AS ao_g
      FROM cl GROUP BY query_id)"""

HAVING = """SELECT query_id, 'group' AS type, (group_g IS NOT NULL)::BIGINT AS label_total, (group_p IS NOT NULL)::BIGINT AS pred_total,
      (group_g IS NOT NULL AND group_p IS NOT NULL AND group_g IS NOT DISTINCT FROM group_p
       AND having_g IS NOT DISTINCT FROM having_p)::BIGINT AS cnt FROM lists"""
ORDER = """SELECT query_id, 'order' AS type, (order_g IS NOT NULL)::BIGINT AS label_total, (order_p IS NOT NULL)::BIGINT AS pred_total,
      (order_g IS NOT NULL AND order_g IS NOT DISTINCT FROM order_p AND limit_p = limit_g)::BIGINT AS cnt FROM lists"""
AND_OR = """SELECT query_id, 'and/or' AS type, CASE WHEN ao_p = ao_g THEN 1 ELSE len(ao_p) END::BIGINT AS label_total,
      CASE WHEN ao_p = ao_g THEN 1 ELSE len(ao_g) END::BIGINT AS pred_total, (ao_p = ao_g)::BIGINT AS cnt FROM lists"""

KEYWORDS = """
    kw AS (SELECT query_id, side, 'where' AS word FROM cl WHERE clause='where'
      UNION SELECT query_id, side, 'group' FROM cl WHERE clause='groupBy'
      UNION SELECT query_id, side, 'having' FROM cl WHERE clause='having'
      UNION SELECT query_id, side, 'order' FROM cl WHERE clause='orderBy'
      UNION SELECT query_id, side, op FROM cl WHERE clause='orderBy'
      UNION SELECT query_id, side, 'limit' FROM cl WHERE clause='limit'
      UNION SELECT query_id, side, 'or' FROM cl WHERE clause IN ('where','having','on') AND conn='or'
      UNION SELECT query_id, side, 'not' FROM cl WHERE clause IN ('where','having','on') AND is_not
      UNION SELECT query_id, side, op FROM cl WHERE clause IN ('where','having','on') AND op IN ('in','like')
      UNION SELECT parent_id, side, link FROM cl WHERE link IN ('intersect','except','union'))"""
KEYS = """SELECT query_id, 'keywords' AS type, count_if(gg)::BIGINT AS label_total, count_if(pp)::BIGINT AS pred_total,
      count_if(gg AND pp)::BIGINT AS cnt FROM (SELECT query_id, word, bool_or(side='pred') AS pp, bool_or(side='gold') AS gg
      FROM kw GROUP BY query_id, word) GROUP BY query_id"""
GROUP_KEY = "CASE WHEN unit_no_agg LIKE '%.%' THEN split_part(unit_no_agg, '.', 2) ELSE unit_no_agg END"
TYPES = [t for t in g.PARTIAL_TYPES if t != "IUEN"]

# The clause tables nest one level deep, so sub-queries have no set operations of their own.
GRADED = with_(CL, LISTS, KEYWORDS) + f""",
    found AS ({units_sql('select', 'select', 'unit')} UNION ALL {units_sql('select(no AGG)', 'select', 'unit_no_agg')}
      UNION ALL {units_sql('where', 'where', 'unit')} UNION ALL {units_sql('where(no OP)', 'where', 'unit_no_agg')}
      UNION ALL {units_sql('group(no Having)', 'groupBy', GROUP_KEY)}
      UNION ALL {HAVING} UNION ALL {ORDER} UNION ALL {AND_OR} UNION ALL {KEYS}),
    flat AS (SELECT q.query_id, t.type, coalesce(f.label_total, 0) AS label_total, coalesce(f.pred_total, 0) AS pred_total,
      coalesce(f.cnt, 0) AS cnt FROM qs q CROSS JOIN (SELECT unnest({TYPES}) AS type) t LEFT JOIN found f
      ON f.query_id = q.query_id AND f.type = t.type),
    own AS (SELECT flat.query_id, (bool_and(pred_total = label_total AND cnt = pred_total)
      AND bool_and(from_g IS NULL OR from_g IS NOT DISTINCT FROM from_p))::BIGINT AS own FROM flat JOIN lists USING (query_id) GROUP BY flat.query_id),
    kids AS (SELECT query_id, parent_id, link, bool_or(side='pred') AS in_pred, bool_or(side='gold') AS in_gold
      FROM cl WHERE parent_id IS NOT NULL GROUP BY query_id, parent_id, link),
    sets AS (SELECT parent_id AS query_id, 'IUEN' AS type, count_if(in_gold)::BIGINT AS label_total, count_if(in_pred)::BIGINT AS pred_total,
      count_if(in_gold AND in_pred AND own = 1)::BIGINT AS cnt FROM kids JOIN own USING (query_id) GROUP BY parent_id),
    iuen AS (SELECT q.query_id, 'IUEN' AS type, coalesce(s.label_total, 0) AS label_total, coalesce(s.pred_total, 0) AS pred_total,
      coalesce(s.cnt, 0) AS cnt FROM qs q LEFT JOIN sets s USING (query_id)),
    partial AS (SELECT *, (pred_total = label_total AND cnt = pred_total)::BIGINT AS score FROM
      (SELECT * FROM flat UNION ALL SELECT * FROM iuen)),
    exact AS (SELECT query_id, own * (label_total = pred_total AND cnt = pred_total)::BIGINT AS exact FROM own JOIN iuen USING (query_id)),
    comp AS (SELECT query_id, count_if(clause='where') AS nw, count_if(clause='groupBy') AS ng, count_if(clause='orderBy') AS no,
      count_if(clause='limit') AS nl, count_if(clause='from') AS nf, count_if(clause='select') AS ns,
      count(*) FILTER (clause IN ('where','having','on') AND conn='or') AS nor, count_if(clause IN ('where','having','on') AND op='like') AS nlike,
      count_if(clause IN ('select','groupBy','orderBy') AND has_agg) + count_if(clause IN ('where','having') AND is_not)
      + count_if(clause='having' AND conn IS NOT NULL) AS nagg FROM gold GROUP BY query_id),
    kidn AS (SELECT parent_id AS query_id, count(*) AS c2 FROM kids WHERE in_gold GROUP BY parent_id),
    sums AS (SELECT query_id, ((nw>0)::INT + (ng>0)::INT + (no>0)::INT + (nl>0)::INT + greatest(nf-1, 0) + nor + nlike)::BIGINT AS c1,
      coalesce(c2, 0)::BIGINT AS c2, ((nagg>1)::INT + (ns>1)::INT + (nw>1)::INT + (ng>1)::INT)::BIGINT AS o
      FROM comp LEFT JOIN kidn USING (query_id)),
    levels AS (SELECT query_id, c1, c2, o, CASE WHEN c1<=1 AND o=0 AND c2=0 THEN 'easy'
      WHEN c2=0 AND ((o<=2 AND c1<=1) OR (c1<=2 AND o<2)) THEN 'medium'
      WHEN (o>2 AND c1<=2 AND c2=0) OR (c1>2 AND c1<=3 AND o<=2 AND c2=0) OR (c1<=1 AND o=0 AND c2<=1) THEN 'hard'
      ELSE 'extra' END AS hardness FROM sums),
    roots AS (SELECT levels.* FROM levels JOIN qs USING (query_id) WHERE has_gold AND is_root),
    ran AS (SELECT query_id, bool_and(pn = gn) AS same_result FROM (SELECT query_id, col_id, value, count_if(side='pred') AS pn,
      count_if(side='gold') AS gn FROM cl GROUP BY query_id, col_id, value) GROUP BY query_id)"""


def unit_query(name: str, kinds: list[tuple[str, str, str]]) -> None:
    sql = with_(CL) + " UNION ALL ".join(units_sql(*k) for k in kinds)

    def run(spark, sf):
        return g.unit_matches(clauses(spark, sf), [k[0] for k in kinds])
    query(name, sql)(run)


unit_query("match_select", [("select", "select", "unit"), ("select(no AGG)", "select", "unit_no_agg")])
unit_query("match_where", [("where", "where", "unit"), ("where(no OP)", "where", "unit_no_agg")])
unit_query("match_group", [("group(no Having)", "groupBy", GROUP_KEY)])


@query("match_having", with_(CL, LISTS) + HAVING)
def match_having(spark, sf):
    return g.having_match(clauses(spark, sf))


@query("match_order", with_(CL, LISTS) + ORDER)
def match_order(spark, sf):
    return g.order_match(clauses(spark, sf))


@query("match_and_or", with_(CL, LISTS) + AND_OR)
def match_and_or(spark, sf):
    return g.and_or_match(clauses(spark, sf))


@query("match_keywords", with_(CL, KEYWORDS) + KEYS)
def match_keywords(spark, sf):
    return g.keyword_match(clauses(spark, sf))


@query("keyword_match", with_(CL, KEYWORDS) + f""", sets AS (SELECT query_id, word, bool_or(side='pred') AS pp,
       bool_or(side='gold') AS gg FROM kw GROUP BY query_id, word)
       SELECT word AS keyword, count_if(pp)::BIGINT AS n_pred, count_if(gg)::BIGINT AS n_gold, count_if(gg AND pp)::BIGINT AS n_both,
       count_if(label_total = pred_total AND cnt = pred_total)::BIGINT AS n_matched
       FROM sets JOIN ({KEYS}) matched ON matched.query_id IS NOT DISTINCT FROM sets.query_id GROUP BY word""")
def keyword_match(spark, sf):
    return g.keyword_counts(clauses(spark, sf))


@query("nested_queries", GRADED + "SELECT query_id, parent_id, link, in_pred, in_gold FROM kids")
def nested_queries(spark, sf):
    return g.nested_queries(clauses(spark, sf))


@query("match_setops", GRADED + "SELECT query_id, type, label_total, pred_total, cnt FROM sets")
def match_setops(spark, sf):
    rows = materialize(clauses(spark, sf), "clauses")
    _, exact = g.grade(rows)
    return g.set_op_matches(g.nested_queries(rows), exact)


@query("partial_scores", GRADED + "SELECT query_id, type, label_total, pred_total, score FROM partial")
def partial_scores(spark, sf):
    return g.grade(materialize(clauses(spark, sf), "clauses"))[0].drop("cnt")


@query("exact_match", GRADED + "SELECT query_id, exact FROM exact")
def exact_match(spark, sf):
    return g.grade(materialize(clauses(spark, sf), "clauses"))[1]


@query("hardness", GRADED + "SELECT query_id, c1, c2, o, hardness FROM levels")
def hardness(spark, sf):
    return g.hardness(clauses(spark, sf))


def graded(spark, sf):
    rows = materialize(clauses(spark, sf), "clauses")
    levels = g.graded_roots(rows, g.hardness(rows))
    return rows, materialize(levels, "levels"), *g.grade(rows)


@query("eval_levels", GRADED + """SELECT CASE WHEN grouping(hardness) = 1 THEN 'all' ELSE hardness END AS level,
       count(*) AS n_queries, round(avg(exact), 6) AS exact, round(avg(same_result::INT), 6) AS exec
       FROM roots JOIN exact USING (query_id) JOIN ran USING (query_id) GROUP BY ROLLUP (hardness)""")
def eval_levels(spark, sf):
    rows, levels, _, exact = graded(spark, sf)
    columns = ["query_id", "col_id", "value"]
    ran = result_set_match(rows.filter(g.on_pred()).select(columns), rows.filter(g.on_gold()).select(columns),
                           ["col_id", "value"], ["query_id"])
    return g.eval_levels(levels, exact, ran)


@query("eval_partial", GRADED + """, avgs AS (SELECT CASE WHEN grouping(hardness) = 1 THEN 'all' ELSE hardness END AS level, type,
       coalesce(avg(score) FILTER (pred_total > 0), 0) AS a, coalesce(avg(score) FILTER (label_total > 0), 0) AS r
       FROM roots JOIN partial USING (query_id) GROUP BY GROUPING SETS ((hardness, type), (type)))
       SELECT level, type, round(a, 6) AS acc, round(r, 6) AS rec,
       round(CASE WHEN a = 0 AND r = 0 THEN 1.0 ELSE 2.0 * a * r / (a + r) END, 6) AS f1 FROM avgs""")
def eval_partial(spark, sf):
    _, levels, partial, _ = graded(spark, sf)
    return g.eval_partial(levels, partial)


@query("exact_match_rate", GRADED + "SELECT round(avg(exact), 6) AS exact_match FROM roots JOIN exact USING (query_id)")
def exact_match_rate(spark, sf):
    _, levels, _, exact = graded(spark, sf)
    return g.exact_match_rate(levels, exact)


@query("sink_eval_rows", GRADED + """SELECT query_id, hardness, exact, type, score FROM roots JOIN exact USING (query_id)
       JOIN partial USING (query_id)""")
def sink_eval_rows(spark, sf):
    from tailsplit.scratch import new_path
    from tailsplit.sources.writers import write_json_rows
    _, levels, partial, exact = graded(spark, sf)
    rows = levels.select("query_id", "hardness").join(exact, "query_id").join(
        partial.select("query_id", "type", "score"), "query_id")
    path = new_path(spark, "eval_rows")
    write_json_rows(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query("multiset_match", with_(r"""
    t AS (SELECT conv_id*4294967296+turn AS row_id, text FROM conversations),
    p AS (SELECT row_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+|[^\p{L}\p{N}\s]')) AS unit, 1 AS pn, 0 AS gn FROM t),
    g AS (SELECT row_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}\s]')) AS unit, 0 AS pn, 1 AS gn FROM t),
    c AS (SELECT row_id, unit, sum(pn) AS pn, sum(gn) AS gn FROM (SELECT * FROM p UNION ALL SELECT * FROM g) GROUP BY row_id, unit)""")
       + "SELECT row_id, sum(gn)::BIGINT AS label_total, sum(pn)::BIGINT AS pred_total, sum(least(pn, gn))::BIGINT AS cnt FROM c GROUP BY row_id")
def multiset(spark, sf):
    from tailsplit.functions.text import TOKEN_PATTERN, tokens
    turns = table(spark, sf, "conversations").select(joins.turn_id().alias("row_id"), "text")
    pred = turns.select("row_id", F.explode(tokens("text")).alias("unit"))
    gold = turns.select("row_id", F.explode(F.regexp_extract_all("text", F.lit(TOKEN_PATTERN), F.lit(0))).alias("unit"))
    return multiset_match(pred, gold, ["row_id"], ["unit"])


@query("result_set_match", GRADED + "SELECT query_id, same_result FROM ran")
def result_sets(spark, sf):
    rows = clauses(spark, sf)
    return result_set_match(rows.filter(g.on_pred()), rows.filter(g.on_gold()), ["col_id", "value"], ["query_id"])


# Every order is a query, its lines are the rows of its result. By the order's number the prediction selects in another
# order, swaps rows, repeats a column, returns nothing, failed, or selects something else.
RESULTS = """
    o3 AS (SELECT unnest(range(3)) AS o),
    head AS (SELECT o_orderkey AS query_id, 'gold' AS side, o AS ordinal, list_extract(['part','supp','flag'], o + 1) AS name FROM orders, o3
      UNION ALL SELECT o_orderkey, 'pred', (o + o_orderkey) % 3, CASE WHEN o_orderkey % 19 = 0 AND o = 1 THEN 'other'
        ELSE list_extract(['part','supp','flag'], o + 1) END FROM orders, o3 WHERE o_orderkey % 17 <> 0
      UNION ALL SELECT o_orderkey, 'pred', 3, 'part' FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey % 17 <> 0),
    golds AS (SELECT *, l_linenumber AS pos FROM lineitem WHERE l_orderkey % 11 <> 0),
    preds AS (SELECT * REPLACE (CASE WHEN l_orderkey % 4 = 0 AND pos <= 2 THEN 3 - pos ELSE pos END AS pos,
      CASE WHEN l_discount = 0.1 THEN 'X' || l_returnflag ELSE l_returnflag END AS l_returnflag)
      FROM golds WHERE l_orderkey % 13 <> 0 AND l_orderkey % 17 <> 0),
    cells AS (SELECT l_orderkey AS query_id, 'gold' AS side, o AS ordinal, pos,
      list_extract([l_partkey::VARCHAR, l_suppkey::VARCHAR, l_returnflag], o + 1) AS value FROM golds, o3
      UNION ALL SELECT l_orderkey, 'pred', (o + l_orderkey) % 3, pos,
      list_extract([l_partkey::VARCHAR, l_suppkey::VARCHAR, l_returnflag], o + 1) FROM preds, o3
      UNION ALL SELECT l_orderkey, 'pred', 3, pos, (l_partkey + l_orderkey % 2)::VARCHAR FROM preds WHERE l_orderkey % 7 = 0),
    lists AS (SELECT query_id, side, ordinal, name, list({'pos': pos, 'value': value} ORDER BY pos, value) FILTER (pos IS NOT NULL) AS vals
      FROM head LEFT JOIN cells USING (query_id, side, ordinal) GROUP BY ALL),
    lasts AS (SELECT * FROM lists QUALIFY row_number() OVER (PARTITION BY query_id, side, name ORDER BY ordinal DESC) = 1)"""


def result_tables(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(cells, columns) of the results of both sides."""
    names = ("part", "supp", "flag")
    key = F.col("o_orderkey")

    def head(side: str, ordinal, name, when):
        return F.struct(F.lit(side).alias("side"), ordinal.cast("long").alias("ordinal"), name.alias("name"), when.alias("_made"))

    failed = key % 17 == 0
    heads = [head("gold", F.lit(i), F.lit(n), F.lit(True)) for i, n in enumerate(names)]
    heads += [head("pred", (key + i) % 3, F.when((key % 19 == 0) & F.lit(n == "supp"), "other").otherwise(n), ~failed)
              for i, n in enumerate(names)]
    heads.append(head("pred", F.lit(3), F.lit("part"), (key % 7 == 0) & ~failed))
    columns = table(spark, sf, "orders").select(key.alias("query_id"), F.inline(F.array(*heads))).filter("_made").drop("_made")

    key, line = F.col("l_orderkey"), F.col("l_linenumber")

    def cell(side: str, ordinal, pos, value, when):
        return F.struct(F.lit(side).alias("side"), ordinal.cast("long").alias("ordinal"), pos.alias("pos"),
                        value.cast("string").alias("value"), when.alias("_made"))

    there, swapped = (key % 13 != 0) & (key % 17 != 0), F.when((key % 4 == 0) & (line <= 2), 3 - line).otherwise(line)
    golds = [F.col("l_partkey"), F.col("l_suppkey"), F.col("l_returnflag")]
    preds = golds[:2] + [F.when(F.col("l_discount") == 0.1, F.concat(F.lit("X"), golds[2])).otherwise(golds[2])]
    made = [cell("gold", F.lit(i), line, v, F.lit(True)) for i, v in enumerate(golds)]
    made += [cell("pred", (key + i) % 3, swapped, v, there) for i, v in enumerate(preds)]
    made.append(cell("pred", F.lit(3), swapped, golds[0] + key % 2, there & (key % 7 == 0)))
    cells = table(spark, sf, "lineitem").filter(key % 11 != 0).select(
        key.alias("query_id"), F.inline(F.array(*made))).filter("_made").drop("_made")
    return cells, columns


@query("result_columns_match", with_(RESULTS) + """SELECT query_id, bool_and(p.name IS NOT NULL AND g.name IS NOT NULL
       AND p.vals IS NOT DISTINCT FROM g.vals) AS same_result FROM (SELECT * FROM lasts WHERE side = 'pred') p
       FULL JOIN (SELECT * FROM lasts WHERE side = 'gold') g USING (query_id, name) GROUP BY query_id""")
def result_columns_match(spark, sf):
    """Execution match with columns aligned by what they select, rows in order."""
    return aligned_match(*result_tables(spark, sf), ["query_id"])


@query("null_values", with_(CL) + "SELECT query_id, side, pos, unit, CASE WHEN is_subquery THEN value END AS value FROM cl")
def null_values(spark, sf):
    return g.null_values(clauses(spark, sf)).select("query_id", "side", "pos", "unit", "value")


def columns_of(rows: DataFrame) -> DataFrame:
    return rows.select("db_id", "col_id").distinct()


@query("valid_columns", with_(CL) + """, cat AS (SELECT DISTINCT col_id, split_part(col_id, '.', 1) AS tab FROM cl)
       SELECT DISTINCT query_id, side, cat.col_id FROM cl JOIN cat ON cat.tab = split_part(cl.col_id, '.', 1) WHERE clause = 'from'""")
def valid_columns(spark, sf):
    rows = clauses(spark, sf)
    return g.valid_columns(rows, rows.select("col_id").distinct())


CANON = """,
    cols AS (SELECT DISTINCT db_id, col_id, split_part(col_id, '.', 2) AS name FROM cl),
    canon AS (SELECT db_id, col_id, min(col_id) OVER (PARTITION BY db_id, name) AS canonical_id FROM cols)"""


def linked_columns(rows: DataFrame) -> DataFrame:
    """Same-named columns of a database are linked to the next table's, as foreign keys would be."""
    cols = columns_of(rows).withColumn("name", F.split_part("col_id", F.lit("."), F.lit(2)))
    first = cols.groupBy("db_id", "name").agg(F.min("col_id").alias("first_id"))
    return fk.canonical_ids(cols.join(first, ["db_id", "name"]), "col_id", "first_id", ["db_id"]).withColumnRenamed(
        "id", "col_id")


@query("join_fk_canon", with_(CL) + CANON + """,
       reads AS (SELECT DISTINCT query_id, side, split_part(col_id, '.', 1) AS tab FROM cl WHERE clause = 'from')
       SELECT cl.query_id, cl.side, pos, unit, CASE WHEN reads.tab IS NOT NULL THEN canonical_id ELSE cl.col_id END AS col_id
       FROM cl JOIN canon ON canon.db_id = cl.db_id AND canon.col_id = cl.col_id
       LEFT JOIN reads ON reads.query_id = cl.query_id AND reads.side = cl.side AND reads.tab = split_part(cl.col_id, '.', 1)""")
def join_fk_canon(spark, sf):
    rows = materialize(clauses(spark, sf), "clauses")
    canonical = materialize(linked_columns(rows), "canonical")
    return g.canonical_columns(rows, canonical).select("query_id", "side", "pos", "unit", "col_id")


@query("fk_canonical_ids", """WITH RECURSIVE nodes AS (SELECT conv_id*4294967296+turn AS id, conv_id, turn FROM conversations),
       walk AS (SELECT id, conv_id, turn, id AS root FROM nodes n WHERE NOT EXISTS
         (SELECT 1 FROM nodes m WHERE m.conv_id = n.conv_id AND m.turn = n.turn - 1)
         UNION ALL SELECT n.id, n.conv_id, n.turn, w.root FROM walk w JOIN nodes n ON n.conv_id = w.conv_id AND n.turn = w.turn + 1)
       SELECT id, root AS canonical_id FROM walk
       WHERE EXISTS (SELECT 1 FROM nodes m WHERE m.conv_id = walk.conv_id AND abs(m.turn - walk.turn) = 1)""")
def fk_canonical_ids(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"))
    edges = turns.join(after, ["conv_id", "turn"], "left_semi").select(
        joins.turn_id().alias("a"), (joins.turn_id() + 1).alias("b"))
    return fk.canonical_ids(edges, "a", "b")
