"""Grading of structured queries as a relational job on clause tables.

A clause table has one row per unit of a query:

    query_id, side (pred | gold), clause, pos, unit, unit_no_agg, has_agg, is_not, op, conn,
    parent_id, link

``clause`` is one of CLAUSES. ``pos`` is the ordinal of the unit in its clause. ``unit`` is its
whole identity, ``unit_no_agg`` the identity without aggregate (select) or without negation and
operator (where), and the plain column in groupBy. ``conn`` is the connector that follows a
condition. A sub-query has its own ``query_id``, the same on both sides, the ``parent_id`` of
its query and in ``link`` the place where it hangs: a set operation or a clause.

Two ordered lists are equal exactly if the bags of their (pos, unit) are, so that no list is
ever gathered: a query of any size is counted with partial aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailsplit.operators.joins import lookup, same
from tailsplit.scratch import materialize

# Fixed values of the grading scheme.
CLAUSES = ("select", "from", "on", "where", "groupBy", "having", "orderBy", "limit")
CONDITIONS = ("on", "where", "having")
SET_OPS = ("intersect", "except", "union")
PARTIAL_TYPES = ("select", "select(no AGG)", "where", "where(no OP)", "group(no Having)", "group", "order",
                 "and/or", "IUEN", "keywords")
LEVELS = ("easy", "medium", "hard", "extra", "all")


def on_pred() -> Column:
    return F.col("side") == "pred"


def on_gold() -> Column:
    return F.col("side") == "gold"


def _clause(*names: str) -> Column:
    return F.col("clause").isin(*names)


# Types whose keys are multisets, sets of words, and ordered or unordered lists.
BAGS = ("select", "select(no AGG)", "where", "where(no OP)", "group(no Having)")
WORDS = ("keywords", "connectors")
LISTS = ("from", "groupBy", "having", "orderBy", "limit")


# Known words are bits of one number, connectors after the keywords; other words are counted one by one.
KEYWORD_BITS = {w: 1 << i for i, w in enumerate(("where", "group", "having", "order", "limit", "or", "not", "in", "like", *SET_OPS,
                                                 "asc", "desc"))}
CONNECTOR_BITS = {"and": 1 << 40, "or": 1 << 41}
WORD_BITS = {"keywords": KEYWORD_BITS, "connectors": CONNECTOR_BITS}


def _bit_of(word: Column, bits: dict[str, int]) -> Column:
    """The bit of a known word, 0 for any other and for none."""
    out = F
    for known, bit in bits.items():
        out = out.when(word == known, F.lit(bit).cast("long"))
    return out.otherwise(F.lit(0).cast("long"))


def _own_bits(kinds: Sequence[str]) -> Column:
    """The known words that a row of the clause table stands for, as bits."""
    def fixed(word: str, when: Column) -> Column:
        return F.when(when, F.lit(KEYWORD_BITS[word]).cast("long")).otherwise(F.lit(0).cast("long"))

    def all_of(*bits: Column) -> Column:
        return reduce(Column.bitwiseOR, bits)

    always = F.lit(True)
    condition = [fixed("or", F.col("conn") == "or"), fixed("not", F.col("is_not")),
                 _bit_of(F.col("op"), {w: KEYWORD_BITS[w] for w in ("in", "like")})]
    words = {"on": condition, "where": [fixed("where", always), *condition], "groupBy": [fixed("group", always)],
             "having": [fixed("having", always), *condition], "limit": [fixed("limit", always)],
             "orderBy": [fixed("order", always), _bit_of(F.col("op"), KEYWORD_BITS)]} if "keywords" in kinds else {}
    if "connectors" in kinds:
        words["where"] = [*words.get("where", []), _bit_of(F.col("conn"), CONNECTOR_BITS)]
    out = F.lit(0).cast("long")
    for clause, bits in words.items():
        out = F.when(_clause(clause), all_of(*bits)).otherwise(out)
    return out


def _entries(kinds: Sequence[str], packed: bool = False) -> Column:
    """What a row of the clause table counts for: array of (query_id, kind, pos, key).

    ``packed``: known words are left to the column ``_bits``, which every entry carries.
    """
    column = F.when(F.contains(F.col("unit_no_agg"), F.lit(".")), F.split_part("unit_no_agg", F.lit("."), F.lit(2))
                    ).otherwise(F.col("unit_no_agg"))

    def entry(kind: str, key: Column, ordered: bool = False, query_id: str = "query_id", when: Column | None = None,
              bits: Column | None = None) -> Column | None:
        if kind not in kinds and kind not in ("query", "link"):
            return None
        pos = F.col("pos").cast("long") if ordered else F.lit(None).cast("long")
        made = [F.col(query_id).alias("query_id"), F.lit(kind).alias("kind"), pos.alias("pos"), key.alias("key")]
        if packed:
            made.append((F.col("_bits") if bits is None else bits).alias("bits"))
        made = F.struct(*made)
        return made if when is None else F.when(when, made)

    def word(key: Column, known: bool = True, **more) -> Column | None:
        return None if packed and known else entry("keywords", key, **more)

    def other(value: Column, bits: dict[str, int]) -> Column:
        return value.isNotNull() & ~value.isin(*bits) if packed else value.isNotNull()

    condition = [word(F.lit("or"), when=F.col("conn") == "or"), word(F.lit("not"), when=F.col("is_not")),
                 word(F.col("op"), when=F.col("op").isin("in", "like"))]
    by_clause = {
        "select": [entry("select", F.col("unit")), entry("select(no AGG)", F.col("unit_no_agg"))],
        "from": [entry("from", F.col("unit"))],
        "on": condition,
        "where": [entry("where", F.col("unit")), entry("where(no OP)", F.col("unit_no_agg")),
                  entry("connectors", F.col("conn"), when=other(F.col("conn"), CONNECTOR_BITS)), word(F.lit("where")), *condition],
        "groupBy": [entry("group(no Having)", column), entry("groupBy", F.col("unit_no_agg"), ordered=True),
                    word(F.lit("group"))],
        "having": [entry("having", F.concat_ws("\u0001", "unit", "conn"), ordered=True), word(F.lit("having")),
                   *condition],
        "orderBy": [entry("orderBy", F.col("unit"), ordered=True), word(F.lit("order")),
                    word(F.col("op"), known=False, when=other(F.col("op"), KEYWORD_BITS))],
        "limit": [entry("limit", F.lit("")), word(F.lit("limit"))],
    }
    # A set operation is a keyword of the query it hangs on.
    set_op = {"query_id": "parent_id", "when": F.col("link").isin(*SET_OPS)}
    hung = word(F.col("link"), **set_op)
    if packed and "keywords" in kinds:
        hung = entry("link", F.lit(""), bits=_bit_of(F.col("link"), KEYWORD_BITS), **set_op)
    always = {"select", "from", "where", "groupBy", "having", "orderBy", "limit"}

    def listed(clause: str | None, entries: list) -> Column:
        own = [e for e in entries if e is not None]
        if clause not in always or by_clause[clause][0] is None:  # every row tells that its query exists
            own.append(entry("query", F.lit("")))
        return F.array_compact(F.array(*own, *([] if hung is None else [hung])))

    out = listed(None, [])
    for clause, entries in by_clause.items():
        out = F.when(_clause(clause), listed(clause, entries)).otherwise(out)
    return out


def _counted(clauses: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """(query_id, kind, pos, key, p, g): how often each key occurs on each side."""
    return clauses.select("side", F.inline(_entries(kinds))).groupBy("query_id", "kind", "pos", "key").agg(
        F.count_if(on_pred()).alias("p"), F.count_if(on_gold()).alias("g"))


def compare_sides(clauses: DataFrame, kinds: Sequence[str] = (*BAGS, *WORDS, *LISTS)) -> DataFrame:
    """One row per query with (gold, pred, match) of every kind: the whole comparison in one pass.

    For bags ``match`` is the size of the multiset intersection, for sets of words the number of
    common ones, and for lists 1 if both sides agree. A set of known words is one number, so that only
    units and words unknown take part in the shuffle on their own.
    """
    columns = [F.bool_or((F.col("kind") != "link") & (F.col("g") > 0)).alias("has_gold")]

    def total(kind: str, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, value)), F.lit(0))

    def words(kind: str, bits: Column) -> Column:
        return F.bit_count(F.coalesce(bits, F.lit(0).cast("long")).bitwiseAND(F.lit(sum(WORD_BITS[kind].values())).cast("long"))).cast("long")

    of_pred, of_gold = F.bit_or("bits_p"), F.bit_or("bits_g")
    for kind in kinds:
        p, g = F.col("p"), F.col("g")
        if kind in WORDS:
            p, g = _int(p > 0), _int(g > 0)
            found = [total(kind, g) + words(kind, of_gold), total(kind, p) + words(kind, of_pred),
                     total(kind, F.least(p, g)) + words(kind, of_pred.bitwiseAND(of_gold))]
        elif kind in LISTS:
            agree = F.coalesce(F.bool_and(F.when(F.col("kind") == kind, p == g)), F.lit(True))
            found = [total(kind, g), total(kind, p), _int(agree)]
        else:
            found = [total(kind, g), total(kind, p), total(kind, F.least(p, g))]
        columns += [c.alias(f"{kind}|{name}") for c, name in zip(found, ("gold", "pred", "match"))]
    rows = clauses.select("*", _own_bits(kinds).alias("_bits")).select("side", F.inline(_entries(kinds, packed=True)))
    counted = rows.groupBy("query_id", "kind", "pos", "key").agg(
        F.count_if(on_pred()).alias("p"), F.count_if(on_gold()).alias("g"),
        F.bit_or(F.when(on_pred(), F.col("bits"))).alias("bits_p"), F.bit_or(F.when(on_gold(), F.col("bits"))).alias("bits_g"))
    return counted.groupBy("query_id").agg(*columns)


def _at(kind: str, name: str) -> Column:
    return F.col(f"`{kind}|{name}`")


def _int(cond: Column) -> Column:
    return cond.cast("long")


def bag_totals(kind: str) -> tuple[Column, Column, Column]:
    """(label_total, pred_total, cnt) of a multiset or a set of words."""
    return _at(kind, "gold"), _at(kind, "pred"), _at(kind, "match")


def group_totals() -> tuple[Column, Column, Column]:
    """1 iff both sides group, by the same columns in the same order, with the same having."""
    gold, pred = _at("groupBy", "gold") > 0, _at("groupBy", "pred") > 0
    same = (_at("groupBy", "match") == 1) & (_at("having", "match") == 1)
    return _int(gold), _int(pred), _int(gold & pred & same)


def order_totals() -> tuple[Column, Column, Column]:
    """1 iff the order lists agree and both sides or neither have a limit, whatever its value."""
    gold, pred = _at("orderBy", "gold") > 0, _at("orderBy", "pred") > 0
    parity = (_at("limit", "gold") > 0) == (_at("limit", "pred") > 0)
    return _int(gold), _int(pred), _int(gold & (_at("orderBy", "match") == 1) & parity)


def and_or_totals() -> tuple[Column, Column, Column]:
    """1 iff the sets of connectors agree; otherwise the totals are the set sizes, sides swapped as published."""
    gold, pred, common = bag_totals("connectors")
    same = (gold == common) & (pred == common)
    one = F.lit(1).cast("long")
    return F.when(same, one).otherwise(pred), F.when(same, one).otherwise(gold), _int(same)


def _long(sides: DataFrame, totals: dict[str, tuple[Column, Column, Column]]) -> DataFrame:
    """(query_id, type, label_total, pred_total, cnt) from the wide comparison."""
    rows = F.array(*[F.struct(F.lit(kind).alias("type"), label.cast("long").alias("label_total"),
                              pred.cast("long").alias("pred_total"), cnt.cast("long").alias("cnt"))
                     for kind, (label, pred, cnt) in totals.items()])
    return sides.select("query_id", F.inline(rows))


def unit_matches(clauses: DataFrame, kinds: Sequence[str] = BAGS) -> DataFrame:
    """(query_id, type, label_total, pred_total, cnt) of the unit types that a query has."""
    found = _long(compare_sides(clauses, kinds), {k: bag_totals(k) for k in kinds})
    return found.filter((F.col("label_total") > 0) | (F.col("pred_total") > 0))


def having_match(clauses: DataFrame) -> DataFrame:
    return _long(compare_sides(clauses, ("groupBy", "having")), {"group": group_totals()})


def order_match(clauses: DataFrame) -> DataFrame:
    return _long(compare_sides(clauses, ("orderBy", "limit")), {"order": order_totals()})


def and_or_match(clauses: DataFrame) -> DataFrame:
    return _long(compare_sides(clauses, ("connectors",)), {"and/or": and_or_totals()})


def keyword_sets(clauses: DataFrame) -> DataFrame:
    """(query_id, keyword, in_pred, in_gold): the keywords of every query."""
    return _counted(clauses, ("keywords",)).filter(F.col("kind") == "keywords").select(
        "query_id", F.col("key").alias("keyword"), (F.col("p") > 0).alias("in_pred"), (F.col("g") > 0).alias("in_gold"))


def keyword_match(clauses: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """Sizes of both keyword sets and of their intersection, for the queries with keywords.

    ``words`` are the ``keyword_sets`` of the clauses, if they are there already.
    """
    words = keyword_sets(clauses) if words is None else words
    return words.groupBy("query_id").agg(
        F.count_if("in_gold").alias("label_total"), F.count_if("in_pred").alias("pred_total"),
        F.count_if(F.col("in_pred") & F.col("in_gold")).alias("cnt")).select(
        "query_id", F.lit("keywords").alias("type"), "label_total", "pred_total", "cnt")


def keyword_counts(clauses: DataFrame) -> DataFrame:
    """(keyword, n_pred, n_gold, n_both, n_matched): in how many queries a keyword occurs on each side and on both, and how
    many of the queries that have it have the same keywords on both sides."""
    words = keyword_sets(clauses)
    hit = score(F.col("pred_total"), F.col("label_total"), F.col("cnt")) == 1
    matched = keyword_match(clauses, words).select(F.col("query_id").alias("_query"), hit.alias("_hit"))
    return words.join(matched, same(words["query_id"], matched["_query"])).groupBy("keyword").agg(
        F.count_if("in_pred").alias("n_pred"), F.count_if("in_gold").alias("n_gold"),
        F.count_if(F.col("in_pred") & F.col("in_gold")).alias("n_both"), F.count_if("_hit").alias("n_matched"))


def nested_queries(clauses: DataFrame) -> DataFrame:
    """(query_id, parent_id, link, in_pred, in_gold) of every sub-query."""
    return clauses.filter(F.col("parent_id").isNotNull()).groupBy("query_id", "parent_id", "link").agg(
        F.bool_or(on_pred()).alias("in_pred"), F.bool_or(on_gold()).alias("in_gold"))


def query_list(clauses: DataFrame) -> DataFrame:
    """(query_id, has_gold, is_root) of every query."""
    return clauses.groupBy("query_id").agg(F.bool_or(on_gold()).alias("has_gold"),
                                           F.bool_and(F.col("parent_id").isNull()).alias("is_root"))


def score(pred_total: Column, label_total: Column, cnt: Column) -> Column:
    """All or nothing: 1 if the totals agree and all units are matched."""
    return _int((pred_total == label_total) & (cnt == pred_total))


def set_op_matches(children: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, type, totals, cnt): set-operation sub-queries present on each side and exactly matched."""
    graded = children.filter(F.col("link").isin(*SET_OPS)).join(exact.select("query_id", "exact"), "query_id")
    both = F.col("in_pred") & F.col("in_gold") & (F.col("exact") == 1)
    return graded.groupBy(F.col("parent_id").alias("query_id")).agg(
        F.count_if("in_gold").alias("label_total"), F.count_if("in_pred").alias("pred_total"),
        F.count_if(both).alias("cnt")).select("query_id", F.lit("IUEN").alias("type"), "label_total", "pred_total", "cnt")


def grade(clauses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(partial, exact) tables of every query, sub-queries included.

    partial: (query_id, type, label_total, pred_total, cnt, score); exact: (query_id, exact).
    A query's own clauses are counted once. Then the verdict of sub-queries is carried up, one
    level per round, until nothing changes: as many rounds as the deepest nesting.
    """
    sides = materialize(compare_sides(clauses), "sides")
    totals = {k: bag_totals(k) for k in BAGS} | {
        "group": group_totals(), "order": order_totals(), "and/or": and_or_totals(), "keywords": bag_totals("keywords")}
    children = materialize(nested_queries(clauses), "children")
    own_score = F.lit(1).cast("long")
    for label, pred, cnt in totals.values():
        own_score = own_score * score(pred, label, cnt)
    tables = (_at("from", "gold") == 0) | (_at("from", "match") == 1)
    own = sides.select("query_id", (own_score * _int(tables)).alias("own"))

    flat = _long(sides, totals)
    hit = score(F.col("pred_total"), F.col("label_total"), F.col("cnt"))
    exact = own.select("query_id", F.col("own").alias("exact"))
    sets, before = None, None
    while True:  # a verdict only ever falls, so that nothing changes in the end
        sets = materialize(set_op_matches(children, exact), "sets")
        state = tuple(sets.agg(F.count(F.lit(1)), F.sum("cnt")).first())
        verdict = sets.select("query_id", hit.alias("nested"))
        exact = materialize(own.join(verdict, "query_id", "left").select(
            "query_id", (F.col("own") * F.coalesce("nested", F.lit(1))).alias("exact")), "exact")
        if state == before or not state[0]:
            break
        before = state
    none = own.join(sets, "query_id", "left_anti").select(
        "query_id", F.lit("IUEN").alias("type"), *[F.lit(0).cast("long").alias(c) for c in
                                                   ("label_total", "pred_total", "cnt")])
    partial = flat.unionByName(sets).unionByName(none).withColumn("score", hit)
    return partial, exact


def hardness(clauses: DataFrame, nested: DataFrame | None = None) -> DataFrame:
    """(query_id, hardness) of the gold side from its component counts.

    ``nested`` gives (query_id, n_nested) where sub-queries have no rows of their own; otherwise they are counted here,
    those in a table list left out. A column ``n_agg`` says how many aggregates a unit has, if it may have several.
    """
    def n(cond: Column) -> Column:
        return F.count_if(F.coalesce(cond, F.lit(False)))

    cond = _clause(*CONDITIONS)
    listed = _clause("select", "groupBy", "orderBy")
    aggregates = n(listed & F.col("has_agg"))
    if "n_agg" in clauses.columns:
        aggregates = F.coalesce(F.sum(F.when(listed, F.col("n_agg"))), F.lit(0))
    counts = clauses.filter(on_gold()).groupBy("query_id").agg(
        n(_clause("where")).alias("n_where"), n(_clause("groupBy")).alias("n_group"),
        n(_clause("orderBy")).alias("n_order"), n(_clause("limit")).alias("n_limit"),
        n(_clause("from")).alias("n_from"), n(_clause("select")).alias("n_select"),
        n(cond & (F.col("conn") == "or")).alias("n_or"), n(cond & (F.col("op") == "like")).alias("n_like"),
        # Flags stand for aggregates: the negation flag in conditions, and connectors in having.
        (aggregates + n(_clause("where", "having") & F.col("is_not"))
         + n(_clause("having") & F.col("conn").isNotNull())).alias("n_agg"))
    if nested is None:
        inside = on_gold() & F.col("parent_id").isNotNull() & (F.coalesce("link", F.lit("")) != "from")
        nested = clauses.filter(inside).groupBy("parent_id").agg(
            F.countDistinct("query_id").alias("n_nested")).withColumnRenamed("parent_id", "query_id")
    all_counts = counts.join(nested, "query_id", "left").withColumn("n_nested", F.coalesce("n_nested", F.lit(0)))
    present = sum((_int(F.col(c) > 0) for c in ("n_where", "n_group", "n_order", "n_limit")), F.lit(0))
    c1 = present + F.greatest(F.col("n_from") - 1, F.lit(0)) + F.col("n_or") + F.col("n_like")
    others = sum((_int(F.col(c) > 1) for c in ("n_agg", "n_select", "n_where", "n_group")), F.lit(0))
    staged = all_counts.select("query_id", c1.alias("c1"), F.col("n_nested").alias("c2"), others.alias("o"))
    flat = F.col("c2") == 0
    level = (F.when((F.col("c1") <= 1) & (F.col("o") == 0) & flat, "easy")
             .when(flat & (((F.col("o") <= 2) & (F.col("c1") <= 1)) | ((F.col("c1") <= 2) & (F.col("o") < 2))), "medium")
             .when((flat & (F.col("o") > 2) & (F.col("c1") <= 2))
                   | (flat & (F.col("c1") == 3) & (F.col("o") <= 2))
                   | ((F.col("c1") <= 1) & (F.col("o") == 0) & (F.col("c2") <= 1)), "hard")
             .otherwise("extra"))
    return staged.select("query_id", "c1", "c2", "o", level.alias("hardness"))


def graded_roots(clauses: DataFrame, per_query: DataFrame) -> DataFrame:
    """Rows of ``per_query`` for the queries that count: no sub-queries, and a readable gold side."""
    return query_list(clauses).filter("has_gold AND is_root").select("query_id").join(per_query, "query_id")


def eval_levels(levels: DataFrame, exact: DataFrame, executed: DataFrame | None = None) -> DataFrame:
    """(level, n_queries, exact[, exec]) by hardness and for all."""
    rows = levels.select("query_id", "hardness").join(exact.select("query_id", "exact"), "query_id")
    measures = [F.count(F.lit(1)).alias("n_queries"), F.round(F.avg("exact"), 6).alias("exact")]
    if executed is not None:
        rows = rows.join(executed.select("query_id", "same_result"), "query_id", "left")
        measures.append(F.round(F.avg(F.coalesce(F.col("same_result"), F.lit(False)).cast("double")), 6).alias("exec"))
    out = rows.rollup("hardness").agg(*measures, F.grouping_id().alias("_all"))
    return out.withColumn("level", F.when(F.col("_all") == 1, "all").otherwise(F.col("hardness"))).select(
        "level", *[c for c in out.columns if c not in ("hardness", "_all")])


def eval_partial(levels: DataFrame, partial: DataFrame) -> DataFrame:
    """(level, type, acc, rec, f1): averages over the rows where the side in question is present.

    F1 is 1 where both averages are 0, as the published grader has it.
    """
    rows = partial.join(levels.select("query_id", "hardness"), "query_id")
    hit = F.col("score").cast("double")
    out = rows.groupingSets([["hardness", "type"], ["type"]], "hardness", "type").agg(
        F.coalesce(F.avg(F.when(F.col("pred_total") > 0, hit)), F.lit(0.0)).alias("a"),
        F.coalesce(F.avg(F.when(F.col("label_total") > 0, hit)), F.lit(0.0)).alias("r"),
        F.grouping("hardness").alias("_all"))
    f1 = F.when((F.col("a") == 0) & (F.col("r") == 0), F.lit(1.0)).otherwise(
        F.try_divide(2.0 * F.col("a") * F.col("r"), F.col("a") + F.col("r")))
    return out.select(F.when(F.col("_all") == 1, "all").otherwise(F.col("hardness")).alias("level"), "type",
                      F.round("a", 6).alias("acc"), F.round("r", 6).alias("rec"), F.round(f1, 6).alias("f1"))


def null_values(clauses: DataFrame, value: str = "value", is_subquery: str = "is_subquery") -> DataFrame:
    """Literal values blanked out, nested queries kept."""
    return clauses.withColumn(value, F.when(F.col(is_subquery), F.col(value)))


def table_of(col_id: Column) -> Column:
    """``__t`` of the column ``__t.c__`` and of the table ``__t__``; null for anything else."""
    table = F.regexp_extract(col_id, r"^(__.+)__$", 1)
    return F.when(F.contains(col_id, F.lit(".")), F.substring_index(col_id, ".", 1)).when(table != "", table)


def query_tables(clauses: DataFrame, col_id: str = "col_id") -> DataFrame:
    """(query_id, side, table_key, n, valid): tables of a query's units, how often they are used, and
    whether the query reads from them."""
    return clauses.withColumn("table_key", table_of(F.col(col_id))).filter(F.col("table_key").isNotNull()).groupBy(
        "query_id", "side", "table_key").agg(F.count(F.lit(1)).alias("n"),
                                             F.bool_or(_clause("from")).alias("valid"))


def valid_columns(clauses: DataFrame, catalog: DataFrame) -> DataFrame:
    """(query_id, side, col_id): catalog columns of the tables a query reads from.

    The catalog has a row per column. With ``db_id`` on both sides a table is looked up in the query's own database only.
    """
    scope = ["db_id"] if "db_id" in clauses.columns and "db_id" in catalog.columns else []
    read = clauses.filter(_clause("from")).withColumn("table_key", table_of(F.col("col_id"))).filter(
        F.col("table_key").isNotNull()).select("query_id", "side", *scope, "table_key").distinct()
    columns = catalog.filter(F.contains("col_id", F.lit("."))).withColumn("table_key", table_of(F.col("col_id")))
    found = read.join(columns.select(*scope, "table_key", "col_id").distinct(), [*scope, "table_key"])
    return found.select("query_id", "side", "col_id").distinct()


def canonical_columns(clauses: DataFrame, canonical: DataFrame) -> DataFrame:
    """Column ids replaced by the canonical id of their linked group, where the query reads the
    column's table; others unchanged. The distinct flag, if there is one, is dropped from the
    comparison. ``canonical``: (db_id, col_id, canonical_id)."""
    keyed = clauses.withColumn("table_key", table_of(F.col("col_id")))
    tables = materialize(query_tables(clauses), "query_tables")
    known = lookup(keyed, tables, ["query_id", "side", "table_key"], freq="n", spread_by=["query_id", "pos", "unit"])
    linked = lookup(known, canonical.select("db_id", "col_id", "canonical_id"), ["db_id", "col_id"])
    new_id = F.when(F.col("valid") & F.col("canonical_id").isNotNull(), F.col("canonical_id")).otherwise(F.col("col_id"))
    out = linked.withColumn("col_id", new_id).select(*clauses.columns)
    return out.withColumn("is_distinct", F.lit(None).cast("boolean")) if "is_distinct" in clauses.columns else out


def exact_match_rate(levels: DataFrame, exact: DataFrame) -> DataFrame:
    """Mean exact match over all graded queries."""
    return eval_levels(levels, exact).filter("level = 'all'").select(F.col("exact").alias("exact_match"))
