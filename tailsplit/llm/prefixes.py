"""The trie of conversation prefixes, with the sums of all its subtrees from one Euler tour.

A node stands for one sequence of first turns; its key is a sum of hashes of the turns with their positions, so that the
keys of a long conversation come from prefix sums over ranges of turns instead of one task. The tour enters and leaves
every node once. These arcs form a linked list, which is ranked without walking it: each block of arcs contracts its own
stretches, of what is left random arcs are taken up by the one before until few remain, and the ranks are handed back in
the opposite order. In tour order a subtree is a stretch, and its leaves and savings are differences of prefix sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tailsplit.operators.joins import lookup
from tailsplit.operators.ranking import rank_rows
from tailsplit.scratch import materialize, row_count

FAMILY = 100  # conversations that share the head of the first of them
HEADS = 6  # remainders of the crc32 that tell how many turns of the head are taken
BLOCK_NODES = 100_000
LAST_ARCS = 20_000  # a list of so few arcs is ranked in one task
STRETCH = 1 << 13  # arcs whose prefix sums one window takes
BLOB = 1 << 16  # characters
ID_BITS = 33  # partition and row of a written node, as monotonically_increasing_id lays them out


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv, place, d, chars): the turns of each conversation by their position, with a digest of role and text."""
    role, text = (F.coalesce(conversations[c], F.lit("")) for c in ("role", "text"))
    narrow = conversations.where(conversations["conv_id"].isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn"),
        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("d"),
        F.char_length(text).cast("long").alias("chars"))
    ranked = rank_rows(narrow, [F.col("turn").asc_nulls_first(), F.col("d")], by=["conv"], name="place")
    return materialize(ranked.drop("turn"), "turns")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv, length, depth, d, chars) of each turn of the rebuilt conversations, and of the root that all begin with."""
    first_of = F.col("conv") - F.col("conv") % FAMILY
    taken = (F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS).alias("h")
    own = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).select("conv", "n", first_of.alias("base"), taken)
    heads = own.where(F.col("conv") == F.col("base")).select("base", F.col("n").alias("base_n"))
    convs = materialize(own.join(heads, "base", "left").select(
        "conv", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("head"),
        (F.least("h", F.coalesce("base_n", F.lit(0))) + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")),
        "conversations")
    # At most HEADS - 1 turns and FAMILY conversations meet on a head.
    shared = turns.where((F.col("place") < HEADS) & (F.col("conv") % FAMILY == 0)).select(
        F.col("conv").alias("base"), "place", "d", "chars")
    before = convs.join(shared, "base").where(F.col("place") <= F.col("head")).select(
        "conv", "length", F.col("place").alias("depth"), "d", "chars")
    after = turns.join(convs.select("conv", "h", "head", "length"), "conv").where(F.col("place") > F.col("h")).select(
        "conv", "length", (F.col("place") - F.col("h") + F.col("head")).alias("depth"), "d", "chars")
    root = convs.select("conv", "length", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("d"),
                        F.lit(0).cast("long").alias("chars"))
    return root.unionByName(before).unionByName(after)


def keyed(occurrences: DataFrame) -> DataFrame:
    """Adds the key (a, b) of the node that each occurrence ends in, and (up_a, up_b) of the node above.

    Keys are running sums, in exclusive or, of two hashes of turn and position. A conversation may lie in many ranges:
    each (range, conversation) adds what the ranges before it hold.
    """
    own = [F.when(F.col("d").isNotNull(), F.xxhash64(F.lit(i), F.col("depth"), F.col("d"))).otherwise(F.lit(0).cast("long"))
           for i in (1, 2)]
    last = (F.col("depth") == F.col("length")).alias("last")
    placed = occurrences.select("conv", "depth", "chars", last, own[0].alias("x"), own[1].alias("y"))
    placed = placed.repartitionByRange("conv", "depth").withColumn("part", F.spark_partition_id())
    placed = materialize(placed, "occurrences")
    runs = placed.groupBy("conv", "part").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("conv", "part", *[F.coalesce(F.bit_xor(c).over(earlier), F.lit(0).cast("long")).alias(f"from_{c}")
                                         for c in "xy"])
    here = Window.partitionBy("conv", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.select("*", F.bit_xor("x").over(here).alias("sx"), F.bit_xor("y").over(here).alias("sy"))
    whole = summed.join(runs, ["conv", "part"])
    a, b = (F.col(f"s{c}").bitwiseXOR(F.col(f"from_{c}")) for c in "xy")
    return whole.select("conv", "depth", "chars", "last", a.alias("a"), b.alias("b"), a.bitwiseXOR(F.col("x")).alias("up_a"),
                        b.bitwiseXOR(F.col("y")).alias("up_b"))


def nodes_of(occurrences: DataFrame) -> DataFrame:
    """(id, conv, depth, a, b, n_convs, chars, parent, parent_conv, n_children, first_child, next) of every node.

    The id tells the block: nodes are laid out by smallest conversation and depth, so that a path and the branches of
    neighbouring conversations stay together.
    """
    grouped = materialize(occurrences.groupBy("a", "b", "depth").agg(
        F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.min("chars").alias("chars"),
        F.min("up_a").alias("up_a"), F.min("up_b").alias("up_b")), "grouped")
    blocks = max(1, -(-row_count(grouped) // BLOCK_NODES))
    laid = grouped.repartitionByRange(blocks, "conv", "depth").sortWithinPartitions("conv", "depth")
    laid = materialize(laid.withColumn("id", F.monotonically_increasing_id()).withColumn("above", F.col("depth") - 1), "nodes")
    kids = laid.where("depth > 0").groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b"), F.col("above").alias("depth")).agg(
        F.count(F.lit(1)).alias("n_children"), F.min(F.struct("conv", "id")).getField("id").alias("first_child"))
    nodes = materialize(laid.join(kids, ["a", "b", "depth"], "left"), "nodes")
    parents = nodes.where("n_children is not null").select(
        F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("depth").alias("above"), F.col("id").alias("parent"),
        F.col("conv").alias("parent_conv"), F.col("n_children").alias("freq"))
    nodes = lookup(nodes, parents, ["up_a", "up_b", "above"], freq="freq", spread_by=["id"], measured=nodes)
    ranked = rank_rows(nodes.drop("up_a", "up_b", "above", "freq"), [F.col("conv").asc()], by=["parent"], name="sibling")
    ranked = materialize(ranked, "nodes")
    following = ranked.where("parent is not null").select("parent", (F.col("sibling") - 1).alias("sibling"),
                                                          F.col("id").alias("next"))
    return materialize(ranked.join(following, ["parent", "sibling"], "left").drop("sibling"), "nodes")


def arcs_of(nodes: DataFrame) -> DataFrame:
    """(arc, after, leaf, saved): 2 id enters a node and 2 id + 1 leaves it; ``after`` is the next arc, null at the end."""
    enter = F.struct((F.col("id") * 2).alias("arc"),
                     F.coalesce(F.col("first_child") * 2, F.col("id") * 2 + 1).alias("after"),
                     F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaf"),
                     ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    leave = F.struct((F.col("id") * 2 + 1).alias("arc"),
                     F.coalesce(F.col("next") * 2, F.col("parent") * 2 + 1).alias("after"),
                     F.lit(0).cast("long").alias("leaf"), F.lit(0).cast("long").alias("saved"))
    return nodes.select(F.explode(F.array(enter, leave)).alias("x")).select("x.*")


def heads_and_offsets(arcs: np.ndarray, after: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the first arc of its stretch, sizes before it there, does the stretch go on here) for each arc."""
    order = np.argsort(arcs)
    at = order[np.minimum(np.searchsorted(arcs, after, sorter=order), len(arcs) - 1)]
    inside = arcs[at] == after
    back = np.arange(len(arcs))
    back[at[inside]] = np.flatnonzero(inside)
    offset = np.where(back == np.arange(len(arcs)), 0, size[back])
    while True:
        further = back[back]
        if (further == back).all():
            return back, offset, inside
        offset = offset + offset[back]
        back = further


def in_block(rows: pd.DataFrame) -> pd.DataFrame:
    arcs, after = rows["arc"].to_numpy(), rows["after"].fillna(-1).to_numpy(np.int64)
    back, offset, inside = heads_and_offsets(arcs, after, np.ones(len(arcs), np.int64))
    return pd.DataFrame({"arc": arcs, "head": arcs[back], "offset": offset, "ends": ~inside, "after": rows["after"],
                         "leaf": rows["leaf"], "saved": rows["saved"]})


def in_one(rows: pd.DataFrame) -> pd.DataFrame:
    arcs, after = rows["head"].to_numpy(), rows["after"].fillna(-1).to_numpy(np.int64)
    _, offset, _ = heads_and_offsets(arcs, after, rows["size"].to_numpy())
    return pd.DataFrame({"head": arcs, "base": offset})


def ranked_list(items: DataFrame) -> DataFrame:
    """(head, base): for each item of the list ``items(head, after, size)`` the sizes of all items before it.

    While the list is long, items that drew a 1 take up the item after them if that drew a 0: a quarter goes in a round.
    """
    taken = []
    while row_count(items) > LAST_ARCS:
        drawn = items.withColumn("coin", F.pmod(F.xxhash64(F.lit(len(taken)), "head"), F.lit(2)))
        second = drawn.where("coin = 0").select(F.col("head").alias("after"), F.col("after").alias("beyond"),
                                                F.col("size").alias("more"))
        pairs = materialize(drawn.where("coin = 1").drop("coin").join(second, "after", "left"), "pairs")
        gone = pairs.where("more is not null").select(F.col("after").alias("head"), F.col("head").alias("by"), "size")
        taken.append(gone)
        longer = pairs.select("head", F.when(F.col("more").isNull(), F.col("after")).otherwise(F.col("beyond")).alias("after"),
                              (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))
        others = drawn.where("coin = 0").drop("coin").join(gone, "head", "left_anti")
        items = materialize(longer.unionByName(others), "list")
    found = items.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(in_one, "head long, base long")
    for gone in reversed(taken):
        found = materialize(found, "ranks")
        back = gone.join(found.withColumnRenamed("head", "by"), "by")
        found = found.unionByName(back.select("head", (F.col("base") + F.col("size")).alias("base")))
    return found


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """(id, n_leaves, saved_tokens) of every node, from one Euler tour."""
    arcs = arcs_of(nodes).withColumn("block", F.shiftright("arc", ID_BITS + 1))
    schema = "arc long, head long, offset long, ends boolean, after long, leaf long, saved long"
    located = materialize(arcs.groupBy("block").applyInPandas(in_block, schema), "arcs")
    items = materialize(located.where("ends").select("head", "after", (F.col("offset") + 1).alias("size")), "list")
    tour = located.join(ranked_list(items), "head").select("arc", (F.col("base") + F.col("offset")).alias("at"), "leaf", "saved")
    tour = materialize(tour.withColumn("stretch", F.expr(f"at div {STRETCH}")), "tour")
    # One row for each stretch, a bounded share of the arcs.
    earlier = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    totals = tour.groupBy("stretch").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved")).select(
        "stretch", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"all_{c}") for c in ("leaf", "saved")])
    here = Window.partitionBy("stretch").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    summed = tour.select("arc", "stretch", "leaf", "saved", F.sum("leaf").over(here).alias("sum_leaf"),
                         F.sum("saved").over(here).alias("sum_saved"))
    summed = lookup(summed, materialize(totals, "totals"), ["stretch"])

    def inside(c: str):
        upto = F.col(f"sum_{c}") + F.col(f"all_{c}")
        return F.sum(F.when(F.col("arc") % 2 == 1, upto).otherwise(F.col(c) - upto))

    return summed.groupBy(F.shiftright("arc", 1).alias("id")).agg(inside("leaf").alias("n_leaves"),
                                                                  inside("saved").alias("saved_tokens"))


def joined_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, first, text): the sorted numbers of a node joined by commas, cut at BLOB characters."""
    rows, node, numbers, size = [], None, [], 0

    def close() -> None:
        if numbers:
            rows.append((*node, numbers[0], ",".join(map(str, numbers))))

    def out() -> pa.RecordBatch:
        made = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                               ["a", "b", "first", "text"])
        rows.clear()
        return made

    for batch in batches:
        for a, b, conv in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "conv"))):
            if (a, b) != node or size > BLOB:
                close()
                node, numbers, size = (a, b), [], 0
            numbers.append(conv)
            size += len(str(conv)) + 1
        if len(rows) > 4096:
            yield out()
    close()
    if rows:
        yield out()


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, ends_sha256): the digest of a node's texts joined by commas; they come sorted, one after the other."""
    done, node, state = [], None, None

    def out() -> pa.RecordBatch:
        made = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done), (pa.int64(), pa.int64(), pa.string()))],
                               ["a", "b", "ends_sha256"])
        done.clear()
        return made

    for batch in batches:
        for a, b, text in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("text")):
            if (a, b) == node:
                state.update(b"," + text.as_py().encode())
                continue
            if node is not None:
                done.append((*node, state.hexdigest()))
            node, state = (a, b), hashlib.sha256(text.as_py().encode())
        if len(done) > 4096:
            yield out()
    if node is not None:
        done.append((*node, state.hexdigest()))
    if done:
        yield out()


def ends_of(occurrences: DataFrame) -> DataFrame:
    """(a, b, ends_sha256) of the nodes that conversations end in.

    One digest over all numbers has to be taken in order. The numbers are sorted in ranges and joined there; the last task
    of a node streams over texts of at least BLOB characters, without holding them.
    """
    ends = occurrences.where("last").select("a", "b", "conv")
    parts = ends.repartitionByRange("a", "b", "conv").sortWithinPartitions("a", "b", "conv").mapInArrow(
        joined_numbers, "a long, b long, first long, text string")
    return parts.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(
        digests, "a long, b long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations: ``conv_id`` (its smallest member), ``depth``,
    ``parent_conv_id`` (null at the root), ``n_convs`` (members), ``n_children``, ``n_leaves`` (nodes without children in
    the subtree, itself included), ``saved_tokens`` (summed over the subtree: one less than its members times the code
    points of its last text) and ``ends_sha256`` (of the numbers of the members that end there, ascending, joined by
    commas).

    A conversation is its turns in order of ``turn``, null first, equal ones in order of the md5 of role and text; a null
    role or text counts as empty; repeated rows are turns of their own. The first turns of conversation c, as many as the
    crc32 of its decimal number modulo 6, are replaced by those of conversation c - c % 100 (remainder with the sign of c;
    fewer if that has fewer, none if it is not there). Rows without ``conv_id`` belong to no conversation and are left
    out. A table without conversations has no trie: no rows. Other columns are ignored.
    """
    occurrences = materialize(keyed(rebuilt(turns_of(conversations))), "keyed")
    nodes = nodes_of(occurrences)
    sums = subtree_sums(nodes)
    whole = nodes.join(sums, "id").join(ends_of(occurrences), ["a", "b"], "left")
    return whole.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
