"""Atoms: the small units a test side should not hold without the train side holding them too."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailsplit.functions.text import tokens
from tailsplit.operators.joins import lookup
from tailsplit.operators.ranking import first_in_group, key_order, rank_rows
from tailsplit.scratch import materialize, row_count

Extractor = Callable[[Column], Column]


def atom_rows(df: DataFrame, text: str = "text", extract: Extractor = tokens, row_id: str = "row_id") -> DataFrame:
    """(row_id, atom), each atom once per row."""
    return df.select(row_id, F.explode(F.array_distinct(extract(F.col(text)))).alias("atom"))


def atom_counts(df: DataFrame, side: str, text: str = "text", extract: Extractor = tokens) -> DataFrame:
    """(side, atom, n): how often each atom occurs on each side, repeats counted."""
    return df.select(side, F.explode(extract(F.col(text))).alias("atom")).groupBy(side, "atom").agg(
        F.count(F.lit(1)).alias("n"))


def atom_divergence(counts: DataFrame, first: str, second: str, side: str, alpha: float = 0.5) -> DataFrame:
    """1 minus the Chernoff coefficient of the two sides' atom distributions."""
    def of(name: str) -> Column:
        return F.sum(F.when(F.col(side) == F.lit(name), F.col("n")).otherwise(0))

    per_atom = materialize(counts.groupBy("atom").agg(of(first).alias("a"), of(second).alias("b")), "atoms")
    total_a, total_b = per_atom.agg(F.sum("a"), F.sum("b")).first()
    p = F.try_divide(F.col("a"), F.lit(total_a))
    q = F.try_divide(F.col("b"), F.lit(total_b))
    overlap = F.sum(F.pow(p, F.lit(alpha)) * F.pow(q, F.lit(1 - alpha)))
    return per_atom.agg(F.round(1 - F.coalesce(overlap, F.lit(0.0)), 6).alias("divergence"))


def holders(rows: DataFrame, atoms: DataFrame, row_id: str = "row_id") -> DataFrame:
    """(atom, row_id, rank, picked) joined on the unique row id."""
    return atoms.join(rows.select(row_id, "rank", "picked"), row_id)


def missing_atoms(held: DataFrame) -> DataFrame:
    """(atom, rank, n_holders): atoms of the unpicked side that the picked side lacks, with the rank of
    their most likely holder.

    One aggregation over both sides; an atom in most of the rows costs one partial row per task.
    """
    per_atom = held.groupBy("atom").agg(F.bool_or("picked").alias("_known"), F.min("rank").alias("rank"),
                                        F.count(F.lit(1)).alias("n_holders"))
    return per_atom.filter(~F.col("_known")).select("atom", "rank", "n_holders")


def atom_carriers(held: DataFrame, missing: DataFrame) -> DataFrame:
    """Row ids of the unpicked side that carry a missing atom."""
    wanted = materialize(missing.select("atom", "n_holders"), "missing")
    found = lookup(held.filter(~F.col("picked")), wanted, ["atom"], freq="n_holders", spread_by=["row_id"])
    return found.filter(F.col("n_holders").isNotNull()).select("row_id").distinct()


def greedy_cover(held: DataFrame) -> DataFrame:
    """(rank) of few rows that together hold every atom of ``held`` (atom, rank).

    Greedy set cover in threshold rounds. Of the rows that hold at least half as many open atoms as the
    best one, every atom elects the one that holds most, the more likely at a tie; rows elected by half
    of their atoms are taken together. The best row of all is always among them, so that every round
    gets on, and a round drops all pairs of the atoms it covered. The result depends on the data only.
    """
    left = materialize(held.select("atom", "rank"), "uncovered")
    taken = left.select("rank").limit(0)
    while row_count(left):
        gains = materialize(left.groupBy("rank").agg(F.count(F.lit(1)).alias("gain")), "gains")
        most = gains.agg(F.max("gain")).first()[0]
        strong = gains.filter(F.col("gain") * 2 >= F.lit(most))
        best = left.join(strong, "rank").groupBy("atom").agg(
            F.min(F.struct((-F.col("gain")).alias("loss"), F.col("rank").alias("rank"))).alias("best"))
        won = best.groupBy("best.rank").agg(F.count(F.lit(1)).alias("votes"), F.max(-F.col("best.loss")).alias("gain"))
        won = materialize(won.filter(F.col("votes") * 2 >= F.col("gain")).select("rank", F.lit(True).alias("won")), "won")
        taken = taken.unionByName(won.select("rank"))
        # With their counts, so that an atom of most rows is looked up without a hot task.
        covered = lookup(left, won, ["rank"]).groupBy("atom").agg(
            F.count(F.lit(1)).alias("n"), F.bool_or("won").alias("covered"))
        covered = materialize(covered.filter("covered").select("atom", "n"), "covered")
        left = materialize(lookup(left, covered, ["atom"], freq="n", spread_by=["rank"]).filter(
            F.col("n").isNull()).select("atom", "rank"), "uncovered")
    return materialize(taken, "cover")


def balance_atoms(rows: DataFrame, atoms: DataFrame, key: str = "key",
                  fewest: bool = False) -> tuple[DataFrame, dict[str, int]]:
    """Swap rows so that the picked side holds every atom of the other side, its size unchanged.

    The most likely holder of each missing atom moves in. Every atom then keeps its most
    likely holder; of the rows that nobody needs, as many of the least likely move out as came
    in. If too few are free, the picked side grows and the report says by how much.

    With ``fewest`` a greedy cover decides instead: few rows that hold many missing atoms move in, and
    where too few rows are free, a cover of what the rows moved in do not hold says which others
    must stay.
    """
    ranked = materialize(rank_rows(rows, key_order(key), name="rank"), "ranked")
    held = materialize(holders(ranked, atoms).select("atom", "rank", "picked"), "holders")
    missing = materialize(missing_atoms(held), "missing")
    if fewest:
        wanted = materialize(missing.select("atom", "n_holders"), "wanted")
        carried = lookup(held.filter(~F.col("picked")), wanted, ["atom"], freq="n_holders", spread_by=["rank"])
        move_in = greedy_cover(carried.filter(F.col("n_holders").isNotNull()))
    else:
        move_in = materialize(missing.select("rank").distinct(), "move_in")
    n_in = row_count(move_in)

    brought = held.filter(~F.col("picked")).select("atom", "rank").join(move_in, "rank", "left_semi").select("atom", "rank")
    own = held.filter("picked").select("atom", "rank")
    keepers = own.unionByName(brought).groupBy("atom").agg(F.min("rank").alias("rank")).select("rank").distinct()

    def free_of(keepers: DataFrame) -> DataFrame:
        return ranked.filter("picked").join(keepers, "rank", "left_anti").select("rank")

    free = free_of(keepers)
    if fewest and n_in and free.count() < n_in:
        # One row per atom that the rows moved in hold, with its holders on the picked side.
        counts = own.withColumn("own", F.lit(1)).unionByName(brought.withColumn("own", F.lit(0))).groupBy("atom").agg(
            F.sum("own").alias("n"), F.min("own").alias("least"))
        safe = materialize(counts.filter((F.col("least") == 0) & (F.col("n") > 0)).select("atom", "n"), "safe")
        open_own = lookup(own, safe, ["atom"], freq="n", spread_by=["rank"]).filter(F.col("n").isNull())
        free = free_of(greedy_cover(open_own))
    move_out = materialize(first_in_group(free, [F.col("rank").desc()], [], n_in, "_turn").select("rank"), "move_out")
    moved = move_in.unionByName(move_out).withColumn("_moved", F.lit(True))
    balanced = ranked.join(moved, "rank", "left").withColumn(
        "picked", F.col("picked") != F.coalesce("_moved", F.lit(False))).drop("_moved")
    n_out = row_count(move_out)
    report = {"missing_atoms": row_count(missing), "moved_in": n_in, "moved_out": n_out, "grown_by": n_in - n_out}
    return balanced.select(*rows.columns, "rank"), report
