"""Joins whose hot keys are known and handled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailsplit.scratch import size_of

# A whole table up to this size is broadcast; of a larger one, the most frequent keys are, HEAD_ROWS at most.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20
HEAD_ROWS = 100_000
SPREAD = 4096
# Room for the turns of one conversation in a turn's id; a turn number of 32 bits always fits.
TURNS = 1 << 32


def fits_broadcast(dim: DataFrame, rows: int | None = None, size: int | None = None) -> bool:
    """True if ``dim`` was measured and found small enough to ship to every executor."""
    n, total = size_of(dim)
    return n <= (BROADCAST_ROWS if rows is None else rows) and total <= (BROADCAST_BYTES if size is None else size)


def head_of(dim: DataFrame, freq: str, head_rows: int | None = None) -> Column:
    """Whether a row of ``dim`` is among its most frequent ones, at most ``head_rows`` by counting.

    The frequencies are counted in ranges of a sixteenth of an octave, some hundred rows; whole ranges are taken.
    """
    octave = F.floor(F.log2(F.greatest(F.col(freq), F.lit(1)).cast("double")) * 16)
    room = HEAD_ROWS if head_rows is None else head_rows
    border = None
    for r in sorted(dim.groupBy(octave.alias("o")).count().collect(), key=lambda r: -r["o"]):
        room -= r["count"]
        if room < 0:
            break
        border = r["o"]
    return F.lit(False) if border is None else octave >= F.lit(border)


def settled_and_open(df: DataFrame, head: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` that the small ``head`` answers or that have a null key, with the values of ``head``, and the others.

    Neither needs an exchange; ``df`` is read once for each.
    """
    on, values = list(on), [c for c in head.columns if c not in on]
    keys = [f"_key_{c}" for c in on]
    packed = head.select(*[F.col(c).alias(k) for c, k in zip(on, keys)], F.struct(*values).alias("_head"))
    kinds = [dict(t.dtypes)[c] for t, names in ((df, on), (packed, keys)) for c in names]
    equal = alike(on, keys) if {*kinds} == {"string"} else [F.col(c) == F.col(k) for c, k in zip(on, keys)]
    probed = df.join(F.broadcast(packed), equal, "left")
    settled = F.col("_head").isNotNull()
    for c in on:
        settled = settled | F.col(c).isNull()
    return (probed.filter(settled).select(*df.columns, *[F.col("_head")[v].alias(v) for v in values]),
            probed.filter(~settled).select(*df.columns))


def alike(left: Sequence[str], right: Sequence[str]) -> Column:
    """Equality of strings that are no keys of the join themselves: its one key is a number made of them.

    Numbers are sorted and looked up faster than strings, which are only compared where the numbers are equal.
    """
    out = F.xxhash64(*left) == F.xxhash64(*right)
    for a, b in zip(left, right):  # an equality would become one more key
        out = out & F.col(a).between(F.col(b), F.col(b))
    return out


def lookup(df: DataFrame, dim: DataFrame, on: Sequence[str], freq: str | None = None,
           spread_by: Sequence[str] = (), rows: int | None = None, head_rows: int | None = None,
           measured: DataFrame | None = None, reread: bool = False) -> DataFrame:
    """Left join of ``df`` to ``dim`` (unique on ``on``) that no hot key can stall.

    * ``dim`` small after counting it: broadcast.
    * ``dim`` larger, with ``freq`` telling how often each key occurs: the most frequent keys, at most ``head_rows``,
      are broadcast. The remaining keys, none of them hot, are shuffled. Rows already
      answered by the broadcast, and rows with a null key, get a spread-out key of their own there, so they match
      nothing and gather nowhere; the salt is a hash of ``spread_by``, hence repeatable.
      With ``reread``, for a ``df`` that is cheap to read twice, they stay out of the shuffle.
    * ``dim`` larger without ``freq``: plain join, left to adaptive execution.

    ``measured`` is the written table ``dim`` was derived from row by row, if it was; its columns may be named otherwise.
    """
    on = list(on)
    if fits_broadcast(dim if measured is None else measured, rows):
        return df.join(F.broadcast(dim), on, "left")
    if freq is None:
        return df.join(dim, on, "left")

    values = [c for c in dim.columns if c not in on]
    hot = head_of(dim, freq, head_rows)
    head, tail = dim.filter(hot), dim.filter(~hot)
    if reread:
        settled, rest = settled_and_open(df, head, on)
        return settled.unionByName(rest.join(tail, on, "left").select(*df.columns, *values))
    head = head.select(*on, F.struct(*values).alias("_head"))
    tail = tail.select(*on, F.struct(*values).alias("_tail"), F.lit(0).alias("_slot"))
    salt = F.pmod(F.xxhash64(*(spread_by or df.columns)), F.lit(SPREAD)).cast("int") + 1
    answered = F.col("_head").isNotNull()
    for c in on:
        answered = answered | F.col(c).isNull()
    joined = (
        df.join(F.broadcast(head), on, "left")
        .withColumn("_slot", F.when(answered, salt).otherwise(F.lit(0)))
        .join(tail, [*on, "_slot"], "left")
    )
    found = F.coalesce("_head", "_tail")
    return joined.select(*df.columns, *[found[v].alias(v) for v in values])


def same(left: Column, right: Column) -> Column:
    """Equality under which two nulls are equal; Spark plans it as an equi-join key."""
    return left.eqNullSafe(right)


def join_scores(rows: DataFrame, scores: DataFrame, key: str = "row_id", check: bool = True) -> DataFrame:
    """Attach one score row to every example, by id instead of by position.

    With ``check`` the two sides must hold the same number of rows and every row must meet
    its score, as aligned score vectors do.
    """
    joined = rows.join(scores, key, "inner")
    if check:
        n_rows, n_scores, n_both = rows.count(), scores.count(), joined.count()
        if not n_rows == n_scores == n_both:
            raise ValueError(f"{n_rows} rows, {n_scores} scores, {n_both} of them matching")
    return joined


def join_predictions(gold: DataFrame, predictions: DataFrame, key: str = "row_id") -> DataFrame:
    """Every reference with its prediction; null, which no metric takes as right, where there is none."""
    return gold.join(predictions, key, "left")


def label_ids(labels: DataFrame, label: str) -> DataFrame:
    """Label dimension (label, label_id): distinct labels in sorted order, counted from zero."""
    from tailsplit.operators.ranking import rank_rows

    distinct = labels.select(label).filter(F.col(label).isNotNull()).distinct()
    return rank_rows(distinct, [F.col(label).asc()], name="label_id").withColumn(
        "label_id", (F.col("label_id") - 1).cast("int"))


def join_label_ids(rows: DataFrame, label: str, dim: DataFrame) -> DataFrame:
    """Integer id per row; the marker -1 for "no label" passes through, unknown labels give null."""
    marker = F.col(label).cast("string") == "-1"
    known = lookup(rows, dim, [label])
    return known.withColumn("label_id", F.when(marker, F.lit(-1)).otherwise(F.col("label_id")))


def turn_id(conv: str = "conv_id", turn: str = "turn") -> Column:
    """One number for a turn of a conversation, unique as (conv, turn) is; fails beyond 64 bits."""
    return F.col(conv).cast("long") * F.lit(TURNS) + F.col(turn)


def next_turn_pairs(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text",
                    role: str = "role") -> DataFrame:
    """(prefix, target) of consecutive turns.

    A self equi-join on the unique (conversation, turn): unlike a window over the conversation
    it never gathers a long conversation in one task.
    """
    first = turns.select(F.col(conv), F.col(turn), F.col(text).alias("prefix"))
    after = turns.select(F.col(conv), (F.col(turn) - 1).alias(turn), F.col(text).alias("target"),
                         F.col(role).alias("label"))
    return first.join(after, [conv, turn], "inner").withColumn("row_id", turn_id(conv, turn))
