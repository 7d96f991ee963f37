"""Fixity audit of archives by Merkle trees over offset ranges.

The bytes of each record are hashed once. A leaf of an archive's tree covers a fixed range of offsets and hashes the
records that start there in order; a node above hashes its children in order. Two replicas first compare roots, then
only the children of branches that differ, and records only below leaves that differ. A range needs no ranking, so an
archive that holds most of the records is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tailsplit.scratch import materialize

RANGE_BYTES = 1 << 16  # offsets under one leaf, hence the most entries that a leaf hashes
FANOUT = 64
LANES = (1, 16, 31, 46)


def record_of(address: Column, body: Column) -> Column:
    """A response record: header, empty line, body, two line ends. Null parts are empty."""
    address, body = F.coalesce(address, F.lit("")), F.coalesce(body, F.lit(""))
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), address,
                    F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body,
                    F.lit("\r\n\r\n"))


def record_hash(record: Column) -> Column:
    """SHA-256 in hexadecimal digits, null for null."""
    return F.sha2(record.cast("binary"), 256)


def lay_out(records: DataFrame, archive: str, order: list[str], length: str) -> DataFrame:
    """Adds ``offset``: the bytes of the archive's records before each. Give it narrow rows, without the records.

    ``order`` must tell an archive's rows apart; a null length counts as 0.
    """
    before = Window.partitionBy(archive).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("offset", F.coalesce(F.sum(F.coalesce(length, F.lit(0))).over(before), F.lit(0)).cast("long"))


def _entries(records: DataFrame, archive: str, offset: str, digest: str) -> DataFrame:
    """(archive, offset, node, hash): what stands at each offset; several records there give one hash in any order."""
    rows = records.select(F.coalesce(F.concat(F.lit("="), F.col(archive).cast("string")), F.lit("")).alias("archive"),
                          F.coalesce(F.col(offset).cast("long"), F.lit(-1)).alias("offset"),
                          F.coalesce(F.col(digest), F.lit("none")).alias("hash"))
    lanes = [F.sum(F.coalesce(F.conv(F.substring("hash", at, 15), 16, 10), F.lit("0")).cast("decimal(38,0)")).cast("string")
             for at in LANES]
    at_once = F.sha2(F.concat_ws(" ", F.count(F.lit(1)).cast("string"), F.min("hash"), F.max("hash"), *lanes), 256)
    found = rows.groupBy("archive", "offset").agg(
        F.when(F.count(F.lit(1)) == 1, F.min("hash")).otherwise(at_once).alias("hash"))
    return found.select("archive", "offset", F.floor(F.col("offset") / RANGE_BYTES).cast("long").alias("node"), "hash")


def _parents(children: DataFrame, place: str, node: Column) -> DataFrame:
    """(archive, node, hash): each node hashes its children in order; their number is bounded by range and fan-out."""
    listed = F.sort_array(F.collect_list(F.struct(place, "hash")))
    text = F.array_join(F.transform(listed, lambda c: F.concat(c[place].cast("string"), F.lit(":"), c["hash"])), "\n")
    return children.groupBy("archive", node.alias("parent")).agg(F.sha2(text, 256).alias("hash")).select(
        "archive", F.col("parent").alias("node"), "hash")


def _above(node: str = "node") -> Column:
    return F.floor(F.col(node) / FANOUT).cast("long")


def _tree(entries: DataFrame, height: int) -> list[DataFrame]:
    """The levels from the leaves to the roots."""
    levels = [materialize(_parents(entries, "offset", F.col("node")), "leaves")]
    for _ in range(height):
        levels.append(materialize(_parents(levels[-1], "node", _above()), "nodes"))
    return levels


def _differing(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    a = left.select(*on, F.col("hash").alias("left_hash"))
    b = right.select(*on, F.col("hash").alias("right_hash"))
    return a.join(b, on, "full").where(~F.col("left_hash").eqNullSafe(F.col("right_hash")))


def audit(left: DataFrame, right: DataFrame, archive: str = "archive", offset: str = "offset",
          digest: str = "digest") -> DataFrame:
    """Where two replicas of archives differ.

    One row for each differing offset: ``archive`` (string), ``offset``, ``kind`` (``changed``, ``missing`` from the
    right or ``added`` there), ``left_hash`` and ``right_hash``. An archive that only one replica has differs in every
    record. A null archive or offset is a value of its own, a null digest equals a null digest only; records that share
    an archive and offset are compared as one set, with repeats. Empty tables are replicas without archives. Other
    columns are ignored.
    """
    a, b = (materialize(_entries(x, archive, offset, digest), "entries") for x in (left, right))
    last = max(int(x.agg(F.max("node")).first()[0] or 0) for x in (a, b))
    height = 0
    while last >= FANOUT**height:
        height += 1
    tree_a, tree_b = _tree(a, height), _tree(b, height)
    suspects = _differing(tree_a[-1], tree_b[-1], ["archive", "node"]).select("archive", "node")
    for level in range(height - 1, -1, -1):
        below = [tree[level].withColumn("up", _above()).join(
            suspects.withColumnRenamed("node", "up"), ["archive", "up"], "left_semi") for tree in (tree_a, tree_b)]
        suspects = materialize(_differing(*below, ["archive", "node"]).select("archive", "node"), "suspects")
    open_a, open_b = (x.join(suspects, ["archive", "node"], "left_semi") for x in (a, b))
    found = _differing(open_a, open_b, ["archive", "offset"])
    kind = F.when(F.col("right_hash").isNull(), "missing").when(F.col("left_hash").isNull(), "added").otherwise("changed")
    return found.select(F.when(F.col("archive") != "", F.substring("archive", 2, 1 << 30)).alias("archive"),
                        F.when(F.col("offset") >= 0, F.col("offset")).alias("offset"), kind.alias("kind"),
                        "left_hash", "right_hash")
