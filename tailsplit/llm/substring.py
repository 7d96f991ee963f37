"""Repeated passages: seed on winnowed anchors, extend both ways, keep maximal repeats.

A winnowed anchor of a window depends on the window's words only, so equal windows have equal anchors at equal places.
The windows that share an anchor form a run. Runs meet at their anchor, and a run whose whole extent, extended to both
sides of the anchor, also stands earlier is repeated as a whole. Only runs of which the anchor is known in other
surroundings are compared window by window. Sorted streams replace groups: a passage in very many documents is never
gathered, and no pairs of its places are made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tailsplit.llm.textblock import BASE, BASE2, SpanHash, mix, text_blocks
from tailsplit.scratch import materialize

ANCHOR_WORDS = 6
SHIFT = 16  # a run as one number: its first window << SHIFT | its number of windows
REPEATED, CONTESTED = 1, 2
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


class Words:
    """The words of a block of texts: places in the bytes, document of each, two hashes."""

    def __init__(self, texts: list[str]):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.data = b"\n".join(raw) + b"\n"
        codes = np.frombuffer(self.data, np.uint8)
        gap = SPACES[codes]
        edge = np.diff(gap.astype(np.int8), prepend=1)
        self.starts, self.ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if len(self.ends) > len(self.starts):
            self.ends = self.ends[-len(self.starts):] if len(self.starts) else self.ends[:0]
        limits = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
        self.doc = np.searchsorted(limits, self.starts, "right")
        self.counts = np.bincount(self.doc, minlength=len(texts))
        self.first = np.cumsum(self.counts) - self.counts
        self.limits = limits
        self.codes = codes

    def hashes(self) -> tuple[SpanHash, SpanHash]:
        """Hashes of spans of words, two of 64 bits."""
        one = SpanHash(self.codes, BASE)(self.starts, self.ends)
        two = SpanHash(self.codes, BASE2)(self.starts, self.ends)
        return SpanHash(one, BASE), SpanHash(two, BASE2)


def windows_of(words: Words, length: int) -> np.ndarray:
    """The first words of all windows of ``length`` words that lie in one document."""
    n = len(words.starts) - length + 1
    if n <= 0:
        return np.empty(0, np.int64)
    return np.flatnonzero(words.doc[:n] == words.doc[length - 1:])


def runs_of(words: Words, length: int):
    """(first window, number of windows, anchor hash, extent hash) of each run of windows with the same anchor."""
    windows = windows_of(words, length)
    if not len(windows):
        empty = np.empty(0, np.int64)
        return empty, empty, empty, empty
    size = min(ANCHOR_WORDS, length)
    one, two = words.hashes()
    places = np.arange(len(words.starts) - size + 1)
    seeds = one(places, places + size)
    among = length - size + 1
    near = np.lib.stride_tricks.sliding_window_view(seeds, among)[:, ::-1]
    anchors = np.empty(len(windows), np.int64)
    for at in range(0, len(windows), 65_536):
        some = windows[at:at + 65_536]
        anchors[at:at + 65_536] = some + among - 1 - near[some[0]:some[-1] + 1].argmin(1)[some - some[0]]
    new = np.ones(len(windows), bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (words.doc[windows[1:]] != words.doc[windows[:-1]])
    at = np.flatnonzero(new)
    first, anchor = windows[at], anchors[at]
    count = np.diff(np.append(at, len(windows)))
    extent = two(first, first + count + length - 1)
    place = ((anchor - first) << 20 | count).astype(np.uint64)
    return first, count, seeds[anchor].view(np.int64), mix(extent ^ mix(place + BASE)).view(np.int64)


def _keyed(docs: DataFrame, text: str, key: str, carry: list[str] | None = None) -> DataFrame:
    """(k, tie, t): rows that share a key and a text are one document; of one key, the text's checksum decides."""
    return docs.select(docs[key].cast("long").alias("k"),
                       F.crc32(F.coalesce(docs[text], F.lit("")).cast("binary")).alias("tie"), docs[text].alias("t"),
                       *[docs[c].alias(f"c_{c}") for c in carry or []])


def _runs(keyed: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in text_blocks(batch.column("t")):
                words = Words(texts)
                first, count, anchor, extent = runs_of(words, length)
                doc = words.doc[first]
                picked = batch.select(["k", "tie"]).take(pa.array(doc + row))
                yield pa.record_batch([picked.column("k"), picked.column("tie"), pa.array(anchor), pa.array(extent),
                                       pa.array((first - words.first[doc]) << SHIFT | count)],
                                      ["k", "tie", "anchor", "extent", "at"])

    return keyed.mapInArrow(run, "k long, tie long, anchor long, extent long, at long")


def _same(columns: list[np.ndarray]) -> np.ndarray:
    """Whether each row equals the one before it in all columns; false for the first."""
    out = np.zeros(len(columns[0]), bool)
    out[1:] = np.logical_and.reduce([c[1:] == c[:-1] for c in columns])
    return out


def _verdicts(batches: Iterator[pa.RecordBatch], names: tuple[str, str], contest: bool) -> Iterator[pa.RecordBatch]:
    """Streams rows sorted by (names..., k, tie, at); yields (k, tie, at, kind) of all that come after an equal one.

    With ``contest`` the first of its kind is reported too if other kinds share the first name. The last kind of a
    batch stays until the next shows what follows.
    """
    columns = [*names, "k", "null", "tie", "at"]
    held = {c: np.empty(0, np.int64) for c in columns}
    tail = None  # the two names of the last row that has been dealt with, and the row itself

    def flush(rows: dict[str, np.ndarray], last: bool):
        nonlocal tail
        n = len(rows["k"])
        if not n:
            return None, 0
        done = n if last else n - 1
        a, b = rows[names[0]], rows[names[1]]
        old_kind, old_a, old_row = _same([a, b]), _same([a]), _same([rows[c] for c in columns])
        if tail is not None:
            old_a[0] = tail[names[0]] == a[0]
            old_kind[0] = old_a[0] and tail[names[1]] == b[0]
            old_row[0] = old_kind[0] and all(tail[c] == rows[c][0] for c in columns)
        kind = np.where(old_kind & ~old_row, REPEATED, 0)
        if contest:
            # The first of a kind is contested if its anchor comes with another kind, before or after.
            ends = np.append(np.flatnonzero(~old_kind)[1:], n) - 1
            starts = np.flatnonzero(~old_kind)
            follows = np.zeros(len(starts), bool)
            inner = ends + 1 < n
            follows[inner] = a[ends[inner] + 1] == a[ends[inner]]
            kind[starts[old_a[starts] | follows]] = CONTESTED
        if not last and contest:
            # A kind that reaches the end of the batch may be the first of several: wait for what follows it.
            begin = np.flatnonzero(~old_kind)
            done = min(done, int(begin[-1]) if len(begin) else done)
        out = np.flatnonzero(kind[:done])
        if done:
            tail = {c: rows[c][done - 1] for c in columns}
        yield_rows = pa.record_batch([pa.array(rows["k"][out], mask=rows["null"][out] == 0), pa.array(rows["tie"][out]),
                                      pa.array(rows["at"][out]), pa.array(kind[out].astype(np.int32))],
                                     ["k", "tie", "at", "kind"])
        return yield_rows, done

    for batch in batches:
        rows = {c: batch.column(c).to_numpy() for c in (*names, "tie", "at")}
        rows["null"] = batch.column("k").is_valid().to_numpy(zero_copy_only=False).astype(np.int64)
        rows["k"] = batch.column("k").fill_null(0).to_numpy()
        rows = {c: np.concatenate([held[c], rows[c]]) for c in columns}
        out, done = flush(rows, False)
        held = {c: rows[c][done:] for c in columns} if out is not None else rows
        if out is not None and out.num_rows:
            yield out
    out, _ = flush(held, True)
    if out is not None and out.num_rows:
        yield out


def _judge(rows: DataFrame, names: tuple[str, str], contest: bool) -> DataFrame:
    """The verdicts on rows dealt out by the first name."""
    ordered = rows.repartition(names[0]).sortWithinPartitions(*names, "k", "tie", "at")
    return ordered.mapInArrow(lambda batches: _verdicts(batches, names, contest), "k long, tie long, at long, kind int")


def _with_lists(keyed: DataFrame, verdicts: DataFrame, how: str) -> DataFrame:
    """Texts with the list of their own verdicts."""
    lists = verdicts.groupBy(F.col("k").alias("k2"), F.col("tie").alias("tie2")).agg(F.collect_list("at").alias("ats"))
    return keyed.join(lists, keyed.k.eqNullSafe(lists.k2) & (keyed.tie == lists.tie2), how)


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of the list column; a null list is empty."""
    column = batch.column("ats")
    counts = np.array(column.value_lengths().fill_null(0))
    return column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(counts)])


def repeated_windows(docs: DataFrame, length: int, text: str, key: str) -> DataFrame:
    """(k, tie, at): the windows that also start earlier, as runs, in a table of its own."""
    keyed = _keyed(docs, text, key)
    verdicts = materialize(_judge(_runs(keyed, length), ("anchor", "extent"), True), "runs")
    asked = _with_lists(keyed, verdicts.where(F.col("kind") == CONTESTED), "inner").dropDuplicates(["k", "tie"])

    def open_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = _lists(batch)
            for row, texts in text_blocks(batch.column("t")):
                words = Words(texts)
                one, two = words.hashes()
                mine = values[offsets[row]:offsets[row + len(texts)]]
                doc = np.repeat(np.arange(len(texts)), np.diff(offsets[row:row + len(texts) + 1]))
                count = mine & ((1 << SHIFT) - 1)
                within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                first = np.repeat((mine >> SHIFT) + words.first[doc], count) + within
                doc = np.repeat(doc, count)
                picked = batch.select(["k", "tie"]).take(pa.array(doc + row))
                yield pa.record_batch(
                    [picked.column("k"), picked.column("tie"), pa.array(one(first, first + length).view(np.int64)),
                     pa.array(two(first, first + length).view(np.int64)),
                     pa.array((first - words.first[doc]) << SHIFT | 1)], ["k", "tie", "one", "two", "at"])

    windows = asked.select("k", "tie", "t", "ats").mapInArrow(
        open_runs, "k long, tie long, one long, two long, at long")
    found = materialize(_judge(windows, ("one", "two"), False), "windows")
    return verdicts.where(F.col("kind") == REPEATED).union(found).select("k", "tie", "at")


def covered(words: Words, length: int, runs: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which words of the block lie in one of the runs."""
    begin = (runs >> SHIFT) + words.first[doc]
    end = begin + (runs & ((1 << SHIFT) - 1)) + length - 1
    steps = np.bincount(begin, minlength=len(words.starts) + 1) - np.bincount(end, minlength=len(words.starts) + 1)
    return np.cumsum(steps)[:-1] > 0


def remove_repeats(docs: DataFrame, length: int = 20, text: str = "text", key: str = "doc_id",
                   carry: list[str] | None = None) -> DataFrame:
    """Takes out of every whole text each word of a window of ``length`` words that also starts earlier.

    Earlier: in a document of smaller key, or in the same one. Words are separated by blanks and the control characters
    9 to 13. One row a document: ``key``, ``n_words``, ``n_removed``, ``kept_sha256`` (of the kept words joined by a
    blank), ``kept`` (the text without the repeats; as it was if there are none, else the kept words with the white
    space that follows each) and ``spans``, the maximal repeats as (first word, word after the last).

    A null or empty text has no words. A null key comes before all others. Rows that repeat key and text are one
    document and get the same result each; of different texts with one key, the one with the smaller CRC-32 comes
    first. ``key`` must be a whole number. The columns to ``carry`` come after, others are ignored.
    """
    keyed = _keyed(docs, text, key, carry)
    carried = [f"c_{c}" for c in carry or []]
    joined = _with_lists(keyed, repeated_windows(docs, length, text, key), "left").select("k", "t", "ats", *carried)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = _lists(batch)
            for row, texts in text_blocks(batch.column("t")):
                words = Words(texts)
                doc = np.repeat(np.arange(len(texts)), np.diff(offsets[row:row + len(texts) + 1]))
                gone = covered(words, length, values[offsets[row]:offsets[row + len(texts)]], doc)
                removed = np.bincount(words.doc[gone], minlength=len(texts))
                digests, kept, spans = [], [], []
                for i, t in enumerate(texts):
                    b = words.first[i]
                    e = b + words.counts[i]
                    mine = ~gone[b:e]
                    begin, end = words.limits[i - 1] if i else 0, words.limits[i] - 1
                    if mine.all():
                        plain = words.data[begin:end]
                        digests.append(hashlib.sha256(b" ".join(plain.split())).hexdigest())
                        kept.append(t)
                        spans.append([])
                        continue
                    starts, stops = words.starts[b:e], words.ends[b:e]
                    after = np.append(starts[1:], end)
                    own = list(zip(starts[mine].tolist(), stops[mine].tolist()))
                    digests.append(hashlib.sha256(b" ".join([words.data[s:x] for s, x in own])).hexdigest())
                    left = b"".join([words.data[s:x] for s, x in zip(starts[mine].tolist(), after[mine].tolist())])
                    kept.append(left.decode("utf-8", "surrogatepass"))
                    edge = np.diff(np.concatenate([[0], (~mine).astype(np.int8), [0]]))
                    spans.append([{"first": int(s), "last": int(x)}
                                  for s, x in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))])
                yield pa.record_batch(
                    [batch.column("k").slice(row, len(texts)), pa.array(words.counts), pa.array(removed),
                     pa.array(digests, pa.string()), pa.array(kept, pa.string()),
                     pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                     *[batch.column(c).slice(row, len(texts)) for c in carried]],
                    ["k", "n_words", "n_removed", "kept_sha256", "kept", "spans", *carried])

    span = T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())])
    out = joined.mapInArrow(finish, T.StructType([
        T.StructField("k", T.LongType()), T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()),
        T.StructField("kept", T.StringType()), T.StructField("spans", T.ArrayType(span)),
        *[joined.schema[c] for c in carried]]))
    return out.withColumnsRenamed({"k": key, **{f"c_{c}": c for c in carry or []}})
