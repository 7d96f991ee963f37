"""Spelling variants: words one edit apart, found in a trie over letter counts.

A word is described by how often each of some groups of letters occurs in it. One edit adds one letter (a surplus of one),
takes one away (a deficit of one), or does both. The words are arranged in a trie by their counts, one group after the
other; a search descends it depth first and spends a budget of one surplus and one deficit. The words at the leaves that
it reaches are compared letter by letter.

The top of the trie is dealt out. Its first levels count few, wide groups; words with the same counts there are a cell, a
cell with too many words is cut by the counts of narrower groups, and one that is too full even then by a hash of its
words. A word searches the cells within its budget; of two cells only the words of one search the other, and what they
find counts for both. Cells are dealt to shards, one task each. Inside a shard all searches descend together, so that a
node is opened once for all of them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailsplit.llm.textblock import BASE, mix
from tailsplit.operators.joins import lookup
from tailsplit.scratch import materialize, row_count

GROUPS = 13  # code points that leave the same remainder; of a to z two letters each
WIDE = [[0, 6], [0, 3, 6, 10], list(range(GROUPS))]  # where the wide groups of a cell begin, level by level
CELL_WORDS = 20_000  # a cell of more is cut
SHARD_WORDS = 20_000
LEAF = 48  # nodes of so few words are not opened further
BLOCK = 1 << 20  # numbers compared at a time
FLUSH = 200_000  # distinct words a task counts before it passes them on
WIDTH = 64  # words of more letters are compared one pair at a time


def count_words(docs: DataFrame, shortest: int, dropped: int, text: str, key: str) -> DataFrame:
    """(word, n) with partial counts: the runs of letters of all texts, some of them with a letter taken out.

    A run that may still have ``shortest`` letters is looked at only. Every task counts before it passes on.
    """
    run_of = re.compile(rf"[a-zÀ-ÿ]{{{max(shortest, 1)},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(known), pa.string()), pa.array(list(known.values()), pa.int64())],
                                   ["word", "n"])

        for batch in batches:
            for name, body in zip(batch.column(0), batch.column(1)):
                # Bytes are lower-cased in A to Z only.
                whole = (body.as_py() or "").encode().lower().decode()
                prefix = zlib.crc32(f"{'' if name.as_py() is None else name.as_py()}:".encode())
                for word, n in Counter(run_of.findall(whole)).items():
                    h = zlib.crc32(word.encode(), prefix)
                    if h % dropped == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < shortest:
                            continue
                    known[word] += n
                if len(known) > FLUSH:
                    yield out()
                    known.clear()
        if known:
            yield out()

    return docs.select(docs[key], docs[text]).mapInArrow(run, "word string, n long")


def letter_counts(words: list[bytes]) -> np.ndarray:
    """One row of GROUPS counts for each word of Latin-1 bytes. A count stops at 120, which only widens a search."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), lengths)
    letters = np.frombuffer(b"".join(words), np.uint8) % GROUPS
    counts = np.bincount(owner * GROUPS + letters, minlength=len(words) * GROUPS).reshape(-1, GROUPS)
    return np.minimum(counts, 120).astype(np.int8)


def steps_within_budget(groups: int) -> np.ndarray:
    """What one edit can change in the counts: nothing, one more, one less, or both."""
    one = np.eye(groups, dtype=np.int64)
    both = [one[i] - one[j] for i in range(groups) for j in range(groups) if i != j]
    return np.array([np.zeros(groups, np.int64), *one, *-one, *both])


def cell_ids(counts: np.ndarray, level: int) -> np.ndarray:
    ids = np.full(len(counts), level + 1, np.uint64)
    for column in counts.T:
        ids = mix(ids * BASE + column.astype(np.uint64))
    return ids.astype(np.int64)


def wide_counts(counts: np.ndarray, level: int) -> np.ndarray:
    return np.add.reduceat(counts.astype(np.int64), WIDE[level], axis=1)


class Cells:
    """Which cell a word lies in and which it searches, knowing the cells that are too full at each level."""

    def __init__(self, full: list[dict[int, int]]):
        self.full = [np.array(sorted(level), np.int64) for level in full]
        self.parts = full[-1] if len(full) == len(WIDE) else {}

    def is_full(self, ids: np.ndarray, level: int) -> np.ndarray:
        return np.isin(ids, self.full[level]) if level < len(self.full) else np.zeros(len(ids), bool)

    def own(self, counts: np.ndarray, words: list[bytes]) -> np.ndarray:
        ids = cell_ids(wide_counts(counts, 0), 0)
        for level in range(len(WIDE) - 1):
            full = np.flatnonzero(self.is_full(ids, level))
            if len(full):
                ids[full] = cell_ids(wide_counts(counts[full], level + 1), level + 1)
        for i in np.flatnonzero(self.is_full(ids, len(WIDE) - 1)) if self.parts else ():
            ids[i] = self.part(ids[i], zlib.crc32(words[i]) % self.parts[int(ids[i])])
        return ids

    @staticmethod
    def part(cell: int, number: int) -> int:
        return int(mix(np.array([cell], np.int64).astype(np.uint64) + np.uint64(number + 1)).astype(np.int64)[0])

    def searched(self, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(words, cells) of all cells that hold words within the budget."""
        for level in range(min(len(WIDE), len(self.full) + 1)):
            fine = wide_counts(counts, level)
            for change in steps_within_budget(fine.shape[1]):
                near = fine + change
                who = np.flatnonzero((near >= 0).all(1))
                if level:  # only below cells that are too full
                    above = np.add.reduceat(near[who], [WIDE[level].index(x) for x in WIDE[level - 1]], axis=1)
                    who = who[self.is_full(cell_ids(above, level - 1), level - 1)]
                ids = cell_ids(near[who], level)
                full = self.is_full(ids, level)
                yield who[~full], ids[~full]
                if level == len(WIDE) - 1:
                    for i, cell in zip(who[full].tolist(), ids[full].tolist()):
                        parts = [self.part(cell, k) for k in range(self.parts[cell])]
                        yield np.full(len(parts), i), np.array(parts, np.int64)


def one_edit(a: bytes, b: bytes) -> bool:
    """Do the words differ by exactly one letter put in, taken out or replaced?"""
    if len(a) > len(b):
        a, b = b, a
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    if len(a) == len(b):
        return same < len(a) and a[same + 1:] == b[same + 1:]
    return len(b) - len(a) == 1 and a[same:] == b[same + 1:]


class Words:
    """Words as rows of letters, for comparing many pairs at once."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        width = int(min(WIDTH, self.lengths.max(initial=1))) + 1
        self.letters = np.array([w[:width] for w in words], f"S{width}").view(np.uint8).reshape(len(words), width)

    def one_edit_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of words a[i], b[i]: is it one edit apart?"""
        turned = self.lengths[a] > self.lengths[b]
        a, b = np.where(turned, b, a), np.where(turned, a, b)
        longer = self.lengths[b] - self.lengths[a]
        short, long = self.letters[a], self.letters[b]
        differ = short != long
        shifted = short[:, :-1] != long[:, 1:]
        last = np.where(shifted.any(1), shifted.shape[1] - 1 - shifted[:, ::-1].argmax(1), -1)
        out = np.where(longer == 0, differ.sum(1) == 1, (longer == 1) & (last < differ.argmax(1)))
        for i in np.flatnonzero((self.lengths[b] > WIDTH) & (longer < 2)).tolist():
            out[i] = one_edit(self.words[a[i]], self.words[b[i]])
        return out


def search(known: Words, counts: np.ndarray, indexed: np.ndarray, asking: np.ndarray) -> Iterator[tuple]:
    """(asking word, indexed word) of all pairs one edit apart, as arrays.

    The indexed words are sorted by their counts, so that a node of the trie is a stretch of them. A stack holds the nodes
    still to open, each with the searches that reach it and what these have spent: bit 0 the surplus, bit 1 the deficit.
    """
    order = indexed[np.lexsort(counts[indexed].T[::-1])]
    sorted_counts = counts[order]
    stack = [(0, len(order), 0, asking, np.zeros(len(asking), np.uint8))]
    while stack:
        first, last, level, who, spent = stack.pop()
        while len(who) and level < GROUPS and last - first > LEAF and (
                sorted_counts[first, level] == sorted_counts[last - 1, level]):  # one child only
            who, spent = step(who, spent, counts[who, level] - sorted_counts[first, level])
            level += 1
        if not len(who):
            continue
        if level == GROUPS or last - first <= LEAF:
            yield from leaves(known, counts, order[first:last], who, spent, level)
            continue
        column = sorted_counts[first:last, level]
        edges = first + np.flatnonzero(np.diff(column, prepend=column[0] - 1))
        for start, end in zip(edges.tolist(), [*edges[1:].tolist(), last]):
            near, cost = step(who, spent, counts[who, level] - sorted_counts[start, level])
            if len(near):
                stack.append((start, end, level + 1, near, cost))


def step(who: np.ndarray, spent: np.ndarray, difference: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The searches that can afford a child with these differences, and what they have spent then."""
    cost = (difference == 1) | (difference == -1).astype(np.uint8) << 1
    fine = (np.abs(difference) <= 1) & (spent & cost == 0)
    return who[fine], (spent | cost)[fine]


def leaves(known: Words, counts: np.ndarray, at: np.ndarray, who: np.ndarray, spent: np.ndarray,
           level: int) -> Iterator[tuple]:
    """The verified pairs between the searches ``who`` and the words ``at`` of one node."""
    for first in range(0, len(at), LEAF):
        some = at[first:first + LEAF]
        rows = max(1, BLOCK // (len(some) * max(1, GROUPS - level)))
        for begin in range(0, len(who), rows):
            left, cost = who[begin:begin + rows], spent[begin:begin + rows]
            surplus = np.repeat((cost & 1)[:, None], len(some), 1)
            deficit = np.repeat((cost >> 1)[:, None], len(some), 1)
            for g in range(level, GROUPS):
                difference = counts[left, g][:, None] - counts[some, g][None, :]
                surplus += np.maximum(difference, 0).astype(np.uint8)
                deficit += np.maximum(-difference, 0).astype(np.uint8)
                np.minimum(surplus, 100, out=surplus)
                np.minimum(deficit, 100, out=deficit)
            i, j = np.nonzero((surplus <= 1) & (deficit <= 1))
            a, b = left[i], some[j]
            near = known.one_edit_apart(a, b)
            yield a[near], b[near]


def nearest(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """For each word with near words in this shard: how many, and the most frequent of them, the smallest of equals."""
    words = [w.encode("latin-1") for w in rows["word"]]
    known, counts = Words(words), letter_counts(words)
    cell, indexed = rows["cell"].to_numpy(), np.flatnonzero(rows["indexed"].to_numpy())
    n = rows["n"].to_numpy()
    place = np.empty(len(words), np.int64)
    place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    found: list[tuple] = []

    def reduced() -> tuple:
        left, right, near = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort([place[right], -n[right], left])
        left, right, near = left[order], right[order], near[order]
        first = np.flatnonzero(np.diff(left, prepend=-1))
        return left[first], right[first], np.add.reduceat(near, first) if len(first) else near

    for a, b in search(known, counts, indexed, np.arange(len(words))):
        inside, onward = cell[a] == cell[b], cell[b] > cell[a]
        one = np.ones(len(a), np.int64)
        found += [(a[inside | onward], b[inside | onward], one[inside | onward]), (b[onward], a[onward], one[onward])]
        if len(found) > 5000:
            found = [reduced()]
    left, right, near = reduced() if found else (np.empty(0, np.int64),) * 3
    names = rows["word"].to_numpy()
    return pd.DataFrame({"word": names[left], "n_near": near, "best": names[right], "best_n": n[right]})


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best, best_n) of every word of ``words(word, n)`` that has a near one."""
    shards = max(1, -(-row_count(words) // SHARD_WORDS))
    full: list[dict[int, int]] = []

    def cells_of(known: Cells):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
                yield pa.record_batch([pa.array(known.own(letter_counts(names), names))], ["cell"])
        return run

    for _ in WIDE:
        cells = words.mapInArrow(cells_of(Cells(full)), "cell long").groupBy("cell").count()
        crowded = cells.where(F.col("count") > CELL_WORDS).collect()  # at most one in CELL_WORDS of the words
        known = set().union(*full)
        more = {r["cell"]: -(-r["count"] // CELL_WORDS) for r in crowded if r["cell"] not in known}
        if not more:
            break
        full.append(more)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Cells(full)
        for batch in batches:
            names = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
            if not names:
                continue
            counts = letter_counts(names)
            own = known.own(counts, names)
            who, shard = [np.arange(len(names))], [own % shards]
            for some, cells in known.searched(counts):
                onward = cells > own[some]
                who.append(some[onward])
                shard.append(cells[onward] % shards)
            pairs = np.unique(np.concatenate(who) * shards + np.concatenate(shard))
            at, shard = pairs // shards, pairs % shards
            yield pa.record_batch([batch.column("word").take(pa.array(at)), batch.column("n").take(pa.array(at)),
                                   pa.array(own[at]), pa.array(shard), pa.array(shard == own[at] % shards)],
                                  ["word", "n", "cell", "shard", "indexed"])

    dealt = words.mapInArrow(deal, "word string, n long, cell long, shard long, indexed boolean")
    near = dealt.groupBy("shard").applyInPandas(nearest, "word string, n_near long, best string, best_n long")
    best = near.groupBy("word").agg(F.sum("n_near").alias("n_near"),
                                    F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("first"))
    return best.select("word", "n_near", F.col("first.best").alias("best"), (-F.col("first.less")).alias("best_n"))


def last_of_chain(links: DataFrame) -> DataFrame:
    """(word, root): where ``links(word, form)`` lead in the end. Every round doubles the length of a step.

    A form is ``ratio`` times as frequent as its word, so a chain is short and has no circle.
    """
    now = materialize(links.select("word", F.col("form").alias("root")), "chain")
    while True:
        asked = now.groupBy("root").agg(F.count(F.lit(1)).alias("freq"))
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        table = materialize(onward.join(asked, "root"), "onward")  # words that others lead to and that lead on
        if not row_count(table):
            return now
        now = materialize(lookup(now, table, ["root"], freq="freq", spread_by=["word"]).select(
            "word", F.coalesce("next", "root").alias("root")), "chain")


def variants(docs: DataFrame, shortest: int = 7, least: int = 2, dropped: int = 31, ratio: int = 10, text: str = "text",
             key: str = "doc_id") -> DataFrame:
    """One row for each word: ``word``, ``n`` (how often it occurs), ``n_near`` (words one edit apart), ``form`` (the most
    frequent near word, if at least ``ratio`` times as frequent; else null), ``form_n`` and ``root`` (the end of the chain
    of forms, or the word itself).

    Words are runs of the letters A to Z, a to z and U+00C0 to U+00FF in whole texts, lower-cased in A to Z only. If the
    unsigned crc32 of ``<key>:<run>`` is divisible by ``dropped``, the letter at that number modulo the length is taken
    out. What has ``shortest`` letters and occurs ``least`` times in all is a word. Of near words of equal frequency the
    smallest in code-point order is the form. A null text has no words, a null key counts as empty; repeated rows count
    each. An empty table gives no rows. Other columns are ignored.
    """
    counted = count_words(docs, shortest, dropped, text, key).groupBy("word").agg(F.sum("n").alias("n"))
    words = materialize(counted.where(F.col("n") >= least), "words")
    near = materialize(near_words(words), "near")
    joined = materialize(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best")).alias("form"),
        F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best_n")).alias("form_n")), "forms")
    roots = last_of_chain(joined.where("form is not null"))
    return joined.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
