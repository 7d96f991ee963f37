"""Packing token sequences into windows: best fit, longest first.

Documents are tokenised where they lie; overlong ones are cut into full windows. Only narrow rows (ids of the piece,
no tokens) travel, in lots of a bounded number of pieces; each lot is packed in one task. A segment tree over the
remaining capacities finds the tightest open window for a piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tailsplit.llm.textblock import PieceIds, release_memory, text_blocks
from tailsplit.scratch import materialize, row_count

LOT_PIECES = 40_000


class Capacities:
    """How many open windows have each remaining capacity; finds the smallest capacity that suffices."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, by: int) -> None:
        node = self.size + capacity
        while node:
            self.count[node] += by
            node >>= 1

    def tightest(self, need: int) -> int:
        """The smallest capacity of at least ``need`` that a window has, or -1."""
        node, count = self.size + need, self.count
        if count[node]:
            return need
        while node > 1:
            if not node & 1 and count[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if count[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return -1


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """(window number, offset) of each piece; the lengths are in falling order, none above ``window``."""
    tree, open_windows = Capacities(window), [[] for _ in range(window + 1)]
    numbers, offsets, opened = [], [], 0
    for length in lengths:
        room = tree.tightest(length)
        if room < 0:
            number, room, opened = opened, window, opened + 1
        else:
            number = open_windows[room].pop()
            tree.add(room, -1)
        numbers.append(number)
        offsets.append(window - room)
        if room > length:
            open_windows[room - length].append(number)
            tree.add(room - length, 1)
    return numbers, offsets


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    added = [t.content for t in loaded.get_added_tokens_decoder().values()]

    def encode(pieces: list[str]) -> list[bytes]:
        found = loaded.encode_batch_fast(pieces, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    return loaded, added, PieceIds(encode, lambda t: loaded.encode(t, add_special_tokens=False).ids)


def token_pieces(docs: DataFrame, path: str, window: int, end_id: int | None, text: str, key: str) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, lot): each document's ids cut at multiples of ``window``."""
    source = docs.select(docs[key].alias("k"), docs[text].alias("t"))
    schema = T.StructType([T.StructField("k", source.schema["k"].dataType)] + [
        T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "lot")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        release_memory()
        loaded, added, ids_of = tokenizer(path)
        lot = TaskContext.get().partitionId() << 33
        last = np.array([] if end_id is None else [end_id], "<u4")
        for batch in batches:
            keys = batch.column("k")
            for first, texts in text_blocks(batch.column("t")):
                special = {i for i, t in enumerate(texts) if any(a in t for a in added)}
                ids, counts = ids_of(["" if i in special else t for i, t in enumerate(texts)])
                ends = np.cumsum(counts).tolist()
                rows = []
                for i, (end, n) in enumerate(zip(ends, counts.tolist())):
                    own = ids[end - n:end]
                    if i in special:
                        own = np.array(loaded.encode(texts[i], add_special_tokens=False).ids, "<u4")
                    own = np.concatenate([own, last]).astype("<u4")
                    for start in range(0, len(own), window):
                        part = own[start:start + window]
                        rows.append((i, start, len(part), zlib.crc32(part.tobytes()), len(own), lot))
                        lot += 1
                if rows:
                    at, *columns = zip(*rows)
                    yield pa.record_batch([keys.slice(first, len(texts)).take(pa.array(at))]
                                          + [pa.array(c, pa.int64()) for c in columns], schema.names)

    return source.mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, window: int = 1024, end_id: int | None = 0, text: str = "text",
         key: str = "doc_id") -> DataFrame:
    """Packs every whole text into sequences of at most ``window`` tokens.

    One row for each piece: ``key``, ``start`` (the document's ids before it), ``length``, ``ids_crc32`` (of the ids
    as little-endian unsigned 32-bit numbers), ``doc_tokens`` (with ``end_id``, which follows each document unless
    None), ``sequence_id`` and ``offset`` in it. A document that fits a window is never cut. A null or empty text has
    ``end_id`` only; repeated rows are packed once each; a null key stays null. Other columns are ignored.
    """
    pieces = materialize(token_pieces(docs, path, window, end_id, text, key), "pieces")
    lots = max(1, -(-row_count(pieces) // LOT_PIECES))
    schema = T.StructType([*pieces.drop("lot").schema.fields, T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])

    def run(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "lot"], ascending=[False, True], ignore_index=True)
        number, offset = best_fit(rows["length"].tolist(), window)
        rows["sequence_id"] = np.array(number, np.int64) + (int(group[0]) << 32)
        rows["offset"] = np.array(offset, np.int64)
        return rows[schema.names]

    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("lot"), F.lit(lots)))
    return dealt.groupBy("part").applyInPandas(run, schema).withColumnRenamed("k", key)
