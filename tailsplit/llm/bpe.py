"""Byte-level BPE by replaying the merges over all distinct pieces of a block at once.

An inverted index leads from each rank to the places of the pairs that this merge joins. The lowest rank is applied
at all its places in all pieces before the next; only the two neighbours of a joined pair enter the index anew.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from tailsplit.llm.textblock import PieceIds, text_blocks

SHIFT = 20  # a pair of ids as one number; vocabularies have fewer than 2**20 ids


class RankFile:
    """A vocabulary of byte strings, one ``base64 rank`` a line."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        if max(self.ranks.values()) >> SHIFT:
            raise ValueError("too many ids")
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        self.pairs: dict[int, int] = {}
        for token, rank in self.ranks.items():
            self.bytes[rank] = token
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << SHIFT | right] = rank
        self.single = [self.ranks[bytes([b])] for b in range(256)]

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """The packed ids of each piece."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        whole = [self.ranks.get(p) for p in raw]
        rest = replay([p for p, rank in zip(raw, whole) if rank is None], self.pairs, self.single)
        return [next(rest) if rank is None else rank.to_bytes(4, "little") for rank in whole]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


def replay(pieces: list[bytes], pairs: dict[int, int], single: list[int]) -> Iterator[bytes]:
    """The packed ids of each piece after all merges that apply to it, lowest rank first, leftmost first.

    A merge may bring about a pair of lower rank than its own (that pair's token was made from other parts). The
    piece then waits with its other places of the rank until the lower one has been applied.
    """
    ids: list[int] = []
    piece: list[int] = []
    for number, raw in enumerate(pieces):
        ids.extend(map(single.__getitem__, raw))
        piece.extend([number] * len(raw))
    size = len(ids)
    after = [i + 1 if i + 1 < size and piece[i + 1] == piece[i] else -1 for i in range(size)]
    before = [i - 1 if i and piece[i - 1] == piece[i] else -1 for i in range(size)]
    index: dict[int, list[int]] = defaultdict(list)
    rank_of = pairs.get
    for i in range(size - 1):
        if after[i] > 0 and (rank := rank_of(ids[i] << SHIFT | ids[i + 1])) is not None:
            index[rank].append(i)
    heap = list(index)
    heapq.heapify(heap)
    while heap:
        rank = heapq.heappop(heap)
        places = index.pop(rank, None)
        if not places:
            continue
        places.sort()
        waits: set[int] = set()
        for i in places:
            j = after[i]
            if j < 0 or ids[i] < 0 or rank_of(ids[i] << SHIFT | ids[j]) != rank:
                continue
            if waits and piece[i] in waits:
                if rank not in index:
                    heapq.heappush(heap, rank)
                index[rank].append(i)
                continue
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                new = rank_of(rank << SHIFT | ids[k])
                if new is not None:
                    if new not in index:
                        heapq.heappush(heap, new)
                    index[new].append(i)
                    if new < rank:
                        waits.add(piece[i])
            h = before[i]
            if h >= 0:
                new = rank_of(ids[h] << SHIFT | rank)
                if new is not None:
                    if new not in index:
                        heapq.heappush(heap, new)
                    index[new].append(h)
                    if new < rank:
                        waits.add(piece[i])
    left = np.array(ids, np.int64)
    kept = left >= 0
    counts = np.bincount(np.array(piece, np.int64)[kept], minlength=len(pieces)) if size else [0] * len(pieces)
    packed, at = left[kept].astype("<u4").tobytes(), 0
    for n in counts:
        yield packed[4 * at:4 * (at + n)]
        at += n


@lru_cache(maxsize=2)
def rank_file(path: str) -> tuple[RankFile, PieceIds]:
    """Read once for each Python worker, with the pieces that it remembers."""
    ranks = RankFile(path)

    @lru_cache(maxsize=1)
    def library():
        import tiktoken

        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.ranks, special_tokens={})

    return ranks, PieceIds(ranks.encode_pieces, lambda t: library().encode_ordinary(t))


def round_trip(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encodes every whole text and decodes it again.

    ``docs`` needs the columns ``key`` and ``text``; other columns are ignored. One row a document, repeated rows
    included: ``key``, ``n_tokens``, ``ids`` (binary, little-endian unsigned 32-bit) and ``decoded`` (binary). A null
    or empty text has no ids and decodes to nothing; a null key stays null. A text with a character younger than Python's
    Unicode tables is encoded by the library itself, whose tables alone tell whether it is a letter.
    """
    return _encoded(docs, path, text, key, digest=False)


def round_trip_digests(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``round_trip`` with the SHA-256 of both binaries in their place, made where they are."""
    return _encoded(docs, path, text, key, digest=True)


def _encoded(docs: DataFrame, path: str, text: str, key: str, digest: bool) -> DataFrame:
    source = docs.select(docs[key].alias("k"), docs[text].alias("t"))
    kind = source.schema["k"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, ids_of = rank_file(path)
        for batch in batches:
            keys = batch.column("k")
            for first, texts in text_blocks(batch.column("t")):
                ids, counts = ids_of(texts)
                ends = np.cumsum(counts)
                parts = [ids[e - n:e] for e, n in zip(ends.tolist(), counts.tolist())]
                packed = [p.astype("<u4").tobytes() for p in parts]
                decoded = [ranks.decode(p) for p in parts]
                if digest:
                    packed, decoded = ([hashlib.sha256(x).hexdigest() for x in column] for column in (packed, decoded))
                plain = pa.string() if digest else pa.binary()
                yield pa.record_batch([keys.slice(first, len(texts)), pa.array(counts), pa.array(packed, plain),
                                       pa.array(decoded, plain)], ["k", "n_tokens", "a", "b"])

    from pyspark.sql import types as T
    value = T.StringType() if digest else T.BinaryType()
    out = source.mapInArrow(run, T.StructType([
        T.StructField("k", kind), T.StructField("n_tokens", T.LongType()), T.StructField("a", value),
        T.StructField("b", value)]))
    return out.toDF(key, "n_tokens", *(("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded")))
