"""Whole texts as flat arrays: a block of documents is split, hashed and compared without a loop over its words.

A block holds as many rows of an Arrow batch as fit a number of characters; a longer row is a block of its own, so
that nothing is ever cut. The helpers run inside tasks.
"""

from __future__ import annotations

import ctypes
import gc
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK_CHARS = 1 << 18
END = 0x110000  # follows each document in a block; no character has this number
SPACE_CLASS, LETTER, NUMBER, OTHER, END_CLASS, YOUNG = range(6)
BASE, BASE2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)  # odd, so that they have inverses mod 2**64

# The characters of Unicode's White_Space property.
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005,
               0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def text_blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of consecutive rows; a null text is an empty one."""
    first, size, texts = 0, 0, []
    for i, value in enumerate(column):
        text = value.as_py() or ""
        if texts and size + len(text) > limit:
            yield first, texts
            first, size, texts = i, 0, []
        texts.append(text)
        size += len(text)
    if texts:
        yield first, texts


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """The class of each code point, as the pre-tokenising pattern tells them apart.

    Code points that Python's Unicode tables do not know may be letters to a library with younger ones.
    """
    classes = np.full(END + 1, OTHER, np.uint8)
    for code in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(code))
        if kind == "Cn":
            classes[code] = YOUNG
        elif kind[0] == "L":
            classes[code] = LETTER
        elif kind[0] == "N":
            classes[code] = NUMBER
    classes[WHITE_SPACE] = SPACE_CLASS
    classes[END] = END_CLASS
    return classes


def release_memory() -> None:
    """Hands back what earlier tasks of this worker have freed; called where a task starts."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def code_points(texts: list[str]) -> np.ndarray:
    mark = END.to_bytes(4, "little")
    return np.frombuffer(mark.join(t.encode("utf-32-le", "surrogatepass") for t in texts) + mark, np.uint32)


def pretokens(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the pieces into which public_tokenizers.PATTERN cuts a block's texts.

    The pieces tile a text, so it is enough to mark where one begins: at each run of letters, digits, white space or
    other characters; one blank before a run belongs to it; an English contraction is a piece of its own.
    """
    kinds = char_classes()[codes]
    n = len(codes)
    begins = np.ones(n, bool)
    begins[1:] = kinds[1:] != kinds[:-1]
    runs = np.flatnonzero(begins)
    begins[kinds == END_CLASS] = True
    kind = kinds[runs]
    # White space in front of something: its last character is a piece, or joins what follows if it is a blank.
    before = np.flatnonzero((kind[:-1] == SPACE_CLASS) & (kind[1:] != END_CLASS)) if len(runs) > 1 else np.empty(0, int)
    follow = runs[before + 1]
    begins[follow - 1] = True
    begins[follow[codes[follow - 1] == 0x20]] = False
    # Contractions.
    quote = runs[:-1][(codes[runs[:-1]] == 0x27) & (runs[1:] - runs[:-1] == 1) & (kind[1:] == LETTER)]
    quote = quote[(quote == 0) | (codes[np.maximum(quote - 1, 0)] != 0x20)]
    one = codes[quote + 1]
    two = np.where(quote + 2 < n, codes[np.minimum(quote + 2, n - 1)], 0)
    single = np.isin(one, [ord(c) for c in "stmd"])
    double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    begins[quote[single | double] + 1] = False
    begins[quote[single] + 2] = True
    begins[quote[double] + 3] = True
    at = np.flatnonzero(begins)
    real = kinds[at] != END_CLASS
    return at[real], np.append(at[1:], n)[real]


def documents_of(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The number of the document that each piece lies in."""
    return np.searchsorted(np.flatnonzero(codes == END), starts)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse, i < n, modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK_CHARS + 4096)
        step = np.full(size, base, np.uint64)
        step[0] = 1
        back = np.full(size, pow(int(base), -1, 1 << 64), np.uint64)
        back[0] = 1
        have = np.cumprod(step), np.cumprod(back)
        if size <= 2 * BLOCK_CHARS:
            _powers[int(base)] = have
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads a hash over all its bits; one to one."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


class SpanHash:
    """Hashes of any spans of a sequence, from prefix sums; equal spans have equal hashes wherever they stand."""

    def __init__(self, values: np.ndarray, base: np.uint64 = BASE):
        up, self.down = powers(base, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])


def distinct_spans(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(first hash, second hash, representative, inverse) of the distinct pieces; together the hashes have 128 bits."""
    first = SpanHash(codes, BASE)(starts, ends)
    second = SpanHash(codes, BASE2)(starts, ends)
    keys, at, inverse = np.unique(first, return_index=True, return_inverse=True)
    if not (second == second[at][inverse]).all():  # two pieces share the first hash
        both = np.empty(len(first), [("a", np.uint64), ("b", np.uint64)])
        both["a"], both["b"] = first, second
        _, at, inverse = np.unique(both, return_index=True, return_inverse=True)
        keys = first[at]
    return keys, second[at], at, inverse


def ragged(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of the consecutive groups of the given lengths."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


class PieceIds:
    """The ids of a block's pieces. A worker encodes a piece once, as long as it remembers it.

    What it remembers are arrays sorted by the first hash, with room for ``most`` pieces and ``most * 4`` ids: some
    15 MB. When they are full, the pieces stay that were used since they were full the last time, if that is half of
    them at most. Texts with characters that are not in Python's Unicode tables are left to ``whole``.
    """

    def __init__(self, encode, whole, most: int = 300_000):
        self.encode, self.whole, self.most = encode, whole, most
        self.forget()

    def forget(self) -> None:
        self.first, self.second = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.begin, self.length, self.used = np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, bool)
        self.ids = np.empty(0, np.uint32)

    def recall(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(is it known, where) for each piece."""
        if not len(self.first):
            return np.zeros(len(first), bool), np.zeros(len(first), np.int64)
        at = np.minimum(np.searchsorted(self.first, first), len(self.first) - 1)
        return (self.first[at] == first) & (self.second[at] == second), at

    def remember(self, first: np.ndarray, second: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Adds pieces that are not known, in order of ``first``."""
        if len(self.first) + len(first) > self.most or len(self.ids) + len(ids) > 4 * self.most:
            if 2 * self.used.sum() > len(self.used) or 2 * self.length[self.used].sum() > len(self.ids):
                self.forget()
            else:
                kept = self.length[self.used]
                self.ids = self.ids[np.repeat(self.begin[self.used], kept) + ragged(kept)]
                self.first, self.second, self.length = (x[self.used] for x in (self.first, self.second, self.length))
                self.begin = (np.cumsum(kept) - kept).astype(np.int32)
                self.used = np.zeros(len(kept), bool)
        if len(first) > self.most or len(ids) > 4 * self.most:
            return
        alone = np.ones(len(first), bool)  # of pieces that share the first hash none but the first is remembered
        alone[1:] = first[1:] != first[:-1]
        if len(self.first):
            at = np.searchsorted(self.first, first)
            alone &= self.first[np.minimum(at, len(self.first) - 1)] != first
        begin = len(self.ids) + np.cumsum(lengths) - lengths
        at = np.searchsorted(self.first, first[alone])
        self.ids = np.concatenate([self.ids, ids])
        self.first, self.second = np.insert(self.first, at, first[alone]), np.insert(self.second, at, second[alone])
        self.begin, self.length = np.insert(self.begin, at, begin[alone]), np.insert(self.length, at, lengths[alone])
        self.used = np.insert(self.used, at, True)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text)."""
        codes = code_points(texts)
        young = np.flatnonzero(char_classes()[codes] == YOUNG)
        if not len(young):
            return self.of_known(texts, codes)
        left = set(documents_of(codes, young).tolist())
        rest = ["" if i in left else t for i, t in enumerate(texts)]
        ids, counts = self.of_known(rest, code_points(rest))
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for i in left:
            parts[i] = np.asarray(self.whole(texts[i]), np.uint32)
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)

    def of_known(self, texts: list[str], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends = pretokens(codes)
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        first, second, at, inverse = distinct_spans(codes, starts, ends)
        known, where = self.recall(first, second)
        lengths = np.zeros(len(first), np.int64)
        lengths[known] = self.length[where[known]]
        begins = np.zeros(len(first), np.int64)
        begins[known] = self.begin[where[known]]
        self.used[where[known]] = True
        source = self.ids
        if not known.all():
            text = "\x00".join(texts) + "\x00"  # one character for each code of the block
            new = at[~known]
            packed = self.encode([text[s:e] for s, e in zip(starts[new].tolist(), ends[new].tolist())])
            sizes = np.fromiter((len(x) >> 2 for x in packed), np.int64, len(packed))
            fresh = np.frombuffer(b"".join(packed), np.uint32)
            lengths[~known] = sizes
            begins[~known] = len(source) + np.cumsum(sizes) - sizes
            source = np.concatenate([source, fresh])
            self.remember(first[~known], second[~known], fresh, sizes)
        counts = lengths[inverse]
        ids = source[np.repeat(begins[inverse], counts) + ragged(counts)]
        return ids, np.bincount(documents_of(codes, starts), counts, len(texts)).astype(np.int64)
