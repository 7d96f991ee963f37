"""Encoding and packing against the libraries that own the vocabularies."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tailsplit.llm import bpe, packing, textblock
from tests.llm import cases

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("clashing", [False, True])
def test_encoding_is_that_of_the_library(spark, clashing):
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    known = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for key, text in cases.texts():
        ids = known.encode_ordinary(text or "")
        raw = np.array(ids, "<u4").tobytes()
        want.append((key, len(ids), hashlib.sha256(raw).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    got = [tuple(r) for r in bpe.round_trip_digests(cases.documents(spark, clashing), RANKS).select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def check_packing(got, want_ids, window):
    """Each id lies in exactly one piece and the pieces of a sequence leave no gap."""
    sequences = {}
    left = {}
    for key, ids in want_ids:
        left.setdefault((key, zlib.crc32(np.array(ids, "<u4").tobytes())), []).append(ids)
    by_key = {}
    for r in got:
        by_key.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for key, pieces in by_key.items():
        wanted = sorted((ids[s:s + window] for k, ids in want_ids if k == key for s in range(0, len(ids), window)),
                        key=str)
        crcs = sorted(zlib.crc32(np.array(x, "<u4").tobytes()) for x in wanted)
        assert sorted(p.ids_crc32 for p in pieces) == crcs
        assert sum(p.length for p in pieces) == sum(map(len, wanted))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= window
    return len(sequences)


@pytest.mark.parametrize("clashing", [False, True])
def test_every_id_is_packed_once(spark, clashing):
    known = Tokenizer.from_file(VOCABULARY)
    want = [(key, known.encode(text or "", add_special_tokens=False).ids + [0]) for key, text in cases.texts()]
    got = packing.pack(cases.documents(spark, clashing), VOCABULARY, 1024, 0).collect()
    n = check_packing(got, want, 1024)
    assert n <= -(-sum(len(ids) for _, ids in want) // 1024) + 2
    for r in got:
        assert r.start + r.length <= r.doc_tokens


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(5)
    for _ in range(50):
        lengths = sorted((rng.randint(1, 32) for _ in range(rng.randint(0, 80))), reverse=True)
        rooms, want = [], []
        for n in lengths:
            fitting = [(room, i) for i, room in enumerate(rooms) if room >= n]
            if not fitting:
                rooms.append(32)
                fitting = [(32, len(rooms) - 1)]
            room, i = min(fitting)
            want.append(room)
            rooms[i] -= n
        numbers, offsets = packing.best_fit(lengths, 32)
        assert [32 - x for x in offsets] == want
        assert len(set(numbers)) == len(rooms)


def test_empty_tables(spark):
    assert packing.pack(cases.none_at_all(spark), VOCABULARY).count() == 0
    assert bpe.round_trip_digests(cases.none_at_all(spark), RANKS).count() == 0


# Letters and digits that are younger than the Unicode tables of Python 3.13, and some code points that are none yet.
YOUNG = ["\u0558", "\u088f", "\u0c5c", "\U00010ee7", "\U00016ea7", "\U0001cce1", "\U00011de1", "\U000323b0", "\U0003347a", "\uffff"]


def test_young_characters(spark):
    texts = [f"a{c}b 12{c}3 {c}{c} 'll{c}\n{c} ." for c in YOUNG] + ["old text", f"old {YOUNG[3]}"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    known = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: (np.frombuffer(r.ids, "<u4").tolist(), r.decoded.decode()) for r in bpe.round_trip(rows, RANKS).collect()}
    assert got == {i: (known.encode_ordinary(t), t) for i, t in enumerate(texts)}
    other = Tokenizer.from_file(VOCABULARY)
    want = [(i, other.encode(t, add_special_tokens=False).ids + [0]) for i, t in enumerate(texts)]
    check_packing(packing.pack(rows, VOCABULARY, 1024, 0).collect(), want, 1024)


def test_pieces_are_remembered_within_bounds():
    asked = []

    def encode(pieces):
        asked.extend(pieces)
        return [np.frombuffer(p.encode("utf-32-le"), "<u4").tobytes() for p in pieces]

    rng = random.Random(9)
    ids_of = textblock.PieceIds(encode, None, most=40)
    for _ in range(60):
        texts = [" ".join(f"w{int(rng.expovariate(0.08))}" for _ in range(rng.randint(0, 12))) for _ in range(3)]
        ids, counts = ids_of(texts)
        assert "".join(map(chr, ids)) == "".join(texts) and counts.tolist() == [len(t) for t in texts]
        assert len(ids_of.first) <= 40 and len(ids_of.ids) <= 160
    assert len(asked) > len(set(asked)) and len(set(asked)) > 40
