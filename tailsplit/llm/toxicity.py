"""Toxicity by a subsequence string kernel and a linear machine on Nyström landmarks.

A word is compared with landmark words by its gapped letter triples: three letters in order within five places, each
skipped place weighing less, so that an insult with letters put in between or an ending changed still resembles its
stem. The support vector machine is fitted on the words that speak most for or against their labelled texts; since it
is linear in the kernel, it collapses into one weight per triple, and scoring needs no landmark. A text is judged by the
worst of its sentences' words.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tailsplit.llm.textblock import END, SpanHash, code_points, ragged, release_memory, text_blocks
from tailsplit.scratch import materialize

TRAIN_ROWS = 20_000  # labelled texts used for fitting, at most
LANDMARKS, CANDIDATES = 128, 1500
WORDS_AT_ONCE = 8192  # words whose triples are laid out together
GAIN = 6.0  # log-likelihood gain from which a word is taken to speak for toxicity
WITNESSES = 3
DECAY = 0.6
SYMBOLS, START = 64, 62
SKIP, GAP, LIMIT = 253, 0, 254
# Offsets of the second and third letter of a triple.
TRIPLES = [(1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4)]
# Digits written for letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}


@lru_cache(maxsize=1)
def symbols() -> np.ndarray:
    """The symbol of each code point: plain letters 1 to 26, other letters 27 to 61, white space, or skipped."""
    out = np.full(END + 1, SKIP, np.uint8)
    for code in range(END):
        char = chr(code)
        kind = unicodedata.category(char)[0]
        if char.isspace():
            out[code] = GAP
        elif char in LOOKALIKES:
            out[code] = ord(LOOKALIKES[char]) - 96
        elif kind == "L":
            plain = unicodedata.normalize("NFKC", char).lower()[:1]
            out[code] = ord(plain) - 96 if "a" <= plain <= "z" else 27 + code % 35
    out[END] = LIMIT
    return out


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, starts, ends, text of each word); letters spaced out one by one make one word."""
    found = symbols()[code_points(texts)]
    found = found[found != SKIP]
    letter = (found != GAP) & (found != LIMIT)
    edge = np.diff(letter.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(starts) > 1:
        limits = np.cumsum(found == LIMIT, dtype=np.int32)
        lone = ends - starts == 1
        joined = lone[1:] & lone[:-1] & (limits[starts[1:]] == limits[starts[:-1]])
        if joined.any():
            drop = np.zeros(len(found), bool)
            for begin, end in zip(ends[:-1][joined], starts[1:][joined]):
                drop[begin:end] = True
            found, letter = found[~drop], letter[~drop]
            edge = np.diff(letter.astype(np.int8), prepend=0, append=0)
            starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return found, starts, ends, np.searchsorted(np.flatnonzero(found == LIMIT), starts)


def spell(found: np.ndarray, start: int, end: int) -> bytes:
    return found[start:end].tobytes()


def triples(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, triple, weight) of all gapped triples; a word begins with a symbol of its own."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    line = np.frombuffer(b"".join(bytes([START]) + w + b"\0\0\0\0" for w in words), np.uint8).astype(np.int64)
    owner = np.repeat(np.arange(len(words)), sizes + 5)
    parts = []
    for second, third in TRIPLES:
        a, b, c = line[:-third], line[second:len(line) - third + second], line[third:]
        at = np.flatnonzero((a > 0) & (b > 0) & (c > 0))
        parts.append((owner[at], (a[at] * SYMBOLS + b[at]) * SYMBOLS + c[at], np.full(len(at), DECAY ** (third - 2))))
    return tuple(np.concatenate(x) for x in zip(*parts)) if words else (np.empty(0, int),) * 3


def scores_of(words: list[bytes], weights: np.ndarray, bias: float) -> np.ndarray:
    """The machine's value of each word; ``weights`` has one entry for each triple."""
    owner, triple, weight = triples(words)
    norm = np.sqrt(np.maximum(np.bincount(owner, weight * weight, len(words)), 1e-12))
    return np.bincount(owner, weight * weights[triple], len(words)) / norm + bias


def kernel(words: list[bytes], landmarks: list[bytes]) -> np.ndarray:
    """The normalised subsequence kernel of words and landmarks."""
    out = np.zeros((len(words), len(landmarks)))
    owner, triple, weight = triples(words)
    norm = np.sqrt(np.maximum(np.bincount(owner, weight * weight, len(words)), 1e-12))
    for m, landmark in enumerate(landmarks):
        out[:, m] = np.bincount(owner, weight * _profile(landmark)[triple], len(words)) / norm
    return out


def _profile(word: bytes) -> np.ndarray:
    _, triple, weight = triples([word])
    return np.bincount(triple, weight, SYMBOLS**3) / np.sqrt(max((weight * weight).sum(), 1e-12))


def choose_landmarks(ranked: list[bytes], most: int = LANDMARKS, alike: float = 0.85) -> list[bytes]:
    """The first words that are not too similar to one chosen before."""
    similar, chosen = kernel(ranked, ranked), []
    for i in range(len(ranked)):
        if len(chosen) < most and (not chosen or similar[i, chosen].max() < alike):
            chosen.append(i)
    return [ranked[i] for i in chosen]


def fit_machine(x: np.ndarray, y: np.ndarray, times: np.ndarray, cost: float = 1000.0, rounds: int = 50):
    """(weights, bias) of a linear support vector machine with squared hinge loss, by Newton steps.

    Row i counts ``times[i]`` times; both classes weigh the same.
    """
    x = np.hstack([x, np.ones((len(x), 1))])
    side = np.where(y, 1.0, -1.0)
    share = times * cost * np.where(y, 0.5 / times[y].sum(), 0.5 / max(1, times[~y].sum()))
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        inside = side * (x @ w) < 1
        part, s = x[inside], share[inside]
        new = np.linalg.solve(ridge + (part * s[:, None]).T @ part, (part * s[:, None]).T @ side[inside])
        if np.abs(new - w).max() < 1e-9:
            break
        w = (w + new) / 2 if _ > 10 else new
    return w[:-1], float(w[-1])


def fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients, the constant last, that turn rows of values into probabilities; Newton steps, a little shrunk."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), 1e-2 * np.eye(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return w


class BlockScorer:
    """The values of all words of a block; a worker computes a word once while it remembers it."""

    def __init__(self, weights: np.ndarray, bias: float, most: int = 400_000):
        self.weights, self.bias, self.most, self.known = weights, bias, most, {}

    def worst(self, texts: list[str]) -> tuple[np.ndarray, list[tuple[int, bytes]]]:
        """The highest values of different words of each text, and (text, word) of them all."""
        top = np.full((len(texts), WITNESSES), self.bias - 1.0)
        found, starts, ends, text = words_of(texts)
        if not len(starts):
            return top, []
        keys, at, inverse = np.unique(SpanHash(found)(starts, ends), return_index=True, return_inverse=True)
        keys = keys.tolist()
        if len(self.known) > self.most:
            self.known.clear()
        new = [i for i, key in enumerate(keys) if key not in self.known]
        if new:
            # In slices: the triples of a very long text's words take hundreds of times its length.
            for first in range(0, len(new), WORDS_AT_ONCE):
                some = new[first:first + WORDS_AT_ONCE]
                where = at[some]
                spelled = [spell(found, s, e) for s, e in zip(starts[where].tolist(), ends[where].tolist())]
                self.known.update(zip([keys[i] for i in some], scores_of(spelled, self.weights, self.bias).tolist()))
        values = np.fromiter((self.known[key] for key in keys), np.float64, len(keys))
        once = np.unique(text * len(keys) + inverse)
        text, word = once // len(keys), once % len(keys)
        order = np.lexsort((word, -values[word], text))
        text, word = text[order], word[order]
        place = ragged(np.bincount(text, minlength=len(texts)))
        text, word, place = (x[place < WITNESSES] for x in (text, word, place))
        top[text, place] = values[word]
        begin, end = starts[at[word]].tolist(), ends[at[word]].tolist()
        return top, list(zip(text.tolist(), (spell(found, s, e) for s, e in zip(begin, end))))


def _training(docs: DataFrame, labels: DataFrame, text: str, key: str, label: str, rows: int) -> DataFrame:
    """(t, y): a bounded sample of the labelled texts that are not held out, by the hash of their key.

    Of rows that repeat a key the text with the smallest hash teaches, so that the bound holds for rows as well.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(
        (F.max(label) > 0).alias("y")).where(~held_out("k"))
    sample = F.broadcast(known.orderBy(F.xxhash64("k"), "k").limit(rows))
    texts = docs.select(docs[key].alias("k"), docs[text].alias("t")).join(sample, "k")
    once = texts.where(F.col("t").isNotNull()).groupBy("k", "y").agg(F.min_by("t", F.xxhash64("t")).alias("t"))
    return materialize(once.select("t", "y"), "labelled")


def held_out(key: str):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def _word_counts(train: DataFrame) -> DataFrame:
    """(word, toxic, clean): in how many texts of either kind a word stands."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = batch.column("y").to_numpy(zero_copy_only=False)
            for row, texts in text_blocks(batch.column("t")):
                found, starts, ends, text = words_of(texts)
                if not len(starts):
                    continue
                keys, at, inverse = np.unique(SpanHash(found)(starts, ends), return_index=True, return_inverse=True)
                once = np.unique(inverse * len(texts) + text)
                word, y = once // len(texts), flags[row + once % len(texts)]
                yield pa.record_batch(
                    [pa.array([spell(found, s, e) for s, e in zip(starts[at].tolist(), ends[at].tolist())], pa.binary()),
                     pa.array(np.bincount(word, y, len(keys)).astype(np.int64)),
                     pa.array(np.bincount(word, ~y, len(keys)).astype(np.int64))], ["word", "toxic", "clean"])

    counts = train.mapInArrow(run, "word binary, toxic long, clean long")
    return counts.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _explained(train: DataFrame, gains: dict[bytes, float]) -> dict[bytes, int]:
    """How many toxic texts have the word among their words of highest gain; at most as many words as ``gains`` has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in text_blocks(batch.column("t")):
                found, starts, ends, text = words_of(texts)
                said: list[set[tuple[float, bytes]]] = [set() for _ in texts]
                for t, s, e in zip(text.tolist(), starts.tolist(), ends.tolist()):
                    word = spell(found, s, e)
                    if word in gains:
                        said[t].add((gains[word], word))
                best = [word for own in said for _, word in sorted(own)[-WITNESSES:]]
                yield pa.record_batch([pa.array(best, pa.binary())], ["word"])

    rows = train.where("y").mapInArrow(run, "word binary").groupBy("word").count().collect()
    return {bytes(r.word): r["count"] for r in sorted(rows, key=lambda r: (-r["count"], -gains[bytes(r.word)], bytes(r.word)))}


def _witnesses(train: DataFrame, weights: np.ndarray, bias: float) -> tuple[np.ndarray, list[list[bytes]], np.ndarray]:
    """(label, worst words, their values) of each training text; bounded by the sample."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = BlockScorer(weights, bias)
        for batch in batches:
            flags = batch.column("y")
            for row, texts in text_blocks(batch.column("t")):
                top, named = scorer.worst(texts)
                words = [[] for _ in texts]
                for text, word in named:
                    words[text].append(word)
                yield pa.record_batch([flags.slice(row, len(texts)), pa.array(words, pa.list_(pa.binary())),
                                       pa.array(list(top), pa.list_(pa.float64()))], ["y", "words", "top"])

    rows = train.mapInArrow(run, "y boolean, words array<binary>, top array<double>").collect()
    return (np.array([r.y for r in rows], bool), [[bytes(w) for w in r.words] for r in rows],
            np.array([r.top for r in rows]))


class Model:
    """One weight for each letter triple, and the line that turns a text's highest values into a probability."""

    def __init__(self, weights: np.ndarray, bias: float, line: np.ndarray):
        self.weights, self.bias, self.line = weights.astype(np.float32), float(bias), line

    def probability(self, top: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(top @ self.line[:-1] + self.line[-1], -30, 30)))


def _constant(logit: float) -> Model:
    return Model(np.zeros(SYMBOLS**3), 0.0, np.array([0.0] * WITNESSES + [logit]))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic",
        rows: int = TRAIN_ROWS, rounds: int = 3) -> Model:
    """Learns from at most ``rows`` labelled texts whose key's CRC-32 (as text) modulo 3 is not 1.

    A label above 0 is toxic; of repeated labels the highest holds, of repeated keys one text; null labels, keys and texts
    teach nothing. The model itself is bounded: at most CANDIDATES words are looked at, LANDMARKS of them become landmarks,
    and a text is judged by its WITNESSES worst words. Where no word reaches the gain GAIN, the ten best stand in. Without
    texts of both kinds the model gives every text the share of toxic labels, 0 without labels.
    """
    train = _training(docs, labels, text, key, label, rows)
    n, bad = (int(x or 0) for x in train.agg(F.count(F.lit(1)), F.count_if("y")).first())
    if not bad or bad == n:
        return _constant(30.0 if bad else -30.0)
    counts = _word_counts(train)
    a, b = F.col("toxic"), F.col("clean")
    share, total = (a + b) * (bad / n), a + b
    gain = (a * F.log(a / share) + F.when(b > 0, b * F.log(b / (total - share))).otherwise(0.0))
    ranked = counts.where((a > 0) & (a > share) & (F.length("word") >= 3)).withColumn("gain", gain)
    found = ranked.orderBy(F.desc("gain"), "word").limit(CANDIDATES).collect()
    gains = {bytes(r.word): r.gain for r in found if r.gain >= GAIN} or {bytes(r.word): r.gain for r in found[:10]}
    if not gains:
        return _constant(float(np.log(bad / (n - bad))))
    toxic = _explained(train, gains)
    landmarks = choose_landmarks(list(toxic))
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks))
    whiten = vectors / np.sqrt(np.maximum(values, 1e-3)) @ vectors.T
    clean: dict[bytes, int] = {}  # the worst words of the clean texts, gathered anew after each fit
    weights, bias = np.zeros(SYMBOLS**3), 0.0  # the first value of a word is its likeness to the landmarks
    for landmark in landmarks:
        np.maximum(weights, _profile(landmark), out=weights)
    for _ in range(rounds):
        flags, words, _ = _witnesses(train, weights, bias)
        for own in (w for flag, w in zip(flags, words) if not flag):
            for word in own:
                clean[word] = clean.get(word, 0) + 1
        items = [(w, True) for w in toxic] + [(w, False) for w in clean]
        times = [*toxic.values(), *clean.values()]
        u, bias = fit_machine(kernel([w for w, _ in items], landmarks) @ whiten,
                              np.array([flag for _, flag in items]), np.array(times, float))
        weights = np.zeros(SYMBOLS**3)
        for share, landmark in zip(whiten @ u, landmarks):
            weights += share * _profile(landmark)
    flags, _, top = _witnesses(train, weights, bias)
    return Model(weights, bias, fit_logistic(top, flags))


def score(docs: DataFrame, model: Model, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """The given columns (all) of every row and ``score``, 0 to 1; a text without words has the score of no evidence.

    Whole texts are read, null as empty. Repeated rows are scored each.
    """
    names = columns or docs.columns
    names = [c for c in names if c != "score"]
    # The text travels once, also if it is among the columns.
    source = docs.select(*[docs[c] for c in dict.fromkeys([*names, text])])
    kept = [source.schema[c] for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        scorer = BlockScorer(model.weights, model.bias)
        for batch in batches:
            value = [scorer.worst(texts)[0] for _, texts in text_blocks(batch.column(text))]
            value = model.probability(np.concatenate(value)) if value else np.empty(0)
            yield pa.record_batch([batch.column(f.name) for f in kept] + [pa.array(value)],
                                  [f.name for f in kept] + ["score"])

    return source.mapInArrow(run, T.StructType([*kept, T.StructField("score", T.DoubleType())]))
