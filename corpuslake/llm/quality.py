"""Quality classifier: supervised subword embeddings.

A document's features are its words, their character n-grams and its pairs of neighbouring words,
hashed into buckets. Each bucket has a learned vector; a document's vectors are averaged and a
softmax over the classes follows. Vectors and softmax are trained by stochastic gradient descent in
numpy, on the driver, over at most ``per_class`` labelled documents a class.

A pair is hashed by the difference of its words' hashes, so a word that repeats itself falls into
one bucket whatever the word.

Scoring needs only each bucket's share of the log odds (vector times softmax weights), so a worker
keeps one number per distinct word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordTable, held, mixed
from .labelled import accepted, fold, scored, training_rows

BUCKETS, PAIRS, DIM = 1 << 17, 1 << 15, 16
SIZES = (2, 3, 4)
#: Characters from which a word's n-grams are found with arrays, and characters that are looked at together.
LONG, SLICE = 60, 1 << 18
_CRC = np.array([zlib.crc32(bytes([i]), 0xFFFFFFFF) ^ 0xFFFFFFFF for i in range(256)], np.uint32)


def _stepped(crc: np.ndarray, points: np.ndarray) -> np.ndarray:
    """States of crc32 after the UTF-8 bytes of one code point each."""
    size = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
    mark = np.array([0, 0, 0xC0, 0xE0, 0xF0], np.uint32)[size]
    for behind in reversed(range(int(size.max(initial=1)))):
        bits = points >> np.uint32(6 * behind)
        byte = np.where(size == behind + 1, bits | mark, bits & np.uint32(63) | np.uint32(128))
        crc = np.where(size > behind, _CRC[(crc ^ byte) & np.uint32(255)] ^ crc >> np.uint32(8), crc)
    return crc


def gram_buckets(marked: str, n: int) -> np.ndarray:
    """Buckets of the distinct n-grams of a long word, as ``zlib.crc32`` of their UTF-8 bytes gives them.

    N-grams are told apart by 64 bits: the bucket and 47 bits of another hash.
    """
    found = np.zeros(0, np.uint64)
    for at in range(0, len(marked) - n + 1, SLICE):
        points = np.frombuffer(marked[at : at + SLICE + n - 1].encode("utf-32-le"), np.uint32)
        count = len(points) - n + 1
        crc, code = np.full(count, 0xFFFFFFFE, np.uint32), np.zeros(count, np.uint64)  # crc32 that starts from 1
        for k in range(n):
            crc = _stepped(crc, points[k : k + count])
            code = mixed(code + points[k : k + count] + np.uint64(1))
        bucket = (crc ^ np.uint32(0xFFFFFFFF)) % np.uint32(BUCKETS)
        found = np.union1d(found, code // np.uint64(BUCKETS) * np.uint64(BUCKETS) + bucket)
    return (found % np.uint64(BUCKETS)).astype(np.int64)


def word_buckets(word: str) -> list[int] | np.ndarray:
    """Buckets of a word and of its distinct character n-grams (with marks at its borders), whatever its length or letters."""
    marked = f"<{word}>"
    raw = marked.encode()
    whole = zlib.crc32(raw) % BUCKETS
    if len(word) > LONG:
        return np.concatenate([[whole], *(gram_buckets(marked, n) for n in SIZES)])
    if len(raw) == len(marked):  # characters are bytes
        grams = {raw[i : i + n] for n in SIZES for i in range(len(raw) - n + 1)}
    else:
        grams = [g.encode() for g in {marked[i : i + n] for n in SIZES for i in range(len(marked) - n + 1)}]
    return [whole, *(zlib.crc32(g, 1) % BUCKETS for g in grams)]


def pair_buckets(hashes: np.ndarray) -> np.ndarray:
    return BUCKETS + (mixed(hashes[1:] - hashes[:-1]) >> np.uint64(64 - 15)).astype(np.int64)


def word_hashes(words: list[str]) -> np.ndarray:
    return mixed(np.array([zlib.crc32(w.encode()) << 32 | zlib.crc32(w.encode(), 7) for w in words], np.uint64))


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares of the average."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    kinds, which, counts = np.unique(np.array(words, object), return_inverse=True, return_counts=True)
    own = [word_buckets(w) for w in kinds]
    buckets = np.concatenate([np.concatenate(own), pair_buckets(word_hashes(kinds.tolist())[which])])
    weights = np.concatenate([np.repeat(counts, [len(o) for o in own]), np.ones(len(words) - 1)])
    found, where = np.unique(buckets, return_inverse=True)
    share = np.bincount(where, weights)
    return found, share / share.sum()


def train(texts: list[str], y: np.ndarray, epochs: int = 8, rate: float = 1.0, seed: int = 0) -> tuple[np.ndarray, float]:
    """Each bucket's share of the log odds, and the bias, after training on balanced classes."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS + PAIRS, DIM)).astype(np.float32)
    soft, bias = np.zeros((DIM, 2)), np.zeros(2)
    docs = [features(t) for t in texts]
    weight = np.array([len(y) / (2 * max(1, (y == c).sum())) for c in (0, 1)])
    steps = max(1, epochs * len(docs))
    for k in range(epochs):
        for j, i in enumerate(rng.permutation(len(docs))):
            at, share = docs[i]
            step = rate * (1 - (k * len(docs) + j) / steps) * min(3.0, weight[y[i]])
            mean = share @ vectors[at] if len(at) else np.zeros(DIM)
            z = mean @ soft + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            grad = soft @ p
            soft -= step * np.outer(mean, p)
            bias -= step * 0.1 * p
            if len(at):
                # Rare buckets of a long document get steps as those of a short one.
                vectors[at] -= (step * share * len(at) ** 0.5)[:, None].astype(np.float32) * grad.astype(np.float32)
    return vectors @ (soft[:, 1] - soft[:, 0]), float(bias[1] - bias[0])


def log_odds(model: tuple[np.ndarray, float], texts: Iterable[str], cache: int = 400_000) -> Iterator[float]:
    shares, bias = model

    def describe(words: list[str]):
        own = [word_buckets(w) for w in words]
        sizes = np.array([len(o) for o in own])
        sums = np.add.reduceat(shares[np.concatenate(own)], np.concatenate([[0], np.cumsum(sizes)[:-1]]))
        return sums.astype(np.float64), sizes, word_hashes(words)

    table = held("quality", id(shares), lambda: WordTable(describe, cache))
    for text in texts:
        words = text.split()
        if not words:
            yield bias
            continue
        at = table.numbers(words)
        sums, sizes, hashes = table.columns
        pairs = shares[pair_buckets(hashes[at])]
        yield (sums[at].sum() + pairs.sum()) / (sizes[at].sum() + len(pairs)) + bias


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", held_out: tuple[int, int] = (5, 0), threshold: float = 0.3, per_class: int = 1000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``held_out``, ``score`` (likelihood of label 1), ``predicted``.

    Rows whose crc32(id) modulo ``held_out[0]`` is ``held_out[1]`` are never trained on. At most
    ``per_class`` labelled documents a class are. Null and empty texts score by the bias alone; without
    labels every text does. Null ids are never held out. Very long texts are read whole, repeated rows are
    scored each, an empty table gives an empty table. Only the two columns of ``docs`` are read, so
    others may have any names.
    """
    parts, odd = held_out
    texts, y, odds = training_rows(docs, labels, label, lambda c: fold(c, parts) != odd, per_class, id_col, text_col)
    shares, bias = train(texts, y)
    found = scored(docs, (shares, bias + odds), log_odds, threshold, id_col, text_col)
    return found.select(id_col, F.coalesce(fold(id_col, parts) == odd, F.lit(False)).alias("held_out"), "score", "predicted")


def quality_filter(docs: DataFrame, labels: DataFrame, label: str = "quality", held_out: tuple[int, int] = (5, 0), threshold: float = 0.3, per_class: int = 1000, id_col: str = "doc_id", text_col: str = "text", cache: int = 400_000) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``quality_scores`` predicts as 1; a worker keeps ``cache`` words.

    Each row is judged by its own text, read whole: repeated rows stay or go together, null and empty texts
    by the bias alone. An empty table gives an empty table; other columns pass through, whatever their names.
    """
    parts, odd = held_out
    texts, y, odds = training_rows(docs, labels, label, lambda c: fold(c, parts) != odd, per_class, id_col, text_col)
    shares, bias = train(texts, y)
    return accepted(docs, (shares, bias + odds), partial(log_odds, cache=cache), threshold, text_col)
