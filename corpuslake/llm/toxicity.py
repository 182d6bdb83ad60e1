"""Toxicity: a factorization machine over hashed terms.

Terms are lower-case words and their prefixes, hashed into buckets. The machine's inputs are buckets whose
presence depends on the label (chi-squared test over the training sample), and both buckets of every pair
whose joint presence explains what a machine of the former leaves over, though each may say nothing
by itself, if they prove themselves on documents that were held back. The log odds are a bias, a weight per term present, and for each pair of terms present the
product of their learned vectors, so that two terms together can count for more, or less, than each alone.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordTable, held
from .labelled import fold, scored, training_rows

BUCKETS, RANK, PREFIXES = 1 << 20, 6, (4, 5, 6)
WORD = re.compile(r"\w+")
SLOTS = 1 + len(PREFIXES)
#: Buckets of a block in the search for pairs.
PART = 1_024


def term_buckets(word: str) -> list[int]:
    """Buckets of a word and of its prefixes; a prefix must be shorter than the word."""
    return [zlib.crc32(word.encode()) % BUCKETS, *(zlib.crc32(word[:n].encode(), n) % BUCKETS for n in PREFIXES if len(word) > n)]


def document_buckets(text: str) -> set[int]:
    return {b for w in set(WORD.findall(text.lower())) for b in term_buckets(w)}


def columns(docs: list[set[int]], buckets: list[int]) -> np.ndarray:
    """Presence of some buckets in each document, less its mean."""
    place = {b: k for k, b in enumerate(buckets)}
    found = np.zeros((len(docs), len(buckets)), np.float32)
    for row, d in enumerate(docs):
        found[row, [place[b] for b in d if b in place] if len(d) < len(place) else [k for b, k in place.items() if b in d]] = 1
    return found - found.mean(axis=0)


def paired(docs: list[set[int]], rest: np.ndarray, buckets: list[int], gain: float) -> set[int]:
    """Buckets of the pairs whose product goes with ``rest`` by a squared deviation of ``gain`` or more, block by block."""
    parts, out = [buckets[at : at + PART] for at in range(0, len(buckets), PART)], set()
    for k, a in enumerate(parts):
        left = columns(docs, a) * rest[:, None].astype(np.float32)
        for b in parts[k:]:
            right = columns(docs, b)
            both = (left.T @ right) ** 2 >= gain * np.maximum((left**2).T @ right**2, 1e-6)
            out |= {a[i] for i in np.flatnonzero(both.any(axis=1))} | {b[j] for j in np.flatnonzero(both.any(axis=0))}
    return out


def evened(y: np.ndarray) -> np.ndarray:
    """Weights of documents by which both classes count alike."""
    return np.where(y == 1, (y >= 0).sum() / (2 * max(1, (y == 1).sum())), (y >= 0).sum() / (2 * max(1, (y == 0).sum())))


def likelihood(odds):
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def fit(docs: list[set[int]], y: np.ndarray, chosen: list[int], epochs: int, rate: float, decay: float, seed: int) -> tuple:
    """(input number of each bucket or -1, weights, vectors, bias, and each document's log odds) after AdaGrad on balanced classes; documents of label -1 are only scored."""
    number = np.full(BUCKETS, -1, np.int32)
    number[chosen] = np.arange(len(chosen))
    rng = np.random.default_rng(seed)
    w, v, bias = np.zeros(len(chosen)), rng.normal(0, 0.01, (len(chosen), RANK)), 0.0
    gw, gv, gb = np.full(len(chosen), 1e-2), np.full(v.shape, 1e-2), 1e-2
    rows = [np.array(sorted(x for x in (number[b] for b in d) if x >= 0), np.int64) for d in docs]
    scale = np.minimum(5.0, evened(y))

    def odds(at: np.ndarray, own: np.ndarray, total: np.ndarray) -> float:
        return bias + w[at].sum() + 0.5 * float((total**2).sum() - (own**2).sum())

    for _ in range(epochs):
        for i in rng.permutation(np.flatnonzero(y >= 0)):
            at = rows[i]
            own = v[at]
            total = own.sum(axis=0)
            g = (likelihood(odds(at, own, total)) - y[i]) * scale[i]
            gb += g * g
            bias -= rate * g / gb**0.5
            if len(at):
                dw, dv = g + decay * w[at], g * (total - own) + decay * own
                gw[at] += dw**2
                gv[at] += dv**2
                w[at] -= rate * dw / gw[at] ** 0.5
                v[at] -= rate * dv / gv[at] ** 0.5
    return number, w, v, bias, np.array([odds(at, v[at], v[at].sum(axis=0)) for at in rows])


def train(texts: list[str], y: np.ndarray, least: int = 3, chi: float = 15.0, share: float = 0.02, gain: float = 45.0, epochs: int = 30, rate: float = 0.1, decay: float = 1e-5, seed: int = 0) -> tuple:
    """(input number of each bucket or -1, weights, vectors, bias).

    Single buckets need ``least`` documents and a chi-squared of ``chi``. Pairs are sought among all buckets of
    a ``share`` of the documents or more, by ``gain``: chance alone gives one in 50 billion so much. What they
    add is used if a machine fitted on half of the documents then tells the other half apart better.
    """
    docs = [document_buckets(t) for t in texts]
    n = np.array([(y == 0).sum(), (y == 1).sum()])
    seen = [Counter(), Counter()]
    for d, label in zip(docs, y):
        seen[label].update(d)
    chosen, frequent = [], []
    for bucket in sorted(set(seen[0]) | set(seen[1])):
        a, b = seen[1][bucket], seen[0][bucket]
        c, d = n[1] - a, n[0] - b
        if a + b >= least and (a * d - b * c) ** 2 * (a + b + c + d) / max(1.0, float(a + b) * (c + d) * n[0] * n[1]) >= chi:
            chosen.append(bucket)
        if a + b >= max(least, share * len(docs)):
            frequent.append(bucket)
    how = epochs, rate, decay, seed
    *model, odds = fit(docs, y, chosen, *how)
    added = paired(docs, evened(y) * (y - likelihood(odds)), frequent, gain)
    more = sorted(added.union(chosen))
    if len(more) == len(chosen):
        return tuple(model)
    back = np.random.default_rng(seed).permutation(len(y)) % 2 == 0
    half, loss = np.where(back, -1, y), []
    for inputs in (chosen, more):
        *_, odds = fit(docs, half, inputs, *how)
        right = np.where(y == 1, odds, -odds)[back]
        loss.append((evened(y)[back] * np.logaddexp(0, -right)).sum())
    return tuple(fit(docs, y, more, *how)[:4]) if loss[1] < loss[0] else tuple(model)


def log_odds(model: tuple, texts: Iterable[str]) -> Iterator[float]:
    number, w, v, bias = model

    def describe(words: list[str]):
        inputs = np.full((len(words), SLOTS), -1, np.int32)
        for row, word in enumerate(words):
            buckets = term_buckets(word)
            inputs[row, : len(buckets)] = number[buckets]
        return (inputs,)

    table = held("toxicity", id(number), lambda: WordTable(describe))
    for text in texts:
        at = table.numbers(WORD.findall(text.lower()))
        if not len(at):
            yield bias
            continue
        found = table.columns[0][at]
        own = v[found := np.unique(found[found >= 0])]
        yield bias + w[found].sum() + 0.5 * float((own.sum(axis=0) ** 2).sum() - (own**2).sum())


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", held_out: tuple[int, int] = (3, 1), threshold: float = 0.7, per_class: int = 2500, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``held_out``, ``score`` (likelihood of label 1, were both classes
    equally frequent), ``predicted``.

    Rows whose crc32(id) modulo ``held_out[0]`` is ``held_out[1]`` are never trained on. At most
    ``per_class`` labelled documents a class are. Null and empty texts score by the bias alone; without
    labels every text does. Null ids are never held out. Very long texts are read whole, repeated rows are
    scored each, an empty table gives an empty table. Only the two columns of ``docs`` are read, so
    others may have any names.
    """
    parts, odd = held_out
    texts, y, _ = training_rows(docs, labels, label, lambda c: fold(c, parts) != odd, per_class, id_col, text_col)
    number, w, v, bias = train(texts, y)
    found = scored(docs, (number, w, v, bias), log_odds, threshold, id_col, text_col)
    return found.select(id_col, F.coalesce(fold(id_col, parts) == odd, F.lit(False)).alias("held_out"), "score", "predicted")
