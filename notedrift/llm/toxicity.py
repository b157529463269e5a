"""Operator 8: toxicity by multiple-instance learning.

A document is a bag of sentences and only the bag is labelled.  A sentence's
probability is the sigmoid of the sum of its distinct words' weights; a document is
toxic if any sentence is (noisy-or), P = 1 - prod(1 - p_s).  The gradient of the
document's likelihood reaches each sentence through the noisy-or, so training
finds the offending sentences by itself.  The model is fitted on a bounded
labelled sample (one task) with steps scaled by a running mean square of each
weight's gradient; every text is scored whole, and the sentence with the
largest probability is located.

Defined results: a null text is the empty text, which has no sentence and
scores 0; without any label every weight is 0; of equal sentences the first is
located; ids may repeat or be null; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import averaged, training_rows
from .textops import text_slices
from .vocab import words

#: First value of the log odds of a sentence without evidence, which are learned too.
BIAS = -7.0
EPOCHS, RATE, KEEP, DECAY = 12, 0.3, 0.9, 1e-3
#: Words of fewer toxic sample documents than this are not learned: they would memorise single documents.
MIN_DOCS = 5
_ENDS = np.array([ord(c) for c in ".!?。！？\n"], np.uint32)


def sentences(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Words of all texts with their sentence: hashes, sentence numbers, and for each sentence its text, start and end.

    A sentence ends after a run of signs with one of ``.!?`` or at a line break.
    """
    h, plain, at, size, first = words(texts, fold=True)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    if not len(h):
        return h, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    ends = np.zeros(len(h), bool)
    # a stop stands inside [start of this word, start of the next word of the text)
    for t in np.unique(doc).tolist():
        lo, hi = first[t], first[t + 1]
        cps = np.frombuffer(texts[t].encode("utf-32-le", "surrogatepass"), "<u4")
        stops = np.concatenate(([0], np.cumsum(np.isin(cps, _ENDS))))
        begin = at[lo:hi]
        ends[lo:hi] = stops[np.append(begin[1:], len(cps))] > stops[begin]
    opens = np.ones(len(h), bool)
    opens[1:] = ends[:-1] | (doc[1:] != doc[:-1])
    number = np.cumsum(opens) - 1
    begin = np.flatnonzero(opens)
    last = np.append(begin[1:], len(h)) - 1
    keep = plain  # signs close sentences but are no words of them
    return h[keep], number[keep], doc[begin], at[begin], at[last] + size[last]


def _bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct (word, sentence) pairs: words and sentence numbers from 0."""
    out = []
    for t in texts:
        h, s, _, _, _ = sentences([t])
        if len(h):
            order = np.lexsort((h, s))
            h, s = h[order], s[order]
            new = np.append(True, (h[1:] != h[:-1]) | (s[1:] != s[:-1]))
            h, s = h[new], s[new]
        out.append((h, s))
    return out


def fit_noisy_or(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    bags = _bags(texts)
    # a word that no toxic document has says nothing that the bias does not
    toxic = [np.unique(h) for (h, _), y in zip(bags, labels) if y > 0]
    every, docs = np.unique(np.concatenate(toxic) if toxic else np.empty(0, np.uint64), return_counts=True)
    vocab = every[docs >= MIN_DOCS]
    if not len(vocab):
        return np.array([-1]), np.array([BIAS])
    rows = []
    for h, s in bags:
        at = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
        known = vocab[at] == h
        rows.append((at[known], s[known], int(s[-1]) + 1 if len(s) else 0))
    w, g2, bias = np.zeros(len(vocab)), np.zeros(len(vocab)), BIAS
    fitted = len(rows) - len(rows) // 4
    for _ in range(epochs):
        for (f, s, n), y in zip(rows[:fitted], labels):
            if not len(f):
                continue
            z = np.bincount(s, w[f], n) + bias
            p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
            none = np.exp(-np.logaddexp(0, z).sum())  # no sentence is toxic
            dz = p if y == 0 else -p * none / max(1 - none, 1e-12)
            g = np.bincount(np.searchsorted(u := np.unique(f), f), dz[s]) + DECAY * w[u]
            g2[u] += (1 - KEEP) * (g * g - g2[u])
            w[u] -= RATE * g / (np.sqrt(g2[u]) + 1e-3)
            bias -= RATE / 10 * np.clip(dz.sum(), -1, 1)
    # calibration on the quarter not fitted: the shift of the log odds with the most documents on the right side of one half
    def right(shift: float) -> int:
        odds = [np.logaddexp(0, np.bincount(s, w[f], n) + bias + shift).sum() > np.log(2) for f, s, n in rows[fitted:]]
        return int((np.array(odds) == (labels[fitted:] > 0)).sum())

    bias += max(np.arange(-3, 3.5, 0.5), key=lambda x: (right(x), -abs(x)))
    used = np.abs(w) > 1e-3
    return np.append(vocab[used].view(np.int64), -1), np.append(w[used], bias)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> dict[int, float]:
    """Weights by word hash, bounded by the words of the sample; see `labelled.training_rows` for the rows used."""
    return averaged(training_rows(docs, labels, label, id_col, text_col, shards=1, more_of=1), fit_noisy_or)


def score(model: dict[int, float], text: Column) -> Column:
    """struct<score, sentence_start, sentence_end, sentence_score>: code points, end exclusive, null without a sentence."""
    pairs = sorted((np.int64(k).view(np.uint64).item(), v) for k, v in model.items() if k != -1)
    keys = np.array([k for k, _ in pairs] or [0], np.uint64)
    values = np.array([v for _, v in pairs] or [0.0])
    bias = model.get(-1, BIAS)

    @F.arrow_udf("struct<score: double, sentence_start: int, sentence_end: int, sentence_score: double>")
    def run(column: pa.Array) -> pa.Array:
        out = []
        for _, _, texts in text_slices(column):
            h, s, doc, start, end = sentences(texts)
            z = np.full(len(doc), bias)
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            known = keys[at] == h
            if known.any():
                both = np.unique(np.stack([s[known].astype(np.uint64), at[known].astype(np.uint64)], axis=1), axis=0)
                z += np.bincount(both[:, 0].astype(np.int64), values[both[:, 1].astype(np.int64)], len(doc))
            p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
            total = -np.expm1(-np.bincount(doc, np.logaddexp(0, z), len(texts)))
            first = np.searchsorted(doc, np.arange(len(texts) + 1))
            for i in range(len(texts)):
                lo, hi = first[i], first[i + 1]
                if lo == hi:
                    out.append({"score": 0.0, "sentence_start": None, "sentence_end": None, "sentence_score": None})
                else:
                    k = lo + int(np.argmax(p[lo:hi]))
                    out.append({"score": float(total[i]), "sentence_start": int(start[k]), "sentence_end": int(end[k]), "sentence_score": float(p[k])})
        return pa.array(out, pa.struct([("score", pa.float64()), ("sentence_start", pa.int32()), ("sentence_end", pa.int32()), ("sentence_score", pa.float64())]))

    return run(text)
