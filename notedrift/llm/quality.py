"""Operator 9: quality classifier, hashed word n-grams and follow-the-regularised-leader.

A document is the sparse vector of its hashed words, word pairs and a mark for
a word that repeats itself at once, with logarithmic counts and unit length.
Logistic regression is trained on a bounded labelled sample by FTRL-proximal
updates, one pass after the other over each shard, and averaged over the shards.
The score of a whole text is the sigmoid of a sparse dot product.

Defined results: a null text is the empty text, which scores by the bias alone;
without any label every score is 0.5; ids may repeat or be null; an empty
table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import averaged, training_rows
from .textops import mix64, text_slices
from .vocab import words

BITS = 20
EPOCHS = 8
ALPHA, BETA, L1, L2 = 4.0, 1.0, 0.01, 0.0
#: Feature of a word that follows itself.
_REPEAT = np.uint64(0x5EED)


def features(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of all texts: text number, bucket, value; unit length a text."""
    h, _, _, _, first = words(texts, fold=False)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    same = doc[1:] == doc[:-1]
    pair = mix64(h[1:] * np.uint64(3) + h[:-1])
    pair = np.where(h[1:] == h[:-1], _REPEAT, pair)[same]
    docs = np.concatenate([doc, doc[1:][same]]).astype(np.uint64)
    bucket = np.concatenate([h, pair]) >> np.uint64(64 - bits)
    key, count = np.unique((docs << np.uint64(bits)) | bucket, return_counts=True)
    d = (key >> np.uint64(bits)).astype(np.int64)
    value = 1.0 + np.log(count)
    norm = np.sqrt(np.bincount(d, value * value, len(texts)))
    return d, (key & np.uint64((1 << bits) - 1)).astype(np.int64), value / norm[d]


def fit_ftrl(texts: list[str], labels: np.ndarray, bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over the rows in order; bucket -1 is the bias (not regularised)."""
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)  # the last place is the bias
    rows = []
    for lo in range(0, len(texts), 200):
        d, b, v = features(texts[lo:lo + 200], bits)
        at = np.searchsorted(d, np.arange(len(texts[lo:lo + 200]) + 1))
        rows += [(np.append(b[i:j], size).astype(np.int32), np.append(v[i:j], 1.0).astype(np.float32)) for i, j in zip(at, at[1:])]

    def weights(z: np.ndarray, n: np.ndarray, bias: np.ndarray) -> np.ndarray:
        l1 = np.where(bias, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    # both classes count alike, as good documents far outnumber bad ones
    high = float(labels.sum())
    weight = {1.0: len(labels) / (2 * high), 0.0: len(labels) / (2 * (len(labels) - high))} if 0 < high < len(labels) else {0.0: 1.0, 1.0: 1.0}
    for _ in range(epochs):
        for (b, v), y in zip(rows, labels):
            w = weights(z[b], n[b], b == size)
            p = 1 / (1 + np.exp(-np.clip(w @ v, -35, 35)))
            g = weight[y] * (p - y) * v
            z[b] += g - (np.sqrt(n[b] + g * g) - np.sqrt(n[b])) / ALPHA * w
            n[b] += g * g
    w = weights(z, n, np.arange(size + 1) == size)
    used = np.flatnonzero(w[:size])
    return np.append(used, -1), np.append(w[used], w[size])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> dict[int, float]:
    """Weights by bucket (at most 2**BITS); see `labelled.training_rows` for the rows used."""
    return averaged(training_rows(docs, labels, label, id_col, text_col), fit_ftrl)


def score(model: dict[int, float], text: Column, bits: int = BITS) -> Column:
    """Score of whole texts, 0 to 1."""
    keys = np.array(sorted(k for k in model if k >= 0), np.int64)
    values = np.array([model[k] for k in keys.tolist()], np.float32)
    bias = float(model.get(-1, 0.0))

    @F.arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        weight = np.zeros(1 << bits, np.float32)
        weight[keys] = values
        out = []
        for _, _, texts in text_slices(column):
            d, b, v = features(texts, bits)
            dot = np.bincount(d, weight[b] * v, len(texts)) + bias
            out.append(1 / (1 + np.exp(-np.clip(dot, -35, 35))))
        return pa.array(np.concatenate(out) if out else np.empty(0), pa.float64())

    return run(text)
