"""Bounded labelled samples, and models averaged over shards of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a model is fitted on at most (a documented bound; scoring covers every row).
SAMPLE_ROWS = 8_000
SHARDS = 4


def held_out(key) -> "F.Column":
    """True for ids whose crc32 (as text) is divisible by 5; a null id is held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text",
                  rows: int = SAMPLE_ROWS, shards: int = SHARDS, more_of: int | None = None) -> DataFrame:
    """(shard, text, label) of at most ``rows`` labelled documents that are not held out, the least by a hash of their id.

    ``more_of``: a label that may be rare; the least quarter of ``rows`` of its documents is in the sample as well.

    An id with contradicting labels is left out; of documents that share an id
    one counts.  Only (id, label) pairs of the sample, at most ``rows``, are broadcast.
    """
    known = (labels.where(~held_out(id_col) & F.col(label).isin(0, 1)).groupBy(F.col(id_col).alias("key"))
             .agg(F.min(label).alias("label"), F.max(label).alias("high")).where("label = high").select("key", "label"))
    sample = known.orderBy(F.xxhash64("key"), "key").limit(rows)
    if more_of is not None:
        sample = sample.union(known.where(F.col("label") == more_of).orderBy(F.xxhash64("key"), "key").limit(rows // 4)).distinct()
    own = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return (own.join(F.broadcast(sample), "key").groupBy("key").agg(F.min(F.struct("text", "label")).alias("r"))
            .select(F.pmod(F.xxhash64(F.lit(7), "key"), F.lit(shards)).alias("shard"), "r.text", "r.label"))


def averaged(rows: DataFrame, fit, shards: int = SHARDS) -> dict[int, float]:
    """Weights by feature: ``fit(texts, labels) -> (features, weights)`` for each shard, averaged by the shards' rows.

    Feature -1 is the bias.  A shard is at most the whole bounded sample.  The
    weights are bounded by the sample's features.
    """
    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["text", "label"], kind="stable")  # the same model whatever the order of arrival
        order = np.random.default_rng(11).permutation(len(frame))
        features, weights = fit([frame["text"].iloc[i] for i in order], frame["label"].to_numpy()[order].astype(float))
        return pd.DataFrame({"feature": features.astype(np.int64), "weight": weights * len(frame), "n": np.where(features == -1, len(frame), 0)})

    parts = rows.groupBy("shard").applyInPandas(one, "feature long, weight double, n long")
    got = parts.groupBy("feature").agg(F.sum("weight").alias("w"), F.sum("n").alias("n")).collect()
    total = sum(r["n"] for r in got) or 1
    return {r["feature"]: r["w"] / total for r in got}
