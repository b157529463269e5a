"""Operator 1: byte-level BPE encoding by overlapping chunks, and decoding.

Texts of at most ``chunk_chars`` characters are encoded where they are read,
without a shuffle.  Longer texts are cut into overlapping chunks which are
pre-tokenised in parallel.  A chunk that does not start at a true pre-token
boundary falls into step with its predecessor after a few characters: two
segmentations of the same text that share a boundary agree from there on.  The
first boundary that two neighbours share in their overlap is therefore where
the texts are stitched, and the pieces between stitches are encoded
independently.  Matches near the end of a chunk may change with the text that
follows, so boundaries within ``GUARD`` characters of it are not used,
nor are those after white space, where the pattern looks ahead.  A text with
neighbours that share no such boundary (a single run longer than the overlap)
is put together again and encoded as one piece: exact for every text.

Defined results: a null text is the empty text, an empty text has no ids; ids
of documents and rows may repeat or be null (rows stay separate rows); an empty
table gives an empty table; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .textops import code_points, slices, text_slices
from .vocab import SPACE, class_table, pretoken_starts, vocabulary

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 1_024
#: Longer than any look-ahead of the pattern.
GUARD = 8


def _encoder(path: str, pattern: str, keys: list[str], text: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, pattern)
        for batch in batches:
            for lo, hi, texts in text_slices(batch.column(text)):
                ids, bounds = vocab.encode(texts)
                columns = [batch.column(k).slice(lo, hi - lo) for k in keys]
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*columns, lists], names=[*keys, "ids"])
    return run


def _boundaries(texts: list[str], firsts: list[int], overlap: int, chunk: int, total: int) -> tuple[list, list]:
    """Trusted boundaries of each chunk in its first and its last overlap, as places in the whole text of ``total`` characters."""
    heads, tails = [], []
    for t, first in zip(texts, firsts):
        cps = code_points(t)
        starts = pretoken_starts(cps)
        stop = len(cps) if first + len(cps) == total else len(cps) - GUARD
        if 0 < stop < len(cps) and class_table()[cps[stop]] == SPACE:
            # white space at the guard may belong to a run that goes on past the end
            run = np.flatnonzero(class_table()[cps[:stop]] != SPACE)
            stop = int(run[-1]) + 1 if len(run) else 0
        starts = starts[starts <= stop] if stop > 0 else starts[:0]
        heads.append((starts[starts < overlap] + first).tolist())
        tail = starts[starts >= chunk]
        # a piece must not end in white space: its matches look at the sign that follows
        tails.append((tail[class_table()[cps[tail - 1]] != SPACE] + first).tolist())
    return heads, tails


def _chunks(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("row").to_pylist(), (t for _, _, part in text_slices(batch.column("text")) for t in part))
            for r, t in rows:
                at = range(0, len(t), chunk)
                for lo in range(0, len(at), 64):
                    part = at[lo:lo + 64]
                    cut = [t[s:s + chunk + overlap] for s in part]
                    heads, tails = _boundaries(cut, list(part), overlap, chunk, len(t))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r] * len(cut), pa.int64()), pa.array([s // chunk for s in part], pa.int32()), pa.array([len(at)] * len(cut), pa.int32()),
                         pa.array(cut, pa.string()), pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))],
                        names=["row", "k", "n", "text", "head", "tail"])
    return run


def stitched(rows: DataFrame, chunk_chars: int, overlap_chars: int) -> DataFrame:
    """Pieces (row, k, text) of long texts (row, text), cut only at pre-token boundaries.

    A row whose chunks fall into step gives one piece a chunk; any other row
    gives its whole text as one piece.
    """
    cut = rows.select("row", "text").repartition("row").mapInArrow(
        _chunks(chunk_chars, overlap_chars), "row long, k int, n int, text string, head array<long>, tail array<long>")
    cut = materialize(cut, "op1-chunks")
    order = Window.partitionBy("row").orderBy("k")
    # narrow rows only; a row of this window is a chunk of one text
    joint = (cut.select("row", "k", "n", "head", "tail")
             .withColumn("stop", F.array_min(F.array_intersect("tail", F.lead("head").over(order))))
             .withColumn("start", F.coalesce(F.lag("stop").over(order), F.lit(0)))
             .withColumn("broken", F.max(F.col("stop").isNull() & (F.col("k") < F.col("n") - 1)).over(Window.partitionBy("row")))
             .select("row", "k", "start", "stop", "broken"))
    pieces = cut.select("row", "k", "text").join(joint, ["row", "k"])
    begin = F.col("k").cast("long") * chunk_chars  # place of the chunk in the whole text
    good = (pieces.where(~F.col("broken"))
            .withColumn("from", F.col("start") - begin)
            .select("row", "k", F.expr("substring(text, cast(`from` + 1 as int), "
                                       f"cast(coalesce(stop - cast(k as bigint) * {chunk_chars}, char_length(text)) - `from` as int))").alias("text")))
    whole = (pieces.where("broken")
             .groupBy("row").agg(F.sort_array(F.collect_list(F.struct("k", F.expr(f"substring(text, 1, {chunk_chars})").alias("text")))).alias("parts"))
             .select("row", F.lit(0).alias("k"), F.array_join("parts.text", "").alias("text")))
    return good.unionByName(whole)


def encode(docs: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """(id_col, ids array<int>): the ids of every whole text, one row a document row."""
    if overlap_chars > chunk_chars or overlap_chars <= 2 * GUARD:
        raise ValueError("overlap_chars has to be over 16 and at most chunk_chars")
    own = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = dict(own.dtypes)["key"]
    long = F.char_length("text") > chunk_chars
    short = own.where(~long).mapInArrow(_encoder(vocab_path, pattern, ["key"], "text"), f"key {kind}, ids array<int>")
    rows = materialize(own.where(long).withColumn("row", F.monotonically_increasing_id()), "op1-long")
    pieces = (stitched(rows, chunk_chars, overlap_chars)
              .mapInArrow(_encoder(vocab_path, pattern, ["row", "k"], "text"), "row long, k int, ids array<int>"))
    joined = (pieces.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("parts"))
              .select("row", F.flatten("parts.ids").alias("ids")))
    long_ids = rows.select("row", "key").join(joined, "row").select("key", "ids")
    return short.unionByName(long_ids).withColumnRenamed("key", id_col)


def _decoder(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, pattern)
        for batch in batches:
            keys, column = batch.column("key"), batch.column("ids")
            bounds = column.offsets.to_numpy()
            ids = column.values.to_numpy().view("<u4")
            for lo, hi in slices(np.diff(bounds), 250_000):
                own = [ids[a:b] for a, b in zip(bounds[lo:hi], bounds[lo + 1:hi + 1])]
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(lo, hi - lo), pa.array([len(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary()),
                     pa.array([vocab.decode(x) for x in own], pa.binary())], names=["key", "n_tokens", "ids_le", "decoded"])
    return run


def decode(encoded: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, n_tokens, ids_le, decoded): raw bytes of the ids one after the other.

    ``ids_le`` holds the ids as little-endian unsigned 32-bit integers.  A null
    list of ids is an empty one; an id outside the vocabulary is an IndexError.
    """
    own = encoded.select(F.col(id_col).alias("key"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))
    kind = dict(own.dtypes)["key"]
    return (own.mapInArrow(_decoder(vocab_path, pattern), f"key {kind}, n_tokens long, ids_le binary, decoded binary")
            .withColumnRenamed("key", id_col))
