"""Operator 5: SimHash near duplicates with pivot distance tables.

A fingerprint bit is set if it is set in over half of the XXH64 hashes (seed
42) of a text's word shingles.  Fingerprints are collapsed to distinct ones
first, so exact copies cost one row.  Distances to ``PIVOTS`` reference
fingerprints are written next to each distinct fingerprint: by the triangle
inequality a pair whose distances to any one reference differ by more than the
limit cannot link.  Pairs come from buckets of fingerprints that agree on all
but ``max_bits`` of a few bit blocks (a pair within the limit must agree on so
many); in the bucket join a pair is discarded by the largest coordinate
difference, survivors are verified by the exact distance.  Buckets of more than
``bucket_limit`` fingerprints are not joined: their members are dealt again over
more and smaller blocks, which is exact too, up to the last level.

Defined results: a null text is the empty text, whose fingerprint is zero and
links like any other; rows may repeat and ids may be null (such a row is never
a component's id unless the component has no other); an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .components import components
from .skew import join_even
from .textops import text_slices

PIVOTS = 16
BUCKET_LIMIT = 1_000
SEED = 42
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str, shingle: int) -> int:
    """Unsigned 64-bit fingerprint of a whole text."""
    words = text.encode("utf-8").translate(_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for lo in range(0, n, 65_536):
        h = np.array([digest(join(words[i:i + shingle]), SEED) for i in range(lo, min(n, lo + 65_536))], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, shingle) for _, _, texts in text_slices(batch.column("text")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("mark"), pa.array(np.array(found, dtype="<u8").view(np.int64))],
                                             names=["key", "mark", "fp"])
    return run


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, mark, fp): the id, a hash of the text and the fingerprint as a signed 64-bit integer, one row a document."""
    own = docs.select(F.col(id_col).alias("key"), F.xxhash64(text_col).alias("mark"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return own.mapInArrow(_fingerprints(shingle), f"key {dict(own.dtypes)['key']}, mark long, fp long")


def _masks(max_bits: int, extra: int) -> list[int]:
    """Masks over ``max_bits + extra`` blocks, each keeping ``extra`` of them: a pair within the limit agrees under one."""
    blocks = max_bits + extra
    edges = [64 * i // blocks for i in range(blocks + 1)]
    part = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    masks = [sum(part[i] for i in keep) for keep in combinations(range(blocks), extra)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def pivots(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints: fixed pseudo-random 64-bit values."""
    return [xxhash.xxh64_intdigest(f"pivot {i}".encode(), SEED) - (1 << 63) for i in range(n)]


def links(distinct: DataFrame, max_bits: int = 3, n_pivots: int = PIVOTS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Distinct pairs (a, b), a < b, of fingerprints ``fp`` that differ in at most ``max_bits`` bits."""
    table = distinct.select("fp", *(F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("byte").alias(f"d{i}") for i, p in enumerate(pivots(n_pivots))))
    coordinates = [f"d{i}" for i in range(n_pivots)]
    members, found, levels = table, [], (2, 3, 4, 5)
    for extra in levels:
        keyed = members.select("fp", *coordinates, F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in _masks(max_bits, extra)))).alias("block", "part"))
        sizes = keyed.groupBy("block", "part").agg(F.count("*").alias("size")).where("size > 1")
        sizes = materialize(sizes, "op5-buckets")
        last = extra == levels[-1]
        own = keyed.join(sizes if last else sizes.where(F.col("size") <= bucket_limit), ["block", "part"]).drop("size")
        far: Column = F.greatest(*(F.abs(F.col(f"x.{c}") - F.col(f"y.{c}")) for c in coordinates)) if n_pivots > 1 else F.abs(F.col("x.d0") - F.col("y.d0"))
        pairs = (own.alias("x").join(own.alias("y"), [F.col("x.block") == F.col("y.block"), F.col("x.part") == F.col("y.part"), F.col("x.fp") < F.col("y.fp"),
                                                      far <= max_bits, F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= max_bits])
                 .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")))
        found.append(pairs.distinct())
        hot = sizes.where(F.col("size") > bucket_limit)
        if last or hot.isEmpty():
            break
        again = keyed.join(hot.select("block", "part"), ["block", "part"], "left_semi").select("fp", *coordinates).distinct()
        members = materialize(again, "op5-members")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct() if len(found) > 1 else out


def groups(docs: DataFrame, shingle: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, mark, fp, component, keeper): one row a document.

    ``component`` is the smallest id of the group of linked documents; ``keeper``
    marks the rows with the group's least (id, hash of the text).
    """
    prints = materialize(fingerprints(docs, shingle, id_col, text_col), "op5-fingerprints")
    least = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "mark")).alias("least")
    distinct = materialize(prints.groupBy("fp").agg(F.count("*").alias("n"), least), "op5-distinct")
    reached = components(links(distinct, max_bits), "a", "b", "op5")
    linked = distinct.join(reached.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    of_group = linked.groupBy("component").agg(F.min("least").alias("least"))
    named = materialize(linked.select("fp", "n", "component").join(of_group, "component")
                        .select("fp", "n", F.col("least.key").alias("component"), F.col("least.mark").alias("keeper_mark")), "op5-groups")
    total = prints.count()
    return (join_even(prints, named, "fp", "n", total)
            .select("key", "mark", "fp", "component", (F.col("key").eqNullSafe(F.col("component")) & (F.col("mark") == F.col("keeper_mark"))).alias("keeper")))


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint, component_id): fingerprint as 16 lower-case hex digits."""
    found = groups(docs, shingle, max_bits, id_col, text_col)
    return found.select(F.col("key").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame, shingle: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, one of each group: the row with the least id (then least text hash); of equal rows any one."""
    found = materialize(groups(docs, shingle, max_bits, id_col, text_col).where("keeper").groupBy("key", "mark").agg(F.count("*").alias("copies")), "op5-keepers")
    names = docs.columns
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), F.col(id_col).alias("key"), F.xxhash64(text_col).alias("mark"))
    kept = own.alias("o").join(found.alias("f"), [F.col("o.key").eqNullSafe(F.col("f.key")), F.col("o.mark") == F.col("f.mark")]).select("o.key", "o.mark", "o.doc", "f.copies")
    once = kept.where("copies = 1").select("doc")
    # only rows that repeat in id and text are grouped, by both
    again = kept.where("copies > 1").groupBy("key", "mark").agg(F.min("doc").alias("doc")).select("doc")
    return once.unionByName(again).select("doc.*")
