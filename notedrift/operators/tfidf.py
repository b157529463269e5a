"""TF-IDF in long form and filing-to-filing cosine distance.

Long form ``(id, term, weight)`` scales with the corpus: no vocabulary is
collected to the driver and no dense vector is built.  Weights follow the
common vectoriser defaults: raw term count times ``ln((1+n)/(1+df)) + 1``,
L2-normalised per document; terms in more than ``max_df`` documents or fewer
than ``min_df`` are dropped first (an int is a count, a float a share of n).

A document stays one row: its distinct terms and their counts are arrays inside the
row, so neither words nor weights are shuffled by document.  Document frequencies
are pre-aggregated (map-side partial counts).  The idf of the most frequent terms
(bounded) is a table every task holds; if it holds all terms of two documents or more,
the others have one idf, else their entries are shuffled by term, and come back to their documents.

Distances need no term names: ``document_vectors`` keeps a document as one row
with a sorted array of (term hash, weight), so a pair of documents is a join of
two rows and a merge of two arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import TOKEN_PATTERN, token_characters, tokenize, word_codes

#: Terms whose idf every task holds (16 bytes each).
HOT_TERMS = 1 << 22


def _limit(value, n: Column) -> Column:
    if value is None:
        return None
    if isinstance(value, bool):
        raise TypeError("max_df/min_df must be int or float")
    if isinstance(value, int):
        return F.lit(value).cast("double")
    return F.lit(float(value)) * n


def _count(names: list[str]):
    """Rows with parallel lists (the last one codes) -> each code once a row, sorted, with ``counts``."""
    def run(batches):
        for full in batches:
            for lo in range(0, full.num_rows, 1_024):
                b = full.slice(lo, 1_024)
                row, *lists = _lists(b, *names)
                code = lists[-1].to_numpy(zero_copy_only=False)
                order = np.lexsort((code, row))
                code, row = code[order], row[order]
                first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (row[1:] != row[:-1])])) if len(code) else np.zeros(0, int)
                counts = np.diff(np.concatenate([first, [len(code)]])).astype(np.int32)
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[first], minlength=b.num_rows))]), pa.int32())
                kept = [x.take(pa.array(order[first])) for x in lists]
                yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.ListArray.from_arrays(ends, x) for x in (*kept, pa.array(counts)))], names=["id", *names, "counts"])
    return run


def _counted_terms(df: DataFrame, id_col: str, tokens: Column, names: list[str]) -> DataFrame:
    """``(id, [terms,] codes, counts)``: a document's distinct terms, their hashes and counts, inside the row."""
    d = df.select(F.col(id_col).alias("id"), F.coalesce(F.filter(tokens, lambda t: t.isNotNull()), F.array().cast("array<string>")).alias("terms"))
    d = d.withColumn("codes", F.transform("terms", lambda t: F.xxhash64(t)))
    shape = {"terms": "array<string>", "codes": "array<bigint>"}
    return d.select("id", *names).mapInArrow(_count(names), ", ".join([f"id {d.schema['id'].dataType.simpleString()}", *(f"{c} {shape[c]}" for c in names), "counts array<int>"]))


def _repeats(rows: DataFrame) -> bool:
    """Whether an id occurs twice (ids alone are shuffled)."""
    return bool(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count())


def _seen(batches):
    """Documents' codes -> how many documents of some hold each."""
    held, size = [], 0

    def added():
        known, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(known, pa.int64()), pa.array(n, pa.int64())], names=["code", "df"])

    for b in batches:
        codes = b.column("codes").flatten().to_numpy(zero_copy_only=False)
        for lo in range(0, len(codes), 1 << 22):
            held.append(codes[lo:lo + (1 << 22)])
            size += len(held[-1])
            if size >= 1 << 22:
                yield added()
                held, size = [], 0
    if size:
        yield added()


class _Idf:
    """The idf of all terms: of at most ``hot_terms`` most frequent as a table that tasks hold, sorted by
    code (0 for terms out of the limits); ``other``: the idf of every term that is not in it (one idf if the
    table holds all terms of two documents or more; 0 if they are out of the limits); ``rest``: where they
    differ, ``(code, idf)`` of the others, else None."""

    def __init__(self, counts: DataFrame, n: float, max_df, min_df, hot_terms: int, keep_table: bool = True):
        """``counts``: documents with ``codes``, or ``(code, df)``, how many documents of some hold a term."""
        from ..session import materialize
        spark = counts.sparkSession
        size = F.lit(float(n))
        part = counts.select("code", "df") if "df" in counts.columns else counts.select("codes").mapInArrow(_seen, "code long, df long")
        seen = part.groupBy("code").agg(F.sum("df").alias("df"))
        hi, lo = _limit(max_df, size), _limit(min_df, size)
        if lo is not None:
            seen = seen.where(F.col("df") >= lo)
        if keep_table:
            seen = materialize(seen, "document_frequencies")
        idf = F.log((F.lit(1.0) + size) / (F.col("df") + 1)) + 1
        if hi is not None:
            idf = F.when(F.col("df") <= hi, idf).otherwise(0.0)
        self.rest, self.other = None, 0.0
        hot = seen
        if seen.count() > hot_terms:
            # all terms from one document frequency on, by the number of terms of each frequency (few rows): nothing is sorted
            cut, held = float("inf"), 0
            for r in seen.groupBy("df").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("df").desc()).toLocalIterator():
                held += r["n"]
                if held > hot_terms:
                    break
                cut = r["df"]
            hot, below = seen.where(F.col("df") >= F.lit(cut)), seen.where(F.col("df") < F.lit(cut))
            if r["df"] == 1:  # what is not in the table is in one document
                self.other = float(spark.range(1).select(F.lit(1).alias("df")).select(idf.cast("double")).first()[0])
            else:
                self.rest = below.select("code", idf.alias("idf")).where("idf > 0")
        table = hot.select("code", idf.alias("idf")).toArrow()
        codes, values = table["code"].to_numpy(), table["idf"].to_numpy()
        order = np.argsort(codes)
        self.hot = spark.sparkContext.broadcast((codes[order], values[order]))


def _lists(batch, *names: str):
    """Row of every entry, and the entries of list columns of one shape, as arrays."""
    sizes = np.diff(batch.column(names[0]).offsets.to_numpy())
    return np.repeat(np.arange(batch.num_rows), sizes), *(batch.column(c).flatten() for c in names)


def _at(known: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each code in the sorted table, and whether it is there."""
    if not len(known):
        return np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
    at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
    return at, known[at] == codes


def _weigh(hot, named: str, whole: bool, other: float = 0.0):
    """Rows of counts -> ``(id, <named>, weights, square, far)``: entries of hot terms within the limits with
    count x idf, the sum of their squares, and the other entries as ``(<named>, code, tf)``."""
    def run(batches):
        known, idf = hot.value
        for full in batches:
            for lo in range(0, full.num_rows, 1_024):
                b = full.slice(lo, 1_024)
                row, codes, counts, names = _lists(b, "codes", "counts", named)
                code, tf = codes.to_numpy(zero_copy_only=False), counts.to_numpy(zero_copy_only=False)
                at, hit = _at(known, code)
                w = tf * np.where(hit, idf[at], other) if len(known) else tf * np.full(len(code), other)
                kept = w > 0
                far = np.zeros(len(code), bool) if whole else ~hit
                ends = lambda m: pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[m], minlength=b.num_rows))]), pa.int32())
                entry = pa.StructArray.from_arrays([names.filter(pa.array(far)), pa.array(code[far], pa.int64()), pa.array(tf[far], pa.int32())], ["name", "code", "tf"])
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), pa.ListArray.from_arrays(ends(kept), names.filter(pa.array(kept))), pa.ListArray.from_arrays(ends(kept), pa.array(w[kept])),
                     pa.array(np.bincount(row[kept], weights=w[kept] ** 2, minlength=b.num_rows).astype(float)), pa.ListArray.from_arrays(ends(far), entry)],
                    names=["id", named, "weights", "square", "far"])
    return run


def _weighted(counts: DataFrame, named: str, idf: _Idf) -> DataFrame:
    """``(id, <named>, weights)`` of unit length; documents without a kept term have empty arrays.  Ids must be unique."""
    kind, name = counts.schema["id"].dataType.simpleString(), counts.schema[named].dataType.elementType.simpleString()
    rows = counts.mapInArrow(_weigh(idf.hot, named, idf.rest is None, idf.other),
                             f"id {kind}, {named} array<{name}>, weights array<double>, square double, far array<struct<name:{name},code:bigint,tf:int>>")
    if idf.rest is not None:
        # entries of the other terms meet their idf by code and come back to their document
        far = (rows.select("id", F.explode("far").alias("e")).select("id", "e.*").join(idf.rest, "code")
                   .select(F.col("id").alias("_id"), F.struct("name", (F.col("tf") * F.col("idf")).alias("w")).alias("e"))
                   .groupBy("_id").agg(F.collect_list("e").alias("_e")))
        rows = rows.join(far, F.col("id").eqNullSafe(F.col("_id")), "left").select(
            "id", F.when(F.col("_e").isNull(), F.col(named)).otherwise(F.concat(named, F.transform("_e", lambda e: e["name"]))).alias(named),
            F.when(F.col("_e").isNull(), F.col("weights")).otherwise(F.concat("weights", F.transform("_e", lambda e: e["w"]))).alias("weights"),
            (F.col("square") + F.coalesce(F.aggregate("_e", F.lit(0.0), lambda s, e: s + e["w"] * e["w"]), F.lit(0.0))).alias("square"))
    return rows.select("id", named, F.transform("weights", lambda w: w / F.sqrt(F.col("square"))).alias("weights"))


def tfidf_rows(df: DataFrame, id_col: str, text_col: str | None = None, *, tokens: Column | None = None,
               max_df: float | int | None = 0.95, min_df: float | int | None = 0, pattern: str = TOKEN_PATTERN,
               hot_terms: int = HOT_TERMS, materialize_counts: bool = True, named: str = "terms") -> DataFrame:
    """I10 with a document a row: ``(id, terms, weights)``, or hashes of the terms with ``named="codes"``.

    Rows of one id are one document.  Documents without a kept term have empty arrays."""
    if tokens is None:
        tokens = tokenize(F.col(text_col), pattern)
    from ..session import materialize
    keep = (lambda t, name: materialize(t, name)) if materialize_counts else (lambda t, name: t)
    names = ["terms", "codes"] if named == "terms" else ["codes"]
    counts = keep(_counted_terms(df, id_col, tokens, names), "term_counts")
    n = counts.count()
    if _repeats(counts):
        one = counts.select("id", F.explode(F.arrays_zip(*names, "counts")).alias("e")).groupBy("id", *(F.col(f"e.{c}").alias(c) for c in names)).agg(F.sum("e.counts").cast("int").alias("counts"))
        counts = one.groupBy("id").agg(F.collect_list(F.struct(*names, "counts")).alias("e"))
        counts = keep(counts.select("id", *(F.col(f"e.{c}").alias(c) for c in (*names, "counts"))), "merged_counts")
    return _weighted(counts, named, _Idf(counts, n, max_df, min_df, hot_terms, materialize_counts))


def tfidf(df: DataFrame, id_col: str, text_col: str | None = None, *, tokens: Column | None = None,
          max_df: float | int | None = 0.95, min_df: float | int | None = 0,
          pattern: str = TOKEN_PATTERN, hot_terms: int = HOT_TERMS, materialize_counts: bool = True) -> DataFrame:
    """Long-form TF-IDF ``(id, term, weight)``.

    ``n`` counts every input row, also rows without any token (as the
    vectoriser does).  Pass ``tokens`` to vectorise a prepared token array
    (n-grams, tags) instead of matching ``pattern`` on ``text_col``.

    Skew: at most ``hot_terms`` most frequent terms (16 bytes each) get their idf
    from a table every task holds and never enter the term-keyed shuffle; every other
    term occurs in at most ``#(doc, term) pairs / hot_terms`` rows.  Terms are
    looked up by ``xxhash64`` (two of V terms share one with a probability of V^2 / 2^65).

    ``materialize_counts`` writes the counts once to the shared checkpoint folder, so
    tokenisation runs once.
    """
    rows = tfidf_rows(df, id_col, text_col, tokens=tokens, max_df=max_df, min_df=min_df, pattern=pattern, hot_terms=hot_terms, materialize_counts=materialize_counts)
    return rows.select("id", F.explode(F.arrays_zip("terms", "weights")).alias("e")).select("id", F.col("e.terms").alias("term"), F.col("e.weights").alias("weight"))


def pair_distances(weights: DataFrame, pairs: DataFrame, a: str = "id", b: str = "prior_id") -> DataFrame:
    """I11 core: ``(a, b, distance)`` for distinct non-null pairs, distance =
    ``1 - cos`` clamped to [0, 1]; null when either vector is empty, 1 when
    the vectors share no term.  Only the pairs' own terms are joined: the
    current side on the document id, the prior side on (document, term) -
    neither key is ever hot."""
    cur = weights.select(F.col("id").alias("_a"), "term", F.col("weight").alias("_wa"))
    pri = weights.select(F.col("id").alias("_b"), "term", F.col("weight").alias("_wb"))
    p = (pairs.select(F.col(a).alias("_a"), F.col(b).alias("_b"))
              .filter(F.col("_a").isNotNull() & F.col("_b").isNotNull()).distinct())
    dots = (p.join(cur, "_a", "inner").join(pri, ["_b", "term"], "inner")
             .groupBy("_a", "_b").agg(F.sum(F.col("_wa") * F.col("_wb")).alias("_dot")))
    nonempty = weights.select(F.col("id").alias("_x")).distinct()
    dist = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - F.coalesce(F.col("_dot"), F.lit(0.0))))
    return (p.join(nonempty.withColumnRenamed("_x", "_a"), "_a", "left_semi")
             .join(nonempty.withColumnRenamed("_x", "_b"), "_b", "left_semi")
             .join(dots, ["_a", "_b"], "left")
             .select(F.col("_a").alias(a), F.col("_b").alias(b), dist.alias("distance")))


def cosine_distance(weights: "DataFrame | PackedVectors", pairs: DataFrame, id_col: str = "id",
                    prior_cols: tuple[str, ...] | str = "prior_id", out_prefix: str = "dist") -> DataFrame:
    """Adds one distance column per prior column of ``pairs``
    (``dist_<suffix>`` for ``prior_<suffix>``, else ``distance``).  All pair
    kinds are scored in one pass.  ``weights``: of ``tfidf``, ``document_vectors`` or ``packed_vectors``."""
    prior_cols = (prior_cols,) if isinstance(prior_cols, str) else tuple(prior_cols)
    allp = None
    for pc in prior_cols:
        one = pairs.select(F.col(id_col).alias("_id"), F.col(pc).alias("_prior"))
        allp = one if allp is None else allp.unionByName(one)
    core = packed_distances if isinstance(weights, PackedVectors) else vector_distances if "vector" in weights.columns else pair_distances
    d = core(weights, allp, "_id", "_prior")
    out = pairs
    for pc in prior_cols:
        name = f"{out_prefix}_{pc[len('prior_'):]}" if pc.startswith("prior_") and len(prior_cols) > 1 else "distance"
        dd = d.select(F.col("_id").alias(id_col), F.col("_prior").alias(pc), F.col("distance").alias(name))
        out = out.join(dd, [id_col, pc], "left")
    return out


def term_counts(df: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """``(id, codes, counts)``: a document's distinct terms as sorted 64-bit hashes with their
    counts, inside the row, so neither tokens nor counts are shuffled.  A document without tokens
    (or with a null array) keeps its row with empty arrays; null tokens count as one term of their own."""
    d = df.select(F.col(id_col).alias("id"), F.coalesce(F.transform(tokens, lambda t: F.xxhash64(t)), F.array().cast("array<bigint>")).alias("codes"))
    return d.mapInArrow(_count(["codes"]), f"id {d.schema['id'].dataType.simpleString()}, codes array<bigint>, counts array<int>")


def document_vectors(df: DataFrame, id_col: str, tokens: Column, *, max_df: float | int | None = 0.95,
                     min_df: float | int | None = 0, hot_terms: int = HOT_TERMS) -> DataFrame:
    """I10 for distances: ``(id, vector)``, the weights of ``tfidf`` as one array of ``(code, w)`` a
    document, sorted by code (``xxhash64`` of the term).  ``id_col`` should be unique: the entries of
    rows that share an id are kept side by side.  Documents whose terms are all dropped have no row.
    Both tables, counts and vectors, are written to the checkpoint folder.
    """
    from ..session import materialize
    counts = materialize(term_counts(df, id_col, tokens), "document_counts")
    n = counts.count()
    idf = _Idf(counts, n, max_df, min_df, hot_terms)
    if _repeats(counts):
        counts = materialize(counts.groupBy("id").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("codes", "counts"))), "document_counts")
    rows = _weighted(counts, "codes", idf).where(F.size("codes") > 0)
    entry = F.zip_with("codes", "weights", lambda c, w: F.struct(c.alias("code"), w.alias("w")))
    return materialize(rows.select("id", F.sort_array(entry).alias("vector")), "document_vectors")


def vector_distances(vectors: DataFrame, pairs: DataFrame, a: str = "id", b: str = "prior_id") -> DataFrame:
    """I11 core over ``document_vectors``: ``(a, b, distance)`` for distinct non-null pairs whose
    documents both have a vector.  Both arrays are sorted, so their concatenation sorts by one merge, and
    a term of both documents stands in two neighbouring entries."""
    p = (pairs.select(F.col(a).alias("_a"), F.col(b).alias("_b"))
              .where(F.col("_a").isNotNull() & F.col("_b").isNotNull()).distinct())
    one = vectors.select(F.col("id").alias("_a"), F.col("vector").alias("_va"))
    two = vectors.select(F.col("id").alias("_b"), F.col("vector").alias("_vb"))
    m = p.join(two, "_b").join(one, "_a").select("_a", "_b", F.sort_array(F.concat("_va", "_vb")).alias("_m"))
    shared = F.zip_with("_m", F.slice("_m", F.lit(2), F.size("_m")),
                        lambda x, y: F.when(x["code"] == y["code"], x["w"] * y["w"]).otherwise(F.lit(0.0)))
    dot = F.aggregate(shared, F.lit(0.0), lambda s, x: s + x)
    return m.select(F.col("_a").alias(a), F.col("_b").alias(b),
                    F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - dot)).alias("distance"))


class PackedVectors:
    """Documents as bytes: ``rows`` ``(id, near, far)`` with the places of their hot terms in the table of ``idf`` and the
    counts, and codes and weights of the other terms.  A weight is worked out where two documents meet."""

    def __init__(self, rows: DataFrame, idf: _Idf):
        self.rows, self.idf = rows, idf

    def terms(self) -> int:
        """Distinct terms that have a weight."""
        return int((self.idf.hot.value[1] > 0).sum()) + self.rows.select(F.explode("far.code").alias("c")).distinct().count()


def _planes(places: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted places as differences, and counts, byte by byte: mostly zeros, which any codec of a shuffle shrinks."""
    both = np.stack([np.diff(places, prepend=0), counts]).astype("<u4")
    return both.view(np.uint8).reshape(2, -1, 4).transpose(0, 2, 1).tobytes()


def _unplaned(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(2, 4, -1).transpose(0, 2, 1)).view("<u4")[:, :, 0].astype(np.int64)
    return np.cumsum(both[0]), both[1]


def _pack(hot, whole: bool, other: float = 0.0):
    def run(batches):
        known, idf = hot.value
        for full in batches:
            for lo in range(0, full.num_rows, 1_024):
                b = full.slice(lo, 1_024)
                row, codes, counts = _lists(b, "codes", "counts")
                code, tf = codes.to_numpy(zero_copy_only=False), counts.to_numpy(zero_copy_only=False)
                at, hit = _at(known, code)
                kept = hit & (idf[at] > 0) if len(known) else hit
                ends = np.cumsum(np.bincount(row[kept], minlength=b.num_rows))[:-1]
                near = [_planes(p, c) for p, c in zip(np.split(at[kept], ends), np.split(tf[kept], ends))]
                far = np.full(len(code), other > 0) & ~hit if whole else ~hit
                entry = pa.StructArray.from_arrays([pa.array(code[far], pa.int64()), pa.array(tf[far], pa.int32())], ["code", "tf"])
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[far], minlength=b.num_rows))]), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(near, pa.binary()), pa.ListArray.from_arrays(offsets, entry)], names=["id", "near", "far"])
    return run


#: Entries and documents of a block of counted documents.
BLOCK_TERMS, BLOCK_ROWS = 1 << 20, 1 << 14


def _dense(a: np.ndarray) -> bytes:
    """Numbers under 2^32 byte by byte: mostly zeros, which the codec of a table shrinks."""
    return np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _undense(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4")[:, 0].astype(np.int64)


def _block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    row, codes = _lists(t, "codes")
    named = codes.dictionary_encode()
    known = named.dictionary.to_numpy(zero_copy_only=False)
    order = np.argsort(known)
    known, rank = known[order], np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    entry = row * max(len(known), 1) + rank[named.indices.to_numpy(zero_copy_only=False)]
    entry.sort()
    first = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]])) if len(entry) else np.zeros(0, int)
    counts = np.diff(np.concatenate([first, [len(entry)]]))
    row, place = np.divmod(entry[first], max(len(known), 1))
    sizes = np.bincount(row, minlength=t.num_rows)
    step = np.diff(place, prepend=0)
    starts = np.cumsum(sizes) - sizes
    full = starts[sizes > 0]
    step[full] = place[full]  # every document begins anew
    ids = pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), t.column("id"))
    own = [known.astype("<i8").tobytes(), *map(_dense, (np.bincount(place, minlength=len(known)), sizes, step, counts))]
    return pa.RecordBatch.from_arrays([ids, *(pa.array([x], pa.binary()) for x in own)], names=["ids", "codes", "df", "sizes", "steps", "counts"])


def _blocks(taken=None):
    """Documents ``(id, codes)`` -> a row for some of them: the terms they hold, in how many of them each is, and for every
    document the places of its terms among these, and the counts.  ``taken`` (`token_characters`): documents are
    ``(id, words)``, lower-cased texts that are split here."""
    def run(batches):
        split = word_codes(taken.value) if taken is not None else None
        held, rows, terms = [], 0, 0
        for full in batches:
            for lo in range(0, full.num_rows, 128):
                b = full.slice(lo, 128)
                if split is not None:
                    n, code = split(b.column("words").to_pylist())
                    ends = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
                    b = pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(ends, pa.array(code))], names=["id", "codes"])
                held.append(b)
                rows, terms = rows + b.num_rows, terms + len(b.column("codes").flatten())
                if terms >= BLOCK_TERMS or rows >= BLOCK_ROWS:
                    yield _block(held)
                    held, rows, terms = [], 0, 0
        if rows:
            yield _block(held)
    return run


def _frequencies(batches):
    for b in batches:
        for codes, df in zip(b.column("codes"), b.column("df")):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(codes.as_py(), "<i8"), pa.int64()), pa.array(_undense(df.as_py()), pa.int64())], names=["code", "df"])


def _pack_blocks(hot, whole: bool, other: float = 0.0):
    """Blocks -> documents as by `_pack`; only the distinct terms of a block are looked up."""
    def run(batches):
        known, idf = hot.value
        for b in batches:
            for i in range(b.num_rows):
                get = lambda c: b.column(c)[i].as_py()  # noqa: B023, E731
                code = np.frombuffer(get("codes"), "<i8")
                at, hit = _at(known, code)
                kept = hit & (idf[at] > 0) if len(known) else hit
                rest = np.full(len(code), other > 0) & ~hit if whole else ~hit
                sizes, step, tf = _undense(get("sizes")), _undense(get("steps")), _undense(get("counts"))
                ends = np.cumsum(sizes)
                total = np.cumsum(step)
                before = np.repeat(np.concatenate([[0], total])[ends - sizes], sizes)
                place = total - before
                row = np.repeat(np.arange(len(sizes)), sizes)
                near, far = kept[place], rest[place]
                parts = np.cumsum(np.bincount(row[near], minlength=len(sizes)))[:-1]
                planes = [_planes(p, c) for p, c in zip(np.split(at[place[near]], parts), np.split(tf[near], parts))]
                entry = pa.StructArray.from_arrays([pa.array(code[place[far]], pa.int64()), pa.array(tf[far], pa.int32())], ["code", "tf"])
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[far], minlength=len(sizes)))]), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column("ids").slice(i, 1).flatten(), pa.array(planes, pa.binary()), pa.ListArray.from_arrays(offsets, entry)], names=["id", "near", "far"])
    return run


def packed_vectors(df: DataFrame, id_col: str, tokens: Column | None = None, *, words: Column | None = None, max_df: float | int | None = 0.95,
                   min_df: float | int | None = 0, hot_terms: int = HOT_TERMS, merge: bool = False) -> PackedVectors | DataFrame:
    """I10 for distances of very many documents: the weights of ``document_vectors`` in a few bytes a term.

    ``df`` is read once: documents are counted in blocks that write each of their terms' 64-bit hashes once, which gives the
    document frequencies and then the vectors.  ``words``: texts in place of tokens, whose tokens are those of
    `tokenize` by its default pattern, split and hashed many texts at a time (`word_codes`).  Where rows share an id (``df`` is then read again), ``document_vectors`` is
    returned, or with ``merge`` they are one document, as in ``tfidf``."""
    from ..session import discard, materialize
    if words is not None:
        tokens = tokenize(words)
        d = df.select(F.col(id_col).alias("id"), F.lower(words).alias("words"))
        taken = df.sparkSession.sparkContext.broadcast(token_characters(df.sparkSession))
    else:
        d = df.select(F.col(id_col).alias("id"), F.coalesce(F.transform(tokens, lambda t: F.xxhash64(t)), F.array().cast("array<bigint>")).alias("codes"))
        taken = None
    kind = d.schema["id"].dataType.simpleString()
    blocks = materialize(d.mapInArrow(_blocks(taken), f"ids array<{kind}>, codes binary, df binary, sizes binary, steps binary, counts binary"), "term_blocks")
    if _repeats(blocks.select(F.explode("ids").alias("id"))):
        discard(blocks)
        if not merge:
            return document_vectors(df, id_col, tokens, max_df=max_df, min_df=min_df, hot_terms=hot_terms)
        one = term_counts(df, id_col, tokens).select("id", F.explode(F.arrays_zip("codes", "counts")).alias("e")).groupBy("id", F.col("e.codes").alias("code")).agg(F.sum("e.counts").cast("int").alias("n"))
        one = one.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("code", "n"))).alias("e"))
        counts = materialize(one.select("id", F.col("e.code").alias("codes"), F.col("e.n").alias("counts")), "merged_counts")
        idf = _Idf(counts, df.count(), max_df, min_df, hot_terms)
        pack = _pack
    else:
        counts, pack = blocks, _pack_blocks
        idf = _Idf(blocks.select("codes", "df").mapInArrow(_frequencies, "code long, df long"), blocks.select(F.sum(F.size("ids"))).first()[0] or 0, max_df, min_df, hot_terms)
    rows = materialize(counts.mapInArrow(pack(idf.hot, idf.rest is None, idf.other), f"id {kind}, near binary, far array<struct<code:bigint,tf:int>>"), "packed_vectors")
    discard(counts)
    if idf.rest is None:
        entry = F.transform("far", lambda e: F.struct(e["code"].alias("code"), (e["tf"] * F.lit(idf.other)).alias("w")))
        return PackedVectors(rows.select("id", "near", entry.alias("far")), idf)
    far = (rows.select("id", F.explode("far").alias("e")).select("id", "e.*").join(idf.rest, "code")
               .groupBy(F.col("id").alias("_id")).agg(F.sort_array(F.collect_list(F.struct("code", (F.col("tf") * F.col("idf")).alias("w")))).alias("_e")))
    own = rows.select("id", "near").join(far, F.col("id").eqNullSafe(F.col("_id")), "left")
    return PackedVectors(materialize(own.select("id", "near", F.coalesce("_e", F.array().cast("array<struct<code:bigint,w:double>>")).alias("far")), "packed_vectors"), idf)


def unpacked(batch: pa.RecordBatch, hot) -> tuple[np.ndarray, ...]:
    """Of rows with ``near`` and ``far`` (null: no document): row, code, count and idf of every hot term, row, code and count x idf of every
    other, and the lengths of the rows' vectors; a weight is count x idf by length."""
    known, idf = hot.value
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    pairs = [none if x is None else _unplaned(x) for x in batch.column("near").to_pylist()]
    row = np.repeat(np.arange(batch.num_rows), [len(p) for p, _ in pairs])
    at, tf = (np.concatenate([x[i] for x in pairs]) if pairs else none[0] for i in (0, 1))
    far = batch.column("far")
    sizes = far.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    entry = far.flatten()
    other, code, w = np.repeat(np.arange(batch.num_rows), sizes), *(entry.field(c).to_numpy(zero_copy_only=False) for c in ("code", "w"))
    idf_ = idf[at] if len(at) else np.zeros(0)
    square = np.bincount(row, weights=(tf * idf_) ** 2, minlength=batch.num_rows) + np.bincount(other, weights=w ** 2, minlength=batch.num_rows)
    return row, known[at] if len(at) else none[0], tf, idf_, other, code, w, np.sqrt(square)


def with_weights(df: DataFrame, vectors: PackedVectors, codes: str, values: str) -> DataFrame:
    """``df`` with the weights of its documents (``near``, ``far``: columns of ``vectors``) at the end of its lists ``codes`` and ``values``."""
    hot, names = vectors.idf.hot, [c for c in df.columns if c not in ("near", "far")]

    def run(batches):
        for full in batches:
            for lo in range(0, full.num_rows, 1_024):
                b = full.slice(lo, 1_024)
                row, code, tf, idf, other, code2, w, length = unpacked(b, hot)
                own = [b.column(c) for c in (codes, values)]
                at = np.repeat(np.arange(b.num_rows), own[0].value_lengths().to_numpy(zero_copy_only=False))
                rows = np.concatenate([at, row, other])
                order = np.argsort(rows, kind="stable")
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=b.num_rows))]), pa.int32())
                lists = {c: pa.ListArray.from_arrays(ends, pa.array(np.concatenate([x.flatten().to_numpy(zero_copy_only=False), *more])[order]))
                         for c, x, more in ((codes, own[0], (code, code2)), (values, own[1], (tf * idf / length[row], w / length[other])))}
                yield pa.RecordBatch.from_arrays([lists.get(c, b.column(c)) for c in names], names=names)
    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in names))


def packed_distances(vectors: PackedVectors, pairs: DataFrame, a: str = "id", b: str = "prior_id") -> DataFrame:
    """I11 core over ``packed_vectors``: ``(a, b, distance)`` for distinct non-null pairs whose documents both have a term."""
    p = (pairs.select(F.col(a).alias("_a"), F.col(b).alias("_b"))
              .where(F.col("_a").isNotNull() & F.col("_b").isNotNull()).distinct())
    side = lambda n: vectors.rows.where((F.octet_length("near") > 0) | (F.size("far") > 0)).select(F.col("id").alias(f"_{n}"), F.col("near").alias(f"near_{n}"), F.col("far.code").alias(f"code_{n}"), F.col("far.w").alias(f"w_{n}"))
    m = p.join(side("b"), "_b").join(side("a"), "_a")
    hot = vectors.idf.hot

    def run(batches):
        idf = hot.value[1]
        def read(batch, n, i):  # noqa: E306
            at, tf = _unplaned(batch.column(f"near_{n}")[i].as_py())
            codes, w = (np.asarray(batch.column(f"{c}_{n}")[i].values) for c in ("code", "w"))
            return at, tf * idf[at] if len(at) else np.zeros(0), codes, w
        for batch in batches:
            out = np.empty(batch.num_rows)
            for i in range(batch.num_rows):
                x, y = read(batch, "a", i), read(batch, "b", i)
                dot = 0.0
                for c in (0, 2):
                    _, i1, i2 = np.intersect1d(x[c], y[c], assume_unique=True, return_indices=True)
                    dot += x[c + 1][i1] @ y[c + 1][i2]
                size = [np.sqrt(v[1] @ v[1] + v[3] @ v[3]) for v in (x, y)]
                out[i] = min(max(1.0 - dot / (size[0] * size[1]), 0.0), 1.0)
            yield pa.RecordBatch.from_arrays([batch.column("_a"), batch.column("_b"), pa.array(out)], names=[a, b, "distance"])

    kinds = [m.schema[c].dataType.simpleString() for c in ("_a", "_b")]
    return m.mapInArrow(run, f"{a} {kinds[0]}, {b} {kinds[1]}, distance double")
