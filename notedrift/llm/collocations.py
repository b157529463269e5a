"""Operator 11: phrase collocation mining by top-order marginalisation.

Only windows of the longest order are counted: for every word the window of it and
the ``longest - 1`` words that lead from it, padded where its piece of text ends.
A Spark ROLLUP over the leading columns then sums the counts of successively
shorter prefixes, so the count of every shorter phrase comes out of the same table
and no n-grams of other orders are made.

Words are known by 64-bit hashes of (language, word).  A first pass counts them as
strings, so that a collision is seen (the pass then runs again under another hash
function) and hashes can be shown as words later.  A phrase with a word below
``min_count`` cannot be a candidate, so such words pad windows as well; where the
remaining words are at most ``MOST_CODES`` (a bounded table for each task) a window
is packed into one integer, else it keeps one hash a word.  Both give the same rows.

Candidates are phrases of two or more words.  A cut after k words gives the counts
l and r of its parts and the score floor(1000000 * a * a / (l * r)) in exact decimal
arithmetic; the cut of lowest score counts, ties to the smallest k.  A candidate
goes if a longer candidate that holds its words side by side has at least ``share``
percent of its count.

Defined results: a null text is the empty text, a null language is ``und``; ids play
no part; repeated rows count each; an empty table gives an empty table.  A text is
one piece of work: memory is bounded by a slice of texts or one single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .textops import hash_runs, mix64, slices

SLICE = 1_000_000
#: Words a task holds before it hands on their counts.
HELD_WORDS = 80_000
#: Most words that get a code in a table held by each task (8 bytes a word).
MOST_CODES = (1 << 21) - 2
#: Parts of a language that are ranked on their own before the last ranking.
RANK_PARTS = 64
UNKNOWN = "und"

_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[ord("A"):ord("Z") + 1] += 32
#: Fixed values of the contract: 1 ends a piece, 2 parts words, 0 is part of a word.
_KIND = np.zeros(256, np.uint8)
_KIND[[ord(c) for c in ".,;:!?\x0a\x0b\x0c\x0d"]] = 1
_KIND[[0x20, 0x09]] = 2


def text_words(data: np.ndarray, bounds: np.ndarray, seed: int) -> tuple[np.ndarray, ...]:
    """Words of texts given as UTF-8 bytes: hash, start, end, text number, whether the next word stands in the same piece."""
    kind = _KIND[data]
    inside = kind == 0
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    first = bounds[:-1][bounds[:-1] < bounds[1:]]
    opens[first] = inside[first]
    start = np.flatnonzero(opens)
    stops = ~inside
    stops[first] = True  # a text's first byte ends the word before it
    edge = np.append(np.flatnonzero(stops), len(data))
    end = edge[np.searchsorted(edge, start, "right")]
    text = np.searchsorted(bounds, start, "right") - 1
    piece = np.cumsum(kind == 1)[start] if len(start) else start
    follows = np.zeros(len(start), bool)
    follows[:-1] = (text[1:] == text[:-1]) & (piece[1:] == piece[:-1])
    # each seed reads another part of the table of random values
    h = hash_runs(_LOWER[data] + np.uint32(256 * seed), start, end)
    return h, start, end, text, follows


def _language_key(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass")) | 1


def _read(batch: pa.RecordBatch, seed: int) -> Iterator[tuple]:
    """Slices of a batch: languages of the texts, and each word's hash (of language and word), place, text number and follower."""
    column = batch.column("text").cast(pa.large_binary())
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    langs = batch.column("lang")
    for lo, hi in slices(sizes, SLICE):
        part = pc.fill_null(column.slice(lo, hi - lo), b"")
        _, offsets, values = part.buffers()
        bounds = np.frombuffer(offsets, np.int64, hi - lo + 1, part.offset * 8)
        data = np.frombuffer(values, np.uint8)[bounds[0]:bounds[-1]] if values is not None else np.empty(0, np.uint8)
        h, start, end, text, follows = text_words(data, bounds - bounds[0], seed)
        named = langs.slice(lo, hi - lo).to_pylist()
        keys = {x: _language_key(x) for x in set(named)}
        word = mix64(h ^ np.array([keys[x] for x in named], np.uint64)[text]) if len(h) else h
        word[word == 0] = 1  # zero pads
        yield named, data, word, start, end, text, follows


def _vocabulary(seed: int):
    """Counts of words as (hash, lang, word, n); a null word carries the number of all words of its language."""
    def rows(held: dict[int, list]) -> pa.RecordBatch:
        key, (lang, word, n) = list(held), zip(*held.values())
        return pa.RecordBatch.from_arrays([pa.array(np.array(key, np.uint64).view(np.int64)), pa.array(lang, pa.string()), pa.array(word, pa.string()), pa.array(n, pa.int64())],
                                          names=["hash", "lang", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        totals: dict[str, int] = {}
        for batch in batches:
            for named, data, word, start, end, text, _ in _read(batch, seed):
                for lang, n in zip(named, np.bincount(text, minlength=len(named)).tolist()):
                    totals[lang] = totals.get(lang, 0) + n
                key, at, n = np.unique(word, return_index=True, return_counts=True)
                whole = _LOWER[data].astype(np.uint8).tobytes()
                for k, i, c in zip(key.tolist(), at.tolist(), n.tolist()):
                    got = held.get(k)
                    if got is None:
                        held[k] = [named[text[i]], whole[start[i]:end[i]].decode("utf-8", "replace"), c]
                    else:
                        got[2] += c
                if len(held) > HELD_WORDS:
                    yield rows(held)
                    held = {}
        if held:
            yield rows(held)
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(np.array([_language_key(x) for x in totals], np.uint64).view(np.int64)), pa.array(list(totals), pa.string()),
                                              pa.nulls(len(totals), pa.string()), pa.array(list(totals.values()), pa.int64())], names=["hash", "lang", "word", "n"])
    return run


def _windows(seed: int, codes: np.ndarray | None, longest: int):
    """Padded longest windows with counts of each slice: one packed integer with ``codes``, else a hash a word."""
    bits = 63 // longest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, word, _, _, _, follows in _read(batch, seed):
                if not len(word):
                    continue
                if codes is None:
                    code = word.view(np.int64)
                else:
                    at = np.searchsorted(codes, word)
                    at[at == len(codes)] = 0
                    code = np.where(codes[at] == word, at + 1, 0) if len(codes) else np.zeros(len(word), np.int64)
                columns, going = [code], code != 0
                for k in range(1, longest):
                    going = going[:-1] & follows[k - 1:len(follows) - 1] & (code[k:] != 0)  # row i: the words i .. i + k stand together
                    column = np.zeros(len(code), np.int64)
                    column[:len(going)] = np.where(going, code[k:], 0)
                    columns.append(column)
                keep = code != 0
                columns = [c[keep] for c in columns]
                if codes is not None:
                    packed = np.zeros(len(columns[0]), np.int64)
                    for c in columns:
                        packed = (packed << bits) | c
                    key, n = np.unique(packed, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], names=["k0", "n"])
                else:
                    order = np.lexsort(columns[::-1])
                    columns = [c[order] for c in columns]
                    new = np.ones(len(order), bool)
                    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
                    at = np.flatnonzero(new)
                    yield pa.RecordBatch.from_arrays([*(pa.array(c[at]) for c in columns), pa.array(np.diff(np.append(at, len(order))))],
                                                     names=[*(f"k{i}" for i in range(longest)), "n"])
    return run


def _named(codes: np.ndarray, longest: int):
    """Codes of phrases back to hashes."""
    table = np.concatenate(([0], codes.view(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [pa.array(table[batch.column(f"w{i}").to_numpy()]) for i in range(1, longest + 1)]
            yield pa.RecordBatch.from_arrays([*columns, batch.column("f")], names=[*(f"w{i}" for i in range(1, longest + 1)), "f"])
    return run


def phrase_counts(docs: DataFrame, min_count: int = 10, longest: int = 3, text_col: str = "text", lang_col: str = "lang",
                  most_codes: int = MOST_CODES) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, phrases), both of what occurs ``min_count`` times or more.

    vocabulary: hash, lang, word, f (word null: all words of the language); phrases: words (array of hashes), f.
    """
    if longest < 2:
        raise ValueError("longest must be 2 or more")
    own = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"))
    seed = 0
    while True:  # until no two words share a hash
        words = (own.mapInArrow(_vocabulary(seed), "hash long, lang string, word string, n long").repartition("hash")
                 .groupBy("hash", "lang", "word").agg(F.sum("n").alias("f"))
                 .groupBy("hash").agg(F.count("*").alias("names"), F.sum("f").alias("f"), F.max_by(F.struct("lang", "word"), "f").alias("name"))
                 .where((F.col("f") >= min_count) | (F.col("names") > 1)))
        words = materialize(words.select("hash", "name.lang", "name.word", "f", "names"), "op11-words")
        if words.where(F.col("names") > 1).isEmpty():
            break
        seed += 1
    vocabulary = words.drop("names")

    frequent = vocabulary.where(F.col("word").isNotNull()).select("hash")
    codes = None
    if most_codes and frequent.count() <= min(most_codes, (1 << 63 // longest) - 2):  # proven bound of the table that tasks hold
        codes = np.sort(frequent.toPandas()["hash"].to_numpy(np.int64).view(np.uint64))
    columns = [f"w{i}" for i in range(1, longest + 1)]
    keys = ["k0"] if codes is not None else [f"k{i}" for i in range(longest)]
    windows = own.mapInArrow(_windows(seed, codes, longest), ", ".join(f"{k} long" for k in [*keys, "n"]))
    top = windows.groupBy(*keys).agg(F.sum("n").alias("f"))
    top = materialize(top, "op11-windows")
    if codes is not None:
        bits = 63 // longest
        parts = [F.shiftright("k0", bits * (longest - i)).bitwiseAND((1 << bits) - 1).alias(c) for i, c in enumerate(columns, 1)]
    else:
        parts = [F.col(k).alias(c) for k, c in zip(keys, columns)]
    top = top.select(*parts, "f")
    shorter = top.rollup(*columns[:-1]).agg(F.sum("f").alias("f")).where((F.col("f") >= min_count) & F.col("w1").isNotNull())
    # a level's own rows have null beyond it, a padded window has zero inside it
    shorter = shorter.where(~F.greatest(*[F.coalesce(F.col(c) == 0, F.lit(False)) for c in [*columns[:-1], columns[0]]]))
    shorter = shorter.select(*[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in columns[:-1]], F.lit(0).cast("long").alias(columns[-1]), "f")
    phrases = top.where((F.col("f") >= min_count) & (F.col(columns[-1]) != 0)).unionByName(shorter)
    if codes is not None:
        phrases = phrases.mapInArrow(_named(codes, longest), ", ".join(f"{c} long" for c in [*columns, "f"]))
    words_of = F.filter(F.array(*columns), lambda w: w != 0).alias("words")
    return vocabulary, materialize(phrases.select(words_of, "f"), "op11-phrases")


def collocations(docs: DataFrame, min_count: int = 10, longest: int = 3, share: int = 50, top: int = 2000,
                 text_col: str = "text", lang_col: str = "lang", most_codes: int = MOST_CODES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases by score, count and phrase."""
    vocabulary, phrases = phrase_counts(docs, min_count, longest, text_col, lang_col, most_codes)
    size = F.size("words")
    candidates = phrases.where(size > 1)
    # parts of candidates, all sides by the hashes of their words
    inner = candidates.where(size > 2).select("f", F.explode(F.flatten(F.transform(
        F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("words") - m + 1), lambda s: F.slice("words", s, m))))).alias("words"))
    longer = inner.groupBy("words").agg(F.max("f").alias("longer"))
    left = candidates.join(longer, "words", "left")
    left = left.where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("f") * share))
    cuts = left.select("words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns({"first": F.slice("words", 1, F.col("k")), "rest": F.slice("words", F.col("k") + 1, size - F.col("k"))})
    cuts = (cuts.join(phrases.select(F.col("words").alias("first"), F.col("f").alias("l")), "first")
            .join(phrases.select(F.col("words").alias("rest"), F.col("f").alias("r")), "rest"))
    a, l, r = (F.col(c).cast("decimal(18,0)") for c in "alr")
    cuts = cuts.select("words", "a", "k", "l", "r", (F.lit(1_000_000).cast("decimal(7,0)") * a * a).alias("over"), (l * r).alias("under"))
    cuts = cuts.withColumn("score", F.expr("over div under").cast("long"))
    best = cuts.groupBy("words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = best.select(F.monotonically_increasing_id().alias("row"), "words", "a", "cut.l", "cut.r", "cut.score")
    best = materialize(best, "op11-candidates")
    shown = best.select("row", "words", "a", "l", "r", "score", *[F.get("words", F.lit(i)).alias(f"w{i}") for i in range(longest)])
    names = vocabulary.where(F.col("word").isNotNull())
    for i in range(longest):
        shown = shown.join(names.select(F.col("hash").alias(f"w{i}"), F.col("word").alias(f"t{i}"), *([F.col("lang")] if i == 0 else [])), f"w{i}", "left")
    shown = shown.select("lang", F.concat_ws(" ", *[f"t{i}" for i in range(longest)]).alias("phrase"), "a", "l", "r", "score", F.pmod("row", F.lit(RANK_PARTS)).alias("part"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # the first of each part, then the first of all: a group holds `top` rows of each part at most
    shown = shown.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    shown = shown.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = vocabulary.where(F.col("word").isNull()).select("lang", F.col("f").alias("n"))
    return shown.join(totals, "lang").select("lang", F.col("rank").cast("int").alias("rank"), "phrase", "a", "l", "r", "n", "score")
