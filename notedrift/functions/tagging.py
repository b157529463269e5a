"""Morpheme tagging surface.

A tagger turns a note into ``ARRAY<STRUCT<surface STRING, tag STRING>>``
sentence by sentence (I1 normalisation, I2 split).  The default tagger goes
by the JVM's classes of characters, many texts at a time (`tag_text`; by
patterns in the JVM: `tag_by_patterns`).  A real morphological analyser can be plugged in
with ``pandas_tagger``: an Arrow-batched pandas UDF that calls it per
sentence and skips a sentence that fails, as the reference does.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .text import characters, normalize_note, split_sentences

TAGGED = "array<struct<surface:string,tag:string>>"

# Default tokenizer: numbers (with inner separators), letter runs, single symbols.
DEFAULT_TOKEN = r"\p{N}+(?:[.,]\p{N}+)*|\p{L}+|[^\s\p{L}\p{N}]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def class_tag(tok: Column) -> Column:
    """Character-class tag: SN number, NNP capitalised word, JX word of at most
    two letters, NNG other word, SF sentence mark, SW other symbol."""
    # most tokens are told by one plain pattern (nothing is shared inside a lambda, so every use of ``tok`` counts); the others go on
    return (F.when(tok.rlike("^[a-z]{3}"), F.lit("NNG"))
             .when(tok.rlike("^[A-Z]"), F.lit("NNP"))
             .when(tok.isin(".", "?", "!"), F.lit("SF"))
             .when(tok.rlike(r"^\p{N}"), F.lit("SN"))
             .when(tok.rlike(r"^\p{Lu}"), F.lit("NNP"))
             .when(tok.rlike(r"^\p{L}{1,2}$"), F.lit("JX"))
             .when(tok.rlike(r"^\p{L}"), F.lit("NNG"))
             .otherwise(F.lit("SW")))


def _tagged(kinds: bytes):
    """Texts -> tagged tokens, many texts at a time; ``kinds``: letters (1), capitals (2) and numbers (4) of all code points."""
    kind = np.frombuffer(zlib.decompress(kinds), np.uint8)
    names = pa.array(["SN", "NNP", "JX", "NNG", "SF", "SW"])

    def run(texts: list) -> pa.ListArray:
        point = np.frombuffer("\n".join(["", *(x or "" for x in texts), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        own = kind[point]
        letter, number = (own & 1).astype(bool), (own & 4).astype(bool)
        after = np.append(point[1:], 10)
        starts = np.cumsum([1, *(len(x or "") + 1 for x in texts)])
        after[starts - 2] = 0  # nothing follows the end of a text
        dot, mark = point == 46, (point == 46) | (point == 63) | (point == 33)
        # a separator between two numbers is part of the number; a mark that ends a sentence goes with its delimiter
        inner = (dot | (point == 44)) & np.append(False, number[:-1]) & np.append(number[1:], False)
        ends = (mark & (after == 32)) | (dot & (after == 10))
        number |= inner
        space = (point == 32) | ((point >= 9) & (point <= 13))
        symbol = ~(letter | number | space | ends)
        begins = (letter & ~np.append(False, letter[:-1])) | (number & ~np.append(False, number[:-1])) | symbol
        inside = letter | number | symbol
        first = np.flatnonzero(begins)
        kept = np.flatnonzero(inside)
        sizes = np.diff(np.append(np.searchsorted(kept, first), len(kept)))
        # the tokens' characters as one UTF-8 text and the bytes up to each token
        some = point[kept]
        width = 1 + (some > 0x7F) + (some > 0x7FF) + (some > 0xFFFF)
        data = some.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        places = np.concatenate([[0], np.cumsum(width)])[np.append(np.cumsum(sizes) - sizes, len(kept))].astype(np.int32)
        surface = pa.StringArray.from_buffers(len(first), pa.py_buffer(places.tobytes()), pa.py_buffer(data))
        head = own[first]
        tag = np.select([(head & 4) > 0, (head & 2) > 0, ((head & 1) > 0) & (sizes <= 2), (head & 1) > 0, mark[first]], [0, 1, 2, 3, 4], 5)
        offsets = pa.array(np.searchsorted(first, starts), pa.int32())
        null = pa.array([x is None for x in texts], pa.bool_())
        values = pa.StructArray.from_arrays([surface, names.take(pa.array(tag, pa.int8()))], ["surface", "tag"])
        return pa.ListArray.from_arrays(offsets, values, mask=null)
    return run


def _characters(spark: SparkSession) -> bytes:
    kinds = sum(characters(spark, p).astype(np.uint8) << i for i, p in enumerate((r"\p{L}", r"\p{Lu}", r"\p{N}")))
    return zlib.compress(kinds.astype(np.uint8).tobytes())


def tag_text(col, normalize: bool = True) -> Column:
    """Default tagger over a note: ``ARRAY<STRUCT<surface, tag>>``.

    The tokens of DEFAULT_TOKEN in the pieces of `split_sentences`, with `class_tag` of each, found by the classes of the
    characters of many texts at once: a pattern a token takes several times as long."""
    x = normalize_note(_c(col)) if normalize else _c(col)
    kinds = _characters(SparkSession.active())

    @F.arrow_udf(TAGGED)
    def tag(texts: pa.Array) -> pa.Array:
        run = _tagged(kinds)
        parts = [run(texts.slice(lo, 128).to_pylist()) for lo in range(0, len(texts), 128)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.struct([("surface", pa.string()), ("tag", pa.string())])))

    return tag(x)


def tag_by_patterns(col, normalize: bool = True) -> Column:
    """`tag_text` by patterns alone, in the JVM: what it is tested against."""
    x = normalize_note(_c(col)) if normalize else _c(col)
    toks = F.flatten(F.transform(split_sentences(x), lambda s: F.regexp_extract_all(s, F.lit(DEFAULT_TOKEN), 0)))
    return F.transform(toks, lambda t: F.struct(t.alias("surface"), class_tag(t).alias("tag")))


def pandas_tagger(fn: Callable[[str], Iterable[tuple[str, str]]]):
    """Wrap a per-sentence analyser ``fn(sentence) -> [(surface, tag), ...]``
    as a pandas UDF ``sentences ARRAY<STRING> -> TAGGED``.  A sentence whose
    analysis raises is skipped; the rest of the note goes on."""

    @F.pandas_udf(TAGGED)
    def _tag(sentences: pd.Series) -> pd.Series:
        out = []
        for sents in sentences:
            pairs = []
            for s in (sents if sents is not None else []):
                try:
                    pairs.extend({"surface": a, "tag": b} for a, b in fn(s))
                except Exception:  # noqa: BLE001 - skip the failing sentence only
                    continue
            out.append(pairs)
        return pd.Series(out)

    return _tag


def format_tokens(tagged, mode: str = "attach_tag") -> Column:
    """``surface`` -> surfaces joined by a space; ``attach_tag`` ->
    'surface/TAG;' pieces concatenated; ``pairs`` -> the structured tokens."""
    t = _c(tagged)
    if mode == "surface":
        return F.array_join(F.transform(t, lambda x: x["surface"]), " ")
    if mode == "attach_tag":
        return F.array_join(F.transform(t, lambda x: F.concat(x["surface"], F.lit("/"), x["tag"], F.lit(";"))), "")
    if mode == "pairs":
        return t
    raise ValueError(mode)


def tagged_tokens(tagged) -> Column:
    """'surface/TAG' strings of structured tokens (input of I4, I5, I12)."""
    return F.transform(_c(tagged), lambda x: F.concat(x["surface"], F.lit("/"), x["tag"]))


def split_tagged_string(col) -> Column:
    """'a/NNG;b/JX;' -> ['a/NNG', 'b/JX'] (the reference's string form)."""
    return F.filter(F.split(_c(col), ";", -1), lambda s: s != "")
