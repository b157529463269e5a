"""Text column functions (I1-I9, I12, I13): built-in regex and array
higher-order functions, so no row leaves the JVM; `word_codes` splits texts
that are in Python already.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Token pattern: runs of two or more letters, digits or underscores (the
# vectoriser's default "two word characters", written without \w so that Java
# and RE2 agree on it).
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"

# Sentence delimiters of the note splitter, in the order given.
SENTENCE_DELIMITERS = (". ", "? ", "! ", "\n", ".\n")

# The morpheme tags kept for the footnote corpus, in the original
# order; the original list carries a trailing ';' on most entries (its token
# separator), which is dropped here because tags are compared structurally.
KEPT_TAGS = ("NNG", "NNP", "NNB", "NP", "VV", "VA", "VX", "VCP", "VCN", "MM", "MAG", "MAJ",
             "XPN", "XSN", "XSV", "XSA", "XR", "NF", "NV", "NA")

# A token is numeric when its text (commas removed) parses as a float:
# plain or scientific decimals, and the nan/inf words Python's float() accepts.
NUMERIC_TOKEN = (r"^\s*[+-]?((\d+(_\d+)*)?\.?\d+(_\d+)*([eE][+-]?\d+(_\d+)*)?|\d+(_\d+)*\.([eE][+-]?\d+)?"
                 r"|(?i:nan|inf|infinity))\s*$")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_note(col) -> Column:
    """Collapse newline runs, drop a space after a newline, remove runs of
    two or more spaces entirely (joins letters spaced out in table headers)."""
    whole = _c(col)
    x = F.regexp_replace(whole, r"\n+", "\n")
    x = F.regexp_replace(x, r"\n ", "\n")
    # a plain search tells the texts that no pattern changes, far cheaper than the patterns
    return F.when(whole.contains("\n\n") | whole.contains("\n ") | whole.contains("  "), F.regexp_replace(x, r" {2,}", "")).otherwise(whole)


def _delimiter_regex(delimiters: Iterable[str]) -> str:
    out = []
    for d in delimiters:
        out.append("".join("\\n" if ch == "\n" else ("\\" + ch if ch in ".?!|()[]{}^$*+\\" else ch) for ch in d))
    return "|".join(out)


def split_sentences(col, delimiters: Iterable[str] = SENTENCE_DELIMITERS) -> Column:
    """Split at any delimiter (leftmost match, limit -1: empty pieces kept)."""
    return F.split(_c(col), _delimiter_regex(delimiters), -1)


# The default pattern's complement, to split on: gives the same maximal runs as
# matching TOKEN_PATTERN, but Java's regex engine is several times faster at it.
NON_TOKEN_CHARS = r"[^\p{L}\p{N}_]+"


def tokenize(col, pattern: str = TOKEN_PATTERN, lowercase: bool = True) -> Column:
    """Tokens of a text: all matches of ``pattern`` (after lower-casing)."""
    x = F.lower(_c(col)) if lowercase else _c(col)
    if pattern == TOKEN_PATTERN:
        return F.filter(F.split(x, NON_TOKEN_CHARS, -1), lambda t: F.length(t) >= 2)
    return F.regexp_extract_all(x, F.lit(pattern), 0)


#: Code points, and the odd base of the sums that make a code of a word.
_POINTS, _BASE = 0x110000, 0x9E3779B97F4A7C15 | 3
_characters: dict[tuple, np.ndarray] = {}


def characters(spark: SparkSession, pattern: str) -> np.ndarray:
    """For every code point whether the class ``pattern`` takes it: asked of the JVM, whose classes are not Python's."""
    key = (spark.sparkContext.applicationId, pattern)
    if key not in _characters:
        one = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
        taken = np.zeros(_POINTS, bool)
        surrogate = F.col("id").between(0xD800, 0xDFFF)
        taken[spark.range(_POINTS).where(~surrogate).where(one.rlike(f"^{pattern}$")).toArrow()["id"].to_numpy()] = True
        _characters[key] = taken
    return _characters[key]


def token_characters(spark: SparkSession) -> np.ndarray:
    """The code points of TOKEN_PATTERN."""
    return characters(spark, TOKEN_PATTERN[:-4])


def word_codes(taken: np.ndarray):
    """`tokenize` of many lower-cased texts at once: a function of a list of texts (or None) that gives the number of tokens of
    each, and for every token a 64-bit code that tells words apart as ``xxhash64`` does (V words share one with about V^2 / 2^65).

    A word's code is a sum over its characters of a random number a character times the base to the power of its place,
    taken from running sums over all texts: nothing is done word by word."""
    drawn = np.random.default_rng(7).integers(0, 1 << 64, _POINTS, np.uint64)
    inverse = pow(_BASE, -1, 1 << 64)
    powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def grown(n: int) -> list[np.ndarray]:
        if len(powers[0]) < n:
            for i, b in enumerate((_BASE, inverse)):
                steps = np.full(n, b, np.uint64)
                steps[0] = 1
                powers[i] = np.multiply.accumulate(steps)
        return powers

    def run(texts: list) -> tuple[np.ndarray, np.ndarray]:
        texts = [x or "" for x in texts]
        point = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        word = taken[point]
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        first, last = edge[::2], edge[1::2]
        long = last - first >= 2
        first, last = first[long], last[long]
        up, down = grown(len(point))
        sums = np.zeros(len(point) + 1, np.uint64)
        np.cumsum(drawn[point] * up[:len(point)], out=sums[1:])
        code = (sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64)
        code = (code ^ (code >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        code ^= code >> np.uint64(32)
        starts = np.cumsum([1, *(len(x) + 1 for x in texts)])
        return np.diff(np.searchsorted(first, starts)), code.view(np.int64)
    return run


def tag_of(token: Column) -> Column:
    """Text after the last '/' of a 'surface/TAG' token, trailing ';' removed."""
    tag = F.substring_index(token, "/", -1)
    return F.when(tag.contains(";"), F.regexp_replace(tag, ";$", "")).otherwise(tag)


def filter_tags(tokens, tags: Iterable[str] = KEPT_TAGS) -> Column:
    """I4: keep 'surface/TAG' tokens whose tag is in ``tags``."""
    allowed = [t.rstrip(";") for t in tags]
    return F.filter(_c(tokens), lambda t: tag_of(t).isin(*allowed))


def noun_filter(tokens) -> Column:
    """Keep tokens tagged NN*."""
    return F.filter(_c(tokens), lambda t: tag_of(t).startswith("NN"))


def is_numeric_text(s: Column) -> Column:
    # a word that begins with a letter is none, but for nan and inf: one plain pattern tells most
    return F.when(s.rlike("^[A-HJ-MO-Za-hj-mo-z]"), F.lit(False)).otherwise(F.translate(s, ",", "").rlike(NUMERIC_TOKEN))


def drop_numeric_tokens(tokens) -> Column:
    """Drop tokens whose part before the first '/' (commas removed) is a number."""
    return F.filter(_c(tokens), lambda t: ~is_numeric_text(F.substring_index(t, "/", 1)))


def join_tokens(tokens, sep: str = " ") -> Column:
    """Tokens -> one string."""
    return F.array_join(_c(tokens), sep)


# Fixed value: markup pattern removed from review text (tags, lower-case entities).
MARKUP_PATTERN = r"<.*?>|&([a-z0-9]+|#[0-9]{1,6}|#x[0-9a-f]{1,6});"


def strip_markup(col) -> Column:
    """Remove tags ``<...>`` (within a line) and character entities."""
    return F.regexp_replace(_c(col), MARKUP_PATTERN, "")


def remove_stopwords(tokens, stopwords: Iterable[str]) -> Column:
    """I8: drop whole tokens found in the stop list (order and repeats kept)."""
    stop = list(stopwords)
    return F.filter(_c(tokens), lambda t: ~t.isin(*stop))


def ngrams(tokens, n: int = 2) -> Column:
    """Space-joined n-grams of consecutive tokens."""
    t = _c(tokens)
    if n == 1:
        return t
    # zip shifted slices: the token array is only referenced outside the
    # lambdas, so it is evaluated n times per row, not once per n-gram
    m = F.greatest(F.size(t) - n + 1, F.lit(0))
    g = F.slice(t, 1, m)
    for j in range(1, n):
        g = F.zip_with(g, F.slice(t, j + 1, m), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(t) >= n, g).otherwise(F.array().cast("array<string>"))


def uni_and_bigrams(tokens) -> Column:
    """Unigrams followed by bigrams (ngram range (1, 2))."""
    return F.concat(_c(tokens), ngrams(tokens, 2))


def keyword_in_name(col, keyword: str) -> Column:
    """Substring test."""
    return _c(col).contains(keyword)
