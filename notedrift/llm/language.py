"""Operator 2: language identification by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior over the languages:

* the text: log-likelihood of its letter trigrams under counts per language;
* the declared markup language: probability of the declared value given the language;
* the address suffix: probability of the host's last label given the language;
* the host: a prior smoothed from the host to its domain to all rows.

All tables are grouped aggregates over every row.  Trigram counts start from
the declared values (noisy labels); the other tables count the text's own
posterior.  Trigrams are hashed to ``BUCKETS``, so the model is bounded; suffixes
beyond the ``SUFFIXES`` most frequent carry no evidence.

A row is accepted if the best posterior is at least ``least`` and its text has a
trigram with a letter and is on average likelier under the best language than
under chance (a uniform draw of buckets).  Rows that are not accepted have the
language "und".

Defined results: a null or empty text, or one without letters, is not accepted;
null declared values, hosts and suffixes are no evidence; of equal posteriors
the first language by name wins; rows may repeat; an empty table gives an empty
table.  Columns of the result never clash: the verdict is one struct column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .skew import join_even
from .textops import mix64, text_slices
from .vocab import LETTER, class_table, code_points, lower_table

LANGUAGES = ("de", "en", "es", "fr")
BUCKETS = 1 << 16
#: Trigrams count as at most so many independent ones, for they are not.
INDEPENDENT = 200
#: Pseudo-counts with which a host and a domain are drawn to the level above.
STRENGTH = 20.0
LEAST = 0.5


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the letter trigrams of all texts and the bounds of each text in them."""
    joined = code_points("   ".join(["", *texts, ""]))
    letters = class_table()[joined] == LETTER
    low = np.where(letters, lower_table()[joined], 0x20).astype(np.uint64)
    code = low[:-2] | (low[1:-1] << np.uint64(21)) | (low[2:] << np.uint64(42))
    real = letters[:-2] | letters[1:-1] | letters[2:]
    at = np.flatnonzero(real)
    buckets = (mix64(code[at]) >> np.uint64(48)).astype(np.int64)
    sizes = np.array([len(t) + 3 for t in texts], np.int64)
    # a text's trigrams start from the second of the blanks before it
    return buckets, np.searchsorted(at, 1 + np.concatenate(([0], np.cumsum(sizes))))


def _counter(languages: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS), np.int64)
        place = {l: i for i, l in enumerate(languages)}
        for batch in batches:
            declared = batch.column("declared").to_pylist()
            for lo, hi, texts in text_slices(batch.column("text")):
                buckets, bounds = trigrams(texts)
                of = np.array([place.get(d, -1) for d in declared[lo:hi]], np.int64)
                each = np.repeat(of, np.diff(bounds))
                known = each >= 0
                inside = buckets[bounds[0]:bounds[-1]]
                total += np.bincount(each[known] * BUCKETS + inside[known], minlength=total.size).reshape(total.shape)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at // BUCKETS, pa.int32()), pa.array(at % BUCKETS, pa.int32()), pa.array(total.ravel()[at], pa.int64())],
                                         names=["language", "bucket", "n"])
    return run


def declared_language(value: Column) -> Column:
    """Primary subtag of a declared value such as ``en-GB``, lower case."""
    return F.regexp_extract(F.lower(F.trim(value)), "^([a-z]{2,3})(?:[-_].*)?$", 1)


def html_language(html: Column) -> Column:
    """The value of the lang attribute of the first html element, however long its tag is."""
    tag = F.regexp_extract(html, r"""(?i)<html\b((?:[^>"']++|"[^"]*+"|'[^']*+')*+)""", 1)
    return F.regexp_extract(tag, r"""(?i)\slang\s*=\s*["']?([A-Za-z_-]+)""", 1)


def address_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


class Model:
    """Trigram log-likelihoods: one bounded array."""

    def __init__(self, languages: tuple[str, ...], counts: np.ndarray):
        self.languages = languages
        self.table = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)).astype(np.float32)

    def likelihood(self, text: Column) -> Column:
        """struct<n, mean>: trigrams of the whole text and their mean log-likelihood by language."""
        table, width = self.table, len(self.languages)

        @F.arrow_udf("struct<n: bigint, mean: array<double>>")
        def run(column: pa.Array) -> pa.Array:
            ns, means = [], []
            for _, _, texts in text_slices(column):
                buckets, bounds = trigrams(texts)
                n = np.diff(bounds)
                sums = np.stack([np.concatenate(([0.0], np.cumsum(table[k][buckets], dtype=np.float64))) for k in range(width)], axis=1)
                means.append((sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(n, 1)[:, None])
                ns.append(n)
            n = np.concatenate(ns) if ns else np.empty(0, np.int64)
            flat = np.concatenate(means).ravel() if means else np.empty(0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * width, pa.int32()), pa.array(flat, pa.float64()))
            return pa.StructArray.from_arrays([pa.array(n, pa.int64()), lists], names=["n", "mean"])

        return run(text)


def train(rows: DataFrame, text: str, declared: str, languages: tuple[str, ...] = LANGUAGES) -> Model:
    """Counts over all rows with a known declared language; at most languages x BUCKETS sums reach the driver."""
    own = rows.select(F.coalesce(F.col(text), F.lit("")).alias("text"), declared_language(F.col(declared)).alias("declared")).where(F.col("declared").isin(*languages))
    counts = np.zeros((len(languages), BUCKETS))
    for r in own.mapInArrow(_counter(languages), "language int, bucket int, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["language"], r["bucket"]] = r["n"]
    return Model(languages, counts)


def _text_posterior(likelihood: Column, width: int) -> list[Column]:
    weight = F.least(likelihood["n"], F.lit(INDEPENDENT))
    odds = [F.when(likelihood["n"] > 0, likelihood["mean"][k] * weight).otherwise(F.lit(0.0)) for k in range(width)]
    top = F.greatest(*odds)
    total = sum((F.exp(o - top) for o in odds[1:]), F.exp(odds[0] - top))
    return [F.exp(o - top) / total for o in odds]


def identify(rows: DataFrame, model: Model, text: str, declared: str | None, host: str | None, least: float = LEAST, verdict: str = "verdict") -> DataFrame:
    """All rows and columns, with ``verdict``: struct<language, probability, accepted> added.

    ``rows`` is read once.  A column of the name of
    ``verdict`` is replaced.
    """
    langs, width = model.languages, len(model.languages)
    p = [f"p{k}" for k in range(width)]
    names = [c for c in rows.columns if c != verdict]
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    value = declared_language(F.col(f"row.`{declared}`")) if declared else F.lit(None).cast("string")
    packed = (packed.withColumn("declared", F.when(value == "", None).when(value.isin(*langs), value).when(value.isNotNull(), "other"))
              .withColumn("host", F.coalesce(F.lower(F.col(f"row.`{host}`").cast("string")), F.lit("")) if host else F.lit(""))
              .withColumn("suffix", F.regexp_extract("host", r"\.([^.]+)$", 1))
              .withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)))
    body = F.coalesce(F.col(f"row.`{text}`"), F.lit(""))
    # the text is scored once: the rows are written with their likelihoods
    packed = materialize(packed.withColumn("t", model.likelihood(body)), "op2-scored")
    seen = (packed.select("declared", "host", "suffix", "domain", *(c.alias(n) for c, n in zip(_text_posterior(F.col("t"), width), p))))
    sums = [F.sum(c).alias(c) for c in p]
    # one row for each host and declared value (five or so a host)
    evidence = materialize(seen.groupBy("host", "domain", "suffix", "declared").agg(F.count("*").alias("n"), *sums), "op2-evidence")
    rolled = lambda *keys: evidence.groupBy(*keys).agg(F.sum("n").alias("n"), *sums)
    every = evidence.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *sums).first()
    total = every["n"]
    base = [((every[c] or 0.0) + 1.0) / (total + width) for c in p]

    # declared values: at most languages + 2 rows
    said = {r["declared"]: r for r in rolled("declared").where("declared is not null").collect()}
    shown = [sum(r[c] for r in said.values()) for c in p]
    values = [*langs, "other"]
    of_declared = {v: [((said[v][c] if v in said else 0.0) + 0.5) / (shown[k] + 0.5 * len(values)) for k, c in enumerate(p)] for v in values}

    # p(suffix | language) of every suffix
    suffixes = rolled("suffix").where("suffix != ''")
    suffixes = suffixes.select("suffix", *(F.log((F.col(c) + base[k]) / (every[c] + 1.0 if total else 1.0)).alias(f"s{k}") for k, c in enumerate(p)))

    def smoothed(above: list[Column]) -> list[Column]:
        return [(F.col(f"x.{c}") + STRENGTH * above[k]) / (F.col("x.n") + STRENGTH) for k, c in enumerate(p)]

    domains = rolled("domain").alias("x").select(F.col("x.domain"), *(c.alias(f"d{k}") for k, c in enumerate(smoothed([F.lit(b) for b in base]))))
    # a host has one domain and one suffix, so its row carries the evidence of all three
    hosts = (rolled("host", "domain", "suffix").alias("x").join(domains.alias("y"), F.col("x.domain") == F.col("y.domain"))
             .select(F.col("x.host"), F.col("x.suffix"), F.col("x.n"), *(F.log(c).alias(f"h{k}") for k, c in enumerate(smoothed([F.col(f"y.d{k}") for k in range(width)])))))
    hosts = materialize(hosts.join(suffixes, "suffix", "left").drop("suffix"), "op2-hosts")

    joined = join_even(packed.select("row", "declared", "host", "t"), hosts, "host", "n", total)
    odds = []
    for k in range(width):
        declared_odds = F.lit(0.0)
        for v in values:
            declared_odds = F.when(F.col("declared") == v, F.lit(float(np.log(of_declared[v][k])))).otherwise(declared_odds)
        text_odds = F.when(F.col("t.n") > 0, F.col("t.mean")[k] * F.least(F.col("t.n"), F.lit(INDEPENDENT))).otherwise(0.0)
        odds.append((text_odds + declared_odds + F.coalesce(F.col(f"s{k}"), F.lit(0.0)) + F.col(f"h{k}")).alias(f"o{k}"))
    scored = joined.select("row", "t", *odds).withColumn("top", F.greatest(*(F.col(f"o{k}") for k in range(width))))
    best = F.coalesce(*(F.when(F.col(f"o{k}") == F.col("top"), k) for k in range(width)))
    likely = F.lit(1.0) / sum((F.exp(F.col(f"o{k}") - F.col("top")) for k in range(1, width)), F.exp(F.col("o0") - F.col("top")))
    accepted = (likely >= least) & (F.col("t.n") > 0) & (F.element_at("t.mean", best + 1) > F.lit(-float(np.log(BUCKETS))))
    language = F.when(accepted, F.element_at(F.array(*(F.lit(l) for l in langs)), best + 1)).otherwise("und")
    return scored.select("row.*", F.struct(language.alias("language"), likely.alias("probability"), accepted.alias("accepted")).alias(verdict))
