"""Operator 4: personal data by candidate gradient boosting, DataFrame functions only.

High-recall generators propose overlapping spans: the four base kinds (email,
ip, card, phone) by their formats, and two wide generators (``mail`` for written
addresses with @, (at) or [at]; ``number`` for any run of digits and separators).
Each wide candidate is described by a few small integers about its format and
context.  Boosted trees are fitted on the table of distinct descriptions with
their counts, aggregated over all candidates of all rows (bounded by the product
of the features' ranges, whatever the corpus size): a description's target is
the share of its candidates that are valid in a base format.  Neither the plus
sign of phones nor the @ of addresses is a feature, so near misses of a format
score like it.  The threshold of each generator is calibrated on the same
counts: the least score from which on ``PRECISION`` of the candidates are valid,
and at which a candidate alone is valid with a probability of ``LIKELY``.

Base spans always stay; a wide candidate is added if its score reaches the
threshold and it overlaps no base span.

Defined results: places are code points, ends exclusive; a null text is the
empty text and has no span; repeated rows are separate rows; without any valid
candidate nothing is added; an empty table gives an empty table.

The regular expressions match exactly what the stated formats match; loops are
possessive, and a look-behind (or the end of the last match) keeps a search
from starting inside a run it has already failed on, so the time is linear.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "mail", "number")
#: Fixed formats of the base kinds.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?+[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
MAIL = (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++"
        r"(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)++")
NUMBER = r"\+?[(]?[0-9](?:[ ().-]{0,3}+[0-9])++"
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
PRECISION, LIKELY = 0.95, 0.9
ROUNDS, RATE, LAMBDA = 30, 0.3, 1.0
FEATURES = ("generator", "digits", "dots", "round", "dash", "blank", "luhn", "quad", "stuck", "named", "tail")


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once: lambdas would compute it again for every element."""
    return F.transform(F.array(value), use)[0]


def found(text: Column, regex: str) -> Column:
    """All matches, left to right: array<struct<start, end, hit, before, after>>.

    Places are running sums of the lengths between and of the matches; they are
    summed in blocks of about the square root of their number.
    """
    both = F.struct(F.split(text, regex, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("hits"))

    def measured(b: Column) -> Column:
        n = F.size(b["hits"])
        sizes = F.zip_with(F.slice(b["gaps"], 1, n), b["hits"], lambda g, h: F.char_length(g) + F.char_length(h))
        return F.struct(b["gaps"].alias("gaps"), b["hits"].alias("hits"), sizes.alias("sizes"), n.alias("n"), F.ceil(F.sqrt(n)).cast("int").alias("width"))

    def total(values: Column, first: Column, count: Column) -> Column:
        return F.aggregate(F.slice(values, first, count), F.lit(0), lambda a, x: a + x)

    def placed(m: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.ceil(m["n"] / m["width"]).cast("int") - 1)
        sums = F.transform(blocks, lambda k: total(m["sizes"], k * m["width"] + 1, m["width"]))
        return let(F.struct(m.alias("m"), sums.alias("sums"), blocks.alias("blocks")), lambda s: F.flatten(F.transform(s["blocks"], lambda k: inside(s, k))))

    def inside(s: Column, k: Column) -> Column:
        m = s["m"]
        first = k * m["width"]
        count = F.least(m["width"], m["n"] - first)
        return let(F.struct(total(s["sums"], F.lit(1), k).alias("base"), F.slice(m["sizes"], first + 1, count).alias("sizes"),
                            F.slice(m["hits"], first + 1, count).alias("hits"), F.slice(m["gaps"], first + 1, count + 1).alias("gaps"), count.alias("n")),
                   lambda b: F.transform(F.sequence(F.lit(0), b["n"] - 1), lambda i: span(b, i)))

    def span(b: Column, i: Column) -> Column:
        end = b["base"] + total(b["sizes"], F.lit(1), i + 1)
        hit = F.get(b["hits"], i)
        return F.struct((end - F.char_length(hit)).alias("start"), end.alias("end"), hit.alias("hit"),
                        F.substring(F.get(b["gaps"], i), -24, 24).alias("before"), F.substring(F.get(b["gaps"], i + 1), 1, 1).alias("after"))

    none = F.array().cast("array<struct<start: int, end: int, hit: string, before: string, after: string>>")
    return let(both, lambda b: F.when(F.size(b["hits"]) == 0, none).otherwise(let(measured(b), placed)))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn sum (doubling every second digit from the right)."""
    values = F.transform(F.split(F.reverse(digits), "(?<=.)(?=.)"), lambda c, i: let(c.cast("int") * (1 + i % 2), lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _is_ip(hit: Column) -> Column:
    return hit.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")


def _is_card(hit: Column) -> Column:
    d = _digits(hit)
    return F.when(F.char_length(d).between(14, 19), luhn(d)).otherwise(False)


def _is_phone(hit: Column) -> Column:
    return F.char_length(_digits(hit)).between(10, 15)


def _kept(spans: Column, valid, kind: str) -> Column:
    good = F.filter(spans, lambda s: valid(s["hit"])) if valid else spans
    return F.transform(good, lambda s: F.struct(s["start"].cast("int").alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].cast("int").alias("end")))


_NONE = "array<struct<start: int, kind: int, end: int>>"


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end>> of the base kinds, kind as its number in KINDS, sorted."""
    digit = text.rlike("[0-9]")
    none = F.array().cast(_NONE)
    mail = F.when(F.contains(text, F.lit("@")), _kept(found(text, EMAIL), None, "email")).otherwise(none)
    rest = F.when(digit, F.concat(_kept(found(text, IP), _is_ip, "ip"), _kept(found(text, CARD), _is_card, "card"),
                                  F.when(F.contains(text, F.lit("+")), _kept(found(text, PHONE), _is_phone, "phone")).otherwise(none))).otherwise(none)
    return F.array_sort(F.concat(mail, rest))


def _mark(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def _described(spans: Column, generator: str) -> Column:
    """Candidates with features, and whether each is valid in a base format."""
    def one(s: Column) -> Column:
        def of(x: Column) -> Column:
            hit, digits = x["hit"], x["digits"]
            size = F.char_length(digits)
            common = {
                "generator": F.lit(KINDS.index(generator) - 4),
                "dots": F.least(F.char_length(hit) - F.char_length(F.replace(hit, F.lit("."), F.lit(""))), F.lit(4)),
                "stuck": _mark(x["before"].rlike(r"[\p{L}\p{N}_=\"'./-]$") | x["after"].rlike(r"[\p{L}\p{N}_\"'-]")),
                "named": _mark(F.lower(x["before"]).rlike(r"(?:tel|phone|mobile|call|fax|mail|contact|card|visa|credit|account|address|\bip)")),
            }
            if generator == "mail":
                own = {"digits": F.lit(0), "round": F.lit(0), "dash": F.lit(0), "blank": F.lit(0), "luhn": F.lit(0), "quad": F.lit(0), "tail": _mark(hit.rlike("[A-Za-z]{2,24}$"))}
                valid = hit.rlike(f"^{EMAIL}$")
            else:
                own = {"digits": F.when(size < 10, 0).when(size == 10, 1).when(size <= 12, 2).when(size == 13, 3).when(size <= 15, 4).when(size == 16, 5).when(size <= 19, 6).otherwise(7),
                       "round": _mark(F.contains(hit, F.lit("("))), "dash": _mark(F.contains(hit, F.lit("-"))), "blank": _mark(F.contains(hit, F.lit(" "))),
                       "luhn": _mark(F.when(size.between(8, 19), luhn(digits)).otherwise(False)), "quad": _mark(_is_ip(hit)), "tail": F.lit(0)}
                valid = _is_ip(hit) | (hit.rlike("^[0-9 -]+$") & _is_card(hit)) | (hit.startswith("+") & _is_phone(hit))
            values = common | own
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), *(values[f].cast("int").alias(f) for f in FEATURES), valid.alias("valid"))

        return let(F.struct(s["hit"].alias("hit"), s["before"].alias("before"), s["after"].alias("after"), _digits(s["hit"]).alias("digits")), of)

    return F.transform(spans, one)


def candidates(text: Column) -> Column:
    """Wide candidates of a text with their descriptions."""
    kind = "array<struct<start: int, end: int, " + ", ".join(f"{f}: int" for f in FEATURES) + ", valid: boolean>>"
    none = F.array().cast(kind)
    mail = F.when(text.rlike(r"@|[(\[]at[)\]]"), _described(found(text, MAIL), "mail")).otherwise(none)
    number = F.when(text.rlike("[0-9]"), _described(F.filter(found(text, NUMBER), lambda s: F.char_length(_digits(s["hit"])) >= 7), "number")).otherwise(none)
    return F.concat(mail.cast(kind), number.cast(kind))


class Trees:
    """Boosted trees of depth two over small integer features, as plain numbers."""

    def __init__(self, base: float, trees: list, thresholds: dict[int, float]):
        self.base, self.trees, self.thresholds = base, trees, thresholds

    def score(self, c: Column) -> Column:
        """Log odds of a described candidate."""
        out = F.lit(self.base)
        for (f, v), (left, right) in self.trees:
            side = lambda s: F.when(c[s[0]] <= s[1], s[2]).otherwise(s[3])
            out = out + F.when(c[f] <= v, side(left)).otherwise(side(right))
        return out

    def selects(self, c: Column) -> Column:
        chosen = F.lit(False)
        for g, t in self.thresholds.items():
            chosen = chosen | ((c["generator"] == g) & (self.score(c) >= t))
        return chosen


def _best_split(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray) -> tuple[int, int, np.ndarray]:
    best = (-1.0, 0, 0)
    for f in range(x.shape[1]):
        for v in np.unique(x[rows, f])[:-1]:
            left = rows & (x[:, f] <= v)
            right = rows & ~left
            gain = g[left].sum() ** 2 / (h[left].sum() + LAMBDA) + g[right].sum() ** 2 / (h[right].sum() + LAMBDA)
            if gain > best[0]:
                best = (gain, f, int(v))
    return best[1], best[2], rows & (x[:, best[1]] <= best[2])


def boost(x: np.ndarray, good: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> Trees:
    """Logistic boosting on descriptions ``x`` with ``good`` of ``n`` valid candidates each."""
    if not len(x) or not good.sum():
        return Trees(0.0, [], {})
    rate = (good.sum() + 0.5) / (n.sum() + 1.0)
    base = float(np.log(rate / (1 - rate)))
    score, trees = np.full(len(x), base), []
    every = np.ones(len(x), bool)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = n * p - good, np.maximum(n * p * (1 - p), 1e-9)
        f, v, low = _best_split(x, g, h, every)
        sides = []
        for rows in (low, ~low):
            ff, vv, inner = _best_split(x, g, h, rows)
            leaves = []
            for leaf in (inner, rows & ~inner):
                value = float(-RATE * g[leaf].sum() / (h[leaf].sum() + LAMBDA))
                score[leaf] += value
                leaves.append(value)
            sides.append((FEATURES[ff], vv, *leaves))
        trees.append(((FEATURES[f], v), tuple(sides)))
    thresholds = {}
    for gen in np.unique(x[:, 0]).tolist():
        own = x[:, 0] == gen
        order = np.argsort(-score[own], kind="stable")
        s, share = score[own][order], np.cumsum(good[own][order]) / np.cumsum(n[own][order])
        whole = np.append(s[1:] < s[:-1], True)  # descriptions of one score stand or fall together
        fit = np.flatnonzero((share >= PRECISION) & whole)
        if len(fit):
            thresholds[int(gen)] = max(float(s[fit[-1]]), float(np.log(LIKELY / (1 - LIKELY)))) - 1e-9
    return Trees(base, trees, thresholds)


def train(rows: DataFrame, text_col: str = "text") -> Trees:
    """Trees fitted on the counts of all candidates by description."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    each = rows.select(F.explode(candidates(text)).alias("c")).select("c.*")
    table = each.groupBy(*FEATURES).agg(F.count("*").alias("n"), F.sum(F.col("valid").cast("long")).alias("good")).orderBy(*FEATURES).collect()
    x = np.array([[r[f] for f in FEATURES] for r in table], np.int64).reshape(-1, len(FEATURES))
    return boost(x, np.array([r["good"] for r in table], float), np.array([r["n"] for r in table], float))


def all_spans(text: Column, trees: Trees) -> Column:
    """struct<base, spans>: the base spans, and these with the selected candidates, sorted."""
    def both(base: Column) -> Column:
        free = lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
        chosen = F.filter(candidates(text), lambda c: trees.selects(c) & free(c)) if trees.thresholds else None
        more = F.transform(chosen, lambda c: F.struct(c["start"].alias("start"), (c["generator"] + 4).alias("kind"), c["end"].alias("end"))) if chosen is not None else F.array().cast(_NONE)
        return F.struct(base.alias("base"), F.array_sort(F.concat(base, more)).alias("spans"))

    return let(base_spans(text), both)


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(rows: DataFrame, trees: Trees, text_col: str = "text", into: str = "pii") -> DataFrame:
    """All rows and columns with ``into``: struct<base, spans> added (a column of that name is replaced)."""
    return rows.withColumn(into, all_spans(F.coalesce(F.col(text_col), F.lit("")), trees))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def cut(s: Column) -> Column:
        before = F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.coalesce(F.array_max(F.transform(F.slice(s, 1, i), lambda x: x["end"])), F.lit(0)))
        parts = F.zip_with(s, before, lambda x, e: F.when(x["start"] >= e, F.concat(text.substr(e + 1, x["start"] - e), F.get(names, x["kind"]))).otherwise(""))
        return F.concat(F.array_join(parts, ""), text.substr(F.array_max(F.transform(s, lambda x: x["end"])) + 1, F.char_length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(let(spans, cut))
