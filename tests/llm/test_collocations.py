"""Operator 11 against a plain count of all n-grams."""

import collections
import random
import re

from notedrift.llm import collocations

SHAPE = "doc_id long, text string, lang string, words int, hash int, n int, a int, f int"


def brute(rows, min_count, longest, share, top):
    counts, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    counts[lang, tuple(words[i:i + m])] += 1
    cands = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= min_count}
    best = collections.Counter()
    for (lang, p), a in cands.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                best[lang, p[i:i + m]] = max(best[lang, p[i:i + m]], a)
    out = collections.defaultdict(list)
    for (lang, p), a in cands.items():
        if 100 * best[lang, p] >= share * a and best[lang, p]:
            continue
        cuts = [(1000000 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, own in out.items()
                  for i, (s, a, p, left, right) in enumerate(sorted(own)[:top], 1))


def corpus():
    rng = random.Random(5)
    words = ["The", "new", "york", "stock", "é", "Ä", "x1", "中文", "a", " b"]
    texts = [(rng.choice(["", " ", "\t"]) + "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "; "]) for _ in range(rng.randint(0, 80))), rng.choice(["en", "de", None, ""]))
             for _ in range(120)]
    # empty, null, repeated and very long texts, a text that is one word, pieces that end with a text
    return texts + [(None, "en"), ("", "en"), (None, None), ("new york stock", "en"), ("new york", "de")] * 12 + [("New york " * 5000, "en"), ("z" * 100000, "en"), ("...,,,", "fr")]


def run(spark, rows, **options):
    df = spark.createDataFrame([(i % 7, t, g, 1, 1, 1, 1, 1) for i, (t, g) in enumerate(rows)], SHAPE).repartition(4)
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in collocations.collocations(df, **options).collect())


def test_collocations_equal_brute_force(spark):
    rows = corpus()
    want = brute(rows, 10, 3, 50, 2000)
    assert {x[0] for x in want} >= {"en", "de", "und", ""}
    assert run(spark, rows) == want
    # words known by hashes alone give the same rows
    assert run(spark, rows, most_codes=0) == want


def test_collocations_of_other_orders(spark):
    rows = corpus()
    assert run(spark, rows, longest=4, min_count=5, share=80, top=30) == brute(rows, 5, 4, 80, 30)
    assert run(spark, rows, longest=2, min_count=20) == brute(rows, 20, 2, 50, 2000)


def test_collocations_of_empty_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, None), ("one two", "en")]) == []


def test_score_of_counts_beyond_64_bits(spark):
    from pyspark.sql import functions as F
    a = 3_000_000_000_000
    cut = spark.createDataFrame([(a, a + 7, a + 9)], "a long, l long, r long").select(*[F.col(c).cast("decimal(18,0)").alias(c) for c in "alr"])
    got = cut.select(F.expr("(cast(1000000 as decimal(7,0)) * a * a) div (l * r)").cast("long")).first()[0]
    assert got == 1000000 * a * a // ((a + 7) * (a + 9))


def test_collision_is_seen_and_hashed_anew(spark, monkeypatch):
    """Two words share a hash under the first function: the next one is taken."""
    real, seeds = collocations.text_words, []

    def clash(data, bounds, seed):
        h, *rest = real(data, bounds, seed)
        seeds.append(seed)
        if seed == 0:
            h[:] = 1
        return (h, *rest)
    rows = [("new york new york", "en")] * 20
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows]), pa.array([g for _, g in rows])], names=["text", "lang"])
    monkeypatch.setattr(collocations, "text_words", clash)
    found = next(collocations._vocabulary(0)(iter([batch]))).to_pylist()
    assert len({r["hash"] for r in found}) == 1
    found = next(collocations._vocabulary(1)(iter([batch]))).to_pylist()
    assert sorted((r["word"], r["n"]) for r in found) == [("new", 40), ("york", 40)]
