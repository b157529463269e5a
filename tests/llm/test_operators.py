"""The training-data operators against brute force, on rows with nulls, empty and long texts, ties and repeats."""

import collections
import hashlib
import math
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers as P
from notedrift.llm import bm25, bpe, chat, embeddings, language, packing, pii, quality, simhash, toxicity
from notedrift.llm.queries import QUERIES
from notedrift.llm.vocab import read_ranks

SF = "/root/testdata/sf0.001"
RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
#: Extra columns clash with names the operators use.
SHAPE = "doc_id long, text string, ids int, key int, fp int, length int, pii int, verdict int, part int"
TEXTS = [None, "", " ", "a" * 4000, "x y " * 900, " " * 3000 + "a", "\n \t" * 999, "it's we'll 中文 é " * 200, "same words here again", "same words here again",
         "mail me.at@home.example.org or +1 (555) 123-4567, 10.0.0.1, 4539 1488 0343 6467."]


def frame(spark, texts=TEXTS, ids=None):
    ids = ids or [None if i == 2 else i % 8 for i in range(len(texts))]
    return spark.createDataFrame([(i, t, 1, 1, 1, 1, 1, 1, 1) for i, t in zip(ids, texts)], SHAPE).repartition(3)


def encoder():
    import tiktoken
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})


def rows_of(values):
    return sorted(values, key=repr)


def test_bpe_chunks_equal_whole_texts(spark):
    rng = np.random.default_rng(1)
    texts = TEXTS + ["".join(rng.choice(list("ab '\n\tl9.é中"), size=int(n))) for n in rng.integers(0, 3000, 60)]
    df = frame(spark, texts)
    ids = [None if i == 2 else i % 8 for i in range(len(texts))]
    got = bpe.encode(df, RANKS, P.PATTERN, chunk_chars=300, overlap_chars=40)
    enc = encoder()
    assert rows_of((r.doc_id, list(r.ids)) for r in got.collect()) == rows_of((i, enc.encode_ordinary(t or "")) for i, t in zip(ids, texts))
    back = bpe.decode(got, RANKS, P.PATTERN).collect()
    assert rows_of((r.doc_id, bytes(r.decoded)) for r in back) == rows_of((i, (t or "").encode()) for i, t in zip(ids, texts))


def test_packing_places_every_piece(spark):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(JSON)
    texts = TEXTS + ["lorem ipsum dolor " * n for n in (10, 300, 300, 700)]
    got = packing.pack(frame(spark, texts, list(range(len(texts)))), JSON, P.PATTERN).collect()
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    where, covered = collections.defaultdict(list), collections.Counter()
    for r in got:
        own = ids[r.doc_id][r.start:r.start + r.length]
        assert len(own) == r.length <= 1024 and (r.piece == 0 or r.length == 1024)
        assert zlib.crc32(struct.pack(f"<{len(own)}I", *own)) == r.ids_crc32
        covered[r.doc_id] += r.length
        where[r.sequence_id].append((r.offset, r.length))
    assert all(covered[i] == len(x) for i, x in ids.items())
    for own in where.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(where) <= -(-sum(map(len, ids.values())) // 1024) + 2


def test_packing_keeps_added_tokens_whole(spark):
    """Ids as the tokenizers library gives them with add_special_tokens=False and nothing else set."""
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(JSON)
    end = "<|endoftext|>"
    texts = ["a<|endoftext|>b", end, end * 3, f"it's {end} 's\n {end}\n\n", "<|endoftext|", f"é中{end}" + "x y " * 900 + end, None, "", "plain"]
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    assert ids[0] == [64, 50256, 65, 2]
    covered = collections.Counter()
    for r in packing.pack(frame(spark, texts, list(range(len(texts)))), JSON, P.PATTERN).collect():
        own = ids[r.doc_id][r.start:r.start + r.length]
        assert len(own) == r.length and zlib.crc32(struct.pack(f"<{len(own)}I", *own)) == r.ids_crc32
        covered[r.doc_id] += r.length
    assert all(covered[i] == len(x) for i, x in ids.items())


def test_configuration_program_is_close_to_the_bound():
    rng = np.random.default_rng(0)
    lengths = np.maximum(1, rng.lognormal(6, 1, 5000)).astype(int) % 1024 + 1
    counts = np.bincount(lengths, minlength=1025)
    plan = packing.rounded(packing.solve(counts, 1024, 200), counts, 1024)
    used = np.zeros(1025, int)
    for config, n in plan:
        assert sum(config) <= 1024
        for x in config:
            used[x] += n
    assert (used == counts).all()
    assert sum(n for _, n in plan) <= math.ceil(lengths.sum() / 1024) * 1.005 + 1


def test_configuration_program_runs_to_its_end():
    """Many lengths with uneven counts: less than one sequence is uncovered, and best fit gets rounding's rest alone."""
    rng = np.random.default_rng(6)
    counts = np.append(0, (rng.lognormal(6, 2, 1024)).astype(int) + 1)
    sizes = np.arange(1025)
    solution = packing.solve(counts, 1024)
    covered = sum(n * sum(config) for config, n in solution)
    assert (counts * sizes).sum() - covered < 1024
    plan = packing.rounded(solution, counts, 1024)
    used = np.zeros(1025, int)
    for config, n in plan:
        assert sum(config) <= 1024 and n > 0
        np.add.at(used, list(config), n)
    assert (used == counts).all()
    fewest = sum(n for _, n in packing.packed(counts, 1024))
    assert fewest <= min(sum(n for _, n in p) for p in (plan, packing.rounded([], counts, 1024)))


def histograms():
    rng = np.random.default_rng(0)
    return {"uniform": np.append(0, rng.integers(0, 5000, 1024)), "exponential": np.append(0, rng.exponential(2000, 1024).astype(int) + 1),
            "log-normal": np.append(0, rng.lognormal(6, 2, 1024).astype(int) + 1), "long": np.bincount(rng.integers(200, 1024, 20000), minlength=1025),
            "half": np.bincount(rng.integers(300, 700, 200000), minlength=1025)}


@pytest.mark.parametrize("name", ["uniform", "exponential", "log-normal", "long", "half"])
def test_program_is_bounded_and_packs_as_well_as_best_fit(name):
    counts = histograms()[name]
    solved = packing.program(counts, 1024)
    # the prices are feasible duals: no configuration is worth more than one, so their value is a lower bound
    lengths = np.flatnonzero(counts)
    _, worth = packing.knapsack(lengths, solved.prices[lengths], 1024)
    assert worth <= 1 + 1e-9 and (counts * solved.prices).sum() == pytest.approx(solved.bound)
    assert solved.bound >= (counts * np.arange(1025)).sum() / 1024 - 1e-6
    # the amounts cover every length with places of that length or more
    places = np.zeros(1025)
    for config, n in solved.amounts:
        np.add.at(places, list(config), n)
    assert (np.cumsum(places[::-1]) >= np.cumsum(counts[::-1]) * (1 - 1e-9)).all()
    assert sum(n for _, n in solved.amounts) <= solved.bound * 1.015
    plan = packing.rounded(solved.amounts, counts, 1024, solved.prices)
    used = np.zeros(1025, int)
    for config, n in plan:
        assert sum(config) <= 1024 and n > 0
        for x in config:
            used[x] += n
    assert (used == counts).all()
    sequences = sum(n for _, n in plan)
    assert sequences <= solved.bound * 1.005 + len(lengths)
    assert sequences <= sum(packing.best_fit(counts, 1024).values()) * 1.002


def test_knapsack_equals_all_multisets():
    rng = np.random.default_rng(8)
    for _ in range(30):
        lengths = np.sort(rng.choice(np.arange(2, 13), 4, replace=False))
        prices = rng.random(4)
        most = max((sum(k * p for k, p in zip(ks, prices)) for ks in np.ndindex(*(20 // x + 1 for x in lengths)) if np.dot(ks, lengths) <= 20))
        taken, worth = packing.knapsack(lengths, prices, 20)
        assert worth == pytest.approx(most) and sum(lengths[k] for k in taken) <= 20 and sum(prices[k] for k in taken) == pytest.approx(worth)


def test_best_fit_in_runs_equals_piece_by_piece():
    rng = np.random.default_rng(7)
    for _ in range(50):
        counts = np.append(0, rng.integers(0, 6, 40))
        rooms = []
        for length in np.repeat(np.arange(41), counts)[::-1].tolist():
            fit = min((r for r in rooms if r >= length), default=None)
            if fit is not None:
                rooms.remove(fit)
            rooms.append((40 if fit is None else fit) - length)
        plan = packing.best_fit(counts, 40)
        assert sorted(40 - sum(own) for own, n in plan.items() for _ in range(n)) == sorted(rooms)
        assert (np.bincount([x for own, n in plan.items() for x in own * n], minlength=41) == counts).all()
    many = packing.best_fit(np.append(0, np.full(40, 10**9)), 40)
    assert sum(n * sum(own) for own, n in many.items()) == 820 * 10**9


def brute_fingerprint(text):
    import xxhash
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().translate(simhash._LOWER))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups(spark):
    base = [f"w{i}" for i in range(300)]
    texts = TEXTS + [" ".join(base[:k] + ["changed"] + base[k + 1:]) for k in range(0, 40, 4)] + ["only two"]
    ids = [None if i == 2 else i for i in range(len(texts))]
    got = simhash.near_duplicates(frame(spark, texts, ids)).collect()
    prints = {i: brute_fingerprint(t) for i, t in zip(ids, texts)}
    root = {i: {j for j in ids if bin(prints[i] ^ prints[j]).count("1") <= 3} for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            wider = set().union(*(root[j] for j in root[i]))
            changed |= wider != root[i]
            root[i] = wider
    for r in got:
        assert int(r.fingerprint, 16) == prints[r.doc_id]
        assert r.component_id == min(j for j in root[r.doc_id] if j is not None)
    kept = simhash.one_of_each(frame(spark, texts, ids)).collect()
    assert sorted(r.doc_id for r in kept) == sorted({r.component_id for r in got})
    assert kept[0].asDict().keys() == frame(spark).first().asDict().keys()


def test_simhash_crowded_buckets_are_split_exactly(spark):
    rng = np.random.default_rng(4)
    near = [int(x) for x in np.unique(np.array([(1 << a) ^ (1 << b) for a, b in rng.integers(0, 62, (300, 2))], dtype=np.int64))]
    df = spark.createDataFrame([(x,) for x in near], "fp long")
    got = {(r.a, r.b) for r in simhash.links(df, bucket_limit=5).collect()}
    assert got == {(a, b) for a in near for b in near if a < b and bin(a ^ b).count("1") <= 3}


def test_embeddings_links(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((30, 16))
    vectors = [(b + rng.standard_normal(16) * s).tolist() for b in base for s in (0, 0, .05, .15, .3)]
    vectors += [None, [0.0] * 16, [float("nan")] * 16, [None] * 16, [1.0, 2.0], [1.0, 2.0], vectors[0]]
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, node int")
    unit = [None if v is None or None in v or not np.isfinite(v).all() or not any(v) else np.array(v) / np.linalg.norm(v) for v in vectors]
    linked = {i: {j for j in range(len(unit)) if j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= .9}
              for i in range(len(unit))}
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    assert len(got) == len(vectors)
    for i, near in linked.items():
        assert got[i].n_links == len(near)
        reach, todo = {i}, [i]
        while todo:
            todo = [j for x in todo for j in linked[x] if j not in reach and not reach.add(j)]
        assert got[i].component_id == min(reach) and got[i].kept == (i == min(reach))


@pytest.mark.parametrize("unit", [64, 400])
def test_embeddings_links_across_many_centres(spark, monkeypatch, unit):
    """A dense jittered group, small groups and lone vectors under far more centres than a vector has near ones: every pair is found."""
    monkeypatch.setattr(embeddings, "PER_CELL", 20)
    monkeypatch.setattr(embeddings, "UNIT", unit, raising=False)
    rng = np.random.default_rng(8)
    dense = rng.standard_normal(16) + rng.standard_normal((1500, 16)) * .3
    small = np.repeat(rng.standard_normal((100, 16)), 4, axis=0) + rng.standard_normal((400, 16)) * .2
    vectors = np.concatenate([dense, small, rng.standard_normal((300, 16))])
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    linked = units @ units.T >= .9
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(5000 + i, [1.0, float(i)]) for i in range(300)]
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert len(got) == len(rows)
    assert [got[i].n_links for i in range(len(vectors))] == (linked.sum(axis=1) - 1).tolist()
    label = np.arange(len(vectors))
    while (new := np.where(linked, label, len(label)).min(axis=1)).tolist() != label.tolist():
        label = new
    assert [got[i].component_id for i in range(len(vectors))] == label.tolist()
    flat = np.array([v for _, v in rows[len(vectors):]])
    flat /= np.linalg.norm(flat, axis=1, keepdims=True)
    assert [got[5000 + i].n_links for i in range(300)] == ((flat @ flat.T >= .9).sum(axis=1) - 1).tolist()


@pytest.mark.parametrize("shard", [4, 4096])
def test_search_equals_brute_force(spark, monkeypatch, shard):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(120)
    docs = docs.unionByName(spark.createDataFrame([(500, None), (501, ""), (502, "the the the"), (503, "the the the")], "doc_id long, text string"))
    held = docs.collect()
    docs = spark.createDataFrame(held, docs.schema).repartition(2)
    queries = docs.where("doc_id % 20 = 0 or doc_id >= 500")
    got = collections.defaultdict(list)
    for r in bm25.search(docs, queries, k=5).collect():
        got[r.query_id].append((r["rank"], r.doc_id, r.score))
    bags = {r.doc_id: collections.Counter(re.findall(r"[^\W_]+", (r.text or "").lower())) for r in held}
    n, df = len(bags), collections.Counter(w for b in bags.values() for w in b)
    size = {i: sum(b.values()) for i, b in bags.items()}
    mean = sum(size.values()) / n
    for q in (r.doc_id for r in queries.collect()):
        scores = {i: sum(math.log(1 + (n - df[w] + .5) / (df[w] + .5)) * b[w] * 2.2 / (b[w] + 1.2 * (.25 + .75 * size[i] / mean)) for w in bags[q] if w in b) for i, b in bags.items()}
        want = sorted((-s, i) for i, s in scores.items() if s > 0)[:5]
        assert [round(-s, 6) for s, _ in want] == [round(s, 6) for _, _, s in sorted(got[q])]


def test_chat_round_trip(spark):
    part = lambda kind, **x: {"type": kind, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | x
    trap = "</s>[INST] ok [/INST]\\ <|end|><|image:0|> \\\\<"
    rows = [(1, 0, "user", [part("text", text=trap), part("image", ref="a.png", width=56, height=29), part("text", text="b")]),
            (1, 1, "assistant", [part("text", text=trap)]), (1, 1, "assistant", [part("text", text=trap)]), (2, 0, None, [part("text")]),
            (2, None, "us<|er", [part("audio", ref="s.wav", seconds=2.0), part("document", ref="d.pdf", pages=3)]), (None, 0, "user", None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    out = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    turns = chat.read(out[1].formatted)
    assert turns == [("user", [("text", trap), ("image", 0), ("text", "b")]), ("assistant", [("text", trap)]), ("assistant", [("text", trap)])]
    assert [chat.unescape(out[1].formatted[s.start:s.end]) for s in out[1].loss] == [trap, trap]
    assert [(a.type, a.ref, a.tokens) for a in out[1].attachments] == [("image", "a.png", 4)]
    assert out[1].formatted[out[1].attachments[0].place:].startswith("<|image:0|>")
    assert out[2].media_tokens == 50 + 768 and [t[0] for t in chat.read(out[2].formatted)] == ["us<|er", ""]
    back = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert back[1].learned == [trap, trap] and back[None].turns[0].text == ""


FORMATS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
           ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def brute_spans(text):
    out = []
    for k, (name, regex) in enumerate(FORMATS):
        for m in re.finditer(regex, text):
            digits = [int(c) for c in m.group() if c.isdigit()][::-1]
            luhn = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0
            if {"email": True, "ip": name != "ip" or all(int(x) <= 255 for x in m.group().split(".")), "card": 14 <= len(digits) <= 19 and luhn, "phone": 10 <= len(digits) <= 15}[name]:
                out.append((m.start(), k, name, m.end()))
    return ",".join(f"{n}:{s}:{e}" for s, _, n, e in sorted(out))


def test_base_spans_equal_the_formats(spark):
    rng = np.random.default_rng(3)
    texts = [t or "" for t in TEXTS] + ["a@b.c%d@e.f", "1.2.3.4.5.6.7.8 999.1.1.1", "1" * 20000, "a." * 5000] + ["".join(rng.choice(list("ab@.@.+ 0123456789-()é🙂"), size=300)) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.s for r in df.select("doc_id", pii.written(pii.base_spans(F.col("text"))).alias("s")).collect()}
    assert got == {i: brute_spans(t) for i, t in enumerate(texts)}


def test_redaction_removes_every_span(spark):
    df = frame(spark)
    found = pii.find(df.select("doc_id", "text", "pii"), pii.train(df))
    got = [r.x for r in found.select(pii.redacted(F.coalesce("text", F.lit("")), F.col("pii.spans")).alias("x")).collect()]
    assert len(got) == len(TEXTS)
    assert "mail [EMAIL] or [PHONE], [IP], [CARD]." in got
    assert not any(brute_spans(x) for x in got)


def test_classifiers_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    known = {r.doc_id: r for r in labels.collect()}
    for name, label, least in (("op8_toxicity", "toxic", .85), ("op9_quality", "quality", .85)):
        got = [r for r in QUERIES[name](spark, "/root/testdata/sf0.01").collect()]
        assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
        held = [r for r in got if r.held_out and r.doc_id in known]
        assert np.mean([r.predicted == known[r.doc_id][label] for r in held]) >= least


def test_classifiers_without_labels_and_with_odd_texts(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = frame(spark)
    assert {r.s for r in df.select(quality.score(quality.train(df, none), F.col("text")).alias("s")).collect()} == {0.5}
    got = df.select("text", toxicity.score(toxicity.train(df, none), F.col("text")).alias("t")).collect()
    assert all((r.t.sentence_start is None) == (not (r.text or "").strip()) for r in got)


def test_language_fuses_evidence(spark):
    pages = {r.page_id: r for r in QUERIES["language_id_pages"](spark, SF).collect()}
    html = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert np.mean([pages[i].language == re.search(r'lang="(\w+)', h).group(1) for i, h in html.items() if 'lang="' in h]) > .95
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = spark.createDataFrame([(None, None, None, None), (9001, "", "en", "x.de"), (9002, "12 34", "xx-YY", None), (9003, "语言识别没有训练过的文字" * 5, None, "src1")], docs.schema)
    rows = docs.unionByName(odd).withColumn("verdict", F.lit(1))
    got = language.identify(rows, language.train(rows, "text", "lang"), "text", "lang", "source").collect()
    assert len(got) == docs.count() + 4
    assert all(not r.verdict.accepted and r.verdict.language == "und" for r in got if r.doc_id is None or r.doc_id > 9000)
    assert np.mean([r.verdict.language == r.lang for r in got if r.doc_id is not None and r.doc_id < 9000]) > .98


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert bpe.decode(bpe.encode(docs, RANKS, P.PATTERN), RANKS, P.PATTERN).count() == 0
    assert packing.pack(docs, JSON, P.PATTERN).count() == 0
    assert simhash.near_duplicates(docs).count() == 0 and simhash.one_of_each(docs).count() == 0
    assert pii.find(docs, pii.train(docs)).count() == 0
    assert docs.select(quality.score(quality.train(docs, labels), F.col("text"))).count() == 0
    assert bm25.search(docs, docs, k=3).count() == 0
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert language.identify(docs, language.train(docs, "text", "lang"), "text", "lang", "source").count() == 0
    assert chat.format_conversations(spark.createDataFrame([], f"conv_id long, turn long, role string, parts array<{chat.PART}>")).count() == 0


def test_pipeline_stages_keep_their_contract(spark):
    import corpus_pipeline as C
    from notedrift.session import materialize
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(C.STAGES):
        source, docs = docs, materialize(stage(spark, docs, SF), f"test-{k}")
        if k < 4:
            assert docs.columns == columns and 0 < docs.count() <= before
            before = docs.count()
        if name.startswith("SimHash"):
            groups = simhash.near_duplicates(source)
            assert {r.doc_id for r in docs.collect()} == {r.component_id for r in groups.collect()}
        if name == "PII":
            assert not any(brute_spans(r.text or "") for r in docs.collect())
    assert docs.select("doc_id").distinct().count() == before


def test_search_ties_of_many_copies(spark, monkeypatch):
    """Copies tie in all shards: the least ids stay, null first; a copy beyond k is never among the best."""
    monkeypatch.setattr(bm25, "SHARD_DOCS", 16)
    monkeypatch.setattr(bm25, "BLOCK_DOCS", 4)
    rows = [(i, "one copied text") for i in range(70, 10, -1)] + [(None, "one copied text"), (5, "another"), (6, None), (7, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = collections.defaultdict(list)
    for r in bm25.search(docs, docs.where("doc_id in (5, 6, 20, 70)"), k=4).collect():
        got[r.query_id].append((r["rank"], r.doc_id))
    best = [(1, None), (2, 11), (3, 12), (4, 13)]
    assert {q: sorted(v) for q, v in got.items()} == {5: [(1, 5)], 20: best, 70: best}
