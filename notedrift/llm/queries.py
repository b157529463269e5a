"""Queries of the training-data operators: thin, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary_file(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers
    return public_tokenizers.PATTERN


@query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document, decode the ids; digests of both."""
    from . import bpe
    path = vocabulary_file("byte_bpe_50k.tiktoken")
    ids = bpe.encode(table(spark, sf_dir, "documents"), path, pattern())
    back = bpe.decode(ids, path, pattern())
    return back.select("doc_id", "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document: 3-word shingles, 3 bits."""
    from . import simhash
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=3)


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document in sequences of at most 1024 tokens."""
    from . import packing
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_file("byte_bpe_50k.json"), pattern(), end_id=2, capacity=1024)


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document and its worst sentence."""
    from . import labelled, toxicity
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    found = docs.select("doc_id", labelled.held_out("doc_id").alias("held_out"), toxicity.score(model, F.col("text")).alias("t"))
    return found.select("doc_id", "held_out", "t.score", (F.col("t.score") >= 0.5).cast("int").alias("predicted"),
                        "t.sentence_start", "t.sentence_end", "t.sentence_score")


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    from . import labelled, quality
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    found = docs.select("doc_id", labelled.held_out("doc_id").alias("held_out"), quality.score(model, F.col("text")).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document: text, declared language (``lang``) and host (``source``)."""
    from . import language
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    model = language.train(docs, "text", "lang")
    found = language.identify(docs, model, "text", "lang", "source")
    return found.select("doc_id", "verdict.language", F.round("verdict.probability", 6).alias("probability"), "verdict.accepted")


@query
def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator on web pages: markup language, address suffix and host of every page."""
    from . import language
    pages = table(spark, sf_dir, "pages")
    text = F.regexp_replace(F.regexp_replace(F.col("html"), r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"<[^>]*>", " ")
    rows = pages.select("page_id", text.alias("text"), language.html_language(F.col("html")).alias("declared"), language.address_host(F.col("url")).alias("host"))
    model = language.train(rows, "text", "declared")
    found = language.identify(rows, model, "text", "declared", "host")
    return found.select("page_id", "verdict.language", F.round("verdict.probability", 6).alias("probability"), "verdict.accepted")


@query
def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that holds control strings, formatted and read back."""
    from . import chat
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    trap = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")],
                                 "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(rows.unionByName(trap).withColumn("parts", chat.text_part(F.col("text"))))
    back = chat.read_back(formatted.withColumn("conv", F.struct("conv_id", F.char_length("formatted").alias("n"))), "conv")
    learned = F.array_join("learned", "")
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv.conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
                       F.char_length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"),
                       F.col("conv.n").cast("long").alias("formatted_chars"))


@query
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base spans, and those the trees add."""
    from . import pii
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = pii.find(docs, pii.train(docs)).select("doc_id", "pii.base", "pii.spans")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == pii.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return got.select("doc_id", count("email"), count("ip"), count("card"), count("phone"),
                      F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"))


@query
def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all embeddings, cosine 0.9."""
    from . import embeddings
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


@query
def op10_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every document whose id is divisible by 100."""
    from . import bm25
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bm25.search(docs, docs.where(F.col("doc_id") % 100 == 0), k=10)


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 strongest phrases of two or three words of every language."""
    from . import collocations
    return collocations.collocations(table(spark, sf_dir, "documents"), min_count=10, longest=3, share=50, top=2000)


#: The separators of pieces and words, lower case of A-Z alone, sums in 128 bits.
ORACLES["op11_collocations"] = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
split as (
  select lang, row_number() over () as id, list_filter(regexp_split_to_array(piece, '[ \t]'), lambda w: w <> '') as ws from pieces),
flat as (select lang, id, ws, unnest(range(1, len(ws) + 1)) as i from split),
grams as (
  select lang, ws[i:i] as p from flat
  union all select lang, ws[i:i + 1] from flat where i + 1 <= len(ws)
  union all select lang, ws[i:i + 2] from flat where i + 2 <= len(ws)),
f as (select lang, p, count(*) as c from grams group by lang, p),
totals as (select lang, sum(c) as n from f where len(p) = 1 group by lang),
candidates as (select lang, p, c from f where len(p) > 1 and c >= 10),
inside as (
  select lang, p[1:2] as p, c from candidates where len(p) = 3
  union all select lang, p[2:3], c from candidates where len(p) = 3),
longer as (select lang, p, max(c) as longest from inside group by lang, p),
kept as (
  select x.lang, x.p, x.c from candidates x left join longer y on x.lang = y.lang and x.p = y.p
  where y.longest is null or 100 * y.longest < 50 * x.c),
cuts as (
  select lang, p, c, 1 as k, p[1:1] as lp, p[2:len(p)] as rp from kept
  union all select lang, p, c, 2, p[1:2], p[3:3] from kept where len(p) = 3),
scored as (
  select x.lang, x.p, x.c as a, x.k, l.c as l, r.c as r,
    (1000000::hugeint * x.c * x.c) // (l.c::hugeint * r.c) as score
  from cuts x join f l on l.lang = x.lang and l.p = x.lp join f r on r.lang = x.lang and r.p = x.rp),
best as (
  select *, row_number() over (partition by lang, p order by score, k) as nth from scored),
ranked as (
  select lang, array_to_string(p, ' ') as phrase, a, l, r, score,
    row_number() over (partition by lang order by score desc, a desc, array_to_string(p, ' ')) as rank
  from best where nth = 1)
select lang, rank::int as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from ranked join totals using (lang) where rank <= 2000
""".replace("\\\\", "\\")


@query
def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written as fixed-width bits by ascending id and read back."""
    from . import token_files
    files = token_files.write(table(spark, sf_dir, "documents"), vocabulary_file("byte_bpe_50k.json"), pattern(), end_id=2)
    return token_files.read(files)


@query
def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the embeddings whose id is divisible by 100; every seventh label is moved on by one."""
    from . import negatives
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine(rows, F.col("vec_id") % 100 == 0, positives=5, negatives=10, low=30, high=90, scale=256)


ORACLES["op13_negatives"] = """
with own as (
  select vec_id as id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label::bigint end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
rows as (select *, row_number() over () as node from own),
met as (
  select a.node as an, a.id as anchor_id, a.label as al, b.node, b.id, b.label,
    (select sum(a.v[i] * b.v[i]) from range(1, len(a.v) + 1) t(i))::bigint as score
  from rows a join rows b on a.id % 100 = 0 and a.node <> b.node and len(a.v) = len(b.v)),
positives as (
  select an, anchor_id, al, id as positive_id, score as positive_score, node as pn
  from met where label = al qualify row_number() over (partition by an order by score desc, id, node) <= 5),
found as (
  select p.anchor_id, p.positive_id, m.id as negative_id, p.positive_score, m.score as negative_score,
    row_number() over (partition by p.an, p.pn order by m.score desc, m.id, m.node) as rank
  from positives p join met m on m.an = p.an and m.label <> p.al
    and 30 * p.positive_score <= 100 * m.score and 100 * m.score <= 90 * p.positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from found where rank <= 10
"""
