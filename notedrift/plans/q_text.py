"""Queries over text and pages: note normalisation, sentences, tagging and
token filters (I1-I9, I12), TF-IDF and distances on documents (I10, I11),
extraction rules (B1-B9)."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..functions import tagging as G
from ..functions import text as X
from ..operators import extract as E
from ..operators import tfidf
from ..sources import adapters as A
from ..sources.tables import table
from .q_filings import r6
from .registry import register
from .views_sql import with_views

_HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
with open(os.path.join(_HERE, "functions", "stopwords_en.txt"), encoding="utf-8") as fh:
    STOPWORDS = tuple(w for w in fh.read().split("\n") if w)

_SQL_STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in STOPWORDS) + "]"
_SQL_TAGS = "[" + ", ".join(f"'{t}'" for t in X.KEPT_TAGS) + "]"
_NORM = r"regexp_replace(regexp_replace(regexp_replace({x}, '\n+', chr(10), 'g'), '\n ', chr(10), 'g'), ' {{2,}}', '', 'g')"
_SPLIT = r"string_split_regex({x}, '\. |\? |! |\n|\.\n')"
_TOK = r"'\p{N}+(?:[.,]\p{N}+)*|\p{L}+|[^\s\p{L}\p{N}]'"
_TAG = (r"CASE WHEN regexp_matches({t}, '^\p{{N}}') THEN 'SN' WHEN regexp_matches({t}, '^\p{{Lu}}') THEN 'NNP' "
        r"WHEN regexp_matches({t}, '^\p{{L}}{{1,2}}$') THEN 'JX' WHEN regexp_matches({t}, '^\p{{L}}') THEN 'NNG' "
        r"WHEN {t} IN ('.', '?', '!') THEN 'SF' ELSE 'SW' END")
_WORDS = r"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]{{2,}}')"

# tagged documents: toks = surfaces, tt = 'surface/TAG' strings
_TAGGED_DOCS = f"""
n AS (SELECT doc_id, {_NORM.format(x='text')} AS x FROM documents),
t0 AS (SELECT doc_id, flatten(list_transform({_SPLIT.format(x='x')}, lambda s: regexp_extract_all(s, {_TOK}))) AS toks FROM n),
t AS (SELECT doc_id, toks, list_transform(toks, lambda w: w || '/' || {_TAG.format(t='w')}) AS tt FROM t0)"""


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang")


def _tagged(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", G.tag_text("text").alias("tagged"))


# ---------------------------------------------------------------- I1-I9, I12
@register("normalize_note", f"SELECT doc_id, md5({_NORM.format(x='text')}) AS norm_md5 FROM documents")
def q_normalize_note(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(X.normalize_note("text")).alias("norm_md5"))


@register("split_sentences", f"""
SELECT doc_id, CAST(pos - 1 AS BIGINT) AS pos, sentence FROM (
  SELECT doc_id, unnest(s) AS sentence, unnest(range(1, len(s) + 1)) AS pos
  FROM (SELECT doc_id, {_SPLIT.format(x='text')} AS s FROM documents))""")
def q_split_sentences(spark, sf_dir):
    d = _docs(spark, sf_dir)
    out = d.select("doc_id", F.posexplode(X.split_sentences("text")).alias("pos", "sentence"))
    return out.select("doc_id", F.col("pos").cast("long").alias("pos"), "sentence")


@register("format_tokens", f"""
WITH {_TAGGED_DOCS}
SELECT doc_id, CAST(len(toks) AS BIGINT) AS n_tokens, md5(array_to_string(list_transform(tt, lambda s: s || ';'), '')) AS tagged_md5,
       md5(array_to_string(toks, ' ')) AS surface_md5
FROM t""")
def q_format_tokens(spark, sf_dir):
    t = _tagged(spark, sf_dir)
    return t.select("doc_id", F.size("tagged").cast("long").alias("n_tokens"),
                    F.md5(G.format_tokens("tagged", "attach_tag")).alias("tagged_md5"),
                    F.md5(G.format_tokens("tagged", "surface")).alias("surface_md5"))


@register("filter_tags", f"""
WITH {_TAGGED_DOCS},
k AS (SELECT doc_id, list_filter(tt, lambda s: list_contains({_SQL_TAGS}, regexp_extract(s, '[^/]*$', 0))) AS kept FROM t)
SELECT doc_id, CAST(len(kept) AS BIGINT) AS n_kept, md5(array_to_string(kept, ' ')) AS kept_md5, len(kept) >= 3 AS enough FROM k""")
def q_filter_tags(spark, sf_dir):
    t = _tagged(spark, sf_dir).select("doc_id", X.filter_tags(G.tagged_tokens("tagged")).alias("kept"))
    return t.select("doc_id", F.size("kept").cast("long").alias("n_kept"), F.md5(X.join_tokens("kept")).alias("kept_md5"),
                    (F.size("kept") >= 3).alias("enough"))


@register("drop_numeric_tokens", f"""
WITH {_TAGGED_DOCS},
k AS (SELECT doc_id, list_filter(tt, lambda s: NOT regexp_matches(replace(split_part(s, '/', 1), ',', ''), '{X.NUMERIC_TOKEN}')) AS kept FROM t)
SELECT doc_id, CAST(len(kept) AS BIGINT) AS n_kept, md5(array_to_string(kept, ' ')) AS kept_md5 FROM k""")
def q_drop_numeric_tokens(spark, sf_dir):
    t = _tagged(spark, sf_dir).select("doc_id", X.drop_numeric_tokens(G.tagged_tokens("tagged")).alias("kept"))
    return t.select("doc_id", F.size("kept").cast("long").alias("n_kept"), F.md5(X.join_tokens("kept")).alias("kept_md5"))


@register("noun_filter", f"""
WITH {_TAGGED_DOCS},
k AS (SELECT doc_id, list_filter(tt, lambda s: starts_with(regexp_extract(s, '[^/]*$', 0), 'NN')) AS kept FROM t)
SELECT doc_id, CAST(len(kept) AS BIGINT) AS n_nouns, md5(array_to_string(kept, ' ')) AS nouns_md5 FROM k""")
def q_noun_filter(spark, sf_dir):
    t = _tagged(spark, sf_dir).select("doc_id", X.noun_filter(G.tagged_tokens("tagged")).alias("kept"))
    return t.select("doc_id", F.size("kept").cast("long").alias("n_nouns"), F.md5(X.join_tokens("kept")).alias("nouns_md5"))


@register("join_tokens", f"SELECT doc_id, md5(array_to_string({_WORDS.format(x='text')}, ' ')) AS joined_md5 FROM documents")
def q_join_tokens(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(X.join_tokens(X.tokenize("text"))).alias("joined_md5"))


@register("strip_markup", r"""
SELECT page_id, md5(s) AS text_md5, CAST(length(s) AS BIGINT) AS n_chars FROM (
  SELECT page_id, regexp_replace(html, '<.*?>|&([a-z0-9]+|#[0-9]{1,6}|#x[0-9a-f]{1,6});', '', 'g') AS s FROM pages)""")
def q_strip_markup(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", X.strip_markup("html").alias("s"))
    return p.select("page_id", F.md5("s").alias("text_md5"), F.length("s").cast("long").alias("n_chars"))


@register("remove_stopwords", f"""
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, CAST(len(k) AS BIGINT) AS n_kept, md5(array_to_string(k, ' ')) AS kept_md5
FROM (SELECT doc_id, w, list_filter(w, lambda x: NOT list_contains({_SQL_STOP}, x)) AS k
      FROM (SELECT doc_id, {_WORDS.format(x='text')} AS w FROM documents))""")
def q_remove_stopwords(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", X.tokenize("text").alias("w"))
    d = d.withColumn("k", X.remove_stopwords("w", STOPWORDS))
    return d.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size("k").cast("long").alias("n_kept"),
                    F.md5(X.join_tokens("k")).alias("kept_md5"))


@register("ngrams", f"""
SELECT doc_id, CAST(len(k) AS BIGINT) AS n_unigrams, CAST(len(b) AS BIGINT) AS n_bigrams, md5(array_to_string(b, '|')) AS bigrams_md5
FROM (SELECT doc_id, k, list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1]) AS b
      FROM (SELECT doc_id, list_filter({_WORDS.format(x='text')}, lambda x: NOT list_contains({_SQL_STOP}, x)) AS k FROM documents))""")
def q_ngrams(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", X.remove_stopwords(X.tokenize("text"), STOPWORDS).alias("k"))
    d = d.withColumn("b", X.ngrams("k", 2))
    return d.select("doc_id", F.size("k").cast("long").alias("n_unigrams"), F.size("b").cast("long").alias("n_bigrams"),
                    F.md5(F.array_join("b", "|")).alias("bigrams_md5"))


# ---------------------------------------------------------------- I10, I11 on documents
def _tfidf_sql(docs_cte: str, toks_expr: str, max_df: str, min_df: str) -> str:
    return f"""
{docs_cte},
toks AS (SELECT id, unnest({toks_expr}) AS term FROM v),
tf AS (SELECT id, term, count(*) AS tf FROM toks GROUP BY id, term),
dfq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
nv AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM v),
idf AS (SELECT term, ln((1 + nv.n) / (1.0 + df)) + 1 AS idf FROM dfq JOIN nv ON true WHERE df <= {max_df} AND df >= {min_df}),
w0 AS (SELECT tf.id, tf.term, tf.tf * idf.idf AS w FROM tf JOIN idf ON tf.term = idf.term),
wn AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM w0)"""


TFIDF_DOCS_SQL = "WITH " + _tfidf_sql("v AS (SELECT doc_id AS id, text FROM documents)", _WORDS.format(x="text"),
                                      "0.95 * nv.n", "0") + "\nSELECT id AS doc_id, term, round(weight, 6) AS weight FROM wn"


@register("tfidf", TFIDF_DOCS_SQL)
def q_tfidf(spark, sf_dir):
    w = tfidf.tfidf(_docs(spark, sf_dir), "doc_id", "text", max_df=0.95, min_df=0)
    return w.select(F.col("id").alias("doc_id"), "term", r6("weight").alias("weight"))


_PLACEBO_DOCS = f"""
WITH {_TAGGED_DOCS},
v0 AS (SELECT doc_id AS id, array_to_string(list_filter(toks, lambda w: starts_with({_TAG.format(t='w')}, 'NN')), ' ') AS words FROM t),
v1 AS (SELECT id, list_filter({_WORDS.format(x='words')}, lambda x: NOT list_contains({_SQL_STOP}, x)) AS k FROM v0),
v AS (SELECT id, list_concat(k, list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1])) AS grams FROM v1)"""


@register("tfidf_placebo", _tfidf_sql(_PLACEBO_DOCS, "grams", "0.5 * nv.n", "2")
          + "\nSELECT id AS doc_id, term, round(weight, 6) AS weight FROM wn")
def q_tfidf_placebo(spark, sf_dir):
    """Review-corpus vectoriser: nouns only (I12), stop words removed (I8),
    uni- and bigrams (I9), max_df 0.5, min_df 2 documents."""
    # each step is its own column: higher-order functions do not share common
    # subexpressions, so nesting them would re-evaluate the tagger per n-gram
    t = _tagged(spark, sf_dir)
    t = t.withColumn("words", F.array_join(F.transform(F.filter("tagged", lambda x: x["tag"].startswith("NN")),
                                                      lambda x: x["surface"]), " "))
    t = t.withColumn("k", X.remove_stopwords(X.tokenize("words"), STOPWORDS))
    t = t.withColumn("grams", X.uni_and_bigrams("k"))
    w = tfidf.tfidf(t, "doc_id", tokens=F.col("grams"), max_df=0.5, min_df=2)
    return w.select(F.col("id").alias("doc_id"), "term", r6("weight").alias("weight"))


@register("cosine_distance", "WITH " + _tfidf_sql("v AS (SELECT doc_id AS id, text FROM documents)", _WORDS.format(x="text"),
                                                  "0.95 * nv.n", "0") + """,
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM documents a LEFT JOIN documents b ON b.doc_id = a.doc_id - 1 AND b.lang = a.lang),
dots AS (SELECT p.a, p.b, sum(x.weight * y.weight) AS dot FROM pairs p JOIN wn x ON x.id = p.a JOIN wn y ON y.id = p.b AND y.term = x.term GROUP BY p.a, p.b),
ne AS (SELECT DISTINCT id FROM wn)
SELECT p.a AS doc_id, p.b AS prior_id,
  CASE WHEN p.b IS NOT NULL AND p.a IN (SELECT id FROM ne) AND p.b IN (SELECT id FROM ne)
       THEN round(greatest(0.0, least(1.0, 1.0 - coalesce(d.dot, 0.0))), 6) END AS distance
FROM pairs p LEFT JOIN dots d ON d.a = p.a AND d.b = p.b""")
def q_cosine_distance(spark, sf_dir):
    d = _docs(spark, sf_dir)
    w = tfidf.packed_vectors(d, "doc_id", X.tokenize("text"), merge=True)
    prev = d.select((F.col("doc_id") + 1).alias("doc_id"), F.col("doc_id").alias("prior_id"), "lang")
    pairs = d.select("doc_id", "lang").join(prev, ["doc_id", "lang"], "left").select("doc_id", "prior_id")
    out = tfidf.cosine_distance(w, pairs, "doc_id", "prior_id")
    return out.select("doc_id", "prior_id", r6("distance").alias("distance"))


# ---------------------------------------------------------------- extraction rules (B)
_TITLE = "CASE WHEN dic_cls <> 'NA' THEN '[' || dic_cls || ']' || rpt_nm ELSE rpt_nm END"


@register("parse_report_title", with_views(["filings"], f"""
SELECT rcp_no, CASE WHEN contains(t, '[') THEN split_part(split_part(t, ']', 1), '[', 2) ELSE 'NA' END AS kind,
       CASE WHEN contains(t, '[') THEN split_part(t, ']', 2) ELSE t END AS name
FROM (SELECT rcp_no, {_TITLE} AS t FROM filings)"""))
def q_parse_report_title(spark, sf_dir):
    f = A.filings(spark, sf_dir)
    title = F.when(F.col("dic_cls") != "NA", F.concat(F.lit("["), F.col("dic_cls"), F.lit("]"), F.col("rpt_nm"))).otherwise(F.col("rpt_nm"))
    kind, name = E.parse_report_title(title)
    return f.select("rcp_no", kind.alias("kind"), name.alias("name"))


@register("keyword_in_name", "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 're') ")
def q_keyword_in_name(spark, sf_dir):
    """Names that hold a keyword."""
    return table(spark, sf_dir, "part").where(X.keyword_in_name("p_name", "re")).select("p_partkey", "p_name")


@register("url_param", "SELECT page_id, split_part(url, '=', 2) AS param FROM pages")
def q_url_param(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", E.url_param("url").alias("param"))


@register("extract_html_tables", r"""
SELECT page_id, CAST(pos - 1 AS BIGINT) AS pos, md5(fragment) AS fragment_md5 FROM (
  SELECT page_id, unnest(f) AS fragment, unnest(range(1, len(f) + 1)) AS pos
  FROM (SELECT page_id, regexp_extract_all(html, '(?is)<li(?:\s[^>]*)?>.*?</li\s*>') AS f FROM pages))""")
def q_extract_html_tables(spark, sf_dir):
    t = E.extract_html_tables(table(spark, sf_dir, "pages"), "page_id", tag="li")
    return t.select("page_id", F.col("pos").cast("long").alias("pos"), F.md5("fragment").alias("fragment_md5"))


@register("extract_tagged_tables", r"""
SELECT page_id, regexp_matches(url, '[02468]$') AS consolidated, CAST(pos - 1 AS BIGINT) AS pos, md5(fragment) AS fragment_md5 FROM (
  SELECT page_id, url, unnest(f) AS fragment, unnest(range(1, len(f) + 1)) AS pos
  FROM (SELECT page_id, coalesce(url, '') AS url, regexp_extract_all(html, '(?is)<a(?:\s[^>]*)?>.*?</a\s*>') AS f FROM pages))""")
def q_extract_tagged_tables(spark, sf_dir):
    """Elements of a page with the kind of note the page holds."""
    t = E.extract_html_tables(table(spark, sf_dir, "pages"), "page_id", tag="a", consolidated=F.col("url").rlike("[02468]$"))
    return t.select("page_id", "consolidated", F.col("pos").cast("long").alias("pos"), F.md5("fragment").alias("fragment_md5"))


@register("pick_sections", with_views(["sections"], """
SELECT rcp_no, md5(max_by(CASE WHEN k = 's' THEN text END, CASE WHEN k = 's' THEN pos END)) AS note_md5,
       md5(max_by(CASE WHEN k = 'c' THEN text END, CASE WHEN k = 'c' THEN pos END)) AS consolidated_md5
FROM (SELECT *, CASE WHEN contains(title, 'assistant') THEN 'c' WHEN contains(title, 's') THEN 's' END AS k FROM sections WHERE is_leaf)
WHERE k IS NOT NULL GROUP BY rcp_no"""))
def q_pick_sections(spark, sf_dir):
    s = E.pick_sections(A.sections(spark, sf_dir), consolidated_kw="assistant", separate_kw="s")
    return s.select("rcp_no", F.md5("foot_note").alias("note_md5"), F.md5("consolidated_foot_note").alias("consolidated_md5"))


@register("extract_auditor", with_views(["sections"], r"""
WITH per AS (
  SELECT rcp_no, coalesce(min_by(text, CASE WHEN contains(text, 'le') THEN pos END), max_by(text, pos)) AS chosen
  FROM sections GROUP BY rcp_no
),
l AS (SELECT rcp_no, string_split(chosen, chr(10)) AS lines FROM per),
hit AS (SELECT rcp_no, list_filter(lines[2:], lambda x: contains(x, 'le'))[1] AS line FROM l),
tok AS (SELECT rcp_no, list_filter(string_split_regex(trim(line), '\s+'), lambda t: contains(t, 'ment') AND t <> 'ment' AND t <> 'le')[1] AS a FROM hit)
SELECT rcp_no, coalesce(a, 'conv:' || CAST(rcp_no AS VARCHAR)) AS auditor FROM tok"""))
def q_extract_auditor(spark, sf_dir):
    s = A.sections(spark, sf_dir)
    return E.extract_auditor(s, default=F.concat(F.lit("conv:"), F.col("rcp_no").cast("string")),
                             line_kw="le", firm_kw="ment")


_SEP = ", ".join(f"'{t}'" for t in (*E.SEPARATE_CORRECTION, *E.SEPARATE_PLAIN))
_CON = ", ".join(f"'{t}'" for t in (*E.CONSOLIDATED_CORRECTION, *E.CONSOLIDATED_PLAIN))
_CORR = ", ".join(f"'{t}'" for t in (*E.SEPARATE_CORRECTION, *E.CONSOLIDATED_CORRECTION))
_NEAREST_SQL = f"""
nearest AS (
  SELECT rcp_no,
    arg_min(CASE WHEN title IN ({_SEP}) THEN value END, CASE WHEN title IN ({_SEP}) THEN {{'a': title NOT IN ({_CORR}), 'b': abs(filed - opt_date), 'c': pos}} END) AS dcm_no,
    arg_min(CASE WHEN title IN ({_CON}) THEN value END, CASE WHEN title IN ({_CON}) THEN {{'a': title NOT IN ({_CORR}), 'b': abs(filed - opt_date), 'c': pos}} END) AS col_dcm_no
  FROM attachment_options GROUP BY rcp_no
)"""


@register("nearest_attachment", with_views(["attachment_options"], f"WITH {_NEAREST_SQL} SELECT rcp_no, dcm_no, col_dcm_no FROM nearest"))
def q_nearest_attachment(spark, sf_dir):
    return E.nearest_attachment(A.attachment_options(spark, sf_dir))


@register("nearest_attachment_exact", with_views(["attachment_options"], f"""
WITH k AS (SELECT rcp_no, pos, value, abs(filed - opt_date) AS delta, title IN ({_CORR}) AS corr,
                  unnest([title IN ({_SEP}), title IN ({_CON})]) AS hit, unnest(['s', 'c']) AS kind FROM attachment_options),
o AS (SELECT * FROM k WHERE hit),
-- the first of a kind is taken whatever it is; later only strictly nearer corrections replace it
firsts AS (SELECT rcp_no, kind, arg_min(value, {{'p': pos, 'd': delta, 'v': value}}) AS value, arg_min(delta, {{'p': pos, 'd': delta}}) AS delta, min(pos) AS pos FROM o GROUP BY ALL),
nearer AS (SELECT o.rcp_no, o.kind, arg_min(o.value, {{'d': o.delta, 'p': o.pos, 'v': o.value}}) AS value FROM o
           JOIN firsts f ON f.rcp_no = o.rcp_no AND f.kind = o.kind WHERE o.corr AND o.delta < f.delta AND o.pos > f.pos GROUP BY ALL)
SELECT f.rcp_no, max(CASE WHEN f.kind = 's' THEN coalesce(n.value, f.value) END) AS dcm_no,
       max(CASE WHEN f.kind = 'c' THEN coalesce(n.value, f.value) END) AS col_dcm_no
FROM firsts f LEFT JOIN nearer n ON n.rcp_no = f.rcp_no AND n.kind = f.kind GROUP BY f.rcp_no"""))
def q_nearest_attachment_exact(spark, sf_dir):
    return E.nearest_attachment(A.attachment_options(spark, sf_dir), mode="exact")


@register("latest_main_document", with_views(["attachment_options"], """
SELECT rcp_no, CAST(coalesce(arg_min(CASE WHEN main_title = rtype THEN pos END,
                                     CASE WHEN main_title = rtype THEN {'d': filed - opt_date, 'p': pos} END), 0) AS BIGINT) AS main_index
FROM attachment_options GROUP BY rcp_no"""))
def q_latest_main_document(spark, sf_dir):
    return E.latest_main_document(A.attachment_options(spark, sf_dir), title="main_title")


@register("blank_short_notes", with_views(["filings"], """
SELECT rcp_no, md5(CASE WHEN len(string_split(foot_note, chr(10))) < 5 THEN NULL ELSE foot_note END) AS note_md5,
       CASE WHEN len(string_split(foot_note, chr(10))) < 5 THEN NULL ELSE dcm_no END AS dcm_no FROM filings"""))
def q_blank_short_notes(spark, sf_dir):
    f = A.filings(spark, sf_dir)
    note = E.blank_short_note("foot_note")
    return f.select("rcp_no", F.md5(note).alias("note_md5"), F.when(note.isNull(), F.lit(None)).otherwise(F.col("dcm_no")).alias("dcm_no"))


@register("needs_attachment", with_views(["filings", "attachment_options"], f"""
WITH {_NEAREST_SQL},
f AS (SELECT rcp_no, dcm_no, col_dcm_no, (foot_note IS NULL OR foot_note = '' OR foot_note = 'NA'
                                         OR len(string_split(foot_note, chr(10))) < 5) AS needs FROM filings)
SELECT f.rcp_no, f.needs AS needs_attachment,
       CASE WHEN f.needs THEN coalesce(n.dcm_no, 'NA') ELSE f.dcm_no END AS dcm_no,
       CASE WHEN f.needs THEN coalesce(n.col_dcm_no, 'NA') ELSE f.col_dcm_no END AS col_dcm_no
FROM f LEFT JOIN nearest n ON n.rcp_no = f.rcp_no"""))
def q_needs_attachment(spark, sf_dir):
    f = A.filings(spark, sf_dir).select("rcp_no", "dcm_no", "col_dcm_no", E.needs_attachment("foot_note").alias("needs"))
    n = E.nearest_attachment(A.attachment_options(spark, sf_dir)).withColumnRenamed("dcm_no", "n_dcm").withColumnRenamed("col_dcm_no", "n_col")
    j = f.join(n, "rcp_no", "left")
    return j.select("rcp_no", F.col("needs").alias("needs_attachment"),
                    F.when(F.col("needs"), F.coalesce("n_dcm", F.lit("NA"))).otherwise(F.col("dcm_no")).alias("dcm_no"),
                    F.when(F.col("needs"), F.coalesce("n_col", F.lit("NA"))).otherwise(F.col("col_dcm_no")).alias("col_dcm_no"))
