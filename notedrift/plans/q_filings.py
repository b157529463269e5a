"""Queries over the filing table: cleaning (C), periods (D), revisions (F),
prior-filing matching and note change (E5, I10, I11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import periods as P
from ..functions import tagging as G
from ..functions import text as X
from ..operators import clean, match, revisions, tfidf
from ..session import materialize
from ..sources import adapters as A
from .registry import register
from .views_sql import with_views


# ---------------------------------------------------------------- building blocks
def with_quarter(df: DataFrame, rpt: str = "rpt_nm") -> DataFrame:
    """Adds closing year ``cy``, ``quarter`` (D4) and ``period``."""
    q = P.fiscal_quarter(P.report_type(rpt), P.closing_month(rpt))
    return (df.withColumn("cy", P.closing_year(rpt)).withColumn("quarter", q)
              .withColumn("period", P.period(F.col("cy"), F.col("quarter"))))


def has_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.split_missing_notes(A.filings(spark, sf_dir))[1]


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisions.resolve_revisions(has_note(spark, sf_dir))


def valid_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved filings, consolidated note preferred, standard quarters only."""
    # the note choice is row-local, so it runs before the revision window and
    # only one text column travels through that shuffle
    r = revisions.resolve_revisions(clean.prefer_consolidated(has_note(spark, sf_dir)))
    cols = ["crp_cls", "crp_nm", "crp_cd", "rpt_nm", "rcp_no", "dic_cls", "rcp_dt", "foot_note"]
    return with_quarter(r.select(*cols)).filter(F.col("quarter").isNotNull())


def r6(c) -> F.Column:
    return F.round(c if not isinstance(c, str) else F.col(c), 6)


# ---------------------------------------------------------------- flagship
def _change(spark: SparkSession, sf_dir: str, words) -> DataFrame:
    """Distances of resolved notes to the notes a quarter and a year earlier; ``words``: note column ->
    text whose tokens (`tokenize`) are weighted.  Revisions are resolved on keys and dates alone; the text of the surviving
    filings is fetched by receipt number (unique) and leaves its task only as term counts."""
    narrow = has_note(spark, sf_dir).select("crp_cd", "rpt_nm", "rcp_no", "rcp_dt", "dic_cls")
    v = with_quarter(revisions.resolve_revisions(narrow)).where(F.col("quarter").isNotNull())
    # read by the vectoriser, the links and the result
    v = materialize(v.select("crp_cd", "rpt_nm", "period", "rcp_dt", "rcp_no"), "resolved_filings")
    notes = clean.prefer_consolidated(A.filings(spark, sf_dir, v.select("rcp_no"))).select("rcp_no", "foot_note")
    vectors = tfidf.packed_vectors(notes, "rcp_no", words=words(F.col("foot_note")), max_df=0.95, min_df=0)
    linked = materialize(match.match_prior_filings(v), "prior_links")
    d = tfidf.cosine_distance(vectors, linked, "rcp_no", ("prior_q", "prior_y"))
    return d.select("crp_cd", "rpt_nm", "rcp_no", "prior_q", r6("dist_q").alias("dist_q"), "prior_y", r6("dist_y").alias("dist_y"))


def note_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much did each company's note change since its previous quarter and
    since the same quarter a year earlier?  filings -> F1 -> C14 -> D4 -> I1 ->
    I10 -> E5 -> I11."""
    return _change(spark, sf_dir, X.normalize_note)


def note_change_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on tagged notes: tagged (I3), other tags dropped (I4), numbers dropped (I5), joined to
    one string (I6) whose words, surfaces and tags alike, are weighted (I10, I11)."""
    return _change(spark, sf_dir, lambda note: X.join_tokens(
        X.drop_numeric_tokens(X.filter_tags(G.tagged_tokens(G.tag_text(note))))))


_NORMAL = r"regexp_replace(regexp_replace(regexp_replace(foot_note, '\n+', chr(10), 'g'), '\n ', chr(10), 'g'), ' {2,}', '', 'g')"
_NOTES = f"""v AS (SELECT crp_cd, rpt_nm, rcp_no, rcp_dt, period, {_NORMAL} AS text FROM valid_notes),"""
_TAGGED_NOTES = f"""
s0 AS (SELECT *, flatten(list_transform(string_split_regex({_NORMAL}, '\\. |\\? |! |\\n|\\.\\n'),
                 lambda s: regexp_extract_all(s, '{G.DEFAULT_TOKEN}'))) AS toks FROM valid_notes),
s1 AS (SELECT *, list_transform(toks, lambda w: w || '/' || CASE
         WHEN regexp_matches(w, '^\\p{{N}}') THEN 'SN' WHEN regexp_matches(w, '^\\p{{Lu}}') THEN 'NNP'
         WHEN regexp_matches(w, '^\\p{{L}}{{1,2}}$') THEN 'JX' WHEN regexp_matches(w, '^\\p{{L}}') THEN 'NNG'
         WHEN w IN ('.', '?', '!') THEN 'SF' ELSE 'SW' END) AS tt FROM s0),
v AS (SELECT crp_cd, rpt_nm, rcp_no, rcp_dt, period, array_to_string(list_filter(tt, lambda s:
        list_contains({list(X.KEPT_TAGS)}, regexp_extract(s, '[^/]*$', 0))
        AND NOT regexp_matches(replace(split_part(s, '/', 1), ',', ''), '{X.NUMERIC_TOKEN}')), ' ') AS text FROM s1),"""
_CHANGE_SQL = r"""
toks AS (SELECT rcp_no AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM v),
tf AS (SELECT id, term, count(*) AS tf FROM toks GROUP BY id, term),
dfq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
nv AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM v),
idf AS (
  SELECT term, ln((1 + nv.n) / (1.0 + df)) + 1 AS idf FROM dfq JOIN nv ON true
  WHERE df <= 0.95 * nv.n AND df >= 0
),
w0 AS (SELECT tf.id, tf.term, tf.tf * idf.idf AS w FROM tf JOIN idf ON tf.term = idf.term),
wn AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM w0),
firsts AS (
  SELECT crp_cd, period, rcp_no AS first_no FROM (
    SELECT crp_cd, period, rcp_no, row_number() OVER (PARTITION BY crp_cd, period ORDER BY rcp_dt, rcp_no) AS rn FROM v
  ) WHERE rn = 1
),
linked AS (
  SELECT v.crp_cd, v.rpt_nm, v.rcp_no, fq.first_no AS prior_q, fy.first_no AS prior_y
  FROM v LEFT JOIN firsts fq ON fq.crp_cd = v.crp_cd AND fq.period = v.period - 1
         LEFT JOIN firsts fy ON fy.crp_cd = v.crp_cd AND fy.period = v.period - 4
),
pairs AS (
  SELECT DISTINCT a, b FROM (
    SELECT rcp_no AS a, prior_q AS b FROM linked UNION ALL SELECT rcp_no, prior_y FROM linked
  ) WHERE b IS NOT NULL
),
dots AS (
  SELECT p.a, p.b, sum(x.weight * y.weight) AS dot
  FROM pairs p JOIN wn x ON x.id = p.a JOIN wn y ON y.id = p.b AND y.term = x.term
  GROUP BY p.a, p.b
),
nonempty AS (SELECT DISTINCT id FROM wn),
dist AS (
  SELECT p.a, p.b, greatest(0.0, least(1.0, 1.0 - coalesce(d.dot, 0.0))) AS distance
  FROM pairs p LEFT JOIN dots d ON d.a = p.a AND d.b = p.b
  WHERE p.a IN (SELECT id FROM nonempty) AND p.b IN (SELECT id FROM nonempty)
)
SELECT l.crp_cd, l.rpt_nm, l.rcp_no, l.prior_q, round(dq.distance, 6) AS dist_q,
       l.prior_y, round(dy.distance, 6) AS dist_y
FROM linked l
LEFT JOIN dist dq ON dq.a = l.rcp_no AND dq.b = l.prior_q
LEFT JOIN dist dy ON dy.a = l.rcp_no AND dy.b = l.prior_y
"""
NOTE_CHANGE_SQL = with_views(["valid_notes"], "WITH " + _NOTES + _CHANGE_SQL)

register("note_change", NOTE_CHANGE_SQL)(note_change)
register("note_change_tagged", with_views(["valid_notes"], "WITH " + _TAGGED_NOTES.lstrip() + _CHANGE_SQL))(note_change_tagged)


# ---------------------------------------------------------------- revisions (F)
RESOLVE_SQL = with_views(["resolved"], "SELECT crp_cd, rpt_nm, rcp_no, rcp_dt, dic_cls FROM resolved")


@register("resolve_revisions", RESOLVE_SQL)
def q_resolve_revisions(spark, sf_dir):
    return resolved(spark, sf_dir).select("crp_cd", "rpt_nm", "rcp_no", "rcp_dt", "dic_cls")


@register("resolve_revisions_strict", with_views(["has_note"], r"""
WITH r0 AS (
  SELECT *, CAST(try_strptime(rcp_dt, '%Y.%m.%d') AS DATE)
              < CAST(make_date(_cy, _cm, 1) + INTERVAL 3 MONTH AS DATE) AS _on_time
  FROM (SELECT *, TRY_CAST(regexp_extract(rpt_nm, '\((\d{4})\.(\d{1,2})', 1) AS INTEGER) AS _cy,
                  TRY_CAST(regexp_extract(rpt_nm, '\((\d{4})\.(\d{1,2})', 2) AS INTEGER) AS _cm FROM has_note)
),
r1 AS (
  SELECT *, row_number() OVER w AS _nth, lead(_on_time) OVER w AS _no, lead(rcp_no) OVER w AS _nx
  FROM r0 WINDOW w AS (PARTITION BY crp_cd, rpt_nm ORDER BY rcp_dt, rcp_no)
)
SELECT crp_cd, rpt_nm, rcp_no, rcp_dt, dic_cls FROM r1
WHERE NOT ((_nth > 1 AND NOT coalesce(_on_time, false)) OR (_nx IS NOT NULL AND coalesce(_no, false)))
"""))
def q_resolve_revisions_strict(spark, sf_dir):
    r = revisions.resolve_revisions_strict(has_note(spark, sf_dir))
    return r.select("crp_cd", "rpt_nm", "rcp_no", "rcp_dt", "dic_cls")


@register("find_duplicate_keys", with_views(["filings"], """
SELECT crp_cd, rpt_nm, count(*) AS n_rows FROM filings GROUP BY crp_cd, rpt_nm HAVING count(*) > 1"""))
def q_find_duplicate_keys(spark, sf_dir):
    return revisions.find_duplicate_keys(A.filings(spark, sf_dir), ["crp_cd", "rpt_nm"])


@register("same_day_last", with_views(["filings"], """
SELECT crp_cd, rpt_nm, rcp_dt, rcp_no FROM (
  SELECT crp_cd, rpt_nm, rcp_dt, rcp_no,
         row_number() OVER (PARTITION BY crp_cd, rpt_nm, rcp_dt ORDER BY rcp_no DESC) AS rn FROM filings
) WHERE rn = 1"""))
def q_same_day_last(spark, sf_dir):
    f = A.filings(spark, sf_dir).select("crp_cd", "rpt_nm", "rcp_dt", "rcp_no")
    return revisions.same_day_last(f)


# ---------------------------------------------------------------- cleaning (C)
PERIOD_YEARS = range(1996, 2001)


@register("filter_period_names", with_views(["filings"], """
SELECT rcp_no, rpt_nm FROM filings WHERE regexp_matches(rpt_nm, '1996|1997|1998|1999|2000')"""))
def q_filter_period_names(spark, sf_dir):
    return clean.filter_period_names(A.filings(spark, sf_dir), PERIOD_YEARS).select("rcp_no", "rpt_nm")


@register("distinct_codes", with_views(["filings"], "SELECT DISTINCT crp_cd FROM filings"))
def q_distinct_codes(spark, sf_dir):
    return clean.distinct_codes(A.filings(spark, sf_dir))


@register("exclude_industry_prefixes", with_views(["filings", "company_industry"], """
SELECT f.rcp_no, f.crp_cd, i.ind_cd FROM filings f JOIN company_industry i ON f.crp_cd = i.crp_cd
WHERE NOT coalesce(starts_with(i.ind_cd, '64') OR starts_with(i.ind_cd, '65') OR starts_with(i.ind_cd, '66'), false)"""))
def q_exclude_industry_prefixes(spark, sf_dir):
    out = clean.exclude_industry_prefixes(A.filings(spark, sf_dir), A.company_industry(spark, sf_dir))
    assert "acc_crp" not in out.columns
    return out.select("rcp_no", "crp_cd", "ind_cd")


@register("split_missing_notes", with_views(["filings"], """
SELECT rcp_no, CASE WHEN foot_note IS NULL OR foot_note = 'NA' THEN 'no_note' ELSE 'has_note' END AS part FROM filings"""))
def q_split_missing_notes(spark, sf_dir):
    no_note, with_note = clean.split_missing_notes(A.filings(spark, sf_dir))
    return (no_note.select("rcp_no", F.lit("no_note").alias("part"))
            .unionByName(with_note.select("rcp_no", F.lit("has_note").alias("part"))))


@register("originals_only", with_views(["filings"], "SELECT rcp_no, crp_cd, rpt_nm FROM filings WHERE dic_cls = 'NA'"))
def q_originals_only(spark, sf_dir):
    return clean.originals_only(A.filings(spark, sf_dir)).select("rcp_no", "crp_cd", "rpt_nm")


@register("sort_filings", with_views(["filings"], "SELECT crp_cd, rpt_nm, rcp_dt, rcp_no FROM filings ORDER BY 1, 2, 3, 4"))
def q_sort_filings(spark, sf_dir):
    return clean.sort_filings(A.filings(spark, sf_dir).select("crp_cd", "rpt_nm", "rcp_dt", "rcp_no"))


@register("take_first_n", with_views(["filings"], "SELECT rcp_no, crp_cd FROM filings ORDER BY rcp_no LIMIT 100"))
def q_take_first_n(spark, sf_dir):
    return clean.take_first_n(A.filings(spark, sf_dir).select("rcp_no", "crp_cd"), 100, ["rcp_no"])


@register("drop_columns", with_views(["filings"], """
SELECT crp_cls, crp_nm, crp_cd, rpt_nm, rcp_no, dic_cls, dcm_no, col_dcm_no, acc_crp, rcp_dt FROM filings"""))
def q_drop_columns(spark, sf_dir):
    return clean.drop_columns(A.filings(spark, sf_dir), ["foot_note", "consolidated_foot_note"])


@register("prefer_consolidated", with_views(["resolved"], """
WITH o AS (SELECT * FROM has_note WHERE dic_cls = 'NA')
SELECT rcp_no, 'originals_separate' AS variant, md5(foot_note) AS note_md5, false AS has_consolidated_col FROM o
UNION ALL SELECT rcp_no, 'revised_separate', md5(foot_note), false FROM resolved
UNION ALL SELECT rcp_no, 'originals_consolidated', md5(coalesce(nullif(consolidated_foot_note, 'NA'), foot_note)), false FROM o
UNION ALL SELECT rcp_no, 'revised_consolidated', md5(coalesce(nullif(consolidated_foot_note, 'NA'), foot_note)), true FROM resolved"""))
def q_prefer_consolidated(spark, sf_dir):
    # the variants are told by digests: texts become digests where they are read ('NA' stays), so neither
    # the revision window nor the four variants carry a text
    digest = lambda c: F.when(F.col(c) == "NA", F.lit("NA")).otherwise(F.md5(c)).alias(c)
    hn = materialize(has_note(spark, sf_dir).select("crp_cd", "rpt_nm", "rcp_no", "rcp_dt", "dic_cls", digest("foot_note"), digest("consolidated_foot_note")), "note_digests")
    variants = clean.note_variants(clean.originals_only(hn), revisions.resolve_revisions(hn))
    out = None
    for name, df in variants.items():
        part = df.select("rcp_no", F.lit(name).alias("variant"), F.col("foot_note").alias("note_md5"),
                         F.lit("consolidated_foot_note" in df.columns).alias("has_consolidated_col"))
        out = part if out is None else out.unionByName(part)
    return out


@register("set_difference", with_views(["filings", "valid_notes"], """
SELECT rcp_no FROM filings WHERE rcp_no NOT IN (SELECT rcp_no FROM valid_notes)"""))
def q_set_difference(spark, sf_dir):
    return clean.set_difference(A.filings(spark, sf_dir).select("rcp_no"), valid_notes(spark, sf_dir), ["rcp_no"])


@register("symmetric_difference", with_views(["filings"], """
WITH a AS (SELECT crp_cd, rpt_nm FROM filings WHERE crp_cls = 'Y'),
     b AS (SELECT crp_cd, rpt_nm FROM filings WHERE dic_cls <> 'NA')
SELECT crp_cd, rpt_nm FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY crp_cd, rpt_nm HAVING count(*) = 1"""))
def q_symmetric_difference(spark, sf_dir):
    f = A.filings(spark, sf_dir)
    a = f.filter(F.col("crp_cls") == "Y").select("crp_cd", "rpt_nm")
    b = f.filter(F.col("dic_cls") != "NA").select("crp_cd", "rpt_nm")
    return clean.symmetric_difference(a, b)


@register("union_frames", with_views(["filings"], """
SELECT crp_cd, rcp_no, rpt_nm FROM filings WHERE crp_cls = 'Y'
UNION ALL SELECT crp_cd, rcp_no, rpt_nm FROM filings WHERE crp_cls = 'K'"""))
def q_union_frames(spark, sf_dir):
    f = A.filings(spark, sf_dir)
    main = f.filter(F.col("crp_cls") == "Y").select("crp_cd", "rcp_no", "rpt_nm", "dcm_no")
    other = f.filter(F.col("crp_cls") == "K").select("rcp_no", "crp_cd", "rpt_nm", "acc_crp")
    return clean.union_frames([main, other], common_only=True)


@register("union_all_columns", with_views(["filings"], """
SELECT crp_cd, rcp_no, dcm_no, NULL::VARCHAR AS acc_crp FROM filings WHERE crp_cls = 'Y'
UNION ALL SELECT crp_cd, rcp_no, NULL::VARCHAR, acc_crp FROM filings WHERE crp_cls = 'K'"""))
def q_union_all_columns(spark, sf_dir):
    f = A.filings(spark, sf_dir)
    main = f.filter(F.col("crp_cls") == "Y").select("crp_cd", "rcp_no", "dcm_no")
    other = f.filter(F.col("crp_cls") == "K").select("rcp_no", "crp_cd", "acc_crp")
    return clean.union_frames([main, other], common_only=False)


# ---------------------------------------------------------------- periods (D)
_CY = r"TRY_CAST(regexp_extract(rpt_nm, '\((\d{4})\.(\d{1,2})', 1) AS INTEGER)"
_CM = r"TRY_CAST(regexp_extract(rpt_nm, '\((\d{4})\.(\d{1,2})', 2) AS INTEGER)"


@register("closing_period", with_views(["filings"], f"""
SELECT rcp_no, CAST({_CY} AS BIGINT) AS closing_year, CAST({_CM} AS BIGINT) AS closing_month FROM filings"""))
def q_closing_period(spark, sf_dir):
    f = A.filings(spark, sf_dir)
    return f.select("rcp_no", P.closing_year("rpt_nm").cast("long").alias("closing_year"),
                    P.closing_month("rpt_nm").cast("long").alias("closing_month"))


@register("correction_deadline", with_views(["filings"], f"""
SELECT rcp_no, CAST(last_day(make_date({_CY}, {_CM}, 1)) + INTERVAL 3 MONTH AS DATE) AS deadline FROM filings"""))
def q_correction_deadline(spark, sf_dir):
    f = A.filings(spark, sf_dir)
    return f.select("rcp_no", P.correction_deadline(P.closing_year("rpt_nm"), P.closing_month("rpt_nm")).alias("deadline"))


@register("correction_deadline_first", with_views(["filings"], f"""
SELECT rcp_no, CAST(make_date({_CY}, {_CM}, 1) + INTERVAL 3 MONTH AS DATE) AS deadline FROM filings"""))
def q_correction_deadline_first(spark, sf_dir):
    f = A.filings(spark, sf_dir)
    return f.select("rcp_no", P.correction_deadline_first(P.closing_year("rpt_nm"), P.closing_month("rpt_nm")).alias("deadline"))


@register("filing_date", with_views(["filings"], """
SELECT rcp_no, CAST(try_strptime(rcp_dt, '%Y.%m.%d') AS DATE) AS filed FROM filings"""))
def q_filing_date(spark, sf_dir):
    return A.filings(spark, sf_dir).select("rcp_no", P.filing_date("rcp_dt").alias("filed"))


_QUARTER_SQL = f"""CASE WHEN regexp_extract(rpt_nm, '^\\s*(\\S+)', 1) = '반기보고서' AND {_CM} = 6 THEN 2
     WHEN regexp_extract(rpt_nm, '^\\s*(\\S+)', 1) = '사업보고서' AND {_CM} = 12 THEN 4
     WHEN regexp_extract(rpt_nm, '^\\s*(\\S+)', 1) = '분기보고서' AND {_CM} = 3 THEN 1
     WHEN regexp_extract(rpt_nm, '^\\s*(\\S+)', 1) = '분기보고서' AND {_CM} = 9 THEN 3 END"""


@register("fiscal_quarter", with_views(["filings"], f"""
SELECT rcp_no, CAST({_QUARTER_SQL} AS BIGINT) AS quarter FROM filings"""))
def q_fiscal_quarter(spark, sf_dir):
    f = A.filings(spark, sf_dir)
    return f.select("rcp_no", P.fiscal_quarter(P.report_type("rpt_nm"), P.closing_month("rpt_nm")).cast("long").alias("quarter"))


@register("prior_quarter_report_name", with_views(["valid_notes"], """
SELECT rcp_no,
  CASE quarter WHEN 1 THEN '사업보고서' WHEN 2 THEN '분기보고서' WHEN 3 THEN '반기보고서' ELSE '분기보고서' END
  || ' (' || CAST(CASE WHEN quarter = 1 THEN cy - 1 ELSE cy END AS VARCHAR) || '.'
  || lpad(CAST(CASE WHEN quarter = 1 THEN 12 ELSE (quarter - 1) * 3 END AS VARCHAR), 2, '0') || ')' AS prior_name
FROM valid_notes"""))
def q_prior_quarter_report_name(spark, sf_dir):
    v = valid_notes(spark, sf_dir)
    return v.select("rcp_no", P.prior_quarter_report_name(F.col("cy"), F.col("quarter") * 3).alias("prior_name"))


@register("prior_year_report_name", with_views(["valid_notes"], """
SELECT rcp_no, regexp_extract(rpt_nm, '^\\s*(\\S+)', 1) || ' (' || CAST(cy - 1 AS VARCHAR) || '.'
  || lpad(CAST(quarter * 3 AS VARCHAR), 2, '0') || ')' AS prior_name FROM valid_notes"""))
def q_prior_year_report_name(spark, sf_dir):
    v = valid_notes(spark, sf_dir)
    return v.select("rcp_no", P.prior_year_report_name(P.report_type("rpt_nm"), F.col("cy"), F.col("quarter") * 3).alias("prior_name"))


@register("symbol_key", with_views(["filings"], "SELECT DISTINCT crp_cd, 'A' || crp_cd AS symbol FROM filings"))
def q_symbol_key(spark, sf_dir):
    return A.filings(spark, sf_dir).select("crp_cd", P.symbol_key("crp_cd").alias("symbol")).distinct()


@register("calendar_parts", """
SELECT DISTINCT CAST(last_day(CAST(o_orderdate AS DATE)) AS DATE) AS d,
       CAST(month(o_orderdate) AS BIGINT) AS month, CAST(year(o_orderdate) AS BIGINT) AS year,
       CAST(CASE WHEN month(o_orderdate) % 3 = 0 THEN month(o_orderdate) // 3 END AS BIGINT) AS quarter
FROM orders""")
def q_calendar_parts(spark, sf_dir):
    from ..sources.tables import table
    d = table(spark, sf_dir, "orders").select(F.last_day(F.to_date("o_orderdate")).alias("d")).distinct()
    m, y, q = P.calendar_parts("d")
    return d.select("d", m.cast("long").alias("month"), y.cast("long").alias("year"), q.cast("long").alias("quarter"))


# ---------------------------------------------------------------- joins on filings (E)
@register("natural_join", with_views(["filings", "company_industry"], """
SELECT f.rcp_no, f.crp_cd, i.ind_cd FROM filings f JOIN company_industry i USING (crp_cd)"""))
def q_natural_join(spark, sf_dir):
    f = A.filings(spark, sf_dir).select("rcp_no", "crp_cd")
    return match.natural_join(f, A.company_industry(spark, sf_dir))


@register("match_prior_filings", NOTE_CHANGE_SQL.split("pairs AS (")[0].rstrip().rstrip(",") + """
SELECT rcp_no, prior_q, prior_y FROM linked""")
def q_match_prior_filings(spark, sf_dir):
    v = valid_notes(spark, sf_dir)
    return match.match_prior_filings(v.select("crp_cd", "period", "rcp_dt", "rcp_no")).select("rcp_no", "prior_q", "prior_y")


@register("exclude_ids", with_views(["resolved", "valid_notes"], """
SELECT rcp_no FROM resolved WHERE rcp_no NOT IN (
  SELECT rcp_no FROM resolved WHERE NOT EXISTS (SELECT 1 FROM valid_notes v WHERE v.rcp_no = resolved.rcp_no))"""))
def q_exclude_ids(spark, sf_dir):
    r = resolved(spark, sf_dir)
    nonstandard = with_quarter(r).filter(F.col("quarter").isNull()).select("rcp_no")
    return match.exclude_ids(r.select("rcp_no"), nonstandard, ["rcp_no"])


@register("prefix_range_join", with_views(["company_industry", "sector_ranges"], """
SELECT crp_cd, ind_cd, sector, sector2, range FROM (
  SELECT i.crp_cd, i.ind_cd, s.sector, s.sector2, s.range,
         row_number() OVER (PARTITION BY i.crp_cd ORDER BY s.pos DESC) AS rn
  FROM company_industry i LEFT JOIN sector_ranges s ON starts_with(i.ind_cd, s.range)
) WHERE rn = 1"""))
def q_prefix_range_join(spark, sf_dir):
    ci = A.company_industry(spark, sf_dir)
    return match.prefix_range_join(ci, A.sector_ranges(spark), key=["crp_cd"])


@register("split_by_sector", with_views(["company_industry", "sector_ranges"], """
SELECT i.crp_cd, i.ind_cd, s.sector, s.sector2, s.range, s.pos
FROM company_industry i JOIN sector_ranges s ON starts_with(i.ind_cd, s.range)"""))
def q_split_by_sector(spark, sf_dir):
    ci = A.company_industry(spark, sf_dir)
    return match.prefix_range_join(ci, A.sector_ranges(spark), key=["crp_cd"], on_overlap="all")


# ---------------------------------------------------------------- scans (A)
@register("read_shards", "SELECT * FROM nation")
def q_read_shards(spark, sf_dir):
    from ..sources import io
    return io.read_shards(spark, sf_dir, "nation")


@register("read_shards_mixed", "SELECT o_orderkey, o_custkey FROM orders")
def q_read_shards_mixed(spark, sf_dir):
    """A1 over written shards: columns differ between them, one holds no rows (and lacks a common column), one is no shard."""
    from ..sources import io
    from ..sources.tables import table
    base = _written(spark, "shards")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    third = lambda k: o.where(F.pmod("o_orderkey", F.lit(3)) == k)
    third(0).drop("o_orderdate").write.mode("overwrite").parquet(f"{base}/a")
    third(1).drop("o_totalprice").write.mode("overwrite").parquet(f"{base}/b")
    third(2).drop("o_orderdate").write.mode("overwrite").parquet(f"{base}/deep/c")
    o.select("o_custkey").where("false").write.mode("overwrite").parquet(f"{base}/empty")
    o.select("o_custkey").limit(5).write.mode("overwrite").option("compression", "none").csv(f"{base}/other")
    return io.read_shards(spark, base, "part-").select("o_orderkey", "o_custkey")


@register("lookup_from_json", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def q_lookup_from_json(spark, sf_dir):
    from ..sources import io
    from ..sources.tables import table
    return io.lookup_from_json(table(spark, sf_dir, "events"), "event_id", "props", "k")


@register("chunk_ids", with_views(["filings"], """
SELECT rcp_no, CAST((row_number() OVER (ORDER BY rcp_no) - 1) // 5000 AS BIGINT) AS chunk FROM filings"""))
def q_chunk_ids(spark, sf_dir):
    from ..sources import io
    return io.chunk_ids(A.filings(spark, sf_dir).select("rcp_no"), "rcp_no", 5000)


@register("read_panel", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def q_read_panel(spark, sf_dir):
    """A3: a sheet read with an explicit schema (only these columns are scanned)."""
    from pyspark.sql import types as T
    from ..sources import io
    schema = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_nationkey", T.IntegerType()),
                           T.StructField("c_mktsegment", T.StringType())])
    return io.read_panel(spark, f"{sf_dir.rstrip('/')}/customer.parquet", schema)


def _written(spark, name: str) -> str:
    """A new folder for a written table, beside the other tables of the shared checkpoint folder."""
    import uuid

    from ..session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/notedrift-tables/{name}-{uuid.uuid4().hex}"


@register("read_codes", "SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS crp_cd, lpad(CAST(c_nationkey AS VARCHAR), 3, '0') AS ind_cd FROM customer")
def q_read_codes(spark, sf_dir):
    """A4 over A7: codes written as CSV and read as strings, leading zeros kept."""
    from ..sources import io
    from ..sources.tables import table
    c = table(spark, sf_dir, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("crp_cd"),
                                                F.lpad(F.col("c_nationkey").cast("string"), 3, "0").alias("ind_cd"))
    return io.read_codes(spark, io.write_csv(c, _written(spark, "codes")), ["crp_cd", "ind_cd"])


@register("write_csv", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def q_write_csv(spark, sf_dir):
    """A table written as UTF-8 CSV with a header, read back."""
    from ..sources import io
    from ..sources.tables import table
    path = io.write_csv(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), _written(spark, "csv"))
    return spark.read.option("header", True).csv(path)


@register("write_stage", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def q_write_stage(spark, sf_dir):
    """A stage written by status and read back."""
    from ..sources import io
    from ..sources.tables import table
    path = io.write_stage(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), _written(spark, "stage"), ["o_orderstatus"])
    return spark.read.parquet(path)


@register("filings_scan", with_views(["filings"], """
SELECT crp_cd, rpt_nm, rcp_no, dic_cls, CAST(rcp_dt AS VARCHAR) AS rcp_dt, length(foot_note) AS note_chars FROM filings"""))
def q_filings_scan(spark, sf_dir):
    """A10: filings written as page files and scanned with the fixed schema of strings."""
    from ..sources import io
    f = A.filings(spark, sf_dir)
    f = f.select(*[(F.col(c) if c in f.columns else F.lit(None)).cast("string").alias(c) for c in io.FILING_SCHEMA.names])
    got = io.filings_scan(spark, io.write_stage(f, _written(spark, "filings")))
    return got.select("crp_cd", "rpt_nm", "rcp_no", "dic_cls", "rcp_dt", F.char_length("foot_note").cast("long").alias("note_chars"))


@register("results_scan", "SELECT 'm' || i AS metric, count(*) AS n, round(avg(CAST(embedding[CAST(i AS INT)] AS DOUBLE)), 6) AS mean FROM embeddings, range(1, 11) r(i) GROUP BY i")
def q_results_scan(spark, sf_dir):
    """Ten positional score columns read from CSV, named, and unpivoted."""
    from ..sources import io
    from ..sources.tables import table
    e = table(spark, sf_dir, "embeddings").select(*[F.get("embedding", i).cast("double").alias(f"c{i}") for i in range(10)])
    got = io.results_scan(spark, io.write_csv(e, _written(spark, "results")), [f"m{i}" for i in range(1, 11)])
    return io.unpivot_results(got).groupBy("metric").agg(F.count("value").alias("n"), r6(F.avg("value")).alias("mean"))
