"""Extraction rules re-aimed from the crawler (B1-B9): the input is a table of
pages, sections or option lists, never a browser.  Per-filing choices are
aggregates keyed by the filing (``min_by``/``max_by``), so they pre-aggregate
on the map side; the order-dependent attachment rule is an ``aggregate`` fold
over the filing's own (small) option array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Attachment titles by kind, as listed on the disclosure site.
SEPARATE_CORRECTION = ("[정정] 감사보고서", "[정정] 반기검토보고서", "[정정] 분기검토보고서")
CONSOLIDATED_CORRECTION = ("[정정] 연결감사보고서", "[정정] 반기연결검토보고서", "[정정] 분기연결검토보고서")
SEPARATE_PLAIN = ("감사보고서", "반기검토보고서", "분기검토보고서")
CONSOLIDATED_PLAIN = ("연결감사보고서", "반기연결검토보고서", "분기연결검토보고서")
PLACEHOLDERS = ("+본문선택+", "+첨부선택+")
CONSOLIDATED_NOTE_TITLE = "연결재무제표 주석"
SEPARATE_NOTE_TITLE = "재무제표 주석"
FIRM_WORD = "회계법인"
FIRM_LINE_WORD = "법인"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ------------------------------------------------------------------ column rules
def parse_report_title(title) -> tuple[Column, Column]:
    """B1: '[kind]name' -> (kind, text after the first ']' up to the next);
    without '[' -> ('NA', whole text)."""
    t = _c(title)
    has = t.contains("[")
    kind = F.when(has, F.split_part(F.split_part(t, F.lit("]"), F.lit(1)), F.lit("["), F.lit(2))).otherwise(F.lit("NA"))
    name = F.when(has, F.split_part(t, F.lit("]"), F.lit(2))).otherwise(t)
    return kind, name


def url_param(url) -> Column:
    """B2: text between the first and second '=' of a URL."""
    return F.split_part(_c(url), F.lit("="), F.lit(2))


def html_elements(html, tag: str = "table") -> Column:
    """Every ``<tag ...>...</tag>`` of a page, in order (non-greedy, so an
    element nested in one of the same tag ends at the inner closing tag)."""
    return F.regexp_extract_all(_c(html), F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>"), 0)


def nested_elements(html, tag: str = "table") -> Column:
    """Every ``<tag ...>...</tag>`` of a page whole, nested ones too, in the order of their opening tags.

    The page is cut before opening and after closing tags, an array fold counts the depth after every piece, and an
    element ends at the first piece that takes the depth below its own.  An element that is never closed is none,
    nor is a closing tag without an opening one; a null page gives null."""
    opening, closing = rf"(?i)^<{tag}(?:\s[^>]*)?>", rf"(?i)</{tag}\s{{0,20}}>$"
    pieces = F.split(_c(html), rf"(?i)(?=<{tag}(?:\s[^>]*)?>)|(?<=</{tag}\s{{0,20}}>)", -1)
    start = F.array().cast("array<struct<at: int, after: int>>")

    def step(found: Column, piece: Column) -> Column:
        before = F.coalesce(F.get(found, F.size(found) - 1)["after"], F.lit(0))
        at = before + piece.rlike(opening).cast("int")
        return F.concat(found, F.array(F.struct(at.alias("at"), F.greatest(at - piece.rlike(closing).cast("int"), F.lit(0)).alias("after"))))

    def whole(p: Column) -> Column:
        depths = F.aggregate(p, start, step)
        both = F.arrays_zip(p.alias("piece"), depths.alias("depth"))
        rest = lambda i: F.slice(both, i + 1, F.size(p))

        def element(x: Column, i: Column) -> Column:
            # pieces until the depth falls below that of this opening tag
            open_ = F.when(x["piece"].rlike(opening), x["depth"]["at"])
            length = F.array_position(F.transform(rest(i), lambda r: r["depth"]["after"] < open_), True)
            return F.when(length > 0, F.array_join(F.transform(F.slice(both, i + 1, length.cast("int")), lambda r: r["piece"]), ""))
        return F.filter(F.transform(both, element), lambda e: e.isNotNull())

    return F.transform(F.array(pieces), whole)[0]


def line_count(note) -> Column:
    return F.size(F.split(_c(note), "\n", -1))


def blank_short_note(note, min_lines: int = 5) -> Column:
    """A note of fewer than ``min_lines`` lines counts as missing (null)."""
    return F.when(line_count(note) < min_lines, F.lit(None).cast("string")).otherwise(_c(note))


def needs_attachment(note, min_lines: int = 5) -> Column:
    """The note must come from the attachments (empty or too short)."""
    n = _c(note)
    return n.isNull() | (n == "") | (n == "NA") | (line_count(n) < min_lines)


# ------------------------------------------------------------------ DataFrame rules
def extract_html_tables(pages: DataFrame, id_col: str, html: str = "html", tag: str = "table", consolidated: Column | None = None) -> DataFrame:
    """One row per element, whole and nested ones too: (id, pos, fragment).

    ``consolidated``: whether a page holds consolidated notes (a boolean expression over ``pages``); its elements then
    carry it as ``consolidated``, null as false."""
    kind = [] if consolidated is None else [F.coalesce(consolidated, F.lit(False)).alias("consolidated")]
    return pages.select(id_col, *kind, F.posexplode(nested_elements(html, tag)).alias("pos", "fragment"))


def pick_sections(sections: DataFrame, filing: str = "rcp_no", pos: str = "pos", title: str = "title",
                  text: str = "text", is_leaf: str | None = "is_leaf",
                  consolidated_kw: str = CONSOLIDATED_NOTE_TITLE, separate_kw: str = SEPARATE_NOTE_TITLE) -> DataFrame:
    """Per filing, the separate and consolidated note among leaf sections;
    a title with the consolidated keyword is consolidated (checked first),
    else with the separate keyword separate; a later section overwrites."""
    s = sections.filter(F.col(is_leaf)) if is_leaf else sections
    kind = (F.when(F.col(title).contains(consolidated_kw), F.lit("c"))
             .when(F.col(title).contains(separate_kw), F.lit("s")))
    s = s.withColumn("_kind", kind).filter(F.col("_kind").isNotNull())
    return (s.groupBy(filing).agg(
        F.max_by(F.when(F.col("_kind") == "s", F.col(text)), F.when(F.col("_kind") == "s", F.col(pos))).alias("foot_note"),
        F.max_by(F.when(F.col("_kind") == "c", F.col(text)), F.when(F.col("_kind") == "c", F.col(pos))).alias("consolidated_foot_note")))


def extract_auditor(tables: DataFrame, filing: str = "rcp_no", pos: str = "pos", text: str = "text",
                    default: Column | None = None, line_kw: str = FIRM_LINE_WORD,
                    firm_kw: str = FIRM_WORD) -> DataFrame:
    """Auditor name.  Table = the first table containing ``line_kw``, else the
    last table; skip its first line; on the first later line containing
    ``line_kw`` take the first whitespace token that contains ``firm_kw`` and is
    not equal to it; otherwise ``default`` (the filing's URL)."""
    has = F.col(text).contains(line_kw)
    per = tables.groupBy(filing).agg(
        F.min_by(F.col(text), F.when(has, F.col(pos))).alias("_first_hit"),
        F.max_by(F.col(text), F.col(pos)).alias("_last"))
    chosen = F.coalesce(F.col("_first_hit"), F.col("_last"))
    lines = F.split(chosen, "\n", -1)
    later = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    line = F.get(F.filter(later, lambda l: l.contains(line_kw)), 0)
    tokens = F.split(F.trim(line), r"\s+", -1)
    tok = F.get(F.filter(tokens, lambda t: t.contains(firm_kw) & (t != firm_kw)), 0)
    out = per.select(filing, tok.alias("auditor"))
    if default is not None:
        out = out.withColumn("auditor", F.coalesce(F.col("auditor"), default))
    return out


def nearest_attachment(options: DataFrame, filing: str = "rcp_no", filed: str = "filed",
                       opt_date: str = "opt_date", title: str = "title", value: str = "value", pos: str = "pos",
                       mode: str = "clean") -> DataFrame:
    """Per filing, the attachment of each kind (separate, consolidated).

    ``clean``: correction titles before plain ones, then the nearest date
    (absolute days), then the earlier position - a ``min_by`` per filing.
    ``exact``: the reference's order-dependent fold: a correction replaces the
    current pick when strictly nearer than it; a plain title is taken only
    while nothing is picked and it is strictly nearer (trap T9).  Options of one
    position are taken by distance, then value.
    """
    o = options.withColumn("_delta", F.abs(F.datediff(F.col(filed), F.col(opt_date))))
    sep = F.col(title).isin(*SEPARATE_CORRECTION, *SEPARATE_PLAIN)
    con = F.col(title).isin(*CONSOLIDATED_CORRECTION, *CONSOLIDATED_PLAIN)
    is_corr = F.col(title).isin(*SEPARATE_CORRECTION, *CONSOLIDATED_CORRECTION)
    if mode == "clean":
        rank = F.struct((~is_corr).alias("a"), F.col("_delta").alias("b"), F.col(pos).alias("c"))
        return o.groupBy(filing).agg(
            F.min_by(F.when(sep, F.col(value)), F.when(sep, rank)).alias("dcm_no"),
            F.min_by(F.when(con, F.col(value)), F.when(con, rank)).alias("col_dcm_no"))
    if mode != "exact":
        raise ValueError(mode)
    item = F.struct(F.col(pos).alias("pos"), F.col("_delta").alias("delta"), F.col(value).alias("value"),
                    is_corr.alias("corr"), sep.alias("sep"), con.alias("con"))
    per = o.filter(sep | con).groupBy(filing).agg(F.array_sort(F.collect_list(item)).alias("_opts"))

    def fold(kind: str):
        init = F.struct(F.lit(None).cast("int").alias("best"), F.lit(None).cast("string").alias("value"))

        def step(acc, x):
            nearer = acc["best"].isNull() | (x["delta"] < acc["best"])
            take = x[kind] & nearer & (x["corr"] | acc["value"].isNull())
            return F.when(take, F.struct(x["delta"].alias("best"), x["value"].alias("value"))).otherwise(acc)

        return F.aggregate(F.col("_opts"), init, step)["value"]

    return per.select(filing, fold("sep").alias("dcm_no"), fold("con").alias("col_dcm_no"))


def latest_main_document(options: DataFrame, filing: str = "rcp_no", filed: str = "filed",
                         opt_date: str = "opt_date", title: str = "title", rtype: str = "rtype",
                         pos: str = "pos", signed: bool = True) -> DataFrame:
    """Among options whose last word equals the report type, the one with the
    smallest ``filed - option_date`` (signed: the latest-dated, even after the
    filing; ``signed=False``: absolute); first position wins ties; default 0."""
    last_word = F.element_at(F.split(F.trim(F.col(title)), r"\s+", -1), -1)
    delta = F.datediff(F.col(filed), F.col(opt_date))
    if not signed:
        delta = F.abs(delta)
    ok = last_word == F.col(rtype)
    agg = options.groupBy(filing).agg(
        F.min_by(F.when(ok, F.col(pos)), F.when(ok, F.struct(delta.alias("d"), F.col(pos).alias("p")))).alias("_idx"))
    return agg.select(filing, F.coalesce(F.col("_idx"), F.lit(0)).cast("long").alias("main_index"))
