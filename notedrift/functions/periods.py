"""Date and key functions (D1-D9).  All return Columns; no UDFs.

A fiscal quarter is addressed by the integer ordinal ``period = year*4 + quarter - 1``
so that "next quarter" is ``period + 1`` and "same quarter last year" is
``period - 4``, independent of gaps in the data.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Report type words and (type, closing month) -> quarter, as filed.
ANNUAL = "사업보고서"
HALF_YEAR = "반기보고서"
QUARTERLY = "분기보고서"
QUARTER_RULES = ((HALF_YEAR, 6, 2), (ANNUAL, 12, 4), (QUARTERLY, 3, 1), (QUARTERLY, 9, 3))
CORRECTION_KIND = "기재정정"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def closing_year(rpt_nm) -> Column:
    """Year of the closing period written as '(yyyy.mm)' in the report name."""
    return _try_int(F.regexp_extract(_c(rpt_nm), r"\((\d{4})\.(\d{1,2})", 1))


def closing_month(rpt_nm) -> Column:
    """Month of the closing period."""
    return _try_int(F.regexp_extract(_c(rpt_nm), r"\((\d{4})\.(\d{1,2})", 2))


def _try_int(c: Column) -> Column:
    return F.when(c == "", F.lit(None).cast("int")).otherwise(c.cast("int"))


def report_type(rpt_nm) -> Column:
    """First whitespace-separated word of the report name."""
    return F.regexp_extract(_c(rpt_nm), r"^\s*(\S+)", 1)


def correction_deadline(year, month) -> Column:
    """Last day of the closing month plus three calendar months (day clamped)."""
    return F.add_months(F.last_day(F.make_date(_c(year), _c(month), F.lit(1))), 3)


def correction_deadline_first(year, month) -> Column:
    """First day of the closing month plus three months (used with strict <)."""
    return F.add_months(F.make_date(_c(year), _c(month), F.lit(1)), 3)


def filing_date(rcp_dt) -> Column:
    """D3: parse 'yyyy.mm.dd'; unparseable -> null."""
    return F.try_to_date(_c(rcp_dt), "yyyy.MM.dd")


def fiscal_quarter(rtype, month) -> Column:
    """(report type, closing month) -> quarter 1..4, anything else null."""
    rtype, month = _c(rtype), _c(month)
    expr = None
    for word, m, q in QUARTER_RULES:
        cond = (rtype == word) & (month == m)
        expr = F.when(cond, F.lit(q)) if expr is None else expr.when(cond, F.lit(q))
    return expr


def period(year, quarter) -> Column:
    """D5 helper: ordinal quarter number."""
    return _c(year) * 4 + _c(quarter) - 1


def period_year(p) -> Column:
    return F.floor(_c(p) / 4).cast("int")


def period_quarter(p) -> Column:
    return (F.pmod(_c(p), F.lit(4)) + 1).cast("int")


def next_period(year, quarter) -> tuple[Column, Column]:
    """(year, quarter) of the next calendar quarter (4Q -> 1Q of next year)."""
    p = period(year, quarter) + 1
    return period_year(p), period_quarter(p)


def previous_period(year, quarter) -> tuple[Column, Column]:
    """(year, quarter) of the previous calendar quarter."""
    p = period(year, quarter) - 1
    return period_year(p), period_quarter(p)


def quarter_report_type(quarter) -> Column:
    """Report type filed for a quarter (inverse of D4)."""
    q = _c(quarter)
    return (F.when(q == 4, F.lit(ANNUAL)).when(q == 2, F.lit(HALF_YEAR))
            .when(q.isin(1, 3), F.lit(QUARTERLY)))


def report_name(rtype, year, month) -> Column:
    """'type (yyyy.mm)'."""
    return F.format_string("%s (%d.%02d)", _c(rtype), _c(year), _c(month))


def prior_quarter_report_name(year, month) -> Column:
    """Name of the report one quarter back (3 -> annual of Y-1, 6 -> quarterly Y.03, ...)."""
    q = F.floor(_c(month) / 3).cast("int")
    p = period(_c(year), q) - 1
    pq = period_quarter(p)
    return F.when(_c(month).isin(3, 6, 9, 12),
                  report_name(quarter_report_type(pq), period_year(p), pq * 3))


def prior_year_report_name(rtype, year, month) -> Column:
    """Same report type and month one year back."""
    return F.when(_c(month).isin(3, 6, 9, 12), report_name(_c(rtype), _c(year) - 1, _c(month)))


def symbol_key(crp_cd) -> Column:
    """Panel symbol 'A' + company code."""
    return F.concat(F.lit("A"), _c(crp_cd))


def calendar_parts(d) -> tuple[Column, Column, Column]:
    """Month, year and quarter of a quarter-end date; quarter null for other months."""
    m = F.month(_c(d))
    return m, F.year(_c(d)), F.when(F.pmod(m, F.lit(3)) == 0, (m / 3).cast("int"))
