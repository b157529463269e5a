"""DuckDB texts of the adapter views (independent twins of
``notedrift.sources.adapters``), used only by the oracle queries.

``with_views(["filings", ...], body)`` prefixes a query with the CTEs it needs
(dependencies included, in order), so every oracle text is self-contained over
the driver's 14 tables.
"""

from __future__ import annotations

from ..sources.adapters import MAIN_MARKET_SEGMENTS, MAIN_TITLES, OPTION_TITLES, SECTOR_RANGES, quarter_end_columns

_SEGMENTS = ", ".join(f"'{s}'" for s in MAIN_MARKET_SEGMENTS)
_WIDE = ",\n    ".join(f"max(CASE WHEN _d = '{c}' THEN revenue END) AS \"{c}\"" for c in quarter_end_columns())
_SECTORS = ", ".join(f"({p}, '{a}', '{b}', '{r}')" for p, a, b, r in SECTOR_RANGES)

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "filings": ((), f"""
filings AS (
  SELECT
    CASE WHEN c.c_mktsegment IN ({_SEGMENTS}) THEN 'Y' ELSE 'K' END AS crp_cls,
    c.c_name AS crp_nm,
    lpad(CAST(o.o_custkey AS VARCHAR), 6, '0') AS crp_cd,
    (CASE WHEN o.o_orderkey % 29 = 0 THEN '반기보고서' WHEN o.cm = 6 THEN '반기보고서'
          WHEN o.cm = 12 THEN '사업보고서' ELSE '분기보고서' END)
      || ' (' || CAST(o.y AS VARCHAR) || '.' || lpad(CAST(o.cm AS VARCHAR), 2, '0') || ')' AS rpt_nm,
    lpad(CAST(o.o_orderkey AS VARCHAR), 14, '0') AS rcp_no,
    CASE WHEN o.o_orderstatus = 'P' THEN '기재정정' ELSE 'NA' END AS dic_cls,
    CAST(o.o_orderkey * 10 + 1 AS VARCHAR) AS dcm_no,
    CASE WHEN o.o_orderkey % 3 = 0 THEN CAST(o.o_orderkey * 10 + 2 AS VARCHAR) ELSE 'NA' END AS col_dcm_no,
    CASE WHEN o.o_orderkey % 17 = 0 THEN 'NA' ELSE d.text END AS foot_note,
    CASE WHEN o.o_orderkey % 3 = 0 THEN d2.text ELSE 'NA' END AS consolidated_foot_note,
    'A' || CAST(o.o_custkey % 9 AS VARCHAR) || '회계법인' AS acc_crp,
    strftime(CAST(last_day(make_date(o.y, o.cm, 1)) + CAST(30 * (o.o_orderkey % 5) AS INTEGER) AS DATE), '%Y.%m.%d') AS rcp_dt
  FROM (SELECT o_orderkey, o_custkey, o_orderstatus, CAST(year(o_orderdate) AS INTEGER) AS y,
               CAST(((month(o_orderdate) + 2) // 3) * 3 AS INTEGER) AS cm,
               o_orderkey % nd.n AS doc_key,
               CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey * 7 + 3) % nd.n END AS cdoc_key
        FROM orders JOIN (SELECT count(*) AS n FROM documents) nd ON true) o
  JOIN customer c ON c.c_custkey = o.o_custkey
  JOIN documents d ON d.doc_id = o.doc_key
  LEFT JOIN documents d2 ON d2.doc_id = o.cdoc_key
)"""),
    "company_industry": ((), """
company_industry AS (
  SELECT lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS crp_cd,
         CASE WHEN c_custkey % 50 = 0 THEN NULL
              ELSE CAST(c_nationkey + 50 AS VARCHAR) || CAST(c_custkey % 10 AS VARCHAR) END AS ind_cd
  FROM customer
)"""),
    "sector_ranges": ((), f"""
sector_ranges(pos, sector, sector2, range) AS (VALUES {_SECTORS})"""),
    "panel": ((), """
panel AS (
  SELECT 'A' || lpad(CAST(custkey AS VARCHAR), 6, '0') AS symbol,
         CAST(year AS INTEGER) AS year, CAST(quarter AS INTEGER) AS quarter,
         CAST(year * 4 + quarter - 1 AS INTEGER) AS period,
         CAST(rev_dec AS DOUBLE) AS revenue,
         CASE WHEN n_lines % 7 = 0 THEN 0.0 ELSE CAST(qty_dec AS DOUBLE) END AS qty,
         CAST(n_lines AS BIGINT) AS n_lines,
         CAST(gross_dec AS DOUBLE) / n_lines AS avg_price
  FROM (
    SELECT o.o_custkey AS custkey, year(o.o_orderdate) AS year, (month(o.o_orderdate) + 2) // 3 AS quarter,
           sum(CAST(l.l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l.l_discount AS DECIMAL(18,2)))) AS rev_dec,
           sum(CAST(l.l_quantity AS DECIMAL(18,2))) AS qty_dec,
           sum(CAST(l.l_extendedprice AS DECIMAL(18,2))) AS gross_dec,
           count(*) AS n_lines
    FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
    GROUP BY 1, 2, 3
  )
)"""),
    # filings with a note -> revision resolution (F1) -> note choice (C14) -> valid quarters
    "has_note": (("filings",), """
has_note AS (SELECT * FROM filings WHERE foot_note IS NOT NULL AND foot_note <> 'NA')"""),
    "resolved": (("has_note",), r"""
rev0 AS (
  SELECT *, coalesce(dic_cls <> 'NA', false) AS _tested,
         CAST(try_strptime(rcp_dt, '%Y.%m.%d') AS DATE)
           <= CAST(last_day(make_date(_cy, _cm, 1)) + INTERVAL 3 MONTH AS DATE) AS _on_time
  FROM (SELECT *, TRY_CAST(regexp_extract(rpt_nm, '\((\d{4})\.(\d{1,2})', 1) AS INTEGER) AS _cy,
                  TRY_CAST(regexp_extract(rpt_nm, '\((\d{4})\.(\d{1,2})', 2) AS INTEGER) AS _cm
        FROM has_note)
),
rev1 AS (
  SELECT *, row_number() OVER w AS _nth, lead(_tested) OVER w AS _nt, lead(_on_time) OVER w AS _no
  FROM rev0 WINDOW w AS (PARTITION BY crp_cd, rpt_nm ORDER BY rcp_dt, rcp_no)
),
resolved AS (
  SELECT * EXCLUDE (_tested, _on_time, _nth, _nt, _no, _cy, _cm) FROM rev1
  WHERE NOT ((_nth > 1 AND _tested AND NOT coalesce(_on_time, false))
             OR (coalesce(_nt, false) AND coalesce(_no, false)))
)"""),
    "valid_notes": (("resolved",), r"""
valid_notes AS (
  SELECT * EXCLUDE (_rt, _cm), cy * 4 + quarter - 1 AS period FROM (
    SELECT crp_cls, crp_nm, crp_cd, rpt_nm, rcp_no, dic_cls, rcp_dt,
           coalesce(nullif(consolidated_foot_note, 'NA'), foot_note) AS foot_note,
           regexp_extract(rpt_nm, '^\s*(\S+)', 1) AS _rt,
           TRY_CAST(regexp_extract(rpt_nm, '\((\d{4})\.(\d{1,2})', 1) AS INTEGER) AS cy,
           TRY_CAST(regexp_extract(rpt_nm, '\((\d{4})\.(\d{1,2})', 2) AS INTEGER) AS _cm,
           CASE WHEN _rt = '반기보고서' AND _cm = 6 THEN 2 WHEN _rt = '사업보고서' AND _cm = 12 THEN 4
                WHEN _rt = '분기보고서' AND _cm = 3 THEN 1 WHEN _rt = '분기보고서' AND _cm = 9 THEN 3 END AS quarter
    FROM resolved
  ) WHERE quarter IS NOT NULL
)"""),
    "panel_wide": (("panel",), f"""
panel_wide AS (
  SELECT symbol,
    {_WIDE}
  FROM (SELECT *, strftime(last_day(make_date(year, quarter * 3, 1)), '%Y-%m-%d') AS _d FROM panel)
  GROUP BY symbol
)"""),
    "panel_basis": (("panel",), """
panel_basis AS (
  SELECT symbol, year, quarter, period,
    CASE WHEN n_lines % 4 = 0 THEN NULL WHEN n_lines % 5 = 0 THEN 'n/a' ELSE CAST(CAST(floor(qty) AS BIGINT) AS VARCHAR) END AS "M-qty",
    CASE WHEN n_lines % 3 = 0 THEN NULL ELSE CAST(CAST(floor(qty) AS BIGINT) + 1 AS VARCHAR) END AS "3-qty",
    CASE WHEN n_lines % 2 = 0 THEN NULL ELSE CAST(CAST(floor(qty) AS BIGINT) + 2 AS VARCHAR) END AS "6-qty",
    CASE WHEN n_lines % 6 = 0 THEN NULL ELSE CAST(CAST(floor(revenue) AS BIGINT) AS VARCHAR) END AS "M-revenue",
    CASE WHEN n_lines % 5 = 0 THEN '-' ELSE CAST(CAST(floor(revenue) AS BIGINT) + 1 AS VARCHAR) END AS "3-revenue",
    CASE WHEN n_lines % 4 = 0 THEN NULL ELSE CAST(CAST(floor(revenue) AS BIGINT) + 2 AS VARCHAR) END AS "6-revenue"
  FROM panel
)"""),
    "preds_binary": ((), """
preds_binary AS (
  SELECT doc_id AS id, CAST(quality AS BIGINT) AS label,
         CAST(CASE WHEN (doc_id * 7919 + 13) % 10 < 7 THEN quality ELSE 1 - quality END AS BIGINT) AS prediction
  FROM labels
)"""),
    "preds_multiclass": ((), """
preds_multiclass AS (
  SELECT vec_id AS id, CAST(label AS BIGINT) AS label,
         CAST(CASE WHEN (vec_id * 7919 + 13) % 10 < 6 THEN label ELSE (label + vec_id) % 10 END AS BIGINT) AS prediction
  FROM embeddings
)"""),
    "attachment_options": (("filings",), f"""
attachment_options AS (
  SELECT o.rcp_no, o.pos, o.opt_date, o.title, o.main_title, o.value,
         CAST(try_strptime(f.rcp_dt, '%Y.%m.%d') AS DATE) AS filed,
         regexp_extract(f.rpt_nm, '^\\s*(\\S+)', 1) AS rtype
  FROM (SELECT lpad(CAST(l_orderkey AS VARCHAR), 14, '0') AS rcp_no, CAST(l_linenumber AS INTEGER) AS pos,
               CAST(l_shipdate AS DATE) AS opt_date,
               [{", ".join(repr(t) for t in OPTION_TITLES)}][(l_partkey + l_linenumber) % 5 + 1] AS title,
               [{", ".join(repr(t) for t in MAIN_TITLES)}][l_linenumber % 3 + 1] AS main_title,
               CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS value
        FROM lineitem) o
  JOIN filings f ON f.rcp_no = o.rcp_no
)"""),
    "sections": ((), """
sections AS (SELECT conv_id AS rcp_no, turn AS pos, role AS title, text, true AS is_leaf FROM conversations)"""),
    "ml_frame": ((), """
ml_frame AS (
  SELECT vec_id AS id, CAST(label % 3 AS BIGINT) AS label, embedding AS emb,
         CAST(embedding[1] AS DOUBLE) AS x1, CAST(embedding[2] AS DOUBLE) AS x2, CAST(embedding[3] AS DOUBLE) AS x3
  FROM embeddings
)"""),
    "scores": ((), """
scores AS (SELECT event_id AS id, event_type AS sample, user_id AS entity, value FROM events)"""),
}


def with_views(names, body: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in VIEWS[n][0]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    ctes = ",".join(VIEWS[n][1] for n in order)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
