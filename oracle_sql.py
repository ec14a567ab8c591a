"""DuckDB oracle SQL for every registered query (same tables, same column names)."""

from __future__ import annotations

# Fixed values, written out here so that a wrong one in the library shows.
STATE_RECODES = [("BR", "WI"), ("MK", "WA")]
EXCLUDED_STATES = ["AS", "CN", "GP", "GU", "MP", "VI"]
REASON_RECODES = [("ELEV_BACT", "ELEVATED BACTERIA")]
INDICATOR_RECODES = [
    ("ENTERO", "ENTEROCOCCI"),
    ("PREEMPT", "PREEMPTORY ACTION"),
    ("FECAL_COL", "FECAL COLIFORM"),
    ("TOTAL_COL", "TOTAL COLIFORM"),
    ("RATIO", "FECAL-TO-TOTAL COLIFORM RATIO"),
]
SOURCE_RECODES = [
    ("CSO", "COMBINED SEWER OVERFLOW"),
    ("SSO", "SANITARY SEWER OVERFLOW"),
    ("POTW", "PUBLICLY-OWNED TREATMENT WORKS"),
    ("SEWER_LINE", "SEWER LINE"),
]
ACTION_TYPES = {
    "closure": "Closure",
    "rain_advisory": "Rain Advisory",
    "contamination_advisory": "Contamination Advisory",
}
LABELS = {
    "beach_id": "EPA beach ID",
    "beach_name": "Beach name",
    "state": "State",
    "county": "County",
    "reasons": "Action reasons",
    "indicators": "Bacteria indicators",
    "sources": "Possible pollution sources",
    "no_of_beach_actions": "Total number of beach actions",
    "no_of_days_under_action": "Total number of days under action",
    "closure": "Total number of beach closures",
    "rain_advisory": "Total number of rain advisories",
    "contamination_advisory": "Total number of contamination advisories",
    "status": "2018 beach reporting status",
}
RECORD_KEYS = {
    "bn": "beach_name", "bi": "beach_id", "s": "state", "c": "county", "na": "no_of_beach_actions",
    "nd": "no_of_days_under_action", "cl": "closure", "ra": "rain_advisory",
    "ca": "contamination_advisory", "r": "reasons", "i": "indicators", "so": "sources", "st": "status",
}
UPPER_FIELDS = ["bn", "bi", "s", "c", "r", "i", "so", "st"]
HIDE_NA_FIELDS = ["na", "nd", "cl", "ra", "ca", "r", "i", "so", "st"]
SUMMARY_SUMS = {
    "total_beaches": "no_of_beach_act_beaches",
    "monitored_beaches": "no_of_monitored_beaches",
    "beaches_with_actions": "no_of_monitored_beacheswith_actions",
    "beaches_without_actions": "no_of_monitored_beacheswithout_actions",
    "total_actions": "total_no_of_beach_actions",
    "total_days_under_action": "no_of_days_undera_beach_action_monitored_beaches",
    "total_days_not_under_action": "no_of_days_not_undera_beach_action_monitored_beaches",
}
SNAPSHOT_YEAR = 2018
SUMMARY_YEARS = [2017, 2018]
NATION_CODES = ["WI", "BR", "MK", "CA", "GU", "NY", "VA", "WV", "FL", "TX", "AS", "MI", "MN",
                "OH", "IL", "IN", "PR", "HI", "VI", "ME", "MA", "NJ", "NC", "SC", "GA"]
YEAR_SHIFT = 20
LOOKUP_STATE = "Virginia"
LOOKUP_TERM = "elevated|^b1"
# names of the codes that the tables hold
STATE_NAMES = [
    ("WI", "Wisconsin"), ("WA", "Washington"), ("CA", "California"), ("NY", "New York"),
    ("VA", "Virginia"), ("WV", "West Virginia"), ("FL", "Florida"), ("TX", "Texas"),
    ("MI", "Michigan"), ("MN", "Minnesota"), ("OH", "Ohio"), ("IL", "Illinois"), ("IN", "Indiana"),
    ("PR", "Puerto Rico"), ("HI", "Hawaii"), ("ME", "Maine"), ("MA", "Massachusetts"),
    ("NJ", "New Jersey"), ("NC", "North Carolina"), ("SC", "South Carolina"), ("GA", "Georgia"),
]

# ---------------------------------------------------------------- oracle SQL

_EV = """
ev AS (
  SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus, o_orderdate, o_totalprice,
    CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE o_orderstatus END AS status,
    CASE WHEN o_orderkey % 97 = 0 THEN NULL
         ELSE CAST(floor(o_totalprice / 10000) AS BIGINT) END AS days,
    CASE WHEN o_orderkey % 3 = 0 THEN NULL
         WHEN o_orderkey % 3 = 1 THEN o_orderpriority
         ELSE o_orderpriority || ', ' || o_orderstatus END AS reasons,
    o_orderstatus || ',' || CASE WHEN o_totalprice > 200000 THEN 'BIG' ELSE 'SMALL' END AS indicators,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL
         ELSE substr(o_orderpriority, 3) || ' ,' || o_orderstatus END AS sources
  FROM orders)"""


def _nums(name: str, key: str = "o_custkey", with_status: bool = True) -> str:
    status = "" if not with_status else """,
    CASE WHEN COUNT(status) = COUNT(*) THEN CAST(SUM(CASE WHEN status = 'F' THEN 1 ELSE 0 END) AS BIGINT) END AS n_f,
    CASE WHEN COUNT(status) = COUNT(*) THEN CAST(SUM(CASE WHEN status = 'O' THEN 1 ELSE 0 END) AS BIGINT) END AS n_o,
    CASE WHEN COUNT(status) = COUNT(*) THEN CAST(SUM(CASE WHEN status = 'P' THEN 1 ELSE 0 END) AS BIGINT) END AS n_p"""
    return f"""
{name} AS (
  SELECT {key} AS o_custkey, COUNT(*) AS n_orders,
    CASE WHEN COUNT(days) = COUNT(*) THEN CAST(SUM(days) AS BIGINT) END AS total_days{status}
  FROM ev GROUP BY {key})"""


_NORMALIZE = {
    "reasons": "regexp_replace(regexp_replace(trim(v), '-', ' '), 'NOT SPECIFIED', 'NS')",
    "indicators": "regexp_replace(trim(v), 'BIG', 'LARGE')",
    "sources": "regexp_replace(trim(v), 'URGENT', 'URG')",
}


def _ordered_lists(keys: list[str]) -> str:
    """CTEs lists_<field>: per keys, distinct values in first-appearance order."""
    k = ", ".join(keys)
    parts = []
    for field, norm in _NORMALIZE.items():
        parts.append(f"""
items_{field} AS (
  SELECT {k}, o_orderkey, pos, {norm} AS v FROM (
    SELECT {k}, o_orderkey, unnest(arr) AS v, unnest(range(1, len(arr) + 1)) AS pos
    FROM (SELECT {k}, o_orderkey,
                 coalesce(string_split({field}, ','), [NULL::VARCHAR]) AS arr FROM ev))),
first_{field} AS (
  SELECT *, row_number() OVER (PARTITION BY {k}, v ORDER BY o_orderkey, pos) AS rn
  FROM items_{field}),
lists_{field} AS (
  SELECT {k}, string_agg(coalesce(v, 'NA'), ', ' ORDER BY o_orderkey, pos) AS {field}
  FROM first_{field} WHERE rn = 1 GROUP BY {k})""")
    return ",".join(parts)


def _lists_join(keys: list[str]) -> str:
    on_i = " AND ".join(f"r.{c} IS NOT DISTINCT FROM i.{c}" for c in keys)
    on_s = " AND ".join(f"r.{c} IS NOT DISTINCT FROM s.{c}" for c in keys)
    cols = ", ".join(f"r.{c}" for c in keys)
    return f"""
lists AS (
  SELECT {cols}, r.reasons, i.indicators, s.sources
  FROM lists_reasons r JOIN lists_indicators i ON {on_i} JOIN lists_sources s ON {on_s})"""


_CN = """
cn AS (
  SELECT c.c_custkey, n.n_name AS state
  FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey)"""

_STATE_TOTALS = f"""
WITH {_EV},{_nums('nums')},{_CN},
sites AS (SELECT nums.*, cn.state FROM nums LEFT JOIN cn ON cn.c_custkey = nums.o_custkey),
by_state AS (
  SELECT state,
    CAST(coalesce(SUM(n_orders), 0) AS BIGINT) AS n_orders,
    CAST(coalesce(SUM(total_days), 0) AS BIGINT) AS total_days,
    CAST(coalesce(SUM(n_f), 0) AS BIGINT) AS n_f,
    CAST(coalesce(SUM(n_o), 0) AS BIGINT) AS n_o,
    CAST(coalesce(SUM(n_p), 0) AS BIGINT) AS n_p,
    COUNT(*) AS n_customers
  FROM sites GROUP BY state),
r AS (
  SELECT *, CAST(n_orders AS DOUBLE) / n_customers AS orders_per_customer,
            CAST(total_days AS DOUBLE) / n_customers AS days_per_customer
  FROM by_state),
t AS (
  SELECT * FROM r
  UNION ALL
  SELECT 'Total', CAST(SUM(n_orders) AS BIGINT), CAST(SUM(total_days) AS BIGINT),
         CAST(SUM(n_f) AS BIGINT), CAST(SUM(n_o) AS BIGINT), CAST(SUM(n_p) AS BIGINT),
         CAST(SUM(n_customers) AS BIGINT), SUM(orders_per_customer), SUM(days_per_customer)
  FROM r)
SELECT state, n_orders, total_days, n_f, n_o, n_p, n_customers,
       round(orders_per_customer, 6) AS orders_per_customer,
       round(days_per_customer, 6) AS days_per_customer
FROM t"""

_TWO_LISTS = """
base AS (
  SELECT o_orderkey,
    CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority || ',' || o_orderstatus END AS l1,
    CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus
         ELSE o_orderstatus || ',X,' || substr(o_orderpriority, 1, 1) END AS l2
  FROM orders),
a AS (SELECT o_orderkey, unnest(coalesce(string_split(l1, ','), [NULL::VARCHAR])) AS t1, l2 FROM base),
b AS (SELECT o_orderkey, t1, unnest(coalesce(string_split(l2, ','), [NULL::VARCHAR])) AS t2 FROM a)"""

_DOCS = """
docs AS (SELECT doc_id, nullif(lang, 'fr') AS lang, lang AS raw_lang, source, n_chars FROM documents),
l AS (SELECT CASE WHEN raw_lang = 'de' THEN -doc_id - 1 ELSE doc_id END AS doc_id, lang, source AS reasons, n_chars FROM docs),
r AS (
  SELECT lb.doc_id, d.lang,
    CASE WHEN lb.toxic = 1 THEN 'Historical'
         WHEN lb.quality = 1 THEN 'No advisory or closure'
         WHEN lb.doc_id % 5 = 0 THEN NULL
         ELSE 'Dormant' END AS beach_status
  FROM labels lb LEFT JOIN docs d ON d.doc_id = lb.doc_id),
j AS (
  SELECT coalesce(l.doc_id, r.doc_id) AS doc_id, coalesce(l.lang, r.lang) AS lang,
         l.reasons, l.n_chars, r.beach_status
  FROM l FULL OUTER JOIN r
    ON l.doc_id IS NOT DISTINCT FROM r.doc_id AND l.lang IS NOT DISTINCT FROM r.lang),
fj AS (
  SELECT doc_id, lang, reasons, n_chars,
    CASE WHEN beach_status = 'No advisory or closure' AND reasons IS NOT NULL THEN 'Active'
         WHEN beach_status = 'No advisory or closure' THEN 'Active: No advisory or closure'
         ELSE coalesce(beach_status, 'NA') END AS status
  FROM j WHERE NOT (beach_status = 'Historical' AND reasons IS NULL))"""

_RECORDS = """
rec AS (
  SELECT p_name AS bn, CAST(p_partkey AS VARCHAR) AS bi, p_type AS s, p_brand AS c,
         CAST(p_size AS VARCHAR) AS na, upper(p_name) AS r, p_type AS st
  FROM part)"""


def _search_sql(state: str = "regexp_matches(s, 'O')") -> str:
    term = "ring|^1"
    fields = ["bn", "bi", "s", "c", "r", "na", "st"]
    conds = " OR ".join(f"regexp_matches(lower({f}), '{term}')" for f in fields)
    return f"""WITH {_RECORDS}
SELECT bi, bn, s FROM rec WHERE {state} AND ({conds})"""


def analog_sql() -> dict[str, str]:
    return {
        "recode_replace_first": """
SELECT p_partkey,
  regexp_replace(regexp_replace(regexp_replace(p_name, 'e', 'E'), 'o', '0'), 'E', '3') AS name_recoded,
  regexp_replace(p_brand, '#', '-') AS brand_recoded,
  regexp_replace(p_type, '[AEIOU]', '*') AS type_recoded
FROM part""",
        "exclude_codes": """
SELECT o_orderkey, o_custkey, p AS o_orderpriority FROM (
  SELECT o_orderkey, o_custkey,
    regexp_replace(regexp_replace(
      CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END,
      '5-LOW', '2-HIGH'), '3-', '4-') AS p
  FROM orders)
WHERE p NOT IN ('2-HIGH')""",
        "token_frequency": """
WITH base AS (
  SELECT CASE WHEN l_linenumber % 3 = 0 THEN NULL
              WHEN l_linenumber % 3 = 1 THEN l_returnflag
              ELSE l_returnflag || ' ,' || l_linestatus || ',' END AS flags
  FROM lineitem)
SELECT regexp_replace(trim(t), 'N', 'NONE') AS flags, CAST(COUNT(*) AS BIGINT) AS n
FROM (SELECT unnest(coalesce(string_split(flags, ','), [NULL::VARCHAR])) AS t FROM base)
GROUP BY 1""",
        "token_frequency_weighted": f"""
WITH {_TWO_LISTS}
SELECT trim(t1) AS l1, CAST(COUNT(*) AS BIGINT) AS n FROM b GROUP BY 1""",
        "long_form": f"""
WITH {_TWO_LISTS}
SELECT o_orderkey, trim(t1) AS l1, trim(t2) AS l2 FROM b""",
        "ordered_distinct_concat": f"""
WITH {_EV},{_ordered_lists(['o_custkey'])},{_lists_join(['o_custkey'])}
SELECT * FROM lists""",
        "conditional_counts": f"""
WITH {_EV},{_nums('nums')}
SELECT * FROM nums""",
        "left_join_counts": f"""
WITH {_EV},{_ordered_lists(['o_custkey', 'o_orderpriority'])},
{_lists_join(['o_custkey', 'o_orderpriority'])},{_nums('nums', "CASE WHEN o_orderstatus = 'P' THEN -o_custkey ELSE o_custkey END")}
SELECT lists.o_custkey, lists.o_orderpriority, lists.reasons, lists.indicators, lists.sources,
       nums.n_orders, nums.total_days, nums.n_f, nums.n_o, nums.n_p
FROM lists LEFT JOIN nums ON lists.o_custkey IS NOT DISTINCT FROM nums.o_custkey""",
        "state_totals": _STATE_TOTALS,
        "ranked_sum": f"""
SELECT *, n_f + n_o AS contam_close FROM ({_STATE_TOTALS})""",
        "share_of_total": """
SELECT o_orderpriority, COUNT(*) AS n,
       round(CAST(COUNT(*) AS DOUBLE) / (SELECT COUNT(*) FROM orders) * 100, 6) AS pct
FROM orders GROUP BY o_orderpriority""",
        "token_share": f"""
WITH {_EV},
toks AS (
  SELECT DISTINCT o_orderkey, trim(t) AS token
  FROM (SELECT o_orderkey, unnest(coalesce(string_split(reasons, ','), [NULL::VARCHAR])) AS t
        FROM ev))
SELECT token, COUNT(*) AS n,
       round(CAST(COUNT(*) AS DOUBLE) / (SELECT COUNT(*) FROM orders) * 100, 6) AS pct
FROM toks GROUP BY token""",
        "dedupe_first_then_filter": """
SELECT event_id, user_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn
  FROM events)
WHERE rn = 1 AND ts >= TIMESTAMP '2024-01-03 00:00:00'""",
        "dedupe_count": """
SELECT o_orderpriority, COUNT(*) AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn
  FROM orders WHERE o_orderstatus <> 'F')
WHERE rn = 1 GROUP BY o_orderpriority""",
        "full_join_status": f"""
WITH {_DOCS}
SELECT * FROM fj""",
        "status_counts": f"""
WITH {_DOCS}
SELECT status, COUNT(*) AS n FROM fj GROUP BY status""",
        "count_two_keys": f"""
WITH {_EV}
SELECT status, CAST(year(o_orderdate) AS INTEGER) AS year, COUNT(*) AS n
FROM ev WHERE status <> 'F' GROUP BY 1, 2""",
        "positive_filter": f"""
WITH {_EV},{_nums('nums')}
SELECT * FROM nums WHERE n_p > 0""",
        "dim_lookup_publish": f"""
WITH {_EV},{_nums('nums', "CASE WHEN o_orderstatus = 'O' THEN o_custkey ELSE -o_custkey END", with_status=False)}
SELECT coalesce(CAST(c.c_custkey AS VARCHAR), 'NA') AS "Customer ID",
       coalesce(c.c_name, 'NA') AS "Customer name",
       coalesce(n.n_name, 'NA') AS "Nation",
       coalesce(nullif(c.c_mktsegment, 'HOUSEHOLD'), 'NA') AS "Segment",
       coalesce(CAST(nums.n_orders AS VARCHAR), 'NA') AS "Total number of orders",
       coalesce(CAST(nums.total_days AS VARCHAR), 'NA') AS "Total days"
FROM customer c
LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
LEFT JOIN nums ON nums.o_custkey = c.c_custkey""",
        "year_state_summary": f"""
WITH {_EV},{_CN},
rows AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS year, cn.state,
    CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' AND month(o_orderdate) = 1
         THEN 1 ELSE 0 END AS v_total,
    CASE WHEN o_orderkey % 211 = 0 THEN NULL
         WHEN o_orderstatus = 'O' AND month(o_orderdate) = 1 THEN 1 ELSE 0 END AS v_monitored,
    CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS v_with,
    CAST(floor(o_totalprice / 1000) AS BIGINT) AS v_price_k
  FROM ev LEFT JOIN cn ON cn.c_custkey = ev.o_custkey),
g AS (
  SELECT year, state,
    CASE WHEN COUNT(v_total) = COUNT(*) THEN CAST(SUM(v_total) AS BIGINT) END AS total,
    CASE WHEN COUNT(v_monitored) = COUNT(*) THEN CAST(SUM(v_monitored) AS BIGINT) END AS monitored,
    CASE WHEN COUNT(v_with) = COUNT(*) THEN CAST(SUM(v_with) AS BIGINT) END AS with_actions,
    CASE WHEN COUNT(v_price_k) = COUNT(*) THEN CAST(SUM(v_price_k) AS BIGINT) END AS price_k
  FROM rows WHERE year IN (1996, 1997) GROUP BY year, state)
SELECT year, state, total, monitored,
  round(CASE WHEN monitored IS NULL OR total IS NULL THEN NULL
             WHEN total <> 0 THEN CAST(monitored AS DOUBLE) / total
             WHEN monitored > 0 THEN 'Infinity'::DOUBLE
             WHEN monitored < 0 THEN '-Infinity'::DOUBLE
             ELSE 'NaN'::DOUBLE END * 100, 6) AS percent_monitored,
  with_actions, price_k
FROM g""",
        "regex_search": _search_sql(),
        "regex_search_unselected": _search_sql("regexp_matches(lower(s), 'all')"),
        "distinct_sorted": "SELECT DISTINCT p_type AS s FROM part",
        "skewed_full_join": """
WITH o AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 1 ELSE o_custkey END AS k, o_orderkey, o_orderstatus FROM orders),
c AS (SELECT nullif(c_custkey, 2) AS k, c_name, c_mktsegment FROM customer)
SELECT coalesce(o.k, c.k) AS custkey, o_orderkey, o_orderstatus, c_name, c_mktsegment
FROM o FULL OUTER JOIN c ON o.k IS NOT DISTINCT FROM c.k""",
    }


# ------------------------------------------------------ report-shaped tables

def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _chain(expr: str, pairs) -> str:
    """First-match replacements in order (DuckDB replaces the first match)."""
    for pat, rep in pairs:
        expr = f"regexp_replace({expr}, {_q(pat)}, {_q(rep)})"
    return expr


def _in_list(values) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


_CODES = "[" + ", ".join(_q(c) for c in NATION_CODES) + "]"
_STATE_DIM = "state_dim(code, name) AS (VALUES " + ", ".join(
    f"({_q(c)}, {_q(n)})" for c, n in STATE_NAMES) + ")"
_SHIFT = YEAR_SHIFT


def _recode_exclude(src: str, col: str) -> str:
    return (f"SELECT * FROM (SELECT * REPLACE ({_chain(col, STATE_RECODES)} AS {col}) FROM {src}) "
            f"WHERE {col} NOT IN {_in_list(EXCLUDED_STATES)}")


_BASE = f"""
oc AS (
  SELECT o.*, c.c_name, c.c_nationkey, c.c_mktsegment, c.c_acctbal
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey),
actions AS (
  SELECT CASE WHEN c_acctbal < 0 THEN 'N' ELSE 'B' END || CAST(o_custkey AS VARCHAR) AS beach_id,
    CASE WHEN o_orderkey % 13 = 0 THEN c_name || ' Cove' ELSE c_name END AS beach_name,
    CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE {_CODES}[c_nationkey + 1] END AS state,
    nullif(c_mktsegment, 'HOUSEHOLD') AS county,
    CASE WHEN o_orderkey % 101 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'Closure'
         WHEN o_orderstatus = 'O' THEN 'Contamination Advisory' ELSE 'Rain Advisory' END AS action_type,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'ELEV_BACT' WHEN '2-HIGH' THEN 'RAINFALL'
         WHEN '3-MEDIUM' THEN 'ELEV_BACT, RAINFALL' WHEN '4-NOT SPECIFIED' THEN 'SEWAGE'
         ELSE NULL END AS action_reasons,
    CASE WHEN o_totalprice > 300000 THEN 'ENTERO,RATIO' WHEN o_totalprice > 150000 THEN 'ENTERO'
         WHEN o_orderstatus = 'P' THEN 'PREEMPT' ELSE 'FECAL_COL, TOTAL_COL' END AS action_indicator,
    CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'CSO,SSO' WHEN 2 THEN 'POTW,SEWER_LINE'
         WHEN 3 THEN 'STORM' ELSE ' RUNOFF ' END AS action_possible_source,
    CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE CAST(floor(o_totalprice / 10000) AS BIGINT) END
      AS action_duration_days,
    CAST(year(o_orderdate) + {_SHIFT} AS INTEGER) AS year,
    o_orderkey AS _ord
  FROM oc),
clean AS ({_recode_exclude('actions', 'state')})"""

_NORM = {
    "action_reasons": lambda e: _chain(e, REASON_RECODES),
    "action_indicator": lambda e: _chain(e, INDICATOR_RECODES),
    "action_possible_source": lambda e: _chain(e, SOURCE_RECODES),
}
_LISTS = {"reasons": "action_reasons", "indicators": "action_indicator",
          "sources": "action_possible_source"}
_KEYS = ["beach_id", "beach_name", "state", "county"]


def _unnest(col: str) -> str:
    return f"unnest(coalesce(string_split({col}, ','), [NULL::VARCHAR]))"


_LONG = f"""
l1 AS (SELECT * EXCLUDE (action_reasons), {_unnest('action_reasons')} AS action_reasons FROM clean),
l2 AS (SELECT * EXCLUDE (action_indicator), {_unnest('action_indicator')} AS action_indicator FROM l1),
l3 AS (SELECT * EXCLUDE (action_possible_source), {_unnest('action_possible_source')}
         AS action_possible_source FROM l2),
long AS (
  SELECT * REPLACE ({_NORM['action_reasons']('trim(action_reasons)')} AS action_reasons,
                    {_NORM['action_indicator']('trim(action_indicator)')} AS action_indicator,
                    {_NORM['action_possible_source']('trim(action_possible_source)')}
                      AS action_possible_source)
  FROM l3)"""


def _per_beach() -> str:
    k = ", ".join(_KEYS)
    parts = []
    for out, src in _LISTS.items():
        parts.append(f"""
it_{out} AS (
  SELECT {k}, _ord, pos, {_NORM[src]('trim(v)')} AS v FROM (
    SELECT {k}, _ord, unnest(arr) AS v, unnest(range(1, len(arr) + 1)) AS pos
    FROM (SELECT {k}, _ord, coalesce(string_split({src}, ','), [NULL::VARCHAR]) AS arr FROM clean))),
fi_{out} AS (
  SELECT *, row_number() OVER (PARTITION BY {k}, v ORDER BY _ord, pos) AS rn FROM it_{out}),
ls_{out} AS (
  SELECT {k}, string_agg(coalesce(v, 'NA'), ', ' ORDER BY _ord, pos) AS {out}
  FROM fi_{out} WHERE rn = 1 GROUP BY {k})""")
    on = lambda a, b: " AND ".join(f"{a}.{c} IS NOT DISTINCT FROM {b}.{c}" for c in _KEYS)
    cats = ",\n    ".join(
        f"CASE WHEN COUNT(action_type) = COUNT(*) THEN CAST(SUM(CASE WHEN action_type = {_q(v)} "
        f"THEN 1 ELSE 0 END) AS BIGINT) END AS {o}" for o, v in ACTION_TYPES.items())
    return ",".join(parts) + f""",
numbers AS (
  SELECT beach_id, COUNT(*) AS no_of_beach_actions,
    CASE WHEN COUNT(action_duration_days) = COUNT(*) THEN CAST(SUM(action_duration_days) AS BIGINT)
         END AS no_of_days_under_action,
    {cats}
  FROM clean GROUP BY beach_id),
pb AS (
  SELECT r.beach_id, r.beach_name, r.state, r.county, r.reasons, i.indicators, s.sources,
         n.no_of_beach_actions, n.no_of_days_under_action, n.closure, n.rain_advisory,
         n.contamination_advisory
  FROM ls_reasons r JOIN ls_indicators i ON {on('r', 'i')} JOIN ls_sources s ON {on('r', 's')}
  LEFT JOIN numbers n ON r.beach_id IS NOT DISTINCT FROM n.beach_id)"""


_PROFILE = f"""
profile AS (
  SELECT 'B' || CAST(o_custkey AS VARCHAR) AS beach_id, c_name AS beach_name,
    {_CODES}[c_nationkey + 1] AS state_code, nullif(c_mktsegment, 'HOUSEHOLD') AS county,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Active' WHEN '2-HIGH' THEN 'No advisory or closure'
         WHEN '3-MEDIUM' THEN 'Historical' WHEN '4-NOT SPECIFIED' THEN 'Dormant' ELSE NULL END
      AS beach_status,
    CAST(year(o_orderdate) + {_SHIFT} AS INTEGER) AS year, o_orderkey AS _ord
  FROM oc),
pclean AS ({_recode_exclude('profile', 'state_code')}),
snap AS (
  SELECT beach_id, beach_name, state_code AS state, county, beach_status, _ord FROM (
    SELECT *, row_number() OVER (PARTITION BY beach_id, beach_status ORDER BY _ord) AS rn
    FROM pclean)
  WHERE rn = 1 AND year = {SNAPSHOT_YEAR})"""

_ALL = f"""
j AS (
  SELECT coalesce(pb.beach_id, s.beach_id) AS beach_id,
         coalesce(pb.beach_name, s.beach_name) AS beach_name,
         coalesce(pb.state, s.state) AS state, coalesce(pb.county, s.county) AS county,
         pb.reasons, pb.indicators, pb.sources, pb.no_of_beach_actions,
         pb.no_of_days_under_action, pb.closure, pb.rain_advisory, pb.contamination_advisory,
         s.beach_status
  FROM pb FULL OUTER JOIN snap s
    ON pb.beach_id IS NOT DISTINCT FROM s.beach_id AND pb.beach_name IS NOT DISTINCT FROM s.beach_name
   AND pb.state IS NOT DISTINCT FROM s.state AND pb.county IS NOT DISTINCT FROM s.county),
allb AS (
  SELECT * EXCLUDE (beach_status),
    CASE WHEN beach_status = 'No advisory or closure' AND reasons IS NOT NULL THEN 'Active'
         WHEN beach_status = 'No advisory or closure' THEN 'Active: No advisory or closure'
         ELSE coalesce(beach_status, 'NA') END AS status
  FROM j WHERE NOT (beach_status = 'Historical' AND reasons IS NULL)),
{_STATE_DIM},
pub AS (SELECT allb.* REPLACE (sd.name AS state) FROM allb LEFT JOIN state_dim sd ON sd.code = allb.state)"""


def _na(col: str, alias: str) -> str:
    return f'coalesce(CAST({col} AS VARCHAR), \'NA\') AS "{alias}"'


def _summary() -> str:
    sums = ",\n    ".join(
        f"CASE WHEN COUNT({src}) = COUNT(*) THEN CAST(SUM({src}) AS BIGINT) END AS {out}"
        for out, src in SUMMARY_SUMS.items())
    return f"""
summary AS (
  SELECT {_CODES}[c_nationkey + 1] AS state, CAST(year(o_orderdate) + {_SHIFT} AS INTEGER) AS year,
    CAST(CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' AND month(o_orderdate) = 1
              THEN 1 ELSE 0 END AS BIGINT) AS no_of_beach_act_beaches,
    CASE WHEN o_orderkey % 211 = 0 THEN NULL
         ELSE CAST(CASE WHEN o_orderstatus = 'O' AND month(o_orderdate) = 1 THEN 1 ELSE 0 END AS BIGINT)
         END AS no_of_monitored_beaches,
    CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS BIGINT) AS no_of_monitored_beacheswith_actions,
    CAST(CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END AS BIGINT) AS no_of_monitored_beacheswithout_actions,
    CAST(1 AS BIGINT) AS total_no_of_beach_actions,
    CAST(floor(o_totalprice / 10000) AS BIGINT) AS no_of_days_undera_beach_action_monitored_beaches,
    CAST(floor(o_totalprice / 100000) AS BIGINT) AS no_of_days_not_undera_beach_action_monitored_beaches
  FROM oc),
sclean AS ({_recode_exclude('summary', 'state')}),
g AS (
  SELECT year, state,
    {sums}
  FROM sclean WHERE year IN ({', '.join(str(y) for y in SUMMARY_YEARS)}) GROUP BY year, state)"""


def report_sql() -> dict[str, str]:
    per_beach = _per_beach()
    state_sum_cols = ["no_of_beach_actions", "no_of_days_under_action", "closure",
                      "contamination_advisory", "rain_advisory"]
    sums = ", ".join(f"CAST(coalesce(SUM({c}), 0) AS BIGINT) AS {c}" for c in state_sum_cols)
    tot = ", ".join(f"CAST(SUM({c}) AS BIGINT)" for c in state_sum_cols)
    pub_cols = ", ".join(_na(c, a) for c, a in LABELS.items())
    keys = RECORD_KEYS
    rec_cols = ", ".join(f"coalesce(CAST({c} AS VARCHAR), 'NA') AS {k}" for k, c in keys.items())
    json_na = " || ',' || ".join(f"""'"{a}":' || coalesce(CAST(to_json({c}) AS VARCHAR), '"NA"')""" for c, a in LABELS.items())
    json_cols = ["beach_id", "beach_name", "state", "county", "reasons", "indicators", "sources", "no_of_beach_actions",
                 "no_of_days_under_action", "closure", "rain_advisory", "contamination_advisory", "status"]
    json = ", ".join(f"""CASE WHEN {c} IS NOT NULL THEN '"{c}":' || CAST(to_json({c}) AS VARCHAR) END""" for c in json_cols)
    display = []
    for k in keys:
        e = f"nullif({k}, 'NA')" if k in HIDE_NA_FIELDS else k
        e = f"upper({e})" if k in UPPER_FIELDS else e
        display.append(f"{e} AS {k}")
    display_cols = ", ".join(display)
    term = LOOKUP_TERM
    search = " OR ".join(
        f"regexp_matches(lower({f}), {_q(term)})" for f in
        ["bn", "bi", "s", "c", "r", "i", "so", "na", "nd", "cl", "ra", "ca", "st"])
    state_sums_sql = f"""WITH {_BASE},{per_beach},
ss AS (SELECT state, {sums}, COUNT(*) AS n FROM pb GROUP BY state),
r AS (SELECT *, CAST(no_of_beach_actions AS DOUBLE) / n AS actionsperbeach,
                CAST(no_of_days_under_action AS DOUBLE) / n AS daysperbeach FROM ss),
t AS (SELECT * FROM r UNION ALL
      SELECT 'Total', {tot}, CAST(SUM(n) AS BIGINT), SUM(actionsperbeach), SUM(daysperbeach) FROM r)
SELECT state, {', '.join(state_sum_cols)}, n AS number_of_beaches_with_actions,
       round(actionsperbeach, 6) AS actionsperbeach, round(daysperbeach, 6) AS daysperbeach
FROM t"""
    lookup = f"""WITH {_BASE},{per_beach},{_PROFILE},{_ALL},
rec AS (SELECT {rec_cols} FROM pub)
SELECT * FROM rec WHERE regexp_matches(s, {_q(LOOKUP_STATE)}) AND ({search})"""

    def summaries(percent: str) -> str:
        return f"""WITH {_BASE},{_summary()}
SELECT year, state, total_beaches, monitored_beaches, {percent} AS percent_monitored,
  beaches_with_actions, beaches_without_actions, total_actions, total_days_under_action,
  total_days_not_under_action
FROM (SELECT *,
  CASE WHEN monitored_beaches IS NULL OR total_beaches IS NULL THEN NULL
       WHEN total_beaches <> 0 THEN CAST(monitored_beaches AS DOUBLE) / total_beaches
       WHEN monitored_beaches > 0 THEN 'Infinity'::DOUBLE
       WHEN monitored_beaches < 0 THEN '-Infinity'::DOUBLE
       ELSE 'NaN'::DOUBLE END * 100 AS pct FROM g)"""

    def document(ctes: str, table: str, columns: list[str], order: str) -> str:
        """Header and rows of a CSV file with their places."""
        field = ("CASE WHEN {c} IS NULL THEN 'NA' WHEN regexp_matches(CAST({c} AS VARCHAR), '[,\"\\n]') "
                 "THEN '\"' || replace(CAST({c} AS VARCHAR), '\"', '\"\"') || '\"' ELSE CAST({c} AS VARCHAR) END")
        line = " || ',' || ".join(field.format(c=c) for c in columns)
        return f"""{ctes}
SELECT CAST(0 AS BIGINT) AS place, {_q(','.join(columns))} AS line UNION ALL
SELECT row_number() OVER (ORDER BY {order}), {line} FROM ({table})"""

    site_keys = ", ".join(f"{k} NULLS LAST" for k in _KEYS)
    pb_cols = [*_KEYS, "reasons", "indicators", "sources", "no_of_beach_actions", "no_of_days_under_action", "closure",
               "rain_advisory", "contamination_advisory"]
    sum_cols = ["state", *state_sum_cols, "number_of_beaches_with_actions", "actionsperbeach", "daysperbeach"]
    whole = lambda c: f"CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END AS {c}"
    lined = _BASE.replace("c_name || ' Cove'", "c_name || chr(10) || '\"Cove\"'")
    assert lined != _BASE
    return {
        "beach_csv_multiline": f"WITH {lined},{per_beach}\nSELECT * FROM pb",
        "beach_frequencies": f"WITH {_BASE},{_LONG}" + " UNION ALL ".join(f"""
SELECT '{c}' AS list, {c} AS value, CAST(COUNT(*) AS BIGINT) AS n FROM long GROUP BY ALL""" for c in _NORM),
        "beach_merged_deliveries": f"WITH {_BASE},{per_beach}\nSELECT * FROM pb",
        "beach_lookup_indexed": lookup,
        "beach_lookup_state": lookup.replace(f" AND ({search})", ""),
        "beach_document_beaches": document(f"WITH {_BASE},{per_beach}", "FROM pb", pb_cols, site_keys),
        "beach_document_state_sums": document("", f"""SELECT * REPLACE ({whole('actionsperbeach')}, {whole('daysperbeach')})
FROM ({state_sums_sql})""", sum_cols, "state = 'Total', state"),
        "beach_document_type_by_year": document(f"WITH {_BASE}", """SELECT action_type, year, COUNT(*) AS n FROM clean
WHERE action_type <> 'Rain Advisory' GROUP BY ALL""", ["action_type", "year", "n"], "action_type, year"),
        "beach_document_sources": document(f"WITH {_BASE},{_LONG}", """SELECT action_possible_source, COUNT(*) AS n FROM long
GROUP BY 1""", ["action_possible_source", "n"], "action_possible_source NULLS LAST"),
        "beach_json_array": f"WITH {_BASE},{per_beach},{_PROFILE},{_ALL}\nSELECT * FROM allb",
        "beach_json_na_array": f"WITH {_BASE},{per_beach},{_PROFILE},{_ALL}\nSELECT {pub_cols} FROM pub",
        "beach_clean_actions": f"WITH {_BASE}\nSELECT * EXCLUDE (_ord) FROM clean",
        "beach_long_actions": f"WITH {_BASE},{_LONG}\nSELECT * EXCLUDE (_ord) FROM long",
        "beach_reason_frequency": f"""WITH {_BASE},{_LONG}
SELECT action_reasons, CAST(COUNT(*) AS BIGINT) AS n FROM long GROUP BY 1""",
        "beach_indicator_frequency": f"""WITH {_BASE},{_LONG}
SELECT action_indicator, CAST(COUNT(*) AS BIGINT) AS n FROM long GROUP BY 1""",
        "beach_source_frequency": f"""WITH {_BASE},{_LONG}
SELECT action_possible_source, CAST(COUNT(*) AS BIGINT) AS n FROM long GROUP BY 1""",
        "beach_per_beach": f"WITH {_BASE},{per_beach}\nSELECT * FROM pb",
        "beach_csv_per_beach": f"WITH {_BASE},{per_beach}\nSELECT * FROM pb",
        "beach_state_sums": state_sums_sql,
        "beach_states_by_contamination": f"""SELECT *, closure + contamination_advisory AS contamclose
FROM ({state_sums_sql})""",
        "beach_reason_shares": f"""WITH {_BASE}
SELECT action_reasons, COUNT(*) AS n,
       round(CAST(COUNT(*) AS DOUBLE) / (SELECT COUNT(*) FROM clean) * 100, 6) AS "Pct"
FROM clean GROUP BY 1""",
        "beach_reason_token_shares": f"""WITH {_BASE},
toks AS (SELECT DISTINCT _ord, trim(t) AS token
         FROM (SELECT _ord, {_unnest('action_reasons')} AS t FROM clean))
SELECT token, COUNT(*) AS n,
       round(CAST(COUNT(*) AS DOUBLE) / (SELECT COUNT(*) FROM clean) * 100, 6) AS pct
FROM toks WHERE token IN ('ELEV_BACT', 'RAINFALL') GROUP BY token""",
        "beach_with_closures": f"WITH {_BASE},{per_beach}\nSELECT * FROM pb WHERE closure > 0",
        "beach_with_contamination": f"WITH {_BASE},{per_beach}\nSELECT * FROM pb WHERE contamination_advisory > 0",
        "beach_with_rain": f"WITH {_BASE},{per_beach}\nSELECT * FROM pb WHERE rain_advisory > 0",
        "beach_action_types": f"WITH {_BASE}\nSELECT action_type, COUNT(*) AS n FROM clean GROUP BY 1",
        "beach_snapshot": f"WITH {_BASE},{_PROFILE}\nSELECT * EXCLUDE (_ord) FROM snap",
        "beach_snapshot_check_count": f"""WITH {_BASE},{_PROFILE}
SELECT state, COUNT(*) AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY beach_id ORDER BY _ord) AS rn
  FROM snap WHERE beach_status <> 'Historical')
WHERE rn = 1 GROUP BY state""",
        "beach_all_status": f"WITH {_BASE},{per_beach},{_PROFILE},{_ALL}\nSELECT * FROM allb",
        "beach_status_counts": f"""WITH {_BASE},{per_beach},{_PROFILE},{_ALL}
SELECT status, COUNT(*) AS n FROM allb GROUP BY 1""",
        "beach_state_counts": f"""WITH {_BASE},{per_beach},{_PROFILE},{_ALL}
SELECT state, COUNT(*) AS n FROM allb GROUP BY 1""",
        "beach_dormant_with_actions": f"""WITH {_BASE},{per_beach},{_PROFILE},{_ALL}
SELECT * FROM allb WHERE status = 'Dormant' AND no_of_beach_actions > 0""",
        "beach_type_by_year": f"""WITH {_BASE}
SELECT action_type, year, COUNT(*) AS n FROM clean WHERE action_type <> 'Rain Advisory' GROUP BY 1, 2""",
        "beach_publication": f"""WITH {_BASE},{per_beach},{_PROFILE},{_ALL}
SELECT {pub_cols} FROM pub""",
        "beach_state_summaries": summaries("round(pct, 6)"),
        "beach_csv_state_summaries": summaries("round(pct, 6)"),
        "beach_state_summaries_text": summaries("""
  CASE WHEN isnan(pct) THEN 'NaN' WHEN isinf(pct) AND pct > 0 THEN 'Inf' WHEN isinf(pct) THEN '-Inf'
       WHEN pct = floor(pct) THEN CAST(CAST(pct AS BIGINT) AS VARCHAR) ELSE CAST(pct AS VARCHAR) END"""),
        "beach_csv_snapshot": f"WITH {_BASE},{_PROFILE}\nSELECT * EXCLUDE (_ord) FROM snap",
        "beach_json": f"""WITH {_BASE},{per_beach},{_PROFILE},{_ALL}
SELECT '{{' || concat_ws(',', {json}) || '}}' AS value FROM allb""",
        "beach_json_na": f"""WITH {_BASE},{per_beach},{_PROFILE},{_ALL}
SELECT '{{' || {json_na} || '}}' AS value FROM pub""",
        "beach_records_search": lookup,
        "beach_lookup": lookup,
        "beach_display": f"""WITH {_BASE},{per_beach},{_PROFILE},{_ALL},
rec AS (SELECT {rec_cols} FROM pub)
SELECT {display_cols} FROM rec""",
        "beach_state_list": f"""WITH {_BASE},{per_beach},{_PROFILE},{_ALL},
rec AS (SELECT {rec_cols} FROM pub)
SELECT DISTINCT s FROM rec""",
    }
