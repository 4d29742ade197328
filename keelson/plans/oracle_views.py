"""DuckDB twins of ``keelson.plans.views`` as CTE fragments.

``with_views("feed", ...)`` returns a ``WITH`` prefix defining the named views over the
driver's pre-registered tables. Literals are cast to DOUBLE where Spark uses doubles (a bare
``1.0`` is DECIMAL in DuckDB).
"""

from __future__ import annotations

from keelson.plans.views import EVENT_CODES, SPLICE_MARKUP


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_CODE_CASE = "CASE " + " ".join(f"WHEN event_type = '{n}' THEN {c}" for n, c in EVENT_CODES) + " END"

FEED = f"""feed AS (
  SELECT event_id,
         CASE WHEN k = 13 THEN NULL ELSE user_id END AS did,
         CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS session_id,
         strftime(ts, '%Y%m%d') AS dt,
         event_type AS event_name,
         CAST({_CODE_CASE} AS INTEGER) AS error_code,
         value,
         least(value / CAST(500 AS DOUBLE), CAST(1 AS DOUBLE)) AS predict,
         CASE WHEN k = 7 THEN NULL WHEN k % 5 = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS label,
         CASE WHEN k = 11 THEN NULL ELSE k % 3 = 0 END AS enter_app,
         CASE WHEN k < 60 THEN 'old' WHEN k < 90 THEN 'new' ELSE 'unknown' END AS user_class
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) e
)"""

DENSE_IN = """dense_in AS (
  SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem
)"""


VOCAB_PART = """vocab_part AS (
  SELECT 'p_brand' AS feature, p_brand AS value, count(*) AS cnt FROM part GROUP BY p_brand
)"""
VOCAB_NEW = """vocab_new AS (
  SELECT 'p_brand' AS feature, p_brand AS value, count(*) AS cnt FROM lineitem JOIN part ON l_partkey = p_partkey
  GROUP BY p_brand
)"""
VOCAB_OLD = """vocab_old AS (
  SELECT feature, position, value FROM (
    SELECT feature, value,
           row_number() OVER (PARTITION BY feature ORDER BY cnt DESC, value ASC NULLS LAST) AS position
    FROM vocab_part) WHERE position <= 11
)"""

_MARKUP_CASE = (
    "CASE "
    + " ".join(f"WHEN page_id % {len(SPLICE_MARKUP)} = {i} THEN {_sql_str(m)}" for i, m in enumerate(SPLICE_MARKUP))
    + " END"
)

ARTICLES = f"""articles AS (
  SELECT 'd' || CAST(doc_id AS VARCHAR) AS article_id,
         CAST(to_json({{'rich_content': {{'text': text, 'spans': CAST([] AS VARCHAR[])}}}}) AS VARCHAR) AS content
  FROM documents
  UNION ALL
  SELECT 'd' || CAST(doc_id AS VARCHAR) || '-raw', '{{"rich_content":{{"text":"' || text || '","spans":[]}}}}' FROM documents
  UNION ALL
  SELECT 'p' || CAST(page_id AS VARCHAR) AS article_id,
         replace(html, '<body>', '<body>' || {_MARKUP_CASE}) AS content
  FROM pages
)"""

_VIEWS = {
    "feed": [FEED],
    "dense_in": [DENSE_IN],
    "vocab_old": [VOCAB_PART, VOCAB_OLD],
    "vocab_new": [VOCAB_NEW],
    "articles": [ARTICLES],
}


def with_views(*names: str) -> str:
    parts: list[str] = []
    for n in names:
        for frag in _VIEWS[n]:
            if frag not in parts:
                parts.append(frag)
    return "WITH " + ",\n".join(parts) + "\n"
