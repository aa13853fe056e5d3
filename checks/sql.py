"""The SQL (DuckDB) that each registered query is checked against, written from the tables and not from our code."""

from __future__ import annotations

_RUN = "'evt-' || strftime(ts, '%Y-%m-%d')"
_DAY = "strftime(ts, '%Y-%m-%d')"
_FEED = f"'feed/' || event_type || '/run_id=' || {_RUN} || '/part-' || (event_id % 4) || '.parquet'"

_MIXED = f"""
mixed AS (
  SELECT CASE event_id % 9
    WHEN 0 THEN NULL
    WHEN 1 THEN ''
    WHEN 2 THEN 'feed/no-date/part-' || event_type
    WHEN 3 THEN 'feed/t/run_id=run_' || {_DAY} || '/x'
    WHEN 4 THEN 'feed/t/run_id=r-2024-13-45/x'
    WHEN 5 THEN 'feed//' || event_type || '-' || {_DAY} || '/x'
    WHEN 6 THEN 'other/t/run_id=o-' || {_DAY} || '/x'
    WHEN 7 THEN 'feed/t/run_id=/run_id=late-' || {_DAY} || '/x'
    ELSE 'feed/t/run_id=r-' || {_DAY} || '-a/x' END AS name
  FROM events)"""

_FOUND = """
found AS (
  SELECT coalesce(nullif(regexp_extract(substr(name, 6), '(?:^|/)run_id=([^/]+)', 1), ''),
                  nullif(regexp_extract(substr(name, 6), '^/*([^/]+)', 1), '')) AS run_id
  FROM mixed WHERE name LIKE 'feed/_%'),
dated AS (
  SELECT run_id, nullif(regexp_extract(run_id, '\\b(\\d{4}-\\d{2}-\\d{2})\\b', 1), '') AS day FROM found)"""

_HISTORY = """
history AS (
  SELECT DISTINCT strftime(ts - INTERVAL 3 DAY, '%Y-%m-%dT%H%M%S.%gZ') AS folder,
    strftime(ts - INTERVAL 3 DAY, '%Y-%m-%d') AS day
  FROM events)"""

_RUNS = f"runs AS (SELECT DISTINCT {_RUN} AS run_id, CAST(ts AS DATE) AS run_date FROM events)"

_LINE_COLUMNS = (
    "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, {discount} AS l_discount, "
    "l_tax, l_returnflag, l_linestatus, l_shipdate"
)
_LINES = f"""
a AS (SELECT {_LINE_COLUMNS.format(discount="l_discount")} FROM lineitem),
changed AS (
  SELECT {_LINE_COLUMNS.format(discount="CASE WHEN l_orderkey % 97 = 0 THEN 0.5 ELSE l_discount END")} FROM lineitem),
b AS (SELECT * FROM changed UNION ALL SELECT * FROM changed WHERE l_orderkey % 101 = 0)"""

_ORDERS = """
a AS (SELECT o_custkey, o_orderstatus FROM orders),
b AS (SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 10 <> 3)"""

_EVENTS = f"""
a AS (SELECT {_RUN} AS run_id, user_id, event_type FROM events),
b AS (SELECT * FROM a WHERE user_id % 50 <> 7)"""


def _totals(by: str = "") -> str:
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
  SELECT {keys}
    CAST((count(*) FILTER (side = 1)) AS BIGINT) AS left_count,
    CAST((count(*) FILTER (side = -1)) AS BIGINT) AS right_count
  FROM (SELECT 1 AS side, * FROM a UNION ALL SELECT -1, * FROM b) {group}"""


def _counts(by: str = "") -> str:
    """Counts of both sides and of the two EXCEPT ALL differences."""
    if not by:
        return """
  (SELECT count(*) FROM a) AS left_count, (SELECT count(*) FROM b) AS right_count,
  (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS only_in_left,
  (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS only_in_right"""
    return f"""
counts AS (
  SELECT k.{by}, coalesce(la.n, 0) AS left_count, coalesce(rb.n, 0) AS right_count,
         coalesce(ol.n, 0) AS only_in_left, coalesce(r2.n, 0) AS only_in_right
  FROM (SELECT {by} FROM a UNION SELECT {by} FROM b) k
  LEFT JOIN (SELECT {by}, count(*) AS n FROM a GROUP BY 1) la ON la.{by} = k.{by}
  LEFT JOIN (SELECT {by}, count(*) AS n FROM b GROUP BY 1) rb ON rb.{by} = k.{by}
  LEFT JOIN (SELECT {by}, count(*) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY 1) ol ON ol.{by} = k.{by}
  LEFT JOIN (SELECT {by}, count(*) AS n FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) GROUP BY 1) r2 ON r2.{by} = k.{by})"""


def _verdict(path: str) -> str:
    """Report columns from the four counts of equal schemas."""
    return f"""
  '{path}' AS path,
  CASE WHEN only_in_left + only_in_right = 0 THEN 'PASS' ELSE 'FAIL' END AS status,
  left_count, right_count, only_in_left, only_in_right, only_in_left + only_in_right AS differing_rows,
  true AS schema_match, true AS comparable, '' AS schema_differences,
  CASE WHEN only_in_left + only_in_right = 0 THEN NULL
       WHEN left_count <> right_count
       THEN 'Mismatch at {path}: row count differs: left=' || left_count || ', right=' || right_count
       ELSE 'Mismatch at {path}: rows differ: ' || only_in_left || ' only in left, ' || only_in_right
            || ' only in right (duplicates count)' END AS error"""


_RUN_REPORT = f"""
{_EVENTS}, {_counts("run_id")}, {_RUNS},
newest AS (SELECT * FROM runs ORDER BY run_date DESC, run_id DESC LIMIT 20), {_HISTORY},
latest AS (SELECT day, max(folder) AS folder FROM history GROUP BY day),
report AS (
  SELECT n.run_id, n.run_date, '/mnt/input/history/' || l.folder || '/' AS raw_path, {_verdict("$.users")}
  FROM newest n JOIN counts c ON c.run_id = n.run_id
  LEFT JOIN latest l ON l.day = CAST(n.run_date AS VARCHAR))"""

_SUMMARY = """
summary AS (
  SELECT count(*) AS total, count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status <> 'PASS') AS failed
  FROM report)"""

_ORDER_FIELDS = [
    ("o_orderkey", "bigint"),
    ("o_custkey", "bigint"),
    ("o_orderstatus", "string"),
    ("o_totalprice", "double"),
    ("o_orderdate", "timestamp_ntz"),
    ("o_orderpriority", "string"),
]
_CUSTOMER_FIELDS = [
    ("c_custkey", "bigint"),
    ("c_name", "string"),
    ("c_nationkey", "int"),
    ("c_acctbal", "double"),
    ("c_mktsegment", "string"),
]
_LINE_FIELDS = [
    ("l_orderkey", "bigint"),
    ("l_partkey", "bigint"),
    ("l_suppkey", "bigint"),
    ("l_linenumber", "int"),
    ("l_quantity", "double"),
    ("l_extendedprice", "double"),
    ("l_discount", "double"),
    ("l_tax", "double"),
    ("l_returnflag", "string"),
    ("l_linestatus", "string"),
    ("l_shipdate", "timestamp_ntz"),
]


def _field(name: str, kind: str, nullable: bool = True) -> str:
    return f"{name}: {kind} (nullable={nullable})"


def _schema_values() -> str:
    leaves = (("$.orders", _ORDER_FIELDS), ("$.customer", _CUSTOMER_FIELDS), ("$.lines", _LINE_FIELDS))
    rows = [
        f"('{path}', {i}, '{name}', '{kind}', true, '{_field(name, kind)}')"
        for path, fields in leaves
        for i, (name, kind) in enumerate(fields)
    ]
    return "fields(path, ordinal, name, type, nullable, field) AS (VALUES " + ", ".join(rows) + ")"


def _side_values() -> str:
    changed = {"o_orderstatus": ("o_status", "string", True), "o_custkey": ("o_custkey", "int", True)}
    changed["l_tax"] = ("l_tax", "double", False)
    leaves = (
        ("$.orders", _ORDER_FIELDS, _ORDER_FIELDS),
        ("$.customer", _CUSTOMER_FIELDS, _CUSTOMER_FIELDS[::-1]),
        ("$.lines", _LINE_FIELDS, _LINE_FIELDS),
    )
    rows = []
    for path, left, right in leaves:
        for i, (l, r) in enumerate(zip(left, right)):
            other = _field(*changed.get(r[0], (*r, True)))
            rows.append(f"('{path}', {i}, '{_field(*l)}', '{other}')")
    return "fields(path, ordinal, l, r) AS (VALUES " + ", ".join(rows) + ")"


_LEAF_ROWS = """
leaf_rows AS (
  SELECT '$.orders' AS path, count(*) AS rows FROM orders
  UNION ALL SELECT '$.customer', count(*) FROM customer
  UNION ALL SELECT '$.lines', count(*) FROM lineitem)"""

# White space that strip() removes at both ends of a text.
_SPACE = (
    "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || ' ' || chr(133) || "
    "chr(160) || chr(5760) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || "
    "chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288)"
)

_HTML_TEXT = f"""
trim(regexp_replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_replace(html,
    '<br\\s*/?>', chr(10), 'gi'),
    '</(?:p|div|h[1-6]|li|tr)>', chr(10), 'gi'),
    '<[^>]+>', '', 'g'),
  '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
  '\\n{{3,}}', chr(10) || chr(10), 'g'), {_SPACE})"""

# What the pages derived from customers say about one customer, line by line.
_WIKI = """
wiki AS (
  SELECT c_custkey // 10 AS page_id, c_custkey AS k, c_name AS name, c_mktsegment AS seg,
    CASE c_custkey % 3 WHEN 0 THEN c_name || ':' WHEN 1 THEN '  ' || upper(c_name) || ' '
                       ELSE c_name || ' : see below' END
    || chr(10) || 'segment ' || c_mktsegment || ' & more'
    || CASE WHEN c_custkey % 4 = 0 THEN chr(10) || c_name || ':' || chr(10) || 'again' ELSE '' END AS about
  FROM customer)"""

# The definition file entries of parts. An indented entry belongs to the entry above it as well, if that is in the same
# file and no unindented line stands between them.
_DEFS = """
entries AS (
  SELECT p_partkey AS k, p_partkey // 20 AS file,
    'part_' || p_partkey || '_feed:' || chr(10) || '  description: ' || p_name || chr(10) || '  schema:' || chr(10)
    || '    p_size:' || chr(10) || '      type: int' AS text
  FROM part),
defs AS (
  SELECT 'part_' || e.k || '_feed' AS key, 'defs/' || lpad(CAST(e.file AS VARCHAR), 5, '0') || '.yml' AS path,
    e.text || coalesce(chr(10) || chr(10) || '  ' || n.text, '') AS block
  FROM entries e LEFT JOIN entries n
    ON n.k = e.k + 1 AND n.file = e.file AND n.k % 7 = 0 AND n.k % 5 <> 0)"""


SQL: dict[str, str] = {
    # ------------------------------------------------------------ discovery
    "discover_runs": f"""
WITH listing AS (SELECT {_FEED} AS name FROM events),
ids AS (SELECT DISTINCT regexp_extract(name, '(?:^|/)run_id=([^/]+)', 1) AS run_id FROM listing)
SELECT run_id, CAST(regexp_extract(run_id, '\\b(\\d{{4}}-\\d{{2}}-\\d{{2}})\\b', 1) AS DATE) AS run_date
FROM ids ORDER BY run_date DESC, run_id DESC LIMIT 20""",
    "runs_in_window": f"""
WITH {_MIXED}, {_FOUND}
SELECT DISTINCT run_id, TRY_CAST(day AS DATE) AS run_date FROM dated
WHERE TRY_CAST(day AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""",
    "dropped_names": f"""
WITH {_MIXED}, {_FOUND}
SELECT 'empty name' AS reason, count(*) AS names FROM mixed WHERE name IS NULL OR name = ''
UNION ALL SELECT 'outside prefix', count(*) FROM mixed WHERE name <> '' AND name NOT LIKE 'feed/_%'
UNION ALL SELECT 'no date', count(*) FROM dated WHERE day IS NULL
UNION ALL SELECT 'impossible date', count(*) FROM dated WHERE day IS NOT NULL AND TRY_CAST(day AS DATE) IS NULL""",
    "snapshot_folders": f"WITH {_HISTORY} SELECT folder, day FROM history",
    "latest_snapshot": f"WITH {_HISTORY} SELECT day, max(folder) AS folder FROM history GROUP BY day",
    "resolve_raw_path": f"""
WITH {_RUNS}, {_HISTORY}, latest AS (SELECT day, max(folder) AS folder FROM history GROUP BY day)
SELECT run_id, run_date, '/mnt/input/history/' || folder || '/' AS raw_path,
       CASE WHEN folder IS NULL THEN 'MISSING' ELSE 'FOUND' END AS raw_status
FROM runs LEFT JOIN latest ON day = CAST(run_date AS VARCHAR)""",
    "resolve_raw_path_template": f"""
WITH {_RUNS} SELECT run_id, run_date, '/data/' || run_id || '/raw/' AS raw_path, 'FOUND' AS raw_status FROM runs""",
    "norm_paths": """
WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*(.*)$', 1) AS x FROM pages),
q AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN '//' || x || '//' ELSE x END AS x FROM p)
SELECT page_id, CASE WHEN trim(x, '/') = '' THEN '' ELSE trim(x, '/') || '/' END AS prefix, rtrim(x, '/') || '/' AS dir FROM q""",
    # ------------------------------------------------------------ relational steps
    "lit_columns": "SELECT o_orderkey, 'box' AS unit, 12 AS factor FROM orders",
    "project": "SELECT l_orderkey, l_quantity FROM lineitem",
    "filter_isin": "SELECT p_partkey, p_size FROM part WHERE p_size IN (7, 14, 28, 42)",
    "left_join_using": """
SELECT o_custkey, o_orderkey, c_name FROM orders
LEFT JOIN (SELECT c_custkey + 100 AS o_custkey, c_name FROM customer) USING (o_custkey)""",
    "left_join_alias": """
SELECT o_orderkey, o_custkey, c_custkey, c_name FROM orders
LEFT JOIN (SELECT c_custkey + 100 AS c_custkey, c_name FROM customer) c ON o_custkey = c_custkey""",
    "left_join_chain": """
SELECT c_name, n_name, r_name FROM customer
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
    "group_count": 'SELECT p_size, count(*) AS "count" FROM part GROUP BY p_size',
    "group_count_alias": "SELECT o_orderstatus, count(*) AS order_count FROM orders GROUP BY o_orderstatus",
    "row_counts": """
SELECT '$.orders' AS path, count(*) AS rows FROM orders UNION ALL SELECT '$.lineitem', count(*) FROM lineitem
UNION ALL SELECT '$.customer', count(*) FROM customer UNION ALL SELECT '$.events', count(*) FROM events""",
    # ------------------------------------------------------------ multiset differences
    "except_all_left": f"WITH {_ORDERS} SELECT * FROM a EXCEPT ALL SELECT * FROM b",
    "except_all_right": f"WITH {_LINES} SELECT * FROM b EXCEPT ALL SELECT * FROM a",
    "except_all_map": """
SELECT o_custkey % 50 AS c, o_orderstatus AS status, o_orderpriority AS priority FROM orders
EXCEPT ALL
SELECT o_custkey % 50, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 10 <> 3""",
    "diff_counts": f"WITH {_EVENTS} SELECT {_counts()}",
    "wide_parity": f"WITH {_LINES} SELECT {_counts()}",
    "hash_parity": f"""
WITH {_LINES}, {_counts("l_returnflag")}
SELECT *, 'changed' AS pair FROM counts
UNION ALL SELECT l_returnflag, count(*), count(*), 0, 0, 'equal' FROM a GROUP BY l_returnflag""",
    "bucketed_parity": f"WITH {_LINES}, {_counts('l_linestatus')} SELECT * FROM counts",
    "text_parity": f"""
WITH a AS (SELECT * FROM documents),
b AS (SELECT * REPLACE (CASE WHEN doc_id % 11 = 0 THEN text || '!' ELSE text END AS text) FROM documents), {_counts("lang")}
SELECT * FROM counts""",
    "row_tally": f"""
WITH {_ORDERS}
SELECT o_custkey, o_orderstatus, count(*) FILTER (side = 1) AS n_left, count(*) FILTER (side = 2) AS n_right
FROM (SELECT 1 AS side, * FROM a UNION ALL SELECT 2, * FROM b) GROUP BY 1, 2""",
    "differing_rows": f"""
WITH {_LINES},
l AS (SELECT * FROM a EXCEPT ALL SELECT * FROM b), r AS (SELECT * FROM b EXCEPT ALL SELECT * FROM a)
SELECT *, count(*) AS copies FROM (SELECT *, 'left' AS side FROM l UNION ALL SELECT *, 'right' FROM r) GROUP BY ALL""",
    "sample_of_clashing_names": f"""
WITH {_ORDERS},
d AS (SELECT o_custkey % 3 AS rank, 'left' AS side,
             '{{"copies":' || o_custkey || ',"side":"' || o_orderstatus || '"}}' AS row, count(*) AS copies
      FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY 1, 2, 3)
SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY rank, side ORDER BY row) <= 2""",
    "empty_differences": f"""
WITH {_ORDERS}
SELECT 'unequal' AS pair, count(*) = 0 AS empty FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
UNION ALL SELECT 'equal', count(*) < 0 OR true FROM a""",
    "diff_sample": f"WITH {_ORDERS} SELECT * FROM a EXCEPT ALL SELECT * FROM b ORDER BY ALL LIMIT 20",
    "sample_by_group": f"""
WITH {_EVENTS},
d AS (SELECT run_id, 'left' AS side, '{{"user_id":' || user_id || ',"event_type":"' || event_type || '"}}' AS row,
             count(*) AS copies
      FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY 1, 2, 3)
SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY run_id, side ORDER BY row) <= 3""",
    # ------------------------------------------------------------ comparison of outputs
    "run_parity": f"WITH {_EVENTS}, {_counts('run_id')} SELECT run_id, {_verdict('$')} FROM counts",
    "run_report": f"WITH {_RUN_REPORT} SELECT * FROM report",
    "report_summary": f"""
WITH {_RUN_REPORT}, {_SUMMARY}
SELECT total, passed, failed, CASE WHEN total = 0 THEN 'NO_RUNS' WHEN failed = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict
FROM summary""",
    "report_failures": f"WITH {_RUN_REPORT} SELECT run_id, run_date, error FROM report WHERE status <> 'PASS'",
    "report_rows": f"""
WITH {_RUN_REPORT}
SELECT run_id, path, path || ': ' || left_count || ' | ' || right_count AS counts,
  'left_count=' || left_count || ', right_count=' || right_count || ', only_in_left=' || only_in_left
  || ', only_in_right=' || only_in_right AS details,
  'rows only in legacy: ' || only_in_left || ', only in refactored: ' || only_in_right || ', total differing rows: '
  || differing_rows AS total
FROM report""",
    "report_text": f"""
WITH {_RUN_REPORT}, {_SUMMARY},
head(section, pos, line) AS (
  SELECT 0, 0, 'comparison report' UNION ALL SELECT 0, 1, repeat('=', 60)
  UNION ALL SELECT 0, 2, 'run_ids: ' || total FROM summary UNION ALL SELECT 0, 3, ''
  UNION ALL SELECT 2, 0, '' UNION ALL SELECT 2, 1, repeat('=', 60)
  UNION ALL SELECT 2, 2, 'Passed: ' || passed || ' / ' || total FROM summary),
blocks AS (
  SELECT 1 AS section, run_date, run_id, path, unnest([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14]) AS pos,
    unnest([repeat('-', 60), 'run_id:     ' || run_id, 'run_date:   ' || run_date,
      'raw_data:   ' || coalesce(raw_path, '-'), 'path:       ' || path, 'status:     ' || status,
      'row counts (legacy | refactored): ' || path || ': ' || left_count || ' | ' || right_count,
      'row difference counts: rows only in legacy: ' || only_in_left || ', only in refactored: ' || only_in_right
      || ', total differing rows: ' || differing_rows,
      '  details: left_count=' || left_count || ', right_count=' || right_count || ', only_in_left=' || only_in_left
      || ', only_in_right=' || only_in_right,
      'schema match: ' || schema_match, 'schema (legacy | refactored):',
      '  ' || rpad('run_id: string (nullable=True)', 52, ' ') || ' | run_id: string (nullable=True)',
      '  ' || rpad('user_id: bigint (nullable=True)', 52, ' ') || ' | user_id: bigint (nullable=True)',
      '  ' || rpad('event_type: string (nullable=True)', 52, ' ') || ' | event_type: string (nullable=True)',
      'error: ' || error]) AS line
  FROM report)
SELECT section, CAST(NULL AS DATE) AS run_date, NULL AS run_id, NULL AS path, pos, line FROM head
UNION ALL SELECT * FROM blocks WHERE line IS NOT NULL""",
    "tree_parity": f"""
WITH n AS (SELECT (SELECT count(*) FROM customer) AS c, (SELECT count(*) FROM orders) AS o,
  (SELECT count(*) FROM orders WHERE o_orderkey % 10 <> 3) AS o2, (SELECT count(*) FROM lineitem) AS l),
none AS (SELECT CAST(NULL AS BIGINT) AS x, CAST(NULL AS BOOLEAN) AS b, CAST(NULL AS VARCHAR) AS t)
SELECT '$.same' AS path, 'PASS' AS status, c AS left_count, c AS right_count, 0 AS only_in_left, 0 AS only_in_right,
  0 AS differing_rows, true AS schema_match, true AS comparable, '' AS schema_differences, NULL AS error FROM n
UNION ALL SELECT '$.list[0]', 'FAIL', o, o2, o - o2, 0, o - o2, true, true, '',
  'Mismatch at $.list[0]: row count differs: left=' || o || ', right=' || o2 FROM n
UNION ALL SELECT '$.list[1]', 'FAIL', l, l, x, x, x, false, false, 'column ''l_tax'' only in legacy',
  'Mismatch at $.list[1]: schema differs: column ''l_tax'' only in legacy' FROM n, none
UNION ALL SELECT '$.gone', 'MISSING_LEAF', o, x, x, x, x, b, b, t, 'Mismatch at $.gone: only in left' FROM n, none
UNION ALL SELECT '$.flag', 'FAIL', x, x, x, x, x, b, b, t, 'Mismatch at $.flag: value left=1, right=2' FROM none""",
    "tree_shapes": f"""
WITH n AS (SELECT (SELECT count(*) FROM orders) AS o, (SELECT count(*) FROM orders WHERE o_orderkey % 10 <> 3) AS o2,
  (SELECT count(*) FROM part) AS p),
none AS (SELECT CAST(NULL AS BIGINT) AS x, CAST(NULL AS BOOLEAN) AS b, CAST(NULL AS VARCHAR) AS t)
SELECT '$.extra' AS path, 'MISSING_LEAF' AS status, x AS left_count, x AS right_count, x AS only_in_left, x AS only_in_right,
  x AS differing_rows, b AS schema_match, b AS comparable, t AS schema_differences,
  'Mismatch at $.extra: left={{}}, right=(missing)' AS error FROM none
UNION ALL SELECT '$.kind', 'FAIL', x, x, x, x, x, b, b, t, 'Mismatch at $.kind: value left={{}}, right=[]' FROM none
UNION ALL SELECT '$[''a.b'']', 'FAIL', o, o2, o - o2, 0, o - o2, true, true, '',
  'Mismatch at $[''a.b'']: row count differs: left=' || o || ', right=' || o2 FROM n
UNION ALL SELECT '$.a.b', 'PASS', p, p, 0, 0, 0, true, true, '', t FROM n, none
UNION ALL SELECT '$.keys{{1}}', 'PASS', x, x, x, x, x, b, b, t, t FROM none
UNION ALL SELECT '$.keys[''1'']', 'FAIL', x, x, x, x, x, b, b, t, 'Mismatch at $.keys[''1'']: value left=6, right=7' FROM none
UNION ALL SELECT '$.both', 'PASS', x, x, x, x, x, b, b, t, t FROM none
UNION ALL SELECT '$.list[0]', 'PASS', p, p, 0, 0, 0, true, true, '', t FROM n, none
UNION ALL SELECT '$.list[1]', 'MISSING_LEAF', x, x, x, x, x, b, b, t, 'Mismatch at $.list[1]: left=(missing), right=[]' FROM none""",
    "broken_leaf": f"""
WITH {_EVENTS}, {_counts('run_id')},
same AS (SELECT run_id, left_count, left_count AS right_count, 0 AS only_in_left, 0 AS only_in_right FROM counts),
none AS (SELECT CAST(NULL AS BIGINT) AS x, CAST(NULL AS BOOLEAN) AS b, CAST(NULL AS VARCHAR) AS t)
SELECT run_id, {_verdict('$.users')} FROM counts UNION ALL SELECT run_id, {_verdict('$.twice')} FROM same
UNION ALL SELECT run_id, '$.lost', 'ERROR', x, x, x, x, x, b, b, t,
  'Mismatch at $.lost: ValueError: column ''run_id'' must occur once in [''user_id'', ''event_type'']' FROM counts, none""",
    "each_run_report": f"""
WITH a AS (SELECT {_RUN} AS run_id, user_id, event_type FROM events),
b AS (SELECT * FROM a WHERE NOT (user_id % 50 = 7 AND run_id LIKE '%03')), {_counts('run_id')},
d AS (SELECT *, CAST(substr(run_id, 5) AS DATE) AS run_date, '/raw' AS raw_path FROM counts),
none AS (SELECT CAST(NULL AS BIGINT) AS x, CAST(NULL AS BOOLEAN) AS b, CAST(NULL AS VARCHAR) AS t)
SELECT run_id, run_date, raw_path, {_verdict('$.users')} FROM d WHERE right(run_id, 2) NOT IN ('01', '02')
UNION ALL SELECT run_id, run_date, raw_path, '$', 'PASS', x, x, x, x, x, b, b, t, t FROM d, none WHERE right(run_id, 2) = '01'
UNION ALL SELECT run_id, run_date, raw_path, '$', 'ERROR', x, x, x, x, x, b, b, t, 'ValueError: no such version'
FROM d, none WHERE right(run_id, 2) = '02'""",
    "bad_lines_report": f"""
WITH lines AS (SELECT {_RUN} AS run_id, event_id, user_id, event_type FROM events),
bad AS (SELECT run_id, '?' || event_id AS line FROM lines WHERE run_id LIKE '%05' AND event_id % 10 = 3),
a AS (SELECT run_id, user_id, event_type FROM lines WHERE NOT (run_id LIKE '%05' AND event_id % 10 = 3)),
b AS (SELECT * FROM a WHERE user_id % 50 <> 7), {_counts('run_id')},
none AS (SELECT CAST(NULL AS BIGINT) AS x, CAST(NULL AS BOOLEAN) AS b, CAST(NULL AS VARCHAR) AS t)
SELECT run_id, CAST(substr(run_id, 5) AS DATE) AS run_date, {_verdict('$')} FROM counts
UNION ALL
SELECT run_id, CAST(substr(run_id, 5) AS DATE), 'inputs.events', 'ERROR', any_value(x), any_value(x), any_value(x), any_value(x),
  any_value(x), any_value(b), any_value(b), any_value(t),
  'inputs.events: ' || count(*) || ' lines cannot be read, such as: ' || min(line)
FROM bad, none GROUP BY run_id""",
    "asserted": f"""
WITH {_ORDERS}, n AS (SELECT {_counts()}),
m AS (SELECT 'left has ' || left_count || ' rows, right ' || right_count || '; only in left: ' || only_in_left
        || ', only in right: ' || only_in_right AS said FROM n)
SELECT 'same' AS pair, 'equal' AS said UNION ALL SELECT 'same tree', 'equal' UNION ALL SELECT 'rows', said FROM m
UNION ALL SELECT 'schema', 'schema differs: column ''c_name'' only in legacy'
UNION ALL SELECT 'tree', 'Mismatch at $.o[0]: ' || said FROM m""",
    "named_table": "SELECT o_orderkey, o_orderstatus FROM orders",
    "delimited_round_trip": """
SELECT lang, count(*) AS left_count, count(*) AS right_count, CAST(0 AS BIGINT) AS only_in_left, CAST(0 AS BIGINT) AS only_in_right
FROM documents GROUP BY lang""",
    "listed_files": f"""
SELECT 'feed/run_id=' || run_id || '/part' AS name, CAST(1 AS BIGINT) AS files, true AS sized
FROM (SELECT DISTINCT {_RUN} AS run_id FROM events)
UNION ALL SELECT unnest(['feed/_SUCCESS', '_tmp/orders/_SUCCESS', '_tmp/orders/part']), 1, true""",
    "corpus_lines": """
SELECT lang, line, count(*) AS n FROM (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY ALL""",
    "schema_rows": f"WITH {_schema_values()}, {_LEAF_ROWS} SELECT * FROM fields JOIN leaf_rows USING (path)",
    "schema_diff": f"""
WITH found(path, pos, kind, name, difference) AS (VALUES
  ('$.orders', 0, 'left_only', 'o_orderstatus', 'column ''o_orderstatus'' only in legacy'),
  ('$.orders', 1, 'right_only', 'o_status', 'column ''o_status'' only in refactored'),
  ('$.orders', 2, 'changed', 'o_custkey',
   'column ''o_custkey'': legacy (bigint, nullable=True) vs refactored (int, nullable=True)'),
  ('$.customer', 0, 'order', '', 'column order differs: legacy order vs refactored order'),
  ('$.lines', 0, 'changed', 'l_tax',
   'column ''l_tax'': legacy (double, nullable=True) vs refactored (double, nullable=False)')),
{_LEAF_ROWS}
SELECT f.*, l.rows AS left_count, CASE WHEN path = '$.customer' THEN l.rows ELSE 0 END AS only_in_left,
  path = '$.lines' AS comparable
FROM found f JOIN leaf_rows l USING (path)""",
    "schema_side_by_side": f"""
WITH {_side_values()}, {_LEAF_ROWS}
SELECT path, ordinal, '  ' || rpad(l, 52, ' ') || ' | ' || r AS line, rows FROM fields JOIN leaf_rows USING (path)""",
    "schema_columns": f"""
WITH {_schema_values()}, {_LEAF_ROWS},
sides(path, name, side) AS (
  SELECT path, name, CASE WHEN name = 'o_orderstatus' THEN 'left' ELSE 'both' END FROM fields
  UNION ALL SELECT '$.orders', 'o_status', 'right')
SELECT * FROM sides JOIN leaf_rows USING (path)""",
    "pair_unused": f"""
WITH a AS (SELECT o_orderkey, o_orderpriority, o_totalprice, 'EUR' AS currency FROM orders), b AS (SELECT * FROM a),
n AS (SELECT {_counts()}) SELECT {_verdict("$")} FROM n""",
    "pair_dead": f"""
WITH a AS (SELECT o_orderkey, c_name, o_totalprice FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
b AS (SELECT o_orderkey, (SELECT c_name FROM customer WHERE c_custkey = o_custkey) AS c_name, o_totalprice FROM orders),
n AS (SELECT {_counts()}) SELECT {_verdict("$")} FROM n""",
    "pair_alias": f"""
WITH a AS (SELECT c_name, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
           LEFT JOIN region ON n_regionkey = r_regionkey),
b AS (SELECT c_name, n_name, r_name FROM customer
      LEFT JOIN (SELECT * FROM nation LEFT JOIN region ON n_regionkey = r_regionkey) ON c_nationkey = n_nationkey),
n AS (SELECT {_counts()}) SELECT {_verdict("$")} FROM n""",
    # ------------------------------------------------------------ scalar functions over tables
    "html_text": f"SELECT page_id, {_HTML_TEXT} AS text FROM pages",
    "page_ref": """
SELECT page_id, CASE WHEN page_id % 9 = 0 THEN CAST(page_id AS VARCHAR)
  ELSE nullif(regexp_extract(regexp_replace(url, '/(en|fr|de|es)/', '/pages/'), '/pages/([0-9]+)(/|$)', 1), '') END AS ref_id
FROM pages""",
    "repo_slugs": """
SELECT page_id, CASE WHEN page_id % 6 < 3 THEN 'acme/r' || page_id END AS slug FROM pages""",
    "pipeline_names": """
WITH n AS (SELECT page_id, 'p' || page_id || CASE WHEN page_id % 3 = 1 THEN '.v2' ELSE '' END AS pipeline FROM pages)
SELECT page_id, pipeline, pipeline || '_feed' AS output FROM n""",
    "redacted_settings": """
WITH k AS (SELECT s_suppkey, unnest(['API_KEY', 'author', 'region', 'db_password']) AS key,
                  CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'v' || s_suppkey END AS v FROM supplier)
SELECT s_suppkey, key,
  CASE WHEN regexp_matches(upper(key), 'SECRET|PASSWORD|TOKEN|KEY|CREDENTIAL|AUTH|PRIVATE')
       THEN CASE WHEN v = '' THEN '(not set)' ELSE '(redacted)' END ELSE v END AS value
FROM k""",
    "redacted_whole_words": """
SELECT s_suppkey, key, CASE WHEN hidden THEN '(redacted)' ELSE CAST(s_suppkey AS VARCHAR) END AS value FROM supplier,
  (VALUES ('authToken', true), ('dbPassword', true), ('API_KEYS', true), ('PASSWORDS', true), ('author', false),
          ('monkey', false), ('keyboard', false), ('my.key', true), ('APIKey', true), ('tokenizer', false)) AS k(key, hidden)""",
    "redacted_map": """
SELECT s_suppkey, 'db_token' AS key, '(redacted)' AS value FROM supplier
UNION ALL SELECT s_suppkey, 'region', CAST(s_suppkey AS VARCHAR) FROM supplier""",
    # ------------------------------------------------------------ text sections
    "section_between": """
SELECT page_id, CASE WHEN contains(html, '<article>')
                     THEN split_part(split_part(html, '<article>', 2), '</article>', 1) END AS article
FROM pages""",
    "page_parts": f"""
WITH {_WIKI}
SELECT page_id, chr(10) || string_agg(about || chr(10), '' ORDER BY k) AS inputs,
  rtrim(chr(10)
    || coalesce(string_agg('****' || chr(10) || name || ':' || chr(10) || 'logic of ' || seg || chr(10), '' ORDER BY k)
                FILTER (WHERE k % 2 = 0), '')
    || '****' || chr(10)
    || coalesce(string_agg('# ' || name || chr(10) || 'rule of ' || seg || chr(10), '' ORDER BY k)
                FILTER (WHERE k % 2 = 1), ''), chr(10)) AS logic
FROM wiki GROUP BY page_id""",
    "named_blocks": f"WITH {_WIKI} SELECT page_id, name, trim(about) AS block FROM wiki",
    "marker_blocks": f"WITH {_WIKI} SELECT page_id, name, 'logic of ' || seg AS block FROM wiki WHERE k % 2 = 0",
    "heading_blocks": f"WITH {_WIKI} SELECT page_id, name, 'rule of ' || seg AS block FROM wiki WHERE k % 2 = 1",
    "logic_blocks": f"""
WITH {_WIKI}
SELECT page_id, name, CASE WHEN k % 2 = 0 THEN 'logic of ' ELSE 'rule of ' END || seg AS block FROM wiki""",
    # ------------------------------------------------------------ definition files and context
    "pick_file": f"WITH {_DEFS} SELECT key, path FROM defs",
    "key_blocks": f"WITH {_DEFS} SELECT key, path, block FROM defs",
    "strip_keys": """
WITH t AS (SELECT *, 'part_' || p_partkey || '_feed' AS "table" FROM part)
SELECT "table", '' AS "column", 'description' AS name, p_name AS value FROM t
UNION ALL SELECT "table", '', 'type', p_type FROM t
UNION ALL SELECT "table", 'p_size', 'description', 'size of ' || p_name FROM t
UNION ALL SELECT "table", 'p_brand', 'type', 'string' FROM t
UNION ALL SELECT "table", 'p_brand', 'format', p_brand FROM t""",
    "source_tables": """
SELECT c_name AS pipeline, 0 AS pos, 'part_' || (c_custkey % 50) || '_feed' AS "table" FROM customer
UNION ALL SELECT c_name, 2, c_name || '_feed' FROM customer
UNION ALL SELECT c_name, 3, c_name FROM customer
UNION ALL SELECT c_name, 4, 'ghost_feed' FROM customer""",
    "tables_to_search": """
SELECT c_name AS pipeline, -1 AS pos, c_name || '_feed' AS "table" FROM customer
UNION ALL SELECT c_name, 0, 'part_' || (c_custkey % 50) || '_feed' FROM customer
UNION ALL SELECT c_name, 3, c_name FROM customer
UNION ALL SELECT c_name, 4, 'ghost_feed' FROM customer""",
    "strip_definition_text": """
SELECT p_partkey, 'part_' || p_partkey || '_feed:' || chr(10) || '  description: ' || p_name || chr(10) || '  schema:' || chr(10)
  || '    p_size:' || chr(10) || '      description: size of' || chr(10) || '        ' || p_name || chr(10)
  || '    p_brand:' || chr(10) || '      type: string' || chr(10) || '      format: ' || p_brand || chr(10)
  || '  owner: team' AS text
FROM part""",
    "merge_definitions": f"""
WITH {_DEFS}
SELECT c_name AS pipeline, 0 AS pos, d.key AS "table", d.block AS text
FROM customer JOIN defs d ON d.key = 'part_' || (c_custkey % 50) || '_feed'
UNION ALL SELECT c_name, 2, c_name || '_feed', '(No definition found.)' FROM customer
UNION ALL SELECT c_name, 3, c_name, 'page of ' || c_name FROM customer
UNION ALL SELECT c_name, 4, 'ghost_feed', '(No definition found.)' FROM customer""",
    "assemble_context": f"""
WITH {_WIKI}, {_DEFS},
rest AS (SELECT page_id, k, name, seg,
           trim(string_agg(about, chr(10)) OVER (PARTITION BY page_id ORDER BY k DESC)) AS below FROM wiki),
page AS (SELECT a.k, a.name, a.seg, trim(string_agg(b.about, chr(10) ORDER BY b.k)) AS below
         FROM wiki a JOIN wiki b ON b.page_id = a.page_id AND b.k >= a.k GROUP BY ALL)
SELECT name AS pipeline,
  '# Pre-ETL Business Logic' || chr(10) || '## ' || name || chr(10)
  || CASE WHEN k % 2 = 0 THEN 'logic of ' ELSE 'rule of ' END || seg || chr(10) || chr(10)
  || '# Output Table' || chr(10) || '## ' || name || '_feed' || chr(10) || '(No definition found.)' || chr(10) || chr(10)
  || '# Input Tables' || chr(10)
  || '## part_' || (k % 50) || '_feed' || chr(10) || chr(10) || replace(d.block, chr(10) || chr(10), chr(10)) || chr(10) || chr(10)
  || '## ' || name || chr(10) || chr(10) || below || chr(10) || chr(10)
  || '## ghost_feed' || chr(10) || chr(10) || '(No definition found.)' || chr(10) || chr(10) AS document
FROM page JOIN defs d ON d.key = 'part_' || (k % 50) || '_feed'""",
}

SQL["written_context"] = SQL["assemble_context"]
SQL["written_report"] = f"SELECT line, count(*) AS n FROM ({SQL['report_text']}) GROUP BY line"
