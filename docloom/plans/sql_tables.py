"""SQL common table expressions of the derived tables, for the oracle side."""

WORD_BREAK = r"[^\p{L}\p{N}]+"


def words_of(table: str, key: str, text: str, name: str) -> str:
    return f"""{name} AS (
  SELECT {key}, list_filter(string_split_regex(lower({text}), '{WORD_BREAK}'), lambda x: x <> '') AS words FROM {table})"""


LINES = """lines AS (
  SELECT doc_id, CAST(generate_subscripts(a, 1) AS BIGINT) AS line_no, unnest(a) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents))"""

BLOCKS = LINES + """, blocks AS (
  SELECT doc_id, (line_no - 1) // 40 AS page_idx, (line_no - 1) % 40 AS block_idx,
    CASE WHEN line_no = 1 THEN 'title' WHEN (line_no - 1) % 40 = 39 THEN 'page_number'
         WHEN line_no % 17 = 0 THEN 'table' WHEN line_no % 17 = 1 AND line_no > 1 THEN 'caption' ELSE 'text' END AS type,
    50 + (doc_id * 7 + line_no * 13) % 5 * 10 AS x0, (line_no - 1) % 40 * 20 AS y0,
    50 + (doc_id * 7 + line_no * 13) % 5 * 10 + least(500, 5 * length(line)) AS x1,
    (line_no - 1) % 40 * 20 + 16 AS y1, line AS text, line_no
  FROM lines WHERE trim(line, ' ') <> '')"""

SPANS = BLOCKS + """, span_words AS (
  SELECT doc_id, page_idx, block_idx, x0 AS bx0, y0 AS by0,
    CAST(generate_subscripts(a, 1) - 1 AS BIGINT) AS span_idx, unnest(a) AS content
  FROM (SELECT *, string_split(text, ' ') AS a FROM blocks)), spans AS (
  SELECT doc_id, page_idx, block_idx, span_idx, content, sx AS x0, by0 + (span_idx * 3) % 5 AS y0,
    sx + 5 * length(content) AS x1, by0 + (span_idx * 3) % 5 + 12 AS y1
  FROM (SELECT *, CAST(bx0 + coalesce(sum(5 * length(content) + 3) OVER (PARTITION BY doc_id, page_idx, block_idx
          ORDER BY span_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS sx FROM span_words))"""

BOXES = """boxes AS (
  SELECT l_orderkey AS page, (l_partkey * 100000 + l_suppkey) * 10 + l_linenumber AS box_id,
    l_quantity AS x0, CAST(l_partkey % 50 AS DOUBLE) AS y0, l_quantity + 10 + 3 * l_linenumber AS x1,
    CAST(l_partkey % 50 + 10 + l_suppkey % 7 AS DOUBLE) AS y1, l_discount AS score, l_returnflag AS label
  FROM lineitem)"""

INTERVALS = """intervals AS (
  SELECT l_orderkey AS key, l_partkey % 100 AS "start", l_partkey % 100 + l_linenumber * 5 AS "end" FROM lineitem)"""
MASKS = """masks AS (
  SELECT l_orderkey AS key, l_suppkey % 100 AS "start", l_suppkey % 100 + l_linenumber * 3 AS "end" FROM lineitem)"""

CELLS = """cells AS (
  SELECT l_orderkey // 8 AS sheet_id, CAST(l_orderkey % 8 * 16 + l_linenumber * 2 + l_suppkey % 3 AS BIGINT) AS "row", l_partkey % 12 AS "col",
    min(l_quantity) AS value FROM lineitem GROUP BY 1, 2, 3)"""

QUERIES = r"""queries AS (
  SELECT item_id AS query_id, lower(array_to_string(string_split_regex(trim(text, ' '), '[ \t\n\r]+'), ' ')) AS query_text
  FROM benchmark)"""

QUERY_LOGS = """query_logs AS (
  SELECT event_id AS query_log_id, user_id, concat_ws('-', user_id, strftime(ts, '%Y-%m-%d')) AS conversation_id,
    CASE WHEN event_type IN ('error', 'signup') THEN 'slow' ELSE 'fast' END AS lane,
    CASE WHEN value > 200 THEN 'slow' ELSE 'fast' END AS predicted_lane,
    event_type = 'signup' AS clarified, CAST(event_type = 'error' AS INTEGER) AS retry_count,
    CAST(floor(value * 10) AS BIGINT) AS total_time,
    CAST(1 + CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS INTEGER) AS feedback_score,
    ts AS created_at, value, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events)"""

DOC_WORDS = words_of("documents", "doc_id", "text", "doc_words")
QUERY_WORDS = words_of("queries", "query_id", "query_text", "query_words")

BM25 = QUERIES + ",\n" + DOC_WORDS + ",\n" + QUERY_WORDS + """,
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(words) AS term FROM doc_words) GROUP BY 1, 2),
dl AS (SELECT doc_id, len(words) AS dl FROM doc_words),
st AS (SELECT count(*) AS n, avg(dl) AS mean FROM dl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(words) AS term FROM query_words) GROUP BY 1, 2),
qn AS (SELECT query_id, count(*) AS n_terms FROM qt GROUP BY 1),
bm AS (SELECT query_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score,
         count(*) AS matched
       FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id), st GROUP BY 1, 2)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"

SPAN_TABLES = """st AS (
  SELECT o_custkey AS doc_id, o_orderkey AS table_no, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page_idx,
    500 + o_orderkey % 2 * 20 + CASE WHEN o_orderkey % 11 = 0 THEN 200 ELSE 0 END AS width,
    o_orderkey % 4 = 0 AS caption, o_orderkey % 8 = 0 AS continued, o_orderkey % 9 = 0 AS footnote
  FROM orders), li AS (
  SELECT o_custkey AS doc_id, l_orderkey AS table_no, l_linenumber * 1000000000000 + l_partkey * 100000 + l_suppkey AS row_no,
    min(l_linenumber) AS no, min(l_partkey) AS part, min(l_suppkey) AS supp, min(l_returnflag) AS flag, min(CAST(trunc(l_quantity) AS BIGINT)) AS qty
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2, 3), sc AS (
  SELECT doc_id, table_no, row_no, unnest([0, 1, 2, 3]) AS col_no, unnest([1, 1, 1 + supp % 2, 1]) AS colspan,
    unnest([CASE WHEN part % 4 = 0 THEN 2 ELSE 1 END, CASE WHEN supp % 3 = 0 THEN 2 ELSE 1 END, 1, 1]) AS rowspan,
    unnest([CAST(no AS VARCHAR), CASE WHEN supp % 3 = 0 THEN '' ELSE flag END, CAST(part AS VARCHAR), CAST(qty AS VARCHAR)]) AS text FROM li
  UNION ALL SELECT doc_id, table_no, row_no, 4, 1, 1, 'x' FROM li WHERE table_no % 3 = 0
  UNION ALL SELECT doc_id, table_no, 0, unnest([0, 1, 2, 3]), unnest([1, 1, CASE WHEN table_no % 2 = 0 THEN 2 ELSE 1 END, 1]),
    unnest([CASE WHEN table_no % 7 = 0 THEN 2 ELSE 1 END, 1, 1, 1]), unnest(['no', 'flag', 'part', CASE WHEN table_no % 2 = 1 THEN '\uff51\uff54\uff59' ELSE 'qty' END]) FROM st WHERE table_no % 5 <> 4
  UNION ALL SELECT doc_id, table_no, 0, 4, 1, 1, 'note' FROM st WHERE table_no % 5 <> 4 AND table_no % 3 = 0)"""

#: The grid cell by cell: ``held`` lists columns taken (a million times the column) up to a row.
SPAN_GRID = SPAN_TABLES + """, sn AS (
  SELECT *, row_number() OVER (PARTITION BY table_no ORDER BY row_no, col_no) AS k, dense_rank() OVER (PARTITION BY table_no ORDER BY row_no) - 1 AS r FROM sc), sg AS (
  SELECT table_no, k, r, CAST(0 AS BIGINT) AS start, CAST(colspan AS BIGINT) AS colspan, list_transform(range(0, colspan), lambda c: c * 1000000 + r + rowspan - 1) AS held FROM sn WHERE k = 1
  UNION ALL
  SELECT table_no, k, r, start, colspan, list_concat(live, list_transform(range(start, start + colspan), lambda c: c * 1000000 + r + rowspan - 1)) FROM (
    SELECT *, list_min(list_filter(range(cur, cur + len(live) + 1), lambda c: NOT list_contains(list_transform(live, lambda h: h // 1000000), c))) AS start FROM (
      SELECT n.table_no, n.k, n.r, CAST(n.colspan AS BIGINT) AS colspan, n.rowspan, list_filter(g.held, lambda h: h % 1000000 >= n.r) AS live,
        CASE WHEN n.r = g.r THEN g.start + g.colspan ELSE 0 END AS cur
      FROM sg g JOIN sn n ON n.table_no = g.table_no AND n.k = g.k + 1))), placed AS (
  SELECT n.*, g.start FROM sn n JOIN sg g USING (table_no, k)), shown AS (
  SELECT table_no, rr, c, max(k) AS k FROM (
    SELECT table_no, rr, k, unnest(range(start, start + colspan)) AS c FROM (SELECT *, unnest(range(r, r + rowspan)) AS rr FROM placed)) GROUP BY 1, 2, 3), rows_ AS (
  SELECT table_no, rr AS r, CAST(max(c) + 1 AS INTEGER) AS effective_cols, CAST(sum(CASE WHEN pc = c - 1 AND pk = k THEN 0 ELSE 1 END) AS INTEGER) AS pieces
  FROM (SELECT *, lag(c) OVER w AS pc, lag(k) OVER w AS pk FROM shown WINDOW w AS (PARTITION BY table_no, rr ORDER BY c)) GROUP BY 1, 2)"""

BLOCK_LINES = BLOCKS + """, block_lines AS (
  SELECT doc_id, line_no // 7 * 3 + CASE WHEN line_no % 7 < 4 THEN 0 WHEN line_no % 7 = 4 THEN 1 ELSE 2 END AS block_no, page_idx, line_no, 50 + line_no % 3 * 3 AS x0, line_no * 20 % 50 AS y0,
    least(50 + line_no % 3 * 3 + 5 * length(text), 250) AS x1, line_no * 20 % 50 + 16 AS y1, CASE WHEN line_no % 4 <> 1 THEN lower(e) ELSE e END AS text
  FROM (SELECT *, CASE WHEN line_no % 3 <> 0 THEN regexp_replace(text, '[.]\\s*$', '') ELSE text END AS e FROM blocks)), line_blocks AS (
  SELECT doc_id, block_no, min(page_idx) AS page_idx, CASE WHEN block_no % 11 = 7 THEN 'paragraph_title' WHEN block_no % 17 = 5 THEN 'interline_equation' WHEN block_no % 7 = 3 THEN 'table' WHEN block_no % 13 = 6 THEN 'index'
    WHEN doc_id % 9 = 4 THEN 'vertical_text' ELSE 'text' END AS type, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM block_lines GROUP BY 1, 2)"""
