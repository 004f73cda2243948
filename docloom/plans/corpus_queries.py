"""Registered queries of chunking, quality, repeats, references and stores."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docloom.functions import presets as P
from docloom.functions import signals as G
from docloom.functions import text as X
from docloom.operators import chunking, graph, quality, ranking, recall
from docloom.operators.lookup import passage_matches
from docloom.plans import sql_tables as S
from docloom.plans.registry import query
from docloom.plans.sql_tables import with_
from docloom.plans.text_queries import mod, pick, pick_sql
from docloom.session import shared_dir
from docloom.sources import stores

SQUEEZE = r"trim(regexp_replace(text, '\s+', ' ', 'g'), ' ')"


@query("U2", f"""SELECT doc_id, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY {SQUEEZE} ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1""")
def exact_dedup(c):
    """One document per whitespace-normalised text."""
    docs = c.table("documents").select("doc_id", "source", "n_chars", "text")
    return recall.distinct_content(docs, [], "text", [F.desc("n_chars"), F.asc("doc_id")]).select("doc_id", "source", "n_chars")


@query("U3", with_(S.LINES) + "SELECT doc_id, line_no, sha256(line) AS line_hash FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY line_no) AS r FROM lines) WHERE r = 1")
def infile_hash_dedup(c):
    """First line of each content inside a document."""
    kept = quality.distinct_in_document(c.lines(), "line", order=["line_no"])
    return kept.select("doc_id", "line_no", F.sha2("line", 256).alias("line_hash"))


TOC_DOCS = """t AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'Scope  3' || chr(10) || 'Terms 12' || chr(10) || 'Rules 101' || chr(10) ELSE '' END || text AS text FROM documents)"""


@query("F7 F8", with_(TOC_DOCS) + f"""
SELECT doc_id, length({SQUEEZE}) < 20 AS short, len(regexp_extract_all(text, '(?m)[一-鿿\\p{{L}}\\p{{N}}_]{{2,}}\\s+[0-9]{{1,3}}\\s*$')) >= 3 AS contents_page FROM t""")
def short_toc_filter(c):
    """Title-only texts and contents pages."""
    head = F.when(mod("doc_id", 6) == 0, "Scope  3\nTerms 12\nRules 101\n").otherwise("")
    t = c.table("documents").select("doc_id", F.concat(head, F.col("text")).alias("text"))
    return t.select("doc_id", recall.is_short(F.col("text")).alias("short"), recall.is_contents_page(F.col("text")).alias("contents_page"))


@query("F7 U2", with_(S.LINES) + r""", w AS (SELECT doc_id, line_no, trim(regexp_replace(line, '\s+', ' ', 'g'), ' ') AS t FROM lines WHERE trim(line, ' ') <> ''),
n AS (SELECT *, len(string_split(t, ' ')) AS n FROM w)
SELECT doc_id, line_no FROM n a WHERE EXISTS (SELECT 1 FROM n b WHERE b.doc_id = a.doc_id AND b.n > a.n AND contains(' ' || b.t || ' ', ' ' || a.t || ' '))""")
def contained_lines(c):
    """Lines of each document whose words run inside a longer line of it."""
    lines = c.lines().where(F.trim("line") != "").select("doc_id", "line_no", F.col("line").alias("content"))
    return recall.contained(lines, ["doc_id"], "content", "line_no")


@query("F9", r"""SELECT page_id, regexp_replace(replace(replace(html, '<article>', '<table class="x">'), '</article>', '</table>'), '(?is)<table.*?</table>', '[TABLE]', 'g') AS html FROM pages""")
def table_placeholders(c):
    """Tables of a text replaced by a marker."""
    made = F.replace(F.replace("html", F.lit("<article>"), F.lit('<table class="x">')), F.lit("</article>"), F.lit("</table>"))
    return c.table("pages").select("page_id", chunking.mask_tables(made).alias("html"))


@query("A29", "SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def passage_truth(c):
    """Documents holding a benchmark passage verbatim."""
    return passage_matches(c.table("documents").select("doc_id", "text"), c.table("benchmark").select("item_id", "text"), "doc_id", "item_id")


# ---------------------------------------------------------------- chunking
MARKED = S.LINES + """, marked AS (SELECT doc_id, line_no, CASE WHEN line_no % 9 = 1 AND doc_id % 4 <> 3 THEN (line_no // 9 + 1) || ' ' WHEN line_no % 9 = 3 AND doc_id % 4 <> 2 THEN (line_no // 9 + 1) || '.1 '
   WHEN line_no % 9 = 5 AND doc_id % 2 = 0 THEN '第 ' || (line_no // 9 + 1) || '.2 节 ' WHEN line_no % 9 = 6 THEN (line_no // 9 + 1) || '.2.1 ' ELSE '' END || line AS line FROM lines)"""


def marked_lines(c):
    """Lines with chapter, section and clause numbers by position."""
    n, chapter = F.col("line_no"), (F.floor(F.col("line_no") / 9) + 1).cast("string")
    at = lambda r: F.pmod(n, F.lit(9)) == r
    mark = (
        F.when(at(1) & (mod("doc_id", 4) != 3), F.concat(chapter, F.lit(" "))).when(at(3) & (mod("doc_id", 4) != 2), F.concat(chapter, F.lit(".1 ")))
        .when(at(5) & (mod("doc_id", 2) == 0), F.concat(F.lit("第 "), chapter, F.lit(".2 节 "))).when(at(6), F.concat(chapter, F.lit(".2.1 "))).otherwise("")
    )
    return c.lines().select("doc_id", "line_no", F.concat(mark, F.col("line")).alias("line"))


CHUNKED = with_(MARKED) + r"""
, k AS (SELECT doc_id, line_no, trim(line, ' ') AS line FROM marked WHERE trim(line, ' ') <> ''),
t AS (SELECT *, CASE WHEN regexp_matches(line, '^(#\s+)?第\s*[0-9]+\s*章') OR regexp_matches(line, '^(#{1,2}\s+)?[0-9]+\s+[^0-9.]') THEN 'chapter' WHEN regexp_matches(line, '^(##\s+)?第?\s*[0-9]+\.[0-9]+\s*节') THEN 'section'
   WHEN regexp_matches(line, '^#{2,4}\s+[0-9]+\.[0-9]+') OR regexp_matches(line, '^#{2,4}\s*[0-9]{2,5}') OR regexp_matches(line, '^[0-9]+\.[0-9]+\.[0-9]+\s') OR regexp_matches(line, '^[0-9]+\.[0-9]+\s+[^0-9]') THEN 'clause' ELSE 'content' END AS kind FROM k),
a AS (SELECT *, sum((kind = 'chapter')::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS ch FROM t),
b AS (SELECT *, sum((kind = 'clause')::INT) OVER (PARTITION BY doc_id, ch ORDER BY line_no) AS cl, max(CASE WHEN kind = 'chapter' THEN line END) OVER (PARTITION BY doc_id, ch) AS ct,
   max((kind = 'clause')::INT) OVER (PARTITION BY doc_id, ch) AS hc FROM a WHERE ch > 0),
c AS (SELECT doc_id, ch, cl, string_agg(line, chr(10) ORDER BY line_no) AS content, 'child' AS chunk_type, max(CASE WHEN kind = 'clause' THEN line END) AS clt, any_value(ct) AS ct FROM b WHERE kind <> 'chapter' AND NOT (kind = 'section' AND hc = 1) GROUP BY 1, 2, 3),
p AS (SELECT x.doc_id, x.ch, -1 AS cl, x.ct || coalesce(chr(10) || chr(10) || y.body, '') AS content, 'parent' AS chunk_type, NULL AS clt, x.ct FROM (SELECT DISTINCT doc_id, ch, ct FROM b) x
   LEFT JOIN (SELECT doc_id, ch, string_agg(content, chr(10) || chr(10) ORDER BY cl) AS body FROM c GROUP BY 1, 2) y USING (doc_id, ch)),
u AS (SELECT * FROM c UNION ALL BY NAME SELECT * FROM p)"""


@query("T9 W5 A20 A22", CHUNKED + r""" SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ch, cl) - 1 AS position, chunk_type, content, coalesce(nullif(regexp_extract(ct, '^#*\s*([0-9]+)\s+', 1), ''), '-') AS chapter,
  coalesce(nullif(regexp_extract(clt, '^#{0,4}\s*([0-9]+\.[0-9]+(\.[0-9]+)?)', 1), ''), '-') AS clause FROM u""")
def chunk_lines(c):
    """Parent chunk per chapter and child chunk per clause."""
    chunks = chunking.chunk_standard(marked_lines(c))
    return chunks.select("doc_id", "position", "chunk_type", "content", F.coalesce("chapter", F.lit("-")).alias("chapter"), F.coalesce("clause", F.lit("-")).alias("clause"))


@query("J3 J1", CHUNKED + r""", f AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ch, cl) - 1 AS position, chunk_type, nullif(regexp_extract(ct, '^#*\s*([0-9]+)\s+', 1), '') AS chapter FROM u)
SELECT doc_id, source, position, coalesce(chapter, '-') AS chapter, EXISTS (SELECT 1 FROM f p WHERE p.chunk_type = 'parent' AND p.doc_id = f.doc_id AND p.chapter IS NOT DISTINCT FROM f.chapter) AS has_parent FROM f JOIN documents USING (doc_id) WHERE chunk_type = 'child'""")
def child_parents(c):
    """Child chunks with the parent of their chapter and their document's source."""
    chunks = chunking.chunk_standard(marked_lines(c))
    linked = chunking.parent_of_child(chunks.where("chunk_type = 'parent'"), chunks.where("chunk_type = 'child'"))
    documents = c.table("documents").select("doc_id", "source")
    return recall.with_documents(linked, documents).select(
        "doc_id", "source", "position", F.coalesce("chapter", F.lit("-")).alias("chapter"), F.col("parent_id").isNotNull().alias("has_parent")
    )


@query("T9 W6 A21", None)
def chunk_markdown(c):
    """Markdown sections in token-bounded parents, clauses and tables."""
    n = F.col("line_no")
    mark = F.when(F.pmod(n, F.lit(8)) == 1, "## ").when(F.pmod(n, F.lit(8)) == 3, "### ").when(F.pmod(n, F.lit(8)) == 5, "表 1 ").when(F.pmod(n, F.lit(8)).isin(6, 7), "| ").otherwise("")
    lines = c.lines().select("doc_id", "line_no", F.concat(mark, F.col("line")).alias("line"))
    return chunking.chunk_markdown(lines, 200).select("doc_id", "position", "section_no", "group_no", "chunk_type", "content")


@query("A21", "WITH RECURSIVE " + S.LINES + """
, k AS (SELECT doc_id, line_no, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS i, CAST(length(line) // 4 AS BIGINT) AS t FROM lines),
r AS (
  SELECT doc_id, line_no, i, 0 AS g, t AS used FROM k WHERE i = 1
  UNION ALL SELECT k.doc_id, k.line_no, k.i, r.g + CASE WHEN r.used + k.t > 200 THEN 1 ELSE 0 END, CASE WHEN r.used + k.t > 200 THEN k.t ELSE r.used + k.t END
  FROM r JOIN k ON k.doc_id = r.doc_id AND k.i = r.i + 1)
SELECT doc_id, line_no, CAST(g AS INTEGER) AS group_no FROM r""")
def token_budget_groups(c):
    """Consecutive lines grouped within 200 tokens."""
    rows = c.lines().select("doc_id", "line_no", F.floor(F.length("line") / 4).alias("tokens"))
    return chunking.token_groups(rows, ["doc_id"], "line_no", "tokens", 200).select("doc_id", "line_no", "group_no")


PARAS = """e AS (SELECT label AS doc_id, vec_id AS para_no, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT doc_id, para_no, list_dot_product(v, pv) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(pv, pv))) AS sim, f FROM (
   SELECT *, lag(v) OVER w AS pv, min(para_no) OVER (PARTITION BY doc_id) AS f FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY para_no)) WHERE pv IS NOT NULL),
b AS (SELECT doc_id, avg(sim) - 0.5 * stddev_pop(sim) AS bar FROM s GROUP BY 1),
d AS (SELECT doc_id, para_no - f AS pos, f, row_number() OVER (PARTITION BY doc_id ORDER BY para_no) AS i FROM s JOIN b USING (doc_id) WHERE round(sim, 9) < round(bar, 9))"""


@query("W4", "WITH RECURSIVE " + PARAS + """,
g AS (SELECT doc_id, f, pos, i, CASE WHEN pos >= 3 THEN pos ELSE 0 END AS last, pos >= 3 AS keep FROM d WHERE i = 1
  UNION ALL SELECT d.doc_id, d.f, d.pos, d.i, CASE WHEN d.pos - g.last >= 3 THEN d.pos ELSE g.last END, d.pos - g.last >= 3 FROM g JOIN d ON d.doc_id = g.doc_id AND d.i = g.i + 1)
SELECT doc_id, pos + f AS boundary FROM g WHERE keep""")
def para_boundaries(c):
    """Where paragraph similarity drops, at least three paragraphs apart."""
    e = c.table("embeddings").select(F.col("label").alias("doc_id"), F.col("vec_id").alias("para_no"), F.col("embedding").alias("vector"))
    return chunking.semantic_boundaries(e)


@query("T9", None)
def chunk_textbook(c):
    """Paragraph parents cut at similarity drops, paragraphs as children."""
    from docloom.functions.vectors import hashed_words

    lines = c.lines().where(F.trim("line") != "").select("doc_id", F.col("line_no").alias("para_no"), F.col("line").alias("paragraph"))
    marks = chunking.semantic_boundaries(lines.where(F.length("paragraph") > 20).select("doc_id", "para_no", hashed_words("paragraph", 32).alias("vector")))
    return chunking.chunk_textbook(lines, marks).select("doc_id", "position", "chunk_type", "part", "content")


TABLE_LINES = S.LINES + """, tl AS (SELECT doc_id, line_no, CASE WHEN line_no % 7 = 0 THEN '<table border=1>' || line WHEN line_no % 7 = 5 AND doc_id % 2 = 0 THEN '表 A' || (line_no % 5) || ' ' || line WHEN line_no % 7 = 6 THEN '' ELSE line END AS line FROM lines)"""


def table_lines(c):
    n = F.col("line_no")
    shown = (
        F.when(F.pmod(n, F.lit(7)) == 0, F.concat(F.lit("<table border=1>"), F.col("line")))
        .when((F.pmod(n, F.lit(7)) == 5) & (mod("doc_id", 2) == 0), F.concat(F.lit("表 A"), F.pmod(n, F.lit(5)).cast("string"), F.lit(" "), F.col("line")))
        .when(F.pmod(n, F.lit(7)) == 6, "").otherwise(F.col("line"))
    )
    return c.lines().select("doc_id", "line_no", shown.alias("line"))


@query("T10 W7 W8", with_(TABLE_LINES) + r"""
, w AS (SELECT doc_id, line_no, trim(line, ' ') AS line, last_value(nullif(trim(line, ' '), '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS above,
   coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off, sum(length(line) + 1) OVER (PARTITION BY doc_id) - 1 AS total FROM tl),
h AS (SELECT *, regexp_extract(above, '^(续\s*)?表\s*([A-Za-z0-9０-９][A-Za-z0-9０-９.\-]*)(\s+(.+))?$', 2) AS num FROM w WHERE regexp_matches(line, '(?i)^<table[\s>]'))
SELECT doc_id, line_no, CASE WHEN num <> '' THEN above ELSE '-' END AS title, coalesce(nullif(num, ''), '-') AS number, round(off / greatest(total, 1), 6) AS offset_share, CAST(greatest(1, floor(round(off / greatest(total, 1), 6) * 12)) AS INTEGER) AS page FROM h""")
def table_titles(c):
    """Title, number and page of every table line."""
    found = chunking.tables_in_text(table_lines(c))
    return found.select(
        "doc_id", "line_no", F.coalesce("title", F.lit("-")).alias("title"), F.coalesce("number", F.lit("-")).alias("number"), "offset_share",
        chunking.estimated_page(F.col("offset_share"), F.lit(12)).alias("page"),
    )


MARKUP = r"""CASE WHEN n % 7 = 0 THEN '<table><tr><th colspan="2">Head</th><th>p|q</th></tr><tr><td rowspan="2">' || n || '</td><td>b</td><td>c</td></tr><tr><td colspan="2">' || length(line) || '</td></tr></table>'
  WHEN n % 7 = 5 AND doc_id % 2 = 0 THEN '表 A' || (n % 5) || ' title' WHEN n % 7 = 6 THEN '' ELSE line END"""


@query("T10 W7 W8 C9 C10", with_(S.LINES) + f""", tl AS (SELECT doc_id, line_no, length(line) AS size, {MARKUP.replace('n %', 'line_no %').replace('|| n ||', '|| line_no ||').replace('(n', '(line_no')} AS line FROM lines), w AS (
  SELECT doc_id, line_no, size, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off, sum(length(line) + 1) OVER (PARTITION BY doc_id) - 1 AS total,
    last_value(nullif(trim(line, ' '), '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS above FROM tl), t AS (
  SELECT *, CASE WHEN regexp_matches(above, '^表 A[0-9] title$') THEN above END AS title FROM w WHERE line_no % 7 = 0)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS BIGINT) AS table_index, coalesce(title[3:4], '-') AS table_number, coalesce(title, '-') AS title, CAST(greatest(1, floor(round(off / greatest(total, 1), 6) * 12)) AS INTEGER) AS page,
  coalesce(title || chr(10) || chr(10), '') || '| Head | Head | p\\|q |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| ' || line_no || ' | b | c |' || chr(10) || '| ' || line_no || ' | ' || size || ' | ' || size || ' |' AS content FROM t""")
def extracted_tables(c):
    """Every table of the texts with its number, title and page, as a pipe table with spanning cells repeated."""
    from docloom.operators import text_tables

    n, size = F.col("line_no"), F.length("line").cast("string")
    markup = F.concat(F.lit('<table><tr><th colspan="2">Head</th><th>p|q</th></tr><tr><td rowspan="2">'), n.cast("string"), F.lit('</td><td>b</td><td>c</td></tr><tr><td colspan="2">'), size, F.lit("</td></tr></table>"))
    titled = F.concat(F.lit("表 A"), (n % 5).cast("string"), F.lit(" title"))
    shown = F.when(n % 7 == 0, markup).when((n % 7 == 5) & (F.col("doc_id") % 2 == 0), titled).when(n % 7 == 6, "").otherwise(F.col("line"))
    found = text_tables.extract_tables(c.lines().select("doc_id", "line_no", shown.alias("line")), c.table("documents").select("doc_id", F.lit(12).alias("page_count")))
    return found.select("doc_id", "table_index", F.coalesce("table_number", F.lit("-")).alias("table_number"), F.coalesce("title", F.lit("-")).alias("title"), "page", "content")


@query("C10", r"""WITH r AS (SELECT page_id, regexp_extract_all(html, '<li>(.*?)</li>', 1) AS a FROM pages),
c AS (SELECT page_id, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS col_no, unnest(a) AS cell FROM r)
SELECT page_id, 0 AS row_no, col_no, CAST(col_no % 3 + 1 AS INTEGER) AS colspan, CAST(1 AS INTEGER) AS rowspan, col_no % 2 = 1 AS is_header, trim(regexp_replace(cell, '<[^>]+>', '', 'g'), ' ') AS text FROM c""")
def html_cells(c):
    """Cells of tables in markup; each page's link list is written as one table row."""
    items = F.regexp_extract_all("html", F.lit("<li>(.*?)</li>"), F.lit(1))
    cell = F.transform(
        items,
        lambda x, i: F.concat(
            F.when(i % 2 == 1, "<th colspan=\"").otherwise("<td colspan=\""), (i % 3 + 1).cast("string"), F.lit("\">"), x, F.when(i % 2 == 1, "</th>").otherwise("</td>")
        ),
    )
    markup = F.concat(F.lit("<table><tr>"), F.array_join(cell, ""), F.lit("</tr></table>"))
    return chunking.table_cells(c.table("pages").select("page_id", markup.alias("t")), ["page_id"], "t")


@query("C9", with_(S.CELLS) + """
, w AS (SELECT sheet_id, CAST(max("col") + 1 AS BIGINT) AS w FROM cells GROUP BY 1), g AS (SELECT sheet_id, "row", unnest(range(0, w)) AS "col" FROM (SELECT DISTINCT sheet_id, "row" FROM cells) JOIN w USING (sheet_id)),
l AS (SELECT sheet_id, "row", '| ' || string_agg(coalesce(CAST(CAST(value AS BIGINT) AS VARCHAR), ''), ' | ' ORDER BY "col") || ' |' AS line FROM g LEFT JOIN cells USING (sheet_id, "row", "col") GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY "row") AS r FROM l)
SELECT sheet_id, string_agg(CASE WHEN r = 1 THEN line || chr(10) || '| ' || (SELECT string_agg('---', ' | ') FROM range(0, w.w)) || ' |' ELSE line END, chr(10) ORDER BY "row") AS markdown FROM n JOIN w USING (sheet_id) GROUP BY 1""")
def gfm_tables(c):
    """Sheets as pipe tables."""
    cells = c.cells().withColumn("text", F.col("value").cast("long").cast("string"))
    return chunking.gfm_table(cells, ["sheet_id"], "row", "col", "text")


@query("T13", with_(S.LINES) + """SELECT doc_id, line_no, '[图片描述] 第' || line_no || '页' || CASE WHEN line_no % 2 = 0 THEN ' 图' || line_no ELSE '' END || CASE WHEN line_no % 3 = 0 THEN ' ：cap' ELSE '' END || ' ' || chr(10) || line AS content FROM lines""")
def image_chunks(c):
    """Text of image chunks."""
    n = F.col("line_no")
    return c.lines().select(
        "doc_id", "line_no", chunking.image_chunk(n, F.when(n % 2 == 0, F.concat(F.lit("图"), n.cast("string"))).otherwise(""), F.when(n % 3 == 0, "cap").otherwise(""), F.col("line")).alias("content"),
    )


@query("A8", r"""WITH w AS (SELECT doc_id, CAST(generate_subscripts(a, 1) AS BIGINT) AS i, unnest(a) AS word FROM (SELECT doc_id, string_split_regex(text, '[^\p{L}\p{N}_]+') AS a FROM documents)),
f AS (SELECT doc_id, word, count(*) AS freq, min(i) AS first FROM w WHERE length(word) BETWEEN 2 AND 6 AND NOT regexp_matches(word, '^[0-9]+$') GROUP BY 1, 2)
SELECT doc_id, word, freq, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY freq DESC, first) AS INTEGER) AS rank FROM f) WHERE rank <= 10""")
def keyword_topk(c):
    """Ten most frequent short words of every document."""
    return chunking.keyword_topk(c.table("documents").select("doc_id", "text"))


GROUPS = {"english": ["the", "and"], "french": ["eau", "ment"], "german": ["sch", "ung"], "license": ["license"]}


@query("A9", """WITH s AS (SELECT doc_id, unnest([{'k': 'english', 'o': 0, 'n': len(regexp_extract_all(text, '(?i)the')) + len(regexp_extract_all(text, '(?i)and'))}, {'k': 'french', 'o': 1, 'n': len(regexp_extract_all(text, '(?i)eau')) + len(regexp_extract_all(text, '(?i)ment'))},
  {'k': 'german', 'o': 2, 'n': len(regexp_extract_all(text, '(?i)sch')) + len(regexp_extract_all(text, '(?i)ung'))}, {'k': 'license', 'o': 3, 'n': len(regexp_extract_all(text, '(?i)license'))}]) AS x FROM documents)
SELECT doc_id, rank, category, score FROM (SELECT doc_id, x.k AS category, CAST(x.n AS BIGINT) AS score, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY x.n DESC, x.o) AS INTEGER) AS rank FROM s WHERE x.n > 0) WHERE rank <= 3""")
def category_score(c):
    """Three best keyword groups of every document."""
    return chunking.keyword_scores(c.table("documents").select("doc_id", "text"), GROUPS)


@query("A10", """WITH t AS (SELECT doc_id, repeat('10kV ', CAST(doc_id % 4 AS INTEGER)) || repeat('35千伏 ', CAST(doc_id % 3 AS INTEGER)) || text AS t FROM documents)
SELECT doc_id, CASE WHEN doc_id % 4 = 0 AND doc_id % 3 = 0 THEN '-' WHEN doc_id % 4 >= doc_id % 3 THEN '10kV' ELSE '35kV' END AS level FROM t""")
def voltage_mode(c):
    """Most frequent voltage level of every document."""
    t = F.concat(F.repeat(F.lit("10kV "), mod("doc_id", 4).cast("int")), F.repeat(F.lit("35千伏 "), mod("doc_id", 3).cast("int")), F.col("text"))
    return c.table("documents").select("doc_id", F.coalesce(chunking.most_frequent_level(t), F.lit("-")).alias("level"))


# ---------------------------------------------------------------- quality
NOISE = ["", "й" * 160 + "ع" * 30 + "ሀ" * 30 + "中" * 120, "" * 40, "�" * 60, "犲" * 40, "#$%&!?" * 60, ""]
NOISE_SQL = f"({[n for n in NOISE]})[CAST(line_no // 40 + doc_id AS INTEGER) % 7 + 1]"


def noisy_pages(c):
    """Forty lines per page, with odd characters on some pages."""
    page = F.floor((F.col("line_no") - 1) / 40)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n")
    pages = c.lines().groupBy("doc_id", page.alias("page_idx")).agg(body.alias("text"))
    return pages.withColumn("_k", F.col("doc_id") + F.col("page_idx")).select("doc_id", "page_idx", F.concat("text", pick("_k", NOISE)).alias("text"))


PAGES = S.LINES + f""", pg AS (SELECT doc_id, (line_no - 1) // 40 AS page_idx, string_agg(line, chr(10) ORDER BY line_no) AS text FROM lines GROUP BY 1, 2),
np AS (SELECT doc_id, page_idx, text || {pick_sql('(doc_id + page_idx)', NOISE)} AS text FROM pg),
cl AS (SELECT *, regexp_replace(text, '[\\s\\x{{00A0}}\\x{{3000}}]', '', 'g') AS clean FROM np)"""


def cnt(column: str, cls: str) -> str:
    return f"len(regexp_extract_all({column}, '{cls}'))"


PUNCT_SQL = r"[!-/:-@\[-`{-~]"
SIGNALS = PAGES + f""", runs AS (SELECT doc_id, page_idx, coalesce(array_to_string(regexp_extract_all(clean, '{PUNCT_SQL}{{4,}}'), ''), '') AS r FROM cl),
sig AS (SELECT doc_id, page_idx, length(text) AS chars, length(clean) AS clean_chars, CAST({cnt('text', r'[\x{FFFD}\x{0001}-\x{0008}\x{000B}\x{000C}\x{000E}-\x{001F}\x{007F}-\x{009F}\x{E000}-\x{F8FF}]')} AS BIGINT) AS abnormal,
  CAST({cnt('text', r'\x{FFFD}')} AS BIGINT) AS map_errors, CAST({cnt('clean', G.CJK)} AS BIGINT) AS cjk, CAST({cnt('clean', r'[\x{4E00}-\x{9FFF}]')} AS BIGINT) AS base_cjk,
  CAST({cnt('clean', r'[\x{7280}-\x{72DF}]')} - {cnt('clean', '[' + P.RARE_CJK_WHITELIST + ']')} AS BIGINT) AS rare_cjk, CAST({cnt('clean', PUNCT_SQL)} AS BIGINT) AS punct,
  length(r) AS run_chars, CAST(len(list_distinct(string_split(r, ''))) AS INTEGER) AS run_kinds,
  {', '.join(f"CAST({cnt('clean', G.char_class([(a, b)]))} AS BIGINT) AS s{i}" for i, (a, b, _) in enumerate(P.SCRIPT_RANGES))} FROM cl JOIN runs USING (doc_id, page_idx))"""


@query("A11 A12 A14 A15 A16", with_(SIGNALS) + "SELECT doc_id, page_idx, chars, clean_chars, abnormal, map_errors, cjk, base_cjk, rare_cjk, punct, run_chars, CASE WHEN run_chars = 0 THEN 0 ELSE run_kinds END AS run_kinds FROM sig")
def text_quality(c):
    """Character signals of every page."""
    return quality.page_signals(noisy_pages(c)).drop("scripts")


@query("A13", with_(SIGNALS) + ", t AS (SELECT doc_id, " + ", ".join(f"sum(s{i}) AS s{i}" for i in range(21)) + " FROM sig GROUP BY 1) SELECT doc_id, CAST(" + " + ".join(f"s{i}" for i in range(21))
       + " AS BIGINT) AS foreign_chars, CAST(" + " + ".join(f"(s{i} >= 5)::INT" for i in range(21)) + " AS INTEGER) AS dense_scripts FROM t")
def cross_script(c):
    """Foreign-script characters of every document."""
    d = quality.document_signals(quality.page_signals(noisy_pages(c)))
    return d.select("doc_id", F.col("foreign").alias("foreign_chars"), "dense_scripts")


@query("A15", with_(SIGNALS) + "SELECT doc_id, page_idx, coalesce(clean_chars >= 100 AND punct / nullif(clean_chars, 0) >= 0.25 AND run_chars / nullif(clean_chars, 0) >= 0.1 AND run_kinds > 1, false) AS dense_punctuation FROM sig")
def punct_runs(c):
    """Pages dense with long mixed punctuation."""
    s = quality.page_signals(noisy_pages(c))
    return s.select("doc_id", "page_idx", F.coalesce(quality.punctuation_trigger(), F.lit(False)).alias("dense_punctuation"))


@query("A18 S14", with_(SIGNALS) + """
, n AS (SELECT doc_id, max(page_idx) + 1 AS n FROM np GROUP BY 1), smp AS (SELECT sig.* FROM sig JOIN n USING (doc_id) WHERE n <= 10 OR list_contains(list_transform(range(0, 10), lambda i: CAST(round_even(i * (n - 1) / 9.0, 0) AS BIGINT)), page_idx)),
d AS (SELECT doc_id, count(*) AS pages, sum(chars) AS ch, sum(clean_chars) AS cc, sum(abnormal) AS ab, sum(map_errors) AS me, sum(cjk) AS cj, sum(base_cjk) AS bc, sum(rare_cjk) AS rc,
   bool_or(coalesce(clean_chars >= 100 AND punct / nullif(clean_chars, 0) >= 0.25 AND run_chars / nullif(clean_chars, 0) >= 0.1 AND run_kinds > 1, false)) AS pt, """ + ", ".join(f"sum(s{i}) AS s{i}" for i in range(21)) + """ FROM smp GROUP BY 1),
e AS (SELECT *, """ + " + ".join(f"s{i}" for i in range(21)) + " AS fo, " + " + ".join(f"(s{i} >= 5)::INT" for i in range(21)) + """ AS ds FROM d),
f AS (SELECT doc_id, CASE WHEN cc / pages < 50 THEN 'few_chars' WHEN coalesce(me / nullif(ch, 0), 0) >= 0.04 THEN 'map_errors' WHEN ch >= 300 AND ab / ch >= 0.03 THEN 'abnormal_chars'
   WHEN cc >= 300 AND cj >= 100 AND fo >= 120 AND fo / cc >= 0.18 AND ds >= 3 THEN 'cross_script' WHEN rc >= 30 AND rc / nullif(bc, 0) >= 0.026 THEN 'rare_cjk' WHEN pt THEN 'punctuation' ELSE '' END AS reason FROM e)
SELECT doc_id, CASE WHEN reason = '' THEN 'txt' ELSE 'ocr' END AS label, reason FROM f""")
def ocr_class(c):
    """Text or scan per document, and why."""
    return quality.classify_documents(noisy_pages(c))


@query("A17", with_(PAGES) + "SELECT doc_id, round(avg((length(trim(text, ' ')) > 50)::INT), 6) AS rate, bool_or(page_idx < 3 AND length(trim(text, ' ')) > 100) AS early_text, round(avg((length(trim(text, ' ')) > 50)::INT), 6) >= 0.5 AS has_text_layer FROM np GROUP BY 1")
def text_layer(c):
    """Share of pages with text."""
    return quality.text_layer(noisy_pages(c))


@query("A19", with_(PAGES) + r""", r AS (SELECT doc_id, page_idx, list_transform(regexp_extract_all(text, '[\x{E000}-\x{F8FF}]+'), lambda x: length(x)) AS r, length(clean) AS n FROM cl)
SELECT doc_id, page_idx, CAST(coalesce(list_sum(r), 0) AS BIGINT) AS pua_count, CAST(coalesce(list_max(r), 0) AS INTEGER) AS longest_run, coalesce(list_sum(r), 0) >= 2 AND (coalesce(list_max(r), 0) >= 2 OR round(coalesce(list_sum(r), 0) / n, 6) >= 0.05) AS needs_ocr FROM r""")
def private_use_runs(c):
    """Private-use characters of every page."""
    s = noisy_pages(c).select("doc_id", "page_idx", G.private_use("text").alias("s"))
    return s.select("doc_id", "page_idx", F.col("s.count").alias("pua_count"), F.col("s.longest_run").alias("longest_run"), G.needs_ocr_for_private_use(F.col("s")).alias("needs_ocr"))


@query("S14", """WITH n AS (SELECT o_orderkey, o_custkey % 300 AS n FROM orders)
SELECT o_orderkey, coalesce(array_to_string(CASE WHEN n <= 10 THEN range(0, n) ELSE list_transform(range(0, 10), lambda i: CAST(round_even(i * (n - 1) / 9.0, 0) AS BIGINT)) END, ','), '') AS pages FROM n""")
def sample_pages(c):
    """Evenly spaced sample page numbers."""
    return c.table("orders").select("o_orderkey", F.array_join(quality.sample_pages(mod("o_custkey", 300)), ",").alias("pages"))


@query("S13", with_(S.BLOCKS) + ", n AS (SELECT doc_id, max(page_idx) AS l FROM blocks GROUP BY 1) SELECT doc_id, page_idx, block_idx FROM blocks JOIN n USING (doc_id) WHERE page_idx >= 1 AND page_idx <= least(3, l)")
def page_slice(c):
    """Blocks of the second to fourth page."""
    b = c.blocks().select("doc_id", "page_idx", "block_idx")
    counts = b.groupBy("doc_id").agg((F.max("page_idx") + 1).alias("page_count"))
    return quality.page_range(b, counts, 1, 3)


@query("F11", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_discount >= 0.05 AND NOT (l_shipmode_ IN ('A', 'N') AND l_discount < 0.08 AND l_linenumber < l_quantity)".replace("l_shipmode_", "l_returnflag"))
def confident_text(c):
    """Recognised text sure enough to keep."""
    keep = quality.confident_text(F.col("l_discount"), 0.05, F.col("l_returnflag"), F.col("l_linenumber"), F.col("l_quantity"), ["A", "N"], 0.08)
    return c.table("lineitem").where(keep).select("l_orderkey", "l_linenumber", "l_partkey")


# ---------------------------------------------------------------- references, versions, stores
LINKS = r"""a AS (SELECT page_id, regexp_extract_all(html, 'href="(/[^"]*)"', 1) AS l FROM pages), o AS (SELECT l[1] AS word, min(page_id) AS owner FROM a WHERE len(l) > 0 GROUP BY 1),
edges AS (SELECT DISTINCT page_id AS source, owner AS target FROM (SELECT page_id, unnest(l) AS word FROM a) JOIN o USING (word))"""


def link_edges(c):
    """Page to page: a link leads to the page that lists the same address first."""
    links = c.table("pages").select("page_id", F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1)).alias("l"))
    owner = links.where(F.size("l") > 0).groupBy(F.col("l")[0].alias("word")).agg(F.min("page_id").alias("target"))
    return links.select(F.col("page_id").alias("source"), F.explode("l").alias("word")).join(owner, "word").select("source", "target").distinct()


@query("J9", "WITH RECURSIVE " + LINKS + """, r AS (SELECT source, target, 1 AS hops FROM edges UNION SELECT r.source, e.target, r.hops + 1 FROM r JOIN edges e ON e.source = r.target WHERE r.hops < 3)
SELECT source, target, CAST(min(hops) AS INTEGER) AS hops FROM r WHERE source <> target GROUP BY 1, 2""")
def link_graph_hops(c):
    """Pages reached within three links."""
    return graph.closure(link_edges(c), 3)


@query("J8 J9 F13", with_(S.LINES) + """
, t AS (SELECT doc_id, line_no, CASE WHEN line_no % 3 = 0 THEN '应符合 GB ' || (1000 + (doc_id + line_no) % 50) ELSE 'GB ' || (1000 + line_no % 50) END AS t FROM lines),
e AS (SELECT DISTINCT doc_id * 100000 + line_no AS source, regexp_extract(t, '(GB [0-9]+)', 1) AS target FROM t WHERE contains(t, '应符合')),
ch AS (SELECT o_orderkey AS chunk_id, 'GB ' || (1000 + o_custkey % 60) AS target, o_orderkey % 11 AS position FROM orders),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY position, chunk_id) AS rank FROM ch) WHERE rank <= 10)
SELECT source, target, chunk_id, CAST(rank AS INTEGER) AS rank FROM e JOIN b USING (target)""")
def reference_expansion(c):
    """Ten chunks of every standard a line refers to."""
    n = F.col("line_no")
    text = F.when(n % 3 == 0, F.concat(F.lit("应符合 GB "), (1000 + (F.col("doc_id") + n) % 50).cast("string"))).otherwise(F.concat(F.lit("GB "), (1000 + n % 50).cast("string")))
    lines = c.lines().select((F.col("doc_id") * 100000 + n).alias("chunk_id"), text.alias("content"))
    chunks = c.table("orders").select(F.col("o_orderkey").alias("chunk_id"), F.concat(F.lit("GB "), (1000 + mod("o_custkey", 60)).cast("string")).alias("standard_no"), mod("o_orderkey", 11).alias("position"))
    return graph.expand_references(graph.reference_edges(lines), chunks).select("source", "target", "chunk_id", "rank")


@query("A38", """SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest_id FROM orders WHERE o_orderstatus = 'F' GROUP BY 1""")
def latest_versions(c):
    """Latest valid version per base number."""
    docs = c.table("orders").select("o_custkey", F.col("o_orderkey").alias("doc_id"), "o_orderdate", "o_orderstatus")
    return graph.latest_versions(docs, "o_custkey", ["o_orderdate", "doc_id"], F.col("o_orderstatus") == "F")


@query("A38", """WITH l AS (SELECT o_orderkey AS doc_id, last_value(o_orderkey) OVER w AS final_id, count(*) OVER w - row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS steps FROM orders
  WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, final_id, steps FROM l""")
def version_chain(c):
    """End of every replaced-by chain."""
    from docloom.operators.ordered import following

    links = c.table("orders").select("o_custkey", F.col("o_orderkey").alias("doc_id"), F.datediff("o_orderdate", F.lit("1970-01-01")).cast("long").alias("day"))
    nxt = following(links, ["o_custkey"], ["day", "doc_id"], F.floor(F.col("day") / 365).cast("long"), {"replaced_by": F.col("doc_id")})
    return graph.resolve_chain(nxt.select("doc_id", "replaced_by"))


@query("J11 S4 U4", """WITH s AS (SELECT 'documents' AS store, doc_id FROM documents UNION SELECT 'vectors', vec_id FROM embeddings UNION SELECT 'pages', page_id FROM pages)
SELECT store, doc_id FROM s WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def orphan_scan(c):
    """Ids of three stores without a label row."""
    stores = {
        "documents": c.table("documents").select("doc_id"), "vectors": c.table("embeddings").select(F.col("vec_id").alias("doc_id")),
        "pages": c.table("pages").select(F.col("page_id").alias("doc_id")),
    }
    return graph.orphans(stores, c.table("labels"), "doc_id")


@query("J12 S2", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def missing_entries(c):
    """Documents without a vector."""
    return graph.missing_entries(c.table("documents").select("doc_id", "lang"), c.table("embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")


@query("J13", """WITH d AS (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS lang FROM documents), k AS (SELECT source, min(lang) AS v FROM d WHERE lang <> '' GROUP BY 1)
SELECT doc_id, source, coalesce(nullif(lang, ''), v) AS lang FROM d LEFT JOIN k USING (source)""")
def backfill_attr(c):
    """Empty languages filled from the source's other documents."""
    d = c.table("documents").select("doc_id", "source", F.when(mod("doc_id", 3) == 0, "").otherwise(F.col("lang")).alias("lang"))
    known = d.where(F.col("lang") != "").groupBy("source").agg(F.min("lang").alias("lang"))
    return graph.backfill(d, known, "source", "lang")


@query("S8 A40", """WITH g AS (SELECT doc_id FROM labels WHERE toxic = 1), r AS (SELECT doc_id, 'documents' AS s FROM documents UNION ALL SELECT vec_id, 'vectors' FROM embeddings UNION ALL SELECT page_id, 'pages' FROM pages)
SELECT doc_id, count(*) FILTER (s = 'documents') AS documents, count(*) FILTER (s = 'vectors') AS vectors, count(*) FILTER (s = 'pages') AS pages FROM r WHERE doc_id IN (SELECT doc_id FROM g) GROUP BY 1""")
def delete_cascade(c):
    """Rows each store loses when flagged documents go."""
    stores = {"documents": c.table("documents").select("doc_id"), "vectors": c.table("embeddings").select(F.col("vec_id").alias("doc_id")), "pages": c.table("pages").select(F.col("page_id").alias("doc_id"))}
    return graph.delete_documents(stores, c.table("labels").where("toxic = 1"), "doc_id")[1]


@query("S5", """WITH i AS (SELECT l_orderkey AS id, max(l_extendedprice) AS price FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), s AS (SELECT o_orderkey AS id, o_totalprice AS price FROM orders)
SELECT id, price, 1 AS version FROM i UNION ALL SELECT id, price, 0 FROM s WHERE id NOT IN (SELECT id FROM i)""")
def upsert_latest(c):
    """Stored rows with the incoming ones laid over them."""
    from docloom.sources.stores import latest_by_key

    stored = c.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.lit(0).alias("version"))
    incoming = c.table("lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_extendedprice").alias("price")).withColumn("version", F.lit(1))
    return latest_by_key(stored, incoming, "id", "version")


@query("S1 X1", """WITH f AS (SELECT doc_id, sha256(text) AS h, row_number() OVER (PARTITION BY text ORDER BY lpad(CAST(doc_id AS VARCHAR), 10, '0')) AS r FROM documents), k AS (SELECT DISTINCT h FROM f JOIN labels USING (doc_id) WHERE quality = 0)
SELECT doc_id, CASE WHEN r = 1 AND h NOT IN (SELECT h FROM k) THEN 'ingested' ELSE 'duplicate' END AS status FROM f""")
def ingest_status(c):
    """Uploads whose content is new, the rest are duplicates."""
    from docloom.sources.files import ingest_report

    docs = c.table("documents").select("doc_id", F.sha2("text", 256).alias("file_hash"), F.lpad(F.col("doc_id").cast("string"), 10, "0").alias("path"), F.col("source").alias("name"))
    known = docs.join(c.table("labels").where("quality = 0"), "doc_id").select("file_hash")
    report = ingest_report(docs.drop("doc_id"), known)
    return report.select(F.col("path").cast("long").alias("doc_id"), "status")


@query("S11", """SELECT event_id, '查询：' || event_type AS input, props AS output FROM events WHERE event_id % 4 <> 0 AND json_extract_string(props, '$.k') IS NOT NULL""")
def record_sink(c):
    """Valid records with all required fields."""
    from docloom.sources.stores import records, valid_records

    rows = c.table("events").select("event_id", "event_type", F.when(mod("event_id", 4) == 0, '{"other": 1}').otherwise(F.col("props")).alias("props"))
    kept = valid_records(rows, "props", "k long", ["k"])
    return kept.select("event_id", *records("rate", F.col("event_type"), F.col("props"))).drop("instruction")


@query("J26", """WITH e AS (SELECT o_custkey AS doc_id, o_orderkey AS entry, ' ' || (o_orderkey % 40) AS anchor FROM orders), b AS (SELECT DISTINCT c_custkey AS doc_id, CAST(c_custkey % 40 AS VARCHAR) AS a FROM customer WHERE c_custkey % 3 <> 0)
SELECT e.doc_id, entry, CASE WHEN e.doc_id NOT IN (SELECT doc_id FROM b) THEN anchor WHEN b.a IS NOT NULL THEN b.a ELSE '-' END AS anchor FROM e LEFT JOIN b ON b.doc_id = e.doc_id AND b.a = trim(e.anchor)""")
def contents_anchors(c):
    """Contents anchors that exist in the body."""
    entries = c.table("orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("entry"), F.concat(F.lit(" "), mod("o_orderkey", 40).cast("string")).alias("anchor"))
    body = c.table("customer").where(mod("c_custkey", 3) != 0).select(F.col("c_custkey").alias("doc_id"), mod("c_custkey", 40).cast("string").alias("anchor"))
    return graph.keep_known_anchors(entries, body).select("doc_id", "entry", F.coalesce("anchor", F.lit("-")).alias("anchor"))


# ---------------------------------------------------------------- stores and images
@query("S6 S7", with_(S.DOC_WORDS) + """SELECT 'chunks' AS store, count(*) AS "rows" FROM documents UNION ALL SELECT 'vectors', count(*) FROM embeddings
UNION ALL SELECT 'postings', count(*) FROM (SELECT DISTINCT doc_id, unnest(words) AS term FROM doc_words)""")
def ingest_stores(c):
    """Rows of the three stores of an ingest, read back from the files that were written."""
    chunks = c.table("documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    vectors = c.table("embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return stores.write_ingest(stores.ingest_tables(chunks, vectors), f"{shared_dir(c.spark)}/ingest-{uuid.uuid4().hex}")


@query("C6", "SELECT doc_id, md5(chr(65533) || text) AS digest FROM documents")
def valid_texts(c):
    """Texts behind a byte that is no UTF-8: it becomes the replacement character."""
    broken = F.concat(F.unhex(F.lit("FF")), F.col("text").cast("binary")).cast("string")
    return c.table("documents").select("doc_id", F.md5(X.valid_text(broken)).alias("digest"))


HITS = """hits AS (SELECT doc_id % 40 AS query_id, doc_id AS chunk_id, doc_id // 10 AS doc_id, CASE WHEN lang = 'es' THEN 'image' ELSE 'text' END AS content_type,
  text || ' 图' || (doc_id % 7) || ' 图 ' || (doc_id % 5) || '.1' AS content, round(1.0 / (1 + doc_id % 13), 4) AS score FROM documents),
images AS (SELECT doc_id * 10 AS image_id, CASE WHEN doc_id % 4 <> 1 THEN doc_id END AS chunk_id, doc_id // 10 AS doc_id, '图' || (doc_id % 7) AS figure FROM documents WHERE doc_id % 3 = 0),
named AS (SELECT DISTINCT query_id, chunk_id, doc_id, score, '图' || unnest(regexp_extract_all(content, '图\\s*([0-9]+(?:[.\\-][0-9]+)*)', 1)) AS figure FROM hits WHERE content_type = 'text')"""


def image_hits(c):
    """Documents as hits that name figures, ten to a standard."""
    n = F.col("doc_id")
    return c.table("documents").select(
        mod("doc_id", 40).alias("query_id"), n.alias("chunk_id"), F.floor(n / 10).alias("doc_id"), F.when(F.col("lang") == "es", "image").otherwise("text").alias("content_type"),
        F.concat("text", F.lit(" 图"), mod("doc_id", 7).cast("string"), F.lit(" 图 "), mod("doc_id", 5).cast("string"), F.lit(".1")).alias("content"), F.round(1 / (1 + mod("doc_id", 13)), 4).alias("score"),
    )


def figure_images(c):
    n = F.col("doc_id")
    return c.table("documents").where(mod("doc_id", 3) == 0).select(
        (n * 10).alias("image_id"), F.when(mod("doc_id", 4) != 1, n).alias("chunk_id"), F.floor(n / 10).alias("doc_id"), F.concat(F.lit("图"), mod("doc_id", 7).cast("string")).alias("figure")
    )


@query("J4 J5", with_(HITS) + """, l AS (SELECT h.query_id, h.chunk_id, i.image_id FROM hits h JOIN images i USING (chunk_id) UNION SELECT n.query_id, n.chunk_id, i.image_id FROM named n JOIN images i USING (doc_id, figure))
SELECT query_id, chunk_id, string_agg(image_id::VARCHAR, ',' ORDER BY image_id) AS images FROM hits LEFT JOIN l USING (query_id, chunk_id) GROUP BY 1, 2""")
def image_links(c):
    """Images that a hit is or names."""
    linked = ranking.inject_image_links(image_hits(c), figure_images(c))
    ids = F.transform("images", lambda i: i["image_id"].cast("string"))
    return linked.select("query_id", "chunk_id", F.array_join(ids, ",").alias("images"))


@query("J6", with_(HITS) + """, rel AS (SELECT doc_id AS chunk_id, (doc_id + 3) * 1 AS related_id FROM documents WHERE doc_id % 6 = 1),
f AS (SELECT n.query_id, i.chunk_id, max(n.score) AS s FROM named n JOIN images i USING (doc_id, figure) WHERE i.chunk_id IS NOT NULL GROUP BY 1, 2),
f1 AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.query_id = f.query_id AND h.chunk_id = f.chunk_id)),
g AS (SELECT h.query_id, r.related_id AS chunk_id, max(h.score) AS s FROM hits h JOIN rel r USING (chunk_id) WHERE content_type = 'text' GROUP BY 1, 2),
g1 AS (SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.query_id = g.query_id AND h.chunk_id = g.chunk_id) AND NOT EXISTS (SELECT 1 FROM f1 WHERE f1.query_id = g.query_id AND f1.chunk_id = g.chunk_id))
SELECT query_id, chunk_id, s AS parent_score, 'pull_along' AS source FROM f1 UNION ALL SELECT query_id, chunk_id, s, 'pull_along_semantic' FROM g1""")
def pulled_images(c):
    """Images added to the hits because a hit names their figure or was related to them at ingest."""
    n = F.col("doc_id")
    related = c.table("documents").where(mod("doc_id", 6) == 1).select(n.alias("chunk_id"), (n + 3).alias("related_id"))
    added = ranking.pull_along_images(image_hits(c), figure_images(c), related, ratio=1.0)
    return added.select("query_id", "chunk_id", F.col("score").alias("parent_score"), "source")


@query("J7", """WITH t AS (SELECT l_orderkey AS doc_id, l_linenumber + 10 * l_orderkey AS text_id, l_linenumber AS a, l_linenumber + l_partkey % 2 AS b FROM lineitem WHERE l_linenumber % 2 = 1),
i AS (SELECT l_orderkey AS doc_id, l_linenumber + 10 * l_orderkey AS image_id, l_suppkey % 8 AS page FROM lineitem WHERE l_linenumber % 2 = 0)
SELECT DISTINCT text_id, image_id FROM t JOIN i USING (doc_id) WHERE page BETWEEN a - 1 AND b + 1""")
def images_by_page(c):
    """Images on a page of a text or on the next one."""
    line = c.table("lineitem")
    number = F.col("l_linenumber").cast("long")
    texts = line.where(mod("l_linenumber", 2) == 1).select(F.col("l_orderkey").alias("doc_id"), (number + 10 * F.col("l_orderkey")).alias("chunk_id"), number.alias("page_start"), (number + mod("l_partkey", 2)).alias("page_end"))
    images = line.where(mod("l_linenumber", 2) == 0).select(F.col("l_orderkey").alias("doc_id"), (number + 10 * F.col("l_orderkey")).alias("chunk_id"), mod("l_suppkey", 8).cast("long").alias("page"))
    return ranking.images_near_text(texts, images)
