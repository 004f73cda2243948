"""Registered queries of rendering, over blocks of every kind made from the lines of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import rendering
from docloom.plans import sql_tables as S
from docloom.plans.registry import query
from docloom.plans.sql_tables import with_

SPAN = "array<struct<kind:string,content:string>>"


def kinds(c):
    """Blocks and parts: every line is a block whose number gives its kind."""
    n, k = F.col("line_no"), F.col("line_no") % 12
    span = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("content"))
    text, name = F.col("text"), lambda prefix, end: F.concat(F.lit(prefix), n.cast("string"), F.lit(end))
    kind = (
        F.when(n == 1, "title").when(k == 2, "interline_equation").when(k == 3, "list").when(k == 4, "image").when(k == 5, "table").when(k == 6, "code").when(k == 7, "chart").when(k == 8, "page_number").otherwise("text")
    )
    spans = (
        F.when(k == 2, F.array(span("text", name("\\alpha_", "")))).when(k == 3, F.array(span("item", F.lit("first")), span("item", text)))
        .when(k == 9, F.array(span("text", text), span("inline_equation", name("x_", "")))).when(k.isin(4, 5, 6, 7), F.lit(None).cast(SPAN)).otherwise(F.array(span("text", text)))
    )
    lines = c.blocks().where("type <> 'title' OR line_no = 1")
    blocks = lines.select("doc_id", "page_idx", "line_no", kind.alias("type"), spans.alias("spans"), (1 + F.pmod("doc_id", F.lit(3))).cast("int").alias("level"), F.when(k == 6, "code").alias("sub_type"), F.lit("py").alias("lang"), F.lit(None).cast("string").alias("image_path"), "x0", "y0", "x1", "y1")
    part = lambda no, kind, spans=None, html=None, path=None, content=None: F.struct(
        F.lit(no).cast("long").alias("part_no"), F.lit(kind).alias("kind"), (F.lit(None) if spans is None else F.array(span("text", spans))).cast(SPAN).alias("spans"),
        *[(F.lit(None) if x is None else x).cast("string").alias(a) for a, x in (("html", html), ("image_path", path), ("content", content))])
    pieces = (
        F.when(k == 4, F.array(part(0, "body", path=name("p", ".png"), content=text), part(1, "caption", spans=name("Fig_", ""))))
        .when(k == 5, F.array(part(0, "caption", spans=F.lit("Table")), part(1, "body", html=name("<table><tr><td><eq>a &lt; ", "</eq></td></tr></table>")), part(2, "footnote", spans=F.lit("note"))))
        .when(k == 6, F.array(part(0, "body", spans=text))).when(k == 7, F.array(part(0, "body", path=name("c", ".png"))))
    )
    parts = lines.where((n > 1) & k.isin(4, 5, 6, 7)).select("doc_id", "line_no", F.explode(pieces).alias("p")).select("doc_id", "line_no", "p.*")
    return blocks, parts


KINDS = S.BLOCKS + r""", rb AS (
  SELECT doc_id, page_idx, line_no, text, CASE WHEN line_no = 1 THEN 1 ELSE line_no % 12 END AS k, 1 + doc_id % 3 AS level, regexp_replace(regexp_replace(text, '([*_`~$])', '\\\1', 'g'), '^\s+|\s+$', '', 'g') AS t FROM blocks WHERE type <> 'title' OR line_no = 1), rt AS (
  SELECT *, regexp_replace(t, '^(#{1,6}|[+-])([ \t])', '\\\1\2') AS p, '```py' || chr(10) || regexp_replace(text, '[ \t]+$', '') || chr(10) || '```' AS code, '<table><tr><td> $a < ' || line_no || '$ </td></tr></table>' AS html FROM rb)"""


@query("S9 F10 C7 C8", with_(KINDS) + r""", md AS (SELECT doc_id, line_no, CASE WHEN line_no = 1 THEN repeat('#', level) || ' ' || t ELSE CASE k WHEN 2 THEN '$$' || chr(10) || '\alpha_' || line_no || chr(10) || '$$' WHEN 3 THEN 'first  ' || chr(10) || t
  WHEN 4 THEN '![](images/p' || line_no || '.png)' || chr(10) || chr(10) || '<details>' || chr(10) || '<summary>image content</summary>' || chr(10) || chr(10) || trim(text, ' ') || chr(10) || '</details>' || chr(10) || chr(10) || 'Fig\_' || line_no
  WHEN 5 THEN 'Table' || chr(10) || html || chr(10) || chr(10) || 'note' WHEN 6 THEN code WHEN 7 THEN '![](images/c' || line_no || '.png)' WHEN 8 THEN '' WHEN 9 THEN regexp_replace(t || ' $x_' || line_no || '$', '^(#{1,6}|[+-])([ \t])', '\\\1\2') ELSE p END END AS m FROM rt)
SELECT doc_id, string_agg(m, chr(10) || chr(10) ORDER BY line_no) AS markdown FROM md WHERE m <> '' GROUP BY 1""")
def rendered_documents(c):
    """Documents of titles, formulas, lists, pictures, tables, code and charts as Markdown."""
    return rendering.documents(rendering.block_markdown(*kinds(c), order="line_no"), "line_no")


@query("S10 F10 C34", with_(KINDS) + r"""SELECT doc_id, page_idx, line_no, CASE WHEN line_no = 1 THEN 'text' ELSE CASE k WHEN 2 THEN 'equation' WHEN 4 THEN 'image' WHEN 5 THEN 'table' WHEN 6 THEN 'code' WHEN 7 THEN 'chart' WHEN 8 THEN 'page_number' ELSE 'text' END END AS type,
  CASE WHEN line_no > 1 THEN CASE k WHEN 2 THEN '' WHEN 4 THEN 'images/p' || line_no || '.png' WHEN 5 THEN '' WHEN 7 THEN 'images/c' || line_no || '.png' END END AS img_path,
  CASE WHEN line_no = 1 THEN t ELSE CASE k WHEN 2 THEN '$$' || chr(10) || '\alpha_' || line_no || chr(10) || '$$' WHEN 3 THEN 'first  ' || chr(10) || t WHEN 4 THEN NULL WHEN 5 THEN NULL WHEN 6 THEN NULL WHEN 7 THEN NULL WHEN 8 THEN t WHEN 9 THEN regexp_replace(t || ' $x_' || line_no || '$', '^(#{1,6}|[+-])([ \t])', '\\\1\2') ELSE p END END AS text,
  CAST(CASE WHEN line_no = 1 THEN level ELSE 0 END AS INTEGER) AS text_level, CASE WHEN line_no > 1 THEN CASE k WHEN 4 THEN 'Fig\_' || line_no WHEN 5 THEN 'Table' END END AS caption, CASE WHEN line_no > 1 AND k = 5 THEN 'note' END AS footnote,
  CASE WHEN line_no > 1 THEN CASE k WHEN 5 THEN html WHEN 6 THEN code WHEN 4 THEN trim(text, ' ') END END AS body FROM rt""")
def content_fields(c):
    """Typed fields of every block, as the JSON items have them."""
    f = lambda name: F.col(f"fields.{name}")
    items = rendering.content_items(*kinds(c), 600.0, 800.0, order="line_no")
    some = lambda *names: F.nullif(F.coalesce(*[F.array_join(f(n), "|") for n in names]), F.lit(""))
    return items.select(
        "doc_id", "page_idx", "line_no", f("type").alias("type"), f("img_path").alias("img_path"), f("text").alias("text"), F.coalesce(f("text_level"), F.lit(0)).alias("text_level"), some("image_caption", "table_caption").alias("caption"),
        some("table_footnote").alias("footnote"), F.coalesce(f("table_body"), f("code_body"), F.when(f("type") == "image", f("content"))).alias("body"),
    )
