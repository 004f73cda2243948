"""Blocks as Markdown and as typed items: text with formulas, titles, lists, code, pictures, tables, charts.

``blocks`` has one row per block: doc_id, page_idx, ``order``, type, spans, level, sub_type, lang,
image_path and a box. ``spans`` is an array of (kind, content); kind is text, item (opens a list item),
inline_equation or interline_equation. ``parts`` has the pieces of pictures, tables, charts and code:
doc_id, ``order``, part_no, kind (body, caption or footnote), spans, html, image_path, content. All
of it runs as expressions in the JVM; what is collected is one block's parts, or one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import boxes as B
from docloom.functions import presets as P
from docloom.functions import text as X

# --- fixed values: block types, parts of Markdown --------------------------------------------
PLAIN = ["text", "list", "index", "abstract", "ref_text"]
VISUAL = ["image", "table", "chart", "code"]
BREAK = "  \n"
COORDS = ("x0", "y0", "x1", "y1")


def shown(spans: str, escape: bool = True) -> Column:
    """Spans as one Markdown text: words escaped, formulas between dollar signs as they are, list items on lines of their own."""
    text = lambda s: X.escape_markdown(s["content"]) if escape else s["content"]

    def one(s: Column) -> Column:
        latex = F.trim(s["content"])
        return (
            F.when(s["kind"] == "inline_equation", F.concat(F.lit("$"), latex, F.lit("$"))).when(s["kind"] == "interline_equation", F.concat(F.lit("\n$$\n"), latex, F.lit("\n$$\n")))
            .when(s["kind"] == "item", F.concat(F.lit(BREAK), F.trim(text(s)))).otherwise(F.trim(text(s)))
        )

    kept = F.filter(spans, lambda s: F.trim(F.coalesce(s["content"], F.lit(""))) != "")
    joined = F.array_join(F.transform(kept, one), " ")
    breaks = F.regexp_replace(F.regexp_replace(joined, " *" + BREAK, BREAK), r" ?(\n\$\$\n[^$]*\n\$\$\n) ?", "$1")
    return F.regexp_replace(F.coalesce(breaks, F.lit("")), r"^\s+|\s+$", "")


def code_text(spans: str, lang: Column) -> Column:
    """Code in a fence: nothing escaped, lines without blanks at their end; empty code gives nothing."""
    raw = F.array_join(F.transform(spans, lambda s: s["content"]), "\n")
    lines = F.regexp_replace(F.regexp_replace(F.coalesce(raw, F.lit("")), r"[ \t]+(\n|$)", "$1"), r"\n+$", "")
    name = F.when(F.coalesce(lang, F.lit("")) == "", "txt").otherwise(lang)
    return F.when(F.trim(lines) == "", "").otherwise(F.concat(F.lit("```"), name, F.lit("\n"), lines, F.lit("\n```")))


def table_html(html: Column, folder: str) -> Column:
    """Table markup for Markdown: stored pictures below ``folder``, formula tags as inline formulas."""
    linked = F.regexp_replace(html, r'src="(?!data:)([^"]+)"', f'src="{folder}/$1"') if folder else html
    plain = F.split(linked, r"(?s)<eq>|</eq>")
    unescaped = lambda x: F.replace(F.replace(F.replace(F.replace(F.replace(x, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&#x27;"), F.lit("'")), F.lit("&amp;"), F.lit("&"))
    pieces = F.transform(plain, lambda x, i: F.when(i % 2 == 1, F.concat(F.lit(" $"), unescaped(x), F.lit("$ "))).otherwise(x))
    return F.when(linked.isNull(), None).otherwise(F.array_join(pieces, ""))


def picture(path: Column, folder: str) -> Column:
    return F.when(F.coalesce(path, F.lit("")) != "", F.concat(F.lit(f"![]({folder}/"), path, F.lit(")")))


def visual_text(parts: DataFrame, blocks: DataFrame, order: str, folder: str) -> DataFrame:
    """(doc_id, ``order``, markdown) of blocks with parts, in the order of the parts.

    Lines follow each other by a hard break; markup starts on a line of its own and is followed by a
    blank line; what a picture says stands in a fold with blank lines around it.
    """
    of = parts.join(blocks.where(F.col("type").isin(VISUAL)).select("doc_id", order, "type", "sub_type", "lang"), ["doc_id", order])
    body, kind = F.col("kind") == "body", F.col("type")
    line = F.when(~body, shown("spans")).when(kind == "code", F.when(F.coalesce("sub_type", F.lit("code")) == "code", code_text("spans", F.col("lang"))).otherwise(shown("spans")))
    line = line.when((kind == "table") & (F.coalesce("html", F.lit("")) != ""), None).otherwise(picture(F.col("image_path"), folder))
    said = F.trim(F.coalesce("content", F.lit("")))
    fold = F.when(body & (kind == "image") & (said != ""), F.concat(F.lit("<details>\n<summary>"), F.coalesce("sub_type", F.lit("image content")), F.lit("</summary>\n\n"), said, F.lit("\n</details>")))
    markup = F.when(body & (kind == "table"), table_html(F.col("html"), folder))
    segment = lambda t, name: F.struct(t.alias("t"), F.lit(name).alias("k"))
    segments = F.filter(F.array(segment(line, "line"), segment(markup, "html"), segment(fold, "fold")), lambda s: F.trim(F.coalesce(s["t"], F.lit(""))) != "")
    listed = of.groupBy("doc_id", order).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part_no", segments.alias("s")))), lambda p: p["s"])).alias("s"))
    gap = lambda before, now: F.when(before == "", "").when((before == "html") | (before == "fold") | (now == "fold"), "\n\n").when(now == "html", "\n").otherwise(BREAK)
    drawn = F.aggregate("s", F.struct(F.lit("").alias("t"), F.lit("").alias("k")), lambda a, s: F.struct(F.concat(a["t"], gap(a["k"], s["k"]), s["t"]).alias("t"), s["k"].alias("k")))
    return listed.select("doc_id", order, drawn["t"].alias("markdown"))


def block_markdown(blocks: DataFrame, parts: DataFrame, order: str = "block_no", folder: str = "images", text_only: bool = False) -> DataFrame:
    """``blocks`` with markdown: the text each block shows, empty where it shows none.

    Titles carry their level (none counts as 1), display formulas stand between double dollars or as their picture,
    ``text_only`` leaves out pictures, charts and tables. Page furniture shows nothing.
    """
    text, kind = shown("spans"), F.col("type")
    title = F.when(text != "", F.concat(F.repeat(F.lit("#"), F.greatest(F.coalesce("level", F.lit(1)), F.lit(1)).cast("int")), F.lit(" "), text))
    latex = F.regexp_replace(F.array_join(F.transform("spans", lambda s: s["content"]), " "), r"^\s+|\s+$", "")
    formula = F.when(F.coalesce(latex, F.lit("")) != "", F.concat(F.lit("$$\n"), latex, F.lit("\n$$"))).otherwise(picture(F.col("image_path"), folder))
    drawn = (
        F.when(kind.isin(P.FURNITURE_TYPES), None).when(kind == "title", title).when(kind == "interline_equation", formula).when(kind == "text", X.escape_block_prefix(text))
        .when(kind.isin(PLAIN), text).when(kind.isin(VISUAL[:3]) if text_only else F.lit(False), None).otherwise(F.col("_v"))
    )
    made = visual_text(parts, blocks, order, folder).withColumnRenamed("markdown", "_v")
    return blocks.join(made, ["doc_id", order], "left").withColumn("markdown", F.coalesce(F.regexp_replace(drawn, r"^\s+|\s+$", ""), F.lit(""))).drop("_v")


def documents(rendered: DataFrame, order: str = "block_no") -> DataFrame:
    """(doc_id, markdown): the blocks that show something, parted by blank lines; a document is one stored value."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, "markdown"))), lambda s: s["markdown"])
    return rendered.where("markdown <> ''").groupBy("doc_id").agg(F.array_join(listed, "\n\n").alias("markdown"))


def content_items(blocks: DataFrame, parts: DataFrame, width: float, height: float, order: str = "block_no", folder: str = "images") -> DataFrame:
    """(doc_id, page_idx, ``order``, fields): each block as typed fields, those it has not null.

    Text-like blocks are text, titles text with a level, formulas equations with LaTeX, references a list;
    pictures, tables, charts and code carry captions, footnotes and their body. Furniture keeps its type. Boxes are
    on the 0..1000 page scale. ``F.to_json`` of the fields gives the item, as it leaves out nulls.
    """
    pieces = parts.select("doc_id", order, "part_no", F.col("kind").alias("_kind"), shown("spans").alias("t"), F.struct("spans", "html", "image_path", "content").alias("b"))
    texts = lambda kind: F.transform(F.array_sort(F.collect_list(F.when((F.col("_kind") == kind) & (F.col("t") != ""), F.struct("part_no", "t")))), lambda s: s["t"])
    body = F.max_by("b", F.when(F.col("_kind") == "body", F.col("part_no"))).alias("body")
    grouped = pieces.groupBy("doc_id", order).agg(texts("caption").alias("captions"), texts("footnote").alias("footnotes"), body)
    seen = blocks.join(grouped, ["doc_id", order], "left").withColumn("_code", F.col("body.spans"))
    kind, text = F.col("type"), shown("spans")
    file = lambda path: F.when(F.coalesce(path, F.lit("")) != "", F.concat(F.lit(folder + "/"), path)).otherwise("")
    latex = F.array_join(F.transform("spans", lambda s: s["content"]), " ")
    has_latex = F.trim(F.coalesce(latex, F.lit(""))) != ""
    only = lambda types, value: F.when(kind.isin(types), value)
    lists = lambda of, c: [only([v], F.coalesce(F.col(of), F.array().cast("array<string>"))).alias(f"{v}_{c}") for v in VISUAL]
    box = B.page_scale(B.box(), width, height)
    plain = F.when(kind == "text", X.escape_block_prefix(text)).otherwise(text)
    fields = F.struct(
        F.when(kind.isin("text", "index", "list", "abstract", "title"), "text").when(kind == "interline_equation", "equation").when(kind == "ref_text", "list").otherwise(kind).alias("type"),
        F.when(kind == "ref_text", "ref_text").when(kind.isin(VISUAL), F.col("sub_type")).alias("sub_type"),
        only(["image", "table", "chart"], file(F.col("body.image_path"))).when(kind == "interline_equation", file(F.col("image_path"))).alias("img_path"),
        F.when(kind.isin("ref_text", *VISUAL), None).when(kind == "interline_equation", F.when(has_latex, F.concat(F.lit("$$\n"), F.trim(latex), F.lit("\n$$")))).otherwise(plain).alias("text"),
        F.when((kind == "interline_equation") & has_latex, "latex").alias("text_format"), F.when((kind == "title") & (F.coalesce("level", F.lit(1)) != 0), F.coalesce("level", F.lit(1)).cast("int")).alias("text_level"),
        only(["ref_text"], F.filter(F.transform("spans", lambda s: F.trim(X.escape_markdown(s["content"]))), lambda t: t != "")).alias("list_items"),
        F.when(kind == "chart", F.coalesce("body.content", F.lit(""))).when((kind == "image") & (F.trim(F.coalesce("body.content", F.lit(""))) != ""), F.trim("body.content")).alias("content"),
        *lists("captions", "caption"), *lists("footnotes", "footnote"),
        only(["table"], F.when(F.coalesce("body.html", F.lit("")) != "", table_html(F.col("body.html"), folder))).alias("table_body"),
        only(["code"], F.when(F.coalesce("sub_type", F.lit("code")) == "code", code_text("_code", F.col("lang"))).otherwise(shown("_code"))).alias("code_body"),
        F.array(*[box[c] for c in COORDS]).alias("bbox"), F.col("page_idx"),
    )
    return seen.select("doc_id", "page_idx", order, fields.alias("fields"))


def json_items(items: DataFrame, order: str = "block_no") -> DataFrame:
    """(doc_id, page_idx, ``order``, item): the fields of each block as JSON."""
    return items.select("doc_id", "page_idx", order, F.to_json("fields").alias("item"))


def json_pages(items: DataFrame, order: str = "block_no") -> DataFrame:
    """(doc_id, page_idx, items): the blocks of each page as one JSON array, in order."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, "item"))), lambda s: s["item"])
    return json_items(items, order).groupBy("doc_id", "page_idx").agg(F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")).alias("items"))
