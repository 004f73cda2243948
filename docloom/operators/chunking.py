"""Documents to parent and child chunks, tables out of text, per-document counts.

Lines come from exploding one document row, so everything grouped by document here is
bounded by the size of one stored text. Paragraph vectors may come as rows of their own;
those steps use the bucketed scans of ``ordered``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import presets as P
from docloom.functions import text as X
from docloom.functions.vectors import cosine
from docloom.operators.ordered import position_bucket, scan
from docloom.operators.skew import best_row, top_k


def split_lines(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    exploded = documents.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return exploded.select(key, (F.col("pos") + 1).cast("long").alias("line_no"), "line")


# ---------------------------------------------------------------- standard text
def chunk_standard(
    lines: DataFrame,
    chapters: Sequence[str] = tuple(P.CHAPTER_PATTERNS),
    sections: Sequence[str] = tuple(P.SECTION_PATTERNS),
    clauses: Sequence[str] = tuple(P.CLAUSE_PATTERNS),
) -> DataFrame:
    """Parent chunk per chapter, child chunk per clause.

    Every clause is closed at the next clause or chapter, a chapter ends its section, and a
    chapter title stands once in its parent. Text before the first chapter is no chunk. A
    chapter without clauses has one child with all its text.
    """
    line = F.trim("line")
    kept = lines.select("doc_id", "line_no", line.alias("line")).where(F.col("line") != "")
    kind = (
        F.when(X.matches_any("line", chapters), "chapter")
        .when(X.matches_any("line", sections), "section")
        .when(X.matches_any("line", clauses), "clause")
        .otherwise("content")
    )
    typed = kept.withColumn("kind", kind)
    along = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    is_ = lambda k: F.col("kind") == k
    typed = typed.withColumn("chapter_idx", F.sum(is_("chapter").cast("int")).over(along)).where("chapter_idx > 0")
    inside = Window.partitionBy("doc_id", "chapter_idx").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("doc_id", "chapter_idx")
    typed = typed.select(
        "*",
        F.sum(is_("clause").cast("int")).over(inside).alias("clause_idx"),
        F.last(F.when(is_("section"), F.col("line")), ignorenulls=True).over(inside).alias("section_title"),
        F.max(F.when(is_("chapter"), F.col("line"))).over(whole).alias("chapter_title"),
        F.max(is_("clause").cast("int")).over(whole).alias("has_clause"),
    )
    body = typed.where(~is_("chapter") & ~(is_("section") & (F.col("has_clause") == 1)))
    ordered = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n"
    )
    children = body.groupBy("doc_id", "chapter_idx", "clause_idx").agg(
        ordered.alias("content"), F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"),
        F.first("chapter_title").alias("chapter_title"),
        F.min_by("section_title", "line_no").alias("section_title"),
        F.min_by(F.when(is_("clause"), F.col("line")), "line_no").alias("clause_title"),
    )
    joined = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("clause_idx", "content"))), lambda s: s["content"]), "\n\n"
    )
    titles = typed.where(is_("chapter")).select("doc_id", "chapter_idx", "chapter_title", F.col("line_no").alias("title_line"))
    bodies = children.groupBy("doc_id", "chapter_idx").agg(joined.alias("body"), F.max("line_end").alias("line_end"))
    parents = titles.join(bodies, ["doc_id", "chapter_idx"], "left").select(
        "doc_id", "chapter_idx", F.lit(-1).alias("clause_idx"),
        F.concat_ws("\n\n", "chapter_title", "body").alias("content"),
        F.col("title_line").alias("line_start"), F.coalesce("line_end", "title_line").alias("line_end"),
        "chapter_title", F.lit(None).cast("string").alias("section_title"), F.lit(None).cast("string").alias("clause_title"),
    )
    chunks = parents.withColumn("chunk_type", F.lit("parent")).unionByName(children.withColumn("chunk_type", F.lit("child")))
    return number_chunks(
        chunks.select(
            "doc_id", "chapter_idx", "clause_idx", "chunk_type", "content",
            X.chapter_number("chapter_title").alias("chapter"), X.section_number("section_title").alias("section"),
            X.heading_clause_number("clause_title").alias("clause"), X.heading_clause_title("clause_title").alias("title"),
            "line_start", "line_end",
        ),
        ["chapter_idx", "clause_idx"],
    )


def number_chunks(chunks: DataFrame, order: Sequence[str], key: str = "doc_id") -> DataFrame:
    """Dense position inside the document and a stable chunk id."""
    w = Window.partitionBy(key).orderBy(*order)
    return chunks.withColumn("position", (F.row_number().over(w) - 1).cast("long")).withColumn(
        "chunk_id", F.xxhash64(key, "position", "content")
    )


def parent_of_child(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Child with the first parent of the same chapter; an unset chapter matches an unset one."""
    first = best_row(
        parents.select("doc_id", F.col("chapter").alias("_chapter"), F.col("chunk_id").alias("parent_id"), F.col("position").alias("_p")),
        ["doc_id", "_chapter"], [F.asc("_p")],
    ).drop("_p")
    condition = (F.col("c.doc_id") == F.col("p.doc_id")) & F.col("c.chapter").eqNullSafe(F.col("p._chapter"))
    return children.alias("c").join(first.alias("p"), condition, "left").select("c.*", "p.parent_id")


# ---------------------------------------------------------------- Markdown
def markdown_lines(lines: DataFrame) -> DataFrame:
    """Lines with section, clause and table run numbers.

    ``## `` opens a section, ``### `` or an ``x.y`` line a clause, ``|`` lines form table
    runs, a ``表 N`` line titles the next table. Blank lines end a table run.
    """
    stripped = F.trim("line")
    kind = (
        F.when(stripped == "", "blank")
        .when(stripped.startswith("|"), "table")
        .when(F.col("line").rlike("^# [^#]"), "title")
        .when(F.col("line").rlike("^## "), "section")
        .when(F.col("line").rlike("^### "), "clause")
        .when(stripped.rlike(r"^[0-9]+\.[0-9]+(?:\.[0-9]+)*\s+\S"), "clause")
        .when(stripped.rlike(r"^表\s*[0-9]+"), "table_title")
        .otherwise("text")
    )
    along = Window.partitionBy("doc_id").orderBy("line_no")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    flag = lambda k: (F.col("kind") == k).cast("int")
    typed = lines.select("doc_id", "line_no", "line", stripped.alias("stripped"), kind.alias("kind"))
    typed = typed.withColumn("_starts", (flag("table") == 1) & (F.coalesce(F.lag("kind").over(along), F.lit("")) != "table"))
    typed = typed.select(
        "*",
        F.sum(flag("section")).over(upto).alias("section_no"),
        F.sum(F.col("_starts").cast("int")).over(upto).alias("table_no"),
    )
    inside = Window.partitionBy("doc_id", "section_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return typed.withColumn("clause_no", F.sum(flag("clause")).over(inside)).drop("_starts")


def chunk_markdown(lines: DataFrame, budget: int = 800) -> DataFrame:
    """Parents of at most ``budget`` tokens of whole clauses, their clauses as children, tables apart."""
    typed = markdown_lines(lines).where("section_no > 0")
    heading = F.trim(F.regexp_replace("stripped", "^[# ]+", ""))
    headings = typed.where(F.col("kind") == "section").select("doc_id", "section_no", heading.alias("heading"))
    run_text = lambda order, value, sep: F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value]), sep
    )
    shown = typed.withColumn("piece", F.when(F.col("kind") == "clause", heading).otherwise(F.col("stripped")))
    pieces = shown.where(F.col("kind").isin("clause", "text")).groupBy("doc_id", "section_no", "clause_no").agg(
        run_text("line_no", "piece", "\n").alias("content"), F.min("line_no").alias("line_start")
    )
    clauses = pieces.where("clause_no > 0").withColumn("tokens", X.token_estimate("content", "ingest"))
    grouped = token_groups(clauses, ["doc_id", "section_no"], "clause_no", "tokens", budget)
    grouped = grouped.join(headings, ["doc_id", "section_no"])
    child = grouped.select(
        "doc_id", "section_no", "group_no", F.lit(1).alias("_o"), F.lit("child").alias("chunk_type"), "content", "heading",
        F.nullif(F.regexp_extract("content", r"^([0-9]+(?:\.[0-9]+)*|[A-Z]\.[0-9]+)\s", 1), F.lit("")).alias("clause"), "line_start",
    )
    parent = grouped.groupBy("doc_id", "section_no", "group_no", "heading").agg(
        run_text("clause_no", "content", "\n\n").alias("_body"), F.min("line_start").alias("line_start")
    ).select(
        "doc_id", "section_no", "group_no", F.lit(0).alias("_o"), F.lit("parent").alias("chunk_type"),
        F.concat_ws("\n\n", "heading", "_body").alias("content"), "heading", F.lit(None).cast("string").alias("clause"), "line_start",
    )
    with_clause = clauses.select("doc_id", "section_no").distinct()
    bare = headings.join(with_clause, ["doc_id", "section_no"], "left_anti").join(
        pieces.where("clause_no = 0").select("doc_id", "section_no", F.col("content").alias("_body"), "line_start"),
        ["doc_id", "section_no"], "left",
    ).select(
        "doc_id", "section_no", F.lit(0).alias("group_no"), F.lit(0).alias("_o"), F.lit("parent").alias("chunk_type"),
        F.concat_ws("\n\n", "heading", "_body").alias("content"), "heading", F.lit(None).cast("string").alias("clause"),
        F.coalesce("line_start", F.lit(0)).alias("line_start"),
    )
    tables = typed.where(F.col("kind") == "table").groupBy("doc_id", "section_no", "table_no").agg(
        run_text("line_no", "stripped", "\n").alias("_md"), F.min("line_no").alias("line_start")
    )
    titles = typed.where(F.col("kind") == "table_title").select("doc_id", (F.col("table_no") + 1).alias("table_no"), F.col("stripped").alias("_title"), F.col("line_no").alias("_at"))
    titles = titles.groupBy("doc_id", "table_no").agg(F.max_by("_title", "_at").alias("_title"))
    table_chunks = tables.join(titles, ["doc_id", "table_no"], "left").join(headings, ["doc_id", "section_no"]).select(
        "doc_id", "section_no", F.lit(-1).alias("group_no"), F.lit(0).alias("_o"), F.lit("parent").alias("chunk_type"),
        F.concat_ws("\n\n", "_title", "_md").alias("content"), "heading", F.lit(None).cast("string").alias("clause"), "line_start",
    )
    everything = child.unionByName(parent).unionByName(bare).unionByName(table_chunks)
    return number_chunks(everything, ["section_no", "group_no", "_o", "line_start"]).drop("_o")


def token_groups(df: DataFrame, keys: Sequence[str], order: str, tokens: str, budget: int) -> DataFrame:
    """Number consecutive rows so that each group stays within the budget; a row is never split."""
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, tokens))).alias("_rows"))
    zero = F.struct(F.lit(0).alias("group"), F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, row: Column) -> Column:
        full = (acc["used"] > 0) & (acc["used"] + row[tokens] > budget)
        full = full | ((F.size(acc["out"]) > 0) & (acc["used"] == 0) & (row[tokens] > budget))
        group = acc["group"] + full.cast("int")
        return F.struct(
            group.alias("group"),
            F.when(full, row[tokens].cast("long")).otherwise(acc["used"] + row[tokens]).alias("used"),
            F.concat(acc["out"], F.array(group)).alias("out"),
        )

    numbered = rows.select(*keys, F.inline(F.arrays_zip(F.col("_rows").alias("_r"), F.aggregate("_rows", zero, step)["out"].alias("group_no"))))
    return df.join(numbered.select(*keys, F.col("_r")[order].alias(order), "group_no"), [*keys, order])


# ---------------------------------------------------------------- textbook
def split_paragraphs(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    parts = F.filter(F.transform(F.split(text, r"\n[ \t\r\f]*\n\s*"), lambda p: F.trim(p)), lambda p: p != "")
    return documents.select(key, F.posexplode(parts).alias("pos", "paragraph")).select(
        key, (F.col("pos") + 1).cast("long").alias("para_no"), "paragraph"
    )


def semantic_boundaries(paragraphs: DataFrame, minimum_gap: int = 3, bucket: int = 1024) -> DataFrame:
    """Paragraph numbers that start a new parent: rows (doc_id, boundary).

    A boundary lies where the similarity to the previous vector is below mean minus half a
    population deviation. Boundaries keep ``minimum_gap`` paragraphs between them, first
    come first served: a candidate that far from the one before it is always kept, so the
    greedy choice runs inside short runs of close candidates.
    """
    before = scan(
        paragraphs, ["doc_id"], ["para_no"], position_bucket("para_no", bucket), previous={"_pv": F.col("vector")}
    )
    sims = before.where(F.col("_pv").isNotNull()).select("doc_id", "para_no", cosine("_pv", "vector").alias("sim"))
    bars = sims.groupBy("doc_id").agg((F.avg("sim") - 0.5 * F.stddev_pop("sim")).alias("bar"))
    first = paragraphs.groupBy("doc_id").agg(F.min("para_no").alias("_first"))
    drops = sims.join(bars, "doc_id").where(F.round("sim", 9) < F.round("bar", 9)).join(first, "doc_id")
    marks = drops.select("doc_id", "_first", (F.col("para_no") - F.col("_first")).alias("at"))
    marks = marks.unionByName(first.select("doc_id", "_first", F.lit(0).cast("long").alias("at")))
    spaced = scan(marks, ["doc_id"], ["at"], position_bucket("at", bucket), previous={"_before": F.col("at")})
    opens = (F.col("_before").isNull() | (F.col("at") - F.col("_before") >= minimum_gap)).cast("int")
    runs = scan(spaced.withColumn("_o", opens), ["doc_id"], ["at"], position_bucket("at", bucket), sums={"run": F.col("_o")})
    listed = runs.groupBy("doc_id", "_first", "run").agg(F.sort_array(F.collect_list("at")).alias("ats"))
    none = F.array().cast("array<long>")
    kept = F.aggregate(
        "ats", none,
        lambda acc, x: F.when((F.size(acc) == 0) | (x - F.element_at(acc, -1) >= minimum_gap), F.concat(acc, F.array(x))).otherwise(acc),
    )
    return listed.select("doc_id", "_first", F.explode(kept).alias("at")).where("at > 0").select(
        "doc_id", (F.col("at") + F.col("_first")).alias("boundary")
    )


def chunk_textbook(paragraphs: DataFrame, boundaries: DataFrame, min_parent: int = 100, min_child: int = 50) -> DataFrame:
    """Parents between boundaries, paragraphs as children; short ones are left out.

    Documents with fewer than two paragraphs become one parent.
    """
    marks = paragraphs.join(
        boundaries.select("doc_id", F.col("boundary").alias("para_no"), F.lit(1).alias("_b")), ["doc_id", "para_no"], "left"
    )
    upto = Window.partitionBy("doc_id").orderBy("para_no").rowsBetween(Window.unboundedPreceding, 0)
    grouped = marks.withColumn("part", F.coalesce(F.sum("_b").over(upto), F.lit(0)))
    sizes = Window.partitionBy("doc_id")
    grouped = grouped.withColumn("_n", F.count("*").over(sizes))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para_no", "paragraph"))), lambda s: s["paragraph"]), "\n\n")
    parents = grouped.groupBy("doc_id", "part", "_n").agg(body.alias("content"), F.min("para_no").alias("para_no"))
    parents = parents.where((F.length("content") > min_parent) | (F.col("_n") < 2))
    children = grouped.join(parents.select("doc_id", "part"), ["doc_id", "part"], "left_semi").where(
        (F.length("paragraph") > min_child) & (F.col("_n") >= 2)
    )
    both = parents.select("doc_id", "part", F.lit(0).alias("_o"), F.lit("parent").alias("chunk_type"), "content", "para_no").unionByName(
        children.select("doc_id", "part", F.lit(1).alias("_o"), F.lit("child").alias("chunk_type"), F.col("paragraph").alias("content"), "para_no")
    )
    return number_chunks(both, ["part", "_o", "para_no"]).drop("_o")


# ---------------------------------------------------------------- tables in text
def mask_tables(text: Column | str, token: str = "[TABLE]") -> Column:
    return F.regexp_replace(X._col(text), r"(?is)<table.*?</table>", token)


def table_cells(df: DataFrame, keys: Sequence[str], html: str) -> DataFrame:
    """Rows (keys, row_no, col_no, colspan, rowspan, is_header, text) of table markup."""
    rows = df.select(*keys, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)(?=<tr[\s>]|</table|</tr|$)"), F.lit(1))).alias("row_no", "_row"))
    cells = rows.select(
        *keys, "row_no",
        F.posexplode(F.regexp_extract_all("_row", F.lit(r"(?is)<t[hd](?:\s[^>]*)?>.*?(?=<t[hd][\s>]|</t[hd]|$)"), F.lit(0))).alias("col_no", "_cell"),
    )
    span = lambda n: F.greatest(F.lit(1), F.coalesce(F.nullif(F.regexp_extract("_cell", rf"(?i)^<[^>]*{n}\s*=\s*[\"']?([0-9]+)", 1), F.lit("")).cast("int"), F.lit(1)))
    body = F.regexp_replace(F.regexp_replace("_cell", r"(?is)^<t[hd][^>]*>", ""), r"(?s)<[^>]+>", "")
    return cells.select(
        *keys, "row_no", "col_no", span("colspan").alias("colspan"), span("rowspan").alias("rowspan"),
        F.col("_cell").rlike("(?i)^<th").alias("is_header"), F.trim(body).alias("text"),
    )


def gfm_table(cells: DataFrame, keys: Sequence[str], row: str = "row_no", col: str = "col_no", value: str = "text") -> DataFrame:
    """Pipe table per key: bars escaped, line breaks as blanks, missing cells empty."""
    width = cells.groupBy(*keys).agg((F.max(col) + 1).alias("_w"))
    shown = F.trim(F.replace(F.replace(F.coalesce(F.col(value).cast("string"), F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|")))
    by_row = cells.groupBy(*keys, row).agg(F.map_from_entries(F.collect_list(F.struct(F.col(col).cast("int").alias("k"), shown.alias("v")))).alias("_m"))
    listed = F.transform(F.sequence(F.lit(0), (F.col("_w") - 1).cast("int")), lambda i: F.coalesce(F.element_at("_m", i), F.lit("")))
    drawn = by_row.join(width, list(keys)).select(
        *keys, row, F.concat(F.lit("| "), F.array_join(listed, " | "), F.lit(" |")).alias("_line"),
        F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("_w").cast("int")), " | "), F.lit(" |")).alias("_rule"),
    )
    lines = F.transform(F.array_sort(F.collect_list(F.struct(row, "_line"))), lambda s: s["_line"])
    return drawn.groupBy(*keys).agg(lines.alias("_lines"), F.first("_rule").alias("_rule")).select(
        *keys, F.array_join(F.concat(F.slice("_lines", 1, 1), F.array("_rule"), F.expr("slice(_lines, 2, size(_lines))")), "\n").alias("markdown")
    )


def tables_in_text(lines: DataFrame, title_pattern: str = r"^(?:续\s*)?表\s*([A-Za-z0-9０-９][A-Za-z0-9０-９.\-]*)(?:\s+(.+))?$", table_pattern: str = r"(?i)^<table[\s>]", look_back: int = 8) -> DataFrame:
    """Table lines with title, number and page share: rows (doc_id, line_no, title, number, offset_share).

    The title is the nearest non-blank line above, within ``look_back`` lines, when it reads
    like one. ``offset_share`` is the part of the text's characters before the line.
    """
    stripped = F.trim("line")
    order = Window.partitionBy("doc_id").orderBy("line_no")
    back = order.rowsBetween(-look_back, -1)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("doc_id")
    seen = lines.select(
        "doc_id", "line_no", stripped.alias("line"),
        F.last(F.when(stripped != "", stripped), ignorenulls=True).over(back).alias("_above"),
        F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).alias("_offset"),
        (F.sum(F.length("line") + 1).over(whole) - 1).alias("_total"),
    )
    hit = F.col("_above").rlike(title_pattern)
    return seen.where(F.col("line").rlike(table_pattern)).select(
        "doc_id", "line_no", "line",
        F.when(hit, F.col("_above")).alias("title"),
        F.when(hit, F.nullif(F.regexp_extract("_above", title_pattern, 1), F.lit(""))).alias("number"),
        F.round(F.col("_offset") / F.greatest(F.col("_total"), F.lit(1)), 6).alias("offset_share"),
    )


def estimated_page(offset_share: Column, page_count: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(offset_share * page_count)).cast("int")


def image_chunk(page: Column, figure: Column, caption: Column, description: Column) -> Column:
    """Text of an image chunk: page, figure number, caption and description."""
    return F.concat_ws(
        " ", F.concat(F.lit("[图片描述] 第"), page.cast("string"), F.lit("页")), F.nullif(figure, F.lit("")),
        F.concat(F.lit("："), F.nullif(caption, F.lit(""))), F.concat(F.lit("\n"), description),
    )


# ---------------------------------------------------------------- per-document counts
def keyword_topk(documents: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Most frequent words of 2 to 6 characters, digits apart; ties by first occurrence."""
    words = F.split(F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}_]+", " ")), " ")
    placed = documents.select(key, F.posexplode(words).alias("pos", "word")).where(
        F.length("word").between(2, 6) & ~F.col("word").rlike("^[0-9]+$")
    )
    counted = placed.groupBy(key, "word").agg(F.count("*").alias("freq"), F.min("pos").alias("first_pos"))
    return top_k(counted, [key], [F.desc("freq"), F.asc("first_pos")], k).drop("first_pos")


def _anywhere(word: str) -> str:
    """Pattern of a word as it is written, in either case."""
    quoted = word.replace("\\E", "\\E\\\\E\\Q")
    return f"(?i)\\Q{quoted}\\E"


def keyword_scores(documents: DataFrame, groups: Mapping[str, Sequence[str]], k: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Top categories by summed keyword occurrences; ties by declaration order.

    Counting happens inside the row, so no text is shuffled.
    """
    total = lambda words: sum((F.regexp_count(F.col(text), F.lit(_anywhere(w))) for w in words), F.lit(0))
    scores = F.array(
        *[F.struct(total(ws).alias("score"), F.lit(-i).alias("o"), F.lit(name).alias("category")) for i, (name, ws) in enumerate(groups.items())]
    )
    best = F.slice(F.sort_array(F.filter(scores, lambda s: s["score"] > 0), asc=False), 1, k)
    return documents.select(key, F.posexplode(best).alias("pos", "s")).select(
        key, (F.col("pos") + 1).alias("rank"), F.col("s.category").alias("category"), F.col("s.score").cast("long").alias("score")
    )


def most_frequent_level(text: Column, levels: Mapping[str, Sequence[str]] = P.VOLTAGE_LEVELS) -> Column:
    """The level whose spellings occur most; ties by declaration order, null when none does."""
    total = lambda words: sum((F.regexp_count(text, F.lit(_anywhere(w))) for w in words), F.lit(0))
    best = F.array_max(F.array(*[F.struct(total(ws).alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("v")) for i, (name, ws) in enumerate(levels.items())]))
    return F.when(best["n"] > 0, best["v"])
