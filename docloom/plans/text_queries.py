"""Registered queries of the text functions, over lines, documents, pages and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions import questions as Qn
from docloom.functions import text as X
from docloom.functions import vectors as V
from docloom.plans import sql_tables as S
from docloom.plans.registry import query
from docloom.plans.sql_tables import with_


def mod(column, n):
    return F.pmod(F.col(column), F.lit(n))


def pick(column, values):
    """One of the values, by the remainder of a column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (mod(column, len(values)) + 1).cast("int"))


def pick_sql(column, values):
    return "([" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"])[CAST({column} % {len(values)} AS INTEGER) + 1]"


@query("C1 S1", """SELECT doc_id, sha256(text) AS content_hash, 'recall:' || md5(concat_ws('|', text, lang)) AS memo_key FROM documents""")
def content_hashes(c):
    """Content digest and cache key of every document."""
    return c.table("documents").select("doc_id", X.content_hash("text").alias("content_hash"), X.memo_key("recall", F.col("text"), F.col("lang")).alias("memo_key"))


@query("C2", r"""WITH t AS (SELECT doc_id, text || repeat('标准', CAST(doc_id % 7 AS INTEGER)) AS t FROM documents),
n AS (SELECT doc_id, length(t) AS n, length(t) - length(regexp_replace(t, '[一-鿿]', '', 'g')) AS k FROM t)
SELECT doc_id, CAST(floor(n / 1.5) AS BIGINT) AS chars, CAST(floor(k * 1.5 + (n - k) / 4) AS BIGINT) AS mixed, CAST(k + floor((n - k) / 4) AS BIGINT) AS ingest, CAST(n // 2 AS BIGINT) AS half FROM n""")
def token_estimates(c):
    """Token estimates of every document in the four ways."""
    t = c.table("documents").select("doc_id", F.concat("text", F.repeat(F.lit("标准"), mod("doc_id", 7).cast("int"))).alias("t"))
    return t.select("doc_id", *[X.token_estimate("t", m).alias(m) for m in ("chars", "mixed", "ingest", "half")])


WIDE = "ＡＢ１２（ﬁx）"


@query("C3 C5 C7", with_(S.LINES) + f"""
SELECT doc_id, line_no, translate(line || '{WIDE}', 'ＡＢ１２（）', 'AB12()') AS narrow, translate(line || '{WIDE}', 'ＡＢ１２', 'AB12') AS letters,
  replace(line || '{WIDE}', 'ﬁ', 'fi') AS plain, regexp_replace(line || '*a_$', '([*_`~$])', '\\\\\\1', 'g') AS escaped,
  CASE WHEN line_no % 3 = 0 THEN '\\# ' ELSE '' END || line AS prefixed FROM lines""")
def text_cleanup(c):
    """Width, ligatures and Markdown escapes on every line."""
    raw = F.concat(F.col("line"), F.lit(WIDE))
    headed = F.concat(F.when(mod("line_no", 3) == 0, "# ").otherwise(""), F.col("line"))
    return c.lines().select(
        "doc_id", "line_no", X.half_width(raw).alias("narrow"), X.half_width(raw, letters_only=True).alias("letters"),
        X.replace_ligatures(raw).alias("plain"), X.escape_markdown(F.concat(F.col("line"), F.lit("*a_$"))).alias("escaped"),
        X.escape_block_prefix(headed).alias("prefixed"),
    )


@query("C4", with_(S.LINES) + r"""
, l AS (SELECT doc_id, line_no, CASE WHEN line_no % 2 = 0 THEN line || 'word-' ELSE line END AS line,
   CASE WHEN line_no % 4 = 1 THEN 'x' || line ELSE line END AS nl FROM lines),
j AS (SELECT doc_id, line_no, line, lead(nl) OVER (PARTITION BY doc_id ORDER BY line_no) AS nx FROM l)
SELECT doc_id, line_no, CASE WHEN regexp_matches(line, '[A-Za-z]+-\s*$') AND coalesce(regexp_matches(nx, '^\s*\p{Ll}'), false) THEN regexp_replace(rtrim(line, ' '), '.$', '')
  WHEN regexp_matches(line, '[A-Za-z]+-\s*$') THEN rtrim(line, ' ') ELSE rtrim(line, ' ') || ' ' END AS part FROM j""")
def hyphen_join(c):
    """What each line adds to its paragraph, broken words rejoined."""
    # The window covers the lines of one stored document.
    along = Window.partitionBy("doc_id").orderBy("line_no")
    shown = F.when(mod("line_no", 2) == 0, F.concat(F.col("line"), F.lit("word-"))).otherwise(F.col("line"))
    opening = F.when(mod("line_no", 4) == 1, F.concat(F.lit("x"), F.col("line"))).otherwise(F.col("line"))
    rows = c.lines().select("doc_id", "line_no", shown.alias("line"), opening.alias("_o")).withColumn("_next", F.lead("_o").over(along))
    return rows.select("doc_id", "line_no", X.join_lines("line", "_next").alias("part"))


@query("C8", with_(S.LINES) + r"""
SELECT doc_id, line_no, line AS formula, trim('x = ' || line, ' ' || chr(10)) AS code, 'a [' || line || '] b' AS bracketed FROM (SELECT doc_id, line_no, trim(line, ' ') AS line FROM lines) WHERE line <> ''""")
def formula_and_code(c):
    """Display brackets and code fences taken off."""
    line = F.trim("line")
    rows = c.lines().select("doc_id", "line_no", line.alias("line")).where(F.col("line") != "")
    return rows.select(
        "doc_id", "line_no", X.strip_display_formula(F.concat(F.lit("\\[ "), F.col("line"), F.lit(" \\]"))).alias("formula"),
        X.strip_code_fence(F.concat(F.lit("```python\nx = "), F.col("line"), F.lit("\n```"))).alias("code"),
        X.plain_brackets(F.concat(F.lit("a \\["), F.col("line"), F.lit("\\] b"))).alias("bracketed"),
    )


STANDARD_TEXT_SQL = """t AS (SELECT doc_id, line_no, 'as in ' || CASE WHEN doc_id % 3 = 0 THEN '应符合 GB/T ' ELSE 'GB ' END || (1000 + doc_id % 300)
   || CASE WHEN line_no % 2 = 0 THEN '-' || (1990 + line_no % 30) ELSE '' END || ' and DL/T ' || (600 + line_no % 20) || ' 第' || (line_no % 9) || '.' || (doc_id % 5) || '条 ' || (line_no % 250) || 'kV' AS t FROM lines)"""


def standard_text(c):
    number = F.concat(F.when(mod("doc_id", 3) == 0, "应符合 GB/T ").otherwise("GB "), (1000 + mod("doc_id", 300)).cast("string"))
    year = F.when(mod("line_no", 2) == 0, F.concat(F.lit("-"), (1990 + mod("line_no", 30)).cast("string"))).otherwise("")
    tail = F.concat(
        F.lit(" and DL/T "), (600 + mod("line_no", 20)).cast("string"), F.lit(" 第"), mod("line_no", 9).cast("string"), F.lit("."),
        mod("doc_id", 5).cast("string"), F.lit("条 "), mod("line_no", 250).cast("string"), F.lit("kV"),
    )
    return c.lines().select("doc_id", "line_no", F.concat(F.lit("as in "), number, year, tail).alias("t"))


@query("C11 C12 C17 F13", with_(S.LINES, STANDARD_TEXT_SQL) + r"""
SELECT doc_id, line_no, regexp_extract(t, '(GB(/T)?\s*[0-9]+(-[0-9]+)?)', 1) AS standard_no,
  array_to_string(list_transform(regexp_extract_all(t, '(GB|DL)(/T)?\s*[0-9]+(-[0-9]+)?'), lambda m: regexp_replace(m, '\s+', ' ')), ';') AS refs,
  regexp_extract(t, '第([0-9]+\.[0-9]+)条', 1) AS clause, regexp_extract(t, '([0-9]+)kV', 1) || 'kV' AS voltage, contains(t, '应符合') AS refers FROM t""")
def std_number_extract(c):
    """Standard numbers, clause, voltage and reference wording of every line."""
    return standard_text(c).select(
        "doc_id", "line_no", X.standard_number("t").alias("standard_no"), F.array_join(X.referenced_standards("t"), ";").alias("refs"),
        X.clause_number("t").alias("clause"), X.voltage("t").alias("voltage"), X.has_reference_words("t").alias("refers"),
    )


HEADINGS = ["# 第 5 章 总则", "3 Scope", "5.2.1 Supply area", "5.2 技术要求", "## 5.2.3 Rules", "第 2.1 节 x", "plain words", "12. Annex"]


@query("C12 C35 C36", with_(S.LINES) + f"""
, h AS (SELECT doc_id, line_no, line_no % 4 AS lv, {pick_sql('(doc_id + line_no)', HEADINGS)} || ' ' || line AS t FROM lines)
SELECT doc_id, line_no, coalesce(nullif(regexp_extract(t, '第?\\s*([0-9]+)\\s*章', 1), ''), nullif(regexp_extract(t, '^#*\\s*([0-9]+)\\.', 1), ''), nullif(regexp_extract(t, '^#*\\s*([0-9]+)\\s+', 1), ''), '-') AS chapter,
  coalesce(nullif(regexp_extract(t, '第?\\s*([0-9]+\\.[0-9]+)\\s*节', 1), ''), nullif(regexp_extract(t, '^##\\s*([0-9]+\\.[0-9]+)', 1), ''), '-') AS section,
  coalesce(nullif(regexp_extract(t, '^#{{0,4}}\\s*([0-9]+\\.[0-9]+(\\.[0-9]+)?)', 1), ''), '-') AS clause,
  regexp_matches(t, '^[0-9]+\\.[0-9]+') OR regexp_matches(t, '^第\\s*[0-9]+\\s*[章节]') AS heading,
  CAST(CASE WHEN contains(t, '章') THEN 1 WHEN contains(t, '节') THEN 2 WHEN regexp_matches(t, '^[0-9]+\\.[0-9]+\\.[0-9]+') THEN 4 WHEN regexp_matches(t, '^[0-9]+\\.[0-9]+') THEN 3 ELSE 2 END AS INTEGER) AS level,
  CASE WHEN len(string_split(regexp_extract(t, '^([0-9]+(\\.[0-9]+)*)', 1), '.')) = lv AND regexp_extract(t, '^([0-9]+(\\.[0-9]+)*)', 1) <> '' THEN replace(regexp_extract(t, '^([0-9]+(\\.[0-9]+)*)', 1), '.', '/') ELSE '-' END AS parts FROM h""")
def heading_numbers(c):
    """Chapter, section, clause, level and number parts of heading-like lines."""
    rows = c.lines().withColumn("_k", F.col("doc_id") + F.col("line_no"))
    t = rows.select("doc_id", "line_no", mod("line_no", 4).alias("lv"), F.concat(pick("_k", HEADINGS), F.lit(" "), F.col("line")).alias("t"))
    dash = lambda col: F.coalesce(col, F.lit("-"))
    return t.select(
        "doc_id", "line_no", dash(X.chapter_number("t")).alias("chapter"), dash(X.section_number("t")).alias("section"),
        dash(X.heading_clause_number("t")).alias("clause"), X.is_heading("t").alias("heading"), X.heading_level("t").alias("level"),
        dash(F.array_join(X.section_parts("t", F.col("lv")), "/")).alias("parts"),
    )


FILES = ["GB 1002-2024.pdf", "GBT+36278-2018 rules.pdf", "dl_T_621-1997.pdf", "Q/ABC-2020.pdf", "notes.pdf"]


@query("C13", f"""WITH n AS (SELECT doc_id, (doc_id % 90) || {pick_sql('doc_id', FILES)} AS name FROM documents),
p AS (SELECT doc_id, regexp_extract(name, '(?i)(GB|DL|NB|JB|HG)[\\s_/\\\\+]*(/T|T)?[\\s_]*([0-9]+(\\.[0-9]+)?)[_\\s\\-—]*([0-9]{{4}})', ['a', 'b', 'c', 'd', 'e']) AS m,
        regexp_extract(name, '(?i)(Q/[A-Za-z0-9]+)[_\\s\\-—]*([0-9]{{4}})', ['a', 'b']) AS q FROM n)
SELECT doc_id, CASE WHEN m.a <> '' THEN upper(m.a) || CASE WHEN m.b <> '' THEN '/' || m.b ELSE '' END || ' ' || m.c || '-' || m.e WHEN q.a <> '' THEN q.a || '-' || q.b ELSE '-' END AS standard_no,
  CASE WHEN m.a <> '' THEN m.e || '版' WHEN q.a <> '' THEN q.b || '版' ELSE '-' END AS version, CASE WHEN m.a <> '' THEN m.e || '-01-01' WHEN q.a <> '' THEN q.b || '-01-01' ELSE '-' END AS publish_date FROM p""")
def filename_metadata(c):
    """Standard number, version and date read off file names."""
    name = F.concat(mod("doc_id", 90).cast("string"), pick("doc_id", FILES))
    got = c.table("documents").select("doc_id", X.filename_metadata(name).alias("m"))
    return got.select("doc_id", *[F.coalesce(f"m.{f}", F.lit("-")).alias(f) for f in ("standard_no", "version", "publish_date")])


HEADS = ["中华人民共和国电力行业标准\n# Safety rules of plants\nGB/T 50065-2011\n2011-12-05 发布 2012-6-1 实施\n", "Title line one\n发布单位：能源局\n发布日期：2019年3月4日\n代替 DL 5-1999\n", "1. x\nQ/ABC 2021\n"]


@query("C13 C14", f"""WITH t AS (SELECT doc_id, {pick_sql('doc_id', HEADS).replace(chr(10), "' || chr(10) || '")} || text AS t FROM documents),
d AS (SELECT doc_id, CAST(doc_id % 3 AS INTEGER) AS k, left(t, 500) AS h5, left(t, 1000) AS h, left(t, 2000) AS h2 FROM t),
m AS (SELECT *, regexp_extract(h5, '(GB|DL|NB|JB|HG)[\\s/]*(/T|T)?\\s*([0-9]+(\\.[0-9]+)?)[\\s—\\-~～]+([0-9]{{4}})', ['a', 'b', 'c', 'd', 'y']) AS m,
  regexp_extract(h5, '(Q/[A-Za-z0-9]+)[\\s—\\-~～]+([0-9]{{4}})', ['a', 'y']) AS q,
  coalesce(nullif(regexp_extract(h, '发布日期[：:]\\s*([0-9]{{4}}[-年][0-9]{{1,2}}[-月][0-9]{{1,2}}日?)', 1), ''), nullif(regexp_extract(h, '([0-9]{{4}}[-年][0-9]{{1,2}}[-月][0-9]{{1,2}})\\s*发布', 1), '')) AS pub,
  coalesce(nullif(regexp_extract(h, '实施日期[：:]\\s*([0-9]{{4}}[-年][0-9]{{1,2}}[-月][0-9]{{1,2}}日?)', 1), ''), nullif(regexp_extract(h, '([0-9]{{4}}[-年][0-9]{{1,2}}[-月][0-9]{{1,2}})\\s*实施', 1), '')) AS imp FROM d)
SELECT doc_id, CASE WHEN m.a <> '' THEN m.a || CASE WHEN m.b LIKE '/%' THEN m.b WHEN m.b <> '' THEN '/' || m.b ELSE '' END || ' ' || m.c || '-' || m.y WHEN q.a <> '' THEN q.a || '-' || q.y ELSE '-' END AS standard_no,
  coalesce(translate(replace(replace(pub, '年', '-'), '月', '-'), '日', ''), CASE WHEN m.a <> '' THEN m.y || '-01-01' WHEN q.a <> '' THEN q.y || '-01-01' END, '-') AS publish_date,
  coalesce(translate(replace(replace(imp, '年', '-'), '月', '-'), '日', ''), '-') AS implement_date,
  coalesce(nullif(trim(regexp_extract(h2, '发布(单位|机构)[：:]\\s*([^\\n]+)', 2)), ''), nullif(trim(regexp_extract(h2, '中华人民共和国([^\\n，,。.]{{2,20}})', 1)), ''), '-') AS publish_org,
  coalesce(nullif(trim(regexp_extract(h2, '(替代|代替|本标准替代)(标准)?[：:]*\\s*((GB|DL|NB)[^\\n]+)', 3)), ''), '-') AS replaces FROM m""")
def content_metadata(c):
    """Number, dates, organisation and predecessor found in the head of the text."""
    text = F.concat(pick("doc_id", HEADS), F.col("text"))
    got = c.table("documents").select("doc_id", X.content_metadata(text).alias("m"))
    return got.select("doc_id", *[F.coalesce(f"m.{f}", F.lit("-")).alias(f) for f in ("standard_no", "publish_date", "implement_date", "publish_org", "replaces")])


@query("C14", """SELECT o_orderkey, coalesce(CAST(try_cast(year(o_orderdate) || '-' || lpad(CAST(o_orderkey % 14 AS VARCHAR), 2, '0') || '-' || lpad(CAST(o_orderkey % 33 AS VARCHAR), 2, '0') AS DATE) AS VARCHAR), '-') AS day FROM orders""")
def lenient_dates(c):
    """Loosely written days as dates, impossible ones as null."""
    text = F.concat(F.year("o_orderdate").cast("string"), F.lit("年"), mod("o_orderkey", 14).cast("string"), F.lit("月"), mod("o_orderkey", 33).cast("string"), F.lit("日"))
    return c.table("orders").select("o_orderkey", F.coalesce(X.lenient_date(text).cast("string"), F.lit("-")).alias("day"))


KINDS = ["操作手册 ", "教材 ", "必须 ", "技术要求 ISBN ", "步骤 ", ""]


@query("C15", f"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'GB 1' ELSE '' END AS std, {pick_sql('doc_id', KINDS)} || text AS t FROM documents)
SELECT doc_id, CASE WHEN std <> '' THEN 'standard' WHEN contains(t, 'ISBN') OR contains(left(t, 500), '教材') THEN 'textbook' WHEN contains(left(t, 500), '手册') OR contains(left(t, 500), '指南') THEN 'manual' ELSE 'standard' END AS doc_type,
  CASE WHEN contains(left(t, 1000), '应') OR contains(left(t, 1000), '必须') OR contains(left(t, 1000), '不得') OR contains(left(t, 1000), '禁止') THEN '规范'
   WHEN contains(left(t, 1000), '技术要求') THEN '技术' WHEN contains(left(t, 1000), '操作') OR contains(left(t, 1000), '步骤') THEN '操作' ELSE '理论' END AS knowledge_type FROM t""")
def document_types(c):
    """Document and knowledge type by the rules on the head of the text."""
    t = c.table("documents").select("doc_id", F.when(mod("doc_id", 5) == 0, "GB 1").otherwise("").alias("std"), F.concat(pick("doc_id", KINDS), F.col("text")).alias("t"))
    return t.select("doc_id", X.doc_type("t", "std").alias("doc_type"), X.knowledge_type("t").alias("knowledge_type"))


CATEGORIES = {"license": ["License", "rights reserved"], "french": [" le ", " les "], "german": ["nicht", " der "]}


@query("C16", """WITH m AS (SELECT doc_id, list_filter([CASE WHEN contains(text, 'License') OR contains(text, 'rights reserved') THEN 'license' END,
  CASE WHEN contains(text, ' le ') OR contains(text, ' les ') THEN 'french' END, CASE WHEN contains(text, 'nicht') OR contains(text, ' der ') THEN 'german' END], lambda x: x IS NOT NULL) AS h FROM documents)
SELECT doc_id, CASE WHEN len(h) = 1 THEN h[1] ELSE '-' END AS category FROM m""")
def query_category(c):
    """The only matching keyword group, none when several match."""
    return c.table("documents").select("doc_id", F.coalesce(Qn.query_category("text", CATEGORIES), F.lit("-")).alias("category"))


TERMS = [("the ", "THE "), ("tion", "cion"), ("cion", "sion"), ("und", "UND")]


@query("C18", "SELECT doc_id, replace(replace(replace(replace(text, 'the ', 'THE '), 'tion', 'cion'), 'cion', 'sion'), 'und', 'UND') AS text FROM documents")
def term_normalize(c):
    """Dictionary spellings replaced in order."""
    return c.table("documents").select("doc_id", Qn.normalize_terms("text", TERMS).alias("text"))


SYNONYMS = [("the", ["thee", "ye", "x"]), ("and", ["plus"]), ("of", ["from", "by"])]


@query("C19", with_(S.QUERIES) + """
, v AS (SELECT query_id, query_text, list_filter([CASE WHEN contains(query_text, 'the') THEN replace(query_text, 'the', 'thee') END, CASE WHEN contains(query_text, 'the') THEN replace(query_text, 'the', 'ye') END,
  CASE WHEN contains(query_text, 'and') THEN replace(query_text, 'and', 'plus') END, CASE WHEN contains(query_text, 'of') THEN replace(query_text, 'of', 'from') END, CASE WHEN contains(query_text, 'of') THEN replace(query_text, 'of', 'by') END], lambda x: x IS NOT NULL) AS r FROM queries),
a AS (SELECT query_id, ([query_text] || r)[1:3] AS a FROM v)
SELECT query_id, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS variant, unnest(a) AS rewrite FROM a""")
def synonym_rewrites(c):
    """Each question with its synonym variants, three in all."""
    return Qn.expand_queries(c.queries(), synonyms=SYNONYMS).select("query_id", "variant", "rewrite")


ROUTES = ["GB 50053 和 GB 50054 有什么不同", "GB 50053, DL/T 620 要求", "引用了哪些标准文件", "第 5.2 条的要求", "接地要求", "同时满足防火和防爆", "10kV配电室安全距离要求分别是什么"]
ROUTE_RULES = ["standard_pair", "several_standards", "multi_hop_words", "explicit_number", "default", "multi_hop_words", "default"]


@query("C20 C21", f"""WITH t AS (SELECT event_id, {pick_sql('event_id', ROUTES)} AS t, CAST(event_id % {len(ROUTES)} AS INTEGER) + 1 AS i FROM events)
SELECT event_id, CASE WHEN i IN (4, 5, 7) THEN 'fast' ELSE 'slow' END AS lane, ({ROUTE_RULES})[i] AS rule, length(t) >= 12 AND regexp_matches(t, '比较|对比|区别|差异|不同|平衡') AS comparison,
  length(t) >= 12 AND regexp_matches(t, '分别|各自|和|与|以及|及') AND regexp_matches(t, '哪些|什么|如何|要求|原则|配置|方式|规定') AS multi_aspect FROM t""")
def route_decision(c):
    """Lane and deciding rule of every logged question."""
    t = c.table("events").select("event_id", pick("event_id", ROUTES).alias("t"))
    return t.withColumn("_r", Qn.route("t")).select("event_id", "_r.lane", "_r.rule", Qn.is_comparison("t").alias("comparison"), Qn.is_multi_aspect("t").alias("multi_aspect"))


VAGUE = ["接地", "怎么规定", "GB 50057-2010第3.2.1条", "10kV配电室安全距离要求", "什么标准要求哪些", "35kV变压器安装规范"]


@query("C22 C23", f"""WITH t AS (SELECT event_id, {pick_sql('event_id', VAGUE)} AS t FROM events),
s AS (SELECT *, (CASE WHEN length(t) < 5 THEN 0.4::DOUBLE WHEN length(t) < 10 THEN 0.2 ELSE 0 END) + least(0.3::DOUBLE, 0.15 * len(list_filter(['要求','规定','标准','怎么','如何','什么','哪些','多少','是否','能不能'], lambda w: contains(t, w))))
  + CASE WHEN regexp_matches(t, '[0-9]+kV|GB\\s*[0-9]+|DL/T\\s*[0-9]+|[0-9]+(米|m|毫米|mm)') THEN -0.1 ELSE 0.2 END AS x FROM t),
r AS (SELECT event_id, t, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, x)), 6) AS score FROM s)
SELECT event_id, score, CASE WHEN score > 0.7 THEN 'clarify_required' WHEN score > 0.5 THEN 'clarify_optional' WHEN score > 0.3 THEN 'suggest' ELSE 'none' END AS strategy,
  regexp_matches(t, 'GB[/T]*[/\\s]*[0-9]+|N-[0-9]+准则|[0-9]+kV|[0-9]+\\.[0-9]+') AS specific FROM r""")
def vagueness_score(c):
    """How vague every logged question is and what to do about it."""
    t = c.table("events").select("event_id", pick("event_id", VAGUE).alias("t")).withColumn("score", Qn.vagueness("t"))
    return t.select("event_id", "score", Qn.vagueness_strategy("score").alias("strategy"), Qn.is_clearly_specific("t").alias("specific"))


FOLLOW = ["其他要求", "还有哪些", "该标准", "普通问题", "其电压"]


@query("C24", f"""WITH t AS (SELECT conv_id, turn, {pick_sql('turn', FOLLOW)} || text AS t FROM conversations)
SELECT conv_id, turn, regexp_matches(t, '它|该|此|这个|上述|上面|前面|之前提到|刚才说的|其中') OR contains(replace(t, '其他', ''), '其') OR regexp_matches(t, '^(还有|另外|此外|同时|以及|那么|那)(哪些|什么|怎么|如何|是否|有没有)') AS follow_up FROM t""")
def follow_up_signal(c):
    """Turns that lean on an earlier one."""
    return c.table("conversations").select("conv_id", "turn", Qn.needs_resolution(F.concat(pick("turn", FOLLOW), F.col("text"))).alias("follow_up"))


@query("C25 U6", """WITH q AS (SELECT event_id, event_id % 3 AS k FROM events)
SELECT event_id, CASE k WHEN 0 THEN '具体限值 电压等级分类 GB/T ' || (14000 + event_id % 50) || '-1993' WHEN 1 THEN 'q' || event_id || ' 未找到电压等级分类' ELSE 'q' || event_id END AS refined FROM q""")
def gap_refinement(c):
    """Second-round question from the gaps of the first answer."""
    k = mod("event_id", 3)
    number = F.concat(F.lit("缺少 GB/T "), (14000 + mod("event_id", 50)).cast("string"), F.lit("-1993 的具体限值"))
    gaps = F.when(k == 0, F.array(number, F.lit("未找到电压等级分类"))).when(k == 1, F.array(F.lit("未找到电压等级分类"))).otherwise(F.array().cast("array<string>"))
    return c.table("events").select("event_id", Qn.refine_for_gaps(F.concat(F.lit("q"), F.col("event_id").cast("string")), gaps).alias("refined"))


@query("F5", """SELECT event_id, CASE event_id % 2 WHEN 0 THEN '适用范围|短路电流' ELSE 'rated current|' || event_type END AS words FROM events""".replace("'rated current|' || event_type", "'rated|current|' || event_type"))
def content_keywords(c):
    """Search words left of a question once numbers and filler are gone."""
    t = F.when(mod("event_id", 2) == 0, "GB 50053-2013的适用范围是什么短路电流").otherwise(F.concat(F.lit("请rated current 的"), F.col("event_type")))
    return c.table("events").select("event_id", F.array_join(Qn.content_keywords(t), "|").alias("words"))


@query("C27", """SELECT event_id, CASE WHEN event_id % 5 = 4 THEN -1 ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events""")
def lenient_json(c):
    """JSON found plain, fenced or inside prose."""
    p = F.col("props")
    k = mod("event_id", 5)
    raw = (
        F.when(k == 0, p).when(k == 1, F.concat(F.lit("Here:\n```json\n"), p, F.lit("\n```\nok"))).when(k == 2, F.concat(F.lit("so "), p, F.lit(" there")))
        .when(k == 3, F.concat(F.lit("  "), p)).otherwise("no json {broken")
    )
    return c.table("events").select("event_id", F.coalesce(X.lenient_json(raw, "k long")["k"], F.lit(-1)).alias("k"))


@query("C27", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN event_type || '|b c' WHEN 1 THEN event_type WHEN 2 THEN 'x|' || event_type ELSE '' END AS items FROM events""")
def lenient_json_list(c):
    """Lists of strings found plain or inside prose; anything else gives none."""
    kind, k = F.col("event_type"), mod("event_id", 6)
    wrap = lambda a, b: F.concat(F.lit(a), kind, F.lit(b))
    raw = (
        F.when(k == 0, wrap('["', '", "b c"]')).when(k == 1, wrap('Sure:\n```json\n["', '"]\n``` [1]')).when(k == 2, wrap(' ["x",\n"', '"] '))
        .when(k == 3, wrap('{"a": "', '"}')).when(k == 4, wrap('[1, "', '"]')).otherwise(wrap('["', '"'))
    )
    return c.table("events").select("event_id", F.array_join(X.lenient_json_list(raw), "|").alias("items"))


@query("C28", """WITH s AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[。！？.!?]'), lambda x: trim(x, ' ')), lambda x: length(x) >= 10 AND NOT suffix(x, '吗') AND NOT prefix(x, '如果') AND NOT prefix(x, '假设'))[1:5] AS f FROM documents)
SELECT doc_id, len(f) AS n, array_to_string(f, '|') AS facts FROM s""".replace("len(f) AS n", "CAST(len(f) AS INTEGER) AS n"))
def factual_sentences(c):
    """First five statements of each document that can be checked."""
    f = X.factual_sentences("text")
    return c.table("documents").select("doc_id", F.size(f).alias("n"), F.array_join(f, "|").alias("facts"))


LANG = ", ".join(
    f"({i}, '{tag}', {words})" for i, (tag, words) in enumerate(X.LANGUAGE_WORDS.items())
)


@query("C39 C40", with_(S.DOC_WORDS) + f""", p AS (SELECT * FROM (VALUES {LANG}) t(o, tag, ws)),
s AS (SELECT doc_id, tag, o, len(list_filter(words, lambda w: list_contains(ws, w))) AS n FROM doc_words, p),
b AS (SELECT doc_id, tag, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, o) AS r FROM s)
SELECT doc_id, CASE WHEN n > 0 THEN tag ELSE '' END AS language FROM b WHERE r = 1""")
def language_tag(c):
    """Language of every document by frequent words."""
    return c.table("documents").select("doc_id", X.language("text").alias("language"))


@query("C41", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 2 = 0 THEN strftime(TIMESTAMP '1899-12-30' + to_days(CAST(20000 + l_partkey AS INTEGER)), '%Y-%m-%d')
  ELSE strftime(TIMESTAMP '1899-12-30' + to_days(CAST(20000 + l_partkey AS INTEGER)) + to_hours(6), '%Y-%m-%d %H:%M:%S') END AS day, strftime(TIMESTAMP '1904-01-01' + to_days(CAST(l_partkey AS INTEGER)), '%Y-%m-%d') AS day_1904 FROM lineitem""")
def serial_dates(c):
    """Spreadsheet serial numbers as ISO dates in both epochs."""
    serial = F.lit(20000) + F.col("l_partkey") + F.when(mod("l_linenumber", 2) == 0, 0.0).otherwise(0.25)
    return c.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", X.excel_serial_to_iso(serial).alias("day"), X.excel_serial_to_iso("l_partkey", date_1904=True).alias("day_1904"))


@query("C42", """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '-' ELSE p_name || '\\tag{' || (p_size % 9) || '.' || p_partkey || '}' END AS formula FROM part""")
def formula_tags(c):
    """Formula number written into the formula."""
    number = F.concat(F.lit(" （"), mod("p_size", 9).cast("string"), F.lit("．"), F.col("p_partkey").cast("string"), F.lit("） "))
    body = F.when(mod("p_partkey", 4) == 0, "\\[ \\]").otherwise(F.concat(F.lit("\\["), F.col("p_name"), F.lit(" \\]")))
    return c.table("part").select("p_partkey", F.coalesce(X.tagged_formula(body, number), F.lit("-")).alias("formula"))


@query("C43", r"""WITH p AS (SELECT page_id, regexp_replace(html, '<a href="([^">]*)">', chr(1) || '\1' || chr(2), 'g') AS h FROM pages),
s AS (SELECT page_id, regexp_replace(h, '<(\w+)(\s[^>]*)?>', '<\1>', 'g') AS h FROM p)
SELECT page_id, regexp_replace(h, chr(1) || '([^' || chr(2) || ']*)' || chr(2), '<a href="\1">', 'g') AS html FROM s""")
def clean_markup(c):
    """Page markup without presentational attributes."""
    return c.table("pages").select("page_id", X.clean_table_markup("html").alias("html"))


TOC = ["Scope\t12", "Terms\txiv", "Annex\tB", "Body\ttwo words", "A\tb\t9", "plain"]


@query("C44", f"""SELECT doc_id, lang || ' ' || ({['Scope', 'Terms', 'Annex', 'Body two words', 'A b', 'plain']})[CAST(doc_id % 6 AS INTEGER) + 1] AS entry FROM documents""")
def index_tails(c):
    """Contents entries without their page token."""
    return c.table("documents").select("doc_id", X.strip_index_tail(F.concat_ws(" ", "lang", pick("doc_id", TOC))).alias("entry"))


CAPTIONS = ["表1 参数（续）", "Table 2 (continued)", "discontinued", "Table continued", "表3 续表", "Table 4", "x (cont.)"]


@query("F14", with_(S.LINES) + f"""
SELECT doc_id, line_no, CAST((doc_id + line_no) % 7 AS INTEGER) NOT IN (2, 5) AS continued FROM lines""")
def continuation_captions(c):
    """Captions that say a table goes on."""
    rows = c.lines().withColumn("_k", F.col("doc_id") + F.col("line_no"))
    return rows.select("doc_id", "line_no", X.is_continuation_caption(F.concat(F.col("line"), F.lit(" "), pick("_k", CAPTIONS))).alias("continued"))


@query("S12", """WITH u AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?', 's3a'), '[?#].*$', '') AS u FROM pages)
SELECT page_id, regexp_extract(u, '^s3a://([^/]+)/(.*)$', 1) AS bucket, regexp_extract(u, '^s3a://([^/]+)/(.*)$', 2) AS key, '0-' || (page_id * 10) AS bytes FROM u""")
def object_paths(c):
    """Bucket, key and byte range of object addresses."""
    address = F.concat(F.regexp_replace(F.regexp_replace("url", "^https?", "s3a"), "[?#].*$", ""), F.lit("?bytes=0,"), (F.col("page_id") * 10).cast("string"))
    p = c.table("pages").select("page_id", X.object_path(address).alias("p"))
    return p.select("page_id", "p.bucket", "p.key", F.array_join("p.byte_range", "-").alias("bytes"))


@query("C31 C32 P1", """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), m AS (SELECT vec_id, v, list_max(list_transform(v, lambda x: abs(x))) AS s FROM e)
SELECT vec_id, round(list_dot_product(v, v), 6) AS squared, round(sqrt(list_dot_product(v, v)), 6) AS length, round(s, 6) AS scale,
  CAST(list_sum(list_transform(v, lambda x: CAST(round(x / s * 127) AS BIGINT))) AS BIGINT) AS code_sum, round(v[1] / (sqrt(list_dot_product(v, v)) + 1e-8), 6) AS first_unit FROM m""")
def vector_functions(c):
    """Dot product, norm, normalised and int8 form of every vector."""
    q = V.quantize_int8("embedding")
    return c.table("embeddings").select(
        "vec_id", F.round(V.dot("embedding", "embedding"), 6).alias("squared"), F.round(V.norm("embedding"), 6).alias("length"), F.round(q["scale"], 6).alias("scale"),
        F.aggregate(q["codes"], F.lit(0).cast("long"), lambda a, x: a + x.cast("long")).alias("code_sum"), F.round(V.normalize("embedding")[0], 6).alias("first_unit"),
    )


# ---------------------------------------------------------------- citations and prompts
ANSWERS = """answers AS (SELECT conv_id * 1000 + turn AS answer_id, conv_id, text || ' [' || (turn % 4 + 1) || '] and [' || (conv_id % 3 + 1) || '] [' || (turn % 4 + 1) || ']' AS answer FROM conversations WHERE role = 'assistant'),
ctx AS (SELECT a.answer_id, c.turn // 2 + 1 AS place, c.conv_id * 1000 + c.turn AS chunk_id FROM answers a JOIN conversations c ON c.conv_id = a.conv_id AND c.role = 'user'),
marks AS (SELECT answer_id, CAST(generate_subscripts(m, 1) AS BIGINT) AS i, CAST(unnest(m) AS BIGINT) AS idx FROM (SELECT answer_id, regexp_extract_all(answer, '\\[([0-9]+)\\]', 1) AS m FROM answers))"""


def answers_and_context(c):
    t = c.table("conversations")
    mark = lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))
    a = t.where(F.col("role") == "assistant").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), "conv_id",
        F.concat_ws(" ", "text", mark(mod("turn", 4) + 1), F.lit("and"), mark(mod("conv_id", 3) + 1), mark(mod("turn", 4) + 1)).alias("answer"),
    )
    users = t.where(F.col("role") == "user").select("conv_id", (F.floor(F.col("turn") / 2) + 1).cast("int").alias("place"), (F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"))
    return a, a.select("answer_id", "conv_id").join(users, "conv_id").drop("conv_id")


@query("C29 J10", with_(ANSWERS) + """, f AS (SELECT answer_id, idx, min(i) AS i FROM marks GROUP BY 1, 2),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY answer_id ORDER BY i) - 1 AS INTEGER) AS order_no FROM f)
SELECT answer_id, CAST(idx AS INTEGER) AS "index", order_no, chunk_id, '[' || idx || '] GB 1 第2条' AS label FROM o JOIN ctx ON ctx.answer_id = o.answer_id AND place = idx""".replace("SELECT answer_id, CAST(idx", "SELECT o.answer_id, CAST(idx"))
def citation_join(c):
    """Context chunk behind every citation marker."""
    from docloom.operators.ranking import citations

    a, ctx = answers_and_context(c)
    return citations(a, ctx).withColumn("label", X.format_citation("index", F.lit("GB 1"), F.lit("2"), F.lit("")))


@query("A24", with_(ANSWERS) + """, n AS (SELECT a.answer_id, a.answer, count(ctx.place) AS total FROM answers a LEFT JOIN ctx USING (answer_id) GROUP BY 1, 2),
k AS (SELECT n.answer_id, count(DISTINCT idx) FILTER (idx BETWEEN 1 AND total) AS cited, count(*) FILTER (NOT idx BETWEEN 1 AND total) AS bad FROM n JOIN marks USING (answer_id) GROUP BY 1)
SELECT answer_id, CAST(cited AS INTEGER) AS cited_count, total AS total_chunks, round(CASE WHEN total > 0 THEN cited / total ELSE 0 END, 6) AS coverage_rate, total - cited AS uncited_count, CAST(bad AS INTEGER) AS invalid_count,
  length(trim(answer, ' ')) > 50 AND cited = 0 AS content_without_citation, total = cited AND bad = 0 AND NOT (length(trim(answer, ' ')) > 50 AND cited = 0) AS valid FROM n JOIN k USING (answer_id)""")
def citation_coverage(c):
    """Citation coverage of every answer."""
    from docloom.operators.ranking import citation_report

    return citation_report(*answers_and_context(c))


@query("C30", """SELECT conv_id AS query_id, string_agg('[' || (turn + 1) || '] ' || role || CASE WHEN turn % 2 = 0 THEN ' 第' || turn || '条' ELSE ' 第c章' END || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS context FROM conversations GROUP BY 1""")
def context_prompts(c):
    """Numbered source blocks of every conversation."""
    from docloom.operators.ranking import context_prompt

    t = c.table("conversations").select(
        F.col("conv_id").alias("query_id"), (F.col("turn") + 1).alias("rank"), F.col("role").alias("standard_no"),
        F.when(mod("turn", 2) == 0, F.col("turn").cast("string")).alias("clause"), F.lit("c").alias("chapter"), F.col("text").alias("content"),
    )
    return context_prompt(t)
