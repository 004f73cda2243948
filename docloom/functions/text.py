"""Text functions, Column in and Column out; all run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import presets as P

CJK = r"[一-鿿]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _chain(column: Column, pairs) -> Column:
    return reduce(lambda acc, p: F.replace(acc, F.lit(p[0]), F.lit(p[1])), pairs, column)


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once.

    A projection below a lambda is folded into it and would run per element; a lambda
    variable is not.
    """
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def first_group(text, pattern: str, group: int = 1) -> Column:
    """Capture group of the first match, null when nothing matches."""
    return F.nullif(F.regexp_extract(_col(text), pattern, group), F.lit(""))


def first_match(text, patterns, group: int = 1) -> Column:
    """First pattern of the ladder that matches."""
    return F.coalesce(*[first_group(text, p, group) for p in patterns])


def matches_any(text, patterns) -> Column:
    return reduce(lambda a, b: a | b, [_col(text).rlike(p) for p in patterns])


def contains_any(text, words) -> Column:
    return reduce(lambda a, b: a | b, [_col(text).contains(w) for w in words])


def squeeze(text) -> Column:
    """Trimmed text with every whitespace run as one blank."""
    return F.trim(F.regexp_replace(_col(text), r"\s+", " "))


# ---------------------------------------------------------------- hashes and keys
def content_hash(text) -> Column:
    return F.sha2(_col(text), 256)


def memo_key(prefix: str, *parts: Column) -> Column:
    """``prefix:md5`` over the parts joined by ``|``."""
    return F.concat(F.lit(prefix + ":"), F.md5(F.concat_ws("|", *parts)))


def canonical_json(mapping) -> Column:
    """JSON of a map with its keys in order, so equal maps give equal text."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(_col(mapping)))))


# ---------------------------------------------------------------- sizes
def token_estimate(text, mode: str = "chars") -> Column:
    """Approximate token count.

    ``chars``: length/1.5. ``mixed``: 1.5 per CJK character, 4 others per token.
    ``ingest``: one per CJK character plus others div 4. ``half``: length div 2.
    """
    text = _col(text)
    n = F.length(text)
    cjk = F.regexp_count(text, F.lit(CJK))
    if mode == "chars":
        return F.floor(n / 1.5).cast("long")
    if mode == "mixed":
        return F.floor(cjk * 1.5 + (n - cjk) / 4).cast("long")
    if mode == "ingest":
        return (cjk + F.floor((n - cjk) / 4)).cast("long")
    if mode == "half":
        return F.floor(n / 2).cast("long")
    raise ValueError(f"unknown token mode {mode}")


# ---------------------------------------------------------------- characters
def half_width(text, letters_only: bool = False) -> Column:
    """Full-width ASCII forms to half width: all marks, or letters and digits only."""
    if letters_only:
        codes = [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)]
    else:
        codes = list(range(0xFF01, 0xFF5F))
    wide = "".join(map(chr, codes))
    narrow = "".join(chr(c - 0xFEE0) for c in codes)
    return F.translate(_col(text), wide, narrow)


def ends_with_hyphen(line) -> Column:
    return _col(line).rlike(P.LINE_END_HYPHEN_PATTERN)


def join_lines(line, next_line) -> Column:
    """Text a line contributes before the next one: CJK joins tight, a broken word loses its hyphen."""
    line, nxt = _col(line), _col(next_line)
    body = F.rtrim(line)
    broken = ends_with_hyphen(line)
    goes_on = F.coalesce(nxt.rlike(r"^\s*\p{Ll}"), F.lit(False))
    return (
        F.when(line.rlike(CJK), body)
        .when(broken & goes_on, F.regexp_replace(body, ".$", ""))
        .when(broken, body)
        .otherwise(F.concat(body, F.lit(" ")))
    )


def replace_ligatures(text) -> Column:
    return _chain(_chain(_col(text), P.CONTROL_REPLACEMENTS), P.LIGATURES)


def valid_text(text) -> Column:
    """Text without invalid UTF-8; lone surrogates cannot occur in a Spark string."""
    return F.make_valid_utf8(_col(text))


def escape_markdown(text) -> Column:
    """Backslash before ``* _ ` ~ $`` unless an odd run of backslashes already escapes it."""
    return F.regexp_replace(_col(text), r"(?<!\\)((?:\\\\)*)([*_`~$])", r"$1\\$2")


def escape_block_prefix(text) -> Column:
    """Backslash before a leading heading or list marker."""
    return F.regexp_replace(_col(text), r"^([ \t]{0,3})(#{1,6}|[+-])(?=[ \t])", r"$1\\$2")


def strip_display_formula(text) -> Column:
    """Formula without its outer display brackets."""
    t = F.regexp_replace(_col(text), r"^\\\[", "")
    return F.trim(F.regexp_replace(t, r"\\\]$", ""))


def strip_code_fence(text) -> Column:
    """Code without its opening and closing fence lines."""
    t = F.regexp_replace(_col(text), r"^```[^\n]*(\n|$)", "")
    return F.trim(F.regexp_replace(t, r"(^|\n)[ \t]*```[ \t]*$", ""))


def plain_brackets(text) -> Column:
    """Balanced display brackets written as plain square brackets."""
    t = _col(text)
    opened, closed = F.regexp_count(t, F.lit(r"\\\[")), F.regexp_count(t, F.lit(r"\\\]"))
    return F.when((opened == closed) & (opened > 0), F.regexp_replace(t, r"\\\[(.*?)\\\]", r"[$1]")).otherwise(t)


# ---------------------------------------------------------------- identifiers
def standard_number(text) -> Column:
    """Standard number named in a question, blanks squeezed."""
    return F.trim(F.regexp_replace(first_match(text, P.QUERY_STANDARD_PATTERNS), r"\s+", " "))


def standard_filter_number(text) -> Column:
    return F.trim(F.regexp_replace(first_match(text, P.FILTER_STANDARD_PATTERNS, 0), r"\s+", " "))


def referenced_standards(text) -> Column:
    """All standard numbers of a text in one spelling, distinct, in order of appearance."""
    found = F.regexp_extract_all(_col(text), F.lit(P.REFERENCE_STANDARD_PATTERN), F.lit(0))

    def spell(m: Column) -> Column:
        part = lambda g: F.regexp_extract(m, P.REFERENCE_STANDARD_PATTERN, g)
        head = F.concat(part(1), F.when(part(2) != "", "/T ").otherwise(" "), part(3))
        return F.when(part(4) != "", F.concat(head, F.lit("-"), part(4))).otherwise(head)

    return F.array_distinct(F.transform(found, spell))


def has_reference_words(text) -> Column:
    return contains_any(text, P.REFERENCE_INDICATORS)


def clause_number(text) -> Column:
    return first_group(text, P.CLAUSE_NUMBER_PATTERN)


def heading_clause_number(line) -> Column:
    return first_group(line, r"^#{0,4}\s*([0-9]+\.[0-9]+(?:\.[0-9]+)?)")


def heading_clause_title(line) -> Column:
    t = F.regexp_replace(_col(line), r"^#{1,6}\s*", "")
    return F.nullif(F.trim(F.regexp_replace(t, r"^[0-9]+\.[0-9]+(?:\.[0-9]+)?\s*", "")), F.lit(""))


def chapter_number(title) -> Column:
    return first_match(title, [r"第?\s*([0-9]+)\s*章", r"^#*\s*([0-9]+)\.", r"^#*\s*([0-9]+)\s+"])


def section_number(title) -> Column:
    return first_match(title, [r"第?\s*([0-9]+\.[0-9]+)\s*节", r"^##\s*([0-9]+\.[0-9]+)"])


def voltage(text) -> Column:
    number = first_group(text, r"(?i)([0-9]+(?:\.[0-9]+)?)kV")
    return F.concat(number, F.lit("kV"))


def is_compatibility_question(text) -> Column:
    return matches_any(text, P.COMPATIBILITY_PATTERNS)


# ---------------------------------------------------------------- document metadata
def filename_metadata(name) -> Column:
    """Struct of standard_no, version and publish_date read from a file name."""
    name = _col(name)
    part = lambda g: F.regexp_extract(name, P.FILENAME_STANDARD_PATTERN, g)
    own = lambda g: F.regexp_extract(name, P.FILENAME_COMPANY_PATTERN, g)
    public, company = part(1) != "", own(1) != ""
    # The subtype keeps its own slash, as the published format does ("GB//T 1-2000").
    number = F.concat(
        F.upper(part(1)),
        F.when(part(2) != "", F.concat(F.lit("/"), part(2))).otherwise(""),
        F.lit(" "), part(3), F.lit("-"), part(4),
    )
    year = F.when(public, part(4)).when(company, own(2))
    return F.struct(
        F.when(public, number).when(company, F.concat_ws("-", own(1), own(2))).alias("standard_no"),
        F.concat(year, F.lit("版")).alias("version"),
        F.concat(year, F.lit("-01-01")).alias("publish_date"),
    )


def plain_date(text) -> Column:
    """Chinese or dashed date text with dashes only."""
    return F.translate(F.replace(F.replace(_col(text), F.lit("年"), F.lit("-")), F.lit("月"), F.lit("-")), "日", "")


def lenient_date(text) -> Column:
    """Date of a loosely written day, null when it is none."""
    return F.try_to_date(plain_date(text), "y-M-d")


def content_metadata(content) -> Column:
    """Struct of the fields found in the head of a document's text."""
    content = _col(content)
    head = lambda n: F.substring(content, 1, n)
    part = lambda g: F.regexp_extract(head(500), P.CONTENT_STANDARD_PATTERN, g)
    own = lambda g: F.regexp_extract(head(500), P.CONTENT_COMPANY_PATTERN, g)
    subtype = (
        F.when(part(2).startswith("/"), part(2)).when(part(2) != "", F.concat(F.lit("/"), part(2))).otherwise("")
    )
    number = F.concat(F.upper(part(1)), subtype, F.lit(" "), part(3), F.lit("-"), part(4))
    public, company = part(1) != "", own(1) != ""
    year = F.when(public, part(4)).when(company, own(2))
    stripped = F.transform(F.slice(F.split(content, "\n"), 1, 15), lambda x: F.trim(x))
    titles = F.filter(
        F.transform(
            F.filter(stripped, lambda x: (F.length(x) > 5) & (F.length(x) < 100)),
            lambda x: F.regexp_replace(x, r"^#+\s*", ""),
        ),
        lambda t: (t != "") & ~t.rlike(r"^[0-9]+\.?\s") & ~t.isin(P.COVER_TITLES) & ~t.rlike("^(GB|DL|NB|JB|HG|Q)/"),
    )
    # A later pattern for the same key overrides an earlier one.
    day = lambda key: plain_date(first_match(head(1000), P.DATE_PATTERNS[key][::-1]))
    return F.struct(
        F.when(public, number).when(company, F.concat_ws("-", own(1), own(2))).alias("standard_no"),
        F.concat(year, F.lit("版")).alias("version"),
        F.coalesce(day("publish_date"), F.concat(year, F.lit("-01-01"))).alias("publish_date"),
        day("implement_date").alias("implement_date"),
        F.get(titles, F.lit(0)).alias("title"),
        F.trim(first_match(head(2000), P.PUBLISHER_PATTERNS)).alias("publish_org"),
        F.trim(first_group(head(2000), P.REPLACES_PATTERN)).alias("replaces"),
    )


def document_metadata(content, name) -> Column:
    """File name wins over content, content over the defaults."""
    by_name, by_text = filename_metadata(name), content_metadata(content)
    both = lambda f: F.coalesce(by_name[f], by_text[f]).alias(f)
    return F.struct(
        both("standard_no"), both("version"), both("publish_date"),
        by_text["implement_date"].alias("implement_date"), by_text["title"].alias("title"),
        F.coalesce(by_text["publish_org"], F.lit("未知")).alias("publish_org"),
        by_text["replaces"].alias("replaces"), F.lit("valid").alias("status"), F.lit("standard").alias("doc_type"),
    )


def doc_type(content, standard_no) -> Column:
    content = _col(content)
    head = F.substring(content, 1, 500)
    return (
        F.when(F.coalesce(_col(standard_no), F.lit("")) != "", "standard")
        .when(content.contains("ISBN") | head.contains("教材"), "textbook")
        .when(contains_any(head, ["手册", "指南"]), "manual")
        .otherwise("standard")
    )


def knowledge_type(content) -> Column:
    head = F.substring(_col(content), 1, 1000)
    return (
        F.when(contains_any(head, P.NORMATIVE_WORDS), "规范")
        .when(contains_any(head, P.TECHNICAL_WORDS), "技术")
        .when(contains_any(head, P.OPERATION_WORDS), "操作")
        .otherwise("理论")
    )


# ---------------------------------------------------------------- headings
def is_heading(text) -> Column:
    return matches_any(text, [r"^[0-9]+\.[0-9]+", r"^第\s*[0-9]+\s*章", r"^第\s*[0-9]+\s*节"])


def heading_level(text) -> Column:
    """1 chapter, 2 section or other, 3 for x.y, 4 for x.y.z numbers."""
    text = _col(text)
    return (
        F.when(text.contains("章"), 1)
        .when(text.contains("节"), 2)
        .when(text.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+"), 4)
        .when(text.rlike(r"^[0-9]+\.[0-9]+"), 3)
        .otherwise(2)
    )


def section_parts(content, level) -> Column:
    """Leading section number as integers when it has exactly ``level`` parts."""
    parts = F.split(F.regexp_extract(F.trim(_col(content)), r"^([0-9]+(?:\.[0-9]+)*)", 1), r"\.")
    ok = (F.size(parts) == _col(level)) & (F.get(parts, F.lit(0)) != "")
    return F.when(ok, F.transform(parts, lambda p: p.cast("int")))


def is_index_page_token(token) -> Column:
    t = F.trim(_col(token))
    return (
        (t != "") & (F.length(t) <= 12) & ~t.rlike(CJK)
        & (t.rlike(r"^[0-9]+$") | F.lower(t).rlike("^[ivxlcdm]+$") | t.rlike("^[a-zA-Z]$"))
    )


def strip_index_tail(text) -> Column:
    """Table-of-contents entry without its tab and page token; other tabs become blanks."""
    text = _col(text)
    tail = F.regexp_extract(text, r"\t([^\t]*)$", 1)
    cut = F.when(text.contains("\t") & is_index_page_token(tail), F.regexp_replace(text, r"\t[^\t]*$", "")).otherwise(text)
    return F.replace(cut, F.lit("\t"), F.lit(" "))


def is_continuation_caption(text) -> Column:
    """Whether a caption says that a table continues."""
    t = F.lower(half_width(F.trim(_col(text))))
    # A bare word counts only where no letter stands before it: "discontinued" does not.
    ends = [F.endswith(t, F.lit(m)) & (~t.rlike(rf"\p{{L}}{m}$") if m.isascii() and m.isalpha() else F.lit(True)) for m in P.CONTINUATION_END_MARKERS]
    inside = [t.contains(m) for m in P.CONTINUATION_INLINE_MARKERS]
    return reduce(lambda a, b: a | b, [*ends, *inside])


# ---------------------------------------------------------------- sentences, JSON, citations
def factual_sentences(answer, limit: int = 5) -> Column:
    parts = F.transform(F.split(_col(answer), r"[。！？.!?]"), lambda s: F.trim(s))
    keep = F.filter(
        parts,
        lambda s: (F.length(s) >= 10) & ~F.endswith(s, F.lit("吗")) & ~F.startswith(s, F.lit("如果")) & ~F.startswith(s, F.lit("假设")),
    )
    return F.slice(keep, 1, limit)


def lenient_json(text, schema: str) -> Column:
    """Struct parsed from plain JSON, else from a fenced block, else from the first object."""
    t = F.trim(_col(text))
    fenced = F.regexp_extract(t, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    first = F.regexp_extract(t, r"(?s)\{.*?\}", 0)
    options = {"mode": "FAILFAST"}
    chosen = F.coalesce(
        F.when(F.try_parse_json(t).isNotNull(), t),
        F.when((fenced != "") & F.try_parse_json(fenced).isNotNull(), fenced),
        F.when((first != "") & F.try_parse_json(first).isNotNull(), first),
    )
    return F.from_json(chosen, schema, {**options, "mode": "PERMISSIVE"})


def lenient_json_list(text) -> Column:
    """Array of strings: the whole text as JSON, else its first bracketed part; empty where neither is a list of strings."""
    t = F.trim(_col(text))
    first = F.regexp_extract(t, r"(?s)\[.*?\]", 0)
    listed = lambda x: F.schema_of_variant(F.try_parse_json(x)).isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.coalesce(F.get_json_object(x, "$[*]"), F.lit("")).contains("null")
    chosen = F.when(F.coalesce(listed(t), F.lit(False)), t).when(F.coalesce(listed(first), F.lit(False)), first)
    return F.coalesce(F.from_json(chosen, "array<string>"), F.array().cast("array<string>"))


def citation_indices(answer) -> Column:
    """Citation numbers in order of first appearance."""
    found = F.regexp_extract_all(_col(answer), F.lit(P.CITATION_PATTERN), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: x.cast("int")))


def format_citation(index, standard_no, clause, title) -> Column:
    where = F.when(_col(clause) != "", F.concat(F.lit("第"), _col(clause), F.lit("条"))).otherwise(
        F.nullif(F.substring(_col(title), 1, 30), F.lit(""))
    )
    return F.concat_ws(" ", F.concat(F.lit("["), _col(index).cast("string"), F.lit("]")), F.nullif(_col(standard_no), F.lit("")), where)


# ---------------------------------------------------------------- words
WORD_BREAK = r"[^\p{L}\p{N}]+"


def tokens(text) -> Column:
    """Lower-cased words; a CJK run becomes its overlapping character pairs."""
    text = _col(text)
    words = F.split(F.trim(F.regexp_replace(F.lower(text), WORD_BREAK, " ")), " ")

    def pairs(word: Column) -> Column:
        n = F.length(word)
        return F.when(
            word.rlike("^[一-鿿]{2,}$"),
            F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(word, i, F.lit(2))),
        ).otherwise(F.array(word))

    spread = F.regexp_replace(F.regexp_replace(F.lower(text), WORD_BREAK, " "), f"({CJK}+)", " $1 ")
    cjk_words = F.split(F.trim(F.regexp_replace(spread, " +", " ")), " ")
    return F.when(text.rlike(CJK), F.flatten(F.transform(cjk_words, pairs))).otherwise(words)


# --- fixed values: frequent short words per language, one profile each --------------------
LANGUAGE_WORDS = {
    "en": ["the", "of", "and", "is", "to", "in", "that", "for", "it", "was", "with", "as", "on", "by", "an", "are"],
    "fr": ["le", "la", "les", "de", "des", "et", "en", "un", "une", "que", "dans", "pour", "par", "du", "au", "est"],
    "de": ["der", "die", "das", "und", "ist", "nicht", "ein", "eine", "mit", "auf", "für", "den", "von", "zu", "im", "sich"],
    "es": ["el", "los", "las", "de", "y", "que", "en", "un", "una", "por", "con", "para", "del", "se", "no", "es"],
}


def language(text) -> Column:
    """Language tag by charset and frequent words; ties go to the earlier profile."""
    text = _col(text)
    n = F.greatest(F.length(F.regexp_replace(text, r"\s", "")), F.lit(1))
    share = lambda p: F.regexp_count(text, F.lit(p)) / n

    def known(words: Column, profile: list[str]) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(profile)))

    def rate(words: Column) -> Column:
        return F.array_max(
            F.array(
                *[
                    F.struct(known(words, profile).alias("s"), F.lit(-i).alias("o"), F.lit(tag).alias("tag"))
                    for i, (tag, profile) in enumerate(LANGUAGE_WORDS.items())
                ]
            )
        )

    best = bind(tokens(text), rate)
    return (
        F.when(share(r"[぀-ヿ]") > 0.05, "ja")
        .when(share(r"[가-힯]") > 0.2, "ko")
        .when(share(CJK) > 0.2, "zh")
        .when(best["s"] > 0, best["tag"])
        .otherwise("")
    )


# ---------------------------------------------------------------- office values
def excel_serial_to_iso(serial, date_1904: bool = False) -> Column:
    """ISO text of a spreadsheet serial number; the time is kept when there is one."""
    s = _col(serial).cast("double")
    # The 1900 system counts a 29 February 1900 that never was, hence the shift below day 60.
    base = F.lit("1904-01-01") if date_1904 else F.lit("1899-12-30")
    days = F.floor(s) if date_1904 else F.floor(s) + F.when((s >= 1) & (s < 60), 1).otherwise(0)
    seconds = F.round((s - F.floor(s)) * 86400).cast("long")
    stamp = F.timestamp_seconds(F.unix_timestamp(F.to_timestamp(base)) + days * 86400 + seconds)
    pattern = F.when(seconds % 86400 == 0, F.date_format(stamp, "yyyy-MM-dd")).otherwise(F.date_format(stamp, "yyyy-MM-dd HH:mm:ss"))
    time_only = F.date_format(stamp, "HH:mm:ss")
    return F.when(~F.isnan(s) & (s < 1) & (s >= 0) & F.lit(not date_1904), time_only).when(~F.isnan(s), pattern)


def formula_tag(number) -> Column:
    t = half_width(F.trim(_col(number)))
    t = F.trim(F.regexp_replace(t, r"^\(", ""))
    return F.trim(F.regexp_replace(t, r"\)$", ""))


def tagged_formula(formula, number) -> Column:
    """Formula with its number as a tag; null when the formula is empty."""
    body = strip_display_formula(F.coalesce(_col(formula), F.lit("")))
    return F.when(body != "", F.concat(body, F.lit("\\tag{"), formula_tag(number), F.lit("}")))


_ATTRIBUTE = r"""\s+([\w-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?"""


def clean_table_markup(html) -> Column:
    """Markup that keeps only spans of cells, link targets and picture basics.

    Every tag is taken apart into its attributes, filtered and put together again; the
    text between tags stays as it is.
    """
    html = _col(html)
    pieces = F.regexp_extract_all(html, F.lit(r"<\w[^>]*>|[^<]+|<"), F.lit(0))

    def rebuild(piece: Column) -> Column:
        name = F.lower(F.regexp_extract(piece, r"^<(\w+)", 1))
        pairs = F.regexp_extract_all(piece, F.lit(_ATTRIBUTE), F.lit(0))

        def kept(pair: Column) -> Column:
            key = F.lower(F.regexp_extract(pair, _ATTRIBUTE, 1))
            return pair.contains("=") & (
                key.isin("colspan", "rowspan")
                | ((name == "img") & key.isin("src", "alt", "width", "height"))
                | ((name == "a") & (key == "href"))
            )

        def spell(pair: Column) -> Column:
            raw = F.regexp_extract(pair, _ATTRIBUTE, 2)
            value = F.regexp_replace(raw, """^["']|["']$""", "")
            return F.concat(F.lit(" "), F.lower(F.regexp_extract(pair, _ATTRIBUTE, 1)), F.lit('="'), value, F.lit('"'))

        attributes = F.array_join(F.transform(F.filter(pairs, kept), spell), "")
        close = F.when(piece.rlike(r"/>\s*$"), "/>").otherwise(">")
        return F.when(piece.rlike(r"(?s)^<\w[^>]*>$"), F.concat(F.lit("<"), name, attributes, close)).otherwise(piece)

    return F.array_join(F.transform(pieces, rebuild), "")


# ---------------------------------------------------------------- object paths
def object_path(url) -> Column:
    """Struct of bucket, key and byte range of an object-store address."""
    url = _col(url)
    plain = F.trim(F.regexp_replace(url, r"\?.*$", ""))
    pattern = r"^s3a?://([^/]+)/(.*)$"
    bounds = F.split(F.nullif(F.regexp_extract(url, r"\?bytes=(.*)$", 1), F.lit("")), ",")
    return F.struct(
        F.nullif(F.regexp_extract(plain, pattern, 1), F.lit("")).alias("bucket"),
        F.when(plain.rlike(pattern), F.regexp_extract(plain, pattern, 2)).alias("key"),
        F.transform(bounds, lambda b: b.cast("long")).alias("byte_range"),
    )
