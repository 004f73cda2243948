import pytest
from pyspark.sql import functions as F

from docloom.functions import questions as Q
from docloom.functions import text as X


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "raw, expected",
    [("a*b", r"a\*b"), (r"a\*b", r"a\*b"), (r"a\\*b", r"a\\\*b"), ("x_y`z", r"x\_y\`z")],
)
def test_markdown_escape_counts_backslashes(spark, raw, expected):
    assert one(spark, X.escape_markdown(F.lit(raw))) == expected


def test_references_take_one_spelling(spark):
    text = F.lit("应符合 GB/T 14549-2023 和 GB 50054-2011, gb/t 14549-2023")
    assert one(spark, X.referenced_standards(text))[:2] == ["GB/T 14549-2023", "GB 50054-2011"]


def test_document_metadata_prefers_the_file_name(spark):
    m = one(spark, X.document_metadata(F.lit("DL/T 5-1999\n某某技术导则标题\n"), F.lit("GB 1002-2024.pdf")))
    assert (m["standard_no"], m["version"], m["status"], m["publish_org"]) == ("GB 1002-2024", "2024版", "valid", "未知")
    assert m["title"] == "DL/T 5-1999" or m["title"] == "某某技术导则标题"


def test_terms_replace_in_order(spark):
    assert one(spark, Q.normalize_terms(F.lit("10千伏配电房的刀闸要求"))) == "10kV配电室的隔离开关要求"


@pytest.mark.parametrize("query, lane", [("GB 50053 和 GB 50054 有什么不同", "slow"), ("接地", "fast"), ("GB 50057-2010第3.2.1条", "fast")])
def test_route(spark, query, lane):
    assert one(spark, Q.route(F.lit(query))["lane"]) == lane


def test_vagueness_orders_questions(spark):
    vague, precise = (one(spark, Q.vagueness(F.lit(q))) for q in ("接地", "GB 50057-2010第3.2.1条"))
    assert vague == 0.6 and precise == 0.0


def test_cjk_tokens_are_pairs(spark):
    assert one(spark, X.tokens(F.lit("接地要求 10kV"))) == ["接地", "地要", "要求", "10kv"]


def test_cleaned_table_markup(spark):
    html = '<td class="x" colspan="2">a</td><a href=\'u\' style="z">t</a><img src="s" onclick="q"/>'
    assert one(spark, X.clean_table_markup(F.lit(html))) == '<td colspan="2">a</td><a href="u">t</a><img src="s"/>'


def test_citation_label(spark):
    assert one(spark, X.format_citation(F.lit(1), F.lit("GB 50057-2010"), F.lit("3.2.1"), F.lit(""))) == "[1] GB 50057-2010 第3.2.1条"
