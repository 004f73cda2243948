"""Registered queries of recall over rewrites and of filters that give way."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import multi_recall, nearest, search
from docloom.plans import sql_tables as S
from docloom.plans.registry import query
from docloom.plans.retrieval_queries import COSINE, document_words
from docloom.plans.sql_tables import with_

FILTERS = ["voltage_level", "category", "doc_type", "standard_no"]


def filtered(c):
    """Questions of customers with one to four filters, and the chunks of orders."""
    chunks = c.table("orders").join(c.table("customer"), F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("o_orderkey").alias("chunk_id"), F.pmod("o_custkey", F.lit(1000)).alias("voltage_level"), F.col("c_mktsegment").alias("category"),
        F.col("o_orderpriority").alias("doc_type"), F.col("o_orderstatus").alias("standard_no"),
    )
    k = F.col("c_custkey")
    asked = c.table("customer").select(
        k.alias("query_id"), F.when(F.pmod(k, F.lit(7)) != 0, F.pmod(k, F.lit(1100))).alias("voltage_level"), F.col("c_mktsegment").alias("category"),
        F.when(F.pmod(k, F.lit(2)) == 0, "1-URGENT").alias("doc_type"), F.when(F.pmod(k, F.lit(3)) == 0, "Z").otherwise("O").alias("standard_no"),
    )
    return multi_recall.relaxed_recall(asked, multi_recall.leaders(chunks, FILTERS, 20))


RELAXED = """WITH facts AS (SELECT o_orderkey AS chunk_id, o_custkey % 1000 AS voltage_level, c_mktsegment AS category, o_orderpriority AS doc_type, o_orderstatus AS standard_no FROM orders JOIN customer ON c_custkey = o_custkey),
q AS (SELECT c_custkey AS query_id, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 1100 END AS v, c_mktsegment AS c, CASE WHEN c_custkey % 2 = 0 THEN '1-URGENT' END AS d, CASE WHEN c_custkey % 3 = 0 THEN 'Z' ELSE 'O' END AS s FROM customer),
l AS (SELECT query_id, level, n, CASE WHEN level < 1 OR v IS NULL THEN v END AS voltage_level, CASE WHEN level < 1 + (v IS NOT NULL)::INT THEN c END AS category, CASE WHEN level < 2 + (v IS NOT NULL)::INT THEN d END AS doc_type,
   CASE WHEN level < 2 + (v IS NOT NULL)::INT + (d IS NOT NULL)::INT THEN s END AS standard_no FROM (SELECT *, unnest(range(0, n + 1)) AS level FROM (SELECT *, 2 + (v IS NOT NULL)::INT + (d IS NOT NULL)::INT AS n FROM q))),
h AS (SELECT query_id, level, chunk_id, row_number() OVER (PARTITION BY query_id, level ORDER BY chunk_id) AS r FROM l JOIN facts f ON (l.voltage_level IS NULL OR l.voltage_level = f.voltage_level) AND (l.category IS NULL OR l.category = f.category)
   AND (l.doc_type IS NULL OR l.doc_type = f.doc_type) AND (l.standard_no IS NULL OR l.standard_no = f.standard_no) QUALIFY r <= 20),
n AS (SELECT l.*, (SELECT count(*) FROM h WHERE h.query_id = l.query_id AND h.level = l.level) AS hits FROM l),
z AS (SELECT * FROM n WHERE hits >= 3 OR level = n.n QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY level) = 1)"""


@query("F6", RELAXED + " SELECT query_id, chunk_id, CAST(level AS INTEGER) AS level FROM h JOIN z USING (query_id, level)")
def relaxed_hits(c):
    """Chunks found under the first set of filters that finds three, filters given up one by one."""
    return filtered(c)[0].select("query_id", "chunk_id", "level")


@query("F6", RELAXED + """ SELECT query_id, CAST(level AS INTEGER) AS level, hits, level > 0 AS relaxed, coalesce(CAST(voltage_level AS VARCHAR), '*') AS voltage_level, coalesce(category, '*') AS category, coalesce(doc_type, '*') AS doc_type,
  coalesce(standard_no, '*') AS standard_no FROM z""")
def relaxed_filters(c):
    """Filters that each question kept, and how many chunks it then found."""
    return filtered(c)[1].select("query_id", "level", "hits", "relaxed", *[F.coalesce(F.col(f).cast("string"), F.lit("*")).alias(f) for f in FILTERS])


VARIANTS = r"""qv AS (SELECT item_id, string_split_regex(trim(lower(text), ' '), '[ \t\n\r]+') AS w FROM benchmark), variants AS (
  SELECT item_id AS query_id, 0 AS variant, array_to_string(w, ' ') AS query_text, CASE WHEN item_id % 3 = 0 THEN item_id + 7 END AS made FROM qv UNION ALL SELECT item_id, 1, array_to_string(w[1:5], ' '), NULL FROM qv UNION ALL SELECT item_id, 2, array_to_string(w[6:9], ' '), NULL FROM qv),
queries AS (SELECT query_id * 64 + variant AS query_id, query_text FROM variants WHERE variant = 0 OR trim(query_text, ' ') <> '')"""


@query("T6 A1 A2 P7", with_(VARIANTS) + S.BM25[len(S.QUERIES) :] + f""", e AS (SELECT vec_id, embedding::DOUBLE[] AS embedding FROM embeddings), q AS (SELECT query_id, variant, embedding AS v FROM (
  SELECT query_id, variant, (coalesce(made, length(query_text)) * 31 + query_id) % (SELECT count(*) FROM e) AS vec_id FROM variants WHERE variant = 0 OR trim(query_text, ' ') <> '') JOIN e USING (vec_id)), ve AS (SELECT query_id, variant, e.vec_id AS chunk_id, {COSINE} AS score FROM q, e), li AS (
  SELECT query_id // 64 AS query_id, query_id % 64 * 2 + 1 AS list_no, doc_id AS chunk_id, score, 'keyword' AS source FROM bm UNION ALL SELECT query_id, variant * 2, chunk_id, score, 'vector' FROM ve
  UNION ALL SELECT item_id, 130, doc_id, 1.0, 'structured' FROM benchmark JOIN documents ON doc_id % 50 = item_id % 50 AND lang = 'en'), rk AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, list_no ORDER BY score DESC, chunk_id) - 1 AS r FROM li QUALIFY r < CASE source WHEN 'structured' THEN 10 ELSE 20 END), fu AS (
  SELECT query_id, chunk_id, round(sum(1 / (61 + r)), 12) AS raw, min((list_no, r)) AS seen, array_to_string(list_distinct(list(source ORDER BY list_no, r)), '+') AS sources, list(source ORDER BY list_no, r) AS so FROM rk GROUP BY 1, 2), sc AS (
  SELECT *, round(raw / max(raw) OVER (PARTITION BY query_id), 6) AS score FROM fu)
SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, chunk_id) AS INTEGER) AS rank FROM sc QUALIFY rank <= 50""")
def rewritten_recall(c):
    """Fifty documents per question from the lists of three wordings, by words and by vectors, and an exact list."""
    words = F.split(F.trim(F.lower("text")), r"[ \t\n\r]+")
    part = lambda a, n: F.array_join(F.slice(words, a, n), " ")
    b, none = c.table("benchmark"), F.lit(None).cast("string").alias("hypothetical")
    made = F.when(F.col("item_id") % 3 == 0, (F.col("item_id") + 7).cast("string"))
    variants = b.select(F.col("item_id").alias("query_id"), F.lit(0).alias("variant"), F.array_join(words, " ").alias("query_text"), made.alias("hypothetical"))
    for n, (start, size) in enumerate(((1, 5), (6, 4)), 1):
        variants = variants.unionByName(b.select(F.col("item_id").alias("query_id"), F.lit(n).alias("variant"), part(start, size).alias("query_text"), none))
    e = c.table("embeddings").select("vec_id", F.col("embedding").alias("vector"))
    total = e.agg(F.count("*").alias("n")).scalar()

    def vector(asked):
        """The vector of a text is that of a number made from it; a hypothetical answer is a number here."""
        number = F.coalesce(F.expr("try_cast(query_text AS BIGINT)"), F.length("query_text").cast("long"))
        own = asked.select("query_id", F.pmod(number * 31 + F.floor(F.col("query_id") / 64), total).alias("vec_id")).join(e, "vec_id")
        return nearest.dense_topk(own.select("query_id", "vector"), e, "vec_id", 20).select("query_id", F.col("vec_id").alias("chunk_id"), "score")

    def exact(asked):
        docs = c.table("documents").where("lang = 'en'").select(F.col("doc_id").alias("chunk_id"), F.pmod("doc_id", F.lit(50)).alias("_k"))
        return asked.select("query_id", F.pmod("query_id", F.lit(50)).alias("_k")).join(docs, "_k").select("query_id", "chunk_id", F.lit(1.0).alias("score"))

    keyword = lambda asked: search.keyword_topk(asked.select("query_id", "query_text"), document_words(c), "doc_id", 20).withColumnRenamed("doc_id", "chunk_id")
    fused = multi_recall.recall_rewrites(variants, {"vector": vector, "keyword": keyword, "structured": exact})
    return fused.select("query_id", "chunk_id", "score", "rank")
