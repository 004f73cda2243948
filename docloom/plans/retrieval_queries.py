"""Registered queries of the retrieval side: search, vectors, fusion, cascade, rerank."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import nearest, recall, search
from docloom.operators.skew import top_k
from docloom.plans import sql_tables as S
from docloom.plans.registry import query
from docloom.plans.sql_tables import with_


def document_words(c):
    return search.tokenize(c.table("documents"), "doc_id", "text")


@query("T1 T2 K1 W1", with_(S.BM25) + """
SELECT query_id, doc_id, score, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM bm)
WHERE rank <= 10""")
def bm25_topk(c):
    """Ten best documents for each question by BM25."""
    return search.keyword_topk(c.queries(), document_words(c), "doc_id", 10).select("query_id", "doc_id", "score", "rank")


@query("T3", with_(S.BM25) + """
SELECT query_id, doc_id, score FROM bm JOIN qn USING (query_id) WHERE matched = n_terms""")
def bm25_and(c):
    """Documents holding every word of the question."""
    return search.bm25(c.queries(), document_words(c), "doc_id", "and").select("query_id", "doc_id", "score")


@query("T5 T2", with_(S.BM25) + """, src AS (SELECT doc_id, lang AS v FROM documents),
lang_q AS (SELECT item_id AS query_id, CASE item_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' ELSE 'es' END AS v FROM benchmark),
ln AS (SELECT v, ln(1 + ((SELECT count(*) FROM src) - count(*) + 0.5) / (count(*) + 0.5)) AS s FROM src GROUP BY v),
u AS (SELECT query_id, doc_id, score * 2.0 AS score, 'text' AS field FROM bm
      UNION ALL SELECT q.query_id, s.doc_id, round(l.s, 6) * 1.5, 'lang' FROM src s JOIN ln l USING (v) JOIN lang_q q USING (v)),
m AS (SELECT query_id, doc_id, round(max(score), 6) AS score, arg_max(field, score) AS field FROM u GROUP BY 1, 2)
SELECT query_id, doc_id, score, field, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM m) WHERE rank <= 20""")
def multi_field_search(c):
    """Best of boosted text score and exact keyword-field score."""
    tag = F.element_at(F.array(*[F.lit(x) for x in ("en", "fr", "de", "es")]), (F.pmod("query_id", F.lit(4)) + 1).cast("int"))
    by_field = search.exact_field(
        c.queries().select("query_id", tag.alias("query_text")), c.table("documents"), "doc_id", "lang"
    )
    text = search.bm25(c.queries(), document_words(c), "doc_id")
    best = search.best_fields({"text": (text, 2.0), "lang": (by_field, 1.5)}, "doc_id")
    return top_k(best, ["query_id"], [F.desc("score"), F.asc("doc_id")], 20)


@query("T4", with_(S.QUERIES, S.DOC_WORDS, S.QUERY_WORDS) + """,
p AS (SELECT doc_id, CAST(generate_subscripts(words, 1) AS BIGINT) AS pos, unnest(words) AS term FROM doc_words),
q AS (SELECT query_id, len(words) AS n, CAST(generate_subscripts(words, 1) AS BIGINT) AS off, unnest(words) AS term FROM query_words),
h AS (SELECT query_id, doc_id, pos - off AS start, any_value(n) AS n, count(*) AS c FROM q JOIN p USING (term) GROUP BY 1, 2, 3)
SELECT query_id, doc_id, count(*) AS occurrences FROM h WHERE c = n GROUP BY 1, 2""")
def phrase_search(c):
    """Documents holding the question's words in sequence."""
    return search.phrase_matches(c.queries(), document_words(c), "doc_id")


@query("T1", with_(S.DOC_WORDS) + """
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf
FROM (SELECT doc_id, unnest(words) AS term FROM doc_words) GROUP BY 1""")
def term_stats(c):
    """Document and collection frequency of every word."""
    return search.term_statistics(search.postings(document_words(c), "doc_id"))


@query("A5 A6", with_(S.BM25) + """
SELECT source, count(*) AS doc_count FROM documents WHERE doc_id IN (SELECT doc_id FROM bm) GROUP BY source
ORDER BY doc_count DESC, source LIMIT 10""")
def source_buckets(c):
    """Sources with most documents among the hits of the questions."""
    hits = search.holding_any(c.queries(), document_words(c), "doc_id")
    return search.count_by_value(c.table("documents").select("doc_id", "source"), "source", 10, hits, "doc_id")


DENSE_QUERIES = "q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v, label FROM embeddings)"
COSINE = "round(list_dot_product(q.v, e.embedding::DOUBLE[]) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 6)"


@query("J14 K1 C31", with_(DENSE_QUERIES) + f"""
SELECT query_id, vec_id, score, rank FROM (
  SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM (SELECT q.query_id, e.vec_id, {COSINE} AS score FROM q, embeddings e)) WHERE rank <= 20""")
def dense_topk(c):
    """Twenty nearest vectors of every vector by cosine."""
    e = c.table("embeddings").select("vec_id", F.col("embedding").alias("vector"))
    q = e.select(F.col("vec_id").alias("query_id"), "vector")
    return nearest.dense_topk(q, e, "vec_id", 20)


MULTI = "list_transform([0,16,32,48], lambda o: list_slice({0}, o + 1, o + 16)::DOUBLE[])"


@query("J16 P3", with_("m AS (SELECT vec_id, label, " + MULTI.format("embedding") + " AS ms FROM embeddings)") + """,
qp AS (SELECT vec_id AS query_id, unnest([1, 2, 3, 4]) AS i, ms FROM m),
pair AS (SELECT q.query_id, d.vec_id, q.i,
   list_max(list_transform(d.ms, lambda x: list_dot_product(q.ms[q.i], x))) AS best
   FROM qp q, m d WHERE d.label % 2 = 0),
s AS (SELECT query_id, vec_id, round(sum(best ORDER BY i), 6) AS score FROM pair GROUP BY 1, 2)
SELECT query_id, vec_id, score, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) WHERE rank <= 50""")
def maxsim_topk(c):
    """Fifty best items with multi-vectors by late interaction; even labels carry them."""
    parts = F.array(*[F.slice("embedding", o + 1, 16) for o in (0, 16, 32, 48)])
    m = c.table("embeddings").select("vec_id", "label", parts.alias("vectors"))
    q = m.select(F.col("vec_id").alias("query_id"), "vectors")
    return nearest.maxsim_topk(q, m.where(F.pmod("label", F.lit(2)) == 0), "vec_id", 50)


SPARSE = """sp AS (SELECT vec_id, i AS index, x AS value FROM (
  SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS i, unnest(embedding) AS x FROM embeddings) WHERE x > 0)"""


@query("J15 P2", with_(SPARSE) + """,
s AS (SELECT q.vec_id AS query_id, d.vec_id, round(sum(q.value::DOUBLE * d.value::DOUBLE), 6) AS score
      FROM sp q JOIN sp d USING (index) GROUP BY 1, 2)
SELECT query_id, vec_id, score, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) WHERE rank <= 20""")
def sparse_dot(c):
    """Sparse dot-product top 20 through the shared indices."""
    sp = sparse_rows(c)
    return nearest.sparse_topk(sp.withColumnRenamed("vec_id", "query_id"), sp, "vec_id", 20)


def sparse_rows(c):
    return (
        c.table("embeddings").select("vec_id", F.posexplode("embedding").alias("index", "value")).where(F.col("value") > 0)
    )


# ---------------------------------------------------------------- fusion
def dense_queries(c):
    """Questions with the vector of the same number."""
    vectors = c.table("embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vectors.join(c.table("benchmark").select(F.col("item_id").alias("query_id")), "query_id")


def recall_lists(c):
    """Vector, keyword, structured and visual hits of every question."""
    e = c.table("embeddings").select("vec_id", F.col("embedding").alias("vector"))
    asked = dense_queries(c)
    vector = nearest.dense_topk(asked, e, "vec_id", 20).select("query_id", F.col("vec_id").alias("chunk_id"), "score")
    keyword = search.keyword_topk(c.queries(), document_words(c), "doc_id", 20).select("query_id", F.col("doc_id").alias("chunk_id"), "score")
    tag = F.concat(F.lit("src"), F.pmod("query_id", F.lit(20)).cast("string"))
    by_source = c.table("documents").select(F.col("doc_id").alias("chunk_id"), "source")
    by_source = top_k(by_source, ["source"], [F.asc("chunk_id")], 10).drop("rank")
    structured = c.queries().select("query_id", tag.alias("source")).join(by_source, "source").select("query_id", "chunk_id", F.lit(1.0).alias("score"))
    cut = lambda v: F.array(*[F.slice(v, o + 1, 16) for o in (0, 16, 32, 48)])
    visual = nearest.maxsim_topk(asked.select("query_id", cut("vector").alias("vectors")), e.select("vec_id", cut("vector").alias("vectors")), "vec_id", 50)
    visual = visual.select("query_id", F.col("vec_id").alias("chunk_id"), "score")
    lists = [("vector", vector), ("keyword", keyword), ("structured", structured), ("visual", visual)]
    united = None
    for no, (name, hits) in enumerate(lists):
        rows = hits.withColumn("list_no", F.lit(no)).withColumn("source", F.lit(name))
        united = rows if united is None else united.unionByName(rows)
    return united


LISTS = S.BM25 + f""",
e AS (SELECT vec_id, embedding::DOUBLE[] AS v, {MULTI.format('embedding')} AS ms FROM embeddings),
eq AS (SELECT e.vec_id AS query_id, v, ms FROM e JOIN benchmark b ON b.item_id = e.vec_id),
vec AS (SELECT query_id, vec_id AS chunk_id, round(list_dot_product(q.v, e.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(e.v, e.v)), 6) AS score FROM eq q, e),
vis AS (SELECT query_id, vec_id AS chunk_id, round(sum(best ORDER BY i), 6) AS score FROM (
  SELECT q.query_id, d.vec_id, i, list_max(list_transform(d.ms, lambda x: list_dot_product(q.ms[i], x))) AS best
  FROM (SELECT *, unnest([1, 2, 3, 4]) AS i FROM eq) q, e d) GROUP BY 1, 2),
stu AS (SELECT q.query_id, d.doc_id AS chunk_id, 1.0 AS score FROM queries q JOIN documents d ON d.source = 'src' || (q.query_id % 20)),
allhits AS (SELECT query_id, chunk_id, score, 0 AS list_no, 'vector' AS source, 20 AS lim FROM vec
  UNION ALL SELECT query_id, doc_id, score, 1, 'keyword', 20 FROM bm
  UNION ALL SELECT query_id, chunk_id, score, 2, 'structured', 10 FROM stu
  UNION ALL SELECT query_id, chunk_id, score, 3, 'visual', 50 FROM vis),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, list_no ORDER BY score DESC, chunk_id) - 1 AS rank FROM allhits) WHERE rank < lim)"""


def fused_sql(weight: str = "1.0", ranked: str = "ranked") -> str:
    return f"""
, fu AS (SELECT query_id, chunk_id, round(sum({weight} / (61 + rank)), 12) AS raw, min(list_no * 1000 + rank) AS fs,
           string_agg(source, '+' ORDER BY list_no) AS sources FROM {ranked} GROUP BY 1, 2),
fs AS (SELECT *, round(raw / max(raw) OVER (PARTITION BY query_id), 6) AS score FROM fu),
fused AS (SELECT query_id, chunk_id, score, sources, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fs, chunk_id) AS INTEGER) AS rank FROM fs) WHERE rank <= 50)"""


@query("A1 A2 K11 T6 P7", with_(LISTS) + fused_sql() + "SELECT * FROM fused")
def hybrid_recall(c):
    """All four recall paths fused by reciprocal rank, fifty chunks per question."""
    return recall.reciprocal_rank_fusion(recall.rank_lists(recall_lists(c)))


@query("A3", with_(LISTS) + "SELECT query_id, source, count(*) AS hits FROM ranked GROUP BY 1, 2")
def recall_sources(c):
    """Hits per question and path."""
    return recall.source_counts(recall.rank_lists(recall_lists(c)))


@query("A4", with_("""e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)""", SPARSE) + """,
d AS (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, round(list_dot_product(q.v, e.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(e.v, e.v)), 6) AS score FROM e q, e),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS chunk_id, round(sum(q.value::DOUBLE * d.value::DOUBLE), 6) AS score FROM sp q JOIN sp d USING (index) GROUP BY 1, 2),
a AS (SELECT *, 0 AS list_no, 'dense' AS source FROM d UNION ALL SELECT *, 1, 'sparse' FROM s),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, list_no ORDER BY score DESC, chunk_id) - 1 AS rank FROM a) WHERE rank < 20)"""
       + fused_sql() + "SELECT * FROM fused WHERE rank <= 10")
def rrf_fusion(c):
    """Dense and sparse lists of every vector fused, ten per vector."""
    e = c.table("embeddings").select("vec_id", F.col("embedding").alias("vector"))
    dense = nearest.dense_topk(e.select(F.col("vec_id").alias("query_id"), "vector"), e, "vec_id", 20)
    sp = sparse_rows(c)
    sparse = nearest.sparse_topk(sp.withColumnRenamed("vec_id", "query_id"), sp, "vec_id", 20)
    as_hits = lambda h: h.select("query_id", F.col("vec_id").alias("chunk_id"), "score")
    return recall.dense_sparse_fusion(as_hits(dense), as_hits(sparse), 10)


WEIGHTS = """w AS (SELECT * FROM (VALUES ('principle', 'vector', 2.0), ('principle', 'visual', 1.5), ('clause', 'keyword', 1.5), ('clause', 'structured', 2.0)) t(query_type, source, weight)),
wr AS (SELECT r.*, coalesce(w.weight, 1.0) AS weight FROM (SELECT *, CASE WHEN query_id % 2 = 0 THEN 'principle' ELSE 'clause' END AS query_type FROM ranked) r LEFT JOIN w USING (query_type, source))"""


@query("A36", with_(LISTS, WEIGHTS) + fused_sql("weight", "wr") + "SELECT * FROM fused")
def weighted_rrf(c):
    """Fusion with weights by question type."""
    weights = c.spark.createDataFrame(
        [("principle", "vector", 2.0), ("principle", "visual", 1.5), ("clause", "keyword", 1.5), ("clause", "structured", 2.0)],
        "query_type string, source string, weight double",
    )
    kind = F.when(F.pmod("query_id", F.lit(2)) == 0, "principle").otherwise("clause")
    return recall.weighted_fusion(recall.rank_lists(recall_lists(c)).withColumn("query_type", kind), weights)


# ---------------------------------------------------------------- structured lookups
FACTS = """facts AS (
  SELECT o_orderkey AS chunk_id, o_custkey AS doc_id, 'GB ' || (1000 + o_custkey % 500) AS standard_no,
    (o_orderkey % 9 + 1) || '.' || (o_orderkey % 7 + 1) AS clause, o_orderkey % 11 AS position,
    CASE WHEN o_orderkey % 2 = 0 THEN 'parent' ELSE 'child' END AS chunk_type, o_orderpriority AS content,
    CASE WHEN o_orderstatus = 'P' THEN 'draft' ELSE 'valid' END AS status, o_custkey % 100 AS reference_count, c_mktsegment AS category
  FROM orders JOIN customer ON c_custkey = o_custkey),
asked AS (
  SELECT c_custkey AS query_id, CASE c_custkey % 5
      WHEN 0 THEN 'GB ' || (1000 + c_custkey % 600) || ' 第' || (c_custkey % 9 + 1) || '.' || (c_custkey % 7 + 1) || '条'
      WHEN 1 THEN 'GB ' || (1000 + c_custkey % 600) || ' HIGH URGENT' WHEN 2 THEN 'GB ' || (100 + c_custkey % 55)
      WHEN 3 THEN '第' || (c_custkey % 9 + 1) || '.' || (c_custkey % 7 + 1) || '条' ELSE 'general question' END AS query_text,
    CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS category
  FROM customer)"""


def fact_chunks(c):
    k = F.col("o_orderkey")
    return c.table("orders").join(c.table("customer"), F.col("c_custkey") == F.col("o_custkey")).select(
        k.alias("chunk_id"), F.col("o_custkey").alias("doc_id"),
        F.concat(F.lit("GB "), (1000 + F.pmod("o_custkey", F.lit(500))).cast("string")).alias("standard_no"),
        F.concat_ws(".", (F.pmod(k, F.lit(9)) + 1).cast("string"), (F.pmod(k, F.lit(7)) + 1).cast("string")).alias("clause"),
        F.pmod(k, F.lit(11)).alias("position"), F.when(F.pmod(k, F.lit(2)) == 0, "parent").otherwise("child").alias("chunk_type"),
        F.col("o_orderpriority").alias("content"), F.when(F.col("o_orderstatus") == "P", "draft").otherwise("valid").alias("status"),
        F.pmod("o_custkey", F.lit(100)).alias("reference_count"), F.col("c_mktsegment").alias("category"),
    )


def asked_by_customers(c):
    k = F.col("c_custkey")
    number = lambda base, n: F.concat(F.lit("GB "), (base + F.pmod(k, F.lit(n))).cast("string"))
    clause = F.concat(F.lit("第"), (F.pmod(k, F.lit(9)) + 1).cast("string"), F.lit("."), (F.pmod(k, F.lit(7)) + 1).cast("string"), F.lit("条"))
    kind = F.pmod(k, F.lit(5))
    text = (
        F.when(kind == 0, F.concat_ws(" ", number(1000, 600), clause)).when(kind == 1, F.concat(number(1000, 600), F.lit(" HIGH URGENT")))
        .when(kind == 2, number(100, 55)).when(kind == 3, clause).otherwise("general question")
    )
    return c.table("customer").select(k.alias("query_id"), text.alias("query_text"), F.when(F.pmod(k, F.lit(3)) == 0, F.col("c_mktsegment")).alias("category"))


@query("K5 F1 F3 F4 F5 S3 C11 C12", with_(FACTS) + r"""
, parsed AS (SELECT query_id, query_text, category,
    nullif(regexp_extract(query_text, '(GB(/T)?\s*[0-9]+)', 1), '') AS std, nullif(regexp_extract(query_text, '第?([0-9]+(\.[0-9]+)+)条?', 1), '') AS cl,
    list_filter(string_split(trim(regexp_replace(query_text, 'GB[/T\s]*[0-9]+-[0-9]+', '')), ' '), lambda w: length(w) >= 2)[1:5] AS words FROM asked),
v AS (SELECT * FROM facts WHERE status = 'valid'),
h AS (
  SELECT query_id, chunk_id, position, reference_count, CASE WHEN v.clause = p.cl THEN 1
      WHEN chunk_type = 'parent' AND len(list_filter(words, lambda w: contains(v.content, w))) > 0 THEN 2
      WHEN chunk_type = 'parent' AND position >= 3 THEN 3 ELSE 4 END AS tier
  FROM parsed p JOIN v ON starts_with(lower(v.standard_no), lower(p.std)) AND (p.category IS NULL OR p.category = v.category)
  UNION ALL SELECT query_id, chunk_id, position, reference_count, 5
  FROM parsed p JOIN v ON v.clause = p.cl AND (p.category IS NULL OR p.category = v.category)
  UNION ALL SELECT query_id, chunk_id, position, reference_count, 6
  FROM parsed p JOIN v ON (p.category IS NULL OR p.category = v.category)),
b AS (SELECT query_id, min(tier) AS best FROM h GROUP BY 1)
SELECT query_id, chunk_id, CAST(tier AS INTEGER) AS tier, CASE tier WHEN 1 THEN 1.0 WHEN 2 THEN 0.95 WHEN 5 THEN 0.85 WHEN 6 THEN 0.7 ELSE 0.9 END::DOUBLE AS score, rank FROM (
  SELECT h.*, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN tier >= 5 THEN -reference_count ELSE 0 END, position, chunk_id) AS INTEGER) AS rank
  FROM h JOIN b USING (query_id) WHERE tier = best) WHERE rank <= 10""")
def structured_cascade(c):
    """Tiered lookup by standard number, clause, words and metadata."""
    return recall.structured_recall(asked_by_customers(c), fact_chunks(c), 10, ["category"])


@query("K8", with_(FACTS) + r"""
, p AS (SELECT query_id, regexp_extract(query_text, '(GB [0-9]+)', 1) AS standard_no, regexp_extract(query_text, '([0-9]+\.[0-9]+)', 1) AS clause FROM asked)
SELECT query_id, chunk_id, standard_no, clause FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY position, chunk_id) AS r FROM p JOIN facts USING (standard_no, clause)) WHERE r = 1""")
def clause_fetch(c):
    """Exact clause of a standard, one chunk per question."""
    from docloom.functions.text import clause_number, standard_number
    from docloom.operators.lookup import fetch_clause

    asked = asked_by_customers(c).select("query_id", standard_number("query_text").alias("standard_no"), clause_number("query_text").alias("clause"))
    return fetch_clause(asked, fact_chunks(c)).select("query_id", "chunk_id", "standard_no", "clause")


@query("F6", """
WITH facts AS (SELECT o_custkey % 1000 AS voltage_level, c_mktsegment AS category, o_orderpriority AS doc_type, o_orderstatus AS standard_no
  FROM orders JOIN customer ON c_custkey = o_custkey),
q AS (SELECT c_custkey AS query_id, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 1100 END AS voltage_level, c_mktsegment AS category,
   CASE WHEN c_custkey % 2 = 0 THEN '1-URGENT' END AS doc_type, CASE WHEN c_custkey % 3 = 0 THEN 'Z' ELSE 'O' END AS standard_no FROM customer),
n AS (SELECT *, list_filter(['voltage_level', 'category', 'doc_type', 'standard_no'], lambda f: CASE f WHEN 'voltage_level' THEN voltage_level IS NOT NULL
   WHEN 'category' THEN category IS NOT NULL WHEN 'doc_type' THEN doc_type IS NOT NULL ELSE standard_no IS NOT NULL END) AS st FROM q),
l AS (SELECT query_id, level, CASE WHEN NOT list_contains(st[1:level], 'voltage_level') THEN voltage_level END AS voltage_level,
   CASE WHEN NOT list_contains(st[1:level], 'category') THEN category END AS category,
   CASE WHEN NOT list_contains(st[1:level], 'doc_type') THEN doc_type END AS doc_type,
   CASE WHEN NOT list_contains(st[1:level], 'standard_no') THEN standard_no END AS standard_no
  FROM (SELECT *, unnest(range(0, len(st) + 1)) AS level FROM n)),
cnt AS (SELECT query_id, level, any_value(l.voltage_level) AS voltage_level, any_value(l.category) AS category, any_value(l.doc_type) AS doc_type, any_value(l.standard_no) AS standard_no,
   count(f.category) AS hits FROM l LEFT JOIN facts f ON (l.voltage_level IS NULL OR l.voltage_level = f.voltage_level) AND (l.category IS NULL OR l.category = f.category)
   AND (l.doc_type IS NULL OR l.doc_type = f.doc_type) AND (l.standard_no IS NULL OR l.standard_no = f.standard_no) GROUP BY 1, 2)
SELECT query_id, CAST(level AS INTEGER) AS level, coalesce(CAST(voltage_level AS VARCHAR), '*') AS voltage_level, coalesce(category, '*') AS category,
  coalesce(doc_type, '*') AS doc_type, coalesce(standard_no, '*') AS standard_no, hits, level > 0 AS relaxed FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits >= 3 DESC, CASE WHEN hits >= 3 THEN level END, level DESC) AS r FROM cnt) WHERE r = 1""")
def filter_relaxation(c):
    """First filter level with three hits, dropping filters one by one."""
    facts = c.table("orders").join(c.table("customer"), F.col("c_custkey") == F.col("o_custkey")).select(
        F.pmod("o_custkey", F.lit(1000)).alias("voltage_level"), F.col("c_mktsegment").alias("category"),
        F.col("o_orderpriority").alias("doc_type"), F.col("o_orderstatus").alias("standard_no"),
    )
    k = F.col("c_custkey")
    asked = c.table("customer").select(
        k.alias("query_id"), F.when(F.pmod(k, F.lit(7)) != 0, F.pmod(k, F.lit(1100))).alias("voltage_level"), F.col("c_mktsegment").alias("category"),
        F.when(F.pmod(k, F.lit(2)) == 0, "1-URGENT").alias("doc_type"), F.when(F.pmod(k, F.lit(3)) == 0, "Z").otherwise("O").alias("standard_no"),
    )
    chosen = recall.relax_filters(asked, facts)
    shown = [F.coalesce(F.col(f).cast("string"), F.lit("*")).alias(f) for f in ("voltage_level", "category", "doc_type", "standard_no")]
    return chosen.select("query_id", "level", *shown, "hits", "relaxed")


@query("F2", """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, strftime(l_shipdate, '%Y-%m-%d') AS ship_day FROM lineitem
WHERE l_returnflag IN ('A', 'R') AND l_quantity >= 10 AND l_quantity < 20 AND l_linestatus <> 'F' AND (l_discount = 0.05 OR l_tax > 0.06)""")
def payload_filter(c):
    """Boolean filter tree compiled to one condition and pushed to the scan."""
    condition = recall.payload_condition({
        "must": [{"key": "l_returnflag", "match": {"any": ["A", "R"]}}, {"key": "l_quantity", "range": {"gte": 10, "lt": 20}}],
        "must_not": [{"key": "l_linestatus", "match": {"value": "F"}}],
        "should": [{"key": "l_discount", "match": {"value": 0.05}}, {"key": "l_tax", "range": {"gt": 0.06}}],
    })
    return c.table("lineitem").where(condition).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.date_format("l_shipdate", "yyyy-MM-dd").alias("ship_day"))


@query("F1", "SELECT p_partkey, p_brand, p_type, p_size FROM part WHERE p_type = 'ECONOMY' AND p_brand IN ('Brand#2', 'Brand#17')")
def metadata_filter(c):
    """Equality and membership filters; unset ones do not filter."""
    condition = recall.metadata_condition({"p_type": "ECONOMY", "p_brand": ["Brand#2", "Brand#17"], "p_name": [], "p_size": None})
    return c.table("part").where(condition).select("p_partkey", "p_brand", "p_type", "p_size")


@query("K9", """
WITH q AS (SELECT c_custkey AS query_id, CASE c_custkey % 4 WHEN 0 THEN 'ring' WHEN 1 THEN 'red' WHEN 2 THEN 'small' ELSE 'Brand#2' END AS keyword,
   CASE WHEN c_custkey % 3 = 0 THEN 'ECONOMY' END AS category FROM customer)
SELECT query_id, doc_id, rank FROM (
  SELECT query_id, p_partkey AS doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY p_partkey) AS INTEGER) AS rank
  FROM q JOIN part ON (contains(p_name, keyword) OR contains(p_brand, keyword)) AND (category IS NULL OR category = p_type) WHERE p_size % 5 <> 0) WHERE rank <= 10""")
def related_listing(c):
    """Ten completed documents whose fields hold a keyword, optionally of a category."""
    from docloom.operators.lookup import related_documents

    k = F.col("c_custkey")
    word = F.element_at(F.array(*[F.lit(w) for w in ("ring", "red", "small", "Brand#2")]), (F.pmod(k, F.lit(4)) + 1).cast("int"))
    asked = c.table("customer").select(k.alias("query_id"), word.alias("keyword"), F.when(F.pmod(k, F.lit(3)) == 0, "ECONOMY").alias("category"))
    documents = c.table("part").select(
        F.col("p_partkey").alias("doc_id"), "p_name", "p_brand", F.col("p_type").alias("category"),
        F.when(F.pmod("p_size", F.lit(5)) != 0, "completed").otherwise("pending").alias("process_status"),
    )
    return related_documents(asked, documents, ["p_name", "p_brand"]).select("query_id", "doc_id", "rank")


@query("K10", """
WITH q AS (SELECT s_suppkey AS query_id, [CASE WHEN s_suppkey % 5 = 4 THEN 'zzz' ELSE 'Brand#1' || (s_suppkey % 10) END, 'T' || s_suppkey || 'X'] AS words FROM supplier),
t AS (SELECT p_partkey AS table_id, p_brand AS title, 'T' || p_size AS table_number FROM part),
h AS (SELECT DISTINCT query_id, table_id FROM (SELECT query_id, unnest(words) AS w FROM q) JOIN t ON contains(title, w) OR contains(table_number, w)),
f AS (SELECT query_id, table_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY table_id) AS INTEGER) AS rank FROM h)
SELECT query_id, table_id, rank FROM f WHERE rank <= 5 UNION ALL SELECT query_id, -1, 0 FROM q WHERE query_id NOT IN (SELECT query_id FROM h)""")
def table_lookup(c):
    """Tables by title word or number; questions without one are marked -1 for text recall."""
    from docloom.operators.lookup import find_tables

    k = F.col("s_suppkey")
    word = F.when(F.pmod(k, F.lit(5)) == 4, "zzz").otherwise(F.concat(F.lit("Brand#1"), F.pmod(k, F.lit(10)).cast("string")))
    asked = c.table("supplier").select(k.alias("query_id"), F.array(word, F.concat(F.lit("T"), k.cast("string"), F.lit("X"))).alias("words"))
    tables = c.table("part").select(F.col("p_partkey").alias("table_id"), F.col("p_brand").alias("title"), F.concat(F.lit("T"), F.col("p_size").cast("string")).alias("table_number"))
    found, missing = find_tables(asked, tables, F.col("words"))
    return found.select("query_id", "table_id", "rank").unionByName(missing.select("query_id", F.lit(-1).cast("long").alias("table_id"), F.lit(0).alias("rank")))


@query("K7", "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total, true AS has_more FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def page_listing(c):
    """Third page of twenty with total."""
    rows = c.table("orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    return recall.page_of(rows, [F.desc("o_orderdate"), F.asc("o_orderkey")], 3, 20).drop("o_orderdate")


# ---------------------------------------------------------------- rerank, sufficiency, expansion
def reranked(c):
    from docloom.operators.ranking import two_stage_rerank

    return two_stage_rerank(document_hits(c), 5, 20)


def document_hits(c):
    """BM25 top 50 with document text; the language decides the content type."""
    hits = search.keyword_topk(c.queries(), document_words(c), "doc_id", 50).select("query_id", F.col("doc_id").alias("chunk_id"), "score")
    from docloom.operators.ranking import distinct_words

    docs = c.table("documents").select(F.col("doc_id").alias("chunk_id"), distinct_words(F.col("text")).alias("content_words"), "lang")
    asked = c.queries().select("query_id", distinct_words(F.col("query_text")).alias("query_words"))
    kind = F.when(F.col("lang") == "fr", "table").when(F.col("lang") == "de", "image_description").otherwise("text")
    return hits.join(docs, "chunk_id").join(asked, "query_id").withColumn("content_type", kind).drop("lang")


RERANK = S.BM25 + """,
cand AS (SELECT b.query_id, b.doc_id AS chunk_id, b.score, lang FROM (
   SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM bm) b JOIN documents d USING (doc_id) WHERE r <= 50),
tx AS (SELECT c.*, list_distinct(q.words) AS qw, list_distinct(d.words) AS dw, count(*) OVER (PARTITION BY c.query_id) AS n FROM cand c JOIN query_words q USING (query_id) JOIN doc_words d ON d.doc_id = c.chunk_id),
sc AS (SELECT *, len(list_intersect(qw, dw)) AS nb FROM tx),
co AS (SELECT *, round(1 / (1 + exp(-(6.0 * nb / greatest(len(qw), 1) - 3))), 6) AS coarse,
   round(1 / (1 + exp(-(4.0 * nb / greatest(len(qw), 1) + 4.0 * nb / greatest(len(qw) + len(dw) - nb, 1) - 3))), 6) AS fine FROM sc),
st2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coarse DESC, chunk_id) AS cr FROM co) WHERE cr <= 20 OR n <= 5),
fi AS (SELECT query_id, chunk_id, CASE WHEN n <= 5 THEN true ELSE fine >= 0.2 END AS ok,
   round(CASE WHEN n <= 5 THEN score ELSE fine END * CASE lang WHEN 'fr' THEN 1.05 WHEN 'de' THEN 1.08 ELSE 1.0 END, 6) AS final_score FROM st2),
rr AS (SELECT query_id, chunk_id, final_score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY ok DESC, final_score DESC, chunk_id) AS INTEGER) AS rank FROM fi) WHERE rank <= 5)"""


@query("K2 K3 P4", with_(RERANK) + "SELECT * FROM rr")
def two_stage_rerank(c):
    """Fifty candidates to twenty to five."""
    return reranked(c).select("query_id", "chunk_id", "final_score", "rank")


@query("K4", with_(S.BM25) + """, j AS (SELECT query_id, doc_id AS chunk_id, CASE lang WHEN 'fr' THEN 1.05 WHEN 'de' THEN 1.08 ELSE 1.0 END AS f, score,
   CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM bm JOIN documents USING (doc_id))
SELECT query_id, chunk_id, round(score * f, 6) AS final_score, rank FROM j WHERE rank <= 5""")
def recall_order(c):
    """Fallback order by recall score."""
    from docloom.operators.ranking import recall_order as fallback

    return fallback(document_hits(c), 5).select("query_id", "chunk_id", "final_score", "rank")


@query("C26", with_(RERANK) + """
SELECT q.query_id, coalesce(reason, 'empty') = '' AS sufficient, coalesce(reason, 'empty') AS reason FROM queries q LEFT JOIN (
  SELECT query_id, CASE WHEN max(final_score) FILTER (rank = 1) < 0.95 THEN 'top1_low' WHEN count(*) FILTER (final_score >= 0.9) < 2 THEN 'coverage_low' ELSE '' END AS reason
  FROM rr GROUP BY 1) s USING (query_id)""")
def sufficiency_rule(c):
    """Is the reranked list good enough to answer from."""
    from docloom.operators.ranking import sufficiency

    return sufficiency(c.queries(), reranked(c), top1=0.95, coverage=0.9)


CHILDREN = """e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
par AS (SELECT q.vec_id AS query_id, l.label AS parent_id, q.v AS qv FROM e q JOIN benchmark b ON b.item_id = q.vec_id CROSS JOIN (SELECT DISTINCT label FROM e) l),
pc AS (SELECT query_id, parent_id, c.vec_id AS child_id, round(list_dot_product(qv, c.v), 6) AS similarity FROM par JOIN e c ON c.label = par.parent_id)"""


def expansion(c):
    from docloom.operators.ranking import expand_children

    e = c.table("embeddings")
    vectors = dense_queries(c).select("query_id", F.col("vector").alias("query_vector"))
    labels = e.agg(F.array_sort(F.collect_set("label")).alias("a")).scalar()
    parents = vectors.select("query_id", F.explode(labels).alias("chunk_id"))
    children = e.select(F.col("vec_id").alias("child_id"), F.col("label").alias("parent_id"), F.col("embedding").alias("vector"))
    return expand_children(parents, children, vectors, threshold=0.2)


@query("K6 J2", with_(CHILDREN) + """
SELECT query_id, parent_id, child_id, similarity, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, parent_id ORDER BY similarity DESC, child_id) AS INTEGER) AS rank
FROM pc WHERE similarity >= 0.2) WHERE rank <= 5""")
def child_expansion(c):
    """Five most similar children of each parent above the threshold."""
    return expansion(c)[0]


@query("A25", with_(CHILDREN) + """
, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, parent_id ORDER BY similarity DESC, child_id) AS r FROM pc WHERE similarity >= 0.2) WHERE r <= 5),
t AS (SELECT query_id, parent_id, count(*) AS total_children FROM pc GROUP BY 1, 2),
f AS (SELECT query_id, parent_id, count(*) AS kept_children, floor(sum(CAST(round(similarity * 1e6) AS BIGINT)) / count(*)) / 1e6 AS a FROM k GROUP BY 1, 2)
SELECT query_id, parent_id, total_children, coalesce(kept_children, 0) AS kept_children, coalesce(a, 0) AS avg_score FROM t LEFT JOIN f USING (query_id, parent_id)""")
def expansion_stats(c):
    """Children seen and kept per parent."""
    return expansion(c)[1]


# ---------------------------------------------------------------- set operations on hit lists
TWO_LISTS = S.BM25 + """,
k1 AS (SELECT * FROM (SELECT query_id, doc_id AS chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM bm) WHERE rank <= 10),
k2 AS (SELECT * FROM (SELECT query_id, doc_id AS chunk_id, round(score / dl, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score / dl, 6) DESC, doc_id) AS INTEGER) AS rank FROM bm JOIN dl USING (doc_id)) WHERE rank <= 10)"""


def two_lists(c):
    """Hits by score and by score per word, ten each."""
    lists = search.two_topk(c.queries(), document_words(c), "doc_id", 10)
    return tuple(hits.drop("matched").withColumnRenamed("doc_id", "chunk_id") for hits in lists)


@query("U1", with_(TWO_LISTS) + """
SELECT query_id, chunk_id, score FROM k1 UNION ALL SELECT query_id, chunk_id, score FROM k2 WHERE (query_id, chunk_id) NOT IN (SELECT (query_id, chunk_id) FROM k1)""")
def merge_hits(c):
    """Two hit lists as one, the first wins."""
    first, second = two_lists(c)
    return recall.merge_hits(first, second).select("query_id", "chunk_id", "score")


@query("U5 U4", with_(TWO_LISTS) + """
, fresh AS (SELECT DISTINCT query_id FROM k2 WHERE query_id % 3 <> 0 AND (query_id, chunk_id) NOT IN (SELECT (query_id, chunk_id) FROM k1))
SELECT query_id, chunk_id, rank, 'old' AS kept FROM k1 WHERE rank <= 5 AND query_id NOT IN (SELECT query_id FROM fresh)
UNION ALL SELECT query_id, chunk_id, rank, 'new' FROM k2 WHERE query_id IN (SELECT query_id FROM fresh)""")
def retry_keep(c):
    """Retry result only where it brought new chunks."""
    first, second = two_lists(c)
    candidates = second.where(F.pmod("query_id", F.lit(3)) != 0)
    tag = lambda d, t: d.withColumn("kept", F.lit(t))
    return recall.keep_unless_new(tag(first, "old"), tag(second, "new"), candidates, first, 5).select("query_id", "chunk_id", "rank", "kept")


@query("U7 T8", with_(TWO_LISTS) + """
, a AS (SELECT *, 1 AS step FROM k1 UNION ALL SELECT *, 2 FROM k2 UNION ALL SELECT query_id, chunk_id, score + 0.5, rank, 3 FROM k1),
f AS (SELECT query_id, chunk_id, score, step FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY step, rank) AS r FROM a) WHERE r = 1)
SELECT query_id, chunk_id, score, CAST(step AS INTEGER) AS step, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, step, chunk_id) AS INTEGER) AS rank FROM f) WHERE rank <= 20""")
def step_results(c):
    """Hits of three steps combined, first occurrence wins, twenty at most."""
    first, second = two_lists(c)
    third = first.withColumn("score", F.col("score") + 0.5)
    steps = first.withColumn("step", F.lit(1)).unionByName(second.withColumn("step", F.lit(2))).unionByName(third.withColumn("step", F.lit(3)))
    return recall.combine_steps(steps)


@query("T7 J8 U5 C26 F7 F8", None)
def fast_lane(c):
    """From four recall paths to the ranked context of every question, with one retry."""
    from docloom.plans.lanes import fast_lane as run

    kind = F.when(F.col("lang") == "fr", "table").when(F.col("lang") == "de", "image_description").otherwise("text")
    texts = c.table("documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), kind.alias("content_type"))
    fused = recall.reciprocal_rank_fusion(recall.rank_lists(recall_lists(c)))
    retry = search.keyword_topk(c.queries(), document_words(c), "doc_id", 50).withColumnRenamed("doc_id", "chunk_id")
    return run(c.queries(), fused, retry, texts)


# ---------------------------------------------------------------- the plan of tools
def tool_fixture(c):
    """Plan of three steps per customer, and the chunks, documents and tables its tools look into."""
    from docloom.operators import tool_plan

    k, number = F.col("c_custkey"), lambda n, m: F.concat(F.lit("GB "), (1000 + F.pmod(n, F.lit(m))).cast("string"))
    clause = F.concat_ws(".", (F.pmod(k, F.lit(9)) + 1).cast("string"), (F.pmod(k, F.lit(7)) + 1).cast("string"))
    null = lambda name: F.lit(None).cast(tool_plan.PARAMETERS[name]).alias(name)
    kind = F.pmod(k, F.lit(4))
    tools = {
        1: F.when(kind == 0, "list_related_standards").when(kind == 1, "retrieve_clause").when(kind == 2, "retrieve_table").otherwise("retrieve_standard"),
        2: F.when(kind == 0, "retrieve_standard").when(kind == 1, "sufficient").when(kind == 2, "zoom").otherwise("retrieve_clause"),
        3: F.when(kind == 3, "retrieve_table").otherwise("retrieve_clause"),
    }
    rows = [
        c.table("customer").select(
            k.alias("query_id"), F.lit(n).alias("step"), tool.alias("tool"), F.lit("URGENT high medium").alias("query"),
            F.when(kind == 3, F.array(number(k, 500), number(k + 1, 500))).alias("standards"), (kind == 0).alias("use_found"), number(k, 500).alias("standard_id"), clause.alias("clause"),
            F.col("c_mktsegment").alias("keyword"), null("category"), F.concat(F.lit("T"), (F.pmod(k, F.lit(60)) + 1).cast("string"), F.lit(" URGENT list")).alias("table_title"),
        )
        for n, tool in tools.items()
    ]
    documents = c.table("customer").select(
        k.alias("doc_id"), number(k, 500).alias("standard_no"), "c_name", "c_mktsegment", F.col("c_mktsegment").alias("category"), F.when(F.pmod(k, F.lit(3)) == 0, "pending").otherwise("completed").alias("process_status")
    )
    p = F.col("p_partkey")
    tables = c.table("part").select(p.alias("table_id"), F.when(F.pmod(p, F.lit(2)) == 0, p).alias("chunk_id"), F.col("p_brand").alias("title"), F.concat(F.lit("T"), F.col("p_size").cast("string")).alias("table_number"), number(p, 500).alias("standard_no"))
    return rows[0].unionByName(rows[1]).unionByName(rows[2]), tool_plan.standard_tools(fact_chunks(c), documents, tables, ["c_name", "c_mktsegment"])


#: The three steps one by one: names found in the first, chunks of the second, exact clauses, tables and their fallback.
TOOL_STEPS = with_(FACTS) + r""", p AS (SELECT c_custkey AS query_id, c_custkey % 4 AS kind, 'GB ' || (1000 + c_custkey % 500) AS std, 'GB ' || (1000 + (c_custkey + 1) % 500) AS std2, (c_custkey % 9 + 1) || '.' || (c_custkey % 7 + 1) AS cl,
    c_mktsegment AS keyword, 'T' || (c_custkey % 60 + 1) AS num FROM customer), done AS (
  SELECT c_custkey AS doc_id, 'GB ' || (1000 + c_custkey % 500) AS standard_no, c_name || chr(1) || c_mktsegment AS t FROM customer WHERE c_custkey % 3 <> 0), words AS (SELECT DISTINCT keyword FROM p WHERE kind = 0), related AS (
  SELECT keyword, standard_no, row_number() OVER (PARTITION BY keyword ORDER BY doc_id) AS r FROM done JOIN words ON contains(t, keyword) QUALIFY r <= 5), named AS (
  SELECT DISTINCT query_id, standard_no FROM p JOIN related USING (keyword) WHERE kind = 0), told AS (
  SELECT query_id, 2 AS step, ['urgent', 'high', 'medium'] AS q, standard_no FROM named UNION ALL SELECT query_id, 1, ['urgent', 'high', 'medium'], unnest([std, std2]) FROM p WHERE kind = 3), tab AS (
  SELECT p_partkey AS table_id, CASE WHEN p_partkey % 2 = 0 THEN p_partkey END AS chunk_id, p_brand || chr(1) || 'T' || p_size AS t, 'GB ' || (1000 + p_partkey % 500) AS standard_no FROM part), tq AS (
  SELECT query_id, CASE kind WHEN 2 THEN 1 ELSE 3 END AS step, std, num FROM p WHERE kind IN (2, 3)), th AS (
  SELECT query_id, step, table_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY table_id) AS r FROM tq JOIN tab ON (contains(t, num) OR contains(t, 'URGENT')) AND contains(standard_no, std) QUALIFY r <= 5), again AS (
  SELECT query_id, step, [lower(num), 'urgent', 'list', '表格'] AS q, std AS standard_no FROM tq WHERE query_id NOT IN (SELECT query_id FROM th)), sc AS (
  SELECT query_id, step, chunk_id, round(len(list_intersect(q, list_distinct(string_split_regex(lower(content), '[^\p{L}\p{N}]+')))) / len(q), 6) AS score
  FROM (SELECT * FROM told UNION ALL SELECT * FROM again) JOIN facts USING (standard_no)), ch AS (
  SELECT query_id, step, chunk_id, score, row_number() OVER (PARTITION BY query_id, step ORDER BY score DESC, chunk_id) AS r FROM sc WHERE score > 0 QUALIFY r <= 15), cq AS (
  SELECT query_id, CASE kind WHEN 1 THEN 1 WHEN 3 THEN 2 ELSE 3 END AS step, std, cl FROM p WHERE kind <> 2), hits AS (
  SELECT query_id, step, CASE WHEN step = 3 OR query_id % 4 = 2 THEN 'retrieve_table' ELSE 'retrieve_standard' END AS tool, chunk_id, score, r FROM ch
  UNION ALL SELECT query_id, step, 'retrieve_table', coalesce(chunk_id, table_id), 1.0, r FROM th
  UNION ALL SELECT query_id, step, 'retrieve_clause', chunk_id, 1.0, 1 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY position, chunk_id) AS n FROM cq JOIN facts ON standard_no = std AND clause = cl) WHERE n = 1)"""


@query("T8 K8 K9 K10", TOOL_STEPS + " SELECT query_id, CAST(step AS INTEGER) AS step, tool, chunk_id, CAST(score AS DOUBLE) AS score, CAST(r AS INTEGER) AS rank FROM hits")
def plan_hits(c):
    """What each step of every question's plan of tools finds; a step may use what the one before found."""
    from docloom.operators import tool_plan

    return tool_plan.run_plan(*tool_fixture(c))[0]


@query("T8", TOOL_STEPS + """, taken AS (SELECT query_id, unnest(CASE kind WHEN 0 THEN ['list_related_standards', 'retrieve_standard', 'retrieve_clause'] WHEN 1 THEN ['retrieve_clause'] WHEN 2 THEN ['retrieve_table'] ELSE ['retrieve_standard', 'retrieve_clause', 'retrieve_table'] END) AS tool,
  unnest(CASE kind WHEN 1 THEN [1] WHEN 2 THEN [1] ELSE [1, 2, 3] END) AS step FROM p)
SELECT query_id, CAST(step AS INTEGER) AS step, tool, count(chunk_id) AS results FROM taken LEFT JOIN hits USING (query_id, step, tool) GROUP BY 1, 2, 3""")
def plan_trace(c):
    """Steps taken by every question, and how much each found."""
    from docloom.operators import tool_plan

    return tool_plan.run_plan(*tool_fixture(c))[1]


@query("T8 U7", TOOL_STEPS + """, f AS (SELECT query_id, chunk_id, score, step FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY step, r) AS z FROM hits) WHERE z = 1)
SELECT query_id, chunk_id, CAST(score AS DOUBLE) AS score, CAST(step AS INTEGER) AS step, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, step, chunk_id) AS INTEGER) AS rank FROM f) WHERE rank <= 20""")
def slow_lane(c):
    """Chunks of a question's whole plan: first occurrences, best first, twenty at most."""
    from docloom.operators import tool_plan

    return tool_plan.combined(tool_plan.run_plan(*tool_fixture(c))[0])
