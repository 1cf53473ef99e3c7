"""Queries of search and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.operators import search as S
from quiver.operators.graph import DEFINITIONS
from quiver.plans.tables import GRAPH, nodes, with_
from quiver.session import table

#: What is searched for: words, phrases and vectors (those whose id is divisible by 100).
WORDS = ["handle", "Store", "retrying"]
PHRASES = ["the settings file", "returns each request", "cold", "if the database has changed"]

#: Where something equivalent is wanted: modules of which each size of the test tables has some.
HINT = "flux_do1.record basket_du2.locale queue_q00a.spool"


def _queries(spark: SparkSession, texts: list[str]) -> DataFrame:
    return spark.createDataFrame([(t,) for t in [*texts, "  "]], "query string")


def keyword_like(spark: SparkSession, d: str) -> DataFrame:
    return S.keyword_like(nodes(spark, d, "labels", "properties"), _queries(spark, WORDS))


def code_search(spark: SparkSession, d: str) -> DataFrame:
    rows = nodes(spark, d, "labels", "properties", "language", "file_path")
    return S.code_search(rows, _queries(spark, WORDS), 20, "python")


def bm25(spark: SparkSession, d: str) -> DataFrame:
    return S.bm25(table(spark, d, "documents").select("doc_id", "text"), _queries(spark, PHRASES), 20)


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return S.vector_topk(v, v.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), 10)


def rrf_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Fusion of two rankings of documents for each phrase: by phrase, and by the phrase's first word."""
    phrase = S.bm25(table(spark, d, "documents").select("doc_id", "text"), _queries(spark, PHRASES), 20)
    first = spark.createDataFrame([(t, t.split()[-1]) for t in PHRASES], "query string, word string")
    words = S.bm25(table(spark, d, "documents").select("doc_id", "text"), first.select(F.col("word").alias("query")), 20)
    by_word = first.join(words.withColumnRenamed("query", "word"), "word").select("query", "doc_id", "place")
    return S.rrf(phrase, by_word, "doc_id", 20)


def symbol_search(spark: SparkSession, d: str) -> DataFrame:
    return S.symbol_search(nodes(spark, d, "name", "qualname"), _queries(spark, WORDS))


def find_equivalent(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "node_embeddings").where("model = 'loom-mini#v3' and size(vector) = 48")
    v = rows.select("vec_id", "graph_id", F.col("node_id").alias("id"), F.col("vector").cast("array<double>").alias("v")).where(F.forall("v", lambda x: ~F.isnan(x)))
    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "v")
    return S.find_equivalent(v, asked, nodes(spark, d, "labels", "module"), DEFINITIONS, HINT, 10)


def embedding_text(spark: SparkSession, d: str) -> DataFrame:
    return S.embedding_text(nodes(spark, d, "name", "labels", "module", "properties"))


QUERIES = {f.__name__: f for f in (keyword_like, code_search, bm25, vector_topk, rrf_hybrid, symbol_search, find_equivalent, embedding_text)}

_G = with_(GRAPH)
_LIKE = """, q AS (SELECT unnest(['handle', 'Store', 'retrying']) AS query),
k AS (SELECT query, graph_id, id, CASE WHEN contains(lower(id), lower(query)) THEN 1.0 ELSE 0.5 END::DOUBLE AS score, language, file_path FROM n JOIN q
  ON contains(lower(id), lower(query)) OR contains(lower(coalesce(properties, '')), lower(query)) OR contains(lower(array_to_string(labels, ' ')), lower(query)))
"""


def _bm25(name: str, phrases: list[tuple[str, str]]) -> str:
    values = ", ".join(f"('{q}', '{t}')" for q, t in phrases)
    return f"""{name}_q AS (SELECT * FROM (VALUES {values}) v(query, phrase)),
{name}_h AS (SELECT query, doc_id, dl, (length(line) - length(replace(line, ' ' || replace(phrase, ' ', '  ') || ' ', ''))) / (length(replace(phrase, ' ', '  ')) + 2)::DOUBLE AS tf
  FROM docs JOIN {name}_q ON contains(line, ' ' || replace(phrase, ' ', '  ') || ' ')),
{name}_s AS (SELECT query, doc_id, round(ln(1 + (total - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean)), 6) AS score
  FROM {name}_h JOIN (SELECT query, count(*) AS df FROM {name}_h GROUP BY ALL) USING (query) CROSS JOIN (SELECT count(*) AS total, avg(dl) AS mean FROM docs)),
{name} AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id)::INTEGER AS place FROM {name}_s QUALIFY place <= 20)"""


_DOCS = """docs AS (SELECT doc_id, len(w) AS dl, '  ' || array_to_string(w, '  ') || '  ' AS line FROM (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents))"""
_PAIRS = [(p, p) for p in PHRASES]
_LASTS = [(p, p.split()[-1]) for p in PHRASES]

SQL = {
    "keyword_like": _G + _LIKE + "SELECT query, graph_id, id, score FROM k",
    "code_search": _G
    + _LIKE
    + """, l AS (SELECT *, coalesce(nullif(language, ''), CASE WHEN file_path LIKE '%.py' THEN 'python' END) AS g FROM k)
SELECT query, graph_id, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, graph_id, id)::INTEGER AS place FROM l WHERE g = 'python' QUALIFY place <= 20""",
    "bm25": f"WITH {_DOCS},\n{_bm25('b', _PAIRS)}\nSELECT * FROM b",
    "rrf_hybrid": f"WITH {_DOCS},\n{_bm25('b', _PAIRS)},\n{_bm25('c', _LASTS)}\n"
    + """, u AS (SELECT query, doc_id, round(coalesce(1.0::DOUBLE / (60 + b.place), 0) + coalesce(1.0::DOUBLE / (60 + c.place), 0), 6) AS score, coalesce(b.place, 1 << 30) AS ps
  FROM b FULL JOIN c USING (query, doc_id))
SELECT query, doc_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, ps, doc_id)::INTEGER AS place FROM u QUALIFY place <= 20""",
    "vector_topk": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(v.v, q.v), 6) AS score FROM v JOIN v q ON q.vec_id % 100 = 0)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS place FROM s QUALIFY place <= 10""",
    "find_equivalent": _G
    + f""", v AS (SELECT vec_id, graph_id, node_id AS id, vector::DOUBLE[] AS v FROM node_embeddings
  WHERE model = 'loom-mini#v3' AND len(vector) = 48 AND len(list_filter(vector, lambda x: isnan(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
w AS (SELECT v.*, list_distinct(regexp_extract_all(lower(coalesce(n.module, '')), '[a-z0-9]+')) AS words FROM v JOIN n USING (graph_id, id)
  WHERE list_has_any(labels, [{', '.join(f"'{x}'" for x in DEFINITIONS)}])),
s AS (SELECT q.vec_id AS query_id, w.graph_id, w.id, round(round(list_cosine_similarity(w.v, q.v), 6)
    + CASE WHEN len(words) > 0 AND list_has_all(regexp_extract_all('{HINT}', '[a-z0-9]+'), words) THEN 0.1 ELSE 0 END, 6) AS score
  FROM w JOIN v q ON q.vec_id % 100 = 0)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, graph_id, id)::INTEGER AS place FROM s QUALIFY place <= 10""",
    "symbol_search": _G
    + """, q AS (SELECT unnest(['handle', 'Store', 'retrying']) AS query),
r AS (SELECT query, graph_id, id, CASE WHEN id = query THEN 1 WHEN name = query THEN 2 ELSE 3 END AS tier FROM n JOIN q
  ON contains(lower(id), lower(query)) OR contains(lower(coalesce(name, '')), lower(query)) OR contains(lower(coalesce(qualname, '')), lower(query)))
SELECT query, graph_id, id, tier FROM r QUALIFY tier = min(tier) OVER (PARTITION BY query, graph_id)""",
}

_J = "CASE WHEN json_valid(properties) THEN json_extract_string(properties, '$.{0}') END"
_PART = lambda c: f"nullif(trim({c}, ' '), '')"
SQL["embedding_text"] = (
    _G
    + f""", p AS (SELECT graph_id, id, name, module, labels, {_J.format('signature')} AS sg, {_J.format('docstring')} AS ds, {_J.format('documentation')} AS dc, {_J.format('snippet')} AS sn,
  CASE WHEN json_valid(properties) THEN json_extract_string(properties, '$.parameters[*]') END AS ps FROM n)
SELECT graph_id, id, concat_ws(' ', {_PART('name')}, lower(regexp_replace(labels[-1], '^Code', '')), 'in ' || {_PART('module')}, {_PART('sg')},
  CASE WHEN len(ps) > 0 THEN '(' || array_to_string(ps, ', ') || ')' END, ': ' || coalesce({_PART('ds')}, {_PART('dc')}, {_PART('sn')})) AS text FROM p"""
)
