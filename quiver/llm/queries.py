"""Queries of the operators for training data, and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.llm import handwritten, leaks, neighbours, pairs, reading, syntax, tokenizer
from quiver.session import table

Query = Callable[[SparkSession, str], DataFrame]


#: The current model of `node_embeddings` and the length of its vectors.
MODEL, DIMENSIONS = "loom-mini#v3", 48


def p6_neighbours(spark: SparkSession, d: str) -> DataFrame:
    vectors = neighbours.usable_vectors(table(spark, d, "node_embeddings"), MODEL, DIMENSIONS)
    return neighbours.nearest_neighbours(vectors)


def p6_ranked(spark: SparkSession, d: str) -> DataFrame:
    """Cosines to six digits, which is what two programs agree on."""
    return p6_neighbours(spark, d).withColumn("cosine", F.round("cosine", 6))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.neighbour_pairs(p6_neighbours(spark, d))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode_corpus(table(spark, d, "documents"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.broken_files(table(spark, d, "documents"))


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.broken_rates(table(spark, d, "documents"), p2_found(spark, d))


def p2_undecided(spark: SparkSession, d: str) -> DataFrame:
    return syntax.undecided_files(table(spark, d, "documents"))


def p4_reasons(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.not_handwritten(table(spark, d, "documents"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_reasons(spark, d).select("doc_id")


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.handwritten_rates(table(spark, d, "documents"))


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.documented_functions(table(spark, d, "nodes"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_pairs(spark, d).select("graph_id", "id")


def p5_file_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.documented_functions_of_files(table(spark, d, "documents"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "benchmark_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_shares(spark, d).select("doc_id", "item_id").distinct()


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.demanding(p10_levels(spark, d)).select("doc_id")


def p10_profile(spark: SparkSession, d: str) -> DataFrame:
    return reading.level_profile(table(spark, d, "documents"), p10_levels(spark, d))


QUERIES: dict[str, Query] = {
    "p2_found": p2_found,
    "p2_rates": p2_rates,
    "p2_undecided": p2_undecided,
    "p4_found": p4_found,
    "p4_reasons": p4_reasons,
    "p4_rates": p4_rates,
    "p5_found": p5_found,
    "p5_pairs": p5_pairs,
    "p5_file_pairs": p5_file_pairs,
    "p6_found": p6_found,
    "p6_neighbours": p6_neighbours,
    "p6_ranked": p6_ranked,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_levels": p10_levels,
    "p10_profile": p10_profile,
}

_NEAREST = f"""
WITH u AS (
  SELECT vec_id, vector::DOUBLE[] AS v FROM node_embeddings
  WHERE model = '{MODEL}' AND len(vector) = {DIMENSIONS} AND list_aggregate(vector, 'sum') IS NOT NULL
    AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
s AS (SELECT a.vec_id, b.vec_id AS neighbour, round(list_cosine_similarity(a.v, b.v), 12) AS cosine FROM u a JOIN u b ON a.vec_id <> b.vec_id),
t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, neighbour) <= 5)
"""

SQL: dict[str, str] = {
    "p6_found": _NEAREST + "SELECT DISTINCT least(vec_id, neighbour) AS vec_a, greatest(vec_id, neighbour) AS vec_b FROM t",
    "p6_ranked": _NEAREST
    + "SELECT vec_id, neighbour, round(cosine, 6) AS cosine, (row_number() OVER (PARTITION BY vec_id ORDER BY t.cosine DESC, neighbour))::INTEGER AS place FROM t",
}
