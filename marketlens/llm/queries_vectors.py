"""Queries over embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import hard_negatives, whitening
from marketlens.llm.registry import query, table


@query("op11_embedding_whitening")
def _op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deviation is null where it is too large for a long."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    done = whitening.transform(rows, whitening.fit(rows, "embedding", 64, 16))
    deviation = F.expr("try_cast(deviation AS BIGINT)").alias("deviation")
    return done.select("vec_id", "component", "n", deviation, "whitened", "explained", "identity_error")


_NEGATIVES_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len([x FOR x IN embedding IF isfinite(x)]) = len(embedding) AND len(embedding) > 0
), s AS (
  SELECT a.vec_id AS anchor_id, e.vec_id, e.label = a.label AS same, list_inner_product(a.q, e.q)::BIGINT AS score
  FROM e a JOIN e ON e.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""


@query("op12_hard_negatives", _NEGATIVES_SQL)
def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)
