"""Queries of the operators that run Python on Arrow batches."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import bpe, media, ngram_join, pii, substring, toxicity
from marketlens.llm.registry import query, table

_SUBSTRING_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
b AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS least FROM g) WHERE least < doc_id),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM b),
k AS (SELECT d.doc_id, p.p, d.w[p.p] AS word, r.p IS NOT NULL AS gone
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d) p JOIN d ON d.doc_id = p.doc_id LEFT JOIN r ON r.doc_id = p.doc_id AND r.p = p.p)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) FILTER (WHERE gone) AS n, string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS kept FROM k GROUP BY doc_id) x
ON d.doc_id = x.doc_id
"""


@query("op5_substring_dedup", _SUBSTRING_SQL)
def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substring.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op4_bpe_codec")
def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op6_audio_features")
def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = media.features(media.store(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "media"))
    return done.select(
        "doc_id",
        "n_bytes",
        "payload_bytes",
        "payload_sha256",
        "tail_crc32",
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


@query("op7_toxicity")
def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    known = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~toxicity.held_out(F.col("doc_id")))
    scored = toxicity.score(docs, toxicity.train(docs, known))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


_JACCARD_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, least(len(w), 1) + 1))) AS i FROM d)),
n AS (SELECT d.doc_id, count(g)::BIGINT AS n FROM d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * o >= 90 * (p.n + q.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS reached FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reached = e.a)
SELECT n.doc_id, any_value(n) AS n_shingles, min(reached) AS component_id FROM n JOIN r ON n.doc_id = r.doc_id GROUP BY n.doc_id
"""


@query("op8_ngram_jaccard", _JACCARD_SQL)
def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), n=3, percent=90)


@query("op13_personal_data")
def _op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.fit(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")
