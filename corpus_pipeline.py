"""A training corpus from documents: toxic ones go, one of each group of near copies stays, repeated passages
are cut, sources are mixed to weights, and what is left is encoded.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import bpe, mixing, ngram_join, substring, toxicity
from marketlens.llm.queries_tables import quality_weight
from marketlens.llm.text import n_words
from marketlens.session import cut, prepare

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fitted on the labels that op7 may learn from; documents with a score of 0.3 or more go."""
    labels = prepare(spark).read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(~toxicity.held_out(F.col("doc_id")))
    model = toxicity.train(docs.select("doc_id", "text"), labels)
    return toxicity.score(docs.select(*COLUMNS), model).where("predicted = 0").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five words, similarity 0.8; of each group the document with the smallest id stays, once if its row repeats."""
    groups = ngram_join.join(docs.select("doc_id", "text"), n=5, percent=80)
    gone = groups.where("doc_id <> component_id").select("doc_id")
    left = docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")
    twice = cut(groups.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    once = left.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return left.join(twice, "doc_id", "left_anti").unionByName(once).select(*COLUMNS)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that a 13-word window shares with an earlier document go; texts without such words stay as they are,
    and documents of which nothing is left go."""
    done = substring.dedup(docs.select(*COLUMNS)).where("n_removed = 0 OR n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return done.withColumn("text", text).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by the weights 5, 2, 1 to 150 % of all words; a document is repeated as often as the mix takes it.

    Ids may be null or repeat, so rows are numbered and written once with their number; of rows that the mix can't tell
    apart, those first by a hash of all their columns get more.
    """
    rows = cut(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()))
    size, weight = n_words(F.col("text")).alias("size"), quality_weight(F.col("text")).alias("weight")
    sized = cut(rows.select("doc_id", "source", size, weight, "row", F.xxhash64(*COLUMNS).alias("tie")))
    copies = mixing.mix(sized, tie="tie").where("copies > 0").select("row", "copies")
    return rows.join(copies, "row").select(*COLUMNS, F.explode(F.expr("sequence(1, copies)"))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with their token ids and what these decode to, as digests."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.digests(docs, path)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("passages", cut_passages),
    ("mix", mix_sources),
    ("encode", encode),
]

#: Stages that SQL can't express (a fitted classifier, a tokenizer): tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written once to the shared folder before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
