"""Readability of a corpus."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions import text as tx
from marketlens.functions.parallel import spread

COUNTS = ("n_sent", "n_words", "n_syll", "n_chars", "poly_all", "poly_no_proper", "fog_complex")
#: The reading-grade limits, (side, limit).
LIMITS = {"fk": ("max", 9.0), "ari": ("max", 9.0), "fog": ("max", 9.0), "ease": ("min", 60.0), "smog": ("max", 10.0)}


def counts(docs: DataFrame, key: str, body: str, markup: bool = True) -> DataFrame:
    """Word, sentence and syllable counts per document.

    Sentences and words are generators inside one scan; the sum per document combines map-side,
    so one short row per document and task is shuffled, however long the text is. Documents
    without a word have no row.
    """
    clean = tx.strip_markup(F.col(body)) if markup else tx.fold_blanks(F.col(body))
    s = spread(docs.select(key, body), key).select(key, F.posexplode(tx.sentences(clean)).alias("k", "s"))
    w = s.select(key, "k", F.posexplode_outer(F.regexp_extract_all("s", F.lit(tx.WORD), F.lit(0))).alias("i", "tok"))
    # One column per step: each string is built once per token.
    word = tx.is_word(F.col("tok"))
    w = w.withColumn("w", F.when(word, tx.letters(F.col("tok"))).otherwise(""))
    w = w.withColumn("g", tx.vowel_groups(F.col("w")))
    w = w.withColumn("syl", tx.syllables_of(F.col("w"), F.col("g")))
    chars = F.length("w") + F.when(word, 0).otherwise(F.length(F.translate("tok", ",.", "")))
    proper = F.ascii("tok").between(65, 90) & (F.col("i") > 0)
    heavy = F.filter(F.split("tok", "-"), lambda p: (p != "") & (tx.syllables(p) >= 3))
    compound = F.contains("tok", F.lit("-")) & (F.size(heavy) == 0)
    stem = F.regexp_replace("tok", "(es|ed|ing)$", "")
    inflected = (stem != F.col("tok")) & (tx.syllables(stem) < 3)
    poly = F.col("syl") >= 3
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    g = w.groupBy(key).agg(
        (F.max("k") + 1).cast("long").alias("n_sent"),
        F.count("tok").alias("n_words"),
        F.sum("syl").alias("n_syll"),
        F.sum(chars).alias("n_chars"),
        one(poly).alias("poly_all"),
        one(poly & ~proper).alias("poly_no_proper"),
        F.sum(F.when(poly, F.when(proper | compound | inflected, 0).otherwise(1)).otherwise(0)).alias("fog_complex"),
    )
    return g.where("n_words > 0")


def score(c: DataFrame) -> DataFrame:
    """The six formulas on the counts."""
    wps, spw = F.col("n_words") / F.col("n_sent"), F.col("n_syll") / F.col("n_words")
    smog = lambda p: 1.0430 * F.sqrt(F.col(p) * 30.0 / F.col("n_sent")) + 3.1291
    return (
        c.withColumn("fk", 0.39 * wps + 11.8 * spw - 15.59)
        .withColumn("ease", 206.835 - 1.015 * wps - 84.6 * spw)
        .withColumn("smog", smog("poly_all"))
        .withColumn("smog_np", smog("poly_no_proper"))
        .withColumn("fog", 0.4 * (wps + 100.0 * F.col("fog_complex") / F.col("n_words")))
        .withColumn("ari", 4.71 * (F.col("n_chars") / F.col("n_words")) + 0.5 * wps - 21.43)
    )


def readability(docs: DataFrame, key: str, body: str, markup: bool = True) -> DataFrame:
    """Counts and scores per document."""
    return score(counts(docs, key, body, markup))


def gate(scores: DataFrame, limits: Mapping[str, tuple[str, float]] = LIMITS) -> DataFrame:
    """Missed limits per document, as a list of names, and whether it passes."""
    miss = [F.when((F.col(n) > v) if side == "max" else (F.col(n) < v), F.lit(n)) for n, (side, v) in limits.items()]
    return scores.withColumn("misses", F.array_compact(F.array(*miss))).withColumn("passes", F.size("misses") == 0)


def gate_report(gated: DataFrame, by: Sequence[str]) -> DataFrame:
    """Documents, passes and misses by limit for each class of documents."""
    per = [F.count_if(F.array_contains("misses", n)).alias(f"miss_{n}") for n in LIMITS]
    return gated.groupBy(*by).agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("passes").alias("n_pass"), *per)


def group_readability(c: DataFrame, by: Sequence[str]) -> DataFrame:
    """Scores of each group as if its texts were one: the formulas on summed counts."""
    return score(c.groupBy(*by).agg(*[F.sum(n).alias(n) for n in COUNTS]))
