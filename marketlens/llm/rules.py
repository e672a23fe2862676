"""Quality rules as a ledger: measure once, store failure bits, apply policies to the bits.

``ledger`` evaluates every rule once for each document and keeps the measurements beside one bit for
each failed rule. A policy is a version name and a mask of the rules that reject; changing a policy
never reads a text again. ``ablations`` counts from the bits alone what a policy would keep without
each of its rules. Everything is built-in columns: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.text import SPACE_CHARS, words

SYMBOLS = "#*$%&|<>"

#: Rule names in bit order; True rejects. Each reads the measurements of ``measure``.
RULES: dict[str, Column | str] = {
    "too_short": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "100 * n_dup_lines > 40 * n_lines",
    "long_words": "word_chars > 20 * n_words",
    "short_words": "word_chars < 2 * n_words",
}

#: Versioned policies: the rules that reject under each.
POLICIES = {
    "base": ("too_short", "repeated_words"),
    "2": ("too_short", "repeated_words", "symbols", "repeated_lines", "long_words", "short_words"),
}


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(policy: str) -> int:
    return sum(bit(r) for r in POLICIES[policy])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id and the measurements the rules read.

    n_words; word_chars (code points in words); n_symbols; n_lines (lines with a word) and n_dup_lines
    (those equal to an earlier one); n_repeat_words (words in 3-word windows found twice or more in the
    text, the first included). Windows are compared as words; hashes only say which texts can have a
    repeat. A null text measures as an empty one. Other columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    split = base.select(
        "doc_id",
        "t",
        words(F.col("t")).alias("w"),
        F.filter(F.split("t", "\n"), lambda x: F.translate(x, SPACE_CHARS, "") != "").alias("lines"),
    )
    counted = split.select(
        "doc_id",
        "w",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("t", SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("CASE WHEN size(w) >= 3 THEN transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i+1], w[i+2])) END").alias("h"),
    )
    keep = ["doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    ordered = counted.select(
        *keep,
        F.expr(
            "CASE WHEN size(array_distinct(h)) < size(h) THEN array_sort(transform(sequence(0, size(w) - 3),"
            " i -> struct(w[i] AS a, w[i+1] AS b, w[i+2] AS c, i AS at))) END"
        ).alias("s"),
    )
    same = "s[{0}].a = x.a AND s[{0}].b = x.b AND s[{0}].c = x.c"
    found = ordered.select(
        *keep,
        F.expr(
            f"array_sort(transform(filter(s, (x, i) -> (i > 0 AND {same.format('i-1')})"
            f" OR (i < size(s) - 1 AND {same.format('i+1')})), x -> x.at))"
        ).alias("p"),
    )
    covered = "aggregate(transform(p, (x, i) -> CASE WHEN i < size(p) - 1 THEN least(3, p[i+1] - x) ELSE 3 END), 0, (a, x) -> a + x)"
    row = F.struct(*keep, F.coalesce(F.expr(covered), F.lit(0)).cast("long").alias("n_repeat_words"))
    # A generator of one row: a later filter on a measurement stays above it and does not repeat the measuring.
    return found.select(F.inline(F.array(row)))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements and ``fail_bits``: bit k is set if rule k rejects the document.

    An empty or null text fails ``too_short`` and no other rule.
    """
    bits = [F.when(F.expr(rule), F.lit(bit(name))).otherwise(F.lit(0)).cast("long") for name, rule in RULES.items()]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measure(docs, id_col, text_col).withColumn("fail_bits", total)


def apply_policy(entries: DataFrame, policy: str) -> DataFrame:
    """Add ``kept`` under a policy; only the bits are read."""
    return entries.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0)


def ablations(entries: DataFrame, policy: str, by: list[str] | None = None) -> DataFrame:
    """For each group: rows, rows kept, the rules that failed anywhere and everywhere (bits), and for each
    rule of the policy the rows kept if it were left out. One pass of partial counts over the bits."""
    m = mask(policy)
    bits = F.col("fail_bits")
    out = [
        F.count(F.lit(1)).alias("n"),
        F.count_if(bits.bitwiseAND(F.lit(m)) == 0).alias("n_kept"),
        F.bit_or(bits).alias("failed_anywhere"),
        F.bit_and(bits).alias("failed_everywhere"),
    ]
    out += [F.count_if(bits.bitwiseAND(F.lit(m & ~bit(r))) == 0).alias(f"kept_without_{r}") for r in POLICIES[policy]]
    return entries.groupBy(*(by or [])).agg(*out)
