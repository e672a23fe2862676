"""Queries of the operators that are built-in columns throughout, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import chat, mixing, quality, rules, urls
from marketlens.llm.registry import query, table
from marketlens.llm.text import SPACE_CHARS, n_words
from marketlens.llm.toxicity import held_out
from marketlens.session import cut

def quality_weight(text):
    """A document's weight in the mix: the share of its visible characters that are not symbols."""
    seen = F.translate(F.coalesce(text, F.lit("")), SPACE_CHARS, "")
    return F.length(F.translate(seen, rules.SYMBOLS, "")) / F.greatest(F.length(seen), F.lit(1))


def sized(docs: DataFrame) -> DataFrame:
    """What the mix needs to know of each document, written once."""
    return cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), quality_weight(F.col("text")).alias("weight")))


#: Words in DuckDB's SQL.
SQL_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')"

_MIX_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len({SQL_WORDS})::BIGINT AS size,
    length(translate(v, '#*$%&|<>', '')) / greatest(length(v), 1)::DOUBLE AS w
  FROM (SELECT *, regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]', '', 'g') AS v FROM documents)
), k AS (
  SELECT *, -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / greatest(coalesce(w, 0), 1e-6) AS key FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1]::DOUBLE AS wt
  FROM d GROUP BY source
), l AS (
  SELECT *, 2.0::DOUBLE * source_size AS stop,
    (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(2.0::DOUBLE * source_size) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(wt) OVER () - coalesce(sum(wt) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lv
  FROM s WINDOW b AS (ORDER BY 2.0::DOUBLE * source_size / wt, source IS NULL, source)
), t AS (
  SELECT source, source_size,
    CASE WHEN lv * wt >= stop THEN stop ELSE wt * max(CASE WHEN lv * wt < stop THEN lv END) OVER () END AS target
  FROM l
), r AS (
  SELECT k.*, source_size, target, floor(target / nullif(source_size, 0))::BIGINT AS epochs, target - floor(target / nullif(source_size, 0)) * source_size AS rest,
    sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
), g AS (
  SELECT source, any_value(rest) - coalesce(sum(size) FILTER (WHERE upto <= rest), 0) AS gap FROM r GROUP BY source
), f AS (
  SELECT r.source IS NULL AS none, coalesce(r.source, '') AS src, doc_id, size, gap, row_number() OVER (PARTITION BY r.source ORDER BY key, doc_id NULLS FIRST, size) AS rn
  FROM r JOIN g ON r.source IS NOT DISTINCT FROM g.source WHERE upto > rest AND size > 0
), w AS (
  SELECT none, src, 0 AS j, 0::BIGINT AS rn, any_value(gap) AS gap FROM f GROUP BY none, src
  UNION ALL
  SELECT w.none, w.src, w.j + 1, min(f.rn), arg_min(w.gap - f.size, f.rn)
  FROM w JOIN f ON w.none = f.none AND w.src = f.src AND f.rn > w.rn AND f.size <= w.gap GROUP BY w.none, w.src, w.j
), e AS (
  SELECT w.none, w.src, w.j, f.rn, abs(w.gap - f.size) AS off FROM w JOIN f ON w.none = f.none AND w.src = f.src AND abs(w.gap - f.size) < w.gap
  WHERE NOT EXISTS (SELECT 1 FROM w AS t WHERE t.none = f.none AND t.src = f.src AND t.rn = f.rn AND t.j <= w.j)
  UNION ALL SELECT none, src, j, NULL, gap FROM w
), b AS (
  SELECT none, src, j, rn FROM e QUALIFY row_number() OVER (PARTITION BY none, src ORDER BY off, j DESC, rn) = 1
), p AS (
  SELECT none, src, rn FROM b WHERE rn IS NOT NULL UNION ALL SELECT w.none, w.src, w.rn FROM w JOIN b ON w.none = b.none AND w.src = b.src AND w.j BETWEEN 1 AND b.j
), x AS (
  SELECT f.doc_id, f.none, f.src FROM f JOIN p ON f.none = p.none AND f.src = p.src AND f.rn = p.rn
)
SELECT r.doc_id, r.size, coalesce(source_size, 0)::BIGINT AS source_size, target,
  (r.size * (coalesce(epochs, 0) + (upto <= rest OR x.src IS NOT NULL)::INT))::BIGINT AS taken
FROM r LEFT JOIN x ON r.doc_id = x.doc_id AND (r.source IS NULL) = x.none AND coalesce(r.source, '') = x.src
"""


@query("op2_source_mix", _MIX_SQL)
def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(sized(table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op1_quality_classifier")
def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's source is its site and its language the path; a quarter of the labels is held out, as in op7."""
    known = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out(F.col("doc_id")))
    done = quality.classify(table(spark, sf_dir, "documents"), known, F.col("source"), F.col("lang"))
    return done.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "evidence", "host_rate", "path_rate", "score", "kept")


_ESC = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')"
_CHAT_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>') + length(replace({_ESC.format("role")}, chr(10), '&#10;')) + 1 + length({_ESC.format("text")}) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""


@query("op3_chat_format", _CHAT_SQL)
def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    back = chat.read_back(chat.render(chat.fold(chat.events_of(rows))))
    turns = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The rules of the contract: host, path, verdict.
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
#: The SQL states its rules itself and is left as it was: its word for ``net/de/`` is still ``block``, against the contract.
_URL_SQL = """
WITH r AS (SELECT * FROM (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')) AS t(rh, rp, v)), p AS (
  SELECT page_id, url,
    coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages)
SELECT page_id, host, path,
  (SELECT rh || rp FROM r WHERE ('.' || host) LIKE ('%.' || rh) AND starts_with(path, rp) ORDER BY length(rh || rp) DESC LIMIT 1) AS rule,
  coalesce((SELECT v FROM r WHERE ('.' || host) LIKE ('%.' || rh) AND starts_with(path, rp) ORDER BY length(rh || rp) DESC LIMIT 1), 'allow') AS verdict
FROM p
"""


@query("op9_url_filter", _URL_SQL)
def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = urls.judge(pages, urls.rule_frame(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


_RULES_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, {SQL_WORDS} AS w FROM documents
), l AS (
  SELECT doc_id, t, w, [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^ \t\n\x0B\f\r]')] AS lines FROM d
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i+1], w[i+2]) AS c
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), rep AS (
  SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS pos FROM g WHERE c > 1) GROUP BY doc_id
), m AS (
  SELECT l.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[ \t\n\x0B\f\r]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM l LEFT JOIN rep ON l.doc_id = rep.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 40 * n_lines
    OR word_chars > 20 * n_words OR word_chars < 2 * n_words) AS kept
FROM m
"""


@query("op10_quality_rules", _RULES_SQL)
def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = rules.apply_policy(rules.ledger(table(spark, sf_dir, "documents")), "2")
    base = F.col("fail_bits").bitwiseAND(F.lit(rules.mask("base"))) != 0
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (F.col("kept") & ~base).alias("kept")
    )
