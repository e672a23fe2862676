"""Queries for readability."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.operators import text as X
from marketlens.plans import views as v
from marketlens.plans.registry import query, shape

_SP = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_WORD = r"[A-Za-z][A-Za-z’''\-]*|\p{Nd}[\p{Nd},.]*"


def _syl(c: str) -> str:
    w = f"regexp_replace(lower({c}), '[^a-z]', '', 'g')"
    n = f"len(regexp_extract_all({w}, '[aeiouy]+'))"
    return f"(CASE WHEN {w} = '' THEN 0 ELSE greatest({n} - CASE WHEN {w} LIKE '%e' AND {w} NOT LIKE '%le' AND {n} > 1 THEN 1 ELSE 0 END, 1) END)"


def _counts_sql(src: str, key: str, body: str, markup: bool) -> str:
    c = body
    if markup:
        c = f"regexp_replace({c}, '(?is)<!--.*?-->|<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>', ' ', 'g')"
        c = f"regexp_replace(regexp_replace({c}, '\\$\\{{[^}}]*\\}}', '', 'g'), '<[^>]+>', ' ', 'g')"
        for name, code in (("quot;", 34), ("copy;", 169), ("middot;", 183), ("amp;", 1), ("amp", 38)):  # those that the pages use
            c = f"replace({c}, '&{name}', chr({code}))"
        c = f"replace({c}, chr(1), '&')"
    return f"""cl AS (SELECT {key}, trim(regexp_replace({c}, '{_SP}', ' ', 'g')) AS t FROM {src}),
sp AS (SELECT {key}, t, list_filter(string_split(regexp_replace(t, '([.!?])[ ]+([A-Z0-9"“‘])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x) <> '') AS k FROM cl),
se AS (SELECT {key}, CASE WHEN len(k) > 0 THEN k ELSE [t] END AS ss FROM sp),
st AS (SELECT {key}, len(ss) AS n_sent, unnest(ss) AS s FROM se),
wl AS (SELECT {key}, n_sent, regexp_extract_all(s, '{_WORD}') AS w FROM st),
wd AS (SELECT {key}, n_sent, unnest(w) AS tok, generate_subscripts(w, 1) AS i FROM wl),
ws AS (SELECT *, {_syl('tok')} AS syl, regexp_matches(tok, '^[A-Z]') AND i > 1 AS proper, regexp_replace(tok, '(es|ed|ing)$', '') AS stem FROM wd),
fx AS (SELECT *, CASE WHEN syl >= 3 AND tok LIKE '%-%' THEN len(list_filter(string_split(tok, '-'), lambda p: p <> '' AND {_syl('p')} >= 3)) = 0 ELSE false END AS compound, stem <> tok AND {_syl('stem')} < 3 AS inflected FROM ws),
cnt AS (SELECT {key}, max(n_sent)::BIGINT AS n_sent, count(*) AS n_words, sum(syl)::BIGINT AS n_syll, sum(length(regexp_replace(tok, '[^A-Za-z\\p{{Nd}}]', '', 'g')))::BIGINT AS n_chars, count(*) FILTER (WHERE syl >= 3) AS poly_all,
  count(*) FILTER (WHERE syl >= 3 AND NOT proper) AS poly_no_proper, count(*) FILTER (WHERE syl >= 3 AND NOT proper AND NOT compound AND NOT inflected) AS fog_complex FROM fx GROUP BY 1)"""


def _score_sql(src: str, keys: str) -> str:
    return f"""sc AS (SELECT {keys}, n_sent, n_words, n_syll, n_chars, poly_all, poly_no_proper, fog_complex, 0.39e0 * (n_words / n_sent) + 11.8e0 * (n_syll / n_words) - 15.59e0 AS fk, 206.835e0 - 1.015e0 * (n_words / n_sent) - 84.6e0 * (n_syll / n_words) AS ease,
 1.0430e0 * sqrt(poly_all * 30e0 / n_sent) + 3.1291e0 AS smog, 1.0430e0 * sqrt(poly_no_proper * 30e0 / n_sent) + 3.1291e0 AS smog_np, 0.4e0 * ((n_words / n_sent) + 100e0 * fog_complex / n_words) AS fog,
 4.71e0 * (n_chars / n_words) + 0.5e0 * (n_words / n_sent) - 21.43e0 AS ari FROM {src})"""


_SCORES = ("fk", "ease", "smog", "smog_np", "fog", "ari")
_OUT = ", ".join(f"round({c}, 7) AS {c}" for c in _SCORES)
_ALL = "n_sent, n_words, n_syll, n_chars, poly_all, poly_no_proper, fog_complex, " + _OUT
_SHAPE = {**{c: "long" for c in X.COUNTS}, **{c: 7 for c in _SCORES}}
_DOCS = _counts_sql("documents", "doc_id", "text", False)


@query("x01_readability_documents", v.sql(_DOCS, _score_sql("cnt", "doc_id")) + f"SELECT doc_id, {_ALL} FROM sc")
def _(s, d):
    return shape(X.readability(v.table(s, d, "documents"), "doc_id", "text", markup=False), {"doc_id": "long", **_SHAPE})


@query("x01_readability_pages", v.sql(_counts_sql("pages", "page_id", "html", True), _score_sql("cnt", "page_id")) + f"SELECT page_id, {_ALL} FROM sc")
def _(s, d):
    return shape(X.readability(v.table(s, d, "pages"), "page_id", "html"), {"page_id": "long", **_SHAPE})


def _lang_counts(s, d):
    docs = v.table(s, d, "documents")
    return X.counts(docs, "doc_id", "text", markup=False).join(docs.select("doc_id", "lang", "source"), "doc_id")


_GATES = {"fk": "fk > 9", "ari": "ari > 9", "fog": "fog > 9", "ease": "ease < 60", "smog": "smog > 10"}


@query(
    "x02_gates",
    v.sql(_DOCS, _score_sql("cnt", "doc_id"))
    + "SELECT doc_id, array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _GATES.items())
    + "], lambda x: x IS NOT NULL), ',') AS misses, NOT ("
    + " OR ".join(_GATES.values())
    + ") AS passes FROM sc",
)
def _(s, d):
    g = X.gate(X.readability(v.table(s, d, "documents"), "doc_id", "text", markup=False))
    return g.select("doc_id", F.array_join("misses", ",").alias("misses"), "passes")


@query(
    "x02_gate_report",
    v.sql(_DOCS, _score_sql("cnt", "doc_id"))
    + "SELECT lang, count(*) AS n_docs, count(*) FILTER (WHERE NOT ("
    + " OR ".join(_GATES.values())
    + ")) AS n_pass, "
    + ", ".join(f"count(*) FILTER (WHERE {c}) AS miss_{n}" for n, c in _GATES.items())
    + " FROM sc JOIN documents USING (doc_id) GROUP BY 1",
)
def _(s, d):
    return X.gate_report(X.gate(X.score(_lang_counts(s, d))), ["lang"])


@query(
    "x03_group_readability",
    v.sql(_DOCS)
    + ", gr AS (SELECT source, "
    + ", ".join(f"sum({c})::BIGINT AS {c}" for c in X.COUNTS)
    + " FROM cnt JOIN (SELECT doc_id, source FROM documents) USING (doc_id) GROUP BY 1), "
    + _score_sql("gr", "source")
    + f" SELECT source, {_ALL} FROM sc",
)
def _(s, d):
    return shape(X.group_readability(_lang_counts(s, d), ["source"]), {"source": None, **_SHAPE})
