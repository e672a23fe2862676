"""Quality classifier: hierarchical empirical Bayes over document, path and host.

A document's evidence is the log likelihood ratio of its binned measurements under good and bad labels (naive
Bayes). Sites carry their own rates: labelled documents count in full, others as far as their evidence speaks.
Host rates shrink toward the global rate and path rates toward their host's, each with a strength that the spread
between hosts (between the paths of hosts) implies, so sparse sites stay near what is above them. The score is
the path's posterior odds, without the document's own share, times the document's evidence. Everything is
columns and grouped sums; only a handful of scalars and the table of bins (under 100 rows) reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.rules import measure
from marketlens.session import cut

#: What an unlabelled document counts for in its site's rate.
SOFT = 0.2
#: Bounds of a level's strength, in documents.
WEAKEST, STRONGEST = 1.0, 1e4
#: Largest size of a document's evidence in log odds.
MOST_EVIDENCE = 12.0


def bins() -> dict[str, Column]:
    """Measurements cut to fewer than 100 bins in all."""
    per = lambda top, bottom, k, most: F.least(F.floor(F.lit(float(k)) * F.col(top) / F.greatest(F.col(bottom), F.lit(1))), F.lit(most)).cast("int")
    return {
        "words": F.least(F.floor(F.log2(F.col("n_words") + 1)), F.lit(16)).cast("int"),
        "symbols": F.when(F.col("n_symbols") == 0, F.lit(-1)).otherwise(per("n_symbols", "n_words", 10, 10)),
        "repeats": per("n_repeat_words", "n_words", 10, 10),
        "lines": per("n_dup_lines", "n_lines", 10, 10),
        "length": per("word_chars", "n_words", 2, 30),
    }


def _bin_keys() -> Column:
    return F.array(*[F.concat(F.lit(f"{name}:"), c.cast("string")) for name, c in bins().items()])


def _strength(groups: DataFrame, rate: Column, mean: Column) -> float:
    """Beta strength from the spread of group rates (g of n) round ``mean``, by moments; one row to the driver."""
    n, m = F.col("n"), mean
    row = groups.where(n > 0).agg(
        F.sum(n).alias("n"), F.sum(n * n).alias("nn"), F.sum(n * (rate - m) * (rate - m)).alias("ss"), F.sum(m * (1 - m)).alias("within"), F.sum(n * m * (1 - m)).alias("v")
    ).first()
    if not row["n"] or row["n"] * row["n"] <= row["nn"]:
        return WEAKEST
    spread = (row["ss"] - row["within"]) / (row["n"] - row["nn"] / row["n"])
    variance = row["v"] / row["n"]
    if spread <= variance / STRONGEST:
        return STRONGEST
    return float(min(STRONGEST, max(WEAKEST, variance / spread - 1)))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, host, path, evidence, host_rate, path_rate, score (chance that it is good) and kept.

    ``labels`` has doc_id and quality (1 good, 0 bad); null ids and labels are ignored, an id with two labels counts
    by their mean. Null hosts are one host and null paths one path of their host. A null text measures as empty.
    Without labels of both kinds there is no evidence and every score is the prior, one half if there is none.
    """
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").cast("double").alias("good"))
    site = docs.select(F.col(id_col).alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col(text_col).alias("text"))
    sites = F.struct("doc_id", "host", "path")
    measured = measure(site.select(sites.alias("site"), "text"), "site", "text").select(F.col("doc_id.doc_id"), F.col("doc_id.host"), F.col("doc_id.path"), _bin_keys().alias("bins"))
    rows = cut(measured.join(marks, "doc_id", "left"))
    seen = rows.where("good IS NOT NULL").select(F.explode("bins").alias("bin"), "good").groupBy("bin").agg(F.sum("good").alias("g"), F.sum(1 - F.col("good")).alias("b"))
    counts = seen.collect()  # fewer than 100 rows
    g_all, b_all = (sum(r[k] for r in counts if r["bin"].startswith("words:")) for k in ("g", "b"))
    if g_all > 0 and b_all > 0:
        ratio = {r["bin"]: ((r["g"] + 0.5) / (g_all + 5)) / ((r["b"] + 0.5) / (b_all + 5)) for r in counts}
        table = F.create_map(*[F.lit(x) for kv in sorted(ratio.items()) for x in kv])
        evidence = F.aggregate(F.transform("bins", lambda k: F.coalesce(F.log(table[k]), F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    else:
        evidence = F.lit(0.0)
    evidence = F.greatest(F.least(evidence, F.lit(MOST_EVIDENCE)), F.lit(-MOST_EVIDENCE))
    prior = min(1 - 1e-3, max(1e-3, (g_all + 1) / (g_all + b_all + 2)))
    told = 1 / (1 + F.exp(-(F.col("evidence") + F.log(F.lit(prior / (1 - prior))))))
    rows = rows.withColumn("evidence", evidence)
    own_n = F.when(F.col("good").isNotNull(), F.lit(1.0)).otherwise(F.lit(SOFT))
    rows = rows.withColumn("own_n", own_n).withColumn("own_g", F.col("own_n") * F.coalesce("good", told))
    paths = cut(rows.groupBy("host", "path").agg(F.sum("own_g").alias("g"), F.sum("own_n").alias("n")))
    hosts = paths.groupBy("host").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))
    total = hosts.agg(F.sum("g").alias("g"), F.sum("n").alias("n")).first()
    mean = total["g"] / total["n"] if total["n"] else 0.5
    k_host = _strength(hosts, F.col("g") / F.col("n"), F.lit(mean))
    hosts = hosts.select("host", F.col("g").alias("hg"), F.col("n").alias("hn"), ((F.col("g") + k_host * mean) / (F.col("n") + k_host)).alias("host_rate"))
    p, h = paths.alias("p"), hosts.alias("h")
    both = p.join(h, F.col("p.host").eqNullSafe(F.col("h.host"))).select("p.*", "host_rate")
    k_path = _strength(both, F.col("g") / F.col("n"), F.col("host_rate"))
    r, b = rows.alias("r"), both.alias("b")
    joined = r.join(b, F.col("r.host").eqNullSafe(F.col("b.host")) & F.col("r.path").eqNullSafe(F.col("b.path")), "left")
    rate = (F.col("b.g") - F.col("own_g") + k_path * F.col("host_rate")) / (F.col("b.n") - F.col("own_n") + k_path)
    rate = F.greatest(F.least(rate, F.lit(1 - 1e-6)), F.lit(1e-6))
    score = 1 / (1 + F.exp(-(F.col("evidence") + F.log(rate / (1 - rate)))))
    return joined.select("doc_id", "r.host", "r.path", "evidence", "host_rate", rate.alias("path_rate"), score.alias("score"), (score >= 0.5).alias("kept"))
