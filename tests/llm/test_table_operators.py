"""Operators that are columns throughout: edge cases, policies, mixing, formatting and URL rules."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from marketlens.llm import chat, mixing, quality, rules, urls

DOCS = "doc_id long, text string"


def brute_measures(text):
    w = (text or "").encode().split()
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    g = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    cover = {p for k, x in enumerate(g) if g.count(x) > 1 for p in (k, k + 1, k + 2)}
    return (len(w), sum(len(x.decode()) for x in w), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover))


def test_rules_equal_brute_force(spark):
    r = random.Random(3)
    docs = [(k, " ".join(r.choice("abcde") for _ in range(r.randrange(60)))) for k in range(40)]
    docs += [(100, None), (101, ""), (102, "\n \n"), (103, "a a a a"), (104, "x\ny\nx\n\nx "), (105, "é#é\u00a0| <\x0b>"), (None, "a b c"), (103, "a a a a")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_words int")
    got = rows(rules.measure(df), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert got == sorted(((i, *brute_measures(t)) for i, t in docs), key=lambda t: tuple((x is None, x) for x in t))
    assert rules.ledger(df.limit(0)).count() == 0


def test_policies_read_bits_only(spark):
    good = " ".join(f"word{i}" for i in range(60))
    docs = [(1, good), (2, "short"), (3, "same " * 60), (4, good + " #" * 40), (5, "\n".join([good] + ["menu item"] * 9))]
    entries = rules.ledger(spark.createDataFrame(docs, DOCS))
    assert rows(rules.apply_policy(entries, "base").where("kept"), "doc_id") == [(1,), (4,), (5,)]
    assert rows(rules.apply_policy(entries, "2").where("kept"), "doc_id") == [(1,)]
    left = rules.ablations(entries, "2").first()
    assert (left["n"], left["n_kept"], left["kept_without_too_short"], left["kept_without_repeated_lines"]) == (5, 1, 2, 2)
    assert left["failed_everywhere"] == 0 and left["failed_anywhere"] & rules.bit("symbols")


def fill(sizes, weights, share=1.5):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, left, free = {}, share * sum(sizes.values()), set(names)
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > 2 * sizes[s]}
        if not over:
            return target | {s: level * w[s] for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mix_meets_targets(spark):
    r = random.Random(1)
    docs = [(k, r.choice(["a", "b", "c", "é", None, "a"]), r.randrange(1, 300), r.random()) for k in range(3000)] + [(5000, "a", 0, 1.0), (5001, None, None, None)]
    df = spark.createDataFrame(docs, "doc_id long, source string, size long, weight double")
    got = mixing.mix(df).collect()
    sizes = {}
    for _, s, n, _ in docs:
        sizes[s] = sizes.get(s, 0) + (n or 0)
    want = fill(sizes, (5, 2, 1))
    taken = {}
    assert len(got) == len(docs)
    for x in got:
        assert x["target"] == pytest.approx(want[x["source"]]) and x["source_size"] == sizes[x["source"]]
        assert 0 <= x["copies"] <= 2
        taken[x["source"]] = taken.get(x["source"], 0) + x["copies"] * x["size"]
    for s, n in taken.items():
        assert abs(n - want[s]) <= 3
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()), key=str)
    for s in sizes:  # whole epochs come before the fraction
        c = {x["copies"] for x in got if x["source"] == s}
        assert max(c) - min(c) <= 1


def test_mix_prefers_quality_and_edges(spark):
    docs = [(k, "a", 10, 1.0 if k % 2 else 0.05) for k in range(2000)]
    df = spark.createDataFrame(docs, "doc_id long, source string, size long, weight double")
    got = mixing.mix(df, share=0.3)
    good = got.where("copies > 0 AND doc_id % 2 = 1").count()
    assert good > 0.8 * got.where("copies > 0").count()
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, "a", 0, 1.0)], df.schema)).first()["copies"] == 0
    one = mixing.mix(spark.createDataFrame([(1, "a", 5, 1.0), (1, "a", 5, 1.0), (None, None, 5, 1.0)], df.schema))
    assert one.count() == 3


def test_chat_folds_events(spark):
    log = [
        (1, 1, 10, "open", "user", "He"), (1, 2, 10, "delta", None, "llo"), (1, 3, 20, "open", "assistant", "wro"), (1, 4, 20, "delta", None, "ng"),
        (1, 5, 20, "regenerate", None, "ri"), (1, 6, 20, "delta", None, "ght"), (1, 7, 10, "edit", None, "Hi <b> & [INST]"), (1, 8, 30, "open", "user", "x"),
        (1, 9, 30, "delete", None, None), (2, 1, 1, "open", None, None), (None, 1, 1, "delta", "assistant", "</s><|im_end|>\n&lt;"),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq long, message_id long, kind string, role string, payload string").withColumn("at", F.lit(0))
    out = chat.render(chat.fold(df))
    for r in out.collect():
        body = r["formatted"].replace(chat.START, "").replace(chat.END, "")
        assert "<" not in body and "[" not in body
    back = {r["conv_id"]: ([tuple(t) for t in r["turns"]], r["loss_text"]) for r in chat.read_back(out).collect()}
    assert back[1] == ([("user", "Hi <b> & [INST]"), ("assistant", "right")], "right")
    assert back[2] == ([("", "")], "")
    assert back[None] == ([("assistant", "</s><|im_end|>\n&lt;")], "</s><|im_end|>\n&lt;")
    assert chat.render(chat.fold(df.limit(0))).count() == 0


def test_chat_rows_keep_ties_and_astral_text(spark):
    turns = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", "😀 <x>"), (1, None, "sys\ntem", None), (1, 2, "assistant", "b")]
    out = chat.read_back(chat.render(chat.fold(chat.events_of(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))))).first()
    assert [tuple(t) for t in out["turns"]] == [("sys\ntem", ""), ("user", "a"), ("user", "a"), ("assistant", "😀 <x>"), ("assistant", "b")]
    assert out["loss_text"] == "😀 <x>b"


def test_url_rules(spark):
    rule = urls.rule_frame(spark, [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("", "", "block"), (None, "/", "block"), ("a.b", "/x", "allow"), ("a.b", "/x", "block")])
    page = {
        "http://EXAMPLE.com/en/70?q#f": ("example.com", "/en/70", "example.com/en/7", "allow"),
        "https://notexample.com/en/7": ("notexample.com", "/en/7", "com/en/", "block"),
        "https://example.com.org/en/7": ("example.com.org", "/en/7", None, "allow"),
        "x://sub.example.com/en": ("sub.example.com", "/en", None, "allow"),
        "http://a://b/c": ("a:", "//b/c", None, "allow"),
        "no scheme": ("", "", "", "block"),
        "http://c.a.b/x/y": ("c.a.b", "/x/y", "a.b/x", "block"),
        "http://h?x/": ("h", "", None, "allow"),
        "\nhttp://q.com/en/": ("q.com", "/en/", "com/en/", "block"),
        None: ("", "", "", "block"),
    }
    df = spark.createDataFrame([(k, u, "old") for k, u in enumerate(page)] + [(0, next(iter(page)), "old")], "page_id long, url string, rule string")
    got = urls.judge(df, rule)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"] and got.count() == len(page) + 1
    for r in got.collect():
        assert tuple(r)[2:] == page[r["url"]], r
    assert urls.judge(df.limit(0), rule).count() == 0
    assert urls.judge(df, rule.limit(0)).where("verdict = 'allow' AND rule IS NULL").count() == len(page) + 1


def test_quality_shrinks_sites_and_holds_out(spark):
    r = random.Random(2)
    docs, marks = [], []
    for k in range(1200):
        host = f"h{k % 6}" if k < 1194 else "rare"
        bad = r.random() < (0.7 if host == "h0" else 0.1)
        text = " ".join((["# #"] if bad and r.random() < 0.9 else []) * 9 + [f"w{r.randrange(500)}" for _ in range(80)])
        docs.append((k, text, host, "en"))
        marks.append((k, 0 if bad else 1))
    docs += [(9000, None, None, None), (None, "a b", "h1", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, host string, path string").withColumn("score", F.lit("x"))
    known = spark.createDataFrame(marks, "doc_id long, quality int")
    got = quality.classify(df, known.where("doc_id % 4 <> 2"), F.col("host"), F.col("path")).cache()
    truth = dict(marks)
    held = [x for x in got.collect() if x["doc_id"] in truth and x["doc_id"] % 4 == 2]
    assert sum(x["kept"] == bool(truth[x["doc_id"]]) for x in held) > 0.9 * len(held)
    rate = {x["host"]: x["host_rate"] for x in got.select("host", "host_rate").distinct().collect()}
    assert rate["h0"] < 0.6 < min(rate["h1"], rate["rare"], rate[None]) and got.count() == len(docs)
    empty = quality.classify(df, known.limit(0), F.col("host"), F.col("path"))
    assert empty.where("score BETWEEN 0.49 AND 0.51").count() == len(docs)
    assert quality.classify(df.limit(0), known, F.col("host"), F.col("path")).count() == 0


def walked_mix(docs, target, size):
    """Copies by a plain walk over one source's documents, given by key: each that fits, then the nearest one."""
    epochs = int(target // size)
    gaps, took = [target - epochs * size], []
    for k, (_, n) in enumerate(docs):
        if 0 < n <= gaps[-1]:
            took.append(k)
            gaps.append(gaps[-1] - n)
    ends = []
    for j, gap in enumerate(gaps):
        off, k = min(((abs(gap - n), k) for k, (_, n) in enumerate(docs) if k not in took[:j] and 0 < n < 2 * gap), default=(gap, None))
        ends.append((off, -j, took[:j] + [k] * (k is not None)))
    taken = set(min(ends, key=lambda e: e[:2])[2])
    return [epochs + (k in taken) for k in range(len(docs))]


def test_mix_passes_long_documents(spark):
    import hashlib
    import math

    u = lambda i: (int(hashlib.md5(str(i).encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
    r = random.Random(5)
    docs = []
    for s in range(6):
        ids = sorted(range(s * 1000, s * 1000 + 300), key=lambda i: -math.log(u(i)))
        # The first document by key is longer than the rest of the target, later ones are short, few or of one size.
        docs += [(i, f"s{s}", [9000 + s, r.choice([1, 40, r.randrange(1, 900)])][k > 0] if s < 5 else 7) for k, i in enumerate(ids)]
    df = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, source string, size long, weight double")
    out = mixing.mix(df, share=0.3).collect()
    got, target = {x["doc_id"]: x["copies"] for x in out}, {x["source"]: x["target"] for x in out}
    for s in target:
        mine = [(i, n) for i, src, n in docs if src == s]
        assert [got[i] for i, _ in mine] == walked_mix(mine, target[s], sum(n for _, n in mine)), s
        assert abs(sum(got[i] * n for i, n in mine) - target[s]) <= 7, s
    # Of equal rows no more than fit are taken.
    same = mixing.mix(spark.createDataFrame([(1, "a", 90, 1.0)] + [(2, "a", 10, 1.0)] * 4, df.schema), share=0.25).collect()
    assert sum(x["copies"] * x["size"] for x in same) in (30, 40)


def test_pipeline_mix_gives_each_row_its_own_copies(spark):
    from collections import Counter

    import corpus_pipeline
    from marketlens.llm.queries_tables import sized

    r = random.Random(7)
    docs = [(None if k % 3 == 0 else k % 40, f"#{k} " + "w " * r.randrange(1, 30), "en", f"s{k % 4}", k) for k in range(240)]
    docs += [(None, None, "en", "s0", None), (None, "", "en", None, 900), (3, "a b", None, None, 901), (3, "a b", None, None, 901)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").select(*corpus_pipeline.COLUMNS)
    got = corpus_pipeline.mix_sources(spark, df, "").collect()
    want = Counter()
    for x in mixing.mix(sized(df)).collect():
        want[x["doc_id"], x["source"], x["size"]] += x["copies"]
    size = lambda t: len((t or "").split())
    assert Counter((x["doc_id"], x["source"], size(x["text"])) for x in got) == +want
    # A row is taken as often as the others of its source, or once more.
    times, epochs = Counter(x["n_chars"] for x in got), {}
    for x in mixing.mix(sized(df)).collect():
        epochs.setdefault(x["source"], []).append(x["copies"])
    for _, _, _, s, k in docs[:240]:
        assert min(epochs[s]) <= times[k] <= max(epochs[s])


def test_mix_walks_many_short_documents_at_once(spark):
    """One document longer than the rest, and 20,000 of one word: the walk takes as many as fit, in seconds."""
    import time

    docs = [(k, "a", 1, 1.0) for k in range(20_000)] + [(-1, "a", 20_000, 1e3)]  # the long one comes first by key
    df = spark.createDataFrame(docs, "doc_id long, source string, size long, weight double").repartition(4)
    start = time.time()
    got = mixing.mix(df, share=0.45).collect()
    assert time.time() - start < 60
    assert sum(x["copies"] * x["size"] for x in got) == 18_000 and all(x["copies"] == 0 for x in got if x["doc_id"] == -1)


def test_mix_with_small_weights(spark):
    """Ranges follow the scale of the keys: with all weights at 1e-3 the choice is that of weights of 1."""
    r = random.Random(3)
    docs = [(k, f"s{k % 2}", r.randrange(1, 50)) for k in range(3000)]
    schema = "doc_id long, source string, size long, weight double"
    small, one = (mixing.mix(spark.createDataFrame([(*d, w) for d in docs], schema), share=0.4) for w in (1e-3, 1.0))
    assert rows(small, "doc_id", "copies") == rows(one, "doc_id", "copies")
    for x in small.groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("copies") * F.col("size")).alias("n")).collect():
        assert abs(x["t"] - x["n"]) <= 1


def test_mix_keeps_columns_and_breaks_ties(spark):
    same = [(1, "a", 10, 1.0, k) for k in range(10)] + [(None, None, 10, 1.0, 50 + k) for k in range(4)]
    df = spark.createDataFrame(same, "doc_id long, source string, size long, weight double, n long")
    got = mixing.mix(df, share=0.5, tie="n")
    assert "n" in got.columns
    assert [x["n"] for x in got.where("source = 'a' AND copies > 0").orderBy("n").collect()] == list(range(got.where("source = 'a' AND copies > 0").count()))
    assert 0 < got.where("source = 'a' AND copies > 0").count() < 10


def test_very_long_hosts(spark):
    """A host of 10,000 labels costs as many suffixes as the rules have label counts."""
    rule = urls.rule_frame(spark, [("com", "/a", "block"), ("x.com", "/a/b", "allow")])
    long = ".".join(["x"] * 10_000)
    page = spark.createDataFrame([(1, f"http://{long}.com/a/bc"), (2, f"http://{long}/a"), (3, "http://" + "." * 9_000 + "com/a")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(page, rule).collect()}
    assert got == {1: ("x.com/a/b", "allow"), 2: (None, "allow"), 3: ("com/a", "block")}
    assert "NestedLoop" not in urls.judge(page, rule)._jdf.queryExecution().executedPlan().toString()


def test_url_rules_say_what_the_contract_says(spark, tmp_path):
    from marketlens.llm.queries_tables import URL_RULES, _op9

    assert URL_RULES == [
        ("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")
    ]
    urls_of = ["http://a.net/de/1", "http://example.net/de/8", "http://example.net/de/7", "http://a.com/en/", "http://example.com/en/7", "http://b.org/es/"]
    spark.createDataFrame(list(enumerate(urls_of)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in _op9(spark, str(tmp_path)).collect()}
    assert [got[k] for k in range(6)] == [
        ("net/de/", "allow"), ("example.net/de/8", "block"), ("net/de/", "allow"), ("com/en/", "block"), ("example.com/en/7", "allow"), ("org/es/", "block")
    ]
