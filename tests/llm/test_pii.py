"""Personal data: base spans against the plain patterns, estimation against planted reliabilities, and whole results."""

import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marketlens.llm import pii

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in doubled) % 10 == 0


def plain(text):
    only = lambda s: re.sub(r"[^0-9]", "", s)
    good = {
        "email": lambda s: True,
        "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda s: 16 <= len(only(s)) <= 19 and plain_luhn(only(s)),
        "phone": lambda s: 8 <= len(only(s)) <= 15,
    }
    return [[m.span() for m in PLAIN[k].finditer(text) if good[k](m.group())] for k in pii.KINDS]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(alphabet="a@.-% ", max_size=40), st.text(alphabet="0159 -.", max_size=60), st.text(alphabet="+12 ().-", max_size=40), st.text(max_size=30)))
def test_base_spans_are_the_plain_patterns(text):
    assert pii.base_spans(text) == plain(text)


def test_base_spans_of_the_given_texts(spark):
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    assert [pii.base_spans(t) for t in texts] == [plain(t) for t in texts]
    assert all(sum(len(plain(t)[k]) for t in texts) > 0 for k in range(4))


@pytest.mark.parametrize("text", ["9" * 400_000, "a" * 400_000 + "@", "1." * 200_000, "+1(" + "(" * 400_000, "x@" + "a-" * 200_000, "a@" * 50_000, "0 " * 200_000])
def test_time_goes_by_length(text):
    start = time.time()
    pii.candidates(text, pii.base_spans(text))
    assert time.time() - start < 5


def test_candidates_do_not_overlap_base_spans():
    r = random.Random(2)
    for _ in range(3000):
        text = "".join(r.choice(["+", "1", "23", "4567", "(", ")", " ", "-", ".", "@", "a", "[at]", "b.c"]) for _ in range(30))
        base = pii.base_spans(text)
        got = pii.candidates(text, base)
        loose = [c for c in got if not c.base]
        own = [c for c in got if c.base]
        assert sorted((c.kind, c.start, c.end) for c in own) == sorted((k, *s) for k, spans in enumerate(base) for s in spans)
        assert not any(a.start < b.end and b.start < a.end for a in loose for b in own)
        assert all(a.end <= b.start for a, b in zip(loose, loose[1:], strict=False))
        for c in got:
            kinds, votes, bits = pii.decode(np.array([pii.encode(text, c)]))
            assert kinds[0] == c.kind and 0 <= pii.encode(text, c) < pii.PATTERNS
            shown = text[c.start : c.end]
            assert votes[0].tolist() == [f(text, shown, re.sub(r"[^0-9]", "", shown), c) for f in pii.LABELERS]


def test_reliabilities_are_recovered():
    """Five independent labelers with known rates: the estimates come near, and so do the posteriors."""
    r = np.random.default_rng(3)
    truth = r.random(40_000) < 0.3
    right, abstain = [0.95, 0.9, 0.8, 0.85, 0.7], [0.0, 0.3, 0.2, 0.5, 0.1]
    votes = np.zeros((len(truth), 5), np.int64)
    for j in range(5):
        says = np.where(r.random(len(truth)) < right[j], truth, ~truth)
        votes[:, j] = np.where(r.random(len(truth)) < abstain[j], 0, np.where(says, 1, -1))
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    share, table, p = pii.reliabilities(patterns, counts.astype(float))
    assert abs(share - 0.3) < 0.02
    for j in range(5):
        assert table[1, j, 2] == pytest.approx(right[j] * (1 - abstain[j]), abs=0.03)
        assert table[0, j, 0] == pytest.approx(right[j] * (1 - abstain[j]), abs=0.03)
    assert ((p[at.ravel()] > 0.5) == truth).mean() > 0.95


def test_classifier_reaches_the_least_loss():
    r = np.random.default_rng(4)
    x = np.concatenate([np.ones((200, 1)), r.integers(0, 2, (200, 3))], axis=1).astype(float)
    p, n = r.random(200), r.integers(1, 9, 200).astype(float)

    def loss(w):
        z = x @ w
        return (n * (np.logaddexp(0, z) - p * z)).sum() / n.sum() + 0.5e-2 * (w @ w) / len(w)

    w = pii.logistic(x, p, n)
    assert all(loss(w) <= loss(w + d) + 1e-12 for d in 1e-3 * r.standard_normal((50, 4)))


def card(prefix, r):
    d = prefix + "".join(str(r.randrange(10)) for _ in range(15 - len(prefix)))
    return next(d + c for c in "0123456789" if plain_luhn(d + c))


def corpus(seed=7, n=400):
    r = random.Random(seed)
    out = []
    for k in range(n):
        w = [f"w{r.choice('abcdefgh')}" for _ in range(30)]
        what = [
            f"mail ann{k}@site.example.org",
            "call +1 (621) 555-4974",
            "server 45.116.239.51",
            f"card {card('4', r)}",
            f"write to bob{k} (at) site (dot) com",
            f"token={r.randrange(10**15, 10**16)}x",
            "on 2020-01-15",
            "phone (621) 555-4974",
        ][k % 8]
        w.insert(r.randrange(len(w)), what)
        out.append((k, " ".join(w), "own"))
    return out


def test_more_spans_are_found_and_base_ones_stay(spark):
    rows = [*corpus(), (9000, None, "n"), (9001, "", "e"), (9001, "", "e"), (None, "mail x@y.org", "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    model = pii.fit(df)
    got = pii.find(df, model)
    assert got.columns == ["doc_id", "text", *pii.FOUND] and got.count() == len(rows)
    spelt = clean = 0
    for x in got.collect():
        text = x["text"] or ""
        base = [f"{k}:{a}:{b}" for k, spans in zip(pii.KINDS, plain(text), strict=True) for a, b in spans]
        assert x["base_spans"] == ",".join(base)
        assert [x["n_email"], x["n_ip"], x["n_card"], x["n_phone"]] == [len(s) for s in plain(text)]
        spans = x["spans"].split(",") if x["spans"] else []
        assert set(base) <= set(spans)
        order = [(pii.KINDS.index(s.split(":")[0]), int(s.split(":")[1])) for s in spans]
        assert order == sorted(order)
        if x["doc_id"] is not None and x["doc_id"] < 9000:
            spelt += x["doc_id"] % 8 == 4 and any(text[int(s.split(":")[1]) : int(s.split(":")[2])].endswith("(dot) com") for s in spans)
            clean += x["doc_id"] % 8 in (5, 6) and not spans
    assert spelt >= 45 and clean >= 95
    again = pii.find(df.repartition(5), pii.fit(df.repartition(3)))
    assert sorted(map(str, again.select("doc_id", "spans").collect())) == sorted(map(str, got.select("doc_id", "spans").collect()))


def test_empty_table_and_no_candidates(spark):
    df = spark.createDataFrame([(1, "no data here")], "doc_id long, text string")
    for part in (df, df.limit(0)):
        model = pii.fit(part)
        assert [tuple(x)[2:] for x in pii.find(part, model).collect()] == [(0, 0, 0, 0, "", "")] * part.count()
    # A model that never saw a kind accepts nothing of it beyond the base spans.
    other = spark.createDataFrame([(1, "phone (621) 555-4974 or card 1234567890123456")], "doc_id long, text string")
    assert pii.find(other, pii.fit(df)).select(F.col("spans")).first()[0] == ""
