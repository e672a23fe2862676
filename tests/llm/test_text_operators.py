"""Operators on words and tokens against brute force, and their edge cases."""

import hashlib
import random
import sys

import numpy as np
import public_tokenizers
import pytest
from conftest import rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marketlens.llm import bpe, ngram_join, substring
from marketlens.llm.blocks import PARTS, Dealer, block_count, match
from marketlens.llm.registry import QUERIES, load

load()
SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string"


def words(text):
    return (text or "").encode().split()


def texts(seed, n=60, vocab=40, length=90):
    """Small vocabulary, shared passages, exact and near copies, nulls and blanks."""
    r = random.Random(seed)
    pick = lambda k: [f"w{r.randrange(vocab)}" for _ in range(k)]
    passages = [pick(r.randrange(10, 40)) for _ in range(5)]
    out = []
    for i in range(n):
        w = pick(r.randrange(0, length))
        if r.random() < 0.5:
            at = r.randrange(len(w) + 1)
            w[at:at] = r.choice(passages)
        if out and r.random() < 0.4:
            w = [x.decode() for x in words(r.choice(out)[1])]
            for _ in range(r.randrange(3)):
                if w:
                    w[r.randrange(len(w))] = f"x{i}"
        out.append((i * 3, " ".join(w)))
    sep = ["\x0b", "\u00a0", "\x85", " \n\t"]
    out += [(1000 + k, f"a{s}b" * 9) for k, s in enumerate(sep)] + [(2000, None), (2001, ""), (2002, "  \n"), (2003, "one"), (2004, "one two"), (2005, "One two")]
    r.shuffle(out)
    return out


def brute_substring(docs):
    first = {}
    for i, t in docs:
        w = words(t)
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in docs:
        w = words(t)
        gone = {p for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for p in range(k, k + 13)}
        out.append((i, len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode()))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_substring_equals_brute_force(spark, seed):
    docs = texts(seed, vocab=(3, 12, 40, 40)[seed])
    got = substring.dedup(spark.createDataFrame(docs, DOCS).repartition(5))
    assert rows(got, "doc_id", "n_words", "n_removed", "kept") == brute_substring(docs)
    for r in got.collect():
        assert sum(e - s for s, e in zip(r["span_starts"], r["span_ends"], strict=True)) == r["n_removed"]


def test_substring_edges(spark):
    long = " ".join(f"u{i}" for i in range(60_000))
    docs = [(None, long), (5, long), (5, long), (7, "z " + long), (-3, "a b"), (9, None)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, kept string, other long")
    got = {(r["doc_id"], r["n_removed"], r["other"]) for r in substring.dedup(df).collect()}
    assert got == {(None, 0, 1), (5, 0, 1), (7, 60_000, 1), (-3, 0, 1), (9, 0, 1)}
    assert substring.dedup(df).count() == len(docs)
    assert substring.dedup(df.limit(0)).count() == 0


def shingle_set(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_join(docs, n, percent):
    sets = {i: shingle_set(t, n) for i, t in docs}
    comp = {i: i for i in sets}

    def top(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                comp[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), top(i)) for i in ids)


@pytest.mark.parametrize("seed,n,percent", [(1, 3, 90), (2, 5, 80), (3, 2, 50)])
def test_jaccard_equals_brute_force(spark, seed, n, percent):
    docs = texts(seed, n=80)
    got = ngram_join.join(spark.createDataFrame(docs, DOCS).repartition(5), n=n, percent=percent)
    assert rows(got) == brute_join(docs, n, percent)


def test_jaccard_chain_beyond_the_hub(spark):
    """A chain whose ends are far apart links only from neighbour to neighbour."""
    base = [f"w{i}" for i in range(300)]
    docs = []
    for i in range(30):
        docs.append((i, " ".join(base)))
        base[i * 9] = f"y{i}"
    assert rows(ngram_join.join(spark.createDataFrame(docs, DOCS), n=3, percent=90)) == brute_join(docs, 3, 90)


def test_jaccard_edges(spark):
    docs = [(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (6, "A B c d"), (8, None), (9, ""), (10, "a b"), (11, "a  b"), (12, "a b a b")]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, component_id int")
    got = rows(ngram_join.join(df, n=3, percent=90))
    assert got == [(4, 2, 4), (4, 2, 4), (6, 2, 4), (8, 0, 8), (9, 0, 9), (10, 1, 10), (11, 1, 10), (12, 2, 12), (None, 2, None)]
    assert ngram_join.join(df.limit(0)).count() == 0


def test_blocks_grow_with_the_corpus(spark):
    df = spark.range(200).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 1_000_000).alias("text"))
    assert block_count(df) >= 200_000_000 // (4 << 20)


ODD = [
    "",
    " ",
    "İstanbul ΑΣ Σ ΣΑΣ don't I'VE 'Ve <|endoftext|> <|ENDOFTEXT|><|startoftext|>x",
    "a" * 3000,
    "ab" * 2000,
    "ﬁ ½ ²³ ٣ 日本語テスト 😀😀👨‍👩‍👧 \x1c\x1d\x85  ​　x",
    "é Å̊ ß ẞ Ǆ ﻿x İ̇ ſ K ℃ ŉ 'S",
    "!!!???...,,, 's'sx 's &&& \t\r\n 12345 a1b2",
]


def test_bpe_equals_the_library(spark):
    lib = Tokenizer.from_file(PATH)
    lib.no_truncation()
    lib.no_padding()
    docs = [(k, t) for k, t in enumerate(ODD)] + [(-1, None)]
    docs += [(100 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = spark.createDataFrame(docs, DOCS)
    coded = bpe.decode(bpe.encode(df, PATH), PATH)
    for r in coded.collect():
        want = lib.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want, r["text"][:80]
        assert r["decoded"] == lib.decode(want, skip_special_tokens=False)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((r["doc_id"], len(r["ids"]), sha(" ".join(map(str, r["ids"]))), sha(r["decoded"])) for r in coded.collect())
    assert rows(bpe.digests(df, PATH)) == want


def test_round_trip_is_one_process_a_task(spark):
    """The text stays behind, other columns stay, and no second Python step holds memory of its own."""
    df = spark.createDataFrame([(1, "One two", "de"), (2, None, None), (3, "", "en")], "doc_id long, text string, lang string")
    got = bpe.round_trip(df, PATH)
    assert rows(got) == rows(bpe.decode(bpe.encode(df, PATH), PATH).drop("text"))
    assert bpe.digests(df, PATH)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_codec_keeps_bounded_words():
    """Words that never repeat must not fill a worker process."""
    c, r = bpe.Codec(PATH), random.Random(3)
    for _ in range(700):
        c.encode(" ".join("".join(r.choices("aeioulmnrst", k=8)) for _ in range(400)))
    held = sum(sys.getsizeof(x) for kept in (c.young, c.old) for item in kept.items() for x in item) + sum(map(sys.getsizeof, (c.young, c.old)))
    assert 0 < held < 24e6


def test_keyed_match_gives_rows(spark):
    """Unpacked where they are made, not by a second Python step."""

    def emit(batches):
        for b in batches:
            dealer = Dealer(7, keyed=True)
            for key, owner in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                dealer.add(np.array([key], np.uint64), np.array([owner], np.int64), np.array([key], np.int64))
            yield from dealer.flush()

    pairs = [(k, o) for k in range(40) for o in range(k % 5)]
    found = match(spark.createDataFrame(pairs, "key long, owner long").repartition(3).mapInArrow(emit, PARTS), 7, keyed=True)
    assert found.columns == ["key", "hub", "doc"]
    got = {tuple(x) for x in found.collect()}
    assert sorted({(k, o) for k, _, o in got}) == [(k, o) for k, o in pairs if k % 5 > 1]
    assert all((k, hub) in pairs and hub <= o for k, hub, o in got)  # the smallest owner of a task or of all


def test_automaton_equals_merging():
    """Random merges over two letters, where equal neighbours and overlaps abound, against merging step by step."""
    r = random.Random(5)
    for _ in range(40):
        vocab, merges = {"a": 0, "b": 1}, []
        for _ in range(r.randrange(1, 12)):
            pair = (r.choice(list(vocab)), r.choice(list(vocab)))
            if pair[0] + pair[1] not in vocab and len(pair[0] + pair[1]) < 9:
                merges.append(pair)
                vocab[pair[0] + pair[1]] = len(vocab)
        auto, names = bpe.Automaton(vocab, merges), {i: t for t, i in vocab.items()}
        for _ in range(60):
            word = "".join(r.choice("ab") for _ in range(r.randrange(1, 25)))
            parts = list(word)
            for a, b in merges:
                out = []
                while parts:
                    x = parts.pop(0)
                    out.append(x + parts.pop(0) if x == a and parts and parts[0] == b else x)
                parts = out
            assert [names[i] for i in auto.word(word)] == parts, (merges, word)


def test_bpe_edges(spark):
    df = spark.createDataFrame([(1, None, 7)], "doc_id long, text string, ids long")
    assert bpe.encode(df, PATH).collect()[0]["ids"] == []
    assert bpe.encode(df.limit(0), PATH).count() == 0


def test_pipeline_query_is_registered():
    from __spark_entry__ import queries

    assert {f"op{n}_" for n in range(1, 14)} <= {name.split("_")[0] + "_" for name in queries()} and "pipeline" in queries()
    assert len(QUERIES) == 13


def test_join_of_a_chain_of_near_copies(spark, monkeypatch):
    """A large group whose members link along chains only, and exact copies of one text: every link is found."""
    monkeypatch.setattr(ngram_join, "LARGE", 6)
    monkeypatch.setattr(ngram_join, "HUBS", 2)
    r = random.Random(11)
    base = [f"b{k}" for k in range(120)]
    docs = []
    for i in range(90):
        if i % 30 == 0:
            base = [f"{w}" if r.random() < 0.9 else f"c{i}.{k}" for k, w in enumerate(base)]
        at = r.randrange(len(base))
        base = base[:at] + [f"n{i}"] + base[at + 1 :]
        docs.append((i * 2, " ".join(base)))
    docs += [(1000 + i, docs[40][1]) for i in range(60)] + [(None, docs[40][1]), (2000, "")]
    r.shuffle(docs)
    df = spark.createDataFrame(docs, DOCS)
    for n, percent in ((3, 90), (5, 80)):
        want = sorted((i, s, c) for i, s, c in brute_join([d for d in docs if d[0] is not None], n, percent))
        got = sorted(tuple(x) for x in ngram_join.join(df, n=n, percent=percent).where("doc_id IS NOT NULL").collect())
        assert got == want and 1 < len({c for _, _, c in want}) < 120


def test_small_components_stay_in_few_tasks(spark):
    """A few edges make a few files a round, whatever the session's number of shuffle partitions."""
    names = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, x in names.items():
            spark.conf.set(k, x)
        comp = ngram_join.components(spark.createDataFrame([(i, i + 1) for i in range(1, 9)], "a long, b long"))
        assert comp.rdd.getNumPartitions() <= 8
        assert rows(comp) == [(i, 1) for i in range(1, 10)]
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)
