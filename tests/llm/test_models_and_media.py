"""Held-out accuracy of the toxicity model, media round trips, and the pipeline against brute force."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_text_operators import brute_join, brute_substring, words
from tokenizers import Tokenizer

from marketlens.llm import media, mixing, toxicity

DOCS = "doc_id long, text string"


def corpus(n=900, seed=4):
    r = random.Random(seed)
    docs, marks = [], []
    for k in range(n):
        w = [f"w{r.randrange(3000)}" for _ in range(r.randrange(5, 200))]
        bad = r.random() < 0.15
        if bad:
            for _ in range(3):
                w[r.randrange(len(w))] = r.choice(["vile", "scumbag", "lowlife", "Vile!"])
        docs.append((k, " ".join(w)))
        marks.append((k, int(bad)))
    return docs, marks


def test_toxicity_on_held_out_rows(spark):
    docs, marks = corpus()
    df = spark.createDataFrame([*docs, (5000, None), (5001, ""), (None, "vile"), (0, docs[0][1])], DOCS).withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([*marks, (None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.train(df, labels.where(~toxicity.held_out(F.col("doc_id"))))
    got = toxicity.score(df, model)
    truth = dict(marks)
    held = [x for x in got.collect() if x["doc_id"] in truth and zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2]
    assert len(held) > 150 and sum(x["predicted"] == truth[x["doc_id"]] for x in held) >= 0.97 * len(held)
    assert got.count() == len(docs) + 4 and got.where("doc_id >= 5000 AND predicted = 1").count() == 0
    assert rows(got, "doc_id", "score") == rows(toxicity.score(df.repartition(3), model), "doc_id", "score")
    assert toxicity.score(df.limit(0), model).count() == 0


def test_toxicity_without_labels_scores_low(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], DOCS)
    model = toxicity.train(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert rows(toxicity.score(df, model), "predicted") == [(0,), (0,)]


def test_negative_risk_is_turned_round():
    """With a prior far above the truth the corrected risk goes negative; the fit stays finite and ranks."""
    p = [np.array([1, 2], np.int32)] * 30
    u = [np.array([1, 2], np.int32)] * 3 + [np.array([3], np.int32)] * 97
    m = toxicity.fit(p, u, 0.5)
    assert np.isfinite(m.bias) and np.isfinite(m.weight).all() and m.weight.sum() > 0


@pytest.mark.parametrize("text", [None, "", "a", "x" * 64, "é" * 33, "long text " * 40_000])
def test_media_round_trip(spark, text):
    df = spark.createDataFrame([(1, text, 5), (2, text, 6)], "doc_id long, text string, media long")
    a, b = media.features(media.store(df)).orderBy("doc_id").collect()
    data = (text or "").encode()
    payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
    assert media.from_wav(bytes(a["media"])) == (media.RATE, payload)
    assert (a["n_bytes"], a["payload_bytes"], a["payload_sha256"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
    assert a["tail_crc32"] == zlib.crc32(payload[-64:])
    assert a["feature"] == b["feature"] and a["tensors"] == b["tensors"]
    t = media.from_tensors(bytes(a["tensors"]))
    assert t.shape[1:] == (media.CHUNK_FRAMES, media.MELS) and len(t) == len(a["tensor_spans"])
    assert media.features(media.store(df.limit(0))).count() == 0


def test_resampling_and_frames_equal_plain_sums():
    r = np.random.default_rng(0)
    x = r.normal(size=500)
    for up, down in ((1, 2), (2, 3), (3, 1)):
        h = media._phases(up, down).T.ravel()
        stuffed = np.zeros(len(x) * up)
        stuffed[::up] = x
        full = np.convolve(stuffed, h)
        n = (len(x) - media.TAPS + 1) * up // down
        want = full[(media.TAPS - 1) * up :][::down][:n]
        assert np.allclose(media.resample(x, up, down)[: len(want)], want)
    payload = bytes(r.integers(0, 256, 200_000, dtype=np.uint8))
    whole, _ = media.log_mel(payload)
    stride, media.STRIDE = media.STRIDE, 1
    try:
        assert np.array_equal(media.log_mel(payload)[0], whole)
    finally:
        media.STRIDE = stride


def test_segments_have_hysteresis():
    e = np.array([0, 0, 5, 1.6, 1.6, 5, 0, 0, 0, 1.6, 0], float)
    assert media.segments(e) == [(2, 6)]
    assert media.segments(np.zeros(4)) == []


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline

    docs, marks = corpus(300)
    docs += [(1000 + i, t + " extra") for i, t in docs[:30]] + [(2000 + i, f"{i} " + " ".join(f"p{j}" for j in range(60)) + f" {i} {i}b") for i in range(8)]
    docs += [(3000, None), (3001, "")]
    full = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in docs]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    model = toxicity.train(df, labels.where(~toxicity.held_out(F.col("doc_id"))))
    kept = {r["doc_id"]: (r["text"], r["source"]) for r in toxicity.score(df, model).where("predicted = 0").collect()}
    comp = {i: c for i, _, c in brute_join([(i, t) for i, (t, _) in kept.items()], 5, 80)}
    kept = {i: v for i, v in kept.items() if comp[i] == i}
    for i, n, gone, left in brute_substring([(i, t) for i, (t, _) in kept.items()]):
        if gone:
            kept[i] = (left, kept[i][1])
            if gone == n:
                del kept[i]
    from marketlens.llm.queries_tables import sized

    plain = spark.createDataFrame([(i, t, s) for i, (t, s) in kept.items()], "doc_id long, text string, source string")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(sized(plain)).collect()}
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, (t, _) in kept.items():
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want += [(i, len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))] * copies[i]
    assert rows(corpus_pipeline.run(spark, str(tmp_path))) == sorted(want)
    assert want and len(kept) < 300 and max(len(words(t)) for t, _ in kept.values()) > 5


def test_risk_and_gradient_equal_plain_sums():
    """The corrected risk by hand, and its gradient by differences, on both sides of the turn."""
    import math

    r = np.random.default_rng(1)
    docs = lambda n: [np.sort(r.choice(6, r.integers(0, 6), replace=False)).astype(np.int32) for _ in range(n)]
    sparse = lambda rows: (np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(x) for x in rows]), len(rows))
    soft = lambda z: math.log1p(math.exp(z))
    turned = set()
    for prior in (0.05, 0.3, 0.5):
        p, u = docs(9), docs(30)
        w, b = r.normal(size=6) * 4, float(r.normal())

        def parts(w, b, p=p, u=u, prior=prior):
            margin = lambda d: sum(w[f] for f in d) + b
            toxic = prior * sum(soft(-margin(d)) for d in p) / len(p)
            clean = sum(soft(margin(d)) for d in u) / len(u) - prior * sum(soft(margin(d)) for d in p) / len(p)
            return toxic, clean

        margins = [np.array([sum(w[f] for f in d) + b for d in rows]) for rows in (p, u)]
        assert toxicity.risk(*margins, prior) == pytest.approx(parts(w, b))
        back = parts(w, b)[1] < -toxicity.SLACK * prior
        turned.add(back)
        goal = lambda w, b: -parts(w, b)[1] if back else sum(parts(w, b))
        h = 1e-6
        want = [(goal(w + h * e, b) - goal(w - h * e, b)) / (2 * h) for e in np.eye(6)] + [(goal(w, b + h) - goal(w, b - h)) / (2 * h)]
        assert np.allclose(toxicity.gradient(w, b, sparse(p), sparse(u), prior), want, atol=1e-6)
    # All margins of the positive documents high, those of the unlabelled ones low: the corrected part is negative.
    p, u, w = [np.array([0], np.int32)] * 3, [np.array([1], np.int32)] * 3, np.array([9.0, -9.0])
    assert toxicity.risk(np.full(3, 9.0), np.full(3, -9.0), 0.5)[1] < -toxicity.SLACK * 0.5
    flipped = toxicity.gradient(w, 0.0, sparse(p), sparse(u), 0.5)
    assert flipped[0] > 0  # as minus the clean part's gradient is; the risk's own would be negative


def test_sample_counts_equal_a_plain_fit(spark):
    """Features counted by Spark and chosen on the driver give the model that fit() gives on all features."""
    docs, marks = corpus(400)
    df = spark.createDataFrame(docs, DOCS)
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    got = toxicity.train(df, labels)
    memo = {}
    bad = {i for i, m in marks if m}
    p = [toxicity.present(t, memo) for i, t in docs if i in bad]
    u = [toxicity.present(t, memo) for i, t in docs if zlib.crc32(str(i).encode()) % 4 != 2]
    share = len(bad) / len(marks)
    want = toxicity.fit(p, u, share - (share * (1 - share) / len(marks)) ** 0.5)
    assert got.feature.tolist() == want.feature.tolist() and np.allclose(got.weight, want.weight) and got.bias == pytest.approx(want.bias)
