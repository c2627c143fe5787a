import random
import tracemalloc
import zlib

import numpy as np
import pytest

from odarel.llm.quality import FEATURES, accepted_rows, features, fit, quality_scores


def corpus(n=600):
    rng = random.Random(3)
    out = []
    for i in range(n):
        w = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(rng.randint(5, 120))]
        good = rng.random() < 0.7
        if not good:
            w = rng.choice([[x + "***" for x in w], [x.upper() + "!!" for x in w], w[:4] * (len(w) // 2), " | ".join(w).split(" ")])
        out.append((i, " ".join(w), int(good)))
    return out


@pytest.fixture(scope="module")
def data(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en", 9) for i, t, _ in rows], "doc_id long, text string, lang string, score int")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    return docs, labels, {i: q for i, _, q in rows}


def test_held_out_accuracy(data):
    docs, labels, truth = data
    got = quality_scores(docs, labels).collect()
    assert len(got) == len(truth)
    out = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in out} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in out) / len(out) > 0.97


def test_held_out_labels_do_not_matter(data, spark):
    docs, labels, truth = data
    flipped = spark.createDataFrame([(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q) for i, q in truth.items()], "doc_id long, quality int")
    a, b = ({r["doc_id"]: r["score"] for r in quality_scores(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_accepts_what_it_predicts(data):
    docs, labels, _ = data
    kept = accepted_rows(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in quality_scores(docs, labels).filter("predicted = 1").collect()}


def test_odd_rows(spark, data):
    _, labels, _ = data
    rows = [(1, None), (2, ""), (None, "a b"), (3, "long words " * 30_000), (3, "x"), (3, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = quality_scores(docs, labels).collect()
    assert len(got) == 6 and len({r["score"] for r in got if r["doc_id"] in (1, 2)}) == 1
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    assert {r["score"] for r in quality_scores(docs, none).collect()} == {0.5}
    assert quality_scores(docs.filter("false"), labels).count() == 0
    assert accepted_rows(docs, none).count() == 6


def test_features():
    assert features(None) == features("  \n") == [0.0] * len(FEATURES)
    assert len(features("Some words, here.")) == len(FEATURES)


def test_memory_of_a_fit():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 8_000)
    x = rng.random((8_000, len(FEATURES)), np.float32)
    x[:, 3] += 0.5 * y
    tracemalloc.start()
    try:
        model = fit(x, y)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 4 * x.nbytes  # 35 MB; the differences of 40,000 pairs alone are 89 MB
    assert np.mean([(model.score(f) >= 0.5) == (t == 1) for f, t in zip(x, y, strict=True)]) > 0.7
