import random

import numpy as np

from odarel.llm.decontaminate import clean_rows, contamination, winnow
from odarel.llm.words import gram_hashes, text_hashes
from tests.llm import brute


def data(spark, seed=5):
    rng = random.Random(seed)
    vocab = ["the", "Of", "and", "é", "zu", "9", "x1", "日本", "a"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 2, 5, 9, 10, 11, 30])))) for i in range(30)]
    items += [(30, None), (31, ""), (32, "..."), (3, "a second text of the third item with more than ten words in it"), (None, "no name at all but words enough to make a window here")]
    docs = []
    for i in range(300):
        w = rng.choices(vocab, k=rng.randint(0, 80))
        if i % 4 == 0:
            w[3:3] = (rng.choice(items)[1] or "").split()
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(w)))
    docs += [(300, None), (301, ""), (None, items[-1][1].upper()), (302, items[5][1]), (302, items[5][1]), (303, "the of " * 50_000)]
    return docs, items, spark.createDataFrame([(i, t, "q") for i, t in docs], "doc_id long, text string, items string"), spark.createDataFrame(items, "item_id long, text string")


def test_equals_brute_force(spark):
    docs, items, d, b = data(spark)
    want = sorted(((k, n, h, w) for k, n, h, w in brute.contamination(docs, [("" if i is None else i, t) for i, t in items])), key=repr)
    for size in (1 << 25, 300):
        got = [(r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), list(r["items"])) for r in contamination(d, b, block_bytes=size).collect()]
        assert sorted(got, key=repr) == want
    clean = clean_rows(d, b)
    assert clean.columns == d.columns
    assert sorted(repr(r["doc_id"]) for r in clean.collect()) == sorted(repr(k) for k, _, h, _ in want if not h)


def test_empty_tables(spark):
    _, _, d, b = data(spark)
    assert contamination(d.filter("false"), b).count() == 0
    assert contamination(d, b.filter("false")).filter("size(spans) > 0 or size(items) > 0").count() == 0
    assert clean_rows(d, b.filter("false")).count() == d.count()


def test_winnowing_keeps_every_shared_span():
    rng = np.random.default_rng(0)
    for _ in range(200):
        span = rng.integers(0, 5, 10, dtype=np.uint64)
        a, b = (np.concatenate([rng.integers(0, 5, rng.integers(0, 30), dtype=np.uint64), span, rng.integers(0, 5, rng.integers(0, 30), dtype=np.uint64)]) for _ in range(2))
        ga, gb = gram_hashes(a, 5), gram_hashes(b, 5)
        assert set(ga[winnow(ga)]) & set(gb[winnow(gb)])


def test_words(monkeypatch):
    from odarel.llm import words

    texts = ["", "Ab1 c-d_É ß\x00z", "ÀB c", "a　b", "...", "a" * 1000 + " b " * 50]
    plain = [brute.words(x) for x in texts]
    names = sorted({w for x in plain for w in x})
    of = {w: int(text_hashes(w)[0]) for w in names}
    assert len(set(of.values())) == len(names)
    for piece in (1 << 20, 7):
        monkeypatch.setattr(words, "PIECE", piece)
        for x, w in zip(texts, plain, strict=True):
            assert text_hashes(x).tolist() == [of[v] for v in w]
