import random

from odarel.llm.jaccard import jaccard_join, least_matches, one_of_each
from tests.llm import brute


def corpus(seed=6):
    rng = random.Random(seed)
    texts = []

    def fresh(n):
        return ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(n)]

    for _ in range(60):
        base = fresh(rng.choice([3, 6, 30, 120, 400]))
        texts.append(base)
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = "changed" + rng.choice("xyz")
            texts.append(copy)
    base = fresh(150)
    for _ in range(120):  # a large group of near copies
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(len(copy))] = rng.choice("uvw") * 7
        texts.append(copy)
    shared = fresh(60)
    texts += [shared + fresh(60) for _ in range(30)]  # a passage that many share
    rng.shuffle(texts)
    return [(i, rng.choice([" ", ", "]).join(t)) for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0, "k") for i, t in rows], "doc_id long, text string, cls int, node string")


def test_equals_brute_force(spark):
    rows = corpus()
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join(frame(spark, rows)).collect())
    assert got == brute.jaccard(rows)


def test_small_blocks(spark, monkeypatch):
    from odarel.llm import graph, jaccard

    rows = corpus(7)
    monkeypatch.setattr(jaccard, "compare_within", lambda *a, **k: graph.compare_within(*a, **k, block_rows=16, block_bytes=1 << 14, least_rows=8))
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join(frame(spark, rows)).collect()) == brute.jaccard(rows)


def test_one_of_each(spark):
    rows = corpus(8)
    df = frame(spark, rows)
    kept = one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c, _ in brute.jaccard(rows)})


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "..."), (4, "Ab cd"), (5, "ab, CD"), (6, "ab cd ef"), (7, "w " * 40_000), (8, "W " * 40_000), (9, "same text here in two rows of one key"), (9, "same text here in two rows of one key"), (None, "ab cd"), (10, "w " * 6)]
    got = {(r["doc_id"], r["n_links"], r["class_id"]) for r in jaccard_join(frame(spark, rows)).collect()}
    assert got == {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 2, 4), (5, 2, 4), (None, 2, 4), (6, 0, 6), (7, 2, 7), (8, 2, 7), (10, 2, 7), (9, 1, 9)}
    assert sorted((r["doc_id"] for r in one_of_each(frame(spark, rows)).collect()), key=repr) == [1, 2, 3, 4, 6, 7, 9]
    twice = [(1, "one text with quite some words"), (1, "another text with other words in it"), (2, "one text with quite some words")]
    assert sorted(r["text"] for r in one_of_each(frame(spark, twice)).collect()) == sorted({t for _, t in twice})
    assert jaccard_join(frame(spark, [])).count() == 0 and one_of_each(frame(spark, [])).count() == 0


def test_pruning_is_safe():
    least = least_matches(0.8, 1e-6)
    assert least == sorted(least) and all(m < 32 * (i + 1) * 0.8 for i, m in enumerate(least))


def test_null_keys_link(spark):
    base = [f"word{i}" for i in range(120)]
    rows = [(None, " ".join(base)), (None, " ".join([*base[:-1], "other"])), (None, " ".join(base)), (None, "quite another text of a few words"), (1, "one more text with its own words")]
    got = jaccard_join(frame(spark, rows)).collect()
    assert sorted(r["n_links"] for r in got) == [0, 0, 2, 2, 2]
    kept = one_of_each(frame(spark, rows)).collect()
    assert len(kept) == 3 and sum(r["text"].startswith("word0") for r in kept) == 1


def test_a_chain_of_loosely_alike_texts_is_no_group(spark, monkeypatch):
    # neighbours have a similarity of 0.5, so that many share a bucket; every tenth text has a near copy
    from odarel.llm import jaccard

    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(9000)]
    rows = [(i, words[i * 30 : i * 30 + 94]) for i in range(280)]
    rows += [(1000 + i, [*rows[i][1][:-1], "changed"]) for i in range(0, 280, 10)]
    rows = [(i, " ".join(w)) for i, w in rows]
    moved = []

    def watched(members, compare, schema, **options):
        if "text" in members.columns:
            moved.append(members.groupBy("comp").count().agg({"count": "max"}).first()[0])
        return compare_within(members, compare, schema, **options)

    compare_within = jaccard.compare_within
    monkeypatch.setattr(jaccard, "compare_within", watched)
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join(frame(spark, rows)).collect())
    assert got == brute.jaccard(rows) and sum(n for _, _, n in got) == 56
    assert moved and moved[0] <= 8


def test_names_that_are_used_inside(spark):
    rows = corpus(9)[:60] + [(None, "a text without a key"), (None, "a text without a key")]
    columns = ["again", "i1", "row", "cls", "first"]
    df = spark.createDataFrame([(i, t, *[n] * 5) for n, (i, t) in enumerate(rows)], "doc_id long, text string, " + ", ".join(f"{c} int" for c in columns))
    out = one_of_each(df)
    assert out.columns == df.columns
    got = out.collect()
    assert sum(r["doc_id"] is None for r in got) == 1 and all(rows[r["i1"]] == (r["doc_id"], r["text"]) for r in got)
    assert {r["doc_id"] for r in got if r["doc_id"] is not None} == {c for _, c, _ in brute.jaccard(rows[:60])}
