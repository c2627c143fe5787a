import random

import pytest

from odarel.llm.sharding import histogram_shards

SCHEMA = "doc_id long, text string, shard string, slot int"


def placed(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], SCHEMA)
    out = histogram_shards(df, **options)
    assert out.columns == ["doc_id", "text", "size", "shard", "slot"]
    return out.collect()


def check(rows, out, shards):
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out) == sorted((i or 0, t or "") for i, t in rows)
    by = {}
    for r in out:
        assert r["size"] == len((r["text"] or "").encode()) + 8
        by.setdefault(r["shard"], []).append(r)
    for s, part in by.items():
        assert 0 <= s < shards and sorted(r["slot"] for r in part) == list(range(len(part)))
    return [sum(r["size"] for r in by.get(s, [])) for s in range(shards)]


@pytest.mark.parametrize("run_rows", [20, 1_000_000])
def test_even_bytes(spark, run_rows):
    rng = random.Random(1)
    rows = [(i, "é" * rng.randint(0, 60)) for i in range(4000)]
    sizes = check(rows, placed(spark, rows, run_rows=run_rows), 24)
    assert max(sizes) - min(sizes) <= 2 * 128


def test_one_text_fills_a_third(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i}") for i in range(3000)]
    sizes = check(rows, placed(spark, rows, run_rows=50), 24)
    assert max(sizes) - min(sizes) <= 40


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "x"), (None, "x"), (3, "y" * 500_000), (3, "y" * 500_000)]
    check(rows, placed(spark, rows), 24)
    assert placed(spark, []) == []
    same = [(1, "a")] * 30
    check(same, placed(spark, same), 24)
    check([(1, "a")], placed(spark, [(1, "a")], shards=1), 1)


@pytest.mark.parametrize("run_rows", [64, None])
def test_equal_rows_are_dealt_out_evenly(spark, run_rows):
    same = [(1, "a")] * 4800
    sizes = check(same, placed(spark, same, run_rows=run_rows), 24)
    assert max(sizes) - min(sizes) <= 9
    hot = [(None, None)] * 2000 + [(i, f"text {i % 7}") for i in range(3000)] + [(5, "b")] * 1000
    sizes = check(hot, placed(spark, hot, run_rows=run_rows), 24)
    assert max(sizes) - min(sizes) <= 40
