import pytest
from pyspark.sql import functions as F

from odarel.llm.mixing import mix, mixed_rows, source_targets

SCHEMA = "doc_id long, text string, source string, size string, taken int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1) for i, t, s in rows], SCHEMA)


def targets(sizes, weights=(1, 2, 3), most=3.0):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, open_, out = float(sum(sizes.values())), set(order), {}
    while True:
        rest = total - sum(out.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return out | share
        out |= {s: most * sizes[s] for s in over}
        open_ -= over


def many(n):
    return [(i, " ".join(["w"] * (1 + (i * 7919) % 97)), "abcde"[i % 5] if i % 3 else "a") for i in range(n)]


@pytest.mark.parametrize("leaf", [2, 16, 256])
def test_near_target_and_bounds(spark, leaf):
    rows = many(3000)
    out = mix(docs(spark, rows), leaf_rows=leaf).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(3000))
    by, sizes = {}, {}
    for r in out:
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        by[r["source"]] = by.get(r["source"], 0) + r["taken"]
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = targets(sizes)
    for s, t in want.items():
        assert abs(by[s] - t) <= 97
        assert {round(r["target"], 6) for r in out if r["source"] == s} == {round(t, 6)}


def test_reruns_agree(spark):
    d = docs(spark, many(500))
    a, b = (sorted(map(tuple, mix(x, leaf_rows=16).collect())) for x in (d, d.repartition(7)))
    assert a == b


def test_targets_stop_at_three_times(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1), ("c", 1), (None, 100), ("z", 0)], "source string, size long")
    got = {r["source"]: r["target"] for r in source_targets(sizes).collect()}
    want = targets({"a": 10, "b": 1, "c": 1, None: 100, "z": 0})
    assert got == pytest.approx(want)


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "one two", None), (4, "one two", None), (None, "x", "b"), (5, "y " * 50_000, "b")]
    out = mix(docs(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["size"]) for r in out) == [(0, 1), (1, 0), (2, 0), (3, 0), (4, 2), (4, 2), (5, 50_000)]
    assert all(r["taken"] == 0 for r in out if r["size"] == 0)
    assert mix(docs(spark, [])).count() == 0
    assert mix(docs(spark, [(1, None, None)])).collect()[0]["target"] == 0


def test_expected_copies(spark):
    # every document's mean over seeds comes near its source's rate
    d = docs(spark, [(i, "w " * (1 + i), "a" if i < 6 else "b") for i in range(12)])
    runs = [mix(d, seed=s).select("doc_id", "copies", (F.col("target") / F.col("source_size")).alias("rate")) for s in range(12)]
    mean = runs[0]
    for r in runs[1:]:
        mean = mean.union(r)
    got = mean.groupBy("doc_id").agg(F.avg("copies").alias("c"), F.first("rate").alias("r")).collect()
    assert sum(abs(r["c"] - r["r"]) for r in got) / len(got) < 0.35


def test_rows(spark):
    rows = [(i, f"text {i} " * (i % 5 + 1), "abc"[i % 3]) for i in range(60)] + [(7, "text 7 " * 3, "b")] * 4
    d = docs(spark, rows)
    out = mixed_rows(d)
    assert out.columns == d.columns
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, mixed_rows(d.repartition(5)).collect()))
    want = {r["source"]: r["target"] for r in mix(d).collect()}
    got = out.collect()
    for s, t in want.items():
        assert abs(sum(len(r["text"].split()) for r in got if r["source"] == s) - t) <= 10
    for r in got:
        assert sum(x["doc_id"] == r["doc_id"] for x in got) <= 3 * sum(i == r["doc_id"] for i, _, _ in rows)


def off_target(out):
    by = {}
    for r in out:
        taken, _ = by.get(r["source"], (0, 0))
        by[r["source"]] = taken + r["taken"], r["target"]
    return {s: abs(taken - t) / t for s, (taken, t) in by.items()}


def test_every_source_is_closed_in_a_full_leaf(spark):
    # small sources beside one of many leaves, and one of two leaves
    def text(i, step):
        return "w " * int(10 ** (1 + (i * step) % 300 / 100))

    rows = [(i, text(i, 7919), f"s{i % 20:02d}") for i in range(1000)] + [(1000 + i, text(i, 104729), "t" if i < 600 else "u") for i in range(900)]
    assert max(off_target(mix(docs(spark, rows)).collect()).values()) < 0.005


def test_one_huge_document_is_made_up_for(spark):
    rows = [(i, "w " * (40 + (i * 7919) % 320), f"s{i % 8}") for i in range(1600)] + [(2000 + i, "w " * (10_000 + 1300 * i), f"s{i}") for i in range(8)]
    assert max(off_target(mix(docs(spark, rows)).collect()).values()) < 0.01


def test_hot_repeated_rows_are_dealt_out(spark):
    # a third of all rows are one row; with a null key and source it is a row like any other
    rows = [(i, "w " * (1 + i % 50), "abc"[i % 3]) for i in range(10_000)]
    for hot in ((7, "w w w", "a"), (None, "w w w", None)):
        out = mix(docs(spark, rows + [hot] * 5000), leaf_rows=64).collect()
        assert len(out) == 15_000 and max(off_target(out).values()) < 0.01
        copies = [r["copies"] for r in out if r["doc_id"] == hot[0] and r["size"] == 3 and r["source"] == hot[2]]
        assert len(copies) >= 5000 and max(copies) - min(copies) <= 1
        kept = mixed_rows(docs(spark, rows + [hot] * 5000), leaf_rows=64)
        rate = next(r["target"] / r["source_size"] for r in out if r["source"] == hot[2])
        n = kept.filter(F.col("doc_id").eqNullSafe(hot[0]) & (F.col("text") == "w w w")).count()
        assert abs(n - 5000 * rate) < 500 and abs(sum(copies) - 5000 * rate) < 500


def test_inclusion_is_nearly_unbiased(spark):
    # 200 sources of equal documents are 200 draws; what a source's last leaf makes up for must not favour a size
    words = [3 + (i * 37) % 180 for i in range(60)]
    rows = [(s * 1000 + i, "w " * w, f"s{s:03d}") for s in range(200) for i, w in enumerate(words)]
    out = mix(docs(spark, rows), weights=(1.0, 1.3)).collect()
    for rate in sorted({round(r["target"] / r["source_size"], 6) for r in out}):
        part = [r for r in out if round(r["target"] / r["source_size"], 6) == rate]
        mean = {}
        for r in part:
            mean.setdefault(r["doc_id"] % 1000, []).append(r["copies"])
        bias = [sum(c) / len(c) - rate for c in mean.values()]
        assert len(part) == 100 * 60 and abs(sum(bias)) / 60 < 0.01
        assert max(map(abs, bias)) < 4 * (0.25 / 100) ** 0.5


def test_names_that_are_used_inside(spark):
    d = spark.createDataFrame([(i, f"text {i}", "a", 1, 2, 3, 4) for i in range(20)], "doc_id long, text string, source string, row int, copies int, i1 int, k int")
    out = mixed_rows(d)
    assert out.columns == d.columns and set(map(tuple, out.collect())) <= set(map(tuple, d.collect()))
