import numpy as np
import pytest

from odarel.llm.embeddings import near_vectors, passes_for
from tests.llm import brute


def planted(n=400, groups=25, size=12, big=300, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    parts = [rng.standard_normal((n, dim))]
    for _ in range(groups):
        parts.append(rng.standard_normal(dim) + 0.18 * rng.standard_normal((size, dim)))
    parts.append(rng.standard_normal(dim) * 2 + 0.25 * rng.standard_normal((big, dim)))
    x = np.vstack(parts).astype(np.float32)
    return np.vstack([x, x[:20]]), rng


@pytest.mark.parametrize("window", [8, 128])
def test_recall_and_precision(spark, window):
    x, rng = planted()
    labels = [None if i % 50 == 49 else int(i % 2) for i in range(len(x))]
    df = spark.createDataFrame([(i, v.tolist(), l, 1) for i, (v, l) in enumerate(zip(x, labels, strict=True))], "vec_id long, embedding array<float>, label int, n_links int")
    got = {r["vec_id"]: r for r in near_vectors(df, window=window).collect()}
    y = x.astype(np.float64)
    s = (y @ y.T) / np.outer(np.linalg.norm(y, axis=1), np.linalg.norm(y, axis=1)) >= 0.93
    lab = np.array([-1 if l is None else l for l in labels])
    s &= (lab[:, None] == lab[None, :]) & (lab >= 0)[:, None]
    np.fill_diagonal(s, False)
    roots = brute.classes(range(len(x)), [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(s)), strict=True)])
    found = sum(got[i]["n_links"] for i in got)
    assert all(got[i]["n_links"] <= s[i].sum() for i in got)
    assert found >= 0.999 * s.sum()
    assert sum(got[i]["component_id"] == roots[i] for i in got) >= 0.999 * len(got)
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [0.0, 0.0], 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1), (5, [None, 1.0], 1), (6, [], 1), (7, [1.0, 0.0], None)]
    rows += [(8, [1.0, 0.0], 1), (9, [2.0, 0.0], 1), (9, [2.0, 0.0], 1), (10, [1.0, 0.0], 2), (11, [1.0, 0.0, 0.0], 1), (12, [1.0, -0.0], 1), (None, [1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = near_vectors(df).collect()
    assert len(got) == len(rows)
    linked = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got if r["n_links"]}
    assert linked == {8: (3, 8), 9: (3, 8), 12: (3, 8)}
    assert near_vectors(df.filter("false")).count() == 0


def test_passes_grow_slowly():
    assert passes_for(100, 128, 0.93, 1e-4) <= passes_for(10**6, 128, 0.93, 1e-4) < passes_for(10**9, 128, 0.93, 1e-4) < 400


def test_shared_direction_loses_no_link(spark):
    # a label whose vectors lean one way: few sign patterns hold most rows, more than a window each
    rng = np.random.default_rng(5)
    dim, groups = 64, 600
    lean = 5 * rng.standard_normal(dim) / np.sqrt(dim)
    centres = lean + rng.standard_normal((groups, dim)) * 2.2 / np.sqrt(dim)
    x = np.repeat(centres, 2, axis=0) + rng.standard_normal((2 * groups, dim)) * 1.3 / np.sqrt(dim)
    n = np.linalg.norm(x, axis=1)
    s = (x @ x.T) / np.outer(n, n) >= 0.93
    np.fill_diagonal(s, False)
    roots = brute.classes(range(len(x)), [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(s)), strict=True)])
    assert 100 < s.sum() / 2 and len(set(roots.values())) > len(x) / 4
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in near_vectors(df, window=8).collect()}
    assert [got[i]["n_links"] for i in range(len(x))] == s.sum(axis=1).tolist()
    assert [got[i]["component_id"] for i in range(len(x))] == [roots[i] for i in range(len(x))]


def test_recall_over_many_partitions_and_huge_components(spark):
    # pairs just above the threshold among vectors with a common mean, over 40 partitions
    rng = np.random.default_rng(8)
    dim, pairs = 64, 1200
    lean = rng.standard_normal(dim)
    x = lean + 1.2 * rng.standard_normal((pairs, dim))
    off = rng.standard_normal((pairs, dim))
    off -= (off * x).sum(1, keepdims=True) / (x * x).sum(1, keepdims=True) * x
    y = 0.935 * x + np.sqrt(1 - 0.935**2) * off * np.linalg.norm(x, axis=1, keepdims=True) / np.linalg.norm(off, axis=1, keepdims=True)
    z = np.vstack([x, y, lean + 1.2 * rng.standard_normal((1000, dim))])
    n = np.linalg.norm(z, axis=1)
    s = (z @ z.T) / np.outer(n, n) >= 0.93
    np.fill_diagonal(s, False)
    z[::3] *= 1e200  # lengths don't matter, not even those whose squares are out of range
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(z)], "vec_id long, embedding array<double>, label int")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = {r["vec_id"]: r["n_links"] for r in near_vectors(df, window=16).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert s.sum() >= 2 * pairs and sum(got.values()) >= 0.9995 * s.sum() and all(got[i] <= s[i].sum() for i in got)


def test_a_key_with_several_vectors(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.0, 2.0], 1), (3, [5.0, 0.1], 1)]
    got = sorted(tuple(r) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]
