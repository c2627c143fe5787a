from collections import defaultdict

from odarel.llm.lines import dedup_lines

SCHEMA = "doc_id long, text string, source string, line string, at int"


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, t, s, "x", 0) for i, t, s in rows], SCHEMA)
    return [tuple(r) for r in dedup_lines(df, **options).collect()]


def brute(rows, min_sites=5, min_chars=1):
    sites = defaultdict(set)
    for _, t, s in rows:
        for line in (t or "").split("\n"):
            if s is not None:
                sites[line.strip(" ")].add(s)
    out = []
    for i, t, _ in rows:
        if t is None:
            out.append((i, 0, 0, None))
            continue
        lines = t.split("\n")
        kept = [x for x in lines if len(x.strip(" ")) < min_chars or len(sites[x.strip(" ")]) < min_sites]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_threshold_is_exact(spark):
    rows = [(i, f"A line that is on {n:02d} sites.\nOwn line of document number {i}", f"s{s}") for i, (n, s) in enumerate((n, s) for n in range(1, 40) for s in range(n))]
    for least in (5, 20):
        assert sorted(run(spark, rows, min_sites=least)) == sorted(brute(rows, least))


def test_odd_rows(spark):
    shared = "This line is everywhere, really."
    rows = [(i, f"{shared}\n  {shared}  \nshort\n", f"s{i}") for i in range(6)]
    rows += [(10, None, "a"), (11, "", "a"), (12, shared, None), (None, shared, "b"), (13, shared, "b"), (13, shared, "b"), (14, "\n".join(f"line number {n} of a long text" for n in range(20_000)), "c")]
    assert sorted(run(spark, rows), key=repr) == sorted(brute(rows), key=repr)
    rows += [(20 + i, "no\n \n  no\n\nyes %d" % i, f"s{i}") for i in range(6)]
    assert sorted(run(spark, rows), key=repr) == sorted(brute(rows), key=repr)
    assert sorted(run(spark, rows, min_chars=16), key=repr) == sorted(brute(rows, min_chars=16), key=repr)
    assert run(spark, []) == []


def test_many_cut_lines_take_linear_time(spark):
    import time

    shared = [f"shared line number {n}" for n in range(100_000)]
    rows = [(i, "\n".join([*shared[:50_000], f"own {i}", *shared[50_000:]]), f"s{i}") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    start = time.perf_counter()
    got = dedup_lines(df).collect()
    assert [(r["n_lines"], r["n_removed"], r["text"]) for r in sorted(got)] == [(100_001, 100_000, f"own {i}") for i in range(5)]
    assert time.perf_counter() - start < 30
