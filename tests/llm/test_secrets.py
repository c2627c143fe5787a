import random

from odarel.llm.secrets import RULES, Ledger, Rule, find_secrets, findings
from tests.llm import brute

SCHEMA = "doc_id long, text string, blob string, spans int"


def listed(row):
    return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in row["spans"])


def run(spark, rows, ledger=None):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    return find_secrets(df, ledger)


def test_equals_brute_force(spark):
    rng = random.Random(4)
    bits = ["password", "Token", "api_key", "APIKEY", "secret", " = ", ":", "'", '"', "abc", "AKIA", "A1B2C3D4E5F6G7H8", "deadbeef", "0123456789abcdef", "é", "𝄞", " ", "\n", "-", "x/y+z=", "AKIAAKIA", "tokentoken="]
    rows = [(i, "".join(rng.choices(bits, k=rng.randint(0, 25)))) for i in range(1500)]
    found, _ = run(spark, rows)
    got = {r["doc_id"]: listed(r) for r in found.collect()}
    assert got == {i: brute.spans(t) for i, t in rows}


def test_ledger_is_incremental(spark):
    rows = [(1, "token=abcdefgh"), (2, "token=abcdefgh"), (3, "nothing"), (4, None), (5, "")]
    found, fresh = run(spark, rows)
    assert fresh.count() == 3 and [listed(r) for r in found.orderBy("doc_id").collect()] == ["assign:0:14"] * 2 + [""] * 3
    found, more = run(spark, [*rows, (6, "nothing"), (7, "secret: abcdefgh")], fresh)
    assert more.count() == 1 and {r["doc_id"]: listed(r) for r in found.collect()}[7] == "assign:0:16"
    again, none = run(spark, rows, fresh.union(more))
    assert none.count() == 0 and again.filter("size(spans) > 0").count() == 2
    assert find_secrets(spark.createDataFrame(rows, "doc_id long, text string"), fresh, version="next")[1].count() == 3


def test_odd_rows(spark):
    rows = [(None, "token=abcdefgh"), (1, "x" * 300_000 + " token=abcdefgh"), (1, "x"), (1, "x")]
    found, _ = run(spark, rows)
    assert sorted(listed(r) for r in found.collect()) == ["", "", "assign:0:14", "assign:300001:300015"]
    assert run(spark, [])[0].count() == 0


def test_stored_ledger_scans_only_new_pairs_of_blob_and_rule(spark, tmp_path):
    rows = [(1, "token=abcdefgh"), (2, "token=abcdefgh " + "a" * 30), (3, "nothing"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    ledger.extend(df)
    assert ledger.read().count() == 4 and all(len(r["scanned"]) == 3 for r in ledger.read().collect())
    again = Ledger(spark, str(tmp_path / "ledger"))  # as another session would open it
    again.extend(df)
    assert again.read().count() == 4
    changed = (*RULES[:2], Rule("hex", "[0-9a-f]{32,}"))
    again.extend(df, rules=changed)  # one rule differs: it alone is scanned anew
    assert again.read().count() == 8 and sorted(len(r["scanned"]) for r in again.read().collect()) == [1] * 4 + [3] * 4
    assert {r["doc_id"]: listed(r) for r in findings(df, again.read(), rules=changed).collect()} == {1: "assign:0:14", 2: "assign:0:14", 3: "", 4: ""}
    assert {r["doc_id"]: listed(r) for r in findings(df, again.read()).collect()}[2] == "assign:0:14,hex:15:45"
    again.extend(spark.createDataFrame([(9, "new token=abcdefgh")], "doc_id long, text string"))
    assert again.read().count() == 9


def test_many_matches_take_linear_time(spark):
    import time

    text = "é token=abcdef " * 100_000
    start = time.perf_counter()
    (found,) = run(spark, [(1, text)])[0].collect()
    assert time.perf_counter() - start < 60
    assert [(s["start"], s["end"]) for s in found["spans"]] == [(2 + 15 * i, 14 + 15 * i) for i in range(100_000)]
