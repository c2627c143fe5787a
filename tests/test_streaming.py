from datetime import datetime

from odarel.streaming.windows import feed, sessions, stream, tumbling


def events(spark):
    rows = [(i, datetime(2024, 1, 1, 0, m), t) for i, (m, t) in enumerate([(0, "a"), (1, "a"), (7, "b"), (8, "b"), (59, "a")])]
    return spark.createDataFrame(rows, "event_id int, ts timestamp, event_type string")


def test_tables(spark):
    got = {(r["window_start"].minute, r["event_type"]): r["n"] for r in tumbling(events(spark), "ts", "10 minutes", ["event_type"]).collect()}
    assert got == {(0, "a"): 2, (0, "b"): 2, (50, "a"): 1}
    assert sorted(r["n"] for r in sessions(events(spark), "ts", "5 minutes", ["event_type"]).collect()) == [1, 2, 2]
    assert tumbling(events(spark), "ts", "10 minutes", [], slide="5 minutes").count() == 5


def test_stream(spark, tmp_path):
    df = events(spark)
    df.write.parquet(str(tmp_path / "in"))
    live = stream(spark, str(tmp_path / "in"), df, files_per_batch=100)
    run = tumbling(live, "ts", "10 minutes", ["event_type"], lateness="1 minute").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.table("counts").count() == 3


def test_feed(spark, tmp_path):
    df = events(spark)
    df.write.parquet(str(tmp_path / "in"))
    seen = []
    before = spark.createDataFrame([(0,), (77,)], "event_id int")
    run = feed(stream(spark, str(tmp_path / "in"), df, files_per_batch=100), ["event_id"], lambda rows, gone, n: seen.append((rows.count(), [r["event_id"] for r in gone.collect()])), lambda: before, str(tmp_path / "ck"))
    run.awaitTermination()
    assert seen == [(5, [77])]


def test_feed_of_changes(spark, tmp_path):
    rows = [(1, 1, "old", False), (1, 3, "new", False), (1, 2, "between", False), (2, 1, "x", False), (2, 2, None, True), (3, 1, "y", None)]
    df = spark.createDataFrame(rows, "id int, at int, v string, gone boolean")
    df.write.parquet(str(tmp_path / "in"))
    seen = []
    run = feed(stream(spark, str(tmp_path / "in"), df, files_per_batch=100), ["id"], lambda rows, gone, n: seen.append((sorted((r["id"], r["v"]) for r in rows.collect()), [r["id"] for r in gone.collect()])), lambda: df, str(tmp_path / "ck"), by="at", removed="gone")
    run.awaitTermination()
    assert seen == [([(1, "new"), (3, "y")], [2])]
