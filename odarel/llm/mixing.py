"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source starts with the same fractional number of copies,
target / source size. Its whole part is certain; the fraction is a probability.
Two documents at a time, a random amount of probability mass (in words) moves
from one to the other until one of them is 0 or 1. The move keeps their
expected words and each document's expectation, so a source's words stay at the
target while all but one document are settled. Leaves of a few hundred
documents are settled in parallel and their single residuals are combined level
by level, so no task ever holds a whole source. A leaf per source is held back
unsettled until the source is down to one leaf; there, what the last open document
misses is made up for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from odarel.llm.shared import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1.0, 2.0, 3.0)
MAX_REPEAT = 3.0


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """One row per source with its size and target.

    ``sizes`` has ``source`` and ``size``. Sources in code point order, null last,
    take the weights in turn. A target is ``min(max_repeat * source size, level *
    weight)`` where the level makes the targets add up to all sizes, which is what
    resharing the excess again and again converges to. Only the per-source table,
    a row per source, is sorted in one task.
    """
    per = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"),
        F.sum((F.col("size") > 0).cast("long")).alias("rows"),
    )
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("rank", F.row_number().over(turn) - 1)
    per = per.withColumn("weight", F.get(cycle, F.col("rank") % len(weights)))
    cap = F.col("source_size") * F.lit(float(max_repeat))
    by_ratio = Window.orderBy(F.col("ratio"), F.col("rank"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    per = per.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    per = per.withColumn("total", F.sum("source_size").over(every).cast("double"))
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    per = per.withColumn("step", level)
    per = per.withColumn("level", F.max("step").over(every))
    return per.select("source", "rank", "rows", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def _numbered(slim: DataFrame, block: int = 4096) -> DataFrame:
    """``slim`` with ``nth``, which tells rows equal in id, source and size apart.

    Equal rows are counted, on the map side first, and dealt out again; a row that is there more than ``block``
    times is dealt out by blocks in as many tasks as there are.
    """
    counted = materialize(slim.groupBy("id", "source", "size").count(), "mix-counted")
    few = counted.filter(F.col("count") <= block).select("id", "source", "size", F.explode(F.sequence(F.lit(1).cast("long"), "count")).alias("nth"))
    many = counted.filter(F.col("count") > block).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("count") - 1) / block))).alias("part"))
    first = F.col("part") * block + 1
    many = many.repartition("id", "part").select("id", "source", "size", F.explode(F.sequence(first, F.least(F.col("count"), F.col("part") * block + block))).alias("nth"))
    return few.union(many)


def _settle(leaf: Column, seed: int) -> Column:
    """Fold a leaf's documents; gives an array of (at, up) and the open one with its probability.

    ``leaf`` is an array of (order, tie, words, p), largest documents first, so
    that the document left open at the end tends to be a small one.
    """
    settled = "array<struct<at:int,up:int>>"
    start = F.struct(
        F.lit(0).alias("at"),
        leaf[0]["words"].alias("words"),
        leaf[0]["p"].alias("p"),
        leaf[0]["tie"].alias("tie"),
        F.lit(1).alias("next"),
        F.array().cast(settled).alias("done"),
    )

    def pair(c: Column, n: Column) -> Column:
        held, other = c["words"] * c["p"], n["words"] * n["p"]
        room, other_room = c["words"] - held, n["words"] - other
        gain, give = F.least(room, other), F.least(held, other_room)
        draw = F.pmod(F.xxhash64(F.lit(seed), c["tie"], n["tie"], c["next"]), F.lit(1 << 52)) / F.lit(float(1 << 52))
        up = draw * (gain + give) < give
        return F.struct(
            up.alias("up"),
            F.when(up, room <= other).otherwise(held <= other_room).alias("carry_settles"),
            F.when(up, F.when(room <= other, (other - room) / n["words"]).otherwise((held + other) / c["words"]))
            .otherwise(F.when(held <= other_room, (held + other) / n["words"]).otherwise((held - other_room) / c["words"]))
            .alias("p"),
        )

    def step(c: Column, n: Column) -> Column:
        def moved(s: Column, m: Column) -> Column:
            first = m["carry_settles"]
            value = (m["up"] == first).cast("int")
            return F.struct(
                F.when(first, s["next"]).otherwise(s["at"]).alias("at"),
                F.when(first, n["words"]).otherwise(s["words"]).alias("words"),
                F.greatest(F.lit(0.0), F.least(F.lit(1.0), m["p"])).alias("p"),
                F.when(first, n["tie"]).otherwise(s["tie"]).alias("tie"),
                (s["next"] + 1).alias("next"),
                F.concat(s["done"], F.array(F.struct(F.when(first, s["at"]).otherwise(s["next"]).alias("at"), value.alias("up")))).cast(settled).alias("done"),
            )

        return F.aggregate(F.array(pair(c, n)), c, moved)

    return F.aggregate(F.slice(leaf, 2, F.greatest(F.size(leaf) - 1, F.lit(0))), start, step)


def _close(leaf: Column, s: Column, seed: int) -> Column:
    """All of a source's last leaf settled: array of (at, up).

    The open document is drawn, and the words by which that misses are made up for by
    moving the document of fitting size that leaves the least, or two in opposite ways, until no move leaves less.
    Each move leaves less than before, so that no state comes twice; the steps allowed are far more than are ever taken.
    """
    kind = "struct<off:double,stop:boolean,all:array<struct<at:int,up:int,words:double>>>"
    move_kind = "struct<left:double,at:int,back:int,words:double>"
    draw = F.pmod(F.xxhash64(F.lit(seed), s["tie"]), F.lit(1 << 52)) / F.lit(float(1 << 52))
    last = (draw < s["p"]).cast("int")
    settled = F.transform(s["done"], lambda d: F.struct(d["at"].alias("at"), d["up"].alias("up"), F.get(leaf, d["at"])["words"].alias("words")))
    every = F.concat(settled, F.array(F.struct(s["at"].alias("at"), last.alias("up"), s["words"].alias("words"))))
    start = F.struct(((s["p"] - last) * s["words"]).alias("off"), F.lit(False).alias("stop"), every.alias("all")).cast(kind)

    def best(c: Column) -> Column:
        """The move that leaves the least: a document, or if none leaves less than before, one for another."""
        def move(miss: Column, x: Column, at: Column, words: Column) -> Column:
            return F.struct(F.abs(miss - (x["words"] - words)).alias("left"), x["at"].alias("at"), at.alias("back"), (x["words"] - words).alias("words")).cast(move_kind)

        def swapped(m: Column, single: Column) -> Column:
            swaps = F.transform(m["there"], lambda x: F.array_min(F.transform(m["back"], lambda y: move(m["miss"], x, y["at"], y["words"]))))
            return F.when(single["left"] < m["miss"] - 1e-6, single).otherwise(F.array_min(swaps))

        def found(m: Column) -> Column:
            single = F.array_min(F.transform(m["there"], lambda x: move(m["miss"], x, F.lit(-1), F.lit(0.0))))
            return F.get(F.transform(F.array(single), lambda one: swapped(m, one)), F.lit(0))

        way = (c["off"] < 0).cast("int")
        sides = F.struct(F.abs(c["off"]).alias("miss"), F.filter(c["all"], lambda x: x["up"] == way).alias("there"), F.filter(c["all"], lambda x: x["up"] != way).alias("back"))
        return F.get(F.transform(F.array(sides), found), F.lit(0))

    def step(c: Column, _: Column) -> Column:
        def moved(held: Column, b: Column) -> Column:
            new = F.struct(
                (held["off"] - F.signum(held["off"]) * b["words"]).alias("off"),
                F.lit(False).alias("stop"),
                F.transform(held["all"], lambda x: F.struct(x["at"].alias("at"), F.when((x["at"] == b["at"]) | (x["at"] == b["back"]), 1 - x["up"]).otherwise(x["up"]).alias("up"), x["words"].alias("words"))).alias("all"),
            ).cast(kind)
            stopped = F.struct(held["off"].alias("off"), F.lit(True).alias("stop"), held["all"].alias("all")).cast(kind)
            return F.when(b["left"] < F.abs(held["off"]) - 1e-6, new).otherwise(stopped)

        return F.when(c["stop"], c).otherwise(F.aggregate(F.array(best(c)), c, moved))

    return F.transform(F.aggregate(F.sequence(F.lit(1), F.size(leaf) * 16 + 16), start, step)["all"], lambda x: F.struct(x["at"].alias("at"), x["up"].alias("up"), F.lit(None).cast("double").alias("p")))


def mix(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    source: str = "source",
    size: Column | None = None,
    text: str = "text",
    weights=WEIGHTS,
    max_repeat: float = MAX_REPEAT,
    leaf_rows: int = 256,
    seed: int = 17,
) -> DataFrame:
    """How often each row of ``docs`` goes into the mix.

    Returns a row per input row: the key column, ``source``, ``size`` (words unless
    ``size`` is given), ``source_size``, ``target`` (its source's), ``copies`` and
    ``taken`` = size * copies, with copies at most ``ceil(max_repeat)``.

    A null or empty text has size 0, takes nothing and has 0 copies; a null source is a source of its own, the
    last in turn. Ties and repeated rows are settled separately, a repeated row's copies in leaves of their own. An empty table
    gives an empty table. Other columns are ignored, whatever their names.
    In a source's last leaf, documents are moved between their two possible numbers of copies, until no
    move makes up for more of what the one left open misses. Draws are hashes of the keys and sizes, so that a rerun gives the same mix.
    """
    size = word_count(F.col(text)) if size is None else size
    slim = materialize(docs.select(F.col(key).alias("id"), F.col(source).alias("source"), size.alias("size")), "mix-sizes")
    targets = materialize(source_targets(slim, weights, max_repeat), "mix-targets")
    rows = _numbered(slim).alias("d").join(targets.alias("t"), F.expr("d.source <=> t.source")).select("d.id", "d.source", "d.size", "d.nth", "t.rank", "t.rows", "t.source_size", "t.target")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.when(F.col("size") > 0, F.floor(share)).otherwise(0)
    rows = rows.withColumn("whole", whole.cast("int")).withColumn("p", F.when(F.col("size") > 0, share - F.floor(share)).otherwise(0.0))
    out = ["id", "source", "size", "source_size", "target", "whole"]
    parts = [rows.filter("p = 0").select(*out, F.lit(0).alias("up"))]
    open_ = rows.filter("p > 0").withColumn("tie", F.xxhash64(F.lit(seed), "id", "size", "nth")).withColumn("leaf", F.col("tie"))
    most = targets.agg(F.max("rows")).first()[0] or 0
    level = 0
    while True:
        most = -(-most // leaf_rows)
        open_ = open_.withColumn("rows", F.ceil(F.col("rows") / leaf_rows))
        open_ = open_.withColumn("leaf", F.when(F.col("leaf") == 0, F.lit(0)).otherwise(F.pmod(F.xxhash64(F.lit(level), "leaf"), F.col("rows"))))
        member = F.struct((-F.col("size")).alias("order"), "tie", F.col("size").cast("double").alias("words"), "p", "id", "source", "source_size", "target", "whole")
        leaves = open_.groupBy("rank", "leaf", "rows").agg(F.sort_array(F.collect_list(member)).alias("m"))
        leaves = leaves.withColumn("s", _settle(F.col("m"), seed + level))
        unsettled = F.lit(None).cast("int").alias("up")
        held = F.transform("m", lambda x, i: F.struct(i.alias("at"), unsettled, x["p"].alias("p")))
        passed = F.concat(
            F.transform(F.col("s.done"), lambda d: F.struct(d["at"].alias("at"), d["up"].alias("up"), F.lit(None).cast("double").alias("p"))),
            F.array(F.struct(F.col("s.at").alias("at"), unsettled, F.col("s.p").alias("p"))),
        )
        results = F.when(F.col("rows") <= 1, _close(F.col("m"), F.col("s"), seed + level + 1)).when(F.col("leaf") == 0, held).otherwise(passed)
        leaves = leaves.select("rank", "leaf", "rows", "m", F.explode(results).alias("r")).withColumn("m", F.get("m", F.col("r.at")))
        settled = leaves.select(
            "rank", "leaf", "rows", "m.id", "m.source", (-F.col("m.order")).alias("size"), "m.source_size", "m.target", "m.whole", "m.tie", "r.up", "r.p"
        )
        settled = materialize(settled, f"mix-level{level}")
        parts.append(settled.filter("up is not null").select(*out, "up"))
        open_ = settled.filter("up is null").drop("up")
        level += 1
        if most <= 1:
            break
    copies = F.col("whole") + F.col("up")
    return reduce(DataFrame.union, parts).select(
        F.col("id").alias(key), F.col("source").alias(source), "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken")
    )


def mixed_rows(docs: DataFrame, *, key: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The mix itself: each row of ``docs``, all its columns whatever their names, as often as ``mix`` says.

    Rows are found again by 128 bits of key, source and text; rows equal in these are interchangeable, so
    that one of them stands for all, as often as their copies add up to. Every row moves once, and
    of equal rows one per map task at most. Null and empty texts are in no mix; null keys and sources are like
    any other; an empty table gives an empty table.
    """
    ids = [F.xxhash64(F.lit(seed), F.col(key).isNull(), F.col(key), F.col(source).isNull(), F.col(source), F.col(text)).alias(name) for seed, name in ((3, "i1"), (5, "i2"))]
    slim = docs.select(F.struct(*ids).alias("k"), F.col(source).alias("s"), word_count(F.col(text)).alias("w"))
    copies = mix(slim, key="k", source="s", size=F.col("w"), **options).filter("copies > 0").groupBy("k").agg(F.sum("copies").cast("int").alias("copies"))
    copies = materialize(copies.select("k.i1", "k.i2", "copies"), "mix-copies")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *ids).groupBy("i1", "i2").agg(F.any_value("row").alias("row"))
    found = rows.hint("merge").join(copies, ["i1", "i2"])
    return found.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
