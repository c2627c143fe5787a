"""Sharding by histogram sort.

Rows are ordered by (text hash, key hash, place), so equal texts lie side by side and
the order is random otherwise; the place only tells rows apart that are equal in key and text. Exact bytes are counted below candidate
boundaries of that order; only the intervals that hold an unmet splitter are
counted again on a finer grid, until each splitter is within tolerance of its
ideal place or no boundary lies nearer. Then rows move once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from odarel.llm.shared import materialize

GRID_BITS = 12
#: What rows are ordered by.
ORDER = ("k1", "k2", "k3")
LOWEST = -(1 << 63)


def byte_size(text: Column, overhead: int = 8) -> Column:
    """UTF-8 bytes of the text, none for null, plus a fixed number per row."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(overhead).cast("long")


def _beyond(cell, level: int, fixed: tuple) -> tuple:
    """What comes after all rows of ``cell``."""
    high = fixed + (cell[f"high{level}"],)
    while high and high[-1] == -LOWEST - 1:
        high = high[:-1]
    if not high:
        return (-LOWEST - 1,) * len(ORDER)
    return high[:-1] + (high[-1] + 1,) + (LOWEST,) * (len(ORDER) - len(high))


def find_splitters(rows: DataFrame, shards: int, tolerance: float, grid_bits: int = GRID_BITS) -> list[tuple[int, ...]]:
    """The places in ORDER at which shards 1, 2, ... begin; ``rows`` has ORDER and ``size``.

    The driver gets at most ``2**grid_bits`` sums for each unmet splitter and round,
    whatever the number of rows.
    """
    total = None
    found: dict[int, tuple[int, ...]] = {}
    # an interval: values of the columns before, bits already fixed of the next, their prefix; bytes below it, splitters in it
    todo: dict[tuple, tuple[int, list[int]]] = {((), 0, 0): (0, list(range(1, shards)))}
    while todo:
        asked, todo = todo, {}
        for level, bits in sorted({(len(x[0]), x[1]) for x in asked}):
            group = {x: y for x, y in asked.items() if (len(x[0]), x[1]) == (level, bits)}
            step = min(grid_bits, 64 - bits)
            column, before = ORDER[level], ORDER[:level]
            prefix = F.shiftright(column, 64 - bits) if bits else F.lit(0).cast("long")
            part = rows
            if bits or level:
                wanted_rows = [reduce(lambda a, b: a & b, [*(F.col(c) == F.lit(v) for c, v in zip(before, fixed, strict=True)), prefix == F.lit(pre)]) for fixed, _, pre in group]
                part = part.filter(reduce(lambda a, b: a | b, wanted_rows))
            ends = [f(c).alias(f"{name}{i}") for i, c in enumerate(ORDER) if i >= level for name, f in (("low", F.min), ("high", F.max))]
            counted = part.groupBy(*before, prefix.alias("prefix"), F.shiftright(column, 64 - bits - step).alias("cell")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), *ends).collect()
            if total is None:
                total = sum(r["bytes"] for r in counted)
                if not total:
                    return [(LOWEST,) * len(ORDER)] * (shards - 1)
            for (fixed, _, pre), (below, wanted) in group.items():
                cells = sorted((r for r in counted if r["prefix"] == pre and tuple(r[c] for c in before) == fixed), key=lambda r: r["cell"])
                edge, k = below, 0
                for i in wanted:
                    ideal = total * i / shards
                    while k < len(cells) - 1 and edge + cells[k]["bytes"] <= ideal:
                        edge += cells[k]["bytes"]
                        k += 1
                    cell = cells[k]
                    after = edge + cell["bytes"]
                    rest = (LOWEST,) * (len(ORDER) - level - 1)
                    start = fixed + (cell[f"low{level}"],) + rest
                    end = fixed + (cells[k + 1][f"low{level}"],) + rest if k + 1 < len(cells) else _beyond(cell, level, fixed)
                    near = min(ideal - edge, after - ideal, key=abs)
                    alike = all(cell[f"low{j}"] == cell[f"high{j}"] for j in range(level, len(ORDER)))
                    if abs(near) <= tolerance * total / shards or cell["n"] == 1 or alike:
                        found[i] = start if ideal - edge <= after - ideal else end
                    else:
                        single = cell[f"low{level}"] == cell[f"high{level}"]
                        nxt = (fixed + (cell[f"low{level}"],), 0, 0) if single else (fixed, bits + step, cell["cell"])
                        todo.setdefault(nxt, (edge, []))[1].append(i)
    return [found[i] for i in range(1, shards)]


def histogram_shards(
    docs: DataFrame,
    *,
    shards: int = 24,
    key: str = "doc_id",
    text: str = "text",
    carry: dict[str, Column] | None = None,
    tolerance: float = 0.001,
    run_rows: int | None = None,
) -> DataFrame:
    """Give every row a shard of nearly equal bytes and a slot, gapless from 0, in it.

    Returns the columns of ``carry`` (by default all of ``docs``) and ``size`` (UTF-8
    bytes plus 8), ``shard`` and ``slot``, which replace columns of these names. Slots are numbered in runs of about
    ``run_rows`` rows (a 4096th of all by default, between 256 and a million), each sorted on its own, whose first slots come from the
    exact counts; a text that fills more than a run is dealt out over several
    by key hash, and a row that is there more often than that by its place in the table.

    Rows are written once with what they are ordered by, so that their places hold whatever ``docs`` is computed from.
    Null texts have size 8 and count as empty; null keys are allowed; repeated rows
    get slots of their own, in different shards where even bytes demand it; an empty table gives an empty table.
    """
    carry = {c: docs[c] for c in docs.columns} if carry is None else carry
    kept = {k: v for k, v in carry.items() if k.lower() not in ("size", "shard", "slot")}
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(
        F.struct(*[v.alias(k) for k, v in kept.items()]).alias("row"),
        byte_size(F.col(text)).alias("size"),
        F.xxhash64(body).alias("k1"),
        F.xxhash64(F.lit(1), F.col(key)).alias("k2"),
        F.monotonically_increasing_id().alias("place"),
    )
    keyed = materialize(keyed.withColumn("k3", F.xxhash64("place")).drop("place"), "shard-rows")
    slim = keyed.select(*ORDER, "size")
    splitters = find_splitters(slim, shards, tolerance)
    if run_rows is None:
        run_rows = max(256, min(1_000_000, slim.count() >> GRID_BITS))

    def not_before(place: tuple[int, ...]) -> Column:
        out = F.lit(True)
        for c, v in reversed(list(zip(ORDER, place, strict=True))):
            out = (F.col(c) > F.lit(v)) | ((F.col(c) == F.lit(v)) & out)
        return out

    def placed(df: DataFrame) -> DataFrame:
        shard = sum((not_before(x).cast("int") for x in splitters), F.lit(0))
        return df.withColumn("shard", shard).withColumn("cell", F.shiftright("k1", 64 - GRID_BITS).cast("int"))

    def bits(limit: int) -> Column:
        return F.least(F.lit(20), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / limit)))).cast("int")

    def top(column: str, bits_: str) -> Column:
        return F.when(F.col(bits_) == 0, F.lit(0).cast("long")).otherwise(F.expr(f"shiftright({column}, 64 - {bits_})"))

    # at most 2**GRID_BITS + shards rows, each with how many bits of k2 deal it out; runs are
    # that many plus two for each full run
    cells = placed(slim).groupBy("shard", "cell").agg(F.count("*").alias("n")).select("shard", "cell", bits(run_rows).alias("bits"))
    cells = materialize(cells, "shard-cells")

    def by_key(df: DataFrame) -> DataFrame:
        return placed(df).join(F.broadcast(cells), ["shard", "cell"]).withColumn("sub", top("k2", "bits"))

    # what k2 leaves in more than two runs, so no more of them than there are runs, is one row many times
    again = by_key(slim).groupBy("shard", "cell", "sub").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * run_rows)
    again = materialize(again.select("shard", "cell", "sub", bits(run_rows).alias("more")), "shard-again")

    def in_runs(df: DataFrame) -> DataFrame:
        known = by_key(df).join(F.broadcast(again), ["shard", "cell", "sub"], "left").withColumn("more", F.coalesce("more", F.lit(0)))
        return known.withColumn("part", top("k3", "more"))

    run = ["shard", "cell", "sub", "part"]
    runs = in_runs(slim).groupBy(*run).agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy(*run[1:]).rowsBetween(Window.unboundedPreceding, -1)
    runs = materialize(runs.select(*run, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "shard-runs")
    inside = Window.partitionBy(*run).orderBy(*ORDER)
    numbered = in_runs(keyed).withColumn("nth", F.row_number().over(inside)).join(runs, run)
    return numbered.select("row.*", "size", "shard", (F.col("first") + F.col("nth") - 1).cast("long").alias("slot"))
