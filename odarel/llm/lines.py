"""Removal of boilerplate lines by the number of distinct sites they are on.

A HyperLogLog sketch of the sites is kept per line hash and merged by
aggregation. Lines whose estimate is clearly above or below the threshold are
decided by it; those near it get an exact distinct count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odarel.llm.shared import materialize

LG_K = 10
#: Relative standard error of a sketch with 2**LG_K registers.
ERROR = 1.04 / 2 ** (LG_K / 2)


def line_key(line: Column) -> list[Column]:
    """128 bits that stand for a line without the spaces around it."""
    body = F.trim(line)
    return [F.xxhash64(body).alias("h1"), F.xxhash64(F.lit(7), body).alias("h2")]


def boilerplate(lines: DataFrame, min_sites: int, sigmas: float = 4.0) -> DataFrame:
    """``h1``, ``h2`` of the lines on at least ``min_sites`` sites; ``lines`` has h1, h2 and site."""
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
    spread = spread.select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites"))
    margin = max(1.0, sigmas * ERROR * min_sites)
    spread = materialize(spread.filter(F.col("sites") >= min_sites - margin), "lines-spread")
    sure = spread.filter(F.col("sites") > min_sites + margin).select("h1", "h2")
    near = spread.filter(F.col("sites") <= min_sites + margin).select("h1", "h2")
    pairs = lines.join(near, ["h1", "h2"], "left_semi").select("h1", "h2", "site").distinct()
    exact = pairs.groupBy("h1", "h2").agg(F.count("site").alias("sites")).filter(F.col("sites") >= min_sites)
    return sure.union(exact.select("h1", "h2"))


def without(lines: Column, cut: Column) -> Column:
    """``lines`` without those at the places in ``cut``: the pieces between two cuts, so each line is touched once."""

    def pieces(x: Column) -> Column:
        def piece(i: Column) -> Column:
            low = F.when(i == 0, F.lit(0)).otherwise(F.get(x["cut"], i - 1) + 1)
            high = F.coalesce(F.get(x["cut"], i), F.size(x["lines"]))
            return F.slice(x["lines"], low + 1, high - low)

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(x["cut"])), piece))

    # bound as a variable, so that neither is computed anew for each piece
    return F.get(F.transform(F.array(F.struct(lines.alias("lines"), F.array_sort(cut).alias("cut"))), pieces), F.lit(0))


def dedup_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = 5, min_chars: int = 1) -> DataFrame:
    """``key``, ``n_lines``, ``n_removed`` and ``text`` without cross-site boilerplate, per row of ``docs``.

    A line is what lies between line feeds; it is compared without the spaces
    around it, and only if at least ``min_chars`` characters are left, so that by default every line counts that isn't empty. Every
    occurrence of a line on ``min_sites`` sites or more goes. A null site counts as none. Null
    texts have no lines and stay null; an empty text has one empty line. Rows equal
    in key and text get the same result. An empty table gives an empty table. Other columns are ignored.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(site).cast("string").alias("site"), F.xxhash64("text").alias("mark"))
    parts = rows.select("key", "mark", "site", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    parts = parts.filter(F.char_length(F.trim("line")) >= min_chars).select("key", "mark", "site", "at", *line_key(F.col("line")))
    parts = materialize(parts, "lines-hashes")
    gone = materialize(boilerplate(parts.select("h1", "h2", "site"), min_sites), "lines-boilerplate")
    cuts = parts.join(gone, ["h1", "h2"]).groupBy("key", "mark").agg(F.collect_set("at").alias("cut"))
    cuts = materialize(cuts, "lines-cuts")  # the join's sides are plain exchanges, of which Spark splits a hot row's
    found = rows.alias("d").join(cuts.alias("c"), F.expr("d.key <=> c.key and d.mark = c.mark"), "left").select("d.key", "d.text", "c.cut")
    lines = F.split("text", "\n", -1)
    return found.select(
        F.col("key").alias(key),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col("cut").isNull(), 0).otherwise(F.size("cut")).cast("long").alias("n_removed"),
        F.when(F.col("cut").isNull(), F.col("text")).otherwise(F.array_join(without(lines, F.col("cut")), "\n")).alias("text"),
    )
