"""Connected components of a distributed graph, and pairwise work inside them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from odarel.llm.shared import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Tie each greater neighbour of a node to the least one of its neighbourhood."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "graph-least")
    return both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Tie a node and its lesser neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = materialize(down.groupBy("a").agg(F.min("b").alias("m")), "graph-least")
    lesser = down.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return lesser.union(least.select("a", F.col("m").alias("b"))).distinct()


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node has one lesser neighbour and no greater ones, or only greater ones."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 or down > 0 and up > 0").isEmpty()


def components(edges: DataFrame, label: str = "graph", most_rounds: int = 60) -> DataFrame:
    """``node`` and ``root``, the least node of its component, for each node of ``edges`` (a, b).

    Alternating large and small stars: the number of edges never grows, and a few rounds
    turn every component into a star, at which they stop. Each round is written; the driver only learns
    whether a node is left that isn't part of a star. A node's least neighbour is written before it is joined, so
    that the join's sides are plain exchanges, of which Spark splits a hub's.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges, f"{label}-edges")
    for i in range(most_rounds):
        if _all_stars(edges):
            break
        edges = materialize(_small_star(_large_star(edges)), f"{label}-round{i}")
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def compare_within(
    members: DataFrame, compare: Callable[[pa.Table, pa.Table | None], pa.Table], schema: str, *, block_rows: int = 2048, block_bytes: int = 4 << 20, bin_bytes: int = 8 << 20, least_rows: int = 128, spread: int = 8
) -> DataFrame:
    """Run ``compare`` on all pairs of blocks of each group, and unite what it returns.

    ``members`` has ``comp``, ``node``, ``bytes`` and what ``compare`` needs. A group
    of up to ``least_rows`` rows and ``block_bytes`` is a block; larger ones are dealt
    by node hash to ``spread`` blocks or, if these would exceed ``block_rows`` rows or ``block_bytes``,
    to more. Every two blocks meet in a task of their own, so that no
    task holds more than two blocks. Small groups share tasks. ``compare(x, None)`` is for pairs
    inside x, ``compare(x, y)`` for pairs of an x and a y.
    """
    sizes = members.groupBy("comp").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    sizes = materialize(sizes.select("comp", "b", F.greatest(F.ceil(F.col("n") / block_rows), F.ceil(F.col("b") / block_bytes), F.least(F.lit(spread), F.ceil(F.col("n") / least_rows))).cast("int").alias("blocks")), "blocks-sizes")
    small = sizes.filter("blocks <= 1").agg(F.sum("b")).first()[0] or 0
    bins = max(1, -(-int(small) // bin_bytes), int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = members.join(sizes.select("comp", "blocks"), "comp")
    single = rows.filter("blocks <= 1").select("*", F.lit(0).alias("block"), F.pmod(F.xxhash64("comp"), F.lit(bins)).alias("bin"), F.lit(0).alias("x"), F.lit(0).alias("y"))
    large = rows.filter("blocks > 1").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    large = large.select(*rows.columns, "block", F.xxhash64("comp").alias("bin"), F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    empty = pa.table({f.name: pa.array([], f.type) for f in _arrow_schema(schema)})

    def run(table: pa.Table) -> pa.Table:
        out = []
        table = table.combine_chunks().sort_by("comp")
        comps = table.column("comp").to_numpy()
        cuts = [0, *[i for i in range(1, len(comps)) if comps[i] != comps[i - 1]], len(comps)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = table.slice(a, b - a)
            if (x := part.column("x")[0].as_py()) == (y := part.column("y")[0].as_py()):
                out.append(compare(part, None))
            else:
                block = part.column("block").to_numpy()
                out.append(compare(part.filter(pa.array(block == x)), part.filter(pa.array(block == y))))
        return pa.concat_tables([empty, *out])

    dealt = single.withColumn("kind", F.lit(0)).union(large.withColumn("kind", F.lit(1)))
    return dealt.groupBy("kind", "bin", "x", "y").applyInArrow(run, schema)


def _arrow_schema(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def stars(n: int, near: Callable[[np.ndarray, np.ndarray], np.ndarray], chunk: int = 64) -> Iterator[tuple[int, np.ndarray]]:
    """Each root among 0..n-1 with all that links reach from it, so a star per component.

    ``near(i, j)`` says which pairs of rows i and j link, as a matrix. A row is asked about only until it is
    reached: a group of n rows that are all alike takes n comparisons, not n * n.
    """
    rest = np.arange(n)
    while len(rest) > 1:
        root, rest = int(rest[0]), rest[1:]
        edge = np.array([root])
        while len(edge) and len(rest):
            hit = np.zeros(len(rest), bool)
            for lo in range(0, len(edge), chunk):
                open_ = np.flatnonzero(~hit)
                if not len(open_):
                    break
                hit[open_] = near(edge[lo : lo + chunk], rest[open_]).any(axis=0)
            edge, rest = rest[hit], rest[~hit]
            if len(edge):
                yield root, edge


def star_edges(nodes: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> pa.Table:
    """``stars`` as edges (a, b) of ``nodes``."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for root, others in stars(len(nodes), near):
        a.append(np.full(len(others), nodes[root], np.int64))
        b.append(nodes[others].astype(np.int64))
    return pa.table({"a": pa.array(np.concatenate(a)), "b": pa.array(np.concatenate(b))})


class Forest:
    """Union-find over hashable nodes; ``join`` says whether it merged two trees."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (p := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(p, p)
            x = p
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b
