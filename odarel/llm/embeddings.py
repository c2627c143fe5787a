"""Near-duplicate embeddings by sorted projection passes.

Each pass sorts the vectors of a label by the concatenated signs of random
projections and compares neighbours in a bounded window. Near pairs agree on
most signs, so that they come close in some pass. Rows of a pass that share a label's leading signs
but are more than a window, as where vectors share a direction, are compared in blocks instead, all with
all; how many signs lead follows from the measured numbers of rows that share them.

Passes carry no vectors but sketches: a few bytes of a projection that keeps distances, so that
a sketch is enough to rule most pairs out. What it doesn't rule out is united to candidate groups, to which the vectors then
move once: all pairs inside a group are compared in blocks in double precision, and verified pairs are united to components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odarel.llm.graph import compare_within, components, star_edges
from odarel.llm.shared import materialize

BITS = 48
#: Bytes of a sketch, and the standard deviations that a byte spans.
SKETCH, SPAN = 32, 4.0
#: Passes in which rows are counted by their leading signs, and passes up to which more signs are tried than even rows need.
PROBES, MOST_PASSES = 4, 48


@cache
def _planes(dim: int, passes: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, passes * BITS))


def passes_at(signs: float, threshold: float, miss: float) -> int:
    """Passes after which a pair at the threshold has never shared its first ``signs`` signs with probability ``miss`` at most.

    Two vectors share a sign with probability 1 - angle / pi.
    """
    share = (1 - math.acos(threshold) / math.pi) ** max(1.0, signs)
    return max(4, math.ceil(math.log(miss) / math.log1p(-share)))


def passes_for(rows: int, window: int, threshold: float, miss: float) -> int:
    """``passes_at`` the log2(rows / window) + 1 signs that leave a window's rows if rows spread evenly."""
    return passes_at(math.log2(max(2, rows) / window) + 1, threshold, miss)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows of doubles, each times a power of two that keeps its squares in range."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None])


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x @ y.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1))


@cache
def _projection(dim: int, seed: int) -> np.ndarray:
    """Orthogonal directions, scaled so that the squared length of what is projected is right on average."""
    k = min(SKETCH, dim)
    return np.linalg.qr(np.random.default_rng([seed, dim, 1]).standard_normal((dim, k)))[0] * math.sqrt(dim / k)


def sketch_of(x: np.ndarray, seed: int) -> np.ndarray:
    """A byte for each projection of the unit vectors; what spans more than SPAN deviations is cut, which only brings rows closer."""
    y = (x / np.linalg.norm(x, axis=1)[:, None]) @ _projection(x.shape[1], seed)
    return np.clip(np.rint(y * (127 * math.sqrt(y.shape[1]) / SPAN)), -127, 127).astype(np.int8)


def sketch_limit(dim: int, threshold: float, miss: float) -> float:
    """The squared distance of sketches that pairs at the threshold exceed with probability ``miss`` at most.

    Of k projections it is about that of a chi-squared variable (Wilson and Hilferty); rounding adds a step for each.
    """
    k = min(SKETCH, dim)
    grown = 1.0 if k == dim else (1 - 2 / (9 * k) + NormalDist().inv_cdf(1 - miss) * math.sqrt(2 / (9 * k))) ** 3
    return (math.sqrt(2 * (1 - threshold) * grown) * 127 * math.sqrt(k) / SPAN + math.sqrt(k)) ** 2


def _keys(vectors: DataFrame, passes: int, seed: int) -> DataFrame:
    """``label``, ``dim``, ``cls``, the 48 signs of each pass as ``keys``, and the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = np.left_shift(np.int64(1), np.arange(BITS)[::-1].astype(np.int64))
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x = _matrix(part.column(3))
                keys = (x @ _planes(int(dim), passes, seed) > 0).reshape(part.num_rows, passes, BITS) @ powers
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, passes, dtype=np.int32)), pa.array(keys.ravel()))
                sketches = pa.array([s.tobytes() for s in sketch_of(x, seed)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], lists, sketches], names=["label", "dim", "cls", "keys", "sketch"])

    return vectors.select("label", "dim", "cls", "v").mapInArrow(run, "label string, dim int, cls long, keys array<long>, sketch binary")


def _plan(classes: DataFrame, window: int, threshold: float, miss: float, seed: int) -> tuple[DataFrame, int]:
    """A number, the leading signs and the passes per label and length, and the most passes of any.

    Labels of a window's rows need no sign. For others the numbers of rows that share their leading signs
    are measured in a few passes. From the signs that even rows would need to those for ``MOST_PASSES`` passes, the
    number is taken that leaves the fewest comparisons. All labels have the passes of the largest at least.
    """
    sizes = materialize(classes.groupBy("label", "dim").agg(F.count("*").alias("rows")), "vectors-sizes")
    largest = sizes.agg(F.max("rows")).first()[0] or 0
    least = passes_for(largest, window, threshold, miss)
    even = max(0, math.floor(math.log2(max(2, largest) / window) + 1))
    depths = range(0, max([even, *[k for k in range(1, BITS) if passes_at(k, threshold, miss) <= MOST_PASSES]]) + 1)
    cost = F.array(*[F.lit(max(least, passes_at(k, threshold, miss))) for k in depths])
    first = F.when(F.col("rows") <= window, 0).otherwise(F.greatest(F.lit(1), F.floor(F.log2(F.col("rows") / window) + 1))).cast("int")
    sizes = sizes.withColumn("first", first)
    probed = _keys(classes, PROBES, seed).select("label", "dim", F.posexplode("keys").alias("pass", "key"))
    shared = probed.groupBy("label", "dim", "pass", F.expr(f"shiftright(key, {BITS - depths[-1]})").alias("lead")).agg(F.count("*").alias("n"))
    shared = materialize(shared, "vectors-shared")
    tried = sizes.filter("first > 0").select("label", "dim", F.explode(F.sequence("first", F.greatest("first", F.lit(depths[-1])))).alias("signs"))
    found = shared.join(tried, ["label", "dim"]).groupBy("label", "dim", "signs", "pass", F.expr(f"shiftright(lead, {depths[-1]} - signs)").alias("lead")).agg(F.sum("n").alias("n"))
    work = found.groupBy("label", "dim", "signs").agg(F.sum(F.col("n") * F.greatest("n", F.lit(window))).alias("work"))
    best = work.withColumn("work", F.col("work").cast("double") * F.get(cost, F.col("signs"))).groupBy("label", "dim").agg(F.min(F.struct("work", "signs"))["signs"].alias("best"))
    plan = sizes.join(best, ["label", "dim"], "left").select("label", "dim", F.coalesce("best", "first").alias("signs"))
    plan = plan.withColumn("passes", F.get(cost, F.col("signs"))).withColumn("line", F.monotonically_increasing_id() * (1 << 12))
    plan = materialize(plan, "vectors-plan")
    return plan, plan.agg(F.max("passes")).first()[0] or 4


def _candidates():
    """Edges that join what sketches don't rule out inside a block or between two: a star per component."""

    def compare(x: pa.Table, y: pa.Table | None) -> pa.Table:
        both = x if y is None else pa.concat_tables([x, y])
        near, limit = _near(both.column("sketch").to_pylist()), both.column("limit")[0].as_py()
        return star_edges(both.column("node").to_numpy(), lambda i, j: near(i, j) <= limit)

    return compare


def _near(sketches: list[bytes]):
    """Squared distances of sketches of one length, as a function of two lists of rows; exact in single precision."""
    x = np.frombuffer(b"".join(sketches), np.int8).reshape(len(sketches), -1).astype(np.float32)
    square = (x * x).sum(axis=1)
    return lambda i, j: square[i][:, None] + square[j][None, :] - 2 * (x[i] @ x[j].T)


def _links(keyed: DataFrame, window: int) -> DataFrame:
    """Edges between rows of a pass that are close by their sketches, and share its leading signs or are neighbours."""
    group = ["line", "lead"]
    heavy = materialize(keyed.groupBy(*group).count().filter(F.col("count") > window).select(*group), "vectors-heavy")
    members = keyed.join(heavy, group).select(F.xxhash64(*group).alias("comp"), F.col("cls").alias("node"), "sketch", "limit", F.lit(SKETCH + 16).cast("long").alias("bytes"))
    return _window_links(keyed.join(heavy, group, "left_anti"), window).union(compare_within(members, _candidates(), "a long, b long"))


def _window_links(keyed: DataFrame, window: int) -> DataFrame:
    """Edges between close neighbours of each pass.

    Rows that share their leading signs are never in two partitions.
    """
    order = ["line", "key", "cls"]
    lined = keyed.select(*order, "sketch", "limit", "lead").repartitionByRange("line", "lead").sortWithinPartitions(*order).select(*order, "sketch", "limit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail_at, tail, tail_ids = None, [], np.zeros(0, np.int64)
        for batch in batches:
            lines, ids, sketches, limits = batch.column(0).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_pylist(), batch.column(4).to_numpy()
            cuts = [0, *(np.flatnonzero(lines[1:] != lines[:-1]) + 1).tolist(), len(lines)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                own, held = ids[a:b], sketches[a:b]
                if tail_at == lines[a]:
                    own, held = np.concatenate([tail_ids, own]), [*tail, *held]
                near, n = _near(held), len(held)
                for i in range(0, n, window):
                    rows = np.arange(max(0, i - window), min(n, i + window))
                    close = near(rows, rows) <= limits[a]
                    np.fill_diagonal(close, False)
                    some = np.flatnonzero(close.any(axis=1))
                    if len(some):
                        close = close[np.ix_(some, some)]
                        yield star_edges(own[rows[some]], lambda p, q, close=close: close[np.ix_(p, q)]).combine_chunks().to_batches()[0]
                tail_at, tail, tail_ids = lines[a], held[-window:], own[-window:]

    return lined.mapInArrow(run, "a long, b long")


def _verified(threshold: float):
    """Rows (a, b, 0) that join what links in one or two blocks, and (a, a, n) with a's number of linked rows."""

    def compare(x: pa.Table, y: pa.Table | None) -> pa.Table:
        xv, xm, xi = _matrix(x.column("v")), x.column("m").to_numpy(), x.column("node").to_numpy()
        if y is None:
            every, ids = _cosines(xv, xv) >= threshold, xi
            np.fill_diagonal(every, False)
            nodes, counts = xi, every @ xm
        else:
            yv, ym, yi = _matrix(y.column("v")), y.column("m").to_numpy(), y.column("node").to_numpy()
            near, ids = _cosines(xv, yv) >= threshold, np.concatenate([xi, yi])
            every = np.zeros((len(ids), len(ids)), bool)
            every[: len(xi), len(xi) :], every[len(xi) :, : len(xi)] = near, near.T
            nodes, counts = ids, np.concatenate([near @ ym, xm @ near])
        joined = star_edges(ids, lambda i, j: every[np.ix_(i, j)])
        some = counts > 0
        a = pa.concat_arrays([joined.column("a").combine_chunks(), pa.array(nodes[some], pa.int64())])
        b = pa.concat_arrays([joined.column("b").combine_chunks(), pa.array(nodes[some], pa.int64())])
        n = pa.array(np.concatenate([np.zeros(joined.num_rows, np.int64), counts[some].astype(np.int64)]))
        return pa.table({"a": a, "b": b, "n": n})

    return compare


def near_vectors(
    vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93, window: int = 128, miss: float = 1e-4, seed: int = 3
) -> DataFrame:
    """``key``, ``n_links``, ``component_id`` and ``kept`` for every row of ``vectors``.

    Vectors of equal label and length link from cosine ``threshold`` on, in double precision.
    ``n_links`` counts the other rows linked directly, copies included. A component's id is
    its least key; the row with that key is kept. Equal vectors, told apart by 128 bits of label and components, are compared once
    and counted as often as they are there. Null, zero and empty vectors, ones with null or
    non-finite components and null labels link with nothing, and neither does a
    null key. Repeated rows are further copies. An empty table gives an empty table. The number of passes follows from the largest label, from how
    unevenly each label's vectors lie and from ``miss``, the share of links at the threshold that may be lost between components, half of it by the passes and half by the sketches.
    """
    rows = vectors.select(F.col(key).alias("key"), F.col(label).cast("string").alias("label"), F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0)).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("key").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0)
    ids = [F.xxhash64(F.lit(s), "label", "v").alias(name) for s, name in ((3, "i1"), (5, "i2"))]
    rows = rows.select("*", F.coalesce(usable, F.lit(False)).alias("ok"), *ids)
    classes = rows.filter("ok").groupBy("i1", "i2").agg(F.min("key").alias("rep"), F.count("*").alias("m"), F.any_value(F.struct("label", "v")).alias("one"))
    classes = materialize(classes.select("i1", "i2", "rep", "m", "one.*", F.size("one.v").alias("dim"), F.monotonically_increasing_id().alias("cls")), "vectors-classes")
    plan, passes = _plan(classes, window, threshold, miss / 2, seed)
    keyed = materialize(_keys(classes, passes, seed).join(plan, ["label", "dim"]).withColumn("keys", F.slice("keys", F.lit(1), F.col("passes"))).drop("label"), "vectors-keys")
    dims = [r[0] for r in plan.select("dim").distinct().collect()]  # lengths, of which there are few
    limit = F.element_at(F.create_map(*[F.lit(x) for d in dims for x in (d, float(sketch_limit(d, threshold, miss / 2)))]), F.col("dim")) if dims else F.lit(0.0)
    placed = keyed.select("cls", "line", "signs", "sketch", limit.alias("limit"), F.posexplode("keys").alias("pass", "key"))
    placed = placed.select((F.col("line") + F.col("pass")).alias("line"), "key", "cls", "sketch", "limit", F.expr(f"shiftright(key, {BITS} - signs)").alias("lead"))
    near = materialize(components(_links(placed, window), "vectors-near"), "vectors-candidates")
    members = near.join(classes.select("cls", "m", "v", "dim"), F.col("node") == F.col("cls")).select(F.col("root").alias("comp"), "node", "m", "v", (F.col("dim") * 8).cast("long").alias("bytes"))
    found = materialize(compare_within(members, _verified(threshold), "a long, b long, n long"), "vectors-links")
    linked = components(found.filter("a <> b").select("a", "b"), "vectors")
    counts = found.filter("a = b").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n"))
    known = classes.select("i1", "i2", "cls", "rep", "m").join(linked.withColumnRenamed("node", "cls"), "cls", "left").join(counts, "cls", "left")
    known = materialize(known.select("i1", "i2", "rep", F.coalesce("root", "cls").alias("root"), (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n")), "vectors-linked")
    first = materialize(known.groupBy("root").agg(F.min("rep").alias("first")), "vectors-first")
    known = materialize(known.join(first, "root").select("i1", "i2", "n", "first"), "vectors-known")
    met = rows.filter("ok").select("key", "i1", "i2").join(known, ["i1", "i2"]).select("key", "n", "first")
    rest = rows.filter("not ok").select("key", F.lit(0).cast("long").alias("n"), F.col("key").cast("long").alias("first"))
    return met.union(rest).select(F.col("key").alias(key), F.col("n").alias("n_links"), F.col("first").alias("component_id"), F.coalesce(F.col("key") == F.col("first"), F.lit(True)).alias("kept"))
