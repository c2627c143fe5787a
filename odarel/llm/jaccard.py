"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of hashed word 5-grams. Texts with equal sets form a class and
are compared once. MinHash bands bring classes together in buckets. Inside a bucket MinHash
values are compared a few at a time, and a pair is dropped as soon as the posterior
probability that its similarity reaches the threshold falls below a tolerance. Only pairs of a
bucket that stay tie classes to candidate groups, so that loosely alike texts form no chains; only
then do texts move, and the pairs that the posterior keeps are verified by the exact Jaccard similarity of the sets.

Rows are found again by 128 bits of key and text. One plan serves all sizes: the texts of
candidates and the rows of the result are joined by exchange, never by a broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odarel.llm.graph import Forest, compare_within, components, star_edges
from odarel.llm.shared import materialize
from odarel.llm.words import gram_hashes, text_hashes

BANDS, ROWS = 32, 6
HASHES = BANDS * ROWS
STEP = 32
_rng = np.random.default_rng(11)
_A = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_MIX = _rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


def shingles(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's runs of k words; a shorter text is one run."""
    words = text_hashes(text)
    return np.unique(gram_hashes(words, min(k, len(words)), k)) if len(words) else words


def class_of(grams: np.ndarray) -> int:
    """64 bits that stand for the whole set."""
    with np.errstate(over="ignore"):
        mixed = (grams ^ (grams >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        total = mixed.sum(dtype=np.uint64) * np.uint64(0x94D049BB133111EB) + np.bitwise_xor.reduce(grams) + np.uint64(len(grams))
        return int((total ^ (total >> np.uint64(31))).astype(np.int64))


def signature(grams: np.ndarray, piece: int = 2048) -> np.ndarray:
    """HASHES least values of the set under as many permutations of 32 bits."""
    low = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    x = (grams >> np.uint64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(x), piece):
            np.minimum(low, (_A[:, None] * x[None, i : i + piece] + _B[:, None]).min(1), out=low)
    return low


def band_hashes(sig: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (sig.reshape(BANDS, ROWS).astype(np.uint64) * _MIX).sum(1, dtype=np.uint64)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + np.arange(BANDS, dtype=np.uint64)
        return (h ^ (h >> np.uint64(29))).astype(np.int64)


def low_bytes(sig: np.ndarray) -> bytes:
    """A byte of each MinHash value: equal values stay equal, different ones are so in 1 of 256 cases."""
    with np.errstate(over="ignore"):
        return ((sig * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def least_matches(threshold: float, tolerance: float, step: int = STEP, hashes: int = HASHES) -> list[int]:
    """For n = step, 2 step, ...: the fewest equal MinHash values with which a pair stays.

    With a uniform prior, the similarity after m of n equal values is Beta(m+1, n-m+1)
    distributed; P(similarity >= t) is P(Binomial(n+1, t) <= m). Of values only a byte is
    compared, which can only add matches, so that no more pairs are dropped.
    """
    out = []
    for n in range(step, hashes + 1, step):
        below, m = 0.0, -1
        while below < tolerance:
            m += 1
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def row_ids(key: Column, text: Column) -> list[Column]:
    """128 bits that stand for a row's key and text."""
    return [F.xxhash64(F.lit(seed), key.isNull(), key, text).alias(name) for seed, name in ((3, "i1"), (5, "i2"))]


def sketches(docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """``key``, ``i1``, ``i2``, and the class, set size, MinHash bytes and bands (null without words) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, sizes, sigs, bands = [], [], [], []
            for x in batch.column(3):
                grams = shingles(x.as_py(), k)
                sig = signature(grams) if len(grams) else None
                classes.append(class_of(grams) if len(grams) else None)
                sizes.append(len(grams))
                sigs.append(low_bytes(sig) if len(grams) else None)
                bands.append(band_hashes(sig) if len(grams) else None)
            found = [pa.array(classes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *found], names=["key", "i1", "i2", "cls", "size", "sig", "bands"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), *row_ids(F.col(key), F.col(text)), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, i1 long, i2 long, cls long, size long, sig binary, bands array<long>")


def shared_buckets(classes: DataFrame) -> DataFrame:
    """``bucket`` and ``cls`` of buckets with several classes.

    Of buckets with the same classes, told apart by their number and two sums of hashes, one stays: near copies
    share most of their buckets.
    """
    placed = classes.select("cls", F.explode("bands").alias("bucket")).repartition("bucket")
    found = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "cls")).alias("y"))
    chosen = materialize(found.filter("n > 1").groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket"), "jaccard-buckets")
    return placed.join(chosen, "bucket").select("bucket", "cls")


def pruned(sx: np.ndarray, sy: np.ndarray, i: np.ndarray, j: np.ndarray, least: list[int], piece: int = 65536) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (i, j) of rows of two MinHash matrices that the posterior keeps."""
    matches = np.zeros(len(i), np.int32)
    for s, m in enumerate(least):
        cut = slice(s * STEP, (s + 1) * STEP)
        for lo in range(0, len(i), piece):
            part = slice(lo, lo + piece)
            matches[part] += (sx[i[part], cut] == sy[j[part], cut]).sum(1, dtype=np.int32)
        keep = matches >= m
        i, j, matches = i[keep], j[keep], matches[keep]
    return i, j


def _alike(size_x: np.ndarray, size_y: np.ndarray, threshold: float) -> np.ndarray:
    """Which sizes allow the threshold."""
    return np.minimum(size_x[:, None], size_y[None, :]) >= threshold * np.maximum(size_x[:, None], size_y[None, :]) - 1e-9


def _signatures(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    raw = b"".join(table.column("sig").to_pylist())
    return np.frombuffer(raw, np.uint8).reshape(-1, HASHES), table.column("size").to_numpy()


def _survivors(threshold: float, tolerance: float):
    """Edges that join what the posterior keeps in one or two blocks of a bucket: a star per component."""
    least = least_matches(threshold, tolerance)

    def compare(x: pa.Table, y: pa.Table | None) -> pa.Table:
        both = x if y is None else pa.concat_tables([x, y])
        sig, size = _signatures(both)

        def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            out = np.zeros((len(i), len(j)), bool)
            p, q = np.nonzero(_alike(size[i], size[j], threshold))
            p, q = pruned(sig[i], sig[j], p, q, least)
            out[p, q] = True
            return out

        return star_edges(both.column("node").to_numpy(), near)

    return compare


def _common(xs: list[np.ndarray], ys: list[np.ndarray], piece: int = 4096) -> np.ndarray:
    """Sizes of the intersections of every x and y.

    Each distinct shingle that is on both sides is a column of two 0/1 matrices, whose
    product is summed up over pieces of columns.
    """
    flat_x, flat_y = np.concatenate(xs), np.concatenate(ys)
    row_x, row_y = np.repeat(np.arange(len(xs)), [len(v) for v in xs]), np.repeat(np.arange(len(ys)), [len(v) for v in ys])
    both = np.intersect1d(flat_x, flat_y)
    out = np.zeros((len(xs), len(ys)), np.float32)

    def placed(flat: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(both, flat), max(0, len(both) - 1))
        ok = both[at] == flat if len(both) else np.zeros(len(flat), bool)
        order = np.argsort(at[ok], kind="stable")
        return at[ok][order], row[ok][order]

    cx, rx = placed(flat_x, row_x)
    cy, ry = placed(flat_y, row_y)
    for lo in range(0, len(both), piece):
        hi = min(lo + piece, len(both))
        a, b = np.searchsorted(cx, [lo, hi])
        c, d = np.searchsorted(cy, [lo, hi])
        mx, my = np.zeros((len(xs), hi - lo), np.float32), np.zeros((len(ys), hi - lo), np.float32)
        mx[rx[a:b], cx[a:b] - lo] = 1
        my[ry[c:d], cy[c:d] - lo] = 1
        out += mx @ my.T
    return out


def links(x: pa.Table, y: pa.Table | None, threshold: float, least: list[int], k: int) -> np.ndarray:
    """Which pairs of texts have a Jaccard similarity of at least ``threshold``, among those that the posterior keeps."""
    sig_x, size_x = _signatures(x)
    sig_y, size_y = (sig_x, size_x) if y is None else _signatures(y)
    alive = _alike(size_x, size_y, threshold)
    if y is None:
        alive = np.triu(alive, 1)
    i, j = pruned(sig_x, sig_y, *np.nonzero(alive), least)
    out = np.zeros_like(alive)
    if not len(i):
        return out
    ux, px = np.unique(i, return_inverse=True)
    uy, py = np.unique(j, return_inverse=True)
    text_x, text_y = x.column("text"), (x if y is None else y).column("text")
    xs, ys = [shingles(text_x[int(a)].as_py(), k) for a in ux], [shingles(text_y[int(b)].as_py(), k) for b in uy]
    if len(i) * 4 < len(ux) + len(uy) or len(i) < 8:
        inter = np.array([len(np.intersect1d(xs[a], ys[b], assume_unique=True)) for a, b in zip(px, py, strict=True)])
    else:
        inter = _common(xs, ys)[px, py]
    hit = inter >= threshold * (size_x[i] + size_y[j] - inter) - 1e-9
    out[i[hit], j[hit]] = True
    return out


def _compare(threshold: float, tolerance: float, k: int):
    """Rows (a, b, 0) that join what links in one or two blocks, and (a, a, n) with a's number of linked rows."""
    least = least_matches(threshold, tolerance)

    def compare(x: pa.Table, y: pa.Table | None) -> pa.Table:
        other = x if y is None else y
        xi, xm, yi, ym = x.column("node").to_numpy(), x.column("m").to_numpy(), other.column("node").to_numpy(), other.column("m").to_numpy()
        a, b, n = [], [], []
        if len(xi) and len(yi):
            hit = links(x, y, threshold, least, k)
            forest = Forest()
            for p, q in zip(*np.nonzero(hit), strict=True):
                if forest.join(int(xi[p]), int(yi[q])):
                    a.append(int(xi[p]))
                    b.append(int(yi[q]))
                    n.append(0)
            both = hit | hit.T if y is None else hit
            for nodes, count in ((xi, both @ ym), *(() if y is None else ((yi, xm @ both),))):
                some = count > 0
                a += nodes[some].tolist()
                b += nodes[some].tolist()
                n += count[some].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})

    return compare


def _joined(docs: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = 0.8, k: int = 5, tolerance: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """The sketch of every row, and ``cls``, ``root``, ``class_id`` and ``n`` (links) of every class; both written."""
    sketch = materialize(sketches(docs, key, text, k), "jaccard-sketches")
    one = F.any_value(F.struct("i1", "i2", "size", "sig", "bands")).alias("one")
    classes = sketch.filter("cls is not null").groupBy("cls").agg(F.min("key").alias("rep"), F.count("*").alias("m"), one)
    classes = materialize(classes.select("cls", "rep", "m", "one.*"), "jaccard-classes")
    met = materialize(shared_buckets(classes), "jaccard-met")
    held = met.join(classes.select("cls", "size", "sig"), "cls").select(F.col("bucket").alias("comp"), F.col("cls").alias("node"), "size", "sig", F.lit(HASHES + 16).cast("long").alias("bytes"))
    near = components(compare_within(held, _survivors(threshold, tolerance), "a long, b long"), "jaccard-near")
    near = near.join(classes.select("cls", "m", "i1", "i2", "size", "sig"), F.col("node") == F.col("cls")).withColumnRenamed("root", "comp").drop("cls")
    near = materialize(near, "jaccard-candidates")
    texts = docs.select(*row_ids(F.col(key), F.col(text)), F.col(text).alias("text")).filter("text is not null")
    members = texts.hint("merge").join(near, ["i1", "i2"])
    members = members.groupBy("node").agg(F.any_value(F.struct("comp", "m", "size", "sig", "text")).alias("one")).select("node", "one.*")  # a row that is there twice is compared once
    members = materialize(members.withColumn("bytes", F.octet_length("text").cast("long")), "jaccard-texts")
    found = materialize(compare_within(members, _compare(threshold, tolerance, k), "a long, b long, n long"), "jaccard-links")
    linked = components(found.filter("a <> b").select("a", "b"), "jaccard-classes")
    counts = found.filter("a = b").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n"))
    known = classes.select("cls", "rep", "m").join(linked.withColumnRenamed("node", "cls"), "cls", "left").join(counts, "cls", "left")
    known = known.select("cls", "rep", F.coalesce("root", "cls").alias("root"), (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n"))
    known = materialize(known, "jaccard-linked")
    first = materialize(known.groupBy("root").agg(F.min("rep").alias("class_id")), "jaccard-first")
    return sketch, materialize(known.join(first, "root").select("cls", "root", "class_id", "n"), "jaccard-known")


def jaccard_join(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``key``, ``class_id``, ``n_links`` and ``kept`` for every row of ``docs``.

    Two rows link if the sets of their word ``k``-grams, case folded for A-Z, have
    a Jaccard similarity of ``threshold`` or more. ``n_links`` counts the other
    rows linked directly, equal texts included; ``class_id`` is the least key that links
    reach, and the row with it is kept.

    A text of fewer than ``k`` words is a single gram. Null texts and texts without words link
    with nothing. Repeated rows are copies of each other, and of those that share the least
    key, all are marked kept. A null key is compared like any other and never the least unless all are null; an empty table gives an empty
    table. Other columns are ignored, whatever their names. Options: ``threshold``, ``k`` and ``tolerance``. A pair exactly at the default threshold
    meets in no bucket with probability 6e-5, if MinHash values were drawn independently, and is dropped with about ``tolerance``; what is
    reported is exact but for equal 64-bit hashes of word runs and classes.
    """
    sketch, known = _joined(docs, key=key, text=text, **options)
    out = sketch.select("key", "cls").join(known, "cls", "left")
    return out.select(
        F.col("key").alias(key),
        F.when(F.col("cls").isNull(), F.col("key")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        (F.col("cls").isNull() | F.col("key").eqNullSafe(F.col("class_id"))).alias("kept"),
    )


def one_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, with one row of each class: that with its least key.

    Null texts and texts without words all stay. Rows equal in key and text are one another's copies, and any one
    stays for them; of several texts with the least key, one stays. A null key is the least only where all are null. An
    empty table gives an empty table. Every row moves once, to be joined with the 128 bits that name the rows to drop.
    """
    sketch, known = _joined(docs, key=key, text=text, **options)
    rows = sketch.filter("cls is not null").join(known.select("cls", "root"), "cls").select("root", "key", "i1", "i2")
    rows = materialize(rows, "jaccard-rows")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("key").isNull().alias("absent"), "key", "i1", "i2")).alias("first"))
    first = materialize(first.select("first.i1", "first.i2"), "jaccard-kept")
    again = rows.groupBy("i1", "i2").count()
    again = materialize(again.join(first.withColumn("first", F.lit(True)), ["i1", "i2"], "left").filter("first is null or count > 1"), "jaccard-again")
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *row_ids(F.col(key), F.col(text)))
    single = whole.hint("merge").join(again, ["i1", "i2"], "left_anti").select("row.*")
    repeated = again.filter("first")
    if repeated.isEmpty():
        return single
    one = whole.join(repeated, ["i1", "i2"], "left_semi").groupBy("i1", "i2").agg(F.any_value("row").alias("row"))
    return single.union(one.select("row.*"))
