"""Benchmark decontamination by winnowing.

Of every six consecutive 5-grams, in documents and in benchmark items, the one
with the least hash is kept as a fingerprint. A span of ten words has six
5-grams, so any that a document shares with an item leaves the same fingerprint
in both. Documents meet the benchmark's fingerprints where they are read;
a hit is extended to the windows around it, each compared by 128 bits. Items of
fewer than ten words are a window of their own length and are looked up as a whole,
since winnowing promises nothing below ten words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odarel.llm.shared import materialize
from odarel.llm.words import gram_hashes, mix, multipliers, text_hashes

WINDOW = 10
GRAM = 5
SPAN = WINDOW - GRAM + 1


def winnow(grams: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Positions of the least hash, the leftmost of equals, of every ``span`` consecutive ones."""
    n = len(grams) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least = grams[:n].copy()
    for i in range(1, span):
        np.minimum(least, grams[i : i + n], out=least)
    at = np.arange(n) + span - 1
    for i in range(span - 2, -1, -1):
        at[grams[i : i + n] == least] = -1 - i
    at = np.where(at < 0, np.arange(n) - 1 - at, at)
    return at[np.concatenate([[True], at[1:] != at[:-1]])]


def _hashes_at(words: np.ndarray, starts: np.ndarray, k: int, seed: int) -> np.ndarray:
    """``gram_hashes`` at some places only."""
    out = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for i, m in enumerate(multipliers(k, seed)):
            out += words[starts + i] * m
    return mix(out)


class Windows:
    """Windows of one length, by hash, with the items that have each."""

    def __init__(self, length: int, parts: list[tuple[np.ndarray, int]]):
        self.length = length
        first = np.concatenate([gram_hashes(w, length, 1) for w, _ in parts])
        second = np.concatenate([gram_hashes(w, length, 2) for w, _ in parts])
        owner = np.concatenate([np.full(len(w) - length + 1, i) for w, i in parts])
        order = np.lexsort((owner, second, first))
        first, second, owner = first[order], second[order], owner[order]
        new = np.ones(len(first), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        self.first, self.second = first[new], second[new]
        self.begin = np.append(np.flatnonzero(new), len(first))
        self.owner = owner

    def find(self, words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, set[int]]:
        """Which of ``starts`` begin a window, and the items that have these windows."""
        first, second = (_hashes_at(words, starts, self.length, s) for s in (1, 2))
        at = np.minimum(np.searchsorted(self.first, first), len(self.first) - 1)
        hit = (self.first[at] == first) & (self.second[at] == second)
        owners: set[int] = set()
        for i in np.unique(at[hit]):
            owners.update(self.owner[self.begin[i] : self.begin[i + 1]].tolist())
        return starts[hit], owners


class Benchmark:
    """Fingerprints and windows of a block of benchmark items."""

    def __init__(self, items: list[tuple[str, str]]):
        self.ids = sorted({i for i, _ in items})
        place = {x: n for n, x in enumerate(self.ids)}
        by_length: dict[int, list[tuple[np.ndarray, int]]] = {}
        prints = [np.zeros(0, np.uint64)]
        for name, text in items:
            words = text_hashes(text)
            if len(words):
                by_length.setdefault(min(WINDOW, len(words)), []).append((words, place[name]))
            if len(words) >= WINDOW:
                grams = gram_hashes(words, GRAM)
                prints.append(grams[winnow(grams)])
        self.windows = {n: Windows(n, parts) for n, parts in by_length.items()}
        self.prints = np.unique(np.concatenate(prints))
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.prints >> np.uint64(48)).astype(np.int64)] = True

    def hits(self, words: np.ndarray) -> tuple[list[tuple[int, int]], list[str]]:
        """Merged spans of hit words, end exclusive, and the ids of the items hit."""
        spans: list[tuple[int, int]] = []
        owners: set[int] = set()
        for n, windows in self.windows.items():
            if len(words) < n:
                continue
            if n == WINDOW:
                grams = gram_hashes(words, GRAM)
                at = winnow(grams)
                at = at[self.maybe[(grams[at] >> np.uint64(48)).astype(np.int64)]]
                if not len(at):
                    continue
                place = np.minimum(np.searchsorted(self.prints, grams[at]), len(self.prints) - 1)
                at = at[self.prints[place] == grams[at]]
                if not len(at):
                    continue
                starts = np.unique((at[:, None] - np.arange(SPAN)[None, :]).ravel())
                starts = starts[(starts >= 0) & (starts <= len(words) - n)]
            else:
                first = gram_hashes(words, n, 1)
                starts = np.flatnonzero(np.isin(first, windows.first))
            found, who = windows.find(words, starts)
            spans += [(int(s), int(s) + n) for s in found]
            owners |= who
        return merged(spans), [self.ids[i] for i in owners]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, key: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The benchmark's items in blocks of about ``block_bytes``: the only thing sent to every executor."""
    items = benchmark.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    for b in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == b)
        yield [(r["id"], r["text"]) for r in part.toLocalIterator()]


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", block_bytes: int = 32 << 20
) -> DataFrame:
    """``key``, ``n_words``, ``spans`` of hit words (end exclusive) and the ``items`` hit, per row of ``docs``.

    Items are named by their id as text, sorted; items that share an id are one, a
    null id is the empty name. A benchmark of more than ``block_bytes`` is taken in
    blocks, each against all documents, with the hits so far written in between.
    Null and empty texts have no words and no hits; items without words have no
    window. Repeated rows are looked at each; empty tables give no rows or no
    hits. Other columns are ignored.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    shape = f"key {kind}, text string, n_words long, spans array<struct<start:int,end:int>>, items array<string>"
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items"))
    blocks = _blocks(benchmark, item_key, item_text, block_bytes)
    block = next(blocks)
    while block is not None:
        after = next(blocks, None)
        shared = spark.sparkContext.broadcast(Benchmark(block))
        last = after is None

        def run(batches: Iterator[pa.RecordBatch], shared=shared, last=last) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                counts, spans, items = [], [], []
                before = zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)
                for x, (old, names) in zip(batch.column(1), before, strict=True):
                    words = text_hashes(x.as_py())
                    found, who = index.hits(words)
                    counts.append(len(words))
                    spans.append([{"start": a, "end": b} for a, b in merged(found + [(s["start"], s["end"]) for s in old])])
                    items.append(sorted({*who, *names}))
                kept = pa.nulls(batch.num_rows, pa.string()) if last else batch.column(1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), kept, pa.array(counts, pa.int64()), pa.array(spans, span_type), pa.array(items, pa.list_(pa.string()))],
                    names=["key", "text", "n_words", "spans", "items"],
                )

        rows = rows.mapInArrow(run, shape)
        if not last:
            rows = materialize(rows, "contamination-block")
        block = after
    return rows.select(F.col("key").alias(key), "n_words", "spans", "items")


def clean_rows(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_key: str = "item_id", item_text: str = "text", block_bytes: int = 32 << 20) -> DataFrame:
    """The rows of ``docs``, all columns, without a hit."""
    names = docs.columns
    for block in _blocks(benchmark, item_key, item_text, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(Benchmark(block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                yield batch.filter(pa.array([not index.hits(text_hashes(x.as_py()))[0] for x in batch.column(names.index(text))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
