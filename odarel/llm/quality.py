"""Quality scores by Bradley-Terry pairwise ranking.

Each pair of a good and a bad labelled document says that the first is
preferred. The score is linear in features of the text alone, counts of its shape and shares of its
hashed words, fitted by logistic loss on the pairs' feature differences. A quantile of the training scores is the
threshold, and a logistic curve through it maps scores to 0..1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odarel.llm.words import SPLIT, gram_hashes, text_hashes, word_hashes

_SYMBOLS = b"#$%&*^~@+=_<>{}[]\\`"
_UPPER, _LOWER, _DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
RATIOS = ("symbols", "shouts", "pipes", "upper", "digits", "repeated5", "repeated3", "stutter", "not_ascii", "slashes")
SHAPE = (*RATIOS, *(f"root_{x}" for x in RATIOS), "word_length", "log_words", "line_length")
#: Buckets that words, in lower case, are hashed to; a bucket's feature is the root of its share of the words.
BUCKETS = 256
FEATURES = (*SHAPE, *(f"words_{i}" for i in range(BUCKETS)))
#: Rows or pairs whose features are held in double precision at once.
BLOCK = 2_000


def word_shares(text: str | None) -> np.ndarray:
    """Roots of the shares of the text's words by bucket."""
    words = text_hashes(text)
    counts = np.bincount((words >> np.uint64(40)) % np.uint64(BUCKETS), minlength=BUCKETS) if len(words) else np.zeros(BUCKETS)
    return np.sqrt(counts / max(1, len(words)))


def features(text: str | None) -> list[float]:
    """FEATURES of one whole text; zeros where there is nothing to measure."""
    return [*shape(text), *word_shares(text).tolist()]


def shape(text: str | None) -> list[float]:
    """Counts of one whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    hashes = word_hashes(raw, SPLIT)
    n, size = len(hashes), len(raw)
    if not n:
        return [0.0] * len(SHAPE)

    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)

    def count(chars: bytes) -> int:
        return int(seen[np.frombuffer(chars, np.uint8)].sum())

    upper = count(_UPPER)

    def repeated(k: int) -> float:
        grams = gram_hashes(hashes, k)
        grams.sort()
        return float(np.count_nonzero(grams[1:] == grams[:-1])) / len(grams) if len(grams) else 0.0

    ratios = [
        count(_SYMBOLS) / size,
        min(1.0, (count(b"!?")) / n),
        min(1.0, count(b"|") / n),
        upper / max(1, upper + count(_LOWER)) if n > 3 else 0.0,
        count(_DIGITS) / size,
        repeated(5),
        repeated(3),
        float(np.mean(hashes[1:] == hashes[:-1])) if n > 1 else 0.0,
        int(seen[128:].sum()) / size,
        min(1.0, count(b"/") / n),
    ]
    lines = count(b"\n") + 1
    return [*ratios, *np.sqrt(ratios).tolist(), min(50.0, size / n) / 10, float(np.log1p(n)) / 10, float(np.log1p(n / lines)) / 10]


@dataclass(frozen=True)
class Ranking:
    """A fitted score: (f - mean) / scale . weights, the threshold and the steepness of the curve."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    steepness: float

    def score(self, f: list[float]) -> float:
        """Between 0 and 1; 0.5 at the threshold."""
        raw = float(((np.asarray(f) - self.mean) * (self.weights / self.scale)).sum())
        return 1 / (1 + exp(-max(-700.0, min(700.0, self.steepness * (raw - self.threshold)))))

    def scores(self, texts: pa.Array) -> np.ndarray:
        return np.array([self.score(features(x.as_py())) for x in texts], float)


def fit(x: np.ndarray, y: np.ndarray, *, pairs: int = 40_000, ridge: float = 1e-3, word_ridge: float = 0.03, rounds: int = 25, seed: int = 5) -> Ranking:
    """Fit on rows ``x`` with labels ``y`` (1 preferred to 0).

    Words are held back by ``word_ridge``, so that they tell what the text's shape leaves open. Without both labels there are no pairs: every score is then 0.5.
    """
    k = len(FEATURES)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranking(np.zeros(k), np.ones(k), np.zeros(k), 0.0, 1.0)
    held = np.r_[np.full(len(SHAPE), ridge), np.full(k - len(SHAPE), word_ridge)]
    blocks = [slice(i, i + BLOCK) for i in range(0, len(x), BLOCK)]
    mean = x.mean(0, dtype=float)
    scale = np.sqrt(sum(np.square(x[b] - mean).sum(0) for b in blocks) / len(x))
    scale[scale < 1e-9] = 1.0
    rng = np.random.default_rng(seed)
    first, second = good[rng.integers(0, len(good), pairs)], bad[rng.integers(0, len(bad), pairs)]
    w = np.zeros(k)
    for _ in range(rounds):  # Newton steps on the mean logistic loss of the differences
        grad, hess = held * w, np.diag(held)
        for i in range(0, pairs, BLOCK):  # the differences of all pairs at once would be larger than x
            d = (x[first[i : i + BLOCK]].astype(float) - x[second[i : i + BLOCK]]) / scale
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            grad -= (d.T @ p) / pairs
            hess += (d * (p * (1 - p))[:, None]).T @ d / pairs
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    s, label = np.concatenate([((x[b] - mean) / scale) @ w for b in blocks]), y == 1
    order = np.argsort(s, kind="stable")
    s, label = s[order], label[order]
    # right answers if the lowest i scores are rejected, for each i between two different scores
    right = np.concatenate([[0], np.cumsum(~label)]) + np.concatenate([np.cumsum(label[::-1])[::-1], [0]])
    cut = np.concatenate([[True], s[1:] > s[:-1], [True]])
    best = int(np.argmax(np.where(cut, right, -1)))
    quantile = best / len(s)
    at = round(quantile * len(s))
    threshold = float(s[0] - 1 if at == 0 else s[-1] + 1 if at == len(s) else (s[at - 1] + s[at]) / 2)
    z, t, a = s - threshold, label.astype(float), 1.0
    for _ in range(50):  # steepness by Newton, kept positive
        p = 1 / (1 + np.exp(np.clip(-a * z, -30, 30)))
        grad, curve = float(((p - t) * z).mean()) + 1e-3 * a, float((p * (1 - p) * z * z).mean()) + 1e-3
        a = min(20.0, max(1e-3, a - grad / curve))
    return Ranking(mean, scale, w, threshold, a)


def held_out(key: Column) -> Column:
    """Whether crc32 of the key as text leaves 1 when divided by 3; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = 20_000) -> Ranking:
    """Fit on labelled rows that are not held out; only their texts are read for it.

    ``most`` bounds the keys whose features the driver gets: of more labelled keys, those whose
    hash falls below a share of all hashes that leaves nine tenths of ``most``. They are sent to all tasks, so that no text moves. Null
    labels and keys don't count; of several labels of a key the mean decides, a draw
    counts as none. Of several texts of a key the one with the least hash counts.
    """
    votes = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("key")).agg(F.avg(label).alias("v")).filter("v <> 0.5")
    share = min(1.0, 0.9 * most / max(1, votes.count()))
    if share < 1.0:
        votes = votes.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 32)) < int(share * (1 << 32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([np.array(features(x.as_py()), np.float32).tobytes() for x in batch.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], names=["key", "v", "f"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(votes), "key")
    rows = rows.select("key", "v", "text").mapInArrow(run, f"key {kind}, v double, f binary")
    got = rows.groupBy("key").agg(F.min(F.struct(F.xxhash64("f").alias("h"), "f", "v")).alias("one")).select("one.f", "one.v").toArrow()
    y = (got.column("v").to_numpy() > 0.5).astype(int)
    x = np.empty((len(y), len(FEATURES)), np.float32)
    at = 0
    for chunk in got.column("f").chunks:
        for f in chunk:
            x[at] = np.frombuffer(f.as_buffer(), np.float32)
            at += 1
    del got
    order = np.lexsort((*x.T, y))  # rows come in any order; reruns agree
    return fit(x[order], y[order])


def quality_scores(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = 20_000) -> DataFrame:
    """``key``, ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) for every row of ``docs``.

    Scores come from whole texts only, read once. A null or empty text has zero
    for every feature and the score that follows from it; repeated rows get the same score; a null key is scored
    but never trained on. An empty table gives an empty table. Other columns are ignored.
    """
    model = train(docs, labels, key=key, text=text, label=label, most=most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.scores(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["key", "held_out", "score", "predicted"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), held_out(F.col(key)).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, held_out boolean, score double, predicted int").withColumnRenamed("key", key)


def accepted_rows(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = 20_000) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, that ``quality_scores`` predicts 1 for; the text moves through no shuffle.

    Null and empty texts, null keys and repeated rows are scored like any other; an empty table gives an empty table.
    """
    model = train(docs, labels, key=key, text=text, label=label, most=most)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(model.scores(batch.column(at)) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
