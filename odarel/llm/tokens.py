"""Token counts of whole texts, huge ones by overlap resynchronisation.

A text longer than a chunk is encoded in overlapping chunks with offsets. Two
neighbours are spliced where both have a boundary between pre-tokens at the
same place, far enough from the left chunk's cut end. There the splitter
forgets what came before and reads the same text on, so that whatever follows
in the right chunk is what the whole text gives. Where the overlap has no such
place it is doubled, up to the whole text.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 16
OVERLAP = 1 << 9
#: Characters before a chunk's cut end in which no boundary counts: longer than any
#: added token and than the one character that the splitter looks ahead.
MARGIN = 64


@cache
def piece_counts(path: str) -> PieceCounts | None:
    """The memo of this worker, kept from task to task."""
    model = load_tokenizer(path)
    return PieceCounts(model) if PieceCounts.fits(model) else None


@cache
def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


#: Unicode's white space, as the byte-level splitter's \\s has it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Letters in every Unicode version, and what surely ends a run of them.
LETTERS = "A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u017f"
AFTER = "!-&(-/:-@\\[-`{-~"
#: A byte-level splitter always ends a pre-token where white space follows other
#: characters or punctuation follows letters, and only a last plain space joins what
#: follows it.
PIECES = re.compile(f" ?[{LETTERS}]+(?![^{SPACE}{AFTER}])| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


class PieceCounts:
    """Tokens of texts, by counting each distinct piece between white space once.

    Only for byte-level tokenizers without a normalizer, which treat such pieces
    apart. The memo is emptied when it is full, which costs time only.
    """

    def __init__(self, tokenizer, most: int = 1_000_000, longest: int = 64):
        self.encode, self.most, self.longest, self.known = tokenizer.encode_batch_fast, most, longest, {}
        added = [t["content"] for t in json.loads(tokenizer.to_str())["added_tokens"]]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None

    @staticmethod
    def fits(tokenizer) -> bool:
        plan = json.loads(tokenizer.to_str())
        split = plan["pre_tokenizer"] or {}
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(f"[{SPACE}]", t["content"])) for t in plan["added_tokens"])
        return plain and plan["normalizer"] is None and split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]

    def __call__(self, texts: list[str]) -> list[int]:
        pieces = [[] if self.added and self.added.search(x) else PIECES.findall(x) for x in texts]
        new = list(set().union(*pieces).difference(self.known))
        if len(self.known) + len(new) > self.most:
            self.known = {}
            new = list(set().union(*pieces))
        fresh = dict(zip(new, map(len, self.encode(new, add_special_tokens=False)), strict=True))
        self.known.update(fresh)
        counts = [sum(map(self.known.__getitem__, x)) for x in pieces]
        for x in fresh:
            if len(x) > self.longest:
                del self.known[x]
        apart = [i for i, x in enumerate(pieces) if not x and texts[i]]  # an added token splits the text first
        for i, x in zip(apart, self.encode([texts[i] for i in apart], add_special_tokens=False), strict=True):
            counts[i] = len(x)
        return counts


def _boundaries(encoding) -> dict[int, int]:
    """Where a pre-token starts right after another one ends: place in the chunk, tokens before it."""
    found, offsets, words = {}, encoding.offsets, encoding.word_ids
    for i in range(1, len(offsets)):
        if offsets[i][0] == offsets[i - 1][1] and (words[i] is None or words[i] != words[i - 1]):
            found[offsets[i][0]] = i
    return found


def count_tokens(text: str, encode: Callable, chunk: int = CHUNK, overlap: int = OVERLAP, margin: int = MARGIN) -> int:
    """Tokens of the whole text; ``encode`` gives an Encoding. Holds two chunks at a time."""
    if len(text) <= chunk:
        return len(encode(text))
    total, start, end, width = 0, 0, chunk, overlap
    left = encode(text[:end])
    first = 0  # tokens of the left chunk before this one belong to its predecessor
    while end < len(text):
        low = max(start, end - width)
        stop = min(len(text), low + max(chunk, 2 * width))
        right = encode(text[low:stop])
        ends = {start + at: n for at, n in _boundaries(left).items() if n >= first and start + at <= end - margin}
        begins = {low + at: n for at, n in _boundaries(right).items()}
        common = max(ends.keys() & begins.keys(), default=None)
        if common is None:
            if low == start:  # the whole left chunk is one pre-token: take a longer one
                end = min(len(text), end + max(chunk, end - start))
                left = encode(text[start:end])
            width = min(2 * width, end - start)
            continue
        total += ends[common] - first
        left, first, start, end, width = right, begins[common], low, stop, overlap
    return total + len(left) - first


def token_counts(
    docs: DataFrame,
    tokenizer: str,
    *,
    key: str = "doc_id",
    text: str = "text",
    limit: int = 512,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
    batch_chars: int = 1 << 20,
) -> DataFrame:
    """``key``, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit``) of every text.

    ``tokenizer`` is the path of a tokenizers file that executors can read. Special
    strings inside a text count as the file's default says; none are added.
    Null and empty texts have 0 bytes and tokens. Rows stay as they are, repeated
    ones and null keys included; other columns are ignored. A worker
    holds a batch of texts of about ``batch_chars`` or a single longer one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_tokenizer(tokenizer)

        by_piece = piece_counts(tokenizer)

        def encode(part: str):
            return model.encode(part, add_special_tokens=False)

        def whole(texts: list[str]) -> list[int]:
            return by_piece(texts) if by_piece else [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]

        def counted(texts: list[str]) -> Iterator[int]:
            held: list[str] = []
            size = 0
            for x in texts:
                x = x or ""
                if held and (size + len(x) > batch_chars or len(x) > chunk):
                    yield from whole(held)
                    held, size = [], 0
                if len(x) > chunk:
                    yield count_tokens(x, encode, chunk, overlap)
                else:
                    held.append(x)
                    size += len(x)
            if held:
                yield from whole(held)

        for batch in batches:
            counts = pa.array(counted(batch.column(2).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts], names=["key", "n_bytes", "n_tokens"])

    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), F.octet_length(body).cast("long").alias("n_bytes"), body.alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    counts = rows.mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long")
    return counts.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
