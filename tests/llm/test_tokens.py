import random

import pytest

from odarel.llm.tokens import PieceCounts, count_tokens, load_tokenizer, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE, WORD = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
BITS = ["a", "B", " ", "  ", "\n", "'s", "'ll", "1", "9", "<|endoftext|>", "<|endof", "é", "日本", "!!", "\t", ".", "𝄞", "\x1c", "\x85", "\xa0", "　", "​", "\r\n", "x" * 70, " " * 150]


def texts(n, most, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(BITS, k=rng.randint(0, most))) for _ in range(n)]


def test_splice_equals_whole():
    model = load_tokenizer(BYTE)

    def encode(x):
        return model.encode(x, add_special_tokens=False)

    for x in texts(150, 400, 1):
        for chunk, overlap in ((100, 70), (200, 80), (300, 2)):
            assert count_tokens(x, encode, chunk, overlap) == len(encode(x))
    assert count_tokens("z" * 5000, encode, 100, 10) == len(encode("z" * 5000))


def test_pieces_equal_whole():
    model = load_tokenizer(BYTE)
    assert PieceCounts.fits(model) and not PieceCounts.fits(load_tokenizer(WORD))
    xs = texts(3000, 30, 2) + [f"a{chr(c)} b {chr(c)}c{chr(c)}{chr(c)}" for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    counts = PieceCounts(model, most=500)
    got = [n for i in range(0, len(xs), 100) for n in counts(xs[i : i + 100])]
    assert got == [len(e) for e in model.encode_batch(xs, add_special_tokens=False)]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_rows(spark, path):
    model = load_tokenizer(path)
    rows = [(1, None), (2, ""), (None, "a b"), (3, "word " * 30_000), (3, "word " * 30_000), (4, "<|endoftext|> x é"), (5, "a" * 513)]
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, n_tokens int")
    got = token_counts(df, path).collect()
    want = [(i, len((t or "").encode()), n := len(model.encode(t or "", add_special_tokens=False)), n > 512) for i, t in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert token_counts(df.filter("false"), path).count() == 0
