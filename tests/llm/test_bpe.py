import random

import pytest

from lodestone.llm import bpe
from lodestone.llm.wordcode import Decoder, WordCoder, default_tokenizer, load, quick_core

ODD = ["a  b", " a", "a ", "\n\n a\tb  \n c ", "it's  'll  x", "x <|endoftext|> y  <|endoftext|>z", "é  b   c", "日本 語。 1234 56 ", "\x1c a \x1d  b", "", " ", "   ", "a" * 5000, "émü 😀 👩‍👩‍👧 x" * 200]


def texts():
    rng = random.Random(1)
    words = ["the", "éa", "12", "x.y", "\n", "", " ", "don't", "日本", "<|endoftext|>", "\t", "🙂", "supercalifragilistic"]
    out = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 400))) for _ in range(60)]
    passage = " ".join(rng.choice(words[:4]) + str(rng.randrange(999)) for _ in range(500))
    return ODD + out + [f"{rng.random()} {passage}{rng.choice(words)}{passage[:900]} {rng.random()}" for _ in range(20)]


@pytest.fixture(scope="module")
def tk():
    return load(default_tokenizer())


def test_words_equal_library(tk):
    coder = WordCoder(default_tokenizer(), cache_words=50)
    for t in texts():
        assert list(memoryview(coder.encode([t])[0]).cast("I")) == tk.encode(t, add_special_tokens=False).ids


def test_quick_core_equals_library(tk):
    quick, lengths, _ = quick_core(tk)
    rng = random.Random(9)
    tokens = [tk.decode([i]) for i in range(0, 50000, 7)]
    for _ in range(300):
        t = "".join(rng.choice(tokens) for _ in range(40))
        assert quick(t) == tk.encode(t, add_special_tokens=False).ids


def test_decoder_equals_library(tk):
    d, rng = Decoder(tk), random.Random(2)
    for _ in range(200):
        ids = [rng.randrange(tk.get_vocab_size()) for _ in range(rng.randrange(30))]
        assert d.text(ids) == tk.decode(ids, skip_special_tokens=False)


def test_any_cut_is_repaired(tk):
    coder, rng = WordCoder(default_tokenizer()), random.Random(3)
    for t in texts():
        for _ in range(5):
            at = sorted(rng.randrange(len(t) + 1) for _ in range(rng.randrange(6)))
            parts = [t[a:b] for a, b in zip([0, *at], [*at, len(t)], strict=True)]
            got = bpe.assemble(coder, list(zip(parts, coder.encode(parts), strict=True)))
            assert list(memoryview(got).cast("I")) == tk.encode(t, add_special_tokens=False).ids


def test_chunks_cover_and_recur():
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefgh é ") for _ in range(6000))
    a, b = (x + passage).encode() if (x := "start " * 40) else b"", ("other beginning " * 11 + passage).encode()
    for data in (a, b, ("é" * 40000).encode()):
        got = bpe.chunks(data)
        assert b"".join(data[x:y] for _, x, y in got) == data
        assert all(data[x:y].decode() for _, x, y in got)
    assert len({h for h, _, _ in bpe.chunks(a)} & {h for h, _, _ in bpe.chunks(b)}) > 3


def test_operator(spark, tk):
    ts = [*texts(), None, None]
    ids = [*range(len(ts) - 2), None, 3]
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in zip(ids, ts, strict=True)], "doc_id long, text string, ids string, p int")
    got = bpe.encode(docs).collect()
    assert len(got) == len(ts)
    want = {(i, tuple(tk.encode(t or "", add_special_tokens=False).ids), t or "") for i, t in zip(ids, ts, strict=True)}
    assert {(r.doc_id, tuple(r.ids), r.decoded) for r in got} == want
    assert bpe.encode(docs.limit(0)).count() == 0
