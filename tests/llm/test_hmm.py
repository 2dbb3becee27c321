import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np

from lodestone.llm import hmm


def some_model(states, classes, seed=0):
    rng = np.random.default_rng(seed)
    norm = lambda x: x / x.sum(axis=1, keepdims=True)
    return hmm.Model(norm(rng.random((2, states))), norm(rng.random((states, states))), norm(rng.random((states, classes))))


def brute(model, seq, first=0):
    """Probability, and expected counts, over all paths."""
    k, total = len(model.moves), 0.0
    start, moves, emit = np.zeros_like(model.start), np.zeros_like(model.moves), np.zeros_like(model.emit)
    for path in itertools.product(range(k), repeat=len(seq)):
        p = model.start[first, path[0]] * model.emit[path[0], seq[0]]
        for a, b, c in zip(path, path[1:], seq[1:], strict=False):
            p *= model.moves[a, b] * model.emit[b, c]
        total += p
        start[first, path[0]] += p
        for a, b in zip(path, path[1:], strict=False):
            moves[a, b] += p
        for a, c in zip(path, seq, strict=True):
            emit[a, c] += p
    return total, start / total, moves / total, emit / total


def crossing(model, before, first, after):
    """Expected moves from the last state of one segment to the first of the next, over all paths of both."""
    k, out = len(model.moves), np.zeros_like(model.moves)
    for a in itertools.product(range(k), repeat=len(before)):
        p = model.start[first, a[0]] * model.emit[a[0], before[0]]
        for x, y, c in zip(a, a[1:], before[1:], strict=False):
            p *= model.moves[x, y] * model.emit[y, c]
        for b in itertools.product(range(k), repeat=len(after)):
            q = p * model.moves[a[-1], b[0]] * model.emit[b[0], after[0]]
            for x, y, c in zip(b, b[1:], after[1:], strict=False):
                q *= model.moves[x, y] * model.emit[y, c]
            out[a[-1], b[0]] += q
    return out / out.sum()


def test_against_all_paths():
    rng = np.random.default_rng(1)
    model = some_model(3, 4)
    seqs = [rng.integers(0, 4, n) for n in (1, 2, 5, 3, 5)]
    first = np.array([0, 1, 0, 1, 1])
    want = [brute(model, s, f) for s, f in zip(seqs, first, strict=True)]
    got = hmm.expected(model, np.concatenate(seqs), np.array([len(s) for s in seqs]), first)
    over = sum(crossing(model, seqs[i - 1], first[i - 1], seqs[i]) for i in range(1, 5) if first[i])
    for i in range(3):
        assert np.allclose(got[i], sum(w[i + 1] for w in want) + (over if i == 1 else 0))
    assert math.isclose(got[3], sum(math.log(w[0]) for w in want))
    assert np.allclose(hmm.likelihoods(model, np.concatenate(seqs), np.array([len(s) for s in seqs])), [math.log(brute(model, s)[0]) for s in seqs])


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(2)
    base = np.array([0.001, 0.199, *[0.1] * 8])
    seqs = [np.array([*(rng.integers(2, 6) if i % 2 else rng.integers(6, 10) for _ in range(40)), 1]) for i in range(60)]
    model, last = hmm.warm(seqs[:8], base, 0.999, 3), -1e18
    for _ in range(8):
        *counts, like = hmm.expected(model, *hmm.segments(seqs))
        assert like > last - 5
        model, last = hmm.maximised(*counts, base, 0.999), like
    assert np.allclose(model.emit.sum(axis=1), 1) and np.allclose(model.moves.sum(axis=1), 1)
    flat = sum(np.log(base[s]).sum() for s in seqs)
    assert last > flat + 100


def test_operator(spark, monkeypatch):
    rng = random.Random(3)
    a, b = [f"a{i}" for i in range(40)], [f"Bé{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choice(a if i % 2 else b) for _ in range(rng.randrange(0, 80)))) for i in range(300)]
    docs += [(None, "a1 never"), (500, None), (501, ""), (502, "new\twords\n only"), (502, "a1"), (503, "a1 " * 30000)]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, p int, w string").repartition(5)
    got = hmm.score(df).collect()
    assert len(got) == len(docs)
    toks = lambda t: [*"".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split(), None]
    fold = lambda i: None if i is None else zlib.crc32(str(i).encode()) % 10
    count = Counter(w for i, t in docs if fold(i) not in (0, None) for w in toks(t))
    n, v = sum(count.values()), len(count)
    want = sorted((str(i), fold(i) == 0, len(toks(t)), sum(count[w] > 0 for w in toks(t)), n, round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in toks(t)), 6)) for i, t in docs)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert hmm.score(df.limit(0)).count() == 0


def test_mass_is_one(spark):
    """Over all one-word texts of the known words and one unknown, followed by an end, the model's mass is that of two-token texts."""
    docs = [(i, f"w{i % 7} x{i % 3}") for i in range(50)]
    words = sorted({w for i, t in docs if zlib.crc32(str(i).encode()) % 10 for w in t.split()})
    one = [(1000 + i, w) for i, w in enumerate([*words, "unknown!"])]
    fake = [(next(j for j in range(10**4, 10**6) if zlib.crc32(str(j).encode()) % 10 == 0 and j % 1000 == i), w) for i, (_, w) in enumerate(one)]
    df = spark.createDataFrame(docs + fake, "doc_id long, text string")
    got = [r for r in hmm.score(df).collect() if r.doc_id >= 10**4]
    assert 0 < sum(10**r.score for r in got) <= 1
