import random
import re

import numpy as np
import xxhash

from lodestone.llm import simhash


def brute_fp(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, bits):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_walk():
    rng = random.Random(1)
    for n in (1, 2, 50, 400):
        base = [rng.getrandbits(64) for _ in range(n // 4 + 1)]
        make = lambda: np.unique(np.array([rng.choice(base) ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (2**64 - 1) for _ in range(n)], "<u8"))
        a, b = make(), make()
        near = lambda x, y: (int(x) ^ int(y)).bit_count() <= 3
        got = {(int(i), int(j)) for x, y in simhash.walk(a, b, 3, 0) for i, j in zip(x, y, strict=True)}
        assert got == {(i, j) for i in range(len(a)) for j in range(len(b)) if near(a[i], b[j])}
        got = {(int(i), int(j)) for x, y in simhash.walk(a, None, 3, 0) for i, j in zip(x, y, strict=True)}
        assert got == {(i, j) for j in range(len(a)) for i in range(j) if near(a[i], a[j])}


def test_fingerprints():
    for t in ["", None, "a", "A b", "x Y z", "é É a b c d", "one  two\tthree\nfour five " * 9, "w" * 10000]:
        assert simhash.fingerprint(t) == brute_fp(t)


def test_links_in_blocks(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = sorted({rng.choice(base) ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6))) & (2**64 - 1) for _ in range(300)})
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    root = list(range(len(fps)))
    at = {x: i for i, x in enumerate(signed)}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in simhash.links(df, 3, block=16).collect():
        a, b = find(at[r.a]), find(at[r.b])
        root[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(fps))] == brute_components(fps, 3)


def test_operator(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    docs = []
    for i in range(60):
        w = [rng.choice(words) for _ in range(rng.choice([0, 1, 2, 80, 300]))]
        for k in range(rng.randrange(1, 4)):
            docs.append((i * 10 + k, " ".join(w)))
            if w:
                w[rng.randrange(len(w))] = "edited"
    docs += [(5000, None), (5001, ""), (5002, " \n\t"), (11, "other text entirely here"), (None, docs[9][1]), (None, "lonely text of no id at all")]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, fp string, root int").repartition(7)
    fps = [brute_fp(t) for _, t in docs]
    comp = brute_components(fps, 3)
    least = {}
    for (i, _), c in zip(docs, comp, strict=True):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = sorted((str(i), f, str(least.get(c))) for (i, _), f, c in zip(docs, fps, comp, strict=True))
    got = sorted((str(r.doc_id), r.fp % 2**64, str(r.component_id)) for r in simhash.near_duplicates(df).collect())
    assert got == want
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted({str(x) for x in least.values()} | {"None"})
    assert simhash.near_duplicates(df.limit(0)).count() == 0
