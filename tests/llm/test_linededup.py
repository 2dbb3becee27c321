import random

from lodestone.llm import linededup


def brute(docs, least):
    """docs: (id, text) in order. The texts that stay: every run against every earlier one."""
    split = [t.split("\n") for _, t in docs]
    out = []
    for x, a in enumerate(split):
        gone = set()
        for i in range(len(a)):
            for j in range(i + 1, len(a) + 1):
                if sum(len(s.split()) for s in a[i:j]) < least:
                    continue
                n = j - i
                if any(b[p : p + n] == a[i:j] for y, b in enumerate(split[: x + 1]) for p in range(len(b) - n + 1) if y < x or p + n <= i):
                    gone.update(range(i, j))
        out.append("\n".join(s for k, s in enumerate(a) if k not in gone))
    return out


def test_against_brute_force(spark):
    rng = random.Random(5)
    v = ["a", "b b", "c c c", "", "d é", " ", "unique"]
    docs = []
    for i in range(60):
        ls = [rng.choice(v) + (str(rng.randrange(10**6)) if rng.random() < 0.1 else "") for _ in range(rng.randrange(0, 14))]
        docs.append((i, "\n".join(ls)))
        if rng.random() < 0.3:
            docs[-1] = (i, docs[rng.randrange(len(docs))][1])
    docs.append((70, "\n".join(["x y"] * 40)))
    docs.append((71, "long " * 30 + "\ntail"))
    docs.append((72, "head\n" + "long " * 30))
    df = spark.createDataFrame([(i, t, "z", 3) for i, t in docs], "doc_id long, text string, ld_k string, k int").repartition(6)
    for least in (1, 4, 7):
        got = {r.doc_id: r for r in linededup.dedup(df, least).collect()}
        for (i, t), want in zip(docs, brute(docs, least), strict=True):
            assert got[i].text == want, (least, i, t)
            assert got[i].ld_lines == t.count("\n") + 1
            assert got[i].k == 3
    assert got[70].ld_removed == 36


def test_odd_rows(spark):
    p = "word " * 60
    rows = [(None, p), (1, p), (1, p), (1, p + "\nmore"), (2, None), (3, ""), (4, p * 300 + "\n" + p)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.text)) for r in linededup.dedup(df, 50).collect())
    assert got == sorted((str(i), str(t)) for i, t in [(None, p), (1, ""), (1, ""), (1, "more"), (2, None), (3, ""), (4, p * 300)])
    assert linededup.dedup(df.limit(0), 50).count() == 0


def test_hot_lines_and_columns(spark):
    """One run in most documents: its keys are split; columns keep their names."""
    rng = random.Random(3)
    run = "hot " * 30 + "\n" + "run " * 30
    docs = [(i, run + f"\nown {i} " + str(rng.random()), float(i), i, "w") for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, ld_score double, n int, `a.b` string").repartition(5)
    out = linededup.dedup(df, 50, report=False)
    assert out.columns == df.columns
    got = {r.doc_id: r for r in out.collect()}
    assert got[0].text == docs[0][1]
    assert all(got[i].text == docs[i][1].split("\n")[2] and got[i].ld_score == i and got[i].n == i and got[i]["a.b"] == "w" for i in range(1, 3000))


def test_native(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert "Python" not in linededup.dedup(df)._jdf.queryExecution().toString()
