import random
import re

from lodestone.llm import decon

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, bench, window=10):
    w, hit, items = plain(text), set(), set()
    for item, t in bench:
        b = plain(t)
        s = min(window, len(b))
        for i in range(len(b) - s + 1 if b else 0):
            for j in range(len(w) - s + 1):
                if w[j : j + s] == b[i : i + s]:
                    hit.update(range(j, j + s))
                    items.add("" if item is None else str(item))
    return len(w), len(hit), sorted(items)


def test_against_brute_force(spark):
    rng = random.Random(0)
    v = ["a", "b", "Ça", "É", "x9", "the"]
    text = lambda n: " ".join(rng.choice(v) + rng.choice(["", ",", "\n"]) for _ in range(n))
    bench = [(i, text(rng.randrange(0, 16))) for i in range(25)] + [(3, text(12)), (None, text(11)), (77, None), (78, "é")]
    docs = [(i, " ".join([text(20), (rng.choice(bench)[1] or "").upper() if i % 2 else "", text(5)])) for i in range(40)]
    docs += [(None, "a"), (5, None), (6, ""), (7, bench[1][1]), (7, bench[1][1]), (8, text(3000)), (9, "É a" + " b" * 400)]
    df = spark.createDataFrame([(*d, "t", [1]) for d in docs], "doc_id long, text string, item_id string, dc_spans array<int>")
    bf = spark.createDataFrame(bench, "item_id long, text string")
    want = sorted((str(i), *brute(t, bench)) for i, t in docs)
    for most in (10**6, 60):
        got = decon.find(df, bf, block_words=most).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.items) for r in got) == want
        assert all(r.contaminated == (r.n_hit > 0) and r.n_items == len(r.items) and sum(s.end - s.start for s in r.spans) == r.n_hit for r in got)
    kept = decon.clean(df, bf).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(w[0] for w in want if not w[2])


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decon.find(docs, none).collect()] == [0]
    assert decon.find(docs.limit(0), none).count() == 0
