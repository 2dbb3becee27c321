import random

import numpy as np

from lodestone.llm import langid

VOCAB = {"en": ["the", "house", "and", "with", "thing", "water"], "fr": ["le", "maison", "avec", "chose", "eau", "été"], "ru": ["дом", "вода", "и", "вещь"], "el": ["σπίτι", "νερό", "και"]}


def say(rng, lang, n):
    return " ".join(rng.choice(VOCAB[lang]) + rng.choice(["", ",", "."]) for _ in range(n))


def corpus(n=400):
    rng = random.Random(0)
    return [(i, say(rng, lang := rng.choice(list(VOCAB)), rng.randrange(5, 60)), lang if rng.random() < 0.9 else None) for i in range(n)]


def brute_viterbi(scores, switch):
    n, k = scores.shape
    best, back = scores[0].astype(float).copy(), []
    for t in range(1, n):
        top = best.argmax()
        stay = best >= best[top] - switch
        back.append([j if stay[j] else top for j in range(k)])
        best = np.maximum(best, best[top] - switch) + scores[t]
    out = [int(best.argmax())]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return out[::-1]


def test_viterbi():
    rng = np.random.default_rng(0)
    lengths = rng.integers(0, 40, 30)
    scores = -rng.integers(0, 5, (lengths.sum(), 3)).astype(np.float32)
    got = np.split(langid.viterbi(scores, lengths, 4.0), np.cumsum(lengths)[:-1])
    for s, g in zip(np.split(scores, np.cumsum(lengths)[:-1]), got, strict=True):
        assert not len(s) or g.tolist() == brute_viterbi(s, 4.0)


def test_identify(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "src") for r in rows], "doc_id long, text string, lang string, score string")
    model = langid.learn(df)
    rng = random.Random(9)
    new = [(i, say(rng, lang, 30), lang) for i, lang in enumerate(list(VOCAB) * 10)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame([(i, t) for i, t, _ in new], "doc_id long, text string"), model, with_spans=True).collect()}
    assert all(got[i].lang_pred == lang and got[i].score > 0.9 for i, _, lang in new)
    mixed = say(rng, "en", 30) + " " + say(rng, "fr", 20) + " " + say(rng, "ru", 5)
    odd = [(1, mixed), (2, None), (3, ""), (4, "12 34 !?"), (5, "日本語"), (None, "the house " * 20000), (6, "été"), (6, "été")]
    got = [(r.doc_id, r.lang_pred, r.score, [(s.start, s.end, s.lang) for s in r.spans]) for r in langid.identify(spark.createDataFrame(odd, "doc_id long, text string"), model, with_spans=True).collect()]
    by = {g[0]: g for g in got}
    assert len(got) == len(odd)
    assert by[1][3] == [(0, 30, "en"), (30, 50, "fr"), (50, 55, "ru")] and by[1][1] == "en" and 0.3 < by[1][2] < 0.8
    assert all(by[i][1:3] == ("und", 0.0) for i in (2, 3, 4)) and by[5][2] == 0.0 and by[5][1] in VOCAB
    assert by[None][1] == "en" and by[6][1] == "fr"
    kept = langid.keep_known(df.union(spark.createDataFrame([(900, None, "en", "s"), (901, "...", "en", "s")], df.schema)))
    assert kept.columns == df.columns and kept.count() == len(rows)


def test_predictions_ignore_labels(spark):
    rows = corpus(200)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(df)
    other = spark.createDataFrame([(i + 10**6, t, "xx") for i, t, _ in rows], df.schema)
    a = sorted((r.doc_id, r.lang_pred, r.score) for r in langid.identify(df, model).collect())
    b = sorted((r.doc_id - 10**6, r.lang_pred, r.score) for r in langid.identify(other, model).collect())
    assert a == b
    assert langid.identify(df, langid.learn(df.limit(0))).first().lang_pred == "und"
    assert langid.identify(df.limit(0), model).count() == 0


def test_generated_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(docs, langid.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id")
    held = found.where(langid.held_out(found)).collect()
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
