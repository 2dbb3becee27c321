"""Documents and turns that a cap or a shared key would lose."""

import random

from lodestone.llm import chat, langid, simhash


def test_rows_without_ids_of_their_own_stay(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(12)]
    # Null ids, and one id for unrelated texts, of which one is a copy of an earlier document.
    docs = [(None, t, "a") for t in texts[:5]] + [(None, texts[0], "b")] + [(1, texts[5], "a"), (2, texts[5], "a"), (2, texts[6], "a"), (2, texts[7], "a"), (3, texts[8], "b"), (3, texts[8], "a"), (None, texts[8], "a")]
    docs += [(4, None, "a"), (5, "", "a")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3)
    want = [(None, t, "a") for t in texts[:5]] + [(1, texts[5], "a"), (2, texts[6], "a"), (2, texts[7], "a"), (3, texts[8], "a"), (4, None, "a")]
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, want))
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_late_rewrites_are_found(spark):
    turns = [(1, i, "user", f"t{i}") for i in range(130)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")

    def late(ts):
        return chat.template(ts[-100:])

    def last(ts):
        return "".join(f"{t if i == len(ts) - 1 else '-'};" for i, (_, t) in enumerate(ts))

    for render, first in ((late, 100), (last, 1)):
        rows = chat.format_chats(df, render).collect()
        assert len(rows) == 1 and rows[0].rewritten_at[0] == first
        assert rows[0].text == render([(r, t) for _, _, r, t in turns])


def test_every_language_is_learned(spark):
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
    rows = [(i * 3 + k, f"{name(i) * 2} " * 5, f"l{i:03d}") for i in range(600) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(df, folds=10**6)
    assert len(model["langs"]) == 600
    got = {r.doc_id: r.lang_pred for r in langid.identify(df, model).collect()}
    assert all(got[i] == lang for i, _, lang in rows)


def test_documents_stay_where_nothing_was_learned(spark):
    df = spark.createDataFrame([(1, "the house", None), (2, "12 !", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in langid.keep_known(df).collect()] == [1]
