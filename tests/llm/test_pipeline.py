import hashlib
import random

import corpus_pipeline
from lodestone.llm.wordcode import default_tokenizer, load
from tests.llm.test_decon import brute as hits
from tests.llm.test_linededup import brute as lines
from tests.llm.test_simhash import brute_components, brute_fp


def test_against_plain_python(spark, tmp_path):
    rng = random.Random(4)
    v = ["the", "house", "water", "and", "green", "tree", "walks", "never"] + [f"word{i}" for i in range(200)]
    say = lambda n: " ".join(rng.choice(v) for _ in range(n))
    passage, item = say(60), say(15)
    texts = [say(rng.randrange(20, 150)) + "\n" + say(10) for _ in range(40)]
    texts += [texts[0], texts[1] + " end", passage + "\nown " + say(30), "own " + say(30) + "\n" + passage, say(20) + " " + item.upper() + " " + say(9), None, "12 34", "", "été " * 30]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, "short")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    keep = [(i, t) for i, t, *_ in docs if any(c.isalpha() for c in t or "")]
    keep = [(i, t) for (i, _), t in zip(keep, lines(keep, 50), strict=True)]
    comps = brute_components([brute_fp(t) for _, t in keep], 3)
    keep = [k for n, (k, c) in enumerate(zip(keep, comps, strict=True)) if n == c]
    keep = [(i, t) for i, t in keep if not hits(t, [(1, item), (2, "short")])[1]]
    tk = load(default_tokenizer())
    want = []
    for i, t in keep:
        ids = tk.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert got == sorted(want)
    assert 35 < len(got) < len(docs) - 3


def test_stages_keep_columns(spark):
    docs = spark.createDataFrame([(1, "the house", "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() == 1
