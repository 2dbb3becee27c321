import zlib

import numpy as np

from lodestone.llm import sst, store
from lodestone.llm.common import Scratch
from lodestone.llm.wordcode import default_tokenizer, load


def test_shards(spark):
    tk = load(default_tokenizer())
    rows = [(i * 7 - 300, f"text {i} " * (i % 9) + "é\n") for i in range(400)] + [(5, None), (5, ""), (5, "same"), (5, "same"), (None, "no id"), (2**62, "w" * 90_000)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, start int, path string").repartition(5)
    scratch = Scratch(spark, "t")
    manifest = sst.write(docs, scratch.folder("s"), scratch)
    want, start = [], 0
    for i, t in sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = [*tk.encode(t, add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), ids))
        start += len(ids)
    order = lambda r: (r[1], r[2])
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids) for r in sst.read_back(manifest).collect()), key=order) == sorted(want, key=order)
    assert sorted((r.start, r.ids_crc32) for r in sst.read_back(manifest, digests=True).collect()) == sorted((w[1], zlib.crc32(np.array(w[3], "<u4").tobytes())) for w in want)
    got = sst.lookup(manifest, [5, -300, 2, None, 2**62])
    assert [len(g) for g in got] == [4, 1, 0, 1, 1]
    assert got[1][0].tolist() == want[1][3]


def test_empty(spark):
    scratch = Scratch(spark, "t")
    manifest = sst.write(spark.createDataFrame([], "doc_id long, text string"), scratch.folder("s"), scratch)
    assert sst.read_back(manifest).count() == 0


def test_blocks_and_filter(tmp_path):
    uri = str(tmp_path / "x.sst")
    w = sst.Writer(store.create(uri), 4)
    for i in range(5000):
        w.add(sst.key_of(i * 2), np.arange(i % 100, dtype="<u4") * 70_000)
    w.close()
    r = sst.Reader(uri)
    assert len(r.index) > 1 and r.n == 5000
    assert all(r.lookup(i * 2)[0].tolist() == [70_000 * k for k in range(i % 100)] for i in range(0, 5000, 37))
    assert sum(r.may_hold(sst.key_of(i * 2 + 1)) for i in range(5000)) < 150
    assert r.lookup(3) == []
