import gzip
import hashlib
import zlib

import pytest

from lodestone.llm import store, warc
from lodestone.llm.common import Scratch


def test_round_trip(spark):
    big, other = "é<p>" * 500, "x" * 1000
    rows = [(1, "u1", big), (2, "u2", big), (9, "u\r\n9", big), (3, None, "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (None, "n", big), (7, "u", other), (7, "u", other), (None, "u", "y" * 2000), (None, "u", "y" * 2000)]
    pages = spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, digest string, salt int")
    scratch = Scratch(spark, "t")
    arch = warc.normalise(warc.write(pages, scratch.folder("a"), scratch), scratch.folder("b"), scratch)
    got = sorted((r.page_id is None, r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or -1) for r in warc.read(arch).collect())
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        last = max((j for j, _, g in rows if j is not None and (g or "") == (h or "")), default=None)
        rev = len(b) >= 1000 and last is not None and i != last
        want.append((i is None, i or 0, len(b), hashlib.sha1(b).hexdigest(), "revisit" if rev else "response", last if rev else -1))
    assert got == sorted(want)
    stored = {r.url: r.payload for r in warc.read(arch, payloads=True).collect() if r.page_id == 9}
    assert stored == {"u  9": big.encode()}
    for r in arch.collect():  # each record is a member of its own
        system, path = store.at(r.path)
        data, n = system.open_input_file(path).read(), 0
        while data:
            z = zlib.decompressobj(31)
            assert z.decompress(data).startswith(b"WARC/1.1")
            data, n = z.unused_data, n + 1
        assert n == r.n_records


def test_empty(spark):
    scratch = Scratch(spark, "t")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(warc.normalise(warc.write(pages, scratch.folder("a"), scratch), scratch.folder("b"), scratch)).count() == 0


def test_streams(tmp_path):
    recs = [warc.record(i, "u", b"x" * i * 700_000, i * 700_000, "00" * 20, "response", None, "d") for i in range(9)]
    for name, data in (("one", gzip.compress(b"".join(recs), 1)), ("many", b"".join(gzip.compress(r, 1) for r in recs))):
        f = tmp_path / name
        f.write_bytes(data)
        assert list(warc.records(warc.inflate(f.open("rb")))) == recs
    f.write_bytes(gzip.compress(b"".join(recs), 1)[:-2000])
    with pytest.raises(ValueError):
        list(warc.records(warc.inflate(f.open("rb"))))
