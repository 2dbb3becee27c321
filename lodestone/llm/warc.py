"""WARC archives: writing, a normaliser for monolithic gzip, and reading by a sidecar offset index.

write()      one gzip stream for each archive, as some crawlers leave it: no record can be reached without
             inflating all before it. Equal payloads of at least LEAST bytes are stored once: the record with the
             largest page_id is the response, the others revisit it.
normalise()  inflates each archive once, in pieces, finds the records by their lengths and rewrites every record as
             a gzip member of its own; a sidecar file beside the archive lists (offset, length) of each member.
read()       takes the sidecars, deals their ranges to tasks and inflates members singly.

Files carry the task attempt in their names and only those that a surviving attempt reports are used, so lost
executors leave stray files at most.

Defined cases: a null html is an empty payload; a null url an empty target. Null page_ids are kept as null and rank
below every number; where all equal payloads have a null page_id, and where rows repeat the largest, all of these
are responses. No rows: no archives. Other columns are ignored. Line ends in a url are written as spaces.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import store
from lodestone.llm.common import Scratch, partitions, small_batches

#: Payloads below this many bytes are never revisits. Salts of each group of equal payloads. Bytes in one read.
LEAST, SALTS, UNIT = 1000, 16, 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENTRY = struct.Struct("<QI")


def record(page_id: int | None, url: str, payload: bytes, size: int, digest: str, kind: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record; payload is left out of a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    target = url.replace("\r", " ").replace("\n", " ")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {target} {digest}')}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"X-Payload-Length: {size}",
    ]
    head += [f"X-Page-ID: {page_id}"] * (page_id is not None)
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's headers, by lower-case name, and its block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    out = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    out["block"] = rest[: int(out["content-length"])]
    return out


def inflate(file):
    """Pieces of a gzip file's content, whatever its number of members."""
    z = zlib.decompressobj(31)
    fed = False
    while piece := file.read(1 << 20):
        while piece:
            out, fed = z.decompress(piece, 1 << 22), True
            while out or z.unconsumed_tail and not z.eof:
                yield out
                out = b"" if z.eof else z.decompress(z.unconsumed_tail, 1 << 22)
            piece = b""
            if z.eof:
                piece, z, fed = z.unused_data, zlib.decompressobj(31), False
    if fed:
        raise ValueError("the gzip stream is cut short")


def records(pieces):
    """Whole records from pieces of a WARC file; holds one record at a time."""
    buf = bytearray()
    need = 0
    for piece in pieces:
        buf += piece
        while True:
            if not need:
                end = buf.find(b"\r\n\r\n")
                if end < 0:
                    break
                length = next(x.split(b":", 1)[1] for x in bytes(buf[:end]).split(b"\r\n") if x.lower().startswith(b"content-length:"))
                need = end + 4 + int(length) + 4
            if len(buf) < need:
                break
            yield bytes(buf[:need])
            del buf[:need]
            need = 0
    if buf.strip():
        raise ValueError("the last record is cut short")


def decide(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html, digest, size, record_type, refers_to of every page. html is null where it need not be stored."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.select("*", F.sha1("html").alias("digest"), F.octet_length("html").cast("long").alias("size"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    same = rows.where(F.col("size") >= least).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("last_id")).where("n > 1 and last_id is not null")
    same = same.select("digest", "last_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    revisit = F.col("last_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last_id"))
    out = rows.join(same, ["digest", "salt"], "left").withColumn("revisit", revisit)
    return out.select("page_id", "url", F.when(~F.col("revisit"), F.col("html")).alias("html"), "digest", "size", F.when(F.col("revisit"), "revisit").otherwise("response").alias("record_type"), F.when(F.col("revisit"), F.col("last_id")).alias("refers_to"))


def _write(folder, date):
    def run(it):
        out = None
        uri = "{}/crawl-{:06d}-{}.warc.gz".format(folder, *store.attempt())
        for batch in it:
            cols = [batch[c].to_pylist() for c in ("page_id", "url", "html", "size", "digest", "record_type", "refers_to")]
            for page_id, url, html, size, digest, kind, refers in zip(*cols, strict=True):
                if out is None:
                    out, z = store.create(uri), zlib.compressobj(1, zlib.DEFLATED, 31)
                out.write(z.compress(record(page_id, url, (html or "").encode(), size, digest, kind, refers, date)))
        if out:
            out.write(z.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [uri]})

    return run


def write(pages: DataFrame, folder: str, scratch: Scratch, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Archives of one gzip stream each below folder; their paths."""
    small_batches(pages.sparkSession)
    return scratch.cut(decide(pages).mapInArrow(_write(folder, date), "path string"))


def rewrite(source: str, target: str, index: str) -> int:
    """One archive, inflated once, to one with a member for each record, and its sidecar."""
    n = at = 0
    out, side = store.create(target), store.create(index)
    with store.open_at(source) as file:
        for rec in records(inflate(file)):
            z = zlib.compressobj(1, zlib.DEFLATED, 31)
            member = z.compress(rec) + z.flush()
            out.write(member)
            side.write(ENTRY.pack(at, len(member)))
            at += len(member)
            n += 1
    out.close()
    side.close()
    return n


def _normalise(folder):
    def run(it):
        _, attempt = store.attempt()
        for batch in it:
            for path in batch["path"].to_pylist():
                name = path.rsplit("/", 1)[1].removesuffix(".warc.gz")
                target = f"{folder}/{name}-{attempt}.warc.gz"
                n = rewrite(path, target, target + ".idx")
                yield pa.RecordBatch.from_pydict({"path": [target], "index": [target + ".idx"], "n_records": pa.array([n], pa.int64())})

    return run


def normalise(archives: DataFrame, folder: str, scratch: Scratch) -> DataFrame:
    """path, index and n_records of the rewritten archives."""
    dealt = archives.repartition(partitions(archives.sparkSession), "path")
    return scratch.cut(dealt.mapInArrow(_normalise(folder), "path string, index string, n_records long"))


def _units(it):
    """Sidecars to ranges of about UNIT bytes: path, offset, and the lengths of the members there."""
    for batch in it:
        for path, index in zip(batch["path"].to_pylist(), batch["index"].to_pylist(), strict=True):
            with store.open_at(index) as f:
                raw = f.read()
            start, sizes, out = 0, [], []
            for at, n in ENTRY.iter_unpack(raw):
                start = at if not sizes else start
                sizes.append(n)
                if at + n - start >= UNIT:
                    out.append({"path": path, "start": start, "sizes": sizes})
                    sizes = []
            out += [{"path": path, "start": start, "sizes": sizes}] * bool(sizes)
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("path", pa.string()), ("start", pa.int64()), ("sizes", pa.list_(pa.int64()))]))


def _read(payloads):
    def run(it):
        for batch in it:
            for path, start, sizes in zip(*(batch[c].to_pylist() for c in ("path", "start", "sizes")), strict=True):
                with store.open_at(path) as f:
                    data, at, rows = memoryview(f.read_at(sum(sizes), start)), 0, []
                for n in sizes:
                    r = parse(zlib.decompress(data[at : at + n], 31))
                    at += n
                    kind, digest = r["warc-type"], base64.b32decode(r["warc-payload-digest"].removeprefix("sha1:")).hex()
                    payload = r["block"].partition(b"\r\n\r\n")[2]
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{path}: a payload differs from its digest")
                    page, refers = r.get("x-page-id"), r.get("x-refers-to-page-id")
                    row = {"page_id": int(page) if page else None, "payload_bytes": len(payload) if kind == "response" else int(r["x-payload-length"]), "payload_digest": digest, "record_type": kind, "refers_to": int(refers) if refers else None}
                    rows.append(row | ({"url": r["warc-target-uri"], "payload": payload if kind == "response" else None} if payloads else {}))
                kinds = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds + [("url", pa.string()), ("payload", pa.binary())] * payloads))

    return run


def read(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """A row for each record of normalised archives; payloads: its url and stored payload too."""
    units = archives.select("path", "index").mapInArrow(_units, "path string, start long, sizes array<long>")
    units = units.repartition(partitions(archives.sparkSession), "path", "start")
    return units.mapInArrow(_read(payloads), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", url string, payload binary" * payloads)
