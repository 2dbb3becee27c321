"""Token ids as sorted-string-table shards.

Documents are range-partitioned and sorted by identifier, so shard follows shard in ascending order. A shard holds

    data blocks   entries (shared key prefix, rest of the key, value), a full key each RESTART entries; zstd, crc32
    index         for each block: its first and last key, offset, length, documents and ids before it in the shard
    Bloom filter  BITS_PER_KEY bits a key
    footer        fixed length: where index and filter are, counts, id width, magic

A key is the identifier as nine big-endian bytes that sort as the number does, null first. A value is the ids in
planes of equal bytes, 16 bits wide where the vocabulary allows. A shard is named by its task attempt and only the
manifest, which the surviving attempt returns, says which files count: a lost executor leaves at most a stray file.

Defined cases: a null text is an empty one, which is the end id alone. Rows that repeat an identifier are all kept,
in order of their text; lookup() gives all of them. No rows: no shards. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import store, wordcode
from lodestone.llm.common import Scratch, partitions, small_batches
from lodestone.llm.wordcode import default_tokenizer

BLOCK, RESTART, BITS_PER_KEY, PROBES = 1 << 18, 16, 10, 7
FOOTER, MAGIC = struct.Struct("<QQQQQQI4s"), b"LSS1"


def key_of(doc_id: int | None) -> bytes:
    return bytes(9) if doc_id is None else b"\1" + (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key[1:], "big") - (1 << 63) if key[0] else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def unvarint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def probes(key: bytes, bits: int) -> list[int]:
    import xxhash

    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (2**64 - 1), h >> 64 | 1
    return [(a + i * b) % bits for i in range(PROBES)]


class Writer:
    """Entries in key order to one shard. Holds one block, the index and the keys."""

    def __init__(self, out, width: int):
        import zstandard

        self.out, self.width, self.zip = out, width, zstandard.ZstdCompressor(level=1)
        self.at, self.index, self.keys, self.n, self.ids = 0, [], [], 0, 0
        self._new()

    def _new(self):
        self.block, self.first, self.last, self.in_block, self.before = bytearray(), b"", b"", 0, (self.n, self.ids)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = 0
        if self.in_block % RESTART:
            while shared < len(key) and shared < len(self.last) and key[shared] == self.last[shared]:
                shared += 1
        value = np.ascontiguousarray(ids.astype(f"<u{self.width}").view(np.uint8).reshape(-1, self.width).T).tobytes()
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.first, self.last = self.first or key, key
        self.in_block += 1
        self.n += 1
        self.ids += len(ids)
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        if len(self.block) >= BLOCK:
            self._flush()

    def _flush(self):
        if self.in_block:
            data = self.zip.compress(bytes(self.block))
            data += struct.pack("<I", zlib.crc32(data))
            self.out.write(data)
            self.index.append((self.first, self.last, self.at, len(data), *self.before))
            self.at += len(data)
            self._new()

    def close(self) -> None:
        self._flush()
        index = b"".join(first + last + struct.pack("<QIQQ", *rest) for first, last, *rest in self.index)
        bits = max(64, (len(self.keys) * BITS_PER_KEY + 7) // 8 * 8)
        bloom = bytearray(bits // 8)
        for key in self.keys:
            for p in probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        self.out.write(index + bytes(bloom) + FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.n, self.ids, self.width, MAGIC))
        self.out.close()


class Reader:
    """One shard: entries in order, or those of a key by filter, index and block."""

    def __init__(self, uri: str):
        import zstandard

        self.file, self.zip = store.open_at(uri), zstandard.ZstdDecompressor()
        foot = self._bytes(self.file.size() - FOOTER.size, FOOTER.size)
        at, n, self.bloom_at, self.bloom_n, self.n, self.ids, self.width, magic = FOOTER.unpack(foot)
        if magic != MAGIC:
            raise ValueError(f"{uri} is no shard")
        raw, one = self._bytes(at, n), 18 + struct.calcsize("<QIQQ")
        self.index = [(raw[i : i + 9], raw[i + 9 : i + 18], *struct.unpack("<QIQQ", raw[i + 18 : i + one])) for i in range(0, n, one)]

    def _bytes(self, at: int, n: int) -> bytes:
        return bytes(self.file.read_at(n, at)) if n else b""

    def block(self, i: int):
        """(key, ids) of block i."""
        _, _, at, n, _, _ = self.index[i]
        data = self._bytes(at, n)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError(f"block {i} is damaged")
        b, at, key = self.zip.decompress(data[:-4]), 0, b""
        while at < len(b):
            shared, at = unvarint(b, at)
            rest, at = unvarint(b, at)
            n, at = unvarint(b, at)
            key = key[:shared] + b[at : at + rest]
            at += rest
            planes = np.frombuffer(b, np.uint8, n, at).reshape(self.width, -1)
            yield key, np.ascontiguousarray(planes.T).view(f"<u{self.width}").ravel().astype("<u4")
            at += n

    def may_hold(self, key: bytes) -> bool:
        bloom = self._bytes(self.bloom_at, self.bloom_n)
        return all(bloom[p >> 3] >> (p & 7) & 1 for p in probes(key, len(bloom) * 8))

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        key, out = key_of(doc_id), []
        if not self.index or not self.may_hold(key):
            return out
        i = bisect_left(self.index, key, key=lambda e: e[1])
        while i < len(self.index) and self.index[i][0] <= key:
            out += [ids for k, ids in self.block(i) if k == key]
            i += 1
        return out


MANIFEST = "shard int, path string, first_id long, last_id long, n_docs long, n_ids long, block int, docs_before long, ids_before long"


def _write(path, folder, end_id, cache_words):
    def run(it):
        writer = coder = None
        part, attempt = store.attempt()
        uri = f"{folder}/shard-{part:06d}-{attempt}.sst"
        for batch in it:
            if not batch.num_rows:
                continue
            if writer is None:
                coder = wordcode.coder(path, cache_words)
                writer = Writer(store.create(uri), 2 if coder.tk.get_vocab_size() <= 1 << 16 else 4)
            texts = [t or "" for t in batch["text"].to_pylist()]
            for doc_id, code in zip(batch["doc_id"].to_pylist(), coder.encode(texts), strict=True):
                writer.add(key_of(doc_id), np.append(np.frombuffer(code, "<u4"), np.uint32(end_id)))
        if writer:
            writer.close()
            rows = [{"shard": part, "path": uri, "first_id": id_of(first), "last_id": id_of(last), "n_docs": writer.n, "n_ids": writer.ids, "block": i, "docs_before": d, "ids_before": t} for i, (first, last, _, _, d, t) in enumerate(writer.index)]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), *((n, pa.int64()) for n in ("first_id", "last_id", "n_docs", "n_ids")), ("block", pa.int32()), ("docs_before", pa.int64()), ("ids_before", pa.int64())]))

    return run


def write(docs: DataFrame, folder: str, scratch: Scratch, tokenizer: str | None = None, end_id: int = 0, cache_words: int = 400_000) -> DataFrame:
    """Writes docs (doc_id, text) as shards below folder; the manifest: one row for each block of each shard."""
    spark, path = docs.sparkSession, tokenizer or default_tokenizer()
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(partitions(spark), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    return scratch.cut(rows.mapInArrow(_write(path, folder, end_id, cache_words), MANIFEST))


def _read(digests):
    def run(it):
        reader = opened = None
        for batch in it:
            for path, block, start in zip(*(batch[c].to_pylist() for c in ("path", "block", "start")), strict=True):
                if path != opened:
                    reader, opened = Reader(path), path
                out = []
                for key, ids in reader.block(block):
                    out.append((id_of(key), start, len(ids), zlib.crc32(ids.tobytes()) if digests else ids))
                    start += len(ids)
                cols = list(zip(*out, strict=True))
                last = pa.array(cols[3], pa.int64()) if digests else pa.array(list(cols[3]), pa.list_(pa.uint32())).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), last], names=["doc_id", "start", "n_tokens", "ids_crc32" if digests else "ids"])

    return run


def read_back(manifest: DataFrame, digests: bool = False) -> DataFrame:
    """Every document of the shards, read block by block: doc_id, start, n_tokens and ids (digests: their crc32).

    A shard is read by one task, which opens it and reads its index once and holds one block at a time. The driver sums the ids of the shards, one number for each file.
    """
    spark = manifest.sparkSession
    sums = manifest.where("block = 0").select("shard", "n_ids").orderBy("shard").toLocalIterator()
    start, starts = 0, []
    for shard, n in sums:
        starts.append((shard, start))
        start += n
    before = spark.createDataFrame(starts, "shard int, shard_start long")
    units = manifest.join(before, "shard").select("shard", "path", "block", (F.col("shard_start") + F.col("ids_before")).alias("start"))
    units = units.repartitionById(partitions(spark), "shard").sortWithinPartitions("shard", "path", "block")
    return units.mapInArrow(_read(digests), "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digests else "ids array<long>"))


def lookup(manifest: DataFrame, doc_ids: list[int | None]) -> list[list[np.ndarray]]:
    """The ids of a few documents: the manifest names the shards, the shards' filters and indexes the blocks."""
    out = []
    for doc_id in doc_ids:
        if doc_id is None:
            near = manifest.where("block = 0").where("shard is not null")
        else:
            near = manifest.where(f"block = 0 or last_id = {doc_id} or first_id <= {doc_id} and last_id >= {doc_id}")
        paths = [r.path for r in near.select("shard", "path").distinct().orderBy("shard").toLocalIterator()]
        out.append([ids for p in paths for ids in Reader(p).lookup(doc_id)])
    return out
