"""BPE encoding and decoding with content-defined chunk reuse.

1. Each text is cut where a rolling hash of its last 32 bytes says so, hence alike wherever a passage stands.
   Only the chunks' 128-bit hashes are shuffled and counted; a hash that occurs twice or more is shared.
2. One text of each shared chunk is fetched and encoded, once for the whole corpus. A bitmap, sized by the number of
   shared chunks, lets the scan send nearly only these; it errs on one side, so nothing is lost. Where it would take
   more than FILTER_BITS, every chunk is sent and the join alone decides.
3. Documents are dealt to buckets; each bucket gets the codes of the shared chunks that occur in it, once each,
   however many documents repeat them. The rest of a text is encoded in place.
4. Where two codes meet, the text around the joint is re-encoded: the window starts at the nearest spaces and
   widens until its own code agrees with the code on both sides, so the ids are exactly those of the whole text.

Defined cases: a null text is an empty one (no ids, the text ""). Empty tables give empty results. Rows that repeat
a doc_id are each encoded. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import wordcode
from lodestone.llm.common import Scratch, bucket_count, packed, small_batches, trimmed, unpacked
from lodestone.llm.wordcode import SPLIT, WordCoder, default_tokenizer, load

#: Least, usual (a power of two above the least) and most bytes of a chunk; the rolling hash's window.
LEAST, USUAL, MOST, WINDOW = 128, 512, 16384, 32
#: Bits of the bitmap for each shared chunk, at least, and in all, at most (32 MB).
CHUNK_BITS, FILTER_BITS = 16, 1 << 28
GEAR = np.frombuffer(b"".join(hashlib.blake2b(bytes([i]), digest_size=4).digest() for i in range(256)), "<u4")


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of UTF-8 bytes, always between characters."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    b = np.frombuffer(data, np.uint8)
    h = GEAR[b]
    step = 1
    while step < WINDOW:  # after each round h covers twice as many bytes
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        step *= 2
    ok = np.empty(n, bool)  # position p: a chunk may end before byte p
    ok[0] = False
    ok[1:] = (h[:-1] >> np.uint32(32 - USUAL.bit_length() + 1) == 0) & (b[1:] & 0xC0 != 0x80)
    out, last = [], 0
    for p in np.flatnonzero(ok).tolist():
        while p - last > MOST:
            q = last + MOST
            while data[q] & 0xC0 == 0x80:
                q -= 1
            out.append(q)
            last = q
        if p - last >= LEAST:
            out.append(p)
            last = p
    while n - last > MOST:
        q = last + MOST
        while data[q] & 0xC0 == 0x80:
            q -= 1
        out.append(q)
        last = q
    out.append(n)
    return out


def chunks(data: bytes) -> list[tuple[bytes, int, int]]:
    import xxhash

    at, out, h = 0, [], xxhash.xxh3_128_digest
    for end in cuts(data):
        out.append((h(data[at:end]), at, end))
        at = end
    return out


def _hashes(it):
    """(text, bucket) to the distinct (h, bucket, n) of each batch."""
    for batch in it:
        seen: dict[tuple[bytes, int], int] = {}
        for text, p in zip(batch["text"].to_pylist(), batch["p"].to_pylist(), strict=True):
            for h, _, _ in chunks((text or "").encode()):
                seen[h, p] = seen.get((h, p), 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.binary()), pa.array([k[1] for k in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["h", "p", "n"])


def _bit(h: bytes, p: int, size: int) -> int:
    return (int.from_bytes(h[:4], "big") + p * 2654435761) & (size - 1)


def _likely(bitmap):
    """(text, bucket) to (h, chunk) of the chunks whose bit is set, or of all where there is no bitmap: those that this bucket is to send."""

    def run(it):
        bits, sent = np.frombuffer(bitmap.value, np.uint8) if bitmap else None, set()
        size = 8 * len(bits) if bitmap else 0
        for batch in it:
            hs, texts = [], []
            for text, p in zip(batch["text"].to_pylist(), batch["p"].to_pylist(), strict=True):
                data = (text or "").encode()
                for h, a, b in chunks(data):
                    i = _bit(h, p, size) if size else 0
                    if (not size or bits[i >> 3] >> (i & 7) & 1) and h not in sent:
                        sent.add(h)
                        hs.append(h)
                        texts.append(data[a:b])
            if len(sent) > 200_000:
                sent.clear()
            yield pa.RecordBatch.from_arrays([pa.array(hs, pa.binary()), pa.array(texts, pa.binary())], names=["h", "chunk"])

    return run


def _encode_chunks(path, cache_words):
    def run(it):
        coder = wordcode.coder(path, cache_words)
        for batch in it:
            codes = coder.encode([c.decode() for c in batch["chunk"].to_pylist()])
            yield pa.RecordBatch.from_arrays([batch["h"].cast(pa.binary()), pa.array(codes, pa.binary())], names=["h", "ids"])

    return run


def _edge(coder: WordCoder, text: str, code: bytes, tail: bool, span: int) -> tuple[str, int] | None:
    """The text's last (first) part of span units whose own code is the last (first) of code; its text and length of code."""
    cut = [m.start() for m in SPLIT.finditer(text, max(0, len(text) - 256 * span) if tail else 0, len(text) if tail else min(len(text), 256 * span))]
    if len(cut) < span:
        return None
    part = text[cut[-span] :] if tail else text[: cut[span - 1]]
    own = coder.encode([part])[0]
    return (part, len(own)) if (code.endswith(own) if tail else code.startswith(own)) else None


def assemble(coder: WordCoder, runs: list[tuple[str, bytes]]) -> bytes:
    """The code of the joined texts, from the texts' own codes; windows at the joints widen until both sides agree."""
    done, text, code = [], "", b""  # code: of text, which may still change at its end
    for right, right_code in runs:
        if not right:
            continue
        if not text:
            text, code = right, right_code
            continue
        span = 1
        while True:
            left_edge, right_edge = _edge(coder, text, code, True, span), _edge(coder, right, right_code, False, span)
            if left_edge and right_edge:
                (tail, k), (head, m) = left_edge, right_edge
                done.append(code[: len(code) - k] + coder.encode([tail + head])[0])
                text, code = right[len(head) :], right_code[m:]
                break
            if span * 256 > len(text) + len(right):  # no place where both agree: the two texts as one
                text += right
                code = coder.encode([text])[0]
                break
            span *= 4
    return b"".join(done) + code


def encode_text(coder: WordCoder, text: str, known: dict[bytes, bytes]) -> bytes:
    """The ids of text, with the codes of its known chunks reused."""
    if not known:
        return coder.encode([text])[0]
    data = text.encode()
    runs, plain = [], -1
    for h, a, b in chunks(data):
        code = known.get(h)
        if code is None:
            plain = a if plain < 0 else plain
            continue
        if plain >= 0:
            runs.append((data[plain:a].decode(), None))
            plain = -1
        runs.append((data[a:b].decode(), code))
    if plain >= 0:
        runs.append((data[plain:].decode(), None))
    own = iter(coder.encode([t for t, c in runs if c is None]))
    return assemble(coder, [(t, next(own) if c is None else c) for t, c in runs])


def _documents(path, cache_words, digests):
    def run(it):
        coder, decoder, known, bucket = wordcode.coder(path, cache_words), wordcode.decoder(path), {}, None
        words = np.array([str(i).encode() + b"," for i in range(coder.tk.get_vocab_size())])
        wide = np.frombuffer(words.tobytes(), np.uint8).reshape(len(words), -1)
        for batch in it:
            got = []
            for p, h, ids, parcel in zip(*(batch[c].to_pylist() for c in ("p", "h", "ids", "parcel")), strict=True):
                if p != bucket:
                    bucket, known = p, {}
                if parcel is None:
                    known[h] = ids
                    continue
                rows = unpacked(parcel)
                for doc_id, text in zip(rows["doc_id"], rows["text"], strict=True):
                    code = np.frombuffer(encode_text(coder, text or "", known), "<u4")
                    listed = code.tolist()
                    if digests:
                        decimal = wide[code].ravel()
                        got.append((doc_id, len(listed), hashlib.sha256(decimal[decimal != 0].tobytes()[:-1]).hexdigest(), hashlib.sha256(decoder.text(listed).encode()).hexdigest()))
                    else:
                        got.append((doc_id, len(listed), listed, decoder.text(listed)))
                if got:
                    kinds = (pa.int64(), pa.int64(), pa.string() if digests else pa.list_(pa.int32()), pa.string())
                    names = ["doc_id", "n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"])]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got, strict=True), kinds, strict=True)], names=names)
                    got = []

    return run


def _bitmap(shared: DataFrame):
    """The broadcast bits of the shared chunks, or None where they would be more than FILTER_BITS."""
    bits = 1 << max(16, (CHUNK_BITS * shared.count() - 1).bit_length())
    if bits > FILTER_BITS:
        return None
    place = (F.conv(F.hex(F.substring("h", 1, 4)), 16, 10).cast("long") + F.col("p") * F.lit(2654435761)).bitwiseAND(bits - 1)
    marks = shared.select(place.alias("i")).groupBy(F.shiftright("i", 5).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, int(i & 31)))").alias("m"))
    marks = marks.toArrow()  # two numbers a row, as many rows as chunks at most
    bitmap = np.zeros(bits // 32, "<u4")
    bitmap[marks["w"].to_numpy()] = marks["m"].to_numpy().astype("<u4")
    return shared.sparkSession.sparkContext.broadcast(bitmap.tobytes())


def encode(docs: DataFrame, tokenizer: str | None = None, digests: bool = False, cache_words: int = 400_000) -> DataFrame:
    """doc_id, n_tokens, ids and decoded text of every document; digests: their sha256 instead of ids and text.

    tokenizer: the path of a byte-level BPE file of the tokenizers library. The result has one row for each row of docs.
    """
    spark, path = docs.sparkSession, tokenizer or default_tokenizer()
    small_batches(spark)
    load(path)
    scratch, buckets = Scratch(spark, "bpe"), bucket_count(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("p", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int"))

    seen = rows.select("text", "p").mapInArrow(trimmed(_hashes, "bpe"), "h binary, p int, n long").groupBy("h", "p").agg(F.sum("n").alias("n"))
    seen = scratch.cut(seen)
    shared = seen.groupBy("h").agg(F.sum("n").alias("n"), F.min("p").alias("p")).where("n > 1").select("h", "p")

    shared = scratch.cut(shared)
    sent = _bitmap(shared)

    texts = rows.select("text", "p").mapInArrow(trimmed(_likely(sent), "bpe"), "h binary, chunk binary").dropDuplicates(["h"])
    codes = texts.join(shared, "h", "left_semi").mapInArrow(trimmed(_encode_chunks(path, cache_words), "bpe"), "h binary, ids binary")
    nothing = F.lit(None).cast("binary")
    dealt = seen.select("h", "p").join(codes, "h").select("p", F.lit(0).alias("kind"), "h", "ids", nothing.alias("parcel"))
    parcels = packed(rows, ["doc_id", "text"], buckets).select("p", F.lit(1).alias("kind"), nothing.alias("h"), nothing.alias("ids"), "parcel")
    both = dealt.union(parcels)
    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")
    return both.repartitionById(buckets, "p").sortWithinPartitions("p", "kind").mapInArrow(trimmed(_documents(path, cache_words, digests), "bpe"), schema)
