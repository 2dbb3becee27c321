"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of `window` words (an item with fewer words is one window). A window lies in a
document only if all its words do, so the necessary prefix of its words, ordered by rarity in the corpus, is the
single rarest one. Documents are joined on these prefix words; the word's place in the window bounds where the
window must start, and the window's length must fit the document (length and positional bounds); what remains is
verified word by word. The join is made in the scan: a text never moves.

The corpus counts of the benchmark's words cover all documents. The benchmark is taken in blocks of at most
BLOCK_WORDS words, so what is broadcast is bounded (about 60 MB of tuples in a worker); each block makes its pass over the documents, and the passes'
results are merged. A usual benchmark is one block.

Defined cases: a null text has no words. An item without words is no window. Items with a null id are looked for and
count as one item named "". Items that share an id are one item. An empty benchmark hits nothing. Each row of docs
gives one row, repeated rows too. mark() replaces columns called dc_words, dc_spans and dc_items; find() returns its own
columns only; clean() returns the columns of docs, whatever their names.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, small_batches, trimmed

BLOCK_WORDS = 200_000
#: Bytes of words stay (letters lowered), all others become spaces.
TABLE = bytes(b if b in b"0123456789abcdefghijklmnopqrstuvwxyz" or b > 127 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
ADDED = {"dc_words": "long", "dc_spans": "array<int>", "dc_items": "array<string>"}


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TABLE).split()


def blocks(benchmark: DataFrame, most: int):
    """Lists of (item id, words) with at most about `most` words each."""
    out, n = [], 0
    for r in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        if w := words(r.text):
            out.append((r.item_id, w))
            n += len(w)
        if n >= most:
            yield out
            out, n = [], 0
    if out:
        yield out


def _count(vocabulary):
    def run(it):
        for batch in it:
            n: Counter = Counter()
            for t in batch["text"].to_pylist():
                n.update(filter(vocabulary.value.__contains__, words(t)))
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

    return run


def index(items: list[tuple[str, list[bytes]]], counts: dict[bytes, int], window: int) -> dict:
    """Prefix word -> (its place, the window's length) -> the window's words -> the items that hold it."""
    out: dict = {}
    for item, w in items:
        size = min(window, len(w))
        for i in range(len(w) - size + 1):
            win = tuple(w[i : i + size])
            at = min(range(size), key=lambda k: (counts.get(win[k], 0), win[k], k))
            out.setdefault(win[at], {}).setdefault((at, size), {}).setdefault(win, set()).add(item)
    return out


def match(w: list[bytes], idx: dict) -> tuple[list[tuple[int, int]], set[str]]:
    """Spans (start, end) of the windows in the words w, and their items."""
    spans, items = [], set()
    for i, x in enumerate(w):
        if x in idx:
            for (at, size), windows in idx[x].items():
                start = i - at
                if start >= 0 and start + size <= len(w) and (found := windows.get(tuple(w[start : start + size]))):
                    spans.append((start, start + size))
                    items |= found
    return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _match(sent):
    def run(it):
        idx = sent.value
        for batch in it:
            n, spans_out, items_out = [], [], []
            old = [batch[c].to_pylist() for c in ("dc_spans", "dc_items")] if "dc_spans" in batch.schema.names else [[[]] * batch.num_rows] * 2
            for t, spans, items in zip(batch["text"].to_pylist(), *old, strict=True):
                w = words(t)
                got, found = match(w, idx)
                got = merged([*zip(spans[::2], spans[1::2], strict=True), *got])
                n.append(len(w))
                spans_out.append([x for s in got for x in s])
                items_out.append(sorted({*items, *found}))
            keep = [c for c in batch.schema.names if c not in ADDED]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(n, pa.int64()), pa.array(spans_out, pa.list_(pa.int32())), pa.array(items_out, pa.list_(pa.string()))], names=[*keep, *ADDED])

    return run


def mark(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with dc_words (their number), dc_spans (start and end word of each merged hit, in turn) and dc_items."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.drop(*ADDED)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), *(f"{k} {v}" for k, v in ADDED.items())])
    scratch, out, last = Scratch(spark, "decon"), rows, None
    for items in blocks(benchmark, block_words):
        if last is not None:
            out = scratch.cut(out.mapInArrow(trimmed(_match(last), "decon"), schema))
        vocabulary = spark.sparkContext.broadcast(frozenset(x for _, w in items for x in w))
        counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(trimmed(_count(vocabulary), "decon"), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
        counts = {bytes(r.word): r.n for r in counts.toLocalIterator()}  # no more rows than the block has words
        vocabulary.unpersist()
        last = spark.sparkContext.broadcast(index(items, counts, window))
    return out.mapInArrow(trimmed(_match(last or spark.sparkContext.broadcast({})), "decon"), schema)


def find(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, contaminated, items and spans of every row of docs."""
    marked = mark(docs.select("doc_id", F.col("text").cast("string").alias("text")), benchmark, window, block_words)
    spans = F.expr("transform(sequence(0, int(size(dc_spans) / 2) - 1), i -> named_struct('start', dc_spans[2 * i], 'end', dc_spans[2 * i + 1]))")
    out = marked.select("doc_id", F.col("dc_words").alias("n_words"), F.col("dc_items").alias("items"), F.when(F.size("dc_spans") > 0, spans).otherwise(F.expr("array()")).alias("spans"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), (n_hit > 0).alias("contaminated"), "items", "spans")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of docs, all their columns as they were, in which no window occurs."""
    row = docs.select(F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return mark(row, benchmark, window).where("size(dc_spans) = 0").select("row.*")
