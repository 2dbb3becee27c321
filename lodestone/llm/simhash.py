"""SimHash near-duplicates by a self-join of a binary trie.

Every text gets a 64-bit fingerprint: a bit is set if it is set in over half of the hashes of its word shingles.
Equal fingerprints are one class, so copies never meet each other. The classes are the leaves of a binary trie over
the fingerprints' bits. The join walks pairs of its nodes together, adds up the bits in which their paths differ and
leaves a pair as soon as more than the budget differ. The first bits of the walk are laid out as groups, one for each
pair of prefixes within the budget, so the walk's upper part is a shuffle and each lower part a task of its own. A
prefix with more than BLOCK classes is split into blocks and its pairs into pairs of blocks: no group is larger than
2 * BLOCK, whatever the skew. A group returns a spanning forest of its links, not the links, and components() joins
the forests.

Fingerprints within `bits` of each other number at most a few tens of thousands for one centre, which bounds the
classes that a group of near copies can have, however many documents it holds.

Defined cases: a null text is an empty one; texts without words have fingerprint zero and link like any other. A row
with a null doc_id gets its fingerprint and its component; null ids name no component unless all of its ids are null.
Rows that repeat a doc_id are all kept. No rows: no result. Other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, components, small_batches, split_join, trimmed

#: Classes of a prefix that meet in one group. Node pairs that one step of a walk may hold.
BLOCK, FRONTIER = 16384, 1 << 20
#: Bits of the prefixes whose list may be broadcast: 65,536 rows of two numbers.
FEW_BITS = 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned. Words are runs of non-space bytes, A-Z lowered; fewer than `shingle` words are one shingle."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-1].tolist()]
    ends = (ends - 1).tolist()
    k = min(shingle, len(words))
    hashes = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[k - 1 :], strict=False)], "<u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprints(shingle):
    def run(it):
        for batch in it:
            got = np.array([fingerprint(t, shingle) for t in batch["text"].to_pylist()], "<u8").view("<i8")
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(got, pa.int64())], names=[*keep, "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(trimmed(_fingerprints(shingle), "simhash"), "doc_id long, fp long")


def walk(left: np.ndarray, right: np.ndarray | None, bits: int, depth: int):
    """Index pairs (i, j) of sorted unsigned fingerprints within `bits`, as arrays, some at a time.

    right None: left with itself, i < j. depth: so many first bits need no look, for left and right with themselves
    agree there; how they differ from each other has been taken off `bits` by the caller.
    """
    own = right is None
    right = left if own else right
    if not len(left) or not len(right):
        return
    above = lambda a: [np.concatenate([[0], np.cumsum(a >> np.uint64(63 - d) & np.uint64(1), dtype=np.int64)]) for d in range(64)]
    ones_l = above(left)
    ones_r = ones_l if own else above(right)
    stack = [(depth, np.array([[0, len(left), 0, len(right), bits]], np.int64).T)]
    while stack:
        d, at = stack.pop()
        if at.shape[1] > FRONTIER:
            half = at.shape[1] // 2
            stack += [(d, at[:, half:]), (d, at[:, :half])]
            continue
        l0, l1, r0, r1, left_over = at
        small = ((l1 - l0) * (r1 - r0) <= 4) | (d == 64)
        if small.any():
            yield from _leaves(left, right, l0[small], l1[small], r0[small], r1[small], bits_left=left_over[small], own=own, depth=d)
            l0, l1, r0, r1, left_over = at[:, ~small]
        if not len(l0):
            continue
        ls, rs = l1 - (ones_l[d][l1] - ones_l[d][l0]), r1 - (ones_r[d][r1] - ones_r[d][r0])
        parts = [np.stack([l0, ls, r0, rs, left_over]), np.stack([ls, l1, rs, r1, left_over]), np.stack([l0, ls, rs, r1, left_over - 1])]
        last = np.stack([ls, l1, r0, rs, left_over - 1])
        parts.append(last[:, (l0 != r0) | (l1 != r1)] if own else last)
        new = np.concatenate(parts, axis=1)
        new = new[:, (new[0] < new[1]) & (new[2] < new[3]) & (new[4] >= 0)]
        if new.shape[1]:
            stack.append((d + 1, new))


def _leaves(left, right, l0, l1, r0, r1, bits_left, own, depth):
    """Pairs of small node pairs, checked by the bits below."""
    below = np.uint64((1 << (64 - depth)) - 1)
    for a in range(int((l1 - l0).max())):
        for b in range(int((r1 - r0).max())):
            ok = (l0 + a < l1) & (r0 + b < r1)
            i, j, most = l0[ok] + a, r0[ok] + b, bits_left[ok]
            near = np.bitwise_count((left[i] ^ right[j]) & below) <= most
            if own:
                near &= i < j
            if near.any():
                yield i[near], j[near]


def forest(n: int, pairs) -> np.ndarray:
    """The least index linked to each of n, from arrays of index pairs."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            open_ = a != b
            if not open_.any():
                break
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def _group(bits, depth):
    def run(table: pa.Table) -> pa.Table:
        fp, side = table["fp"].to_numpy().view("<u8"), table["side"].to_numpy()
        left, right = np.sort(fp[side == 0]), np.sort(fp[side == 1])
        if table["lo"][0].as_py() == table["hi"][0].as_py():
            right = None
            pairs, nodes = walk(left, None, bits, depth), left
        elif len(left) and len(right):
            apart = int(np.bitwise_count(left[0] >> np.uint64(64 - depth) ^ right[0] >> np.uint64(64 - depth)))
            pairs = ((i, j + len(left)) for i, j in walk(left, right, bits - apart, depth))
            nodes = np.concatenate([left, right])
        else:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        root = forest(len(nodes), pairs)
        at = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.table({"a": nodes[at].view("<i8"), "b": nodes[root[at]].view("<i8")})

    return run


def links(classes: DataFrame, bits: int = 3, block: int = BLOCK) -> DataFrame:
    """Distinct fp to links (a, b) that join every two fingerprints within `bits`, over one or more steps."""
    n = classes.count()
    depth = min(32, max(4, (n // max(1, block // 2)).bit_length()))
    prefix = F.shiftrightunsigned("fp", 64 - depth).cast("int")
    rows = classes.select("fp", prefix.alias("x"))
    # A row for each prefix; broadcast only where there are no more than 2 ** FEW_BITS of them.
    small = F.broadcast if depth <= FEW_BITS else (lambda df: df)
    blocks = rows.groupBy("x").agg(F.ceil(F.count("*") / block).cast("int").alias("nb"))
    masks = [sum(1 << i for i in c) for k in range(bits + 1) for c in combinations(range(depth), k)]
    own = rows.join(small(blocks), "x").withColumn("blk", F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int"))
    near = own.select("fp", "x", "blk", F.explode(F.array(*[F.lit(m) for m in masks])).alias("m")).select("fp", "x", "blk", F.col("x").bitwiseXOR(F.col("m")).alias("y"))
    near = near.join(small(blocks.select(F.col("x").alias("y"), "nb")), "y").select("fp", "x", "blk", "y", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other"))
    code = lambda x, blk: F.shiftleft(F.col(x).cast("long"), 20) + F.col(blk)
    near = near.select("fp", code("x", "blk").alias("c"), code("y", "other").alias("o"))
    near = near.select("fp", F.least("c", "o").alias("lo"), F.greatest("c", "o").alias("hi"), (F.col("c") > F.col("o")).cast("int").alias("side"))
    return near.groupBy("lo", "hi").applyInArrow(_group(bits, depth), "a long, b long")


def near_duplicates(docs: DataFrame, bits: int = 3, shingle: int = 3, block: int = BLOCK) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id reachable over links of at most `bits`, of every row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    fps = scratch.cut(fingerprints(docs, shingle))
    classes = scratch.cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("size")))
    comps = components(spark, links(classes.select("fp"), bits, block), scratch)
    rooted = classes.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.select("fp", "root", "size").join(ids, "root").select("fp", "component_id", "size")
    # All copies share a fingerprint, however many they are.
    return split_join(fps, of, ["fp"], "size", fps.count()).select("doc_id", "fp", "component_id")


def _row_key():
    """16 bytes for doc_id and text. Rows that agree in both are exact copies; a null text is an empty one."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.unhex(F.md5(F.concat_ws(" ", text("doc_id"), text("text"))))


def keep_one(docs: DataFrame, bits: int = 3, shingle: int = 3) -> DataFrame:
    """One row of each component of linked fingerprints: the one with the smallest doc_id, a null one last.

    Rows go by their own fingerprints: those that repeat a doc_id, or have none, are copies only where they link. Of
    rows of one component that share its smallest doc_id, the one with the least hash of its text stays.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row_key().alias("key"), F.col("text").cast("string").alias("text"))
    fps = scratch.cut(rows.mapInArrow(trimmed(_fingerprints(shingle), "simhash"), "doc_id long, key binary, fp long"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    classes = scratch.cut(fps.groupBy("fp").agg(F.min(order).alias("first")))
    comps = components(spark, links(classes.select("fp"), bits), scratch)
    rooted = classes.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    chosen = scratch.cut(rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.key").alias("sh_key")))
    keyed = docs.withColumn("sh_key", _row_key())
    twice = scratch.cut(fps.groupBy(F.col("key").alias("sh_key")).count().where("count > 1").select("sh_key").join(chosen, "sh_key", "left_semi"))
    if twice.isEmpty():
        return keyed.join(chosen, "sh_key", "left_semi").drop("sh_key")
    # Exact copies of a chosen row: the least by the other columns stays.
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    least = F.struct(F.col("text").isNotNull().alias("some"), F.to_json(F.struct(*rest)) if rest else F.lit(""))
    copies = keyed.join(twice, "sh_key", "left_semi").groupBy("sh_key").agg(F.min_by(F.struct(*docs.columns), least).alias("row")).select("row.*")
    return keyed.join(chosen.join(twice, "sh_key", "left_anti"), "sh_key", "left_semi").drop("sh_key").unionByName(copies)
