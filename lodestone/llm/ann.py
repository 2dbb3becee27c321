"""Approximate nearest neighbours by cosine: multiprobe p-stable hashing.

Equal vectors are one class, so a group of copies costs as one vector. A table hashes a unit vector by k Gaussian
projections, each shifted by the median of a sample and cut into slots. The slots are wider than the projections of unit
vectors reach, so two half-lines are met, and a bucket is named by k bits. k grows with the logarithm of the rows: a bucket
of evenly spread vectors holds PER_BUCKET, whatever their number.

For a query, the chance that a neighbour at the angle looked for falls into a slot follows from the projection's own
value: it is normal around cos * x with deviation sin. A bucket's chance is the product. Buckets are visited in order
of these chances until they add up to `success`: that is, those at or above the chance at which the sum is reached. The
candidates of all tables are merged and ranked by the exact cosine.

The angle is the one that QUANTILE of SAMPLE rows (the bound of the fit) have to their k-th neighbour among all rows, from
one pass over the table. A query whose own k-th find lies farther off, or that found fewer than k, visits again with the
angle of that find (all buckets, where it found fewer than k). Every row is indexed, at every size alike.

A table's buckets are gathered by their first bits into cells, and a cell with more than BLOCK rows or queries into
blocks; a group of the join is a pair of blocks. A query goes only to cells that hold a bucket it visits, is compared
there only with the rows of the buckets it visits, and leaves its nearest.

Defined cases: vectors that are null, empty, zero, or hold a null or non-finite component take no part, nor do those of
a length other than the commonest one, nor rows without vec_id. Rows that repeat a vec_id are separate candidates, but
none is a candidate of its own vec_id. Ties (to 12 digits) go to the smaller vec_id. No rows: no result. Other columns
are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch

SAMPLE, QUANTILE, PER_BUCKET, BLOCK = 256, 0.1, 8, 8192
#: A cell has so many leading bits at least. Draws from which a chance is read where a table has more than EXACT bits.
CELL_BITS, DRAWS, EXACT = 5, 4096, 12
TABLES, SUCCESS, SEED = 2, 0.8, 20240607


def planes(table: int, k: int, dim: int) -> np.ndarray:
    """k Gaussian projections, orthogonal in groups of dim: unit vectors have projections of variance 1."""
    rng = np.random.default_rng([SEED, table])
    parts = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] * math.sqrt(dim) for _ in range(-(-k // dim))]
    return np.concatenate(parts, axis=1)[:, :k]


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / top  # very large or small components don't overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def names(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as numbers, the first bit highest."""
    out = np.zeros(len(bits), np.int64)
    for j in range(bits.shape[1]):
        out = out << 1 | bits[:, j]
    return out


_ERF = np.frompyfunc(math.erf, 1, 1)


def log_chances(x: np.ndarray, shifts: np.ndarray, cos: float | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of queries' projections: logarithms of the chances that a neighbour lies below and above each cut."""
    cos = np.broadcast_to(np.asarray(cos, float).reshape(-1, 1), (len(x), 1))
    sin = np.sqrt(np.maximum(1e-12, 1 - cos * cos))
    above = 0.5 * (1 + _ERF((cos * x - shifts) / (sin * math.sqrt(2))).astype(float))
    return np.log(np.maximum(1 - above, 1e-300)), np.log(np.maximum(above, 1e-300))


def least_chance(low: np.ndarray, high: np.ndarray, success: float, draws: np.ndarray) -> float:
    """The logarithm of the chance down to which one query's buckets, likeliest first, add up to success."""
    if success >= 1:
        return -math.inf
    if len(low) <= EXACT:
        log = np.zeros(1)
        for a, b in zip(low, high, strict=True):
            log = np.concatenate([log + a, log + b])
        log = -np.sort(-log)
        return float(log[min(np.searchsorted(np.cumsum(np.exp(log)), success), len(log) - 1)])
    # A neighbour drawn at random lies in a bucket of at least this chance in `success` of the cases.
    log = np.where(draws < np.exp(high), high, low).sum(axis=1)
    return float(np.quantile(log, 1 - success))


def cells_of(low: np.ndarray, high: np.ndarray, least: float, cell_bits: int) -> np.ndarray:
    """The leading bits of the buckets with at least this chance."""
    rest = np.maximum(low, high)[::-1].cumsum()[::-1]
    cell, log = np.zeros(1, np.int64), np.zeros(1)
    for j in range(cell_bits):
        cell, log = np.concatenate([cell << 1, cell << 1 | 1]), np.concatenate([log + low[j], log + high[j]])
        best = log + (rest[j + 1] if j + 1 < len(rest) else 0.0)
        cell, log = cell[best >= least - 1e-9], log[best >= least - 1e-9]
    return cell


def _index(k, shifts, cell_bits):
    def run(it):
        for batch in it:
            if batch.num_rows:
                u = unit(matrix(batch["v"]))
                for t in range(len(shifts)):
                    bucket = names((u @ planes(t, k, u.shape[1]) > shifts[t]).astype(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), t), pa.int32()), pa.array(bucket >> (k - cell_bits), pa.int64()), pa.array(bucket, pa.int64()), batch["rep"], batch["id"], batch["v"]], names=["tab", "cell", "bucket", "rep", "id", "v"])

    return run


def _probe(k, shifts, cell_bits, success):
    """rep, v, cos to the cells to visit, each with the least chance (logarithm) of its buckets."""

    def run(it):
        draws = np.random.default_rng(SEED).random((DRAWS, k)) if k > EXACT and success < 1 else None
        for batch in it:
            if batch.num_rows:
                u, cos = unit(matrix(batch["v"])), batch["cos"].to_numpy()
                for t in range(len(shifts)):
                    low, high = log_chances(u @ planes(t, k, u.shape[1]), shifts[t], cos)
                    # cos of -1 or less: all buckets.
                    least = [least_chance(a, b, success if c > -1 else 1.0, draws) for a, b, c in zip(low, high, cos, strict=True)]
                    got = [cells_of(a, b, x, cell_bits) for a, b, x in zip(low, high, least, strict=True)]
                    n = [len(g) for g in got]
                    at = pa.array(np.repeat(np.arange(len(u)), n))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t), pa.int32()), pa.array(np.concatenate(got), pa.int64()), batch["rep"].take(at), batch["v"].take(at), batch["cos"].take(at), pa.array(np.repeat(least, n), pa.float64())], names=["tab", "cell", "rep", "v", "cos", "least"])

    return run


#: Queries that a group compares at a time.
AT_ONCE = 256


def _nearest(keep, k, shifts):
    """A group's rows and queries to (q, rep, score): each query's nearest in the buckets it visits; rep null: how many it was compared with."""

    def run(table: pa.Table) -> pa.Table:
        asks = table["asks"].to_numpy() == 1
        v, rep, ids, t = unit(matrix(table["v"].combine_chunks())), table["rep"].to_numpy(), table["id"].to_numpy(zero_copy_only=False), table["tab"][0].as_py()
        least, cos, bucket = (table[c].to_numpy(zero_copy_only=False)[asks] for c in ("least", "cos", "bucket"))
        bucket = table["bucket"].to_numpy(zero_copy_only=False)[~asks].astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        rows, row_rep, row_id = v[~asks][order], rep[~asks][order], ids[~asks][order]
        found, starts = np.unique(bucket[order], return_index=True)
        ends = [*starts[1:].tolist(), len(rows)]
        bits = (found[:, None] >> np.arange(k - 1, -1, -1) & 1).astype(float)
        queries, query_rep = v[asks], rep[asks]
        out = []
        for a in range(0, len(queries) if len(rows) else 0, AT_ONCE):
            x = queries[a : a + AT_ONCE]
            low, high = log_chances(x @ planes(t, k, x.shape[1]), shifts[t], cos[a : a + AT_ONCE])
            visit = low.sum(axis=1)[:, None] + (high - low) @ bits.T >= least[a : a + AT_ONCE, None] - 1e-9
            score = np.full((len(x), len(rows)), -np.inf)
            for b, (start, end) in enumerate(zip(starts.tolist(), ends, strict=True)):
                at = np.flatnonzero(visit[:, b])
                if len(at):
                    score[at, start:end] = x[at] @ rows[start:end].T
            n = min(keep, len(rows))
            bound = np.partition(score, len(rows) - n, axis=1)[:, len(rows) - n]
            seen = visit @ np.diff([*starts, len(rows)])
            for i, q in enumerate(query_rep[a : a + AT_ONCE]):
                at = np.flatnonzero((score[i] >= bound[i] - 1e-12) & np.isfinite(score[i]))
                at = at[np.lexsort((row_id[at], -np.round(score[i, at], 12)))][:n]
                out.append((np.full(len(at) + 1, q), np.append(row_rep[at], 0), np.append(score[i, at], seen[i]), np.append(np.zeros(len(at), bool), True)))
        q, r, s, empty = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.array([], np.int64), np.array([], np.int64), np.array([], float), np.array([], bool))
        return pa.table({"q": pa.array(q, pa.int64()), "rep": pa.array(r, pa.int64(), mask=empty), "score": pa.array(s, pa.float64())})

    return run


def clean(rows: DataFrame) -> DataFrame:
    """vec_id and v, an array of doubles, of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and size(v) > 0")
    rows = rows.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    # The commonest length, the shorter at a tie: one number.
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).first()
    return rows.where(F.size("v") == (common.n if common else 0))


def fit(classes: DataFrame, k: int, bits: int, tables: int) -> tuple[np.ndarray, float]:
    """Shifts (a row for each table) and the cosine looked for, from SAMPLE rows held against all rows."""
    sample = classes.orderBy(F.xxhash64("rep")).limit(SAMPLE).toPandas()
    u = unit(np.stack(sample["v"].to_numpy()))
    shifts = np.stack([np.median(u @ planes(t, bits, u.shape[1]), axis=0) for t in range(tables)])
    sent = classes.sparkSession.sparkContext.broadcast(u)

    def tops(it):
        best = None
        for batch in it:
            if batch.num_rows:
                s = sent.value @ unit(matrix(batch["v"])).T
                best = s if best is None else np.concatenate([best, s], axis=1)
                if best.shape[1] > k + 1:
                    best = np.partition(best, best.shape[1] - k - 1, axis=1)[:, -k - 1 :]
        if best is not None:
            at = np.repeat(np.arange(len(best)), best.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(best.ravel(), pa.float64())], names=["s", "score"])

    # Its own row is a sample row's nearest; k + 1 values a partition of each of SAMPLE rows.
    ranked = classes.select("v").mapInArrow(tops, "s int, score double").groupBy("s").agg(F.sort_array(F.collect_list("score"), asc=False).alias("near"))
    kth = [r.c for r in ranked.select(F.get("near", F.lit(k)).alias("c")).collect() if r.c is not None]
    return shifts, float(np.clip(np.quantile(kth, QUANTILE), 0.0, 0.999)) if kth else 0.0


def _blocks(base: DataFrame, asked: DataFrame, run) -> DataFrame:
    """Each query's nearest in each pair of blocks of a cell."""
    cell = ["tab", "cell"]
    n = base.groupBy(*cell).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb"))
    m = asked.groupBy(*cell).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("mb"))
    both = n.join(m, cell)
    each = lambda size: F.explode(F.sequence(F.lit(0), F.col(size) - 1))
    mine = lambda size: F.pmod(F.xxhash64("rep"), F.col(size)).cast("int")
    none = lambda kind: F.lit(None).cast(kind)
    left = base.join(both, cell).select(*cell, "bucket", "rep", "id", "v", none("double").alias("cos"), none("double").alias("least"), F.lit(0).alias("asks"), mine("nb").alias("i"), each("mb").alias("j"))
    right = asked.join(both, cell).select(*cell, none("long").alias("bucket"), "rep", none("long").alias("id"), "v", "cos", "least", F.lit(1).alias("asks"), each("nb").alias("i"), mine("mb").alias("j"))
    return left.union(right).groupBy(*cell, "i", "j").applyInArrow(run, "q long, rep long, score double")


def search(rows: DataFrame, is_query, k: int = 5, tables: int = TABLES, success: float = SUCCESS) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows found for each row for which is_query holds, and visited.

    visited: with how many distinct vectors the query was compared, over all tables and visits. success: the chance that
    a neighbour at the query's angle is met in one table; 1: all buckets are visited, and the result is exact.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "ann")
    rows = scratch.cut(clean(rows))
    keep = k + 1  # a query's own row is among them
    # One row for each distinct vector with the least ids of its rows; no more are ever needed.
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    least = rows.select("vec_id", "v").distinct().withColumn("place", place).where(F.col("place") <= keep)
    classes = least.groupBy("v").agg(F.min("vec_id").alias("id"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    # Vectors that share a least id (rows that repeat a vec_id) still need names of their own.
    classes = scratch.cut(classes.withColumn("rep", F.xxhash64("id", "v")))
    n = classes.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, visited long")
    bits = max(1, math.ceil(math.log2(n / PER_BUCKET))) if n > PER_BUCKET else 1
    cell_bits = min(bits, max(CELL_BITS, math.ceil(math.log2(n / BLOCK))))
    shifts, cos = fit(classes, k, bits, tables)

    asking = scratch.cut(rows.where(is_query).select(F.col("vec_id").alias("query_id"), "v").distinct().join(classes.select("v", "rep"), "v").select("query_id", "rep"))
    asked = classes.join(asking.select("rep").distinct(), "rep", "left_semi").select("rep", "v", F.lit(cos).alias("cos"))
    base = scratch.cut(classes.select("rep", "id", "v").mapInArrow(_index(bits, shifts, cell_bits), "tab int, cell long, bucket long, rep long, id long, v array<double>"))
    near = F.round("score", 12)

    def visits(queries, pass_):
        probes = queries.mapInArrow(_probe(bits, shifts, cell_bits, success), "tab int, cell long, rep long, v array<double>, cos double, least double")
        return scratch.cut(_blocks(base, scratch.cut(probes), _nearest(keep, bits, shifts)).withColumn("pass", F.lit(pass_)))

    first = visits(asked, 1)
    # The k-th find besides the query's own vector, in one group's order; none: it found fewer.
    hits = first.where("rep is not null").select("q", "rep", "score").distinct()
    kth = hits.groupBy("q").agg(F.sort_array(F.collect_set(F.struct("score", "rep")), asc=False).alias("near"))  # keep finds of each cell visited
    kth = kth.select(F.col("q").alias("rep"), F.get("near", F.lit(min(keep, n) - 1))["score"].alias("kth"))
    again = asked.drop("cos").join(kth, "rep", "left").where(F.col("kth").isNull() | (F.col("kth") < cos)).select("rep", "v", F.coalesce("kth", F.lit(-2.0)).alias("cos"))
    found = first if success >= 1 else first.union(visits(scratch.cut(again), 2))

    best = found.where("rep is not null").groupBy("q", "rep").agg(F.max("score").alias("score"))
    high = F.rank().over(Window.partitionBy("q").orderBy(near.desc()))  # ties stay until their ids are known
    best = best.withColumn("high", high).where(F.col("high") <= keep).drop("high").join(classes.select("rep", "id", "ids"), "rep")
    order = Window.partitionBy("q").orderBy(near.desc(), "id", "rep")
    got = best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep).select("q", "ids", "score")
    seen = found.where("rep is null").groupBy("q").agg(F.sum("score").cast("long").alias("visited"))
    lists = got.groupBy("q").agg(F.collect_list(F.struct("score", "ids")).alias("near")).join(seen, "q")  # keep classes of keep ids at most
    out = asking.join(lists, asking["rep"] == lists["q"]).select("query_id", "visited", F.explode("near").alias("c")).select("query_id", "visited", "c.score", F.explode("c.ids").alias("vec_id")).where("vec_id <> query_id")
    out = out.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.max("visited").alias("visited"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(near.desc(), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "visited")
