"""What the operators of this subpackage share: the shared folder, cut lineage, batches, components."""

from __future__ import annotations

import gc
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch handed to Python. Documents may be long, so batches stay short.
ARROW_ROWS = 512
#: So many keys may be hot, each with more than its share of the rows; no less than HOT_ROWS make a key hot.
HOT_KEYS, HOT_ROWS = 4096, 256


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a folder of our own only in local mode (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    set_now = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_now.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("/tmp/checkpoints")
        set_now = spark.sparkContext._jsc.sc().getCheckpointDir()
    return str(set_now.get()).rstrip("/")


#: Bytes of one Arrow batch, about, for a row may be longer than that.
ARROW_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to ARROW_ROWS and ARROW_BYTES at most; smaller settings stay."""
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = re.sub(r"[bB]$", "", spark.conf.get(key))
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


#: What a worker process keeps for its next tasks, of one owner at a time.
_KEPT: dict = {"owner": None}


def kept(owner: str, key, make):
    """An object that a worker keeps for its next tasks. What another operator has kept goes first, so no two add up."""
    if _KEPT["owner"] != owner:
        _KEPT.clear()
        _KEPT["owner"] = owner
        trim()
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def trim() -> None:
    """Gives a worker's free memory back to the system."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library: it frees by its own rules
        pass


def trimmed(run, owner: str):
    """A mapInArrow function that finds nothing in its worker that another owner has kept, and leaves no free memory there."""

    def wrapped(it):
        kept(owner, "on", bool)
        try:
            yield from run(it)
        finally:
            trim()

    return wrapped


def split_join(many: DataFrame, one: DataFrame, keys: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """many joined with one on keys, in which one has a row at most for each key, though a key may hold any share of many.

    size: a column of one with the key's number of rows in many, not more than total in all. A key is hot with more than
    its part, total / HOT_KEYS; hence there are no more than HOT_KEYS hot ones, and their list is broadcast. A hot key's
    rows are dealt by a hash of the row over enough salts that none holds more than a part, and its row of one is copied to each.
    No key may be null. size is not returned.
    """
    part = max(HOT_ROWS, -(-total // HOT_KEYS))
    copies = F.when(F.col(size) > part, F.ceil(F.col(size) / part)).otherwise(1).cast("int")
    hot = one.where(F.col(size) > part).select(*keys, copies.alias("sj_n"))
    left = many.join(F.broadcast(hot), keys, "left").withColumn("sj_salt", F.coalesce(F.pmod(F.xxhash64(*many.columns), F.col("sj_n")).cast("int"), F.lit(0))).drop("sj_n")
    right = one.withColumn("sj_salt", F.explode(F.sequence(F.lit(0), copies - 1))).drop(size)
    return left.join(right, [*keys, "sj_salt"], how).drop("sj_salt")


class Scratch:
    """Tables written to the shared folder to cut lineage. A table outlives the executors that made it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.top, self.n = spark, f"{shared_dir(spark)}/lodestone-{name}-{uuid.uuid4().hex}", 0

    def cut(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.top}/t{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._lodestone_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            delete(self.spark, df._lodestone_path)

    def folder(self, name: str) -> str:
        return f"{self.top}/{name}"


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b) as (node, root): root is the least node of the component.

    Alternates large and small stars (Kiveris et al., 2014): each round is two aggregations, the hot node's
    neighbours are re-linked by a join and never gathered into a list, and the rounds grow with the logarithm
    of the longest chain. Null ends and loops are ignored; nodes without an edge don't appear.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = scratch.cut(e)
    last, total = None, e.count()
    for _ in range(rounds):
        # Large star: every neighbour above a node links to the least of the node's neighbourhood.
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("size")).select("a", F.least("a", "m").alias("m"), "size")
        large = split_join(both, least, ["a"], "size", 2 * total).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: a node and its lower neighbours link to the least of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("size"))
        small = split_join(large, low, ["a"], "size", 2 * total)
        new = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        new = scratch.cut(new)
        mark = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
        scratch.drop(e)
        e, total = new, mark.n
        if last == (mark.n, mark.s):
            break
        last = (mark.n, mark.s)
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("b").alias("node")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("node", F.col("node").alias("root")))


#: Bytes of text that a bucket is to hold, about.
BUCKET = 64 << 20


def bucket_count(docs: DataFrame) -> int:
    """Into how many buckets the texts of docs go: the session's shuffle partitions, more where these would grow beyond BUCKET."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return max(partitions(docs.sparkSession), -(-size // BUCKET))


#: Bytes of text that one compressed parcel gathers, over all buckets.
PARCEL = 16 << 20


def packed(docs: DataFrame, keep: list[str], buckets: int) -> DataFrame:
    """Rows (doc_id, text, ...) dealt to buckets by a hash of both, as compressed parcels (p, parcel).

    Texts that must move do so at less than half of the size that rows would take in a shuffle.
    """
    import pyarrow as pa

    def run(it):
        held, size = [], 0

        def emit():
            table = pa.Table.from_batches(held)
            by = table.append_column("row", pa.array(range(table.num_rows), pa.int32())).group_by("p").aggregate([("row", "list")])
            ps, blobs = by["p"].to_pylist(), []
            for rows in by["row_list"]:
                part, out = table.select(keep).take(rows.values).combine_chunks(), pa.BufferOutputStream()
                with pa.ipc.new_stream(out, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_table(part)
                blobs.append(out.getvalue().to_pybytes())
            return pa.RecordBatch.from_arrays([pa.array(ps, pa.int32()), pa.array(blobs, pa.binary())], names=["p", "parcel"])

        for batch in it:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
                if size >= PARCEL:
                    yield emit()
                    held, size = [], 0
        if held:
            yield emit()

    p = F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int").alias("p")
    return docs.select(p, *keep).mapInArrow(trimmed(run, "packed"), "p int, parcel binary")


def unpacked(parcel: bytes):
    """The columns of a parcel, by name, as lists."""
    import pyarrow as pa

    return pa.ipc.open_stream(parcel).read_all().to_pydict()
