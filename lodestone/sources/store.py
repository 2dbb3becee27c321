"""A store of built graphs in the shared folder, so that a graph is built once and read by every query.

A stored graph has three tables: nodes by id, with their degrees; edges by source; and the same edges by target. Each is
range-partitioned and sorted by its key, so that a filter on the key reads the row groups that hold it and no others.
Edges of a large input are merged and sorted in up to four parts by a hash of their source, one after the other: each reads the
whole input and shuffles its share, and the shuffle files of a part are gone before the next. So a key is looked up in one row group
of each part. The same edges by target are sorted in such parts by a hash of the target. The nodes come from the stored edges.
The store's name is a digest of the recipe and of the path, length and time of every input file: a changed input makes
another store. A store is written beside its place and renamed into it, so a lost executor or a second writer leaves no half.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.build import Graph, with_ends
from lodestone.operators.metrics import degrees
from lodestone.sources.shared import at as _at
from lodestone.sources.shared import cut, drop, put, shared_dir

TABLES = {"nodes": ["id"], "edges": ["source", "target"], "into": ["target", "source"]}
#: Bytes of input for each part of the edges, and the most parts.
PART, PARTS = 64 << 20, 4


def state_of(spark: SparkSession, paths: list[str]) -> str:
    """A digest of the files below the paths: names, lengths and times, as the file system has them."""
    out = []
    for path in paths:
        fs, at = _at(spark, path)
        files = fs.listFiles(at, True)
        while files.hasNext():
            f = files.next()
            out.append(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}")
    return sha256("\n".join(sorted(out)).encode()).hexdigest()


def bytes_of(spark: SparkSession, paths: list[str]) -> int:
    return sum(fs.getContentSummary(at).getLength() for fs, at in (_at(spark, p) for p in paths))


def _part(edges: DataFrame, key: str, k: int, parts: int) -> DataFrame:
    return edges if parts == 1 else edges.where(F.pmod(F.hash(key), F.lit(parts)) == k)


def _read(spark: SparkSession, top: str) -> Graph:
    nodes, edges, into = (spark.read.parquet(f"{top}/{t}") for t in TABLES)
    return Graph(nodes, edges, into)


def stored(spark: SparkSession, recipe: str, inputs: list[str], make: Callable[[], Graph]) -> Graph:
    """The graph that make() builds from the files in inputs, read from the store; built and stored first where it is not there."""
    name = sha256(f"{recipe}|{state_of(spark, inputs)}".encode()).hexdigest()[:32]
    top = f"{shared_dir(spark)}/lodestone-graph-{name}"
    fs, at = _at(spark, top)
    if not fs.exists(at):
        half = f"{top}-{uuid.uuid4().hex}"
        graph = make()
        parts = min(PARTS, 1 + bytes_of(spark, inputs) // PART)
        for k in range(parts):
            merged = cut(_part(graph.edges, "source", k, parts))
            write(merged, half, "edges")
            drop(merged)
        edges = spark.read.parquet(f"{half}/edges")
        for k in range(parts):
            write(_part(edges, "target", k, parts), half, "into")
        into = spark.read.parquet(f"{half}/into")
        write(graph.nodes if graph.known is None else with_ends(graph.known, edges, into), half, "raw")
        write(degrees(Graph(spark.read.parquet(f"{half}/raw"), edges, into)), half, "nodes")
        fs.delete(_at(spark, f"{half}/raw")[1], True)
        if not fs.exists(at):
            fs.rename(_at(spark, half)[1], at)
        if fs.exists(_at(spark, half)[1]):  # another writer was first
            fs.delete(_at(spark, half)[1], True)
    return _read(spark, top)


def write(df: DataFrame, top: str, table: str) -> None:
    keys = TABLES.get(table)
    if keys:
        df = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    put(df, f"{top}/{table}", **{"parquet.block.size": 8 << 20, "compression": "zstd"})


def forget(spark: SparkSession) -> int:
    """Deletes every stored graph of the shared folder; their number."""
    fs, at = _at(spark, f"{shared_dir(spark)}/lodestone-graph-*")
    found = list(fs.globStatus(at) or [])
    for f in found:
        fs.delete(f.getPath(), True)
    return len(found)
