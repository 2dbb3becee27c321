"""Neighbours, reachability and paths, a level at a time.

A level joins the frontier with the edges and drops what was seen before. Each level is a table written to the shared
folder, so a lost executor costs no replay. A frontier of a few nodes becomes a filter that the scan takes; it is
broadcast only while it is counted as small; a large one is shuffled on the node.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.columns import has_relation, is_project, is_test_file
from lodestone.operators.build import Graph
from lodestone.sources.shared import cut, drop

CALLS = ("calls", "references")
#: So many nodes are a filter of the scan, so many a broadcast.
FEW, SOME = 10, 50_000


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder."""
    return cut(df)


def neighbours(graph: Graph, node: str, out: bool, relations: tuple[str, ...] = ()) -> DataFrame:
    """The nodes across a node's edges, with the relation met: all of them, in order of id once sorted."""
    mine, other = ("source", "target") if out else ("target", "source")
    edges = (graph.edges if out else graph.into).where(F.col(mine) == node)
    if relations:
        edges = edges.where(has_relation(*relations))
    ends = edges.select(F.col(other).alias("id"), "relation", "confidence", "weight")
    return ends.join(graph.nodes.select("id", "name", "kind", "source_file"), "id")


def listed(rows: DataFrame, cap: int = 200) -> DataFrame:
    """The first `cap` rows by id; each has the total and whether it was cut."""
    rows = cut(rows)
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy("id").limit(cap).join(F.broadcast(total)).withColumn("truncated", F.col("total") > cap).orderBy("id")


def _across(step: DataFrame, frontier: DataFrame) -> DataFrame:
    """step (a, b) joined with the frontier on a = id."""
    few = [r.id for r in frontier.select("id").limit(FEW + 1).collect()]
    if len(few) <= FEW:
        step = step.where(F.col("a").isin(few))
    side = frontier.withColumnRenamed("id", "a")
    return step.join(F.broadcast(side) if len(few) <= FEW or frontier.limit(SOME + 1).count() <= SOME else side, "a")


def reachable(graph: Graph, starts: DataFrame, depth: int | None, backwards: bool = False, undirected: bool = False) -> DataFrame:
    """(id, depth) of every node within `depth` steps of the starts, or any number (None), these included at 0."""
    ahead = graph.edges.select(F.col("source").alias("a"), F.col("target").alias("b"))
    back = graph.into.select(F.col("target").alias("a"), F.col("source").alias("b"))
    step = ahead.union(back) if undirected else back if backwards else ahead
    frontier = cut(starts.select("id").distinct().withColumn("depth", F.lit(0)))
    levels, seen = [frontier], frontier
    for d in count(1) if depth is None else range(1, depth + 1):
        new = _across(step, frontier.select("id")).select(F.col("b").alias("id")).distinct()
        frontier = cut(new.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(d)))
        levels.append(frontier)
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    found = cut(seen)
    drop(*levels)
    return found


def path(graph: Graph, source: str, target: str, depth: int = 32, relations: tuple[str, ...] = ()) -> tuple[list[str] | None, bool]:
    """The least of the shortest paths by its ids, and whether the depth cut the search off."""
    if source == target:
        return [source], False
    step = (graph.edges.where(has_relation(*relations)) if relations else graph.edges).select(F.col("source").alias("a"), F.col("target").alias("b"))
    frontier = cut(graph.edges.sparkSession.createDataFrame([(source, [source])], "id string, path array<string>"))
    seen, levels = frontier.select("id"), [frontier]
    try:
        for _ in range(depth):
            new = _across(step, frontier).where("b <> a")
            new = new.groupBy(F.col("b").alias("id")).agg(F.min(F.concat("path", F.array("b"))).alias("path"))
            frontier = cut(new.join(seen, "id", "left_anti"))
            levels.append(frontier)
            if hit := frontier.where(F.col("id") == target).first():
                return hit.path, False
            if frontier.isEmpty():
                return None, False
            seen = seen.union(frontier.select("id"))
        beyond = _across(step, frontier.select("id")).select(F.col("b").alias("id")).join(seen, "id", "left_anti")
        return None, not beyond.isEmpty()
    finally:
        drop(*levels)


def starts_of(nodes: DataFrame, changes: list[str]) -> DataFrame:
    """Nodes whose source_file is a changed path or whose id is named."""
    paths = [c.replace("\\", "/").removeprefix("./") for c in changes]
    return nodes.where(F.col("source_file").isin(paths) | F.col("id").isin(changes)).select("id")


def impact(graph: Graph, starts: DataFrame, depth: int = 2) -> DataFrame:
    """(path, what) of the files that depend on the starts: impacted_file, or likely_test where the file is a test.

    Start nodes give tests only.
    """
    found = reachable(graph, starts, depth, backwards=True).join(graph.nodes.select("id", "source_file"), "id").where("source_file <> ''")
    test = is_test_file(F.col("source_file"))
    return found.where(test | (F.col("depth") > 0)).select(F.col("source_file").alias("path"), F.when(test, "likely_test").otherwise("impacted_file").alias("what")).distinct()


def neighbourhood(graph: Graph, starts: DataFrame, most: int = 10_000, depth: int = 64) -> tuple[DataFrame, bool]:
    """Undirected reach of the starts; a report that stops at `most` nodes, the nearest and then the least, and says so."""
    found = reachable(graph, starts, depth, undirected=True)
    return found.orderBy("depth", "id").limit(most), found.limit(most + 1).count() > most


def project_edges(graph: Graph) -> DataFrame:
    mine = graph.nodes.where(is_project(F.col("kind"))).select("id")
    edges = graph.edges.join(mine.withColumnRenamed("id", "source"), "source", "left_semi")
    return edges.join(mine.withColumnRenamed("id", "target"), "target", "left_semi")
