"""Graph metrics: counts, degrees, rankings, surprising links, cycles."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.columns import is_project
from lodestone.operators.build import Graph
from lodestone.operators.traverse import checkpointed
from lodestone.sources.shared import drop


def degrees(graph: Graph) -> DataFrame:
    """nodes with in_degree, out_degree and degree: one shuffle of the edges' ends, or none where a store has them."""
    if "degree" in graph.nodes.columns:
        return graph.nodes
    if graph.by_target is None:
        ends = graph.edges.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    else:  # either end is counted where its rows lie together
        n = F.count("*")
        ends = graph.edges.groupBy(F.col("source").alias("id")).agg(n.alias("o")).withColumn("i", F.lit(0)).unionByName(graph.by_target.groupBy(F.col("target").alias("id")).agg(n.alias("i")).withColumn("o", F.lit(0)))
    n = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return graph.nodes.join(n.hint("merge"), "id", "left").select(*graph.nodes.columns, zero("in_degree"), zero("out_degree")).withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def kinds(graph: Graph) -> DataFrame:
    return graph.nodes.groupBy("kind").agg(F.count("*").alias("n"))


def relations(graph: Graph) -> DataFrame:
    """Edges by their first relation."""
    return graph.edges.groupBy("relation").agg(F.count("*").alias("n"))


def density(graph: Graph) -> DataFrame:
    n = graph.nodes.agg(F.count("*").alias("nodes"))
    both = n.join(F.broadcast(graph.edges.agg(F.count("*").alias("edges"))))
    d = F.when(F.col("nodes") > 1, F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1)).cast("double")).otherwise(0.0)
    return both.select("nodes", "edges", d.alias("density"))


def busiest(graph: Graph, side: str, top: int = 5) -> DataFrame:
    """The nodes of most edges that come in (side "in") or go out ("out"); ties by id."""
    return degrees(graph).orderBy(F.desc(f"{side}_degree"), "id").limit(top).select("id", f"{side}_degree")


def summary(graph: Graph, top: int = 10) -> dict[str, DataFrame]:
    """The tables of a graph's overview, each bounded."""
    return {"size": density(graph), "god_nodes": god_nodes(graph, top), "entry_points": entry_points(graph, top), "top_files": top_files(graph, top), "surprising": surprising(graph, min(top, 5))}


def community_of(graph: Graph, node: str, most: int = 50) -> DataFrame:
    """node, community, size, and its first members by id, at most `most`. No row where the node has no community or is none."""
    home = graph.nodes.where(F.col("id") == node).select("community").where("community is not null").limit(1)
    members = graph.nodes.join(F.broadcast(home), "community", "left_semi")
    size = home.join(F.broadcast(members.agg(F.count("*").alias("size"))))
    first = members.orderBy("id").limit(most).agg(F.sort_array(F.collect_list("id")).alias("members"))
    return size.join(F.broadcast(first)).select(F.lit(node).alias("node"), "community", "size", "members")


def god_nodes(graph: Graph, top: int = 20) -> DataFrame:
    found = degrees(graph).where(is_project(F.col("kind"))).orderBy(F.desc("degree"), "id").limit(top)
    return found.select("id", "kind", "in_degree", "out_degree", "degree")


def orphans(graph: Graph, top: int = 20) -> DataFrame:
    ends = graph.edges.select(F.col("source").alias("id")).union(graph.edges.select("target"))
    found = graph.nodes.where(is_project(F.col("kind"))).join(ends, "id", "left_anti")
    return found.orderBy("id").limit(top).select("id", "kind", "source_file")


def entry_points(graph: Graph, top: int = 20) -> DataFrame:
    """Files that depend on much and on which little depends."""
    ratio = F.col("out_degree") / F.greatest(F.col("in_degree"), F.lit(1)).cast("double")
    found = degrees(graph).where("kind = 'file' and out_degree > 0").withColumn("ratio", ratio)
    return found.orderBy(F.desc("ratio"), "id").limit(top).select("id", "in_degree", "out_degree", "ratio")


def top_files(graph: Graph, top: int = 20) -> DataFrame:
    return degrees(graph).where("kind = 'file'").orderBy(F.desc("degree"), "id").limit(top).select("id", "source_file", "degree")


#: Rows up to which a set of ids or edges is broadcast, and how many edges beyond the top have their ends' kinds looked up before all do.
SMALL, FIRST = 10_000, 1_000


def _sized(table: DataFrame) -> DataFrame:
    """A written table as one side of a join: broadcast while its rows are counted as small, else never. Spark would go by the files' bytes, which say little of the rows: sorted ids take less than a byte each."""
    return F.broadcast(table) if table.count() <= SMALL else table.hint("merge")


def _meets(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows whose end in the column is one of the ids, a table that is written; the rows stay where they are while the ids are counted as small."""
    return rows.join(_sized(ids.select(F.col("id").alias(column))), column, "left_semi")


def _closing(graph: Graph, nodes: DataFrame) -> DataFrame:
    """The edges that can be part of a triangle x to y to z with x to z: all that are in one, and few others.

    A common neighbour always closes such a triangle, for the edge x to y or the edge y to z. So y has edges in and out,
    z is behind a y and has two edges in, x is before a z and has two edges out; each set is found from the one before.
    nodes: with their degrees.
    """
    e, into = graph.edges.select("source", "target"), graph.into.select("source", "target")
    kept = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(checkpointed(df))
        return kept[-1]

    def met(edges: DataFrame, column: str, ids: DataFrame) -> DataFrame:
        return _meets(edges, column, ids).select("source", "target")

    def ends(edges: DataFrame, column: str, where: str) -> DataFrame:
        return keep(_meets(nodes.where(where).select("id"), "id", keep(edges.select(F.col(column).alias("id")).distinct())))

    middle = keep(nodes.where("in_degree > 0 and out_degree > 0").select("id"))
    second = keep(met(e, "source", middle))
    last = ends(second, "target", "in_degree > 1")
    direct = keep(met(into, "target", last))
    start = ends(direct, "source", "out_degree > 1")
    first = keep(met(keep(met(e, "source", start)), "target", middle))
    # What is left of the first edges bounds the others once more.
    middle, start = (keep(first.select(F.col(c).alias("id")).distinct()) for c in ("target", "source"))
    second, direct = met(met(second, "target", last), "source", middle), met(direct, "source", start)
    out = checkpointed(first.union(second).union(direct).distinct())
    drop(*kept)
    return out


def surprising(graph: Graph, top: int = 20) -> DataFrame:
    """Project edges whose ends share no predecessor and no successor.

    Two ends with a common neighbour close a triangle, so only edges that can be part of one meet each other. Every pair
    that such an edge joins, in either direction, is laid from the end of lower degree to the other; a triangle's three
    pairs then leave one corner twice, and a corner has no more than the square root of twice the edges of such pairs.
    So a hub's neighbours never meet each other.

    The edges that share a neighbour are all found. Kinds are looked up for the first of the others in order, and for
    all of them only where too few of these join project nodes.
    """
    if graph.by_target is None:
        graph = Graph(graph.nodes, checkpointed(graph.edges.select("source", "target", "relation")))
    d = degrees(graph).select("id", "kind", "in_degree", "out_degree")
    common = _common(_closing(graph, d))
    edges = graph.edges.select("source", "target", "relation")
    alone = edges.join(_sized(common), ["source", "target"], "left_anti")
    head = checkpointed(alone.orderBy("source", "target").limit(top + FIRST))
    ends = head.select(F.col("source").alias("id")).union(head.select("target")).distinct()
    mine = checkpointed(d.where(is_project(F.col("kind"))).join(F.broadcast(ends), "id", "left_semi").select("id"))
    found = checkpointed(_meets(_meets(head, "source", mine), "target", mine).select("source", "target", "relation"))
    if found.count() < top and head.count() == top + FIRST:
        mine = checkpointed(graph.nodes.where(is_project(F.col("kind"))).select("id"))
        found = _meets(_meets(alone, "source", mine), "target", mine).select("source", "target", "relation")
    return found.orderBy("source", "target").limit(top)


def _common(e: DataFrame) -> DataFrame:
    """The edges (source, target) whose ends have a common predecessor or successor by the edges given, a table that is dropped."""
    small = e.count() <= SMALL
    side = lambda df: df if small else df.hint("merge")
    ends = e.select(F.explode(F.array("source", "target")).alias("id"))
    rank = ends.groupBy("id").agg(F.count("*").alias("degree"))
    pairs = e.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), (F.col("source") < F.col("target")).cast("int").alias("up"))
    # way: 1 from a to b, 2 from b to a, 3 both.
    pairs = pairs.groupBy("a", "b").agg(F.sum(F.when(F.col("up") == 1, 1).otherwise(2)).cast("int").alias("way"))
    pairs = pairs.join(side(rank.select(F.col("id").alias("a"), F.col("degree").alias("da"))), "a").join(side(rank.select(F.col("id").alias("b"), F.col("degree").alias("db"))), "b")
    first = F.struct("da", "a") <= F.struct("db", "b")
    back = lambda c: F.element_at(F.array(F.lit(2), F.lit(1), F.lit(3)), c)
    laid = checkpointed(pairs.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("v"), F.when(first, F.col("way")).otherwise(back(F.col("way"))).alias("way")))
    one, two = laid.select("u", F.col("v").alias("v"), F.col("way").alias("uv")), laid.select("u", F.col("v").alias("w"), F.col("way").alias("uw"))
    wedges = one.join(side(two), "u").where("v < w")
    third = laid.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("w"), F.when(F.col("u") < F.col("v"), F.col("way")).otherwise(back(F.col("way"))).alias("vw"))
    triangles = wedges.join(side(third), ["v", "w"])

    def has(way, bit):
        return way.bitwiseAND(bit) != 0

    # Each of a triangle's edges from x to y, with z as the corner in common: z before both, or after both.
    sides = F.array(*[
        F.struct(x.alias("x"), y.alias("y"), xy.alias("xy"), xz.alias("xz"), yz.alias("yz"))
        for x, y, xy, xz, yz in (
            (F.col("u"), F.col("v"), F.col("uv"), F.col("uw"), F.col("vw")),
            (F.col("u"), F.col("w"), F.col("uw"), F.col("uv"), back(F.col("vw"))),
            (F.col("v"), F.col("w"), F.col("vw"), back(F.col("uv")), back(F.col("uw"))),
        )
    ])
    s = triangles.select(F.explode(sides).alias("s")).select("s.*")
    shared = (has(F.col("xz"), 1) & has(F.col("yz"), 1)) | (has(F.col("xz"), 2) & has(F.col("yz"), 2))
    s = s.where(shared)
    common = s.where(has(F.col("xy"), 1)).select(F.col("x").alias("source"), F.col("y").alias("target")).union(s.where(has(F.col("xy"), 2)).select("y", "x"))
    common = checkpointed(common.distinct())
    drop(e, laid)
    return common


def cycles(edges: DataFrame, top: int = 20, longest: int | None = None) -> DataFrame:
    """The first `top` simple cycles by length, then ids; each starts with its least node.

    Nodes without an edge in or out are trimmed first. Paths grow by one edge a round, only to nodes above their start,
    and the rounds end with the length at which enough cycles are known, so longer ones are never enumerated.
    """
    e = checkpointed(edges.select("source", "target").where("source <> target").distinct())
    while True:
        core = checkpointed(e.join(e.select(F.col("source").alias("target")).distinct(), "target", "left_semi").join(e.select(F.col("target").alias("source")).distinct(), "source", "left_semi").select("source", "target"))
        if core.count() == e.count():
            break
        e = core
    paths = core.where("target > source").select(F.col("source").alias("start"), F.col("target").alias("end"), F.array("source", "target").alias("path"))
    back = core.select(F.col("source").alias("end"), F.col("target").alias("start"))
    found, n = None, 0
    for length in count(2) if longest is None else range(2, longest + 1):
        paths = checkpointed(paths)
        if paths.isEmpty():
            break
        closed = paths.join(back, ["end", "start"], "left_semi").select(F.lit(length).alias("length"), F.col("path").alias("nodes"))
        closed = checkpointed(closed)
        found = closed if found is None else found.union(closed)
        n += closed.count()
        if n >= top:
            break
        paths = paths.join(core.select(F.col("source").alias("end"), F.col("target").alias("next")), "end").where("next > start and not array_contains(path, next)")
        paths = paths.select("start", F.col("next").alias("end"), F.concat("path", F.array("next")).alias("path"))
    if found is None:
        return edges.sparkSession.createDataFrame([], "length int, nodes array<string>")
    return found.orderBy("length", "nodes").limit(top)
