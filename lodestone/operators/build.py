"""Property graphs from raw records: merging, placeholders, order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.columns import edge_language, has_relation, interop_family
from lodestone.functions.ids import normalize_id
from lodestone.sources.shared import cut


@dataclass(frozen=True)
class Graph:
    """nodes(id, kind, name, source_file, ...) and edges(source, target, relation, relations, ...), one edge for each ordered pair.

    by_target: the same edges laid out by target, where a store has them. known: the nodes without those that only edges name,
    where build_graph() made the graph.
    """

    nodes: DataFrame
    edges: DataFrame
    by_target: DataFrame | None = None
    known: DataFrame | None = None

    @property
    def into(self) -> DataFrame:
        return self.edges if self.by_target is None else self.by_target

    def only(self, *relations: str) -> Graph:
        """The graph with the edges that have one of the relations."""
        return Graph(self.nodes, self.edges.where(has_relation(*relations)), self.into.where(has_relation(*relations)))


def _with(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(kind) for c, kind in columns.items() if c not in df.columns})


def dedupe_nodes(nodes: DataFrame) -> DataFrame:
    """The first row of each id by source_file."""
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.col("source_file").asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in nodes.columns if c not in ("id", "source_file")]))
    return nodes.withColumn("place", place).where("place = 1").drop("place")


def merge_edges(edges: DataFrame) -> DataFrame:
    """One row for each (source, target, relation): the first by source_file and by location as text, weights added up."""
    edges = _with(edges, {"source_location": "string", "context": "string", "confidence": "string"})
    rest = F.struct(F.coalesce("source_file", F.lit("")).alias("k1"), F.coalesce("source_location", F.lit("")).alias("k2"), "source_file", "source_location", "context", "confidence")
    out = edges.groupBy("source", "target", "relation").agg(F.min(rest).alias("r"), F.sum(F.coalesce("weight", F.lit(1.0))).alias("weight"))
    return out.select("source", "target", "relation", "r.source_file", "r.source_location", "r.context", "r.confidence", "weight")


def build_graph(nodes: DataFrame, edges: DataFrame, ascii_ids: bool = False) -> Graph:
    """Normalised ids, no loops or empty ids, missing ends as nodes of kind unknown, parallel edges folded.

    Of nodes whose ids fall together the one with the last raw id stays. An edge keeps the attributes of the first of
    its parallels by raw ends and relation, the sum of weights and every relation, in that order.
    """
    nodes = _with(nodes, {"kind": "string", "name": "string", "source_file": "string", "source_location": "string", "is_method": "boolean"})
    nodes = nodes.withColumn("raw", F.col("id")).withColumn("id", normalize_id(F.col("id"), ascii_ids)).where("id is not null")
    attrs = [c for c in nodes.columns if c not in ("id", "raw")]
    kept = nodes.groupBy("id").agg(F.max_by(F.struct(*attrs), F.struct("raw", *[F.col(c) for c in attrs])).alias("a")).select("id", "a.*")

    edges = _with(edges, {"relation": "string", "source_file": "string", "source_location": "string", "context": "string", "confidence": "string", "weight": "double"})
    # A filter on a projection is pushed below it and works its expressions out again; it isn't pushed below a generator.
    ends = F.struct(normalize_id(F.col("source"), ascii_ids).alias("s"), normalize_id(F.col("target"), ascii_ids).alias("t"))
    edges = edges.select("*", F.inline(F.array(ends))).where("s <> '' and t <> '' and s <> t")
    key = F.struct("source", "target", F.coalesce("relation", F.lit("")).alias("relation"))
    first = F.struct(key.alias("key"), "source_file", "source_location", "context", "confidence")
    weight = F.coalesce(F.nullif(F.col("weight"), F.lit(0.0)), F.lit(1.0))
    merged = edges.groupBy(F.col("s").alias("source"), F.col("t").alias("target")).agg(F.min(first).alias("f"), F.sum(weight).alias("weight"), F.sort_array(F.collect_set(key)).alias("keys"))
    relations = F.array_distinct(F.filter(F.transform("keys", lambda x: x["relation"]), lambda r: r != ""))
    merged = merged.select("source", "target", F.get(relations, F.lit(0)).alias("relation"), relations.alias("relations"), "f.source_file", "f.source_location", "f.context", "f.confidence", "weight")

    return Graph(with_ends(kept, merged), merged, known=kept)


def with_ends(known: DataFrame, edges: DataFrame, by_target: DataFrame | None = None) -> DataFrame:
    """The nodes and, of kind unknown, the ends of edges that are none of them. by_target: the edges laid out by target."""
    into = edges if by_target is None else by_target
    ends = edges.select(F.col("source").alias("id")).distinct().union(into.select("target").distinct()).distinct().join(known.hint("merge"), "id", "left_anti")
    ends = ends.select("id", F.lit("unknown").alias("kind"), F.col("id").alias("name"))
    return known.unionByName(ends, allowMissingColumns=True)


def dispatch_methods(edges: DataFrame, nodes: DataFrame, imports: DataFrame, most: int = 3) -> DataFrame:
    """Calls of a bare method name sent on to the methods of that name.

    edges: source, target, relation, confidence, source_file, called. nodes: id, name, source_file, is_method. imports:
    (source_file, target_file). Outside calls stay. A candidate must be of the caller's interop family, unless either
    side's file type is unknown; a Python caller must share its file or import it. One to `most` candidates: an edge to
    each. Otherwise the edge stays if its target is a known node, and goes if not. The gates come before the count.
    Equal calls are each sent on; a candidate counts once, however many equal calls or nodes there are.

    Calls that agree in name, family and file are one question, asked once. Without the import gate a question's
    candidates depend on name and family alone, so a name that too many methods share is cut before it meets a call.
    """
    edges = cut(edges)  # read four times below
    open_call = (F.col("relation") == "calls") & F.col("called").isNotNull() & ~F.col("confidence").eqNullSafe("EXTERNAL_CALL")
    family = lambda c: F.when(edge_language(F.col(c)) != "other", interop_family(F.col(c)))
    asks = edges.select(F.when(open_call, F.lower("called")).alias("nm"), "source_file").where("nm is not null").distinct()
    asks = asks.withColumns({"fam": family("source_file"), "py": F.coalesce(edge_language(F.col("source_file")) == "python", F.lit(False))})
    methods = nodes.where("is_method").select(F.lower("name").alias("nm"), F.col("id").alias("method"), F.col("source_file").alias("method_file")).distinct()
    methods = methods.withColumn("method_fam", family("method_file"))
    # A caller of any other kind than Python's meets its name's methods of its family and of no known family.
    kinds = asks.where("not py").select("nm", "fam").distinct()
    fits = (F.col("fam").isNull() | F.col("method_fam").isNull() | (F.col("fam") == F.col("method_fam")))
    sizes = methods.groupBy("nm", "method_fam").agg(F.countDistinct("method").alias("k")).join(kinds, "nm").where(fits)
    # Methods that stand in several files may count twice here: what passes is counted exactly below.
    few = sizes.groupBy("nm", "fam").agg(F.max("k").alias("k")).where(F.col("k") <= most).select(F.col("nm").alias("n2"), F.col("fam").alias("f2"))
    plain = asks.where("not py").join(few, (F.col("nm") == F.col("n2")) & F.col("fam").eqNullSafe(F.col("f2"))).select("nm", "source_file", "fam")
    plain = plain.join(methods, "nm").where(fits).select("nm", "source_file", "method")
    # A Python caller meets the methods of its own file and of the files that it imports.
    near = imports.select("source_file", F.col("target_file").alias("method_file")).union(asks.where("py").select("source_file", "source_file")).distinct()
    python = asks.where("py").join(near, "source_file").join(methods, ["nm", "method_file"]).where(fits).select("nm", "source_file", "method")
    found = plain.union(python).distinct()
    counted = found.groupBy("nm", "source_file").agg(F.count("*").alias("k")).where(F.col("k") <= most).drop("k")
    found = cut(found.join(counted, ["nm", "source_file"], "left_semi").select("nm", F.col("source_file").alias("file"), "method"))

    known = nodes.select(F.col("id").alias("target")).distinct().withColumn("known", F.lit(True))
    asked = edges.withColumn("nm", F.when(open_call, F.lower("called")))
    sent = asked.join(found, (asked["nm"] == found["nm"]) & asked["source_file"].eqNullSafe(found["file"])).select(*[F.col("method").alias("target") if c == "target" else F.col(c) for c in edges.columns])
    hit = found.select(F.col("nm").alias("n2"), "file").distinct()
    rest = asked.join(hit, (F.col("nm") == F.col("n2")) & F.col("source_file").eqNullSafe(F.col("file")), "left_anti").join(known, "target", "left")
    return sent.unionByName(rest.where(F.col("nm").isNull() | F.col("known")).select(*edges.columns))
