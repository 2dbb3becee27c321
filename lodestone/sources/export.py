"""Sinks: JSON documents, Markdown and HTML reports, append-only logs."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import metrics
from lodestone.operators.build import Graph
from lodestone.operators.communities import rollup
from lodestone.sources.shared import at


def write_bundle(graph: Graph, path: str) -> None:
    """nodes.json and edges.json, one object a line in order; the folder appears whole (a rename commits each)."""
    graph.nodes.orderBy("id").write.mode("overwrite").json(f"{path}/nodes.json")
    graph.edges.orderBy("source", "target").write.mode("overwrite").json(f"{path}/edges.json")


def write_tables(graph: Graph, path: str) -> None:
    graph.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    graph.edges.write.mode("overwrite").parquet(f"{path}/edges")


def _table(df: DataFrame, top: int) -> list[str]:
    rows = df.limit(top).collect()
    return ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(str(x).replace("|", "\\|") for x in r) + " |" for r in rows)]


def markdown(graph: Graph, top: int = 10) -> str:
    """A report of the graph's rankings, and of its twenty largest communities with up to 15 members each where it has any."""
    parts = [("Kinds", metrics.kinds(graph).orderBy("kind")), ("Relations", metrics.relations(graph).orderBy("relation")), ("Most connected", metrics.god_nodes(graph, top)), ("Entry points", metrics.entry_points(graph, top)), ("Surprising links", metrics.surprising(graph, top)), ("Orphans", metrics.orphans(graph, top))]
    if "community" in graph.nodes.columns:
        own = graph.nodes.where("community is not null")
        largest = rollup(own).orderBy(F.desc("size"), "community").limit(20)
        place = F.row_number().over(Window.partitionBy("community").orderBy("id"))
        members = own.join(F.broadcast(largest.select("community")), "community", "left_semi").withColumn("place", place).where("place <= 15")
        members = members.groupBy("community").agg(F.array_join(F.sort_array(F.collect_list("id")), ", ").alias("members"))
        parts.append(("Communities", largest.join(members, "community").orderBy(F.desc("size"), "community")))
    return "\n".join(["# Graph", *(line for title, df in parts for line in ("", f"## {title}", "", *_table(df, 20 if title == "Communities" else top)))]) + "\n"


def viewer(graph: Graph, most: int = 2000) -> str:
    """A page with the most connected nodes and the edges among them as data, safe inside a script element."""
    nodes = metrics.degrees(graph).orderBy(F.desc("degree"), "id").limit(most).select("id", "name", "kind")
    ids = nodes.select("id")
    edges = graph.edges.join(F.broadcast(ids.withColumnRenamed("id", "source")), "source", "left_semi").join(F.broadcast(ids.withColumnRenamed("id", "target")), "target", "left_semi").select("source", "target", "relation")
    data = json.dumps({"nodes": [r.asDict() for r in nodes.collect()], "edges": [r.asDict() for r in edges.orderBy("source", "target").limit(10 * most).collect()]}).replace("<", "\\u003c").replace("\u2028", "\\u2028").replace("\u2029", "\\u2029")
    rows = "".join(f"<li>{html.escape(r.name or r.id)}</li>" for r in nodes.limit(50).collect())
    return f'<!doctype html><meta charset="utf-8"><title>Graph</title><ul>{rows}</ul><script type="application/json" id="graph">{data}</script>\n'


def append_log(rows: DataFrame, path: str, most: int = 5 << 20) -> None:
    """Appends rows as JSON lines. A log above `most` bytes becomes path.1, in place of the one before it, and a new one begins."""
    fs, where = at(rows.sparkSession, path)
    if fs.exists(where) and fs.getContentSummary(where).getLength() > most:
        _, older = at(rows.sparkSession, f"{path.rstrip('/')}.1")
        fs.delete(older, True)
        fs.rename(where, older)
    rows.write.mode("append").json(path)
