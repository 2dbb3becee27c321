"""Graphs and logs laid over relational tables, so every operator can run on stored data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def path_of(name: str, key: Column) -> Column:
    """Every tenth entity lies below tests/; extensions take turns."""
    ext = F.when(key % 4 == 0, ".py").when(key % 4 == 1, ".ts").when(key % 4 == 2, ".rs").otherwise(".go")
    folder = F.when(key % 10 == 0, f"src/{name}/tests/").otherwise(f"src/{name}/")
    return F.concat(folder, key.cast("string"), ext)


def id_of(name: str, key: Column) -> Column:
    return F.concat(F.lit(f"{name}_"), key.cast("string"))


#: Entity tables: key, name column, node kind.
ENTITIES = {
    "region": ("r_regionkey", "r_name", "class"),
    "nation": ("n_nationkey", "n_name", "class"),
    "customer": ("c_custkey", "c_name", "file"),
    "supplier": ("s_suppkey", "s_name", "file"),
    "part": ("p_partkey", "p_name", "function"),
    "orders": ("o_orderkey", None, "function"),
}


def commerce_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw nodes. Every seventh part is left out, so edges to it lack their end."""
    out = None
    for name, (key, label, kind) in ENTITIES.items():
        rows = table(spark, sf_dir, name)
        k = F.col(key).cast("long")
        if name == "part":
            rows = rows.where(k % 7 != 0)
        node = rows.select(id_of(name, k).alias("id"), F.lit(kind).alias("kind"), (F.col(label) if label else id_of(name, k)).alias("name"), path_of(name, k).alias("source_file"), F.lit("L1").alias("source_location"))
        out = node if out is None else out.unionByName(node)
    return out


def commerce_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw edges, parallel ones included."""

    def edge(rows, source, s, target, t, relation, confidence="EXTRACTED"):
        s, t = F.col(s).cast("long"), F.col(t).cast("long")
        sure = F.lit(confidence) if isinstance(confidence, str) else confidence(t)
        return rows.select(id_of(source, s).alias("source"), id_of(target, t).alias("target"), F.lit(relation).alias("relation"), path_of(source, s).alias("source_file"), sure.alias("confidence"), F.lit(1.0).alias("weight"))

    get = lambda name: table(spark, sf_dir, name)
    lines = get("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")
    called = lambda t: F.when(t % 14 == 0, "EXTERNAL_CALL").when(t % 7 == 0, "EXTRACTED").otherwise("LOCAL_CALL")
    parts = [
        edge(get("customer"), "customer", "c_custkey", "nation", "c_nationkey", "imports"),
        edge(get("supplier"), "supplier", "s_suppkey", "nation", "s_nationkey", "imports"),
        edge(get("nation"), "nation", "n_nationkey", "region", "n_regionkey", "contains"),
        edge(get("orders"), "orders", "o_orderkey", "customer", "o_custkey", "calls", "LOCAL_CALL"),
        edge(lines, "orders", "l_orderkey", "part", "l_partkey", "calls", called),
        edge(lines, "orders", "l_orderkey", "supplier", "l_suppkey", "references"),
        edge(lines.where("l_returnflag = 'R'"), "orders", "l_orderkey", "supplier", "l_suppkey", "calls", "LOCAL_CALL"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def event_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between the types of a user's consecutive events, weight: how often."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("event_type", F.lead("event_type").over(w).alias("target"))
    rows = rows.where("target is not null and target <> event_type").groupBy(F.col("event_type").alias("source"), "target").agg(F.count("*").cast("double").alias("weight"))
    return rows.select("source", "target", F.lit("calls").alias("relation"), F.lit("src/events.py").alias("source_file"), F.lit("EXTRACTED").alias("confidence"), "weight")


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page url, and the target and place of each link in its html."""
    hrefs = F.regexp_extract_all(F.col("html"), F.lit(r'href="([^"]*)"'), 1)
    return table(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(hrefs).alias("pos", "href"))


def usage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as entries of a usage log: one file reference for each, its size from the properties."""
    k = F.get_json_object("props", "$.k").cast("long")
    files = F.array(F.struct(F.concat(F.lit("src/u"), F.col("user_id").cast("string"), F.lit(".py")).alias("path"), (F.coalesce(k, F.lit(0)) * 100).alias("bytes")))
    return table(spark, sf_dir, "events").select("event_id", "ts", F.col("event_type").alias("cmd"), F.floor(F.col("value") * 10).cast("long").alias("wall_ms"), F.floor(F.col("value") * 100).cast("long").alias("output_bytes"), files.alias("files"))


def incident_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an incident log: error is an occurrence, view an acknowledgement, signup a resolution."""
    kind = F.when(F.col("event_type") == "error", "occurrence").when(F.col("event_type") == "view", "ack").when(F.col("event_type") == "signup", "resolve")
    rows = table(spark, sf_dir, "events").withColumn("kind", kind).where("kind is not null")
    cls = F.when(F.col("user_id") % 3 == 0, "build").when(F.col("user_id") % 3 == 1, "query").otherwise("daemon")
    return rows.select(F.col("event_id").alias("ord"), "ts", "kind", F.col("user_id").alias("fingerprint"), cls.alias("class"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as outcomes: success is quality, severe is toxic, the model is the source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    labels = table(spark, sf_dir, "labels")
    risk = F.when(F.col("doc_id") % 3 == 0, "low").when(F.col("doc_id") % 3 == 1, "medium").otherwise("high")
    provenance = F.when(F.col("doc_id") % 5 == 0, "human").when(F.col("doc_id") % 5 == 1, "ci").otherwise("machine")
    return labels.join(docs, "doc_id").select(F.col("doc_id").alias("outcome_id"), F.col("source").alias("model"), F.col("lang").alias("category"), risk.alias("risk"), provenance.alias("provenance"), F.col("quality").alias("success"), F.col("toxic").alias("severe"), (F.col("doc_id") * 3600).alias("recorded_at"), F.col("n_chars").alias("tokens"))


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two states of a file set from documents: files come, go, and every fifth that stays has changed."""
    docs = table(spark, sf_dir, "documents")
    n = docs.count()
    row = docs.select("doc_id", F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("rel_path"), F.sha2("text", 256).alias("content_hash"))
    changed = F.when(F.col("doc_id") % 5 == 0, F.sha2(F.concat("content_hash", F.lit("*")), 256)).otherwise(F.col("content_hash"))
    return row.where(F.col("doc_id") < 0.8 * n).drop("doc_id"), row.where(F.col("doc_id") >= 0.2 * n).select("rel_path", changed.alias("content_hash"))
