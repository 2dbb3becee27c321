"""Communities: local moving and aggregation (Louvain), and their rollup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.traverse import checkpointed


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b, w), a < b: the weights of both directions."""
    return edges.where("source <> target").groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.sum("weight").alias("w"))


def _moves(both: DataFrame, labels: DataFrame, strength: DataFrame, total: float, half: int) -> DataFrame:
    """Each node of this half of the nodes to the neighbouring community of greatest gain, ties to the least label."""
    k = strength.join(labels, "id").groupBy("label").agg(F.sum("k").alias("kc"))
    near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id"), "label").agg(F.sum("w").alias("kin"))
    own = labels.select("id", "label", F.lit(0.0).alias("kin"))
    options = near.unionByName(own).groupBy("id", "label").agg(F.sum("kin").alias("kin")).join(k, "label").join(strength, "id").join(labels.withColumnRenamed("label", "mine"), "id")
    rest = F.col("kc") - F.when(F.col("label") == F.col("mine"), F.col("k")).otherwise(0.0)
    gain = F.round(F.col("kin") - rest * F.col("k") / (2 * total), 9)
    best = options.groupBy("id", "mine").agg(F.max_by("label", F.struct(gain.alias("g"), (F.col("label") == F.col("mine")).alias("s"), (-F.xxhash64("label")).alias("t"))).alias("label"))
    turn = F.pmod(F.xxhash64("id"), F.lit(2)) == half
    return best.select("id", F.when(turn, F.col("label")).otherwise(F.col("mine")).alias("label"))


def modularity(pairs: DataFrame, labels: DataFrame) -> float:
    """Of a labelling of an undirected graph; loops (a = b) count once."""
    m = pairs.agg(F.sum("w")).first()[0] or 0.0
    if not m:
        return 0.0
    ends = pairs.select(F.col("a").alias("id"), "w").union(pairs.select("b", "w")).join(labels, "id").groupBy("label").agg(F.sum("w").alias("k"))
    inner = pairs.join(labels.select(F.col("id").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b").where("la = lb").agg(F.sum("w")).first()[0] or 0.0
    return inner / m - ends.agg(F.sum(F.pow(F.col("k") / (2 * m), F.lit(2.0)))).first()[0]


def numbered(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """rows numbered from 0 by a total order: ranges are numbered within, from the sum of the ranges before."""
    parts = checkpointed(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    before = F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.groupBy("part").count().select("part", before.alias("start"))  # as many rows as there are ranges
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return parts.withColumn("place", place).join(F.broadcast(starts), "part").withColumn(name, (F.col("start") + F.col("place")).cast("int")).drop("part", "place", "start")


def louvain(nodes: DataFrame, edges: DataFrame, sweeps: int = 8, levels: int = 4) -> DataFrame:
    """(id, community): numbered by size, then least member.

    Moves are made set-at-a-time by joins, one half of the nodes after the other so that pairs don't swap for ever; a
    sweep that does not raise modularity ends the level. Communities become the next level's nodes.
    """
    pairs = checkpointed(undirected(edges))
    whole = checkpointed(nodes.select("id").distinct().withColumn("label", F.col("id")))
    current = pairs
    for _ in range(levels):
        ends = current.select(F.col("a").alias("id"), "w").union(current.select("b", "w"))
        strength = checkpointed(ends.groupBy("id").agg(F.sum("w").alias("k")))
        total = current.agg(F.sum("w")).first()[0] or 0.0
        if not total:
            break
        both = current.where("a <> b")
        both = checkpointed(both.select("a", "b", "w").union(both.select("b", "a", "w")))
        labels = checkpointed(strength.select("id", F.col("id").alias("label")))
        score = modularity(current, labels)
        start = score
        for _ in range(sweeps):
            moved = labels
            for half in (0, 1):
                moved = checkpointed(_moves(both, moved, strength, total, half))
            new = modularity(current, moved)
            if new <= score + 1e-9:
                break
            labels, score = moved, new
        if score <= start + 1e-9:
            break
        step = labels.select(F.col("id").alias("label"), F.col("label").alias("next"))
        whole = checkpointed(whole.join(step, "label", "left").select("id", F.coalesce("next", "label").alias("label")))
        up = current.join(labels.select(F.col("id").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b")
        current = checkpointed(up.groupBy(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).agg(F.sum("w").alias("w")))
    sizes = whole.groupBy("label").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    number = numbered(sizes, "community", F.desc("n"), F.col("least"))
    return whole.join(number.select("label", "community"), "label").select("id", "community")


def rollup(nodes: DataFrame) -> DataFrame:
    """Communities with size, counts by kind, common folder and commonest kind; labels are folder and kind with an s."""
    folder = F.when(F.col("source_file") != "", F.slice(F.split("source_file", "/"), 1, F.size(F.split("source_file", "/")) - 1))
    kinds = nodes.groupBy("community", "kind").agg(F.count("*").alias("n"), F.min(folder).alias("low"), F.max(folder).alias("high"))
    found = kinds.groupBy("community").agg(
        F.sum("n").alias("size"), *[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"{k}_count") for k in ("file", "function", "class")],
        F.min_by("kind", F.struct(-F.col("n"), "kind")).alias("modal"), F.min("low").alias("low"), F.max("high").alias("high"),
    )
    # The common beginning of all folders is that of the least and the greatest.
    pairs = F.arrays_zip(F.slice("low", 1, F.least(F.size("low"), F.size("high"))).alias("l"), F.slice("high", 1, F.least(F.size("low"), F.size("high"))).alias("h"))
    same = F.aggregate(pairs, F.struct(F.lit("").alias("p"), F.lit(True).alias("on")), lambda acc, x: F.struct(F.when(acc["on"] & (x["l"] == x["h"]), F.concat_ws("/", F.nullif(acc["p"], F.lit("")), x["l"])).otherwise(acc["p"]).alias("p"), (acc["on"] & (x["l"] == x["h"])).alias("on")), lambda acc: acc["p"])
    return found.select("community", "size", "file_count", "function_count", "class_count", F.coalesce(F.nullif(same, F.lit(".")), F.lit("")).alias("folder"), F.when(F.col("modal") != "unknown", F.concat("modal", F.lit("s"))).alias("kind_label"))
