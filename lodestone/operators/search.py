"""Finding nodes by name: ranked search, near candidates, and the cascade that resolves a token to a node."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.columns import thousandths

TIERS = ("exact-id", "name", "path-suffix", "id-substring", "name-substring", "tokens")
SEARCH_MOST = 100


def clean(token: str) -> str:
    return token.strip().lower().strip("`")


def words(token: str) -> list[str]:
    """Parts of three letters and more."""
    return [p for p in re.split(r"[^a-z0-9]+", token) if len(p) >= 3]


def _text(c: str) -> Column:
    return F.lower(F.coalesce(F.col(c), F.lit("")))


def _path() -> Column:
    return F.replace(_text("source_file"), F.lit("\\"), F.lit("/"))


def _hits(parts: list[str], hay: Column) -> Column:
    return sum((F.when(hay.contains(p), 1).otherwise(0) for p in parts), F.lit(0))


def view(*more: str) -> list[Column]:
    """What is shown of a node."""
    return [F.col("id"), F.coalesce("name", "id").alias("name"), F.coalesce("kind", F.lit("unknown")).alias("kind"), F.coalesce("source_file", F.lit("")).alias("source_file"), *map(F.col, more)]


def ranked(nodes: DataFrame, text: str) -> DataFrame:
    """Every node that matches, with tier and score: its best offer."""
    token, parts = clean(text), words(clean(text))
    if not token:
        raise ValueError("empty search")
    node, name, path, n = F.lower("id"), _text("name"), _path(), F.lit(float(len(token)))
    offer = lambda ok, tier, score: F.when(ok, F.struct(F.lit(tier).alias("tier"), (-score).alias("minus")))
    offers = [
        offer(node == token, 0, F.lit(1.0)),
        offer(name == token, 1, F.lit(1.0)),
        offer((path != "") & path.endswith(token.replace("\\", "/")), 2, F.when(F.col("kind") == "file", 1.0).otherwise(0.9)),
        offer(node.contains(token) & (node != token), 3, thousandths(n / F.length("id"))),
        offer((name != "") & name.contains(token) & (name != token), 4, thousandths(n / F.length(name))),
    ]
    if parts:
        hits = _hits(parts, F.concat_ws(" ", node, name, path))
        offers.append(offer(hits > 0, 5, thousandths(hits / F.lit(float(len(parts))))))
    best = F.array_min(F.filter(F.array(*offers), lambda x: x.isNotNull()))
    return nodes.withColumn("best", best).where("best is not null").select(*view(), F.col("best.tier").alias("tier"), (-F.col("best.minus")).alias("score"))


def search(nodes: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """The first `limit` matches with match_type, score, and total_matches on each row."""
    limit = max(1, min(limit, SEARCH_MOST))
    found = ranked(nodes, text)
    total = found.agg(F.count("*").alias("total_matches"))
    names = F.element_at(F.array(*[F.lit(t) for t in TIERS]), F.col("tier") + 1)
    top = found.orderBy("tier", F.desc("score"), "id").limit(limit)
    return top.join(F.broadcast(total)).orderBy("tier", F.desc("score"), "id").select("id", "name", "kind", "source_file", names.alias("match_type"), "score", "total_matches")


def candidates(nodes: DataFrame, token: str, limit: int = 5) -> DataFrame:
    """Nodes that share most parts with a token that was not found."""
    parts = words(clean(token))
    hits = _hits(parts, F.replace(F.concat_ws(" ", F.lower("id"), _text("name"), _text("source_file")), F.lit("\\"), F.lit("/")))
    return nodes.withColumn("hits", hits).where("hits > 0").orderBy(F.desc("hits"), "id").limit(limit).select(*view("hits"))


def resolve(nodes: DataFrame, token: str) -> DataFrame:
    """(place, id, match_type): the node meant first, then alternates, three or, for path suffixes, four.

    The first way that finds anything counts: exact id; name, nearest the root first; path suffix, files first; part of the id.
    """
    token = clean(token)
    path = _path()
    depth = F.when(F.trim(path, F.lit("/")) == "", 0).otherwise(F.length(F.trim(path, F.lit("/"))) - F.length(F.replace(F.trim(path, F.lit("/")), F.lit("/"), F.lit(""))))
    way = (
        F.when(F.col("id") == token, F.struct(F.lit(0).alias("way"), F.lit(0).alias("a")))
        .when(_text("name") == token, F.struct(F.lit(1).alias("way"), depth.alias("a")))
        .when((path != "") & path.endswith(token.replace("\\", "/")), F.struct(F.lit(2).alias("way"), F.lit(0).alias("a")))
        .when(F.col("id").contains(token), F.struct(F.lit(3).alias("way"), F.length("id").alias("a")))
    )
    found = nodes.select("id", "kind", way.alias("w")).where("w is not null")
    # A later way counts only where no earlier one finds anything. Seven rows hold the answer: the first of the first way,
    # files before others, and the six least of it by depth or length, then id.
    found = found.select("id", "kind", "w.*")
    plain = ["way", "a", "id"]
    lead = found.orderBy("way", F.when((F.col("way") == 2) & (F.col("kind") != "file"), 1).otherwise(0), "a", "id").limit(1)
    few = lead.withColumn("lead", F.lit(1)).union(found.orderBy(*plain).limit(6).withColumn("lead", F.lit(0)))
    few = few.groupBy("id", "way", "a").agg(F.max("lead").alias("lead"))
    least = F.min("way").over(Window.partitionBy())
    rest = few.withColumn("least", least).where("way = least")
    keep = F.when(F.col("way") == 0, 1).when(F.col("way") == 2, 5).otherwise(4)
    place = F.row_number().over(Window.orderBy(F.desc("lead"), "a", "id"))  # seven rows
    names = F.element_at(F.array(*[F.lit(x) for x in ("exact-id", "name", "path-suffix", "fuzzy")]), F.col("way") + 1)
    return rest.withColumn("place", place).where(F.col("place") <= keep).select((F.col("place") - 1).alias("place"), "id", names.alias("match_type"))


def resolve_id(nodes: DataFrame, token: str) -> str | None:
    row = resolve(nodes, token).orderBy("place").first()
    return row.id if row else None
