"""Resolving imports: candidate paths in order, aliases, packages and longest prefixes, as equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Extensions and index files tried in this order (fixed values).
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
INDEXES = tuple(f"/index{e}" for e in EXTENSIONS)
#: A compiled name may stand for its source (fixed values).
SOURCES = {".js": (".ts", ".tsx"), ".jsx": (".tsx",), ".mjs": (".mts",), ".cjs": (".cts",)}


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def normal_path(path: Column) -> Column:
    """The path without . and .. parts; .. above the root stays."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    fold = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when((x == "..") & (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("")), acc), -1) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))))
    return F.array_join(fold, "/")


def candidates(base: Column) -> Column:
    """All paths that a base may stand for, best first.

    A base with an extension stands for the sources of a compiled name, then for itself; another one for itself, with each
    extension, and as a folder with an index. Dots and slashes in front are no part of a path.
    """
    ending = F.regexp_extract(base, r"[^/.][^/]*?(\.[^./]*)$", 1)
    stem = F.left(base, F.length(base) - F.length(ending))
    tried = F.when(ending == "", F.array(base, *[F.concat(base, F.lit(e)) for e in (*EXTENSIONS, *INDEXES)]))
    for compiled, sources in SOURCES.items():
        tried = tried.when(ending == compiled, F.array(*[F.concat(stem, F.lit(e)) for e in sources], base))
    return F.transform(tried.otherwise(F.array(base)), lambda p: F.ltrim(p, F.lit("./")))


def first_existing(asked: DataFrame, tried: Column, files: DataFrame) -> DataFrame:
    """asked with target: the first of its candidate paths that is a file, else null."""
    keys = asked.columns
    rows = asked.select(*keys, F.posexplode(tried).alias("place", "path")).join(files.select("path").distinct(), "path")
    found = rows.groupBy(*keys).agg(F.min_by("path", "place").alias("target"))
    return asked.join(found, keys, "left") if not any(asked.schema[k].nullable for k in keys) else asked.join(found.withColumnsRenamed({k: f"{k}_" for k in keys}), [asked[k].eqNullSafe(F.col(f"{k}_")) for k in keys], "left").select(*keys, "target")


def resolve_relative(asked: DataFrame, files: DataFrame) -> DataFrame:
    """(importer, specifier) of relative imports to target."""
    base = normal_path(F.concat_ws("/", parent(F.col("importer")), "specifier"))
    return first_existing(asked.select("importer", "specifier").distinct(), candidates(base), files)


def resolve_alias(asked: DataFrame, aliases: DataFrame, files: DataFrame) -> DataFrame:
    """Imports by alias. aliases: (scope, pattern, replacement, place); the longest scope above the importer comes first.

    A pattern with a star is matched by its part before it: the specifier's prefixes are exploded and joined, so there is
    no theta join.
    """
    star = F.col("pattern").contains("*")
    table = aliases.select("scope", F.substring_index("pattern", "*", 1).alias("prefix"), F.when(star, F.substring_index("pattern", "*", -1)).alias("tail"), "replacement", "place")
    heads = F.transform(F.sequence(F.lit(0), F.length("specifier")), lambda i: F.substring("specifier", F.lit(1), i))
    rows = asked.select("importer", "specifier", F.explode(heads).alias("prefix")).join(table, "prefix")
    inside = (F.col("scope") == "") | F.col("importer").startswith(F.concat("scope", F.lit("/")))
    whole = F.when(F.col("tail").isNull(), F.col("specifier") == F.col("prefix")).otherwise(F.col("specifier").endswith(F.col("tail")))
    middle = F.expr("substring(specifier, length(prefix) + 1, length(specifier) - length(prefix) - length(coalesce(tail, '')))")
    base = normal_path(F.concat_ws("/", "scope", F.replace(F.col("replacement"), F.lit("*"), middle)))
    rows = rows.where(inside & whole).select("importer", "specifier", F.length("scope").alias("depth"), F.length("prefix").alias("n"), "place", candidates(base).alias("tried"))
    rows = rows.select("importer", "specifier", "depth", "n", "place", F.posexplode("tried").alias("at", "path")).join(files.select("path").distinct(), "path")
    return rows.groupBy("importer", "specifier").agg(F.min_by("path", F.struct(-F.col("depth"), -F.col("n"), "place", "at")).alias("target"))


def longest_prefix(names: DataFrame, prefixes: DataFrame) -> DataFrame:
    """name and its longest registered prefix, or null: names are exploded to prefixes of registered lengths only."""
    lengths = prefixes.select(F.length("prefix").alias("n")).distinct()
    lengths = lengths.agg(F.sort_array(F.collect_set("n")).alias("ns"))  # as many as there are lengths
    heads = F.transform(F.filter("ns", lambda n: n <= F.length("name")), lambda n: F.substring("name", F.lit(1), n))
    rows = names.distinct().join(F.broadcast(lengths)).select("name", F.explode(heads).alias("prefix")).join(prefixes.distinct(), "prefix")
    found = rows.groupBy("name").agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))
    return names.distinct().join(found, "name", "left").select("name", "prefix")


def resolve_python(asked: DataFrame, files: DataFrame, roots: tuple[str, ...] = ("", "src")) -> DataFrame:
    """(importer, module) to target; leading dots go up from the importer's package."""
    dots = F.length(F.regexp_extract("module", r"^(\.*)", 1))
    rest = F.replace(F.regexp_replace("module", r"^\.+", ""), F.lit("."), F.lit("/"))
    up = F.concat_ws("/", parent(F.col("importer")), F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))), rest)
    bases = F.when(dots > 0, F.array(normal_path(up))).otherwise(F.array(*[normal_path(F.concat_ws("/", F.lit(r), rest)) for r in roots]))
    tried = F.flatten(F.transform(bases, lambda b: F.array(F.concat(b, F.lit(".py")), F.concat(b, F.lit("/__init__.py")))))
    return first_existing(asked.select("importer", "module").distinct(), tried, files)


def resolve_packages(asked: DataFrame, packages: DataFrame) -> DataFrame:
    """Bare specifiers to workspace packages (name, root): the longest name at a / boundary, and the rest as a subpath."""
    parts = F.split("specifier", "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    rows = asked.select("specifier", F.explode(heads).alias("name")).join(packages, "name")
    best = rows.groupBy("specifier").agg(F.max_by(F.struct("name", "root"), F.length("name")).alias("b"))
    return best.select("specifier", "b.name", "b.root", F.expr("substring(specifier, length(b.name) + 2)").alias("subpath"))
