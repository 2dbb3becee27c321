"""A project's imports to its files: TypeScript's cascade over manifests, and Rust's modules and crates.

Every step is an equi-join: an import is laid out to the paths, scopes or names that it may mean, these meet the table of
files, aliases or packages, and the best place wins in one partial aggregation. Imports are made distinct first. Joins are
inner with a unique right side, so a path or scope that most imports name is split by the adaptive skew join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.imports import candidates, normal_path, parent

#: Entries of a package, the preferred first, before these fallbacks (fixed values).
ENTRY_PATHS = ("$.exports", "$.exports['.']", "$.exports['.'].import", "$.exports['.'].default", "$.exports['.'].require", "$.exports['.'].module", "$.exports['.'].main", "$.module", "$.main", "$.types")
FALLBACKS = ("src/index", "index")
#: Roots of Rust paths that always lead outside, files that are their module's root, and tables of dependencies (fixed values).
OUTSIDE = ("std", "core", "alloc", "proc_macro")
MODULE_ROOTS = ("lib.rs", "main.rs", "mod.rs")
DEPENDENCY_TABLES = ("dependencies", "dev-dependencies", "build-dependencies")
CARGO = "dir string, ident string, declared array<string>, shared array<string>"


def ancestors(path: Column) -> Column:
    """All folders above a path, the root as an empty string."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def _below(folder: Column, rest: Column) -> Column:
    return normal_path(F.concat_ws("/", folder, rest))


def _is_file_named(name: str) -> Column:
    return F.element_at(F.split("rel_path", "/"), -1) == name


def _strings(path: str) -> Column:
    """The value at a path of the variant column v, where it is a string."""
    escaped = path.replace("'", "\\'")
    return F.expr(f"CASE WHEN schema_of_variant(try_variant_get(v, '{escaped}', 'variant')) = 'STRING' THEN try_variant_get(v, '{escaped}', 'string') END")


def _documents(files: DataFrame, name: str) -> DataFrame:
    """dir and v of the JSON manifests of a name; what is no JSON is left out."""
    rows = files.where(_is_file_named(name)).select(parent(F.col("rel_path")).alias("dir"), F.try_parse_json("text").alias("v"))
    return rows.where("v is not null")


def packages(files: DataFrame) -> DataFrame:
    """(name, root, entry) of the package.json among files (rel_path, text) that name a package and lead to a file.

    The entry is the first file among the exports, the module, the main and the types, and the indexes. Of two packages of
    one name that of the lesser path counts.
    """
    rows = _documents(files, "package.json").select("dir", F.trim(_strings("$.name")).alias("name"), F.array(*[F.concat(F.lit(""), F.ltrim(_strings(p), F.lit("./"))) for p in ENTRY_PATHS], *[F.lit(f) for f in FALLBACKS]).alias("said")).where("name <> ''")
    rows = rows.select("name", "dir", F.posexplode(F.filter("said", lambda s: s.isNotNull())).alias("place", "said"))
    rows = rows.select("name", "dir", "place", F.posexplode(candidates(_below(F.col("dir"), F.col("said")))).alias("at", "path"))
    found = rows.join(files.select(F.col("rel_path").alias("path")).distinct(), "path").groupBy("name", "dir").agg(F.min_by("path", F.struct("place", "at")).alias("entry"))
    return found.groupBy("name").agg(F.min_by(F.struct("dir", "entry"), F.concat("dir", F.lit("/package.json"))).alias("p")).select("name", F.col("p.dir").alias("root"), "p.entry")


def aliases(files: DataFrame) -> DataFrame:
    """(scope, pattern, place, replacement) of the tsconfig.json among files; replacements are paths from the root."""
    rows = _documents(files, "tsconfig.json").select(F.col("dir").alias("scope"), F.coalesce(_strings("$.compilerOptions.baseUrl"), F.lit(".")).alias("base"), F.expr("try_variant_get(v, '$.compilerOptions.paths', 'map<string,variant>')").alias("paths"))
    rows = rows.select("scope", "base", F.explode("paths").alias("pattern", "to")).select("scope", "base", "pattern", F.posexplode(F.expr("try_variant_get(to, '$', 'array<variant>')")).alias("place", "v"))
    rows = rows.select("scope", "base", "pattern", "place", _strings("$").alias("target")).where("target is not null")
    return rows.select("scope", "pattern", "place", normal_path(F.concat_ws("/", "scope", "base", "target")).alias("replacement"))


def typescript(asked: DataFrame, files: DataFrame, compiled: DataFrame | None = None) -> DataFrame:
    """(importer, specifier, target, confidence) of the distinct imports asked for; both null where nothing resolves.

    The first that leads to one of files (rel_path, text) counts: what a compiler said (compiled: importer, specifier,
    target, confidence), a relative path or an alias (EXACT_IMPORT), a workspace package (WORKSPACE_IMPORT). Aliases of the
    nearest tsconfig come first, then by pattern; packages by the longest name.
    """
    keys = ["importer", "specifier"]
    asked = asked.select(*keys).where("importer is not null and specifier is not null").distinct()
    path, spec = F.col("importer"), F.col("specifier")
    near = asked.where(spec.startswith(".")).select(*keys, F.struct(F.lit(1).alias("step"), F.lit(0).alias("far"), F.lit("").alias("scope"), F.lit("").alias("name"), F.lit(0).alias("place")).alias("rank"), candidates(_below(parent(path), spec)).alias("tried"))

    star = F.col("pattern").contains("*")
    table = aliases(files).select("scope", "pattern", "place", "replacement", F.substring_index("pattern", "*", 1).alias("head"), F.when(star, F.expr("substring(pattern, instr(pattern, '*') + 1)")).alias("tail"))
    rows = asked.where(~spec.startswith(".")).select(*keys, F.explode(ancestors(path)).alias("scope")).join(table, "scope")
    fits = F.when(F.col("tail").isNull(), spec == F.col("head")).otherwise(spec.startswith(F.col("head")) & spec.endswith(F.col("tail")))
    middle = F.expr("substring(specifier, length(head) + 1, length(specifier) - length(head) - length(coalesce(tail, '')))")
    rank = F.struct(F.lit(1).alias("step"), (-F.length("scope")).alias("far"), "scope", F.col("pattern").alias("name"), "place")
    named = rows.where(fits).select(*keys, rank.alias("rank"), candidates(normal_path(F.replace(F.col("replacement"), F.lit("*"), middle))).alias("tried"))

    parts = F.split(spec, "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    rows = asked.select(*keys, F.explode(heads).alias("name")).join(packages(files), "name")
    rest = F.expr("substring(specifier, length(name) + 2)")
    inside = F.concat(candidates(_below(F.col("root"), rest)), candidates(_below(F.concat_ws("/", F.nullif(F.col("root"), F.lit("")), F.lit("src")), rest)))
    rank = F.struct(F.lit(2).alias("step"), (-F.length("name")).alias("far"), F.lit("").alias("scope"), "name", F.lit(0).alias("place"))
    packaged = rows.select(*keys, rank.alias("rank"), F.when(spec == F.col("name"), F.array("entry")).otherwise(inside).alias("tried"))

    tried = near.union(named).union(packaged).select(*keys, "rank", F.posexplode("tried").alias("at", "rel_path"))
    hits = tried.join(files.select("rel_path").distinct(), "rel_path")
    best = hits.groupBy(*keys).agg(F.min_by(F.struct(F.col("rel_path").alias("target"), F.when(F.col("rank.step") == 1, "EXACT_IMPORT").otherwise("WORKSPACE_IMPORT").alias("confidence")), F.struct("rank", "at")).alias("own"))
    out = asked.join(best, keys, "left")
    if compiled is not None:
        told = compiled.groupBy(*keys).agg(F.min(F.struct("target", "confidence")).alias("told"))
        out = out.join(told, keys, "left").select(*keys, F.coalesce("told", "own").alias("own"))
    return out.select(*keys, "own.target", "own.confidence")


def cargo(files: DataFrame) -> DataFrame:
    """dir, ident (null for a manifest without package), declared and shared dependencies of each Cargo.toml that parses.

    TOML has no reader in SQL; only the manifests go through Python, a batch at a time.
    """

    def ident(name: str) -> str:
        return name.strip().replace("-", "_")

    def names(scope) -> list[str]:
        found = scope if isinstance(scope, dict) else {}
        return sorted({ident(k) for t in DEPENDENCY_TABLES if isinstance(found.get(t), dict) for k in found[t]})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tomllib

        for batch in batches:
            out = []
            for folder, text in zip(batch["dir"], batch["text"], strict=True):
                try:
                    doc = tomllib.loads(text)
                except (ValueError, TypeError, RecursionError):
                    continue  # a bad manifest declares nothing
                package = doc.get("package")
                name = package.get("name") if isinstance(package, dict) else None
                out.append((folder, ident(name) if isinstance(name, str) and name.strip() else None, names(doc), names(doc.get("workspace"))))
            yield pd.DataFrame(out, columns=["dir", "ident", "declared", "shared"])

    manifests = files.where(_is_file_named("Cargo.toml")).select(parent(F.col("rel_path")).alias("dir"), "text")
    return manifests.mapInPandas(read, CARGO)


def module_dir(path: Column) -> Column:
    """Where Rust looks for the children of a file's module."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(name.isin(*MODULE_ROOTS), parent(path)).otherwise(_below(parent(path), F.regexp_replace(name, r"(.)\.[^.]*$", "$1")))


def _module_files(base: Column) -> Column:
    return F.array(F.concat(base, F.lit(".rs")), F.concat(base, F.lit("/mod.rs")))


def rust_mod(asked: DataFrame, files: DataFrame) -> DataFrame:
    """(importer, name, target) of `mod name;`: one of the two layouts of a module's file, else null."""
    keys = ["importer", "name"]
    asked = asked.select(*keys).where("importer is not null and name <> ''").distinct()
    rows = asked.select(*keys, F.posexplode(_module_files(_below(module_dir(F.col("importer")), F.col("name")))).alias("at", "rel_path"))
    best = rows.join(files.select("rel_path").distinct(), "rel_path").groupBy(*keys).agg(F.min_by("rel_path", "at").alias("target"))
    return asked.join(best, keys, "left")


def rust_use(asked: DataFrame, files: DataFrame) -> DataFrame:
    """(importer, use_path, inline_depth, target, external) of `use` paths.

    The path's head gives the folder to start at: the crate of the importer (by the nearest manifest, else the nearest src
    folder), its own module, the one above (within an inline module: the file itself), or a crate of the project. Below it
    the longest run of modules that is a file counts; an upper-case letter ends the modules. external: the head is one of
    Rust's own crates, or a dependency that the importer's crate or its workspace declares; any manifest's, where the
    importer belongs to no manifest.
    """
    keys = ["importer", "use_path", "inline_depth"]
    asked = asked.select(*keys).where("importer is not null and use_path is not null").distinct()
    manifests = cargo(files)
    crates = manifests.where("ident is not null").select("dir", "ident")
    shared = manifests.agg(F.array_distinct(F.flatten(F.collect_set("shared"))).alias("shared"), F.array_distinct(F.flatten(F.collect_set(F.concat("declared", "shared")))).alias("any"))

    segments = F.filter(F.split(F.replace(F.col("use_path"), F.lit(" ")), "::"), lambda s: s != "")
    rows = asked.select(*keys, segments.alias("s")).select(*keys, F.get("s", F.lit(0)).alias("head"), F.slice("s", 2, F.greatest(F.size("s"), F.lit(1))).alias("rest"), F.regexp_extract("importer", r"^((?:.*/)?src)(?:/.*)?$", 1).alias("src"))
    importers = rows.select("importer", F.regexp_replace("src", "/?src$", "").alias("fallback"), (F.col("src") != "").alias("in_src")).distinct()
    mine = importers.select("importer", F.explode(ancestors(F.col("importer"))).alias("dir")).join(crates.select("dir"), "dir").groupBy("importer").agg(F.max_by("dir", F.length("dir")).alias("dir"))
    home = importers.join(mine, "importer", "left").select("importer", F.coalesce("dir", F.when(F.col("in_src"), F.col("fallback"))).alias("home"))
    home = home.join(manifests.select(F.col("dir").alias("home"), "declared"), "home", "left")
    rows = rows.join(home, "importer").join(crates.groupBy(F.col("ident").alias("head")).agg(F.min_by("dir", F.concat("dir", F.lit("/Cargo.toml"))).alias("there")), "head", "left").crossJoin(F.broadcast(shared))  # one row of names of crates

    own, src = module_dir(F.col("importer")), F.lit("src")
    is_self, is_super, is_crate = (F.col("head") == h for h in ("self", "super", "crate"))
    is_outside = F.col("head").isin(*OUTSIDE)
    start = (
        F.when(is_outside | F.col("head").isNull(), None).when(is_crate, _below(F.col("home"), src)).when(is_self, own)
        .when(is_super, parent(own)).when(F.col("there").isNotNull(), _below(F.col("there"), src))
    )
    start = F.when(is_crate & F.col("home").isNull(), None).otherwise(start)
    declared = F.when(F.col("declared").isNotNull(), F.array_contains(F.concat("declared", "shared"), F.col("head"))).otherwise(F.array_contains("any", F.col("head")))
    external = is_outside | (~is_crate & ~is_self & ~is_super & F.col("there").isNull() & declared)
    capital = F.array_position(F.transform("rest", lambda s: F.substring(s, 1, 1).rlike(r"\p{Lu}")), True)
    modules = F.when(capital > 0, F.slice("rest", F.lit(1), (capital - 1).cast("int"))).otherwise(F.col("rest"))
    rows = rows.select(*keys, F.coalesce(external, F.lit(False)).alias("external"), start.alias("start"), modules.alias("m"), (is_super & (F.col("inline_depth") > 0)).alias("inside"))
    under = lambda n: _below(F.col("start"), F.array_join(F.slice("m", F.lit(1), n), "/"))
    roots = F.array(*[_below(F.col("start"), F.lit(n)) for n in ("lib.rs", "mod.rs", "main.rs")])
    walk = F.flatten(F.transform(F.sequence(F.size("m"), F.lit(0), F.lit(-1)), lambda n: F.when(n > 0, _module_files(under(n))).otherwise(roots)))
    tried = rows.where("start is not null and not coalesce(inside, false)").select(*keys, F.posexplode(walk).alias("at", "rel_path"))
    best = tried.join(files.select("rel_path").distinct(), "rel_path").groupBy(*keys).agg(F.min_by("rel_path", "at").alias("target"))
    best = best.withColumnsRenamed({k: f"{k}_" for k in keys})
    rows = rows.join(best, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys], "left")
    return rows.select(*keys, F.when(F.col("inside"), F.col("importer")).otherwise(F.col("target")).alias("target"), "external")
