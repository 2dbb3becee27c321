"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.schema import PROJECT_KINDS

#: Languages that health is measured for, by file suffix (fixed values).
EDGE_LANGUAGES = {"py": "python", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "go": "go", "rs": "rust"}
#: File names of tests end so, or lie below a tests directory (fixed values).
TEST_SUFFIXES = (".test.ts", ".spec.ts", ".test.tsx", ".spec.tsx", ".test.js", ".spec.js", ".test.py", ".spec.py")
WILSON_Z = 1.959963984540054


def lookup(c: Column, table: dict[str, str], default: str | None = None) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, c), F.lit(default))


def suffix(path: Column) -> Column:
    """The extension without its dot, lower case; empty where there is none."""
    return F.lower(F.regexp_extract(path, r"[^/.]\.([^./\\]+)$", 1))


def edge_language(path: Column) -> Column:
    return lookup(suffix(F.coalesce(path, F.lit(""))), EDGE_LANGUAGES, "other")


def interop_family(path: Column) -> Column:
    """JavaScript and TypeScript call each other; other languages only themselves."""
    language = edge_language(path)
    return F.when(language.isin("typescript", "javascript"), "js").otherwise(language)


def is_project(kind: Column) -> Column:
    return kind.isin(*PROJECT_KINDS)


def is_test_file(path: Column) -> Column:
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    out = F.concat(F.lit("/"), p).contains("/tests/")
    for s in TEST_SUFFIXES:
        out = out | p.endswith(s)
    return F.coalesce(out, F.lit(False))


def has_relation(*names: str) -> Column:
    """Of an edge with relation and relations."""
    return F.arrays_overlap(F.coalesce(F.col("relations"), F.array("relation")), F.array(*[F.lit(n) for n in names]))


def unsafe_path(path: Column) -> Column:
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return p.startswith("/") | p.rlike("^[A-Za-z]:") | F.array_contains(F.split(p, "/"), "..")


def safe_relative_path(path: Column) -> Column:
    """The path with forward slashes and no ./ before it, or null where it is not safe."""
    p = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./)+", "")
    bad = unsafe_path(p) | (p == "") | p.rlike(r"[\p{Cc}\p{Cf}\p{Cs}\p{Zl}\p{Zp}]")
    return F.when(~bad, p)


#: Files whose change alone makes a review risky (fixed values).
SENSITIVE = (
    "pyproject.toml", "package.json", "package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "bun.lock", "bun.lockb", "requirements.txt",
    "uv.lock", "pipfile.lock", "poetry.lock", "cargo.toml", "cargo.lock", "go.mod", "go.sum", "dockerfile",
)


def sensitive_config(path: Column) -> Column:
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return F.element_at(F.split(p, "/"), -1).isin(*SENSITIVE) | p.startswith(".github/workflows/")


def wilson_lower(successes: Column, total: Column) -> Column:
    """The lower end of Wilson's 95 % interval; 0 without trials."""
    n, p, z2 = total.cast("double"), successes / total, WILSON_Z**2
    low = (p + z2 / (2 * n) - WILSON_Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)
    return F.when(total > 0, F.greatest(F.lit(0.0), low)).otherwise(0.0)


def log2_bucket(v: Column) -> Column:
    """0 for null and non-positive numbers, else one more than the power of two below, 20 at most."""
    return F.when(v > 0, F.least(F.lit(20), F.floor(F.log2(v)).cast("int") + 1)).otherwise(0)


def thousandths(v: Column) -> Column:
    """Rounded half up to three places, the same in any SQL engine."""
    return F.floor(v * 1000 + 0.5) / 1000
