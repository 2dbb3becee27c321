"""Text sources: files, logs, rounds, git listings, and references in lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.columns import lookup, suffix
from lodestone.schema import BUNDLE, EDGE, INCIDENT, NODE, USAGE
from lodestone.sources.shared import at

#: Labels of files by extension (fixed values).
LANGUAGES = {"ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "jsx", "mjs": "javascript", "cjs": "javascript", "py": "python", "go": "go", "rs": "rust", "json": "json", "md": "markdown", "mdx": "markdown", "yml": "yaml", "yaml": "yaml", "css": "css", "scss": "scss", "html": "html", "sql": "sql"}
#: Folders and endings that a scan passes over (fixed values).
SKIP_DIRS = ("node_modules", ".git", ".next", ".wrangler", ".open-next", "dist", "build", "out", "coverage", ".cache", ".claude", ".pytest_cache", ".mypy_cache", ".ruff_cache", "__pycache__", "tools", "vendor", ".venv", "venv", "target")
SKIP_SUFFIXES = (".lock", ".log", ".min.js", ".min.css", ".map", ".svg", ".png", ".jpg", ".jpeg", ".gif", ".ico", ".woff", ".woff2", ".ttf", ".eot", ".mp4", ".webm", ".ogg", ".mp3", ".wav", ".pdf", ".zip", ".tar", ".gz")
MOST_BYTES, SNIFF, ENTRY_BYTES = 1_000_000, 8192, 8192


def eligible(path, dotfiles: bool = False, outputs: tuple[str, ...] = ()):
    """Whether a scan takes a relative path. dotfiles: also where a part begins with a dot. outputs: folders of the tool's own."""
    parts = F.split(path, "/")
    ok = ~F.arrays_overlap(parts, F.array(*[F.lit(d) for d in SKIP_DIRS]))
    if not dotfiles:
        ok = ok & ~F.exists(parts, lambda p: p.startswith("."))
    for folder in outputs:
        ok = ok & (path != folder.strip("/")) & ~path.startswith(folder.strip("/") + "/")
    for s in SKIP_SUFFIXES:
        ok = ok & ~F.lower(path).endswith(s)
    return ok


def scan_files(spark: SparkSession, root: str, most: int = MOST_BYTES) -> DataFrame:
    """rel_path, language, size, content_hash, content of the text files below root. Too large files are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace(F.col("path"), r"^[a-z]+:/*", "/")
    rel = F.substring_index(rel, root.rstrip("/") + "/", -1)
    files = files.where(F.col("length") <= most).withColumn("rel_path", rel).where(eligible(F.col("rel_path")))
    files = files.where(~F.expr(f"contains(substring(content, 1, {SNIFF}), X'00')"))
    return files.select("rel_path", lookup(suffix(F.col("rel_path")), LANGUAGES).alias("language"), F.col("length").alias("size"), F.sha2("content", 256).alias("content_hash"), F.decode("content", "UTF-8").alias("text"))


def read_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of a graph written as one JSON document, or by export.write_bundle."""
    fs, where = at(spark, f"{path.rstrip('/')}/nodes.json")
    if fs.exists(where):
        return spark.read.schema(NODE).json(f"{path}/nodes.json"), spark.read.schema(EDGE).json(f"{path}/edges.json")
    doc = spark.read.schema(BUNDLE).option("multiLine", True).json(path)
    return doc.select(F.inline("nodes")), doc.select(F.inline("edges"))


def usage_entries(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Entries of usage logs, older generations first; lines that are no entries are left out."""
    out = None
    for i, p in enumerate(paths):
        rows = spark.read.text(p).select(F.from_json("value", USAGE, {"mode": "PERMISSIVE"}).alias("e")).where("e.cmd is not null").select(F.lit(i).alias("generation"), "e.*")
        out = rows if out is None else out.union(rows)
    return out


def incident_entries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Valid entries, and the number of lines passed over: too long, no JSON, or without a known kind."""
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.from_json("value", INCIDENT).alias("e"))
    ok = (F.octet_length("value") <= ENTRY_BYTES) & F.col("e.fingerprint").isNotNull() & F.col("e.kind").isin("occurrence", "ack", "resolve")
    ok = F.coalesce(ok, F.lit(False))
    return lines.where(ok).select("e.*"), lines.agg(F.count_if(~ok).alias("skipped"))


def status_events(spark: SparkSession, path: str) -> DataFrame:
    """Events with malformed, true where the line is none."""
    rows = spark.read.text(path).select("value", F.from_json("value", "round int, actor string, status string, ts string").alias("e"))
    return rows.select("e.*", (F.col("e.status").isNull()).alias("malformed"))


def rounds(spark: SparkSession, path: str) -> DataFrame:
    """Round files: number, author, to and body, from the front matter between the first two --- lines."""
    rows = spark.read.text(path, wholetext=True)
    part = lambda i: F.regexp_extract("value", r"(?s)^---\r?\n(.*?)\r?\n---\r?\n?(.*)$", i)
    field = lambda name: F.regexp_extract(part(1), rf"(?m)^{name}:\s*(.*?)\s*$", 1)
    number = F.regexp_extract(field("round"), r"^(\d+)$", 1)
    return rows.select(F.nullif(number, F.lit("")).cast("int").alias("round"), field("author").alias("author"), field("to").alias("addressee"), part(2).alias("body")).orderBy(F.col("round").asc_nulls_last())


def porcelain(raw: bytes, most: int = 100_000) -> list[tuple[str, str, str | None]]:
    """(status, path, old path) of NUL-separated git status output. Conflicts and broken records raise ValueError."""
    fields, out = raw.split(b"\0"), []
    if fields and fields[-1] == b"":
        fields.pop()
    it = iter(fields)
    for f in it:
        text = f.decode("utf-8")
        if len(text) < 4 or text[2] != " ":
            raise ValueError("malformed record")
        code, path = text[:2], text[3:]
        if "U" in code or code in ("AA", "DD"):
            raise ValueError(f"conflict in {path}")
        old = None
        if "R" in code or "C" in code:
            old = next(it, b"").decode("utf-8")
            if not old:
                raise ValueError("rename without its old path")
        kind = "untracked" if code == "??" else "deleted" if "D" in code else "renamed" if "R" in code else "added" if "A" in code or "C" in code else "modified"
        out.append((kind, path, old))
        if len(out) > most:
            raise ValueError("too many records")
    return out


def numstat(lines: DataFrame) -> DataFrame:
    """added, removed (null for binary files) and path of git numstat lines."""
    f = F.split("value", "\t", 3)
    return lines.where(F.size(f) == 3).select(f[0].try_cast("long").alias("added"), f[1].try_cast("long").alias("removed"), f[2].alias("path"))


def references(files: DataFrame, needle: str) -> DataFrame:
    """(file, line, text) of the lines that contain needle in any case."""
    rows = files.select("file", F.posexplode(F.split("text", "\n")).alias("i", "text")).where(F.lower("text").contains(needle.lower()))
    return rows.select("file", (F.col("i") + 1).alias("line"), "text")


def case_collisions(paths: DataFrame) -> DataFrame:
    """Paths that differ in case only."""
    return paths.groupBy(F.lower("path").alias("folded")).agg(F.countDistinct("path").alias("n"), F.min("path").alias("path")).where("n > 1")
