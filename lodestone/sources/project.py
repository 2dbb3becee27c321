"""A project on the driver's disk: its files by git, its roots, an engine's fingerprint, paths that an answer names, checks of JSON values."""

from __future__ import annotations

import hashlib
import json
import os
import re
import subprocess
from dataclasses import dataclass
from pathlib import Path

#: Files and folders by which a folder is a project (fixed values).
PROJECT_MARKS = (".git", "package.json", "pyproject.toml", "wrangler.toml", "Cargo.toml", "go.mod", "deno.json", "vite.config.ts", "next.config.js", "next.config.mjs")
MOST_RECORDS = 100_000
#: Keys of an answer whose values are paths, or lists of paths (fixed values).
PATH_KEYS, PATH_LIST_KEYS = ("source_file", "file", "path"), ("impacted_files", "likely_tests", "files")


def listed_paths(raw: bytes, most: int = MOST_RECORDS) -> list[str]:
    """Relative paths of a NUL-separated listing. One that is cut off, too long, no UTF-8 or leaves the root raises ValueError."""
    if not raw:
        return []
    text = raw.decode("utf-8")
    if not text.endswith("\0"):
        raise ValueError("listing is cut off")
    paths = text[:-1].split("\0")
    if len(paths) > most:
        raise ValueError("too many records")
    for p in paths:
        if not p or p.startswith("/") or re.match(r"[A-Za-z]:", p) or ".." in p.replace("\\", "/").split("/"):
            raise ValueError(f"unsafe path: {p!r}")
    return paths


def git_files(root: str) -> list[str] | None:
    """Tracked files and untracked ones that aren't ignored; None where root is no repository. A root inside another repository raises."""
    at = Path(root).resolve()
    if not os.path.lexists(at / ".git"):
        if any(os.path.lexists(p / ".git") for p in at.parents):
            raise ValueError("nested in another repository")
        return None
    done = subprocess.run(["git", "-C", str(at), "ls-files", "-z", "--cached", "--others", "--exclude-standard"], capture_output=True, timeout=30, check=False)
    if done.returncode:
        raise ValueError("git could not list the files")
    return listed_paths(done.stdout)


def discover(base: str, depth: int = 6, most: int = 128, marks: tuple[str, ...] = PROJECT_MARKS, skip: frozenset[str] | None = None, ignore: str | None = None) -> list[str]:
    """Project roots at most `depth` folders below base, at most `most`, by name. A project isn't searched for others.

    Hidden folders, those in `skip` and those that hold a file named `ignore` are passed over.
    """
    from lodestone.sources.texts import SKIP_DIRS

    skip, out, level = frozenset(SKIP_DIRS) if skip is None else skip, [], [Path(base).resolve(strict=True)]
    for _ in range(depth + 1):
        below = []
        for folder in sorted(level):
            if ignore and (folder / ignore).exists():
                continue
            if any((folder / m).exists() for m in marks):
                out.append(folder)
            else:
                below += [d for d in folder.iterdir() if d.is_dir() and not d.is_symlink() and d.name not in skip and not d.name.startswith(".")]
        level = below
    return sorted((str(p) for p in out[:most]), key=str.lower)


@dataclass(frozen=True)
class Named:
    path: str


def _named(key: str, value):
    """A path where the key holds one, a list of them where it holds a list, and any other value as it is."""
    if key in PATH_KEYS and isinstance(value, str):
        return Named(value) if value else None
    if key in PATH_LIST_KEYS and isinstance(value, list):
        return [Named(v) for v in value if isinstance(v, str) and v]
    return value


def answer_paths(result, most: int = 100) -> list[str]:
    """Paths that a nested answer names, each once in the order of first mention, at most `most`."""
    seen: dict[str, None] = {}
    todo = [result]
    while todo and len(seen) < most:
        value = todo.pop()
        if isinstance(value, Named):
            seen[value.path] = None
        elif isinstance(value, list):
            todo += reversed(value)
        elif isinstance(value, dict):
            todo += reversed([_named(k, v) for k, v in value.items()])
    return list(seen)


def fingerprint(root: str, header: dict[str, str], ending: str = ".py", most_files: int = 10_000, most_bytes: int = 64 << 20) -> str:
    """SHA-256 of a header and of every file below root with the ending: names and contents with their lengths, by name."""
    at, total, digest = Path(root).resolve(strict=True), 0, hashlib.sha256(json.dumps(header, sort_keys=True, separators=(",", ":")).encode())
    files = sorted((p.relative_to(at).as_posix(), p) for p in at.rglob(f"*{ending}") if p.is_file() and not p.is_symlink())
    if len(files) > most_files:
        raise ValueError("too many files")
    for name, path in files:
        data = path.read_bytes()
        total += len(data)
        if total > most_bytes:
            raise ValueError("too many bytes")
        digest.update(len(name.encode()).to_bytes(4, "big") + name.encode() + len(data).to_bytes(8, "big") + data)
    return digest.hexdigest()


KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "null": type(None), "object": dict, "array": list}


def _is_kind(value, kind) -> bool:
    if isinstance(kind, list):
        return any(_is_kind(value, k) for k in kind)
    if isinstance(value, bool):
        return kind == "boolean"
    return kind in KINDS and isinstance(value, KINDS[kind])


def _same(a, b) -> bool:
    """Equal as JSON: true is not 1, and 1 is not 1.0."""
    return json.dumps(a, sort_keys=True) == json.dumps(b, sort_keys=True)


def _within(n: int, schema: dict, least: str, most: str) -> bool:
    bound = lambda k, default: schema[k] if isinstance(schema.get(k), int) and not isinstance(schema[k], bool) and schema[k] >= 0 else default
    return bound(least, 0) <= n <= bound(most, n)


def conforms(value, schema) -> bool:
    """Whether a JSON value meets a schema's type, const, enum, pattern (of the whole), lengths, properties, required and items.

    An object takes no other properties unless the schema allows them. Keywords beyond these are passed over.
    """
    if not isinstance(schema, dict):
        return False
    if schema.get("type") is not None and not _is_kind(value, schema["type"]):
        return False
    if "const" in schema and not _same(value, schema["const"]) or "enum" in schema and not any(_same(value, e) for e in schema["enum"]):
        return False
    if isinstance(value, str):
        pattern = schema.get("pattern")
        return _within(len(value), schema, "minLength", "maxLength") and not (isinstance(pattern, str) and not re.fullmatch(pattern, value))
    if isinstance(value, dict) and (schema.get("type") == "object" or schema.keys() & {"properties", "required", "additionalProperties"}):
        parts = schema.get("properties", {})
        if not isinstance(parts, dict) or set(schema.get("required", ())) - set(value):
            return False
        closed = schema.get("additionalProperties", False) is False
        return not (closed and set(value) - set(parts)) and all(conforms(value[k], s) for k, s in parts.items() if k in value)
    if isinstance(value, list) and (schema.get("type") == "array" or schema.keys() & {"items", "minItems", "maxItems"}):
        items = schema.get("items")
        return _within(len(value), schema, "minItems", "maxItems") and (not isinstance(items, dict) or all(conforms(v, items) for v in value))
    return True


def replacement_audit(checks: dict[str, bool], remnants: dict[str, list]) -> dict:
    """Whether a new tool can take over: checks by code (false blocks), and what the old tool left, by code (warns).

    Ready when nothing blocks and no path of the old tool is left (code "paths_exist").
    """
    blockers = [code for code, ok in checks.items() if not ok]
    warnings = {code: found for code, found in remnants.items() if found}
    return {"ok": not blockers, "ready": not blockers and not remnants.get("paths_exist"), "blockers": blockers, "warnings": warnings}
