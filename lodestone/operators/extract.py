"""Source files to raw nodes and edges.

Python is parsed by the standard library; TypeScript, JavaScript, Go and Rust by light lexers that know declarations,
imports and calls, so their edges are partial. A declaration's id is its file and its name, whatever it is nested in.

Files are independent rows. A first pass asks each file which paths its imports could mean; a join with the paths that
exist answers; a second pass emits nodes, edges and errors as tagged rows. No list of the project's files is gathered.
"""

from __future__ import annotations

import ast
import builtins
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.ids import file_id, make_id
from lodestone.operators.build import Graph, build_graph, dispatch_methods
from lodestone.sources.shared import at, cut

SCHEMA = "tag string, id string, kind string, name string, source_file string, source_location string, is_method boolean, source string, target string, relation string, confidence string, called string, weight double"
KEYED = SCHEMA + ", key string"
#: Objects and members whose calls say nothing of the project (fixed values).
BUILTIN_OBJECTS = frozenset("Array Boolean Date Error Intl JSON Math Number Object Promise Reflect RegExp String Symbol URL URLSearchParams console process window document".split())
NOISY_MEMBERS = frozenset(
    "addEventListener append appendChild catch concat delete endsWith entries every filter find findIndex flat flatMap forEach get has includes join keys log map match max min parse push reduce remove removeEventListener replace set slice some sort split startsWith stringify then toISOString toLocaleString toLowerCase toString toUpperCase trim values".split()
)
#: Names built into the languages, whose calls are no edges (fixed values).
DROPPED = frozenset({
    "String", "Number", "Boolean", "Object", "Array", "Symbol", "BigInt", "Date", "RegExp", "Error", "TypeError", "RangeError", "SyntaxError", "ReferenceError", "EvalError", "URIError",
    "Promise", "Map", "Set", "WeakMap", "WeakSet", "JSON", "Math", "Reflect", "Proxy", "Intl", "parseInt", "parseFloat", "isNaN", "isFinite",
    "encodeURIComponent", "decodeURIComponent", "encodeURI", "decodeURI", "URL", "URLSearchParams", "FormData", "Blob", "File", "Headers", "Request", "Response", "AbortController", "AbortSignal",
    "TextEncoder", "TextDecoder", "console",
    "str", "int", "float", "bool", "list", "dict", "set", "tuple", "bytes", "len", "range", "enumerate", "zip", "map", "filter", "sum", "min", "max", "print", "open", "isinstance", "type", "super", "sorted", "reversed",
    "any", "all", "abs", "round", "next", "iter", "hash", "id", "repr", "callable", "getattr", "setattr", "hasattr", "delattr", "vars", "dir",
    "append", "cap", "make", "copy", "delete", "panic", "recover", "close", "new", "println", "clear",
    "Some", "None", "Ok", "Err", "Box", "drop", "Default",
})
#: Names that a project doesn't define: of test frameworks, of runtimes, and Python's (fixed values; exceptions by their rule).
OUTSIDE = frozenset({
    "expect", "it", "describe", "test", "vi", "jest", "beforeEach", "afterEach", "beforeAll", "afterAll", "suite", "xit", "xdescribe", "fit", "fdescribe",
    "setTimeout", "setInterval", "clearTimeout", "clearInterval", "fetch", "queueMicrotask", "structuredClone", "atob", "btoa", "crypto", "performance", "Buffer", "require",
    "frozenset", "bytearray", "complex", "object", "property", "staticmethod", "classmethod", "slice", "divmod", "format",
    *(n for n, v in vars(builtins).items() if isinstance(v, type) and issubclass(v, BaseException)),
}) - DROPPED


class Found:
    """What one file yields, and what its imports bind: names to ids, names to whole files, and names from outside."""

    def __init__(self, path: str):
        self.path, self.file, self.rows = path, file_id(path), []
        self.names: dict[str, str] = {}
        self.modules: dict[str, str] = {}
        self.outside: set[str] = set()
        self.inside: set[str] = set()
        self.node(self.file, "file", path.rsplit("/", 1)[-1], 1)

    def node(self, id_: str, kind: str, name: str, line: int, method: bool = False) -> str:
        self.rows.append({"tag": "node", "id": id_, "kind": kind, "name": name, "source_file": self.path, "source_location": f"L{line}", "is_method": method})
        return id_

    def edge(self, source: str, target: str, relation: str, line: int, confidence: str = "EXTRACTED", called: str | None = None) -> None:
        self.rows.append({"tag": "edge", "source": source, "target": target, "relation": relation, "source_file": self.path, "source_location": f"L{line}", "confidence": confidence, "called": called, "weight": 1.0})

    def declare(self, owner: str, kind: str, name: str, line: int, method: bool = False) -> str:
        me = self.node(make_id(self.file, name), kind, name, line, method)
        self.edge(owner, me, "contains", line)
        return me

    def leaves(self, root: str | None) -> str:
        """The confidence of a call whose first name is root; None where the receiver has no name, which proves nothing."""
        outside = root is not None and root not in self.inside and (root in OUTSIDE or root in self.outside)
        return "EXTERNAL_CALL" if outside else "LOCAL_CALL"

    def plain_call(self, owner: str, name: str, line: int) -> None:
        if name not in DROPPED:
            self.edge(owner, self.names.get(name) or make_id(self.file, name), "calls", line, self.leaves(name))

    def member_call(self, owner: str, called: str, root: str | None, line: int) -> None:
        """called: receiver.member, or the member alone. Dispatch sends on what isn't known here, by the member's name."""
        receiver, _, member = called.rpartition(".")
        if receiver in self.modules:
            self.edge(owner, make_id(self.modules[receiver], member), "calls", line, "LOCAL_CALL")
        elif keeps_call(called):
            self.edge(owner, make_id(self.file, called), "calls", line, self.leaves(root), member)


def keeps_call(called: str) -> bool:
    root, _, member = called.partition(".")
    return root not in BUILTIN_OBJECTS and (not member or called.rsplit(".", 1)[-1] not in NOISY_MEMBERS)


def module_file(module: str, level: int, path: str, known) -> str | None:
    """The file of a Python module among the known ones."""
    parts = path.split("/")[: -max(1, level)] if level else []
    tail = module.split(".") if module else []
    for root in ([*parts],) if level else ([], ["src"]):
        base = "/".join([*root, *tail])
        for candidate in (f"{base}.py", f"{base}/__init__.py" if base else "__init__.py"):
            if candidate in known:
                return candidate
    return None


def _python_imports(found: Found, tree: ast.AST, known) -> None:
    path = found.path
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            for a in n.names:
                file, root = module_file(a.name, 0, path, known), a.name.split(".")[0]
                found.edge(found.file, file_id(file) if file else make_id(a.name), "imports", n.lineno, "EXACT_IMPORT" if file else "EXTERNAL_IMPORT")
                # Importing a.b.c runs the packages a and a.b as well, and binds a.
                steps = a.name.split(".")[:-1]
                above = [module_file(".".join(steps[: i + 1]), 0, path, known) for i in range(len(steps))]
                for package in above if file else ():
                    if package:
                        found.edge(found.file, file_id(package), "imports", n.lineno, "EXACT_IMPORT")
                bound = file if a.asname or not steps else above[0]
                local = a.asname or root
                if bound:
                    found.modules[local] = file_id(bound)
                    found.inside.add(local)
                else:
                    found.outside.add(local)
        elif isinstance(n, ast.ImportFrom):
            module, file = n.module or "", module_file(n.module or "", n.level, path, known)
            found.edge(found.file, file_id(file) if file else make_id(module or "package"), "imports", n.lineno, "EXACT_IMPORT" if file else "EXTERNAL_IMPORT")
            for a in n.names:
                local, sub = a.asname or a.name, module_file(f"{module}.{a.name}" if module else a.name, n.level, path, known)
                if sub:
                    found.modules[local] = file_id(sub)
                    found.edge(found.file, file_id(sub), "imports", n.lineno, "EXACT_IMPORT")
                elif file:
                    found.names[local] = make_id(file_id(file), a.name)
                (found.inside if sub or file else found.outside).add(local)


def python_file(path: str, text: str, known=frozenset()) -> list[dict]:
    found, tree = Found(path), ast.parse(text)
    _python_imports(found, tree, known)

    def visit(n, owner: str, scope: str, in_class: bool) -> None:
        """owner: the nearest declaration, which contains; scope: the nearest function, which calls."""
        for c in ast.iter_child_nodes(n):
            if isinstance(c, ast.ClassDef):
                me = found.declare(owner, "class", c.name, c.lineno)
                for b in c.bases:
                    if isinstance(b, ast.Name):
                        found.edge(me, make_id(b.id), "inherits", b.lineno)
                visit(c, me, scope, True)
            elif isinstance(c, ast.FunctionDef | ast.AsyncFunctionDef):
                me = found.declare(owner, "function", c.name, c.lineno, in_class)
                visit(c, me, me, False)
            else:
                if isinstance(c, ast.Call) and isinstance(c.func, ast.Name):
                    found.plain_call(scope, c.func.id, c.lineno)
                elif isinstance(c, ast.Call) and isinstance(c.func, ast.Attribute):
                    receiver = root = c.func.value
                    while isinstance(root, ast.Attribute):
                        root = root.value
                    simple = f"{receiver.id}." if isinstance(receiver, ast.Name) else ""
                    found.member_call(scope, simple + c.func.attr, root.id if isinstance(root, ast.Name) else None, c.lineno)
                # Statements under an if or try of a class body are its own, as are a method's decorators.
                visit(c, owner, scope, in_class)

    visit(tree, found.file, found.file, False)
    return found.rows


def blank(text: str, line_comment: str = "//") -> str:
    """Comments and strings as spaces, lines kept."""
    pattern = rf"{re.escape(line_comment)}[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`"
    return re.sub(pattern, lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


NAME = r"[A-Za-z_$][\w$]*"
GENERIC = r"(?:<[\w\s,.|&\[\]?<>$]*>)?"
#: What follows the = of a name that holds a function.
FUNCTION_VALUE = rf"(?:async\s*)?(?:(?:\([^()]*\)|{NAME})\s*(?::[^=\n]+)?=>|function\b\s*\*?\s*(?:{NAME})?\s*\()"
#: (kind, pattern) of declarations, by language; the name is the first group.
DECLARED = {
    "js": [("class", rf"\bclass\s+({NAME})"), ("function", rf"\bfunction\s*\*?\s+({NAME})\s*{GENERIC}\s*\("), ("function", rf"\b(?:const|let|var)\s+({NAME})\s*(?::[^=\n]+)?=\s*{FUNCTION_VALUE}")],
    "go": [("class", r"\btype\s+(\w+)\s+(?:struct|interface)\b"), ("method", r"\bfunc\s+\([^)]*\)\s*(\w+)\s*[(\[]"), ("function", r"\bfunc\s+(\w+)\s*[(\[]")],
    "rust": [("class", r"\b(?:struct|enum|trait)\s+(\w+)"), ("impl", r"(?m)^\s*(?:unsafe\s+)?impl\b\s*(?:<[^{;]*?>\s*)?(?:[^{;]*?\sfor\s+)?&?(?:\w+::)*(\w+)"), ("function", r"\bfn\s+(\w+)")],
}
#: Members of a class body: name( that a block follows, and name = a function.
MEMBER = re.compile(rf"(?<![\w$.#])#?({NAME})\s*(?:{GENERIC}\s*(\()|[?!]?\s*(?::[^=;{{}}\n]+)?=\s*{FUNCTION_VALUE})")
CALL = re.compile(rf"(?<![\w$.])((?:{NAME}(?:\?\.|\.|::))*{NAME})(?:::)?{GENERIC}\s*\(")
CHAINED = re.compile(rf"\.\s*({NAME}){GENERIC}\s*\(")
DESTRUCTURED = re.compile(rf"\b(?:const|let|var)\s*(\[[^\]=]*\]|\{{[^}}=]*\}})\s*=\s*(?:await\s+)?(?:{NAME}\.)*use[A-Z][\w$]*\s*{GENERIC}\s*\(")
#: Words before a bracket that are no calls.
KEYWORDS = {
    "js": frozenset("if for while switch catch return function new typeof await async import require super do in of else constructor".split()),
    "go": frozenset("if for switch return func new go defer select case range else import type var const".split()),
    "rust": frozenset("if for while match return fn move loop unsafe in else Fn FnMut FnOnce pub where".split()),
}
IMPORT = re.compile(rf"""(?:import\s+(?:type\s+)?(?P<what>[^'"();]*?)\s*from\s*|import\s*|(?:const|let|var)\s+(?P<req>{NAME}|\{{[^}}]*\}})\s*(?::[^=\n]+)?=\s*require\s*\(\s*)['"](?P<spec>[^'"\n]+)['"]""")


def closing(code: str, at: int) -> int:
    """Past the bracket that closes the one just before `at`."""
    depth = 1
    for m in re.compile(r"[()]").finditer(code, at):
        depth += 1 if m[0] == "(" else -1
        if depth == 0:
            return m.end()
    return len(code)


def body_end(code: str, at: int) -> int:
    """Past the block that opens after a declaration, or its statement's end. Default values in its brackets are no block."""
    depth = 0
    for m in re.compile(r"[{};]").finditer(code, closing(code, at) if code[at - 1] == "(" else at):
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth -= 1
            if depth <= 0:
                return m.end()
        elif depth == 0:
            return m.start()
    return len(code)


def bound_in(pattern: str) -> list[tuple[str, str]]:
    """(local, original) of a destructuring pattern's own level, or of a braced import list."""
    out = []
    for part in pattern.strip()[1:-1].split(","):
        m = re.fullmatch(rf"\s*(?:\.\.\.\s*|type\s+)?({NAME})\s*(?:(?::|\bas\b)\s*({NAME})\s*)?", part)
        if m:
            out.append((m[2] or m[1], m[1]))
    return out


def rebound(code: str) -> set[str]:
    """Names bound more than once in a file, by declarations or parameters at any depth."""
    counts: dict[str, int] = {}
    for m in re.finditer(rf"\b(?:const|let|var)\s+({NAME}|\[[^\]=]*\]|\{{[^}}=]*\}})|\bfunction\b[^(]*\(([^()]*)\)|\(([^()]*)\)\s*(?::[^={{}}\n]+)?(?:=>|\{{)|(?<![\w$.])({NAME})\s*=>", code):
        held = m[1] or m[4]
        if held and held[0] in "[{":
            names = [local for local, _ in bound_in(held)]
        else:
            names = [held] if held else [p[0] for part in (m[2] or m[3] or "").split(",") if (p := re.findall(NAME, part))]
        for name in names:
            counts[name] = counts.get(name, 0) + 1
    return {name for name, n in counts.items() if n > 1}


def _js_imports(found: Found, text: str, code: str, known, line) -> None:
    required: set[str] = set()
    for m in IMPORT.finditer(text):
        if not code[m.start() : m.start() + 3].strip():
            continue  # inside a comment or string
        target = js_file(m["spec"], found.path, known)
        base = file_id(target) if target else make_id(m["spec"])
        found.edge(found.file, base, "imports", line(m.start()), "EXACT_IMPORT" if target else "EXTERNAL_IMPORT")
        what = (m["what"] or m["req"] or "").strip()
        braced = re.search(r"\{.*\}", what, re.S)
        pairs = bound_in(braced[0]) if braced else []
        # A namespace and a required module stand for the whole file; a default import for no definition of a known name.
        star = re.search(rf"\*\s+as\s+({NAME})", what)
        whole = star[1] if star else m["req"] if m["req"] and not braced else None
        default = re.match(rf"({NAME})\s*(?:,|$)", what) if m["what"] else None
        locals_ = {local for local, _ in pairs} | ({whole} if whole else set()) | ({default[1]} if default else set())
        required |= locals_ if m["req"] else set()
        (found.inside if target else found.outside).update(locals_)
        if target:
            found.names.update({local: make_id(base, original) for local, original in pairs})
            found.modules.update({whole: base} if whole else {})
    # A required name that the file binds again can't be told from its other meaning.
    for name in required & rebound(code) if required else ():
        found.names.pop(name, None)
        found.modules.pop(name, None)


def _members(code: str, start: int, end: int):
    """(start, end, name) of the methods and function fields at the top level of a class body."""
    at = code.find("{", start, end) + 1
    while at and (m := MEMBER.search(code, at, end)):
        opened = re.search(r"[{}]", code[at : m.start()])
        if opened:  # a block of the body stands before the match
            at = body_end(code, at + opened.start()) if opened[0] == "{" else end
        elif m[2]:
            after = closing(code, m.end())
            if block := re.compile(r"\s*(?::[^{;=]+)?\{").match(code, after):
                at = body_end(code, block.end() - 1)
                if m[1] not in KEYWORDS["js"]:
                    yield m.start(), at, m[1]
            else:
                at = after
        else:
            at = body_end(code, m.end())
            yield m.start(), at, m[1]


def lexed_file(path: str, text: str, family: str, known=frozenset()) -> list[dict]:
    found, code = Found(path), blank(text)
    line = lambda at: text.count("\n", 0, at) + 1
    if family == "js":
        _js_imports(found, text, code, known, line)
    elif family == "go":
        for m in re.finditer(r'(?m)^\s*(?:import\s+)?(?:(\w+)\s+)?"([\w./-]+)"\s*$', text):
            found.edge(found.file, make_id(m[2]), "imports", line(m.start()))
    else:
        for m in re.finditer(r"(?m)^\s*(?:pub\s+)?(?:use\s+([\w:]+)|mod\s+(\w+)\s*;)", code):
            spec = m[1] or m[2]
            found.edge(found.file, make_id(spec.replace("::", "_")), "imports", line(m.start()))
            found.names[spec.rsplit("::", 1)[-1]] = make_id(spec.replace("::", "_"))
    spans = []
    for kind, pattern in DECLARED[family]:
        for m in re.finditer(pattern, code):
            end = body_end(code, m.end())
            spans.append((m.start(), end, kind, m[1]))
            if family == "js" and kind == "class":
                spans += [(a, b, "method", name) for a, b, name in _members(code, m.end(), end)]
    spans.sort(key=lambda s: (s[0], -s[1]))
    owners: list[tuple[int, int, str, str]] = []  # an impl owns its functions and is no node
    ids = {found.file}

    def around(at: int, *kinds: str) -> str | None:
        return next((o[2] for o in reversed(owners) if o[0] < at < o[1] and (not kinds or o[3] in kinds)), None)

    for a, b, kind, name in spans:
        if kind == "impl":
            me = make_id(found.file, name)
        else:
            method = kind == "method" or family == "rust" and around(a, "impl") is not None
            me = found.declare(around(a) or found.file, "class" if kind == "class" else "function", name, line(a), method)
            ids.add(me)
        owners.append((a, b, me, kind))
    declared = {s[0] for s in spans if s[2] == "method"}
    named: set[int] = set()
    for m in CALL.finditer(code):
        called = m[1].replace("::", ".").replace("?.", ".")
        named.add(m.end(1))
        before = code[max(0, m.start() - 12) : m.start()]
        if called in KEYWORDS[family] or m.start() in declared or re.search(r"\b(?:function\s*\*?|func|fn|class)\s*$|\bfunc\s*\([^)]*\)\s*$", before):
            continue
        owner = around(m.start(), "function", "method") or found.file
        if "." in called:
            found.member_call(owner, called, called.split(".")[0], line(m.start()))
        else:
            found.plain_call(owner, called, line(m.start()))
    for m in CHAINED.finditer(code):  # what has no receiver with a name: a call's result, a literal
        if m.end(1) not in named and m[1] not in DROPPED:
            found.member_call(around(m.start(), "function", "method") or found.file, m[1], None, line(m.start()))
    if family == "js":
        called = {r["target"] for r in found.rows if r.get("relation") == "calls"}
        for m in DESTRUCTURED.finditer(code):
            for local, _ in bound_in(m[1]):
                me = make_id(found.file, local)
                if me in called and me not in ids:  # only what the file calls is a function
                    ids.add(found.declare(around(m.start()) or found.file, "function", local, line(m.start())))
    return found.rows


def js_file(spec: str, path: str, known) -> str | None:
    from lodestone.operators.imports import EXTENSIONS, INDEXES, SOURCES

    if not spec.startswith("."):
        return None
    parts: list[str] = []
    for p in [*path.split("/")[:-1], *spec.split("/")]:
        if p == "..":
            parts = parts[:-1]
        elif p not in ("", "."):
            parts.append(p)
    base = "/".join(parts)
    name = parts[-1] if parts else ""
    ending = name[name.rindex(".") :] if "." in name.lstrip(".") else ""
    tried = [base[: len(base) - len(ending)] + s for s in SOURCES.get(ending, ())] + [base] + ([] if ending else [base + e for e in (*EXTENSIONS, *INDEXES)])
    return next((t for t in tried if t in known), None)


FAMILY = {"typescript": "js", "tsx": "js", "javascript": "js", "jsx": "js", "go": "go", "rust": "rust"}
FAILURES = (SyntaxError, ValueError, RecursionError)


def extract_file(path: str, language: str | None, text: str, known=frozenset()) -> list[dict]:
    if language == "python":
        return python_file(path, text, known)
    if language in FAMILY:
        return lexed_file(path, text, FAMILY[language], known)
    return Found(path).rows


class Asked(set):
    """Knows no path, and keeps those it is asked for."""

    def __contains__(self, path) -> bool:
        self.add(path)
        return False


def wanted(path: str, language: str | None, text: str) -> Asked:
    """Every path that an import of the file could mean."""
    asked = Asked()
    try:
        if language == "python":
            _python_imports(Found(path), ast.parse(text), asked)
        elif FAMILY.get(language) == "js":
            _js_imports(Found(path), text, blank(text), asked, lambda at: 1)
    except FAILURES:  # extract_file says so
        pass
    return asked


def _sources(batch):
    for path, language, text in zip(*(batch[c].to_pylist() for c in ("rel_path", "language", "text")), strict=True):
        yield path, language, text or ""


def with_known(files: DataFrame) -> DataFrame:
    """rel_path, language, text and known: those of the paths that the file's imports could mean that exist."""
    files = files.select("rel_path", "language", "text").where("rel_path is not null")
    schema = pa.schema([("rel_path", pa.string()), ("asked", pa.string())])

    def ask(it):
        for batch in it:
            pairs = [{"rel_path": path, "asked": a} for path, language, text in _sources(batch) for a in wanted(path, language, text)]
            yield pa.RecordBatch.from_pylist(pairs, schema=schema)

    there = files.select(F.col("rel_path").alias("asked")).distinct()
    known = files.mapInArrow(ask, "rel_path string, asked string").join(there, "asked", "left_semi").groupBy("rel_path").agg(F.sort_array(F.collect_set("asked")).alias("known"))
    return files.join(known, "rel_path", "left")


def _rows(files: DataFrame) -> DataFrame:
    """Tagged rows of files (rel_path, language, text, known, key), each with the key of its file."""
    kinds = {"string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in KEYED.split(", ")])

    def run(it):
        for batch in it:
            out = []
            for (path, language, text), paths, key in zip(_sources(batch), batch["known"].to_pylist(), batch["key"].to_pylist(), strict=True):
                try:
                    rows = extract_file(path, language, text, frozenset(paths or ()))
                except FAILURES as e:
                    rows = [*Found(path).rows, {"tag": "error", "id": path, "name": type(e).__name__}]
                out += [{**r, "key": key} for r in rows]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return files.select("rel_path", "language", "text", "known", "key").mapInArrow(run, KEYED)


def _parts(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes = found.where("tag = 'node'").select("id", "kind", "name", "source_file", "source_location", F.coalesce("is_method", F.lit(False)).alias("is_method"))
    edges = found.where("tag = 'edge'").select("source", "target", "relation", "source_file", "source_location", "confidence", "called", "weight")
    return nodes, edges, found.where("tag = 'error'").select(F.col("id").alias("subject"), F.col("name").alias("error")).orderBy("subject")


def _tagged(files: DataFrame) -> DataFrame:
    return _rows(with_known(files).withColumn("key", F.lit(None).cast("string")))


def extract(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges and errors of files (rel_path, language, text). Rows without a path are left out; a null text is empty.

    Each file is given those of its imports' paths that exist, by a join: a path that many files import is one row of
    the side that is looked up, and a file's own list is as long as its imports.
    """
    return _parts(_tagged(files))


def extract_cached(files: DataFrame, cache: str, engine: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As extract(); what a file yields is kept in the folder `cache` and extracted again only when its key changes.

    A key is made of the path, the language, the text and the known paths of the imports, so a file whose import
    appears or goes is extracted again. Each engine has a folder of its own. One run at a time may write.
    """
    spark, home = files.sparkSession, f"{cache.rstrip('/')}/engine={engine}"
    key = F.sha2(F.to_json(F.struct("rel_path", "language", F.sha2("text", 256).alias("t"), "known")), 256)
    keyed = with_known(files).withColumn("key", key).dropDuplicates(["key"])
    fs, where = at(spark, home)
    kept = lambda: spark.read.schema(KEYED).parquet(home)
    new = keyed.join(kept().select("key").distinct(), "key", "left_anti") if fs.exists(where) else keyed
    _rows(new).write.mode("append").parquet(home)
    return _parts(kept().join(keyed.select("key"), "key", "left_semi"))


def prune_cache(spark: SparkSession, cache: str, engine: str) -> list[str]:
    """Deletes the folders of other engines; their names."""
    fs, where = at(spark, f"{cache.rstrip('/')}/engine=*")
    others = [f.getPath() for f in fs.globStatus(where) or [] if f.getPath().getName() != f"engine={engine}"]
    return sorted(p.getName() for p in others if fs.delete(p, True))


def code_graph(files: DataFrame) -> tuple[Graph, DataFrame]:
    """The graph of files and the errors: extraction, then member calls sent to the methods they can mean, then the build.

    What the files yield is written once to the shared folder, for it is read by several joins.
    """
    nodes, edges, errors = _parts(cut(_tagged(files)))
    homes = nodes.where("kind = 'file'").select(F.col("id").alias("target"), F.col("source_file").alias("target_file"))
    imports = edges.where("relation = 'imports'").join(homes, "target").select("source_file", "target_file").distinct()
    return build_graph(nodes, dispatch_methods(edges, nodes, imports)), errors


def uncached(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose content and path are not among the cache's keys."""
    return files.join(cache.select("rel_path", "content_hash").distinct(), ["rel_path", "content_hash"], "left_anti")
