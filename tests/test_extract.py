"""What extraction binds, file by file and over a project."""

import pytest

from lodestone.operators.extract import code_graph, extract, extract_file, wanted

SPARE = frozenset()


def nodes_of(path, language, text, known=SPARE):
    return {r["id"]: r["is_method"] for r in extract_file(path, language, text, known) if r["tag"] == "node"}


def calls_of(path, language, text, known=SPARE):
    return {(r["source"], r["target"], r["confidence"]) for r in extract_file(path, language, text, known) if r.get("relation") == "calls"}


def test_class_fields_and_methods():
    text = "export class Widget {\n  handle = () => 1;\n  size: number = f(3);\n  constructor(a = {}) { super(a); }\n  run(): string { if (a) { b(); } return this.handle(); }\n  async go<T>(q: T) { await z() }\n}\nexport const plain = () => 2;\n"
    assert nodes_of("src/w.ts", "typescript", text) == {"src_w": False, "src_w_widget": False, "src_w_handle": True, "src_w_run": True, "src_w_go": True, "src_w_plain": False}
    assert {("src_w_run", "src_w_this_handle", "LOCAL_CALL"), ("src_w_run", "src_w_b", "LOCAL_CALL"), ("src_w_go", "src_w_z", "LOCAL_CALL")} <= calls_of("src/w.ts", "typescript", text)


@pytest.mark.parametrize("hook", ["const [copied, setCopied] = useState(false)", "const [copied, setCopied] = useState<string>('')", "const { copied, put: setCopied } = React.useThing()"])
def test_a_destructured_binding_is_a_function_once_it_is_called(hook):
    text = f"export function Panel() {{\n  {hook};\n  function mark() {{ setCopied(true); }}\n  return [copied, mark];\n}}\n"
    assert set(nodes_of("src/p.tsx", "tsx", text)) == {"src_p", "src_p_panel", "src_p_mark", "src_p_setcopied"}
    assert ("src_p_mark", "src_p_setcopied", "LOCAL_CALL") in calls_of("src/p.tsx", "tsx", text)


def test_no_binding_of_what_hooks_do_not_give():
    assert set(nodes_of("a.js", "javascript", "const { readFile } = load();\nreadFile();\nconst api = { toLabel: () => 1 };\nxs.map(x => x + 1);\n")) == {"a"}


def test_confidence_of_calls():
    text = "import { dep } from './dep';\nimport { z } from 'zod';\nimport * as crypto from './dep';\nfunction go() {\n dep(); z.object({}); crypto.q(); missing(); new Widget(); getThing().test(); 'x'.format(1); expect(2); performance.now(); String(3); }\n"
    assert calls_of("src/t.ts", "typescript", text, frozenset({"src/dep.ts"})) == {
        ("src_t_go", "src_dep_dep", "LOCAL_CALL"), ("src_t_go", "src_t_z_object", "EXTERNAL_CALL"), ("src_t_go", "src_dep_q", "LOCAL_CALL"), ("src_t_go", "src_t_missing", "LOCAL_CALL"),
        ("src_t_go", "src_t_widget", "LOCAL_CALL"), ("src_t_go", "src_t_getthing", "LOCAL_CALL"), ("src_t_go", "src_t_test", "LOCAL_CALL"), ("src_t_go", "src_t_format", "LOCAL_CALL"),
        ("src_t_go", "src_t_expect", "EXTERNAL_CALL"), ("src_t_go", "src_t_performance_now", "EXTERNAL_CALL"),
    }


def test_required_names_that_are_bound_again_prove_nothing():
    one = "const m = require('./x');\nconst { f, g: h } = require('./x');\nfunction a() { m.real(); f(); h(); }\n"
    assert calls_of("c.js", "javascript", one, frozenset({"x.js"})) == {("c_a", "x_real", "LOCAL_CALL"), ("c_a", "x_f", "LOCAL_CALL"), ("c_a", "x_g", "LOCAL_CALL")}
    assert ("c_a", "c_m_real", "LOCAL_CALL") in calls_of("c.js", "javascript", one.replace("a()", "a(m)"), frozenset({"x.js"}))
    assert extract_file("c.js", "javascript", "// const q = require('./x')\n", frozenset({"x.js"}))[1:] == []


def test_python():
    text = 'import os.path, pkg.sub\nfrom helpers import format\nclass A(B, c.D):\n  x = f()\n  def run(self):\n    os.path.join(1); format(1); "{}".format(2); self.go(); len(3); pkg.build(); raise ValueError(2)\n'
    known = frozenset({"helpers.py", "pkg/__init__.py", "pkg/sub.py"})
    rows = extract_file("m.py", "python", text, known)
    assert {(r["target"], r["confidence"]) for r in rows if r.get("relation") == "imports"} == {("os_path", "EXTERNAL_IMPORT"), ("pkg_sub", "EXACT_IMPORT"), ("pkg_init", "EXACT_IMPORT"), ("helpers", "EXACT_IMPORT")}
    assert [r["target"] for r in rows if r.get("relation") == "inherits"] == ["b"]
    assert nodes_of("m.py", "python", text, known) == {"m": False, "m_a": False, "m_run": True}
    assert calls_of("m.py", "python", text, known) == {
        ("m", "m_f", "LOCAL_CALL"), ("m_run", "m_join", "EXTERNAL_CALL"), ("m_run", "helpers_format", "LOCAL_CALL"), ("m_run", "m_format", "LOCAL_CALL"),
        ("m_run", "m_self_go", "LOCAL_CALL"), ("m_run", "pkg_init_build", "LOCAL_CALL"), ("m_run", "m_valueerror", "EXTERNAL_CALL"),
    }


def test_rust_and_go_methods():
    text = "pub struct S<T> { a: T }\nimpl<T: Clone> Foo for S<T> {\n  fn run(&self) { help(); }\n}\nfn help() -> impl Fn() { }\ntrait Q { fn z(&self); }\n"
    assert nodes_of("l.rs", "rust", text) == {"l": False, "l_s": False, "l_run": True, "l_help": False, "l_q": False, "l_z": False}
    assert any(r.get("relation") == "contains" and (r["source"], r["target"]) == ("l_s", "l_run") for r in extract_file("l.rs", "rust", text, SPARE))
    assert nodes_of("x.go", "go", "package x\ntype T struct {}\nfunc (t *T) Run() { help() }\nfunc help() {}\n") == {"x": False, "x_t": False, "x_run": True, "x_help": False}


def test_paths_asked_for():
    assert {"dep.ts", "dep.tsx", "dep/index.ts"} <= set(wanted("a.ts", "typescript", "import {x} from './dep'"))
    assert wanted("a.py", "python", "def (") == set() and wanted("a.md", "markdown", "x") == set()


def test_member_calls_reach_methods_of_other_files(spark):
    files = [("src/w.ts", "typescript", "export class Widget {\n  handle = () => 1;\n  run() { return this.handle(); }\n}\n"), ("src/use.ts", "typescript", "import { Widget } from './w';\nexport function go(w: Widget) { w.handle(); w.unknown(); }\n"), ("src/none.ts", None, None), (None, "python", "x()")]
    g, errors = code_graph(spark.createDataFrame(files, "rel_path string, language string, text string"))
    got = {(r.source, r.target) for r in g.edges.where("array_contains(relations, 'calls')").collect()}
    assert got == {("src_w_run", "src_w_handle"), ("src_use_go", "src_w_handle")} and errors.count() == 0
    assert ("src_use", "src_w") in {(r.source, r.target) for r in g.edges.collect()}


def test_no_files(spark):
    for part in extract(spark.createDataFrame([], "rel_path string, language string, text string")):
        assert part.count() == 0
