import json

import pandas as pd
import pytest

from lodestone.operators import evidence, imports, ledger
from lodestone.operators.build import build_graph
from lodestone.operators.extract import extract, python_file, uncached
from lodestone.sources import export, texts
from lodestone.streaming import watch
from pyspark.sql import functions as F


def test_project_to_graph(spark, tmp_path):
    files = {
        "src/mod.ts": "export function target() {}\nexport const other = () => 1;\n",
        "src/consumer.ts": 'import { target, other } from "./mod";\nexport function alpha() { target(); }\nconst beta = () => { target(); };\nfunction gamma() { other(); }\nfunction delta() { alpha(); "target()"; }\n',
        "app/main.py": "from app.util import helper\nclass A(B):\n    def run(self):\n        helper()\n",
        "app/util.py": "def helper(): pass\n",
        "app/broken.py": "def (:\n",
        "go/x.go": 'package x\nimport "fmt"\nfunc Run() { fmt.Println(1); help() }\nfunc help() {}\n',
        "rs/l.rs": "use std::io;\npub struct S;\nfn run() { help(); }\nfn help() {}\n",
        "node_modules/x.js": "x",
        "bin.py": "a\0b",
    }
    for name, text in files.items():
        p = tmp_path / "in" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    scanned = texts.scan_files(spark, str(tmp_path / "in"))
    assert {r.rel_path for r in scanned.collect()} == set(files) - {"node_modules/x.js", "bin.py"}
    nodes, edges, errors = extract(scanned)
    assert [r.subject for r in errors.collect()] == ["app/broken.py"]
    g = build_graph(nodes, edges)
    got = {(r.source, r.target): r for r in g.edges.collect()}
    for pair in (("src_consumer_alpha", "src_mod_target"), ("src_consumer_beta", "src_mod_target"), ("src_consumer_gamma", "src_mod_other"), ("src_consumer_delta", "src_consumer_alpha"), ("src_consumer", "src_mod"), ("app_main", "app_util"), ("app_main_run", "app_util_helper"), ("go_x_run", "go_x_help"), ("rs_l_run", "rs_l_help")):
        assert pair in got, pair
    assert ("src_consumer_delta", "src_mod_target") not in got and not any(t == "src_consumer_target" for _, t in got)
    export.write_bundle(g, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/nodes.json")).count() == g.nodes.count()
    assert "## Most connected" in export.markdown(g) and "</script><" not in export.viewer(g).split("graph")[-1][:50]
    assert uncached(scanned, scanned.limit(2)).count() == scanned.count() - 2
    assert python_file("a.py", "")[0]["id"] == "a"


def test_logs(spark, tmp_path):
    (tmp_path / "u.1").write_text('{"ts":"1","cmd":"q","wall_ms":1,"output_bytes":8,"files":[{"path":"a","bytes":40}]}\nbroken\n')
    (tmp_path / "u").write_text('{"ts":"2","cmd":"r","wall_ms":1,"output_bytes":80000,"files":[]}\n')
    rows = texts.usage_entries(spark, [str(tmp_path / "u.1"), str(tmp_path / "u")])
    assert [r.cmd for r in rows.orderBy("generation").collect()] == ["q", "r"]
    got = {r.cmd: r.tokens for r in ledger.savings(rows).collect()}
    assert got == {"q": 1008, "r": 0, None: 1008}
    assert ledger.format_saving(12345, 250.0) == "~12.3k tokens / ~4 min" and ledger.format_saving(900, 45.0) == "~900 tokens / ~45s"
    (tmp_path / "i").write_text("\n".join([json.dumps({"schema": 1, "kind": k, "fingerprint": "f", "ts": t, "class": "build"}) for k, t in (("occurrence", "1"), ("ack", "2"))] + ["{}", "x" * 9000]))
    good, skipped = texts.incident_entries(spark, str(tmp_path / "i"))
    assert good.count() == 2 and skipped.first().skipped == 2
    (tmp_path / "r.md").write_text("---\nround: 3\nauthor: ann\nto: bob\n---\nBody\n")
    assert tuple(texts.rounds(spark, str(tmp_path / "r.md")).first())[:3] == (3, "ann", "bob")
    assert texts.porcelain(b" M a\0R  new\0old\0?? u\0") == [("modified", "a", None), ("renamed", "new", "old"), ("untracked", "u", None)]
    for bad in (b"UU a\0", b"R  new\0", b"x\0"):
        with pytest.raises(ValueError):
            texts.porcelain(bad)
    assert texts.case_collisions(spark.createDataFrame([("A.py",), ("a.py",), ("b",)], "path string")).count() == 1


def test_incident_states(spark):
    def state(*events):
        rows = [(i, k, "f", t, "build") for i, (k, t) in enumerate(events)]
        return ledger.fold_incidents(spark.createDataFrame(rows, "ord long, kind string, fingerprint string, ts string, class string")).first().state

    assert state(("occurrence", "1")) == "open" and state(("occurrence", "1"), ("ack", "2"), ("occurrence", "3")) == "acked"
    assert state(("occurrence", "1"), ("resolve", "2")) == "resolved" and state(("occurrence", "1"), ("resolve", "2"), ("occurrence", "3")) == "open"


def test_diff_and_evidence(spark):
    a = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "rel_path string, content_hash string")
    b = spark.createDataFrame([("b", "1"), ("c", "2"), ("d", "1")], "rel_path string, content_hash string")
    assert {(r.rel_path, r.change) for r in ledger.snapshot_diff(a, b).collect()} == {("a", "removed"), ("c", "changed"), ("d", "added")}
    assert watch.freshness(a, b, "1", "1").first().stale and not watch.freshness(a, a, "1", "1").first().stale
    rows = spark.createDataFrame([("x", f"{i:03}", n) for i, n in enumerate([5, 90, 3, 50, 2])], "scope string, path string, bytes long")
    assert [r.verdict for r in evidence.within_budget(rows, 3, 60).orderBy("path").collect()] == ["taken", "max_bytes", "taken", "taken", "max_files"]
    stats = spark.createDataFrame([("low", 60, 60, 0), ("low", 10, 10, 0), ("medium", 100, 90, 0), ("high", 999, 999, 0), ("low", 60, 60, 1)], "risk string, n long, successes long, severe long")
    assert [r.reason for r in evidence.promotion(stats).collect()] == ["none", "too_few", "bound", "risk", "severe_failure"]
    cli = spark.createDataFrame([("m1", "low", [], 100, 95, 0, 0, 1), ("m2", "low", ["quota"], 100, 100, 0, 0, 1), ("m3", "max", [], 100, 99, 10, 1, None)], "model string, effort string, failed array<string>, n long, successes long, repo_n long, repo_successes long, age_days int").withColumns({c: F.lit(0) for c in ("token_points", "latency_points", "scarcity", "risk_points")})
    got = evidence.rank_cli(cli).collect()
    assert [r.model for r in got] == ["m1", "m3", "m2"] and got[2].rejection == "quota" and got[0].score > got[1].score


def test_imports(spark):
    files = spark.createDataFrame([(p,) for p in ("src/a.ts", "src/lib/index.ts", "pkg/x.py", "src/pkg/y/__init__.py", "web/src/u.tsx")], "path string")
    asked = spark.createDataFrame([("src/b.ts", "./a.js"), ("src/b.ts", "./lib"), ("src/lib/index.ts", "../a"), ("src/b.ts", "./none")], "importer string, specifier string")
    got = {r.specifier: r.target for r in imports.resolve_relative(asked, files).collect()}
    assert got == {"./a.js": "src/a.ts", "./lib": "src/lib/index.ts", "../a": "src/a.ts", "./none": None}
    aliases = spark.createDataFrame([("", "@/*", "src/*", 0), ("web", "@/*", "src/*", 0)], "scope string, pattern string, replacement string, place int")
    asked = spark.createDataFrame([("web/src/b.ts", "@/u"), ("src/b.ts", "@/a")], "importer string, specifier string")
    assert {r.specifier: r.target for r in imports.resolve_alias(asked, aliases, files).collect()} == {"@/u": "web/src/u.tsx", "@/a": "src/a.ts"}
    asked = spark.createDataFrame([("main.py", "pkg.x"), ("main.py", "pkg.y"), ("pkg/z.py", ".x"), ("main.py", "os")], "importer string, module string")
    assert {r.module: r.target for r in imports.resolve_python(asked, files).collect()} == {"pkg.x": "pkg/x.py", "pkg.y": "src/pkg/y/__init__.py", ".x": "pkg/x.py", "os": None}
    names = spark.createDataFrame([("serde_json_value",), ("other",)], "name string")
    prefixes = spark.createDataFrame([("serde",), ("serde_json",)], "prefix string")
    assert {r.name: r.prefix for r in imports.longest_prefix(names, prefixes).collect()} == {"serde_json_value": "serde_json", "other": None}
    packages = spark.createDataFrame([("@a/b", "packages/b"), ("@a/b/c", "packages/c")], "name string, root string")
    assert {r.specifier: (r.root, r.subpath) for r in imports.resolve_packages(spark.createDataFrame([("@a/b/x",), ("@a/b/c",), ("zz",)], "specifier string"), packages).collect()} == {"@a/b/x": ("packages/b", "x"), "@a/b/c": ("packages/c", "")}


def test_streams(spark, tmp_path):
    def stream(rows, schema, name):
        folder = tmp_path / name
        folder.mkdir(exist_ok=True)
        pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]).to_json(folder / f"{len(list(folder.iterdir()))}.json", orient="records", lines=True)
        return spark.readStream.schema(schema).json(str(folder))

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"c_{name}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.sql(f"select * from {name}").collect()

    df = stream([("a", "1", 0), ("b", "1", 0), ("a", "2", 1), ("b", None, 1)], "rel_path string, content_hash string, scan long", "scans")
    assert {(r.rel_path, r.change) for r in run(watch.changes(df), "s1")} == {("a", "added"), ("b", "added"), ("a", "changed"), ("b", "removed")}
    df = stream([("p", "e1", "new", "ready", 1), ("p", "e1", "new", "ready", 1), ("p", "e2", "ready", "done", 5), ("p", "e3", "ready", "done", 6), ("p", "e4", "done", "x", 7)], "boundary string, event_id string, expected string, next string, occurred_at long", "life")
    assert [r.verdict for r in run(watch.transitions(df), "s2")] == ["applied", "duplicate", "applied", "conflict", "applied"]

    df = stream([("a", 1)], "k string, v long", "watched")
    calls = []

    def build(batch):
        calls.append(batch.count())
        if len(calls) == 1:
            raise RuntimeError("first try fails")

    with pytest.raises(Exception, match="first try"):
        watch.watch(df, build, str(tmp_path / "cw"), once=True).awaitTermination(60)
    watch.watch(df, build, str(tmp_path / "cw"), once=True).awaitTermination(60)
    assert calls == [1, 1]
    looks = iter([{"a": "1"}, {"a": "2"}, {"a": "2"}])
    assert watch.settled(lambda: next(looks), lambda: None) == {"a": "2"}
    assert watch.backoff(3, 1, 100, "x") == watch.backoff(3, 1, 100, "x") >= 8
