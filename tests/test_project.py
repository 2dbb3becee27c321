"""Projects on disk, logs and caches between runs, plans before they run, and the parts of evidence without a query."""

import subprocess

import pytest

from lodestone.functions.ids import cache_key, file_set_digest, incident_fingerprint
from lodestone.operators import evidence, metrics
from lodestone.operators.build import Graph, build_graph
from lodestone.operators.extract import extract, extract_cached, prune_cache
from lodestone.plans.plan import build, preview, query
from lodestone.sources import export, project, texts
from lodestone.streaming import watch
from pyspark.sql import functions as F


def test_listed_paths():
    assert project.listed_paths(b"") == [] and project.listed_paths("a\0b/ü c\0".encode()) == ["a", "b/ü c"]
    for bad in (b"a", b"/a\0", b"a/../b\0", b"\xff\0", b"C:/a\0", b"\0"):
        with pytest.raises(ValueError):
            project.listed_paths(bad)
    with pytest.raises(ValueError):
        project.listed_paths(b"a\0b\0", most=1)


def test_git_files(tmp_path):
    root = tmp_path / "r"
    (root / "sub").mkdir(parents=True)
    assert project.git_files(str(root)) is None
    subprocess.run(["git", "init", "-q", str(root)], check=True)
    (root / "a.py").write_text("x")
    (root / "sub/b.log").write_text("x")
    (root / ".gitignore").write_text("*.log\n")
    assert sorted(project.git_files(str(root))) == [".gitignore", "a.py"]
    with pytest.raises(ValueError):
        project.git_files(str(root / "sub"))


def test_discover(tmp_path):
    for name in ("b/package.json", "b/inner/go.mod", "A/x/Cargo.toml", "node_modules/z/go.mod", ".hid/go.mod", "quiet/.skip", "quiet/go.mod", "d/e/f/go.mod"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("")
    rel = lambda found: [p[len(str(tmp_path)) + 1 :] for p in found]
    assert rel(project.discover(str(tmp_path), ignore=".skip")) == ["A/x", "b", "d/e/f"]
    assert rel(project.discover(str(tmp_path), depth=2, ignore=".skip")) == ["A/x", "b"] and rel(project.discover(str(tmp_path), most=1, ignore=".skip")) == ["b"]
    with pytest.raises(FileNotFoundError):
        project.discover(str(tmp_path / "none"))


def test_answer_paths():
    answer = {"file": "a", "rows": [{"path": "b", "name": "x"}, {"path": "a"}, {"files": ["c", 1, "", {"path": "no"}]}], "path": {"file": "d"}, "files": "no", "other": ["no"]}
    assert project.answer_paths(answer) == ["a", "b", "c", "d"] and project.answer_paths(answer, 2) == ["a", "b"] and project.answer_paths(None) == []


def test_fingerprint(tmp_path):
    (tmp_path / "a.py").write_text("x")
    first = project.fingerprint(str(tmp_path), {"version": "1"})
    assert first != project.fingerprint(str(tmp_path), {"version": "2"}) and len(first) == 64
    (tmp_path / "note.md").write_text("x")
    assert first == project.fingerprint(str(tmp_path), {"version": "1"})
    (tmp_path / "b.py").write_text("")
    assert first != project.fingerprint(str(tmp_path), {"version": "1"})
    with pytest.raises(ValueError):
        project.fingerprint(str(tmp_path), {}, most_files=1)


def test_schemas():
    ok = project.conforms
    shape = {"type": "object", "required": ["id"], "properties": {"id": {"type": "integer"}, "tags": {"type": "array", "items": {"type": "string", "pattern": "[a-z]+", "maxLength": 3}, "minItems": 1, "maxItems": 2}}}
    assert ok({"id": 1, "tags": ["ab"]}, shape) and ok({"id": 1}, shape)
    for bad in ({}, {"id": True}, {"id": 1.0}, {"id": 1, "more": 2}, {"id": 1, "tags": []}, {"id": 1, "tags": ["a", "b", "c"]}, {"id": 1, "tags": ["abcd"]}, {"id": 1, "tags": ["A"]}, [], None):
        assert not ok(bad, shape), bad
    assert ok({"id": 1, "more": 2}, shape | {"additionalProperties": True}) and ok(None, {"type": ["string", "null"]}) and ok(1.5, {"type": "number"})
    assert not ok(True, {"const": 1}) and not ok(1, {"enum": [1.0, True]}) and ok([1], {"const": [1]}) and not ok(1, "x") and ok(1, {"format": "?"})


def test_audit():
    assert project.replacement_audit({"a": True}, {"text_references": ["x"]}) == {"ok": True, "ready": True, "blockers": [], "warnings": {"text_references": ["x"]}}
    assert project.replacement_audit({"a": False}, {"paths_exist": ["p"]}) == {"ok": False, "ready": False, "blockers": ["a"], "warnings": {"paths_exist": ["p"]}}


def test_cached_extraction(spark, tmp_path):
    shape, cache = "rel_path string, language string, text string", str(tmp_path / "cache")
    rows = [("a.py", "python", "import b\n"), ("c.ts", "typescript", "function f() { g(); }\n"), ("d.py", "python", "def (")]
    plain = lambda parts: [sorted(map(str, p.collect())) for p in parts]
    one = spark.createDataFrame(rows, shape)
    assert plain(extract_cached(one, cache, "1")) == plain(extract(one))
    before = spark.read.parquet(f"{cache}/engine=1").count()
    assert plain(extract_cached(one, cache, "1")) == plain(extract(one)) and spark.read.parquet(f"{cache}/engine=1").count() == before
    two = spark.createDataFrame([*rows[:2], ("b.py", "python", "")], shape)  # a.py's import appears
    assert plain(extract_cached(two, cache, "1")) == plain(extract(two))
    assert spark.read.parquet(f"{cache}/engine=1").where("source_file = 'a.py' and tag = 'node'").count() == 2
    extract_cached(two, cache, "2")
    assert prune_cache(spark, cache, "2") == ["engine=1"] and prune_cache(spark, cache, "2") == []


def test_logs_rotate_and_bundles_come_back(spark, tmp_path):
    log, rows = str(tmp_path / "log"), spark.createDataFrame([("x" * 100,)], "cmd string")
    export.append_log(rows, log)
    export.append_log(rows, log)
    assert spark.read.json(log).count() == 2
    export.append_log(rows, log, most=50)
    assert spark.read.json(log).count() == 1 and spark.read.json(f"{log}.1").count() == 2
    g = build_graph(spark.createDataFrame([("a", "file", "a", "a.py")], "id string, kind string, name string, source_file string"), spark.createDataFrame([("a", "b", "calls")], "source string, target string, relation string"))
    export.write_bundle(g, str(tmp_path / "g"))
    nodes, edges = texts.read_bundle(spark, str(tmp_path / "g"))
    assert {r.id for r in nodes.collect()} == {"a", "b"} and edges.select("source", "target", "relations").first() == ("a", "b", ["calls"])
    (tmp_path / "one.json").write_text('{"nodes": [{"id": "a"}], "edges": []}')
    assert [d.count() for d in texts.read_bundle(spark, str(tmp_path / "one.json"))] == [1, 0]
    (tmp_path / "n").write_text("3\t1\ta b\n-\t-\tbin\nnone\n")
    assert [tuple(r) for r in texts.numstat(spark.read.text(str(tmp_path / "n"))).collect()] == [(3, 1, "a b"), (None, None, "bin")]
    (tmp_path / "s").write_text('{"round": 1, "status": "open"}\nbroken\n')
    assert [r.malformed for r in texts.status_events(spark, str(tmp_path / "s")).collect()] == [False, True]


def test_overview(spark):
    nodes = spark.createDataFrame([("a", "file", "a", 1), ("b", "file", "b", 1), ("c", "class", "c", None), ("d", "file", "d", 2)], "id string, kind string, name string, community int").withColumn("source_file", F.col("id"))
    g = Graph(nodes, spark.createDataFrame([("a", "b", "calls", ["calls"]), ("c", "b", "imports", ["imports"])], "source string, target string, relation string, relations array<string>"))
    assert tuple(metrics.community_of(g, "a", most=1).first()) == ("a", 1, 2, ["a"])
    assert metrics.community_of(g, "c").count() == metrics.community_of(g, "none").count() == 0
    stats = {(r.what, r.name): r.n for r in query("stats", g).collect()}
    assert stats["nodes", None] == 4 and stats["edges", None] == 2 and stats["communities", None] == 2 and stats["in", "b"] == 2 and stats["kind", "file"] == 3
    assert set(metrics.summary(g)) == {"size", "god_nodes", "entry_points", "top_files", "surprising"}
    page = export.markdown(g)
    assert "## Communities" in page and "a, b" in page.split("## Communities")[1]
    seen = preview(build("callers b"), g)
    assert seen["executable"] and seen["targets"][0]["node"] == "b" and seen["limits"] == {"max_results": 200}
    assert not preview(build("callers zzz"), g)["executable"]


def test_choices(spark):
    shape = "model string, effort string, gate boolean, reliability int, role_bonus int, usage string, input_tokens long, output_tokens long, latency_ms long, retry int, escalation int, scarcity int"
    rows = [("m1", "low", True, 900, 0, "none", 100, 100, 1000, 0, 0, 0), ("m2", "low", True, 900, 50, "none", 0, 0, 0, 0, 0, 0), ("m3", "low", False, 1000, 0, "none", 0, 0, 0, 0, 0, 0), ("m0", "low", True, -5, 0, "none", 0, 0, 0, 0, 0, 0)]
    got = evidence.rank_candidates(spark.createDataFrame(rows, shape)).collect()
    assert [r.model for r in got] == ["m2", "m1", "m0"] and got[0].score >= got[1].score > got[2].score == 0
    ways = spark.createDataFrame([("a", 1, 10), ("b", 2, 90), ("c", 3, 10)], "model string, ordinal int, reserve long")
    tried = spark.createDataFrame([("a", False, 50)], "model string, ok boolean, tokens long")
    assert [r.model for r in evidence.route(ways, tried, 100).collect()] == ["c"] and [r.model for r in evidence.route(ways, tried.where("false"), 100).collect()] == ["a"]
    assert evidence.route(ways, tried, 40).count() == 0
    judges = spark.createDataFrame([("x", "f", "f", 1, 0), ("y", "g", "f", 2, 0), ("z", "h", "f", 2, 0)], "model string, family string, author_family string, cost int, load int")
    assert [r.model for r in evidence.reviewer(judges).collect()] == ["y"]
    moves = spark.createDataFrame([("new", "ready"), ("ready", "new")], "before string, after string")
    assert watch.violations(moves, moves.limit(1)).collect() == [("ready", "new")] and watch.violations(moves, moves.where("false")).count() == 2
    marks = spark.createDataFrame([(100,), (99,), (4000,)], "seen_at long")
    assert sorted(r.seen_at for r in watch.active(marks, 3700).collect()) == [100]


def test_digests(spark):
    assert cache_key("a", "b") != cache_key("a:", "b") and len(cache_key("a")) == 64
    paths = spark.createDataFrame([("b",), ("a",), ("b",)], "p string")
    assert paths.agg(file_set_digest(F.col("p"))).first() == paths.orderBy("p").distinct().agg(file_set_digest(F.col("p"))).first()
    assert len(spark.range(1).select(incident_fingerprint(F.lit("build"), F.lit("E1"), F.lit("x"))).first()[0]) == 16
