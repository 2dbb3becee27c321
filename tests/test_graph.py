import itertools
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import columns
from lodestone.functions.ids import file_id, make_id, normal_id, normalize_id
from lodestone.operators import communities, context, health, metrics, search, traverse
from lodestone.operators.build import Graph, build_graph, dedupe_nodes, merge_edges
from lodestone.plans import natural
from lodestone.plans.plan import Plan, PlanError, build, capabilities, check, execute

FIVE = [("src_app", "file", "app.ts", "src/app.ts"), ("src_app_main", "function", "main", "src/app.ts"), ("web_sync", "file", "sync.js", "web/sync.js"), ("web_sync_acceptpairing", "function", "acceptPairing", "web/sync.js"), ("web_sync_openscanner", "function", "openScanner", "web/sync.js")]


def nodes_of(spark, rows):
    return spark.createDataFrame(rows, "id string, kind string, name string, source_file string")


def edges_of(spark, pairs, relation="calls"):
    rows = [(a, b, relation, "a.py", "LOCAL_CALL", 1.0) for a, b in pairs]
    return spark.createDataFrame(rows, "source string, target string, relation string, source_file string, confidence string, weight double")


def graph_of(spark, pairs, relation="calls"):
    ids = sorted({x for p in pairs for x in p})
    return build_graph(nodes_of(spark, [(i, "function", i, "src/mod.py") for i in ids]), edges_of(spark, pairs, relation))


def test_ids(spark):
    odd = ["src/app.ts", "_.A..B__c-", "Straße ﬁ", "x" * 300, "..", "a__b", "日本 語"]
    assert make_id("src", "App.ts") == "src_app_ts" and len(make_id("x" * 300)) == 120
    assert file_id("src/app.test.ts") == "src_app_test" and file_id("README") == "readme"
    assert normal_id("Straße ﬁ") == "strasse_fi" and len(normal_id("x" * 300)) == 300
    df = spark.createDataFrame([(x,) for x in odd], "v string")
    assert [r[0] for r in df.select(normalize_id(F.col("v"))).collect()] == [normal_id(x) for x in odd]
    plain = [x for x in odd if x.isascii()]
    df = spark.createDataFrame([(x,) for x in plain], "v string")
    assert [r[0] for r in df.select(normalize_id(F.col("v"), ascii_only=True)).collect()] == [normal_id(x) for x in plain]


def test_columns(spark):
    vectors = [(0, 0, 0.0), (0, 10, 0.0), (10, 10, 0.722467), (50, 50, 0.928652), (95, 100, 0.88825)]
    df = spark.createDataFrame(vectors, "s long, n long, want double")
    assert all(abs(r.got - r.want) < 1e-6 for r in df.select("want", columns.wilson_lower(F.col("s"), F.col("n")).alias("got")).collect())
    paths = [("tests/a.py", True, False, "python"), ("src/a.test.ts", True, False, "typescript"), ("../x.go", False, True, "go"), ("C:\\x", False, True, "other"), ("src/latest.rs", False, False, "rust"), (None, False, None, "other")]
    df = spark.createDataFrame(paths, "p string, t boolean, u boolean, l string")
    for r in df.select("*", columns.is_test_file(F.col("p")).alias("t2"), columns.unsafe_path(F.col("p")).alias("u2"), columns.edge_language(F.col("p")).alias("l2")).collect():
        assert (r.t, r.u, r.l) == (r.t2, r.u2, r.l2)
    df = spark.createDataFrame([(v,) for v in (None, -1, 0, 1, 2, 3, 1024, 10**9)], "v long")
    assert [r[0] for r in df.select(columns.log2_bucket(F.col("v"))).collect()] == [0, 0, 0, 1, 2, 2, 11, 20]
    df = spark.createDataFrame([("./a/b.py",), ("a\u200bb",), ("",), ("/a",)], "p string")
    assert [r[0] for r in df.select(columns.safe_relative_path(F.col("p"))).collect()] == ["a/b.py", None, None, None]


def test_build_does_not_depend_on_order(spark):
    nodes = [("a", "function", "a", "f.py"), ("A", "class", "A2", "g.py"), ("b", "file", "b", None)]
    rows = [("a", "b", "imports", "f.py", None, 2.0), ("a", "b", "calls", "g.py", "LOCAL_CALL", None), ("A", "b", "calls", "h.py", "X", 0.0), ("a", "a", "calls", "f.py", None, 1.0), ("b", "zz", "calls", "f.py", None, 1.0), ("..", "b", "calls", "f.py", None, 1.0)]
    seen = set()
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        g = build_graph(nodes_of(spark, nodes), spark.createDataFrame(rows, "source string, target string, relation string, source_file string, confidence string, weight double").repartition(3))
        e = {(r.source, r.target): r for r in g.edges.collect()}
        assert set(e) == {("a", "b"), ("b", "zz")}
        r = e["a", "b"]
        seen.add((r.relation, tuple(r.relations), r.source_file, r.weight))
        assert {(r.id, r.kind) for r in g.nodes.collect()} == {("a", "function"), ("b", "file"), ("zz", "unknown")}
    assert seen == {("calls", ("calls", "imports"), "h.py", 4.0)}


def test_merging(spark):
    rows = [("a", "b", "calls", "f.py", "L2", 1.0), ("a", "b", "calls", "f.py", "L10", 2.0), ("a", "b", "imports", "f.py", "L1", 1.0)]
    got = {r.relation: (r.source_location, r.weight) for r in merge_edges(spark.createDataFrame(rows, "source string, target string, relation string, source_file string, source_location string, weight double")).collect()}
    assert got == {"calls": ("L10", 3.0), "imports": ("L1", 1.0)}
    assert dedupe_nodes(nodes_of(spark, [("a", "x", "n", "b.py"), ("a", "y", "n", "a.py")])).first().kind == "y"


def test_search(spark):
    nodes = nodes_of(spark, FIVE)
    first = lambda q: search.search(nodes, q).first()
    assert (first("acceptPairing").match_type, first("acceptPairing").score) == ("name", 1.0)
    assert first("web/sync.js").id == "web_sync" == first("web\\sync.js").id
    assert first("src_app_main").match_type == "exact-id"
    assert search.search(nodes, "sync").first().total_matches == 3
    with pytest.raises(ValueError):
        search.search(nodes, " ` ")
    got = lambda t: [(r.id, r.match_type) for r in search.resolve(nodes, t).orderBy("place").collect()]
    assert got("MAIN") == [("src_app_main", "name")]
    assert got("sync.js")[0] == ("web_sync", "name") and got("b/sync.js")[0] == ("web_sync", "path-suffix")
    assert got("scanner") == [("web_sync_openscanner", "fuzzy")] and got("none such") == []
    assert [r.id for r in search.candidates(nodes, "sync scanner thing").collect()][0] == "web_sync_openscanner"


def plain_path(edges, a, b, depth):
    """Breadth first, neighbours in order."""
    out = {}
    for x, y in sorted(edges):
        out.setdefault(x, []).append(y)
    queue, seen, cut = [[a]], {a}, False
    if a == b:
        return [a], False
    for p in queue:
        for y in out.get(p[-1], []):
            if len(p) - 1 == depth:
                cut |= y not in seen
            elif y not in seen:
                if y == b:
                    return [*p, y], False
                seen.add(y)
                queue.append([*p, y])
    return None, cut


def test_paths(spark):
    rng = random.Random(1)
    for depth in (2, 5):
        ids = [f"n{i}" for i in range(9)]
        pairs = {(a, b) for a, b in itertools.permutations(ids, 2) if rng.random() < 0.18}
        g = graph_of(spark, sorted(pairs))
        for _ in range(3):
            a, b = rng.sample(sorted({x for p in pairs for x in p}), 2)
            assert traverse.path(g, a, b, depth) == plain_path(pairs, a, b, depth)


def plain_cycles(pairs):
    ids, out = sorted({x for p in pairs for x in p}), []
    for n in range(2, len(ids) + 1):
        for c in itertools.permutations(ids, n):
            if c[0] == min(c) and all((a, b) in pairs for a, b in zip(c, (*c[1:], c[0]), strict=True)):
                out.append(list(c))
    return sorted(out, key=lambda c: (len(c), c))


def test_cycles(spark):
    pairs = [("b", "a"), ("a", "b"), ("d", "c"), ("c", "d"), ("f", "e"), ("e", "f"), ("g", "h"), ("h", "i"), ("i", "g"), ("i", "z")]
    got = [r.nodes for r in metrics.cycles(edges_of(spark, pairs), 20).collect()]
    assert got == [["a", "b"], ["c", "d"], ["e", "f"], ["g", "h", "i"]]
    assert [r.nodes for r in metrics.cycles(edges_of(spark, pairs[::-1]), 2).collect()] == got[:2]
    rng = random.Random(3)
    pairs = [(a, b) for a, b in itertools.permutations("abcdef", 2) if rng.random() < 0.5]
    assert [r.nodes for r in metrics.cycles(edges_of(spark, pairs), 500).collect()] == plain_cycles(set(pairs))
    assert metrics.cycles(edges_of(spark, [("a", "b")])).count() == 0


def test_health_and_grades(spark):
    def made(ext, bound, unbound, relation="calls"):
        nodes = [("me", "function", "me", f"a{ext}")] + [(f"b{i}", "function", "b", "b.py") for i in range(bound)]
        edges = [("me", f"b{i}") for i in range(bound)] + [("me", f"u{i}") for i in range(unbound)]
        return build_graph(nodes_of(spark, nodes), edges_of(spark, edges, relation).withColumn("source_file", F.lit(f"a{ext}")))

    def grade(g, language, empty, relation="calls"):
        asked = spark.createDataFrame([("q", relation, language, empty)], "question string, relation string, language string, empty boolean")
        return health.grades(health.cells(g), asked).first().grade

    assert grade(made(".py", 8, 2), "python", False) == "decision_grade"
    assert grade(made(".py", 8, 2), "python", True) == "advisory"
    assert grade(made(".py", 7, 3), "python", False) == "advisory" and grade(made(".py", 7, 3), "python", True) == "inconclusive"
    assert grade(made(".py", 8, 2), "go", True) == "inconclusive"
    assert grade(made(".py", 9, 1, "imports"), "python", True, "imports") == "decision_grade"
    assert grade(made(".ts", 9, 1, "imports"), "typescript", True, "imports") == "advisory"
    assert not health.healthy(health.cells(made(".py", 7, 3))).first().healthy
    assert health.caveats(spark, ["calls"], ["python"], True).count() == 2 and health.caveats(spark, ["calls"], ["python"], False).count() == 1


def test_validation(spark):
    nodes = nodes_of(spark, [("a", "file", "a", "../a"), ("a", "file", "a", "a.py"), ("", None, "x", None), ("b", "file", "b", "b.py")])
    edges = edges_of(spark, [("a", "a"), ("a", "zz"), ("b", "a"), ("b", "a"), ("", "a")])
    clusters = spark.createDataFrame([(0, ["a", "gone"])], "id int, members array<string>")
    issues = health.validate(nodes, edges, 3, 5, clusters)
    assert {(r.severity, r.code, r.subject): r.n for r in issues.collect()} == {
        ("error", "node_id_missing", ""): 1, ("error", "node_id_duplicate", "a"): 1, ("error", "absolute_source_file", "a"): 1, ("error", "edge_source_missing", " -> a"): 1, ("error", "edge_target_unknown", "a -> zz"): 1,
        ("warning", "edge_duplicate", "b -> a (calls)"): 1, ("error", "metadata_node_count", "4"): 1, ("warning", "cluster_member_unknown", "gone"): 1,
    }
    report = health.validation_report(issues).first()
    assert (report.ok, report.error_count, report.warning_count) == (False, 6, 2)
    assert health.validate(nodes_of(spark, FIVE), edges_of(spark, [("src_app", "web_sync")])).count() == 0
    assert [r.code for r in health.validate(nodes.where("false"), edges.where("false")).collect()] == ["empty_graph"]


def test_bundle_types(spark):
    texts = ['{"nodes": [], "edges": [], "metadata": {}}', '{"nodes": 1, "edges": [1, {}], "clusters": [3, {"members": "x"}, {}], "analysis": []}', "[]", "{", None]
    found = {r.code: (r.severity, r.n) for r in health.bundle_types(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert found == {
        "nodes_type": ("error", 1), "edge_type": ("error", 1), "metadata_type": ("error", 1), "cluster_type": ("warning", 1), "cluster_members_type": ("warning", 1), "analysis_type": ("warning", 1),
        "graph_invalid": ("error", 1), "graph_invalid_json": ("error", 2),
    }
    assert health.bundle_types(spark.createDataFrame([(texts[0],)], "text string")).count() == 0


def test_plans(spark):
    assert build("callers helper").json() == {"operation": "callers", "targets": [{"role": "node", "input": "helper"}], "options": {"max_results": 200}, "source": "query", "plan_version": 1}
    assert build("reaches main -> helper").options == {"max_depth": 32} and build("in x").operation == "imported-by" and build("stats").targets == ()
    for text, code in (("", "empty_query"), ("fly x", "unknown_query_verb"), ("path a", "invalid_query_format"), ("stats x", "invalid_query_format"), ("callers", "invalid_query_format")):
        with pytest.raises(PlanError) as e:
            build(text)
        assert e.value.code == code
    for bad in (Plan("callers", (("node", "x"),), {"max_results": 0}), Plan("callers", (("source", "x"),)), Plan("none"), Plan("stats", plan_version=2)):
        with pytest.raises(PlanError):
            check(bad)
    g = graph_of(spark, [("main", "helper"), ("other", "helper")])
    rows, how = execute(build("callers helper"), g)
    assert [r.id for r in rows.collect()] == ["main", "other"] and how[0]["type"] == "exact-id"
    assert execute(build("reaches main -> helper"), g)[0].first().path == ["main", "helper"]
    with pytest.raises(PlanError) as e:
        execute(build("callers helpers"), g)
    assert e.value.code == "node_not_found"
    assert len(capabilities()) == 8


def test_natural():
    t = natural.translate
    assert t("Who calls `parse`?").targets == (("node", "parse"),)
    assert t("shortest path from the app module to b").operation == "path"
    assert t("what tests cover src/a.py") == ("impact", "src/a.py") and t("tell me about x") == ("context", "x")
    assert t("who calls the") == ("search", "calls") and t("where are widgets") == ("search", "widgets")
    with pytest.raises(PlanError):
        t("what is it?")


def test_communities(spark):
    pairs = [(a, b) for group in ("abcd", "efgh", "ijkl") for a, b in itertools.combinations(group, 2)] + [("a", "e"), ("h", "i")]
    g = graph_of(spark, pairs)
    found = communities.louvain(g.nodes, g.edges)
    groups = {}
    for r in found.collect():
        groups.setdefault(r.community, set()).add(r.id)
    assert sorted(map(sorted, groups.values())) == [list("abcd"), list("efgh"), list("ijkl")]
    nodes = spark.createDataFrame([("f1", "function", "src/pkg/a.py", 0), ("f2", "function", "src/pkg/b.py", 0), ("c1", "class", "src/pkg/c/d.py", 0), ("c2", "class", "src/pkg/e.py", 0)], "id string, kind string, source_file string, community int")
    r = communities.rollup(nodes).first()
    assert (r["size"], r.folder, r.kind_label) == (4, "src/pkg", "classs")


def test_numbers_of_communities(spark):
    rows = spark.range(1000).selectExpr("id % 7 as n", "id as least").repartition(9)
    got = communities.numbered(rows, "i", communities.F.desc("n"), communities.F.col("least")).collect()
    assert [(r.n, r.least) for r in sorted(got, key=lambda r: r.i)] == sorted(((r.n, r.least) for r in got), key=lambda r: (-r[0], r[1])) and sorted(r.i for r in got) == list(range(1000))


def test_context_and_review(spark):
    g = graph_of(spark, [("a", "b"), ("b", "c"), ("d", "c")])
    got = {(r.section, r.item): r.total for r in context.context(g, ["c"]).collect()}
    assert got["dependent", "b"] == 2 and ("risk", "no_dependencies") in got
    assert context.review(g, ["src/mod.py"])["level"] == "medium" and context.review(g, ["package.json"])["level"] == "high"
    assert context.classify("Fix login session", 1, 0, False) == {"category": "authentication", "risk": "high", "complexity": 6, "broad_impact": False}
    assert context.classify("update the docs", 1, 25, False)["risk"] == "medium"
    found, cut = traverse.neighbourhood(g, spark.createDataFrame([("a",)], "id string"), 2)
    assert found.count() == 2 and cut
