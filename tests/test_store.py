"""The graph store, authority and channel operators, and cases that earlier versions got wrong."""

import datetime as dt

from pyspark.sql import functions as F

from lodestone.operators import authority, build, channel, ledger, metrics, traverse
from lodestone.operators.build import Graph, build_graph, dispatch_methods
from lodestone.sources import shared, store
from lodestone.sources.texts import eligible

EDGES = "source string, target string, relation string, source_file string, weight double"


def small(spark):
    nodes = spark.createDataFrame([(x, "function", x, f"src/{x}.py") for x in "abcde"], "id string, kind string, name string, source_file string")
    edges = spark.createDataFrame([("a", "b", "calls", "src/a.py", 1.0), ("b", "c", "calls", "src/b.py", 1.0), ("a", "c", "calls", "src/a.py", 1.0), ("c", "z", "imports", "src/c.py", 1.0), ("d", "a", "calls", "src/d.py", 1.0)], EDGES)
    return build_graph(nodes, edges, ascii_ids=True)


def test_a_graph_is_built_once_and_again_when_its_files_change(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return small(spark)

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f").write_text("one")
    fresh = small(spark)
    for _ in range(2):
        got = store.stored(spark, "test", [str(tmp_path / "in")], make)
    assert len(calls) == 1
    rows = lambda df: sorted(map(str, df.select("source", "target", "relation", "weight").collect()))
    assert rows(got.edges) == rows(got.into) == rows(fresh.edges)
    deg = {r.id: (r.in_degree, r.out_degree) for r in got.nodes.collect()}
    assert deg["c"] == (2, 1) and deg["z"] == (1, 0) and deg["e"] == (0, 0)
    (tmp_path / "in" / "f").write_text("other")
    store.stored(spark, "test", [str(tmp_path / "in")], make)
    assert len(calls) == 2
    assert store.forget(spark) >= 2


def test_levels_leave_one_table(spark):
    shared.sweep(spark)
    found = traverse.reachable(small(spark), spark.createDataFrame([("a",)], "id string"), 5)
    assert {r.id: r.depth for r in found.collect()} == {"a": 0, "b": 1, "c": 1, "z": 2}
    assert shared.sweep(spark) == 1


def test_surprising_against_plain_python(spark):
    import random

    rng = random.Random(8)
    pairs = {(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for _ in range(40)}
    pairs = {(a, b) for a, b in pairs if a != b}
    nodes = spark.createDataFrame([(f"n{i}", "function", "x", "f.py") for i in range(12)], "id string, kind string, name string, source_file string")
    g = build_graph(nodes, spark.createDataFrame([(a, b, "calls", "f.py", 1.0) for a, b in pairs], EDGES), ascii_ids=True)
    into, out = {}, {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
        into.setdefault(b, set()).add(a)
    want = sorted((a, b) for a, b in pairs if not into.get(a, set()) & into.get(b, set()) and not out.get(a, set()) & out.get(b, set()))
    assert [(r.source, r.target) for r in metrics.surprising(g, 100).collect()] == want


def shuffled(spark) -> int:
    """Rows written to shuffles so far."""
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    gateway = spark.sparkContext._gateway
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_surprising_meets_only_edges_that_can_close_a_triangle(spark):
    # Every function calls every one of 60, and none calls on: pairs of the 60 below each function would be 531,000 rows.
    rows = [(f"f{i}", f"t{k}", "calls", "f.py", 1.0) for i in range(300) for k in range(60)] + [("a", "b", "calls", "f.py", 1.0), ("b", "c", "calls", "f.py", 1.0), ("a", "c", "calls", "f.py", 1.0)]
    names = {x for r in rows for x in r[:2]}
    nodes = spark.createDataFrame([(x, "function", x, "f.py") for x in names], "id string, kind string, name string, source_file string")
    g = build_graph(nodes, spark.createDataFrame(rows, EDGES), ascii_ids=True)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as with large tables, joins shuffle
    try:
        before = shuffled(spark)
        got = [(r.source, r.target) for r in metrics.surprising(g, 3).collect()]
        rows = shuffled(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert got == [("a", "c"), ("f0", "t0"), ("f0", "t1")]
    assert rows < 300_000


def test_surprising_looks_beyond_its_first_edges(spark, monkeypatch):
    monkeypatch.setattr(metrics, "FIRST", 2)
    monkeypatch.setattr(metrics, "SMALL", 0)  # and nothing is broadcast as small
    rows = [(f"a{i}", f"gone{i}", "calls", "f.py", 1.0) for i in range(9)] + [("x", "y", "calls", "f.py", 1.0), ("y", "z", "calls", "f.py", 1.0)]
    nodes = spark.createDataFrame([(x, "function", x, "f.py") for x in (*(f"a{i}" for i in range(9)), "x", "y", "z")], "id string, kind string, name string, source_file string")
    g = build_graph(nodes, spark.createDataFrame(rows, EDGES), ascii_ids=True)
    assert [(r.source, r.target) for r in metrics.surprising(g, 2).collect()] == [("x", "y"), ("y", "z")]


def broadcast(spark, since: int = 0) -> tuple[int, int]:
    """The most rows of a broadcast since so many executions, and the number of executions so far."""
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    status = spark._jsparkSession.sharedState().statusStore()
    runs, most = status.executionsList(), 0
    for run in (runs.apply(i) for i in range(runs.size())):
        if run.executionId() >= since:
            nodes, values = status.planGraph(run.executionId()).allNodes(), status.executionMetrics(run.executionId())
            for node in (nodes.apply(i) for i in range(nodes.size())):
                for m in (node.metrics().apply(i) for i in range(node.metrics().size())):
                    if node.name() == "BroadcastExchange" and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most, max((runs.apply(i).executionId() for i in range(runs.size())), default=-1) + 1


def test_surprising_broadcasts_only_what_is_counted_as_small(spark, tmp_path, monkeypatch):
    # Files of stored ids are a few kB, so Spark by itself would broadcast all nodes, edges and ids here.
    monkeypatch.setattr(metrics, "SMALL", 100)
    monkeypatch.setattr(metrics, "FIRST", 20)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f").write_text("triangles")
    rows = [(s + str(i), t + str(i), "calls", "f.py", 1.0) for i in range(100, 400) for s, t in ("ab", "bc", "ac")]
    # c100 to c389 are no project's nodes, so the first edges don't suffice.
    names = [x + str(i) for i in range(100, 400) for x in "abc" if x != "c" or i >= 390]
    nodes = spark.createDataFrame([(x, "function", x, "f.py") for x in names], "id string, kind string, name string, source_file string")
    g = store.stored(spark, "triangles", [str(tmp_path / "in")], lambda: build_graph(nodes, spark.createDataFrame(rows, EDGES), ascii_ids=True))
    since = broadcast(spark)[1]
    got = [(r.source, r.target) for r in metrics.surprising(g, 30).collect()]
    assert got == [(f"a{i}", f"c{i}") for i in range(390, 400)]
    assert broadcast(spark, since)[0] <= 100
    store.forget(spark)


def test_a_store_in_parts_holds_the_same_graph(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f").write_text("some")
    fresh = small(spark)
    monkeypatch.setattr(store, "PART", 1)
    got = store.stored(spark, "parts", [str(tmp_path / "in")], lambda: small(spark))
    rows = lambda df: sorted(map(str, df.select(*fresh.edges.columns).collect()))
    assert rows(got.edges) == rows(got.into) == rows(fresh.edges)
    nodes = lambda df: sorted(map(str, df.select(*fresh.nodes.columns).collect()))
    assert nodes(got.nodes) == nodes(fresh.nodes)
    assert {(r.id, r.in_degree, r.out_degree) for r in got.nodes.collect()} == {(r.id, r.in_degree, r.out_degree) for r in metrics.degrees(fresh).collect()}


def test_a_written_table_leaves_no_shuffle_files(spark):
    import time

    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {x.getName() for x in (f.apply(i) for f in [blocks.getAllFiles()] for i in range(f.size())) if x.getName().startswith("shuffle_")}
    before = files()
    df = shared.cut(spark.range(1000).repartition(3, "id"))
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and df.count() == 1000
    shared.drop(df)


def test_dispatch_fails_open_and_counts_methods_once(spark):
    nodes = [("m1", "Run", "a.ts", True), ("m2", "run", "b.js", True), ("m2", "run", "b.js", True), ("m3", "run", "x.unknown", True), ("m4", "run", "c.py", True), ("f", "other", "a.ts", False)]
    nodes = spark.createDataFrame(nodes, "id string, name string, source_file string, is_method boolean")
    rows = [("t", "run", "calls", "LOCAL_CALL", "t.ts", "run"), ("t", "run", "calls", "LOCAL_CALL", "t.ts", "run"), ("p", "run", "calls", "LOCAL_CALL", "p.py", "RUN"), ("q", "run", "calls", "LOCAL_CALL", "q.py", "run"), ("u", "f", "calls", "LOCAL_CALL", "u.go", "nothing"), ("v", "run", "calls", "EXTERNAL_CALL", "v.ts", "run")]
    edges = spark.createDataFrame(rows, "source string, target string, relation string, confidence string, source_file string, called string")
    imports = spark.createDataFrame([("p.py", "c.py")], "source_file string, target_file string")
    got = sorted((r.source, r.target) for r in dispatch_methods(edges, nodes, imports).collect())
    # A TypeScript caller meets js methods and the one of no known kind; the Python one only what it imports.
    assert got == sorted([("t", "m1"), ("t", "m2"), ("t", "m3")] * 2 + [("p", "m4"), ("u", "f"), ("v", "run")])


def test_hidden_folders_are_not_scanned(spark):
    rows = [(".github/x.yml", False), (".idea/y.py", False), ("src/a.py", True), ("src/.hidden.py", False), ("out/a.py", False), ("outer/a.py", True)]
    df = spark.createDataFrame(rows, "p string, want boolean").withColumn("got", eligible(F.col("p"), outputs=("out",)))
    assert all(r.got == r.want for r in df.collect())
    assert df.select(eligible(F.lit(".github/x.yml"), dotfiles=True).alias("x")).first().x


def test_identity_changes_in_order(spark):
    base = {"digest": "d", "version": "1.2.3", "model_digest": "m", "routing_policy_digest": "r", "capabilities": ["a", "b"], "policy_version": "p", "runtime_digest": "x", "provider": "v", "runtime_kind": "endpoint"}
    cases = [
        ({}, "unchanged"), ({"version": "2.0.0", "model_digest": "n"}, "major"), ({"version": "1.3.0", "model_digest": "n"}, "minor"), ({"model_digest": "n", "policy_version": "q"}, "model_digest"),
        ({"routing_policy_digest": "s", "capabilities": []}, "routing_policy"), ({"capabilities": ["a"], "policy_version": "q"}, "capability"), ({"policy_version": "q", "runtime_digest": "y"}, "policy"),
        ({"runtime_digest": "y", "version": "1.2.4"}, "endpoint"), ({"version": "1.2.4"}, "patch"), ({"provider": "w"}, "boundary_invalid"), ({"capabilities": ["b", "a"]}, "unclassified"),
    ]
    rows = [(base, {**base, **({"digest": "e"} if change else {}), **change}, want) for change, want in cases]
    local = {**base, "runtime_kind": "local_cli"}
    rows += [(local, {**local, "digest": "e", "runtime_digest": "y"}, "hash_only"), (None, base, None)]
    kind = "struct<digest: string, version: string, model_digest: string, routing_policy_digest: string, capabilities: array<string>, policy_version: string, runtime_digest: string, provider: string, runtime_kind: string>"
    df = spark.createDataFrame(rows, f"before {kind}, after {kind}, want string").withColumn("got", authority.identity_change())
    assert [r.got for r in df.collect()] == [r.want for r in df.collect()]


def test_consumption_is_single_use_and_within_budget(spark):
    approvals = spark.createDataFrame([(1, "n", "m", "issued", 100, 5), (2, "n", "m", "consumed", 100, 5), (3, "n", "m", "invalidated", 100, 5)], "approval_id long, nonce string, manifest string, status string, expires_at long, reserved long")
    asks = [(1, "n", "m", 50, 5), (1, "x", "m", 50, 5), (1, "n", "m", 100, 5), (1, "n", "m", 50, 6), (2, "n", "m", 50, 5), (3, "n", "m", 50, 5), (9, "n", "m", 50, 5)]
    requests = spark.createDataFrame(asks, "approval_id long, nonce string, manifest string, now long, tokens long")
    ledger_ = spark.createDataFrame([("reservation", 90), ("refund", 1000)], "entry_type string, tokens long")
    want = ["consumed", "approval_manifest_changed", "approval_expired", "approval_manifest_changed", "approval_reused", "approval_lifecycle_stale", "approval_missing"]
    code = {tuple(r)[:5]: r.code for r in authority.consumption(requests, approvals, ledger_, 95).collect()}
    assert [code[a] for a in asks] == want
    assert {r.code for r in authority.consumption(requests.limit(1), approvals, ledger_, 94).collect()} == {"budget_exhausted"}
    after, entries = authority.after_consumption(authority.consumption(requests, approvals, ledger_, 95), approvals)
    assert {r.approval_id: r.status for r in after.collect()} == {1: "consumed", 2: "consumed", 3: "invalidated"}
    assert [(r.entry_id, r.tokens) for r in entries.collect()] == [("reserve:1", 5)]


def test_channel(spark):
    at = dt.datetime(2024, 1, 1)
    rounds = spark.createDataFrame([(1, "a", ["b"], None, "r/1"), (2, "b", ["a", "c"], 9, "r/2"), (3, None, ["a"], 1, "r/3")], "round long, author string, to array<string>, supersedes long, path string")
    events = spark.createDataFrame([(1, 1, "delivered", "b", at, False), (1, 2, "done", "b", at, False), (2, 1, "done", "x", at, False), (2, 2, "delivered", "a", at, False), (3, 1, "delivered", "q", at, True)], "round long, seq long, status string, actor string, at timestamp, malformed boolean")
    files = spark.createDataFrame([("r/1", True, False, 1, "a", "a"), ("r/2", True, False, 2, "b", "b"), ("r/3", True, False, 3, None, None)], "path string, tracked boolean, dirty boolean, commits long, origin_author string, origin_agent string")
    assert [r.round for r in channel.inbox(rounds, events, "c").collect()] == [2]
    assert [r.round for r in channel.inbox(rounds, events, "a").collect()] == [3]
    rows = {r.round: r for r in channel.report(rounds, events, files, F.lit(dt.datetime(2024, 1, 9)), 3).collect()}
    assert [(rows[i].verification, rows[i].stalled, rows[i].open) for i in (1, 2, 3)] == [("verified", False, False), ("modified", True, True), ("legacy", True, True)]
    assert sorted((r.round, r.kind) for r in channel.anomalies(rounds, events).collect()) == [(2, "done_without_delivery"), (2, "status_actor_not_participant"), (2, "supersedes_missing"), (3, "malformed_status")]


def test_one_row_tables(spark):
    old, new = spark.createDataFrame([(1, "a")], "at long, v string"), spark.createDataFrame([(2, "b")], "at long, v string")
    assert ledger.upsert_one(old, new, "at").first().v == "b"
    assert ledger.upsert_one(old.limit(0), new.limit(0), "at").count() == 0
    assert authority.newest(old.union(new), ["at"], 1).first().v == "b"
    assert isinstance(small(spark), Graph) and not hasattr(build, "ordered")
