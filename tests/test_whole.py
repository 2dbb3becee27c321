"""Registered queries of the graph engine over rows that a filter or a cap in them would leave out."""

from lodestone import registry
from lodestone.operators.build import dispatch_methods


def stored(spark, tmp_path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_worst_status_reads_every_event(spark, tmp_path):
    rows = [(7, 1, "signup"), (8, 1, "error"), (9, 2, "purchase"), (10, 2, "view"), (14, 3, "click")]
    at = stored(spark, tmp_path, events=(rows, "event_id long, user_id long, event_type string"))
    assert {r.user_id: r.status for r in registry.QUERIES["worst_status"](spark, at).collect()} == {1: "blocked", 2: "degraded", 3: "ready"}


def test_method_dispatch_sends_every_line(spark, tmp_path):
    """Order 1 calls part 1 twice, which shares its name with part 5, and part 2 in its last line."""
    parts = [(1, "A", 1), (5, "A", 1), (2, "B", 1)]
    lines = [(1, 1, 1), (1, 1, 2), (1, 2, 3), (5, 1, 2)]
    at = stored(spark, tmp_path, part=(parts, "p_partkey long, p_brand string, p_size int"), lineitem=(lines, "l_orderkey long, l_partkey long, l_linenumber int"))
    got = sorted((r.source, r.target) for r in registry.QUERIES["method_dispatch"](spark, at).collect())
    # Part 2 is of another language than order 1, so that call stays as it is.
    assert got == sorted([("orders_1", "part_1"), ("orders_1", "part_5")] * 2 + [("orders_1", "part_2")] + [("orders_5", "part_1"), ("orders_5", "part_5")])


def test_equal_calls_share_the_cap(spark):
    nodes = spark.createDataFrame([(f"m{i}", "run", "a.ts", True) for i in range(3)], "id string, name string, source_file string, is_method boolean")
    edges = spark.createDataFrame([("x", "run", "calls", "LOCAL_CALL", "b.ts", "run")] * 2, "source string, target string, relation string, confidence string, source_file string, called string")
    imports = spark.createDataFrame([], "source_file string, target_file string")
    assert sorted(r.target for r in dispatch_methods(edges, nodes, imports).collect()) == ["m0", "m0", "m1", "m1", "m2", "m2"]
    assert dispatch_methods(edges, nodes, imports, most=2).count() == 0


def test_longest_prefix_registers_every_customer(spark, tmp_path):
    rows = [(k, f"Customer#{k:09d}") for k in range(1, 200)]
    at = stored(spark, tmp_path, customer=(rows, "c_custkey long, c_name string"))
    prefixes = {name[: 10 + k % 9] for k, name in rows}
    want = {name: max((name[:n] for n in range(len(name) + 1) if name[:n] in prefixes), key=len, default=None) for _, name in rows}
    assert {r.name: r.prefix for r in registry.QUERIES["longest_prefix"](spark, at).collect()} == want


def test_reach_component_is_whole(spark, tmp_path):
    person = "{0}_custkey long, {0}_name string, {0}_nationkey int"
    at = stored(
        spark,
        tmp_path,
        region=([(1, "ASIA"), (2, "EUROPE")], "r_regionkey int, r_name string"),
        nation=([(3, "INDIA", 1), (4, "JAPAN", 1), (5, "FRANCE", 2)], "n_nationkey int, n_name string, n_regionkey int"),
        customer=([(k, f"c{k}", 3 + k % 3) for k in range(900)], person.format("c")),
        supplier=([(1, "s", 4)], person.format("s").replace("s_custkey", "s_suppkey")),
        part=([], "p_partkey long, p_name string, p_brand string, p_size int"),
        orders=([], "o_orderkey long, o_custkey long"),
        lineitem=([], "l_orderkey long, l_partkey long, l_suppkey long, l_returnflag string"),
    )
    got = [(r.id, r.depth) for r in registry.QUERIES["reach_component"](spark, at).collect()]
    want = [("nation_3", 0), ("region_1", 1), ("nation_4", 2), ("supplier_1", 3)] + [(f"customer_{k}", 1 if k % 3 == 0 else 3) for k in range(900) if k % 3 < 2]
    assert sorted(got) == sorted(want)
