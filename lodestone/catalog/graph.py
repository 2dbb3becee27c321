"""Queries over the commerce graph and the event graph."""

from __future__ import annotations

import inspect
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import columns, ids
from lodestone.operators import build, health, metrics, search, traverse
from lodestone.operators.build import Graph, build_graph, dedupe_nodes, dispatch_methods, merge_edges
from lodestone.operators.context import context, review
from lodestone.plans import plan
from lodestone.sources import store, tables


SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def built(spark, sf_dir) -> Graph:
    return build_graph(tables.commerce_nodes(spark, sf_dir), tables.commerce_edges(spark, sf_dir), ascii_ids=True)


def _recipe() -> str:
    """What the stored graph was made by: another text of these modules makes another store."""
    return "commerce" + "".join(inspect.getsource(m) for m in (tables, build, columns, ids, store))


def commerce(spark, sf_dir) -> Graph:
    """The commerce graph from the store: built by the first query over these files, read by all others."""
    return store.stored(spark, _recipe(), [f"{sf_dir}/{t}.parquet" for t in SOURCES], lambda: built(spark, sf_dir))


def _graph(f, spark, sf_dir):
    return f(commerce(spark, sf_dir))


def _path(name: str, key: str) -> str:
    return f"'src/{name}/' || CASE WHEN {key} % 10 = 0 THEN 'tests/' ELSE '' END || {key} || CASE {key} % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.rs' ELSE '.go' END"


def _nodes() -> str:
    out = []
    for name, (key, label, kind) in tables.ENTITIES.items():
        where = f" WHERE {key} % 7 <> 0" if name == "part" else ""
        out.append(f"SELECT '{name}_' || {key} AS id, '{kind}' AS kind, {label or f"'{name}_' || {key}"} AS name, {_path(name, key)} AS source_file FROM {name}{where}")
    return " UNION ALL ".join(out)


def _edge(table, source, s, target, t, relation, confidence="'EXTRACTED'", where="") -> str:
    return f"SELECT '{source}_' || {s} AS source, '{target}_' || {t} AS target, '{relation}' AS relation, {_path(source, s)} AS source_file, {confidence} AS confidence FROM {table} {where}"


def _edges() -> str:
    called = "CASE WHEN l_partkey % 14 = 0 THEN 'EXTERNAL_CALL' WHEN l_partkey % 7 = 0 THEN 'EXTRACTED' ELSE 'LOCAL_CALL' END"
    return " UNION ALL ".join([
        _edge("customer", "customer", "c_custkey", "nation", "c_nationkey", "imports"),
        _edge("supplier", "supplier", "s_suppkey", "nation", "s_nationkey", "imports"),
        _edge("nation", "nation", "n_nationkey", "region", "n_regionkey", "contains"),
        _edge("orders", "orders", "o_orderkey", "customer", "o_custkey", "calls", "'LOCAL_CALL'"),
        _edge("lineitem", "orders", "l_orderkey", "part", "l_partkey", "calls", called),
        _edge("lineitem", "orders", "l_orderkey", "supplier", "l_suppkey", "references"),
        _edge("lineitem", "orders", "l_orderkey", "supplier", "l_suppkey", "calls", "'LOCAL_CALL'", "WHERE l_returnflag = 'R'"),
    ])


#: The commerce graph in SQL: nodes and edges as build_graph() makes them.
G = f"""raw_nodes AS ({_nodes()}), raw_edges AS ({_edges()}),
    edges AS (SELECT source, target, min(relation) AS relation, list_sort(list(DISTINCT relation)) AS relations, CAST(count(*) AS DOUBLE) AS weight,
              arg_min(confidence, relation || confidence) AS confidence, min(source_file) AS source_file FROM raw_edges GROUP BY source, target),
    nodes AS (SELECT id, kind, name, source_file FROM raw_nodes UNION ALL
              SELECT DISTINCT target, 'unknown', target, NULL FROM edges WHERE target NOT IN (SELECT id FROM raw_nodes)),
    deg AS (SELECT id, kind, source_file, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree FROM nodes
            LEFT JOIN (SELECT target AS id, count(*) AS n FROM edges GROUP BY 1) i USING (id) LEFT JOIN (SELECT source AS id, count(*) AS n FROM edges GROUP BY 1) o USING (id))"""
CALLED = "(list_contains(relations, 'calls') OR list_contains(relations, 'references'))"
EXT = "regexp_extract(coalesce({0}, ''), '[.]([a-z]+)$', 1)"
LANGUAGE = f"CASE {EXT.format('source_file')} WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'rs' THEN 'rust' WHEN 'go' THEN 'go' ELSE 'other' END"
CELLS = f"""x AS (SELECT {LANGUAGE.replace("source_file", "e.source_file")} AS language, r.relation, n.kind <> 'unknown' AS b,
              n.kind = 'unknown' AND e.confidence = CASE r.relation WHEN 'calls' THEN 'EXTERNAL_CALL' ELSE 'EXTERNAL_IMPORT' END AS x
         FROM (SELECT source, target, confidence, source_file, unnest(relations) AS relation FROM edges) r JOIN edges e ON e.source = r.source AND e.target = r.target JOIN nodes n ON n.id = r.target
         WHERE r.relation IN ('calls', 'imports')),
    cells AS (SELECT language, relation, count(*) FILTER (NOT x) AS total, count(*) FILTER (b) AS bound, count(*) FILTER (x) AS external FROM x GROUP BY GROUPING SETS ((relation), (language, relation)))"""
PROJECT = "kind IN ('file', 'function', 'class')"


def degree_rank(spark, sf_dir):
    return _graph(metrics.god_nodes, spark, sf_dir)


def imports_only(g: Graph) -> Graph:
    return g.only("imports", "contains")


def listing(spark, sf_dir, token, out, relations=()) -> DataFrame:
    g = commerce(spark, sf_dir)
    node = search.resolve_id(g.nodes, token)
    rows = traverse.listed(traverse.neighbours(g, node, out, relations))
    return rows.select("id", "name", "kind", "relation", "weight", "total", "truncated")


def _listing_sql(token, mine, other, where="") -> str:
    return f"""WITH {G}, r AS (SELECT n.id, n.name, n.kind, e.relation, e.weight FROM edges e JOIN nodes n ON n.id = e.{other} WHERE e.{mine} = '{token}' {where})
    SELECT *, CAST((SELECT count(*) FROM r) AS BIGINT) AS total, (SELECT count(*) FROM r) > 200 AS truncated FROM r ORDER BY id LIMIT 200"""


def impact_d2(spark, sf_dir):
    g = commerce(spark, sf_dir)
    return traverse.impact(g, traverse.starts_of(g.nodes, ["region_1"]), 2)


def reach(spark, sf_dir):
    g = commerce(spark, sf_dir)
    return traverse.reachable(g, traverse.starts_of(g.nodes, ["orders_1", "orders_7"]), 3)


def reach_undirected(spark, sf_dir):
    """A nation's component, whole."""
    g = commerce(spark, sf_dir)
    return traverse.reachable(imports_only(g), traverse.starts_of(g.nodes, ["nation_3"]), None, undirected=True)


def path_lexmin(spark, sf_dir, relations=()):
    g = commerce(spark, sf_dir)
    found, cut = traverse.path(g, "orders_1", "region_1" if not relations else "supplier_1", 32 if not relations else 3, relations)
    return spark.createDataFrame([(found is not None, len(found) - 1 if found else -1, ">".join(found or []), cut)], "found boolean, length int, path string, truncated boolean")


def shortest_lengths(spark, sf_dir):
    """How many nodes lie at each distance from one node."""
    return reach(spark, sf_dir).groupBy("depth").agg(F.count("*").alias("n"))


def health_cells(spark, sf_dir, by_language):
    found = _graph(health.cells, spark, sf_dir)
    return found.where("language is not null") if by_language else found.where("language is null").drop("language")


def answer_grade(spark, sf_dir):
    rows = [(q, r, lang, empty) for q, r, langs in (("callers", "calls", ["python", "go"]), ("importers", "imports", ["typescript", "python"]), ("elsewhere", "calls", ["javascript"])) for lang in langs for empty in (True, False)]
    asked = spark.createDataFrame(rows, "question string, relation string, language string, empty boolean")
    return health.grades(_graph(health.cells, spark, sf_dir), asked)


def validate_issues(spark, sf_dir):
    nodes, edges = tables.commerce_nodes(spark, sf_dir), tables.commerce_edges(spark, sf_dir)
    return health.validate(nodes, edges).groupBy("severity", "code").agg(F.sum("n").alias("n"))


def node_dedup(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "events").select(F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("id"), F.concat(F.lit("src/"), "event_type", F.lit("/"), F.col("event_id").cast("string")).alias("source_file"))
    return dedupe_nodes(rows)


def edge_merge(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("orders_"), F.col("l_orderkey").cast("string")).alias("source"), F.concat(F.lit("supplier_"), F.col("l_suppkey").cast("string")).alias("target"), F.col("l_returnflag").alias("relation"), F.lit("src/a.py").alias("source_file"), F.concat(F.lit("L"), F.col("l_linenumber").cast("string")).alias("source_location"), F.lit(1.0).alias("weight"))
    return merge_edges(rows).select("source", "target", "relation", "source_location", "weight")


def graph_edges(spark, sf_dir):
    return built(spark, sf_dir).edges.select("source", "target", "relation", F.array_join("relations", ",").alias("relations"), "confidence", "source_file", "weight")


def placeholder_nodes(spark, sf_dir):
    return built(spark, sf_dir).nodes.where("kind = 'unknown'").select("id", "name")


def method_dispatch(spark, sf_dir):
    """Orders call parts by brand, a bare name; parts are the methods, and share it many or few."""
    part, lines = tables.table(spark, sf_dir, "part"), tables.table(spark, sf_dir, "lineitem")
    name = F.concat(F.col("p_brand"), F.lit("_"), F.col("p_size").cast("string"))
    key = F.col("p_partkey").cast("long")
    nodes = part.where("p_partkey % 7 <> 0").select(tables.id_of("part", key).alias("id"), name.alias("name"), tables.path_of("part", key).alias("source_file"), F.lit(True).alias("is_method"))
    calls = lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
    order = F.col("l_orderkey").cast("long")
    edges = calls.select(tables.id_of("orders", order).alias("source"), tables.id_of("part", key).alias("target"), F.lit("calls").alias("relation"), F.when(key % 14 == 0, "EXTERNAL_CALL").otherwise("LOCAL_CALL").alias("confidence"), tables.path_of("orders", order).alias("source_file"), F.upper(name).alias("called"))
    imports = edges.select("source_file", F.lit("src/part/4.py").alias("target_file")).distinct()
    return dispatch_methods(edges, nodes, imports).select("source", "target", "confidence")


def _dispatch_sql() -> str:
    fam = lambda c: f"CASE {EXT.format(c)} WHEN 'py' THEN 'python' WHEN 'ts' THEN 'js' WHEN 'rs' THEN 'rust' ELSE 'go' END"
    return f"""WITH m AS (SELECT 'part_' || p_partkey AS id, lower(p_brand || '_' || p_size) AS nm, {_path("part", "p_partkey")} AS f FROM part WHERE p_partkey % 7 <> 0),
    e AS (SELECT 'orders_' || l_orderkey AS source, 'part_' || l_partkey AS target, CASE WHEN p_partkey % 14 = 0 THEN 'EXTERNAL_CALL' ELSE 'LOCAL_CALL' END AS confidence,
          {_path("orders", "l_orderkey")} AS f, lower(p_brand || '_' || p_size) AS nm FROM lineitem JOIN part ON l_partkey = p_partkey),
    a AS (SELECT DISTINCT f, nm FROM e WHERE confidence <> 'EXTERNAL_CALL'),
    c AS (SELECT a.f, a.nm, m.id FROM a JOIN m ON m.nm = a.nm WHERE ({fam("a.f")}) = ({fam("m.f")}) AND (({fam("a.f")}) <> 'python' OR a.f = m.f OR m.f = 'src/part/4.py')),
    s AS (SELECT * FROM c QUALIFY count(*) OVER (PARTITION BY f, nm) <= 3)
    SELECT e.source, s.id AS target, confidence FROM e JOIN s ON s.f = e.f AND s.nm = e.nm WHERE confidence <> 'EXTERNAL_CALL' UNION ALL
    SELECT source, target, confidence FROM e WHERE confidence = 'EXTERNAL_CALL' OR target IN (SELECT id FROM m) AND NOT EXISTS (SELECT 1 FROM s WHERE s.f = e.f AND s.nm = e.nm)"""


def event_cycles(spark, sf_dir):
    return metrics.cycles(tables.event_transitions(spark, sf_dir), top=84).select("length", F.array_join("nodes", ">").alias("cycle"))


def search_tiers(spark, sf_dir):
    return search.search(commerce(spark, sf_dir).nodes, "customer_12", 50)


def resolve_cascade(spark, sf_dir):
    nodes = commerce(spark, sf_dir).nodes
    out = None
    for token in ("part_3", "ASIA", "supplier/3.go", "tests/20.py", "omer_1", "nothing at all"):
        found = search.resolve(nodes, token).select(F.lit(token).alias("token"), "place", "id", "match_type")
        out = found if out is None else out.union(found)
    return out


def _resolve_sql() -> str:
    out = []
    for token in ("part_3", "asia", "supplier/3.go", "tests/20.py", "omer_1", "nothing at all"):
        raw = "ASIA" if token == "asia" else token
        out.append(f"""SELECT '{raw}' AS token, place - 1 AS place, id, way AS w FROM (SELECT *, row_number() OVER (ORDER BY (r <> 1), a, id) AS place FROM
            (SELECT *, min(way) OVER () AS least, row_number() OVER (ORDER BY way, (way = 2 AND kind <> 'file'), a, id) AS r FROM (SELECT id, kind, CASE WHEN id = '{token}' THEN 0 WHEN lower(name) = '{token}' THEN 1 WHEN ends_with(coalesce(source_file, ''), '{token}') THEN 2 WHEN contains(id, '{token}') THEN 3 END AS way,
             CASE WHEN id = '{token}' THEN 0 WHEN lower(name) = '{token}' THEN length(source_file) - length(replace(source_file, '/', '')) WHEN ends_with(coalesce(source_file, ''), '{token}') THEN 0 ELSE length(id) END AS a FROM nodes) WHERE way IS NOT NULL) WHERE way = least)
            WHERE place <= CASE way WHEN 0 THEN 1 WHEN 2 THEN 5 ELSE 4 END""")
    return f"WITH {G}, r AS ({' UNION ALL '.join(out)}) SELECT token, CAST(place AS INTEGER) AS place, id, CASE w WHEN 0 THEN 'exact-id' WHEN 1 THEN 'name' WHEN 2 THEN 'path-suffix' ELSE 'fuzzy' END AS match_type FROM r"


def near_candidates(spark, sf_dir):
    return search.candidates(commerce(spark, sf_dir).nodes, "nation/tests or customer", 40).select("id", "name", "kind", "hits")


def node_context(spark, sf_dir):
    return context(commerce(spark, sf_dir), ["nation_3", "orders_1"])


def review_packet(spark, sf_dir):
    g = commerce(spark, sf_dir)
    rows = [review(g, changes, deleted, stale) for changes, deleted, stale in ((["src/nation/3.go"], [], False), (["src/orders/1.ts", "README.md"], [], False), (["package.json"], ["x.py"], True))]
    return spark.createDataFrame([(i, r["level"], ",".join(r["flags"]), r["impacted"], r["tests"]) for i, r in enumerate(rows)], "packet int, level string, flags string, impacted int, tests int")


QUERIES = {
    "stats_kinds": partial(_graph, metrics.kinds),
    "stats_relations": partial(_graph, metrics.relations),
    "density": partial(_graph, metrics.density),
    "degree_rank": degree_rank,
    "busiest_in": lambda s, d: metrics.busiest(commerce(s, d), "in"),
    "busiest_out": lambda s, d: metrics.busiest(commerce(s, d), "out"),
    "plan_stats": lambda s, d: plan.query("stats", commerce(s, d)),
    "orphans": lambda s, d: metrics.orphans(imports_only(commerce(s, d))),
    "entry_points": partial(_graph, metrics.entry_points),
    "top_files": partial(_graph, metrics.top_files),
    "surprising": partial(_graph, metrics.surprising),
    "callers": lambda s, d: listing(s, d, "supplier_3", False, traverse.CALLS),
    "callees": lambda s, d: listing(s, d, "orders_1", True, traverse.CALLS),
    "depends_on": lambda s, d: listing(s, d, "customer_11", True),
    "imported_by": lambda s, d: listing(s, d, "nation_7", False),
    "impact_d2": impact_d2,
    "reach_depth3": reach,
    "reach_component": reach_undirected,
    "shortest_path_len": shortest_lengths,
    "path_lexmin": path_lexmin,
    "reaches_calls": lambda s, d: path_lexmin(s, d, traverse.CALLS),
    "search_tiers": search_tiers,
    "candidates": near_candidates,
    "resolve_cascade": resolve_cascade,
    "health_relation": lambda s, d: health_cells(s, d, False),
    "health_language": lambda s, d: health_cells(s, d, True),
    "healthy": lambda s, d: health.healthy(_graph(health.cells, s, d)),
    "answer_grade": answer_grade,
    "validate_issues": validate_issues,
    "node_dedup": node_dedup,
    "edge_merge": edge_merge,
    "graph_edges": graph_edges,
    "placeholder_nodes": placeholder_nodes,
    "method_dispatch": method_dispatch,
    "event_cycles": event_cycles,
    "node_context": node_context,
    "review_packet": review_packet,
}
HITS = " + ".join(f"CAST(contains(h, '{p}') AS INTEGER)" for p in ("nation", "tests", "customer"))
BFS = "WITH RECURSIVE {g}, r(id, depth) AS (SELECT {start}, 0 UNION SELECT {to}, depth + 1 FROM r JOIN edges ON {on} = id WHERE depth < {most})"
T = "CASE WHEN contains('/' || source_file, '/tests/') THEN 'likely_test' ELSE 'impacted_file' END"
PATH = """WITH RECURSIVE {g}, p(id, path) AS (SELECT 'orders_1', ['orders_1'] UNION ALL SELECT target, list_append(path, target) FROM p JOIN edges ON source = id WHERE {where} AND NOT list_contains(path, target)),
    b AS (SELECT path FROM p WHERE id = '{end}' ORDER BY len(path), path LIMIT 1)
    SELECT count(*) = 1 AS found, CAST(coalesce(max(len(path)) - 1, -1) AS INTEGER) AS length, coalesce(max(array_to_string(path, '>')), '') AS path, false AS truncated FROM b"""
ORACLE_SQL = {
    "stats_kinds": f"WITH {G} SELECT kind, count(*) AS n FROM nodes GROUP BY kind",
    "stats_relations": f"WITH {G} SELECT relation, count(*) AS n FROM edges GROUP BY relation",
    "density": f"WITH {G} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM edges) / CAST((SELECT count(*) FROM nodes) * ((SELECT count(*) FROM nodes) - 1) AS DOUBLE) AS density",
    "degree_rank": f"WITH {G} SELECT id, kind, in_degree, out_degree, in_degree + out_degree AS degree FROM deg WHERE {PROJECT} ORDER BY degree DESC, id LIMIT 20",
    "busiest_in": f"WITH {G} SELECT id, in_degree FROM deg ORDER BY in_degree DESC, id LIMIT 5",
    "busiest_out": f"WITH {G} SELECT id, out_degree FROM deg ORDER BY out_degree DESC, id LIMIT 5",
    "plan_stats": f"""WITH {G} SELECT 'kind' AS what, kind AS name, count(*) AS n FROM nodes GROUP BY kind
        UNION ALL SELECT 'relation', relation, count(*) FROM edges GROUP BY relation
        UNION ALL SELECT 'nodes', NULL, count(*) FROM nodes UNION ALL SELECT 'edges', NULL, count(*) FROM edges
        UNION ALL SELECT * FROM (SELECT 'in', id, in_degree FROM deg ORDER BY in_degree DESC, id LIMIT 5)
        UNION ALL SELECT * FROM (SELECT 'out', id, out_degree FROM deg ORDER BY out_degree DESC, id LIMIT 5)""",
    "orphans": f"WITH {G} SELECT id, kind, source_file FROM nodes WHERE {PROJECT} AND id NOT IN (SELECT source FROM edges WHERE relation IN ('imports', 'contains') UNION ALL SELECT target FROM edges WHERE relation IN ('imports', 'contains')) ORDER BY id LIMIT 20",
    "entry_points": f"WITH {G} SELECT id, in_degree, out_degree, out_degree / CAST(greatest(in_degree, 1) AS DOUBLE) AS ratio FROM deg WHERE kind = 'file' AND out_degree > 0 ORDER BY ratio DESC, id LIMIT 20",
    "top_files": f"WITH {G} SELECT id, source_file, in_degree + out_degree AS degree FROM deg WHERE kind = 'file' ORDER BY degree DESC, id LIMIT 20",
    "surprising": f"""WITH {G}, p AS (SELECT source, target, relation FROM edges WHERE target IN (SELECT id FROM raw_nodes)),
        c AS (SELECT p.source, p.target FROM p JOIN edges a ON a.target = p.source JOIN edges b ON b.source = a.source AND b.target = p.target
              UNION SELECT p.source, p.target FROM p JOIN edges a ON a.source = p.source JOIN edges b ON b.source = p.target AND b.target = a.target)
        SELECT * FROM p ANTI JOIN c USING (source, target) ORDER BY source, target LIMIT 20""",
    "callers": _listing_sql("supplier_3", "target", "source", f"AND {CALLED}"),
    "callees": _listing_sql("orders_1", "source", "target", f"AND {CALLED}"),
    "depends_on": _listing_sql("customer_11", "source", "target"),
    "imported_by": _listing_sql("nation_7", "target", "source"),
    "impact_d2": BFS.format(g=G, start="'region_1'", to="source", on="target", most=2) + f" SELECT DISTINCT source_file AS path, {T} AS what FROM (SELECT id, min(depth) AS depth FROM r GROUP BY id) JOIN nodes USING (id) WHERE depth > 0 OR {T} = 'likely_test'",
    "reach_depth3": BFS.format(g=G, start="unnest(['orders_1', 'orders_7'])", to="target", on="source", most=3) + " SELECT id, min(depth) AS depth FROM r WHERE id IN (SELECT id FROM nodes) GROUP BY id",
    "reach_component": f"""WITH RECURSIVE {G}, u AS (SELECT source AS a, target AS b FROM edges WHERE relation IN ('imports', 'contains') UNION ALL SELECT target, source FROM edges WHERE relation IN ('imports', 'contains')),
        r(id, depth) AS (SELECT 'nation_3', 0 UNION SELECT b, depth + 1 FROM r JOIN u ON a = id WHERE depth < 6) SELECT id, min(depth) AS depth FROM r GROUP BY id""",
    "shortest_path_len": BFS.format(g=G, start="unnest(['orders_1', 'orders_7'])", to="target", on="source", most=3) + " SELECT depth, count(*) AS n FROM (SELECT id, min(depth) AS depth FROM r WHERE id IN (SELECT id FROM nodes) GROUP BY id) GROUP BY depth",
    "path_lexmin": PATH.format(g=G, where="true", end="region_1"),
    "reaches_calls": PATH.format(g=G, where=CALLED, end="supplier_1"),
    "search_tiers": f"""WITH {G}, o AS (SELECT id, name, kind, coalesce(source_file, '') AS source_file, unnest([
            CASE WHEN id = 'customer_12' THEN {{'tier': 0, 'minus': -1.0::DOUBLE}} END, CASE WHEN lower(name) = 'customer_12' THEN {{'tier': 1, 'minus': -1.0::DOUBLE}} END,
            CASE WHEN ends_with(coalesce(source_file, ''), 'customer_12') THEN {{'tier': 2, 'minus': CASE kind WHEN 'file' THEN -1.0 ELSE -0.9 END::DOUBLE}} END,
            CASE WHEN contains(id, 'customer_12') AND id <> 'customer_12' THEN {{'tier': 3, 'minus': -floor(11.0::DOUBLE / length(id) * 1000 + 0.5) / 1000}} END,
            CASE WHEN contains(lower(name), 'customer_12') AND lower(name) <> 'customer_12' THEN {{'tier': 4, 'minus': -floor(11.0::DOUBLE / length(name) * 1000 + 0.5) / 1000}} END,
            CASE WHEN contains(id || ' ' || lower(name) || ' ' || coalesce(source_file, ''), 'customer') THEN {{'tier': 5, 'minus': -1.0::DOUBLE}} END]) AS x FROM nodes),
        b AS (SELECT id, name, kind, source_file, min(x) AS x FROM o WHERE x IS NOT NULL GROUP BY ALL)
        SELECT id, name, kind, source_file, ['exact-id', 'name', 'path-suffix', 'id-substring', 'name-substring', 'tokens'][x.tier + 1] AS match_type, -x.minus AS score, (SELECT count(*) FROM b) AS total_matches FROM b ORDER BY x.tier, x.minus, id LIMIT 50""",
    "candidates": f"WITH {G}, h AS (SELECT id, name, kind, lower(id || ' ' || name || ' ' || coalesce(source_file, '')) AS h FROM nodes) SELECT id, name, kind, {HITS} AS hits FROM h WHERE {HITS} > 0 ORDER BY hits DESC, id LIMIT 40",
    "resolve_cascade": _resolve_sql(),
    "health_relation": f"WITH {G}, {CELLS} SELECT relation, total, bound, external, CASE WHEN total > 0 THEN floor(bound / total::DOUBLE * 1000 + 0.5) / 1000 END AS ratio FROM cells WHERE language IS NULL",
    "health_language": f"WITH {G}, {CELLS} SELECT language, relation, total, bound, external, CASE WHEN total > 0 THEN floor(bound / total::DOUBLE * 1000 + 0.5) / 1000 END AS ratio FROM cells WHERE language IS NOT NULL",
    "healthy": f"WITH {G}, {CELLS} SELECT coalesce(bool_and(floor(bound / total::DOUBLE * 1000 + 0.5) / 1000 >= 0.8), true) AS healthy FROM cells WHERE language IS NULL AND total > 0",
    "answer_grade": f"""WITH {G}, {CELLS}, a(question, relation, language) AS (VALUES ('callers', 'calls', 'python'), ('callers', 'calls', 'go'), ('importers', 'imports', 'typescript'), ('importers', 'imports', 'python'), ('elsewhere', 'calls', 'javascript')),
        q AS (SELECT question, empty, count(c.total) FILTER (c.total > 0) AS measured, coalesce(bool_or(floor(bound / nullif(total, 0)::DOUBLE * 1000 + 0.5) / 1000 < 0.8), false) AS degraded, bool_or(a.relation = 'calls' OR a.language IN ('javascript', 'typescript')) AS u
              FROM a, (SELECT unnest([true, false]) AS empty) LEFT JOIN cells c ON c.language = a.language AND c.relation = a.relation GROUP BY question, empty)
        SELECT question, empty, measured, degraded, CASE WHEN degraded OR measured = 0 THEN CASE WHEN empty THEN 'inconclusive' ELSE 'advisory' END WHEN empty AND u THEN 'advisory' ELSE 'decision_grade' END AS grade FROM q""",
    "validate_issues": f"""WITH {G} SELECT 'warning' AS severity, 'edge_duplicate' AS code, CAST(sum(k - 1) AS BIGINT) AS n FROM (SELECT count(*) AS k FROM raw_edges GROUP BY source, target, relation HAVING count(*) > 1) HAVING count(*) > 0
        UNION ALL SELECT 'error', 'edge_target_unknown', count(*) FROM raw_edges WHERE target NOT IN (SELECT id FROM raw_nodes) HAVING count(*) > 0""",
    "node_dedup": "SELECT 'user_' || user_id AS id, min('src/' || event_type || '/' || event_id) AS source_file FROM events GROUP BY user_id",
    "edge_merge": "SELECT 'orders_' || l_orderkey AS source, 'supplier_' || l_suppkey AS target, l_returnflag AS relation, min('L' || l_linenumber) AS source_location, CAST(count(*) AS DOUBLE) AS weight FROM lineitem GROUP BY ALL",
    "graph_edges": f"WITH {G} SELECT source, target, relation, array_to_string(relations, ',') AS relations, confidence, source_file, weight FROM edges",
    "placeholder_nodes": f"WITH {G} SELECT id, name FROM nodes WHERE kind = 'unknown'",
    "method_dispatch": _dispatch_sql(),
    "node_context": f"""WITH RECURSIVE {G}, r(id, depth) AS (SELECT unnest(['nation_3', 'orders_1']), 0 UNION SELECT source, depth + 1 FROM r JOIN edges ON target = id WHERE depth < 2),
        mine AS (SELECT d.*, n.name FROM deg d JOIN nodes n USING (id) WHERE d.id IN ('nation_3', 'orders_1')),
        f AS (SELECT id, 'summary' AS section, concat_ws(' ', kind, name, in_degree, out_degree) AS item FROM mine
            UNION ALL SELECT id, 'risk', unnest(list_filter([CASE WHEN in_degree >= 10 THEN 'many_dependents' END, CASE WHEN out_degree >= 25 THEN 'many_dependencies' END, CASE WHEN in_degree = 0 THEN 'no_dependents' END, CASE WHEN out_degree = 0 THEN 'no_dependencies' END], lambda x: x IS NOT NULL)) FROM mine
            UNION ALL SELECT target, 'dependent', source FROM edges WHERE target IN ('nation_3', 'orders_1') UNION ALL SELECT source, 'dependency', target FROM edges WHERE source IN ('nation_3', 'orders_1')
            UNION ALL SELECT '*', what, path FROM (SELECT DISTINCT source_file AS path, {T} AS what FROM (SELECT id, min(depth) AS depth FROM r GROUP BY id) JOIN nodes USING (id) WHERE depth > 0 OR {T} = 'likely_test'))
        SELECT id, section, item, count(*) OVER (PARTITION BY id, section) AS total FROM f QUALIFY row_number() OVER (PARTITION BY id, section ORDER BY item) <= 20""",
    "review_packet": f"""WITH RECURSIVE {G}, c(packet, path) AS (VALUES (0, 'src/nation/3.go'), (1, 'src/orders/1.ts'), (1, 'README.md'), (2, 'package.json'), (2, 'x.py')),
        k(packet, stale, deleted, sensitive) AS (VALUES (0, false, false, false), (1, false, false, false), (2, true, true, true)),
        r(packet, id, depth) AS (SELECT packet, id, 0 FROM c JOIN nodes ON source_file = path OR id = path UNION SELECT packet, source, depth + 1 FROM r JOIN edges ON target = id WHERE depth < 2),
        i AS (SELECT DISTINCT packet, source_file, {T} AS what FROM (SELECT packet, id, min(depth) AS depth FROM r GROUP BY ALL) JOIN nodes USING (id) WHERE source_file <> '' AND (depth > 0 OR {T} = 'likely_test')),
        m AS (SELECT k.*, (SELECT count(*) FROM i WHERE i.packet = k.packet AND what = 'impacted_file') AS impacted, (SELECT count(*) FROM i WHERE i.packet = k.packet AND what = 'likely_test') AS tests,
            EXISTS (SELECT 1 FROM c WHERE c.packet = k.packet AND path NOT IN (SELECT source_file FROM raw_nodes)) AS missing FROM k),
        f AS (SELECT packet, impacted, tests, list_filter([CASE WHEN stale THEN 'GRAPH_STALE' END, CASE WHEN deleted THEN 'DELETED_FILES' END, CASE WHEN sensitive THEN 'SENSITIVE_CONFIG' END, CASE WHEN impacted >= 10 THEN 'BROAD_IMPACT' END,
            CASE WHEN missing THEN 'MISSING_GRAPH_MATCHES' END, CASE WHEN tests = 0 THEN 'NO_LIKELY_TESTS' END], lambda x: x IS NOT NULL) AS flags, stale OR deleted OR sensitive OR impacted >= 10 AS high FROM m)
        SELECT packet, CASE WHEN high THEN 'high' WHEN len(flags) > 0 THEN 'medium' ELSE 'low' END AS level, array_to_string(flags, ',') AS flags, CAST(impacted AS INTEGER) AS impacted, CAST(tests AS INTEGER) AS tests FROM f""",
    "event_cycles": """WITH RECURSIVE e AS (SELECT DISTINCT event_type AS s, t FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events) WHERE t IS NOT NULL AND t <> event_type),
        p(start, last, path) AS (SELECT s, t, [s, t] FROM e WHERE t > s UNION ALL SELECT start, e.t, list_append(path, e.t) FROM p JOIN e ON e.s = p.last WHERE e.t > start AND NOT list_contains(path, e.t) AND len(path) < 32)
        SELECT CAST(len(path) AS INTEGER) AS length, array_to_string(path, '>') AS cycle FROM p JOIN e ON e.s = p.last AND e.t = p.start ORDER BY 1, 2 LIMIT 84""",
}
