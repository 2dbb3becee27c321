"""Queries over projects laid over the commerce tables: manifests, source files and what they import."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators.extract import code_graph
from lodestone.operators import communities, resolve
from lodestone.sources import tables

EXTENSION = "CASE WHEN {c} % 2 = 0 THEN '.ts' ELSE '/index.tsx' END"


def _rows(spark, sf_dir, table, /, **columns):
    return tables.table(spark, sf_dir, table).select(*[F.expr(e).alias(c) for c, e in columns.items()])


def _typescript_files(spark, sf_dir):
    """Nations are packages with manifests, customers their modules or shared ones."""
    main = """CASE n_nationkey % 3 WHEN 0 THEN concat('{"name": "@org/n', n_nationkey, '", "main": "./src/index.js"}') WHEN 1 THEN concat('{"name": "@org/n', n_nationkey, '", "exports": {".": {"import": "./lib/main.ts"}}}') ELSE '{"version": "1", "name": 7}' END"""
    home = "concat('packages/n', n_nationkey, '/{}')"
    files = _rows(spark, sf_dir, "nation", rel_path=home.format("package.json"), text=main)
    files = files.union(_rows(spark, sf_dir, "nation", rel_path=home.format("tsconfig.json"), text="""'{"compilerOptions": {"paths": {"~/*": ["./src/*"]}}}'"""))
    for name in ("src/index.ts", "lib/main.ts"):
        files = files.union(_rows(spark, sf_dir, "nation", rel_path=home.format(name), text="''"))
    files = files.union(_rows(spark, sf_dir, "customer", rel_path=f"CASE WHEN c_custkey % 5 = 0 THEN concat('shared/c', c_custkey, '.ts') ELSE concat('packages/n', c_custkey % 25, '/src/c', c_custkey, {EXTENSION.format(c='c_custkey')}) END", text="''"))
    root = """CASE r_regionkey WHEN 0 THEN '{"compilerOptions": {"baseUrl": "./shared", "paths": {"~/*": ["none/*", "*"], "lib": [5, "lib.ts"]}}}' WHEN 1 THEN '' ELSE 'no JSON' END"""
    return files.union(_rows(spark, sf_dir, "region", rel_path="CASE r_regionkey WHEN 0 THEN 'tsconfig.json' WHEN 1 THEN 'shared/lib.ts' ELSE concat('broken/', r_regionkey, '/package.json') END", text=root))


def typescript_imports(spark, sf_dir):
    """Each order imports its customer's module in one of six ways."""
    spec = "element_at(array(concat('./c', o_custkey, '.js'), concat('./c', o_custkey), concat('~/c', o_custkey), concat('@org/n', o_custkey % 25), concat('@org/n', o_custkey % 25, '/c', o_custkey), 'lib', 'react'), CAST(o_orderkey % 7 + 1 AS INT))"
    asked = _rows(spark, sf_dir, "orders", importer="concat('packages/n', o_custkey % 25, '/src/app.ts')", specifier=spec)
    return resolve.typescript(asked, _typescript_files(spark, sf_dir))


def _rust_files(spark, sf_dir):
    """Regions are crates, suppliers their modules."""
    home = "concat('crates/r', r_regionkey, '/{}')"
    manifest = """concat('[package]\nname = "r-', r_regionkey, '"\n', CASE WHEN r_regionkey < 2 THEN '[dependencies]\nserde-json = "1"\n' ELSE '' END)"""
    files = _rows(spark, sf_dir, "region", rel_path=home.format("Cargo.toml"), text=manifest)
    files = files.union(_rows(spark, sf_dir, "region", rel_path=home.format("src/lib.rs"), text="''"))
    files = files.union(_rows(spark, sf_dir, "supplier", rel_path="concat('crates/r', s_suppkey % 5, '/src/m', s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '.rs' ELSE '/mod.rs' END)", text="''"))
    return files.union(_rows(spark, sf_dir, "region", rel_path="CASE r_regionkey WHEN 0 THEN 'Cargo.toml' ELSE concat('broken/', r_regionkey, '/Cargo.toml') END", text="""CASE r_regionkey WHEN 0 THEN '[workspace.dependencies]\ntokio = "1"\n' ELSE '[package' END"""))


def rust_uses(spark, sf_dir):
    """Each lineitem uses its supplier's module in one of seven ways."""
    path = "element_at(array(concat('crate::m', l_suppkey, '::Thing'), concat('r_', l_suppkey % 5, '::m', l_suppkey, '::run'), 'std::fmt', 'serde_json::Value', concat('super::m', l_suppkey, '::f'), 'self::x::Y', 'tokio::spawn'), CAST(l_linenumber AS INT))"
    asked = _rows(spark, sf_dir, "lineitem", importer="concat('crates/r', l_suppkey % 5, '/src/m', l_suppkey, '.rs')", use_path=path, inline_depth="CASE WHEN l_partkey % 2 = 0 THEN 1 ELSE 0 END")
    return resolve.rust_use(asked, _rust_files(spark, sf_dir))


def rust_mods(spark, sf_dir):
    """Each supplier's module is declared by its crate's root."""
    asked = _rows(spark, sf_dir, "supplier", importer="concat('crates/r', s_suppkey % 5, '/src/lib.rs')", name="concat('m', s_suppkey)")
    return resolve.rust_mod(asked, _rust_files(spark, sf_dir))


def community_rollup(spark, sf_dir):
    """Customers in the communities of their nations, kinds by their segments, folders by their region."""
    nation = tables.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("file", "function", "class", "unknown")]), (F.col("c_custkey") % 4 + 1).cast("int"))
    path = F.concat(F.lit("src/r"), F.col("n_regionkey").cast("string"), F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit("/n"), F.col("c_nationkey").cast("string"))).otherwise(F.concat(F.lit("/d"), (F.col("c_custkey") % 2).cast("string"))), F.lit("/f.py"))
    nodes = tables.table(spark, sf_dir, "customer").join(nation, "c_nationkey").select(F.col("c_nationkey").cast("int").alias("community"), kind.alias("kind"), path.alias("source_file"))
    return communities.rollup(nodes).select("community", "size", "file_count", "function_count", "class_count", "folder", "kind_label")


#: Files of a made-up project: S is a supplier, N its nation.
PYTHON_FILE = "from pkg.nN import helper\nclass CS:\n    def runS(self):\n        helper(len('x'))\n        self.stop()\n    def stop(self): pass\ndef fS():\n    lostS()\n    raise ValueError(1)\n"
SCRIPT_FILE = "import { helper } from './nN';\nimport z from 'zod';\nexport class KS {\n  goS = () => helper();\n  runS() { return this.goS(); }\n}\nexport function mainS() { z.object({}); other.stray(); }\n"


def code_edges(spark, sf_dir):
    """Edges of the graph of a Python and a TypeScript file for each supplier, and of the files of the nations that these import."""
    supplier, nation = tables.table(spark, sf_dir, "supplier"), tables.table(spark, sf_dir, "nation")
    own = supplier.select(F.col("s_suppkey").cast("string").alias("s"), F.col("s_nationkey").cast("string").alias("n"))
    text = lambda t: F.replace(F.replace(F.lit(t), F.lit("S"), F.col("s")), F.lit("N"), F.col("n"))
    of = lambda path, language, t: F.struct(path.alias("rel_path"), F.lit(language).alias("language"), t.alias("text"))
    files = own.select(F.inline(F.array(of(F.format_string("pkg/s%s.py", "s"), "python", text(PYTHON_FILE)), of(F.format_string("web/s%s.ts", "s"), "typescript", text(SCRIPT_FILE)))))
    helped = nation.select(F.col("n_nationkey").cast("string").alias("n"))
    shared = helped.select(F.inline(F.array(of(F.format_string("pkg/n%s.py", "n"), "python", F.lit("def helper(x): pass\n")), of(F.format_string("web/n%s.ts", "n"), "typescript", F.lit("export const helper = () => 1;\n")))))
    graph, _ = code_graph(files.union(shared))
    return graph.edges.select("source", "target", "relation", "confidence")


QUERIES = {f.__name__: f for f in (typescript_imports, rust_uses, rust_mods, community_rollup, code_edges)}

INSIDE = "CASE WHEN c_custkey % 5 <> 0 THEN 'packages/n' || n || '/src/c' || c || CASE WHEN c % 2 = 0 THEN '.ts' ELSE '/index.tsx' END END"
MODULE = "CASE WHEN s_suppkey IS NOT NULL THEN 'crates/r' || r || '/src/m' || s || CASE WHEN s % 2 = 0 THEN '.rs' ELSE '/mod.rs' END END"
ORACLE_SQL = {
    "typescript_imports": f"""WITH o AS (SELECT DISTINCT o_custkey AS c, o_custkey % 25 AS n, o_orderkey % 7 AS way FROM orders),
        t AS (SELECT o.*, 'packages/n' || n || '/src/app.ts' AS importer, CASE way WHEN 0 THEN './c' || c || '.js' WHEN 1 THEN './c' || c WHEN 2 THEN '~/c' || c WHEN 3 THEN '@org/n' || n WHEN 4 THEN '@org/n' || n || '/c' || c WHEN 5 THEN 'lib' ELSE 'react' END AS specifier,
            CASE way WHEN 0 THEN CASE WHEN c % 2 = 0 THEN {INSIDE} END WHEN 1 THEN {INSIDE} WHEN 2 THEN coalesce({INSIDE}, CASE WHEN c_custkey IS NOT NULL THEN 'shared/c' || c || '.ts' END)
                WHEN 3 THEN CASE n % 3 WHEN 0 THEN 'packages/n' || n || '/src/index.ts' WHEN 1 THEN 'packages/n' || n || '/lib/main.ts' END WHEN 4 THEN CASE WHEN n % 3 < 2 THEN {INSIDE} END WHEN 5 THEN 'shared/lib.ts' END AS target
            FROM o LEFT JOIN customer ON c_custkey = c)
        SELECT DISTINCT importer, specifier, target, CASE WHEN target IS NOT NULL THEN CASE WHEN way IN (3, 4) THEN 'WORKSPACE_IMPORT' ELSE 'EXACT_IMPORT' END END AS confidence FROM t""",
    "rust_uses": f"""WITH l AS (SELECT DISTINCT l_suppkey AS s, l_suppkey % 5 AS r, l_linenumber AS way, CASE WHEN l_partkey % 2 = 0 THEN 1 ELSE 0 END AS inline_depth FROM lineitem)
        SELECT 'crates/r' || r || '/src/m' || s || '.rs' AS importer, CASE way WHEN 1 THEN 'crate::m' || s || '::Thing' WHEN 2 THEN 'r_' || r || '::m' || s || '::run' WHEN 3 THEN 'std::fmt' WHEN 4 THEN 'serde_json::Value' WHEN 5 THEN 'super::m' || s || '::f' WHEN 6 THEN 'self::x::Y' ELSE 'tokio::spawn' END AS use_path,
            inline_depth, CASE WHEN way IN (1, 2) OR way = 5 AND inline_depth = 0 THEN coalesce({MODULE}, 'crates/r' || r || '/src/lib.rs') WHEN way = 5 THEN 'crates/r' || r || '/src/m' || s || '.rs' WHEN way = 6 AND s % 2 <> 0 THEN {MODULE} END AS target,
            way IN (3, 7) OR way = 4 AND r < 2 AS external FROM l LEFT JOIN supplier ON s_suppkey = s""",
    "rust_mods": f"WITH l AS (SELECT DISTINCT s_suppkey AS s, s_suppkey % 5 AS r, s_suppkey FROM supplier) SELECT 'crates/r' || r || '/src/lib.rs' AS importer, 'm' || s AS name, {MODULE} AS target FROM l",
    "community_rollup": """WITH n AS (SELECT c_nationkey AS community, ['file', 'function', 'class', 'unknown'][c_custkey % 4 + 1] AS kind, 'src/r' || n_regionkey || CASE WHEN c_nationkey % 2 = 0 THEN '/n' || c_nationkey ELSE '' END AS base, c_custkey % 2 AS side FROM customer JOIN nation ON c_nationkey = n_nationkey),
        k AS (SELECT community, kind, count(*) AS m FROM n GROUP BY ALL), top AS (SELECT community, arg_min(kind, (-m, kind)) AS kind FROM k GROUP BY community)
        SELECT community, count(*) AS size, count(*) FILTER (n.kind = 'file') AS file_count, count(*) FILTER (n.kind = 'function') AS function_count, count(*) FILTER (n.kind = 'class') AS class_count,
            min(base) || CASE WHEN community % 2 <> 0 AND min(side) = max(side) THEN '/d' || min(side) ELSE '' END AS folder, CASE WHEN any_value(top.kind) <> 'unknown' THEN any_value(top.kind) || 's' END AS kind_label FROM n JOIN top USING (community) GROUP BY community""",
    "code_edges": """WITH f AS (SELECT 'pkg_s' || s_suppkey AS p, 'web_s' || s_suppkey AS w, s_suppkey AS s, 'pkg_n' || s_nationkey AS pn, 'web_n' || s_nationkey AS wn FROM supplier),
        e AS (SELECT unnest([{'source': p, 'target': p || '_c' || s, 'relation': 'contains', 'confidence': 'EXTRACTED'}, {'source': p || '_c' || s, 'target': p || '_run' || s, 'relation': 'contains', 'confidence': 'EXTRACTED'},
            {'source': p || '_c' || s, 'target': p || '_stop', 'relation': 'contains', 'confidence': 'EXTRACTED'}, {'source': p, 'target': p || '_f' || s, 'relation': 'contains', 'confidence': 'EXTRACTED'},
            {'source': p, 'target': pn, 'relation': 'imports', 'confidence': 'EXACT_IMPORT'}, {'source': p || '_run' || s, 'target': pn || '_helper', 'relation': 'calls', 'confidence': 'LOCAL_CALL'},
            {'source': p || '_run' || s, 'target': p || '_stop', 'relation': 'calls', 'confidence': 'LOCAL_CALL'}, {'source': p || '_f' || s, 'target': p || '_lost' || s, 'relation': 'calls', 'confidence': 'LOCAL_CALL'},
            {'source': p || '_f' || s, 'target': p || '_valueerror', 'relation': 'calls', 'confidence': 'EXTERNAL_CALL'},
            {'source': w, 'target': w || '_k' || s, 'relation': 'contains', 'confidence': 'EXTRACTED'}, {'source': w || '_k' || s, 'target': w || '_go' || s, 'relation': 'contains', 'confidence': 'EXTRACTED'},
            {'source': w || '_k' || s, 'target': w || '_run' || s, 'relation': 'contains', 'confidence': 'EXTRACTED'}, {'source': w, 'target': w || '_main' || s, 'relation': 'contains', 'confidence': 'EXTRACTED'},
            {'source': w, 'target': wn, 'relation': 'imports', 'confidence': 'EXACT_IMPORT'}, {'source': w, 'target': 'zod', 'relation': 'imports', 'confidence': 'EXTERNAL_IMPORT'},
            {'source': w || '_go' || s, 'target': wn || '_helper', 'relation': 'calls', 'confidence': 'LOCAL_CALL'}, {'source': w || '_run' || s, 'target': w || '_go' || s, 'relation': 'calls', 'confidence': 'LOCAL_CALL'},
            {'source': w || '_main' || s, 'target': w || '_z_object', 'relation': 'calls', 'confidence': 'EXTERNAL_CALL'}]) AS x FROM f)
        SELECT x.source AS source, x.target AS target, x.relation AS relation, x.confidence AS confidence FROM e
        UNION ALL SELECT 'pkg_n' || n_nationkey, 'pkg_n' || n_nationkey || '_helper', 'contains', 'EXTRACTED' FROM nation UNION ALL SELECT 'web_n' || n_nationkey, 'web_n' || n_nationkey || '_helper', 'contains', 'EXTRACTED' FROM nation""",
}
