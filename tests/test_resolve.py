"""Resolution of imports over small projects."""

import json

from lodestone.operators import imports, resolve


def project(spark, files):
    return spark.createDataFrame([(p, t) for p, t in files.items()], "rel_path string, text string")


def resolved(spark, files, asked, **more):
    rows = resolve.typescript(spark.createDataFrame(asked, "importer string, specifier string"), project(spark, files), **more).collect()
    return {(r.importer, r.specifier): (r.target, r.confidence) for r in rows}


def test_a_compiled_name_means_its_source(spark):
    got = resolved(spark, {"src/q.ts": "", "src/q.js": "", "src/only.js": "", "src/v.service.ts": "", "src/m.mts": ""}, [("src/a.ts", s) for s in ("./q.js", "./only.js", "./v.service", "./m.mjs")] * 2)
    assert got == {
        ("src/a.ts", "./q.js"): ("src/q.ts", "EXACT_IMPORT"), ("src/a.ts", "./only.js"): ("src/only.js", "EXACT_IMPORT"),
        ("src/a.ts", "./v.service"): (None, None), ("src/a.ts", "./m.mjs"): ("src/m.mts", "EXACT_IMPORT"),
    }


def test_the_nearest_config_comes_first(spark):
    files = {
        "tsconfig.json": json.dumps({"compilerOptions": {"baseUrl": "lib", "paths": {"~/*": ["*"], "one": ["one.ts"], "x-*-y": ["mid/*"]}}}),
        "apps/web/tsconfig.json": json.dumps({"compilerOptions": {"paths": {"~/*": ["./app/*"], "bad": "no list"}}}),
        "apps/api/tsconfig.json": "{ // no JSON", "apps/web/app/u.ts": "", "lib/u.ts": "", "lib/w/index.js": "", "lib/one.ts": "", "lib/mid/k.ts": "",
    }
    got = resolved(spark, files, [("apps/web/x.ts", "~/u"), ("apps/api/x.ts", "~/u"), ("apps/web/x.ts", "~/w"), ("x.ts", "one"), ("x.ts", "x-k-y"), ("x.ts", "bad")])
    assert {k: v[0] for k, v in got.items()} == {("apps/web/x.ts", "~/u"): "apps/web/app/u.ts", ("apps/api/x.ts", "~/u"): "lib/u.ts", ("apps/web/x.ts", "~/w"): "lib/w/index.js", ("x.ts", "one"): "lib/one.ts", ("x.ts", "x-k-y"): "lib/mid/k.ts", ("x.ts", "bad"): None}


def test_workspace_packages(spark):
    files = {
        "packages/u/package.json": json.dumps({"name": "@r/u", "exports": {".": {"types": "./t.d.ts", "import": "./src/main.js"}}}), "packages/u/src/main.ts": "", "packages/u/src/money.ts": "",
        "packages/v/package.json": json.dumps({"name": "@r/u/v", "main": "gone.js"}), "packages/v/index.ts": "", "packages/w/package.json": json.dumps({"name": "w"}), "package.json": json.dumps({"name": 3}),
        "packages/s/package.json": json.dumps({"name": " s ", "exports": "./lib.ts"}), "packages/s/lib.ts": "",
    }
    got = resolved(spark, files, [("a.ts", s) for s in ("@r/u", "@r/u/money", "@r/u/v", "@r/u/none", "w", "s", "react")])
    assert {k[1]: v for k, v in got.items()} == {
        "@r/u": ("packages/u/src/main.ts", "WORKSPACE_IMPORT"), "@r/u/money": ("packages/u/src/money.ts", "WORKSPACE_IMPORT"), "@r/u/v": ("packages/v/index.ts", "WORKSPACE_IMPORT"),
        "@r/u/none": (None, None), "w": (None, None), "s": ("packages/s/lib.ts", "WORKSPACE_IMPORT"), "react": (None, None),
    }


def test_what_the_compiler_said_comes_first(spark):
    told = spark.createDataFrame([("a.ts", "./b", "c.ts", "COMPILER_IMPORT")], "importer string, specifier string, target string, confidence string")
    assert resolved(spark, {"b.ts": "", "c.ts": ""}, [("a.ts", "./b")], compiled=told) == {("a.ts", "./b"): ("c.ts", "COMPILER_IMPORT")}


def test_no_files_and_nulls(spark):
    assert resolved(spark, {"a.json": None}, [("a.ts", None), (None, "./b"), ("a.ts", "./b")]) == {("a.ts", "./b"): (None, None)}
    empty = project(spark, {"x": ""}).where("false")
    assert resolve.rust_use(spark.createDataFrame([("a.rs", "crate::b", 0)], "importer string, use_path string, inline_depth int"), empty).collect()[0].target is None


def test_rust(spark):
    files = {
        "Cargo.toml": '[workspace.dependencies]\ntokio = "1"\n', "one/Cargo.toml": '[package]\nname = "crate-one"\n[dependencies]\nserde-json = "1"\n', "two/Cargo.toml": '[package]\nname = "two"\n', "bad/Cargo.toml": "[package",
        "one/src/lib.rs": "", "one/src/a.rs": "", "one/src/a/b.rs": "", "one/src/c/mod.rs": "", "two/src/main.rs": "", "two/src/d.rs": "", "free/src/e.rs": "", "free/src/f.rs": "",
    }
    wanted = {
        ("one/src/a.rs", "crate::c::Thing"): ("one/src/c/mod.rs", False), ("one/src/a.rs", "self::b::run"): ("one/src/a/b.rs", False), ("one/src/a.rs", "super::c"): ("one/src/c/mod.rs", False),
        ("one/src/a.rs", "crate::Nothing"): ("one/src/lib.rs", False), ("two/src/d.rs", "crate_one::a::b::f"): ("one/src/a/b.rs", False), ("one/src/a.rs", "serde_json::Value"): (None, True),
        ("two/src/d.rs", "serde_json::Value"): (None, False), ("two/src/d.rs", "tokio::spawn"): (None, True), ("two/src/d.rs", "std::fmt"): (None, True), ("free/src/e.rs", "crate::f::g"): ("free/src/f.rs", False),
        ("free/src/e.rs", "serde_json::x"): (None, True), ("two/src/d.rs", "unknown::x"): (None, False), ("two/src/d.rs", " "): (None, False),
    }
    asked = spark.createDataFrame([(*k, 0) for k in wanted] + [("one/src/a.rs", "super::x", 1), ("one/src/a.rs", "self::b::run", None)], "importer string, use_path string, inline_depth int")
    got = {(r.importer, r.use_path, r.inline_depth): (r.target, r.external) for r in resolve.rust_use(asked, project(spark, files)).collect()}
    assert got == {**{(*k, 0): v for k, v in wanted.items()}, ("one/src/a.rs", "super::x", 1): ("one/src/a.rs", False), ("one/src/a.rs", "self::b::run", None): ("one/src/a/b.rs", False)}
    mods = spark.createDataFrame([("one/src/lib.rs", "a"), ("one/src/lib.rs", "c"), ("one/src/a.rs", "b"), ("one/src/a.rs", "z")], "importer string, name string")
    assert {(r.importer, r.name): r.target for r in resolve.rust_mod(mods, project(spark, files)).collect()} == {("one/src/lib.rs", "a"): "one/src/a.rs", ("one/src/lib.rs", "c"): "one/src/c/mod.rs", ("one/src/a.rs", "b"): "one/src/a/b.rs", ("one/src/a.rs", "z"): None}


def test_candidates(spark):
    rows = spark.createDataFrame([(b,) for b in ("a/b.js", "a/.hidden", "a.b/c", "../x.css")], "b string").select("b", imports.candidates(imports.F.col("b")).alias("c")).collect()
    got = {r.b: r.c for r in rows}
    assert got["a/b.js"] == ["a/b.ts", "a/b.tsx", "a/b.js"] and got["../x.css"] == ["x.css"] and got["a.b/c"][:2] == ["a.b/c", "a.b/c.ts"] and got["a/.hidden"][1] == "a/.hidden.ts" and len(got["a.b/c"]) == 13
