"""The command surface over a small project, and the store."""

import json

import pytest
from pyspark.sql import functions as F

from larkspur import api
from larkspur.operators import edits, ingest
from larkspur.sources import connectors
from larkspur.sources.store import Store

BODY = "let alpha = 1;\nlet beta = alpha + 2;\nlet gamma = beta * alpha;\ncall(alpha, beta, gamma);\nreturn gamma;"


def project(spark):
    def chunk(name, file, start, signature, kind="fn", test=False, access=""):
        return (name, file, kind, start, start + 6, signature, "", test, BODY if kind == "fn" else "", "", "", "demo", access)

    raw = spark.createDataFrame(
        [
            chunk("m::run", "crates/demo/src/a.rs", 1, "fn run()"),
            chunk("m::help", "crates/demo/src/a.rs", 11, "fn help()"),
            chunk("m::lonely", "crates/demo/src/b.rs", 1, "fn lonely(cfg: &Config)", access="cfg.path"),
            chunk("m::check", "crates/demo/src/tests/t.rs", 1, "fn check()", test=True),
            chunk("m::Config", "crates/demo/src/b.rs", 20, "struct Config", kind="struct"),
        ],
        connectors.RAW_CHUNKS,
    )
    edges = spark.createDataFrame([("m::run", "a.rs", "fn", "m::help", "", 0, 3, True, "demo"), ("m::check", "t.rs", "fn", "m::run", "crates/demo/src/a.rs", 1, 5, True, "demo")], connectors.RAW_EDGES)
    made = api.add(raw, edges)
    ids = {r.display_name: r.idx for r in made.chunks.collect()}
    return made, ids


def test_commands(spark):
    p, i = project(spark)
    assert {(r.src, r.dst) for r in p.edges.collect()} == {(i["run"], i["help"]), (i["check"], i["run"])}
    assert {r.idx for r in p.symbols("HELP").collect()} == {i["help"]}
    assert {(r.idx, r.role) for r in p.context("run", include_tests=True).collect()} == {(i["run"], "def"), (i["help"], "callee"), (i["check"], "test")}
    assert {r.role: r.names for r in p.summary("run").collect()} == {"def": ["run"], "callee": ["help"], "test": ["check"]}
    assert [r.idx for r in sorted(p.trace("check", "help").collect())] == [i["check"], i["run"], i["help"]]
    assert {(r.idx, r.depth) for r in p.blast("help").collect()} == {(i["help"], 0), (i["run"], 1), (i["check"], 2)}
    assert {r.idx for r in p.blast_type("Config").collect()} == {i["lonely"]}
    assert {r.idx for r in p.blast("Config.path").collect()} == {i["lonely"]}
    assert [r.idx for r in sorted(p.tree("run").collect())] == [i["run"], i["help"]]
    assert {r.idx for r in p.dead().collect()} == {i["lonely"]}
    assert p.ranked().first().idx == i["run"]
    assert {r.crate: r.prod_fns for r in p.stats().collect()} == {"demo": 3, "(all)": 3}
    assert p.cluster("a.rs").first().members == 2
    assert {r.alias for r in p.aliases().collect()} == {"[A]", "[A1]"}
    assert p.dupes(mode="ast").count() == 0
    same = sorted(i[n] for n in ("run", "help", "lonely", "check"))
    assert sorted(tuple(r) for r in p.dupes().collect()) == [(same[0], x, 64) for x in same[1:]]  # equal bodies
    assert {r.file: r.pairs for r in p.dupes_by_file().collect()} == {"crates/demo/src/a.rs": 3}
    assert p.split_module("crates/demo/src/a.rs", 1).where("target like '%mod.rs'").count() == 2


def test_line_commands(spark):
    p, _ = project(spark)
    p.lines = edits.to_lines(spark.createDataFrame([("a.rs", "use x::Y;\nfn go() {\n}\nfn on() {}")], "file string, text string"))
    text = lambda df: [r.text for r in sorted(df.collect(), key=lambda r: (r.file, r.line_no))]
    assert text(p.edit_symbol("replace", "go", "fn went() {}")) == ["use x::Y;", "fn went() {}", "fn on() {}"]
    assert text(p.edit_symbol("delete", "go")) == ["use x::Y;", "fn on() {}"]
    assert text(p.clean_imports()) == ["fn go() {", "}", "fn on() {}"]
    assert text(p.create_file("b.rs", "1\n2")) == ["1", "2"]
    with pytest.raises(ValueError, match="exists"):
        p.create_file("a.rs", "1")
    assert text(p.delete_lines("a.rs", 2, 99)) == ["use x::Y;"]
    assert text(p.insert_at("a.rs", 99, "end\n")) == ["use x::Y;", "fn go() {", "}", "fn on() {}", "end"]
    assert text(p.replace_lines("a.rs", 2, 3, "fn a() {}")) == ["use x::Y;", "fn a() {}", "fn on() {}"]
    assert text(p.edit_symbol("insert-before", "go", "// top")) == ["use x::Y;", "// top", "", "fn go() {", "}", "fn on() {}"]
    assert text(p.edit_symbol("insert-after", "go", "// end")) == ["use x::Y;", "fn go() {", "}", "", "// end", "fn on() {}"]
    for bad in (lambda: p.delete_lines("a.rs", 5, 6), lambda: p.delete_lines("a.rs", 0, 1), lambda: p.delete_lines("a.rs", 3, 2), lambda: p.delete_lines("z.rs", 1, 1), lambda: p.edit_symbol("before", "go", "x"), lambda: p.locate("nothing")):
        with pytest.raises(ValueError):
            bad()
    assert text(p.split("go", "a/g.rs"))[:2] == ["mod g;", "pub use g::*;"]


def test_manifest_and_attributes(spark, tmp_path):
    p, _ = project(spark)
    p.lines = edits.to_lines(spark.createDataFrame([("k/a.rs", "/// says\n#[inline]\nfn go() {\n}"), ("k/b.rs", "fn on() {}\nlast")], "file string, text string"))
    assert [tuple(r) for r in p.locate("m::go").collect()] == [("k/a.rs", 1, 4)]
    (tmp_path / "body").write_text("fn off() {}\n")
    manifest = tmp_path / "m.json"
    manifest.write_text(json.dumps([{"op": "delete", "symbol": "go"}, {"op": "replace", "symbol": "on", "file": "b.rs", "body_file": str(tmp_path / "body")}]))
    assert [(r.file, r.text) for r in sorted(p.run_manifest(str(manifest)).collect())] == [("k/b.rs", "fn off() {}"), ("k/b.rs", "last")]
    assert {(r.file, tuple(r.new)) for r in p.run_manifest(str(manifest), dry_run=True).collect()} == {("k/a.rs", ()), ("k/b.rs", ("fn off() {}",))}
    manifest.write_text(json.dumps([{"op": "insert-at", "symbol": "go"}]))
    with pytest.raises(ValueError, match="unknown operation"):
        p.run_manifest(str(manifest))


def test_one_writer_at_a_time(spark, tmp_path):
    store = Store(spark, str(tmp_path / "locked"))
    with store.writing(), pytest.raises(TimeoutError), store.writing(wait=0.2):
        pass
    with store.writing(wait=0.2):
        store.put("t", spark.range(3))
        store.put("t", store.get("t").where("id > 0"))
    assert sorted(r.id for r in store.get("t").collect()) == [1, 2]


def test_scan_leaves_out_what_git_ignores(spark, tmp_path):
    import subprocess

    for name, text in {"a.rs": "x", "b.rs": "y", ".gitignore": "b.rs\n", "c.md": ""}.items():
        (tmp_path / name).write_text(text)
    assert {r.path for r in connectors.scan_files_fast(spark, str(tmp_path)).collect()} == {"a.rs", "b.rs"}
    subprocess.run(["git", "-C", str(tmp_path), "init", "-q"], check=True)
    assert {r.path for r in connectors.scan_files_fast(spark, str(tmp_path)).collect()} == {"a.rs"}


def test_text_rules(spark):
    row = spark.range(1).select(
        edits.fix_paths(F.lit('super::a("super::b", x_super::c, super::d)'), "super", "crate::m").alias("p"),
        edits.ensure_visibility(F.lit("  async fn f()")).alias("v"),
        edits.ensure_visibility(F.lit("pub fn f()")).alias("w"),
        edits.contains_word(F.lit("a_b b"), "b").alias("c"),
        edits.contains_word(F.lit("a_b"), "b").alias("d"),
    ).first()
    assert row.p == 'crate::m::a("super::b", x_super::c, crate::m::d)'
    assert (row.v, row.w, row.c, row.d) == ("  pub(crate) async fn f()", "pub fn f()", True, False)


def test_store(spark, tmp_path, rows):
    store = Store(spark, str(tmp_path / "db"))
    schema = "idx long, name string, file string, start_line int, end_line int, crate_name string"
    first = spark.createDataFrame([(0, "f", "a", 1, 2, "x"), (1, "g", "b", 1, 2, "y")], schema)
    assert store.get("chunks") is None and store.load_graph(first) is None
    store.save_symbols(first)
    store.save_symbols(spark.createDataFrame([(0, "f", "a", 3, 4, "x"), (2, "h", "a", 5, 6, "x")], schema))
    kept = store.get("chunks").select("name", "start_line", "crate_name")
    assert rows(kept) == [("f", 3, "x"), ("g", 1, "y"), ("h", 5, "x")]
    edges = spark.createDataFrame([(0, 1, 1)], "src long, dst long, line int")
    store.save_graph(edges, first)
    assert rows(store.load_graph(first)) == [(0, 1, 1)]
    assert store.load_graph(first.limit(1)) is None


def test_attached_calls_and_manifests(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "f"), (2, "f"), (3, "g")], "seq int, name string")
    edges = spark.createDataFrame([("f", "a", 2), ("f", "b", 1), ("f", "a", 2)], "caller string, callee string, line int")
    assert {r.seq: r.calls for r in ingest.attach_calls(chunks, edges).collect()} == {1: "b@1, a@2", 2: "", 3: ""}
    assert connectors.workspace_members('[workspace]\nmembers = ["a", "libs/*"]', ("libs/x", "libs/y", "other/z")) == ["a", "libs/x", "libs/y"]
    (tmp_path / "p/q").mkdir(parents=True)
    (tmp_path / "p/Cargo.toml").write_text("")
    assert connectors.project_root(str(tmp_path / "p/q")) == str(tmp_path / "p")
