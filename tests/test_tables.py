"""Ingest, edits, sources and streams."""

import json
import sqlite3

from pyspark.sql import functions as F

from larkspur.operators import edits, ingest, similarity
from larkspur.plans.staging import numbered, stage
from larkspur.sources import connectors
from larkspur.streaming import watch


def lines(spark, **files):
    return spark.createDataFrame([(n.replace("_", "."), i, t) for n, text in files.items() for i, t in enumerate(text.split("\n"), 1)], "file string, line_no int, text string")


def text_of(df, file):
    return [r.text for r in sorted(df.where(F.col("file") == file).collect(), key=lambda r: r.line_no)]


def test_change_detection(spark, rows):
    schema = "path string, mtime long, hash string"
    index = spark.createDataFrame([("same", 1, "a"), ("touched", 1, "a"), ("changed", 1, "a"), ("gone", 1, "a"), ("nohash", 1, None), ("unreadable", 1, "a")], schema)
    now = spark.createDataFrame([("same", 1, "b"), ("touched", 2, "a"), ("changed", 2, "b"), ("new", 1, "a"), ("nohash", 2, "a"), ("unreadable", 2, None)], schema)
    assert rows(ingest.changed_files(now, index)) == [("changed",), ("new",), ("nohash",)]
    assert rows(ingest.deleted_files(now, index)) == [("gone",)]
    assert {r.path for r in ingest.next_index(now, index).collect()} == {"same", "touched", "changed", "new", "nohash", "unreadable"}


def test_incremental_merge_equals_rebuild(spark, rows):
    old = spark.createDataFrame([("a", "x", 1), ("b", "y", 1)], "file string, name string, v int")
    new = spark.createDataFrame([("b", "y", 2), ("c", "z", 2)], "file string, name string, v int")
    assert rows(ingest.merge_changed(old, new, ["file", "name"])) == [("a", "x", 1), ("b", "y", 2), ("c", "z", 2)]


def test_to_chunks_and_manifest(spark):
    schema = connectors.RAW_CHUNKS
    raw = spark.createDataFrame([("m::f", ".\\src\\a.rs", "fn", 3, 9, "fn f(x: u8) -> Vec<T>", "pub", False, "body", "g@4, h@x", "", "m", "Self.a")], schema)
    row = ingest.to_chunks(raw).first()
    assert (row.idx, row.kind, row.file, row.display_name, row.return_type) == (0, "function", "src/a.rs", "f", "Vec<T>")
    assert [tuple(c) for c in row.calls] == [("g", 4), ("h", 0)]
    files = spark.createDataFrame([("a/b/src/x.rs",), ("a/y.rs",), ("z.rs",)], "file string")
    manifests = spark.createDataFrame([("a", "outer"), ("a/b", "inner"), ("", "root")], "dir string, crate_name string")
    assert {r.file: r.crate_name for r in ingest.nearest_manifest(files, manifests).collect()} == {"a/b/src/x.rs": "inner", "a/y.rs": "outer", "z.rs": "root"}


def test_numbered_is_dense(spark):
    df = spark.createDataFrame([(f"f{i % 7}", i) for i in range(200)], "file string, n int")
    got = sorted((r.idx, r.file, r.n) for r in numbered(df, "file", "n").collect())
    assert got == [(i, *x) for i, x in enumerate(sorted((f"f{i % 7}", i) for i in range(200)))]


def test_edits(spark):
    src = lines(spark, a_rs="one\ntwo\nthree")
    plan = spark.createDataFrame([("a.rs", "replace", 2, 2, "TWO\nmore\n", 0), ("a.rs", "before", 1, 1, "top", 1), ("a.rs", "after", 3, 9, "end", 2)], "file string, op string, start int, end int, body string, seq int")
    assert text_of(edits.apply_edits(src, plan), "a.rs") == ["top", "", "one", "TWO", "more", "three", "", "end"]
    gone = spark.createDataFrame([("a.rs", "delete", 2, 99, None, 0)], "file string, op string, start int, end int, body string, seq int")
    assert text_of(edits.apply_edits(src, gone), "a.rs") == ["one"]
    assert edits.crossing(plan.withColumn("end", F.lit(9))).count() > 0


def test_imports(spark):
    src = lines(spark, a_rs="use std::fmt;\nuse std::io::{Read, Write as W};\npub use q::Z;\n\n\nfn f() { W::x() }", b_rs="use fmt;")
    assert text_of(edits.clean_imports(src), "a.rs") == ["use std::io::{Read, Write as W};", "pub use q::Z;", "", "fn f() { W::x() }"]
    one = edits.ensure_import(lines(spark, a_rs="use std::fmt;\nx"), "a.rs", "std", "mem")
    assert text_of(one, "a.rs") == ["use std::{fmt, mem};", "x"]
    new = edits.ensure_import(lines(spark, a_rs="use std::fmt;\nx"), "a.rs", "other", "T")
    assert text_of(new, "a.rs") == ["use std::fmt;", "use other::T;", "x"]


def test_split_and_span(spark):
    src = lines(spark, a_rs="use std::fmt;\nuse q::R;\nfn keep() {}\nfn go() {\n  fmt::x();\n}\nfn last() {}")
    span = edits.symbol_span(src, "go")
    assert [tuple(r) for r in span.collect()] == [("a.rs", 4, 6)]
    plan = edits.split_plan(src, span, "a/go_mod.rs")
    assert text_of(plan, "a/go_mod.rs") == ["use std::fmt;", "fn go() {", "  fmt::x();", "}"]
    assert text_of(plan, "a.rs") == ["mod go_mod;", "pub use go_mod::*;", "use std::fmt;", "use q::R;", "fn keep() {}", "fn last() {}"]
    made = edits.create_files(src, spark.createDataFrame([("a.rs", "x"), ("n.rs", "1\n2")], "file string, text string"))
    assert {(r.file, r.line_no) for r in made.collect()} == {("n.rs", 1), ("n.rs", 2)}


def test_partition_module(spark):
    functions = spark.createDataFrame([("m", 1, True, 9), ("m", 2, False, 9), ("m", 3, False, 9), ("m", 4, True, 1), ("m", 5, False, 5)], "file string, idx long, is_pub boolean, lines int")
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (1, 5)], "src long, dst long")
    assert {r.idx: r.grp for r in edits.partition_module(functions, edges, 10).collect()} == {1: 1, 2: 1, 3: 1, 4: None, 5: None}


def test_partition_takes_one_pass_and_places_types(spark):
    rows = [("m", 1, True, 9, "function", "m::a", "Jug::new()"), ("m", 2, False, 9, "function", "m::b", ""), ("m", 3, False, 9, "function", "m::c", "Cup"), ("m", 4, False, 3, "struct", "m::Jug", ""), ("m", 5, False, 3, "enum", "m::Cup", ""), ("m", 6, True, 9, "function", "m::d", "Cup")]
    symbols = spark.createDataFrame(rows, "file string, idx long, is_pub boolean, lines int, kind string, name string, text string")
    edges = spark.createDataFrame([(1, 3), (3, 2)], "src long, dst long")
    # 2 is called by 3, which has no group yet; Cup is used by two groups
    assert {r.idx: r.grp for r in edits.partition_module(symbols, edges, 5).collect()} == {1: 1, 2: None, 3: 1, 4: 1, 5: None, 6: 6}


def test_code_tokens_block_comments(spark):
    text = "/* open\ninside word\n*/ after // not cut\nlet x = 12; // gone\n#[attr]\n/* one */ dropped\nlast"
    df = similarity.code_tokens(spark.createDataFrame([(1, text)], "idx long, text string"))
    assert [r.token for r in sorted(df.collect(), key=lambda r: (r.line, r.pos))] == ["after", "not", "cut", "let", "x", "$N", "last"]


def test_pairs_equal_cross_comparison(spark, rows):
    import random

    rng = random.Random(1)
    base = [rng.randrange(50) for _ in range(64)]
    sigs = []
    for i in range(40):
        s = list(base)
        for k in rng.sample(range(64), rng.randrange(64)):
            s[k] = rng.randrange(1000)
        sigs.append((i, s))
    df = spark.createDataFrame(sigs, "idx long, signature array<long>")
    want = sorted((a, b, sum(x == y for x, y in zip(s, t, strict=True))) for a, s in sigs for b, t in sigs if a < b and sum(x == y for x, y in zip(s, t, strict=True)) >= 32)
    assert sorted(tuple(r) for r in similarity.minhash_pairs(df, 0.5).collect()) == want


def test_hash_groups_drop_overlaps(spark):
    rows_ = [(1, "a", 1, 10, "h"), (2, "a", 5, 8, "h"), (3, "b", 1, 5, "h"), (4, "c", 1, 2, "g"), (5, "d", 1, 2, None)]
    got = similarity.hash_groups(spark.createDataFrame(rows_, "idx long, file string, start_line int, end_line int, hash string")).collect()
    assert [(r.hash, r.size, r.members) for r in got] == [("h", 2, [1, 3])]


def test_json_and_coverage(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"edges": [{"caller": "a", "callee": "b", "file": "f", "line": 3}], "chunks": [{"name": "a", "file": "f", "kind": "method", "start_line": 1, "end": 4}]}))
    edges, chunks = connectors.extractor_json(spark, str(tmp_path / "x.json"))
    assert (edges.first().caller, chunks.first().start_line, chunks.first().end_line, chunks.first().crate_name) == ("a", 1, 4, "")
    (tmp_path / "c.json").write_text(json.dumps({"data": [{"files": [{"filename": "crates/k/src/a.rs", "summary": {"functions": {"count": 4, "covered": 3}, "lines": {"count": 0, "covered": 0}}}]}]}))
    from larkspur.operators.reports import coverage

    row = coverage(connectors.coverage_json(spark, str(tmp_path / "c.json"))).first()
    assert (row.crate, row.fn_pct, row.line_pct) == ("k", 75.0, None)


def test_sqlite_source_pushes_filters(spark, tmp_path):
    path = str(tmp_path / "m.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE mir_edges (caller TEXT, line INTEGER, is_local INTEGER, crate_name TEXT)")
        db.executemany("INSERT INTO mir_edges VALUES (?, ?, ?, ?)", [(f"c{i}", i, i % 2, "ab"[i % 2]) for i in range(100)])
    df = connectors.sqlite_table(spark, path, "mir_edges", "caller string, line int, is_local boolean, crate_name string, field_accesses string")
    assert df.count() == 100
    got = df.where(F.col("crate_name") == "a").collect()
    assert len(got) == 50 and all(r.field_accesses == "" and r.is_local is False for r in got)
    assert df.where(F.col("field_accesses") == "").count() == 100 and df.where(F.col("field_accesses").isin("x", "y")).count() == 0


def test_scan_files(spark, tmp_path):
    for name in ("src/a.rs", "src/b.md", "target/c.rs", "d.go"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    got = connectors.scan_files(spark, str(tmp_path), content=True)
    assert {r.path for r in got.collect()} == {"src/a.rs", "d.go"}
    assert [tuple(r) for r in connectors.language_summary(got).collect()] == [("go", 1), ("rust", 1)]
    assert connectors.detect_language({"go.mod", "Cargo.toml"}) == "rust"


def test_stream_keeps_last_state(spark, tmp_path, rows):
    schema = "path string, crate_name string, seq long, value double, deleted boolean"
    batches = [[("a.rs", "x", 1, 1.0, False), ("b.rs", "x", 2, 2.0, False)], [("a.rs", "y", 3, 3.0, False), ("c.md", "x", 4, 4.0, False)], [("b.rs", "x", 5, 5.0, True), ("a.rs", "y", 2, 9.0, False)]]
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = watch.read_changes(spark, str(tmp_path / "in"), schema, files_per_batch=1).where(watch.relevant())
    watch.maintain(stream, str(tmp_path / "table"), str(tmp_path / "check")).awaitTermination()
    assert rows(watch.current(spark, str(tmp_path / "table")).select("path", "crate_name", "seq")) == [("a.rs", "y", 3)]


def test_stage_reads_back(spark, rows):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert rows(stage(df, "t")) == rows(df)
    assert stage(df.limit(0), "t").count() == 0
