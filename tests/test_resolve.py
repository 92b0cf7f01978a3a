"""Names to symbols."""

from larkspur.operators import reports, resolve

SCHEMA = "idx long, name string, display_name string, file string, kind string, start_line int, end_line int, is_test boolean, signature string, crate_name string"


def chunks(spark, *names, **kinds):
    rows = [(i, n, n.rpartition("::")[2], f"src/f{i}.rs", kinds.get(f"k{i}", "function"), 10 * i + 1, 10 * i + 9, False, f"fn {n}()", "") for i, n in enumerate(names)]
    return spark.createDataFrame(rows, SCHEMA)


def calls(spark, *rows):
    return spark.createDataFrame(rows, "src long, call string, line int")


def resolved(df):
    return {(r.src, r.dst, r.line) for r in df.collect()}


def test_by_name(spark):
    c = chunks(spark, "caller", "Bar::exec", "utils::helper", "Trait for Engine<T>::go", "map<k>::get")
    got = resolve.resolve_by_name(calls(spark, (0, "Bar::exec", 3), (0, "helper", 4), (0, "x.HELPER", 2), (0, "caller", 5), (0, "engine::go", 6), (0, "map::get", 7), (0, "nothing", 8)), c)
    assert resolved(got) == {(0, 1, 3), (0, 2, 2), (0, 3, 6), (0, 4, 7)}


def test_last_full_name_wins_and_first_alias(spark):
    c = chunks(spark, "a::run", "b::run", "a::run")
    got = resolve.resolve_by_name(calls(spark, (9, "a::run", 1), (8, "run", 1)), c)
    assert resolved(got) == {(9, 2, 1), (8, 0, 1)}


def test_by_location(spark):
    c = chunks(spark, "a", "b", "c")
    asked = spark.createDataFrame([(0, 1, "SRC/f1.rs", 11), (0, 2, "src/f1.rs", 10), (0, 3, "src/f1.rs", 12), (0, 4, "deep/src/f2.rs", 21), (0, 5, "src/f1.rs", 14), (0, 6, "", 3)], "src long, line int, callee_file string, callee_line int")
    got = {r.line: r.dst for r in resolve.resolve_by_location(asked, c).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 2}


def test_trait_fan_out_and_calls(spark):
    c = chunks(spark, "main", "<a::X as t::Run>::go", "<b::Y as t::Run>::go", "plain::f")
    schema = "caller string, caller_file string, callee string, callee_file string, callee_line int, line int"
    raw = spark.createDataFrame([("main", "src/f0.rs", "t::Run::go", "", 0, 4), ("main::{closure#0}", "src/f0.rs", "crate_x::plain::f", "", 0, 5), ("main", "src/f0.rs", "?", "src/f3.rs", 30, 6), ("main", "src/f0.rs", "main", "", 0, 7)], schema)
    assert resolved(resolve.resolve_calls(raw, c)) == {(0, 1, 4), (0, 2, 4), (0, 3, 5)}


def test_trait_impls_both_forms(spark):
    c = chunks(spark, "m::Search", "Search for Engine", "<m::Index as m::Search>", "Other for X", k0="trait", k1="impl", k2="impl", k3="impl")
    assert {tuple(r) for r in resolve.trait_impls(c).collect()} == {(0, 1), (0, 2)}
    f = chunks(spark, "Search for Engine", "Search for Engine::run", "free", k0="impl")
    assert {tuple(r) for r in resolve.fn_trait_impl(f).collect()} == {(1, 0)}


def test_resolve_symbol(spark):
    c = chunks(spark, "run", "a::run", "b::rerun", "<x::T as y::Tr>::do_it")
    assert {r.idx for r in resolve.resolve_symbol(c, "Run").collect()} == {0, 1}
    assert {r.idx for r in resolve.resolve_symbol(c, "T::do_it").collect()} == {3}
    assert resolve.resolve_symbol(c, "absent").count() == 0


def test_field_access_index(spark):
    pairs = "array<struct<name:string,type:string>>"
    schema = f"idx long, name string, kind string, field_types {pairs}, param_types {pairs}, local_types {pairs}, field_accesses array<string>"
    c = spark.createDataFrame([(0, "m::Engine", "struct", [("store", "Arc<Store>")], [], [], []), (1, "m::Engine::run", "function", [], [("cfg", "&Config")], [("cfg", "Wrong")], ["self.store", "self.store.rows", "cfg.path", "odd.x"])], schema)
    assert {(r.key, r.idx) for r in resolve.field_access_index(c).collect()} == {("engine::store", 1), ("store::rows", 1), ("config::path", 1), ("odd::x", 1)}


def test_dedup_types_keeps_longest_then_last(spark):
    rows = [(0, "S", "S", "a.rs", "struct", 1, 5), (1, "S", "S", "a.rs", "struct", 1, 9), (2, "S", "S", "a.rs", "struct", 11, 19), (3, "f", "f", "a.rs", "function", 1, 2), (4, "f", "f", "a.rs", "function", 1, 2)]
    c = spark.createDataFrame(rows, "idx long, name string, display_name string, file string, kind string, start_line int, end_line int")
    assert {r.idx for r in resolve.dedup_types(c).collect()} == {2, 3, 4}


def test_stats_and_dead(spark):
    c = chunks(spark, "a", "b", "t::new", "main", "S", "E", k4="struct", k5="enum")
    row = reports.stats(c).first()
    assert (row.prod_fns, row.test_fns, row.structs, row.enums) == (4, 0, 1, 1)
    edges = spark.createDataFrame([(0, 1, 1)], "src long, dst long, line int")
    assert {r.idx for r in reports.dead_candidates(c, edges).collect()} == {0}
    files = spark.createDataFrame([("src/f0.rs", 5)], "file string, n_lines int")
    assert reports.dead_code(c, edges, files).count() == 0  # stale
