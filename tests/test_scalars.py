"""Truth tables of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from larkspur.functions import names as N
from larkspur.functions import paths as P
from larkspur.operators import similarity as S


def check(spark, function, table):
    df = spark.createDataFrame([(i, k) for i, k in enumerate(table)], "i int, x string").select("i", function(F.col("x")).alias("y"))
    assert [r.y for r in sorted(df.collect())] == list(table.values())


@pytest.mark.parametrize(
    ("function", "table"),
    [
        (N.leaf_type, {"&mut jug": "jug", "vec<cup>": "cup", "result<mug, spill>": "mug", "option<vec<cup>>": "vec", "&'t mug": "mug", "dyn pour": "pour", "Plain": "Plain"}),
        (N.owning_type, {"Jug::fill": "jug", "fill": None, "Serve for Inn::open": "inn", "a::Jug<T>::fill": "jug"}),
        (N.owner_leaf, {"a::Jug": "jug", "Serve for Inn<T>": "inn"}),
        (N.is_derived_noise, {"<Jug as core::hash::Hash>::hash": True, "<Quill as Ink>::blot": False, "hash": False}),
        (N.is_noise, {"self.pour": True, "jug.iter": True, "Cellar::open": False, "Err": True}),
        (N.display_name, {"<a::T as b::Tr>::m": "T::m", "<a::T>": "T", "a::b::c": "c", "<a::T as b::Tr>": "T", "plain": "plain"}),
        (N.strip_generics, {"map<k, vec<v>>::get": "map::get", "<a as b>::m": "::m", "plain": "plain", "a<b": "a", "a>b": "ab", "A" + "<b" * 14 + ">" * 14 + "::run": "A::run", "a<b<c>d": "a", "": ""}),
        (N.strip_closure, {"a::b::{closure#0}::{closure#1}": "a::b", "a": "a"}),
        (N.strip_visibility, {"pub fn": "fn", "pub(crate) x": "x", "public": "public"}),
        (N.strip_crate_prefix, {"a::b::c": "b::c", "<a::T>::m": "<T>::m", "x": "x"}),
        (lambda c: N.shorten_signature(c, 12), {"fn a::b::C()": "fn C()", "fn a_long_name()": "fn a_long..."}),
        (N.return_type, {"fn f() -> Vec<u8> {": "Vec<u8>", "fn f()": None}),
        (N.is_derive_generated, {"a::_serde::b": True, "<X as clap::Parser>::p": True, "a::b": False}),
        (N.is_macro_name, {"a::Builder::x": True, "x::build": True, "builder": False}),
        (P.is_test_path, {"lib/tests/jug.rs": True, "pour_test.go": True, "lib/test_jugs.rs": False}),
        (P.normalize_path, {".\\cellar\\jug.rs": "cellar/jug.rs", "//?/C:/a": "C:/a", "a/b": "a/b"}),
        (lambda c: P.normalize_path(c, "/Home/Me"), {"/home/me/src/a.rs": "src/a.rs", "/Home/Me/b": "b", "/other/c": "/other/c"}),
        (P.crate_of, {"parts/cellar/src/jug.rs": "cellar", "parts\\cellar\\src\\jug.rs": "cellar", "src/a.rs": "(root)", "jug.rs": "(root)"}),
        (lambda c: P.crate_of(c, "main_pkg"), {"src/a.rs": "main_pkg"}),
        (P.language, {"a.rs": "rust", "b.TSX": "other", "c.hxx": "cpp", "none": "other"}),
        (P.is_skipped, {"target/x.rs": True, "a/.git/b": True, "a/targets/b": False, ".larkspur.db/x": True}),
        (P.first_folder, {"crates/a/b.rs": "crates/", "main.rs": "main.rs"}),
    ],
)
def test_truth_tables(spark, function, table):
    check(spark, function, table)


def test_lists(spark):
    row = spark.range(1).select(
        N.parameters(F.lit("fn f(&self, a: &str, mut b: u8)")).alias("p"),
        N.packed_calls(F.lit("a::b@12, c@x, d")).alias("c"),
        N.field_pairs(F.lit("Self.x, A.b.c")).alias("f"),
        N.struct_fields(F.lit("struct S {\n  pub a: u8,\n  // no\n  b: Vec<C>,\n}")).alias("s"),
        N.enum_variants(F.lit("enum E {\n  #[x]\n  A,\n  B(u8),\n  C { d: u8 },\n}")).alias("e"),
        N.generic_bounds(F.lit("fn pour<T: Serve>(x: T)")).alias("g"),
        N.generic_bounds(F.lit("fn pour<T>(x: T) where T: a::Serve + Send, U: Map<K, V> {")).alias("w"),
    ).first()
    assert [tuple(x) for x in row.p] == [("a", "&str"), ("mut b", "u8")]
    assert [tuple(x) for x in row.c] == [("a::b", 12), ("c", 0), ("d", 0)]
    assert [tuple(x) for x in row.f] == [("Self", "x"), ("A", "b.c")]
    assert [tuple(x) for x in row.s] == [("a", "u8"), ("b", "Vec<C>")]
    assert row.e == ["A", "B", "C"]
    assert [tuple(x) for x in row.g] == [("t", "serve")]
    assert [tuple(x) for x in row.w] == [("t", "serve"), ("u", "map")]


def test_overlap_and_tags(spark):
    for a, b, c, d, want in [(2, 9, 4, 20, True), (3, 7, 7, 9, True), (3, 7, 8, 9, False), (6, 6, 6, 6, True)]:
        assert spark.range(1).select(S.overlaps(*map(F.lit, (a, b, c, d)))).first()[0] is want
    for jaccard, same, want in [(0.2, True, "AST"), (0.6, False, "Token"), (0.8, True, "AST+Token"), (0.05, False, "Weak")]:
        assert spark.range(1).select(S.pair_tag(F.lit(jaccard), F.lit(same))).first()[0] == want


def test_signature_hex_round_trip(spark):
    s = F.array(*[F.lit(x).cast("long") for x in (0, 1, 255, 2**31 - 2)])
    row = spark.range(1).select(s.alias("s"), S.signature_from_hex(S.signature_hex(s)).alias("t")).first()
    assert row.s == row.t
