"""Queries over whole tables against brute force: no call, symbol, point or pair is left out."""

import random

import pytest

from larkspur.operators import graph, similarity
from larkspur.plans import catalogue

#: Calls by lines that the thin graph leaves out, and one that it keeps.
CALLS = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 12), (12, 13), (13, 14), (20, 21)]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Thirty symbols of one crate and file, and CALLS as orders of two lines."""
    base = str(tmp_path_factory.mktemp("sf"))
    parts = [(i, "ECO", "B#1", "small ring" if i == 50 else f"n{i} x", 40) for i in [*range(1, 31), 50, 51]]
    spark.createDataFrame(parts, "p_partkey long, p_type string, p_brand string, p_name string, p_size int").write.parquet(f"{base}/part.parquet")
    calls = [*CALLS, (51, 50)]
    items = [(k, p, n, "R" if a == 20 else "N", 50.0 if a == 20 else 1.0) for k, (a, b) in enumerate(calls) for n, p in ((3, a), (4, b))]
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string, l_quantity double").write.parquet(f"{base}/lineitem.parquet")
    events = [(2, 3, "click"), (4, 3, "signup")]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string").write.parquet(f"{base}/events.parquet")
    spark.createDataFrame([(i, "BUILDING", f"c{i}") for i in range(1, 9)], "c_custkey long, c_mktsegment string, c_name string").write.parquet(f"{base}/customer.parquet")
    text = " ".join(f"w{i}" for i in range(40))
    docs = [(i, text if i in (2, 11) else f"{i}", f"s{i}", 9) for i in range(1, 31)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    return base


def run(spark, sf, name):
    return catalogue.QUERIES[name](spark, sf)


def test_components_and_traces(spark, sf):
    found = {r.node: r.component for r in run(spark, sf, "components").collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 12: 10, 13: 10, 14: 10, 20: 20, 21: 20, 50: 50, 51: 50}
    assert [r.idx for r in sorted(run(spark, sf, "trace_path").collect())] == [10, 11, 12, 13, 14]
    assert run(spark, sf, "trace_hops").first().hops == 4
    crate = {r.component: r.members for r in run(spark, sf, "cluster_candidates").where("file = 'eco'").collect()}
    # functions are 0 to 5 modulo 10; those of 0 or 5 modulo 5 have no crate
    assert (crate[1], crate[11], crate[21], crate.get(2)) == (4, 4, 1, None)


def test_dead_and_blast(spark, sf):
    called = {b for _, b in CALLS} | {50}
    whole = {r.idx for r in run(spark, sf, "dead_code").collect()}
    assert whole and not whole & called and 1_000_000_001 in whole
    assert run(spark, sf, "dead_by_crate").agg({"dead": "sum"}).first()[0] == len(whole)
    assert {(r.idx, r.depth) for r in run(spark, sf, "blast_type").collect()} == {(4, 0), (3, 1), (2, 2)}
    counts = run(spark, sf, "blast_field").first()
    assert (counts.prod, counts.tests) == (1, 0)


def test_module_partition_follows_all_calls(spark, sf):
    found = {r.idx: r.grp for r in run(spark, sf, "module_partition").collect()}
    assert (found[12], found[13], found[14]) == (12, 12, 12)


def test_blast_of_every_symbol_of_a_name(spark, sf):
    assert {(r.idx, r.depth) for r in run(spark, sf, "blast_symbol").collect()} == {(50, 0), (51, 1)}


def test_entry_starts_from_every_seed(spark):
    import __spark_entry__ as entry

    named = {r.idx for r in catalogue.QUERIES["resolve_symbol"](spark, "/root/testdata/sf0.001").collect()}
    assert {r.idx for r in entry.entry(spark).where("depth = 0").collect()} == named


@pytest.mark.parametrize("seed", range(3))
def test_unified_classes_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    base = [rng.randrange(1000) for _ in range(64)]
    signs = [base, [v if k % 8 else -1 for k, v in enumerate(base)], [v if k % 2 else -2 for k, v in enumerate(base)], [rng.randrange(1000) for _ in range(64)]]
    rows = []
    for i in range(24):
        start = rng.choice([1, 8, 15, None])
        rows.append((i, rng.choice("ff g".split()) if seed else "f", start, start and start + 9, rng.choice([None, "x", "y", f"own{i}"]), rng.choice([None, *signs])))
    chunks = spark.createDataFrame([r[:5] for r in rows], "idx long, file string, start_line int, end_line int, hash string")
    signed = spark.createDataFrame([(r[0], r[5]) for r in rows if r[5]], "idx long, signature array<long>")
    got = {(r.a, r.b): (r.jaccard, r.same_hash, r.class_a, r.class_b) for r in similarity.unified_classes(chunks, signed, chunks.select("idx", "hash"), 0.4).collect()}
    first = {}
    for r in rows:
        first.setdefault(str(r[5]), r[0])
    class_of = {r[0]: first[str(r[5])] if r[5] else None for r in rows}
    want = {}
    for a in rows:
        for b in rows[a[0] + 1 :]:
            j = sum(x == y for x, y in zip(a[5], b[5])) / 64 if a[5] and b[5] else 0.0
            same = a[4] is not None and a[4] == b[4]
            over = a[1] == b[1] and a[2] is not None and b[2] is not None and a[2] <= b[3] and b[2] <= a[3]
            if not over and (same or j >= 0.4):
                want[a[0], b[0]] = (j, same, class_of[a[0]], class_of[b[0]])
    assert got.items() <= want.items()
    classes = {frozenset(v[2:]) for v in got.values()}
    in_class = {(x, v[2]) for p, v in got.items() if v[2] == v[3] for x in p}
    in_hash = {x for p, v in got.items() if v[1] for x in p}
    for (a, b), (j, same, ca, cb) in want.items():
        assert not same or {a, b} <= in_hash
        if j >= 0.4:
            assert {(a, ca), (b, ca)} <= in_class if ca == cb else frozenset((ca, cb)) in classes


def test_dupes_report_copies(spark):
    from test_api import project

    p, ids = project(spark)
    same = {ids[n] for n in ("run", "help", "lonely", "check")}
    assert {x for r in p.dupes().collect() for x in (r.a, r.b)} == same
    assert {x for r in p.dupes(mode="all").collect() for x in (r.a, r.b)} == same


def test_unified_dupes_hash_whole_texts(spark, tmp_path):
    words = lambda seed: " ".join(f"w{random.Random(seed * 1000 + i).randrange(10**6)}" for i in range(80))
    opening = "the same opening of more than forty characters\n"
    texts = [opening + words(1), opening + words(2), words(3) + "\nlast", "// a comment first\n" + words(3) + "\nlast"]
    docs = [(i, x, f"s{i}", len(x)) for i, x in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert {(r.a, r.b, r.same_hash) for r in run(spark, str(tmp_path), "unified_dupes").collect()} == {(2, 3, True)}


def test_context_follows_calls_at_any_line(spark, sf):
    assert {(r.idx, r.role, r.depth) for r in run(spark, sf, "context_roles").collect()} == {(1, "def", 0), (2, "callee", 1), (3, "type", 1)}


def test_duplicates_found_are_analysed_over_all_calls(spark, sf):
    assert [tuple(r) for r in run(spark, sf, "dupe_analysis").collect()] == [(2, 11, 0.0, 0.0, 2, 0, "DIFFERENT LOGIC")]


def test_every_point_is_placed(spark, sf):
    assert {r.idx for r in run(spark, sf, "span_interval_join").collect()} == {*range(1, 31), 50, 51}


def test_traces_have_no_limit(spark):
    chain = spark.createDataFrame([(i, i + 1, 1) for i in range(67)], "src long, dst long, line int").coalesce(1)
    ends = [spark.createDataFrame([(i,)], "idx long").coalesce(1) for i in (67, 0)]
    assert [r.idx for r in sorted(graph.shortest_path(chain, *ends).collect())] == list(range(67, -1, -1))
