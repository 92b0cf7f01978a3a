"""Queries over tables that repeat with shifted keys, as larger inputs do, against their SQL."""

import random

import __spark_entry__ as entry
import duckdb

from larkspur.operators import edits, ingest, similarity


def parts(spark, base, rows):
    """A part table of (key, type, brand, name, size) in ``base``."""
    spark.createDataFrame(rows, "p_partkey long, p_type string, p_brand string, p_name string, p_size int").write.parquet(f"{base}/part.parquet")
    return str(base)


def agrees(spark, base, name, *others):
    """The rows of the query, which are those of its SQL over part and ``others``."""
    db = duckdb.connect()
    # a table that the projections name and the query doesn't need is taken from the smallest tables
    for t in ("part", "lineitem", "customer", "events", "documents", "labels"):
        at = f"{base}/{t}.parquet/*.parquet" if t in ("part", *others) else f"/root/testdata/sf0.001/{t}.parquet"
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}'")
    got = entry.queries()[name](spark, base)
    want = db.execute(entry.oracle_sql()[name]).fetchdf()[got.columns]
    text = lambda df: df.astype(str).sort_values(got.columns).reset_index(drop=True)
    assert text(got.toPandas()).equals(text(want))
    return got.collect()


def test_symbols_that_repeat_under_other_spellings_of_a_path_are_one(spark, tmp_path):
    # 252 and 702 differ in ./ and in nothing else; 1 and 901 in is_test, 14 and 914 in the signature too
    keys = [252, 702, 1, 901, 13, 913, 14, 914, 7, 907]
    base = parts(spark, tmp_path, [(k, "ECO", "B#1", f"n{k % 450} x", 20) for k in keys])
    assert len(agrees(spark, base, "symbols_from_rows")) == 5


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_spans_are_not_sent_to_the_driver(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(edits, "BROADCAST_SPANS", 3, raising=False)
    base = parts(spark, tmp_path, [(k, "ECO", "B#1", f"n{k} x", 20) for k in range(40)])
    assert len(agrees(spark, base, "located_symbols")) == 40
    assert "Broadcast" not in plan_of(entry.queries()["located_symbols"](spark, base))


def test_imports_are_cleaned_without_tables_in_the_driver(spark, tmp_path):
    base = parts(spark, tmp_path, [(k, "ECO", "B#1", f"n{k} x", 20) for k in range(40)])
    assert len(agrees(spark, base, "cleaned_imports")) == 40
    assert "Broadcast" not in plan_of(entry.queries()["cleaned_imports"](spark, base))


def test_points_and_spans_of_a_file_are_not_paired(spark):
    rng = random.Random(3)
    spans = [(rng.choice("ab"), a, a + rng.choice([-1, 0, 3, 40]), rng.choice(["x", "y", "é", None])) for a in rng.choices(range(60), k=150)] + [("a", None, 5, "n"), (None, 1, 9, "n")]
    points = [(rng.choice("abc"), rng.randrange(-3, 110), i % 40) for i in range(300)] * 2 + [(None, 3, 1), ("a", None, 1)]
    own = spark.createDataFrame(points, "file string, line int, idx long").repartition(3)
    found = ingest.span_join(own, spark.createDataFrame(spans, "file string, start_line int, end_line int, name string"))
    assert found.columns == ["file", "line", "idx", "name"] and "Join" not in plan_of(found)
    want = []
    for file, line, idx in set(points):
        around = [(e - s, n is not None, n or "") for f, s, e, n in spans if file is not None and f == file and None not in (line, s) and s <= line <= e]
        if around:
            _, named, name = min(around)
            want.append((file, line, idx, name if named else None))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)


def test_signatures_meet_in_blocks_without_a_join_of_candidates(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 7, raising=False)
    rng = random.Random(11)
    bases = [[rng.randrange(50) for _ in range(64)] for _ in range(4)] + [[rng.randrange(1 << 40) for _ in range(64)]]
    signs = {i: [v if rng.random() < rng.choice([0.5, 0.7, 0.95]) else rng.randrange(50) for v in rng.choice(bases)] for i in range(60)}
    found = similarity.class_pairs(spark.createDataFrame(list(signs.items()), "idx long, signature array<long>"), 0.3)
    assert "Join" not in plan_of(found)
    both = {(a, b): sum(x == y for x, y in zip(signs[a], signs[b], strict=True)) for a in signs for b in signs if a < b}
    want = [(a, b, n) for (a, b), n in both.items() if n >= 20]
    assert len(want) > 50 and sorted(map(tuple, found.collect())) == sorted(want)
