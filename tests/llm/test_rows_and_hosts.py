"""Rows that share ids, labels of other documents, vectors that can't ask, hosts of URLs."""

import random

from pyspark.sql import functions as F

from larkspur.llm import lines, neardup, simhash, topk, toxicity

A, B, C = "one two three four five six seven", "an entirely other text with words of its own", "a third text that no other row of this table has"


def test_rows_go_by_their_own_component(spark):
    rows = [(3, A, "x"), (7, A, "y"), (7, B, "z"), (8, B, "w"), (8, C, "v"), (8, C, "v"), (None, A, "n"), (9, "", "e"), (9, " ", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for keep in (simhash.keep_one, neardup.keep_one):
        got = sorted(((r.doc_id, r.text) for r in keep(docs).collect()), key=str)
        assert [(i, t.strip()) for i, t in got] == sorted([(3, A), (7, B), (8, C), (None, A), (9, "")], key=str)
        assert got == sorted(((r.doc_id, r.text) for r in keep(docs.repartition(3, "source")).collect()), key=str)


def test_sample_is_drawn_from_labelled_documents(spark):
    rng = random.Random(1)
    words = [f"word{c}" for c in "abcdefghijklmnopqrstuvwxyz"]
    docs = [(i, " ".join(rng.choices(words, k=30)) + (" vile" if i % 5 == 0 else "")) for i in range(200)]
    labels = spark.range(1_000_000, 1_200_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    own = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    got = toxicity.judge(spark.createDataFrame(docs, "doc_id long, text string"), labels.unionByName(own)).where("rejected")
    assert {r.doc_id for r in got.collect()} == set(range(0, 200, 5))


def test_toxicity_held_out(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    chain = toxicity.learn(docs.select("doc_id", "text"), labels.where(~held))
    got = toxicity.score(docs.select("doc_id", "text"), chain).join(labels.where(held).groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id").collect()
    bad, good = [r for r in got if r.toxic == 1], [r for r in got if r.toxic == 0]
    caught, spared = sum(r.rejected for r in bad) / len(bad), sum(not r.rejected for r in good) / len(good)
    print(f"held out: {caught:.2f} of {len(bad)} toxic rejected, {spared:.2f} of {len(good)} clean kept")
    assert caught >= 0.6 and spared >= 0.9


def test_probabilities_are_those_of_the_plain_sums(spark):
    import math

    chain = toxicity.Chain(["a", "b"], ["vile", "word"], [__import__("numpy").array([2.0, -1.0, 0.5]), __import__("numpy").array([1.0, 0.0, 3.0, -2.0])])
    got = toxicity.score(spark.createDataFrame([(1, "Vile vile word"), (2, None)], "doc_id long, text string"), chain, "b", 0.5).collect()
    sig = lambda x: 1 / (1 + math.exp(-x))
    for r, vile, word in zip(sorted(got), (1, 0), (1, 0), strict=True):
        a = sig(2 * vile - word + 0.5)
        b = sig(vile + 3 * a - 2)
        assert abs(r.p_a - a) < 1e-9 and abs(r.p_b - b) < 1e-9 and r.rejected == (b >= 0.5)


def test_a_usable_row_asks_beside_one_that_is_not(spark):
    nan = float("nan")
    rows = [(20, [1.0, 2.0]), (20, [nan, 0.0]), (20, [float("inf"), 0.0]), (20, None), (1, [1.0, 1.0]), (2, [0.0, 1.0]), (3, [nan, nan])]
    got = topk.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=5)
    assert sorted(tuple(r) for r in got.collect()) == [(20, 1, 1, 3 * 64 * 64), (20, 2, 2, 2 * 64 * 64)]


def test_hosts(spark):
    urls = ["http://A.example.com/x", "https://u:p@a.example.com:8080?q", "//a.example.com#f", "src7", None, "", "https://[::1]:80/", "ftp+x://b/"]
    got = [r.h for r in spark.createDataFrame([(u,) for u in urls], "u string").select(lines.host_of(F.col("u")).alias("h")).collect()]
    assert got == ["a.example.com"] * 3 + ["src7", None, "", "[::1]", "b"]


def test_pages_lose_the_lines_of_their_host(spark):
    rows = [(i, f"http://m.a.com/{i}", f"nav\nown {i}") for i in range(20)] + [(100 + i, "http://b.com/", f"nav {i}" if i else "nav") for i in range(30)] + [(200, None, "nav")]
    got = lines.drop_boilerplate(spark.createDataFrame(rows, "page_id long, url string, html string"), site="url", text="html").collect()
    assert {r.page_id: r.html for r in got} == {i: f"own {i}" if i < 20 else h for i, _, h in rows}
