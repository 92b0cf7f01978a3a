"""Budgets, sources and sizes beyond what one list on the driver would hold."""

import random

import pytest

from larkspur.llm import mixing


def test_long_documents_fill_what_they_can():
    assert mixing.fit_lengths([700_000, 600_000], [1, 1], 650_000) == [0, 1]
    assert mixing.fit_lengths([900_000, 5], [3, 10], 2_000_000) == [2, 10]


@pytest.mark.parametrize(("budget", "want"), [(650_000, 1), (400_000, 1), (300_000, 0), (350_000, 0)])
def test_one_document_past_the_target_if_that_is_nearer(budget, want):
    take = mixing.fit_lengths([700_000], [1], budget)
    assert take == [0] and mixing._nearest([700_000], [1], take, budget) == [want]


def test_targets_of_many_sources_are_those_of_the_plain_rule(spark):
    rng = random.Random(3)
    for n in (1, 2, 7, 500):
        sizes = {f"={chr(97 + rng.randrange(26))}{i}": rng.choice([0, 1, 10, 1000, 10**7]) for i in range(n)} | {"": 40}
        rows = [(k, 1, v) for k, v in sizes.items()]
        got = {r.source_key: r.target for r in mixing.source_targets(spark.createDataFrame(rows, "source_key string, size long, n long")).collect()}
        names = sorted(sizes, key=lambda k: (k == "", k))
        want = dict(zip(names, mixing.fill_targets([(k, sizes[k]) for k in names]), strict=True))
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1e-9 * max(1, want[k]) for k in want)


def test_query_against_a_plain_version(spark, small):
    from larkspur.llm.queries import QUERIES

    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    size = lambda t: len((t or "").encode().split())
    by_source = {}
    for r in docs:
        by_source.setdefault(r.source, []).append(size(r.text))
    names = sorted(by_source, key=lambda s: (s is None, s or ""))
    targets = dict(zip(names, mixing.fill_targets([(s, sum(by_source[s])) for s in names]), strict=True))
    got = QUERIES["op10_mixing"](spark, small).collect()
    sizes = {r.doc_id: (r.source, size(r.text)) for r in docs}
    taken = {}
    for r in got:
        source, n = sizes[r.doc_id]
        assert r.size == n and r.source_size == sum(by_source[source]) and abs(r.target - targets[source]) < 1e-6 and 0 <= r.taken <= 2 * n
        taken[source] = taken.get(source, 0) + r.taken
    assert len(got) == len(docs)
    for s, own in by_source.items():
        goal = round(targets[s]) - (0 if targets[s] < sum(own) else sum(own) if targets[s] < 2 * sum(own) else 2 * sum(own))
        sums = {0}
        for n in own:
            sums |= {n + x for x in sums if n + x <= goal}
        assert abs(taken[s] - round(targets[s])) <= goal - max(sums)
