"""Traversals and components over small graphs."""

import random

import pytest

from larkspur.operators import graph
from larkspur.operators.components import connected_components


def edges(spark, *pairs):
    return spark.createDataFrame([(a, b, 1) for a, b in pairs], "src long, dst long, line int")


def seeds(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "idx long")


@pytest.mark.parametrize(
    ("pairs", "start", "depth", "want"),
    [
        ([(0, 1), (2, 1)], [1], 2, {(0, 1), (1, 0), (2, 1)}),
        ([(0, 1), (1, 2)], [2], 5, {(2, 0), (1, 1), (0, 2)}),
        ([(0, 1), (1, 2)], [2], 1, {(2, 0), (1, 1)}),
        ([(0, 1), (1, 2), (2, 0)], [0], 9, {(0, 0), (2, 1), (1, 2)}),
        ([(0, 2), (1, 2)], [0, 1], 3, {(0, 0), (1, 0)}),
        ([], [7], 3, {(7, 0)}),
    ],
)
def test_reverse_bfs(spark, pairs, start, depth, want):
    assert {tuple(r) for r in graph.bfs(edges(spark, *pairs), seeds(spark, *start), depth, reverse=True).collect()} == want


@pytest.mark.parametrize(
    ("pairs", "source", "target", "want"),
    [
        ([(0, 1), (1, 2), (2, 3)], 0, 3, [0, 1, 2, 3]),
        ([(0, 1), (1, 3), (0, 2), (2, 4), (4, 3)], 0, 3, [0, 1, 3]),
        ([(0, 1)], 1, 0, [1, 0]),
        ([(0, 1), (1, 2), (2, 0)], 0, 2, [0, 2]),
        ([(0, 1)], 0, 0, [0]),
        ([(0, 1), (2, 3)], 0, 3, []),
        ([(0, 2), (0, 1), (1, 3), (2, 3)], 0, 3, [0, 1, 3]),
    ],
)
def test_shortest_path(spark, pairs, source, target, want):
    found = graph.shortest_path(edges(spark, *pairs), seeds(spark, source), seeds(spark, target))
    assert [r.idx for r in sorted(found.collect())] == want


def test_components_against_union_find(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, k) for k in range(1001, 1100)] + [(k, k + 1) for k in range(2000, 2100)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(edges(spark, *pairs)).collect()}
    assert got == {x: find(x) for x in parent}


def test_components_of_nothing(spark):
    assert connected_components(edges(spark).limit(0)).count() == 0
    assert connected_components(edges(spark, (4, 4))).count() == 0


def test_trait_seeds(spark):
    impls = spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "trait_idx long, impl_idx long")
    assert {r.idx for r in graph.with_traits(seeds(spark, 1, 12), impls).collect()} == {1, 10, 11, 12, 2}


def test_flow_tree_marks_back_references(spark):
    chunks = spark.createDataFrame([(i, f"f{i}", i == 9) for i in range(10)], "idx long, name string, is_test boolean")
    tree = graph.flow_tree(chunks, edges(spark, (0, 1), (0, 2), (1, 2), (2, 0), (0, 9)), 0, 4)
    assert [(r.depth, r.idx, r.back) for r in sorted(tree.collect())] == [(0, 0, False), (1, 1, False), (2, 2, False), (3, 0, True), (1, 2, True)]


def test_flow_tree_first_visit_at_the_bound_counts(spark):
    chunks = spark.createDataFrame([(i, f"f{i}", f"f{i}", "a.rs", i, i, i == 2) for i in range(6)], "idx long, name string, display_name string, file string, start_line int, end_line int, is_test boolean")
    tree = graph.flow_tree(chunks, edges(spark, (0, 1), (0, 3), (1, 3), (3, 4), (2, 0)), 0, 2)
    assert [(r.depth, r.idx, r.back) for r in sorted(tree.collect())] == [(0, 0, False), (1, 1, False), (2, 3, False), (1, 3, True)]
    several = graph.flow_tree(chunks, edges(spark, (0, 1), (2, 0)), [2, 0], 3)  # a root may be a test, and met before
    assert [(r.depth, r.idx, r.back) for r in sorted(several.collect())] == [(0, 2, False), (1, 0, False), (2, 1, False), (0, 0, False), (1, 1, True)]
    lines = [r.line for r in sorted(graph.render_tree(tree, chunks).collect())]
    assert lines == ["a.rs:0-0  f0", "  ├─→ a.rs:1-1  f1", "  │   └─→ a.rs:3-3  f3", "  └─→ a.rs:3-3  f3  ↩"]


def test_clusters(spark):
    chunks = spark.createDataFrame([(i, "a.rs" if i < 4 else "b.rs", "function", 1, 10) for i in range(6)], "idx long, file string, kind string, start_line int, end_line int")
    found = {(r.file, r.component): (r.members, r.lines, r.split_candidate) for r in graph.clusters(chunks, edges(spark, (0, 1), (1, 2), (3, 4)), 25).collect()}
    assert found == {("a.rs", 0): (3, 30, True), ("a.rs", 3): (1, 10, False), ("b.rs", 4): (1, 10, False), ("b.rs", 5): (1, 10, False)}
