"""Rows that share an id: the mix takes as many as planned."""

import pytest

from larkspur.llm import mixing


@pytest.mark.parametrize("doc_id", [None, 7])
def test_no_more_rows_of_one_id_than_planned(spark, doc_id):
    rows = [(doc_id, f"{i} b c d e", "s") for i in range(200)] + [(1000 + i, "a b c d e", "s") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(docs).collect()
    assert sum(r.taken for r in got) == got[0].target == 1800
    taken = {}
    for r in got:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.copies
    found = {}
    for r in mixing.mixed_rows(docs).collect():
        found[r.doc_id] = found.get(r.doc_id, 0) + 1
    assert found == taken
