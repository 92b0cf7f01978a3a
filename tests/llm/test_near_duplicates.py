"""The near-duplicates stage against exact Jaccard similarities."""

import random

import corpus_pipeline
import pytest
from larkspur.llm import neardup


def _jaccard(a, b):
    grams = lambda x: {tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))}
    x, y = grams(a.split()), grams(b.split())
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("chunk", [neardup.CHUNK, 2])
def test_planted_copies_go_and_others_stay(spark, monkeypatch, chunk):
    monkeypatch.setattr(neardup, "CHUNK", chunk)
    rng = random.Random(5)
    texts, want = [], set()
    for n in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([80, 200, 600]))]
        texts.append(" ".join(words))
        # scattered edits, or one block at the end
        for share in (0.01, 0.02, 0.04, 0.1):
            other = list(words)
            at = rng.sample(range(len(words)), max(1, int(share * len(words)))) if n % 2 else range(int(len(words) * (1 - share)), len(words))
            for i in at:
                other[i] = f"x{rng.randrange(5000)}"
            texts.append(" ".join(other))
    texts += ["", " ", "one two", "ONE  two", "one two three"]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert {300, 302, 304} <= kept and not {301, 303} & kept
    high = 0
    for n in range(0, 300, 5):
        group = range(n, n + 5)
        near = {(a, b) for a in group for b in group if a < b and _jaccard(texts[a], texts[b]) >= 0.8}
        high += len(near)
        assert n in kept and not any(a in kept and b in kept for a, b in near)
        # what goes was linked to something
        assert all(i in kept or any(i in p for p in near) for i in group)
    assert high > 100


def test_a_large_group_of_near_copies_is_compared_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CHUNK", 8)
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    texts = [" ".join([*base[:at], "x", *base[at + 1 :]]) for at in range(0, 400, 2)]
    docs = spark.createDataFrame([(1000 - i, x) for i, x in enumerate(texts)] + [(5000, "other words that stand alone here")], "doc_id long, text string")
    found = neardup.components(docs)
    assert {r.component_id for r in found.collect()} == {801, 5000}
    assert {r.doc_id for r in neardup.keep_one(docs).collect()} == {801, 5000}
