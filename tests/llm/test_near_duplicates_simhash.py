"""The near-duplicates stage follows the links of the SimHash operator."""

import random

import corpus_pipeline
from larkspur.llm import neardup, simhash


def test_links_of_simhash_are_verified_and_followed(spark, monkeypatch):
    # no band in common: what goes was found by SimHash
    monkeypatch.setattr(neardup, "band_keys", lambda hashes, seed=42: [])
    rng = random.Random(4)
    words = [f"w{rng.randrange(5000)}" for _ in range(600)]
    near = [*words[:300], "x", *words[301:]]
    texts = [" ".join(words), " ".join(near), " ".join(words[:100] + near[500:]), "a b"]
    assert 0 < (simhash.fingerprint(texts[0].encode()) ^ simhash.fingerprint(texts[1].encode())).bit_count() <= 3
    docs = spark.createDataFrame([(9 - i, x, "s") for i, x in enumerate(texts)], "doc_id long, text string, source string")
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == {8, 7, 6}
