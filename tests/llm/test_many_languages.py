"""More languages and bytes than one small table holds."""

import random

import numpy as np

from larkspur.llm import language


def _tongue(k):
    rng = random.Random(k)
    letters = rng.sample("abcdefghijklmnopqrstuvwxyzäöüßéèñçåøæłśżабвгдежзиклмнопрстαβγδεζηθικλμν", 14)
    return ["".join(rng.choices(letters, k=rng.randrange(2, 8))) for _ in range(60)]


def test_the_seventieth_language_is_learnt(spark):
    rows = []
    for k in range(70):
        words, rng = _tongue(k), random.Random(1000 + k)
        rows += [(100 * k + i, " ".join(rng.choices(words, k=40)), f"l{k:02}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len({r.lang for r in got}) > 60 and sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)


def test_all_bytes_stay_apart():
    rng = np.random.default_rng(1)
    trees = {n: language.ContextTree(2).learn([rng.integers(0, 256, 4000, np.uint8).tobytes()]) for n in "ab"}
    model = language.compile_trees(trees, 500)
    text = rng.integers(0, 256, 300, np.uint8)
    want = [[trees[n].bits(text.tobytes()) for n in "ab"]]
    assert model.radix > 250 and np.abs(language.code_lengths(model, text, np.array([0, 300])) - want).max() < 1e-2
