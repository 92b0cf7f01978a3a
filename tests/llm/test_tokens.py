"""Ids by tables of words and pieces against the tokenizer itself."""

import numpy as np
import pytest

from larkspur.llm import packing, tokens


@pytest.fixture(scope="module")
def encoder():
    return tokens.WordIds(tokens.default_path())


def test_every_character_beside_letters_and_signs(encoder):
    chars = [chr(c) for c in [*range(1, 0x3100), *range(0xA000, 0xD800, 97), *range(0xE000, 0x110000, 991)]]
    texts = [f"Ab!{c}!T{c}x {c}É I{c}" for c in chars]
    want = [x.ids for x in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.ids(texts)] == want


def test_words_and_pieces_that_come_again_after_a_clearing():
    small = tokens.WordIds(tokens.default_path(), room=4, pieces=3)
    texts = ["don't stop### 1234", "stop*** don't", "T̈rend ẗrend ẗ", "λόγος ΛΟΓΟΣ stop###"] * 3
    want = [np.array(small.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert [x for t in texts for x in small.ids([t])] == want


def test_another_vocabulary_gets_whole_texts():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    other = tokens.WordIds(path)
    texts = ["Mixed Case  words", "", "a\nb"]
    assert not other.by_words
    assert [np.frombuffer(x, "<u4").tolist() for x in other.ids(texts)] == [other.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("lengths", [[2100] * 500 + [1900] * 3, [4000] * 300, [1] * 700, [2049] * 300 + [2047] * 150])
def test_merging_goes_on_while_any_two_bins_fit(spark, lengths):
    pieces = [(i, 0, 0, n, 0) for i, n in enumerate(lengths)]
    got = packing.pack(spark.createDataFrame(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long"), items=100)
    bins = sorted(r[0] for r in got.groupBy("sequence_id").sum("length").select("sum(length)").collect())
    assert sum(bins) == sum(lengths) and bins[-1] <= 4096
    assert len(bins) == packing.best_fit(np.array(lengths), 4096).max() + 1
