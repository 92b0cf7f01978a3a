"""Language, SimHash, lines, substrings: odd rows, brute force, held-out accuracy."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from larkspur.llm import language, lines, simhash, substrings
from larkspur.llm.queries import QUERIES


def words(text):
    return (text or "").encode().split()


# ---- language --------------------------------------------------------------


def test_compiled_costs_are_the_trees(monkeypatch):
    trees = {"a": language.ContextTree(3).learn(["the cat sat on the mat, été là".encode() * 3]), "b": language.ContextTree(3).learn(["der hund läuft über den weg".encode() * 3])}
    model = language.compile_trees(trees)
    texts = [b"", "the dog läuft".encode(), b"x", b"th", "中文 the cat".encode(), b"", "été über den".encode() * 40]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    for block in (7, 64, 1 << 19):
        monkeypatch.setattr(language, "BLOCK", block)
        want = np.array([[trees[name].bits(t) for name in model.langs] for t in texts])
        assert np.abs(language.code_lengths(model, data, offsets) - want).max() < 1e-2


def test_probabilities_sum_to_one():
    tree = language.ContextTree(2).learn([b"abracadabra"])
    for context in (b"", b"a", b"ab", b"zz"):
        total = sum(tree.probability(context, b) for b in range(256))
        assert 0 < total <= 1.000001  # without exclusion escapes also reach symbols already seen


def test_language_odd_rows(odd, none):
    got = {(r.doc_id, r.lang_pred): r for r in language.identify(odd).collect()}
    assert language.identify(odd).count() == odd.count()
    assert all((i, "und") in got for i in (1, 2, 3, 9))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.identify(none).count() == 0
    unlabelled = language.predict(odd, None).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


def test_language_held_out_accuracy(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = QUERIES["op1_language"](spark, small).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 10 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.95


# ---- SimHash ---------------------------------------------------------------


def plain_fingerprint(text):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius=3):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= radius and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def test_simhash_odd_rows(odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count() and simhash.near_duplicates(none).count() == 0
    by_id = {r.doc_id: r for r in got}
    for r in odd.collect():
        assert by_id[r.doc_id].fingerprint == f"{plain_fingerprint(r.text):016x}"
    assert {by_id[i].component_id for i in (1, 2, 3)} == {1} and by_id[5].component_id == 4 and by_id[7].component_id == 6
    kept = simhash.keep_one(odd).collect()
    assert sorted((r.doc_id for r in kept), key=str) == sorted([1, 4, 6, 8, 9, None], key=str)


def test_simhash_against_brute_force(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    fps = {i: plain_fingerprint(t) for i, t in docs.items()}
    want = plain_components(fps)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op5_simhash"](spark, small).collect()} == {i: (f"{fps[i]:016x}", want[i]) for i in docs}


@pytest.mark.parametrize("tile", [4, 4096])
def test_links_within_and_across_tiles(spark, tile):
    rng = random.Random(5)
    fps = set()
    for _ in range(30):
        x = rng.getrandbits(64)
        for _ in range(5):
            fps.add(x)
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                x ^= 1 << b
    signed = {f if f < 1 << 63 else f - (1 << 64) for f in fps}
    forest = simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp long"), 3, tile).collect()
    mask = (1 << 64) - 1
    assert all(((r.src ^ r.dst) & mask).bit_count() <= 3 for r in forest)
    want = plain_components({f: f & mask for f in signed})
    root = {f: f for f in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in forest:
        root[max(find(r.src), find(r.dst))] = min(find(r.src), find(r.dst))
    assert {f: find(f) for f in signed} == want


# ---- lines -----------------------------------------------------------------


def test_lines_odd_rows(odd, none):
    got = lines.drop_boilerplate(odd, ratio=0.2, min_pages=1)
    assert got.columns == [c for c in odd.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    by_id = {r.doc_id: r for r in got.collect()}
    assert by_id[1].text is None and by_id[1].n_lines == 0 and by_id[2].text == "" and by_id[3].text == " \t\n "
    assert by_id[4].n_dropped == 0  # no source
    assert by_id[5].text == "" and by_id[5].n_dropped == 3  # the only page of its source
    assert lines.drop_boilerplate(none).count() == 0


def test_lines_ratio_is_relative_to_the_site(spark):
    rows = [(i, f"menu\nown line {i}\n menu\t", "a") for i in range(10)] + [(100 + i, "menu" if i == 0 else f"b {i}", "b") for i in range(20)]
    got = {r.doc_id: r.text for r in lines.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i] == f"own line {i}" for i in range(10)) and got[100] == "menu"


# ---- substrings ------------------------------------------------------------


def plain_repeats(texts, width):
    counts = Counter(b" ".join(w[k : k + width]) for w in texts for k in range(len(w) - width + 1))
    out = []
    for w in texts:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if counts[b" ".join(w[k : k + width])] > 1:
                gone[k : k + width] = [True] * width
        kept = b" ".join(a for a, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def test_substrings_odd_rows(odd, none):
    got = substrings.remove_repeats(odd).collect()
    want = plain_repeats([words(r.text) for r in odd.collect()], 35)
    assert sorted((r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(want)
    assert substrings.remove_repeats(none).count() == 0


@pytest.mark.parametrize(("width", "seed_words"), [(35, 8), (6, 3)])
def test_substrings_against_brute_force(spark, width, seed_words):
    rng = random.Random(width)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(80)]
    texts = []
    for i in range(80):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 150))]
        if i % 3 == 0:
            a, b = sorted(rng.sample(range(81), 2))
            w[len(w) // 2 : len(w) // 2] = passage[a:b]
        if i % 7 == 0:
            w += w[: width + 3] + ["same"] * (width + rng.randrange(3))
        texts.append((i, "  ".join(w)))
    texts += [(200, texts[0][1]), (201, texts[0][1].replace("  ", "\n"))]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string"), width, seed_words).collect()}
    want = dict(zip((i for i, _ in texts), plain_repeats([words(t) for _, t in texts], width), strict=True))
    assert got == want


def test_kept_text_has_the_kept_digest(spark):
    shared = " ".join(f"s{i}" for i in range(50))
    got = substrings.remove_repeats(spark.createDataFrame([(1, f"a b {shared} c"), (2, f"{shared} d")], "doc_id long, text string")).collect()
    assert {r.doc_id: r.kept for r in got} == {1: "a b c", 2: "d"}
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)
