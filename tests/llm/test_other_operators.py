"""Media, preferences, top-k, toxicity, packing, mixing and the pipeline."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from larkspur.llm import jpeg, media, mixing, packing, preferences, tokens, topk, toxicity
from larkspur.llm.queries import ORACLE_SQL, QUERIES

# ---- media -----------------------------------------------------------------


@pytest.mark.parametrize("raw", [None, b"", b"a", b"a" * 191, b"b" * 192, b"c" * 193, bytes(range(256)) * 30, os.urandom(48 * 32 * 1030)])
def test_payload_round_trip(raw):
    size, data = media.payload_avi(raw)
    payload, frames, fps = media.payload_of(data)
    assert payload == (raw or b"") + b" " * (size - len(raw or b"")) and size % 192 == 0 and size > 0 and fps == 25


def test_bit_reader_reads_what_arrays_write():
    frames = np.frombuffer(os.urandom(3 * 48 * 32), np.uint8).reshape(3, 32, 48)
    for file, frame in zip(jpeg.encode_lossless(frames), frames, strict=True):
        assert (jpeg.decode_frame(file) == frame).all()


def baseline_file(blocks_across, blocks_down, dc):
    """A baseline frame whose blocks have only DC values, with fixed-length codes of 4 bits."""
    sizes = bytes(range(12))
    table = bytes([0, 0, 0, 12] + [0] * 12) + sizes
    head = b"\xff\xd8" + jpeg._segment(0xDB, b"\x00" + bytes([8] * 64)) + jpeg._segment(0xC0, bytes([8, 0, 8 * blocks_down, 0, 8 * blocks_across, 1, 1, 0x11, 0]))
    head += jpeg._segment(0xC4, b"\x00" + table) + jpeg._segment(0xC4, b"\x10" + table) + jpeg._segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    bits, last = "", 0
    for value in dc:
        d, last = value - last, value
        s = abs(d).bit_length()
        bits += f"{s:04b}" + (f"{d if d > 0 else d + (1 << s) - 1:0{s}b}" if s else "") + "0000"
    bits += "1" * (-len(bits) % 8)
    return head + int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00") + b"\xff\xd9"


def test_baseline_frames():
    frame = jpeg.decode_frame(baseline_file(2, 1, [10, -20]))
    assert frame.shape == (8, 16) and (frame[:, :8] == 138).all() and (frame[:, 8:] == 108).all()
    assert jpeg._ZIGZAG[:10] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and jpeg._ZIGZAG[-1] == 63


def test_shots_and_clips(spark):
    dark, light = np.full((10, 32, 48), 20, np.uint8), np.full((6, 32, 48), 200, np.uint8)
    file = media.write_avi(jpeg.encode_lossless(np.concatenate([dark, light])), 48, 32, 10)
    broken = file.replace(b"idx1", b"junk")
    rows = [(1, bytearray(file)), (2, bytearray(broken)), (3, bytearray(b"RIFFno")), (4, None), (1, bytearray(file))]
    got = sorted(tuple(r) for r in media.clips(spark.createDataFrame(rows, "doc_id long, media binary")).where("reason is null").collect())
    clips = [(0, 0, 10, 0.0, 1.0, None), (1, 10, 6, 1.0, 1.6, None)]
    assert got == [(k, *c) for k in (1, 2) for c in clips for _ in range(2 if k == 1 else 1)]
    assert media.clips(spark.createDataFrame(rows, "doc_id long, media binary")).where("reason is not null").count() == 2


def test_media_odd_rows(odd, none):
    got = media.store_payloads(odd).collect()
    assert len(got) == odd.count() and media.store_payloads(none).count() == 0
    texts = {r.doc_id: (r.text or "").encode() for r in odd.collect()}
    for r in got:
        padded = texts[r.doc_id].ljust(max(1, -(-len(texts[r.doc_id]) // 192)) * 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert r.media_sha256 == hashlib.sha256(r.media).hexdigest() and r.media_bytes == len(r.media)


# ---- preferences -----------------------------------------------------------


def test_preferences(spark):
    from pyspark.sql import functions as F

    turns = [(0, 0, "user", "q"), (0, 1, "assistant", "good"), (1, 0, "user", "q"), (1, 1, "assistant", "bad"), (2, 0, "user", None), (3, 0, "user", None), (4, 0, None, "x"), (6, 0, "user", "a"), (7, 0, "user", "a"), (7, 1, "user", "b"), (None, 0, "user", "z"), (0, 1, "assistant", "good")]
    df = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id long, turn long, role string, text string, pair_id string")
    by = lambda d: preferences.format_preferences(d, F.shiftright("conv_id", 1), F.col("conv_id") % 2 == 0)
    got = {r.pair_id: r for r in by(df).collect()}
    first = got[0]
    assert first.prompt == "<|user|>\nq<|end|>\n" and first.chosen == "<|assistant|>\ngood<|end|>\n" * 2 and first.rejected == "<|assistant|>\nbad<|end|>\n"
    assert first.chosen_mask == "14:0,12:1,14:0,12:1" and first.rejected_mask == "14:0,11:1"
    assert got[1].prompt_turns == 1 and got[1].chosen == "" and got[1].rejected == ""
    assert not got[2].complete and got[2].rejected is None and got[2].chosen == "<|unknown|>\nx<|end|>\n"
    assert got[3].prompt_turns == 1 and got[3].chosen == "" and got[3].rejected_mask == "18:0"
    assert set(got) == {0, 1, 2, 3} and by(df.limit(0)).count() == 0


# ---- top-k -----------------------------------------------------------------


def plain_top(rows, k, asks, scale=64.0):
    usable = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in {i: v for i, v in sorted(usable, key=lambda r: r[1]) if asks(i)}.items():
        scored = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in usable if i != q and len(w) == len(v)))
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_top_k_odd_rows(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(60)]
    rows += [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (102, [float("nan")] * 6), (103, [float("inf")] * 6), (None, [1.0] * 6), (104, [1.0, 2.0]), (120, [2.0, 1.0]), (140, []), (141, []), (5, rows[5][1]), (7, rows[5][1]), (160, [1e6] * 6), (161, [-1e9] * 6)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<double>, block string")
    got = topk.exact_top_k(df, F.col("vec_id") % 20 == 0, k=5)
    assert sorted(tuple(r) for r in got.collect()) == plain_top(rows, 5, lambda i: i % 20 == 0)
    assert topk.exact_top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_phases_keep_the_best(monkeypatch, spark):
    from pyspark.sql import functions as F

    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-3, 4, size=8).astype(float).tolist()) for i in range(150)]
    got = topk.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=7, lists=3)
    assert sorted(tuple(r) for r in got.collect()) == plain_top(rows, 7, lambda i: i % 20 == 0)


# ---- toxicity --------------------------------------------------------------


def test_chain_learns_and_uses_earlier_links(spark):
    rng = np.random.default_rng(0)
    plain = [f"word{c}" for c in "abcdefghijklmnopqrstuvwxyz"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        text = " ".join(rng.choice(plain, 30)) + (" vile" if toxic else "")
        rows.append((i, text))
        labels.append((i, int(i % 3 > 0), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity.judge(docs, spark.createDataFrame(labels[:400], "doc_id long, quality int, toxic int")).collect()
    held = [r for r in got if r.doc_id >= 400]
    assert all(r.rejected == (r.doc_id % 5 == 0) for r in held)


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 1), (4, 0, None), (4, 1, 1), (None, 1, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.judge(odd, labels)
    assert got.count() == odd.count() and got.columns == [c for c in odd.columns if c != "rejected"] + ["p_low_quality", "p_toxic", "p_toxic_low_quality", "rejected"]
    unknown = toxicity.judge(odd, labels.limit(0)).collect()
    assert not any(r.rejected for r in unknown) and all(r.p_toxic is None for r in unknown)
    assert toxicity.judge(none, labels).count() == 0


# ---- packing ---------------------------------------------------------------


def test_packing_odd_rows(spark, odd, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.default_path())
    got = packing.pack_documents(odd).collect()
    want = []
    for r in odd.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], "<u4")
            want.append((r.doc_id, k, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack_documents(none).count() == 0


def test_packing_rounds_reach_few_bins(spark):
    rng = np.random.default_rng(4)
    pieces = [(i, 0, 0, int(n), 0) for i, n in enumerate(rng.integers(1, 4000, size=3000))]
    df = spark.createDataFrame(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(df, items=400).groupBy("sequence_id").sum("length").collect()
    at_once = packing.best_fit(np.array([p[3] for p in pieces]), 4096).max() + 1
    assert sum(r[1] for r in got) == sum(p[3] for p in pieces) and len(got) <= 1.02 * at_once


def test_cache_that_overflows_stays_right():
    encoder = tokens.WordIds(tokens.default_path(), room=5)
    texts = ["The cat's hat, really? 42", "ΣΑΣ İstanbul été don't", "", "a b c d e f g h", "<|endoftext|> x", "x\x1fy \x85 z"]
    want = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(encoder.ids(texts)) == want


# ---- mixing ----------------------------------------------------------------


def test_targets_reshare_the_excess():
    got = mixing.fill_targets([("a", 10), ("b", 1000), ("c", 1000), (None, 0)])
    assert got[0] == 20 and got[3] == 0 and abs(sum(got) - 1.5 * 2010) < 1e-6 and got[1] / got[2] == 2


@pytest.mark.parametrize("budget", [0, 1, 7, 100, 1234, 10**6])
def test_knapsack_is_as_near_as_possible(budget):
    lengths, counts = [3, 5, 11, 200], [4, 3, 2, 2]
    take = mixing.fit_lengths(lengths, counts, budget)
    assert all(0 <= k <= c for k, c in zip(take, counts, strict=True))
    sums = {0}
    for n, c in zip(lengths, counts, strict=True):
        sums = {s + n * k for s in sums for k in range(c + 1)}
    assert sum(n * k for n, k in zip(lengths, take, strict=True)) == max(s for s in sums if s <= budget)


def test_mixing_odd_rows(odd, none):
    got = mixing.mix_sources(odd).collect()
    again = mixing.mix_sources(odd).collect()
    assert len(got) == odd.count() and sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    by_source = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.taken % max(r.size, 1) == 0
        by_source.setdefault(r.source, []).append(r)
    assert set(by_source) == {"", "s", "t", None}
    for rows in by_source.values():
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= max(r.size for r in rows)
    assert mixing.mix_sources(none).count() == 0 and mixing.mixed_rows(none).count() == 0
    taken = {}
    for r in got:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.copies
    rows = {}
    for r in mixing.mixed_rows(odd).collect():
        rows[r.doc_id] = rows.get(r.doc_id, 0) + 1
    assert rows == {k: v for k, v in taken.items() if v}


# ---- queries and the pipeline ----------------------------------------------


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracles(spark, small, name):
    db = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    got, want = QUERIES[name](spark, small).toPandas(), db.execute(ORACLE_SQL[name]).fetchdf()
    columns = sorted(got.columns)
    text = lambda df: df[columns].astype(str).sort_values(columns).reset_index(drop=True)
    assert text(got).equals(text(want))


def test_pipeline_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, corpus_pipeline.stage(step(spark, docs, small), name)
        sizes.append(docs.count())
        if k < 4:
            assert docs.columns == columns
        if name == "near_duplicates":
            assert docs.count() == docs.select("doc_id").distinct().count() < before.count()
        if name == "lines":
            assert docs.count() == before.count() and docs.where("n_chars <> length(text)").count() == 0
    assert sizes[1] < sizes[0] and sizes[-1] >= sizes[-2]
    assert {"sequence_id", "offset"} <= set(docs.columns)
