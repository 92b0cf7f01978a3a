"""Removal of word sequences that repeat anywhere in a corpus, by de Bruijn compaction.

The windows of ``width`` consecutive words are the edges of a de Bruijn graph
whose nodes are the words two neighbours share.

1. Seeds.  Every window has a minimizer, the least hash of the shorter k-mers in
   it, and windows of equal words have equal minimizers.  Only about one k-mer in
   fourteen is one.  Those that occur in two unlike texts, or twice in one, mark
   the texts and windows that can repeat at all; the rest is settled.
2. Edges.  The marked windows are counted by a 128-bit hash; a repeated edge gets
   its first occurrence (text and position) as its source coordinate.
3. Compaction.  The occurrences are joined with the repeated edges.  Along a text,
   edges whose source coordinates also advance by one form a nonbranching path;
   it compacts into one span (text, start, source text, source start, length).
4. Verification.  A span counts if the words at its own and at its source
   coordinates have the same digest.  It and its source are removed.

Texts are told apart by a digest of their words; texts with equal words are
counted, and a group of copies is one text in all steps.  Every count is combined
on the map side and joined back, so that the adaptive skew join splits what is
very common; no step gathers the occurrences of a passage in one task.

Cases.  Null text has no words.  Texts shorter than a window keep all words.
Repeated rows and rows of equal words are copies of each other.  Null doc_id is
allowed.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.texts import text_at
from larkspur.plans.staging import release, stage

#: Words of a window and of the k-mers among which its minimizer is chosen.
WIDTH, SEED_WORDS = 35, 8
#: Odd multipliers of the rolling hashes: of seeds and of the two halves of an edge.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
_NO_ID = -(1 << 63)


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def rolling(words: np.ndarray, width: int, multiplier: int) -> np.ndarray:
    """A hash of every ``width`` consecutive word hashes, all arithmetic modulo 2**64."""
    n = len(words)
    up = np.cumprod(np.full(n, multiplier, np.uint64)) if n else words
    down = np.cumprod(np.full(n, pow(multiplier, -1, 1 << 64), np.uint64)) if n else words
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up)])
    mixed = (sums[width:] - sums[:-width]) * down[: max(n - width + 1, 0)]
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(29))


def minimizers(words: np.ndarray, width: int = WIDTH, seed_words: int = SEED_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every k-mer, and for every window the position of its minimizer."""
    kmers = rolling(words, seed_words, MULTIPLIERS[0])
    span = width - seed_words + 1
    if len(kmers) < span:
        return kmers, np.zeros(0, np.int64)
    best = np.concatenate([sliding_window_view(kmers[at : at + 65_536 + span - 1], span).argmin(1) + at for at in range(0, len(kmers) - span + 1, 65_536)])
    return kmers, best + np.arange(len(best)) - np.concatenate([np.full(min(65_536, len(best) - at), at) for at in range(0, len(best), 65_536)])


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*values, np.zeros(0, np.int64)]).astype(np.int64)))


def _arrays(column: pa.Array) -> Iterator[np.ndarray]:
    for x in column:
        yield x.values.to_numpy(zero_copy_only=False) if x.is_valid and len(x) else np.zeros(0, np.int64)


def _summaries(docs: DataFrame, width: int, seed_words: int) -> DataFrame:
    """Per row: the digest of its words and the seeds of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, shas, seeds, twice = [], [], [], []
            for text in text_at(batch.column(2)):
                words = (text or b"").split()
                n_words.append(len(words))
                shas.append(hashlib.sha256(b" ".join(words)).digest())
                if len(words) < width:
                    seeds.append(np.zeros(0, np.int64))
                    twice.append(seeds[-1])
                    continue
                kmers, at = minimizers(word_hashes(words), width, seed_words)
                found, times = np.unique(kmers[np.unique(at)].view(np.int64), return_counts=True)
                seeds.append(found)
                twice.append(found[times > 1])
            halves = np.frombuffer(b"".join(s[:16] for s in shas), ">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(n_words, pa.int64()), pa.array(shas, pa.binary()), _lists(seeds), _lists(twice)],
                ["doc_id", "x", "t1", "t2", "n_words", "sha", "seeds", "twice"],
            )

    return docs.mapInArrow(run, "doc_id long, x long, t1 long, t2 long, n_words long, sha binary, seeds array<long>, twice array<long>")


def _edges(texts: DataFrame, width: int, seed_words: int) -> DataFrame:
    """Hash (e1, e2) and place (tid, pos) of every window whose minimizer is a seed of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tid, text, seeds in zip(batch.column(0).to_pylist(), text_at(batch.column(1)), _arrays(batch.column(2)), strict=True):
                words = word_hashes(text.split())
                kmers, at = minimizers(words, width, seed_words)
                pos = np.flatnonzero(np.isin(kmers.view(np.int64), seeds)[at])
                if len(pos):
                    halves = [pa.array(rolling(words, width, m)[pos].view(np.int64)) for m in MULTIPLIERS[1:]]
                    yield pa.RecordBatch.from_arrays([*halves, pa.array(np.full(len(pos), tid)), pa.array(pos)], ["e1", "e2", "tid", "pos"])

    return texts.select("tid", "text", "seeds").mapInArrow(run, "e1 long, e2 long, tid long, pos long")


def _spans(runs: DataFrame) -> DataFrame:
    """Compact paths of each text: start, windows, and the first source coordinate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for flat in (batch.column(0)[k].values for k in range(batch.num_rows)):
                loc, src = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("loc", "src"))
                first = np.flatnonzero((np.diff(loc, prepend=loc[0] - 2) != 1) | (np.diff(src, prepend=src[0]) != 1))
                yield pa.RecordBatch.from_arrays([pa.array(loc[first]), pa.array(src[first]), pa.array(np.diff(np.append(first, len(loc))).astype(np.int64))], ["loc", "src", "windows"])

    return runs.mapInArrow(run, "loc long, src long, windows long")


def _digests(texts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(tid, pos, windows) of ``wanted`` with a 128-bit digest of the words there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            for tid, text, spans in zip(batch.column(0).to_pylist(), text_at(batch.column(1)), batch.column(2), strict=True):
                words, flat = text.split(), spans.values
                pos, windows = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("pos", "windows"))
                found = [xxh3_128_digest(b" ".join(words[p : p + n + width - 1])) for p, n in zip(pos.tolist(), windows.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pos), tid)), pa.array(pos), pa.array(windows), pa.array(found, pa.binary())], ["tid", "pos", "windows", "digest"])

    lists = wanted.groupBy("tid").agg(F.collect_set(F.struct("pos", "windows")).alias("spans"))
    return texts.select("tid", "text").join(lists, "tid").select("tid", "text", "spans").mapInArrow(run, "tid long, pos long, windows long, digest binary")


def _removals(texts: DataFrame, verified: DataFrame, width: int) -> DataFrame:
    """Per text with a repeat: words removed and the digest of what is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(text_at(batch.column(0)), batch.column(1), strict=True):
                words, flat = text.split(), spans.values
                pos, windows = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("pos", "windows"))
                step = np.zeros(len(words) + 1, np.int64)
                np.add.at(step, pos, 1)
                np.add.at(step, pos + windows + width - 1, -1)
                keep = np.cumsum(step[:-1]) == 0
                kept = b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])
                key = np.frombuffer(hashlib.sha256(b" ".join(words)).digest()[:16], ">i8").tolist()
                rows.append((*key, int(len(words) - keep.sum()), hashlib.sha256(kept).digest(), kept))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["t1", "t2", "n_removed", "kept_sha", "kept"])

    lists = verified.groupBy("tid").agg(F.collect_set(F.struct("pos", "windows")).alias("spans"))
    return texts.select("tid", "text").join(lists, "tid").select("text", "spans").mapInArrow(run, "t1 long, t2 long, n_removed long, kept_sha binary, kept binary")


def _texts_with_seeds(docs: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """One row for each text that can hold a repeated window, with the seeds it shares."""
    own = rows.where(F.size("twice") > 0).select((F.col("x").bitwiseXOR(F.lit(1))).alias("x"), F.explode("twice").alias("seed"))
    seeds = rows.select("x", F.explode("seeds").alias("seed"))
    shared = seeds.unionByName(own).groupBy("seed").agg(F.min("x").alias("a"), F.max("x").alias("b")).where("a <> b").select("seed")
    # staged, so that of two plain tables the join can split a seed that very many rows have
    hits = seeds.join(stage(shared, "shared"), "seed").groupBy("x").agg(F.collect_set("seed").alias("seeds"))
    one = rows.where(F.col("n_words") >= width).groupBy("t1", "t2").agg(F.min(F.struct(_row_id(), "x")).alias("r")).select("r.rid", "r.x")
    texts = docs.select(_row_id(), "x", "text").join(one.join(hits, "x"), ["x", "rid"])
    return texts.select(F.monotonically_increasing_id().alias("mid"), "text", "seeds")


def _row_id() -> Column:
    return F.coalesce("doc_id", F.lit(_NO_ID)).alias("rid")


def remove_repeats(docs: DataFrame, width: int = WIDTH, seed_words: int = SEED_WORDS, with_text: bool = True) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, and (``with_text``)
    kept, the words left joined by one space, null where no word is removed."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("x"), F.col("text").cast("string").alias("text"))
    rows = stage(_summaries(own, width, seed_words), "summaries")
    texts = stage(_texts_with_seeds(own, rows, width), "texts")
    release(spark)
    # a place is one long: partition, row and position in as many bits as they need
    top = texts.agg(F.max(F.col("mid").bitwiseAND(F.lit((1 << 33) - 1))), F.max("mid")).first()
    longest = rows.agg(F.max("n_words")).first()[0] or 0
    row_bits, pos_bits = int(top[0] or 0).bit_length(), int(longest).bit_length() + 1
    if (int(top[1] or 0) >> 33).bit_length() + row_bits + pos_bits > 62:
        raise ValueError("texts are too many or too long for 62-bit places")
    texts = texts.select(F.shiftleft(F.shiftright("mid", 33), row_bits).bitwiseOR(F.col("mid").bitwiseAND(F.lit((1 << 33) - 1))).alias("tid"), "text", "seeds")
    edges = _edges(texts, width, seed_words).select("e1", "e2", (F.shiftleft("tid", pos_bits) + F.col("pos")).alias("loc"))
    sources = stage(edges.groupBy("e1", "e2").agg(F.count(F.lit(1)).alias("n"), F.min("loc").alias("src")).where("n > 1").select("e1", "e2", "src"), "sources")
    release(spark)  # the counts' shuffle; and a join of two plain tables can be split where an edge is very common
    marked = edges.join(sources, ["e1", "e2"]).select("loc", "src")
    runs = marked.groupBy(F.shiftright("loc", pos_bits).alias("tid")).agg(F.sort_array(F.collect_list(F.struct("loc", "src"))).alias("runs"))
    spans = stage(_spans(runs.select("runs")), "spans")
    release(spark)

    def place(loc: str, tid: str = "tid", pos: str = "pos") -> list[Column]:
        return [F.shiftright(loc, pos_bits).alias(tid), F.col(loc).bitwiseAND(F.lit((1 << pos_bits) - 1)).alias(pos)]

    copies = spans.where("loc <> src")
    wanted = copies.select(*place("loc"), "windows").unionByName(copies.select(*place("src"), "windows")).distinct()
    digests = stage(_digests(texts, wanted, width), "digests")
    here = digests.select((F.shiftleft("tid", pos_bits) + F.col("pos")).alias("loc"), "windows", "digest")
    there = here.withColumnsRenamed({"loc": "src", "digest": "source_digest"})
    verified = copies.join(here, ["loc", "windows"]).join(there, ["src", "windows"]).where("digest = source_digest")
    places = verified.select(*place("loc"), "windows").unionByName(verified.select(*place("src"), "windows").distinct())
    found = _removals(texts, places, width)
    # what is known of a text, in one table: a copy group's rows meet it in a single join of two plain tables, which can be split
    changed = (found if with_text else found.drop("kept")).dropDuplicates(["t1", "t2"])
    copied = rows.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("copies"))
    known = stage(copied.join(changed, ["t1", "t2"], "left").where("copies > 1 or n_removed is not null"), "known")
    everywhere = (F.col("copies") > 1) & (F.col("n_words") >= width)
    joined = rows.select("doc_id", "t1", "t2", "n_words", "sha").join(known, ["t1", "t2"], "left")
    out = [
        F.col("doc_id"),
        F.col("n_words"),
        F.when(everywhere, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(everywhere, F.sha2(F.lit(""), 256)).otherwise(F.lower(F.hex(F.coalesce("kept_sha", "sha")))).alias("kept_sha256"),
    ]
    if with_text:
        out.append(F.when(everywhere, F.lit("")).otherwise(F.col("kept").cast("string")).alias("kept"))
    return joined.select(*out)


ORACLE = f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
     e AS (SELECT r, i, md5(array_to_string(ws[i:i + {WIDTH - 1}], ' ')) AS h FROM (SELECT r, ws, unnest(range(1, len(ws) - {WIDTH - 2})) AS i FROM w)),
     c AS (SELECT DISTINCT r, i + k AS p FROM e JOIN (SELECT h FROM e GROUP BY 1 HAVING count(*) > 1) USING (h), range({WIDTH}) AS t(k)),
     g AS (SELECT r, list(p) AS gone FROM c GROUP BY 1),
     a AS (SELECT doc_id, ws, coalesce(gone, []) AS gone FROM w LEFT JOIN g USING (r))
SELECT doc_id, len(ws)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed, sha256(array_to_string(list_filter(ws, lambda x, i: NOT list_contains(gone, i)), ' ')) AS kept_sha256 FROM a
"""
