"""Near duplicates by SimHash, and by the Jaccard similarity of word shingles.

SimHash: the fingerprints of ``simhash`` (3-word shingles) are all compared by its tiles;
those that differ in 3 or fewer bits are candidates, whose sets are compared exactly.
Near copies that differ in more bits are found beside it:

1. Each text becomes its set of shingle hashes; equal sets are one (a hot group of
   copies costs one row), the others get MinHash values in bands.
2. Sets that share a band stand in one bucket.  Buckets of the same sets are one.
3. Per bucket, in order of id, each set is compared exactly with those before it
   that joined none: the first similar enough is its link.  Large buckets are dealt
   into chunks first, and what joins none in its chunk meets in fewer chunks.
4. Components of the links of both kinds; one id of each stays.

All links are verified.  Of two ids left, none is similar to the other if they share
a bucket: the smaller one would have been the other's link, or had one itself and
gone.  Two sets of similarity s share none with a chance of (1 - s^ROWS)^BANDS:
2 in 10,000 at 0.8, less than 1 in a million at 0.9.

Cases as in ``simhash``: null text and text without words are copies of each other;
fewer words than a shingle make one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.simhash import BROADCAST_IDS, fingerprint, keep_components, near_links
from larkspur.llm.texts import text_at, trimmed
from larkspur.operators.components import connected_components
from larkspur.plans.staging import stage

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
BANDS, ROWS = 16, 4
#: Sets of a bucket that one task compares.
CHUNK = 128


def shingle_set(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Sorted distinct hashes of a UTF-8 text's shingles."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate(map((1).__add__, map(len, words))))
    first = [0, *ends]
    k = min(shingle, len(words))
    return np.unique(np.array([xxh64_intdigest(joined[a : b - 1], seed) for a, b in zip(first, ends[k - 1 :], strict=False)], np.uint64))


def set_key(hashes: np.ndarray) -> int:
    from xxhash import xxh3_64_intdigest

    return int(np.uint64(xxh3_64_intdigest(hashes.tobytes())).view(np.int64))


def band_keys(hashes: np.ndarray, seed: int = SEED) -> list[int]:
    """One key per band of MinHash values; none of an empty set."""
    if not len(hashes):
        return []
    from xxhash import xxh3_64_intdigest

    rng = np.random.default_rng(seed)
    factor, mask = (rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), 1024):
        least = np.minimum(least, ((hashes[at : at + 1024, None] ^ mask) * factor).min(axis=0))
    return [int(np.uint64(xxh3_64_intdigest(band.tobytes(), seed)).view(np.int64)) for band in least.reshape(BANDS, ROWS)]


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets of sorted distinct values have that Jaccard similarity."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def _signed(docs: DataFrame, seed: int, shingle: int) -> DataFrame:
    """(doc_id, fp, bands, mark) of every row: key of its set, keys of its bands, SimHash fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, bands, marks = [], [], []
            for text in text_at(batch.column(1)):
                marks.append(fingerprint(text))
                found = shingle_set(text, shingle, seed)
                keys.append(set_key(found))
                bands.append(band_keys(found, seed))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(marks, pa.int64())], ["doc_id", "fp", "bands", "mark"])

    return _texts(docs).mapInArrow(trimmed(run), "doc_id long, fp long, bands array<long>, mark long")


def _sets(docs: DataFrame, seed: int, shingle: int) -> DataFrame:
    """(fp, hashes) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text, shingle, seed) for text in text_at(batch.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array(map(set_key, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["fp", "hashes"])

    return _texts(docs).mapInArrow(trimmed(run), "fp long, hashes binary")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _links(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(src, dst) of (bucket, n, rep, fp): each set's link to one before it in its bucket of ``n``.

    A bucket of over ``CHUNK`` sets is dealt into chunks; the sets that join none there meet
    in the next round, in fewer chunks, until the bucket is one.  A bucket that a round does
    not halve holds unlike sets and is one chunk from then on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, alone = None, []
        for batch in batches:
            src = []
            for place, fp, raw in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), batch.column(5).to_pylist(), batch.column(6), strict=True):
                if place != at:
                    at, alone = place, []
                own = np.frombuffer(raw.as_py(), np.uint64)
                found = next((f for f, other in alone if similar(own, other, similarity)), None)
                if found is None:
                    alone.append((fp, own))
                src.append(found)
            out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in (0, 2, 3, 4, 5)), pa.array(src, pa.int64())], ["bucket", "chunks", "n", "rep", "fp", "src"])
            # in a bucket of one chunk, what joined none is done
            yield out.filter(pc.or_(pc.is_valid(out.column(5)), pc.greater(out.column(1), 1)))

    found, left = [], members.withColumn("chunks", F.ceil(F.col("n") / CHUNK))
    while True:
        dealt = left.join(sets, "fp").select("bucket", F.pmod("fp", "chunks").alias("chunk"), "chunks", "n", "rep", "fp", "hashes")
        dealt = dealt.repartition("bucket", "chunk").sortWithinPartitions("bucket", "chunk", "rep", "fp")
        judged = stage(dealt.mapInArrow(trimmed(run), "bucket long, chunks long, n long, rep long, fp long, src long"), "judged")
        found.append(judged.where("src is not null").select("src", F.col("fp").alias("dst")))
        alone = judged.where("src is null")
        if alone.isEmpty():
            return reduce(DataFrame.unionByName, found)
        sizes = stage(alone.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max("n").alias("before")), "sizes")
        chunks = F.when(F.col("n") * 2 > F.col("before"), F.lit(1)).otherwise(F.ceil(F.col("n") / CHUNK)).cast("long")
        left = alone.select("bucket", "rep", "fp").join(sizes, "bucket").select("bucket", "n", "rep", "fp", chunks.alias("chunks"))


def _simhash_links(marked: DataFrame) -> DataFrame:
    """(src, dst): pairs of sets of the links among SimHash fingerprints, not verified yet.  Of the
    sets of one fingerprint each is linked to the smallest, which stands for them in other links."""
    each = marked.select("fp", "mark").distinct()
    least = stage(each.groupBy("mark").agg(F.min("fp").alias("src"), F.count(F.lit(1)).alias("n")), "marks")
    alike = each.join(least.where("n > 1"), "mark").select("src", F.col("fp").alias("dst"))
    links = near_links(least.select(F.col("mark").alias("fp")))
    for side in ("src", "dst"):
        links = links.join(least.select(F.col("mark").alias(side), F.col("src").alias(f"set_{side}")), side)
    near = links.select(F.col("set_src").alias("src"), F.col("set_dst").alias("dst"))
    return alike.unionByName(near).where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def _verified(links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``links`` (src, dst) whose sets have that similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(2), batch.column(3), strict=True)
            near = pa.array([similar(np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64), similarity) for a, b in pairs], pa.bool_())
            yield batch.select([0, 1]).filter(near)

    both = links.join(sets.select(F.col("fp").alias("src"), F.col("hashes").alias("a")), "src").join(sets.select(F.col("fp").alias("dst"), F.col("hashes").alias("b")), "dst")
    return both.select("src", "dst", "a", "b").mapInArrow(trimmed(run), "src long, dst long")


def components(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, component_id, root) of every row with an id."""
    rows = docs.where("doc_id is not null")
    marked = stage(_signed(rows, seed, shingle), "signed")
    groups = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "groups")
    banded = groups.select("rep", "fp", F.posexplode("bands").alias("pos", "band"))
    # buckets are told apart by size and two sums of hashes, so that no task gathers one
    sums = [F.bit_xor(F.xxhash64(F.lit(k), F.col("fp"))).alias(f"sum_{k}") for k in range(2)]
    counted = banded.groupBy("pos", "band").agg(F.count(F.lit(1)).alias("n"), *sums).where("n > 1")
    unlike = stage(counted.groupBy("n", "sum_0", "sum_1").agg(F.min(F.struct("pos", "band")).alias("at")).select("at.pos", "at.band", "n"), "unlike")
    members = stage(banded.join(unlike, ["pos", "band"]).select(F.xxhash64("pos", "band").alias("bucket"), "n", "rep", "fp"), "buckets")
    near = stage(_simhash_links(marked), "near")
    compared = groups.join(near.select(F.explode(F.array("src", "dst")).alias("fp")).distinct(), "fp").select("rep", "fp")
    wanted = stage(members.select("rep", "fp").unionByName(compared).distinct().withColumnRenamed("rep", "doc_id"), "wanted")
    few = wanted.count() <= BROADCAST_IDS
    ids, keys = wanted.select("doc_id").distinct(), wanted.select("fp").distinct()
    if few:
        ids, keys = F.broadcast(ids), F.broadcast(keys)
    # the rows of an id that repeats have several sets; rows that repeat have one
    sets = stage(_sets(rows.join(ids, "doc_id", "left_semi"), seed, shingle).join(keys, "fp", "left_semi"), "sets")
    repeats = sets.groupBy("fp").count().where("count > 1").limit(1).count()
    sets = stage(sets.dropDuplicates(["fp"]), "distinct") if repeats else sets
    found = _verified(near, sets, similarity).unionByName(_links(members, sets, similarity))
    linked = connected_components(found).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    placed = groups.join(linked, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = stage(placed.join(least, "root").select("fp", "component_id", "root"), "named")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id", "root")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` with one row of each component left, by the rules of ``simhash.keep_components``."""

    def fp(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([set_key(shingle_set(None if t is None else t.encode(), how.get("shingle", SHINGLE), how.get("seed", SEED))) for t in part], dtype="int64")

    return keep_components(docs, components(docs, **how), F.pandas_udf(fp, "long"))
