"""SimHash near-duplicates by tiled exact comparison.

Fingerprints of all documents are reduced to distinct ones, dealt into tiles of
one population count, and every pair of tiles whose population counts differ by
no more than the radius is compared with exclusive-or and bit counts in numpy.
Within a pair of tiles the same bound skips sub-tiles by the population counts
of the two halves.  A tile pair emits a spanning forest of its links, never all
pairs of a group; components of the forests are those of the links.

Cases.  Null text and text without words: fingerprint zero, linked like any
other.  Fewer words than a shingle: the whole sequence is the one shingle.
Repeated rows share a fingerprint; each row is returned.  Null doc_id: the row
takes part and is returned, but is no component_id unless its component has no
other id (then null).  An empty table gives no rows.  Other columns of the
input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from larkspur.llm.texts import text_at, trimmed
from larkspur.operators.components import connected_components
from larkspur.plans.staging import stage

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Fingerprints in a tile, about; ids that may be broadcast.
TILE, BROADCAST_IDS = 4096, 1_000_000


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a UTF-8 text as a signed 64-bit integer."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()  # of bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map((1).__add__, map(len, words))))
    first = [0, *ends]
    k = min(shingle, len(words))
    hashes = np.array([xxh64_intdigest(joined[a : b - 1], seed) for a, b in zip(first, ends[k - 1 :], strict=False)], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255):
        bits = np.unpackbits(hashes[at : at + 255].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_at(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t, shingle, seed) for t in texts], pa.int64())], ["doc_id", "fp"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(trimmed(run), "doc_id long, fp long")


def link_forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links at ``radius`` or fewer differing bits between
    two tiles of distinct fingerprints (uint64), or within one tile (b None)."""
    a = a[np.argsort(np.bitwise_count(a >> np.uint64(32)), kind="stable")]
    own, b = b is None, a if b is None else b[np.argsort(np.bitwise_count(b >> np.uint64(32)), kind="stable")]
    high_a, high_b = (np.bitwise_count(x >> np.uint64(32)).astype(np.int16) for x in (a, b))
    shift = 0 if own else len(a)
    label = np.arange(shift + len(b))
    forest: list[tuple[int, int]] = []
    for at in range(0, len(a), 64):
        rows = a[at : at + 64]
        lo = max(int(np.searchsorted(high_b, high_a[at] - radius)), at + 1 if own else 0)
        hi = int(np.searchsorted(high_b, high_a[min(at + 63, len(a) - 1)] + radius, side="right"))
        if lo >= hi:
            continue
        near = np.bitwise_count(rows[:, None] ^ b[None, lo:hi]) <= radius
        i, j = np.nonzero(near)
        if not len(i):
            continue
        i, j = i + at, j + lo
        if own:
            i, j = i[j > i], j[j > i]
        while len(i):
            x, y = label[i], label[j + shift]
            apart = x != y
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            if not len(i):
                break
            # every larger label hangs on one smaller label: no cycle
            up, low = np.maximum(x, y), np.minimum(x, y)
            up, one = np.unique(up, return_index=True)
            forest += zip(a[i[one]].view(np.int64).tolist(), b[j[one]].view(np.int64).tolist(), strict=True)
            parent = np.arange(len(label))
            parent[up] = low[one]
            while True:
                further = parent[parent]
                if np.array_equal(further, parent):
                    break
                parent = further
            label = parent[label]
    return forest


def near_links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(src, dst): forests of the links among the distinct values of column fp."""
    spark = fps.sparkSession
    popped = fps.select("fp", F.bit_count("fp").alias("pop"))
    sizes = {r[0]: -(-r[1] // tile) for r in popped.groupBy("pop").count().collect()}  # 65 rows at most
    tiles_of = F.create_map(*[F.lit(x) for p in range(65) for x in (p, sizes.get(p, 0))])
    tiles = stage(popped.withColumn("part", F.pmod(F.xxhash64("fp"), tiles_of[F.col("pop")]).cast("int")).groupBy("pop", "part").agg(F.collect_list("fp").alias("fps")), "tiles")
    near = F.explode(F.sequence(F.col("pop"), F.least(F.col("pop") + radius, F.lit(64))))
    left = tiles.select(F.col("pop").alias("pop_a"), F.col("part").alias("part_a"), F.col("fps").alias("fps_a"), near.alias("pop")).where(tiles_of[F.col("pop")] > 0)
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), tiles_of[F.col("pop")] - 1))).where("pop > pop_a or part >= part_a")
    pairs = left.join(tiles, ["pop", "part"]).select(((F.col("pop") == F.col("pop_a")) & (F.col("part") == F.col("part_a"))).alias("own"), "fps_a", F.when(~((F.col("pop") == F.col("pop_a")) & (F.col("part") == F.col("part_a"))), F.col("fps")).alias("fps_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def longs(column: pa.Array, k: int) -> np.ndarray:
            return column[k].values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)

        for batch in batches:
            for k in range(batch.num_rows):
                own = batch.column(0)[k].as_py()
                forest = link_forest(longs(batch.column(1), k), None if own else longs(batch.column(2), k), radius)
                if forest:
                    src, dst = zip(*forest, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return pairs.mapInArrow(trimmed(run), "src long, dst long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED, tile: int = TILE) -> DataFrame:
    """doc_id, fp, fingerprint (16 hex digits), component_id and root (its smallest fp) of every row."""
    marked = stage(fingerprints(docs, shingle, seed), "fingerprints")
    groups = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "groups")
    linked = connected_components(near_links(groups.select("fp"), radius, tile)).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    placed = groups.join(linked, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    # only roots that gather several fingerprints need a second look
    least = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = stage(placed.join(least, "root").select("fp", "component_id", "root"), "named")
    return marked.join(named, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` with one row of each component left, by :func:`keep_components`."""

    def fp(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([fingerprint(None if t is None else t.encode(), how.get("shingle", SHINGLE), how.get("seed", SEED)) for t in part], dtype="int64")

    return keep_components(docs, near_duplicates(docs, **how), F.pandas_udf(fp, "long"))


def keep_components(docs: DataFrame, found: DataFrame, fp: Callable[[Column], Column]) -> DataFrame:
    """The rows of ``docs`` with one row of each component of ``found`` (doc_id, fp, root
    of every row) left: that of its smallest doc_id, then fp, then a hash of the row.
    Rows with null doc_id stay.  What stays is decided for rows, not ids: an id that
    stands on unlike rows stays with each of them that its component keeps.

    Only the ids that go, and those on several rows, meet the texts: by broadcast up to
    ``BROADCAST_IDS``, by a shuffle join beyond; the latter's ``fp`` (of the text) is
    computed again to tell their rows apart."""
    # staged, so that grouping doesn't keep the dealing by fp, and the join before it can split a large group of copies
    found = stage(found.where("doc_id is not null").select("root", "doc_id", "fp"), "found")
    rows = stage(found.groupBy("root", "doc_id", "fp").agg(F.count(F.lit(1)).alias("n")), "rows")
    first = stage(rows.groupBy("root").agg(F.min(F.struct("doc_id", "fp")).alias("first")), "first")
    judged = rows.join(first, "root").select("doc_id", "fp", "n", (F.struct("doc_id", "fp") == F.col("first")).alias("stays"))
    ids = stage(judged.groupBy("doc_id").agg(F.sum("n").alias("n"), F.max("stays").alias("stays")), "ids")
    odd = ids.where("n > 1 or not stays")
    small = odd.count() <= BROADCAST_IDS
    meet = F.broadcast if small else lambda x: x
    single = docs.join(meet(odd.select("doc_id")), "doc_id", "left_anti").select(docs.columns)
    several = docs.join(meet(odd.where("stays and n > 1").select("doc_id")), "doc_id", "left_semi")
    marked = several.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), fp(F.col("text").cast("string")).alias("mark"))
    kept = judged.where("stays").select(F.col("doc_id").alias("id"), F.col("fp").alias("mark"))
    plain = [F.col("row").getField(f.name) for f in docs.schema if not isinstance(f.dataType, MapType)]
    one = marked.join(kept, ["id", "mark"], "left_semi").groupBy("id", "mark").agg(F.min_by("row", F.struct(F.xxhash64(*plain), F.xxhash64(F.lit(1), *plain))).alias("row"))
    return single.unionByName(one.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]))
