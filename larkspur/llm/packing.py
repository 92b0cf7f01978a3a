"""Hierarchical residual packing of documents into token sequences.

Documents longer than a sequence are cut into full pieces and a rest.  Full
pieces are sequences.  The others are packed by partitions: each places its items
best-fit in decreasing order, emits the bins that are nearly full, and hands the
underfull ones on as items, but for those that not even the least of them fits
into; fewer partitions then merge these, until one has packed what is left.  A
partition never gets more than about ``ITEMS`` items, however many there are; if
more stay underfull, rounds go on as long as they merge any.

Cases.  Null text counts as empty; an empty text is the one closing id.  Very
long texts are many full pieces.  Equal lengths are placed in the order of their
partition.  Repeated rows are packed as documents of their own, null doc_id too.
An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.texts import give_back, trimmed
from larkspur.llm.tokens import BLOCK_CHARS, CACHE_WORDS, default_path, word_ids
from larkspur.plans.staging import stage

CAPACITY, CLOSING_ID = 4096, 1
#: A bin with at most this room is emitted; items of a partition, about.
SLACK, ITEMS = 8, 30_000

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item: longest first, each into the fullest bin that has room."""
    bins = np.empty(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, n = 0, 0  # bit r of rooms: some bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fits = rooms >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            at = free[room].pop()
            if not free[room]:
                rooms ^= 1 << room
        else:
            room, at, n = capacity, n, n + 1
        bins[i] = at
        room -= need
        if room:
            free[room].append(at)
            rooms |= 1 << room
    return bins


def _cut(doc_ids: list[int | None], ids: Iterable[np.ndarray], capacity: int) -> pa.RecordBatch:
    """The pieces of documents, whose ids are followed by the closing one."""
    rows: list[tuple] = []
    closing = np.array([CLOSING_ID], "<u4").tobytes()
    for doc_id, own in zip(doc_ids, ids, strict=True):
        n, raw = len(own) + 1, memoryview(np.ascontiguousarray(own)).cast("B")
        for k, at in enumerate(range(0, n, capacity)):
            length = min(capacity, n - at)
            crc = zlib.crc32(raw[4 * at : 4 * (at + length)])
            rows.append((doc_id, k, at, length, zlib.crc32(closing, crc) if at + length == n else crc))
    columns = list(zip(*rows, strict=True)) or [()] * 5
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])


def token_pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, cache_words: int = CACHE_WORDS, block_chars: int = BLOCK_CHARS, lean: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row; ``lean`` gives all freed memory
    back after each block and task, which costs time."""
    path = tokenizer_path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, after = word_ids(path, cache_words), give_back if lean else pa.default_memory_pool().release_unused
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).fill_null("")
            bytes_to = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(texts):
                read = int(bytes_to[at - 1]) if at else 0
                end = max(at + 1, int(np.searchsorted(bytes_to, read + block_chars, side="right")))
                yield _cut(doc_ids[at:end], encoder.block(texts.slice(at, end - at)), capacity)
                at = end
                after()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(run) if lean else run, _PIECE)


def _round(items: DataFrame, partitions: int, capacity: int, slack: int) -> DataFrame:
    """Bins (fill, done, members) of items (fill, members), best-fit within each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches).combine_chunks()
        fill = table.column("fill").to_numpy()
        bins = best_fit(fill, capacity)
        order = np.argsort(bins, kind="stable")
        members = table.column("members").combine_chunks().take(pa.array(order))
        offsets = members.offsets.to_numpy() - members.offsets[0].as_py()
        first = np.flatnonzero(np.diff(bins[order], prepend=-1))
        total = np.add.reduceat(fill[order], first)
        merged = pa.ListArray.from_arrays(pa.array(np.append(offsets[first], offsets[-1]), pa.int32()), members.flatten())
        yield pa.RecordBatch.from_arrays([pa.array(total, pa.int64()), pa.array(total >= capacity - slack), merged], ["fill", "done", "members"])

    return items.select("fill", "members").repartition(partitions).mapInArrow(trimmed(run), f"fill long, done boolean, members array<struct<{_PIECE.replace(' ', ':').replace(',:', ',')}>>")


def pack(pieces: DataFrame, capacity: int = CAPACITY, slack: int = SLACK, items: int = ITEMS) -> DataFrame:
    """The pieces with sequence_id and offset."""
    own = F.struct(*[F.col(c.split()[0]) for c in _PIECE.split(", ")])
    bins = pieces.select(F.col("length").alias("fill"), F.array(own).alias("members"))
    full = [bins.where(F.col("fill") >= capacity - slack)]
    under = bins.where(F.col("fill") < capacity - slack)
    left, partitions, before = under.count(), None, None
    while left:
        wanted = -(-left // items)
        narrower = wanted if partitions is None else max(wanted, partitions // 4)
        if narrower == partitions and left == before:
            break  # more bins than a task should hold, and a whole round has merged none of them
        partitions, before = narrower, left
        done = stage(_round(under, partitions, capacity, slack), "bins")
        if partitions == 1:
            under, left = done.where("false"), 0
            full.append(done)
            break
        # a bin that has no room for the least one left will never take another
        least = done.where("not done").agg(F.min("fill")).first()[0]
        open_ = (~F.col("done") & (F.col("fill") <= capacity - least)) if least is not None else F.lit(False)
        full.append(done.where(~open_))
        under = done.where(open_)
        left = under.count()
    full.append(under)
    every = full[0].select("members")
    for part in full[1:]:
        every = every.unionByName(part.select("members"))
    every = every.select(F.monotonically_increasing_id().alias("sequence_id"), "members")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column(1)
            flat = members.flatten()
            sizes = np.diff(members.offsets.to_numpy())
            length = flat.field("length").to_numpy(zero_copy_only=False)
            run = np.cumsum(length) - length
            begin = np.repeat(run[np.cumsum(sizes) - sizes], sizes) if len(run) else run
            yield pa.RecordBatch.from_arrays([*flat.flatten(), pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), sizes)), pa.array(run - begin, pa.int64())], [c.split()[0] for c in _PIECE.split(", ")] + ["sequence_id", "offset"])

    return every.mapInArrow(trimmed(place), f"{_PIECE}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, cache_words: int = CACHE_WORDS, block_chars: int = BLOCK_CHARS, lean: bool = False) -> DataFrame:
    """Pieces of ``docs`` with their place in the sequences."""
    return pack(stage(token_pieces(docs, tokenizer_path, capacity, cache_words, block_chars, lean), "pieces"), capacity)
