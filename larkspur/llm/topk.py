"""Exact top-k inner products by a three-phase uniform threshold.

A vector's components are split into ``LISTS`` runs; the products of a query with
one run of every vector are one list of local scores, and a score is their sum.
Vectors are dealt into blocks, and every block of queries meets every block of
vectors once per phase.

1. Each meeting gathers, per query and list, the ``k`` best local scores with what
   they sum to.  The k-th best sum over all meetings is a safe cutoff: k vectors
   reach it.
2. The cutoffs go out with the query blocks.  A vector that reaches the cutoff
   has at least the cutoff divided by the number of lists in some list; each
   meeting collects these entries.
3. Their remaining local scores are resolved exactly in place, since a block holds
   whole vectors, and at most k of those that reach the cutoff leave a meeting.

Sums over meetings are merged by two levels of grouping, ``GROUPS`` groups of
meetings first, so that no task gets all lists of a query.

Scores are exact: components become floor(scale * x) and products are summed as
float64 while they stay under 2**53, else as Python integers clipped to a long.

Cases.  Null vectors, vectors that hold a null or non-finite component and rows
with null id take no part.  Vectors meet only vectors of the same length; length
zero scores 0.  Ties go to the smaller id.  A query's own row is every row of its
id.  Repeated candidate rows are candidates of their own; of repeated query rows
the one with the greatest usable vector is the query.  Fewer than k candidates: all.  An
empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.plans.staging import stage

K, SCALE, LISTS = 20, 64.0, 2
#: Rows of a block of vectors and of queries.
BLOCK, QUERY_BLOCK = 4096, 1024
#: Groups of meetings whose lists are merged first.
GROUPS = 64
_NONE = -(1 << 63)


def _blocks(rows: DataFrame, size: int, scale: float) -> DataFrame:
    """Blocks (dim, ids, matrix of float64) of at most ``size`` usable vectors of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {}

        def block(dim: int, some: list) -> pa.RecordBatch:
            ids = np.array([i for i, _ in some], np.int64)
            matrix = np.array([v for _, v in some], np.float64).reshape(len(some), dim)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([matrix.tobytes()], pa.binary())], ["dim", "ids", "matrix"])

        for batch in batches:
            for i, vector in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if i is None or not vector.is_valid or vector.values.null_count:
                    continue
                v = np.floor(scale * vector.values.to_numpy(zero_copy_only=False).astype(np.float64))
                if np.isfinite(v).all():
                    some = held.setdefault(len(v), [])
                    some.append((i, v))
                    if len(some) == size:
                        yield block(len(v), held.pop(len(v)))
        for dim, some in held.items():
            yield block(dim, some)

    return rows.mapInArrow(run, "dim int, ids array<long>, matrix binary")


def local_scores(queries: np.ndarray, vectors: np.ndarray, lists: int) -> list[np.ndarray]:
    """Score of every (query, vector) in each list, exact."""
    bound = float(np.abs(queries).max(initial=0.0)) * float(np.abs(vectors).max(initial=0.0)) * max(1, queries.shape[1])
    if bound >= 2.0**53:
        exact = np.array([[int(x) for x in row] for row in vectors.tolist()], object).reshape(vectors.shape)
        queries, vectors = np.array([[int(x) for x in row] for row in queries.tolist()], object).reshape(queries.shape), exact
    elif bound < 2.0**24:
        queries, vectors = queries.astype(np.float32), vectors.astype(np.float32)  # still exact, and half the memory
    edges = np.linspace(0, queries.shape[1], lists + 1).astype(int)
    return [queries[:, a:b] @ vectors[:, a:b].T if b > a else np.zeros((len(queries), len(vectors)), queries.dtype) for a, b in zip(edges, edges[1:], strict=False)]


def _total(parts: list[np.ndarray]) -> np.ndarray:
    total = sum(parts[1:], parts[0])
    return np.clip(total, -(2**63), 2**63 - 1).astype(np.int64) if total.dtype == object else total.astype(np.int64)


def gather(queries: np.ndarray, vectors: np.ndarray, own: np.ndarray, k: int, lists: int) -> np.ndarray:
    """Phase 1: (queries, k) best sums among the k best of every list; ``own`` marks
    pairs that don't count.  Missing ones are the least long."""
    parts = local_scores(queries, vectors, lists)
    total = _total(parts)
    total[own] = _NONE
    n = total.shape[1]
    rows = np.arange(len(total))[:, None]
    taken = np.zeros(total.shape, bool)
    for part in parts:
        part = part.astype(np.float64)
        part[own] = -np.inf
        taken[rows, np.argpartition(part, n - k, axis=1)[:, n - k :] if n > k else np.arange(n)[None, :]] = True
    total[~taken] = _NONE
    best = np.sort(total, axis=1)[:, ::-1][:, :k] if n <= k else np.sort(np.partition(total, n - k, axis=1)[:, n - k :], axis=1)[:, ::-1]
    return np.pad(best, ((0, 0), (0, k - best.shape[1])), constant_values=_NONE)


def resolve(queries: np.ndarray, vectors: np.ndarray, own: np.ndarray, ids: np.ndarray, cutoff: np.ndarray, k: int, lists: int) -> list[np.ndarray]:
    """Phases 2 and 3: arrays (query, vector, score) of the best k pairs of each query that reach its cutoff."""
    parts = local_scores(queries, vectors, lists)
    least = cutoff / lists  # float: rounding is made harmless by the slack
    slack = np.abs(least) * 1e-12 + 1e-6
    enough = np.zeros(own.shape, bool)
    for part in parts:
        enough |= part >= (least - slack)[:, None]
    q, v = np.nonzero(enough & ~own)
    score = _total([part[q, v] for part in parts])
    reach = score >= cutoff[q]
    q, v, score = q[reach], v[reach], score[reach]
    order = np.lexsort((ids[v], ~score, q))  # ~x falls as x rises, without overflow
    q, v, score = q[order], v[order], score[order]
    nth = np.arange(len(q)) - np.searchsorted(q, q)
    return [q[nth < k], ids[v[nth < k]], score[nth < k]]


def _meetings(queries: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every query block with every block of vectors of its length, by an equi-join on the pair's name."""
    counts = {r["dim"]: (r["q"], r["b"]) for r in queries.groupBy("dim").agg(F.max("block").alias("q")).join(blocks.groupBy("dim").agg(F.max("block").alias("b")), "dim").collect()}
    if not counts:
        counts = {-1: (0, 0)}
    most = lambda k: F.create_map(*[F.lit(x) for dim, n in counts.items() for x in (dim, n[k])])[F.col("dim")]
    every = lambda top: F.explode(F.sequence(F.lit(0), top))
    left = queries.withColumnRenamed("block", "q_block").withColumn("v_block", every(most(1)))
    right = blocks.withColumnRenamed("block", "v_block").withColumn("q_block", every(most(0)))
    return left.join(right, ["dim", "q_block", "v_block"])


def _numbered(blocks: DataFrame) -> DataFrame:
    """Blocks with a number from 0 within their length. One row per block, without its data, is ranked."""
    named = blocks.withColumn("mid", F.monotonically_increasing_id())
    small = named.select("dim", "mid").withColumn("block", (F.row_number().over(Window.partitionBy("dim").orderBy("mid")) - 1).cast("int")).drop("dim")
    return named.join(small, "mid").drop("mid")


def _matrix(raw: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(raw, np.float64).reshape(n, dim)


def _meeting(batch: pa.RecordBatch, row: int) -> tuple:
    dim = batch.column("dim")[row].as_py()
    q_ids, v_ids = (batch.column(c)[row].values.to_numpy() for c in ("q_ids", "v_ids"))
    return q_ids, v_ids, _matrix(batch.column("q_matrix")[row].as_py(), len(q_ids), dim), _matrix(batch.column("v_matrix")[row].as_py(), len(v_ids), dim)


def exact_top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: float = SCALE, lists: int = LISTS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for every row where ``is_query``."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("asks"))
    finite = lambda x: F.coalesce(F.abs(F.lit(scale) * x) < float("inf"), F.lit(False))  # noqa: E731  # NaN is above infinity
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite))
    blocks = _numbered(stage(_blocks(rows.select("id", "v"), BLOCK, scale), "blocks")).select("dim", "block", F.col("ids").alias("v_ids"), F.col("matrix").alias("v_matrix"))
    asking = rows.where("asks").groupBy("id").agg(F.max("v").alias("v"))
    asked = _numbered(stage(_blocks(asking, QUERY_BLOCK, scale), "queries")).select("dim", "block", F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"))
    meetings = _meetings(asked, blocks)

    def phase_1(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                q_ids, v_ids, q, v = _meeting(batch, row)
                best = gather(q, v, q_ids[:, None] == v_ids[None, :], k, lists)
                offsets = pa.array(np.arange(0, best.size + 1, k), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(q_ids), pa.array(np.full(len(q_ids), batch.column("v_block")[row].as_py()), pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(best.ravel()))], ["query_id", "v_block", "best"])

    def merged(frame: DataFrame, *keys: str) -> DataFrame:
        return frame.groupBy(*keys).agg(F.slice(F.sort_array(F.flatten(F.collect_list("best")), False), 1, k).alias("best"))

    lists_1 = meetings.mapInArrow(phase_1, "query_id long, v_block int, best array<long>")
    part = F.pmod("v_block", F.lit(GROUPS)).alias("part")
    cutoffs = stage(merged(merged(lists_1.select("query_id", part, "best"), "query_id", "part"), "query_id").select("query_id", F.element_at("best", k).alias("cutoff")), "cutoffs")
    # the cutoffs of a query block go with it, in the order of its ids
    places = asked.select("dim", "block", F.posexplode("q_ids").alias("pos", "query_id"))
    by_block = places.join(cutoffs, "query_id").groupBy("dim", "block").agg(F.sort_array(F.collect_list(F.struct("pos", "cutoff"))).getField("cutoff").alias("cutoffs"))
    ready = _meetings(asked.join(by_block, ["dim", "block"]), blocks)

    def phase_2(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                q_ids, v_ids, q, v = _meeting(batch, row)
                cutoff = batch.column("cutoffs")[row].values.to_numpy()
                at, ids, score = resolve(q, v, q_ids[:, None] == v_ids[None, :], v_ids, cutoff, k, lists)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[at]), pa.array(np.full(len(at), batch.column("v_block")[row].as_py()), pa.int32()), pa.array(ids), pa.array(score)], ["query_id", "v_block", "vec_id", "score"])

    entries = ready.mapInArrow(phase_2, "query_id long, v_block int, vec_id long, score long")

    def ranked(frame: DataFrame, *keys: str) -> DataFrame:
        order = F.struct(F.bitwise_not("score").alias("a"), F.col("vec_id").alias("b"))
        return frame.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list(order)), 1, k).alias("best"))

    first = ranked(entries.select("query_id", part, "vec_id", "score"), "query_id", "part")
    final = first.groupBy("query_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    return final.select("query_id", F.posexplode("best").alias("nth", "x")).select("query_id", (F.col("nth") + 1).cast("int").alias("rank"), F.col("x.b").alias("vec_id"), F.bitwise_not("x.a").alias("score"))


ORACLE = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
     q AS (SELECT * FROM v WHERE vec_id % 20 = 0),
     s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score FROM q JOIN v ON q.vec_id <> v.vec_id),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
