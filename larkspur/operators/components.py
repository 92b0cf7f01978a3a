"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.plans.staging import drop_staged, stage, stage_at

#: Edges beyond which the minima are staged: then a hub's rows can be split where they meet its minimum.
SPLIT_EDGES = 2_000_000


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with an edge; component is its smallest node.

    Each round hangs every node's larger neighbours on its smallest neighbour
    (large star), then its smaller neighbours too (small star), so that a path
    halves per round and the table of edges never grows.  A node's minimum is a
    map-side combined aggregate joined back; from ``SPLIT_EDGES`` on it is staged
    first, so that the adaptive skew join can split a node with very many neighbours.  Self edges and edges with a
    null end are dropped; repeated edges count once.
    """
    spark = edges.sparkSession
    pairs = (
        edges.select(F.greatest(src, dst).alias("hi"), F.least(src, dst).alias("lo"))
        .where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
        .distinct()
    )
    now, path = stage_at(pairs, "edges")
    mark = None
    for _ in range(max_rounds):
        new = _mark(now)
        if new == mark or new[0] == 0:
            break
        mark = new
        old, (now, path) = path, stage_at(_small_star(_large_star(now, new[0]), new[0]), "edges")
        drop_staged(spark, old)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    leaves = now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return leaves.unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    """Changes whenever the set of edges does: its size and a sum of hashes."""
    row = edges.agg(F.count(F.lit(1)), F.sum((F.xxhash64("hi", "lo") % 1_000_000_007).cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _minima(least: DataFrame, edges: int) -> DataFrame:
    return stage(least, "minima") if edges > SPLIT_EDGES else least


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = _minima(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), n)
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    least = _minima(edges.groupBy("hi").agg(F.min("lo").alias("m")), n)
    moved = edges.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()
