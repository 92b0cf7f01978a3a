"""Traversals of an edge table (src, dst, line).

Level loops keep a frontier and the visited nodes in the shared folder; each level
is one join and one anti-join, and its size decides whether the next one runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import names as N
from larkspur.operators.components import connected_components
from larkspur.plans.staging import stage


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int, reverse: bool = False) -> DataFrame:
    """(idx, depth) of every node within ``max_depth`` calls of the seeds (idx), which have depth 0."""
    near, far = ("dst", "src") if reverse else ("src", "dst")
    hop = stage(edges.select(F.col(near).alias("idx"), F.col(far).alias("next")), "hop")
    levels = [stage(seeds.select("idx").distinct(), "frontier")]
    out = levels[0].withColumn("depth", F.lit(0))
    for depth in range(1, max_depth + 1):
        seen = levels[0]
        for level in levels[1:]:
            seen = seen.unionByName(level)
        reached = levels[-1].join(hop, "idx").select(F.col("next").alias("idx")).distinct()
        new = stage(reached.join(seen, "idx", "left_anti"), "frontier")
        if new.isEmpty():
            break
        levels.append(new)
        out = out.unionByName(new.withColumn("depth", F.lit(depth)))
    return out


def shortest_path(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(pos, idx) of one shortest path that ignores direction; ties go to the smallest
    parent, then to the smallest target.  No rows if there is none."""
    edges = stage(edges.select("src", "dst"), "calls")
    hop = stage(edges.select(F.col("src").alias("idx"), F.col("dst").alias("next")).unionByName(edges.select(F.col("dst").alias("idx"), F.col("src").alias("next"))).distinct(), "hop")
    targets = stage(targets.select("idx").distinct(), "targets")
    levels = [stage(sources.select("idx").distinct().withColumn("parent", F.lit(None).cast("long")), "path")]
    while True:
        hit = levels[-1].join(targets, "idx", "left_semi").agg(F.min("idx")).first()[0]
        if hit is not None:
            path, at = [], hit
            for level in reversed(levels):  # one row a level
                path.append(at)
                at = level.where(F.col("idx") == at).first()["parent"]
            return edges.sparkSession.createDataFrame(list(enumerate(reversed(path))), "pos int, idx long")
        # without direction a step leads to the level itself, the one before or a new one
        seen = levels[-1].select("idx")
        if len(levels) > 1:
            seen = seen.unionByName(levels[-2].select("idx"))
        reached = _step(levels[-1], hop)
        new = stage(reached.join(seen, "idx", "left_anti"), "path")
        if new.isEmpty():
            break
        levels.append(new)
    return edges.sparkSession.createDataFrame([], "pos int, idx long")


def _step(level: DataFrame, hop: DataFrame) -> DataFrame:
    return level.select(F.col("idx").alias("from")).join(hop, F.col("from") == F.col("idx")).groupBy(F.col("next").alias("idx")).agg(F.min("from").alias("parent"))


def with_traits(seeds: DataFrame, impls: DataFrame) -> DataFrame:
    """Seeds (idx) with the impls of seed traits and the traits of seed impls (trait_idx, impl_idx)."""
    down = seeds.join(impls, F.col("idx") == F.col("trait_idx")).select(F.col("impl_idx").alias("idx"))
    up = seeds.join(impls, F.col("idx") == F.col("impl_idx")).select(F.col("trait_idx").alias("idx"))
    return seeds.select("idx").unionByName(down).unionByName(up).distinct()


def clusters(chunks: DataFrame, edges: DataFrame, min_lines: int = 50) -> DataFrame:
    """Connected groups of functions of one file: file, component, members, lines, split_candidate."""
    functions = chunks.where("kind = 'function'").select("idx", "file", (F.col("end_line") - F.col("start_line") + 1).alias("lines"))
    a, b = functions.select(F.col("idx").alias("src"), F.col("file").alias("fa")), functions.select(F.col("idx").alias("dst"), F.col("file").alias("fb"))
    inner = edges.select("src", "dst").join(a, "src").join(b, "dst").where("fa = fb").select("src", "dst")
    found = connected_components(inner)
    grouped = functions.join(found, F.col("idx") == F.col("node"), "left").select("file", F.coalesce("component", "idx").alias("component"), "lines")
    return grouped.groupBy("file", "component").agg(F.count(F.lit(1)).alias("members"), F.sum("lines").cast("long").alias("lines")).withColumn("split_candidate", F.col("lines") >= min_lines)


def flow_tree(chunks: DataFrame, edges: DataFrame, roots: int | list[int], max_depth: int) -> DataFrame:
    """(pos, depth, idx, back) of the pre-order call tree from one or several roots: a node
    is expanded at its first visit only, also where that is at the greatest depth; later
    visits are back references.  Tests and derived noise are left out below the roots.

    Which visit is first depends on the whole walk, so the part of the graph within
    the depth, gathered by Spark, is walked in one place."""
    spark, roots = edges.sparkSession, [roots] if isinstance(roots, int) else list(roots)
    start = spark.createDataFrame([(r,) for r in roots], "idx long")
    edges = stage(edges.select("src", "dst"), "calls")
    near = stage(bfs(edges, start, max(max_depth - 1, 0)).select("idx"), "near")
    shown = chunks.where(~F.col("is_test") & ~N.is_derived_noise(F.col("name"))).select(F.col("idx").alias("dst"))
    local = edges.join(near.withColumnRenamed("idx", "src"), "src", "left_semi").join(shown, "dst", "left_semi").distinct()
    gathered = local.agg(F.sort_array(F.collect_list(F.struct("src", "dst"))).alias("edges"))

    def walk(frames):
        import pandas as pd

        for frame in frames:
            for edges_ in frame["edges"]:
                callees: dict[int, list[int]] = {}
                for e in edges_:
                    callees.setdefault(e["src"], []).append(e["dst"])
                rows, met = [], set()
                for root in roots:
                    stack = [(root, 0)]
                    while stack:
                        node, depth = stack.pop()
                        back = node in met and depth > 0
                        rows.append((len(rows), depth, node, back))
                        met.add(node)
                        if not back and depth < max_depth:
                            stack.extend((c, depth + 1) for c in reversed(callees.get(node, ())))
                yield pd.DataFrame(rows, columns=["pos", "depth", "idx", "back"])

    return gathered.mapInPandas(walk, "pos int, depth int, idx long, back boolean")


def render_tree(tree: DataFrame, chunks: DataFrame) -> DataFrame:
    """(pos, line) of a call tree as text: branches, file and lines, name, marks of tests and back references.

    A tree is a report for one reader: its lines are drawn in one task."""
    marks = F.concat(F.when(F.col("is_test"), " [test]").otherwise(""), F.when(F.col("back"), "  \u21a9").otherwise(""))
    label = F.concat("file", N.line_suffix(F.col("start_line"), F.col("end_line")), F.lit("  "), N.shown_name(F.col("display_name"), F.col("name")), marks)
    named = tree.join(chunks, "idx").select("pos", "depth", label.alias("label"))

    def draw(frames):
        import pandas as pd

        rows = pd.concat(list(frames)).sort_values("pos", ascending=False)
        lines, goes_on = [], set()  # depths at which a sibling follows
        for pos, depth, label in rows.itertuples(index=False):
            stem = "".join("\u2502   " if d in goes_on else "    " for d in range(1, depth))
            arrow = ("  " + stem + ("\u251c" if depth in goes_on else "\u2514") + "\u2500\u2192 ") if depth else ""
            lines.append((pos, arrow + label))
            goes_on = {d for d in goes_on if d < depth} | {depth}
        yield pd.DataFrame(lines[::-1], columns=["pos", "line"])

    return named.coalesce(1).mapInPandas(draw, "pos int, line string")
