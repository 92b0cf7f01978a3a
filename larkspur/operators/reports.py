"""Reports over symbols and calls: search, statistics, dead code, context and blast radius."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import names as N
from larkspur.functions import paths as P
from larkspur.operators.graph import bfs, with_traits

# Roles by priority.
ROLES = ("def", "trait", "type", "caller", "callee", "test")


def is_test(chunks_columns: str = "") -> Column:
    return F.col("is_test") | P.is_test_path(F.col("file"))


def crate(default_name: str | None = None) -> Column:
    return F.coalesce(F.nullif(F.col("crate_name"), F.lit("")), P.crate_of(F.col("file"), default_name))


def search(chunks: DataFrame, pattern: str, kind: str | None = None, exclude_tests: bool = False, limit: int | None = None) -> DataFrame:
    """Symbols whose name or display name contains the pattern in any case, or whose
    file ends with it if it looks like a path; ordered by file, then idx."""
    low = pattern.lower()
    hit = F.lower("name").contains(low) | F.lower("display_name").contains(low)
    if P.looks_like_path(pattern):
        hit = hit | F.lower("file").endswith(low)
    out = chunks.where(hit)
    if kind:
        out = out.where(F.lower("kind") == kind.lower())
    if exclude_tests:
        out = out.where(~is_test())
    if limit:
        out = out.orderBy("idx").limit(limit)
    return out.select("idx", "name", "display_name", "kind", "file", "start_line", "end_line")


def similar_names(chunks: DataFrame, name: str, limit: int = 5) -> DataFrame:
    """Symbols whose display name contains the name or is contained in it, first by idx."""
    low = name.lower()
    display = F.lower(N.shown_name(F.col("display_name"), F.col("name")))
    return chunks.where(display.contains(low) | F.lit(low).contains(display)).orderBy("idx").limit(limit).select("idx", "display_name")


def stats(chunks: DataFrame, totals: bool = False) -> DataFrame:
    """Functions in use and in tests, structs and enums by crate; with ``totals`` a row (all)."""
    function = F.col("kind") == "function"
    rows = chunks.select(crate().alias("crate"), "kind", is_test().alias("test"))
    grouped = rows.rollup("crate") if totals else rows.groupBy("crate")
    out = grouped.agg(
        F.count_if(function & ~F.col("test")).alias("prod_fns"),
        F.count_if(function & F.col("test")).alias("test_fns"),
        F.count_if(F.col("kind") == "struct").alias("structs"),
        F.count_if(F.col("kind") == "enum").alias("enums"),
    )
    return out.withColumn("crate", F.coalesce("crate", F.lit("(all)")))


def coverage(files: DataFrame) -> DataFrame:
    """Functions and lines covered by crate of (filename, functions, lines as structs of count and covered); percentages with one decimal, null of nothing."""
    rate = lambda part, whole: F.round(F.try_divide(F.lit(100.0) * F.col(part), F.col(whole)), 1)
    sums = files.groupBy(P.crate_of(F.col("filename")).alias("crate")).agg(
        *[F.sum(f"{what}.{n}").cast("long").alias(f"{short}_{n}") for what, short in (("functions", "fn"), ("lines", "line")) for n in ("count", "covered")]
    )
    return sums.withColumn("fn_pct", rate("fn_covered", "fn_count")).withColumn("line_pct", rate("line_covered", "line_count"))


def coverage_with_total(files: DataFrame, totals: DataFrame) -> DataFrame:
    """:func:`coverage` by crate and a row (total) of the document's own totals, which no filter of files changes."""
    rate = lambda part, whole: F.round(F.try_divide(F.lit(100.0) * F.col(part), F.col(whole)), 1)
    sums = totals.agg(*[F.sum(f"{what}.{n}").cast("long").alias(f"{short}_{n}") for what, short in (("functions", "fn"), ("lines", "line")) for n in ("count", "covered")])
    total = sums.select(F.lit("(total)").alias("crate"), "*").withColumn("fn_pct", rate("fn_covered", "fn_count")).withColumn("line_pct", rate("line_covered", "line_count"))
    return coverage(files).unionByName(total)


def edge_totals(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("src").alias("callers"), F.count_distinct("dst").alias("callees"))


def dead_candidates(chunks: DataFrame, edges: DataFrame, include_pub: bool = False, file: str | None = None) -> DataFrame:
    """Functions in use that nothing calls, without generated, entry and trait ones."""
    name, signature = F.col("name"), F.coalesce("signature", F.lit(""))
    together = F.count(F.lit(1)).over(Window.partitionBy("file", "start_line"))
    placed = chunks.withColumn("together", F.when(F.col("start_line").isNotNull(), together).otherwise(1))
    out = placed.where((F.col("kind") == "function") & ~is_test() & ~N.is_derive_generated(name) & ~N.is_macro_name(name))
    out = out.where(~((signature == "") & (F.col("together") >= 2)))
    if file:
        out = out.where(F.col("file").contains(file))
    if not include_pub:
        out = out.where(~(signature.startswith("pub ") | signature.startswith("pub(crate)")))
    out = out.where(~(name.startswith("<") & name.contains(" as ")) & (name != "main") & ~name.endswith("::main") & P.is_code_file(F.col("file")))
    out = out.where(~name.contains("::check::assert_impl") & ~name.contains("::{closure#0}::check"))
    out = out.join(edges.select(F.col("dst").alias("idx")).distinct(), "idx", "left_anti")
    leaf_news = out.where(name.endswith("::new")).join(edges.select(F.col("src").alias("idx")).distinct(), "idx", "left_anti").select("idx")
    return out.join(leaf_news, "idx", "left_anti").drop("together")


def with_staleness(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """``chunks`` with stale: the file (file, n_lines) is gone or shorter than the symbol."""
    known = files.select("file", "n_lines")
    return chunks.join(known, "file", "left").withColumn("stale", F.col("n_lines").isNull() | F.coalesce(F.col("end_line") > F.col("n_lines"), F.lit(False))).drop("n_lines")


def dead_code(chunks: DataFrame, edges: DataFrame, files: DataFrame, **how) -> DataFrame:
    found = with_staleness(dead_candidates(chunks, edges, **how), files)
    return found.where(~F.col("stale")).select(crate().alias("crate"), "idx", "name", "file")


def path_aliases(chunks: DataFrame) -> DataFrame:
    """(dir, alias): source roots as [A] to [Z] in order, their folders numbered from 1."""
    dirs = chunks.select(P.folder_of(F.col("file")).alias("dir")).where("dir is not null").distinct()
    parts = dirs.select(F.regexp_extract("dir", r"^(.*?/src/)", 1).alias("root"), F.regexp_replace("dir", r"^.*?/src/", "").alias("sub")).where("root <> ''")
    roots = parts.select("root").distinct().withColumn("n", F.row_number().over(Window.orderBy("root"))).where("n <= 26")
    letter = F.char(F.col("n") + 64)
    numbered = parts.where("sub <> ''").withColumn("k", F.row_number().over(Window.partitionBy("root").orderBy("sub"))).join(roots, "root")
    top = roots.select(F.col("root").alias("dir"), F.concat(F.lit("["), letter, F.lit("]")).alias("alias"))
    return top.unionByName(numbered.select(F.concat("root", "sub").alias("dir"), F.concat(F.lit("["), letter, F.col("k").cast("string"), F.lit("]")).alias("alias")))


def aliased(chunks: DataFrame, aliases: DataFrame) -> DataFrame:
    """``chunks`` with shown_file: the folder's alias and the file's name, else the file."""
    joined = chunks.withColumn("dir", P.folder_of(F.col("file"))).join(aliases, "dir", "left")
    return joined.withColumn("shown_file", F.coalesce(F.concat("alias", F.substring_index("file", "/", -1)), "file")).drop("dir", "alias")


def blast(chunks: DataFrame, edges: DataFrame, seeds: DataFrame, impls: DataFrame | None = None, depth: int = 2, scope: str | None = None) -> DataFrame:
    """(idx, depth, test) of everything that reaches the seeds; a depth of one is taken as two."""
    start = with_traits(seeds, impls) if impls is not None else seeds
    reached = bfs(edges, start, 2 if depth == 1 else depth, reverse=True)
    out = reached.join(chunks.select("idx", "file", is_test().alias("test")), "idx")
    if scope:
        out = out.where(F.col("file").contains(scope))
    return out.select("idx", "depth", "test")


def blast_counts(blasted: DataFrame) -> DataFrame:
    far = F.col("depth") > 0
    return blasted.agg(F.count_if(far & ~F.col("test")).alias("prod"), F.count_if(far & F.col("test")).alias("tests"))


def context(chunks: DataFrame, edges: DataFrame, type_refs: DataFrame, seeds: DataFrame, impls: DataFrame, depth: int = 1) -> DataFrame:
    """(idx, role, depth, call_line): the first role of each symbol around the seeds."""
    start = with_traits(seeds, impls)
    flags = chunks.select("idx", is_test().alias("test"), N.is_derived_noise(F.col("name")).alias("noise"))
    up = bfs(edges, start, depth, reverse=True).where("depth > 0").join(flags, "idx")
    down = bfs(edges, start, depth).where("depth > 0").join(flags, "idx").where("not noise and not test")
    role = lambda df, name: df.select("idx", F.lit(name).alias("role"), F.col("depth"))
    types = type_refs.join(start.withColumnRenamed("idx", "src"), "src", "left_semi").select(F.col("dst").alias("idx"), F.lit(1).alias("depth"))
    found = role(seeds.select("idx", F.lit(0).alias("depth")), "def").unionByName(role(start.join(seeds, "idx", "left_anti").withColumn("depth", F.lit(0)), "trait")).unionByName(role(types, "type"))
    found = found.unionByName(role(up.where("not test"), "caller")).unionByName(role(down, "callee")).unionByName(role(up.where("test"), "test"))
    priority = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role"))
    best = found.groupBy("idx").agg(F.min(F.struct(priority.alias("p"), "depth", "role")).alias("b")).select("idx", "b.role", "b.depth")
    site = edges.join(start.withColumnRenamed("idx", "dst"), "dst", "left_semi").groupBy(F.col("src").alias("idx")).agg(F.min("line").alias("up_line"))
    return best.join(site, "idx", "left").select("idx", "role", "depth", F.when(F.col("role").isin("caller", "test"), F.coalesce("up_line", F.lit(0))).otherwise(0).cast("int").alias("call_line"))


def shared_callers(impls: DataFrame, edges: DataFrame) -> DataFrame:
    """(trait_idx, caller, n, shared) of callers of a trait's impls: shared if they call
    more than one and at least half of the impls."""
    size = impls.groupBy("trait_idx").agg(F.count_distinct("impl_idx").alias("impls"))
    calls = impls.join(edges, F.col("impl_idx") == F.col("dst")).groupBy("trait_idx", F.col("src").alias("caller")).agg(F.count_distinct("impl_idx").alias("n"))
    return calls.join(size, "trait_idx").select("trait_idx", "caller", "n", ((F.col("n") > 1) & (F.col("n") >= F.ceil(F.col("impls") / 2))).alias("shared"))


def ranked_by_recent(chunks: DataFrame, recents: DataFrame, most: int = 30) -> DataFrame:
    """``chunks`` with score: a recent exact name (name, ord from 0) gives 100 and its
    recency, a recent owner 80; recency is 30 less the place, 1 at least."""
    gain = F.greatest(F.lit(most) - F.col("ord"), F.lit(1))
    recent = recents.where(F.col("ord") < most).select(F.lower("name").alias("key"), gain.alias("gain")).groupBy("key").agg(F.max("gain").alias("gain"))
    exact = recent.select("key", (F.col("gain") + 100).alias("exact"))
    owner = recent.select(F.col("key").alias("owner"), (F.col("gain") + 80).alias("by_owner"))
    out = chunks.withColumn("key", F.lower("display_name")).withColumn("owner", N.owning_type(F.col("name"))).join(exact, "key", "left").join(owner, "owner", "left")
    return out.withColumn("score", F.coalesce(F.greatest("exact", "by_owner"), F.lit(0)).cast("int")).drop("key", "owner", "exact", "by_owner")


def methods_of(chunks: DataFrame, type_name: str) -> DataFrame:
    """Functions whose owner is the type, generics aside, or whose name has no owner and contains it."""
    leaf = type_name.lower().rpartition("::")[2].partition("<")[0]
    owner = N.strip_generics(N.owning_type(F.col("name")))
    return chunks.where((F.col("kind") == "function") & F.when(owner.isNotNull(), owner == leaf).otherwise(F.lower("name").contains(leaf)))


def summary(roles: DataFrame, chunks: DataFrame, top: int = 5) -> DataFrame:
    """(role, names, more): the first symbols of each role of a context and how many follow."""
    named = roles.join(chunks.select("idx", "display_name"), "idx")
    order = F.struct("depth", "idx", "display_name")
    found = named.groupBy("role").agg(F.slice(F.sort_array(F.collect_list(order)), 1, top).alias("x"), F.count(F.lit(1)).alias("n"))
    return found.select("role", F.transform("x", lambda r: r["display_name"]).alias("names"), F.greatest(F.col("n") - top, F.lit(0)).alias("more"))


def by_file(pairs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(file, pairs, names) of pairs (a, b) by the first one's file, most pairs first."""
    shown = lambda s: chunks.select(F.col("idx").alias(s), N.shown_name(F.col("display_name"), F.col("name")).alias(f"name_{s}"))
    named = pairs.join(shown("a"), "a").join(shown("b"), "b").join(chunks.select(F.col("idx").alias("a"), "file"), "a")
    text = F.concat("name_a", F.lit(" ~ "), "name_b")
    file = F.when(F.col("file") == "", "(unknown)").otherwise(F.col("file"))
    return named.groupBy(file.alias("file")).agg(F.count(F.lit(1)).alias("pairs"), F.array_sort(F.collect_list(text)).alias("names")).orderBy(F.desc("pairs"), "file")


def unresolved_calls(chunks: DataFrame, calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, call, line) of named calls (src, call, line) that say something and lead to no symbol: no edge
    of the caller goes to one of that last segment."""
    last = lambda c: F.substring_index(F.lower(N.last_segment(c)), ".", -1)
    known = edges.join(chunks.select(F.col("idx").alias("dst"), last(F.col("name")).alias("leaf")), "dst").select("src", "leaf").distinct()
    asked = calls.where(~N.is_noise(F.col("call"))).withColumn("leaf", last(F.col("call")))
    return asked.join(known, ["src", "leaf"], "left_anti").groupBy("src", "call").agg(F.min("line").alias("line"))


def impl_callees(impls: DataFrame, edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """(trait_idx, method, impls, callees): what the implementations of each method call, by the method's name."""
    named = impls.join(chunks.select(F.col("idx").alias("impl_idx"), N.last_segment(F.col("name")).alias("method")), "impl_idx")
    calls = named.join(edges.select(F.col("src").alias("impl_idx"), F.col("dst").alias("callee")), "impl_idx", "left")
    return calls.groupBy("trait_idx", "method").agg(F.count_distinct("impl_idx").alias("impls"), F.count_distinct("callee").alias("callees"))


def depth_tag(depth: Column) -> Column:
    return F.when(depth <= 0, "").otherwise(F.concat(F.lit("d"), depth.cast("string")))


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON text per row."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))
