"""Names to symbols: key tables and prioritised cascades of equi-joins.

A cascade is a table of keys with a rank per kind of key.  The best rank of each
call is found with ``min_by``, so a cascade is one join and one aggregate however
many kinds of key it has.  What distinct texts resolve to is staged before all
calls meet it: of two plain tables the adaptive skew join can split a hot name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import names as N
from larkspur.functions import paths as P
from larkspur.plans.staging import stage


def symbol_keys(chunks: DataFrame) -> DataFrame:
    """(space, key, idx): exact and short keys, each with the symbol it names.

    Exact: the full lower-case name (the last symbol of a name wins) before the
    aliases (the first wins): without generics, the display name, owner::method,
    Concrete::method.  Short: last segments; the first symbol wins.
    """
    lower = F.lower("name")
    prefix, method = N.before_last_segment(lower), N.last_segment(lower)
    concrete = F.when(prefix.contains(" for "), F.regexp_extract(prefix, r"(?s)^.*? for (.*)$", 1))
    leaf = F.substring_index(N.last_segment(concrete), "<", 1)
    display = F.nullif(F.lower("display_name"), F.lit(""))

    def key(space: str, tier: int, value: Column) -> Column:
        return F.struct(F.lit(space).alias("space"), F.lit(tier).alias("tier"), value.alias("key"))

    keys = F.array(
        key("exact", 0, lower),
        key("exact", 1, N.strip_generics(lower)),
        key("exact", 1, display),
        key("exact", 1, F.when(N.before_last_segment(prefix).isNotNull(), F.concat(N.last_segment(prefix), F.lit("::"), method))),
        key("exact", 1, F.when(leaf != "", F.concat(leaf, F.lit("::"), method))),
        key("short", 1, method),
        key("short", 1, F.when(lower.contains("."), F.substring_index(lower, ".", -1))),
        key("short", 1, N.last_segment(display)),
    )
    each = chunks.select("idx", F.explode(keys).alias("k")).select("idx", "k.*").where("key is not null")
    # the last full name, else the first alias
    order = F.struct(F.col("tier"), F.when(F.col("tier") == 0, -F.col("idx")).otherwise(F.col("idx")))
    return each.groupBy("space", "key").agg(F.min_by("idx", order).alias("idx"))


def resolve_by_name(calls: DataFrame, chunks: DataFrame) -> DataFrame:
    """(src, dst, line) of named calls (src, call, line): exact, else short by the
    last ``::``, else short by the last dot; unresolved and self calls are dropped,
    repeated ones keep their least line."""
    lower = F.lower("call")
    short, dotted = N.last_segment(lower), F.substring_index(lower, ".", -1)
    tries = F.array(
        F.struct(F.lit(0).alias("rank"), F.lit("exact").alias("space"), lower.alias("key")),
        F.struct(F.lit(1).alias("rank"), F.lit("short").alias("space"), short.alias("key")),
        F.struct(F.lit(2).alias("rank"), F.lit("short").alias("space"), dotted.alias("key")),
    )
    # calls of one text resolve alike: the cascade runs over distinct texts
    texts = calls.select("call").distinct()
    found = texts.select("call", F.explode(tries).alias("t")).select("call", "t.*").join(symbol_keys(chunks), ["space", "key"]).groupBy("call").agg(F.min_by("idx", "rank").alias("dst"))
    return calls.join(stage(found, "found"), "call").where("src <> dst").groupBy("src", "dst").agg(F.min("line").alias("line"))


def resolve_by_location(calls: DataFrame, chunks: DataFrame) -> DataFrame:
    """(src, line, callee_file, callee_line, dst) by :func:`place_hits`."""
    own = calls.select("src", "line", "callee_file", "callee_line", F.lower("callee_file").alias("place"))
    return own.join(place_hits(calls, chunks), ["place", "callee_line"]).select("src", "line", "callee_file", "callee_line", "dst")


def place_hits(calls: DataFrame, chunks: DataFrame) -> DataFrame:
    """(place, callee_line, dst) of the distinct places that calls (callee_file, callee_line) go to:
    file in any case or as a suffix of the other, line as given, else one more, else
    one less; of symbols that start on one line the last wins."""
    located = chunks.where("start_line is not null and not (start_line = 0 and end_line = 0)")
    starts = located.groupBy(F.lower("file").alias("file"), "start_line").agg(F.max("idx").alias("idx"))
    deltas = F.array(*[F.struct(F.lit(r).alias("rank"), F.lit(d).alias("delta")) for r, d in enumerate((0, 1, -1))])
    places = calls.select(F.lower("callee_file").alias("place"), "callee_line").where("place <> '' and callee_line > 0").distinct()
    whole = starts.select("file").distinct()
    equal = places.select("place").distinct().join(whole, F.col("place") == F.col("file"), "left").select("place", F.col("file").alias("equal"))
    # suffixes only where no file is equal: by the last path component, an equi-join, then the longer name's end
    last = lambda c: F.substring_index(c, "/", -1)
    odd = equal.where("equal is null").select("place", last("place").alias("leaf"))
    fits = F.col("file").endswith(F.col("place")) | F.col("place").endswith(F.col("file"))
    suffix = odd.join(whole.withColumn("leaf", last("file")), "leaf").where(fits).select("place", "file")
    files = equal.where("equal is not null").select("place", F.col("equal").alias("file")).unionByName(suffix)
    tried = places.select("place", "callee_line", F.explode(deltas).alias("d")).select("place", "callee_line", "d.rank", (F.col("callee_line") + F.col("d.delta")).alias("start_line"))
    hits = tried.join(files, "place").join(starts, ["file", "start_line"]).groupBy("place", "callee_line").agg(F.min_by("idx", F.struct("file", "rank")).alias("dst"))
    return stage(hits, "hits")


def name_keys(chunks: DataFrame) -> DataFrame:
    """(key, idx) for callers and callees: names without visibility; the last real
    symbol of a name wins, else the first synthetic one."""
    real = ~((F.col("start_line") == 0) & (F.col("end_line") == 0)) | F.col("start_line").isNull()
    order = F.struct((~real).alias("synthetic"), F.when(real, -F.col("idx")).otherwise(F.col("idx")))
    return chunks.groupBy(F.lower(N.strip_visibility(F.col("name"))).alias("key")).agg(F.min_by("idx", order).alias("idx"))


def resolve_mir_name(calls: DataFrame, chunks: DataFrame, column: str = "callee") -> DataFrame:
    """``calls`` distinct ``column`` with dst: without closures, else without the first segment too."""
    texts = calls.select(column).distinct()
    lower = N.strip_closure(F.lower(column))
    tries = F.array(F.struct(F.lit(0).alias("rank"), lower.alias("key")), F.struct(F.lit(1).alias("rank"), N.after_first_segment(lower).alias("key")))
    return texts.select(column, F.explode(tries).alias("t")).select(column, "t.*").join(name_keys(chunks), "key").groupBy(column).agg(F.min_by("idx", "rank").alias("dst"))


def trait_methods(chunks: DataFrame) -> DataFrame:
    """(key, idx): ``traitleaf>::method`` of every ``<Type as path::Trait>::method``."""
    after = F.regexp_extract(F.lower("name"), r"(?s)^.*? as (.*)$", 1)
    trait, method = F.substring_index(after, ">", 1), F.regexp_extract(after, r"(?s)^[^>]*>::(.+)$", 1)
    return chunks.where(F.lower("name").contains(" as ")).select(F.concat(N.last_segment(trait), F.lit(">::"), method).alias("key"), "idx", method.alias("method")).where("method <> ''").select("key", "idx")


def trait_fan_out(calls: DataFrame, chunks: DataFrame, column: str = "callee") -> DataFrame:
    """``calls`` with dst, one row per implementation of the trait method called."""
    name = N.strip_closure(F.lower(column))
    key = F.concat(N.last_segment(N.before_last_segment(name)), F.lit(">::"), N.last_segment(name))
    return calls.withColumn("key", key).join(trait_methods(chunks), "key").drop("key").withColumnRenamed("idx", "dst")


def resolve_incremental(stored: DataFrame, calls: DataFrame, chunks: DataFrame, changed: DataFrame) -> DataFrame:
    """``stored`` edges (crate_name, src, dst, line) brought up to date: those of ``changed`` crates
    (crate_name) are resolved again from their calls, by the one resolver that full runs use; those
    of crates without calls go.  Numbers of symbols mustn't have changed for the others."""
    again = changed.select("crate_name").distinct()
    new = resolve_calls(calls.join(again, "crate_name", "left_semi"), chunks, ("crate_name",))
    kept = stored.join(again, "crate_name", "left_anti").join(calls.select("crate_name").distinct(), "crate_name", "left_semi")
    return kept.select("crate_name", "src", "dst", "line").unionByName(new.select("crate_name", "src", "dst", "line"))


def resolve_calls(calls: DataFrame, chunks: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, src, dst, line) of extractor calls (caller, caller_file, callee, callee_file,
    callee_line, line): callee by location, else name; unresolved ones and trait
    declarations fan out to implementations; of several callers one in the callee's
    root folder is taken, else the first."""
    calls = stage(calls, "calls")
    own = calls.withColumn("place", F.lower("callee_file"))
    by_place = place_hits(calls, chunks).withColumnRenamed("dst", "by_place")
    by_name = stage(resolve_mir_name(own, chunks), "by_name").withColumnRenamed("dst", "by_name")
    base = own.join(by_place, ["place", "callee_line"], "left").join(by_name, "callee", "left").withColumn("dst", F.coalesce("by_place", "by_name"))
    kinds = chunks.select(F.col("idx").alias("dst"), F.col("kind").alias("dst_kind"), F.col("file").alias("dst_file"))
    fan = trait_fan_out(base.join(kinds, "dst", "left").where("dst is null or dst_kind = 'trait'").drop("dst", "dst_kind", "dst_file"), chunks)
    columns = ["caller", "caller_file", "line", "dst", *by]
    targets = base.where("dst is not null").select(columns).unionByName(fan.select(columns)).join(kinds, "dst")
    return choose_callers(targets, chunks).where("src <> dst").groupBy(*by, "src", "dst").agg(F.min("line").alias("line"))


def choose_callers(targets: DataFrame, chunks: DataFrame) -> DataFrame:
    """``targets`` (caller, caller_file, dst, dst_file, ...) with src.

    Symbols of the caller's name (without its first segment, if need be): those in
    the caller's file, else the real ones, else the name's symbol; among them the
    first in the callee's root folder, else the first."""
    lower = N.strip_closure(F.lower("caller"))
    named = chunks.where("start_line is null or not (start_line = 0 and end_line = 0)").select(F.lower(N.strip_visibility(F.col("name"))).alias("key"), F.col("idx").alias("src"), F.col("file").alias("src_file"))
    tries = F.array(F.struct(F.lit(0).alias("rank"), lower.alias("key")), F.struct(F.lit(1).alias("rank"), N.after_first_segment(lower).alias("key")))
    # calls of one caller to one root folder have one answer: the cascade runs over those
    own = targets.withColumns({"_file": F.coalesce("caller_file", F.lit("")), "_root": F.coalesce(P.first_folder(F.col("dst_file")), F.lit(""))})
    keyed = own.select("caller", "_file", "_root").distinct().withColumn("t", F.explode(tries)).select("caller", "_file", "_root", "t.*")
    rank = F.struct("rank", (F.coalesce("src_file", F.lit("")) != F.col("_file")).alias("elsewhere"), (F.coalesce(P.first_folder(F.col("src_file")), F.lit("")) != F.col("_root")).alias("far"), "src")
    best = stage(keyed.join(named, "key").groupBy("caller", "_file", "_root").agg(F.min(rank)["src"].alias("src")), "callers")
    return own.join(best, ["caller", "_file", "_root"]).select(*targets.columns, "src")


def resolve_type_refs(refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(src, dst) of (src, type): exact, else short; self references dropped."""
    lower = F.lower("type")
    tries = F.array(*[F.struct(F.lit(r).alias("rank"), F.lit(s).alias("space"), lower.alias("key")) for r, s in enumerate(("exact", "short"))])
    found = refs.select("type").distinct().select("type", F.explode(tries).alias("t")).select("type", "t.*").join(symbol_keys(chunks), ["space", "key"]).groupBy("type").agg(F.min_by("idx", "rank").alias("dst"))
    return refs.join(found, "type").where("src <> dst").select("src", "dst").distinct()


def resolve_symbol(chunks: DataFrame, name: str) -> DataFrame:
    """idx of every symbol of that name or display name, or whose name ends with
    ``::name``; only without any, methods of ``<owner as Trait>::method``."""
    lower = name.lower()
    names = chunks.select("idx", F.explode(F.array(F.lower("name"), F.lower("display_name"))).alias("n"))
    direct = names.where((F.col("n") == lower) | F.col("n").endswith(f"::{lower}")).select("idx").distinct()
    owner, cut, method = lower.rpartition("::")
    if not cut:
        return direct
    fallback = names.where(F.col("n").contains(f"::{owner} as ") & F.col("n").endswith(f">::{method}")).select("idx").distinct()
    none = direct.agg(F.count(F.lit(1)).alias("c")).where("c = 0")
    return direct.unionByName(fallback.join(F.broadcast(none), F.lit(True), "left_semi"))


def trait_impls(chunks: DataFrame) -> DataFrame:
    """(trait_idx, impl_idx): ``Trait for Type`` or ``<Type as Trait>`` impls of each
    trait, by exact name, else by its last segment."""
    lower = F.lower("name")
    trait = F.when(lower.contains(" for "), F.regexp_extract(lower, r"(?s)^(.*?) for ", 1)).when(lower.startswith("<") & lower.contains(" as "), F.regexp_replace(F.regexp_extract(lower, r"(?s)^.*? as (.*)$", 1), ">$", ""))
    impls = chunks.where("kind = 'impl'").select(F.col("idx").alias("impl_idx"), trait.alias("trait")).where("trait is not null")
    tries = F.array(F.struct(F.lit(0).alias("rank"), F.lit("exact").alias("space"), F.col("trait").alias("key")), F.struct(F.lit(1).alias("rank"), F.lit("short").alias("space"), N.last_segment(F.col("trait")).alias("key")))
    return impls.select("impl_idx", F.explode(tries).alias("t")).select("impl_idx", "t.*").join(symbol_keys(chunks), ["space", "key"]).groupBy("impl_idx").agg(F.min_by("idx", "rank").alias("trait_idx")).select("trait_idx", "impl_idx")


def fn_trait_impl(chunks: DataFrame) -> DataFrame:
    """(idx, impl_idx): functions whose parent path is a trait impl's name."""
    impls = chunks.where("kind = 'impl'").where(F.lower("name").contains(" for ")).groupBy(F.lower("name").alias("parent")).agg(F.max("idx").alias("impl_idx"))
    return chunks.where("kind = 'function'").select("idx", N.before_last_segment(F.lower("name")).alias("parent")).join(impls, "parent").select("idx", "impl_idx")


def field_access_index(chunks: DataFrame) -> DataFrame:
    """(key, idx): ``type::field`` of every access in field_accesses (receiver.field
    texts), receivers typed by self, self.field, parameters and locals in that order;
    an unknown receiver keeps its own text.  Needs field_types, param_types and
    local_types as array<struct<name,type>>."""
    owners = chunks.where("kind = 'struct'").select(N.owner_leaf(F.col("name")).alias("owner"), "idx", F.posexplode("field_types").alias("pos", "f"))
    owners = owners.groupBy("owner", F.lower("f.name").alias("field")).agg(F.max_by(F.lower("f.type"), F.struct("idx", "pos")).alias("type"))
    has = chunks.where(F.size("field_accesses") > 0)
    typed = lambda c, rank: has.select("idx", F.explode(c).alias("p")).select("idx", F.lower("p.name").alias("receiver"), N.leaf_type(F.lower("p.type")).alias("type"), F.lit(rank).alias("rank"))
    self_ = has.select("idx", F.lit("self").alias("receiver"), N.owning_type(F.col("name")).alias("type"), F.lit(0).alias("rank")).where("type is not null")
    fields = self_.join(owners.withColumnRenamed("type", "field_type"), F.col("type") == F.col("owner")).select("idx", F.concat(F.lit("self."), F.col("field")).alias("receiver"), N.leaf_type(F.col("field_type")).alias("type"), F.lit(1).alias("rank"))
    known = self_.unionByName(fields).unionByName(typed("param_types", 2)).unionByName(typed("local_types", 3)).groupBy("idx", "receiver").agg(F.min_by("type", "rank").alias("type"))
    used = has.select("idx", F.explode("field_accesses").alias("a")).select("idx", F.lower(F.regexp_extract("a", r"^(.*)\.", 1)).alias("receiver"), F.lower(F.substring_index("a", ".", -1)).alias("field"))
    return used.join(known, ["idx", "receiver"], "left").select(F.concat(F.coalesce("type", "receiver"), F.lit("::"), F.col("field")).alias("key"), "idx").distinct()


def dedup_types(chunks: DataFrame) -> DataFrame:
    """Of types that share file, display name and kind the one with the longest span, ties to the later; others pass."""
    types = F.col("kind").isin("struct", "enum", "trait", "type_alias")
    order = Window.partitionBy("file", "display_name", "kind").orderBy(F.desc(F.col("end_line") - F.col("start_line")), F.desc("idx"))
    kept = chunks.where(types).withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")
    return chunks.where(~types).unionByName(kept)
