"""Edits of line tables (file, line_no from 1, text), planned relationally.

An edit (file, op, start, end, body, seq) replaces, deletes, or inserts before, after
or at a range of lines; all edits of all files are one plan: replaced and deleted
lines are an anti join, inserted ones a union, and the new order is numbered per
file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.plans.staging import stage

#: Spans that may be broadcast to the lines; more meet them by a merge join, since the sizes that
#: Spark estimates are those of compressed files and tell little of what the driver would hold.
BROADCAST_SPANS = 100_000

# What a symbol's first line may start with, by a text search.
SYMBOL_STARTS = ("fn {}", "pub fn {}", "pub(crate) fn {}", "struct {}", "pub struct {}", "enum {}", "pub enum {}", "trait {}", "pub trait {}", "impl {}", "const {}", "type {}")


def to_lines(texts: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    return texts.select(F.col(file).alias("file"), F.posexplode(F.split(text, "\n")).alias("pos", "text")).select("file", (F.col("pos") + 1).alias("line_no"), "text")


#: Names of operations by commands and manifests, and what they do.
OPERATIONS = {"replace": "replace", "insert-before": "before", "insert-after": "after", "delete": "delete", "insert-at": "at", "delete-lines": "delete", "replace-lines": "replace"}


def named_operations(plan: DataFrame, known: tuple[str, ...] = tuple(OPERATIONS)) -> DataFrame:
    """``plan`` with op by :data:`OPERATIONS`; unknown names are refused."""
    unknown = plan.where(~F.coalesce(F.col("op").isin(*known), F.lit(False))).select("op").distinct().limit(5).collect()
    if unknown:
        raise ValueError(f"unknown operations: {sorted(str(r.op) for r in unknown)}; expected {', '.join(known)}")
    return plan.withColumn("op", F.element_at(F.create_map(*[F.lit(x) for pair in OPERATIONS.items() for x in pair]), F.col("op")))


def refused(lines: DataFrame, edits: DataFrame) -> DataFrame:
    """(file, op, start, end, reason) of edits that can't be made: a file that is not there, a
    line under 1, a range that ends before it starts or starts past the file's end."""
    last = lines.groupBy("file").agg(F.max("line_no").alias("n"))
    ranged = F.col("op").isin("replace", "delete")
    reason = (
        F.when(F.col("n").isNull(), "no such file")
        .when((F.col("start") < 1) | (F.col("end") < 1) | F.col("start").isNull() | F.col("end").isNull(), "lines count from 1")
        .when(F.col("start") > F.col("end"), "the range ends before it starts")
        .when(ranged & (F.col("start") > F.col("n")), "the range starts past the end")
    )
    return edits.join(last, "file", "left").withColumn("reason", reason).where("reason is not null").select("file", "op", "start", "end", "reason")


def apply_edits(lines: DataFrame, edits: DataFrame) -> DataFrame:
    """(file, line_no, text) after all edits, whose ranges mustn't cross; edits of
    :func:`refused` change nothing.

    The end of a range is clamped to the file; before adds an empty line below its
    body, after one above it, at neither; a body loses white space at its end, and an
    empty one has no line."""
    bare = F.regexp_replace(F.coalesce("body", F.lit("")), r"\s+$", "")
    body = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "\n"))
    body = F.when(F.col("op") == "before", F.concat(body, F.array(F.lit("")))).when(F.col("op") == "after", F.concat(F.array(F.lit("")), body)).otherwise(body)
    last = lines.groupBy("file").agg(F.max("line_no").alias("n"))
    edits = edits.join(last, "file").where("start >= 1 and start <= end and (start <= n or op not in ('replace', 'delete'))")
    edits = edits.withColumns({"start": F.least("start", F.col("n") + 1), "end": F.least("end", "n")})
    gone = edits.where(F.col("op").isin("replace", "delete")).select("file", F.explode(F.sequence("start", "end")).alias("line_no"))
    kept = lines.join(gone, ["file", "line_no"], "left_anti").select("file", F.col("line_no").alias("at"), F.lit(1).alias("side"), F.lit(0).alias("seq"), F.lit(0).alias("pos"), "text")
    where = F.when(F.col("op") == "after", F.col("end")).otherwise(F.col("start"))
    side = F.when(F.col("op") == "after", 2).otherwise(0)
    added = edits.where("op <> 'delete'").select("file", where.alias("at"), side.alias("side"), "seq", F.posexplode(body).alias("pos", "text"))
    order = Window.partitionBy("file").orderBy("at", "side", "seq", "pos")
    return kept.unionByName(added).select("file", F.row_number().over(order).alias("line_no"), "text")


def preview(lines: DataFrame, edits: DataFrame, shown: int = 3) -> DataFrame:
    """(file, op, start, end, old, new) of what edits would do, the first lines of each: a dry run."""
    hit = edits.join(lines, "file", "left").where(F.col("line_no").between(F.col("start"), F.least(F.col("end"), F.col("start") + shown - 1)) | F.col("line_no").isNull())
    old = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"])
    body = F.regexp_replace(F.coalesce("body", F.lit("")), r"\s+$", "")
    new = F.when(body == "", F.array().cast("array<string>")).otherwise(F.slice(F.split(body, "\n"), 1, shown))
    return hit.groupBy("file", "op", "start", "end", "seq", new.alias("new")).agg(old.alias("old")).select("file", "op", "start", "end", "old", "new")


def crossing(edits: DataFrame) -> DataFrame:
    """Pairs of neighbouring edits of a file whose ranges cross."""
    order = Window.partitionBy("file").orderBy("start", "end", "seq")
    return edits.withColumn("next_start", F.lead("start").over(order)).where(F.col("next_start") <= F.col("end")).select("file", "start", "end", "next_start")


def create_files(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Lines of the new files (file, text) that don't exist yet."""
    return to_lines(new.join(existing.select("file").distinct(), "file", "left_anti"))


def symbol_span(lines: DataFrame, name: str) -> DataFrame:
    """(file, start, end) of the first line that starts the symbol, to where its braces balance."""
    trimmed = F.regexp_replace("text", r"^\s+", "")
    starts = F.lit(False)
    for pattern in SYMBOL_STARTS:
        starts = starts | trimmed.startswith(pattern.format(name))
    first = stage(lines.where(starts).groupBy("file").agg(F.min("line_no").alias("start")), "starts")
    net = F.length(F.regexp_replace("text", r"[^{]", "")) - F.length(F.regexp_replace("text", r"[^}]", ""))
    order = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    after = met(lines, first).where("line_no >= start").withColumn("open", F.sum(net).over(order)).withColumn("opened", F.max(F.col("text").contains("{").cast("int")).over(order))
    ends = F.min(F.when(F.expr("open <= 0 and (opened = 1 or text like '%;%')"), F.col("line_no")))
    # the last line after the start is the file's
    return after.groupBy("file", "start").agg(F.coalesce(ends, F.max("line_no")).alias("end"))


def met(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """``lines`` with the staged ``spans`` of their files, which are counted before they are broadcast."""
    return lines.join(F.broadcast(spans) if spans.count() <= BROADCAST_SPANS else spans.hint("merge"), "file")


def with_attributes(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """``spans`` (file, start, end) that begin with the attribute and doc lines right above them."""
    above = F.trim("text").rlike(r"^(#\[|#!\[|///|//!|@)")
    spans = stage(spans.select("file", "start", "end"), "spans")
    stops = met(lines, spans).where((F.col("line_no") < F.col("start")) & ~above).select("file", "start", "end", F.col("line_no").alias("stop"))
    found = spans.withColumn("stop", F.lit(0)).unionByName(stops).groupBy("file", "start", "end").agg(F.max("stop").alias("stop"))
    return found.select("file", F.least("start", F.col("stop") + 1).alias("start"), "end")


def original_visibility(text: Column) -> Column:
    """The visibility an item's first line has, empty if none."""
    return F.regexp_extract(text, r"^\s*(pub(?:\([^)]*\))?) ", 1)


def crate_prefix(file: Column) -> Column:
    """The module path of a file inside its crate: crate::a::b of src/a/b.rs and src/a/b/mod.rs."""
    inside = F.regexp_replace(F.regexp_replace(F.regexp_replace(file, r"\\", "/"), r"^(.*/)?src/", ""), r"\.rs$", "")
    module = F.regexp_replace(inside, r"(^|/)(mod|lib|main)$", "")
    return F.when(module == "", "crate").otherwise(F.concat(F.lit("crate::"), F.replace(module, F.lit("/"), F.lit("::"))))


def use_idents(use: Column) -> Column:
    """Names that a use line brings in: the last segments, those after as."""
    inside = F.regexp_replace(F.regexp_replace(use, r"^\s*use\s+", ""), r";\s*$", "")
    items = F.filter(F.transform(F.split(F.regexp_replace(inside, r"^.*\{|\}.*$", ""), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(items, lambda x: F.trim(F.when(x.contains(" as "), F.regexp_extract(x, r" as (.*)$", 1)).otherwise(F.substring_index(x, "::", -1))))


def is_use_line(text: Column) -> Column:
    return text.rlike(r"^\s*use\s.*;\s*$")


def unused_imports(lines: DataFrame) -> DataFrame:
    """(file, line_no) of single-line private use lines none of whose names the file uses elsewhere."""
    names = F.when(is_use_line(F.col("text")), use_idents(F.col("text")))
    words = F.when(~F.col("text").rlike(r"^\s*(pub(\([^)]*\))?\s+)?use\s"), F.array_distinct(F.filter(F.split("text", r"[^A-Za-z0-9_]+"), lambda w: w != "")))
    # one grouping by name instead of joins of uses and words: no side that could be broadcast
    uses = lines.select("file", "line_no", F.explode(names).alias("name"), F.col("name").isin("*", "self").alias("used"))
    elsewhere = lines.select("file", F.lit(None).cast("int").alias("line_no"), F.explode(words).alias("name"), F.lit(True).alias("used"))
    met = uses.unionByName(elsewhere).groupBy("file", "name").agg(F.collect_set("line_no").alias("at"), F.max("used").alias("used"))
    return met.select("file", F.explode("at").alias("line_no"), "used").groupBy("file", "line_no").agg(F.max("used").alias("used")).where("not used").select("file", "line_no")


def clean_imports(lines: DataFrame) -> DataFrame:
    """``lines`` without unused imports, and runs of empty lines made one."""
    kept = lines.join(unused_imports(lines).hint("merge"), ["file", "line_no"], "left_anti")
    order = Window.partitionBy("file").orderBy("line_no")
    single = kept.withColumn("before", F.lag("text").over(order)).where(~((F.trim("text") == "") & (F.trim("before") == "")) | F.col("before").isNull())
    return single.select("file", F.row_number().over(order).alias("line_no"), "text")


def ensure_import(lines: DataFrame, file: str, path: str, name: str) -> DataFrame:
    """``lines`` where ``file`` imports path::name: merged, sorted, into its use of that
    path, else a line after its last use, else its first line."""
    own, pattern = lines.where(F.col("file") == file), rf"^use {path}::(\{{.*\}}|[A-Za-z0-9_]+);$"
    at = own.where(F.col("text").rlike(pattern)).agg(F.min("line_no").alias("merge"))
    last = own.where(is_use_line(F.col("text"))).agg(F.max("line_no").alias("last"))
    target = F.broadcast(at.join(last, F.lit(True)))
    joined = own.join(target, F.lit(True))
    names = F.array_sort(F.array_distinct(F.concat(use_idents(F.col("text")), F.array(F.lit(name)))))
    merged = F.when(F.size(names) == 1, F.concat(F.lit(f"use {path}::"), names[0], F.lit(";"))).otherwise(F.concat(F.lit(f"use {path}::{{"), F.array_join(names, ", "), F.lit("};")))
    kept = joined.select("file", "line_no", F.lit(0).alias("k"), F.when(F.col("line_no") == F.col("merge"), merged).otherwise(F.col("text")).alias("text"))
    new = joined.where("merge is null").select("file", F.coalesce("last", F.lit(0)).alias("line_no"), F.lit(1).alias("k"), F.lit(f"use {path}::{name};").alias("text")).distinct()
    order = Window.partitionBy("file").orderBy("line_no", "k")
    done = kept.unionByName(new).select("file", F.row_number().over(order).alias("line_no"), "text")
    return lines.where(F.col("file") != file).unionByName(done)


def split_plan(lines: DataFrame, symbols: DataFrame, target: str) -> DataFrame:
    """(file, line_no, text) of both files after the symbols (file, start, end) move to
    ``target``: its header holds the uses its body needs, the old file declares and
    re-exports the module."""
    moved = lines.join(symbols, "file").where(F.col("line_no").between(F.col("start"), F.col("end"))).select(*lines.columns)
    words = moved.select(F.explode(F.split("text", r"[^A-Za-z0-9_]+")).alias("name")).distinct()
    uses = lines.where(is_use_line(F.col("text"))).select("line_no", "text", F.explode(use_idents(F.col("text"))).alias("name"))
    header = uses.join(words, "name", "left_semi").select("line_no", "text").distinct()
    order = Window.partitionBy("file").orderBy("k", "line_no")
    body = header.select(F.lit(target).alias("file"), F.lit(0).alias("k"), "line_no", "text").unionByName(moved.select(F.lit(target).alias("file"), F.lit(1).alias("k"), "line_no", "text"))
    module = target.rpartition("/")[2].removesuffix(".rs")
    rest = lines.join(moved.select("file", "line_no"), ["file", "line_no"], "left_anti").select("file", F.lit(1).alias("k"), "line_no", "text")
    declared = symbols.select("file").distinct().select("file", F.lit(0).alias("k"), F.explode(F.array(F.struct(F.lit(0).alias("line_no"), F.lit(f"mod {module};").alias("text")), F.struct(F.lit(1).alias("line_no"), F.lit(f"pub use {module}::*;").alias("text")))).alias("x")).select("file", "k", "x.line_no", "x.text")
    return body.unionByName(rest).unionByName(declared).select("file", F.row_number().over(order).alias("line_no"), "text")


def partition_module(symbols: DataFrame, edges: DataFrame, min_lines: int = 300) -> DataFrame:
    """(idx, grp) of a module's symbols (file, idx, is_pub, lines, and if it has types
    also kind, name, text): public functions start groups; in one pass in order of idx a
    private one joins the single group that has called it so far; a type joins the single
    group whose bodies hold its name; groups under ``min_lines`` dissolve (null).
    Sequential by definition: one task per file."""
    import re

    import pandas as pd

    for column, default in (("kind", "function"), ("name", ""), ("text", "")):
        if column not in symbols.columns:
            symbols = symbols.withColumn(column, F.lit(default))
    callers = edges.join(symbols.select(F.col("idx").alias("src")), "src", "left_semi").groupBy(F.col("dst").alias("idx")).agg(F.sort_array(F.collect_set("src")).alias("callers"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("idx")
        functions, types = group[group["kind"] == "function"], group[group["kind"].isin(["struct", "enum", "trait"])]
        place = {i: i for i, pub in zip(functions["idx"], functions["is_pub"], strict=True) if pub}
        for i, own in zip(functions["idx"], functions["callers"], strict=True):
            homes = {place[c] for c in (own if own is not None else []) if c in place}
            if i not in place and len(homes) == 1:
                place[i] = homes.pop()
        words: dict[int, set[str]] = {}
        for i, text in zip(functions["idx"], functions["text"], strict=True):
            if i in place:
                words.setdefault(place[i], set()).update(re.findall(r"[A-Za-z0-9_]+", text or ""))
        for i, name in zip(types["idx"], types["name"], strict=True):
            homes = [g for g, used in words.items() if name and name.rpartition("::")[2] in used]
            if len(homes) == 1:
                place[i] = homes[0]
        lines = group.assign(grp=group["idx"].map(place)).groupby("grp")["lines"].sum()
        big = set(lines[lines >= min_lines].index)
        return pd.DataFrame({"idx": group["idx"], "grp": [place.get(i) if place.get(i) in big else None for i in group["idx"]]}).astype({"grp": "Int64"})

    return symbols.join(callers, "idx", "left").groupBy("file").applyInPandas(run, "idx long, grp long")


def _outside_strings(text: Column, change) -> Column:
    """``change`` applied to what stands outside double-quoted literals."""
    parts = F.regexp_extract_all(text, F.lit(r'("(?:[^"\\\\]|\\\\.)*"|[^"]+|")'), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.startswith('"'), p).otherwise(change(p))), "")


def fix_paths(text: Column, old: str, new: str) -> Column:
    """Module paths that start with ``old::`` start with ``new::``, string literals aside."""
    return _outside_strings(text, lambda p: F.regexp_replace(p, rf"(?<![A-Za-z0-9_:]){old}::", f"{new}::"))


def contains_word(text: Column, word: str) -> Column:
    return text.rlike(rf"(?<![A-Za-z0-9_]){word}(?![A-Za-z0-9_])")


def ensure_visibility(text: Column, visibility: str = "pub(crate)") -> Column:
    """An item's first line with a visibility, if it has none."""
    return F.regexp_replace(text, r"^(\s*)((?:async |unsafe |const )*(?:fn|struct|enum|trait|type|const|static|mod) )", f"$1{visibility} $2")


def module_plan(partition: DataFrame, symbols: DataFrame, folder: str) -> DataFrame:
    """(idx, target): the file of each symbol (idx, name) once its module becomes a folder;
    symbols without a group stay in mod.rs, a group's file is named by its entry point."""
    entry = symbols.select(F.col("idx").alias("grp"), F.regexp_replace(F.lower(F.substring_index("name", "::", -1)), "[^a-z0-9_]", "_").alias("stem"))
    placed = symbols.select("idx").join(partition, "idx", "left").join(entry, "grp", "left")
    return placed.select("idx", F.concat(F.lit(f"{folder}/"), F.coalesce("stem", F.lit("mod")), F.lit(".rs")).alias("target"))


def callers_warned(edges: DataFrame, chunks: DataFrame, doomed: DataFrame) -> DataFrame:
    """(idx, caller, line): callers in use of symbols (idx) about to be deleted."""
    users = chunks.where(~F.col("is_test")).select(F.col("idx").alias("caller"))
    hit = edges.join(doomed.select(F.col("idx").alias("dst")), "dst", "left_semi").select(F.col("dst").alias("idx"), F.col("src").alias("caller"), "line")
    return hit.join(users, "caller", "left_semi").join(doomed.select(F.col("idx").alias("caller")), "caller", "left_anti").select("idx", "caller", "line")
