"""Raw extractor rows to symbols, and incremental maintenance of stored tables."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from larkspur.functions import names as N
from larkspur.functions import paths as P
from larkspur.plans.staging import numbered


_PAIRS = "array<struct<name:string,type:string>>"


def changed_files(now: DataFrame, index: DataFrame) -> DataFrame:
    """Paths of ``now`` (path, mtime, hash) that are new, or whose time and hash both
    differ from ``index``; a file that can't be read counts as unchanged, one without a
    stored hash as changed."""
    old = index.select("path", F.col("mtime").alias("old_mtime"), F.col("hash").alias("old_hash"), F.lit(True).alias("known"))
    joined = now.join(old, "path", "left")
    changed = F.col("known").isNull() | ((F.col("mtime") != F.col("old_mtime")) & F.col("hash").isNotNull() & (F.col("old_hash").isNull() | (F.col("hash") != F.col("old_hash"))))
    return joined.where(changed).select("path")


def deleted_files(now: DataFrame, index: DataFrame) -> DataFrame:
    return index.select("path").join(now.select("path"), "path", "left_anti")


def next_index(now: DataFrame, index: DataFrame) -> DataFrame:
    """The index after a scan: present rows replace, missing ones go."""
    return index.join(now.select("path"), "path", "left_semi").join(now.select("path"), "path", "left_anti").unionByName(now)


def first_wins(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key: the first by ``order``, as inserts that ignore conflicts keep it."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_nth", F.row_number().over(window)).where("_nth = 1").drop("_nth")


def dedup_symbols(raw: DataFrame) -> DataFrame:
    """Per (name, file) the first by seq, but one in use before one of a test; files given absolutely are left out."""
    inside = raw.where(~F.col("file").startswith("/") & ~F.col("file").rlike("^.:"))
    return first_wins(inside, ["name", "file"], [F.col("is_test"), F.col("seq")])


def merge_changed(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows, and old rows whose key no new row has."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def merge_prefixed(main: DataFrame, sub: DataFrame, crates: list[str], prefix: str, keys: list[str]) -> DataFrame:
    """``main`` with the rows of a sub-workspace's own crates, its relative files prefixed."""
    own = sub.where(F.col("crate_name").isin(*[c.replace("-", "_") for c in crates]))
    file = F.when(F.col("file").startswith("/") | F.col("file").rlike("^.:") | F.col("file").startswith(f"{prefix}/"), F.col("file")).otherwise(F.concat(F.lit(f"{prefix}/"), F.col("file")))
    return merge_changed(main, own.withColumn("file", file), keys)


def without_crates(rows: DataFrame, crates: list[str]) -> DataFrame:
    return rows.where(~F.col("crate_name").isin(*[c.replace("-", "_") for c in crates]))


def missing_crates(declared: DataFrame, edges: DataFrame) -> DataFrame:
    """Declared crates that no stored edge belongs to."""
    return declared.select("crate_name").distinct().join(edges.select("crate_name").distinct(), "crate_name", "left_anti")


def to_chunks(raw: DataFrame) -> DataFrame:
    """Raw symbol rows (packed strings) as symbols: kinds, lists and names unpacked, idx by (file, lines, name)."""
    kind = F.when(F.col("kind").isin("fn", "method"), "function").otherwise(F.col("kind"))
    calls = N.packed_calls(F.coalesce("calls", F.lit("")))
    rows = raw.select(
        "name",
        N.display_name(F.col("name")).alias("display_name"),
        P.normalize_path(F.col("file")).alias("file"),
        kind.alias("kind"),
        "start_line",
        "end_line",
        "signature",
        "visibility",
        (F.col("is_test") | P.is_test_path(F.col("file"))).alias("is_test"),
        F.col("body").alias("text"),
        calls.alias("calls"),
        N.parameters(F.coalesce("signature", F.lit(""))).alias("param_types"),
        N.return_type(F.coalesce("signature", F.lit(""))).alias("return_type"),
        F.when(F.col("kind") == "struct", N.struct_fields(F.coalesce("body", F.lit("")))).otherwise(F.array().cast(_PAIRS)).alias("field_types"),
        F.array().cast(_PAIRS).alias("local_types"),
        F.when(F.col("kind") == "enum", N.enum_variants(F.coalesce("body", F.lit("")))).otherwise(F.array().cast("array<string>")).alias("enum_variants"),
        F.filter(F.split(F.coalesce("field_accesses", F.lit("")), ", "), lambda a: a.contains(".")).alias("field_accesses"),
        "crate_name",
    )
    return numbered(rows, "file", "start_line", "end_line", "name")


def uses_of_functions(uses: DataFrame, deps: DataFrame) -> DataFrame:
    """(fn_name, fn_file, source, resolved): what each function needs of its file's use lines."""
    lines = uses.select(F.col("file").alias("use_file"), F.col("line").alias("use_line"), "source", "resolved")
    return deps.join(lines, ["use_file", "use_line"]).select("fn_name", "fn_file", "source", "resolved").distinct()


def replace_files(old: DataFrame, new: DataFrame, touched: DataFrame) -> DataFrame:
    """``new`` rows, and the old ones of files (file) that were not touched."""
    return old.join(touched.select("file").distinct(), "file", "left_anti").select(new.columns).unionByName(new)


def ingestible(raw: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Raw symbols to take in: of files given relatively, no one-line derived methods, and with
    ``sources`` (file) of changed files only."""
    kept = raw.where(~F.col("file").startswith("/") & ~F.col("file").rlike("^.:"))
    kept = kept.where(~((F.col("start_line") == F.col("end_line")) & N.is_derived_noise(F.col("name"))) | F.col("start_line").isNull())
    return kept.join(sources.select("file").distinct(), "file", "left_semi").select(raw.columns) if sources is not None else kept


def nearest_manifest(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """(file, crate_name) by the manifest (dir, crate_name) in the nearest folder above."""
    parts = F.split("file", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    each = files.select("file", F.explode(above).alias("dir")).join(manifests, "dir")
    return each.groupBy("file").agg(F.max_by("crate_name", F.length("dir")).alias("crate_name"))


def span_join(points: DataFrame, spans: DataFrame) -> DataFrame:
    """Innermost span (file, start_line, end_line, name) around each point (file, line, ...).

    Points and spans are never paired: each file is read once in order of lines, with the
    spans begun so far in a heap, the innermost on top.  Spans of the same lines are one
    before, so that copies of a symbol cost nothing there."""
    width = F.col("end_line").cast("long") - F.col("start_line").cast("long")
    alike = spans.where("file is not null and start_line <= end_line").groupBy("file", "start_line", width.alias("n")).agg(F.min(F.struct("name"))["name"].alias("name"))
    point = F.struct(*points.columns)
    opened = alike.select("file", F.col("start_line").cast("long").alias("at"), F.col("n"), "name", F.lit(None).cast(points.select(point).schema[0].dataType).alias("point"))
    asked = points.where("file is not null and line is not null").distinct().select("file", F.col("line").cast("long").alias("at"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("string").alias("name"), point.alias("point"))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, begun = None, []
        for batch in batches:
            found, inside = [], []
            for own, at, n, name in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if own != file:
                    file, begun = own, []
                if n is not None:
                    # a null name comes first, as in an ascending order
                    heappush(begun, (n, name is not None, name or "", at + n))
                    continue
                # an ended span is in no later point: it goes once it is on top
                while begun and begun[0][3] < at:
                    heappop(begun)
                inside.append(bool(begun))
                if begun:
                    found.append(begun[0][2] if begun[0][1] else None)
            asked = batch.filter(pc.is_null(batch.column(2))).filter(pa.array(inside, pa.bool_()))
            yield pa.RecordBatch.from_arrays([asked.column(4), pa.array(found, pa.string())], ["point", "name"])

    # spans that begin at a line come before its points
    dealt = opened.unionByName(asked).repartition("file").sortWithinPartitions("file", "at", F.col("n").isNull())
    met = dealt.mapInArrow(sweep, StructType([StructField("point", opened.schema["point"].dataType), StructField("name", StringType())]))
    return met.select("point.*", "name")


def attach_calls(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """``chunks`` (seq, name, ...) with calls: the calls (caller, callee, line) of a name go to its first symbol."""
    packed = edges.groupBy(F.col("caller").alias("name")).agg(F.sort_array(F.collect_set(F.struct("line", "callee"))).alias("c"))
    text = F.array_join(F.transform("c", lambda x: F.concat(x["callee"], F.lit("@"), x["line"].cast("string"))), ", ")
    first = chunks.groupBy("name").agg(F.min("seq").alias("seq")).join(packed, "name").select("name", "seq", text.alias("calls"))
    return chunks.join(first, ["name", "seq"], "left").withColumn("calls", F.coalesce("calls", F.lit("")))


def polyglot_chunks(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """Extractor chunks with calls attached by bare caller name, to the last chunk of the name."""
    calls = edges.groupBy(F.substring_index(F.substring_index("caller", "::", -1), ".", -1).alias("name")).agg(F.array_sort(F.collect_set("callee")).alias("calls"))
    last = chunks.groupBy("name").agg(F.max(F.struct("file", "start_line")).alias("at")).join(calls, "name").select("name", "at.file", "at.start_line", "calls")
    return chunks.join(last, ["name", "file", "start_line"], "left").withColumn("calls", F.coalesce("calls", F.array().cast("array<string>")))
