"""Readers of what extractors and tools leave: JSON documents, SQLite tables, folders, coverage exports."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from larkspur.functions import paths as P

# Files that mark a project's language, by precedence.
PROJECT_MARKERS = (("Cargo.toml", "rust"), ("go.mod", "go"), ("tsconfig.json", "typescript"), ("package.json", "typescript"))
_EDGE = "caller string, callee string, file string, line int, caller_file string, caller_start int, caller_end int"
_CHUNK = "name string, file string, kind string, start int, start_line int, end int, end_line int, signature string, text string, crate_name string"
_COUNTS = "struct<count:bigint,covered:bigint>"


def extractor_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(edges, chunks) of documents {edges, chunks}; start_line and end_line may stand for start and end."""
    doc = spark.read.schema(f"edges array<struct<{_colons(_EDGE)}>>, chunks array<struct<{_colons(_CHUNK)}>>").option("multiLine", True).json(path)
    edges = doc.select(F.explode("edges").alias("e")).select("e.*")
    chunks = doc.select(F.explode("chunks").alias("c")).select("c.*")
    return edges, chunks.select("name", "file", "kind", F.coalesce("start", "start_line").alias("start_line"), F.coalesce("end", "end_line").alias("end_line"), "signature", "text", F.coalesce("crate_name", F.lit("")).alias("crate_name"))


def _colons(schema: str) -> str:
    return ",".join(":".join(part.strip().rsplit(" ", 1)) for part in schema.split(","))


def coverage_json(spark: SparkSession, path: str) -> DataFrame:
    """(filename, functions, lines) of a coverage export's files."""
    schema = f"data array<struct<files:array<struct<filename:string,summary:struct<functions:{_COUNTS},lines:{_COUNTS}>>>>>"
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    files = doc.select(F.explode("data").alias("d")).select(F.explode("d.files").alias("f"))
    return files.select("f.filename", "f.summary.functions", "f.summary.lines")


def coverage_totals(spark: SparkSession, path: str) -> DataFrame:
    """(functions, lines) of a coverage export as the document itself totals them."""
    schema = f"data array<struct<totals:struct<functions:{_COUNTS},lines:{_COUNTS}>>>"
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    return doc.select(F.explode("data").alias("d")).select("d.totals.functions", "d.totals.lines")


def scan_files(spark: SparkSession, folder: str, exclude: tuple[str, ...] = (), content: bool = False) -> DataFrame:
    """(path, mtime, size[, hash, content]) of the code files under a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    base = folder.rstrip("/")
    path = F.regexp_replace("path", f"^.*?{base.removeprefix('file:')}/", "")
    rows = found.select(path.alias("path"), F.unix_timestamp("modificationTime").alias("mtime"), F.col("length").alias("size"), *([F.md5("content").alias("hash"), F.col("content").cast("string").alias("content")] if content else []))
    return rows.where(P.is_code_file(F.col("path")) & ~P.is_skipped(F.col("path"), exclude))


def scan_files_fast(spark: SparkSession, folder: str, exclude: tuple[str, ...] = (), content: bool = False) -> DataFrame:
    """As :func:`scan_files`, of a git work tree only what git lists (ignored files stay out);
    without git or its listing every file."""
    import subprocess

    try:
        listed = subprocess.run(["git", "-C", folder, "ls-files", "-z", "--cached", "--others", "--exclude-standard"], capture_output=True, check=True).stdout.decode()
    except (OSError, subprocess.CalledProcessError):
        listed = ""
    names = [(n,) for n in listed.split("\0") if n]
    if not names:
        return scan_files(spark, folder, exclude, content)
    return scan_files(spark, folder, (), content).join(spark.createDataFrame(names, "path string").distinct(), "path", "left_semi")


def crate_names(edges: DataFrame) -> DataFrame:
    return edges.select("crate_name").distinct()


def language_summary(files: DataFrame) -> DataFrame:
    return files.groupBy(P.language(F.col("path")).alias("language")).agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), "language")


def detect_language(names: set[str]) -> str | None:
    return next((language for marker, language in PROJECT_MARKERS if marker in names), None)


def project_root(start: str, markers: tuple[str, ...] = ("Cargo.toml", "go.mod", "package.json", ".git"), most: int = 10) -> str | None:
    """The first folder from ``start`` upwards, at most ten up, that has a marker."""
    from pathlib import Path

    at = Path(start).resolve()
    return next((str(p) for p in [at, *at.parents][:most] if any((p / m).exists() for m in markers)), None)


def workspace_members(manifest: str, folders: tuple[str, ...] = ()) -> list[str]:
    """Members of a workspace manifest; a trailing * stands for each of ``folders`` under it."""
    import tomllib

    members = tomllib.loads(manifest).get("workspace", {}).get("members", [])
    out = []
    for m in members:
        out += [f for f in folders if f.rpartition("/")[0] == m[:-2]] if m.endswith("/*") else [m]
    return sorted(set(out))


class _Range(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class SqliteReader(DataSourceReader):
    """Rows of one table by ranges of rowid; equality and IN filters go into the SQL."""

    def __init__(self, schema, options):
        self.schema, self.options, self.clauses, self.values = schema, options, [], []

    def _connect(self):
        import sqlite3

        return sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)

    def _columns(self, db) -> set[str]:
        return {row[1] for row in db.execute(f'PRAGMA table_info("{self.options["table"]}")')}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        with self._connect() as db:
            there = self._columns(db)
        for f in filters:
            # SQLite would take the name of a column that the file lacks for a text
            column = getattr(f, "attribute", ())
            if len(column) != 1 or column[0] not in there:
                yield f
            elif isinstance(f, EqualTo):
                self.clauses.append(f'"{f.attribute[0]}" = ?')
                self.values.append(f.value)
            elif isinstance(f, In):
                self.clauses.append(f'"{f.attribute[0]}" IN ({",".join("?" * len(f.value))})')
                self.values.extend(f.value)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        with self._connect() as db:
            lo, hi = db.execute(f'SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM "{self.options["table"]}"').fetchone()
        n = int(self.options.get("partitions", "8"))
        step = max(1, -(-(hi - lo + 1) // n))
        return [_Range(a, a + step) for a in range(lo, hi + 1, step)] or [_Range(0, 0)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        with self._connect() as db:
            there = self._columns(db)
            # a column that an older file lacks reads as empty text
            columns = ", ".join(f'"{f.name}"' if f.name in there else "''" for f in self.schema.fields)
            where = " AND ".join(["rowid >= ? AND rowid < ?", *self.clauses])
            for row in db.execute(f'SELECT {columns} FROM "{self.options["table"]}" WHERE {where}', [partition.lo, partition.hi, *self.values]):
                yield tuple(bool(v) if f.dataType.typeName() == "boolean" and v is not None else v for f, v in zip(self.schema.fields, row, strict=True))


class SqliteSource(DataSource):
    """``spark.read.format("sqlite_table").schema(...).option("path", file).option("table", name)``;
    the file has to be where every executor sees it."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def reader(self, schema) -> SqliteReader:
        return SqliteReader(schema, self.options)


RAW_USES = "file string, line int, source string, resolved string, crate_name string"
RAW_USE_DEPS = "fn_name string, fn_file string, use_file string, use_line int, crate_name string"
RAW_CHUNKS = "name string, file string, kind string, start_line int, end_line int, signature string, visibility string, is_test boolean, body string, calls string, type_refs string, crate_name string, field_accesses string"
RAW_EDGES = "caller string, caller_file string, caller_kind string, callee string, callee_file string, callee_start_line int, line int, is_local boolean, crate_name string"


def sqlite_table(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_table").schema(schema).option("path", path).option("table", table).load()
