"""The data model over the driver's tables: symbols, calls, files and lines.

Each projection is one SELECT that Spark and DuckDB both read, so that a query
and its oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Symbols: part as functions, types, traits and impls of made-up crates.
CHUNKS = """
SELECT p_partkey AS idx,
       p_type || '::' || p_brand || '::' || replace(p_name, ' ', '_') AS name,
       replace(p_name, ' ', '_') AS display_name,
       'crates/' || lower(p_type) || '/src/' || CASE WHEN p_partkey % 9 = 0 THEN 'tests/' ELSE '' END || p_brand || '.rs' AS file,
       CASE WHEN p_partkey % 10 < 6 THEN 'function' WHEN p_partkey % 10 = 6 THEN 'struct' WHEN p_partkey % 10 = 7 THEN 'enum' WHEN p_partkey % 10 = 8 THEN 'trait' ELSE 'impl' END AS kind,
       CAST((p_partkey % 50) * 10 + 1 AS INT) AS start_line,
       CAST((p_partkey % 50) * 10 + 1 + p_size AS INT) AS end_line,
       p_partkey % 7 = 0 AS is_test,
       CASE WHEN p_partkey % 13 = 0 THEN NULL
            ELSE CASE WHEN p_partkey % 4 = 0 THEN 'pub ' ELSE '' END || 'fn ' || replace(p_name, ' ', '_') || '(&self, size: &mut Vec<' || lower(p_type) || '>, n: u' || CAST(p_size AS VARCHAR(9)) || ') -> Option<' || replace(p_brand, '#', '') || '>' END AS signature,
       CASE WHEN p_partkey % 5 = 0 THEN '' ELSE lower(p_type) END AS crate_name
FROM part
"""

#: Calls: parts that follow each other in an order, self calls dropped, first line kept.
EDGES = """
SELECT src, dst, min(line) AS line
FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst, l_linenumber AS line FROM lineitem) AS calls
WHERE dst IS NOT NULL AND src <> dst
GROUP BY src, dst
"""

#: Functions that no order calls: customers, in the files and crates of the symbols.
IDLE = """
SELECT 1000000000 + c_custkey AS idx, c_mktsegment || '::idle::' || c_name AS name, c.file AS file, 'function' AS kind,
       c.start_line AS start_line, CAST(c.start_line + c_custkey % 40 AS INT) AS end_line, c_custkey % 11 = 0 AS is_test,
       CASE WHEN c_custkey % 3 = 0 THEN 'pub fn ' ELSE 'fn ' END || lower(c_mktsegment) AS signature, c.crate_name AS crate_name
FROM customer JOIN chunks AS c ON c.idx = 1 + c_custkey % 2000
"""

#: Calls by name: what each edge's caller says it calls, as a full name, a short name or with a receiver.
NAMED_CALLS = """
SELECT e.src AS src, CASE WHEN e.dst % 3 = 0 THEN c.name WHEN e.dst % 3 = 1 THEN 'x.' || c.display_name ELSE 'other::' || upper(c.display_name) END AS call, e.line AS line
FROM edges AS e JOIN chunks AS c ON c.idx = e.dst
"""

#: Field accesses: event types as receivers' types, users as fields.
FIELD_ACCESSES = """
SELECT CAST(event_id % 500 AS BIGINT) AS idx, event_type || '::f' || CAST(user_id % 10 AS VARCHAR(9)) AS key FROM events
"""

#: Where each edge says it goes: the file as written elsewhere and a line that may be off by one or two.
LOCATED_CALLS = """
SELECT e.src AS src, e.dst AS dst, e.line AS line,
       CASE WHEN e.dst % 4 = 0 THEN upper(c.file) ELSE c.file END AS callee_file,
       CAST(c.start_line + e.src % 4 - 1 AS INT) AS callee_line
FROM edges AS e JOIN chunks AS c ON c.idx = e.dst
"""

#: Files: length in lines, the longest symbols of some brands reach beyond it.
FILES = "SELECT file, CAST(max(start_line) + 25 AS INT) AS n_lines FROM chunks WHERE idx % 17 <> 0 GROUP BY file"

#: Snapshots of an index of files before and after changes.
FILE_INDEX = "SELECT 'd' || CAST(doc_id AS VARCHAR(20)) AS path, CAST(n_chars AS BIGINT) AS mtime, md5(text) AS hash FROM documents WHERE doc_id % 11 <> 5"
FILES_NOW = """
SELECT 'd' || CAST(doc_id AS VARCHAR(20)) AS path, CAST(n_chars + CASE WHEN doc_id % 7 IN (0, 1) THEN 1 ELSE 0 END AS BIGINT) AS mtime,
       CASE WHEN doc_id % 7 = 0 THEN md5(text || 'x') WHEN doc_id % 49 = 1 THEN NULL ELSE md5(text) END AS hash
FROM documents WHERE doc_id % 13 <> 4
"""


def project(spark: SparkSession, sql: str, **views: DataFrame) -> DataFrame:
    """Run one of the projections over the named frames."""
    text = sql.replace("{", "{{").replace("}", "}}")
    for name in views:
        for word in ("FROM ", "JOIN "):
            text = text.replace(f"{word}{name} ", f"{word}{{{name}}} ").replace(f"{word}{name}\n", f"{word}{{{name}}}\n").replace(f"{word}{name})", f"{word}{{{name}}})")
    return spark.sql(text.rstrip(), **views)


class Tables:
    """Projections of the tables in one folder, read on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def chunks(self) -> DataFrame:
        return project(self.spark, CHUNKS, part=self.raw("part"))

    def edges(self) -> DataFrame:
        return project(self.spark, EDGES, lineitem=self.raw("lineitem"))

    def idle(self) -> DataFrame:
        return project(self.spark, IDLE, customer=self.raw("customer"), chunks=self.chunks())

    def named_calls(self) -> DataFrame:
        return project(self.spark, NAMED_CALLS, edges=self.edges(), chunks=self.chunks())

    def located_calls(self) -> DataFrame:
        return project(self.spark, LOCATED_CALLS, edges=self.edges(), chunks=self.chunks())

    def files(self) -> DataFrame:
        return project(self.spark, FILES, chunks=self.chunks())

    def field_accesses(self) -> DataFrame:
        return project(self.spark, FIELD_ACCESSES + "\n", events=self.raw("events")).distinct()

    def file_index(self) -> DataFrame:
        return project(self.spark, FILE_INDEX, documents=self.raw("documents"))

    def files_now(self) -> DataFrame:
        return project(self.spark, FILES_NOW, documents=self.raw("documents"))


#: The projections as common table expressions of an oracle.
ORACLE_VIEWS = f"""chunks AS ({CHUNKS}), edges AS ({EDGES}), idle AS ({IDLE}), named AS ({NAMED_CALLS}), located AS ({LOCATED_CALLS}), files AS ({FILES}),
access AS (SELECT DISTINCT * FROM ({FIELD_ACCESSES})), old_files AS ({FILE_INDEX}), new_files AS ({FILES_NOW})"""
