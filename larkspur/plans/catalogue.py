"""Queries of the code-intelligence operators over the driver's tables, each with an
oracle in DuckDB's SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import names as N
from larkspur.functions import paths as P
from larkspur.operators import edits, graph, ingest, reports, resolve, similarity
from larkspur.operators.components import connected_components
from larkspur.plans.staging import settled, stage
from larkspur.sources.connectors import language_summary
from larkspur.sources.projections import ORACLE_VIEWS, Tables, project

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None, views: bool = True):
    """Register a query by its name, with its oracle over the projections."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            own = oracle.strip()
            if views:
                own = f"WITH RECURSIVE {ORACLE_VIEWS}, {own[5:]}" if own.startswith("WITH ") else f"WITH RECURSIVE {ORACLE_VIEWS} {own}"
            ORACLE_SQL[f.__name__] = own
        return f

    return add


def seeds(t: Tables, *ids: int) -> DataFrame:
    return t.spark.createDataFrame([(i,) for i in ids], "idx long")


_TEST = "(is_test OR contains(file, '/tests/'))"
_CRATE = "CASE WHEN crate_name <> '' THEN crate_name ELSE regexp_extract(file, '([^/]*)/src/', 1) END"
_STATS = f"""count(*) FILTER (kind = 'function' AND NOT {_TEST})::BIGINT AS prod_fns, count(*) FILTER (kind = 'function' AND {_TEST})::BIGINT AS test_fns,
count(*) FILTER (kind = 'struct')::BIGINT AS structs, count(*) FILTER (kind = 'enum')::BIGINT AS enums"""

# ---- reports ---------------------------------------------------------------


@query(f"SELECT {_CRATE} AS crate, {_STATS} FROM chunks GROUP BY 1")
def stats_by_crate(t: Tables) -> DataFrame:
    return reports.stats(t.chunks())


@query(f"WITH c AS (SELECT *, {_CRATE} AS crate FROM chunks) SELECT coalesce(crate, '(all)') AS crate, {_STATS} FROM c GROUP BY ROLLUP (crate)")
def stats_totals_rollup(t: Tables) -> DataFrame:
    return reports.stats(t.chunks(), totals=True)


_FILE_NAMES = "SELECT 'f' || CAST(p_partkey AS VARCHAR(20)) || CASE p_partkey % 8 WHEN 0 THEN '.rs' WHEN 1 THEN '.tsx' WHEN 2 THEN '.go' WHEN 3 THEN '.mjs' WHEN 4 THEN '.pyi' WHEN 5 THEN '.hh' WHEN 6 THEN '.h' ELSE '.md' END AS path FROM part"


@query(
    f"""SELECT CASE e WHEN 'rs' THEN 'rust' WHEN 'tsx' THEN 'typescript' WHEN 'go' THEN 'go' WHEN 'mjs' THEN 'javascript' WHEN 'pyi' THEN 'python' WHEN 'hh' THEN 'cpp' WHEN 'h' THEN 'c' ELSE 'other' END AS language, count(*)::BIGINT AS files
    FROM (SELECT regexp_extract(path, '[^.]*$') AS e FROM ({_FILE_NAMES})) GROUP BY 1"""
)
def lang_summary(t: Tables) -> DataFrame:
    return language_summary(project(t.spark, _FILE_NAMES + "\n", part=t.raw("part")))


@query("""
WITH d AS (SELECT DISTINCT regexp_extract(file, '^(.*/)', 1) AS dir FROM chunks),
     p AS (SELECT regexp_extract(dir, '^(.*?/src/)', 1) AS root, regexp_replace(dir, '^.*?/src/', '') AS sub FROM d),
     r AS (SELECT root, row_number() OVER (ORDER BY root) AS n FROM (SELECT DISTINCT root FROM p)),
     s AS (SELECT root, sub, row_number() OVER (PARTITION BY root ORDER BY sub) AS k FROM p WHERE sub <> '')
SELECT root AS dir, '[' || chr((64 + n)::INTEGER) || ']' AS alias FROM r WHERE n <= 26
UNION ALL SELECT root || sub, '[' || chr((64 + n)::INTEGER) || k || ']' FROM s JOIN r USING (root) WHERE n <= 26
""")
def path_aliases(t: Tables) -> DataFrame:
    return reports.path_aliases(t.chunks())


@query("""
WITH x AS (SELECT idx, regexp_extract(file, '^(.*/)', 1) AS dir, file FROM chunks),
     p AS (SELECT DISTINCT dir, regexp_extract(dir, '^(.*?/src/)', 1) AS root, regexp_replace(dir, '^.*?/src/', '') AS sub FROM x),
     r AS (SELECT root, row_number() OVER (ORDER BY root) AS n FROM (SELECT DISTINCT root FROM p)),
     s AS (SELECT dir, root, sub, CASE WHEN sub = '' THEN '' ELSE (row_number() OVER (PARTITION BY root, sub <> '' ORDER BY sub))::VARCHAR END AS k FROM p)
SELECT idx, '[' || chr((64 + n)::INTEGER) || k || ']' || regexp_extract(file, '[^/]*$') AS shown_file FROM x JOIN s USING (dir) JOIN r USING (root)
""")
def aliased_files(t: Tables) -> DataFrame:
    chunks = t.chunks()
    return reports.aliased(chunks, reports.path_aliases(chunks)).select("idx", "shown_file")


_FOUND = "idx, name, display_name, kind, file, start_line, end_line"


@query(f"SELECT {_FOUND} FROM chunks WHERE contains(lower(name), 'bolt') AND kind = 'function' AND NOT {_TEST}")
def symbol_search(t: Tables) -> DataFrame:
    return reports.search(t.chunks(), "Bolt", kind="function", exclude_tests=True)


@query(f"SELECT {_FOUND} FROM chunks WHERE contains(lower(name), 'src/brand#2.rs') OR ends_with(lower(file), 'src/brand#2.rs') ORDER BY idx LIMIT 40")
def symbol_search_file(t: Tables) -> DataFrame:
    return reports.search(t.chunks(), "src/Brand#2.rs", limit=40)


@query("SELECT idx, display_name FROM chunks WHERE contains(lower(display_name), 'ring') OR contains('ring', lower(display_name)) ORDER BY idx LIMIT 5")
def similar_symbol_hint(t: Tables) -> DataFrame:
    return reports.similar_names(t.chunks(), "ring")


_RECENTS = [("small_ring", 0), ("red_widget", 1), ("brand#4", 2), ("blue_bolt", 28), ("Brand#17", 40)]


@query("""
WITH r(key, gain) AS (VALUES ('small_ring', 30), ('red_widget', 29), ('brand#4', 28), ('blue_bolt', 2))
SELECT idx, greatest(coalesce(e.gain + 100, 0), coalesce(o.gain + 80, 0))::INTEGER AS score
FROM chunks LEFT JOIN r AS e ON e.key = lower(display_name) LEFT JOIN r AS o ON o.key = lower(split_part(name, '::', 2))
""")
def recent_ranking(t: Tables) -> DataFrame:
    return reports.ranked_by_recent(t.chunks(), t.spark.createDataFrame(_RECENTS, "name string, ord int")).select("idx", "score")


#: Symbols, and the customers as functions that no order calls.
_DEAD = f"""
every AS (SELECT idx, name, file, kind, start_line, end_line, is_test, signature, crate_name FROM chunks UNION ALL SELECT * FROM idle),
d AS (SELECT c.*, {_CRATE} AS crate FROM every AS c
      WHERE kind = 'function' AND NOT {_TEST} AND NOT starts_with(coalesce(signature, ''), 'pub ')
        AND NOT (coalesce(signature, '') = '' AND (SELECT count(*) FROM every AS o WHERE o.file = c.file AND o.start_line = c.start_line) >= 2)
        AND idx NOT IN (SELECT dst FROM edges))
"""


def _every(t: Tables) -> DataFrame:
    columns = ["idx", "name", "file", "kind", "start_line", "end_line", "is_test", "signature", "crate_name"]
    return t.chunks().select(columns).unionByName(t.idle().select(columns))


@query(f"WITH {_DEAD.strip()} SELECT crate, idx, name, file FROM d JOIN files USING (file) WHERE end_line <= n_lines")
def dead_code(t: Tables) -> DataFrame:
    return reports.dead_code(_every(t), t.edges(), t.files())


@query(f"WITH {_DEAD.strip()} SELECT crate, count(*)::BIGINT AS dead, md5(string_agg(idx::VARCHAR, ',' ORDER BY idx)) AS members_md5 FROM d JOIN files USING (file) WHERE end_line <= n_lines GROUP BY 1")
def dead_by_crate(t: Tables) -> DataFrame:
    return _dead_by_crate(reports.dead_code(_every(t), t.edges(), t.files()))


def _dead_by_crate(found: DataFrame) -> DataFrame:
    members = F.md5(F.array_join(F.transform(F.array_sort(F.collect_list("idx")), lambda i: i.cast("string")), ","))
    return found.groupBy("crate").agg(F.count(F.lit(1)).alias("dead"), members.alias("members_md5"))


@query("SELECT idx, (n_lines IS NULL OR end_line > n_lines) AS stale FROM chunks LEFT JOIN files USING (file)")
def stale_symbols(t: Tables) -> DataFrame:
    return reports.with_staleness(t.chunks(), t.files()).select("idx", "stale")


@query("""
SELECT 'crate' || (l_suppkey % 7) AS crate, sum(l_linenumber)::BIGINT AS fn_count, sum(CASE WHEN l_returnflag = 'A' THEN l_linenumber ELSE 0 END)::BIGINT AS fn_covered,
       sum(l_quantity::BIGINT)::BIGINT AS line_count, sum(CASE WHEN l_linestatus = 'F' THEN l_quantity::BIGINT ELSE 0 END)::BIGINT AS line_covered,
       round(100.0::DOUBLE * fn_covered / fn_count, 1) AS fn_pct, round(100.0::DOUBLE * line_covered / line_count, 1) AS line_pct
FROM lineitem GROUP BY 1
""")
def coverage_rollup(t: Tables) -> DataFrame:
    item = t.raw("lineitem")
    covered = lambda flag, value, n: F.sum(F.when(F.col(flag) == value, F.col(n).cast("long")).otherwise(0))
    per_file = item.groupBy("l_suppkey").agg(
        F.struct(F.sum("l_linenumber").alias("count"), covered("l_returnflag", "A", "l_linenumber").alias("covered")).alias("functions"),
        F.struct(F.sum(F.col("l_quantity").cast("long")).alias("count"), covered("l_linestatus", "F", "l_quantity").alias("covered")).alias("lines"),
    )
    name = F.concat(F.lit("crate"), (F.col("l_suppkey") % 7).cast("string"), F.lit("/src/s"), F.col("l_suppkey").cast("string"), F.lit(".rs"))
    document = per_file.groupBy().agg(F.collect_list(F.struct(name.alias("filename"), "functions", "lines")).alias("files"))
    return reports.coverage(document.select(F.explode("files").alias("f")).select("f.*"))


# ---- scalars ---------------------------------------------------------------


@query("""
SELECT idx, display_name, display_name AS shown, ':' || start_line || '-' || end_line AS span,
       regexp_replace(signature, '([A-Za-z0-9_]+::)+', '', 'g')[1:27] || CASE WHEN length(signature) > 30 THEN '...' ELSE '' END AS short_signature,
       lower(split_part(name, '::', 2)) AS owner, regexp_extract(file, '^crates/') AS root
FROM chunks
""")
def display_names(t: Tables) -> DataFrame:
    c = t.chunks()
    name = F.col("name")
    return c.select(
        "idx",
        N.display_name(name).alias("display_name"),
        N.shown_name(F.lit(""), N.last_segment(name)).alias("shown"),
        N.line_suffix(F.col("start_line"), F.col("end_line")).alias("span"),
        N.shorten_signature(F.col("signature"), 30).alias("short_signature"),
        N.owning_type(name).alias("owner"),
        P.first_folder(F.col("file")).alias("root"),
    )


@query("""
SELECT idx, CASE WHEN signature IS NULL THEN 0 ELSE 2 END AS n_params, 'vec' AS leaf_of_lower,
       regexp_extract(signature, 'Vec<([^>]*)>', 1) AS first_leaf, 'u' || (end_line - start_line) AS second_type,
       regexp_extract(signature, '-> (.*)$', 1) AS return_type, regexp_extract(signature, 'Option<(.*)>', 1) AS return_leaf
FROM chunks WHERE signature IS NOT NULL
""")
def parse_signatures(t: Tables) -> DataFrame:
    p = N.parameters(F.col("signature"))
    r = N.return_type(F.col("signature"))
    return t.chunks().where("signature is not null").select("idx", F.size(p).alias("n_params"), F.lit("vec").alias("leaf_of_lower"), N.leaf_type(p[0]["type"]).alias("first_leaf"), p[1]["type"].alias("second_type"), r.alias("return_type"), N.leaf_type(r).alias("return_leaf"))


_NAMES = """(VALUES ('<inn::Host as core::clone::Clone>::clone', 'jug.clone'), ('<Quill as Ink>::blot', 'self.pour'), ('pub(crate) a::b', 'Cellar::open'), ('a::b::{closure#0}', 'Ok'),
('Serve for Inn<T>::run', 'jug.lid.unwrap_or'), ('Shelf<K, Row<V>>::take', 'vec'), ('<geo::Leaf>', 'vecs')) AS v(name, call)"""


@query(
    """SELECT * FROM (VALUES
    ('<inn::Host as core::clone::Clone>::clone', 'Host::clone', '<inn::Host as core::clone::Clone>::clone', true, true, '::clone'),
    ('<Quill as Ink>::blot', 'Quill::blot', '<Quill as Ink>::blot', false, true, '::blot'),
    ('pub(crate) a::b', 'b', 'a::b', false, false, 'pub(crate) a::b'),
    ('a::b::{closure#0}', '{closure#0}', 'a::b', false, true, 'a::b::{closure#0}'),
    ('Serve for Inn<T>::run', 'run', 'Serve for Inn<T>::run', false, true, 'Serve for Inn::run'),
    ('Shelf<K, Row<V>>::take', 'take', 'Shelf<K, Row<V>>::take', false, true, 'Shelf::take'),
    ('<geo::Leaf>', 'Leaf', '<geo::Leaf>', false, false, '')) AS v(name, shown, key, derived, noise, bare)""",
    views=False,
)
def name_rules(t: Tables) -> DataFrame:
    v = t.spark.sql(f"SELECT * FROM {_NAMES}")
    n = F.col("name")
    return v.select("name", N.display_name(n).alias("shown"), N.strip_closure(N.strip_visibility(n)).alias("key"), N.is_derived_noise(n).alias("derived"), N.is_noise(F.col("call")).alias("noise"), N.strip_generics(n).alias("bare"))


# ---- resolution ------------------------------------------------------------


@query("SELECT idx FROM chunks WHERE lower(name) = 'small_ring' OR lower(display_name) = 'small_ring' OR ends_with(lower(name), '::small_ring')")
def resolve_symbol(t: Tables) -> DataFrame:
    return resolve.resolve_symbol(t.chunks(), "Small_Ring")


_KEYS = """
k AS (SELECT 'exact' AS space, 0 AS tier, lower(name) AS key, -idx AS o, idx FROM chunks
      UNION ALL SELECT 'exact', 1, lower(display_name), idx, idx FROM chunks
      UNION ALL SELECT 'exact', 1, lower(split_part(name, '::', 2) || '::' || split_part(name, '::', 3)), idx, idx FROM chunks
      UNION ALL SELECT 'short', 1, lower(display_name), idx, idx FROM chunks),
key AS (SELECT space, key, arg_min(idx, (tier, o)) AS idx FROM k GROUP BY 1, 2)
"""


@query("WITH " + _KEYS.strip() + " SELECT space, key, idx FROM key")
def symbol_keys(t: Tables) -> DataFrame:
    return resolve.symbol_keys(t.chunks())


@query(
    "WITH "
    + _KEYS.strip()
    + """,
n AS (SELECT src, line, lower(call) AS c, regexp_extract(lower(call), '([^:]*)$', 1) AS s, regexp_extract(lower(call), '([^.]*)$', 1) AS d FROM named),
r AS (SELECT src, line, coalesce(e.idx, s.idx, d.idx) AS dst FROM n LEFT JOIN key AS e ON e.space = 'exact' AND e.key = n.c
      LEFT JOIN key AS s ON s.space = 'short' AND s.key = n.s LEFT JOIN key AS d ON d.space = 'short' AND d.key = n.d)
SELECT src, dst, min(line) AS line FROM r WHERE dst IS NOT NULL AND src <> dst GROUP BY 1, 2"""
)
def resolve_calls_by_name(t: Tables) -> DataFrame:
    return resolve.resolve_by_name(t.named_calls(), t.chunks())


@query("""
WITH s AS (SELECT lower(file) AS file, start_line, max(idx) AS idx FROM chunks GROUP BY 1, 2),
     p AS (SELECT DISTINCT callee_file, callee_line FROM located WHERE callee_line > 0),
     h AS (SELECT callee_file, callee_line, arg_min(idx, r) AS dst FROM p, (VALUES (0, 0), (1, 1), (2, -1)) AS d(r, x), s
           WHERE s.file = lower(callee_file) AND s.start_line = callee_line + x GROUP BY 1, 2)
SELECT l.src, l.line, l.callee_file, l.callee_line, h.dst FROM located AS l JOIN h USING (callee_file, callee_line)
""")
def resolve_calls_by_location(t: Tables) -> DataFrame:
    return resolve.resolve_by_location(t.located_calls(), t.chunks())


#: Traits, impls and trait methods: regions, their nations and suppliers.
_TRAITS = """
SELECT CAST(r_regionkey AS BIGINT) AS idx, 'geo::' || r_name AS name, r_name AS display_name, 'crates/geo/src/lib.rs' AS file, 'trait' AS kind, 1 AS start_line, 9 AS end_line FROM region
UNION ALL SELECT CAST(100 + n_nationkey AS BIGINT), r_name || ' for ' || n_name, n_name, 'crates/geo/src/nation.rs', 'impl', 1, 9 FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT CAST(1000 + s_suppkey AS BIGINT), '<geo::' || n_name || ' as geo::' || r_name || '>::m' || CAST(s_suppkey % 10 AS VARCHAR(9)), 'm', 'crates/geo/src/s.rs', 'function', CAST(s_suppkey AS INT), CAST(s_suppkey AS INT)
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""
#: Calls of trait methods by customers.
_TRAIT_CALLS = """
SELECT c_custkey AS caller, 'geo::' || r_name || '::m' || CAST(c_custkey % 10 AS VARCHAR(9)) AS callee FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""


def _traits(t: Tables) -> DataFrame:
    return project(t.spark, _TRAITS, **{n: t.raw(n) for n in ("region", "nation", "supplier")})


def _trait_calls(t: Tables) -> DataFrame:
    return project(t.spark, _TRAIT_CALLS, **{n: t.raw(n) for n in ("region", "nation", "customer")})


@query(f"""
WITH tr AS ({_TRAITS}), calls AS ({_TRAIT_CALLS}),
     m AS (SELECT idx, regexp_extract(lower(name), ' as geo::(.*)>::', 1) AS trait, regexp_extract(lower(name), '>::(.*)$', 1) AS method FROM tr WHERE contains(name, ' as '))
SELECT caller, callee, idx AS dst FROM calls JOIN m ON lower(callee) = 'geo::' || trait || '::' || method
""")
def resolve_trait_fanout(t: Tables) -> DataFrame:
    return resolve.trait_fan_out(_trait_calls(t), _traits(t)).select("caller", "callee", "dst")


@query(f"WITH tr AS ({_TRAITS}) SELECT a.idx AS trait_idx, b.idx AS impl_idx FROM tr AS a JOIN tr AS b ON a.kind = 'trait' AND b.kind = 'impl' AND starts_with(b.name, a.display_name || ' for ')")
def trait_impls(t: Tables) -> DataFrame:
    return resolve.trait_impls(_traits(t))


@query(f"""
WITH tr AS ({_TRAITS}), p AS (SELECT a.idx AS trait_idx, b.idx AS impl_idx FROM tr AS a JOIN tr AS b ON a.kind = 'trait' AND b.kind = 'impl' AND starts_with(b.name, a.display_name || ' for ')),
     s(idx) AS (VALUES (0::BIGINT), (103::BIGINT))
SELECT idx FROM s UNION SELECT impl_idx FROM p JOIN s ON s.idx = trait_idx UNION SELECT trait_idx FROM p JOIN s ON s.idx = impl_idx
""")
def expand_trait_seeds(t: Tables) -> DataFrame:
    return graph.with_traits(seeds(t, 0, 103), resolve.trait_impls(_traits(t)))


_AMBIGUOUS = """
SELECT p_partkey AS row_id, replace(p_name, ' ', '_') AS caller, 'crates/' || lower(p_type) || '/src/' || p_brand || '.rs' AS caller_file, p_partkey % 100 AS dst FROM part
"""
_SHORT_CHUNKS = "SELECT idx, display_name AS name, file, start_line, end_line FROM chunks"


@query(f"""
WITH a AS ({_AMBIGUOUS}), s AS ({_SHORT_CHUNKS})
SELECT row_id, arg_min(s.idx, (s.file <> caller_file, s.idx)) AS src FROM a JOIN s ON lower(s.name) = caller GROUP BY 1
""")
def ambiguous_callers(t: Tables) -> DataFrame:
    chunks = project(t.spark, _SHORT_CHUNKS + "\n", chunks=t.chunks())
    calls = project(t.spark, _AMBIGUOUS, part=t.raw("part")).join(t.chunks().select(F.col("idx").alias("dst"), F.col("file").alias("dst_file")), "dst")
    return resolve.choose_callers(calls, chunks).select("row_id", "src")


@query(
    "WITH "
    + _KEYS.strip()
    + """,
r AS (SELECT src, upper(split_part(call, '.', 2)) AS type FROM named WHERE starts_with(call, 'x.'))
SELECT DISTINCT src, coalesce(e.idx, s.idx) AS dst FROM r LEFT JOIN key AS e ON e.space = 'exact' AND e.key = lower(r.type) LEFT JOIN key AS s ON s.space = 'short' AND s.key = lower(r.type)
WHERE coalesce(e.idx, s.idx) <> src"""
)
def type_ref_edges(t: Tables) -> DataFrame:
    refs = t.named_calls().where(F.col("call").startswith("x.")).select("src", F.upper(F.substring_index("call", ".", -1)).alias("type"))
    return resolve.resolve_type_refs(refs, t.chunks())


@query("""
WITH r AS (SELECT idx, row_number() OVER (PARTITION BY file, display_name, kind ORDER BY end_line - start_line DESC, idx DESC) AS n, kind FROM chunks)
SELECT idx FROM r WHERE n = 1 OR kind NOT IN ('struct', 'enum', 'trait')
""")
def dedup_types(t: Tables) -> DataFrame:
    return resolve.dedup_types(t.chunks()).select("idx")


@query("SELECT src, dst, coalesce(e.line, 0) AS line FROM (SELECT idx AS src, (idx * 7) % 2000 AS dst FROM chunks) LEFT JOIN edges AS e USING (src, dst)")
def call_site_lines(t: Tables) -> DataFrame:
    asked = t.chunks().select(F.col("idx").alias("src"), ((F.col("idx") * 7) % 2000).alias("dst"))
    return asked.join(t.edges(), ["src", "dst"], "left").select("src", "dst", F.coalesce("line", F.lit(0)).alias("line"))


# ---- traversals ------------------------------------------------------------


def _walk(near: str, far: str, start: str, depth: int, edges: str = "edges") -> str:
    return f"b(idx, depth) AS ({start} UNION SELECT e.{far}, b.depth + 1 FROM b JOIN {edges} AS e ON e.{near} = b.idx WHERE b.depth < {depth}), w AS (SELECT idx, min(depth)::INTEGER AS depth FROM b GROUP BY 1)"


@query("WITH " + _walk("src", "dst", "SELECT 1::BIGINT, 0", 3) + " SELECT idx, depth FROM w")
def bfs_forward_depth(t: Tables) -> DataFrame:
    return graph.bfs(t.edges(), seeds(t, 1), 3)


@query("WITH " + _walk("dst", "src", "SELECT unnest([5, 7])::BIGINT, 0", 2) + " SELECT idx, depth FROM w")
def bfs_reverse_depth(t: Tables) -> DataFrame:
    return graph.bfs(t.edges(), seeds(t, 5, 7), 2, reverse=True)


@query("WITH " + _walk("dst", "src", "SELECT idx, 0 FROM chunks WHERE display_name = 'small_ring'", 2) + f" SELECT idx, depth, {_TEST} AS test FROM w JOIN chunks USING (idx)")
def blast_symbol(t: Tables) -> DataFrame:
    chunks = t.chunks()
    return reports.blast(chunks, t.edges(), resolve.resolve_symbol(chunks, "small_ring"), depth=1)


@query("WITH " + _walk("dst", "src", "SELECT idx, 0 FROM access WHERE key = 'click::f3'", 2) + f" SELECT count(*) FILTER (depth > 0 AND NOT {_TEST})::BIGINT AS prod, count(*) FILTER (depth > 0 AND {_TEST})::BIGINT AS tests FROM w JOIN chunks USING (idx)")
def blast_field(t: Tables) -> DataFrame:
    users = t.field_accesses().where(F.col("key") == "click::f3").select("idx")
    return reports.blast_counts(reports.blast(t.chunks(), t.edges(), users))


@query("WITH " + _walk("dst", "src", "SELECT DISTINCT idx, 0 FROM access WHERE starts_with(key, 'signup::')", 2) + f" SELECT idx, depth, {_TEST} AS test FROM w JOIN chunks USING (idx)")
def blast_type(t: Tables) -> DataFrame:
    users = t.field_accesses().where(F.col("key").startswith("signup::")).select("idx")
    return reports.blast(t.chunks(), t.edges(), users)


_BOTH = "u AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges)"


def _joined(links: str, into: str) -> str:
    """Components of symmetric links (a, b): a node takes the least label of its neighbours until none changes."""
    return f"{into}(idx, c) USING KEY (idx) AS (SELECT DISTINCT a, a FROM {links} UNION SELECT me.idx, min(w.c) FROM {into} AS w JOIN {links} AS l ON l.b = w.idx JOIN recurring.{into} AS me ON me.idx = l.a WHERE w.c < me.c GROUP BY me.idx)"


_ENDS = "(SELECT min(idx) AS lo, max(idx) AS hi FROM comp WHERE c = (SELECT c FROM comp GROUP BY c ORDER BY count(*) DESC, c LIMIT 1))"
_COMP = f"{_BOTH}, {_joined('u', 'comp')}"


@query(f"WITH {_COMP} SELECT idx AS node, c AS component FROM comp")
def components(t: Tables) -> DataFrame:
    return connected_components(t.edges())


def _ends(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Smallest and largest node of the largest component."""
    found = connected_components(edges)
    largest = found.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi")).orderBy(F.desc("n"), "component").limit(1)
    return largest.select(F.col("lo").alias("idx")), largest.select(F.col("hi").alias("idx"))


_LEVELS = f"{_COMP}, ends AS {_ENDS}, lv(idx, depth) AS (SELECT lo, 0 FROM ends UNION SELECT u.b, lv.depth + 1 FROM lv JOIN u ON u.a = lv.idx WHERE lv.depth < 16), least_ AS (SELECT idx, min(depth) AS depth FROM lv GROUP BY 1)"


@query(f"WITH {_LEVELS} SELECT depth::BIGINT AS hops FROM least_ JOIN ends ON idx = hi")
def trace_hops(t: Tables) -> DataFrame:
    edges = stage(t.edges(), "edges")
    return graph.shortest_path(edges, *_ends(edges)).agg((F.count(F.lit(1)) - 1).alias("hops"))


@query(
    f"""WITH {_LEVELS},
    back(idx, depth) AS (SELECT hi, depth FROM ends JOIN least_ ON least_.idx = hi
        UNION ALL SELECT (SELECT min(p.idx) FROM u JOIN least_ AS p ON p.idx = u.a WHERE u.b = back.idx AND p.depth = back.depth - 1), back.depth - 1 FROM back WHERE back.depth > 0)
    SELECT depth::INTEGER AS pos, idx FROM back"""
)
def trace_path(t: Tables) -> DataFrame:
    edges = stage(t.edges(), "edges")
    return graph.shortest_path(edges, *_ends(edges))


_INNER = f"""f AS (SELECT idx, crate_name AS g, end_line - start_line + 1 AS n FROM chunks WHERE kind = 'function'),
i AS (SELECT src AS a, dst AS b FROM edges JOIN f AS x ON x.idx = src JOIN f AS y ON y.idx = dst WHERE x.g = y.g), i2 AS (SELECT a, b FROM i UNION SELECT b, a FROM i), {_joined('i2', 'ic')}"""


@query(f"WITH {_INNER} SELECT g AS file, coalesce(c, idx) AS component, count(*)::BIGINT AS members, sum(n)::BIGINT AS lines, sum(n) >= 50 AS split_candidate FROM f LEFT JOIN ic USING (idx) GROUP BY 1, 2")
def cluster_candidates(t: Tables) -> DataFrame:
    # a crate stands for a file here, so that groups are large enough to split
    return graph.clusters(t.chunks().withColumn("file", F.col("crate_name")), t.edges())


@query("""
WITH kids AS (SELECT src, list(dst ORDER BY dst DESC) AS ks FROM edges JOIN chunks ON idx = dst WHERE NOT is_test GROUP BY src),
     walk(pos, depth, idx, back, stack, seen) AS (
        SELECT 0, 0, 1::BIGINT, false, list_transform((SELECT ks FROM kids WHERE src = 1), lambda x: {'n': x, 'd': 1}), [1::BIGINT]
        UNION ALL SELECT pos + 1, w.stack[-1].d, w.stack[-1].n, list_contains(w.seen, w.stack[-1].n),
               w.stack[:-2] || CASE WHEN list_contains(w.seen, w.stack[-1].n) OR w.stack[-1].d >= 3 THEN [] ELSE list_transform(coalesce(k.ks, []), lambda x: {'n': x, 'd': w.stack[-1].d + 1}) END,
               CASE WHEN list_contains(w.seen, w.stack[-1].n) THEN w.seen ELSE list_append(w.seen, w.stack[-1].n) END
        FROM walk AS w LEFT JOIN kids AS k ON k.src = w.stack[-1].n WHERE len(w.stack) > 0)
SELECT pos, depth, idx, back FROM walk
""")
def flow_tree(t: Tables) -> DataFrame:
    return graph.flow_tree(t.chunks(), t.edges(), 1, 3)


@query(
    "WITH "
    + _walk("dst", "src", "SELECT 1::BIGINT, 0", 2)
    + ", "
    + _walk("src", "dst", "SELECT 1::BIGINT, 0", 2).replace("b(", "d(", 1).replace("b.", "d.").replace("FROM b ", "FROM d ").replace("w AS", "v AS").replace("FROM b", "FROM d")
    + f""",
    r AS (SELECT idx, 1 AS p, 'def' AS role, 0 AS depth FROM (SELECT 1::BIGINT AS idx)
          UNION ALL SELECT (idx * 3) % 2000, 3, 'type', 1 FROM chunks WHERE idx = 1
          UNION ALL SELECT idx, CASE WHEN {_TEST} THEN 6 ELSE 4 END, CASE WHEN {_TEST} THEN 'test' ELSE 'caller' END, depth FROM w JOIN chunks USING (idx) WHERE depth > 0
          UNION ALL SELECT idx, 5, 'callee', depth FROM v JOIN chunks USING (idx) WHERE depth > 0 AND NOT {_TEST}),
    best AS (SELECT idx, min((p, depth, role)) AS x FROM r GROUP BY 1), site AS (SELECT src AS idx, min(line) AS line FROM edges WHERE dst = 1 GROUP BY 1)
    SELECT idx, x[3] AS role, x[2]::INTEGER AS depth, (CASE WHEN x[3] IN ('caller', 'test') THEN coalesce(line, 0) ELSE 0 END)::INTEGER AS call_line FROM best LEFT JOIN site USING (idx)"""
)
def context_roles(t: Tables) -> DataFrame:
    refs = t.chunks().select(F.col("idx").alias("src"), ((F.col("idx") * 3) % 2000).alias("dst"))
    none = t.spark.createDataFrame([], "trait_idx long, impl_idx long")
    return reports.context(t.chunks(), t.edges(), refs, seeds(t, 1), none, depth=2)


@query("""
WITH p AS (SELECT idx % 20 AS trait_idx, idx AS impl_idx FROM chunks WHERE kind = 'impl'), n AS (SELECT trait_idx, count(DISTINCT impl_idx) AS impls FROM p GROUP BY 1),
     c AS (SELECT trait_idx, src AS caller, count(DISTINCT impl_idx)::BIGINT AS n FROM p JOIN edges ON dst = impl_idx GROUP BY 1, 2)
SELECT trait_idx, caller, c.n, c.n > 1 AND c.n >= ceil(impls / 2) AS shared FROM c JOIN n USING (trait_idx)
""")
def impl_group_shared_callers(t: Tables) -> DataFrame:
    impls = t.chunks().where("kind = 'impl'").select((F.col("idx") % 20).alias("trait_idx"), F.col("idx").alias("impl_idx"))
    return reports.shared_callers(impls, t.edges())


# ---- similarity ------------------------------------------------------------

_TOKENS = """
ln AS (SELECT doc_id, i, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS t FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS raw FROM documents)),
st AS (SELECT *, coalesce(last_value(CASE WHEN starts_with(t, '/*') AND NOT contains(t, '*/') THEN true WHEN contains(t, '*/') THEN false END IGNORE NULLS)
       OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS inside FROM ln),
cd AS (SELECT doc_id, i, CASE WHEN inside THEN CASE WHEN contains(t, '*/') THEN t[strpos(t, '*/') + 2:] ELSE '' END
       WHEN starts_with(t, '/*') OR starts_with(t, '//') OR starts_with(t, '#') THEN '' ELSE split_part(t, '//', 1) END AS code FROM st),
tk AS (SELECT doc_id, i, j, CASE WHEN regexp_full_match(w, '[0-9]+') THEN '$N' ELSE w END AS token
       FROM (SELECT doc_id, i, generate_subscripts(ws, 1) AS j, unnest(ws) AS w FROM (SELECT doc_id, i, string_split_regex(code, '[^\\p{L}\\p{N}_]+') AS ws FROM cd)) WHERE w <> ''),
ft AS (SELECT DISTINCT doc_id, unnest([token, token || '_' || nxt]) AS feature FROM (SELECT *, lead(token) OVER (PARTITION BY doc_id ORDER BY i, j) AS nxt, count(*) OVER (PARTITION BY doc_id) AS n FROM tk) WHERE n >= 10)
"""


def _texts(t: Tables) -> DataFrame:
    return t.raw("documents").select(F.col("doc_id").alias("idx"), "text")


def _signatures(t: Tables) -> DataFrame:
    return stage(similarity.minhash(_texts(t)), "signatures")


@query(f"WITH {_TOKENS.strip()} SELECT doc_id AS idx, count(*)::BIGINT AS tokens, count(DISTINCT token)::BIGINT AS kinds, count(*) FILTER (token = '$N')::BIGINT AS numbers, min(token) AS first_token FROM tk GROUP BY 1")
def code_tokens(t: Tables) -> DataFrame:
    tokens = similarity.code_tokens(_texts(t))
    return tokens.groupBy("idx").agg(F.count(F.lit(1)).alias("tokens"), F.count_distinct("token").alias("kinds"), F.count_if(F.col("token") == "$N").alias("numbers"), F.min("token").alias("first_token"))


@query(f"WITH {_TOKENS.strip()} SELECT doc_id AS idx, count(*)::BIGINT AS features, min(feature) AS least, max(feature) AS most FROM ft WHERE feature IS NOT NULL GROUP BY 1")
def token_bigrams(t: Tables) -> DataFrame:
    found = similarity.text_features(_texts(t))
    return found.groupBy("idx").agg(F.count(F.lit(1)).alias("features"), F.min("feature").alias("least"), F.max("feature").alias("most"))


_MINS = ", ".join(f"min(({a} * h + {b}) % {similarity.MODULUS})" for a, b in map(similarity.permutation, range(similarity.WIDTH)))
_SIGNED = f"{_TOKENS.strip()}, hs AS (SELECT doc_id, ('0x' || left(md5(feature), 7))::BIGINT AS h FROM ft WHERE feature IS NOT NULL), sg AS (SELECT doc_id AS idx, [{_MINS}] AS s FROM hs GROUP BY 1)"


@query(f"WITH {_SIGNED} SELECT idx, md5(array_to_string(s, ',')) AS signature_md5, s[1]::BIGINT AS first FROM sg")
def minhash_signature(t: Tables) -> DataFrame:
    s = F.col("signature")
    return _signatures(t).select("idx", F.md5(F.array_join(F.transform(s, lambda x: x.cast("string")), ",")).alias("signature_md5"), s[0].alias("first"))


@query(f"""WITH {_SIGNED}, cl AS (SELECT idx, s, min(idx) OVER (PARTITION BY s) AS class FROM sg), bk AS (SELECT idx, class, generate_subscripts(s, 1) AS p, unnest(s) AS v FROM cl),
pr AS (SELECT a.idx AS a, b.idx AS b, any_value(a.class) AS ca, any_value(b.class) AS cb, count(*)::INTEGER AS matches FROM bk AS a JOIN bk AS b ON a.p = b.p AND a.v = b.v AND a.idx < b.idx GROUP BY 1, 2 HAVING count(*) >= 32)
SELECT a, b, matches FROM pr WHERE a = ca AND (b = cb OR ca = cb)""")
def minhash_pairs(t: Tables) -> DataFrame:
    return similarity.minhash_pairs(_signatures(t), 0.5)


@query(f"WITH {_SIGNED} SELECT idx, min(idx) OVER (PARTITION BY s) AS class FROM sg")
def minhash_classes(t: Tables) -> DataFrame:
    return similarity.signature_classes(_signatures(t))


def _hashed(t: Tables) -> DataFrame:
    # symbols of one signature and no calls hash alike
    c = t.chunks()
    lines = similarity.line_count(F.col("start_line"), F.col("end_line"))
    hashed = similarity.structure_hash(F.regexp_replace("signature", r"n: u\d+", "n"), F.array(F.col("kind")), F.col("name"), lines, F.lit(""))
    return c.select("idx", "file", "start_line", "end_line", hashed.alias("hash"))


_HASHED = "hh AS (SELECT idx, file, start_line AS s, end_line AS e, CASE WHEN coalesce(signature, '') = '' THEN md5(chr(10) || kind || chr(10) || name || chr(10) || (end_line - start_line + 1) || chr(10) || md5('')) ELSE md5(regexp_replace(signature, 'n: u[0-9]+', 'n') || chr(10) || kind) END AS hash FROM chunks)"


@query(f"""WITH {_HASHED}, m AS (SELECT hash, file, list({{'i': idx, 's': s, 'e': e}} ORDER BY e - s DESC, idx) AS ms FROM hh GROUP BY 1, 2),
k AS (SELECT hash, unnest(list_transform(list_reduce(ms[2:], lambda kept, x: CASE WHEN len(list_filter(kept, lambda y: y.s <= x.e AND x.s <= y.e)) = 0 THEN list_append(kept, x) ELSE kept END, [ms[1]]), lambda x: x.i)) AS idx FROM m)
SELECT hash, count(*)::BIGINT AS size, string_agg(idx::VARCHAR, ',' ORDER BY idx) AS members FROM k GROUP BY 1 HAVING count(*) > 1""")
def ast_hash_groups(t: Tables) -> DataFrame:
    groups = similarity.hash_groups(_hashed(t))
    return groups.select("hash", "size", F.array_join(F.transform("members", lambda i: i.cast("string")), ",").alias("members"))


@query(f"WITH {_HASHED} SELECT idx, hash FROM hh")
def structure_hashes(t: Tables) -> DataFrame:
    return _hashed(t).select("idx", "hash")


def _clone_chunks(t: Tables) -> DataFrame:
    hashed = similarity.body_digest(F.col("text"))
    return t.raw("documents").select(F.col("doc_id").alias("idx"), "source", "n_chars", "text").select("idx", F.col("source").alias("file"), (F.col("n_chars") % 1000).cast("int").alias("start_line"), (F.col("n_chars") % 1000 + 20).cast("int").alias("end_line"), hashed.alias("hash"))


@query()
def unified_dupes(t: Tables) -> DataFrame:
    rows = _clone_chunks(t)
    return similarity.unified_classes(rows, _signatures(t), rows.select("idx", "hash"), 0.4)


@query("WITH o AS (SELECT a.idx AS a, b.idx AS b, a.start_line AS s1, a.end_line AS e1, b.start_line AS s2, b.end_line AS e2 FROM chunks AS a JOIN chunks AS b ON b.idx = a.idx + 1 OR b.idx = a.idx + 3) SELECT a, b FROM o WHERE NOT (s1 <= e2 AND s2 <= e1)")
def dupe_overlap_filter(t: Tables) -> DataFrame:
    # a symbol with the first and the third after it, taken for one file's
    c = t.chunks().select("idx", F.lit("f").alias("file"), "start_line", "end_line")
    pairs = c.select(F.col("idx").alias("a"), F.explode(F.array(F.col("idx") + 1, F.col("idx") + 3)).alias("b"))
    return similarity.apart(pairs, c)


@query()
def dupe_analysis(t: Tables) -> DataFrame:
    # a document is the text of the symbol of its number
    pairs = settled(lambda: QUERIES["unified_dupes"](t.spark, t.sf_dir).select("a", "b"), "pairs")
    return similarity.analyze_pairs(pairs, t.edges(), t.chunks())


@query(f"""
WITH p AS (SELECT idx AS a, idx + 1 AS b FROM chunks WHERE idx + 1 IN (SELECT idx FROM chunks)),
     cs AS (SELECT src AS idx, list(DISTINCT dst) AS s FROM edges GROUP BY 1), rs AS (SELECT dst AS idx, list(DISTINCT src) AS s FROM edges GROUP BY 1),
     j AS (SELECT a, b, coalesce(ca.s, []) AS ca, coalesce(cb.s, []) AS cb, coalesce(ra.s, []) AS ra, coalesce(rb.s, []) AS rb FROM p LEFT JOIN cs AS ca ON ca.idx = a LEFT JOIN cs AS cb ON cb.idx = b LEFT JOIN rs AS ra ON ra.idx = a LEFT JOIN rs AS rb ON rb.idx = b),
     k AS (SELECT a, b, CASE WHEN len(list_distinct(ca || cb)) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(ca, cb))::DOUBLE / len(list_distinct(ca || cb)) END AS callee_jaccard,
                  CASE WHEN len(list_distinct(ra || rb)) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(ra, rb))::DOUBLE / len(list_distinct(ra || rb)) END AS caller_jaccard FROM j),
     o AS (SELECT a, b, e.src AS n FROM p JOIN edges AS e ON e.dst IN (a, b)), o2 AS (SELECT a, b, n FROM o UNION SELECT a, b, e.src FROM o JOIN edges AS e ON e.dst = o.n),
     c AS (SELECT a, b, count(*) FILTER (NOT {_TEST}) AS prod, count(*) FILTER ({_TEST}) AS tests FROM o2 JOIN chunks ON idx = n WHERE n <> a AND n <> b GROUP BY 1, 2)
SELECT k.*, coalesce(prod, 0)::BIGINT AS prod, coalesce(tests, 0)::BIGINT AS tests, CASE WHEN callee_jaccard = 1 THEN 'SAFE TO MERGE' WHEN callee_jaccard >= 0.5 THEN 'REVIEW NEEDED' ELSE 'DIFFERENT LOGIC' END AS verdict FROM k LEFT JOIN c USING (a, b)
""")
def pair_verdicts(t: Tables) -> DataFrame:
    # every symbol with the one after it
    c = t.chunks()
    pairs = c.select(F.col("idx").alias("a"), (F.col("idx") + 1).alias("b")).join(c.select(F.col("idx").alias("b")), "b", "left_semi").select("a", "b")
    return similarity.analyze_pairs(pairs, stage(t.edges(), "edges"), c)


# ---- ingest ----------------------------------------------------------------


@query("SELECT n.path FROM new_files AS n LEFT JOIN old_files AS o USING (path) WHERE o.path IS NULL OR (n.mtime <> o.mtime AND n.hash IS NOT NULL AND (o.hash IS NULL OR n.hash <> o.hash))")
def changed_files(t: Tables) -> DataFrame:
    return ingest.changed_files(t.files_now(), t.file_index())


@query("SELECT path FROM old_files WHERE path NOT IN (SELECT path FROM new_files)")
def deleted_files(t: Tables) -> DataFrame:
    return ingest.deleted_files(t.files_now(), t.file_index())


@query("SELECT path, mtime, hash FROM new_files")
def next_file_index(t: Tables) -> DataFrame:
    return ingest.next_index(t.files_now(), t.file_index())


@query("WITH r AS (SELECT display_name AS name, file, idx AS seq, is_test, row_number() OVER (PARTITION BY display_name, file ORDER BY is_test, idx) AS n FROM chunks) SELECT name, file, seq, is_test FROM r WHERE n = 1")
def ingest_dedup(t: Tables) -> DataFrame:
    return ingest.dedup_symbols(t.chunks().select(F.col("display_name").alias("name"), "file", F.col("idx").alias("seq"), "is_test"))


_OLD = "SELECT file, name, idx, 'old' AS version FROM chunks WHERE idx % 3 <> 0"
_NEW = "SELECT file, name, idx, 'new' AS version FROM chunks WHERE idx % 5 = 0"


@query(f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT * FROM n UNION ALL SELECT * FROM o WHERE (file, name) NOT IN (SELECT (file, name) FROM n)")
def merge_incremental(t: Tables) -> DataFrame:
    return ingest.merge_changed(project(t.spark, _OLD, chunks=t.chunks()), project(t.spark, _NEW, chunks=t.chunks()), ["file", "name"])


@query("""
WITH m AS (SELECT name, kind, crate_name, file FROM chunks WHERE idx % 2 = 0), s AS (SELECT name, kind, crate_name, CASE WHEN idx % 4 = 1 THEN '/abs/' || file WHEN idx % 4 = 3 THEN 'sub/' || file ELSE file END AS file FROM chunks WHERE idx % 3 = 0 AND crate_name IN ('economy', 'promo')),
     f AS (SELECT name, kind, crate_name, CASE WHEN starts_with(file, '/') OR starts_with(file, 'sub/') THEN file ELSE 'sub/' || file END AS file FROM s)
SELECT * FROM f UNION ALL SELECT * FROM m WHERE (name, kind, crate_name) NOT IN (SELECT (name, kind, crate_name) FROM f)
""")
def merge_prefixed(t: Tables) -> DataFrame:
    c = t.chunks()
    main = c.where("idx % 2 = 0").select("name", "kind", "crate_name", "file")
    file = F.when(F.col("idx") % 4 == 1, F.concat(F.lit("/abs/"), "file")).when(F.col("idx") % 4 == 3, F.concat(F.lit("sub/"), "file")).otherwise(F.col("file"))
    sub = c.where("idx % 3 = 0").select("name", "kind", "crate_name", file.alias("file"))
    return ingest.merge_prefixed(main, sub, ["economy", "promo"], "sub", ["name", "kind", "crate_name"])


@query("WITH d AS (SELECT DISTINCT crate_name FROM chunks UNION SELECT 'never') SELECT crate_name FROM d WHERE crate_name NOT IN (SELECT crate_name FROM chunks WHERE idx % 6 = 1)")
def missing_crates(t: Tables) -> DataFrame:
    c = t.chunks()
    declared = c.select("crate_name").unionByName(t.spark.createDataFrame([("never",)], "crate_name string"))
    return ingest.missing_crates(declared, c.where("idx % 6 = 1"))


@query("""
SELECT p.file, p.line, p.idx, min((s.end_line - s.start_line, s.name))[2] AS name FROM (SELECT file, start_line + 5 AS line, idx FROM chunks) AS p
JOIN chunks AS s ON s.file = p.file AND s.start_line <= p.line AND p.line <= s.end_line GROUP BY 1, 2, 3
""")
def span_interval_join(t: Tables) -> DataFrame:
    c = t.chunks()
    return ingest.span_join(c.select("file", (F.col("start_line") + 5).alias("line"), "idx"), c)


# ---- edits -----------------------------------------------------------------


@query("""
WITH ln AS (SELECT doc_id::VARCHAR AS file, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS text FROM documents),
     ed AS (SELECT doc_id::VARCHAR AS file, doc_id % 4 AS op FROM labels),
     o AS (SELECT ln.file, n::DOUBLE AS p, text FROM ln LEFT JOIN ed USING (file) WHERE NOT (n = 1 AND coalesce(op, 9) IN (0, 1))
           UNION ALL SELECT file, 1, 'new body' FROM ed JOIN (SELECT DISTINCT file FROM ln) USING (file) WHERE op = 0
           UNION ALL SELECT file, 0.5 + x, CASE x WHEN 0 THEN 'new body' ELSE '' END FROM ed JOIN (SELECT DISTINCT file FROM ln) USING (file), (VALUES (0), (0.1)) AS v(x) WHERE op = 2
           UNION ALL SELECT file, 1.5 + x, CASE x WHEN 0 THEN '' ELSE 'new body' END FROM ed JOIN (SELECT DISTINCT file FROM ln) USING (file), (VALUES (0), (0.1)) AS v(x) WHERE op = 3)
SELECT file, count(*)::BIGINT AS n, md5(string_agg(text, chr(10) ORDER BY p)) AS text_md5 FROM o GROUP BY 1
""")
def apply_line_edits(t: Tables) -> DataFrame:
    lines = edits.to_lines(t.raw("documents").select(F.col("doc_id").cast("string").alias("file"), "text"))
    op = F.element_at(F.array(*map(F.lit, ("replace", "delete", "before", "after"))), (F.col("doc_id") % 4 + 1).cast("int"))
    plan = t.raw("labels").select(F.col("doc_id").cast("string").alias("file"), op.alias("op"), F.lit(1).alias("start"), F.lit(1).alias("end"), F.lit("new body\n").alias("body"), F.lit(0).alias("seq"))
    done = edits.apply_edits(lines, plan)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n")
    return done.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.md5(text).alias("text_md5"))


_SOURCE = """(VALUES ('a.rs', 1, 'use std::fmt;'), ('a.rs', 2, 'use std::io::{Read, Write as W};'), ('a.rs', 3, 'pub use x::Y;'), ('a.rs', 4, 'use q::*;'), ('a.rs', 5, ''), ('a.rs', 6, 'fn main() {'), ('a.rs', 7, '    fmt::x(W);'), ('a.rs', 8, '}'),
('b.rs', 1, 'use std::mem;'), ('b.rs', 2, 'use a::b as c;'), ('b.rs', 3, 'fn f() { c(); }')) AS v(file, line_no, text)"""


@query("SELECT * FROM (VALUES ('b.rs', 1)) AS v(file, line_no)", views=False)
def unused_imports(t: Tables) -> DataFrame:
    return edits.unused_imports(t.spark.sql(f"SELECT * FROM {_SOURCE}"))


@query("SELECT * FROM (VALUES ('a.rs', 6, 8)) AS v(file, start, \"end\")", views=False)
def symbol_span(t: Tables) -> DataFrame:
    return edits.symbol_span(t.spark.sql(f"SELECT * FROM {_SOURCE}"), "main")


@query("""SELECT * FROM (VALUES ('a.rs', 1, 'mod main_;'), ('a.rs', 2, 'pub use main_::*;'), ('a.rs', 3, 'use std::fmt;'), ('a.rs', 4, 'use std::io::{Read, Write as W};'), ('a.rs', 5, 'pub use x::Y;'), ('a.rs', 6, 'use q::*;'), ('a.rs', 7, ''),
('a/main_.rs', 1, 'use std::fmt;'), ('a/main_.rs', 2, 'use std::io::{Read, Write as W};'), ('a/main_.rs', 3, 'fn main() {'), ('a/main_.rs', 4, '    fmt::x(W);'), ('a/main_.rs', 5, '}')) AS v(file, line_no, text)""", views=False)
def split_plan(t: Tables) -> DataFrame:
    lines = t.spark.sql(f"SELECT * FROM {_SOURCE}").where("file = 'a.rs'")
    return edits.split_plan(lines, edits.symbol_span(lines, "main"), "a/main_.rs")


@query("""
WITH f AS (SELECT crate_name AS file, idx, starts_with(coalesce(signature, ''), 'pub ') AS is_pub, end_line - start_line + 1 AS n FROM chunks WHERE kind = 'function'),
     pr AS (SELECT file, idx, row_number() OVER (PARTITION BY file ORDER BY idx) AS k FROM f WHERE NOT is_pub),
     ca AS (SELECT DISTINCT b.idx, a.idx AS caller FROM edges JOIN f AS a ON a.idx = src JOIN f AS b ON b.idx = dst WHERE a.file = b.file),
     g(idx, grp, k) USING KEY (idx) AS (
        SELECT idx, idx, 0::BIGINT FROM f WHERE is_pub
        UNION SELECT pr.idx, CASE WHEN count(DISTINCT w.grp) = 1 THEN min(w.grp) END, pr.k
              FROM pr LEFT JOIN ca ON ca.idx = pr.idx LEFT JOIN recurring.g AS w ON w.idx = ca.caller
              WHERE pr.k = (SELECT max(k) + 1 FROM recurring.g) GROUP BY pr.idx, pr.k),
     big AS (SELECT grp FROM g JOIN f USING (idx) GROUP BY 1 HAVING sum(n) >= 30)
SELECT f.idx, CASE WHEN grp IN (SELECT grp FROM big) THEN grp ELSE -1 END AS grp FROM f JOIN g USING (idx)
""")
def module_partition(t: Tables) -> DataFrame:
    functions = t.chunks().where("kind = 'function'").select(F.col("crate_name").alias("file"), "idx", F.coalesce(F.col("signature").startswith("pub "), F.lit(False)).alias("is_pub"), (F.col("end_line") - F.col("start_line") + 1).alias("lines"))
    return edits.partition_module(functions, t.edges(), 30).withColumn("grp", F.coalesce("grp", F.lit(-1)))


# ---- streams ---------------------------------------------------------------


@query("""
WITH e AS (SELECT user_id::VARCHAR || '.rs' AS path, event_type AS crate_name, event_id AS seq, value, event_type = 'error' AS deleted FROM events),
     l AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS n FROM e)
SELECT path, crate_name, seq, value FROM l WHERE n = 1 AND NOT deleted
""")
def stream_change_batches(t: Tables) -> DataFrame:
    from uuid import uuid4

    from larkspur.plans.staging import shared_dir
    from larkspur.streaming import watch

    base = f"{shared_dir(t.spark)}/larkspur-stream-{uuid4().hex}"
    events = t.raw("events").select(F.concat(F.col("user_id").cast("string"), F.lit(".rs")).alias("path"), F.col("event_type").alias("crate_name"), F.col("event_id").alias("seq"), "value", (F.col("event_type") == "error").alias("deleted"))
    events.repartitionByRange(4, "seq").write.parquet(f"{base}/in")
    schema = "path string, crate_name string, seq long, value double, deleted boolean"
    changes = watch.read_changes(t.spark, f"{base}/in", schema, "parquet", files_per_batch=2).where(watch.relevant())
    watch.maintain(changes, f"{base}/table", f"{base}/checkpoint").awaitTermination()
    return watch.current(t.spark, f"{base}/table").select("path", "crate_name", "seq", "value")
