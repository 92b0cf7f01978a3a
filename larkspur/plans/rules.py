"""More queries of the catalogue: scalar rules, interchange formats, stores, incremental resolution and edits."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import names as N
from larkspur.functions import paths as P
from larkspur.operators import edits, graph, ingest, reports, resolve, similarity
from larkspur.plans.catalogue import _SIGNED, _TEST, _signatures, _traits, query, seeds
from larkspur.plans.staging import shared_dir, spread, stage
from larkspur.sources import connectors
from larkspur.sources.projections import Tables, project
from larkspur.sources.store import Store


def _folder(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/larkspur-{name}-{uuid4().hex}"


# ---- scalar rules ------------------------------------------------------------


@query("""
SELECT idx, CASE idx % 4 WHEN 1 THEN 'C:/' ELSE '' END || file AS normal, regexp_extract(file, 'crates/([^/]*)/src', 1) AS crate, contains(file, '/tests/') AS test_path,
       idx % 6 < 3 OR contains(file, '/tests/') AS test_fn, contains(file, '/tests/') OR idx % 6 < 2 OR is_test AS test_clone, regexp_replace(name, '^[^:]*::', '') AS inside,
       idx % 5 < 2 AS generated, CASE idx % 3 WHEN 0 THEN 'T' || idx || '::m' WHEN 1 THEN split_part(name, '::', 3) ELSE 'x::y' END AS shown
FROM chunks
""")
def path_and_name_rules(t: Tables) -> DataFrame:
    i, file, name = F.col("idx"), F.col("file"), F.col("name")
    path = F.when(i % 4 == 0, F.concat(F.lit(".\\"), F.replace(file, F.lit("/"), F.lit("\\")))).when(i % 4 == 1, F.concat(F.lit("//?/C:/"), file)).when(i % 4 == 2, F.concat(F.lit("./"), file)).otherwise(file)
    test = F.when(i % 6 == 0, F.concat(F.lit("test_"), "display_name")).when(i % 6 == 1, F.lit("a::test_x")).when(i % 6 == 2, F.lit("m::tests::y")).otherwise(name)
    made = F.when(i % 5 == 0, F.lit("<A as bincode::Encode>::encode")).when(i % 5 == 1, F.lit("a::_serde::b")).otherwise(name)
    signature = F.when(i % 3 == 0, F.concat(F.lit("<impl a::Tr for b::T"), i.cast("string"), F.lit(">::m()"))).otherwise(F.lit("fn m()"))
    display = F.when(i % 3 == 0, F.lit("m")).when(i % 3 == 1, F.lit("")).otherwise(F.lit("x::y"))
    full = F.when(i % 3 == 0, F.lit("m")).when(i % 3 == 1, N.last_segment(name)).otherwise(name)
    return t.chunks().select(
        "idx",
        P.normalize_path(path).alias("normal"),
        P.crate_of(path).alias("crate"),
        P.is_test_path(path).alias("test_path"),
        N.is_test_fn(file, test).alias("test_fn"),
        similarity.is_test_clone(file, test, F.col("is_test")).alias("test_clone"),
        N.strip_crate_prefix(name).alias("inside"),
        N.is_derive_generated(made).alias("generated"),
        N.disambiguate(display, full, signature).alias("shown"),
    )


_BODIES = """
SELECT idx, 'f' || CAST(idx AS VARCHAR(20)) || '@' || CAST(start_line AS VARCHAR(20)) || ', a::b@x, c' AS calls, 'Self.x' || CAST(idx AS VARCHAR(20)) || ', A.b.c, plain' AS accesses,
       'pub struct S {' || chr(10) || '    /// says' || chr(10) || '    pub a' || CAST(idx AS VARCHAR(20)) || ': Vec<u8>,' || chr(10) || '    // no: not' || chr(10) || '    pub(crate) b: Map<K, V>,' || chr(10) || '}' AS struct_body,
       'enum E {' || chr(10) || '    #[x]' || chr(10) || '    A' || CAST(idx AS VARCHAR(20)) || ',' || chr(10) || '    B(u8),' || chr(10) || '    C { d: u8 },' || chr(10) || '}' AS enum_body,
       'fn f<T: geo::Shape' || CAST(idx AS VARCHAR(20)) || ' + Send, U: Copy>(x: T) where V: Into<u8> {' AS signature
FROM chunks
"""


@query("""
SELECT idx, 'call' AS what, unnest(['f' || idx, 'a::b', 'c']) AS a, unnest([start_line::VARCHAR, '0', '0']) AS b FROM chunks
UNION ALL SELECT idx, 'access', unnest(['Self', 'A']), unnest(['x' || idx, 'b.c']) FROM chunks
UNION ALL SELECT idx, 'field', unnest(['a' || idx, 'b']), unnest(['Vec<u8>', 'Map<K, V>']) FROM chunks
UNION ALL SELECT idx, 'variant', unnest(['A' || idx, 'B', 'C']), '' FROM chunks
UNION ALL SELECT idx, 'bound', unnest(['t', 'u', 'v']), unnest(['shape' || idx, 'copy', 'into']) FROM chunks
""")
def packed_texts(t: Tables) -> DataFrame:
    pair = lambda kind, a, b: F.struct(F.lit(kind).alias("what"), a.alias("a"), b.alias("b"))
    parts = F.concat(
        F.transform(N.packed_calls(F.col("calls")), lambda c: pair("call", c["name"], c["line"].cast("string"))),
        F.transform(N.field_pairs(F.col("accesses")), lambda f: pair("access", f["receiver"], f["field"])),
        F.transform(N.struct_fields(F.col("struct_body")), lambda f: pair("field", f["name"], f["type"])),
        F.transform(N.enum_variants(F.col("enum_body")), lambda v: pair("variant", v, F.lit(""))),
        F.transform(N.generic_bounds(F.col("signature")), lambda g: pair("bound", g["param"], g["bound"])),
    )
    return project(t.spark, _BODIES, chunks=t.chunks()).select("idx", F.explode(parts).alias("p")).select("idx", "p.*")


@query("""
SELECT doc_id AS idx, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')), lambda x: x <> '' AND NOT starts_with(x, '//')), chr(10))) AS digest
FROM documents WHERE text IS NOT NULL
""")
def body_digests(t: Tables) -> DataFrame:
    return t.raw("documents").where("text is not null").select(F.col("doc_id").alias("idx"), similarity.body_digest(F.col("text")).alias("digest"))


@query(f"WITH {_SIGNED} SELECT idx, md5(array_to_string(list_transform(s, lambda x: lpad(lower(to_hex(x::BIGINT)), 16, '0')), '')) AS hex_md5, true AS back FROM sg")
def signature_texts(t: Tables) -> DataFrame:
    text = similarity.signature_hex(F.col("signature"))
    return _signatures(t).select("idx", F.md5(text).alias("hex_md5"), (similarity.signature_from_hex(text) == F.col("signature")).alias("back"))


# ---- interchange -------------------------------------------------------------

_RAW = """
SELECT name, CASE WHEN idx % 4 = 0 THEN './' || file ELSE file END AS file, CASE kind WHEN 'function' THEN 'fn' ELSE kind END AS kind, start_line, end_line, signature, '' AS visibility, is_test,
       CASE kind WHEN 'enum' THEN 'enum E {' || chr(10) || '  A,' || chr(10) || '  B,' || chr(10) || '}' ELSE '' END AS body, 'f@1, g@2' AS calls, '' AS type_refs, crate_name, 'a.b' AS field_accesses
FROM chunks
"""


@query(f"""
SELECT row_number() OVER (ORDER BY file, start_line, end_line, name) - 1 AS idx, name, split_part(name, '::', 3) AS display_name, file, kind, {_TEST} AS is_test, 2 AS n_calls,
       regexp_extract(signature, '-> (.*)$', 1) AS return_type, CASE kind WHEN 'enum' THEN 2 ELSE 0 END AS n_variants
FROM (SELECT DISTINCT ON (file, start_line, end_line, name) * FROM chunks ORDER BY file, start_line, end_line, name, idx)
""")
def symbols_from_rows(t: Tables) -> DataFrame:
    # told apart by the path as it is stored: ./a and a are one file
    raw = project(t.spark, _RAW.replace("SELECT ", "SELECT idx, ", 1), chunks=t.chunks()).withColumn("file", P.normalize_path(F.col("file")))
    made = ingest.to_chunks(ingest.first_wins(raw, ["file", "start_line", "end_line", "name"], [F.col("idx")]))
    return made.select("idx", "name", "display_name", "file", "kind", "is_test", F.size("calls").alias("n_calls"), "return_type", F.size("enum_variants").alias("n_variants"))


@query("SELECT name, regexp_replace(file, '^\\./', '') AS file, crate_name, start_line, is_test FROM chunks WHERE crate_name = 'economy'")
def sqlite_symbols(t: Tables) -> DataFrame:
    # one task writes the file, as one extractor does
    path = f"{_folder(t, 'sqlite').removeprefix('file:')}.db"
    columns = ["name", "file", "crate_name", "start_line", "is_test"]

    def write(frames):
        import sqlite3

        import pandas as pd

        n = 0
        with sqlite3.connect(path) as db:
            db.execute(f"CREATE TABLE mir_chunks ({', '.join(columns)})")
            for frame in frames:
                db.executemany(f"INSERT INTO mir_chunks VALUES ({', '.join('?' * len(columns))})", frame.astype(object).values.tolist())
                n += len(frame)
        yield pd.DataFrame({"n": [n]})

    project(t.spark, _RAW, chunks=t.chunks()).select(columns).coalesce(1).mapInPandas(write, "n long").collect()
    rows = connectors.sqlite_table(t.spark, path, "mir_chunks", "name string, file string, crate_name string, start_line int, is_test boolean, field_accesses string")
    found = rows.where((F.col("crate_name") == "economy") & (F.col("field_accesses") == ""))
    return found.select("name", P.normalize_path(F.col("file")).alias("file"), "crate_name", "start_line", "is_test")


@query("SELECT e.src, c.name AS caller, d.name AS callee, d.file AS callee_file, e.line FROM edges AS e JOIN chunks AS c ON c.idx = e.src JOIN chunks AS d ON d.idx = e.dst")
def extractor_edges(t: Tables) -> DataFrame:
    c = t.chunks()
    named = t.edges().join(c.select(F.col("idx").alias("src"), F.col("name").alias("caller"), "crate_name"), "src").join(c.select(F.col("idx").alias("dst"), F.col("name").alias("callee"), F.col("file").alias("file")), "dst")
    edge = F.struct("caller", "callee", "file", "line", F.col("src").cast("int").alias("caller_start"))
    documents = named.groupBy("crate_name", F.pmod("src", F.lit(16)).alias("part")).agg(F.to_json(F.struct(F.collect_list(edge).alias("edges"), F.array().cast("array<struct<name:string>>").alias("chunks"))).alias("value"))
    path = _folder(t, "json")
    documents.select("value").write.option("maxRecordsPerFile", 1).text(path)
    edges, _ = connectors.extractor_json(t.spark, path)
    return edges.select(F.col("caller_start").cast("long").alias("src"), "caller", "callee", F.col("file").alias("callee_file"), "line")


@query("""
WITH s AS (SELECT CASE WHEN l_suppkey % 7 = 6 THEN '(root)' ELSE 'crate' || (l_suppkey % 7) END AS crate, sum(l_linenumber)::BIGINT AS fn_count, sum(CASE WHEN l_returnflag = 'A' THEN l_linenumber ELSE 0 END)::BIGINT AS fn_covered,
                  sum(l_quantity::BIGINT)::BIGINT AS line_count, sum(CASE WHEN l_linestatus = 'F' THEN l_quantity::BIGINT ELSE 0 END)::BIGINT AS line_covered FROM lineitem GROUP BY 1)
SELECT *, round(100.0::DOUBLE * fn_covered / fn_count, 1) AS fn_pct, round(100.0::DOUBLE * line_covered / line_count, 1) AS line_pct FROM s
UNION ALL SELECT '(total)', 10, 5, 0, 0, 50.0, NULL
""")
def coverage_report(t: Tables) -> DataFrame:
    covered = lambda flag, value, n: F.sum(F.when(F.col(flag) == value, F.col(n).cast("long")).otherwise(0))
    per_file = t.raw("lineitem").groupBy("l_suppkey").agg(
        F.struct(F.sum("l_linenumber").alias("count"), covered("l_returnflag", "A", "l_linenumber").alias("covered")).alias("functions"),
        F.struct(F.sum(F.col("l_quantity").cast("long")).alias("count"), covered("l_linestatus", "F", "l_quantity").alias("covered")).alias("lines"),
    )
    crate = F.when(F.col("l_suppkey") % 7 == 6, F.lit("")).otherwise(F.concat(F.lit("crate"), (F.col("l_suppkey") % 7).cast("string"), F.lit("/")))
    file = F.struct(F.concat(crate, F.lit("src/s"), F.col("l_suppkey").cast("string"), F.lit(".rs")).alias("filename"), F.struct("functions", "lines").alias("summary"))
    # the document's own totals need not be the sums
    totals = F.struct(F.struct(F.lit(10).alias("count"), F.lit(5).alias("covered")).alias("functions"), F.struct(F.lit(0).alias("count"), F.lit(0).alias("covered")).alias("lines"))
    path = _folder(t, "coverage")
    per_file.groupBy().agg(F.to_json(F.struct(F.array(F.struct(F.collect_list(file).alias("files"), totals.alias("totals"))).alias("data"))).alias("value")).write.text(path)
    return reports.coverage_with_total(connectors.coverage_json(t.spark, path), connectors.coverage_totals(t.spark, path))


@query("""
WITH o AS (SELECT file, name, crate_name, idx, 'old' AS version FROM chunks WHERE idx % 3 <> 0), n AS (SELECT file, name, crate_name, idx, 'new' AS version FROM chunks WHERE idx % 5 = 0 AND crate_name <> 'promo')
SELECT * FROM n WHERE crate_name <> 'small' UNION ALL SELECT * FROM o WHERE crate_name <> 'small' AND NOT EXISTS (SELECT 1 FROM n WHERE n.crate_name = o.crate_name AND n.file = o.file AND n.name = o.name)
""")
def stored_symbols(t: Tables) -> DataFrame:
    rows = t.chunks().select("file", "name", "crate_name", "idx")
    store = Store(t.spark, _folder(t, "store"))
    with store.writing():
        store.save_symbols(rows.where("idx % 3 <> 0").withColumn("version", F.lit("old")))
        store.save_symbols(rows.where("idx % 5 = 0 and crate_name <> 'promo'").withColumn("version", F.lit("new")))
    return ingest.without_crates(store.get("chunks"), ["small"]).select("file", "name", "crate_name", "idx", "version")


@query("SELECT src, dst, line FROM edges")
def stored_graph(t: Tables) -> DataFrame:
    store, chunks = Store(t.spark, _folder(t, "store")), t.chunks()
    store.save_graph(t.edges(), chunks)
    if store.load_graph(chunks.where("idx > 1")) is not None:
        raise AssertionError("a graph of other symbols")
    return store.load_graph(chunks).select("src", "dst", "line")


@query("SELECT 'fn' || idx AS fn_name, file AS fn_file, 'use m' || (idx % 5) || ';' AS source, 'm' || (idx % 5) AS resolved FROM chunks WHERE kind = 'function'")
def function_uses(t: Tables) -> DataFrame:
    c = t.chunks()
    n = (F.col("idx") % 5).cast("string")
    uses = c.select("file", (F.col("idx") % 5).cast("int").alias("line"), F.concat(F.lit("use m"), n, F.lit(";")).alias("source"), F.concat(F.lit("m"), n).alias("resolved"), "crate_name").distinct()
    deps = c.where("kind = 'function'").select(F.concat(F.lit("fn"), F.col("idx").cast("string")).alias("fn_name"), F.col("file").alias("fn_file"), F.col("file").alias("use_file"), (F.col("idx") % 5).cast("int").alias("use_line"), "crate_name")
    return ingest.uses_of_functions(uses, deps)


@query("SELECT idx, file FROM chunks WHERE idx % 9 <> 2 AND idx % 9 <> 4 AND file IN (SELECT file FROM files)")
def ingest_filters(t: Tables) -> DataFrame:
    i = F.col("idx")
    raw = t.chunks().select(
        "idx",
        F.when(i % 9 == 2, F.concat(F.lit("/"), "file")).otherwise(F.col("file")).alias("file"),
        F.when(i % 9 == 4, F.lit("<A as core::clone::Clone>::clone")).otherwise(F.col("name")).alias("name"),
        "start_line",
        F.when(i % 9 == 4, F.col("start_line")).otherwise(F.col("end_line")).alias("end_line"),
    )
    return ingest.ingestible(raw, t.files()).select("idx", "file")


@query("SELECT file, idx, 'new' AS version FROM chunks WHERE idx % 50 = 0 UNION ALL SELECT file, idx, 'old' FROM chunks WHERE file NOT IN (SELECT file FROM chunks WHERE idx % 100 = 0)")
def replaced_files(t: Tables) -> DataFrame:
    rows = t.chunks().select("file", "idx")
    return ingest.replace_files(rows.withColumn("version", F.lit("old")), rows.where("idx % 50 = 0").withColumn("version", F.lit("new")), rows.where("idx % 100 = 0"))


# ---- resolution --------------------------------------------------------------

_CALLS = """
SELECT s.name AS caller, s.file AS caller_file, s.crate_name AS crate_name, CASE WHEN e.dst % 5 = 1 THEN d.name || '::{closure#0}' ELSE d.name END AS callee,
       CASE WHEN e.dst % 2 = 0 THEN d.file ELSE '' END AS callee_file, CASE WHEN e.dst % 2 = 0 THEN d.start_line ELSE 0 END AS callee_line, e.line AS line
FROM edges AS e JOIN chunks AS s ON s.idx = e.src JOIN chunks AS d ON d.idx = e.dst
"""
_GRAPH = f"""
c0 AS ({_CALLS}), nk AS (SELECT lower(name) AS key, max(idx) AS idx FROM chunks GROUP BY 1), pk AS (SELECT lower(file) AS f, start_line AS l, max(idx) AS idx FROM chunks GROUP BY 1, 2),
c1 AS (SELECT c0.*, row_number() OVER () AS r, coalesce(pk.idx, nk.idx) AS dst FROM c0 LEFT JOIN pk ON callee_line > 0 AND f = lower(callee_file) AND l = callee_line LEFT JOIN nk ON key = replace(lower(callee), '::{{closure#0}}', '')),
c2 AS (SELECT r, any_value(c1.crate_name) AS crate_name, any_value(dst) AS dst, any_value(line) AS line, arg_min(k.idx, (k.file <> caller_file, k.idx)) AS src FROM c1 JOIN chunks AS k ON lower(k.name) = lower(caller) GROUP BY r)
"""


@query(f"WITH {_GRAPH.strip()} SELECT src, dst, min(line) AS line FROM c2 WHERE src <> dst GROUP BY 1, 2")
def call_graph(t: Tables) -> DataFrame:
    chunks = t.chunks()
    return resolve.resolve_calls(project(t.spark, _CALLS, edges=t.edges(), chunks=chunks), chunks)


@query(f"WITH {_GRAPH.strip()} SELECT crate_name, src, dst, min(line) AS line FROM c2 WHERE src <> dst GROUP BY 1, 2, 3")
def call_graph_incremental(t: Tables) -> DataFrame:
    chunks = t.chunks()
    calls = project(t.spark, _CALLS, edges=t.edges(), chunks=chunks)
    full = resolve.resolve_calls(calls, chunks, ("crate_name",))
    wrong = t.spark.createDataFrame([("economy", 1, 2, 1), ("gone", 3, 4, 1)], "crate_name string, src long, dst long, line int")
    stored = stage(full.where("crate_name <> 'economy'").select("crate_name", "src", "dst", "line").unionByName(wrong), "stored")
    return resolve.resolve_incremental(stored, calls, chunks, t.spark.createDataFrame([("economy",)], "crate_name string"))


@query("SELECT s_suppkey + 1000000 AS idx, 100 + n_nationkey::BIGINT AS impl_idx FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def functions_of_impls(t: Tables) -> DataFrame:
    functions = project(t.spark, "SELECT s_suppkey + 1000000 AS idx, r_name || ' for ' || n_name || '::m' || CAST(s_suppkey AS VARCHAR(20)) AS name, 'function' AS kind FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey\n", **{n: t.raw(n) for n in ("supplier", "nation", "region")})
    return resolve.fn_trait_impl(_traits(t).select("idx", "name", "kind").unionByName(functions))


@query("""
SELECT DISTINCT * FROM (SELECT idx, unnest([lower(display_name) || '::size', lower(split_part(name, '::', 2)) || '::inner', 'inner::deep', 'what::ever']) AS key FROM chunks WHERE kind = 'function')
""")
def field_index(t: Tables) -> DataFrame:
    pairs = "array<struct<name:string,type:string>>"
    none = F.array().cast(pairs)
    c = t.chunks()
    functions = c.where("kind = 'function'").select(
        "idx", "name", "kind", none.alias("field_types"), F.array(F.struct(F.lit("Cfg").alias("name"), F.concat(F.lit("&mut "), "display_name").alias("type"))).alias("param_types"), none.alias("local_types"),
        F.array(*map(F.lit, ("cfg.Size", "self.inner", "self.a.deep", "what.ever"))).alias("field_accesses"),
    )
    brands = c.select(F.element_at(F.split("name", "::"), 2).alias("brand")).distinct()
    structs = brands.select(F.xxhash64("brand").alias("idx"), F.concat(F.lit("t::"), "brand").alias("name"), F.lit("struct").alias("kind"), F.array(F.struct(F.lit("a").alias("name"), F.lit("Vec<Inner>").alias("type"))).alias("field_types"), none.alias("param_types"), none.alias("local_types"), F.array().cast("array<string>").alias("field_accesses"))
    return resolve.field_access_index(functions.unionByName(structs)).select("idx", "key")


@query("SELECT lower(name) AS key, max(idx) AS idx FROM chunks GROUP BY 1")
def caller_keys(t: Tables) -> DataFrame:
    return resolve.name_keys(t.chunks())


@query("SELECT idx FROM chunks WHERE kind = 'function' AND lower(split_part(name, '::', 2)) = 'brand#13'")
def type_methods(t: Tables) -> DataFrame:
    return reports.methods_of(t.chunks(), "a::Brand#13<T>").select("idx")


# ---- reports -----------------------------------------------------------------


@query(f"SELECT e.dst AS idx, e.src AS caller, e.line FROM edges AS e JOIN chunks ON idx = e.src WHERE e.dst % 100 = 3 AND e.src % 100 <> 3 AND NOT is_test")
def warned_callers(t: Tables) -> DataFrame:
    c = t.chunks()
    return edits.callers_warned(t.edges(), c, c.where("idx % 100 = 3").select("idx"))


@query("""
WITH r AS (SELECT dst AS idx, display_name, row_number() OVER (ORDER BY dst) AS n, count(*) OVER () AS m FROM edges JOIN chunks ON idx = dst WHERE src = 1 AND NOT is_test),
     l AS (SELECT idx, file || ':' || start_line || '-' || end_line || '  ' || display_name AS label FROM chunks)
SELECT 0 AS pos, label || CASE WHEN (SELECT is_test FROM chunks WHERE idx = 1) THEN ' [test]' ELSE '' END AS line FROM l WHERE idx = 1
UNION ALL SELECT n::INTEGER, CASE WHEN n < m THEN '  ├─→ ' ELSE '  └─→ ' END || label || CASE WHEN r.idx = 1 THEN '  ↩' ELSE '' END FROM r JOIN l USING (idx)
""")
def rendered_tree(t: Tables) -> DataFrame:
    chunks = t.chunks()
    return graph.render_tree(graph.flow_tree(chunks, t.edges(), 1, 1), chunks)


@query("SELECT count(*)::BIGINT AS edges, count(DISTINCT src)::BIGINT AS callers, count(DISTINCT dst)::BIGINT AS callees FROM edges")
def edge_totals(t: Tables) -> DataFrame:
    return reports.edge_totals(t.edges())


@query("SELECT DISTINCT crate_name FROM chunks")
def crate_names(t: Tables) -> DataFrame:
    return connectors.crate_names(t.chunks())


@query("""
WITH p AS (SELECT a.idx, a.file, a.display_name || ' ~ ' || b.display_name AS x FROM chunks AS a JOIN chunks AS b ON b.idx = a.idx + 1)
SELECT file, count(*)::BIGINT AS pairs, md5(string_agg(x, ',' ORDER BY x)) AS names_md5 FROM p GROUP BY 1
""")
def pairs_by_file(t: Tables) -> DataFrame:
    c = t.chunks()
    pairs = c.select(F.col("idx").alias("a"), (F.col("idx") + 1).alias("b"))
    return reports.by_file(pairs, c).select("file", "pairs", F.md5(F.array_join("names", ",")).alias("names_md5"))


@query("""
WITH a AS (SELECT src, line, CASE WHEN dst % 4 = 0 THEN 'lost::thing' || dst WHEN dst % 4 = 1 THEN 'self.' || dst ELSE 'x.' || dst_name END AS call, dst FROM (SELECT e.*, d.display_name AS dst_name FROM edges AS e JOIN chunks AS d ON d.idx = e.dst))
SELECT src, call, min(line) AS line FROM a WHERE dst % 4 = 0 GROUP BY 1, 2
""")
def unresolved_calls(t: Tables) -> DataFrame:
    chunks, edges = t.chunks(), stage(t.edges(), "edges")
    d, to = F.col("dst"), F.col("dst").cast("string")
    call = F.when(d % 4 == 0, F.concat(F.lit("lost::thing"), to)).when(d % 4 == 1, F.concat(F.lit("self."), to)).otherwise(F.concat(F.lit("x."), "display_name"))
    calls = edges.join(chunks.select(F.col("idx").alias("dst"), "display_name"), "dst").select("src", call.alias("call"), "line")
    return reports.unresolved_calls(chunks, calls, edges)


@query("""
WITH p AS (SELECT idx % 20 AS trait_idx, idx AS impl_idx, display_name AS method FROM chunks WHERE kind = 'impl')
SELECT trait_idx, method, count(DISTINCT impl_idx)::BIGINT AS impls, count(DISTINCT dst)::BIGINT AS callees FROM p LEFT JOIN edges ON src = impl_idx GROUP BY 1, 2
""")
def impl_callees(t: Tables) -> DataFrame:
    c = t.chunks()
    return reports.impl_callees(c.where("kind = 'impl'").select((F.col("idx") % 20).alias("trait_idx"), F.col("idx").alias("impl_idx")), t.edges(), c)


@query(f"""
WITH up AS (SELECT DISTINCT src AS idx FROM edges WHERE dst = 1), dn AS (SELECT DISTINCT dst AS idx FROM edges WHERE src = 1),
     r AS (SELECT 1::BIGINT AS idx, 1 AS p, 'def' AS role, 0 AS d UNION ALL SELECT idx, CASE WHEN {_TEST} THEN 6 ELSE 4 END, CASE WHEN {_TEST} THEN 'test' ELSE 'caller' END, 1 FROM up JOIN chunks USING (idx)
           UNION ALL SELECT idx, 5, 'callee', 1 FROM dn JOIN chunks USING (idx) WHERE NOT {_TEST}),
     b AS (SELECT idx, min((p, d, role)) AS x FROM r GROUP BY 1)
SELECT x[3] AS role, array_to_string(list(display_name ORDER BY x[2], idx)[1:5], ',') AS names, greatest(count(*) - 5, 0)::BIGINT AS more FROM b JOIN chunks USING (idx) GROUP BY 1
""")
def context_summary(t: Tables) -> DataFrame:
    chunks = t.chunks()
    none, refs = t.spark.createDataFrame([], "trait_idx long, impl_idx long"), t.spark.createDataFrame([], "src long, dst long")
    found = reports.summary(reports.context(chunks, t.edges(), refs, seeds(t, 1), none), chunks)
    return found.select("role", F.array_join("names", ",").alias("names"), F.col("more").cast("long").alias("more"))


# ---- edits -------------------------------------------------------------------


@query("""
WITH ln AS (SELECT doc_id::VARCHAR AS file, doc_id % 7 AS op, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL),
     f AS (SELECT file, any_value(op) AS op, max(n) AS m FROM ln GROUP BY 1),
     o AS (SELECT file, n::DOUBLE AS p, text FROM ln WHERE NOT (op IN (0, 3, 5, 6) AND n BETWEEN 2 AND 4)
           UNION ALL SELECT file, 1.5 + x, t FROM f, (VALUES (0.0, 'new'), (0.1, 'two')) AS v(x, t) WHERE (op IN (0, 6) AND m >= 2) OR op IN (1, 4)
           UNION ALL SELECT file, 1.7, '' FROM f WHERE op = 1
           UNION ALL SELECT file, least(4, m) + 0.5 + x, t FROM f, (VALUES (0.0, ''), (0.1, 'new'), (0.2, 'two')) AS v(x, t) WHERE op = 2)
SELECT file, count(*)::BIGINT AS n, md5(string_agg(text, chr(10) ORDER BY p)) AS text_md5 FROM o GROUP BY 1
""")
def batch_edits(t: Tables) -> DataFrame:
    docs = t.raw("documents").where("text is not null").select(F.col("doc_id").cast("string").alias("file"), "text", (F.col("doc_id") % 7).alias("k"))
    lines = stage(edits.to_lines(docs), "lines")
    op = F.element_at(F.array(*map(F.lit, edits.OPERATIONS)), (F.col("k") + 1).cast("int"))
    plan = edits.named_operations(docs.select("file", op.alias("op"), F.lit(2).alias("start"), F.lit(4).alias("end"), F.lit("new\ntwo\n\n").alias("body"), F.lit(0).alias("seq")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n")
    return edits.apply_edits(lines, plan).groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.md5(text).alias("text_md5"))


@query("""
WITH f AS (SELECT doc_id::VARCHAR AS file, len(string_split(text, chr(10))) AS m, doc_id % 4 AS k FROM documents WHERE text IS NOT NULL)
SELECT file, CASE k WHEN 0 THEN 'the range starts past the end' WHEN 1 THEN 'lines count from 1' WHEN 2 THEN 'the range ends before it starts' END AS reason FROM f WHERE (k = 0 AND m < 3) OR k IN (1, 2)
UNION ALL SELECT 'nowhere', 'no such file'
""")
def refused_edits(t: Tables) -> DataFrame:
    docs = t.raw("documents").where("text is not null").select(F.col("doc_id").cast("string").alias("file"), "text", (F.col("doc_id") % 4).alias("k"))
    k = F.col("k")
    plan = docs.select("file", F.lit("delete").alias("op"), F.when(k == 1, 0).when(k == 3, 1).otherwise(3).alias("start"), F.when(k == 2, 2).when(k == 3, 1).otherwise(9).alias("end"))
    plan = plan.unionByName(t.spark.createDataFrame([("nowhere", "delete", 1, 1)], "file string, op string, start int, end int"))
    return edits.refused(edits.to_lines(docs), plan).select("file", "reason")


_FILES = """
SELECT 'p' || CAST(idx AS VARCHAR(20)) || '.rs' AS file, 'use a::b;' || chr(10) || CASE idx % 3 WHEN 0 THEN '' WHEN 1 THEN chr(10) ELSE chr(10) || chr(10) END || '/// says' || chr(10) || '#[inline]' || chr(10) || 'pub fn other(x: u8) {' || chr(10) || '    b(x);' || chr(10) || '}' || chr(10) || 'fn more() {}' AS text, idx
FROM chunks
"""


@query("SELECT 'p' || idx || '.rs' AS file, (2 + idx % 3)::INTEGER AS start, (6 + idx % 3)::INTEGER AS \"end\", 'pub' AS visibility FROM chunks")
def located_symbols(t: Tables) -> DataFrame:
    lines = edits.to_lines(spread(project(t.spark, _FILES, chunks=t.chunks())))
    bare = stage(edits.symbol_span(lines, "other"), "spans")
    first = edits.met(lines, bare).where("line_no = start").select("file", edits.original_visibility(F.col("text")).alias("visibility"))
    return edits.with_attributes(lines, bare).hint("merge").join(first, "file").select("file", "start", "end", "visibility")


@query("""
WITH l AS (SELECT 'p' || idx || '.rs' AS file, idx, unnest(CASE WHEN idx % 3 = 0 THEN ['use a::b;'] ELSE ['use a::b;', ''] END || ['/// says', '#[inline]', 'pub fn other(x: u8) {', '    b(x);', '}', 'fn more() {}']) AS text FROM chunks)
SELECT file, count(*)::BIGINT AS lines FROM l GROUP BY 1
""")
def cleaned_imports(t: Tables) -> DataFrame:
    return edits.clean_imports(edits.to_lines(spread(project(t.spark, _FILES, chunks=t.chunks())))).groupBy("file").agg(F.count(F.lit(1)).alias("lines"))


@query("""
SELECT 'n' || idx || '.rs' AS file, unnest([1, 2])::INTEGER AS line_no, unnest(['mod x;', 'crate::' || lower(split_part(name, '::', 1)) || '::' || split_part(name, '::', 2)]) AS text FROM chunks WHERE idx % 2 = 1
""")
def created_files(t: Tables) -> DataFrame:
    c = t.chunks()
    file = F.concat(F.lit("n"), F.col("idx").cast("string"), F.lit(".rs"))
    path = F.concat(F.lit("k/src/"), F.lower(F.element_at(F.split("name", "::"), 1)), F.lit("/"), F.element_at(F.split("name", "::"), 2), F.lit("/mod.rs"))
    new = c.select(file.alias("file"), F.concat(F.lit("mod x;\n"), edits.crate_prefix(path)).alias("text"))
    return edits.create_files(c.where("idx % 2 = 0").select(file.alias("file")), new)
