"""The commands as functions: a project's tables in, a DataFrame out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators import edits, graph, ingest, reports, resolve, similarity
from larkspur.plans.staging import stage
from larkspur.sources import connectors


@dataclass
class Project:
    """Symbols (see ``ingest.to_chunks``), calls (src, dst, line), and what else commands read."""

    chunks: DataFrame
    edges: DataFrame
    lines: DataFrame | None = None
    type_refs: DataFrame | None = None
    recents: list[str] = field(default_factory=list)

    def _spark(self):
        return self.chunks.sparkSession

    def _impls(self) -> DataFrame:
        return resolve.trait_impls(self.chunks)

    def _types(self) -> DataFrame:
        return self.type_refs if self.type_refs is not None else self._spark().createDataFrame([], "src long, dst long")

    def aliases(self) -> DataFrame:
        return reports.path_aliases(self.chunks)

    def symbols(self, pattern: str, **how) -> DataFrame:
        return reports.search(self.chunks, pattern, **how)

    def context(self, name: str, depth: int = 1, include_tests: bool = False, scope: str | None = None) -> DataFrame:
        self.recents = [name, *[r for r in self.recents if r != name]][:30]
        found = reports.context(self.chunks, self.edges, self._types(), resolve.resolve_symbol(self.chunks, name), self._impls(), depth)
        if not include_tests:
            found = found.where("role <> 'test'")
        if scope:
            found = found.join(self.chunks.select("idx", "file"), "idx").where((F.col("role") == "def") | F.col("file").contains(scope)).drop("file")
        return found

    def summary(self, name: str, depth: int = 1) -> DataFrame:
        return reports.summary(self.context(name, depth, include_tests=True), self.chunks)

    def tree(self, name: str, depth: int = 3) -> DataFrame:
        """From every symbol of the name: a report for a reader, who names few."""
        roots = [r.idx for r in resolve.resolve_symbol(self.chunks, name).orderBy("idx").toLocalIterator()]
        return graph.flow_tree(self.chunks, self.edges, roots, depth)

    def rendered_tree(self, name: str, depth: int = 3) -> DataFrame:
        return graph.render_tree(self.tree(name, depth), self.chunks)

    def blast(self, name: str, depth: int = 2, scope: str | None = None) -> DataFrame:
        """Of a symbol, or of ``Type.field``."""
        owner, dot, attribute = name.partition(".")
        if dot:
            index = resolve.field_access_index(self.chunks)
            users = index.where(F.col("key") == f"{owner}::{attribute}".lower()).select("idx")
            return reports.blast(self.chunks, self.edges, users, None, depth, scope)
        return reports.blast(self.chunks, self.edges, resolve.resolve_symbol(self.chunks, name), self._impls(), depth, scope)

    def blast_type(self, name: str, depth: int = 2) -> DataFrame:
        leaf = name.lower().rpartition("::")[2]
        users = resolve.field_access_index(self.chunks).where(F.col("key").startswith(f"{leaf}::")).select("idx").distinct()
        return reports.blast(self.chunks, self.edges, users, None, depth)

    def trace(self, source: str, target: str) -> DataFrame:
        return graph.shortest_path(self.edges, resolve.resolve_symbol(self.chunks, source), resolve.resolve_symbol(self.chunks, target))

    def ranked(self) -> DataFrame:
        recents = self._spark().createDataFrame([(n, i) for i, n in enumerate(self.recents)], "name string, ord int")
        return reports.ranked_by_recent(self.chunks, recents).orderBy(F.desc("score"), "idx")

    def dupes(self, threshold: float = 0.5, exclude_tests: bool = False, k: int | None = 50, min_lines: int = 5, mode: str = "tokens") -> DataFrame:
        """``mode``: tokens (MinHash), ast (hash groups) or all (both, verified); copies are pairs of
        full score.  The ``k`` best; all for None.  Needs ``text`` and ``calls`` in the symbols."""
        rows = similarity.candidates(self.chunks, min_lines, exclude_tests)
        lines = similarity.line_count(F.col("start_line"), F.col("end_line"))
        calls = F.transform("calls", lambda c: c["name"])
        hashed = rows.select("idx", "file", "start_line", "end_line", similarity.structure_hash(F.col("signature"), calls, F.col("name"), lines, F.col("text")).alias("hash"))
        if mode == "ast":
            return similarity.hash_groups(hashed, k)
        signed = stage(similarity.minhash(rows.select("idx", "text")), "signed")
        if mode == "all":
            return similarity.unified_classes(rows, signed, hashed, threshold, k)
        found = similarity.token_pairs(rows, signed, threshold).orderBy(F.desc("matches"), "a", "b")
        return found.limit(k) if k else found

    def dupes_by_file(self, **how) -> DataFrame:
        return reports.by_file(self.dupes(mode="all", **how), self.chunks)

    def analyze(self, pairs: DataFrame) -> DataFrame:
        return similarity.analyze_pairs(pairs, self.edges, self.chunks)

    def stats(self) -> DataFrame:
        return reports.stats(self.chunks, totals=True)

    def coverage(self, path: str, file: str | None = None) -> DataFrame:
        files = connectors.coverage_json(self._spark(), path)
        return reports.coverage(files.where(F.col("filename").contains(file)) if file else files)

    def dead(self, include_pub: bool = False, file: str | None = None, files: DataFrame | None = None) -> DataFrame:
        found = reports.dead_candidates(self.chunks, self.edges, include_pub, file)
        return reports.with_staleness(found, files).where(~F.col("stale")) if files is not None else found

    def cluster(self, file: str | None = None, min_lines: int = 50) -> DataFrame:
        rows = self.chunks.where(F.col("file").contains(file)) if file else self.chunks
        return graph.clusters(rows, self.edges, min_lines).orderBy(F.desc("lines"), "file", "component")

    def batch(self, plan: DataFrame, dry_run: bool = False) -> DataFrame:
        """Edits (file, op, start, end, body, seq) of :data:`edits.OPERATIONS` as one plan; what can't
        be made is refused before anything is changed.  ``dry_run``: what they would do."""
        plan = edits.named_operations(plan)
        wrong = edits.refused(self.lines, plan).limit(3).collect()
        if wrong:
            raise ValueError("; ".join(f"{r.file}:{r.start}-{r.end}: {r.reason}" for r in wrong))
        if not edits.crossing(plan.where(F.col("op").isin("replace", "delete"))).isEmpty():
            raise ValueError("edits of one file cross")
        return edits.preview(self.lines, plan) if dry_run else edits.apply_edits(self.lines, plan)

    def insert_at(self, file: str, line: int, body: str) -> DataFrame:
        return self.batch(self._edit(file, "insert-at", line, line, body))

    def delete_lines(self, file: str, start: int, end: int) -> DataFrame:
        return self.batch(self._edit(file, "delete-lines", start, end, None))

    def replace_lines(self, file: str, start: int, end: int, body: str) -> DataFrame:
        return self.batch(self._edit(file, "replace-lines", start, end, body))

    def _edit(self, *edit) -> DataFrame:
        return self._spark().createDataFrame([(*edit, 0)], "file string, op string, start int, end int, body string, seq int")

    def locate(self, name: str, file: str | None = None) -> DataFrame:
        """(file, start, end) of the one symbol of that name, attributes and doc lines included, by the
        text of its file; ``file``: the end of its path."""
        spans = edits.symbol_span(self.lines, name.rpartition("::")[2])
        if file:
            hint = file.replace("\\", "/")
            spans = spans.where(F.col("file").endswith(hint) | F.lit(hint).endswith(F.col("file")))
        found = spans.limit(3).count()
        if found != 1:
            raise ValueError(f"{name} is {'more than one symbol' if found else 'no symbol'}")
        return edits.with_attributes(self.lines, spans)

    def edit_symbol(self, op: str, name: str, body: str | None = None, file: str | None = None) -> DataFrame:
        span = self.locate(name, file)
        return self.batch(span.select("file", F.lit(op).alias("op"), "start", "end", F.lit(body).cast("string").alias("body"), F.lit(0).alias("seq")))

    def run_manifest(self, path: str, dry_run: bool = False) -> DataFrame:
        """A JSON manifest of edits (op, symbol, file, body or body_file) as one plan over all files."""
        import json
        from pathlib import Path

        entries = json.loads(Path(path).read_text(encoding="utf-8"))
        plan = None
        for k, e in enumerate(entries):
            if e["op"] not in ("replace", "insert-before", "insert-after", "delete"):
                raise ValueError(f"unknown operation {e['op']!r} for {e['symbol']}")
            body = e.get("body")
            if body is None and e.get("body_file"):
                body = Path(e["body_file"]).read_text(encoding="utf-8")
            if body is None and e["op"] != "delete":
                raise ValueError(f"no body for {e['symbol']}")
            one = self.locate(e["symbol"], e.get("file")).select("file", F.lit(e["op"]).alias("op"), "start", "end", F.lit(body).cast("string").alias("body"), F.lit(k).alias("seq"))
            plan = one if plan is None else plan.unionByName(one)
        return self.lines if plan is None else self.batch(plan, dry_run)

    def create_file(self, file: str, text: str) -> DataFrame:
        if not self.lines.where(F.col("file") == file).isEmpty():
            raise ValueError(f"{file} exists")
        return edits.create_files(self.lines, self._spark().createDataFrame([(file, text)], "file string, text string"))

    def split(self, name: str, target: str) -> DataFrame:
        return edits.split_plan(self.lines, edits.symbol_span(self.lines, name), target)

    def split_module(self, file: str, min_lines: int = 300) -> DataFrame:
        rows = self.chunks.where((F.col("file") == file) & F.col("kind").isin("function", "struct", "enum", "trait"))
        symbols = rows.select("file", "idx", "kind", "name", "text", F.coalesce(F.col("signature").startswith("pub "), F.lit(False)).alias("is_pub"), similarity.line_count(F.col("start_line"), F.col("end_line")).alias("lines"))
        return edits.module_plan(edits.partition_module(symbols, self.edges, min_lines), rows, file.removesuffix(".rs"))

    def clean_imports(self) -> DataFrame:
        return edits.clean_imports(self.lines)

    def ensure_import(self, file: str, path: str, name: str) -> DataFrame:
        return edits.ensure_import(self.lines, file, path, name)


def add(raw_chunks: DataFrame, raw_edges: DataFrame) -> Project:
    """A project from extractor tables: symbols normalised, calls resolved by place and name."""
    chunks = resolve.dedup_types(ingest.to_chunks(raw_chunks))
    calls = raw_edges.select("caller", F.col("caller_file").alias("caller_file"), "callee", F.coalesce("callee_file", F.lit("")).alias("callee_file"), F.coalesce("callee_start_line", F.lit(0)).alias("callee_line"), "line")
    return Project(chunks, resolve.resolve_calls(calls, chunks))
