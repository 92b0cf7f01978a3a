"""Column functions over file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions by language, and folders that a scan never enters.
LANGUAGE_OF_EXTENSION = {
    "rs": "rust",
    "ts": "typescript",
    "tsx": "typescript",
    "js": "javascript",
    "jsx": "javascript",
    "mjs": "javascript",
    "cjs": "javascript",
    "py": "python",
    "pyi": "python",
    "go": "go",
    "java": "java",
    "c": "c",
    "h": "c",
    "cpp": "cpp",
    "hpp": "cpp",
    "cc": "cpp",
    "cxx": "cpp",
    "hxx": "cpp",
    "hh": "cpp",
}
SKIPPED_FOLDERS = ("target", "node_modules", ".git", ".swarm", "__pycache__", ".venv", "dist", "vendor", ".tox", ".mypy_cache", ".pytest_cache", ".claude", "build", "mutants.out")
TEST_PATH_PARTS = ("/tests/", "\\tests\\", "/test/", "\\test\\")
TEST_PATH_ENDS = ("_test.rs", "_test.go")
#: Folders of this tool's own stores start so.
OWN_PREFIX = ".larkspur"


def extension(path: Column) -> Column:
    return F.substring_index(F.regexp_replace(path, r"\\", "/"), ".", -1)


def language(path: Column) -> Column:
    """Language of a file's extension, other if unknown."""
    pairs = F.create_map(*[F.lit(x) for pair in LANGUAGE_OF_EXTENSION.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, extension(path)), F.lit("other"))


def is_code_file(path: Column) -> Column:
    return language(path) != "other"


def is_skipped(path: Column, exclude: tuple[str, ...] = ()) -> Column:
    """A folder on the way to the file is one that scans don't enter."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.exists(folders, lambda d: d.isin(*SKIPPED_FOLDERS, *exclude) | d.startswith(OWN_PREFIX))


def normalize_path(path: Column, root: str | None = None) -> Column:
    """Forward slashes, without verbatim prefix, ./ or the project root (tried as
    written, then in any case)."""
    out = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^//\?/", "")
    if root:
        base = root.replace("\\", "/").rstrip("/") + "/"
        out = F.when(out.startswith(base), F.substring(out, len(base) + 1, 1 << 30)).when(F.lower(out).startswith(base.lower()), F.substring(out, len(base) + 1, 1 << 30)).otherwise(out)
    return F.regexp_replace(out, r"^(\./)+", "")


def crate_of(path: Column, manifest_name: str | None = None) -> Column:
    """The folder before the first /src/; src/... belongs to the manifest's package, else (root)."""
    path = F.regexp_replace(path, r"\\", "/")
    before = F.regexp_extract(path, r"^(.*?)/src/", 1)
    own = F.lit(manifest_name or "(root)")
    return F.when(before != "", F.substring_index(before, "/", -1)).when(path.startswith("src/"), own).otherwise("(root)")


def is_test_path(path: Column) -> Column:
    out = F.lit(False)
    for part in TEST_PATH_PARTS:
        out = out | path.contains(part)
    for end in TEST_PATH_ENDS:
        out = out | path.endswith(end)
    return out


def looks_like_path(pattern: str) -> bool:
    """A search pattern that names a file: a slash in it, or a known extension."""
    return "/" in pattern or pattern.rpartition(".")[2] in LANGUAGE_OF_EXTENSION and "." in pattern


def folder_of(path: Column) -> Column:
    """Up to and with the last slash; null without one."""
    return F.when(path.contains("/"), F.regexp_extract(path, r"^(.*/)", 1))


def first_folder(path: Column) -> Column:
    """Up to and with the first slash, else the path: files of one workspace root share it."""
    return F.when(path.contains("/"), F.concat(F.substring_index(path, "/", 1), F.lit("/"))).otherwise(path)
