"""Predicates on paths, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by extension.
LANGUAGE_OF = {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "rs": "rust", "go": "go", "vue": "vue"}
# What counts as source.
SOURCE_EXTENSIONS = ("py", "ts", "tsx", "js", "jsx", "rs", "go", "java", "rb", "cpp", "c", "h", "cs", "swift", "kt", "scala")
# How test files are told.
TEST_NAME_PREFIXES = ("test_", "tests_")
TEST_NAME_SUFFIXES = ("_test.py", ".test.ts", ".test.js", ".spec.ts", ".spec.js")
TEST_FOLDERS = ("tests", "test")
# Endings of generated files.
GENERATED_SUFFIXES = (".pb.go", "_pb.go", ".pb.ts", "_pb.ts", "_pb2.py", "_pb2_grpc.py", "_grpc.pb.go", ".generated.ts", ".generated.go", ".generated.rs", ".g.dart")
# Modules that pass imports on.
REEXPORTS = ("__init__.py", "index.ts", "index.js", "mod.rs")


def _pattern(*alternatives: str) -> str:
    return "|".join(f"(?:{a})" for a in alternatives)


def _quoted(text: str) -> str:
    return "".join(f"\\{c}" if c in ".+*?()[]{}|^$\\" else c for c in text)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """What follows the last dot of the name; empty without one or if the name begins with it."""
    return F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)


def language(path: Column) -> Column:
    """Null for files that aren't supported."""
    return F.create_map(*[F.lit(x) for kv in LANGUAGE_OF.items() for x in kv])[extension(path)]


def is_test_file(path: Column) -> Column:
    folder = "|".join(TEST_FOLDERS)
    name = _pattern("(?:^|/)(?:" + "|".join(TEST_NAME_PREFIXES) + ")[^/]*$", "(?:" + "|".join(map(_quoted, TEST_NAME_SUFFIXES)) + ")$", f"(?:^|/)(?:{folder})/")
    return path.rlike(name)


def is_test_source_pair(a: Column, b: Column) -> Column:
    return is_test_file(a) != is_test_file(b)


def is_source_file(path: Column) -> Column:
    return path.rlike(r"\.(?:" + "|".join(SOURCE_EXTENSIONS) + ")$")


def is_docs_example(path: Column) -> Column:
    return path.rlike("^(?:docs_src|docs|examples|example)/|/(?:docs_src|examples)/")


def crate_prefix(path: Column) -> Column:
    """The folder above a top-level src folder, else null."""
    return F.when(path.rlike("^[^/]*/src(?:/|$)"), F.substring_index(path, "/", 1))


def is_cross_crate_pair(a: Column, b: Column) -> Column:
    return F.coalesce(crate_prefix(a) != crate_prefix(b), F.lit(False))


def is_generated_code(path: Column) -> Column:
    return path.rlike(_pattern("(?:" + "|".join(map(_quoted, GENERATED_SUFFIXES)) + ")$", "/generated/", r"/gen/(?:.*)\.(?:go|ts|py)$"))


def is_reexport_module(path: Column) -> Column:
    return file_name(path).isin(*REEXPORTS)
