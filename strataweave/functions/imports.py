"""Import statements to paths, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def folder(path: Column) -> Column:
    """The path without its last part; empty for a bare name."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def python_import(module: Column, file: Column) -> Column:
    """a.b to a/b.py; each dot in front beyond the first is a folder up; dots alone are a package; null if there is no such folder."""
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    rest = F.translate(F.regexp_extract(module, r"^\.*(.*)$", 1), ".", "/")
    parts = F.filter(F.split(folder(file), "/"), lambda p: p != "")
    kept = F.size(parts) - (dots - 1)
    base = F.concat_ws("/", F.slice(parts, F.lit(1), F.greatest(kept, F.lit(0))))
    inside = F.concat(base, F.when(base == "", "").otherwise("/"))
    relative = F.when(rest == "", F.concat(inside, F.lit("__init__.py"))).otherwise(F.concat(inside, rest, F.lit(".py")))
    return F.when(module == "", None).when(dots == 0, F.concat(rest, F.lit(".py"))).when(kept >= 0, relative)


def rust_use(statement: Column) -> Column:
    """use crate::a::b; to src/a/b.rs, without a brace's list; null for other crates."""
    path = F.regexp_extract(F.trim(statement), r"^use\s+crate::([^{;]*)", 1)
    path = F.regexp_replace(F.trim(path), ":+$", "")
    return F.when(path != "", F.concat(F.lit("src/"), F.replace(path, F.lit("::"), F.lit("/")), F.lit(".rs")))


def rust_mod(name: Column, file: Column) -> Column:
    """The two places of mod name; as an array."""
    up = F.when(folder(file) == "", "").otherwise(F.concat(folder(file), F.lit("/")))
    return F.array(F.concat(up, name, F.lit(".rs")), F.concat(up, name, F.lit("/mod.rs")))


def go_import(path: Column, module: str | None) -> Column:
    """The folder inside the module; null for other modules."""
    if not module:
        return F.lit(None).cast("string")
    prefix = F.lit(module + "/")
    return F.when(path.startswith(prefix) & (F.length(path) > len(module) + 1), F.substr(path, F.lit(len(module) + 2)))


def ts_import(path: Column) -> Column:
    """A relative import without the dots and slashes in front; null for packages."""
    return F.when(path.startswith("."), F.regexp_replace(path, r"^(?:\./)+", ""))


def vue_import(path: Column, alias: bool = True) -> Column:
    """As ts_import, and @/ is src/ where the tree has the alias; what isn't resolved stays as it is."""
    inside = F.coalesce(ts_import(path), path)
    return F.when(path.startswith("@/"), F.concat(F.lit("src/"), F.substr(path, F.lit(3)))).otherwise(inside) if alias else inside
