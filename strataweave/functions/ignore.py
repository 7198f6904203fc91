"""Ignore rules: globs become regular expressions, and a list of rules one column expression, the last match winning."""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

# Generated code that is always ignored.
BUILTIN = ("*.pb.go", "*_pb.go", "*_grpc.pb.go", "*.pb.ts", "*_pb.ts", "*_pb2.py", "*_pb2_grpc.py", "*.generated.ts", "*.generated.go", "*.generated.rs", "*.g.dart")

#: A piece of a glob: any depth with the slash behind it, any name, one character, or plain text.
_PIECE = re.compile(r"(\*\*/?)|(\*)|(\?)|([^*?]+)")


def glob_regex(glob: str) -> str:
    """Matches a path that ends with the glob at a folder's border; a glob with a slash at its end matches what is below."""
    folder = glob.endswith("/")
    body = glob.removeprefix("/").removesuffix("/")
    out = "".join(".*" if deep else "[^/]*" if any_ else "[^/]" if one else re.sub(r"([.(){}+|^$\[\]\\])", r"\\\1", text) for deep, any_, one, text in _PIECE.findall(body))
    return f"(?:^|/){out}" + ("(?:/|$)" if folder else "$")


@dataclass(frozen=True)
class IgnoreRules:
    """(regex, negated) in order."""

    rules: tuple[tuple[str, bool], ...] = ()
    user: int = 0

    @classmethod
    def parse(cls, text: str, builtin: bool = True) -> IgnoreRules:
        """A rule a line; blank lines and those that begin with # are none, ! negates."""
        lines = [x.strip() for x in text.splitlines()]
        own = [x for x in lines if x and not x.startswith("#")]
        return cls(tuple((glob_regex(x.removeprefix("!")), x.startswith("!")) for x in ([*BUILTIN, *own] if builtin else own)), len(own))

    @classmethod
    def load(cls, root: str | Path, name: str = ".graphignore") -> IgnoreRules:
        try:
            return cls.parse((Path(root) / name).read_text())
        except OSError:
            return cls.parse("")

    @property
    def is_empty(self) -> bool:
        return not self.rules

    @property
    def has_user_rules(self) -> bool:
        return self.user > 0

    def column(self, path: Column) -> Column:
        """Whether path is ignored.  Neighbouring rules of one kind are one expression."""
        out = F.lit(False)
        for regex, negated in self.grouped():
            out = F.when(path.rlike(regex), F.lit(not negated)).otherwise(out)
        return out

    def grouped(self) -> list[tuple[str, bool]]:
        merged: list[tuple[str, bool]] = []
        for regex, negated in self.rules:
            if merged and merged[-1][1] == negated:
                merged[-1] = (f"{merged[-1][0]}|{regex}", negated)
            else:
                merged.append((regex, negated))
        return merged

    def is_ignored(self, path: str) -> bool:
        """The same for one path on the driver."""
        return next((not negated for regex, negated in reversed(self.rules) if re.search(regex, path)), False)
