"""Hunks of real patches, their attribution line by line, and the three signals inside files."""

import random
import subprocess
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strataweave.operators import intrafile
from strataweave.sources import hunks


def git(repo, *args):
    subprocess.run(["git", "-C", repo, "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True)


def test_hunks_of_a_repository(spark, tmp_path):
    repo = tmp_path / "repo"
    repo.mkdir()
    git(repo, "init", "-q")
    file, odd = repo / "a.py", repo / 'd "q" é.py'
    steps = [
        lambda: (file.write_text("1\n2\n3\n4\n"), odd.write_text("x\n")),
        lambda: file.write_text("1\n2b\n3\n4\n5\n6\n@@ -1 +1 @@\n"),
        lambda: (file.write_text("1\n4\n5\n6\n@@ -1 +1 @@\n"), (repo / "bin").write_bytes(b"\0\1")),
        lambda: odd.unlink(),
    ]
    for i, step in enumerate(steps):
        step()
        git(repo, "add", "-A")
        git(repo, "commit", "-qm", f"step {i}\ttab @@ -9 +9 @@")
    hunks.write_patches(str(repo), str(tmp_path / "log"))
    got = hunks.read_hunks(spark, str(tmp_path / "log"))
    rows = {(r["file"], r["old_start"], r["old_lines"], r["new_start"], r["new_lines"]) for r in got.collect()}
    assert rows == {("a.py", 0, 0, 1, 4), ('d "q" é.py', 0, 0, 1, 1), ("a.py", 2, 1, 2, 1), ("a.py", 4, 0, 5, 3), ("a.py", 2, 2, 1, 0), ('d "q" é.py', 1, 1, 0, 0)}
    assert got.select("commit_id").distinct().count() == 4 and got.where("ts is null").isEmpty()


SYMBOLS = "file string, symbol string, line_start int, line_end int"
HUNKS = "commit_id string, file string, old_start int, old_lines int, new_start int, new_lines int"


@pytest.mark.parametrize("bucket", [64, 5])
def test_every_line_goes_to_its_innermost_symbol(spark, bucket):
    r = random.Random(bucket)
    symbols, changes = [], []
    for f in ("f", "g", "empty"):
        at = 1
        for i in range(0 if f == "empty" else 12):
            n = r.randrange(4, 60)
            symbols.append((f, f"{f}::C{i}", at, at + n))
            symbols += [(f, f"{f}::C{i}::m{j}", at + 1 + j * 2, at + 2 + j * 2) for j in range(r.randrange(0, n // 2))]
            at += n + r.randrange(1, 9)
    for i in range(150):
        changes.append((f"c{i % 40}", r.choice(["f", "g", "empty", "unknown"]), 0, r.randrange(0, 9), r.randrange(0, 300), r.choice([0, 1, 2, 40, 200])))
    want = Counter()
    for c, f, _, old, start, new in changes:
        start, n = max(start, 1), max(new, 1)
        for line in range(start, start + n) if old + new else ():
            around = [(b - a, a, s) for x, s, a, b in symbols if x == f and a <= line <= b]
            want[c, f, min(around)[2] if around else f] += (old + new) / n
    got = {tuple(x)[:3]: x["lines"] for x in intrafile.attributed(spark.createDataFrame(changes, HUNKS), spark.createDataFrame(symbols, SYMBOLS), bucket).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def changes_of(spark, commits):
    """commits: the symbols of file f that each one changes."""
    return spark.createDataFrame([(f"c{i}", "f", f"f::{s}", 1.0) for i, c in enumerate(commits) for s in c], "commit_id string, file string, node string, lines double")


def test_hotspot_inside_a_file(spark):
    changes = changes_of(spark, ["a"] * 20 + ["b"])
    symbols = spark.createDataFrame([("f", f"f::{s}", 1, 1) for s in "abcde"], SYMBOLS)
    (row,) = intrafile.hotspots(changes, symbols).collect()
    assert row["node_a"] == "f::a" and abs(row["severity"] - 20 / (21 / 5)) < 1e-9
    assert intrafile.hotspots(changes_of(spark, ["a"] * 4), symbols).isEmpty(), "too few changes"
    assert intrafile.hotspots(changes_of(spark, ["a"] * 9 + ["b"] * 9 + ["c"] * 9), symbols).isEmpty(), "all alike"


def test_hidden_coupling_inside_a_file(spark):
    coupled = intrafile.symbol_couplings(changes_of(spark, ["ab"] * 6 + ["cd"] * 6 + ["a", "x"]))
    edges = spark.createDataFrame([("f::d", "f::c", "calls"), ("f::a", "f::b", "imports")], "source string, target string, edge_type string")
    got = [tuple(r) for r in intrafile.hidden_couplings(coupled, edges).collect()]
    assert got == [("f::a", "f::b", 1.0)]
    assert intrafile.hidden_couplings(intrafile.symbol_couplings(changes_of(spark, ["ab"] * 4)), edges).isEmpty(), "too few together"
    marked = intrafile.co_change_edges(coupled).collect()
    assert len(marked) == 2 and {m["metadata"] for m in marked} == {'{"scope": "intra_file"}'}


def test_file_to_be_split(spark):
    apart = ["ab"] * 10 + ["cd"] * 10 + ["bc"] * 5 + ["b"] * 12 + ["c"] * 12
    coupled = intrafile.symbol_couplings(changes_of(spark, apart))
    w = {(r["a"][-1] + r["b"][-1]): r["w"] for r in coupled.collect()}
    assert w == {"ab": 1.0, "cd": 1.0, "bc": 5 / 27}
    (row,) = intrafile.split_candidates(coupled).collect()
    m = sum(w.values())
    q = 2 * (1 / m - ((2 + w["bc"]) / (2 * m)) ** 2)
    assert (row["node_a"], row["groups"]) == ("f", 2) and abs(row["severity"] - (1 - q)) < 1e-9
    assert intrafile.split_candidates(intrafile.symbol_couplings(changes_of(spark, ["abcd"] * 9))).isEmpty(), "one group"


def test_no_hunks_and_no_symbols(spark):
    none = intrafile.attributed(spark.createDataFrame([], HUNKS), spark.createDataFrame([], SYMBOLS))
    assert none.isEmpty()
    only = intrafile.attributed(spark.createDataFrame([("c", "f", 1, 1, 1, 1)], HUNKS), spark.createDataFrame([], SYMBOLS)).collect()
    assert [tuple(r) for r in only] == [("c", "f", "f", 2.0)]
    assert intrafile.symbol_couplings(none).select(F.col("a")).isEmpty()


def test_a_long_chain_of_symbols_is_one_group_in_few_rounds(spark, monkeypatch):
    """Two rings of 60 symbols: searches from a pivot would take a round for each step."""
    from strataweave.operators import components

    rows = [("f", f"{g}{i:02}", f"{g}{i + 1:02}", 9, 0.9) for g in "xy" for i in range(59)]
    rows += [("f", f"{g}00", f"{g}59", 9, 0.9) for g in "xy"] + [("f", f"{g}{i:02}", f"{g}{i + 2:02}", 9, 0.9) for g in "xy" for i in range(0, 58)]
    rounds, cut = [], components.cut
    monkeypatch.setattr(components, "cut", lambda df: rounds.append(1) or cut(df))
    coupled = spark.createDataFrame(rows, "file string, a string, b string, cnt long, w double")
    groups = intrafile.clusters(coupled)
    assert {(r["id"], r["component"]) for r in groups.collect()} == {(f"{g}{i:02}", f"{g}00") for g in "xy" for i in range(60)}
    assert len(rounds) <= 10


def test_hunks_are_read_once(spark):
    """A hunk's symbols and its file's rest come from one pass: the hunks are in the plan once."""
    symbols = spark.createDataFrame([("f", "f::a", 3, 10), ("f", "f::b", 5, 6)], "file string, symbol string, line_start int, line_end int")
    hunks = spark.range(1).selectExpr("'c' as commit_id", "'f' as file", "cast(2 + id as int) as old_lines", "cast(1 as int) as new_start", "cast(8 as int) as new_lines")
    got = intrafile.attributed(hunks, symbols)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 1") == 1
    assert {r["node"]: r["lines"] for r in got.collect()} == {"f::a": 5.0, "f::b": 2.5, "f": 2.5}
