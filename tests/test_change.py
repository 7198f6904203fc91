import datetime as dt

from pyspark.sql import functions as F

from strataweave.config import Build, load_config
from strataweave.functions.ignore import IgnoreRules, glob_regex
from strataweave.functions.paths import is_generated_code, is_test_file, language
from strataweave.operators import change
from strataweave.schema import TOUCHES

T0 = dt.datetime(2024, 6, 1)


def touches(spark, rows):
    return spark.createDataFrame(rows, TOUCHES)


def test_metrics_and_pairs(spark):
    rows = [("c0", 0, T0, "a.py", 3), ("c0", 0, T0, "b.py", 1), ("c1", 1, T0, "a.py", 2), ("c2", 2, T0, "a.py", 0), ("c2", 2, T0, "b.py", 5)]
    rows += [("bulk", 3, T0, f"f{i}.py", 1) for i in range(9)]
    t = touches(spark, rows)
    freq = {r["file"]: (r["change_freq"], r["churn_lines"]) for r in change.frequencies(t).collect()}
    assert freq["a.py"] == (3, 5) and freq["b.py"] == (2, 6)
    pairs = change.co_change_pairs(t, 8)
    assert [tuple(r) for r in pairs.collect()] == [("a.py", "b.py", 2)]
    coupled = change.couplings(pairs, change.frequencies(t), 2)
    assert coupled.first()["w"] == 1.0
    assert change.couplings(pairs, change.frequencies(t), 3).isEmpty()
    assert [tuple(r) for r in change.bulk_commits(t, 8).collect()] == [("bulk", 9)]
    scores = {r["node_id"]: r["hotspot_score"] for r in change.change_metrics(change.frequencies(t), coupled).collect()}
    assert scores["a.py"] == 1.0 and scores["f0.py"] == 1 / 3


def test_window(spark):
    assert change.window_days("6 months ago") == 180 and change.window_days("2 weeks ago") == 14
    assert change.window_days("nonsense") is None and change.window_days("soon") is None
    now = F.lit(T0).cast("timestamp_ntz")
    rows = [(f"n{i}", i, T0, "a.py", 1) for i in range(3)] + [(f"o{i}", 3 + i, T0 - dt.timedelta(days=400), "a.py", 1) for i in range(101)] + [("late", 104, T0, "b.py", 1)]
    rows[1] = ("n1", 1, None, "a.py", 1)
    seen = change.windowed(touches(spark, rows), now, Build())
    assert {r["commit_id"] for r in seen.collect()} == {"n0", "n1", "n2"}
    seen = change.windowed(touches(spark, rows[:50] + rows[-1:]), now, Build())
    assert {r["commit_id"] for r in seen.collect()} == {"n0", "n1", "n2", "late"}
    capped = change.windowed(touches(spark, rows), now, Build(max_commits=2))
    assert {r["commit_id"] for r in capped.collect()} == {"n0", "n1"}


def test_kept_files(spark):
    rows = [("c", 0, T0, f, 1) for f in ("a.py", "b.txt", "x.pb.go", "docs/c.py", "docs/keep.py")]
    rules = IgnoreRules.parse("# comment\n\ndocs/\n!docs/keep.py")
    assert {r["file"] for r in change.kept_files(touches(spark, rows), rules).collect()} == {"a.py", "docs/keep.py"}
    assert rules.has_user_rules and not rules.is_empty and not IgnoreRules.parse("").has_user_rules
    assert rules.is_ignored("docs/c.py") and not rules.is_ignored("docs/keep.py")


def test_globs():
    import re

    cases = [("*.py", "a/b.py", True), ("*.py", "a/b.pyc", False), ("/src/*.ts", "src/a.ts", True), ("src/*.ts", "src/x/a.ts", False), ("a/**/z.py", "a/b/c/z.py", True), ("gen/", "x/gen/y.go", True), ("gen/", "x/regen/y.go", False), ("?.rs", "a.rs", True), ("?.rs", "ab.rs", False)]
    for glob, path, expected in cases:
        assert bool(re.search(glob_regex(glob), path)) is expected, (glob, path)


def test_predicates(spark):
    names = ["test_a.py", "a/test_b.py", "src/a.test.ts", "x/tests/y.py", "tests/y.py", "contest.py", "latest/x.py", "a/gen/b.go", "a/gen/b.rs", "q.g.dart", "a.tsx", ".py", "noext"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    p = F.col("p")
    got = {r["p"]: (r["t"], r["g"], r["l"]) for r in df.select("p", is_test_file(p).alias("t"), is_generated_code(p).alias("g"), language(p).alias("l")).collect()}
    assert [n for n in names if got[n][0]] == names[:5]
    assert [n for n in names if got[n][1]] == ["a/gen/b.go", "q.g.dart"]
    assert got["a.tsx"][2] == "typescript" and got[".py"][2] is None and got["noext"][2] is None


def test_running_total_matches_window(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7)
    got = {r["id"]: r["t"] for r in change.running_total(df, "id", F.col("v"), "t", 7).collect()}
    total = 0
    for i in range(1000):
        total += i % 7
        assert got[i] == total


def test_config(tmp_path):
    assert load_config(tmp_path / "none.toml").build.min_co_changes == 5
    (tmp_path / "c.toml").write_text("[build]\nmin_co_changes = 2\nunknown = 1\n[thresholds]\nghost_coupling = 0.7\n")
    c = load_config(tmp_path / "c.toml")
    assert c.build.min_co_changes == 2 and c.thresholds.ghost_coupling == 0.7
    (tmp_path / "bad.toml").write_text("= nonsense")
    assert load_config(tmp_path / "bad.toml").build.min_coupling == 0.3
