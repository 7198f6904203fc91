"""One pass over the history counts what the layers' own operators count."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_catalog import star

from strataweave.operators import change, tally
from strataweave.sources.fixture import Fixture


def rows(df, *names):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*names).collect()), key=repr)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Lines without an amount or an order, orders without lines, and one of ten files, which is too large for pairs."""
    path = tmp_path_factory.mktemp("star")
    star(spark, path / "plain", 400)
    for name in ("part", "orders"):
        spark.read.parquet(f"{path}/plain/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    lines = spark.read.parquet(f"{path}/plain/lineitem.parquet")
    odd = lines.where("l_orderkey = 1").limit(1).crossJoin(spark.range(1, 11)).withColumn("l_partkey", F.col("id")).withColumn("l_linenumber", (F.col("id") + 10).cast("int")).drop("id")
    lone = lines.where("l_orderkey between 5 and 40").withColumn("l_orderkey", F.col("l_orderkey") + 100000)
    keyless = lines.where("l_orderkey between 5 and 7").withColumn("l_orderkey", F.lit(None).cast("long"))
    unknown = lines.where("l_orderkey between 50 and 90").withColumn("l_quantity", F.lit(None).cast("double"))
    lines.where("l_orderkey % 37 <> 0 and l_orderkey not between 50 and 90").unionByName(odd).unionByName(lone).unionByName(keyless).unionByName(unknown).write.parquet(f"{path}/lineitem.parquet")
    return str(path)


@pytest.mark.parametrize("block", [1, 50, 1 << 19])
def test_a_settled_fixture_has_the_same_layers(spark, folder, block, monkeypatch):
    monkeypatch.setattr(tally, "BLOCK", block)
    plain, settled = Fixture(spark, folder), Fixture(spark, folder).settle()
    for name, columns in {
        "frequencies": ("file", "change_freq", "churn_lines", "churn_rate", "last_changed"),
        "couplings": ("a", "b", "cnt", "w"),
        "faults": ("source", "target", "cnt", "weight"),
        "defect_metrics": ("node_id", "bug_count", "defect_density", "fix_inducing_rate"),
        "imports": ("source", "target"),
    }.items():
        expected = rows(getattr(plain, name)(), *columns)
        assert expected and rows(getattr(settled, name)(), *columns) == expected, name


def test_a_settled_fixture_reads_the_lines_once(spark, folder):
    fx, read = Fixture(spark, folder).settle(), []
    table = fx.table
    fx.table = lambda name: read.append(name) or table(name)
    for make in (fx.frequencies, fx.change_metrics, fx.faults, fx.defect_metrics, fx.imports, fx.coupled):
        make().count()
    assert read.count("lineitem") == 1 and read.count("orders") == 1


def test_empty_history(spark, folder):
    fx = Fixture(spark, folder)
    assert tally.tallies(fx.history().limit(0), 8, "l_linenumber").count() == 0


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_changes_propagate_over_the_borders_of_blocks(spark, block, monkeypatch):
    monkeypatch.setattr(change, "BLOCK", block)
    files = {0: "ab", 1: "c", 2: "abcd", 4: "b", 7: "ad", 8: "c", 14: "b"}  # 2 is too large
    touches = spark.createDataFrame([(str(s), s, None, f, 1) for s, fs in files.items() for f in fs], "commit_id string, seq long, ts timestamp, file string, churn long")
    small = {s: set(fs) for s, fs in files.items() if len(fs) <= 3}
    expected = Counter((a, b) for s, fs in small.items() for a in fs for b in set().union(*[small.get(s - k, set()) for k in range(1, 6)]) if a != b)
    got = {(x["source"], x["target"]): x["cnt"] for x in change.change_propagates(touches, 5, 3).collect()}
    assert got == expected


def test_a_touch_is_shuffled_about_once_for_propagation(spark):
    touches = spark.range(20000).select(F.col("id").cast("string").alias("commit_id"), F.col("id").alias("seq"), F.lit(None).cast("timestamp").alias("ts"), F.lit("f").alias("file"), F.lit(1).alias("churn"))
    plan = change.change_propagates(touches, 5, 8)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode(sequence") == 1 and plan.count("RepartitionByExpression") == 1 and "LeftAnti" not in plan
