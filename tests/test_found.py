"""Queries on some signals, or on those about one node, find no others; a settled history sends numbers for names."""

import pytest
from pyspark.sql import functions as F
from test_catalog import star

from strataweave import catalog
from strataweave.operators import components, signals
from strataweave.sources import fixture
from strataweave.sources.fixture import Fixture


def rows(df):
    return sorted(df.collect(), key=repr)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("star")
    star(spark, path, 400)
    return str(path)


@pytest.mark.parametrize("query, kinds", [("signals_filtered", ["god_module"]), ("highlighted_edges", ["fragile_boundary", "ghost_coupling", "ticking_bomb"]), ("signals_searched", ["ghost_coupling", "stable_core"])])
def test_only_what_is_asked_for_is_detected(spark, folder, monkeypatch, query, kinds):
    asked = []
    plain = catalog._detect
    monkeypatch.setattr(catalog, "_detect", lambda fx, name: asked.append(name) or plain(fx, name))
    monkeypatch.setattr(components, "strong_components", lambda *_: pytest.fail("searched all cycles"))
    catalog.QUERIES[query](spark, folder).collect()
    assert sorted(asked) == [f"signal_{k}" for k in kinds]


def test_signals_about_a_node_are_those_of_all(spark, folder, monkeypatch):
    every = catalog._all(Fixture(spark, folder)).cache()
    ends = [x["n"] for x in every.where("signal_type = 'dependency_cycle'").select(F.explode(F.array("node_a", "node_b")).alias("n")).distinct().limit(2).collect()]
    monkeypatch.setattr(components, "strong_components", lambda *_: pytest.fail("searched all cycles"))
    for node in [*ends, every.where("signal_type <> 'dependency_cycle'").first()["node_a"], "no such node"]:
        assert rows(catalog._about(Fixture(spark, folder), node)) == rows(every.where((F.col("node_a") == node) | (F.col("node_b") == node)))


def test_a_nodes_component_is_the_one_of_all(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "f"), ("g", "a"), ("h", "h"), (None, "a"), ("a", None)]
    edges = spark.createDataFrame(pairs, "source string, target string")
    every = {x["id"]: x["component"] for x in components.strong_components(edges).collect()}
    for node in "abcdefghx":
        expected = [(i, c) for i, c in every.items() if c == every.get(node)]
        assert [tuple(x) for x in rows(components.component_of(edges, node))] == sorted(expected)


@pytest.mark.parametrize("clash", [False, True])
def test_the_history_sends_numbers_unless_two_files_share_one(spark, folder, monkeypatch, clash):
    sent = []
    plain = fixture.tally.tallies
    monkeypatch.setattr(fixture.tally, "tallies", lambda h, *a: sent.append(dict(h.dtypes)["file"]) or plain(h, *a))
    expected = rows(Fixture(spark, folder).couplings())
    if clash:
        monkeypatch.setattr(fixture, "number", lambda name: F.when(name.isNotNull(), F.xxhash64(name) % 2))
    assert expected and rows(Fixture(spark, folder).settle().couplings()) == expected
    assert sent == ["string" if clash else "bigint"]
