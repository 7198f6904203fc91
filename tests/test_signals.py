"""The detectors on graphs made by hand, with the engine's limits."""

import pytest
from pyspark.sql import functions as F

from strataweave.config import Thresholds
from strataweave.operators import components, graphops, metrics, signals
from strataweave.schema import CHANGE_METRICS, DEFECT_METRICS, EDGES, NODES, as_schema


def graph(spark, nodes=(), edges=(), change=(), defect=(), **limits):
    layer = {"imports": "structural", "contains": "structural", "calls": "structural", "co_changes": "change", "fault_propagates": "defect"}
    known = {n[0] for n in nodes}
    nodes = [*nodes, *[(x, None, None) for x in dict.fromkeys(y for e in edges for y in e[1:3]) if x not in known]]
    n = as_schema(spark.createDataFrame(nodes, "id string, complexity int, loc int").withColumn("file_path", F.substring_index("id", "::", 1)), NODES)
    e = as_schema(spark.createDataFrame([(a, b, layer[k], k, float(w)) for k, a, b, w in edges], "source string, target string, layer string, edge_type string, weight double"), EDGES)
    c = as_schema(spark.createDataFrame(list(change), "node_id string, change_freq long, hotspot_score double, sum_coupling double"), CHANGE_METRICS)
    d = as_schema(spark.createDataFrame(list(defect), "node_id string, defect_density double"), DEFECT_METRICS)
    return signals.Graph(n, e, c, d, signals.limits_of(n, Thresholds(**limits)))


def found(df):
    return sorted((r["signal_type"], r["node_a"], r["node_b"], round(r["severity"], 6)) for r in df.collect())


def test_ghost_coupling(spark):
    assert found(signals.ghost_coupling(graph(spark, edges=[("co_changes", "a.py", "b.py", 0.8)]))) == [("ghost_coupling", "a.py", "b.py", 0.8)]
    assert found(signals.ghost_coupling(graph(spark, edges=[("co_changes", "a.py", "b.py", 0.8), ("imports", "a.py", "b.py", 1)]))) == []
    parent = [("imports", "p.py", "a.py", 1), ("imports", "p.py", "b.py", 1)]
    assert found(signals.ghost_coupling(graph(spark, edges=[("co_changes", "a.py", "b.py", 0.8), *parent]))) == []
    assert found(signals.ghost_coupling(graph(spark, edges=[("co_changes", "a.py", "b.py", 0.95), *parent]))) == [("ghost_coupling", "a.py", "b.py", 0.285)]
    assert found(signals.ghost_coupling(graph(spark, edges=[("co_changes", "crate-a/src/foo.rs", "crate-b/src/bar.rs", 0.8)]))) == []
    assert found(signals.ghost_coupling(graph(spark, edges=[("co_changes", "test_a.py", "a.py", 0.8), ("co_changes", "a.md", "b.py", 0.9), ("co_changes", "a.py", "c.py", 0.5)]))) == []


def test_fragile_boundary(spark):
    g = graph(spark, edges=[("imports", "a.py", "b.py", 1), ("co_changes", "a.py", "b.py", 0.7), ("fault_propagates", "a.py", "b.py", 0.2)])
    assert found(signals.fragile_boundary(g)) == [("fragile_boundary", "a.py", "b.py", 1.4)]


def test_over_engineering(spark):
    assert found(signals.over_engineering(graph(spark, nodes=[("b.py", 2, 10)], edges=[("imports", "a.py", "b.py", 1)]))) == [("over_engineering", "a.py", "b.py", 0.4)]
    g = graph(spark, nodes=[("b.py", 30, 10)], edges=[("imports", "a.py", "b.py", 1), ("imports", "b.py", "c.py", 1), ("co_changes", "a.py", "c.py", 0.8)])
    assert ("over_engineering", "a.py", "b.py", 0.4) in found(signals.over_engineering_pass_through(g))
    g = graph(spark, nodes=[("b.py", 20, 10)], edges=[("imports", "a.py", "b.py", 1), ("imports", "c.py", "b.py", 1)])
    assert found(signals.over_engineering(g)) == []


def test_cycles(spark):
    two = graph(spark, edges=[("imports", "a.py", "b.py", 1), ("imports", "b.py", "a.py", 1)])
    assert found(signals.dependency_cycle(two)) == [("dependency_cycle", "a.py", "b.py", 1.0)]
    three = graph(spark, edges=[("imports", "a.py", "b.py", 1), ("imports", "b.py", "c.py", 1), ("imports", "c.py", "a.py", 1)])
    assert found(signals.dependency_cycle(three)) == [("dependency_cycle", "a.py", "b.py", 1.5)]
    assert found(signals.dependency_cycle(graph(spark, edges=[("imports", "a.py", "b.py", 1), ("imports", "b.py", "c.py", 1)]))) == []


def test_god_module(spark):
    def with_imports(name, n, complexity, loc):
        return graph(spark, nodes=[(name, complexity, loc)], edges=[("imports", name, f"d{i}.py", 1) for i in range(n)])

    assert found(signals.god_module(with_imports("g.py", 20, 80, 1200))) == [("god_module", "g.py", None, round(80 / 50 * 1200 / 500 * 20 / 15, 6))]
    assert len(found(signals.god_module(with_imports("g.py", 15, 80, 600)))) == 1
    assert found(signals.god_module(with_imports("g.pb.go", 20, 80, 1200))) == []
    inner = graph(spark, nodes=[("g.py", 80, 1200)], edges=[*[("contains", "g.py", f"g.py::f{i}", 1) for i in range(20)], ("imports", "g.py", "d.py", 1)])
    assert found(signals.god_module(inner)) == []


def test_shotgun_and_unstable(spark):
    wide = graph(spark, edges=[("co_changes", "a.py", f"b{i}.py", 0.5) for i in range(10)])
    assert found(signals.shotgun_surgery(wide)) == [("shotgun_surgery", "a.py", None, 1.25)]
    assert found(signals.shotgun_surgery(graph(spark, edges=[("co_changes", "a.py", "b.py", 0.5), ("co_changes", "a.py", "c.py", 0.5)]))) == []
    edges = [*[("imports", f"c{i}.py", "stable.py", 1) for i in range(5)], ("imports", "stable.py", "unstable.py", 1), *[("imports", "unstable.py", f"l{i}.py", 1) for i in range(5)]]
    assert [x[:3] for x in found(signals.unstable_dependency(graph(spark, edges=edges)))] == [("unstable_dependency", "stable.py", "unstable.py")]


def test_ticking_bomb_and_stable_core(spark):
    nodes = [(f"f{i}.py", 5, 10) for i in range(10)]
    g = graph(spark, nodes=nodes, edges=[e for i in range(1, 10) for e in (("imports", f"f{i}.py", "f0.py", 1), ("imports", "f0.py", f"f{i}.py", 1))], change=[(f"f{i}.py", i + 1, (i + 1) / 10, i / 10) for i in range(10)], defect=[(f"f{i}.py", i / 10) for i in range(10)])
    assert [x[1] for x in found(signals.ticking_bomb(g))] == ["f9.py"]
    assert [x[1] for x in found(signals.stable_core(g))] == ["f0.py"]


def test_all_signals_are_ordered(spark):
    g = graph(spark, nodes=[("b.py", 2, 10)], edges=[("imports", "a.py", "b.py", 1), ("co_changes", "x.py", "y.py", 0.8)])
    rows = [(r["signal_type"], r["severity"]) for r in signals.detect_signals(g).collect()]
    assert rows == sorted(rows, key=lambda r: -r[1]) and {r[0] for r in rows} >= {"ghost_coupling", "over_engineering"}


@pytest.mark.parametrize("p, expected", [(50, 3.0), (0, 1.0), (100, 5.0)])
def test_percentile(spark, p, expected):
    assert spark.range(1, 6).agg(metrics.percentile("id", p).alias("p")).first()["p"] == expected
    assert spark.range(0).agg(metrics.percentile("id", p).alias("p")).first()["p"] == 0


def test_components_both_ways(spark):
    import random

    r = random.Random(3)
    pairs = [(f"n{r.randrange(40):02}", f"n{r.randrange(40):02}") for _ in range(70)]
    edges = spark.createDataFrame(pairs, "source string, target string")
    reach = {a: {b for x, b in pairs if x == a} for a, _ in pairs}
    for _ in range(40):
        reach = {a: s | {c for b in s for c in reach.get(b, ())} for a, s in reach.items()}
    expected = {(a, min(b for b in {*s, a} if b == a or a in reach.get(b, ()))) for a, s in reach.items() if any(b != a and a in reach.get(b, ()) for b in s)}
    assert {(x["id"], x["component"]) for x in components.strong_components(edges).collect()} == expected


def test_duplicate_edges_count_in_fans_only(spark):
    edges = [("imports", "a.py", "b.py", 1), ("imports", "a.py", "b.py", 1)]
    g = graph(spark, edges=edges)
    row = {x["id"]: x for x in metrics.node_metrics(g.nodes, g.edges).collect()}
    assert (row["b.py"]["fan_in"], row["a.py"]["fan_out"], row["a.py"]["cbo"]) == (2, 2, 1)


def test_merge_and_paths(spark):
    n = spark.createDataFrame([("a", 1)], "id string, loc int")
    m = spark.createDataFrame([("a", 2), ("b", 3)], "id string, loc int")
    e = spark.createDataFrame([("a", "b", 2.0), ("b", "c", 1.0)], "source string, target string, weight double")
    nodes, edges = graphops.merge_graphs((n, e.limit(0)), (m, e))
    assert sorted(tuple(x) for x in nodes.collect()) == [("a", 1), ("b", 3)] and edges.count() == 2
    assert graphops.shortest_path(e, "a", "c").first()["path"] == ["a", "b", "c"]
    assert graphops.shortest_path(e, "c", "a").isEmpty()


def test_pass_through_takes_the_first_import_of_the_file(spark):
    from strataweave.operators import structural

    parsed = spark.createDataFrame([("a.py", "python", 1, [], [], ["b.py"]), ("b.py", "python", 1, [], [], ["none.py", "z.py", "c.py"]), ("c.py", "python", 1, [], [], []), ("z.py", "python", 1, [], [], [])], "file_path string, language string, loc int, functions array<struct<name:string,line_start:int,line_end:int,complexity:int>>, classes array<struct<name:string,line_start:int,line_end:int,complexity:int>>, imports array<string>")
    nodes, edges = structural.build_structural(parsed)
    places = {(r["source"], r["target"]): r["edge_seq"] for r in edges.collect()}
    assert places == {("a.py", "b.py"): 0, ("b.py", "z.py"): 1, ("b.py", "c.py"): 2}
    co = spark.createDataFrame([("a.py", "c.py", "change", "co_changes", 0.9), ("a.py", "z.py", "change", "co_changes", 0.8)], "source string, target string, layer string, edge_type string, weight double")
    both = as_schema(edges.unionByName(co, allowMissingColumns=True), EDGES)
    change = spark.createDataFrame([("b.py", 9)], "node_id string, change_freq long")
    g = signals.Graph(nodes, both, change, change, signals.limits_of(nodes, Thresholds()))
    (row,) = signals.over_engineering_pass_through(g).collect()
    assert (row["node_a"], row["node_b"], row["severity"], row["description"]) == ("a.py", "b.py", 0.4, "Pass-through to z.py")
