"""Strong components, spectra, modularity and stress against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataweave.operators import components, spectral, stress


def tarjan_free(pairs):
    """Groups of mutual reach by matrix closure."""
    ids = sorted({x for p in pairs for x in p})
    at = {x: i for i, x in enumerate(ids)}
    m = np.zeros((len(ids),) * 2, dtype=bool)
    for a, b in pairs:
        m[at[a], at[b]] = True
    for k in range(len(ids)):
        m |= np.outer(m[:, k], m[k])
    both = m & m.T
    return {(x, ids[min(np.flatnonzero(both[i]))]) for x, i in at.items() if (both[i].sum() > 1)}


@pytest.mark.parametrize("seed", range(2))
def test_random_graphs(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = [(f"n{a:03}", f"n{b:03}") for a, b in rng.integers(0, 60, (int(rng.integers(50, 110)), 2))]
    got = components.strong_components(spark.createDataFrame(pairs, "source string, target string"))
    assert {tuple(x) for x in got.collect()} == tarjan_free(pairs)


def test_bridges_loops_repeats_and_nulls(spark):
    cycle = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "b"), ("a", "a"), ("c", "x"), ("x", "y"), ("y", "p"), ("p", "q"), ("q", "p"), ("q", "end"), (None, "a"), ("z", None)]
    got = components.strong_components(spark.createDataFrame(cycle, "source string, target string"))
    assert {tuple(x) for x in got.collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("p", "p"), ("q", "p")}
    assert components.strong_components(spark.createDataFrame([], "source string, target string")).collect() == []
    assert components.strong_components(spark.createDataFrame([("a", "b")], "source string, target string")).collect() == []


def test_a_dense_component_without_a_join_beyond_its_edges(spark, monkeypatch):
    """2,000 nodes with 40 edges each, and as many in tails: nothing that is written has more rows than twice the edges."""
    n, each = 2000, 40
    i = spark.range(n * each).select((F.col("id") % n).alias("s"), F.floor(F.col("id") / n).alias("k"))
    ring = i.select(F.col("s").cast("string").alias("source"), ((F.col("s") * 7 + F.col("k") * F.col("k") + 1) % n).cast("string").alias("target"))
    back = spark.range(n).select(F.col("id").cast("string").alias("source"), ((F.col("id") + 1) % n).cast("string").alias("target"))
    tails = spark.range(n).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("source"), F.concat(F.lit("t"), (F.col("id") + 1).cast("string")).alias("target"))
    edges = ring.union(back).union(tails.where("source like 't1%'"))
    rows, cut = [], components.cut

    def counted(df):
        out = cut(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(components, "cut", counted)
    got = components.strong_components(edges)
    assert got.agg(F.count("*"), F.countDistinct("component")).first()[:] == (n, 1)
    assert max(rows) <= 2 * edges.distinct().count() and len(rows) < 100


def graph(rng, n, m):
    edges = [(f"n{a}", f"n{b}", float(w)) for (a, b), w in zip(rng.integers(0, n, (m, 2)), rng.random(m) + 0.1)]
    matrix = np.zeros((n, n))
    for a, b, w in edges:
        i, j = int(a[1:]), int(b[1:])
        matrix[i, j] += w
        if i != j:
            matrix[j, i] += w
    return edges, matrix


def test_dominant_eigenvector(spark):
    edges, matrix = graph(np.random.default_rng(1), 12, 60)
    value, x, rounds = spectral.eigenvector(spark.createDataFrame(edges, "source string, target string, weight double"))
    values, vectors = np.linalg.eigh(matrix)
    best = np.abs(vectors[:, -1])
    assert abs(value - values[-1]) < 1e-6 and rounds < 200
    assert all(abs(r["x"] - best[int(r["id"][1:])]) < 1e-6 for r in x.collect())


def test_a_bipartite_star_converges_and_an_empty_graph_is_zero(spark):
    star = spark.createDataFrame([("c", f"l{i}", 1.0) for i in range(4)], "source string, target string, weight double")
    assert abs(spectral.spectral_radius(star) - 2) < 1e-6
    assert spectral.centrality(star, 1).first()["id"] == "c"
    assert spectral.spectral_radius(star.limit(0)) == 0


def test_modularity_is_the_sum_over_pairs(spark):
    rng = np.random.default_rng(2)
    edges, _ = graph(rng, 15, 40)
    edges.append(("n1", "n1", 2.0))
    groups = {f"n{i}": f"g{i % 3}" for i in range(14)}  # n14 is alone
    a = np.zeros((15, 15))
    for s, t, w in edges:
        a[int(s[1:]), int(t[1:])] += w
        a[int(t[1:]), int(s[1:])] += w
    own = [groups.get(f"n{i}", "alone") for i in range(15)]
    same = np.array([[x == y for y in own] for x in own])
    degree, twice = a.sum(1), a.sum()
    expected = ((a - np.outer(degree, degree) / twice) * same).sum() / twice
    got = spectral.modularity(spark.createDataFrame(edges, "source string, target string, weight double"), spark.createDataFrame(list(groups.items()), "id string, group string"))
    assert abs(got.agg(F.sum("q")).first()[0] - expected) < 1e-9
    assert {r["group"] for r in got.collect()} == {"g0", "g1", "g2", "node:n14"}


def test_relaxation_equals_a_dense_solve(spark):
    edges, matrix = graph(np.random.default_rng(3), 10, 30)
    np.fill_diagonal(matrix, 0)
    loads = spark.createDataFrame([("n0", 5.0), ("n3", 1.0), ("n3", 1.0), ("apart", 2.0)], "id string, pressure double")
    field, rounds, residual = stress.relax(loads, spark.createDataFrame(edges, "source string, target string, weight double"), damping=0.6)
    p = np.zeros(10)
    p[0], p[3] = 5, 2
    want = np.linalg.solve(np.eye(10) - 0.6 / matrix.sum(1).max() * matrix, p)
    got = {r["id"]: r["stress"] for r in field.collect()}
    assert got.pop("apart") == 2 and all(abs(v - want[int(k[1:])]) < 1e-7 for k, v in got.items())
    assert rounds < 100 and residual <= 1e-9
    with pytest.raises(ValueError, match="rounds"):
        stress.relax(loads, spark.createDataFrame(edges, "source string, target string, weight double"), damping=0.99, rounds=3)
    delta = {r["id"]: r["change"] for r in stress.compare(field, field.where("id <> 'n0'")).collect()}
    assert delta["n3"] == 0 and delta["n0"] < 0


def test_zones(spark):
    rows = spark.createDataFrame([(0.5,), (1.0,), (1.5,), (2.0,), (3.0,), (3.1,), (None,)], "s double")
    assert [r[0] for r in rows.select(stress.zone(F.col("s"))).collect()] == ["critical", "danger", "warning", "healthy", "healthy", "over_engineered", "over_engineered"]


def test_an_eigenvector_whose_next_value_is_near_takes_few_rounds(spark):
    """A path of 40 nodes: the two largest eigenvalues differ by a hundredth, so a power iteration takes hundreds of rounds."""
    path = spark.createDataFrame([(f"p{i:02}", f"p{i + 1:02}", 1.0) for i in range(39)], "source string, target string, weight double")
    value, x, rounds = spectral.eigenvector(path, 1e-7)
    want = np.sin(np.arange(1, 41) * np.pi / 41)
    want /= np.linalg.norm(want)
    assert rounds <= 25 and abs(value - 2 * np.cos(np.pi / 41)) < 1e-9
    assert all(abs(r["x"] - want[int(r["id"][1:])]) < 1e-6 for r in x.collect())


def test_linked_components(spark, monkeypatch):
    """Chains, a hub, repeats, loops and nulls, in rounds that grow as the logarithm of the longest path."""
    rng = np.random.default_rng(5)
    names = [f"n{i:03}" for i in rng.permutation(300)]
    pairs = [*zip(names[:199], names[1:200]), *[(names[200], x) for x in names[201:260]], (names[260], names[260]), (None, names[0]), (names[0], None), (names[1], names[0]), (names[280], names[281]), (names[282], names[281])]
    rounds, cut = [], components.cut
    monkeypatch.setattr(components, "cut", lambda df: rounds.append(1) or cut(df))
    got = {tuple(x) for x in components.linked_components(spark.createDataFrame(pairs, "source string, target string")).collect()}
    assert got == {(x, min(g)) for g in (names[:200], names[200:260], names[280:283]) for x in g}
    assert len(rounds) <= 12
    several = spark.createDataFrame([(9, 5), (9, 2), (5, 1)], "source int, target int")
    assert {x[1] for x in components.linked_components(several).collect()} == {1}
    assert components.linked_components(several.limit(0)).isEmpty()
