"""Queries of the catalogue on small tables, against brute force."""

import datetime as dt
import random
from collections import Counter

from strataweave import catalog
from strataweave.sources.fixture import Fixture

DAY0 = dt.datetime(1992, 1, 1)


def star(spark, folder, n_orders, seed=1):
    """Orders and lines in the driver's shape, written to folder; the same rows."""
    r = random.Random(seed)
    orders = [(k, r.randrange(4), DAY0 + dt.timedelta(days=r.randrange(200))) for k in range(1, n_orders + 1)]
    lines = [(k, r.randrange(1, 31), r.randrange(3), i, float(r.randrange(1, 9)), r.choice("NR"), when + dt.timedelta(days=r.randrange(1, 90))) for k, _, when in orders for i in range(r.randrange(1, 6))]
    parts = [(k, f"Brand#{k % 12 + 1}", ("SMALL", "PROMO", "LARGE")[k % 3], k % 50 + 1) for k in range(1, 31)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_shipdate timestamp_ntz").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_type string, p_size int").write.parquet(f"{folder}/part.parquet")
    return orders, lines


def test_range_innermost(spark, tmp_path):
    orders, lines = star(spark, tmp_path, 40)
    of = {k: (c, (when - DAY0).days) for k, c, when in orders}
    last = {}
    for k, *_, shipped in lines:
        last[k] = max(last.get(k, 0), (shipped - DAY0).days)
    expected = set()
    for k, _, _, line, *_, shipped in lines:
        at, customer = (shipped - DAY0).days, of[k][0]
        around = [(last[d] - b, b, d) for d, (c, b) in of.items() if c == customer and d in last and b <= at <= last[d]]
        expected.add((customer, k, line, at, min(around)[2]))
    got = [tuple(x) for x in catalog.QUERIES["range_innermost"](spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    assert {x[1] for x in got} == set(of)


def test_change_propagates(spark, tmp_path):
    n = 2300
    orders, lines = star(spark, tmp_path, n)
    path = {x["p_partkey"]: x["id"] for x in Fixture(spark, str(tmp_path)).parts().collect()}
    seq = {k: i for i, (k, _, _) in enumerate(sorted(orders, key=lambda x: (x[2], x[0]), reverse=True))}
    files = {}
    for k, part, *_ in lines:
        files.setdefault(seq[k], set()).add(path[part])
    freq = Counter(f for fs in files.values() for f in fs)
    times = Counter()
    for i, here in files.items():
        after = set().union(*[files.get(j, set()) for j in range(max(i - 5, 0), i)])
        times.update((a, b) for a in here for b in after if a != b)
    got = {(x["source"], x["target"]): (x["cnt"], x["weight"]) for x in catalog.QUERIES["change_propagates"](spark, str(tmp_path)).collect()}
    assert {k: v[0] for k, v in got.items()} == times
    assert all(abs(w - times[k] / freq[k[0]]) < 1e-6 for k, (_, w) in got.items())


def test_scc_members(spark, tmp_path):
    star(spark, tmp_path, 12)
    fx = Fixture(spark, str(tmp_path))
    ways = {}
    for x in fx.edges().collect():
        ways.setdefault(x["source"], set()).add(x["target"])

    def reached(a):
        seen, front = set(), [a]
        while front:
            new = ways.get(front.pop(), set()) - seen
            seen |= new
            front += new
        return seen

    reach = {a: reached(a) for a in ways}
    groups = {a: {b for b in r if a in reach.get(b, ())} | {a} for a, r in reach.items()}
    expected = {(a, min(g)) for a, g in groups.items() if len(g) > 1}
    got = {(x["id"], x["component"]) for x in catalog.QUERIES["scc_members"](spark, str(tmp_path)).collect()}
    assert got == expected and got
