"""Sharding, nearest neighbours and the pipeline."""

import math
import random
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strataweave.llm import hash_tree, nndescent


def test_hash_tree(llm):
    rows = [(i, "x" * (i % 50)) for i in range(4000)] + [(None, None), (7, "x" * 7), (8, "é")]
    df = llm.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash")).withColumn("other", F.lit(1))
    got = hash_tree.shard_rows(df, 24).collect()
    assert len(got) == len(rows) and {r["shard"] for r in got} == set(range(24))
    for s in range(24):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert all(r["grown_shard"] in (r["shard"], 24) for r in got) and 80 < sum(r["grown_shard"] == 24 for r in got) < 250
    assert all((r["region"], r["rack"]) == (r["shard"] // 8, r["shard"] // 4 % 2) for r in got)
    known = {(r["doc_id"], r["size"]): r["text_crc32"] for r in got}
    assert known[(None, 8)] == 0 and known[(8, 10)] == zlib.crc32("é".encode())
    # what grown_shard announces is what one more shard gives
    for n in (1, 4, 20, 23):
        pairs = [(hash_tree.shard_rows(df, n), "grown_shard"), (hash_tree.shard_rows(df, n + 1), "shard")]
        now, then = [sorted(str((r["doc_id"], r["size"], r[c])) for r in d.collect()) for d, c in pairs]
        assert now == then
    # a heavier shard takes rows: they move into its region or inside it, and those of other racks there only from outside
    a = {(r["doc_id"], r["size"]): r for r in got}
    b = {(r["doc_id"], r["size"]): r for r in hash_tree.shard_rows(df, 24, weights={3: 2.0}).collect()}
    moved = [(a[i], b[i]) for i in a if a[i]["shard"] != b[i]["shard"]]
    assert moved and all(y["region"] == 0 for _, y in moved) and all(y["rack"] == 0 for x, y in moved if x["region"] == 0)
    assert all(y["shard"] == 3 for x, y in moved if (x["region"], x["rack"]) == (0, 0))
    assert sum(x["shard"] == 3 for x in b.values()) > 1.5 * sum(x["shard"] == 3 for x in a.values())
    none = {r["shard"] for r in hash_tree.shard_rows(df, 24, weights={3: 0.0}).collect()}
    assert 3 not in none and hash_tree.shard_rows(df.limit(0), 24).isEmpty()


def twin(key, tree, seed=7):
    """The descent by hand: Spark's hash of several longs is XXH64 of each, seeded with the one before; a null leaves it."""

    def number(*values):
        h = 42
        for v in values:
            h = h if v is None else xxhash.xxh64_intdigest(struct.pack("<q", v), h)
        return h

    def draw(path, weight, seed=seed):
        return -math.log(((number(key, *path, seed) >> 12) + 0.5) / 2**52) / weight

    def descend(path, level, inside):
        weights = {}
        for x in inside:
            weights[getattr(x, level)] = weights.get(getattr(x, level), 0) + x.weight
        return min((draw([*path, i], w), i) for i, w in weights.items())[1]

    arrivals, tree = [], [x for x in tree if x.weight > 0]
    for region in {x.region for x in tree if not x.vacant}:
        inside = [x for x in tree if x.region == region]
        first = draw([region], sum(x.weight for x in inside))
        rack = descend([region], "rack", inside)
        shard = descend([region, rack], "shard", [x for x in inside if x.rack == rack])
        shards = {x.shard: x for x in inside if not x.vacant}
        if shard in shards:
            arrivals.append((first, region, rack, shard))
        else:
            arrivals.append(min((first + draw([region, x.rack, x.shard], x.weight, seed + hash_tree.WAIT), region, x.rack, x.shard) for x in shards.values()))
    return min(arrivals)[1:]


def test_descent_by_hand(llm):
    keys = [None, 0, -5, 1 << 60, *range(100, 400)]
    df = llm.createDataFrame([(k,) for k in keys], "k long")
    trees = [hash_tree.layout(24), hash_tree.layout(13, 2, 3, {0: 5.0, 4: 0.0, 9: 0.5}), [hash_tree.Shard(7, 2, 1), hash_tree.Shard(1, 0, 5, 3.0)], [hash_tree.Shard(0, 0, 0)]]
    for tree in trees:
        got = df.select("k", hash_tree.place(F.col("k"), tree).alias("at")).collect()
        assert [(r["at"]["region"], r["at"]["rack"], r["at"]["shard"]) for r in got] == [twin(k, tree) for k in keys]
    for n in range(1, 41):
        assert hash_tree.with_one_more(hash_tree.layout(n)) == hash_tree.layout(n + 1)
    with pytest.raises(ValueError):
        hash_tree.place(F.col("k"), [hash_tree.Shard(0, 0, 0, 0.0)])


def test_growth_takes_rows_into_the_new_shard_alone(llm):
    """From 1 to 41 shards: even shares at each count, and no row moves but into the new one."""
    df, rows = llm.range(6000), 6000
    before = None
    for n in range(1, 42):
        now = [r[0] for r in df.orderBy("id").select(hash_tree.place(F.col("id"), hash_tree.layout(n))["shard"]).collect()]
        counts = np.bincount(now, minlength=n)
        assert len(counts) == n and (np.abs(counts - rows / n) < 5 * np.sqrt(rows / n)).all()
        assert before is None or all(x == y or y == n - 1 for x, y in zip(before, now, strict=True))
        before = now


def brute(rows, n=20):
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows], dtype=float)
    out = {}
    for q in (i for i in ids if i % 20 == 0):
        s = x @ x[ids.index(q)]
        out[q] = [ids[j] for j in np.lexsort((ids, -s)) if ids[j] != q][:n]
    return out


def test_nearest(llm):
    r = np.random.RandomState(3)
    good = [(i, r.standard_normal(16).astype(np.float32).tolist()) for i in range(1500)]
    same = good[0][1]
    good += [(2000 + i, same) for i in range(40)]
    odd = [(5000, None), (5001, []), (5002, [0.0] * 16), (5003, [None] * 16), (5004, [float("nan")] * 16), (5020, [1.0, 2.0]), (None, same)]
    df = llm.createDataFrame(good + odd + good[:3], "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = nndescent.nearest(df).collect()
    expected = brute(good)
    by: dict[int, list] = {}
    for x in sorted(got, key=lambda x: (x["query_id"], x["rank"])):
        by.setdefault(x["query_id"], []).append(x)
    assert set(by) == set(expected) and all([x["rank"] for x in v] == list(range(1, 21)) for v in by.values())
    hits = sum(len({x["vec_id"] for x in by[q]} & set(expected[q])) for q in expected)
    assert hits / (20 * len(expected)) >= 0.95
    vectors = dict(good)
    for x in got[:200]:
        assert abs(x["score"] - float(np.dot(np.array(vectors[x["query_id"]], float), np.array(vectors[x["vec_id"]], float)))) < 1e-9
    # copies come by id
    assert [x["vec_id"] for x in by[2000]][:3] == [0, 2001, 2002]


def test_rounds_converge(llm):
    """No edge stays new because its other direction is old already."""
    r = np.random.RandomState(5)
    nodes = llm.createDataFrame([(i, r.standard_normal(16).tolist()) for i in range(500)], "id long, x array<double>")
    codes, _ = nndescent._coded(nodes, 16)
    graph = nndescent.build_graph(codes, 500, 16).collect()
    assert len(graph) == 500 * 32 and sum(e["new"] for e in graph) <= 0.03 * len(graph)


def test_nearest_of_few(llm):
    few = llm.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(x)[:3] for x in nndescent.nearest(few).orderBy("query_id", "rank").collect()] == [(0, 1, 1), (0, 2, 20), (20, 1, 1), (20, 2, 0)]
    assert nndescent.nearest(few.limit(0)).isEmpty()


def test_pipeline(llm, tmp_path):
    import corpus_pipeline

    r = random.Random(8)
    rows, labels = [], []
    words = lambda n: " ".join(f"w{r.randrange(300)}" for _ in range(n))
    for i in range(400):
        toxic = i % 6 == 0
        w = words(60).split()
        for _ in range(6 * toxic):
            w.insert(r.randrange(len(w)), "grunzel")
        rows.append((i, " ".join(w), "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(toxic)))
    rows += [(500, rows[1][1], "en", "s0", 0), (501, rows[1][1] + " more", "en", "s1", 0), (502, words(40) + rows[2][1][:150] + words(40), "en", "s2", 0), (503, None, None, None, None), (504, "", "en", "s0", 0)]
    llm.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    llm.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = llm.read.parquet(str(tmp_path / "documents.parquet")), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(llm, docs, str(tmp_path)).write.parquet(str(tmp_path / f"{i}"))
        docs = llm.read.parquet(str(tmp_path / f"{i}"))
        seen.append(docs)
        if i < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    toxic = {i for i, _, t in labels if t}
    after = [{x["doc_id"] for x in d.select("doc_id").collect()} for d in seen]
    assert len(after[0] & toxic) < 5 and len({i for i, _, t in labels if not t} - after[0]) < 5
    assert 1 in after[1] and not {500, 501} & after[1] and {502, 503, 504} <= after[1]
    kept = {x["doc_id"]: x["text"] for x in seen[2].collect()}
    assert rows[2][1][:150] not in kept[502] and len(kept[502]) < len(rows[402][1])
    assert {"ids", "n_ids"} <= set(seen[4].columns) and seen[4].count() == seen[3].count()
    assert corpus_pipeline.run(llm, str(tmp_path)).count() == seen[4].count()
