"""Packing by hash range: whatever the number of buckets and however long the stretches, results are the same."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataweave.llm import bwt, common, partenum

SCHEMA = "doc_id long, text string"


def rows(seed):
    r = random.Random(seed)
    base = " ".join(f"w{r.randrange(300)}" for _ in range(400))
    out = [(i, base[a : a + r.randrange(50, 900)] + f" {i}") for i, a in enumerate(r.randrange(900) for _ in range(40))]
    return out + [(50, None), (51, ""), (52, base), (53, base), (54, base), (55, "few words"), (None, base[:300])]


@pytest.mark.parametrize("buckets", [1, 70_000])
def test_buckets(llm, buckets):
    df = llm.createDataFrame(rows(1), SCHEMA)
    assert sorted(map(tuple, bwt.removed_bytes(df, buckets=buckets).collect()), key=str) == sorted(map(tuple, bwt.removed_bytes(df).collect()), key=str)
    counted = partenum.count_shingles(df)
    assert sorted(map(tuple, partenum.count_shingles(df, buckets).collect()), key=str) == sorted(map(tuple, counted.collect()), key=str)
    assert counted.where("n_shared > 0 and n_shared < n_shingles").count() > 20


def test_stretches():
    """Each window is in one run, under the same anchor, however a text is divided."""
    r = np.random.RandomState(2)
    data, offsets = r.randint(97, 101, 5000).astype(np.uint8), np.array([0, 0, 1300, 1350, 4990, 5000])

    def each(**options):
        first, many, h = bwt.runs(data, offsets, **options)
        return np.concatenate([first[i] + np.arange(n) for i, n in enumerate(many)]).tolist(), np.repeat(h, many).tolist()

    for stretch in (1, 90, 777):
        assert each(stretch=stretch) == each()


def test_hashes_by_stretch(monkeypatch):
    data, begin = np.random.RandomState(3).randint(0, 256, 3000).astype(np.uint8), np.array([0, 5, 99, 100, 101, 640, 2900])
    whole = bwt.window_hashes(data, begin)
    monkeypatch.setattr(bwt, "STRETCH", 100)
    assert (bwt.window_hashes(data, begin) == whole).all()


def test_copies_dealt(llm, monkeypatch):
    """A large group of copies goes to several tasks and is answered alike."""
    df = llm.createDataFrame(rows(4), SCHEMA).unionByName(llm.range(100, 160).select(F.col("id").alias("doc_id"), F.lit("copy " * 60).alias("text")))
    plain = sorted(map(tuple, bwt.removed_bytes(df).collect()), key=str)
    monkeypatch.setattr(common, "HOT_ROWS", 7)
    assert sorted(map(tuple, bwt.removed_bytes(df).collect()), key=str) == plain
    assert [x[0] for x in plain if x[0] is not None and x[0] >= 100 and x[2] == x[1] == 300] == list(range(101, 160))


def test_merges_have_several_shards(llm, monkeypatch):
    """On a whole table every merge takes the transforms of at least two shards, and an anchor's strings come from several."""
    df = llm.createDataFrame(rows(5), SCHEMA).where("doc_id is not null and text is not null").withColumn("h", F.xxhash64("text")).withColumn("g", F.xxhash64(F.lit(1), "text"))
    seen, across, merge = [], [], bwt.merge

    def counting(rounds):
        shard, group = merge(rounds)
        seen.append(len(rounds[0]))
        across.append(any(len(np.unique(shard[group == g])) > 1 for g in np.flatnonzero(np.bincount(group) > 1)[:200]))
        return shard, group

    monkeypatch.setattr(bwt, "merge", counting)
    table = df.select("doc_id", "text", "h", "g").toArrow().combine_chunks().to_batches()[0]
    data, offsets = bwt.flat_bytes(table.column("text"))
    start, _, h = bwt.runs(data, offsets)
    _, place, count = np.unique(h, return_inverse=True, return_counts=True)
    per = np.diff(np.searchsorted(start, offsets))
    ends = np.cumsum(per)
    flags = (count[place] > 1).astype(np.uint8)
    batch = table.append_column("flags", bwt._binary([flags[e - n : e].tobytes() for e, n in zip(ends, per, strict=True)]))
    for x in bwt._strings(1, 1)(iter([batch])):
        bwt._merged(pa.Table.from_batches([x]))
    assert seen and min(seen) >= 2 and any(across)
