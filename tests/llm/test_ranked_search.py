"""Ranked search against the definition, item by item and document by document."""

import math
import re

import numpy as np
import pytest

from strataweave.llm import ranked_search
from strataweave.llm.common import prepare

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string, score long, item_id long", "item_id long, text string, rank string"


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=20):
    split = [(d, terms(t)) for d, t in docs]
    n, total = sum(bool(t) for _, t in split), sum(len(t) for _, t in split)
    df = {}
    for _, t in split:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in {(i, t) for i, t in items if t is not None}:
        scored = []
        for d, t in split:
            score = 0
            for x in terms(text):
                tf = t.count(x)
                if tf:
                    m = 100 - 25 + 25 * len(t) * n // total
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (1_000_000_000 * tf // (1000 * tf + 12 * m))
            if score > 0:
                scored.append((-score, d is None, d))
        out += [(item, i, d, -s) for i, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def tables(seed):
    rng = np.random.default_rng(seed)
    words = ["Ab", "b", "É", "é", "日本", "x9", "9", "tail", "rare1", "rare2", "com", "mon"]
    docs = [(int(i), " ".join(rng.choice(words, rng.integers(1, 30)))) for i in rng.permutation(80)]
    docs += [(500, "b"), (501, "b"), (502, "b "), (503, None), (504, ""), (505, "!?"), (None, "b x9 x9"), docs[0], docs[0], (600, "com mon " * 60_000)]
    items = [(i, " ".join(rng.choice(words, rng.integers(1, 9)))) for i in range(12)]
    return docs, [*items, (3, "second text b"), (3, "second text b"), (20, None), (21, ""), (22, "nowhere"), (23, "rare1 rare1 RARE1 b"), (None, "b b")]


@pytest.mark.parametrize("item_bytes", [ranked_search.ITEM_BYTES, 60])
def test_equals_the_definition(spark, item_bytes):
    docs, items = tables(4)
    left = prepare(spark).createDataFrame([(d, t, 1, 2) for d, t in docs], DOCS).repartition(4)
    right = spark.createDataFrame([(i, t, "r") for i, t in items], ITEMS)
    got = [tuple(r) for r in ranked_search.search(left, right, item_bytes=item_bytes).collect()]
    assert sorted(got, key=str) == brute(docs, items)


def test_rows_of_a_product_in_steps(spark, monkeypatch):
    docs, items = tables(5)
    left = prepare(spark).createDataFrame([(d, t, 1, 2) for d, t in docs], DOCS)
    right = spark.createDataFrame([(i, t, "r") for i, t in items], ITEMS)
    block = ranked_search.Block(right.select("text").toArrow().column("text").combine_chunks())
    texts = left.select("text").toArrow().column("text").combine_chunks()
    length, term, text, times = ranked_search.postings(texts, block.vocabulary)
    weight = ranked_search.weights(90, np.bincount(term, minlength=len(block.vocabulary)))
    whole = [np.concatenate(c) for c in zip(*ranked_search.product(block, weight, 90, 900, length, term, text, times))]
    monkeypatch.setattr(ranked_search, "PRODUCTS", 50)
    steps = list(ranked_search.product(block, weight, 90, 900, length, term, text, times))
    assert len(steps) > 3 and all((np.concatenate(c) == w).all() for c, w in zip(zip(*steps), whole))


def test_empty_tables(spark):
    docs, items = prepare(spark).createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "b", "r")], ITEMS)
    assert ranked_search.search(docs, items).collect() == [] and ranked_search.search(docs, some).collect() == []
    assert ranked_search.search(spark.createDataFrame([(1, "b", 1, 1)], DOCS), items).columns == ["item_id", "rank", "doc_id", "score"]
