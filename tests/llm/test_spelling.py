"""Spelling variants against a search of all pairs by edit distance."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from strataweave.llm import spelling
from strataweave.llm.common import prepare

SCHEMA = "doc_id long, text string, word string, form string"


def near(a: str, b: str) -> bool:
    """Exactly one letter inserted, deleted or replaced, by the textbook table."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1] == 1


def brute(rows: list[tuple], least: int, times: int) -> set[tuple]:
    counted: Counter = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(x.lower() if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counted[run] += len(run) >= 6
    n = {w: c for w, c in counted.items() if c >= least}
    others = {w: [x for x in n if near(w, x)] for w in n}
    best = {w: min(o, key=lambda x: (-n[x], x), default=None) for w, o in others.items()}
    form = {w: b if b is not None and n[b] >= times * n[w] else None for w, b in best.items()}
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(others[w]), n[form[w]] if form[w] else None))
    return out


def rows_of(seed: int) -> list[tuple]:
    """Texts of few syllables, so that many words are near; a chain of ever rarer misspellings, nulls, repeats, long ones."""
    rng = np.random.default_rng(seed)
    syllables = ["ba", "bab", "à", "éï", "na", "nan", "st", "ÿx", "e", "aaa"]
    vocabulary = ["".join(rng.choice(syllables, rng.integers(2, 6))) for _ in range(250)]
    rows = [(i, " ".join(rng.choice(vocabulary, 60)) + rng.choice([".", "×", " Õ÷x ", "\n"])) for i in range(70)]
    rows += [(100 + i, "Foreverly " * 125 + "foreverli " * 25 + "foreveli " * 5) for i in range(2)]
    long = "abcdefghij" * 30
    rows += [(200 + i, f"{long} {long[:150]}{long[151:]} Œuvre_Œuvre1œuvreœ") for i in range(7)]
    return [*rows, (None, None), (None, "banana " * 9), (5, ""), rows[0], rows[0]]


@pytest.mark.parametrize("block", [spelling.BLOCK, 7])
def test_equals_a_search_of_all_pairs(spark, block):
    rows = rows_of(3)
    docs = prepare(spark).createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA).repartition(5)
    got = [tuple(r) for r in spelling.variants(docs, block=block).collect()]
    want = brute(rows, 5, 5)
    assert len(got) == len(want) and set(got) == want
    assert any(r[1] is not None and r[2] != r[1] for r in got), "a chain of forms"
    assert len({r[2] for r in got}) < len(got)


def test_no_words_and_no_rows(spark):
    for rows in ([], [(1, None, None, None), (2, "", None, None), (3, "short wo rds 12345678", None, None)]):
        assert spelling.variants(prepare(spark).createDataFrame(rows, SCHEMA)).collect() == []


def test_checksums_of_joined_strings():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.bytes(int(rng.integers(0, 30))), rng.bytes(int(rng.integers(1, spelling.TABLE_BYTES + 1)))
        got = spelling.joined_crc(*(np.array([zlib.crc32(x)], np.uint32) for x in (a, b)), np.array([len(b)]))
        assert got[0] == zlib.crc32(a + b)


def test_the_bound_keeps_every_edit():
    """Whatever the edit, enough grams stay, and one of the rarest of both words is among them."""
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 5, spelling.BUCKETS)
    for _ in range(300):
        word = rng.integers(97, 100, int(rng.integers(6, 12))).astype(np.uint8)
        at = int(rng.integers(0, len(word) + 1))
        other = np.insert(word, at, 98) if rng.random() < 0.5 else np.where(np.arange(len(word)) == at, 120, word).astype(np.uint8)
        short, long = spelling.grams(word[None]), spelling.grams(other[None])
        assert spelling.shared_grams(short, long)[0] >= len(other) - 1
        ours = {(int(short[0, p]), p) for p in spelling.rarest(short, counts)[1]}
        theirs = {(int(long[0, p]), p) for p in spelling.rarest(long, counts)[1]}
        shifts = (0, 1) if len(other) > len(word) else (0,)
        assert any((g, p + s) in theirs for g, p in ours for s in shifts)
